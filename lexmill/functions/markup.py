"""Column functions over marked-up and scanned text: Markdown to text, OCR repairs, paragraph rebuilding, mind maps, PDF quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.questions import stripped

#: What goes from Markdown, in this order (inline code before fenced blocks).
MARKDOWN = [
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^#{1,6}\s+", ""), (r"\*\*(.+?)\*\*", "$1"), (r"__(.+?)__", "$1"),
    (r"(?<!\*)\*(?!\*)(.+?)(?<!\*)\*(?!\*)", "$1"), (r"(?<!_)_(?!_)(.+?)(?<!_)_(?!_)", "$1"), (r"`([^`]*)`", "$1"), (r"```[\s\S]*?```", ""),
    (r"(?m)^[-*_]{3,}\s*$", ""), (r"(?m)^[\s]*[-*+]\s+", ""), (r"(?m)^[\s]*\d+\.\s+", ""), (r"(?m)^>\s?", ""), (r"~~(.+?)~~", "$1"), (r"<[^>]+>", ""), (r"\n{3,}", "\n\n"),
]
#: OCR slips and what they stand for.
OCR = [(r"[|l](?=[a-z])", "I"), (r"(?<=[a-z])[0O](?=[a-z])", "o"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"), (r"\n[a-zA-Z]\n", "\n")]
#: Repairs of text taken from pages, before paragraphs are rebuilt.
REPAIRS = [
    (r"([a-zA-Z])-\s*\n\s*([a-z])", "$1$2"), (r"([^\n.!?。！？])\n([a-z一-鿿])", "$1 $2"), (r"\s+([，。！？；：、）】」』])", "$1"), (r"([（【「『])\s+", "$1"), (r"([,!?;:])([a-zA-Z])", "$1 $2"),
    (r"\s+([,.!?;:])", "$1"), (r" {2,}", " "), (r"\n{3,}", "\n\n"), (r"(\d+)\.\s*([a-zA-Z一-鿿])", "$1. $2"), (r"\(\s+", "("), (r"\s+\)", ")"),
]
#: Lines that begin a paragraph, ends of sentences, and how a new one begins.
NEW_PARAGRAPH = r"^#{1,6}\s|^[\-\*\+]\s|^\d+\.\s|^__IMG_PLACEHOLDER_"
SENTENCE_END, SENTENCE_BEGIN = r"[.!?。！？]\s*$", "^[A-Z一-鿿]"
IMAGE = r"!\[[^\]]*\]\([^)]+\)"
GARBLED = r"[�□■◆●○◇△▽▲▼\x00-\x08\x0b\x0c\x0e-\x1f]"


def _each(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, by in rules:
        text = F.regexp_replace(text, f"(?d){pattern}", by)
    return text


def markdown_text(text: Column) -> Column:
    """Markdown as plain text."""
    return stripped(_each(text, MARKDOWN))


def ocr_text(text: Column) -> Column:
    """OCR output with common slips mended, blanks squeezed and lone letters on a line left out."""
    return stripped(_each(text, OCR))


def paragraphs(text: Column) -> Column:
    """Lines joined into paragraphs, with a blank line between: headings, list items and images begin one, as do capitals after a sentence's end."""
    lines = F.transform(F.split(text, "\n"), stripped)
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        begins = (acc["now"] == "") | line.rlike(NEW_PARAGRAPH) | (acc["now"].rlike(SENTENCE_END) & line.rlike(SENTENCE_BEGIN))
        closed = F.when((begins | (line == "")) & (acc["now"] != ""), F.array_append(acc["out"], acc["now"])).otherwise(acc["out"])
        now = F.when(begins | (line == ""), line).otherwise(F.concat(acc["now"], F.lit(" "), line))
        return F.struct(now.alias("now"), closed.alias("out"))

    return F.aggregate(lines, start, step, lambda a: F.array_join(F.when(a["now"] != "", F.array_append(a["out"], a["now"])).otherwise(a["out"]), "\n\n"))


def rebuilt(text: Column) -> Column:
    """Page text as paragraphs: hyphens, sentences, punctuation, blanks and list items mended; images stay as they are."""
    images = F.regexp_extract_all(text, F.lit(f"({IMAGE})"), 1)
    pieces = F.split(text, IMAGE)
    numbered = F.transform(pieces, lambda p, i: F.when(i < F.size(pieces) - 1, F.concat(p, F.lit("__IMG_PLACEHOLDER_"), i.cast("string"), F.lit("__"))).otherwise(p))
    made = paragraphs(_each(F.array_join(numbered, ""), REPAIRS))
    restored = F.aggregate(F.arrays_zip(images.alias("image"), F.sequence(F.lit(0), F.size(images)).alias("i")), made, lambda t, x: F.when(x["image"].isNull(), t).otherwise(F.replace(t, F.concat(F.lit("__IMG_PLACEHOLDER_"), x["i"].cast("string"), F.lit("__")), x["image"])))
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(stripped(restored))


def mindmap_markdown(text: Column) -> Column:
    """A mind map in asterisks as Markdown headings of the same depth."""
    inner = F.regexp_extract(text, r"(?is)@startmindmap\s*(.*?)\s*@endmindmap", 1)
    body = stripped(F.when(text.rlike(r"(?is)@startmindmap\s*.*?\s*@endmindmap"), inner).otherwise(text))
    lines = F.filter(F.transform(F.split(body, "\n"), stripped), lambda x: x != "")
    stars = lambda x: F.regexp_extract(x, r"^(\*+)", 1)
    heading = lambda x: F.concat(F.repeat(F.lit("#"), F.length(stars(x))), F.lit(" "), stripped(F.regexp_extract(x, r"^\*+\s*(.*)", 1)))
    return F.array_join(F.transform(lines, lambda x: F.when(F.startswith(x, F.lit("*")), heading(x)).otherwise(x)), "\n")


def pdf_reason(text: Column, pages: Column) -> Column:
    """Why a document's text needs OCR: ``short``, ``garbled``, ``thin`` or ``meaningless``; ``fine`` if it does not."""
    n = F.length(F.coalesce(text, F.lit("")))
    garbled = n - F.length(F.regexp_replace(text, GARBLED, ""))
    letters = F.length(F.regexp_replace(text, r"(?U)[\s\d\W]", ""))
    return (
        F.when((n == 0) | (F.length(stripped(text)) < 100), "short")
        .when(garbled / n > 0.05, "garbled")
        .when(n / F.greatest(pages, F.lit(1)) < 200, "thin")
        .when(letters < n * 0.3, "meaningless")
        .otherwise("fine")
    )
