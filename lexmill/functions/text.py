"""Column functions over text: tokens, sizes, predicates, cleaning, query analysis."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The token pattern (CJK runs or lower-case ASCII alphanumeric runs).
TOKEN = "[一-鿿]+|[a-z0-9]+"

#: Keywords by which a question's kind is told, in the order in which kinds are tried.
OVERVIEW_WORDS = ["总结", "概括", "概述", "简述", "大意", "主要内容", "讲什么", "关于什么", "介绍", "背景", "整体", "全文", "有哪些", "包括什么", "涉及什么", "summary", "summarize", "overview", "outline", "main idea", "what is this about", "what does it cover"]
ANALYTICAL_WORDS = ["分析", "解释", "说明", "为什么", "怎么", "如何", "原因", "理由", "比较", "对比", "区别", "差异", "联系", "关系", "优缺点", "利弊", "优势", "劣势", "影响", "作用", "analyze", "explain", "why", "how does", "compare", "difference", "advantage", "disadvantage", "impact"]
EXTRACTION_WORDS = ["具体", "详细", "准确", "精确", "数据", "数值", "数字", "步骤", "流程", "过程", "方法", "公式", "代码", "原文", "specific", "detail", "exact", "data", "number", "step", "procedure", "formula", "code", "algorithm"]
#: Results asked for, vector weight and candidates by kind of question.
TOP_K = {"overview": 15, "extraction": 5, "analytical": 12, "specific": 10}
ALPHA = {"extraction": 0.35, "overview": 0.65, "analytical": 0.55, "specific": 0.5}
CANDIDATES = {"extraction": 50, "overview": 30, "analytical": 25, "specific": 20}
GRANULARITY = {"overview": ("summary", 10), "extraction": ("full", 3), "analytical": ("digest", 5), "specific": ("digest", 5)}
#: Words that tell a question about references.
REFERENCE_WORDS = ["参考文献", "文献", "引用", "引文", "相关工作", "references", "reference", "bibliography", "citation", "citations", "related work"]
#: Keywords of memory tags, and what else makes a fact.
TAG_WORDS = {
    "concept": ["定义", "概念", "是指", "refers to", "definition", "meaning of"],
    "fact": ["数据", "统计", "百分比", "percent", "data", "statistics"],
    "preference": ["喜欢", "偏好", "prefer", "习惯", "倾向", "favorite"],
    "method": ["方法", "步骤", "流程", "algorithm", "approach", "procedure"],
    "conclusion": ["结论", "总结", "因此", "therefore", "conclude", "综上"],
    "correction": ["纠正", "错误", "不对", "correct", "wrong", "mistake"],
}
FACT_PATTERN = r"[0-9]+%|[0-9]{4}[-/年][0-9]{1,2}|[0-9]+\.[0-9]+"
#: Lines that are never garbage.
WHITELIST = [r"^\s*\[\d+\]", r"^\s*\(\d+\)", r"^\s*Fig\.\s*\d+", r"^\s*Table\s*\d+", r"^\s*Eq\.\s*\d+", r"^\s*§\s*\d+", "[α-ωΑ-Ω∑∏∫∂∇±×÷≤≥≠≈∞∈∉⊂⊃∪∩]", r"\$.*\$", r"\\[a-zA-Z]+", r"^\s*\d+\.\s+", r"^\s*[a-z]\)\s+", r"^\s*•\s+", r"^\s*-\s+", "https?://", "[a-zA-Z0-9._%+-]+@"]


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return reduce(Column.__or__, [text.contains(w) for w in words])


def by_key(key: Column, values: dict, default: object) -> Column:
    """A value looked up by a column among a few fixed keys."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(default)


def cjk_ngrams(run: Column) -> Column:
    """All one-, two- and three-character pieces of a run."""
    n = F.length(run)
    piece = lambda size: F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(run, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    return F.concat(piece(1), piece(2), piece(3))


def tokens(text: Column) -> Column:
    """Lexical tokens: ASCII runs of two characters or more; CJK runs as their n-grams.

    Texts without CJK, nearly all, take one regular expression and no function over its matches.
    """
    low = F.lower(text)
    runs = F.regexp_extract_all(low, F.lit(f"({TOKEN})"), 1)
    mixed = F.flatten(F.transform(runs, lambda r: F.when(r.rlike("^[一-鿿]"), cjk_ngrams(r)).when(F.length(r) > 1, F.array(r)).otherwise(F.array().cast("array<string>"))))
    return F.when(text.rlike("[一-鿿]"), mixed).otherwise(F.regexp_extract_all(low, F.lit("([a-z0-9]{2,})"), 1))


def token_count(text: Column) -> Column:
    """How many tokens a text has, without listing them where it has no CJK."""
    return F.when(text.rlike("[一-鿿]"), F.size(tokens(text))).otherwise(F.regexp_count(F.lower(text), F.lit("[a-z0-9]{2,}")))


def count_of(text: Column, pattern: str) -> Column:
    """Characters left when only those of the class ``pattern`` stay."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def estimate_tokens(text: Column) -> Column:
    """ceil(CJK characters / 1.5 + others / 4)."""
    cjk = count_of(text, r"[一-鿿㐀-䶿豈-﫿\x{20000}-\x{2A6DF}]")
    return F.ceil(cjk / 1.5 + (F.length(text) - cjk) / 4.0).cast("long")


def estimate_embedding_tokens(text: Column) -> Column:
    """int(ASCII / 3.5 + 1.1 * others), the estimate that batches are cut by."""
    other = count_of(text, r"[^\x00-\x7F]")
    return F.floor((F.length(text) - other) / 3.5 + other * 1.1).cast("long")


def language(text: Column) -> Column:
    """``cjk`` if more than a tenth of the characters are CJK, else ``en``."""
    return F.when((F.length(text) > 0) & (count_of(text, "[一-鿿]") / F.length(text) > 0.1), "cjk").otherwise("en")


def query_type(query: Column) -> Column:
    q = F.lower(query)
    return F.when(contains_any(q, OVERVIEW_WORDS), "overview").when(contains_any(q, ANALYTICAL_WORDS), "analytical").when(contains_any(q, EXTRACTION_WORDS), "extraction").otherwise("specific")


def is_reference_query(query: Column) -> Column:
    return contains_any(F.lower(query), REFERENCE_WORDS)


def is_reference_like(text: Column, most: int = 1200) -> Column:
    """Whether a text reads like a list of references: a keyword, or two of five signals at its start.

    The patterns and thresholds are fixed values.
    """
    sample = F.substring(text, 1, most)
    low = F.lower(sample)
    hits = lambda t, p: F.regexp_count(t, F.lit(p))
    years = hits(sample, r"\b(?:19|20)\d{2}\b")
    lines = F.filter(F.transform(F.split(sample, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    numbered = F.size(F.filter(lines, lambda x: x.rlike(r"^\[?\d{1,3}\]?[.)]?\s")))
    signals = [
        hits(sample, r"\[[0-9]{1,3}\]") >= 2,
        years >= 2,
        (hits(low, "et al") >= 1) | (hits(sample, r"\b[A-Z][a-z]+,\s*(?:[A-Z]\.|[A-Z][a-z]+)") >= 2),
        hits(low, r"\b(?:doi|arxiv)\b") >= 1,
        (F.size(lines) > 0) & (numbered / F.greatest(F.size(lines), F.lit(1)) >= 0.35) & (years >= 1),
    ]
    return low.contains("references") | low.contains("bibliography") | sample.contains("参考文献") | (sum((s.cast("int") for s in signals), F.lit(0)) >= 2)


def is_table_fragment(text: Column) -> Column:
    """Loose numbers without a sentence: over a quarter numeric words and no stretch of 30 characters, or over half.

    The patterns and thresholds are fixed values.
    """
    words = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    core = F.transform(words, lambda t: F.regexp_replace(t, r"^[(),%↑↓·-]+|[(),%↑↓·-]+$", ""))
    ratio = F.size(F.filter(core, lambda t: t.rlike(r"^-?[0-9]+\.?[0-9]*[a-zA-Z]?$"))) / F.greatest(F.size(words), F.lit(1))
    sentence = F.exists(F.split(text, "[.!?。！？]"), lambda s: F.length(F.trim(s)) > 30)
    return (F.length(text) >= 20) & (F.size(words) >= 3) & (((ratio > 0.25) & ~sentence) | (ratio > 0.5))


def is_likely_table(text: Column) -> Column:
    """Of two lines or more: four pipes, or four tabs, or of three lines or more at least half with three digits."""
    lines = F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n")
    numeric = F.size(F.filter(lines, lambda x: F.length(F.regexp_replace(x, "[^0-9]", "")) >= 3))
    many = (F.regexp_count(text, F.lit(r"\|")) >= 4) | (F.regexp_count(text, F.lit("\t")) >= 4) | ((F.size(lines) >= 3) & (numeric >= 0.5 * F.size(lines)))
    return (F.size(lines) >= 2) & many


def auto_tags(content: Column) -> Column:
    """Sorted tags whose keywords occur; numbers, percentages and dates also make a fact."""
    low = F.lower(content)
    made = [F.when(contains_any(low, words) | (content.rlike(FACT_PATTERN) if tag == "fact" else F.lit(False)), tag) for tag, words in TAG_WORDS.items()]
    return F.array_sort(F.array_compact(F.array(*made)))


def preprocess(text: Column) -> Column:
    """Drop licence lines, blank lines and lines of NUL, join hyphenated words, squeeze blanks."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    nul = lambda x: count_of(x, r"\x00")
    keep = lambda x: ~F.lower(x).contains("authorized licensed use limited to") & ~F.lower(x).contains("all rights reserved") & ~((F.length(x) > 5) & (nul(x) / F.greatest(F.length(x), F.lit(1)) > 0.3))
    clean = F.filter(F.transform(F.filter(lines, keep), lambda x: F.regexp_replace(x, r"\x00", "")), lambda x: F.trim(F.regexp_replace(x, r"\s", " ")) != "")
    joined = F.regexp_replace(F.array_join(clean, "\n"), r"(?U)(\w)-\n(\w)", "$1$2")
    return F.regexp_replace(F.regexp_replace(joined, r"[ \t]+", " "), r"^\s+|\s+$", "")


def clean_text(text: Column) -> Column:
    """Without control characters other than tab and line ends, and without runs of replacement characters."""
    return F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), "�{2,}", "")


def is_garbage_line(line: Column) -> Column:
    """Over three tenths control, replacement or private-use characters, and not of a whitelisted form."""
    good = reduce(Column.__or__, [line.rlike(p) for p in WHITELIST])
    bad = count_of(line, r"[\x00-\x08\x0B\x0C\x0E-\x1F]") + count_of(line, "[�-]") + count_of(line, r"\x00")
    return (F.length(line) >= 2) & ~good & (bad / F.greatest(F.length(line), F.lit(1)) > 0.3)


#: Replacement and private-use characters.
ODD = r"[\x{FFFD}\x{E000}-\x{F8FF}]"


def page_score(text: Column, blocks: Column) -> Column:
    """0 to 100: full marks less penalties for NUL, odd characters, characters not usual in prose, and thin blocks."""
    n = F.greatest(F.length(text), F.lit(1))
    nul = F.when(F.contains(text, F.lit("\x00")), count_of(text, r"\x00")).otherwise(0) / n
    weird = F.when(text.rlike(ODD), count_of(text, ODD)).otherwise(0) / n
    odd = F.length(F.regexp_replace(text, r"[\p{L}\p{N} \t\n.,;:!?()\[\]{}\"'-]", ""))
    score = F.lit(100.0) - nul * 200 - weird * 150 - (odd / n) * 50 - F.when((blocks > 0) & (F.length(text) / blocks < 10), 20.0).otherwise(0.0)
    return F.when(F.length(text) > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).otherwise(0.0)


def page_reason(score: Column, threshold: float = 60) -> Column:
    return F.when(score >= 80, "good").when(score >= threshold, "acceptable").otherwise("poor_quality")


def html_text(html: Column) -> Column:
    """Text of HTML without scripts, styles, comments and tags, the commonest entities decoded, blanks squeezed."""
    t = F.regexp_replace(html, r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), "<[^>]*>", " ")
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(c))
    return F.trim(F.regexp_replace(t, r"[ \t\r\n]+", " "))


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def domain(url: Column) -> Column:
    """Lower-case network location of a URL, with user and port where it has them."""
    return F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))


def is_blocked(host: Column, blocked: Column) -> Column:
    """Whether a host is the blocked domain or under it."""
    return (host == blocked) | F.endswith(host, F.concat(F.lit("."), blocked))


#: XML's entities, in capitals where HTML has them so too; the ampersand comes last, so that nothing is decoded twice.
ENTITIES = [("&lt;", "<"), ("&LT;", "<"), ("&gt;", ">"), ("&GT;", ">"), ("&quot;", '"'), ("&QUOT;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&"), ("&AMP;", "&")]


def unescaped(text: Column) -> Column:
    for entity, c in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(c))
    return text


def is_number(text: Column) -> Column:
    return text.rlike(r"^[-+]?[0-9]*\.?[0-9]+$")


def mdhash(text: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.md5(text))


def similarity_of(distance: Column, metric: str) -> Column:
    """Inner products to (d + 1) / 2, squared distances to 1 / (1 + d), memories to d; all within 0 and 1."""
    value = {"ip": (distance + 1) / 2, "l2": F.lit(1.0) / (distance + 1), "memory": distance}[metric]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


def markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |"))


def char_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the characters of two texts."""
    chars = lambda t: F.array_distinct(F.filter(F.split(t, ""), lambda c: c != ""))
    union = F.size(F.array_union(chars(a), chars(b)))
    return F.when(union > 0, F.size(F.array_intersect(chars(a), chars(b))) / union).otherwise(0.0)


def inline_refs(answer: Column) -> Column:
    """Distinct citation numbers of an answer, in order: [n] that is no image or link, or the full-width form."""
    found = F.regexp_extract_all(answer, F.lit(r"((?<!!)\[\d{1,3}\](?!\()|【\d{1,3}】)"), 1)
    return F.array_distinct(F.transform(found, lambda x: F.regexp_extract(x, r"(\d+)", 1).cast("int")))


def keyword_list(text: Column, most: int = 6) -> Column:
    """Keywords of a list in prose: cut at commas and line ends, numbering, bullets and blanks stripped."""
    stripped = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    parts = F.transform(F.split(text, "[,，、\n]+"), lambda x: stripped(F.regexp_replace(F.regexp_replace(stripped(x), r"^[0-9]+[.)、]\s*", ""), r"^[-•]\s*", "")))
    return F.slice(F.filter(parts, lambda x: x != ""), 1, most)


def sentences(text: Column) -> Column:
    """Sentences cut after stops and line ends, trimmed, blank ones left out."""
    return F.filter(F.transform(F.split(text, r"(?<=[。！？.!?])\s*|(?<=\n)\s*"), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), lambda s: s != "")
