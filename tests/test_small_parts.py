"""Parts that need no Spark: common runs, term automata, brackets, small graphs, office files."""

import io
import random
import re
import zipfile
from difflib import SequenceMatcher
from itertools import combinations

import pytest

from lexmill.functions import latex
from lexmill.operators.context import Runs
from lexmill.operators.glossary import Automaton, Terms
from lexmill.operators.leiden import Small
from lexmill.sources import office


def test_longest_run_is_difflibs():
    rng = random.Random(1)
    for i in range(1000):
        letters = "ab" if i % 2 else "abcde "
        a, b = ("".join(rng.choices(letters, k=rng.randint(0, n))) for n in (25, 80))
        m = SequenceMatcher(None, a, b, autojunk=False).find_longest_match()
        assert Runs(a).longest(b) == (m.a, m.b, m.size), (a, b)


def test_runs_stay_linear():
    runs = Runs("ab" * 2000)
    assert len(runs.next) <= 2 * 4000 and runs.longest("ba" * 50_000)[2] == 4000


def plain_terms(entries, text):
    """Every entry looked for at every place."""
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    edge = lambda i: not 0 <= i < len(text) or not (text[i].isalnum() or text[i] == "_")
    first = {}
    for i, (term, translation, case, whole) in enumerate(entries):
        source, word = (text, term) if case else (low, term.lower())
        for at in range(len(text)):
            if source.startswith(word, at) and (not whole or not re.search("[A-Za-z0-9_]", term) or (edge(at - 1) and edge(at + len(word)))):
                hit = (at, int(not case), len(word), i)
                first[term, translation] = min(first.get((term, translation), hit), hit)
    return [(h[0], h[2], *p) for h, p in sorted((h, p) for p, h in first.items())]


def test_glossary_is_naive_scan():
    rng = random.Random(2)
    for _ in range(300):
        entries = sorted({("".join(rng.choices("abAé中 _", k=rng.randint(1, 4))), rng.choice("xy"), rng.random() < 0.5, rng.random() < 0.5) for _ in range(rng.randint(0, 12))})
        text = "".join(rng.choices("abABé中 _.İ", k=rng.randint(0, 60)))
        terms = Terms(entries)
        assert terms.found(text) == plain_terms(entries, text), (entries, text)
        assert terms.any(text) == bool(plain_terms(entries, text))


def test_automaton_reports_every_end():
    words = ["he", "she", "his", "hers", "e"]
    assert sorted(Automaton(words).ends("ushers")) == sorted((m.start() + len(w), i) for i, w in enumerate(words) for m in re.finditer(f"(?={w})", "ushers"))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (r"a \[x+1\] b \(y\) c", "a $$x+1$$ b $y$ c"),
        (r"\[ a \[ b \] c \]", r"$$ a \[ b \] c $$"),
        (r"\\[not\\] and \[open", r"\\[not\\] and \[open"),
        (r"\[open \(x\)", r"\[open $x$"),
        (r"\[a \[b\]", r"\[a $$b$$"),
        (r"`\(code\)` and [l \(x\)](u) \(x\)", r"`\(code\)` and [l \(x\)](u) $x$"),
        (r"\(a \\times b\)", r"$a \times b$"),
        (r"so \frac{a}{b} is \unknown{c}", r"so $\frac{a}{b}$ is \unknown{c}"),
        (r"$a \\cdot b$ kept", r"$a \cdot b$ kept"),
        ("```\n\\[x\\]\n``` \\[y\\]", "```\n\\[x\\]\n``` $$y$$"),
        ("no formulas", "no formulas"),
        ("", ""),
    ],
)
def test_brackets(text, want):
    assert latex.dollars(text) == want


def test_many_open_brackets_stay_linear():
    assert latex.dollars(r"\[" * 50_000 + r"\(x\)").endswith("$x$")


def quality(edges, of):
    total = 2 * sum(w for _, _, w in edges)
    k, inner = {}, 0.0
    for a, b, w in edges:
        k[a], k[b] = k.get(a, 0) + w, k.get(b, 0) + w
        inner += 2 * w * (of[a] == of[b])
    sums = {}
    for v, x in k.items():
        sums[of[v]] = sums.get(of[v], 0) + x
    return inner / total - sum(x * x for x in sums.values()) / total**2


def test_small_leiden_is_best_on_small_graphs():
    """Of all partitions of six nodes none is much better; rings of cliques come apart into cliques."""
    rng = random.Random(3)

    def partitions(names):
        if not names:
            yield {}
            return
        for rest in partitions(names[1:]):
            for c in {*rest.values(), names[0]}:
                yield {names[0]: c, **rest}

    for _ in range(30):
        edges = [(a, b, float(rng.randint(1, 3))) for a, b in combinations("abcdef", 2) if rng.random() < 0.5]
        if not edges:
            continue
        graph = Small(edges)
        best = max(quality(edges, p) for p in partitions(graph.names))
        assert quality(edges, graph.communities()) >= best - 0.1
    ring = [(f"{c}{i}", f"{c}{j}", 1.0) for c in "abcdefgh" for i, j in combinations(range(5), 2)] + [(f"{c}0", f"{d}1", 1.0) for c, d in zip("abcdefgh", "bcdefgha")]
    found = Small(ring).communities()
    assert {v: found[v] for v in found} == {v: f"{v[0]}0" for v in found}


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def docx():
    cell = lambda t, more="": f"<w:tc><w:tcPr>{more}</w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = (
        '<w:p><w:pPr><w:pStyle w:val="h2"/></w:pPr><w:r><w:t>Title &amp; more</w:t></w:r></w:p><w:p><w:r><w:t xml:space="preserve">one </w:t><w:tab/><w:t>two</w:t></w:r><w:hyperlink><w:r><w:t> link</w:t></w:r></w:hyperlink><w:del><w:r><w:delText>gone</w:delText></w:r></w:del></w:p><w:p/>'
        f'<w:tbl><w:tr>{cell("a")}{cell("b")}</w:tr><w:tr>{cell("wide", "<w:gridSpan w:val=%s2%s/>" % (chr(34), chr(34)))}</w:tr><w:tr>{cell("", "<w:vMerge/>")}{cell("z")}</w:tr></w:tbl>'
        '<w:p><w:pPr><w:pStyle w:val="odd"/></w:pPr><w:r><w:t>Plain heading</w:t></w:r></w:p>'
    )
    styles = f'<w:styles {W}><w:style w:styleId="h2"><w:name w:val="heading 2"/></w:style><w:style w:styleId="odd"><w:name w:val="Heading"/></w:style></w:styles>'
    return zipped({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles})


def xlsx():
    rows = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>in</t></is></c></row><row r="2"><c r="A2"><v>3</v></c><c r="B2"><v>2.5</v></c><c r="C2" t="b"><v>1</v></c></row>'
        '<row r="3"><c r="A3" t="s"><v>2</v></c></row><row r="4"><c r="B4" s="1"><v>45292</v></c><c r="C4" t="str"><f>A1</f><v>made</v></c></row>'
    )
    return zipped(
        {
            "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="First" sheetId="1" r:id="rId1"/><sheet name="Empty" sheetId="2" r:id="rId2"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
            "xl/sharedStrings.xml": f"<sst {S}><si><t>head</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si><si><t> </t></si></sst>",
            "xl/styles.xml": f'<styleSheet {S}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
            "xl/worksheets/sheet1.xml": f"<worksheet {S}><sheetData>{rows}</sheetData></worksheet>",
            "xl/worksheets/sheet2.xml": f"<worksheet {S}><sheetData/></worksheet>",
        }
    )


DOCX = "## Title & more\n\none \ttwo link\n\n| a | b |\n| --- | --- |\n| wide | wide |\n| wide | z |\n\n# Plain heading"
XLSX = "## First\n\n| head |  | in |\n| --- | --- | --- |\n| 3 | 2.5 | True |\n|  | 2024-01-01 00:00:00 | made |\n\n## Empty"


def test_office_files():
    assert office.docx_markdown(docx()) == DOCX
    assert office.xlsx_markdown(xlsx()) == XLSX


def test_office_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("a.docx", docx()), ("in/b.xlsx", xlsx()), ("broken.docx", b"no zip"), ("c.txt", b"text")):
        (tmp_path / name).write_bytes(data)
    entities = zipped({"word/document.xml": '<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>'})
    (tmp_path / "bad.docx").write_bytes(entities)
    got = {r["path"].rsplit("/", 1)[1]: r for r in office.office_documents(spark, str(tmp_path)).collect()}
    assert got["a.docx"]["text"] == DOCX and got["b.xlsx"]["text"] == XLSX and set(got) == {"a.docx", "b.xlsx", "broken.docx", "bad.docx"}
    assert got["broken.docx"]["text"] is None and "BadZipFile" in got["broken.docx"]["error"] and "entities" in got["bad.docx"]["error"]


def test_sums_in_the_order_of_events(spark, tmp_path):
    """Whether a user's prompt is out goes by a sum of floats, which partial sums of files would change."""
    import duckdb
    from pyspark.sql import functions as F

    from lexmill.plans.context_queries import Q

    values = [0.1, 0.7, 0.3, 0.6, 0.2, 0.9, 1.3, 2.1, 0.8, 5.3, 1.1, 0.4]
    rows = [(u * 100 + i, u, t, values[(i * (u + 1) + u) % len(values)] + u % 7) for u in range(300) for i in range(12) for t in ["click" if i % 3 else "view"]]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' AS ts")
    # a user's events lie in all of the files
    events.repartitionByRange(7, (F.col("event_id") * 37) % 101).write.parquet(str(tmp_path / "events.parquet"))
    duck = duckdb.connect(config={"threads": 1})
    duck.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet') ORDER BY event_id")
    wanted = duck.execute(Q["prompt_selection"][1]).fetchall()
    got = [(r["user_id"], r["prompt_id"]) for r in Q["prompt_selection"][0](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(wanted) and len(got) > 100
