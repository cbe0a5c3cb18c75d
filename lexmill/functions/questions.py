"""Column functions over questions: rewriting, intents, web queries, answer styles, parsing of models' short replies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.text import contains_any

#: Colloquial phrases and what stands for them, the more special first.
COLLOQUIAL = [
    (r"(.+?)啥意思", "$1的含义和解释"), (r"啥意思", "的含义和解释"),
    (r"(.+?)讲了啥", "$1的主要内容"), (r"(.+?)说了啥", "$1的主要内容"), (r"讲了啥", "的主要内容"), (r"说了啥", "的主要内容"),
    (r"啥是\s*(.+)", "$1的定义"), (r"(.+?)是啥", "$1的定义"),
    (r"为啥要?\s*(.+)", "$1的原因和目的"), (r"为啥", "的原因"),
    (r"咋用\s*(.+)", "$1的使用方法"), (r"(.+?)咋用", "$1的使用方法"), (r"怎么用\s*(.+)", "$1的使用方法"), (r"(.+?)怎么用", "$1的使用方法"),
    (r"咋(.+)", "如何$1"), (r"啥(.+)", "什么$1"),
]
#: Pronouns that a selection stands for.
PRONOUNS = ["这个", "那个", "这块", "那块", "这部分", "那部分", "这段", "那段", "这里", "那里", "它"]
#: Words of web queries that need the selection.
WEB_PRONOUNS = ["这个", "该", "它", "上述", "此", "这种", "这些", "这项", "该项", "本方法", "this", "that", "it", "they", "he", "she", "them"]
#: Words that ask for a web search, and words that rule it out.
SEARCH_WORDS = ["最新", "现在", "今", "近期", "当前", "实时", "更新", "新闻", "最近", "版本", "上市", "发布", "latest", "current", "recent", "news", "now", "today", "update", "release", "2024", "2025", "2026", "谁是", "谁当", "多少钱", "价格", "股价", "汇率", "天气"]
NO_SEARCH_WORDS = ["摘要", "总结", "概括", "翻译", "解释", "分析图表", "本文", "文章", "文档", "此处", "这段", "图中", "表格", "公式", "作者怎么", "文中", "怎么理解", "什么意思", "summarize", "translate", "explain this", "what does this mean"]
#: What makes a question worth taking apart.
DECOMPOSE = "比较|区别|异同|不同|优缺点|对比|差异|相同|各自|分别|以及|和.*的关系|与.*的区别"
#: Words that ask for a mind map, and for a flow chart.
MINDMAP_WORDS, FLOWCHART_WORDS = ["思维导图", "脑图", "mindmap", "mind map"], ["流程图", "flowchart", "flow chart", "mermaid"]
#: Tokens of detailed and standard answers, and those that a structured list of citations takes.
DETAILED_TOKENS, STANDARD_TOKENS, CITATION_TOKENS = 8192, 4096, 1024


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that it names several times: over an array of one, the value is made once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_replaced(text: Column, literal: Column, by: Column) -> Column:
    """The first occurrence of a literal replaced; the text as it is without one."""
    at = F.position(literal, text)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), by, F.substring(text, at + F.length(literal), F.length(text)))).otherwise(text)


def key_content(text: Column, most: int = 50) -> Column:
    """The first sentence of a selection, cut at ``most`` characters; empty for blank ones."""
    pieces = F.filter(F.transform(F.split(stripped(text), "[。！？\n；;!?]"), stripped), lambda s: s != "")
    return F.substring(F.coalesce(F.get(pieces, F.lit(0)), stripped(text), F.lit("")), 1, most)


def without_colloquial(query: Column) -> Column:
    """The first of COLLOQUIAL that changes the query, applied."""
    changed = [F.nullif(F.regexp_replace(query, f"(?d){p}", by), query) for p, by in COLLOQUIAL]
    return F.coalesce(*changed, query)


def rewritten(query: Column, selected: Column) -> Column:
    """A query for retrieval: pronouns give way to the selection's key content, colloquial phrases to plain ones.

    A query that neither changes gets the selection's first 80 characters behind it.  Blank queries stay.
    """
    chosen = F.coalesce(stripped(selected), F.lit(""))
    pronouns = F.array(*map(F.lit, PRONOUNS))
    resolved = F.when(chosen != "", bound(key_content(chosen), lambda key: F.aggregate(pronouns, query, lambda acc, p: first_replaced(acc, p, key)))).otherwise(query)
    longer = F.concat(query, F.lit(" "), key_content(chosen, 80))
    plain = bound(bound(resolved, without_colloquial), lambda p: F.when((chosen != "") & (p == query), longer).otherwise(p))
    return F.when(stripped(query) == "", query).otherwise(plain)


def squeezed(text: Column, most: int = 200) -> Column:
    return F.substring(stripped(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), 1, most)


def web_query(query: Column, question: Column, title: Column, snippet: Column) -> Column:
    """What to ask the web: the query, the title unless it is in there, and for questions with pronouns the selection's relevant ``snippet``.

    Snippets that read like reference lists are left out by the caller; all is cut at 260 characters.
    """
    base = squeezed(F.when(F.coalesce(query, F.lit("")) != "", query).otherwise(question), 180)
    name = F.regexp_replace(squeezed(title, 80), r"(?i)\.(pdf|docx?|txt|md)$", "")
    named = F.when((name != "") & ~F.contains(F.lower(base), F.lower(name)), F.concat(F.lit(" "), name)).otherwise("")
    asked = F.when(F.coalesce(question, F.lit("")) != "", question).otherwise(base)
    part = squeezed(snippet, 80)
    chosen = F.when(contains_any(F.lower(asked), WEB_PRONOUNS) & (part != ""), F.concat(F.lit(" "), part)).otherwise("")
    return F.when(base == "", "").otherwise(squeezed(F.concat(base, named, chosen), 260))


def needs_web(question: Column, undecided: bool = True) -> Column:
    """Whether to search the web: by words that ask for it, then by words that rule it out; else as ``undecided`` says."""
    q = F.lower(stripped(F.coalesce(question, F.lit(""))))
    return F.when(q == "", False).when(contains_any(q, SEARCH_WORDS), True).when(contains_any(q, NO_SEARCH_WORDS), False).otherwise(undecided)


def should_decompose(question: Column) -> Column:
    return (F.length(question) >= 10) & question.rlike(f"(?d){DECOMPOSE}")


def preset(query: Column) -> Column:
    """``mindmap`` or ``flowchart``, whichever is asked for first (at one place: the flow chart); null for neither."""
    low = F.lower(query)

    def first(words: list[str]) -> Column:
        return F.array_min(F.filter(F.array(*[F.locate(w, low) for w in words]), lambda i: i > 0))

    mind, flow = first(MINDMAP_WORDS), first(FLOWCHART_WORDS)
    return F.when(flow.isNotNull() & (mind.isNull() | (flow <= mind)), "flowchart").when(mind.isNotNull(), "mindmap")


def answer_detail(value: Column) -> Column:
    """``concise``, ``standard`` or ``detailed``; standard for anything else."""
    v = F.lower(stripped(value))
    return F.when(v.isin("concise", "detailed"), v).otherwise("standard")


def answer_tokens(most: Column, detail: Column, structured: Column) -> Column:
    """Tokens of an answer (null: the provider's own): a floor for detailed ones, a default for standard ones, more for structured citations."""
    kind = answer_detail(detail)
    base = F.when(kind == "detailed", F.greatest(F.coalesce(most, F.lit(0)), F.lit(DETAILED_TOKENS))).when(kind == "standard", F.coalesce(most, F.lit(STANDARD_TOKENS))).otherwise(most)
    return base + F.when(structured, CITATION_TOKENS).otherwise(0)


def expanded_queries(reply: Column, query: Column, n: int = 3) -> Column:
    """Up to ``n`` queries of a reply, one a line: numbering and bullets stripped, without the query itself and those of three characters or fewer."""
    bare = lambda x: stripped(F.regexp_replace(F.regexp_replace(stripped(x), r"^[0-9]+[.)]\s*", ""), r"^[-•]\s*", ""))
    return F.slice(F.filter(F.transform(F.split(stripped(reply), "\n"), bare), lambda x: (x != query) & (F.length(x) > 3)), 1, n)


def reply_score(reply: Column) -> Column:
    """The least whole number from 0 to 10 in a reply, over 10; null without one."""
    found = F.transform(F.regexp_extract_all(reply, F.lit(r"(?<![0-9A-Za-z_])([0-9]{1,2})(?![0-9A-Za-z_])"), 1), lambda x: x.cast("int"))
    return F.array_min(F.filter(found, lambda x: x <= 10)) / 10.0


def distilled_facts(reply: Column) -> Column:
    """The facts of a reply: lines that begin with a dash, longer than three characters."""
    lines = F.transform(F.split(stripped(reply), "\n"), stripped)
    return F.filter(F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("- "))), lambda x: stripped(F.substring(x, 3, 1 << 30))), lambda x: F.length(x) > 3)
