"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed over cells (source, language, topic).  Raking multiplies the cells' rates, one
margin after the other, until the expected tokens of every source, language and topic meet their targets.  A rate of
one is all of a cell, so each step holds rates beyond one at one and finds the factor by which the rest meet the target:
the bound is in the raking, not put on what comes of it.  A cell's rate is the probability with which each of its
documents is kept; a hash of the id decides.

Targets are the margins' token shares to a power below one, times the budget.  A value that does not hold its
target is taken whole, and what it lacks is shared out among the others.

A document's topic is one of eight, by a hash of its most frequent term of five letters or more (the least of equals).
Terms are counted once, in Arrow batches, and written with the rows; raking and drawing read what was written.

Contract: null values of a margin are the value ''; null and empty texts have no tokens, no topic (``none``) and the
probability of their cell; explicit targets may be given as token shares, and a value without one, or with one of 0,
gets rate 0; targets of values that do not occur are shared out among the others; rows that repeat a doc_id are drawn
alike.  A budget beyond what there is keeps everything of positive target.  All columns are kept; those added win over
clashing names.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, slices, text_batches, unused

MARGINS = ("source", "lang", "topic")
#: Cells that are raked on the driver and sent to all executors (about 100 bytes each); more are raked in DataFrames.
MOST_CELLS = 200_000
#: Most sweeps; the gap at which they end, as a share of all tokens; and the gap from which there is a warning.
SWEEPS, CLOSE, TOLD = 60, 1e-13, 1e-4
#: Exponents that temper the token shares of each margin into its targets.
TEMPER = {"source": 0.7, "lang": 0.5, "topic": 0.8}
BUDGET = 0.5
TOPICS, TERM_LENGTH = 8, 5


def _counted(texts: pa.RecordBatch) -> pa.StructArray:
    """The most frequent term of each lower-cased text (the least of equals, null without one), and its number of words."""
    words = pc.ascii_split_whitespace(texts.column(0).cast(pa.string()))
    coded = pc.dictionary_encode(words.flatten())
    terms, codes = coded.dictionary, coded.indices.to_numpy()
    doc = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy())
    lengths = pc.utf8_length(terms).to_numpy()
    n = np.bincount(doc[lengths[codes] > 0], minlength=len(words))
    chosen = pc.array_filter(terms, pa.array(lengths >= TERM_LENGTH))
    order = pc.sort_indices(chosen).to_numpy().astype(np.int64)
    place = np.full(len(terms), -1)
    place[np.flatnonzero(lengths >= TERM_LENGTH)[order]] = np.arange(len(order))
    place = place[codes]
    size = len(order) + 1
    keys = np.sort((doc * size + place)[place >= 0])
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    of, rank = np.divmod(keys[first], size)
    begins = np.flatnonzero(np.diff(of, prepend=-1))
    # the greatest count, of equal ones the least place
    most = np.maximum.reduceat(np.diff(first, append=len(keys)) * size - rank, begins) if len(begins) else np.zeros(0, np.int64)
    best = np.full(len(words), -1)
    best[of[begins]] = order[-most % size]
    return pa.StructArray.from_arrays([chosen.take(pa.array(best, mask=best < 0)), pa.array(n)], names=["term", "n"])


@F.arrow_udf(T.StructType().add("term", T.StringType()).add("n", T.LongType()))
def _terms(texts: pa.Array) -> pa.Array:
    whole = pa.RecordBatch.from_arrays([texts], names=["text"])
    kind = pa.struct([("term", pa.string()), ("n", pa.int64())])
    return pa.concat_arrays([pa.array([], kind), *[_counted(x) for x in slices([whole], 1024, 4 << 20)]])


def counted(documents: DataFrame, topic: str, n: str, *without: str) -> DataFrame:
    """All columns but those ``without``, and under the given names the topic and words of each text."""
    text_batches(documents.sparkSession)
    found = unused(documents, "found")
    rows = documents.withColumn(found, _terms(F.lower(F.coalesce("text", F.lit(""))))).drop(*without)
    number = F.conv(F.substring(F.md5(F.col(found)["term"]), 1, 8), 16, 10).cast("long") % TOPICS
    of = F.coalesce(F.concat(F.lit("topic-"), number.cast("string")), F.lit("none"))
    return rows.withColumns({topic: of, n: F.col(found)["n"]}).drop(found)


def _margins(rows: DataFrame, topic: str) -> dict[str, Column]:
    return {m: rows[topic] if m == "topic" else F.coalesce(rows[m].cast("string"), F.lit("")) for m in MARGINS}


def _cells_of(rows: DataFrame, topic: str, n: str) -> DataFrame:
    rows = rows.select(*[c.alias(m) for m, c in _margins(rows, topic).items()], F.col(n).alias("n"))
    return rows.groupBy(*MARGINS).agg(F.sum("n").cast("double").alias("tokens"))


def cells(documents: DataFrame) -> DataFrame:
    """Tokens (words) of each (source, lang, topic)."""
    return _cells_of(counted(documents.select("source", "lang", "text"), "topic", "n"), "topic", "n")


def filled(group: np.ndarray, tokens: np.ndarray, rates: np.ndarray, goals: np.ndarray) -> np.ndarray:
    """Rates times a factor for each group such that its cells' tokens times min(1, rate) come to its goal; rates of 0 stay, others are 1 at least where that cannot be."""
    if not len(tokens):
        return rates
    order = np.lexsort((-rates, group))
    g, t, u = group[order], tokens[order], rates[order]
    first = np.flatnonzero(np.diff(g, prepend=-1))
    size = np.diff(first, append=len(g))
    within = lambda x: np.cumsum(x) - np.repeat((np.cumsum(x) - x)[first], size)
    held = within(t) - t  # tokens of the cells before, taken whole
    rest = np.repeat(np.add.reduceat(t * u, first), size) - within(t * u) + t * u
    factor = np.divide(goals[g] - held, rest, out=np.zeros(len(g)), where=rest > 0)
    fits = np.where((rest > 0) & (factor * u <= 1), np.arange(len(g)), len(g))
    at = np.minimum.reduceat(fits, first)
    found = np.repeat(at < len(g), size)
    new = np.where(found, u * np.maximum(factor[np.minimum(np.repeat(at, size), len(g) - 1)], 0), np.where((goals[g] > 0) & (u > 0), np.maximum(u, 1), 0))
    out = np.empty(len(new))
    out[order] = new
    return out


def goals_of(sums: np.ndarray, exponent: float, budget: float) -> np.ndarray:
    """Tokens of each value in proportion to its own to the power of ``exponent``, no more than it has, ``budget`` in all."""
    rates = np.where(sums > 0, np.where(sums > 0, sums, 1.0) ** (exponent - 1), 0.0)
    return sums * np.minimum(1, filled(np.zeros(len(sums), int), sums, rates, np.array([budget])))


def shared_goals(sums: np.ndarray, shares: np.ndarray, budget: float) -> np.ndarray:
    """Tokens of each value by explicit shares, no more than it has, ``budget`` in all as far as that goes."""
    rates = np.where(sums > 0, shares / np.where(sums > 0, sums, 1.0), 0.0)
    return sums * np.minimum(1, filled(np.zeros(len(sums), int), sums, rates, np.array([budget])))


def rake(tokens: np.ndarray, margins: list[np.ndarray], goals: list[np.ndarray], sweeps: int = SWEEPS) -> np.ndarray:
    """Rates of cells such that their tokens times min(1, rate) sum to the goals of each margin's groups; ``margins`` number these.

    Sweeps end once all margins are met to CLOSE; where that is not reached there is a warning with the gaps.
    """
    rates = np.ones(len(tokens))
    for _ in range(sweeps):
        for group, goal in zip(margins, goals):
            rates = filled(group, tokens, rates, goal)
        if max(gaps(tokens, margins, goals, rates), default=0.0) <= CLOSE:
            break
    else:
        unmet = dict(zip(MARGINS, gaps(tokens, margins, goals, rates)))
        if sweeps and max(unmet.values(), default=0.0) > TOLD:
            warnings.warn(f"margins are not met after {sweeps} sweeps; the greatest gaps as shares of all tokens are {unmet}", stacklevel=2)
    return rates


def gaps(tokens: np.ndarray, margins: list[np.ndarray], goals: list[np.ndarray], rates: np.ndarray) -> list[float]:
    """Of each margin the greatest difference between expected tokens and goal, as a share of all expected tokens."""
    expected = tokens * np.minimum(rates, 1)
    total = max(expected.sum(), 1e-300)
    return [float(np.abs(np.bincount(g, expected, len(goal)) - goal).max(initial=0) / total) for g, goal in zip(margins, goals)]


def _filled_in_frames(rows: DataFrame, by: str) -> DataFrame:
    """``filled`` over rows with tokens, u and goal."""
    w = Window.partitionBy(by).orderBy(F.col("u").desc(), *MARGINS)
    held = F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(F.col("tokens") * F.col("u")).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumns({"held": held, "rest": rest, "at": F.row_number().over(w)})
    factor = F.when(F.col("rest") > 0, (F.col("goal") - F.col("held")) / F.col("rest"))
    fits = F.when(factor * F.col("u") <= 1, F.struct("at", factor.alias("f")))
    found = F.min(fits).over(Window.partitionBy(by))["f"]
    new = F.when(found.isNotNull(), F.col("u") * F.greatest(found, F.lit(0.0))).when((F.col("goal") > 0) & (F.col("u") > 0), F.greatest("u", F.lit(1.0))).otherwise(0.0)
    return rows.withColumn("u", new).drop("held", "rest", "at")


def _calibrated_in_frames(table: DataFrame, temper: Mapping[str, float], budget: float, sweeps: int, targets: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """What ``calibrated`` gives, for any number of cells: every step is windows over a margin's values."""
    total = table.agg(F.sum("tokens")).first()[0] or 0.0
    goals = {}
    for m in MARGINS:
        sums = table.groupBy(m).agg(F.sum("tokens").alias("tokens"))
        if m in targets:
            shares = table.sparkSession.createDataFrame([(str(v), float(x)) for v, x in targets[m].items()], f"{m} string, share double")
            sums = sums.join(shares, m, "left").withColumn("u", F.when(F.col("tokens") > 0, F.coalesce("share", F.lit(0.0)) / F.col("tokens")).otherwise(0.0)).drop("share")
        else:
            sums = sums.withColumn("u", F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(temper[m] - 1))).otherwise(0.0))
        others = {x: F.lit("") for x in MARGINS if x != m}
        rows = _filled_in_frames(sums.withColumns({"goal": F.lit(budget * total), "all": F.lit(0)} | others), "all")
        goals[m] = cut(rows.select(m, (F.col("tokens") * F.least(F.lit(1.0), "u")).alias("goal")), "targets")
    table = table.withColumn("u", F.lit(1.0))
    gap = 0.0
    for _ in range(sweeps):
        for m in MARGINS:
            table = _filled_in_frames(table.join(goals[m], m), m).drop("goal")
        table = cut(table, "raked")
        gap = 0.0
        for m in MARGINS:
            held = table.groupBy(m).agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), "u")).alias("held")).join(goals[m], m)
            gap = max(gap, (held.agg(F.max(F.abs(F.col("held") - F.col("goal")))).first()[0] or 0.0) / max(budget * total, 1e-300))
        if gap <= CLOSE:
            break
    if gap > TOLD:
        warnings.warn(f"margins are not met after {sweeps} sweeps; the greatest gap as a share of all tokens is {gap}", stacklevel=2)
    return table.select(*MARGINS, F.col("u").alias("weight"), F.least(F.lit(1.0), "u").alias("probability"))


def calibrated(documents: DataFrame, temper: Mapping[str, float] = TEMPER, budget: float = BUDGET, sweeps: int = SWEEPS, most_cells: int = MOST_CELLS, targets: Mapping[str, Mapping[str, float]] | None = None) -> tuple[DataFrame, bool]:
    """weight (the raked rate) and probability of each cell, and whether the table is bounded by ``most_cells``.

    ``targets`` has explicit shares by margin and value, in place of the tempered ones.
    """
    return _calibrated(cells(documents), temper, budget, sweeps, most_cells, targets)


def _calibrated(table: DataFrame, temper: Mapping[str, float] = TEMPER, budget: float = BUDGET, sweeps: int = SWEEPS, most_cells: int = MOST_CELLS, targets: Mapping[str, Mapping[str, float]] | None = None) -> tuple[DataFrame, bool]:
    """``calibrated`` of the table of cells."""
    spark = table.sparkSession
    table = cut(table, "cells")
    if table.count() > most_cells:
        return cut(_calibrated_in_frames(table, temper, budget, sweeps, targets or {}), "calibrated"), False
    rows = sorted(table.collect(), key=lambda r: tuple(r[m] for m in MARGINS))
    tokens = np.array([r["tokens"] for r in rows], float)
    groups, goals = [], []
    for m in MARGINS:
        values = sorted({r[m] for r in rows})
        number = {v: i for i, v in enumerate(values)}
        group = np.array([number[r[m]] for r in rows], int)
        sums = np.bincount(group, tokens, len(values)) if len(rows) else np.zeros(0)
        groups.append(group)
        if targets and m in targets:
            goals.append(shared_goals(sums, np.array([float(targets[m].get(v, 0.0)) for v in values]), budget * tokens.sum()))
        else:
            goals.append(goals_of(sums, temper[m], budget * tokens.sum()))
    rates = rake(tokens, groups, goals, sweeps)
    data = [(*(r[m] for m in MARGINS), float(u), float(min(u, 1.0))) for r, u in zip(rows, rates)]
    return spark.createDataFrame(data, "source string, lang string, topic string, weight double, probability double"), True


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) from a hash of the id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), doc_id.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def _joined(rows: DataFrame, names: dict[str, str], n: str, **options) -> DataFrame:
    """``rows`` with their topics and words, and under the given names the weight and probability of their cells, and whether they are drawn."""
    table, bounded = _calibrated(_cells_of(rows, names["topic"], n), **options)
    keys = {m: names[m] if m == "topic" else unused(rows, f"of_{m}") for m in MARGINS}
    table = table.select(*[F.col(m).alias(keys[m]) for m in MARGINS], F.col("weight").alias(names["weight"]), F.col("probability").alias(names["probability"]))
    rows = rows.withColumns({keys[m]: c for m, c in _margins(rows, names["topic"]).items()})
    rows = rows.join(F.broadcast(table) if bounded else table, list(keys.values()))
    p = F.col(names["probability"])
    return rows.withColumn(names["kept"], F.coalesce(draw(F.col("doc_id")) < p, p >= 1)).drop(*[keys[m] for m in ("source", "lang")])


_ADDED = ("topic", "weight", "probability", "kept")


def with_probabilities(documents: DataFrame, **options) -> DataFrame:
    """All columns, and topic, weight, probability and kept."""
    documents = documents.drop(*_ADDED)
    n = unused(documents, "words")
    return _joined(cut(counted(documents, "topic", n), "counted"), {c: c for c in _ADDED}, n, **options).drop(n)


def sample(documents: DataFrame, **options) -> DataFrame:
    """The documents drawn, with the columns they came with."""
    names = {c: unused(documents, f"mix_{c}") for c in _ADDED}
    n = unused(documents, "words")
    rows = _joined(cut(counted(documents, names["topic"], n), "counted"), names, n, **options)
    return rows.where(F.col(names["kept"])).select(*documents.columns)


def report(documents: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability (six places) and kept of every document."""
    rows = cut(counted(documents.select("doc_id", "text", "source", "lang"), "topic", "n_tokens", "text"), "counted")
    rows = _joined(rows, {c: c for c in _ADDED}, "n_tokens")
    return rows.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "kept")


def oracle(documents: str = "documents", steps: int = SWEEPS) -> str:
    """DuckDB SQL for ``report``: two common table expressions for each raking step of as many sweeps."""
    before, on = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING", "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"

    def fill(source: str, keys: str, by: str, goal: str, out: str) -> list[str]:
        over = f"PARTITION BY {by} ORDER BY u DESC, {keys}" if by else f"ORDER BY u DESC, {keys}"
        part = f"PARTITION BY {by}" if by else ""
        return [
            f"{out}a AS MATERIALIZED (SELECT *, {goal} AS goal, coalesce(sum(n) OVER ({over} {before}), 0) AS held, sum(n * u) OVER ({over} {on}) AS rest, row_number() OVER ({over}) AS place FROM {source})",
            f"{out}b AS (SELECT *, min(CASE WHEN rest > 0 AND (goal - held) / rest * u <= 1 THEN place END) OVER ({part}) AS k FROM {out}a)",
            f"""{out} AS MATERIALIZED (SELECT * EXCLUDE (u, goal, held, rest, place, k), CASE WHEN k IS NOT NULL THEN u * greatest(0, max(CASE WHEN place = k THEN (goal - held) / rest END) OVER ({part})) WHEN goal > 0 AND u > 0 THEN greatest(u, 1) ELSE 0 END AS u FROM {out}b)""",
        ]

    ctes = [f"""w AS (SELECT doc_id, t FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+')) AS t FROM (SELECT DISTINCT doc_id, text FROM {documents})) WHERE length(t) >= {TERM_LENGTH})""",
      "b AS (SELECT doc_id, t FROM w GROUP BY doc_id, t QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, t) = 1)",
      f"""d AS (SELECT d.doc_id, source, lang, coalesce(source, '') AS s, coalesce(lang, '') AS l, CASE WHEN t IS NULL THEN 'none' ELSE 'topic-' || ('0x' || substr(md5(t), 1, 8))::BIGINT % {TOPICS} END AS topic,
      len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM {documents} d LEFT JOIN b ON b.doc_id = d.doc_id)""",
      f"c AS MATERIALIZED (SELECT s, l, topic AS t, sum(n_tokens)::DOUBLE AS n, {BUDGET} * sum(sum(n_tokens)) OVER () AS budget FROM d GROUP BY s, l, topic)"]
    for key, m in zip("slt", MARGINS):
        ctes.append(f"m{key} AS (SELECT {key}, sum(n) AS n, any_value(budget) AS budget, CASE WHEN sum(n) > 0 THEN pow(sum(n), {TEMPER[m] - 1}) ELSE 0 END AS u FROM c GROUP BY {key})")
        ctes += fill(f"m{key}", key, "", "budget", f"g{key}")
    ctes.append("w0 AS MATERIALIZED (SELECT s, l, t, c.n, gs.n * least(1, gs.u) AS ts, gl.n * least(1, gl.u) AS tl, gt.n * least(1, gt.u) AS tt, 1.0::DOUBLE AS u FROM c JOIN gs USING (s) JOIN gl USING (l) JOIN gt USING (t))")
    for step in range(3 * steps):
        key = "slt"[step % 3]
        ctes += fill(f"w{step}", "s, l, t", key, f"t{key}", f"w{step + 1}")
    return f"""WITH {", ".join(ctes)}
    SELECT doc_id, source, lang, topic, n_tokens, round(u, 6) AS weight, round(least(1, u), 6) AS probability,
      coalesce(('0x' || substr(md5('mix:' || doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < least(1, u), u >= 1) AS kept
    FROM d JOIN w{3 * steps} p ON d.s = p.s AND d.l = p.l AND d.topic = p.t"""
