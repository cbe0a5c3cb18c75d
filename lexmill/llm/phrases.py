"""Phrase collocations: frequent phrases of 2 to 5 words and how much more often than by chance their parts meet.

Texts are cut into pieces; equal pieces become one row with a multiplicity, so that copies cost nothing more.  N-grams
are then counted with these as weights in three passes over the pieces: words, pairs of frequent words, and phrases of
three to five words all of whose pairs are frequent.  A phrase is never more frequent than what it holds, so the
passes lose nothing.  Every pass sums what a task has read before it is shuffled by a hash of the phrase, and DuckDB
sums each hash bucket, within a memory limit and spilling beyond it.

Which words or pairs are frequent is known to a pass by a bit for each hash.  The bits number at most ``MOST_BITS``
whatever the corpus; two phrases that share one only let an infrequent phrase be counted.  A phrase's parts are looked
up by requests: each asks under its part's words, meets the count there in a shuffle, and goes back to the phrase.

Contract: A-Z become lower case; null texts are empty; a null language is ``und``; rows that repeat count again, as do
rows without an id; further columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_values, cut, slices, text_batches

#: Bits that tell frequent words or pairs: so many for each, between two bounds (8 KB and 32 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 1 << 16, 1 << 28
#: Bytes of pieces that a task holds before it passes their sums on, and words whose n-grams are summed at once.
HELD_BYTES, HELD_WORDS = 32 << 20, 2 << 20
#: Memory of DuckDB in a bucket's task; beyond it sums go to the task's own temporary folder, which it deletes.
BUCKET_MEMORY = "192MB"
COUNTED = "lang string, phrase binary, m long"
SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("m", pa.int64())])
#: Words are divided by one space, pieces by one line feed.
_CUT = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
_ROWS = 20_000
_SALTS = 64


def pieces(documents: DataFrame) -> DataFrame:
    """(lang, phrase, m): distinct pieces, their words divided by one space, and how often they occur."""
    text_batches(documents.sparkSession)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[str, bytes]] = Counter()
        size = 0
        for batch in slices(batches):
            langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
            for lang, text in zip(langs, binary_values(batch.column(batch.schema.get_field_index("text")))):
                found = [(lang, b" ".join(p.split())) for p in text.translate(_CUT).split(b"\n")]
                held.update(found)
                size += len(text)
                if size > HELD_BYTES:
                    yield from _rows(held)
                    held, size = Counter(), 0
        yield from _rows(held)

    rows = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").mapInArrow(cut_up, COUNTED)
    return rows.groupBy("lang", "phrase").agg(F.sum("m").alias("m"))


def _rows(held: Counter[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
    items = [(lang, p, m) for (lang, p), m in held.items() if p]
    for at in range(0, len(items), _ROWS):
        some = items[at : at + _ROWS]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in some], t) for i, t in enumerate(SCHEMA.types)], schema=SCHEMA)


class _Numbers(dict):
    """Words and their numbers, by first occurrence."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Held:
    """Pieces of one language whose n-grams are to be summed."""

    def __init__(self) -> None:
        self.numbers, self.words, self.lengths, self.weights = _Numbers(), [], [], []

    def add(self, pieces: pa.Array, weights: np.ndarray) -> None:
        import pyarrow.compute as pc

        # all pieces of a batch are cut into words at once; the number of blanks tells them apart
        self.lengths.append(pc.count_substring(pieces, b" ").to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        self.words.extend(map(self.numbers.__getitem__, b" ".join(pieces.to_pylist()).split(b" ")))
        self.weights.append(weights)


def word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    import xxhash

    start = lang.encode() + b"\0"
    return np.fromiter((xxhash.xxh3_64_intdigest(start + w) for w in words), np.uint64, len(words))


def joined(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Hashes of pairs by those of their words, so that a pair need not be spelled to be looked up."""
    x = one * np.uint64(0x9E3779B97F4A7C15) + two
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def phrase_hashes(keys: list[bytes], lang: str) -> np.ndarray:
    """Hashes of words, or of pairs of words."""
    parts = [k.split(b" ") for k in keys]
    first = word_hashes([p[0] for p in parts], lang)
    if not parts or len(parts[0]) == 1:
        return first
    return joined(first, word_hashes([p[1] for p in parts], lang))


def _known(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = hashes % np.uint64(8 * len(bits))
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def sums(held: _Held, lang: str, step: int, bits: np.ndarray | None) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Phrases and weights of held pieces: all words and, as the empty phrase, their number (step 1), pairs of known words (2), phrases of 3 to 5 words of known pairs (3)."""
    words = list(held.numbers)
    w, lengths = np.array(held.words, np.int64), np.concatenate(held.lengths)
    weight = np.repeat(np.concatenate(held.weights).astype(np.float64), lengths)
    total = lambda group, some: np.bincount(group, weight[some]).astype(np.int64)  # noqa: E731  whole numbers below 2 ** 53
    if step == 1:
        yield [*words, b""], np.append(total(w, slice(None)), int(weight.sum()))
        return
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(w))  # words from here to the piece's end
    spelled = lambda first, k: [b" ".join([words[x] for x in row]) for row in np.stack([w[first + i] for i in range(k)], axis=1).tolist()]
    if step == 2:
        known = _known(word_hashes(words, lang), bits)[w]
        some = np.flatnonzero(left >= 2)
        some = some[known[some] & known[some + 1]]
    else:
        some = np.flatnonzero(left >= 2)
    _, first, group = np.unique(w[some] * len(words) + w[some + 1], return_index=True, return_inverse=True)
    if step == 2:
        yield spelled(some[first], 2), total(group, some)
        return
    h = word_hashes(words, lang)
    known = _known(joined(h[w[some[first]]], h[w[some[first] + 1]]), bits)[group]
    number, good = np.full(len(w), -1, np.int64), np.zeros(len(w) + 5, bool)
    some, group = some[known], group[known]
    number[some], good[some] = group, True
    for k in (3, 4, 5):
        # what begins here is a phrase of k - 1 words, and the pair at its end is known too
        some = np.flatnonzero((number >= 0) & (left >= k))
        some = some[good[some + k - 2]]
        _, first, group = np.unique(number[some] * len(words) + w[some + k - 1], return_index=True, return_inverse=True)
        number = np.full(len(w), -1, np.int64)
        number[some] = group
        yield spelled(some[first], k), total(group, some)


def counts(rows: DataFrame, step: int, bits: Broadcast | None, least: int) -> DataFrame:
    """(lang, phrase, m) of the phrases of a step that occur ``least`` times or more, and with step 1 the number of words as that of the empty phrase."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Held] = {}
        flag = None if bits is None else np.frombuffer(bits.value, np.uint8)

        def given(lang: str) -> Iterator[pa.RecordBatch]:
            for phrases, m in sums(held.pop(lang), lang, step, flag):
                for at in range(0, len(phrases), _ROWS):
                    some = phrases[at : at + _ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary()), pa.array(m[at : at + _ROWS])], schema=SCHEMA)

        for batch in slices(batches, column="phrase"):
            langs = batch.column(0).dictionary_encode()
            number = langs.indices.to_numpy()
            weights = batch.column(2).to_numpy()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                if lang not in held:
                    held[lang] = _Held()
                held[lang].add(batch.column(1).filter(pa.array(number == i)), weights[number == i])
            while sum(len(h.words) for h in held.values()) > HELD_WORDS:
                yield from given(max(held, key=lambda x: len(held[x].words)))
        for lang in list(held):
            yield from given(lang)

    return rows.mapInArrow(summed, COUNTED).repartition("lang", "phrase").mapInArrow(_bucket(least), COUNTED)


def _bucket(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def every() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        with tempfile.TemporaryDirectory() as folder, duckdb.connect(config={"memory_limit": BUCKET_MEMORY, "threads": "1", "temp_directory": folder, "preserve_insertion_order": "false"}) as db:
            db.register("rows", pa.RecordBatchReader.from_batches(first.schema, every()))
            out = db.sql(f"SELECT lang, phrase, sum(m)::BIGINT AS m FROM rows GROUP BY lang, phrase HAVING sum(m) >= {least} OR octet_length(phrase) = 0")
            for batch in out.to_arrow_reader(_ROWS):
                yield batch.cast(SCHEMA)

    return run


def marked(rows: DataFrame) -> Broadcast:
    """The bits of all phrases of a table of counts."""
    spark = rows.sparkSession
    bits = LEAST_BITS
    n = rows.count()
    while bits < min(MOST_BITS, BITS_EACH * n):
        bits *= 2

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(phrase)
            for lang, keys in by.items():
                yield pa.RecordBatch.from_arrays([pa.array((phrase_hashes(keys, lang) % np.uint64(bits)).astype(np.int64))], names=["at"])

    # a block of 65536 bits becomes one row of at most so many numbers
    blocks = rows.select("lang", "phrase").mapInArrow(placed, "at long").groupBy(F.shiftright("at", 16).alias("block")).agg(F.collect_set((F.col("at") % 65536).cast("int")).alias("at"))
    out = np.zeros(bits, bool)
    for r in blocks.toLocalIterator():
        out[np.array(r["at"], np.int64) + (r["block"] << 16)] = True
    return spark.sparkContext.broadcast(np.packbits(out, bitorder="little").tobytes())


def phrase_counts(documents: DataFrame, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """(lang, n): number of words; (lang, phrase, m): the words and phrases of up to five words that occur ``least`` times or more."""
    rows = cut(pieces(documents), "pieces")
    words = cut(counts(rows, 1, None, least), "words")
    known = words.where(F.octet_length("phrase") > 0)
    bits = marked(known)
    pairs = cut(counts(rows, 2, bits, least), "pairs").where(F.octet_length("phrase") > 0)
    bits.unpersist()
    bits = marked(pairs)
    longer = cut(counts(rows, 3, bits, least), "longer").where(F.octet_length("phrase") > 0)
    bits.unpersist()
    found = known.unionByName(pairs).unionByName(longer).withColumn("phrase", F.col("phrase").cast("string"))
    return words.where(F.octet_length("phrase") == 0).select("lang", F.col("m").alias("n")), found


def scored(totals: DataFrame, found: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, n, score) of phrases of two words or more: the cut with the least score, the first of equals."""
    words = found.withColumn("w", F.split("phrase", " ")).withColumn("size", F.size("w")).where("size > 1")
    part = lambda c, at, n: F.array_join(F.slice(c, at, n), " ")
    ask = lambda k: F.array(F.struct(k.alias("k"), F.lit("l").alias("side"), part(F.col("w"), F.lit(1), k).alias("part")), F.struct(k.alias("k"), F.lit("r").alias("side"), part(F.col("w"), k + 1, F.col("size") - k).alias("part")))
    asked = words.select("lang", "phrase", "size", F.col("m").alias("a"), F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.col("size") - 1), ask))).alias("q")).select("lang", "phrase", "size", "a", "q.*")
    met = asked.join(found.select("lang", F.col("phrase").alias("part"), F.col("m").alias("f")), ["lang", "part"])
    back = met.groupBy("lang", "phrase", "size", "a").agg(F.collect_list(F.struct("k", "side", "f")).alias("parts")).join(totals, "lang")
    schema = "lang string, phrase string, size int, a long, l long, r long, n long, score long"

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                f = {(p["k"], p["side"]): p["f"] for p in x["parts"]}
                cuts = [((1000 * x["a"] * x["n"]) // (f[k, "l"] * f[k, "r"]), k) for k in range(1, x["size"])]
                score, k = min(cuts)
                out.append({"lang": x["lang"], "phrase": x["phrase"], "size": x["size"], "a": x["a"], "l": f[k, "l"], "r": f[k, "r"], "n": x["n"], "score": score})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), *[(c, pa.int64()) for c in ("a", "l", "r", "n", "score")]]))

    return back.mapInArrow(best, schema)


def collocations(documents: DataFrame, least: int = 100, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases that no longer one as frequent holds.

    Where a longer phrase is as frequent as one within it, so is every phrase between the two; hence phrases of one
    word more are all that need to be looked at.
    """
    totals, found = phrase_counts(documents, least)
    rows = cut(scored(totals, found), "scored")
    w = F.split("phrase", " ")
    inner = lambda at: F.array_join(F.slice(w, at, F.col("size") - 1), " ")
    over = rows.where("size > 2").select("lang", F.explode(F.array(inner(1), inner(2))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("over"))
    kept = rows.join(over, ["lang", "phrase"], "left").where("over is null or over < a")
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    # first among a hash's rows, so that no task orders all phrases of a language
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS))).orderBy(*order)
    some = kept.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) t(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS s, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.k, c.phrase, c.a, x.f AS l, y.f AS r, n.n, cut, (1000::HUGEINT * a * n.n) // (x.f::HUGEINT * y.f) AS score FROM c JOIN n ON n.lang = c.lang
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(s[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(s[cut + 1:c.k], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, unnest([array_to_string(s[1:k - 1], ' '), array_to_string(s[2:k], ' ')]) AS phrase, a FROM (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS s FROM f WHERE k > 2)),
d AS (SELECT b.* FROM b LEFT JOIN (SELECT lang, phrase, max(a) AS a FROM o GROUP BY ALL) v ON v.lang = b.lang AND v.phrase = b.phrase WHERE v.a IS NULL OR v.a < b.a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM r WHERE rank <= 2000
"""
