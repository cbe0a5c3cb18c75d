"""A large group of near copies does not take the operators' results from its rows."""

import numpy as np

from lexmill.llm import imatch


def test_op5_third_of_rows_near_copies(spark):
    rng = np.random.default_rng(8)
    words = np.array([f"w{i}" for i in range(4000)])
    own = [f"g{i}" for i in range(150)]
    rows = [(i, " ".join(rng.choice(words, 150))) for i in range(400)]
    for i in range(200):
        copy = list(own)
        copy[rng.integers(150)] = f"edit{i}"
        rows.append((400 + i, " ".join(copy)))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    held = {r["term"] for r in imatch.lexicon(table).collect()}
    assert len(held & set(own)) == 150
    near = [r["near_next"] for r in imatch.fingerprints(table).where("doc_id > 400").collect()]
    assert np.mean(near) > 0.5
    # words that a fifth of different texts hold stay out
    common = spark.createDataFrame([(i, f"common {t}" if i % 2 else t) for i, t in rows[:400]], "doc_id long, text string")
    assert not imatch.lexicon(common).where("term = 'common'").count()
