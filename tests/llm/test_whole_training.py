"""The attention model's pass over the corpus takes whole documents."""

import zlib

import numpy as np

from lexmill.llm import attention_lm
from lexmill.llm.common import cut
from lexmill.llm.queries import tokenizer_file


def test_op3_trains_past_the_beginning(spark):
    path = tokenizer_file("byte_bpe_50k.json")
    counts = np.ones(attention_lm.word_ids(path).size)
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 != 2]
    begin = "the same beginning of every text " * 20  # 660 characters

    def weights(rest):
        rows = [(i, begin + rest) for i in ids]
        table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        tokens = cut(attention_lm.encoded(table, path), "tokens").where("ids is not null")
        return attention_lm.trained(tokens.select("doc_id", "learn", "ids"), path, counts, 1).pack()

    assert np.abs(weights("river stone " * 60) - weights("seven green lamps " * 40)).max() > 1e-3
