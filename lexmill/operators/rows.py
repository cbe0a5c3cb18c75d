"""Table functions over single rows: a row's values in, any number of rows out, in Arrow batches and without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def per_row(df: DataFrame, keys: list[str], inputs: list[str], fields: str, make: Callable[..., Iterable[tuple]], number: str | None = None) -> DataFrame:
    """``keys`` of each row with the rows of ``fields`` that ``make`` gives for its inputs (null texts as empty ones), numbered from 0."""
    names = [f.split()[0] for f in fields.split(", ")]
    kinds = [f"{k} {df.schema[k].dataType.simpleString()}" for k in keys] + ([f"{number} int"] if number else [])
    texts = {c for c in inputs if df.schema[c].dataType.simpleString() == "string"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            columns = [pdf[c].fillna("").tolist() if c in texts else pdf[c].tolist() for c in inputs]
            rows = []
            for key, *values in zip(zip(*(pdf[k].tolist() for k in keys)), *columns):
                rows += [(*key, *([i] if number else []), *row) for i, row in enumerate(make(*values))]
            yield pd.DataFrame(rows, columns=[*keys, *([number] if number else []), *names])

    return df.select(*dict.fromkeys([*keys, *inputs])).mapInPandas(run, ", ".join([*kinds, fields]))
