"""Shared helpers: where intermediate tables go, and how Arrow batches are walked.

Intermediate results are written as Parquet in the folder named by
``spark.checkpoint.dir``: a lost executor loses none of them, and their lineage ends there.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_session = uuid.uuid4().hex[:12]


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Only a local session may do without, as in tests, and gets a temporary one: on a cluster a machine's own folder
    would be read by others, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="lexmill-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return "file://" + _own["dir"]


def scratch(spark: SparkSession, name: str) -> str:
    """A path for a new table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/lexmill-{_session}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that its lineage ends here."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Most rows and bytes of a batch that goes to Python, where rows hold whole texts, sets or blocks.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def text_batches(spark: SparkSession) -> None:
    """Let batches of texts that go to Python hold a few MB, in this session from now on."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    # Spark gives its default in bytes, with their unit; another unit is somebody's choice
    held = spark.conf.get(size).removesuffix("b")
    if held.isdigit() and int(held) > BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))


def keep_freed_memory() -> None:
    """Let this worker's allocator keep what numpy frees for the next arrays of the size, up to 256 MB.

    Handing pages of short-lived arrays back to the system and getting them again, zeroed, takes half the time of a
    numpy loop where many workers share a machine.  Where the C library has no such setting nothing changes.
    """
    import ctypes

    try:
        options = ctypes.CDLL(None).mallopt
    except (OSError, AttributeError):
        return
    options(-3, 32 << 20)  # from which size on arrays are mapped apart
    options(-1, 256 << 20)  # how much may stay free at the end of the heap


def give_back_memory() -> None:
    """Hand what this worker has freed back to the system, where the C library can."""
    import ctypes

    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        return


def release(spark: SparkSession) -> None:
    """Delete what this process has written to the shared folder.

    Frames that a query has returned still read from there, so that is the caller's to say, once they are written.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/lexmill-{_session}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def crc32_mod(column: str | Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string").cast("binary")) % modulus


def binary_values(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column; null gives the empty string."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2048, most_bytes: int = 8 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into pieces of a few rows and MB, so that what Python unpacks stays small."""
    import pyarrow.compute as pc

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist() if batch.num_rows else []
        start = held = 0
        for i, n in enumerate(lengths):
            if i > start and (i - start >= rows or held + n > most_bytes):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name
