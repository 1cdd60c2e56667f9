"""Shared storage and small helpers for the corpus operators.

Everything that must outlive a task is written below ``spark.checkpoint.dir``, which driver and
executors share.  A folder of our own is taken only where that setting is absent (tests, local mode).
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_fallback: dict[str, str] = {}
_shipped: set[str] = set()
PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that all machines share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _fallback:
            _fallback[app] = "file://" + tempfile.mkdtemp(prefix="spark-seriesloom-")
        base = _fallback[app]
    return base.rstrip("/") if "://" in base else "file://" + base.removeprefix("file:").rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


BATCH_ROWS, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most ROWS rows for the jobs run inside: rows are whole texts, so batches of Spark's
    default size take much memory in the JVM and in Python. The session's own setting comes back afterwards."""
    before = spark.conf.get(BATCH_ROWS)
    if not 0 < int(before) <= ROWS:
        spark.conf.set(BATCH_ROWS, str(ROWS))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: later stages start from files, not from lineage."""
    path = new_path(df.sparkSession, label)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by `cut` that no later stage reads."""
    for table in tables:
        filesystem, path = pafs.FileSystem.from_uri(table.cut_path)
        filesystem.delete_dir(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, unless they can import it already."""
    roots = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(":")]
    app = spark.sparkContext.applicationId
    if app in _shipped or PACKAGE_ROOT in map(os.path.abspath, filter(None, roots)):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="spark-seriesloom-"), "seriesloom.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(os.path.join(PACKAGE_ROOT, "seriesloom")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, PACKAGE_ROOT))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file; the folder can be set by SERIESLOOM_TOKENIZERS."""
    folder = os.environ.get("SERIESLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch so that each piece holds about `max_bytes` of `column`; one value may exceed it."""
    values = batch.column(column)
    start, held = 0, 0
    for i, size in enumerate(pa.compute.fill_null(pa.compute.binary_length(values), 0).to_pylist()):
        if held and held + size > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that `df` doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in taken:
        name = "_" + name
    return name


def least_hashed(df: DataFrame, columns: list[str], rows: int) -> DataFrame:
    """The `rows` rows with the least hash of `columns`, or all if there are fewer: a repeatable sample.

    A bound on the hash first thins the table to about four times as many, so that what is sorted doesn't grow
    with it; where rows repeat their columns, the bound rises until enough rows are below it.
    """
    h = F.xxhash64(*columns)
    wanted, n = 4 * rows, df.count()
    while wanted < n:
        held = df.where(h < -(2**63) + (2**64 * wanted) // n)
        if held.count() >= rows:
            df = held
            break
        wanted *= 16
    return df.orderBy(h, *columns).limit(rows)
