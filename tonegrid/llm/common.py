"""Helpers shared by the text operators: shared storage, Arrow plumbing, words."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: Words are runs of anything but space and the five ASCII control blanks.
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"


def tokenizer_path(name: str) -> str:
    """Path of a vocabulary file: ``name`` itself if it is a path, else a file of the public tokenizers."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent on one machine (tests) a temporary folder is
    made and registered as the checkpoint folder; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Tables written by ``cut`` inside the open ``scratch`` blocks, innermost last.
_OPEN: list[list[str]] = []


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file system layer, wherever it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Intermediate tables that are cut inside the block are deleted at its end; what reads them must have been written."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            drop_table(spark, path)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    The table outlives executors, so a lost one costs a reread, not a rerun. It
    stays until the enclosing ``scratch`` block ends, or for ever without one.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{label}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_field(df: DataFrame, name: str, kind: str) -> StructType:
    """The schema of ``df`` and one more column (``schema.add`` would alter ``df`` itself)."""
    return StructType([*df.schema.fields, StructField(name, _parse_datatype_string(kind), True)])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(column: pa.Array) -> list[str]:
    """Python strings of an Arrow text column, null as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


#: Bytes of an Arrow batch between the JVM and Python: texts are long rows, and 10 000 of them at once are a task's memory.
BATCH_BYTES = 1 << 22


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes in this session, unless its own bound (64 MB as Spark comes) is lower."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def parts(batches: Iterator[pa.RecordBatch], at: int, max_bytes: int = 1 << 22, max_rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches of at most ``max_bytes`` in column ``at`` (one row at least), so few texts are Python strings at once.

    What a task's end would keep in the allocators of a reused worker is handed back there.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
        start = held = 0
        for k, size in enumerate(sizes):
            if k > start and (held + size > max_bytes or k - start >= max_rows):
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)
    release()


def release() -> None:
    """Give memory that the allocators hold back to the system (a worker process outlives its task)."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def once(maker):
    """Cache one value per Python worker, keyed by the arguments."""
    held: dict = {}

    def get(*key):
        if key not in held:
            held.clear()
            held[key] = maker(*key)
        return held[key]

    return get


def ascii_lower_words(text: str) -> list[bytes]:
    """UTF-8 words of ``text`` with A-Z lower-cased; ``bytes.split`` cuts at 0x20 and 0x09-0x0D."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def partition_number() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0

