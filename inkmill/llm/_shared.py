"""What the operators share: the shared folder, written intermediates, size checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of rows that may be broadcast; an executor holds about twice as many.
BROADCAST_BYTES = 32 << 20
#: Bytes of an Arrow batch of rows; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset and the master is local (tests), a temporary folder of this
    machine is taken; on a cluster the setting is required.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(context, "_inkmill_shared", None)
    if own is None:
        own = context._inkmill_shared = "file://" + tempfile.mkdtemp(prefix="inkmill-")
    return own


class Scratch:
    """Written intermediates of one call, in a folder of their own below shared_dir().

    Batches that go to Python workers are held to BATCH_BYTES from then on, since executors
    keep what their largest batches took."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """df written as Parquet and read again: lineage ends here, and so does recomputation."""
        path = self.path(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes written intermediates, or with no names all of them."""
        for path in [self.path(n) for n in names] or [self.root]:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def _width(x: Column, kind: T.DataType) -> tuple[int, Column | None]:
    """Bytes that every value of a column takes, and an expression for those that depend on it."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return 16, F.coalesce(F.octet_length(x), F.lit(0)).cast("long")
    if isinstance(kind, T.ArrayType):
        fixed, more = _width(F.element_at(x, 1), kind.elementType)
        each = F.lit(fixed).cast("long") * F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(0))
        if more is not None:
            each = each + F.aggregate(F.coalesce(x, F.array().cast(kind)), F.lit(0).cast("long"), lambda a, y: a + _width(y, kind.elementType)[1])
        return 16, each
    if isinstance(kind, T.StructType):
        parts = [_width(x[f.name], f.dataType) for f in kind.fields]
        more = [m for _, m in parts if m is not None]
        return 16 + sum(n for n, _ in parts), sum(more[1:], more[0]) if more else None
    return 8, None


def size_in_bytes(df: DataFrame) -> int:
    """About what the rows of df take when they are broadcast: read now, and of a written
    table of plain numbers from the footers of its files only."""
    parts = [_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    more = [m for _, m in parts if m is not None]
    fixed = 32 + sum(n for n, _ in parts)
    if not more:
        return fixed * df.count()
    n, bytes_ = df.agg(F.count("*"), F.sum(sum(more[1:], more[0]))).first()
    return fixed * n + (bytes_ or 0)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if its rows take at most `most` bytes; else as it is, so that
    the join shuffles, and adaptive execution splits its skewed partitions. df should be a
    written table, since its size is read now."""
    return F.broadcast(df) if size_in_bytes(df) <= most else df


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else kept; null is the empty text."""
    return F.translate(
        F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, after which a Python worker gives its free memory back: workers outlive tasks, and
    what an idle one holds is missing beside the next stage's heap."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes
        import gc

        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return wrapped
