"""What the operators of this subpackage have in common: shipping code, shared tables, blocks of documents."""

from __future__ import annotations

import ctypes
import gc
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once an application."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    fd, name = tempfile.mkstemp(prefix="tidemark", suffix=".zip")
    with os.fdopen(fd, "wb") as f:
        f.write(data.getvalue())
    sc.addPyFile(name)
    sc._tidemark_shipped = True


_model: dict[tuple, object] = {}


def only(key: tuple, make: Callable[[], object]):
    """A worker's one large model, with what it has cached: another one's makes way, so workers that many jobs use stay bounded."""
    if key not in _model:
        _model.clear()
        trim()
        _model[key] = make()
    return _model[key]


def trim() -> None:
    """Give memory that a task has freed back to the machine; the allocators of C, Python and Arrow keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def release() -> None:
    """Before work on large arrays: another operator's model makes way too."""
    _model.clear()
    trim()


def tidily(work: Callable, *given):
    """work(*given) with no other operator's model held, and what it has freed given back at its end."""
    release()
    done = work(*given)
    trim()
    return done


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, and a trim at their end."""
    yield from batches
    trim()


def settle(spark: SparkSession) -> None:
    """Between large jobs: the driver drops what the ones before have left, shuffles and broadcasts nobody refers to among it, and gives memory back."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where that is unset and all runs in one process one of our own (for tests)."""
    held = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not held and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not held:
        held = "file://" + tempfile.mkdtemp(prefix="tidemark-shared-")
        spark.sparkContext.setCheckpointDir(held)
    return held


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again, which cuts its lineage and runs it once."""
    return stored(df, name)[0]


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """What `written` gives, and where it is."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that `stored` has written."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    _written.remove(path)


_written: list[str] = []


def clear_written(spark: SparkSession) -> int:
    """Delete what `written` has left in the shared folder, once no result that was made of it is needed; how many tables."""
    n = len(_written)
    while _written:
        discard(spark, _written[-1])
    return n


def identity(docs: DataFrame) -> DataFrame:
    """doc_id as long, text as UTF-8 bytes (null: empty), and all other columns in one struct `rest`, so none can clash; all nullable, as tasks return them."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    kind = docs.select(*[F.col(f"`{c}`") for c in rest]).schema.simpleString() if rest else "struct<none:int>"
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
        (F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(None).cast("int").alias("none"))).cast(kind).alias("rest"),
    )


def word_count(text: Column) -> Column:
    """Words of a text (null: none), by the definition in words.py."""
    return F.coalesce(F.size(F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")), F.lit(0))


def sizes(docs: DataFrame) -> tuple[int, int]:
    """Rows and bytes of text, two numbers."""
    r = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    return r["n"], r["b"] or 0


def block_count(total_bytes: int, block_bytes: int) -> int:
    """Blocks of about `block_bytes`, at every size. A block sends a row only to hash ranges that it has keys for, so rows never outnumber keys."""
    return int(max(1, total_bytes // block_bytes))


def block_of(blocks: int) -> Column:
    """The block of a row of `identity`: by doc_id; rows without one, which may be many, by text."""
    return F.pmod(F.xxhash64(F.lit(7), "doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(blocks)).cast("int")


def by_bytes(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, of about `limit` bytes in `column` (one row at least)."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes + 1) - 1) // limit
    firsts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(firsts, firsts[1:]):
        yield batch.slice(a, b - a)


def bits_for(n: int) -> int:
    """Smallest r with 2**r >= n."""
    return max(0, int(n - 1).bit_length())


def bucket_slices(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each of 2**bits buckets, dealt by the leading bits, begins in the sorted uint64 keys; one more for the end."""
    if bits == 0:
        return np.array([0, len(keys)])
    firsts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.append(np.searchsorted(keys, firsts), len(keys))
