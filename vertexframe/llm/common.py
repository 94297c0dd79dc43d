"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import threading
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCK = threading.Lock()
_TOKENIZERS: dict = {}
#: Rows of a broadcast side that its callers count first (ids and keys of 16 bytes: some 20 MB at most).
BROADCAST_ROWS = 200_000
#: Names of the columns that hold a caller's row while an operator works on it.
ROW = "row"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; one of our own only where that is unset and Spark is a single process (tests)."""
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    with _LOCK:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="vertexframe-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed now and read back from the shared checkpoint folder (survives lost executors)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store, if it is there."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints of DataFrames that are no longer referred to: its cleaner waits for a collection in the driver, which may be long in coming."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def returning(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, whose memory goes back to the system at its end: Python workers live on and would keep the most that any task took."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only in the GNU library
                if trim is not None:
                    trim(0)

    return whole


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, added: Iterable[str]) -> list[str]:
    """The columns of df but for those that clash with added ones (Spark ignores case in names)."""
    taken = {a.lower() for a in added}
    return [c for c in df.columns if c.lower() not in taken]


def held(names: Iterable[str]) -> Column:
    """The columns `names` as one struct: inside it their names clash with nothing.  No names: a field of its own, as no struct is empty."""
    return F.struct(*([col(c).alias(c) for c in names] or [F.lit(0).alias("_")])).alias(ROW)


def released(names: Iterable[str], row: Column | None = None) -> list[Column]:
    """The columns of a struct that `held` made."""
    row = F.col(ROW) if row is None else row
    return [row.getField(c).alias(c) for c in names]


def small(df: DataFrame) -> DataFrame:
    """df, marked for a broadcast if a count shows that it is small; df should be cheap to compute twice."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def hf_tokenizer(path: str, *, plain: bool = False):
    """The tokenizer of a .json file, once per Python process, without threads of its own.

    plain: special strings inside texts are ordinary text (else they are special, the library's default).
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, plain) not in _TOKENIZERS:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        tokenizer.encode_special_tokens = plain
        _TOKENIZERS[path, plain] = tokenizer
    return _TOKENIZERS[path, plain]


def tokenizer_path(name: str) -> str:
    """Where an installed public vocabulary file lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def raw_values(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each value of a string column, one at a time; null as none."""
    wide = pa.types.is_large_string(column.type)
    if not len(column):
        return
    _, places, data = column.buffers()
    bounds = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    content = memoryview(data) if data is not None else memoryview(b"")
    valid = column.is_valid().to_pylist() if column.null_count else None
    for i in range(len(column)):
        yield bytes(content[bounds[i] : bounds[i + 1]]) if valid is None or valid[i] else b""


def slices(batches: Iterable[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about `size` bytes of a text column, and at most 512 rows (one text may be larger)."""
    for batch in batches:
        lengths = np.array([len(x) for x in raw_values(batch.column(column))], np.int64)
        begin = 0
        while begin < batch.num_rows:
            end = begin + max(1, int(np.searchsorted(np.cumsum(lengths[begin : begin + 512]), size, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def pack(records: np.ndarray) -> bytes:
    """Records as compressed bytes, field by field: sorted and small fields nearly vanish."""
    raw = b"".join(np.ascontiguousarray(records[name]).tobytes() for name in records.dtype.names)
    return len(records).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unpack(blob: pa.Buffer, kind: np.dtype) -> np.ndarray:
    view = memoryview(blob)
    n = int.from_bytes(view[:8], "little")
    raw = memoryview(pa.Codec("zstd").decompress(view[8:], n * kind.itemsize))
    out, at = np.empty(n, kind), 0
    for name in kind.names:
        field = kind[name]
        out[name] = np.frombuffer(raw[at : at + n * field.itemsize], field.base).reshape(n, *field.shape)
        at += n * field.itemsize
    return out


def deal(bucket: np.ndarray, records: np.ndarray, buckets: int) -> tuple[pa.Array, pa.Array]:
    """Records dealt into buckets: (bucket, packed records), one row for each bucket that is used."""
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    used = np.flatnonzero(np.diff(bounds))
    return pa.array(used, pa.int64()), pa.array([pack(records[order[bounds[b] : bounds[b + 1]]]) for b in used], pa.binary())


def gather(batches: Iterable[pa.RecordBatch], kind: np.dtype) -> np.ndarray:
    """The records of all `blob` values."""
    found = [unpack(x.as_buffer(), kind) for batch in batches for x in batch.column("blob")]
    return np.concatenate(found) if found else np.empty(0, kind)


def in_parts(records: np.ndarray, size: int, make: Callable[[np.ndarray], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(records), size):
        yield make(records[k : k + size])
