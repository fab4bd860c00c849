"""Shared helpers: scratch tables in the cluster's shared folder, text batches.

Every operator writes what it must reuse as Parquet under
``spark.checkpoint.dir`` (shared storage, survives lost executors) and
deletes its intermediate tables when its result has been written.
"""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import ensure_checkpoint_dir

#: bytes of text that a task holds in working arrays at once (a longer
#: single text is a slice of its own)
SLICE_BYTES = 8 << 20
#: rows of an Arrow batch: a few MB of usual texts in the JVM and in Python
BATCH_ROWS = 2000


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per
    application (they need not share the driver's folders), and let Arrow
    batches of whole texts be small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    top = os.path.dirname(package)
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{os.path.basename(package)}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, top))
    context.addPyFile(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever store it is on."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Intermediate tables of one operator call.

    ``table`` writes a DataFrame and reads it back (lineage ends there);
    ``result`` does so for the last one and deletes all the others.  Result
    tables are deleted when the driver program ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def path(self, name: str = "t") -> str:
        self._n += 1
        return f"{self.root}/{self._n}-{name}"

    def table(self, df: DataFrame, name: str = "t", codec: str = "snappy") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path, compression=codec)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (out, path)
        return out

    def forget(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            _, path = self._paths.pop(id(t), (None, None))
            if path:
                delete_path(self.spark, path)

    def drop(self) -> None:
        delete_path(self.spark, self.root)

    def keep(self) -> None:
        """Leave the tables until the driver program ends: the result reads
        them when it is asked for."""
        atexit.register(_forget, self.spark, self.root)

    def result(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}-result"
        df.write.parquet(path)
        self.drop()
        atexit.register(_forget, self.spark, path)
        return self.spark.read.schema(df.schema).parquet(path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        delete_path(spark, path)
    except Exception:  # noqa: BLE001 - the session may be gone at exit
        pass


def crc_mod5(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5 (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def is_held_out(doc_id: Column) -> Column:
    """True where the remainder is 0; a null id is held out (never learned from)."""
    return F.coalesce(crc_mod5(doc_id) == 0, F.lit(True))


def text_slices(batch: pa.RecordBatch, column: str,
                max_bytes: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """(rows, their texts without nulls) in slices of bounded text size."""
    if not batch.num_rows:
        return
    texts = pc.fill_null(batch.column(column), "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    block = (np.cumsum(sizes) - sizes) // max_bytes
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], len(sizes)]):
        yield batch.slice(a, b - a), texts.slice(a, b - a)
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker is used again by later
    stages, next to the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts in a row, offsets with one more entry than texts);
    a view of the Arrow buffers, nothing is copied."""
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, dtype=width)[texts.offset:texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]]
    return raw, (offsets - offsets[0]).astype(np.int64)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each segment [offsets[i], offsets[i+1]); 0 for an empty one."""
    out = np.zeros((len(offsets) - 1,) + values.shape[1:], dtype=values.dtype)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], axis=0)
    return out


class BoundedCache(dict):
    """A dict that stops taking entries when full: words met early are the
    frequent ones, and a rare word is just computed again."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def put(self, key, value):
        if len(self) < self.limit:
            self[key] = value
        return value


def rows(columns: dict[str, pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [columns[f.name].cast(f.type) if isinstance(columns[f.name], pa.Array)
         else pa.array(columns[f.name], f.type) for f in schema], schema=schema)
