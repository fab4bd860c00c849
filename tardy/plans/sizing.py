"""Broadcast only what has a proven size; cut lineage reliably.

A derived table (an aggregate over the trip table) has no trustworthy size
estimate before it runs.  ``materialize`` writes it as a parquet table in the
shared ``spark.checkpoint.dir`` folder (survives executor loss); from then on
Spark knows its real file size.  ``bounded_broadcast`` hints a broadcast only
when the written bytes are below a bound; otherwise the join is Spark's and
AQE's choice, and is split if skewed.

Written tables live until ``release_tables`` or the end of the program.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import ensure_checkpoint_dir

# Parquet bytes of all tables that one plan broadcasts together; rows in
# memory take a few times that, far below an executor's heap.
MAX_BROADCAST_BYTES = 8 << 20

_TABLES: list[tuple[SparkSession, str]] = []


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    target, fs = _path(spark, path)
    return fs.exists(target)


def delete_path(spark: SparkSession, path: str) -> None:
    target, fs = _path(spark, path)
    fs.delete(target, True)


def list_path(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    target, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def move_path(spark: SparkSession, path: str, to: str) -> None:
    """Rename within a store."""
    source, fs = _path(spark, path)
    target, _ = _path(spark, to)
    if not fs.rename(source, target):
        raise OSError(f"cannot rename {path} to {to}")


def path_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files under a path."""
    target, fs = _path(spark, path)
    return fs.getContentSummary(target).getLength()


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new folder name in the shared folder, deleted by ``release_tables``
    or at the end of the program."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}/{uuid.uuid4().hex}"
    _TABLES.append((spark, path))
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a parquet table under the shared checkpoint folder
    and read it back: one job, the result no longer depends on lineage
    (survives lost executors), and the scan carries real file sizes for
    the planner.  (An eager RDD checkpoint would compute ``df`` twice.)"""
    spark = df.sparkSession
    path = scratch_path(spark, "tables")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_parts(df: DataFrame, column: str) -> tuple[DataFrame, dict[str, int]]:
    """Like ``materialize``, in a folder for each value of ``column`` (few
    values); also the written bytes of each."""
    spark = df.sparkSession
    path = scratch_path(spark, "tables")
    df.write.partitionBy(column).parquet(path)
    target, fs = _path(spark, path)
    sizes = {s.getPath().getName().split("=", 1)[1]: fs.getContentSummary(s.getPath()).getLength()
             for s in fs.listStatus(target) if s.isDirectory()}
    return spark.read.schema(df.schema).parquet(path), sizes


def within_budget(sizes: dict[str, int], budget: int = MAX_BROADCAST_BYTES) -> set[str]:
    """The tables that one plan broadcasts: the smallest first, as long as
    their bytes together fit."""
    out, spent = set(), 0
    for name in sorted(sizes, key=lambda k: (sizes[k], k)):
        spent += sizes[name]
        if spent > budget:
            break
        out.add(name)
    return out


def salted_left_join(df: DataFrame, table: DataFrame, keys: list[str], salts: int = 16) -> DataFrame:
    """Left join with a table of unique keys that is too large to broadcast,
    where no adaptive split helps (streams): a hot key's rows are dealt over
    ``salts`` tasks, and the table is repeated for each."""
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts)).cast("int"))
    repeated = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(repeated, [*keys, "_salt"], "left").drop("_salt")


def release_tables() -> None:
    """Delete every table written so far; frames that read them are void."""
    while _TABLES:
        spark, path = _TABLES.pop()
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001 - the session is gone; nothing to delete with
            return


atexit.register(release_tables)


def table_bytes(df: DataFrame) -> int:
    """File bytes behind a frame that only reads written tables."""
    spark = df.sparkSession
    return sum(path_bytes(spark, f) for f in df.inputFiles())


def bounded_broadcast(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES,
                      already_materialized: bool = False) -> DataFrame:
    """Return ``df`` (materialised) with a broadcast hint iff its written
    bytes fit."""
    small = df if already_materialized else materialize(df)
    return F.broadcast(small) if table_bytes(small) <= max_bytes else small
