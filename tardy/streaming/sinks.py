"""Sinks of ``foreachBatch`` that may run a batch again.

A file topic takes a batch in three steps: the rows are written to a staging
folder, a plan that lists the staged files is put in place by one rename, and
the files are renamed into the topic.  The plan is the point of no return: a
batch without one is staged anew, a batch with one only finishes its
renames, and a batch whose plan is marked done is skipped.  So each message
stands in the topic once, wherever the writer is stopped.

Records are kept per (sink name, batch id) under ``_sink`` in the topic's
folder, which readers skip.  A broker topic has no rename: its batch is sent,
then recorded; a writer that stops in between sends it again (at least once),
and the header ``batch`` lets readers drop the repeat.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Writer = Callable[[DataFrame, int], None]


class _Records:
    """Small files of one sink, read and replaced whole."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        jvm = spark._jvm
        self.Path = jvm.org.apache.hadoop.fs.Path
        self.conf = spark._jsc.hadoopConfiguration()
        self.bytes = jvm.java.lang.String
        self.root = f"{root.rstrip('/')}/_sink/{name}"
        self.fs = self.Path(root).getFileSystem(self.conf)

    def path(self, batch: int, what: str):
        return self.Path(f"{self.root}/{batch:012d}.{what}")

    def exists(self, path) -> bool:
        return self.fs.exists(path)

    def put(self, path, lines: list[str]) -> None:
        """All or nothing: written aside, then renamed."""
        aside = self.Path(f"{path.toString()}.tmp")
        out = self.fs.create(aside, True)
        out.write(bytearray("\n".join(lines).encode()))
        out.close()
        self.move(aside, path)

    def read(self, path) -> list[str]:
        src = self.fs.open(path)
        try:
            text = bytes(src.readAllBytes()).decode()
        finally:
            src.close()
        return text.split("\n") if text else []

    def move(self, a, b) -> None:
        self.fs.mkdirs(b.getParent())
        if not self.fs.rename(a, b):
            raise OSError(f"cannot rename {a.toString()} to {b.toString()}")


def file_topic_writer(path: str, name: str, fmt: str = "json", options: dict | None = None) -> Writer:
    """Each batch once into the folder ``path``.  ``name`` tells this sink
    from other writers of the topic and must stay the same over restarts."""

    def write(batch: DataFrame, batch_id: int) -> None:
        records = _Records(batch.sparkSession, path, name)
        done, plan = records.path(batch_id, "done"), records.path(batch_id, "plan")
        if records.exists(done):
            return
        stage = records.path(batch_id, "stage")
        if not records.exists(plan):
            records.fs.delete(stage, True)
            batch.write.format(fmt).options(**(options or {})).save(stage.toString())
            files = sorted(s.getPath().getName() for s in records.fs.listStatus(stage))
            records.put(plan, [f for f in files if f.startswith("part-")])
        for i, file in enumerate(records.read(plan)):
            staged = records.Path(f"{stage.toString()}/{file}")
            suffix = file.split(".", 1)[1] if "." in file else fmt
            target = records.Path(f"{path.rstrip('/')}/{name}-{batch_id:012d}-{i:05d}.{suffix}")
            if not records.exists(target):
                records.move(staged, target)
        records.move(plan, done)
        records.fs.delete(stage, True)

    return write


def broker_writer(records_path: str, name: str, options: dict, fmt: str = "kafka") -> Writer:
    """Each batch at least once to a broker topic; a batch that is recorded
    as sent is skipped."""

    def write(batch: DataFrame, batch_id: int) -> None:
        records = _Records(batch.sparkSession, records_path, name)
        done = records.path(batch_id, "done")
        if records.exists(done):
            return
        mark = F.array(F.struct(F.lit("batch").alias("key"),
                                F.lit(f"{name}-{batch_id}").cast("binary").alias("value")))
        batch.withColumn("headers", mark).write.format(fmt).options(**options).save()
        records.put(done, [])

    return write
