"""Checkpoints and named savepoints of streaming jobs.

A checkpoint is Spark's checkpoint folder: the offset log is written before a
batch, the commit log after it, state files in between. A savepoint is a copy of
that folder at a batch boundary. Copies go through Hadoop's file systems, so the
folders may be in any store Spark can write."""

from __future__ import annotations

import json
import time

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery


class SavepointError(RuntimeError):
    pass


class _Files:
    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.make, self.util = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.fs.FileUtil
        self.io = jvm.org.apache.commons.io.IOUtils
        self.fs = self.make(path).getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.make(path))

    def names(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.make(path))] if self.exists(path) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self.make(path))
        try:
            return self.io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        stream = self.fs.create(self.make(path), True)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        self.fs.delete(self.make(path), True)

    def copy(self, source: str, to: str, without: tuple[str, ...] = ()) -> None:
        """Copy to a temporary name, then rename: a half copy is never taken for
        a whole one. without: paths below `source` to leave out."""
        part = f"{to}._copying"
        self.fs.delete(self.make(part), True)
        self.fs.mkdirs(self.make(part).getParent())
        self.util.copy(self.fs, self.make(source), self.fs, self.make(part), False, self.conf)
        for name in without:
            self.delete(f"{part}/{name}")
        if not self.fs.rename(self.make(part), self.make(to)):
            raise SavepointError(f"cannot publish {to}")


def batches(spark: SparkSession, checkpoint: str) -> list[int]:
    """Numbers of the committed batches, ascending."""
    return sorted(int(n) for n in _Files(spark, checkpoint).names(f"{checkpoint}/commits") if n.isdigit())


class Savepoints:
    """Named savepoints of a job under `data_dir`. The running job's checkpoint is
    data_dir/checkpoint, savepoints are data_dir/savepoints/<name>."""

    def __init__(self, spark: SparkSession, data_dir: str | None):
        self.spark, self.data_dir = spark, data_dir

    @property
    def checkpoint(self) -> str:
        if not self.data_dir:
            raise SavepointError("no data directory is set")
        return f"{self.data_dir}/checkpoint"

    def _path(self, name: str) -> str:
        if not self.data_dir:
            raise SavepointError("no data directory is set")
        if not name or "/" in name or name.startswith("."):
            raise SavepointError(f"not a savepoint name: {name!r}")
        return f"{self.data_dir}/savepoints/{name}"

    def trigger(self, query: StreamingQuery | None, name: str) -> dict:
        """Stop the query after its next commit, or at once if it has nothing to
        do, and copy its checkpoint; records may keep coming. A batch that had
        begun meanwhile is not part of the copy. The caller starts the job again
        to go on. An existing name is an error."""
        path = self._path(name)
        if query is None or not query.isActive:
            raise SavepointError("the job is not running")
        files = _Files(self.spark, self.data_dir)
        if files.exists(path):
            raise SavepointError(f"savepoint {name} exists")
        before = batches(self.spark, self.checkpoint)[-1:]
        while query.isActive and batches(self.spark, self.checkpoint)[-1:] == before and not query.status["message"].startswith("Waiting"):
            time.sleep(0.02)
        query.stop()
        if (error := query.exception()) is not None:
            raise SavepointError(f"the job failed: {error}")
        done = batches(self.spark, self.checkpoint)
        begun = [n for n in files.names(f"{self.checkpoint}/offsets") if n.isdigit() and int(n) > (done[-1] if done else -1)]
        files.copy(self.checkpoint, path, tuple(x for n in begun for x in (f"offsets/{n}", f"offsets/.{n}.crc")))
        return {"name": name, "id": done[-1] if done else None, "path": path, "status": "completed"}

    def names(self) -> list[str]:
        return sorted(n for n in _Files(self.spark, self.data_dir).names(f"{self.data_dir}/savepoints") if not n.endswith("._copying"))

    def resume(self, name: str) -> str:
        """Copy a savepoint to the checkpoint place and return that; the savepoint
        itself stays as it is. A missing name is an error, and so is a checkpoint
        that is there already."""
        path, files = self._path(name), _Files(self.spark, self.data_dir)
        if not files.exists(path):
            raise SavepointError(f"no savepoint {name}")
        if files.exists(self.checkpoint):
            raise SavepointError(f"{self.checkpoint} exists; resume into an empty data directory")
        files.copy(path, self.checkpoint)
        return self.checkpoint

    def kind(self) -> dict:
        """What the checkpoint says of its job."""
        files, path = _Files(self.spark, self.data_dir), f"{self.checkpoint}/job.json"
        return json.loads(files.read(path)) if files.exists(path) else {}

    def check(self, parallelism: int, **job: str | None) -> None:
        """State is laid out by partition count and holds one job's kind of
        values: a restore keeps both or fails. The kind stands beside the state."""
        files = _Files(self.spark, self.data_dir)
        found = len([n for n in files.names(f"{self.checkpoint}/state/0") if n.isdigit()])
        if found and found != parallelism:
            raise SavepointError(f"checkpoint has parallelism {found}, job has {parallelism}")
        if was := self.kind():
            for what, value in job.items():
                if was.get(what) != value:
                    raise SavepointError(f"checkpoint has {what} {was.get(what)}, job has {value}")
        else:
            files.write(f"{self.checkpoint}/job.json", json.dumps(job))
