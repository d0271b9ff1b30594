"""Tables in the shared folder, and other session helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BASES: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all machines share; only
    where that is unset (a local session, as in tests) under a temporary one.
    What the application wrote there goes when it ends."""
    sc = spark.sparkContext
    if sc.applicationId not in _BASES:
        base = sc.getConf().get("spark.checkpoint.dir")
        if not base and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = base or tempfile.mkdtemp(prefix="scratch-")
        _BASES[sc.applicationId] = f"{base}/tables-{uuid.uuid4().hex}"
        atexit.register(_delete, spark, _BASES[sc.applicationId])
    return f"{_BASES[sc.applicationId]}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    """Remove a folder; one that cannot be reached any more stays."""
    try:
        jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)
    except Exception:  # noqa: BLE001  the session may be gone
        pass


#: Narrow rows that one task of a small table takes.
TASK_ROWS = 50_000


def tasks_for(rows: int) -> int:
    """Tasks for a table of about so many narrow rows."""
    return max(8, -(-rows // TASK_ROWS))


def cut(frame: DataFrame, tasks: int | None = None) -> DataFrame:
    """Write a frame as a table in the shared folder and read it back, so that
    later stages, retries and iterations do not compute what stands before. (A
    checkpoint would compute the frame twice and keep all columns together.)
    tasks: at most so many tasks and files, for tables whose size is known."""
    spark, path = frame.sparkSession, scratch_path(frame.sparkSession, "cut")
    (frame.coalesce(tasks) if tasks else frame).write.parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out._scratch = path
    return out


def drop(*frames: DataFrame | None) -> None:
    """Delete tables that `cut` wrote and no later plan reads."""
    for frame in frames:
        if frame is not None and getattr(frame, "_scratch", None):
            _delete(frame.sparkSession, frame._scratch)


#: Bytes of an Arrow batch, on either side of a Python function.
BATCH_BYTES = 4 << 20


def batched(frame: DataFrame) -> DataFrame:
    """The frame, in a session whose Arrow batches are bounded by bytes: ten
    thousand long texts at once would fill a task's memory. A bound that the
    cluster sets itself stays."""
    key, spark = "spark.sql.execution.arrow.maxBytesPerBatch", frame.sparkSession
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, str(BATCH_BYTES))
    return frame


def document_id_crc(doc_id: str) -> Column:
    """crc32 of the id's decimal text; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0))


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """These names, with underscores before those that the frame has itself."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out
