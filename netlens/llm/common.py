"""Tables written to the shared folder, table readers and the plan pieces that the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it has been counted and has no more rows than this; otherwise the join shuffles.
BROADCAST_ROWS = 500_000
#: Bytes of one Arrow batch between Spark and a Python worker; both sides hold a few of them at a time.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by BATCH_BYTES, unless the session bounds them lower; ten thousand whole texts are six times as much and more."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if _bytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def _bytes(value: str) -> int:
    """A size as Spark's settings have it."""
    number = value.lower().rstrip("bkmgt")
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}[value.lower()[len(number) :][:1]]


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session may lack it; it then gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="netlens-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_folder(spark)}/netlens-{label}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


class Stage:
    """A table written once to the shared folder: a lost executor costs a re-read, not the work before it."""

    def __init__(self, frame: DataFrame, label: str):
        self.spark, self.path = frame.sparkSession, new_folder(frame.sparkSession, label)
        frame.write.parquet(self.path)
        self.frame = self.spark.read.schema(frame.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; nothing may read ``frame`` afterwards."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def stage(frame: DataFrame, label: str) -> DataFrame:
    return Stage(frame, label).frame


def free_name(frame: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet, whatever the case."""
    taken = {column.lower() for column in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded(frame: DataFrame, rows: int | None = None) -> DataFrame:
    """``frame`` with a broadcast hint if a count shows that it is small; unchanged otherwise."""
    limit = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(frame) if frame.limit(limit + 1).count() <= limit else frame


def fold_remainder(key: Column, parts: int) -> Column:
    """``crc32`` of the key's decimal text, modulo ``parts``: the folds that the contracts fix."""
    return F.crc32(key.cast("string").cast("binary")) % parts
