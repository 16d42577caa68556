"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of a batch that a Python worker is handed; a longer row comes alone.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
#: Rows of ids and hashes that are worth a task, and the fewest tasks of any step.
TASK_ROWS, LEAST_TASKS = 50_000, 12


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. One task reads a row group, so texts in fewer files than there are cores are dealt out; larger tables never are."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores) if name in ("documents", "pages") and len(table.inputFiles()) < cores else table


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the session's ``spark.checkpoint.dir``. Without one, a single-machine session gets a temporary folder; a cluster is refused."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of so many ``rows`` at most, in tasks of ``TASK_ROWS`` rows each; with so many that they suffice already, it stays as it is."""
    return df.coalesce(LEAST_TASKS + rows // TASK_ROWS)


class Scratch:
    """Tables written to a folder of their own beside the checkpoints, so that lineage ends there, and removed when they have served."""

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark, self.folder, self.tables = spark, f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """Write and read back. With a bound of its ``rows``, which ``count`` of another kept table may give without a job of note, a
        small table is written by few tasks."""
        self.tables += 1
        path = f"{self.folder}/{self.tables}"
        (df if rows is None else dealt(df, rows)).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, number: int) -> None:
        """Remove the table that was kept as the ``number``-th, from 1; nothing if there is none."""
        self._remove(f"{self.folder}/{number}")

    def clear(self) -> None:
        self._remove(self.folder)

    def _remove(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def keyed_modulo(column: str, modulus: int):
    """crc32 of an id written as text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def bound_batches(spark: SparkSession) -> None:
    """Bound what a Python worker is handed at once, for the session; smaller settings stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, None)
        number = int(now.rstrip("bB")) if now and now.rstrip("bB").lstrip("-").isdigit() else 0
        if number <= 0 or number > most:
            spark.conf.set(key, str(most))


def map_arrow(df: DataFrame, build: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, rows: int = 2000) -> DataFrame:
    """Apply a batch function in Arrow; ``build`` makes it once in each task, and no call sees more than ``rows`` rows."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = build()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                yield apply(batch.slice(start, rows))

    return df.mapInArrow(run, schema)
