"""Session helpers shared by all operators: lineage cuts, tables, size checks."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a driver-side or broadcast reference list; longer lists are worked through in blocks.
MAX_BROADCAST_ROWS = 50_000
#: Bytes of a scratch table from which the shuffles behind it are given up at once.
LARGE_BYTES = 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder (a parquet file or a folder of them)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Without that setting a session in one process (tests) gets a temporary folder; a
    cluster doesn't, as its executors would each write to a disk of their own."""
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="vitrine-ckpt-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, for files that one step writes and another reads."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Tables that a few steps read again, as files beside the checkpoints; gone at the end of the block.

    Files are smaller than checkpoints, as they are compressed by column, and can be dropped as soon as they aren't needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, shared_folder(spark, name)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop()

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back; shuffles that only it used are given up."""
        path, kind = f"{self.folder}/{name}", df.schema
        df.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)
        del df
        fs, at = self._files(path)
        if fs.getContentSummary(at).getLength() >= LARGE_BYTES:
            release(self.spark)
        return self.spark.read.schema(kind).parquet(path)

    def _files(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def drop(self, name: str = "") -> None:
        """Delete one table, or all of them."""
        fs, path = self._files(f"{self.folder}/{name}" if name else self.folder)
        fs.delete(path, True)


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of plans that nobody holds any more; else they stay until its memory runs low."""
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(0.2)  # the first collection lets go of the plan, the next one of its shuffles
    spark._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: the lineage ends
    here, the rows are computed once, and a lost executor loses none of them."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle partitions, the number of cells hot keys are spread over."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def spread(rows: DataFrame) -> DataFrame:
    """Rows read from few files laid out for all cores, before a step in Python; those of many files stay as they lie.

    Only what is read straight from files is looked at, as a look at the number of parts
    would run the shuffles of other plans."""
    plan = rows._jdf.queryExecution().executedPlan().toString()
    if "Exchange" in plan or "Scan" not in plan:
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def collect_bounded(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> list | None:
    """All rows of ``df`` on the driver if there are at most ``limit``, else None."""
    rows = df.limit(limit + 1).collect()
    return None if len(rows) > limit else rows


def default_parallel_env() -> None:
    """One thread per numeric kernel: Spark already runs a task per core."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(name, "1")
