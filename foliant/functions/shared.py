"""Results that a plan needs more than once, written to the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where none is set, a local master (tests) gets one that goes with the process; a
    cluster gets an error, as its executors would not see each other's files."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import atexit
        import shutil
        import tempfile

        found = tempfile.mkdtemp(prefix="foliant-shared-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame) -> DataFrame:
    """`df` worked out once, written to the shared folder and read from there; a lost executor costs nothing of it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
