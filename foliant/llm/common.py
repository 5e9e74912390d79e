"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch.  Texts can be long, so a batch stays small whatever the table.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the memory of one Arrow batch; read when the plan runs."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names.  Where none is set, a local master (tests) gets a folder of its own; a
    cluster gets an error, as its executors would not see each other's files."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import atexit
        import shutil
        import tempfile

        found = tempfile.mkdtemp(prefix="foliant-ckpt-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_or_empty(col: str = "text"):
    """The column as a string, null as the empty string."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_schema(kind: str):
    """The Arrow schema of a DDL string; made on the driver, where a session is."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(kind))
