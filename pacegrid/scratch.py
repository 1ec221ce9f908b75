"""The checkpoint folder of rounds that cut their lineage, and tables kept there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoints(spark: SparkSession) -> None:
    """Set the session's checkpoint folder from ``spark.checkpoint.dir``. Only a local master without
    that setting gets a temporary folder, for executors of a cluster wouldn't see it."""
    if spark.sparkContext.getCheckpointDir():
        return
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="pacegrid-")
    spark.sparkContext.setCheckpointDir(folder)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` for joins that deal both sides out by their key. The planner takes exploded rows for no more
    bytes than the file that they come from has, and files of rounds compress well: as broadcasts such
    rows would pass whole through the driver."""
    return df.hint("merge")


def spread(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df`` dealt out by columns to tasks of about ``rows`` rows each: before short rows are exploded into
    many, for a small file is one task however much comes of it."""
    return df.repartition(max(1, -(-df.count() // rows)), *by)


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder as Parquet and read back. Its lineage is cut as by a
    checkpoint, and its size is the files' own: a checkpoint keeps the planner's estimate, and those of
    joins multiply from round to round. Joins with it deal their rows out."""
    checkpoints(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return dealt(df.sparkSession.read.schema(df.schema).parquet(path))
