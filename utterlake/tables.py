"""Tables in the folder that the driver and all executors share, and numbers over a whole table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; in a local session without one, below a temporary folder."""
    base = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="utterlake-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: it is computed once, and lineage ends here."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, key: str, most: int = 1 << 20) -> DataFrame:
    """``rows`` by ``key`` in as many partitions as hold ``most`` rows each on average, if the session's shuffle partitions
    are too few for that: what a task sorts then does not grow with the table. The rows are counted in a pass of its own."""
    wanted = -(-rows.count() // most)
    return rows if wanted <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(wanted, key)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their number in ``order``, from 0: each range partition counts its own rows, and the ranges' totals,
    one row a partition, are added up. The ranges are written, so that both passes see the same ones."""
    part = F.spark_partition_id()
    at = F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)
    ranged = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", part).withColumn("__at", at), "numbered")
    totals = ranged.groupBy("__part").agg(F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(totals.select("__part", before.alias("__before")), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")
