"""Tables in the shared folder that cut lineage between supersteps."""

from __future__ import annotations

import logging
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_log = logging.getLogger(__name__)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on a local master, where it is unset, a new temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="arcweave-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Has a folder deleted when the application ends; results may read it until then."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


class Steps:
    """Written tables that cut lineage. Those that are replaced or dropped go at once, the others when the application ends."""

    def __init__(self, spark: SparkSession, name: str = "steps"):
        self.spark, self.n = spark, 0
        self.at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, replaces: DataFrame | None = None, name: str = "", codec: str = "snappy") -> DataFrame:
        self.n += 1
        path = f"{self.at}/{self.n}" + f"-{name}" * bool(name)
        _log.debug("step %s", path)
        df.write.option("compression", codec).parquet(path)
        if self.n == 1:
            delete_at_end(self.spark, self.at)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._step_path = path
        self.drop(replaces)
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            path = getattr(t, "_step_path", None)
            if path:
                p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def indexed(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``name``, 0, 1, 2, ... in the given order, without sending all rows to one task.

    Rows are range-partitioned and written; each partition is numbered from the number
    of rows before it.  They are written first as they are, since finding the ranges
    would else compute them twice.
    """
    steps = Steps(df.sparkSession)
    placed = steps.write(steps.write(df).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part").orderBy(*order)
    # One row a partition on the small side.
    out = placed.withColumn("__at", F.row_number().over(inside)).join(F.broadcast(counts), "__part")
    return out.withColumn(name, (F.col("__before") + F.col("__at") - 1).cast("long")).drop("__part", "__before", "__at")
