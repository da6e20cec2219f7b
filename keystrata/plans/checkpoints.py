"""Where lineage is cut: the cluster's shared checkpoint folder."""

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Only for sessions on one machine that set none.
FALLBACK = "/tmp/checkpoints"


def own_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; one is set only where there is none.

    Executors of a cluster don't share a local folder, so there it must be set.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or FALLBACK)
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read again.

    For iterations: a checkpoint keeps the size that was estimated for its plan,
    which joins multiply round by round, and files have their own.
    """
    path = f"{own_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def forget(*written_rows: DataFrame) -> None:
    """Delete the files behind rows that ``written`` returned."""
    for df in written_rows:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def dealt_by_range(df: DataFrame, column: str) -> DataFrame:
    """``df`` in ranges of a column, its range number ``part`` written down.

    Range bounds come from a sample and partitions may be merged at run time,
    so the numbers hold only for rows that were written.
    """
    own_folder(df.sparkSession)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, column).withColumn("part", F.spark_partition_id()).checkpoint()


def running_sum(df: DataFrame, order: str, column: str, name: str) -> DataFrame:
    """``df`` with the sum of ``column`` over all rows before (by ``order``, unique).

    Rows are summed in ranges; of the ranges only the totals meet, a row each.
    """
    dealt = dealt_by_range(df, order)
    totals = dealt.groupBy("part").agg(F.sum(column).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(column).over(inside), F.lit(0))
    return dealt.join(F.broadcast(starts), "part").withColumn(name, F.col("__start") + own).drop("part", "__start")
