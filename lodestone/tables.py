"""Intermediate tables in the folder that the cluster shares, and joins on hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that the cluster shares (spark.checkpoint.dir).

    Only a local session, as in tests, may go without: it gets a temporary folder. Elsewhere that is an error.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(found)
    return found


#: Whether the files of a query's shuffles go once it has ended.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, sweep: bool = False) -> DataFrame:
    """Cut the lineage: write a table to the shared folder and read it back.

    Unlike a checkpoint, the table is read column by column, and the planner's size estimate comes from the stored rows
    rather than from the plan that made them, so loops do not swell it. With `sweep`, what was shuffled to make it leaves
    the disks at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(SWEEP, None) if sweep else None
    if sweep:
        spark.conf.set(SWEEP, "true")
    try:
        df.write.parquet(path)
    finally:
        if sweep:
            spark.conf.unset(SWEEP) if before is None else spark.conf.set(SWEEP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Like durable(), as a table in buckets of a key: a join or grouping by it moves only the other side."""
    spark = df.sparkSession
    name = f"table_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark).rstrip('/')}/{name}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def counted(df: DataFrame, what: str = "true") -> tuple[DataFrame, int]:
    """A durable table and its number of rows that fulfil a condition, counted while it is written."""
    seen = Observation()
    out = durable(df.observe(seen, F.count(F.when(F.expr(what), 1)).alias("n")))
    return out, seen.get["n"]


def discard(*tables: DataFrame) -> None:
    """Delete tables that durable() wrote and nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._table_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: A key that holds more than one in so many rows is hot, so there are at most so many hot keys; and the rows that one
#: task takes in any case, so that smaller tables need no look at their keys.
HOT, FEW = 1000, 20_000


def looked_up(rows: DataFrame, found: DataFrame, key: str, how: str = "inner", many: DataFrame | str | None = None, total: int | None = None,
              merge: bool = False) -> DataFrame:
    """rows joined with found, which has one row per key, without a task for all rows of a hot key.

    A hot key's rows are dealt to as many parts as it holds thousandths of all rows, and its row of `found` is copied to
    each. The list of hot keys has at most HOT rows, whatever the size, and so is broadcast. `many` (key, __many) and
    `total` may be given where the counts are known already; where both sides hold a key's count (or more) in a column, `many`
    names it, and no list is made or joined. The join is by merging whatever the size of `found`, so what
    it moves at one size tells what it moves at another.
    """
    total = rows.count() if total is None else total
    if total <= FEW:
        found = found.drop(many) if isinstance(many, str) else found
        return rows.join(found.hint("merge") if merge else found, key, how)
    many = held(rows, key) if many is None else many
    least = -(-total // HOT)
    rest = [c for c in rows.columns if c != key]
    part = F.xxhash64(*rest) if rest else F.lit(0)
    if isinstance(many, str):
        parts = F.when(F.col(many) > F.lit(least), F.ceil(F.col(many) / F.lit(least))).otherwise(1).cast("int")
        dealt = rows.withColumn("__part", F.pmod(part, parts).cast("int"))
        copied = found.withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop(many)
        return dealt.join(copied.hint("merge"), [key, "__part"], how).drop("__part")
    hot = F.broadcast(many.where(F.col("__many") > F.lit(least)).select(F.col(key).alias("__hot"), F.ceil(F.col("__many") / F.lit(least)).cast("int").alias("__parts")))
    here = F.col(key) == F.col("__hot")
    dealt = rows.join(hot, here, "left").withColumn("__part", F.coalesce(F.pmod(part, F.col("__parts")), F.lit(0)).cast("int")).drop("__hot", "__parts")
    copies = F.sequence(F.lit(0), F.coalesce(F.col("__parts"), F.lit(1)) - 1)
    copied = found.join(hot, here, "left").withColumn("__part", F.explode(copies)).drop("__hot", "__parts")
    return dealt.join(copied.hint("merge"), [key, "__part"], how).drop("__part")


def held(rows: DataFrame, key: str) -> DataFrame:
    """How many rows each key holds, as looked_up() takes it."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("__many"))
