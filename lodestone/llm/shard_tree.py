"""Sharding by a tree of weighted hash draws: region, rack, shard."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import table


@dataclass(frozen=True)
class Tree:
    """Shards 0 to shards-1, filled rack by rack and region by region; weights defaults to 1 for every shard."""

    shards: int
    per_rack: int = 5
    racks_per_region: int = 2
    weights: tuple[float, ...] | None = None

    def regions(self) -> list[list[list[int]]]:
        racks = [list(range(a, min(a + self.per_rack, self.shards))) for a in range(0, self.shards, self.per_rack)]
        return [racks[a:a + self.racks_per_region] for a in range(0, len(racks), self.racks_per_region)]

    def weight(self, shard: int) -> float:
        return 1.0 if self.weights is None else self.weights[shard]


def draw(key: Column, level: str, node: Column, weight: Column) -> Column:
    """Arrival time of a key at a node: exponential with the node's weight, from a hash of key, level and node.

    Weight 0 never wins.
    """
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(level), node), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.when(weight > 0, -F.ln(u) / weight).otherwise(F.lit(float("inf")))


def descend(key: Column, tree: Tree) -> Column:
    """The shard of a key: the region that it arrives at first, in that the rack, in that the shard.

    Each level draws anew among the children of the node chosen before, each child with the weight of all its shards.
    So a key leaves a node's children as they are unless a weight below that node changes, and then moves only between
    that child and the others: a new region takes keys only into itself. Ties go to the smaller number.
    """
    regions = tree.regions()
    racks = [rack for region in regions for rack in region]
    heavy = lambda shards: float(sum(tree.weight(s) for s in shards))
    node = lambda n, w: F.struct(F.lit(n).alias("node"), F.lit(w).alias("weight"))
    numbers = iter(range(len(racks)))
    of_region = F.array(*[F.array(*[node(next(numbers), heavy(rack)) for rack in region]) for region in regions])
    of_rack = F.array(*[F.array(*[node(s, float(tree.weight(s))) for s in rack]) for rack in racks])
    first = lambda level, children: F.array_min(F.transform(children, lambda c: F.struct(draw(key, level, c["node"], c["weight"]).alias("at"), c["node"].alias("node"))))["node"]
    region = first("region", F.array(*[node(i, heavy([s for rack in r for s in rack])) for i, r in enumerate(regions)]))
    rack = first("rack", F.get(of_region, region))
    return first("shard", F.get(of_rack, rack))


def place(docs: DataFrame, tree: Tree, grown: Tree) -> DataFrame:
    """doc_id, size, text_crc32, shard, grown_shard for every row; only these narrow columns go on."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(key, F.lit("slot")).alias("__h"),
        descend(key, tree).cast("int").alias("shard"),
        descend(key, grown).cast("int").alias("grown_shard"))


#: Equal rows that one task numbers.
TOGETHER = 10_000


def slots(rows: DataFrame, per_group: int = 20_000, shards: int = 40) -> DataFrame:
    """Number the rows of each shard from 0 without gaps, in order of a hash of the key.

    Equal rows are counted first, and given a run of numbers, so neither a null nor a repeated doc_id piles up. A
    shard's rows are cut into ranges of the hash, of about per_group rows; ranges are counted, the counts summed along
    the shard, and rows numbered inside their range. So no task holds a whole shard.
    """
    n = rows.count()
    groups = 1
    while groups * shards * per_group < n:
        groups *= 2
    bits = groups.bit_length() - 1
    cut = F.shiftrightunsigned("__h", 64 - bits) if bits else F.lit(0).cast("long")
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__same")).withColumn("__g", cut)
    before = Window.partitionBy("shard").orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy("shard", "__g").agg(F.sum("__same").alias("__n"))
              .select("shard", "__g", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from")))
    order = [F.shiftleft("__h", bits) if bits else F.col("__h"), F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    own = Window.partitionBy("shard", "__g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(starts, ["shard", "__g"]).withColumn("__from", F.col("__from") + F.sum("__same").over(own) - F.col("__same"))
    few = rows.where(F.col("__same") <= TOGETHER).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__same") - 1)))
    many = rows.where(F.col("__same") > TOGETHER).withColumn("__lot", F.explode(F.sequence(F.lit(0), F.floor((F.col("__same") - 1) / TOGETHER))))
    many = many.repartition("__lot", "__h").withColumn("__i", F.explode(F.sequence(F.col("__lot") * TOGETHER, F.least(F.col("__same"), (F.col("__lot") + 1) * TOGETHER) - 1))).drop("__lot")
    return few.unionByName(many).withColumn("slot", F.col("__from") + F.col("__i")).drop("__g", "__from", "__h", "__same", "__i")


def shard_documents(docs: DataFrame, shards: int = 40, weights: tuple[float, ...] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row, under the law `key`.

    doc_id and the number of shards (with their weights) decide. Null text counts as empty; rows with a null doc_id
    share one key, as do repeated doc_ids; repeated rows get slots of their own. An empty table gives no rows. Other
    columns of the input are ignored. grown_shard is the shard when there is one more, of weight 1.
    """
    tree = Tree(shards, weights=weights)
    grown = Tree(shards + 1, weights=None if weights is None else (*weights, 1.0))
    rows = place(docs, tree, grown)
    return slots(rows, shards=shards).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long"), "grown_shard")


def op7_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards."""
    return shard_documents(table(spark, sf_dir, "documents"))
