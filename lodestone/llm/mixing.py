"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, table, word_count
from lodestone.tables import durable

WEIGHTS = (5, 2, 1)
#: No source may be taken more often than this, nor any of its documents.
MOST_REPEATS = 3
#: Blocks have at most this many words, and few enough that the smallest target has FINENESS blocks.
LONGEST_BLOCK, FINENESS = 1024, 200


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """One row per source: its size, weight and target.

    Sources in order of code points, null last, take the weights in turn. Targets share all words by weight; one above
    `most` times its source's size stops there, and the excess is shared again by weight. In order of cap / weight the
    sources that stop come first, so one pass over this order finds the level that the others share.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    src = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
           .withColumn("rank", F.row_number().over(by_name))
           .withColumn("weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long"))
           .withColumn("cap", F.col("source_size") * most)
           .withColumn("ratio", F.col("cap").cast("double") / F.col("weight")))
    order = Window.orderBy("ratio", "rank")
    everything = Window.partitionBy()
    src = (src.withColumn("total", F.sum("source_size").over(everything))
           .withColumn("full", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
           .withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
           .withColumn("level", (F.col("total") - F.col("full")).cast("double") / F.col("open")))
    found = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "rank", "level"))).over(everything)
    src = src.withColumn("found", found)
    share = F.least(F.col("cap").cast("double"), F.col("found.level") * F.col("weight"))
    return src.select("source", "rank", "source_size", "total",
                      F.coalesce(share, F.col("cap").cast("double")).alias("target"))


def apportioned(df: DataFrame, share: str, seats: str, order: str, by: list[str]) -> DataFrame:
    """Sainte-Laguë: of the seats of each group `by` (all rows, if empty), the rows take those with the highest quotients
    share / (2 s - 1), s = 1, 2, ..., ties to the smaller order. Adds won.

    All seats but a few per row are sure: those won at a divisor that gives out too few, and those lost at one that
    gives out too many. Only the seats between, about two per row, are ranked.
    """
    group = Window.partitionBy(*by)
    df = df.withColumn("__n", F.count(F.lit(1)).over(group)).withColumn("__all", F.sum(share).over(group))

    def given(count: Column) -> Column:
        part = F.when(F.col("__all") > 0, F.col(share) * F.greatest(count, F.lit(0.0)) / F.col("__all")).otherwise(0.0)
        return F.floor(part + 0.5)

    df = (df.withColumn("__sure", given(F.col(seats) - F.col("__n") / 2 - 1)).withColumn("__most", given(F.col(seats) + F.col("__n") / 2 + 1))
          .withColumn("__left", F.col(seats) - F.sum("__sure").over(group)))
    seat = F.explode(F.when(F.col("__most") > F.col("__sure"), F.sequence(F.col("__sure") + 1, F.col("__most"))).otherwise(F.array().cast("array<bigint>")))
    ranked = df.select(*by, order, share, "__left", seat.alias("__seat"))
    best = Window.partitionBy(*by).orderBy((F.col(share) / (2 * F.col("__seat") - 1)).desc(), order)
    more = (ranked.withColumn("__place", F.row_number().over(best)).where(F.col("__place") <= F.col("__left"))
            .groupBy(*by, order).agg(F.count(F.lit(1)).alias("__more")))
    return (df.join(more, [*by, order], "left").withColumn("won", F.col("__sure") + F.coalesce("__more", F.lit(0)))
            .drop("__n", "__all", "__sure", "__most", "__left", "__more"))


def quotas(src: DataFrame) -> DataFrame:
    """Blocks of equal size for every source, by highest quotients of its target: adds block and quota."""
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(Window.partitionBy())
    src = (src.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(LONGEST_BLOCK), F.floor(F.coalesce(least, F.lit(0.0)) / FINENESS))).cast("long"))
           .withColumn("blocks", F.floor(F.col("total") / F.col("block") + 0.5)))
    return apportioned(src, "target", "blocks", "rank", []).select("source", "source_size", "target", "block", F.col("won").alias("quota"))


def mix(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """taken and its reasons for every row of (doc_id, source, size).

    A source's rows stand in a line by a seeded hash of doc_id (ties by doc_id, size), which is cut into equal blocks of
    words; only its last block is shorter. The hash also cuts the line into shards, and a block belongs to the shard in
    which it starts. The source's quota of blocks is apportioned to its shards by their blocks, again by highest
    quotients. Each shard then takes its quota: all its blocks as often as the quota holds them, and of the rest a run
    that starts at a seeded block and goes on from the shard's first after its last. A row takes the words that it has
    in taken blocks. No block, and so no row, is taken more than `most` times. Shards, not sources, go to a task.
    Rows of size 0 take nothing. With no words at all every target is 0. An empty table gives no rows; null doc_ids
    and repeated rows stand in the line like others.
    """
    sizes = durable(sizes.select("doc_id", "source", F.col("size").cast("long"),
                                 F.md5(F.concat(F.lit("mix|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("h")))
    n, digits = sizes.count(), 0
    while 16 ** (2 * digits) < n:  # as many shards as a shard has rows
        digits += 1
    sizes = sizes.withColumn("shard", F.substring("h", 1, digits))
    named = lambda df: df.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))).drop("source")
    src = named(quotas(targets(sizes, weights, most)))
    rows = named(sizes.withColumn("source_name", F.col("source")))
    before = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = (rows.groupBy("key", "shard").agg(F.sum("size").alias("shard_size"))
              .withColumn("from", F.coalesce(F.sum("shard_size").over(before), F.lit(0))).join(src, "key"))
    block_at = lambda c: F.floor((c + F.col("block") - 1) / F.col("block"))  # noqa: E731  first block that starts at or after c
    shards = (shards.withColumn("first", block_at(F.col("from"))).withColumn("own", block_at(F.col("from") + F.col("shard_size")) - F.col("first"))
              .withColumn("wanted", F.least(F.col("quota"), most * F.sum("own").over(Window.partitionBy("key")))))
    shards = apportioned(shards, "own", "wanted", "shard", ["key"]).withColumn("shard_quota", F.least(F.col("won"), most * F.col("own")))
    start = F.conv(F.substring(F.md5(F.concat(F.lit("start|"), "key", F.lit("|"), "shard")), 1, 8), 16, 10).cast("long")
    some = F.col("own") > 0
    shards = (shards.withColumn("every", F.when(some, F.floor(F.col("shard_quota") / F.col("own"))).otherwise(F.lit(0)))
              .withColumn("rest", F.when(some, F.col("shard_quota") - F.col("every") * F.col("own")).otherwise(F.lit(0)))
              .withColumn("a", F.when(some, start % F.col("own")).otherwise(F.lit(0))))
    # the run [a, a + rest) around the shard's blocks, as two stretches of the line; and what the last block before is taken
    shards = (shards.withColumn("to", F.least(F.col("a") + F.col("rest"), F.col("own"))).withColumn("again", F.greatest(F.col("a") + F.col("rest") - F.col("own"), F.lit(0)))
              .withColumn("last", F.when(some, F.col("every") + F.when((F.col("rest") > 0) & (F.col("to") == F.col("own")) & (F.col("a") < F.col("own")), 1).otherwise(0)))
              .withColumn("lead", F.coalesce(F.last("last", ignorenulls=True).over(before), F.lit(0))))
    own = Window.partitionBy("key", "shard").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = (rows.join(shards.drop("shard_size", "wanted", "won", "last"), ["key", "shard"])
            .withColumn("p", F.col("from") + F.sum("size").over(own) - F.col("size")).withColumn("q", F.col("p") + F.col("size")))
    begin = F.col("first") * F.col("block")
    inside = lambda a, b: F.greatest(F.lit(0), F.least(F.col("q"), begin + b * F.col("block")) - F.greatest(F.col("p"), begin + a * F.col("block")))
    head = F.greatest(F.lit(0), F.least(F.col("q"), begin) - F.col("p"))
    taken = (head * F.col("lead") + (F.col("size") - head) * F.col("every")
             + inside(F.col("a"), F.col("to")) + inside(F.lit(0), F.col("again")))
    return rows.select("doc_id", F.col("source_name").alias("source"), "size", "source_size", "target", taken.cast("long").alias("taken"),
                       "block", "quota", "shard", F.col("shard_quota").cast("long"))


def sizes_of(docs: DataFrame) -> DataFrame:
    """doc_id, source and number of words of every row: null, empty and blank texts have 0; other columns are left behind."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them: each as often as the nearest whole number of times its words are taken.

    Every column of the input goes on, whatever its name; extra columns have no say. Rows that share a doc_id share the
    decision, as do all rows with a null one. Rows without words (null text too) are never taken. An empty table gives
    no rows.
    """
    id_ = {"__null": F.col("doc_id").isNull(), "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0))}
    copies = (mix(sizes_of(docs)).withColumns(id_).groupBy(*id_).agg(F.sum("taken").alias("t"), F.sum("size").alias("s"))
              .where("s > 0").select(*id_, F.floor(F.col("t") / F.col("s") + 0.5).cast("int").alias("__copies")).where("__copies > 0"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *[c.alias(k) for k, c in id_.items()],
                         F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(WORD).alias("__words"))
    joined = packed.where("__words").join(copies, list(id_))
    return joined.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("__row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed."""
    return mix(sizes_of(table(spark, sf_dir, "documents"))).select(
        F.col("doc_id").cast("long"), "size", "source_size", "target", "taken", "block", "quota")


ORACLE_SQL = {"op9_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5('mix|' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
a AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
b AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM a),
c AS (SELECT *, [5, 2, 1][CAST((rank - 1) % 3 + 1 AS INT)] AS weight, 3 * source_size AS cap FROM b),
e AS (SELECT *, CAST(cap AS DOUBLE) / weight AS ratio FROM c),
f AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
        CAST(sum(cap) OVER (ORDER BY ratio, rank ROWS UNBOUNDED PRECEDING) AS BIGINT) - cap AS used,
        CAST(sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open FROM e),
g AS (SELECT *, CAST(total - used AS DOUBLE) / open AS level FROM f),
i AS (SELECT g.*, least(CAST(cap AS DOUBLE), (SELECT arg_min(level, rank_of) FROM (SELECT level, row_number() OVER (ORDER BY ratio, rank) AS rank_of FROM g WHERE ratio > level)) * weight) AS target FROM g),
j AS (SELECT *, CAST(greatest(1, least(1024, floor(min(target) FILTER (target > 0) OVER () / 200))) AS BIGINT) AS block FROM i),
k AS (SELECT *, CAST(floor(CAST(total AS DOUBLE) / block + 0.5) AS BIGINT) AS blocks FROM j),
q AS (SELECT rank, count(*) AS quota FROM (
        SELECT rank, row_number() OVER (ORDER BY target / (2 * s - 1) DESC, rank) AS place, blocks
        FROM k, unnest(range(1, CAST(floor(target / block) AS BIGINT) + 20)) AS u(s)) WHERE place <= blocks GROUP BY rank),
m AS (SELECT k.*, coalesce(quota, 0) AS quota FROM k LEFT JOIN q USING (rank)),
z AS (SELECT CAST((SELECT min(g) FROM range(0, 9) AS t(g) WHERE pow(16, 2 * g) >= (SELECT count(*) FROM d)) AS INT) AS digits),
r AS (SELECT d.*, coalesce('s' || source, 'null') AS key, substring(h, 1, digits) AS shard,
        CAST(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS p FROM d, z),
n AS (SELECT key, source, shard, CAST(sum(size) AS BIGINT) AS shard_size, CAST(min(p) AS BIGINT) AS begin_at FROM r GROUP BY key, source, shard),
o AS (SELECT n.*, block, quota, (begin_at + block - 1) // block AS first, (begin_at + shard_size + block - 1) // block - (begin_at + block - 1) // block AS own
      FROM n JOIN m ON n.source IS NOT DISTINCT FROM m.source),
v AS (SELECT key, shard, count(*) AS won FROM (
        SELECT key, shard, row_number() OVER (PARTITION BY key ORDER BY CAST(own AS DOUBLE) / (2 * s - 1) DESC, shard) AS place,
          least(quota, 3 * (SELECT sum(own) FROM o AS w WHERE w.key = o.key)) AS wanted
        FROM o, unnest(range(1, CAST(3 * own + 2 AS BIGINT))) AS u(s)) WHERE place <= wanted GROUP BY key, shard),
x AS (SELECT o.*, least(coalesce(won, 0), 3 * own) AS sq FROM o LEFT JOIN v USING (key, shard)),
y AS (SELECT *, CASE WHEN own > 0 THEN sq // own ELSE 0 END AS every, CASE WHEN own > 0 THEN sq % own ELSE 0 END AS rest,
        CASE WHEN own > 0 THEN CAST('0x' || substring(md5('start|' || key || '|' || shard), 1, 8) AS BIGINT) % own ELSE 0 END AS a FROM x),
e1 AS (SELECT r.doc_id, r.size, r.p + i.i AS word, y.* FROM r JOIN y USING (key, shard), unnest(range(0, r.size)) AS i(i)),
e2 AS (SELECT doc_id, size, key, word // block AS number FROM e1),
e3 AS (SELECT doc_id, size, key, number, count(*) AS words FROM e2 GROUP BY ALL),
e4 AS (SELECT e3.*, y.every + CASE WHEN (number - y.first - y.a + y.own) % y.own < y.rest THEN 1 ELSE 0 END AS times
       FROM e3 JOIN y ON e3.key = y.key AND number >= y.first AND number < y.first + y.own),
e5 AS (SELECT doc_id, CAST(sum(words * times) AS BIGINT) AS taken FROM e4 GROUP BY doc_id)
SELECT d.doc_id, d.size, m.source_size, m.target, coalesce(taken, 0) AS taken, m.block, CAST(m.quota AS BIGINT) AS quota
FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source LEFT JOIN e5 USING (doc_id)"""}
