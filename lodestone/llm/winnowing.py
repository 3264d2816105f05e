"""Document fingerprints by winnowing, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, shuffle_partitions, table

#: Words in a gram, and grams in a window (a power of two). Any run of GRAM + WINDOW - 1 words that two texts share
#: gives them a fingerprint in common.
GRAM, WINDOW = 3, 4


def pieces(text: Column) -> Column:
    """The units that grams are made of: whole words."""
    return F.regexp_extract_all(text, F.lit(f"({WORD})"))


def turned(h: Column, k: int) -> Column:
    """A 64-bit word turned left by k bits."""
    return h if k == 0 else F.shiftleft(h, k).bitwiseOR(F.shiftrightunsigned(h, 64 - k))


def gram_hashes(units: Column, gram: int = GRAM) -> Column:
    """Rolling hashes of all runs of `gram` units; a shorter text is one run.

    Every unit is hashed once. A run's hash is the cyclic polynomial of its units' hashes: each turned by its distance
    from the run's end, all of them combined by exclusive or. As the window rolls, what was combined is turned by one.
    """
    h = F.transform(units, lambda w: F.xxhash64(w))
    out = F.transform(h, lambda x: turned(x, gram - 1))
    for left in range(gram - 2, -1, -1):  # by how much the next unit is turned
        later = F.slice(h, gram - left, F.greatest(F.size(h), F.lit(1)))
        out = F.zip_with(out, later, lambda x, y: x.bitwiseXOR(F.coalesce(turned(y, left), F.lit(0).cast("long"))))  # noqa: B023
    return F.slice(out, 1, F.greatest(F.size(h) - (gram - 1), F.lit(1)))


def winnow(hashes: Column, window: int = WINDOW) -> Column:
    """Places (from 0) of the least hash of every window, the rightmost of ties, each place once, ascending.

    With fewer hashes than a window has, the window is what there is. Minima over windows come from minima over half
    the length, so that a place costs log2(window) steps; then the last place in the window that holds the minimum is
    looked for from its end.
    """
    width, least = 1, hashes
    while width < window:
        least = F.zip_with(least, F.slice(least, width + 1, F.greatest(F.size(least), F.lit(1))), lambda x, y: F.least(x, y))
        width *= 2
    least = F.slice(least, 1, F.greatest(F.size(hashes) - (window - 1), F.lit(1)))

    def last(m: Column, i: Column) -> Column:
        found = F.when(F.get(hashes, i + (window - 1)) == m, i + (window - 1))
        for k in range(window - 2, -1, -1):
            found = found.when(F.get(hashes, i + k) == m, i + k)
        return found

    return F.array_distinct(F.transform(least, last))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def fingerprints(df: DataFrame, text: str, prefix: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Add <prefix>places and <prefix>marks (their hashes) for a text column; empty arrays for a text without words."""
    df = df.withColumn("__u", pieces(F.col(text)))
    df = df.withColumn("__h", F.when(F.size("__u") > 0, gram_hashes(F.col("__u"), gram)).otherwise(F.array().cast("array<bigint>"))).drop("__u")
    df = df.withColumn(f"{prefix}places", F.when(F.size("__h") > 0, winnow(F.col("__h"), window)).otherwise(F.array().cast("array<int>")))
    return df.withColumn(f"{prefix}marks", F.transform(f"{prefix}places", lambda p: F.get("__h", p))).drop("__h")


def written(places: str, marks: str) -> Column:
    """A fingerprint as text: place:hash in hexadecimal, by place."""
    return F.array_join(F.zip_with(places, marks, lambda p, h: F.concat(p.cast("string"), F.lit(":"), F.lower(F.hex(h)))), " ")


def bucket_of(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are at most a value: first among every sqrt(n)-th of them, then inside."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    at_most = lambda xs: F.size(F.filter(xs, lambda c: c <= value))
    coarse = at_most(longs(cuts[step - 1::step]))
    fine = F.array(*[longs(cuts[a:a + step - 1]) if cuts[a:a + step - 1] else F.array().cast("array<bigint>") for a in range(0, len(cuts) + 1, step)])
    return coarse * step + at_most(F.get(fine, coarse))


def next_texts(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, text, __bucket, __guest, and next_text: the text of the next row by descending doc_id, after the last
    the first; rows of one doc_id stand by text.

    Rows are cut into ranges of doc_id at quantiles (their number bounds what the driver gets). The first doc_id of a
    range goes also into the range before as a guest, and the first of all into the last; so each range finds its
    own neighbours in one shuffle, and no task orders the whole table.
    """
    spark = docs.sparkSession
    buckets = buckets or 8 * shuffle_partitions(spark)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("__id"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = docs.agg(F.percentile_approx("__id", [i / buckets for i in range(1, buckets)], 10 * buckets)).head()[0] or []
    cuts = sorted(set(cuts))
    docs = docs.withColumn("__bucket", bucket_of(F.col("__id"), cuts))
    heads = docs.select("__id", "__bucket").groupBy("__bucket").agg(F.max("__id").alias("__id"))
    order = Window.orderBy("__bucket")
    above = F.lead("__bucket").over(order)
    heads = heads.select("__id", F.coalesce(above, F.min("__bucket").over(Window.partitionBy())).alias("__into"))
    guests = (docs.join(F.broadcast(heads), "__id").withColumn("__bucket", F.col("__into")).drop("__into")
              .withColumn("__guest", F.lit(True)))
    rows = docs.withColumn("__guest", F.lit(False)).unionByName(guests)
    own = Window.partitionBy("__bucket").orderBy("__guest", F.col("__id").desc(), "text")
    return rows.withColumn("next_text", F.coalesce(F.lead("text").over(own), F.lit(""))), own


def fingerprint_documents(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    A null text is empty; its fingerprint is the empty string, like that of white space only; two empty fingerprints
    have likeness 1. A single row is its own next one. Repeated rows count each. An empty table gives no rows; other
    columns of the input are ignored. Fingerprints compare words as they stand, whole and with all 64 bits of a hash.
    """
    rows, own = next_texts(docs)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))).drop("next_text")
    rows = fingerprints(rows, "text", "", gram, window)
    rows = rows.select("__id", "__bucket", "__guest", "doc_id", "text", n.cast("long").alias("n_chars"), "edited", "places", "marks")
    rows = rows.withColumn("next_marks", F.lead("marks").over(own)).where(~F.col("__guest"))
    rows = fingerprints(rows, "edited", "e_", gram, window)
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        written("places", "marks").alias("fingerprint"), written("e_places", "e_marks").alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("e_marks")).alias("near_edited"),
        likeness(F.col("marks"), F.col("next_marks")).alias("near_next"))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and their edited texts, fingerprinted."""
    return fingerprint_documents(table(spark, sf_dir, "documents"))
