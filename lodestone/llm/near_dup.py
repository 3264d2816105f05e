"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, lean, ship, table
from lodestone.operators.linking import components
from lodestone.tables import counted, discard, durable, held, looked_up

#: Slots that shingle hashes fall into before they are permuted; the second permutation is a table of this length.
SLOTS = 1 << 22
#: Chance to miss a pair just at the threshold.
MISS = 3e-7
#: Coordinates kept as one byte each, for estimates before sets are compared, and how many standard errors an
#: estimate may lie below the threshold.
SKETCH, ERRORS = 768, 4.0
#: Bits of the fixed-size filter of ids whose sets are wanted, and of one of its rows.
FILTER, ROW = 1 << 23, 1 << 15
#: Members of a bucket that are compared with one another in one task.
CHUNK = 512
#: Rows that a Python worker handles at once.
AT_ONCE = 1024
#: A bucket's hubs are its smallest ids as they stand and after each of these bits is turned over.
ORDERS = (0x2A5F1C3B97D4E68B, 0x55E3C06A71B82D9F)


@dataclass(frozen=True)
class Plan:
    """Words in a shingle, the least similarity in percent, and coordinates in a band."""

    words: int = 5
    percent: int = 80
    rows: int = 6

    @property
    def bands(self) -> int:
        return math.ceil(math.log(MISS) / math.log1p(-((self.percent / 100) ** self.rows)))

    @property
    def least_estimate(self) -> float:
        t = self.percent / 100
        return t - ERRORS * math.sqrt(t * (1 - t) / SKETCH)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Distinct 64-bit hashes, ascending, of all runs of `words` words, A-Z lower-cased; a shorter text is one run."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=1)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    out = h[:len(h) - words + 1]
    for k in range(1, words):
        out = mixed(out) * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - words + 1 + k]
    return np.unique(mixed(out))


@lru_cache(maxsize=1)
def second_permutation(length: int) -> np.ndarray:
    """Windows of `length` over the permutation of all slots, its start repeated at the end: row s holds the
    values that slot s gets under every circular shift."""
    pi = np.random.default_rng(20).permutation(SLOTS).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:length - 1]]), length)


def signature(shingles: np.ndarray, length: int) -> np.ndarray:
    """Circulant MinHash: the first permutation deals the shingles to slots once; each coordinate is the least value
    under the second permutation, shifted by one more place."""
    x = shingles & np.uint64(SLOTS - 1)
    x = (x * np.uint64(0x2545F491) + np.uint64(0x3039)) & np.uint64(SLOTS - 1)  # first permutation: odd factor,
    slots = np.unique(x ^ (x >> np.uint64(11))).astype(np.int64)                 # then a shift folded in
    shifted = second_permutation(length)
    least = shifted[slots[:256]].min(axis=0)
    for a in range(256, len(slots), 256):
        np.minimum(least, shifted[slots[a:a + 256]].min(axis=0), out=least)
    return least


SIGNED = "doc_id long, k1 long, k2 long, n long, set_key binary, bands array<long>, sketch binary"


def sign_partition(plan: Plan) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = max(plan.bands * plan.rows, SKETCH)
        salt = mixed(np.arange(1, plan.bands * plan.rows + 1, dtype=np.uint64)).reshape(plan.bands, plan.rows)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [])
            for text in batch.column(3):
                s = shingle_set(text.as_py(), plan.words)
                rows[0].append(len(s))
                if not len(s):
                    for r in rows[1:]:
                        r.append(None)
                    continue
                sig = signature(s, length)
                bands = mixed((mixed(sig[:salt.size].astype(np.uint64).reshape(salt.shape) + salt)).sum(axis=1, dtype=np.uint64) + salt[:, 0])
                rows[1].append(xxhash.xxh3_128_digest(s.tobytes()))
                rows[2].append(bands.view(np.int64))
                rows[3].append(sig[:SKETCH].astype(np.uint8).tobytes())
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(r, k) for r, k in zip(rows, kinds, strict=True))],
                                             names=[x.split()[0] for x in SIGNED.split(", ")])
    return run


def sets_partition(words: int, wanted: np.ndarray) -> Callable:
    """Sets of the texts (k1, k2, text, bit) whose bit is on in the filter (a few others may come along)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column(3).to_numpy()
            batch = batch.filter(pa.array((wanted[bit >> 3] >> (bit & 7)) & 1 == 1))
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                yield pa.record_batch([part.column(0), part.column(1), pa.array([shingle_set(t.as_py(), words).tobytes() for t in part.column(2)], pa.binary())],
                                      names=["k1", "k2", "shingles"])
    return run


def wanted_partition(wanted: np.ndarray) -> Callable:
    """Rows whose last column, a bit's place, is on in the filter (a few others may come along), without that column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column(batch.num_columns - 1).to_numpy()
            yield batch.filter(pa.array((wanted[bit >> 3] >> (bit & 7)) & 1 == 1)).select(list(range(batch.num_columns - 1)))
    return run


def bit_of(id_: str) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(FILTER))


def filter_of(ids: DataFrame) -> np.ndarray:
    """The bits of all ids: a filter of FILTER bits, whatever their number."""
    bits = ids.select(bit_of(ids.columns[0]).alias("bit"))
    rows = bits.groupBy(F.floor(F.col("bit") / ROW).alias("row")).agg(F.bitmap_construct_agg(F.col("bit") % ROW).alias("bits")).toArrow()
    out = np.zeros(FILTER // 8, np.uint8)
    for row, raw in zip(rows["row"].to_pylist(), rows["bits"].to_pylist(), strict=True):
        out[row * ROW // 8:(row + 1) * ROW // 8] = np.frombuffer(raw, np.uint8)
    return out


def filtered(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (row, ...) that may be among the ids: most others are left out before anything is moved."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.withColumn("__bit", bit_of("row")).mapInArrow(lean(wanted_partition(filter_of(ids)), AT_ONCE), schema)


def alike_partition(least: float, percent: int) -> Callable:
    """Pairs whose sizes fit and whose sketches agree in so many places that the texts may be alike."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SKETCH) for i in (4, 5))
                fits = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
                batch = batch.filter(pa.array(fits & ((x == y).mean(axis=1) >= least)))
            yield batch.select([0, 1])
    return run


def verify_partition(percent: int) -> Callable:
    """Pairs whose full sets are alike."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(a) + len(b) - len(np.union1d(a, b))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])
    return run


def cross_pairs(least: float, percent: int) -> Callable:
    """Of a chunk of a bucket's members and a chunk of its guests, the pairs of different components that may be alike.

    Pairs of two guests come from the lesser one's visit; a pair that shares several buckets from the first of them.
    """
    def run(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        guest, minor, ids, n, group = (part[c].to_numpy() for c in ("guest", "minor", "id", "n", "component"))
        sketch = np.frombuffer(b"".join(part["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH)
        bands = part["bands"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        band = np.flatnonzero(bands[0] == part["key"][0].as_py())[0]
        home = np.flatnonzero(~guest)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for i in np.flatnonzero(guest):
            fits = home[(group[home] != group[i]) & (100 * np.minimum(n[home], n[i]) >= percent * np.maximum(n[home], n[i]))]
            fits = fits[~minor[fits] | (ids[fits] > ids[i])]
            fits = fits[~(bands[fits, :band] == bands[i, :band]).any(axis=1)]
            fits = fits[(sketch[fits] == sketch[i]).mean(axis=1) >= least]
            if len(fits):
                out.append((np.maximum(ids[i], ids[fits]), np.minimum(ids[i], ids[fits])))
        x, y = (np.concatenate([o[k] for o in out]) if out else np.empty(0, np.int64) for k in (0, 1))
        return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})
    return run


def text_keys(text: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a text; a null text is empty."""
    given = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(given, F.lit(s)).alias(f"k{s}") for s in (1, 2)]


def grouped(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, k1, k2 (of the text), n, component (null for texts without words) and component_id of every row."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_keys(F.col("text")), F.col("text").cast("string").alias("text"))
    signed = durable(rows.mapInArrow(lean(sign_partition(plan), AT_ONCE), SIGNED).withColumn("row", F.monotonically_increasing_id()))
    # one class per distinct set, named by one of its rows; only that row goes on
    classes, n_classes = counted(signed.where("set_key is not null").groupBy("set_key").agg(F.min("row").alias("id"), F.min("doc_id").alias("lead")))
    leading = durable(signed.select(F.col("row").alias("id"), "bands").join(classes.select("id").hint("merge"), "id", "left_semi"))  # bands move once
    banded = leading.select(F.explode("bands").alias("key"), "id")
    shared = durable(banded.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    many = shared.select("key", F.col("members").alias("__many"))
    members, n_members = counted(looked_up(banded, shared, "key", many=many, total=plan.bands * n_classes))
    discard(leading)
    other = lambda salt: F.min(F.col("id").bitwiseXOR(F.lit(salt))).bitwiseXOR(F.lit(salt))
    hubs = members.groupBy("key").agg(F.array_distinct(F.array(F.min("id"), *map(other, ORDERS))).alias("hubs"), F.first("members").alias("members"))
    stars = (looked_up(members, hubs, "key", many="members", total=n_members).select("id", F.explode("hubs").alias("hub")).where("id <> hub")
             .select(F.greatest("id", "hub").alias("x"), F.least("id", "hub").alias("y")).distinct())

    def beside(pairs: DataFrame, n: int, of: Callable) -> DataFrame:
        left = looked_up(pairs, of("x"), "x", total=n, merge=True)
        return looked_up(left, of("y"), "y", many=held(pairs, "y"), total=n, merge=True)

    def alike(pairs: DataFrame, n: int) -> DataFrame:
        few = filtered(signed.select("row", "n", "sketch"), pairs.select("x").union(pairs.select("y")))
        of = lambda k: few.select(F.col("row").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
        return beside(pairs, n, of).select("x", "y", "nx", "ny", "sx", "sy").mapInArrow(lean(alike_partition(plan.least_estimate, plan.percent), AT_ONCE), "x long, y long")

    def verified(pairs: DataFrame) -> tuple[DataFrame, int]:
        pairs, n = counted(pairs)
        if not n:
            return pairs, 0
        ids = pairs.select(F.col("x").alias("row")).union(pairs.select("y")).distinct()
        texts = durable(signed.select("row", "k1", "k2").join(ids, "row", "left_semi"))
        wanted = filter_of(texts.select("k1"))
        sets = rows.select("k1", "k2", "text", bit_of("k1")).mapInArrow(lean(sets_partition(plan.words, wanted), AT_ONCE), "k1 long, k2 long, shingles binary")
        # one set per text first: copies are dropped before they move, and the join takes the sets where they lie
        sets = durable(sets.groupBy("k1", "k2").agg(F.first("shingles").alias("shingles")).join(texts, ["k1", "k2"]).select("row", "shingles"))
        of = lambda k: sets.select(F.col("row").alias(k), F.col("shingles").alias(f"s{k}"))
        links = counted(beside(pairs, n, of).select("x", "y", "sx", "sy").mapInArrow(lean(verify_partition(plan.percent), AT_ONCE), "x long, y long"))
        discard(sets, texts)
        return links

    stars, n = counted(stars)
    known = components(verified(alike(stars, n))[0])
    tops = durable(classes.select("id").join(known, "id", "left").select("id", F.coalesce("component", "id").alias("component")))
    for last in (False, True):
        placed = members.where("members > 2").join(tops, "id")
        parts = durable(placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("rep"), F.first("members").alias("members")))
        open_ = parts.groupBy("key").agg(F.max(F.struct("size", "component", "rep")).alias("major"), F.count(F.lit(1)).alias("groups"),
                                         F.first("members").alias("members")).where("groups > 1")
        open_, n = counted(open_.select("key", "members", F.col("major.component").alias("major"), F.col("major.rep").alias("hub"), (F.col("members") - F.col("major.size")).alias("minors")))
        if not n:
            break
        if last:
            more = open_pairs(placed, open_, signed, plan, n_members).distinct().join(stars, ["x", "y"], "left_anti")
        else:  # one of each component first
            reps = looked_up(parts.select("key", "component", "rep", "members"), open_, "key", many="members", total=n_members).where("component <> major")
            reps, n = counted(reps.select(F.greatest("rep", "hub").alias("x"), F.least("rep", "hub").alias("y")).distinct().join(stars, ["x", "y"], "left_anti"))
            if not n:
                continue
            more = alike(reps, n)
            stars = stars.union(reps)
        links, n = verified(more)
        if n:
            root = lambda k: tops.select(F.col("id").alias(k), F.col("component").alias(f"c{k}"))
            joined = links.join(root("x"), "x").join(root("y"), "y").select(F.col("cx").alias("x"), F.col("cy").alias("y"))
            up = components(joined).select(F.col("id").alias("component"), F.col("component").alias("top"))
            tops = durable(looked_up(tops, up, "component", "left").select("id", F.coalesce("top", "component").alias("component")))
    named = durable(classes.join(tops, "id").select("set_key", "component", "lead"))
    leads = named.groupBy("component").agg(F.min("lead").alias("component_id"))
    named = looked_up(named.select("component", "set_key"), leads, "component").select("set_key", "component", "component_id")
    small = signed.select("set_key", "doc_id", "k1", "k2", "n", "row")
    return (looked_up(small, named, "set_key", "left").withColumn("component_id", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
            .select("doc_id", "k1", "k2", "n", "component", "component_id"))


def open_pairs(placed: DataFrame, open_: DataFrame, signed: DataFrame, plan: Plan, total: int) -> DataFrame:
    """Pairs across components of the buckets that hold several, which may be alike.

    Two members of the bucket's largest component need no comparison, so only the others (guests) visit. Members and
    guests are cut into chunks of at most about CHUNK; a task compares one chunk of each. With few guests beside a large
    component a bucket costs each member once.
    """
    chunks = lambda c: F.ceil(F.col(c) / CHUNK).cast("int")
    of = lambda salt, c: F.pmod(F.xxhash64("id", F.lit(salt)), chunks(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), chunks(c) - 1))
    ids = placed.join(open_.select("key"), "key", "left_semi").select("id")
    rows = (looked_up(placed.select("key", "id", "component", "members"), open_, "key", many="members", total=total).withColumn("minor", F.col("component") != F.col("major"))
            .join(filtered(signed.select("row", "n", "bands", "sketch"), ids).withColumnRenamed("row", "id").hint("merge"), "id"))
    home = rows.withColumns({"ci": of("home", "members"), "cj": every("minors"), "guest": F.lit(False)})
    guests = rows.where("minor").withColumns({"cj": of("guest", "minors"), "ci": every("members"), "guest": F.lit(True)})
    columns = ["key", "ci", "cj", "guest", "minor", "id", "n", "component", "bands", "sketch"]
    return home.select(*columns).union(guests.select(*columns)).groupBy("key", "ci", "cj").applyInArrow(cross_pairs(plan.least_estimate, plan.percent), "x long, y long")


def near_duplicates(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Rows with the same set of shingles are one class; one row of each goes on. In each bucket of a band every class is
    compared with three hubs (the smallest under three orders), which links most of a large group without all its
    pairs. Then, in buckets whose members are still in different components, one of each component is compared with
    one of the largest, and at last all pairs across components, so that no link that joins components is lost. A link
    is drawn when the full sets of both texts are alike. component_id is the smallest doc_id of the component.

    Texts without words (or null) have no shingles and stay alone. Rows that share a doc_id but not the text are
    separate; so are rows with a null doc_id, which never lead others: their component_id is null if no row of the
    component has a doc_id, and they are never `kept`. Empty tables give no rows; other columns are ignored.
    """
    return grouped(docs, plan).select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def kept_documents(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The rows that stay: one of each group of near copies, with every column of the input, whatever its name.

    The row with the smallest doc_id stays (null last), of several with that doc_id the one whose text has the least
    hash, of several with that text too the one with the least hash over all columns. Rows with a null doc_id belong to
    their text's group like others. Rows whose text is null or has no words all stay. An empty table gives no rows.
    """
    keys = ["__null", "__id", "k1", "k2"]
    id_ = F.col("doc_id").cast("long")
    of_id = {"__null": id_.isNull(), "__id": F.coalesce(id_, F.lit(0))}
    per = grouped(docs, plan).where("component is not null").withColumns(of_id).groupBy("component", *keys).agg(F.count(F.lit(1)).alias("__rows"))
    best = per.groupBy("component").agg(F.min(F.struct(*keys)).alias("best")).select("best.*")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    packed = docs.select(F.struct(*columns).alias("__row"), F.xxhash64(*plain).alias("__hash"), *[c.alias(k) for k, c in of_id.items()], *text_keys(F.col("text")),
                         F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(WORD).alias("__words"))
    one = packed.where("__words").groupBy(*keys).agg(F.min_by("__row", "__hash").alias("__row"))
    stay = one.join(best, keys, "left_semi").select("__row").union(packed.where("not __words").select("__row"))
    return stay.select("__row.*")


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of 3-word shingles are alike to 85 percent."""
    return near_duplicates(table(spark, sf_dir, "documents"), Plan(words=3, percent=85, rows=7))


ORACLE_SQL = {"op2_near_dup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d),
u AS (SELECT doc_id, len(g) AS n, unnest(g) AS sh FROM s),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n + b.n AS total, count(*) AS common FROM u a JOIN u b ON a.sh = b.sh AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n),
l AS (SELECT x, y FROM i WHERE 100 * common >= 85 * (total - common)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS seen FROM s UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.seen = e.x)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept
FROM s JOIN (SELECT doc_id, min(seen) AS c FROM r GROUP BY doc_id) USING (doc_id)"""}
