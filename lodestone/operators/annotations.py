"""Annotations: spans, tags, merging of branches, lookups and candidate-key joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order of entity types in which spans are chosen and tags written (fixed values).
PRIORITY = {"cell": 0, "hormone": 1, "gene": 2, "protein": 2}
TAGS = {"cell": "C", "gene": "G", "protein": "G", "hormone": "H"}


def span_end(text: Column, start: Column, end: Column, mention: Column) -> Column:
    """The exclusive end of a span: one more if only that makes its text the mention; null if it lies outside."""
    longer = (end - start + 1 == F.length(mention)) & (F.substring(text, start + 1, end - start + 1) == mention)
    fixed = F.when(F.coalesce(longer, F.lit(False)), end + 1).otherwise(end)
    return F.when((start >= 0) & (fixed > start) & (fixed <= F.length(text)), fixed)


def crosses(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether spans [a, b) and [c, d) overlap without one holding the other."""
    return ((a < c) & (c < b) & (b < d)) | ((c < a) & (a < d) & (d < b))


def non_crossing(spans: Column) -> Column:
    """Of an array of structs (start, end, type, key), those kept: longest first, by type, start, end and key; a span
    that crosses a kept one goes. In order of start, longest first.

    The choice depends on all before it, so it folds over one chunk's sorted array.
    """
    rank = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    keyed = F.transform(spans, lambda s: F.struct((s["start"] - s["end"]).alias("a"), F.coalesce(F.try_element_at(rank, s["type"]), F.lit(99)).alias("b"),
                                                  s["start"].alias("start"), s["end"].alias("end"), s["key"].alias("key"), s["type"].alias("type")))
    empty = F.filter(keyed, lambda s: F.lit(False))
    kept = F.aggregate(F.array_sort(keyed), empty, lambda acc, s: F.when(
        F.exists(acc, lambda k: crosses(s["start"], s["end"], k["start"], k["end"])), acc).otherwise(F.array_append(acc, s)))
    placed = F.array_sort(F.transform(kept, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("e"), s["b"].alias("b"), s["key"].alias("key"), s["end"].alias("end"), s["type"].alias("type"))))
    return F.transform(placed, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), s["key"].alias("key")))


def tag_numbers(rows: DataFrame, group: str, prefix: str, key: str, order: str) -> DataFrame:
    """Add `number`: per group and prefix, keys are numbered from 1 by where they first stand."""
    firsts = rows.groupBy(group, prefix, key).agg(F.min(order).alias("__first"))
    number = F.row_number().over(Window.partitionBy(group, prefix).orderBy("__first", key))
    return rows.join(firsts.withColumn("number", number).drop("__first"), [group, prefix, key])


def tagged(text: Column, spans: Column) -> Column:
    """A text with tags around its spans (an array of structs start, end, type, tag).

    Every span is two events, its opening and its closing, with what they write. At one place closings come first, that
    of the span that began last before others; of openings, that of the span that ends last. Ties go by type and tag. The
    text between an event and the one before goes in front of what the event writes.
    """
    text = F.coalesce(text, F.lit(""))
    types = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    rank = lambda s: F.coalesce(F.try_element_at(types, s["type"]), F.lit(99))

    def event(at: Column, kind: int, depth: Column, by_type: Column, tag: Column, form: str) -> Column:
        return F.struct(at.cast("int").alias("at"), F.lit(kind).alias("kind"), depth.cast("int").alias("depth"), by_type.alias("rank"), tag.alias("tag"), F.format_string(form, tag).alias("write"))

    openings = F.transform(spans, lambda s: event(s["start"], 1, -s["end"], rank(s), s["tag"], "[%s]"))
    closings = F.transform(spans, lambda s: event(s["end"], 0, -s["start"], -rank(s), s["tag"], "[/%s]"))
    events = F.array_sort(F.concat(closings, openings))
    before = lambda i: F.coalesce(F.get(events, i - 1)["at"], F.lit(0))
    parts = F.transform(events, lambda e, i: F.concat(F.substring(text, before(i) + 1, e["at"] - before(i)), e["write"]))
    last = F.coalesce(F.get(events, F.size(events) - 1)["at"], F.lit(0))
    return F.when(spans.isNull(), text).otherwise(F.concat(F.array_join(parts, ""), F.substring(text, last + 1, F.length(text))))


def render_tags(rows: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Add `tagged`."""
    return rows.withColumn("tagged", tagged(F.col(text), F.col(spans)))


def merge_branches(left: DataFrame, right: DataFrame, key: str, aligned: list[str]) -> DataFrame:
    """Full outer join of two branches on a key, with `problem` set where a row is missing or fields disagree.

    Fields are compared only where both are given.
    """
    l = left.select(F.col(key), F.struct(*left.columns).alias("l"))
    r = right.select(F.col(key), F.struct(*right.columns).alias("r"))
    some = lambda c: F.nullif(c.cast("string"), F.lit(""))
    unequal = [F.coalesce(some(F.col(f"l.{c}")) != some(F.col(f"r.{c}")), F.lit(False)) for c in aligned]
    wrong = F.when(F.col("l").isNull(), "left missing").when(F.col("r").isNull(), "right missing")
    for c, bad in zip(aligned, unequal, strict=True):
        wrong = wrong.when(bad, f"{c} differs")
    return l.join(r, key, "full_outer").withColumn("problem", wrong)


def by_candidate_keys(items: DataFrame, targets: DataFrame, item: str, target: str, keys: list[str]) -> DataFrame:
    """Each item with the target that its most specific key finds; keys that several targets share find nothing."""
    spread = lambda df, i: df.select(F.col(i), F.posexplode(F.array(*[F.col(k).cast("string") for k in keys])).alias("priority", "key")).where("key is not null")
    unique = spread(targets, target).groupBy("priority", "key").agg(F.count_distinct(target).alias("n"), F.min(target).alias(target)).where("n = 1").drop("n")
    best = spread(items, item).join(unique, ["priority", "key"]).groupBy(item).agg(F.min_by(target, "priority").alias(target))
    return items.select(item).distinct().join(best, item, "left")


def three_valued(direct: Column, mapped_any: Column, mapped_all_known: Column) -> Column:
    """True if shown directly or by a mapped record, false if all mapped records are known, else null."""
    return F.when(F.coalesce(direct, F.lit(False)) | F.coalesce(mapped_any, F.lit(False)), F.lit(True)).when(mapped_all_known, F.lit(False))
