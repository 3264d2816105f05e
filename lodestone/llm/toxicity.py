"""Toxicity scores by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import lean, ship, table

#: Terms are hashed into so many places.
PLACES = 1 << 22
#: Bounds of the labelled sample that the model is fitted on: toxic and other rows, by a hash of doc_id.
TOXIC_ROWS, OTHER_ROWS = 3000, 6000
#: Terms that the model knows at most, those of them chosen by frequency (at most a 40th of the rows), and how far (in standard errors) the rates
#: of a term must differ between the classes for the rest.
TERMS, FREQUENT, DIFFERENCE = 2048, 192, 4.0
FACTORS, EPOCHS, BATCH, LEAST_BATCHES, RATE, DECAY, SEED = 6, 14, 512, 16, 0.03, 3e-4, 5
#: Words whose terms a worker remembers.
REMEMBERED = 150_000
THRESHOLD, HELD_OUT = 0.3, 2
#: Rows that a worker scores at once.
AT_ONCE = 256
TERM = re.compile(r"[^\W_]+")


def terms(word: str) -> set[int]:
    """Places of a word and, if it is longer, of its first four and five letters."""
    raw = word.encode()
    found = {zlib.crc32(b"w" + raw) % PLACES}
    for n in (4, 5):
        if len(word) > n:
            found.add(zlib.crc32(b"%d" % n + word[:n].encode()) % PLACES)
    return found


def terms_of(text: str | None) -> set[int]:
    return set().union(*map(terms, set(TERM.findall((text or "").lower()))))


@dataclass
class Machine:
    """Score of a set of terms x: bias + sum of w + sum over pairs of the product of their factors, as a logit."""

    places: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.v
        return self.bias + x @ self.w + 0.5 * ((s * s) - x @ (self.v * self.v)).sum(axis=1)

    def scorer(self) -> Callable[[str | None], float]:
        """Score of one text; remembers which of the known terms a word has."""
        index = {int(p): i for i, p in enumerate(self.places)}
        known: dict[str, tuple[int, ...]] = {}

        def score(text: str | None) -> float:
            if len(known) > REMEMBERED:
                known.clear()
            found: set[int] = set()
            for word in set(TERM.findall((text or "").lower())):
                at = known.get(word)
                if at is None:
                    at = known[word] = tuple(index[t] for t in terms(word) if t in index)
                found.update(at)
            rows = sorted(found)
            s, v = self.v[rows].sum(axis=0), self.v[rows]
            logit = self.bias + self.w[rows].sum() + 0.5 * float((s * s - (v * v).sum(axis=0)).sum())
            return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))

        return score


def fit(samples: list[np.ndarray], y: np.ndarray, share: float) -> Machine:
    """Fit to sets of places and their labels; share: the share of toxic rows among all labelled ones.

    Terms are those whose rates differ clearly between the classes and the most frequent ones, with which the others
    may interact. Steps are Adam's on seeded batches; at the end the bias is moved from the sample's share to the true
    one. With one class only, the score is the smoothed share.
    """
    odds = lambda p: float(np.log(p / (1 - p)))
    if not len(y) or y.min() == y.max():
        return Machine(np.empty(0, np.int64), odds(min(max(share, 0.01), 0.99)), np.empty(0), np.empty((0, FACTORS)))
    flat = np.concatenate(samples).astype(np.uint32)
    row = np.repeat(np.arange(len(samples), dtype=np.int32), [len(s) for s in samples])
    places, col, df = np.unique(flat, return_inverse=True, return_counts=True)
    del flat
    col = col.astype(np.int32)
    pos = np.bincount(col[y[row] > 0], minlength=len(places))
    p1, p0 = pos / y.sum(), (df - pos) / (len(y) - y.sum())
    rate = df / len(y)
    z = np.abs(p1 - p0) / np.sqrt(rate * (1 - rate) * (1 / y.sum() + 1 / (len(y) - y.sum())) + 1e-9)
    frequent = np.argsort(-df, kind="stable")[:min(FREQUENT, len(y) // 40)]  # no more than a small sample can bear
    telling = [i for i in np.argsort(-z, kind="stable")[:TERMS] if z[i] >= DIFFERENCE and df[i] >= 3]
    chosen = np.array(sorted({*frequent.tolist(), *telling[:TERMS - FREQUENT]}))
    to = np.full(len(places), -1, np.int32)
    to[chosen] = np.arange(len(chosen))
    col = to[col]
    x = np.zeros((len(samples), len(chosen)), bool)
    x[row[col >= 0], col[col >= 0]] = True
    del row, col, to
    rng = np.random.default_rng(SEED)
    params = [np.array([odds(y.mean())]), np.zeros(len(chosen)), rng.normal(0, 0.02, (len(chosen), FACTORS))]
    m, s, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(y)), min(len(y), max(LEAST_BATCHES, len(y) // BATCH))):
            b, w, v = params
            xb = x[rows].astype(np.float32)
            sums = xb @ v
            logit = b + xb @ w + 0.5 * (sums * sums - xb @ (v * v)).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[rows]) / len(rows)
            grads = [np.array([g.sum()]), xb.T @ g + DECAY * w, xb.T @ (g[:, None] * sums) - (xb.T @ g)[:, None] * v + DECAY * v]
            step += 1
            for i, d in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * d
                s[i] = 0.99 * s[i] + 0.01 * d * d
                params[i] = params[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.99**step)) + 1e-8)
    b, w, v = params
    return Machine(places[chosen].astype(np.int64), float(b[0]) + odds(share) - odds(y.mean()), w, v)


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, by which rows are held out (null: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def terms_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.array(sorted(terms_of(t.as_py())), "<u4").tobytes() for t in batch.column(1)]
        yield pa.record_batch([batch.column(0), pa.array(found, pa.binary())], names=["toxic", "terms"])


def learn(docs: DataFrame, labels: DataFrame, held_out: int = HELD_OUT) -> Machine:
    """Fit the machine on labelled rows that are not held out."""
    ship(docs.sparkSession)
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (remainder(F.col("doc_id")) % 4 != held_out))
             .groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    n, pos = known.select(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).head()
    part = lambda label, most: known.where(F.col("toxic") == label).orderBy(F.xxhash64("id"), "id").limit(most)
    chosen = F.broadcast(part(1, TOXIC_ROWS).unionByName(part(0, OTHER_ROWS)))  # bounded by the two limits
    texts = (docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(chosen, "id")
             .groupBy("id", "toxic").agg(F.min("text").alias("text"))  # one text of rows that share an id
             .select("toxic", "text").mapInArrow(lean(terms_partition, AT_ONCE), "toxic int, terms binary"))
    got = texts.toArrow()
    rows = sorted(zip(got["toxic"].to_pylist(), got["terms"].to_pylist(), strict=True))
    del got
    samples = [np.frombuffer(t, "<u4") for _, t in rows]
    return fit(samples, np.array([y for y, _ in rows], float), min(max((pos + 0.1) / (n + 1), 1e-4), 1 - 1e-4))


def score_partition(machine: Machine, at: int) -> Callable:
    """Append the score of the text in column `at` to every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = machine.scorer()
        for batch in batches:
            scores = pa.array([score(t.as_py()) for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i != at], scores],
                                             names=[*[n for i, n in enumerate(batch.schema.names) if i != at], "score"])
    return lean(run, AT_ONCE)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Whole texts are scored, by their terms alone; a null or empty text scores as one without terms. Rows that repeat
    are scored each. Several labels of a doc_id count as toxic if one does; null ones not at all. Without labels of
    both classes the score is their smoothed share. An empty table gives no rows; other columns are ignored.
    """
    machine = learn(docs, labels, held_out)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id")) % 4 == held_out).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    return (rows.mapInArrow(score_partition(machine, 2), "doc_id long, held_out boolean, score double")
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def accept_partition(machine: Machine, at: int, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = machine.scorer()
        for batch in batches:
            yield batch.filter(pa.array([score(t.as_py()) < threshold for t in batch.column(at)], pa.bool_()))
    return lean(run, AT_ONCE)


def accepted_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not predicted toxic, with every column of the input, whatever its name.

    A null or empty text is judged as one without terms; rows that repeat, or have no doc_id, are judged each. Labels
    count as in score_toxicity(). An empty table gives no rows.
    """
    machine = learn(docs, labels)
    return docs.mapInArrow(accept_partition(machine, docs.columns.index("text"), threshold), docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
