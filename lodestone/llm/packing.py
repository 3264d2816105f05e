"""Packing token streams: concatenate, take two-pass prefix sums over partitions, cut fixed windows."""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import lean, ship, table
from lodestone.tables import durable

WINDOW, END_ID, TOKENIZER = 2048, 1, "byte_bpe_50k.json"
#: Rows that are encoded or cut at once: memory follows these, not the batches that Spark sends.
AT_ONCE = 256
#: White space as the byte-level pre-tokenizer sees it, and units that it never joins: a run of other characters with
#: the space before it, or a run of white space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNIT = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Units that a worker remembers, and the longest that it does.
REMEMBERED, LONGEST = 300_000, 48


def tokenizer(name: str):
    """A public tokenizer by file name or path; special strings in a text are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(name if os.path.isabs(name) else public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t


def companion(name: str):
    """The same vocabulary as ranks, where the file lies beside the tokenizer's: it encodes short units faster, to the
    same ids (merges in order of rank)."""
    import public_tokenizers
    import tiktoken

    path = (name if os.path.isabs(name) else public_tokenizers.path(name)).removesuffix(".json") + ".tiktoken"
    if not os.path.exists(path):
        return None
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Units(dict):
    """Ids of units as bytes; those of a unit that is not known yet are made when it is met."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, unit: str) -> bytes:
        out = self.encode(unit)
        if len(unit) <= LONGEST:
            self[unit] = out
        return out


class Encoder:
    """Ids of texts as bytes, unit by unit: a byte-level pre-tokenizer cuts at unit borders in any case, so the ids of
    a text are those of its units, and frequent units need the tokenizer once."""

    def __init__(self, name: str, end_id: int):
        self.t = tokenizer(name)
        self.kind = "<u2" if max(self.t.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        self.end = np.array([end_id], self.kind).tobytes()
        how = json.loads(self.t.to_str())
        pre = how["pre_tokenizer"] or {}
        t, kind, ranks = self.t, self.kind, companion(name)  # no way back from the units to the encoder: both go when a task ends
        ids_of = (lambda u: t.encode(u, add_special_tokens=False).ids) if ranks is None else ranks.encode_ordinary
        self.known = Units(lambda u: np.array(ids_of(u), kind).tobytes())
        self.by_unit = (how["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
                        and pre.get("use_regex", True) and all(x["special"] for x in how["added_tokens"]))

    def raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_unit:
            return [x + self.end for x in self.raw(texts)]
        out, ids_of = [], self.known.__getitem__
        for x in texts:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            out.append(b"".join(map(ids_of, UNIT.findall(x))) + self.end)
        return out


def encode_partition(name: str, end_id: int):
    """First pass: ids of each document with the end id, their number, and the place in the partition's stream."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pid, at = Encoder(name, end_id), TaskContext.get().partitionId(), 0
        width = np.dtype(encode.kind).itemsize
        for batch in batches:
            rows = encode([x or "" for x in batch.column(1).to_pylist()])
            n = np.array([len(x) // width for x in rows], np.int64)
            ends = at + np.cumsum(n)
            yield pa.record_batch([batch.column(0), pa.array(rows, pa.binary()), pa.array(n), pa.array(ends - n), pa.array([pid] * len(rows), pa.int32())],
                                  names=["doc_id", "ids", "doc_tokens", "at", "pid"])
            at += int(n.sum())
    return lean(run, AT_ONCE)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, boundary boolean"


def cut_partition(window: int):
    """Second pass: pieces of each document at multiples of the window in the whole stream."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, raw, n, at in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                wide = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes()
                a = 0
                while a < n:
                    sequence, offset = divmod(at + a, window)
                    b = min(n, a + window - offset)
                    out.append((doc_id, a, b - a, zlib.crc32(wide[4 * a:4 * b]), n, sequence, offset, a > 0 or b < n))
                    a = b
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.bool_() if i == 7 else pa.int64()) for i, c in enumerate(zip(*out, strict=True) if out else [[]] * 8)],
                names=[x.split()[0] for x in PIECES.split(", ")])
    return lean(run, AT_ONCE)


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, tokenizer_file: str = TOKENIZER) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, boundary.

    Documents stand one after the other, partition by partition; each is its ids and the end id, so a null or empty
    text is the end id alone. Partition totals, summed along the partitions, give every document its place in the
    whole stream, which is cut into windows; only the last is not full. boundary marks the pieces of documents that a
    cut goes through. The ids are kept by a checkpoint, so that places hold when a task runs again. Repeated rows and
    null doc_ids are packed like others; an empty table gives no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    encoded = durable(rows.mapInArrow(encode_partition(tokenizer_file, end_id),
                                      "doc_id long, ids binary, doc_tokens long, at long, pid int"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = (encoded.groupBy("pid").agg(F.sum("doc_tokens").alias("total"))
             .select("pid", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")))
    placed = encoded.join(F.broadcast(bases), "pid")  # a row per partition
    return placed.select("doc_id", "ids", "doc_tokens", F.col("at") + F.col("base")).mapInArrow(cut_partition(window), PIECES)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))
