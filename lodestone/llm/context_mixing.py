"""Language-model scores by online logistic mixing of bit predictors under hashed contexts."""

from __future__ import annotations

import heapq
import pickle
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import lean, release, ship, table, tidy
from lodestone.llm.near_dup import mixed
from lodestone.tables import bucketed, durable

#: Held out are rows whose crc32(doc_id as text) mod FOLDS is 0.
FOLDS = 10
#: Bytes of text in a block. A block asks for what the corpus knows about its own words and contexts only.
BLOCK = 8 << 20
#: Words before a token that make a hashed context, and how many of a context's successors count each by itself: all.
ORDERS = {1: None, 3: None}
#: Bits of a context's hash inside its range, of the hash of a successor without a code, and of a word's when its count
#: is asked for. The number of ranges follows the corpus, so the chance that two contexts of a range meet stays the same
#: at every size.
CONTEXT_BITS, WORD_BITS, COUNTED_BITS = 28, 20, 56
#: Bits of a successor: its place among the codes, those without one at the escape's by their hash.
SUCCESSOR_BITS = 21
#: Tokens in a range of contexts.
RANGE_TOKENS = 1 << 21
#: Most words that have a code of their own; all others are one escape, then told apart by their exact counts.
DICTIONARY = 1 << 16
#: Code weights are at least this part of all tokens, which bounds the length of a code to 30 bits.
LEAST_SHARE = 1 / (1 << 20)
#: What each count gives up, and the weight that a context leaves to the order below.
DISCOUNT, LEFT_OVER = 0.4, 0.6
#: Counts are told in such parts, and what each gives up is so many of them.
PARTS = 5
GIVEN_UP = round(DISCOUNT * PARTS)
#: Tokens after which weights and refinement start anew (long texts are scored in parallel lanes), tokens mixed at
#: once, and tokens whose inputs are made at once.
LANE, AT_ONCE, INPUTS = 256, 1 << 17, 1 << 14
#: Pairs of a context and a successor that a range answers at once, about; a context's own stay together.
SLICE = 1 << 17
#: Rates of the mixer and the refinement, cells of the refinement, and its part in the result.
RATE, REFINE_RATE, CELLS, REFINE_PART = 0.004, 0.02, 16, 0.25
LIMIT = 11.5
END = b" "


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == 0


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def pack(x) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(x, protocol=5))


def unpack(raw: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(raw))


def planes(x: np.ndarray, size: int) -> np.ndarray:
    """The lowest `size` bytes of whole numbers, first all lowest bytes, and so on, which compress far better."""
    return np.ascontiguousarray(x.astype("<u8").reshape(-1, 1).view(np.uint8)[:, :size].T)


def from_planes(x: np.ndarray) -> np.ndarray:
    out = np.zeros((x.shape[1], 8), np.uint8)
    out[:, :x.shape[0]] = x.T
    return out.view("<u8").reshape(-1)


def contexts(h: np.ndarray, place: np.ndarray, order: int) -> np.ndarray:
    """Hash of the `order` words before each token; before a text's first word stands the empty word."""
    out = np.full(len(h), order, np.uint64)
    for k in range(1, order + 1):
        before = np.concatenate([np.zeros(min(k, len(h)), np.uint64), h[:-k]])
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + np.where(place >= k, before, np.uint64(1)))
    return out


def places(lengths: np.ndarray) -> np.ndarray:
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def ranked(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and the rank of every element; values are below 2^width.

    Where a value and its place fit into 64 bits, one plain sort tells both, much faster than sorting places.
    """
    low = np.uint64(max(1, len(x).bit_length()))
    if width + int(low) > 64:
        return np.unique(x, return_inverse=True)
    both = x.astype(np.uint64) << low
    both |= np.arange(len(x), dtype=np.uint64)
    both.sort()
    new = np.ones(len(x), bool)
    new[1:] = both[1:] >> low != both[:-1] >> low
    value = both[new] >> low
    both &= (np.uint64(1) << low) - np.uint64(1)
    rank = np.empty(len(x), np.int64)
    rank[both.view(np.int64)] = np.cumsum(new) - 1
    return value, rank


# first pass: texts become numbers of the words of their block

BLOCKS = "block long, tokens long, payload binary"


def block_partition() -> Callable:
    """Cut a partition into blocks; of each its documents as numbers of its words. And, once per partition (block
    below 0), how often each byte follows each in training words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, n_block, size = TaskContext.get().partitionId(), 0, 0
        docs: list[tuple] = []
        letters = np.zeros(1 << 16, np.int64)

        def block() -> pa.RecordBatch:
            spelled, number, lengths = numbered([raw for _, raw in docs])
            train = np.array([not held_out(i) for i, _ in docs])
            seen = np.bincount(number, weights=np.repeat(train, lengths), minlength=len(spelled))
            joined = np.frombuffer(b"".join(b" " + w + b" " for w in spelled), np.uint8).astype(np.int64)
            sizes = np.array([len(w) + 2 for w in spelled])
            within = np.arange(len(joined) - 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)[:-1] < np.repeat(sizes, sizes)[:-1] - 1
            pairs = (joined[:-1] << 8 | joined[1:])[within]
            nonlocal letters
            letters += np.bincount(pairs, weights=np.repeat(seen, sizes)[:-1][within] > 0, minlength=1 << 16).astype(np.int64)
            by_count = np.argsort(-np.bincount(number, minlength=len(spelled)), kind="stable")  # frequent words get small numbers
            new = np.empty(len(spelled), np.int64)
            new[by_count] = np.arange(len(spelled))
            payload = ([i for i, _ in docs], lengths, train, planes(new[number], 3), b"\n".join(spelled[i] for i in by_count))
            return batch_of([((pid << 24) | n_block, len(number), pack(payload))], BLOCKS)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                raw = text.as_py() or b""
                docs.append((doc_id, raw))
                size += len(raw) + 8
                if size >= BLOCK:
                    yield block()
                    docs, size, n_block = [], 0, n_block + 1
        if docs:
            yield block()
        if letters.any():
            yield batch_of([(-1 - pid, 0, pack(letters))], BLOCKS)
    return run


#: Bytes in lower case, and which of them part words.
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def numbered(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct tokens of texts, the number of each token, and the tokens of each text: its words, then one end."""
    raw = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    blank = BLANK[raw]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    sizes = np.flatnonzero(~blank[:-1] & blank[1:]) + 1 - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(LOWER[raw[~blank]])]).dictionary_encode()
    ends = np.cumsum([len(t) + 1 for t in texts])
    lengths = np.diff(np.searchsorted(starts, ends, side="right"), prepend=0) + 1
    spelled = [*words.dictionary.to_pylist(), END]
    number = np.full(int(lengths.sum()), len(spelled) - 1)
    is_word = np.ones(len(number), bool)
    is_word[np.cumsum(lengths) - 1] = False
    number[is_word] = words.indices.to_numpy()
    return spelled, number, lengths


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def add_letters(part: pa.Table) -> pa.Table:
    total = sum(unpack(x) for x in part["payload"].to_pylist())
    return pa.Table.from_batches([batch_of([(part["block"][0].as_py(), 0, pack(total))], BLOCKS)])


# second pass: a block asks for its words and contexts; each range of hashes answers every block

ASKED = "key long, block long, payload binary"


def opened(raw: bytes) -> tuple:
    """A block: doc ids, lengths, training marks, number of each token's word, the words and their hashes."""
    ids, lengths, train, number, spelled = unpack(raw)
    words = spelled.split(b"\n")
    return ids, lengths, train, from_planes(number).astype(np.int64), words, hashes(words)


def asking_words(bits: int) -> Callable:
    """Of every block, by range of the hash (key): its words with their training counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                _, lengths, train, number, _, word_hash = opened(raw.as_py())
                order = np.argsort(word_hash)
                counts = np.bincount(number, weights=np.repeat(train, lengths), minlength=len(word_hash)).astype(np.int64)[order]
                h = word_hash[order] >> np.uint64(64 - COUNTED_BITS)
                low = np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(COUNTED_BITS - bits)
                cuts = np.searchsorted(h, low)
                yield batch_of([(r, block, pack((small(np.diff(h[a:b], prepend=low[r])), small(counts[a:b])))) for r, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a], ASKED)
    return run


def width_for(most: int) -> type:
    """Whole numbers up to `most` take half the memory where they can."""
    return np.int32 if most < 1 << 31 else np.int64


def pairs_of(bits: int, order: int, learned: np.ndarray, number: np.ndarray, h: np.ndarray, place: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, ...]:
    """A block's contexts, ascending, and whether a held-out document asks for them; its distinct pairs of a context and
    its successor, in the order of the codes: the context's place and the word's number; and the pair of every token."""
    c, inverse = ranked(contexts(h, place, order) >> np.uint64(64 - bits - CONTEXT_BITS), bits + CONTEXT_BITS)
    held = np.zeros(len(c), bool)
    held[inverse[~learned]] = True
    wide, by_code = len(successor).bit_length(), np.argsort(successor, kind="stable")
    rank = np.empty(len(successor), np.int64)
    rank[by_code] = np.arange(len(successor))
    pairs, pair = ranked(inverse << wide | rank[number], len(c).bit_length() + wide)
    pairs = pairs.astype(np.int64)
    narrow = width_for(len(number))
    return c, held, (pairs >> wide).astype(narrow), by_code.astype(narrow)[pairs & ((1 << wide) - 1)], pair.astype(narrow)


def asking_contexts(shared, bits: int) -> Callable:
    """Of every block, by order and range of the hash (key): its contexts with their successors, and how often these
    stand in training texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shared.value
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                _, lengths, train, number, _, word_hash = opened(raw.as_py())
                learned, h, place = np.repeat(train, lengths), word_hash[number], places(lengths)
                successor = code.successors(word_hash)
                for k in ORDERS:
                    c, held, owner, word, pair = pairs_of(bits, k, learned, number, h, place, successor)
                    n = np.bincount(pair[learned], minlength=len(owner))
                    of = np.bincount(owner, minlength=len(c))
                    starts = np.concatenate([[0], np.cumsum(of)])
                    after = successor[word]
                    after[1:] -= np.where(owner[1:] == owner[:-1], after[:-1], 0)  # steps inside a context, which are small
                    cuts = [0, *np.searchsorted(c, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(CONTEXT_BITS)), len(c)]
                    out = []
                    for r, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        if b > a:
                            x, y = starts[a], starts[b]
                            out.append(((k << 40) | r, block, pack((small(np.diff(c[a:b], prepend=np.uint64(r << CONTEXT_BITS))), small(of[a:b] * 2 + held[a:b]),
                                                                   planes(after[x:y], 3), small(n[x:y])))))
                    yield batch_of(out, ASKED)
    return run


def small(x: np.ndarray) -> np.ndarray:
    """Whole numbers as byte planes, as few as hold them."""
    return planes(x, max(1, (int(x.max() if len(x) else 0).bit_length() + 7) // 8))


def answer_words(floor: int, bits: int) -> Callable:
    """The counts of one range of words, told to every block that asked; and under block -1 the range's tokens, distinct
    words, words seen once, and the words seen `floor` times or more."""
    def run(part: pa.Table) -> pa.Table:
        key, blocks = part["key"][0].as_py(), part["block"].to_pylist()
        low = np.uint64(key << (COUNTED_BITS - bits))
        got = [(np.cumsum(from_planes(h)) + low, from_planes(c)) for h, c in map(unpack, part["payload"].to_pylist())]
        tokens, at = np.unique(np.concatenate([h for h, _ in got]), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([c for _, c in got]), minlength=len(tokens)).astype(np.int64)
        ends = np.cumsum([len(h) for h, _ in got])
        out = [(key, b, pack(small(counts[at[e - len(h):e]]))) for b, e, (h, _) in zip(blocks, ends, got, strict=True)]
        often = counts >= floor
        out.append((key, -1, pack((int(counts.sum()), int((counts > 0).sum()), int((counts == 1).sum()), tokens[often], counts[often]))))
        return pa.Table.from_batches([batch_of(out, ASKED)])
    return run


def answer_contexts(shared) -> Callable:
    def run(part: pa.Table) -> pa.Table:
        answers = told([unpack(x) for x in part["payload"].to_pylist()], shared.value)
        return pa.Table.from_batches([batch_of([(part["key"][0].as_py(), b, x) for b, x in zip(part["block"].to_pylist(), answers, strict=True)], ASKED)])
    return run


def told(asked: list[tuple], code: Code) -> list[bytes]:
    """For every block, in its order: how often each context was seen in all training texts; of each pair with a
    successor how often that was seen, and whether other successors share its way down the code; for those, step by step,
    the mass of all successors that leave the way there (last, for the escape, of those that share its leaf). What the
    pair before in the same context tells is left out: their common steps, and the step where their ways part.

    So every successor counts, however many a context has, and a block is told no more than the ways of its own words. A
    successor seen once counts by itself only where a held-out document asks: to a training document it would mostly be
    its own.

    The range is answered slice by slice of its contexts, so no more than about SLICE pairs are worked on at once."""
    blocks = np.arange(len(asked), dtype=np.uint64)[:, None] << np.uint64(CONTEXT_BITS)
    ctx = np.concatenate([np.cumsum(from_planes(x[0])) + b for x, b in zip(asked, blocks, strict=True)])  # ascending over all blocks
    of = np.concatenate([from_planes(x[1]) for x in asked]).astype(np.int64)
    held, of = of & 1, of >> 1
    starts = np.concatenate([[0], np.cumsum(of)])
    after = np.cumsum(np.concatenate([from_planes(x[2]) for x in asked]).astype(np.int64))
    after -= np.repeat(np.append(0, after)[starts[:-1]], of)
    n = np.concatenate([from_planes(x[3]).astype(np.int32) for x in asked])
    slices = max(1, len(n) // SLICE)
    bounds = (np.arange(slices + 1, dtype=np.uint64) << np.uint64(CONTEXT_BITS)) // np.uint64(slices)
    cuts = np.searchsorted(ctx, (blocks + bounds).reshape(-1)).reshape(len(asked), -1)
    total, seen, begin, size = np.empty(len(ctx), np.int64), np.empty(len(n), np.int64), np.zeros(len(n), np.int8), np.zeros(len(n), np.int8)
    parts = []
    for s in range(slices):
        at, pick = spans(cuts[:, s], cuts[:, s + 1]), spans(starts[cuts[:, s]], starts[cuts[:, s + 1]])
        if len(at):
            total[at], seen[pick], ways, begin[pick[ways]], size[pick[ways]], masses = told_slice(
                code, ctx[at] & np.uint64((1 << CONTEXT_BITS) - 1), held[at], of[at], after[pick], n[pick])
            parts.append((pick[ways].astype(width_for(len(n))), masses))
    first = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    flat = np.empty(first[-1], np.result_type(np.int32, *(m for _, m in parts)))
    while parts:
        ways, masses = parts.pop()
        flat[spans(first[ways], first[ways + 1])] = masses
    out = []
    for a, b in zip(cuts[:, 0], cuts[:, -1], strict=True):
        x, y = starts[a], starts[b]
        kind = np.repeat(digits(total[a:b]), of[a:b])
        way = np.flatnonzero(size[x:y])
        out.append(pack((small(total[a:b]), small(seen[x:y][np.argsort(kind, kind="stable")]),
                         small(flat[first[x]:first[y]][alike(kind[way], begin[x:y][way], size[x:y][way])]))))
    return out


def told_slice(code: Code, ctx: np.ndarray, held: np.ndarray, of: np.ndarray, successor: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """What is told about contexts that blocks ask for, block by block: how often each was seen; for each pair how often
    (and whether its way is shared); which pairs' masses are told, from which step, how many, and these."""
    known, at = ranked(ctx, CONTEXT_BITS)
    key = np.repeat(at, of) << SUCCESSOR_BITS | successor
    pairs, which = ranked(key, len(known).bit_length() + SUCCESSOR_BITS)
    pairs = pairs.astype(np.int64)
    n = np.bincount(which, weights=count, minlength=len(pairs)).astype(np.int64)
    owner = pairs >> SUCCESSOR_BITS
    total = np.bincount(owner, weights=n, minlength=len(known)).astype(np.int64)
    mass = np.where(n > 0, n * PARTS - GIVEN_UP, 0)
    mass = np.stack([np.where(n > 1, mass, 0), mass])  # of successors seen twice or more, and of all
    of_context = np.stack([np.bincount(owner, weights=m, minlength=len(known)) for m in mass]).astype(np.int64)
    several = np.flatnonzero((np.bincount(owner, minlength=len(known)) > 1)[owner])  # pairs of contexts with several successors
    leave, word, starts = leaving(code, owner[several], pairs[several] & ((1 << SUCCESSOR_BITS) - 1), mass[:, several])
    asks = np.repeat(held, of)
    shared_way = of_context[asks, owner[which]] > mass[asks, which]
    place = np.empty(len(pairs), np.int64)
    place[several] = np.arange(len(several))
    some = np.flatnonzero(shared_way)
    mine = place[which[some]]
    begin, size = untold(code, np.repeat(np.arange(len(of)), of)[some], word[mine])
    masses = leave.reshape(-1)[np.repeat(starts[mine] + begin + asks[some] * leave.shape[1], size) + places(size)]
    return total[at], n[which] * 2 + shared_way, some, begin, size, masses


def spans(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All places from each a up to its b, one span after the other."""
    return np.repeat(a, b - a) + places(b - a)


def digits(x: np.ndarray) -> np.ndarray:
    """Binary digits of whole numbers."""
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def alike(kind: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The order in which masses are told: by the digits of their context's count, then by step, as alike ones compress
    better side by side."""
    return np.argsort(np.repeat(kind.astype(np.uint16) << 5 | begin.astype(np.uint16), size) + places(size.astype(np.int64)).astype(np.uint16), kind="stable")


def untold(code: Code, owner: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From which step on a pair's masses are told, as the pair before tells the others; and how many these are."""
    begin, size = np.zeros(len(word), np.int32), np.empty(len(word), np.int32)
    for x in range(0, len(word), INPUTS):
        now = word[x:x + INPUTS]
        size[x:x + INPUTS] = code.length[now] + (now == code.escape)
        x = max(x, 1)
        now, before = word[x:x + INPUTS], word[x - 1:x + INPUTS - 1][:len(word) - x]
        same = owner[x:x + INPUTS] == owner[x - 1:x + INPUTS - 1][:len(word) - x]
        begin[x:x + INPUTS] = np.where(same, np.minimum(agreed(code.code[now], code.code[before]), code.length[now]), -1) + 1
    return begin, size - begin


def pieces(new: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts into pieces of about INPUTS elements, which begin where `new` says so."""
    bounds = np.append(np.flatnonzero(new), len(new))
    a = 0
    while a < len(bounds) - 1:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + INPUTS, side="right")) - 1)
        yield int(bounds[a]), int(bounds[b])
        a = b


def leaving(code: Code, owner: np.ndarray, successor: np.ndarray, masses: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of a context and a successor, ascending: the mass of the context's successors that leave the way of this
    one at each step, a row for each kind of mass; the pairs' rows in the code, and where their steps start."""
    words = code.by_leaf[code.leaf(successor)]
    entries = code.length[words] + (words == code.escape)
    first = np.cumsum(entries) - entries
    out = np.zeros((len(masses), int(entries.sum())), np.int32 if masses.sum(axis=1).max(initial=0) < 1 << 31 else np.int64)
    fresh = np.append(True, owner[1:] != owner[:-1])[:len(owner)]
    for x, y in pieces(fresh):
        mass, word, starts = masses[:, x:y], words[x:y], first[x:y]
        steps, bits = code.length[word], code.code[word]
        same = np.concatenate([[-1], np.where(fresh[x + 1:y], -1, agreed(bits[1:], bits[:-1]))])  # steps in common with the one before
        here = np.arange(y - x)  # the pairs whose way goes on
        before = np.add.reduceat(mass, np.flatnonzero(same < 0), axis=1)[:, np.cumsum(same < 0) - 1]
        for j in range(1, int(steps.max()) + 1):
            new = same < j
            now = np.add.reduceat(mass, np.flatnonzero(new), axis=1)[:, np.cumsum(new) - 1]
            here = here[steps[here] >= j]
            out[:, starts[here] + j - 1] = (before - now)[:, here]
            before = now
        last = np.flatnonzero(word == code.escape)
        if len(last):
            new = same < 32
            out[:, starts[last] + steps[last]] = (np.add.reduceat(mass, np.flatnonzero(new), axis=1)[:, np.cumsum(new) - 1] - mass)[:, last]
    return out, words, first


# the code of the words

@dataclass
class Code:
    """A Huffman code of the dictionary's words; the one before the last is the escape. For every word its code (left
    in 32 bits), its length, and, by steps down the code, the chance of the subtree it is in; `by_word` finds words by hash."""

    hash: np.ndarray
    code: np.ndarray
    length: np.ndarray
    subtree: np.ndarray
    n: int
    types: int
    rest: int
    once: int
    letters: np.ndarray

    def __post_init__(self):
        on, beside = self.subtree[1:], self.subtree[:-1] - self.subtree[1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            stretch = np.clip(np.log(on / beside), -LIMIT, LIMIT)
        # word by word, step by step: the chance on the way, beside it, and the dictionary's input
        self.depth = len(on)
        self.on, self.beside, self.stretch = (np.ascontiguousarray(x.T).astype(np.float32).reshape(-1) for x in (on, beside, stretch))
        self.by_leaf = np.argsort(self.code)
        self.leaf_of = np.empty(len(self.code), np.int64)
        self.leaf_of[self.by_leaf] = np.arange(len(self.code))

    @property
    def escape(self) -> int:
        return len(self.hash)

    def by_word(self, h: np.ndarray) -> np.ndarray:
        """Rows of words by their hash; the escape for others."""
        h = h >> np.uint64(64 - COUNTED_BITS)
        at = np.searchsorted(self.hash, h)
        return np.where(np.append(self.hash, np.uint64(0))[at] == h, at, self.escape) if len(self.hash) else np.full(len(h), self.escape)

    def successors(self, h: np.ndarray) -> np.ndarray:
        """Words by their hash as numbers in the order of the codes; at the escape by the upper bits of the hash."""
        row, free = self.by_word(h), self.leaf_of[self.escape]
        leaf = self.leaf_of[row]
        return np.where(row == self.escape, free + (h >> np.uint64(64 - WORD_BITS)).astype(np.int64), leaf + (leaf > free) * (1 << WORD_BITS))

    def leaf(self, successor: np.ndarray) -> np.ndarray:
        """Places among the codes of such numbers."""
        free = self.leaf_of[self.escape]
        return np.where(successor < free, successor, np.maximum(successor - (1 << WORD_BITS), free))


def huffman(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (left in 32 bits) and lengths."""
    heap: list[tuple[int, int]] = [(int(w), i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    parent = np.zeros(2 * len(weights), np.int64)
    side = np.zeros(2 * len(weights), np.uint64)
    node = len(weights)
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x], parent[y], side[y] = node, node, 1
        heapq.heappush(heap, (a + b, node))
        node += 1
    code, length = np.zeros(node, np.uint64), np.zeros(node, np.int64)
    for i in range(node - 2, -1, -1):
        p = parent[i]
        length[i] = length[p] + 1
        code[i] = code[p] | (side[i] << np.uint64(32 - length[i]))
    return code[:len(weights)], length[:len(weights)]


def make_code(word_hash: np.ndarray, counts: np.ndarray, n: int, types: int, once: int, letters: np.ndarray) -> Code:
    order = np.argsort(word_hash)
    word_hash, counts = word_hash[order], counts[order]
    rest = max(0, n - int(counts.sum()))
    weights = np.maximum(np.concatenate([counts, [rest + 1, 1]]), np.ceil(n * LEAST_SHARE)).astype(np.int64)
    code, length = huffman(weights)
    by_code = np.argsort(code)
    sums = np.concatenate([[0], np.cumsum(weights[by_code])])
    subtree = np.zeros((int(length.max()) + 1, len(weights)))
    for j in range(len(subtree)):
        low = code >> np.uint64(32 - j) << np.uint64(32 - j)
        a, b = np.searchsorted(code[by_code], low), np.searchsorted(code[by_code], low + np.uint64(1 << (32 - j)))
        subtree[j] = (sums[b] - sums[a]) / sums[-1]
    return Code(word_hash, code, length, subtree, n, types, rest, once, letters)


# third pass: scoring

def agreed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Steps at the start that two codes have in common; 32 for equal ones."""
    return 32 - np.frexp((a ^ b).view(np.int64).astype(np.float64))[1]


def spelled_chance(code: Code, words: list[bytes]) -> np.ndarray:
    """Log10 of the chance to spell words that no training text holds, letter by letter after the letter before."""
    if not words:
        return np.empty(0)
    follows = code.letters.reshape(256, 256).astype(np.float64) + 0.01
    logs = np.append(np.log10(follows / follows.sum(axis=1, keepdims=True)).reshape(-1), 0.0)
    x = np.frombuffer(b" " + b" \n ".join(words) + b" \n", np.uint8).astype(np.int64)  # each word between spaces
    pairs = x[:-1] << 8 | x[1:]
    pairs[(x[:-1] == 10) | (x[1:] == 10)] = 1 << 16
    ends = np.flatnonzero(x == 10)
    return np.add.reduceat(logs[pairs], np.concatenate([[0], ends[:-1] + 1]))


def own_counts(doc: np.ndarray, what: np.ndarray) -> np.ndarray:
    """How often the document of each token holds the same value."""
    key = mixed(what.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + doc.astype(np.uint64))
    _, at = ranked(key >> np.uint64(22), 42)
    return np.bincount(at)[at] if len(at) else at


def seen_before(doc: np.ndarray, h: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The token after the last place before in the same document where the same two words stood; -1 if none."""
    key = mixed(contexts(h, place, 2) + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    low = np.uint64(max(1, len(key).bit_length()))  # the upper bits of the key, then the place: one sort tells both
    both = np.sort(key >> low << low | np.arange(len(key), dtype=np.uint64))
    order = (both & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    same = np.flatnonzero(both[1:] >> low == both[:-1] >> low)
    out = np.full(len(key), -1)
    out[order[same + 1]] = order[same]
    return out


class Known:
    """What the corpus told about the contexts of one order of a block: for each pair of a context and its successor the
    masses down the successor's way in the code (in PARTS), and per token what is taken off them and the weight left to
    the dictionary's own chances. A training document's own sights of a word after its context are taken off, so that it
    is predicted by the other documents."""

    def __init__(self, code: Code, answers: list, asked: tuple, row_of: np.ndarray, doc: np.ndarray, learned: np.ndarray):
        held, owner, word, self.pair = asked
        kind = width_for(PARTS * max(int(from_planes(x[0]).max(initial=0)) for x in answers))
        total = np.concatenate([from_planes(x[0]).astype(kind) for x in answers])
        alike_, ends = digits(total)[owner], np.cumsum([0, *(x[1].shape[1] for x in answers)])
        seen = np.empty(len(owner), kind)
        for a, b, x in zip(ends, ends[1:], answers, strict=False):
            seen[a:b][np.argsort(alike_[a:b], kind="stable")] = from_planes(x[1])
        n, shared = seen >> 1, (seen & 1) == 1
        row = row_of[word].astype(np.int32)
        del seen
        self.mass = np.where((n > 1) | ((n > 0) & held[owner]), n * PARTS - GIVEN_UP, 0)  # of the successor itself
        live = np.flatnonzero(shared | (self.mass > 0))
        entries = (code.length[row] + (row == code.escape))[live]
        self.start = np.full(len(n), -1, width_for(int(entries.sum())))
        self.start[live] = np.cumsum(entries) - entries
        self.leave = np.zeros(int(entries.sum()), kind)
        self.on = np.repeat(self.mass[live], entries)  # what stays on the way after each step
        del live, entries
        top = self.mass.copy()
        ways = np.flatnonzero(shared)
        begin, size = untold(code, owner[ways], row[ways])
        told_at = np.cumsum(size, dtype=width_for(int(size.sum()))) - size - begin
        leave, cuts = np.empty(int(size.sum()), kind), np.searchsorted(ways, ends)
        for a, b, x in zip(cuts, cuts[1:], answers, strict=False):
            if b > a:
                leave[told_at[a] + begin[a]:told_at[b - 1] + begin[b - 1] + size[b - 1]][alike(alike_[ways[a:b]], begin[a:b], size[a:b])] = from_planes(x[2])
        answers.clear()
        for x, y in pieces(begin == 0):
            top[ways[x:y]] = self.fill(code, row[ways[x:y]], self.mass[ways[x:y]], self.start[ways[x:y]], begin[x:y], told_at[x:y], leave)
        del leave, told_at, begin, size, ways, row, shared, alike_
        some = np.flatnonzero((top[self.pair] > 0) & learned)
        off = own_counts(doc[some], self.pair[some])
        of = self.pair[some]
        left = n[of] - off
        self.off = np.zeros(len(self.pair), kind)
        self.off[some] = np.where(self.mass[of] > 0, self.mass[of] - np.where(left > 0, left * PARTS - GIVEN_UP, 0), 0)
        self.named = top[self.pair] - self.off
        rest = total[owner][self.pair].astype(np.float64)
        rest[some] -= off
        self.left = (np.maximum(rest - self.named / PARTS, 0) + LEFT_OVER).astype(np.float32)

    def fill(self, code: Code, row: np.ndarray, mass: np.ndarray, start: np.ndarray, begin: np.ndarray, told_at: np.ndarray, leave: np.ndarray) -> np.ndarray:
        """Masses down the ways of some pairs, from the last step to the first; what is not told is known from the pair
        before. The masses of their contexts."""
        steps, every = code.length[row], np.arange(len(row))
        now = mass.copy()  # what is on the way before the step that was filled last
        free = np.flatnonzero(row == code.escape)
        alone = begin[free] <= steps[free]
        now[free[alone]] += leave[told_at[free[alone]] + steps[free[alone]]]
        now[free] = now[free[np.maximum.accumulate(np.where(alone, np.arange(len(free)), 0))]] if len(free) else 0
        for j in range(int(steps.max()) - 1, -1, -1):
            goes = steps > j
            here, parting = np.flatnonzero(goes & (begin <= j)), np.flatnonzero(goes & (begin == j + 1))
            given = np.zeros(len(row), np.int64)
            given[here] = leave[told_at[here] + j]
            given[parting] = now[parting - 1]
            source = np.zeros(len(row), np.int64)
            source[here], source[parting] = here, parting
            off = given[np.maximum.accumulate(source)]
            goes = every[goes]
            at, off = start[goes] + j, off[goes]
            self.on[at], self.leave[at] = now[goes], off
            now[goes] += off
        return now


def first_weights(gate: np.ndarray) -> np.ndarray:
    """Weights to start from, of order 1, order 3 and the document's own past: what knows more about a context gets more.
    A predictor that knows nothing speaks for the dictionary."""
    one, three, own = gate % 3, gate // 3 % 3, gate // 9
    w = np.zeros((len(gate), 3), np.float32)
    w[:, 1] = np.choose(three, [0, 0.55, 0.75])
    w[:, 2] = np.where(own > 0, 0.3, 0)
    w[:, 0] = np.maximum(np.choose(one, [1, 0.6, 0.85]) * (1 - w[:, 1]), 0.1)
    return w


GATES = 18


def mix_lanes(x: np.ndarray, gate: np.ndarray, steps: np.ndarray, lane: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    """Log10 of the chance of every token: online mixing, lane by lane side by side.

    x: inputs of all decisions, a row per predictor, towards the bit that stands (the array is used up); gate and steps
    (number of decisions) per token; tokens in rounds, a round holds the next token of every lane that is not at its
    end. The weights of a token's gate move after its bits, as does the refinement: a table by confidence that learns
    how often the likelier bit comes.
    """
    lanes = int(lane.max()) + 1
    weights = np.tile(first_weights(np.arange(GATES)).T, (1, lanes))
    refine = np.tile(1 / (1 + np.exp(-(np.arange(CELLS) + 0.5) * (12 / CELLS))), lanes).astype(np.float32)
    moves = (1 - (1 - REFINE_RATE) ** np.arange(int(steps.max()) + 1)).astype(np.float32)
    cell_of, place_of = (lane * CELLS).astype(np.int32), lane * GATES + gate
    bounds = np.concatenate([[0], np.cumsum(steps)])
    out = np.empty(len(gate))
    one, part = np.float32(1), np.float32(REFINE_PART)
    for a, b in zip(rounds, rounds[1:], strict=False):
        d0, d1 = bounds[a], bounds[b]
        now, k, at = x[:, d0:d1], steps[a:b], place_of[a:b]
        starts = bounds[a:b] - d0
        w = weights[:, at]
        st = np.repeat(w[0], k) * now[0]
        for i in range(1, len(now)):
            st += np.repeat(w[i], k) * now[i]
        np.maximum(np.minimum(st, LIMIT, out=st), -LIMIT, out=st)
        p = one / (one + np.exp(-st))
        right = st > 0
        cell = np.repeat(cell_of[a:b], k) + (np.abs(st) * np.float32(CELLS / 12)).astype(np.int32)
        t = refine[cell]
        q = p + part * (np.where(right, t, one - t) - p)
        out[a:b] = np.add.reduceat(np.log(q), starts)
        error = np.float32(RATE) * (one - p)
        for i in range(len(now)):
            w[i] += np.add.reduceat(now[i] * error, starts)
        weights[:, at] = w
        used = (int(lane[b - 1]) + 1) * CELLS  # lanes end from the last to the first
        n = np.bincount(cell, minlength=used)
        share = np.bincount(cell, weights=right, minlength=used) / np.maximum(n, 1)
        refine[:used] += moves[n] * (share - refine[:used])
    return out / np.log(10)


def score_tokens(code: Code, lengths: np.ndarray, train: np.ndarray, number: np.ndarray, words: list[bytes], word_hash: np.ndarray,
                 counts: np.ndarray, answers: dict[int, list], asked: dict[int, tuple]) -> np.ndarray:
    """Log10 of the chance of every token of a block."""
    h, place = word_hash[number], places(lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    learned = np.repeat(train, lengths)
    row_of = code.by_word(word_hash)
    names = (word_hash >> np.uint64(64 - WORD_BITS)).astype(np.int32)[number]
    known = {}
    for k in ORDERS:
        known[k] = Known(code, answers.pop(k), asked.pop(k), row_of, doc, learned)
        release()
    copy = seen_before(doc, h, place).astype(width_for(len(h)))
    # the lanes: documents, long ones in pieces, longest first
    lane_of = np.flatnonzero(place % LANE == 0)
    size = np.diff(np.append(lane_of, len(h)))
    order = np.argsort(-size, kind="stable")
    del h, place
    rest_base = rest_chances(code, doc, learned, number, words, row_of, counts)
    del doc, learned
    out, row = np.empty(len(number)), row_of[number]
    release()
    a = 0
    while a < len(order):
        b = a + max(1, int(np.searchsorted(np.cumsum(size[order[a:]]), AT_ONCE)))
        some = order[a:b]
        lane = np.repeat(np.arange(len(some)), size[some])
        t = places(size[some])
        by_round = np.lexsort((lane, t))
        tokens = (np.repeat(lane_of[some], size[some]) + t)[by_round]
        rounds = np.concatenate([[0], np.cumsum(np.bincount(t))])
        out[tokens] = score_some(code, row, known, copy, names, rest_base, tokens, lane[by_round], rounds)
        a = b
    return out


def rest_chances(code: Code, doc: np.ndarray, learned: np.ndarray, number: np.ndarray, words: list[bytes], row_of: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Chance of each token's word among those without a code: by its count (without its own document's), else spelled."""
    out = np.ones(len(number))
    at = np.flatnonzero(row_of[number] == code.escape)
    own = own_counts(doc[at], number[at])
    left = counts[number[at]] - np.where(learned[at], own, 0)
    new = (code.once + 1) / (code.rest + 2)
    spelled = np.zeros(len(words))
    need = np.unique(number[at[left <= 0]])
    spelled[need] = spelled_chance(code, [words[i] for i in need])
    out[at] = np.where(left > 0, (1 - new) * left / (code.rest + 1), new * 10.0 ** np.maximum(spelled[number[at]], -300))
    return out


def score_some(code: Code, row: np.ndarray, known: dict[int, Known], copy: np.ndarray, names: np.ndarray, rest_base: np.ndarray,
               tokens: np.ndarray, lane: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    """Log10 of the chance of some tokens, in rounds of lanes: the predictors' inputs first, then the mixing."""
    steps = code.length[row[tokens]]
    ends = np.concatenate([[0], np.cumsum(steps)])
    x, gate, rest = np.empty((3, ends[-1]), np.float32), np.empty(len(tokens), np.int64), np.empty(len(tokens))
    for a in range(0, len(tokens), INPUTS):
        b = min(len(tokens), a + INPUTS)
        gate[a:b], rest[a:b] = inputs(code, row, known, copy, names, rest_base, tokens[a:b], x[:, ends[a]:ends[b]])
    return mix_lanes(x, gate, steps, lane, rounds) + rest


def inputs(code: Code, row: np.ndarray, known: dict[int, Known], copy: np.ndarray, names: np.ndarray, rest_base: np.ndarray,
           tokens: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fill in the predictors' inputs of all decisions of some tokens; their gates, and log10 of the chance of what the
    code does not tell."""
    own = row[tokens]
    steps = code.length[own]
    begin = np.cumsum(steps) - steps
    step = places(steps)
    cell = np.repeat(own * code.depth, steps) + step
    x[0] = code.stretch[cell]
    x[1:] = x[0]
    escaped = own == code.escape
    rest = rest_base[tokens]
    shares, parts = np.where(escaped, rest, 0.0), np.ones(len(tokens))
    back_share = np.float32(code.subtree[code.length[code.escape], code.escape])

    def fill(column: int, d: np.ndarray, on: np.ndarray, beside: np.ndarray, left: np.ndarray) -> None:
        """A predictor's inputs of some decisions, from the masses on the way and beside it and the dictionary's share."""
        c = cell[d]
        on += left * code.on[c]
        beside += left * code.beside[c]
        odds = np.log(on / np.maximum(beside, np.float32(1e-9)))
        x[column, d] = np.maximum(np.minimum(odds, LIMIT), -LIMIT)

    def share(at: np.ndarray, total: np.ndarray, found: np.ndarray, left: np.ndarray) -> None:
        """Among the words without a code: the named ones, then all."""
        back = left * back_share
        shares[at] += (found + back * rest[at]) / (total + back)
        parts[at] += 1

    states = []
    for column, (k, of) in enumerate(known.items()):
        named = of.named[tokens]
        states.append((named > 0) + (named >= (1 if k > 1 else 3) * PARTS).astype(np.int64))
        some = np.flatnonzero(named > 0)  # differs from the dictionary's own only where something is known
        token, size = tokens[some], steps[some]
        start, off, left = of.start[of.pair[token]], of.off[token], of.left[token]
        one = places(size)
        at = np.repeat(start, size) + one
        on = (of.on[at] - np.repeat(off.astype(of.on.dtype), size)).astype(np.float32) * np.float32(1 / PARTS)
        fill(column, np.repeat(begin[some], size) + one, on, of.leave[at].astype(np.float32) * np.float32(1 / PARTS), np.repeat(left, size))
        e = np.flatnonzero(escaped[some])
        total = of.on[start[e] + size[e] - 1] - off[e]
        e, total = e[total > 0], total[total > 0]
        share(some[e], total / PARTS, (of.mass[of.pair[token[e]]] - off[e]) / PARTS, left[e])
    some = np.flatnonzero(copy[tokens] >= 0)
    again, size = copy[tokens[some]], steps[some]
    one = places(size)
    same = np.repeat(np.minimum(agreed(code.code[row[again]], code.code[own[some]]), size), size)
    fill(2, np.repeat(begin[some], size) + one, (one < same).astype(np.float32), (one == same).astype(np.float32), np.float32(0.5))
    e = np.flatnonzero(escaped[some] & (row[again] == code.escape))
    share(some[e], np.ones(len(e)), (names[again[e]] == names[tokens[some[e]]]).astype(np.float64), np.float32(0.5))
    gate = states[0] + 3 * states[1] + 9 * (copy[tokens] >= 0)
    return gate, np.where(escaped, np.log10(np.where(escaped, shares, 1) / parts), 0)


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                    ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])


def score_block(shared, bits: int) -> Callable:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return SCORED.empty_table()
        code = shared.value
        ids, lengths, train, number, words, word_hash = opened(left["payload"][0].as_py())
        got: dict[int, list] = {k: [] for k in (0, *ORDERS)}
        for key, raw in sorted(zip(right["key"].to_pylist(), right["payload"].to_pylist(), strict=True)):
            got[key >> 40].append(unpack(raw))
        counts = np.empty(len(words), np.int64)
        counts[np.argsort(word_hash)] = np.concatenate([from_planes(x) for x in got[0]])
        h, place, successor = word_hash[number], places(lengths), code.successors(word_hash)
        asked = {k: pairs_of(bits, k, np.repeat(train, lengths), number, h, place, successor)[1:] for k in ORDERS}
        del h, place, successor
        release()
        own = score_tokens(code, lengths, train, number, words, word_hash, counts, got, asked)
        starts = np.cumsum(lengths) - lengths
        per = lambda x: np.add.reduceat(x, starts)
        size = per(np.array([len(w) + 1 if w != END else 1 for w in words])[number])
        base = per(np.log10((counts + 0.1) / (code.n + 0.1 * (code.types + 1)))[number])
        score = per(own)
        return pa.table([pa.array(ids, pa.int64()), pa.array(~train), pa.array(lengths.astype(np.int64)), pa.array(per((counts > 0).astype(np.int64)[number])),
                         pa.array(np.full(len(ids), code.n)), pa.array(base), pa.array(score), pa.array(-score * np.log2(10) / size)], schema=SCORED)
    return run


def frequent_partition(least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                _, _, _, h, n = unpack(raw)
                keep = n >= least
                yield pa.record_batch([pa.array(h[keep].view(np.int64)), pa.array(n[keep], pa.int64())], names=["hash", "n"])
    return run


def totals_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens, distinct words and words seen once of ranges, and how many words are seen 2^k times or more."""
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            n, types, once, _, counts = unpack(raw)
            yield batch_of([(n, types, once, pack(np.array([int((counts >= least).sum()) for least in LEVELS])))], "n long, types long, once long, levels binary")


#: Counts at which the dictionary may end.
LEVELS = sorted({int(2 ** (k / 8)) for k in range(8 * 50)})


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row.

    Whole texts are scored; a null or empty text is its end token alone. A word is a path of binary decisions along a
    Huffman code of the frequent words. Every decision has four predictors: the dictionary's counts, the successors
    of the hashed contexts of one and of three words in all training texts (a training document's own sights taken
    off), and what followed the last two words the last time in this text. A mixer whose weights are gated by how much
    the contexts know combines them; its weights, and a table that refines the result, move with the bits of every
    word while a text is scored. Words without a code of their own are told apart by exact counts, new ones by letters.

    Counts cover all training rows and are held by hash: each block of text asks for its own words and contexts, so
    nothing but the dictionary (at most 65,536 words) and the letter counts goes to every worker. Counts of tokens are
    exact up to equal 64-bit hashes. Rows that repeat count and are scored each; a null doc_id counts as empty text in
    the fold. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = bucketed(rows.mapInArrow(lean(block_partition(), 256), BLOCKS), "block")  # so blocks meet their answers where they lie
    blocks = made.where("block >= 0")
    tokens = blocks.agg(F.sum("tokens")).head()[0] or 0
    bits = max(3, (tokens // RANGE_TOKENS).bit_length())
    letters = made.where("block < 0")
    for _ in range(4):  # sums of 64 at a time, so no task opens all partitions' tables
        letters = letters.withColumn("block", F.ceil(F.col("block") / 64) - F.lit(1)).groupBy("block").applyInArrow(add_letters, BLOCKS)
    letters = sum((unpack(x) for x in letters.select("payload").toArrow()["payload"].to_pylist()), np.zeros(1 << 16, np.int64))
    answers = durable(blocks.mapInArrow(lean(asking_words(bits), 1), ASKED).groupBy("key").applyInArrow(tidy(answer_words(max(1, tokens >> 23), bits)), ASKED), sweep=True)
    words = answers.where("block < 0").select("payload")
    totals = words.mapInArrow(totals_partition, "n long, types long, once long, levels binary").toArrow().to_pylist()  # a small row per range
    n, types, once = (sum(r[k] for r in totals) for k in ("n", "types", "once"))
    levels = sum((unpack(r["levels"]) for r in totals), np.zeros(len(LEVELS), np.int64))
    least = next((x for x, many in zip(LEVELS, levels, strict=True) if many <= DICTIONARY), LEVELS[-1])
    top = words.mapInArrow(frequent_partition(least), "hash long, n long").toArrow()  # at most DICTIONARY rows
    code = make_code(top["hash"].to_numpy().view(np.uint64), top["n"].to_numpy(), n, types, once, letters)
    shared = spark.sparkContext.broadcast(code)  # of bounded size
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    told_ = blocks.mapInArrow(lean(asking_contexts(shared, bits), 1), ASKED).groupBy("key").applyInArrow(tidy(answer_contexts(shared)), ASKED)
    told_ = told_.union(answers.where("block >= 0"))
    return blocks.groupBy("block").cogroup(told_.groupBy("block")).applyInArrow(tidy(score_block(shared, bits)), schema)


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored."""
    return score_texts(table(spark, sf_dir, "documents"))
