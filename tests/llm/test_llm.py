"""Operators of the llm subpackage against brute force, exact round trips and held-out accuracy, with odd inputs."""

import collections
import gc
import hashlib
import math
import random
import re
import time
import tracemalloc
import weakref
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone import tables
from lodestone.operators import linking
from lodestone.llm import (chat_format, common, context_mixing, html_blocks, mixing, near_dup, packing, shard_tree, topk_threshold,
                           toxicity, winnowing)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string"
RNG = random.Random(7)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 6))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def odd_docs(spark):
    """Null and empty texts, white space only, one word, repeats, a very long text, unusual characters; extra columns
    named like those of results."""
    texts = [None, "", " \t\n", "One", "one", "One", prose(40, 1), prose(40, 1), prose(30000, 2), "é😀 中文 \x85 x x  y<|endoftext|>", "A B C", "a  b\nc", prose(60, 3)]
    rows = [(i, t, "en", ["a", "b", None][i % 3], 0, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[6]], DOCS), texts


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def words(t):
    return (t or "").encode().lower().split()


# top-k

def brute_top(vectors, k=5, every=50):
    whole = {i: [math.floor(256 * x) for x in v] for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, qv in whole.items():
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in whole.items() if i != q)[:k]
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["gauss", "ties", "wide"])
def test_topk_matches_brute_force(spark, kind):
    r = np.random.default_rng(3)
    x = r.normal(0, 0.2, (300, 12)) if kind != "ties" else r.integers(-1, 2, (300, 4)) / 4
    if kind == "wide":
        x = x * 3e6
    vectors = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    vectors += [(300, None), (350, [float("nan")] * len(x[0])), (None, vectors[0][1]), (400, [None] * len(x[0]))]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in vectors], "vec_id long, embedding array<double>, rank int, score double")
    got = sorted(tuple(t) for t in topk_threshold.top_k(df, candidates=64, queries=4).collect())
    assert got == brute_top(vectors)


def test_topk_of_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk_threshold.top_k(empty(spark, schema)).count() == 0
    assert topk_threshold.top_k(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    got = topk_threshold.top_k(spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [-1.0])], schema)).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 0), (0, 2, 2, 0)]


# near-duplicates

def brute_groups(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[a:a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and root(a) != root(b):
                    group[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("words_in, percent, rows", [(3, 85, 7), (5, 80, 6)])
def test_near_duplicates_match_brute_force(spark, words_in, percent, rows):
    r = random.Random(5)
    texts = [None, "", "one", "One", "a b", "a  B"]
    for base in range(4):
        w = prose(120, base).split()
        for _ in range(25):  # a family of edits, some near the threshold
            v = list(w)
            for _ in range(r.randint(0, 7)):
                v[r.randrange(len(v))] = r.choice(WORDS)
            texts.append(" ".join(v))
    texts += texts[6:9]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dup.near_duplicates(df, near_dup.Plan(words_in, percent, rows)).collect()}
    assert got == brute_groups(list(enumerate(texts)), words_in, percent)


def test_near_duplicates_of_nothing(spark):
    assert near_dup.near_duplicates(empty(spark)).count() == 0


def test_components_of_a_long_chain(spark):
    """Logarithmic in the chain's length, and the planner's estimate stays that of the stored rows."""
    n, rounds = 10_000, []
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:])] + [(n + 1, n + 2)], "x long, y long")
    out = linking.components(edges, rounds)
    got = dict((r.id, r.component) for r in out.collect())
    assert set(got.values()) == {0, n + 1} and len(got) == n + 2
    assert sum(rounds) <= 2 * math.log2(n) + 1
    assert int(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 1 << 40


def test_components_of_a_sorted_chain(spark):
    rounds = []
    got = linking.components(spark.range(1500).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y")), rounds).agg(F.max("component"), F.count("*")).head()
    assert tuple(got) == (0, 1501) and len(rounds) == 1 and rounds[0] <= 12


def test_rows_that_share_a_doc_id(spark):
    """Rows are documents of their own; null ids never lead; every column goes on, whatever its name."""
    copy, other, long = prose(50, 1), prose(50, 2), prose(40_000, 9)
    rows = [(1, copy, "a"), (1, other, "b"), (2, copy + " x", "c"), (None, other, "d"), (None, prose(50, 3), "e"), (None, prose(50, 3), "f"), (3, None, "g"),
            (3, "", "h"), (4, long, "i"), (5, long + " y", "j"), (6, prose(50, 4), "k"), (6, prose(50, 4), "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id string")
    df = df.withColumns({"__row": F.lit(1), "component": F.lit(2), "k1": F.create_map(F.lit(1), F.lit(2)), "n": F.array(F.lit(1))})
    got = collections.Counter((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect())
    assert got == collections.Counter([(1, 1, True), (1, 1, True), (2, 1, False), (None, 1, False), (None, None, False), (None, None, False), (3, 3, True), (3, 3, True),
                                       (4, 4, True), (5, 4, False), (6, 6, True), (6, 6, True)])
    kept = near_dup.kept_documents(df)
    assert kept.columns == df.columns
    names = sorted(r["__id"] for r in kept.collect())
    assert names in (["a", "b", "e", "g", "h", "i", "k"], ["a", "b", "f", "g", "h", "i", "k"])
    assert names == sorted(r["__id"] for r in near_dup.kept_documents(df.repartition(5)).collect())
    assert near_dup.kept_documents(empty(spark)).count() == 0


def test_pairs_across_components_of_a_bucket(spark):
    """A family whose neighbours are alike but not its ends: every link that joins components is found."""
    r = random.Random(8)
    base, texts = prose(200, 5).split(), []
    for _ in range(60):
        texts.append(" ".join(base))
        for _ in range(3):
            base[r.randrange(len(base))] = r.choice(WORDS)
    r.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dup.near_duplicates(df).collect()}
    assert got == brute_groups(list(enumerate(texts)), 5, 80)


def test_hot_keys_are_dealt_by_a_count_that_rows_hold(spark):
    """A hot key's rows lie in many parts, each meets its one partner, and no list of hot keys is joined."""
    rows = spark.range(30_000).select(F.when(F.col("id") < 9000, -1).otherwise(F.col("id")).alias("x"), F.col("id").alias("v"))
    rows = rows.withColumn("many", F.when(F.col("x") == -1, 9000).otherwise(1))
    found = rows.groupBy("x").agg(F.min("v").alias("least"), F.first("many").alias("many"))
    got = tables.looked_up(rows, found, "x", many="many", total=30_000)
    assert got.columns == ["x", "v", "many", "least"] and "__hot" not in got._jdf.queryExecution().analyzed().toString()
    assert tuple(got.agg(F.count("*"), F.countDistinct("v"), F.sum("least")).head()) == (30_000, 30_000, sum(range(9000, 30_000)))


def test_joins_of_sets_merge_for_few_pairs_too(spark):
    """What moves beside few pairs is what moves beside many, so a small run tells the disk of a large one."""
    sides = [spark.range(10).select(F.col("id").alias("x"), F.lit(k).alias(f"c{k}")) for k in (1, 2)]
    got = tables.looked_up(*sides, "x", total=10, merge=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and got.count() == 10


def test_lean_workers_see_slices_and_every_row():
    batch, seen = pa.record_batch([pa.array(range(10))], names=["x"]), []
    run = lambda batches: (seen.append(b.num_rows) or b for b in batches)
    got = list(common.lean(run, 4)(iter([batch, batch.slice(0, 0), batch.slice(7)])))
    assert seen == [4, 4, 2, 3] and [v for b in got for v in b.column(0).to_pylist()] == [*range(10), 7, 8, 9]


def test_circulant_signature_is_the_shifted_minimum():
    s = np.arange(1, 50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sig = near_dup.signature(s, 300)
    assert len(sig) == 300 and (near_dup.signature(np.concatenate([s, s]), 300) == sig).all()
    t = s.copy()
    t[:5] += np.uint64(12345)
    assert abs((near_dup.signature(t, 300) == sig).mean() - 44 / 54) < 0.12


# HTML

def test_blocks_are_labelled_on_unseen_layouts():
    maker, model, wrong, total = html_blocks.Maker(4242), html_blocks.trained(), 0, 0
    for _ in range(150):
        blocks = html_blocks.blocks_of(maker.page())
        y = np.array(["\x01" in b.text for b in blocks])
        for b in blocks:
            b.text = b.text.replace("\x01", "").strip() or "-"
        if blocks:
            wrong += int(((model.label([html_blocks.features(blocks)])[0] >= 0.5) != y).sum())
            total += len(y)
    assert wrong / total < 0.05


def test_block_text():
    page = "<!-- c --><p>a &amp; b<br>c&nbsp;d<p><b>e</b>  f<script>x</p></script><td title='<p>'>g</td><a href=\"#\">h</a> 3 < 4</div>"
    assert [b.text for b in html_blocks.blocks_of(page)] == ["a & b c d", "e f", "g", "h 3 < 4"]
    assert html_blocks.blocks_of(None) == [] and html_blocks.blocks_of("<") != None  # noqa: E711


def test_head_without_end_tag():
    for page in ("<html><head><title>x</title><meta a=b><body><p>One two.</p>", "<head><link a=b><div>One two.</div>"):
        got = html_blocks.blocks_of(page)
        assert [b.text for b in got] == ["One two."] and got == html_blocks.blocks_of(page.replace("<body>", "</head><body>").replace("<div>", "</head><div>"))
    assert html_blocks.blocks_of("<head><title>x</title><script>y</script>z</head>") == []


@pytest.mark.parametrize("page, want", [
    ("<p title=don't>alpha beta</p><p>it's gamma</p>", ["alpha beta", "it's gamma"]),
    ("<p class=x'>it's one <b>two</b> don't stop</p>", ["it's one two don't stop"]),
    ("<p>a<!-- open <b>x</b></p><p>more</p>", ["ax", "more"]),
    ("<p>a</p><textarea>in <p>text</p>", ["a", "text"]),
    ("<p>a</p><script>if (a<b) {} <p>text</p>", ["a", "text"]),
    ("<p title=\"a>b\">x</p><a href='x>y'>z</a>", ["x", "z"]),
    ("<p>of <math><mi>x</mi></math> and <object>it</object></p>", ["of x and it"]),
    ("<svg><path d=x><p>after</p>", ["after"]),
    ("<p a=\"x>y</p><p>z</p>", ["y", "z"]),
    ("<!--><p>a</p><!-- <p>no</p> --><p>b</p>", ["a", "b"]),
    ("<p" + " a='b" * 5000 + ">x", ["x"]),
])
def test_text_of_broken_markup(page, want):
    assert [b.text for b in html_blocks.blocks_of(page)] == want


def test_extract_text_of_odd_pages(spark):
    page = "<html><nav><a href=1>x</a></nav><article><h1>T</h1><p>One two three four.</p></article><footer>f</footer>"
    df = spark.createDataFrame([(0, "u", None, "z"), (1, "u", "", "z"), (2, None, page, "z"), (2, None, page, "z")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_blocks.extract_text(df).collect())
    assert got == [(0, "", 0), (1, "", 0), (2, "T\nOne two three four.", 21), (2, "T\nOne two three four.", 21)]
    paragraphs = [f"{prose(60, i).capitalize()}." for i in range(900)]  # a long page, and a column named like a result
    page = "<html><nav><a href=1>x</a></nav><article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article></html>"
    long = html_blocks.extract_text(spark.createDataFrame([(7, "u", page, -1)], "page_id long, url string, html string, n_chars long")).head()
    assert long.text == "\n".join(paragraphs) and long.n_chars == len(long.text)
    assert html_blocks.extract_text(empty(spark, "page_id long, url string, html string")).count() == 0


# language model

def test_base_scores_and_folds_match_brute_force(spark):
    df, texts = odd_docs(spark)
    more = [(100 + i, prose(80, 50 + i % 9), "en", "a", 0, "", "") for i in range(60)]
    df = df.unionByName(spark.createDataFrame(more, DOCS))
    rows = [(i, t) for i, t in enumerate(texts)] + [(6, texts[6])] + [(r[0], r[1]) for r in more]
    counts = collections.Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update([*words(t), b""])
    n, v = sum(counts.values()), len(counts)
    want = sorted((i, zlib.crc32(str(i).encode()) % 10 == 0, len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), b""]), n,
                   round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(t), b""]), 6)) for i, t in rows)
    got = context_mixing.score_texts(df).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert context_mixing.score_texts(empty(spark)).count() == 0


def slow_scores(rows, code):
    """Score of every (id, text) word by word and bit by bit, from plain counts."""
    cm = context_mixing
    docs = [(not cm.held_out(i), [*words(t), cm.END]) for i, t in rows]
    short = lambda w: cm.hashes([w])[0] >> np.uint64(64 - cm.WORD_BITS)
    row_of = {int(h): i for i, h in enumerate(code.hash)}
    row = lambda w: row_of.get(int(cm.hashes([w])[0]) >> (64 - cm.COUNTED_BITS), code.escape)
    bits = [format(int(c), "032b")[:n] for c, n in zip(code.code, code.length)]
    weight = [max(x, math.ceil(code.n * cm.LEAST_SHARE)) for x in [*(None,) * 0, *code_counts(code, docs)]]
    chance = lambda prefix: sum(x for x, b in zip(weight, bits) if b.startswith(prefix)) / sum(weight)
    follow = lambda ws, t, k: tuple(ws[t - j] if t >= j else None for j in range(1, k + 1))
    seen = {k: collections.defaultdict(collections.Counter) for k in cm.ORDERS}
    count = collections.Counter()
    for train, ws in docs:
        for t, w in enumerate(ws):
            if train:
                count[w] += 1
                for k in cm.ORDERS:
                    seen[k][follow(ws, t, k)][w] += 1
    letters = code.letters.reshape(256, 256) + 0.01
    spelled = lambda w: math.prod(letters[a, b] / letters[a].sum() for a, b in zip(b" " + w + b" ", w + b" "))
    out = []
    for train, ws in docs:
        total = 0.0
        for t, w in enumerate(ws):
            if t % cm.LANE == 0:
                weights = {g: list(cm.first_weights(np.array([g]))[0].astype(float)) for g in range(cm.GATES)}
                refine = [1 / (1 + math.exp(-(c + 0.5) * 12 / cm.CELLS)) for c in range(cm.CELLS)]
            predictors, states = [], []
            for k, most in cm.ORDERS.items():
                after = seen[k][follow(ws, t, k)]
                asked = any(follow(xs, u, k) == follow(ws, t, k) for learned, xs in docs if not learned for u in range(len(xs)))
                known = sorted((x for x in after.items() if asked or x[1] > 1), key=lambda x: (-x[1], short(x[0])))[:most]
                off = sum(ws[u] == w and follow(ws, u, k) == follow(ws, t, k) for u in range(len(ws))) if train and known else 0
                named = [(x, n - off * (x == w) - cm.DISCOUNT) for x, n in known if n - off * (x == w) > 0]
                mass = sum(n for _, n in named)
                left = max(sum(after.values()) - off - mass, 0) + cm.LEFT_OVER
                states.append(int(mass > 1e-9) + int(mass >= (1.0 if k > 1 else 3.0)))
                predictors.append((named, left))
            same = [u for u in range(t) if follow(ws, u, 2) == follow(ws, t, 2)]
            predictors.append(([(ws[same[-1]], 1.0)] if same else [], 0.5))
            gate = states[0] + 3 * states[1] + 9 * bool(same)
            code_bits = bits[row(w)]
            grads, cells = [0.0] * len(predictors), []
            for j in range(len(code_bits)):
                on, at = code_bits[:j + 1], code_bits[:j]
                xs = []
                for named, left in predictors:
                    side = lambda p: sum(n for x, n in named if bits[row(x)].startswith(p)) + left * chance(p)  # noqa: E731, B023
                    down = side(on)
                    xs.append(max(-cm.LIMIT, min(cm.LIMIT, math.log(down / max(side(at) - down, 1e-9)))))
                st = max(-cm.LIMIT, min(cm.LIMIT, sum(a * b for a, b in zip(weights[gate], xs))))
                p = 1 / (1 + math.exp(-st))
                cell = int(abs(st) * cm.CELLS / 12)
                side = refine[cell] if st > 0 else 1 - refine[cell]
                total += math.log10((1 - cm.REFINE_PART) * p + cm.REFINE_PART * side)
                grads = [g + (1 - p) * x for g, x in zip(grads, xs)]
                cells.append((cell, st > 0))
            weights[gate] = [a + cm.RATE * g for a, g in zip(weights[gate], grads)]
            for c in set(c for c, _ in cells):
                hits = [r for d, r in cells if d == c]
                refine[c] += (1 - (1 - cm.REFINE_RATE) ** len(hits)) * (sum(hits) / len(hits) - refine[c])
            if row(w) == code.escape:
                new = (code.once + 1) / (code.rest + 2)
                n = count[w] - train * ws.count(w)
                rest = (1 - new) * n / (code.rest + 1) if n > 0 else new * spelled(w)
                shares = [rest]
                for named, left in predictors:
                    free = [(x, n) for x, n in named if row(x) == code.escape]
                    if free:
                        back = left * chance(bits[code.escape])
                        shares.append((sum(n for x, n in free if x == w) + back * rest) / (sum(n for _, n in free) + back))
                total += math.log10(sum(shares) / len(shares))
        out.append(total)
    return out


def code_counts(code, docs):
    count = collections.Counter(w for train, ws in docs if train for w in ws)
    by_hash = {int(context_mixing.hashes([w])[0]) >> (64 - context_mixing.COUNTED_BITS): n for w, n in count.items()}
    return [*(by_hash[int(h)] for h in code.hash), code.rest + 1, 1]


@pytest.mark.parametrize("dictionary", [1 << 16, 60])
def test_scores_match_a_slow_bit_by_bit_version(spark, monkeypatch, dictionary):
    monkeypatch.setattr(context_mixing, "DICTIONARY", dictionary)
    kept = []
    make = context_mixing.make_code
    monkeypatch.setattr(context_mixing, "make_code", lambda *a: kept.append(make(*a)) or kept[-1])
    r = random.Random(3)
    few = WORDS[:80]
    rows = [(i, " ".join(r.choice(few) for _ in range(r.randint(0, 40)))) for i in range(30)]
    rows += [(30, rows[3][1] + " never yet seen"), (31, rows[3][1]), (32, None), (33, " ".join(["loop it"] * 150)), (36, rows[5][1] + " zq zq zq")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {x.doc_id: x.score for x in context_mixing.score_texts(df).collect()}
    want = slow_scores(rows, kept[0])
    assert np.allclose([got[i] for i, _ in rows], want, rtol=2e-4)


def test_code_of_words_is_complete():
    weights = np.array([5, 1, 1, 900, 33, 2, 2, 71])
    code, length = context_mixing.huffman(weights)
    assert abs(sum(2.0 ** -int(x) for x in length) - 1) < 1e-12 and len(set(code)) == len(weights)
    assert length[3] == 1


def test_order_of_words_matters(spark):
    """The same words shuffled get another score, and a copy of a training text a better one than its words shuffled."""
    words_in = prose(300, 77).split()
    copy, shuffled = " ".join(words_in), " ".join(random.Random(5).sample(words_in, len(words_in)))
    held = [i for i in range(200) if context_mixing.held_out(i)]
    rows = [(i, prose(300, 1000 + i) if i % 4 else copy, "en", "a", 0, "", "") for i in range(200) if i not in held]
    rows += [(held[0], copy, "en", "a", 0, "", ""), (held[1], shuffled, "en", "a", 0, "", "")]
    got = {r.doc_id: r.score for r in context_mixing.score_texts(spark.createDataFrame(rows, DOCS)).where("held_out").collect()}
    assert got[held[0]] > got[held[1]] + 50


def test_words_of_a_block_are_numbered():
    texts = [b"", b" \t\n", b"One one\x0bONE", "é\x85 x<|y\x00 ".encode(), b"a", b"  b"]
    spelled, number, lengths = context_mixing.numbered(texts)
    want = [[*context_mixing.words_of(t), context_mixing.END] for t in texts]
    assert [spelled[i] for i in number] == sum(want, []) and lengths.tolist() == [len(w) for w in want] and len(set(spelled)) == len(spelled)


def test_every_successor_of_a_context_counts(spark):
    """Twelve words follow the same one equally often, and a text that holds any of them is as likely as the others."""
    held, free = ([i for i in range(900) if context_mixing.held_out(i) == kind] for kind in (True, False))
    rows = [(free[i], f"lead {WORDS[i % 12]}") for i in range(600)]
    rows += [(held[i], f"lead {WORDS[i]}") for i in range(12)]
    got = [r.score for r in context_mixing.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()]
    assert len(got) == 12 and max(got) - min(got) < 0.5


def test_pairs_of_a_block_are_held_in_half_the_memory(monkeypatch):
    """Places of pairs take four bytes, and what a pair before tells is found piece by piece as at once."""
    cm, r = context_mixing, np.random.default_rng(5)
    number, place, learned = r.integers(0, 50, 5000), np.arange(5000) % 40, r.random(5000) < 0.9
    h = cm.hashes([b"%d" % i for i in range(50)])
    code = cm.make_code(h >> np.uint64(64 - cm.COUNTED_BITS), r.integers(1, 900, 50), 50_000, 60, 3, np.zeros(1 << 16, np.int64))
    _, _, owner, word, pair = cm.pairs_of(3, 1, learned, number, h[number], place, code.successors(h))
    assert {x.dtype for x in (owner, word, pair)} == {np.dtype(np.int32)} and (word[pair] == number).all()
    row = code.by_word(h)[word]
    whole = cm.untold(code, owner, row)
    monkeypatch.setattr(cm, "INPUTS", 7)
    assert all((a == b).all() for a, b in zip(whole, cm.untold(code, owner, row), strict=True))
    plain = [0 if i == 0 or owner[i] != owner[i - 1] else
             1 + min(int(code.length[row[i]]), int(cm.agreed(code.code[row[i]:row[i] + 1], code.code[row[i - 1]:row[i - 1] + 1])[0])) for i in range(len(row))]
    assert whole[0].tolist() == plain


def asked_range(blocks, each):
    """A code, and what blocks ask of a range: contexts of one to many successors, of which they share a part."""
    cm, r = context_mixing, np.random.default_rng(8)
    h = np.sort(cm.hashes([b"%d" % i for i in range(3000)]))
    code = cm.make_code(h[:2000] >> np.uint64(64 - cm.COUNTED_BITS), r.integers(1, 900, 2000), 500_000, 3000, 3, np.zeros(1 << 16, np.int64))
    after, asked = code.successors(h), []
    for _ in range(blocks):
        context = (r.integers(0, 200, each) ** 2 * 6700).astype(np.uint64)
        key, n = np.unique(context << np.uint64(cm.SUCCESSOR_BITS) | after[r.integers(0, 3000, each)].astype(np.uint64), return_counts=True)
        c, of = np.unique(key >> np.uint64(cm.SUCCESSOR_BITS), return_counts=True)
        step = np.diff((key & np.uint64((1 << cm.SUCCESSOR_BITS) - 1)).astype(np.int64), prepend=0)
        first = np.cumsum(of) - of
        step[first] = key[first] & np.uint64((1 << cm.SUCCESSOR_BITS) - 1)
        asked.append((cm.small(np.diff(c, prepend=np.uint64(0))), cm.small(of * 2 + r.integers(0, 2, len(c))), cm.planes(step, 3), cm.small(n - (r.random(len(n)) < 0.2))))
    return code, asked


def test_a_range_is_answered_slice_by_slice(monkeypatch):
    """The same answers whatever the slices, and memory does not follow the number of pairs that a range is asked for."""
    code, asked = asked_range(12, 30_000)
    answers, peaks = [], []
    for size in (1 << 30, 1 << 12, 100):
        monkeypatch.setattr(context_mixing, "SLICE", size, raising=False)
        tracemalloc.start()
        answers.append(context_mixing.told(asked, code))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert answers[0] == answers[1] == answers[2]
    assert peaks[1] < 0.5 * peaks[0]


def test_ranks_are_found_in_few_copies():
    """Ranks as of a plain search, and less than six times the values' memory at once."""
    x = np.random.default_rng(2).integers(0, 1 << 30, 500_000).astype(np.uint64)
    tracemalloc.start()
    value, rank = context_mixing.ranked(x, 30)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (value[rank] == x).all() and (value[1:] > value[:-1]).all() and peak < 5.5 * x.nbytes


def test_shuffles_of_a_swept_table_leave_the_disks(spark):
    """No files of its shuffles stay behind, and the session's setting stays as it was."""
    here = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before, set_to = here(), spark.conf.get(tables.SWEEP, None)
    out = tables.durable(spark.range(1000).repartition(4).groupBy((F.col("id") % 7).alias("k")).count(), sweep=True)
    for _ in range(50):
        if here() <= before:
            break
        time.sleep(0.1)
    assert here() <= before and spark.conf.get(tables.SWEEP, None) == set_to
    assert sorted(x["count"] for x in out.collect()) == [142, 143, 143, 143, 143, 143, 143]


# toxicity

def test_toxicity_learns_pairs_that_weights_miss():
    r = np.random.default_rng(1)
    x = r.integers(0, 2, (1500, 6))
    y = ((x[:, 0] & x[:, 1]) | 0).astype(float)
    sets = [np.flatnonzero(v) for v in x]
    m = toxicity.fit(sets, y, float(y.mean()))
    dense = np.array([[int(p) in s for p in m.places] for s in map(set, sets)], np.float32)
    assert ((m.logits(dense) > 0) == (y > 0)).mean() > 0.98
    assert (m.v[m.places.tolist().index(0)] @ m.v[m.places.tolist().index(1)]) > 0.5


def test_toxicity_logits_are_sums_over_pairs():
    r = np.random.default_rng(2)
    sets = [np.flatnonzero(v) for v in r.integers(0, 2, (300, 8))]
    m = toxicity.fit(sets, r.integers(0, 2, 300).astype(float), 0.5)
    dense = np.array([[int(p) in s for p in m.places] for s in map(set, sets)], np.float32)
    pairs = [sum(float(m.v[a] @ m.v[b]) for a in range(len(x)) for b in range(a) if x[a] and x[b]) for x in dense]
    zero = m.logits(np.zeros((1, dense.shape[1]), np.float32))[0]
    alone = np.array([m.logits(np.eye(dense.shape[1], dtype=np.float32)[[a]])[0] - zero for a in range(dense.shape[1])])
    assert np.allclose(m.logits(dense), zero + dense @ alone + pairs, atol=1e-3)


def test_toxicity_on_odd_rows_and_held_out_rows(spark):
    df, _ = odd_docs(spark)
    texts = [(200 + i, prose(50, i) + (" awful" if i % 5 == 0 else ""), "en", "a", 0, "", "") for i in range(400)]
    df = df.unionByName(spark.createDataFrame(texts, DOCS))
    labels = spark.createDataFrame([(r[0], int(r[1].endswith("awful"))) for r in texts] + [(3, None), (None, 1), (200, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, labels).collect()}
    held = [r for r in texts if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(got[r[0]].held_out for r in held) and all(got[r[0]].predicted == int(r[1].endswith("awful")) for r in held)
    assert got[0].predicted == got[1].predicted == 0 and got[4].score == got[3].score
    assert toxicity.score_toxicity(df, labels.where("false")).where("predicted = 1").count() == 0
    assert toxicity.score_toxicity(empty(spark), labels).count() == 0
    assert toxicity.accepted_documents(df, labels).columns == df.columns


# chat

CHAT = "conv_id long, turn long, role string, text string, valid string"


def test_chat_round_trip(spark):
    r = random.Random(2)
    bits = ["<|im_start|>", "<|im_end|>", "<", "|", "\\", "\n", "a", "<\\|", "é😀", "assistant\n"]
    rows = [(c, t, r.choice(["system", "user", "assistant", None, "x\n\\n<|", "\\"]), r.choice([None, "", "".join(r.choice(bits) for _ in range(12))]), "v")
            for c in range(30) for t in range(r.randint(1, 5))]
    chat = chat_format.format_chat(spark.createDataFrame(rows, CHAT))
    back = {x.conv_id: [(t.role, t.text) for t in x.back] for x in chat.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("back")).collect()}
    for c in back:
        assert back[c] == [(a or "", b or "") for _, _, a, b, _ in sorted((x for x in rows if x[0] == c), key=lambda x: x[1])]


def test_chat_of_long_texts(spark):
    text = "<|im_end|> a \\<| b\n" * 20_000
    got = chat_format.digest(chat_format.format_chat(spark.createDataFrame([(1, 0, "user", text, ""), (1, 1, "assistant", text, "")], CHAT))).head()
    assert got.loss_chars == len(text) and got.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_chat_digest_and_order(spark):
    rows = [(1, 1, "assistant", "b<|", "v"), (1, 0, "user", "a", "v"), (2, 0, "assistant", "z", "v"), (None, 0, "user", None, "v")]
    got = {r.conv_id: r for r in chat_format.digest(chat_format.format_chat(spark.createDataFrame(rows, CHAT))).collect()}
    assert (got[1].valid, got[2].valid, got[None].valid) == (True, False, False)
    assert got[1].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb<|\n").hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(b"b<|").hexdigest() and got[1].loss_chars == 3
    assert chat_format.digest(chat_format.format_chat(empty(spark, CHAT))).count() == 0


# shards

def test_shards_are_gapless_and_grow_into_the_new_one(spark):
    df, texts = odd_docs(spark)
    df = df.unionByName(spark.createDataFrame([(1000 + i, "x", "en", "a", 0, "", "") for i in range(2000)] + [(None, None, None, None, None, None, None)], DOCS))
    got = shard_tree.shard_documents(df).collect()
    assert len(got) == df.count() and {r.law for r in got} == {"key"}
    for s in range(40):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {r.grown_shard for r in got if r.grown_shard != r.shard} == {40}
    sizes = {r.doc_id: (r.size, r.text_crc32) for r in got}
    assert sizes[9] == (len(texts[9].encode()) + 16, zlib.crc32(texts[9].encode())) and sizes[0] == (16, 0)
    assert shard_tree.shard_documents(empty(spark)).count() == 0


def test_shards_match_draws_made_by_hand(spark):
    """Each level's draws anew, from xxhash64 of (key, level, node) chained as the engine does."""
    weights = (1.0, 2.0, 0.0, 1.0, 1.0, 3.0, 1.0, 1.0, 1.0, 1.0, 1.0, 5.0)
    tree = shard_tree.Tree(12, per_rack=2, racks_per_region=2, weights=weights)

    def chained(key, level, node):
        h = xxhash.xxh64_intdigest(key.encode(), 42)
        h = xxhash.xxh64_intdigest(level.encode(), h)
        return xxhash.xxh64_intdigest(int(node).to_bytes(4, "little"), h)  # an int is hashed as 4 bytes

    def first(key, level, children):
        def at(node, weight):
            return -math.log(((chained(key, level, node) >> 11) + 0.5) / 2**53) / weight if weight > 0 else math.inf
        return min((at(n, w), n) for n, w in children)[1]

    heavy = lambda xs: sum(weights[x] for x in xs)
    want = {}
    for i in range(400):
        region = first(str(i), "region", [(r, heavy(range(4 * r, 4 * r + 4))) for r in range(3)])
        rack = first(str(i), "rack", [(k, heavy(range(2 * k, 2 * k + 2))) for k in (2 * region, 2 * region + 1)])
        want[i] = first(str(i), "shard", [(s, weights[s]) for s in (2 * rack, 2 * rack + 1)])
    rows = shard_tree.place(spark.range(400).select(F.col("id").alias("doc_id"), F.lit("").alias("text")), tree, tree).collect()
    assert {r.doc_id: r.shard for r in rows} == want


def test_equal_rows_get_slots_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(shard_tree, "TOGETHER", 7)
    rows = [(None, "x")] * 40 + [(5, "y")] * 9 + [(i, "z") for i in range(30)]
    got = shard_tree.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_weights_move_rows_only_at_their_subtree(spark):
    ids = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    a = shard_tree.Tree(20)
    w = [1.0] * 20
    w[7] = 3.0
    rows = shard_tree.place(ids, a, shard_tree.Tree(20, weights=tuple(w))).collect()
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert moved and all(r.grown_shard < 10 for r in moved)  # into the region of shard 7, or inside it
    assert all(r.grown_shard in range(5, 10) for r in moved if r.shard in range(5, 10) or r.shard < 5)
    assert all(r.grown_shard == 7 for r in moved if r.shard in range(5, 10))
    assert 2.2 < sum(r.grown_shard == 7 for r in rows) / sum(r.shard == 7 for r in rows) < 3.8


# fingerprints

def brute_places(hashes, window):
    out = []
    for a in range(max(1, len(hashes) - window + 1) if hashes else 0):
        part = hashes[a:a + window]
        at = a + max(i for i, x in enumerate(part) if x == min(part))
        if at not in out:
            out.append(at)
    return out


def rolled(text, gram):
    """Hashes of all runs of words, rolled one word at a time: turn by one, take out the word that leaves, put in the
    next."""
    turn = lambda x, k: ((x << k) | (x >> (64 - k))) & (2**64 - 1) if k else x
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    now, out = 0, []
    for x in h[:gram]:
        now = turn(now, 1) ^ x
    if h and len(h) < gram:
        now = turn(now, gram - len(h))
    out = [now] if h else []
    for a in range(gram, len(h)):
        now = turn(now, 1) ^ turn(h[a - gram], gram) ^ h[a]
        out.append(now)
    return [x - 2**64 if x >= 2**63 else x for x in out]


def test_fingerprints_match_brute_force(spark):
    texts = ["", " ", "one", "one two", "a b c", "a b c d", "x" * 5000 + " y " + "x" * 4999 + " z q", prose(300, 4), "b a " * 40, "é 😀 é 😀 é 中"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for gram, window in ((3, 4), (1, 2), (5, 8)):
        for r in winnowing.fingerprints(df, "t", "", gram, window).collect():
            h = rolled(texts[r.i], gram)
            assert list(r.places) == brute_places(h, window) and list(r.marks) == [h[p] for p in r.places]


def test_buckets_count_cuts(spark):
    cuts = [3, 5, 6, 9, 10, 11, 20, 21]
    for n in range(len(cuts) + 1):
        got = spark.range(25).select("id", winnowing.bucket_of(F.col("id"), cuts[:n]).alias("b")).collect()
        assert all(r.b == sum(c <= r.id for c in cuts[:n]) for r in got)


@pytest.mark.parametrize("window", [1, 2, 4, 8])
def test_winnowing_matches_brute_force(spark, window):
    r = random.Random(window)
    rows = [[r.choice([r.getrandbits(63), -r.getrandbits(63), 5]) for _ in range(n)] for n in (1, 2, 3, 7, 8, 40, 41)]
    rows.append([5] * 12)
    df = spark.createDataFrame([(i, h) for i, h in enumerate(rows)], "i int, h array<long>")
    got = {x.i: x.p for x in df.select("i", winnowing.winnow(F.col("h"), window).alias("p")).collect()}
    assert [got[i] for i in range(len(rows))] == [brute_places(h, window) for h in rows]


def test_fingerprints_of_odd_documents(spark):
    df, texts = odd_docs(spark)
    got = {}
    for r in winnowing.fingerprint_documents(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    order = sorted([*[(i, t or "") for i, t in enumerate(texts)], (6, texts[6])], key=lambda x: (-x[0], x[1]))
    for k, (i, t) in enumerate(order):
        nxt, third = order[(k + 1) % len(order)][1], len(t) // 3
        sha = hashlib.sha256((t[:len(t) - third] + nxt[:third]).encode()).hexdigest()
        assert sha in {x.edited_sha256 for x in got[i]} and all(x.n_chars == len(t) for x in got[i])
    assert got[3][0].fingerprint == got[5][0].fingerprint != got[4][0].fingerprint and got[0][0].fingerprint == "" == got[2][0].fingerprint
    assert 0.6 < got[8][0].near_edited < 0.72 and got[8][0].near_next < 0.1
    assert winnowing.fingerprint_documents(empty(spark)).count() == 0
    one = winnowing.fingerprint_documents(df.where("doc_id = 12")).head()
    assert one.near_next == 1.0


def test_shared_runs_share_a_mark(spark):
    run = prose(winnowing.GRAM + winnowing.WINDOW - 1, 77)
    df = spark.createDataFrame([(i, f"{prose(9, i)} {run} {prose(13, i + 50)}") for i in range(20)], "i int, t string")
    marks = [set(r.marks) for r in winnowing.fingerprints(df, "t", "").collect()]
    assert all(a & b for a in marks for b in marks)


# mixing

def test_mix_is_near_its_targets_and_bounded(spark):
    df, _ = odd_docs(spark)
    df = df.unionByName(spark.createDataFrame([(100 + i, prose(20 + i % 30, i), "en", "abcdef"[i % 6] if i % 2 else "a", 0, "", "") for i in range(600)], DOCS))
    sizes = mixing.sizes_of(df)
    got = mixing.mix(sizes).collect()
    assert len(got) == df.count() and sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(sizes).collect()))
    by = collections.defaultdict(list)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by[r.source].append(r)
    total = sum(r.size for r in got)
    assert abs(sum(v[0].target for v in by.values()) - total) < 1e-6 * total
    for v in by.values():
        assert v[0].source_size == sum(r.size for r in v) and v[0].target <= 3 * v[0].source_size + 1e-9
        assert abs(sum(r.taken for r in v) - v[0].target) <= max(4 * v[0].block, 0.01 * v[0].target)
        blocks = -(-v[0].source_size // v[0].block)
        assert sum({r.shard: r.shard_quota for r in v}.values()) == min(v[0].quota, 3 * blocks)
    assert mixing.mix(mixing.sizes_of(empty(spark))).count() == 0
    none = mixing.mix(mixing.sizes_of(df.where("doc_id < 3"))).collect()
    assert all(r.taken == 0 and r.target == 0 for r in none)


def test_quotas_follow_the_highest_quotients(spark):
    r = random.Random(6)
    rows = [(g, i, float(r.choice([0, 1, 3, 3, 50, 700])), 40 + 13 * g) for g in range(4) for i in range(30)]
    df = spark.createDataFrame(rows, "g int, i int, share double, seats long")
    got = {(x.g, x.i): x.won for x in mixing.apportioned(df, "share", "seats", "i", ["g"]).collect()}
    for g in range(4):
        best = sorted((-w / (2 * s - 1), i) for h, i, w, _ in rows if h == g for s in range(1, 200) if w)[:40 + 13 * g]
        assert {i: got[g, i] for i in range(30)} == {i: sum(j == i for _, j in best) for i in range(30)}


def test_mixed_documents_keep_columns(spark):
    df, _ = odd_docs(spark)
    df = df.withColumns({"__id": F.lit("a"), "__row": F.lit(1), "size": F.lit(2), "__copies": F.create_map(F.lit(1), F.lit(2))})
    df = df.unionByName(df.where("doc_id = 12").withColumn("doc_id", F.lit(None).cast("long")))
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    taken = {r.doc_id: (r.size, r.taken) for r in mixing.mix(mixing.sizes_of(df.where("doc_id is not null and doc_id <> 6"))).collect()}
    assert all(n >= 0 for _, n in taken.values())
    n = collections.Counter(r.doc_id for r in got.collect())
    assert all(n[i] <= 3 for i in n if i not in (6,)) and not {0, 1, 2} & set(n)
    assert mixing.mixed_documents(empty(spark)).count() == 0


# the pipeline

def test_pipeline_runs_all_stages(spark, tmp_path):
    import corpus_pipeline

    toxic = [(500 + i, prose(40, 700 + i) + " vile", "en", "a") for i in range(120)]
    clean = [(i, prose(40, i), "en", "ab"[i % 2]) for i in range(300)]
    odd = [(900, clean[5][1], "en", "a"), (901, clean[6][1] + " more", "en", "b"), (902, None, "en", None), (903, "", "en", "a"), (None, clean[7][1], "en", "a")]
    docs = spark.createDataFrame([*toxic, *clean, *odd], "doc_id long, text string, lang string, source string").withColumn("__id", F.lit(1))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], int(r[0] >= 500)) for r in [*toxic, *clean]], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stage(spark, now, str(tmp_path)).cache()
        assert now.columns == docs.columns, name
        left = {r.doc_id for r in now.collect()}
        if name == "toxicity":
            assert not left & set(range(500, 620)) and set(range(300)) <= left
        if name == "near_dedup":
            assert {r.doc_id for r in before.collect()} - left == {900, 901, None}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == left
    want = collections.Counter(r.doc_id for r in now.collect())
    assert all(sum(r.length for r in pieces if r.doc_id == i) == n * next(r.doc_tokens for r in pieces if r.doc_id == i) for i, n in want.items())


# packing

def test_pieces_rebuild_every_document(spark):
    df, texts = odd_docs(spark)
    got = packing.pack(df.repartition(3)).collect()
    encode = packing.Encoder(packing.TOKENIZER, 1)
    want = {i: np.array([*encode.t.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts)}
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        part = want[r.doc_id][r.start:r.start + r.length]
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
    for i, ids in want.items():
        assert sum(r.length for r in pieces[i]) == len(ids) * (2 if i == 6 else 1)
    rows = sorted((r.sequence_id, r.offset, r.length) for r in got)
    assert rows[0][:2] == (0, 0)
    for a, b in zip(rows, rows[1:]):
        assert b[:2] == ((a[0], a[1] + a[2]) if a[1] + a[2] < 2048 else (a[0] + 1, 0))
    assert packing.pack(empty(spark)).count() == 0


def test_rows_without_doc_id_are_packed(spark):
    rows = [(None, "one two"), (None, "one two"), (None, None), (7, "three")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter(r.doc_id for r in got) == {None: 3, 7: 1} and sorted(r.offset for r in got) == [0, *np.cumsum([r.length for r in sorted(got, key=lambda r: r.offset)])[:-1].tolist()]


def test_units_give_the_tokenizers_ids():
    encode, r = packing.Encoder(packing.TOKENIZER, 1), random.Random(3)
    letters = "ab1 .\n\t\r\x0b\x1c\x1d\x85\xa0 　​é中😀'sd|<>\x00"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 14))) + r.choice(["", "<|endoftext|>", "'ll  x"]) for _ in range(3000)]
    assert encode(texts) == [x + encode.end for x in encode.raw(texts)]


def test_packing_sees_few_rows_at_once_and_forgets(monkeypatch):
    """However large Spark's batches, a worker encodes few rows at once, and nothing of a task outlives it."""
    monkeypatch.setattr(packing, "TaskContext", type("T", (), {"get": classmethod(lambda c: c), "partitionId": staticmethod(lambda: 3)}))
    seen, kept = [], []

    class Seen(packing.Encoder):
        def __call__(self, texts):
            kept[:] = [weakref.ref(self)]
            seen.append(len(texts))
            return super().__call__(texts)

    monkeypatch.setattr(packing, "Encoder", Seen)
    texts = [None if i % 7 == 0 else f"word{i} and so on" for i in range(3000)]
    batch = pa.record_batch([pa.array(range(3000), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    gc.disable()
    try:
        got = pa.Table.from_batches(packing.encode_partition(packing.TOKENIZER, 1)(iter([batch, batch])))
        assert kept[0]() is None
    finally:
        gc.enable()
    n = got["doc_tokens"].to_numpy()
    assert max(seen) <= 512 and sum(seen) == len(got) == 6000
    assert got["doc_id"].to_pylist() == [*range(3000)] * 2 and (got["at"].to_numpy() == np.cumsum(n) - n).all() and set(got["pid"].to_pylist()) == {3}
    plain = packing.tokenizer(packing.TOKENIZER)
    assert got["ids"].to_pylist()[:50] == [np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u2").tobytes() for t in texts[:50]]
