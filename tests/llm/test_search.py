"""Collision counting, importance resampling and lexical search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from duotext.llm import collisions, lexical, resampling
from duotext.llm import queries as q
from test_llm import ODD, frame, none, odd  # noqa: F401

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


# -- embeddings --------------------------------------------------------------------------

def slow_links(rows, similarity=0.98):
    """Links between row positions, by all cosines."""
    units = {}
    for i, (_, x, label) in enumerate(rows):
        if label is not None and x and all(e is not None and math.isfinite(e) for e in x) and any(x):
            v = np.array(x, np.float64) / max(map(abs, x))
            units[i] = v / np.linalg.norm(v)
    near = defaultdict(set)
    for i in units:
        for j in units:
            if i < j and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= similarity:
                near[i].add(j), near[j].add(i)
    return near


def slow_rows(rows, near):
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j), todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((vec_id, len(near[i]), least, vec_id is not None and vec_id == least))
    return out


def planted(seed=1, bases=60, dim=24):
    rnd = np.random.default_rng(seed)
    rows = []
    for b in range(bases):
        x = rnd.standard_normal(dim)
        for size in [0.0, *rnd.uniform(0, 0.3, b % 6)]:
            rows.append((len(rows), (x + size * np.linalg.norm(x) / math.sqrt(dim) * rnd.standard_normal(dim)).tolist(), b % 3))
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumns(
        {c: F.lit("taken") for c in ("node", "unit", "leaf", "links", "root", "home", "times")})


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_links_of_odd_vectors(spark):
    rows = planted()
    x = rows[0][1]
    rows += [
        (900, x, 0), (900, x, 0), (901, [3 * e for e in x], 0), (902, x, 1), (903, x, None), (None, x, 0), (904, None, 0), (905, [], 0),
        (906, [0.0] * 24, 0), (907, [None, *x[1:]], 0), (908, [math.nan, *x[1:]], 0), (909, [math.inf, *x[1:]], 0), (910, x[:20], 0),
        (None, [1.0] * 24, 7), (None, [1e300] * 24, 7), (911, [1e-300] * 24, 7), (912, [-0.0, 1.0], 9), (913, [0.0, 1.0], 9),
    ]
    assert found(collisions.near_duplicates(table(spark, rows))) == sorted(slow_rows(rows, slow_links(rows)), key=str)
    assert found(collisions.near_duplicates(table(spark, rows[:0]))) == []


@pytest.mark.parametrize("group", [5, 40])
def test_recall_of_cut_groups(spark, group):
    rows = planted(seed=2, bases=200)
    near = slow_links(rows)
    result = {r[0]: r for r in found(collisions.near_duplicates(table(spark, rows), group=group))}
    links = sum(map(len, near.values()))
    got = sum(r[1] for r in result.values())
    assert links > 200 and 0.97 * links <= got <= links
    assert all(r[1] <= len(near[i]) for i, r in result.items())


def test_a_dense_group_is_compared_in_pieces(spark):
    rnd = np.random.default_rng(3)
    x = rnd.standard_normal(16)
    rows = [(i, (x + 0.01 * rnd.standard_normal(16)).tolist(), 0) for i in range(200)]
    assert {r[1:3] for r in found(collisions.near_duplicates(table(spark, rows), group=30))} == {(199, 0)}


def test_needed_collisions_keep_the_recall():
    need = collisions.needed_collisions()
    rnd = np.random.default_rng(4)
    differ = rnd.standard_normal((20000, collisions.COUNTED))  # in units of a close pair's spread
    reached = (np.abs(differ) <= collisions.WINDOW).sum(1) >= need
    assert reached.mean() > 0.999
    far = np.abs(differ) * math.sqrt(2) <= collisions.WINDOW * collisions.spread(0.98)
    assert (far.sum(1) >= need).mean() < 1e-3


def test_recall_on_the_given_vectors(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    near = slow_links(rows)
    whole = collisions.near_duplicates(table(spark, rows), group=50)
    assert sum(r[1] for r in found(whole)) >= 0.97 * sum(map(len, near.values()))


# -- resampling --------------------------------------------------------------------------

def slow_resample(docs, items):
    bucket = lambda w: zlib.crc32(w.encode()) % 10000
    s = Counter(bucket(w) for _, text in docs for w in terms(text))
    t = Counter(bucket(w) for text in items for w in terms(text))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)}
    out = []
    for i, text in docs:
        words = terms(text)
        weight = sum(gain[bucket(w)] for w in words) // max(1, len(words))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, r in enumerate(able[:10 * len(able) // 100], 1):
        r[4] = rank
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("most,piece", [(12, 16), (3, 2)])
def test_radix_ranks(spark, most, piece):
    rnd = random.Random(6)
    rows = [(rnd.choice([0, 7, 7, 7, rnd.randrange(1000)]), rnd.randrange(5), rnd.randrange(2**40)) for _ in range(500)]
    made = spark.createDataFrame(rows, "a bigint, b bigint, c bigint").repartition(7)
    out = resampling.radix_ranks(made, [("c", 40), ("b", 3), ("a", 10)], most, piece).orderBy("place").collect()
    assert [r.place for r in out] == list(range(500)) and [(r.a, r.b, r.c) for r in out] == sorted(rows)
    assert resampling.radix_ranks(made, [], most, piece).agg(F.max("place")).first()[0] == 499


def test_resampling_against_brute_force(spark, odd, none, monkeypatch):  # noqa: F811
    rnd = random.Random(7)
    vocabulary = [f"W{i}x" for i in range(60)] + ["é", "12", "-"]
    docs = [(i, t) for i, t, _ in ODD] + [(i * (-1) ** i, " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 60)))) for i in range(20, 150)]
    docs += docs[-9:] + [(None, docs[-1][1]), (2**40 + 3, docs[-2][1]), (40, docs[-3][1])]
    items = [" ".join(vocabulary[:20] * 3), None, "", "w1x W1X é"]
    bench = spark.createDataFrame(enumerate(items), "item_id bigint, text string")
    monkeypatch.setattr(resampling, "MEMO", 10)
    monkeypatch.setattr(resampling, "DIGIT_BITS", 6)
    given = frame(spark, [(i, t, "s") for i, t in docs]).withColumns({c: F.lit("taken") for c in ("score", "rank", "place", "low", "weight")})
    assert found(resampling.resample(given, bench)) == slow_resample(docs, items)
    assert found(resampling.resample(odd, bench.limit(0))) == slow_resample([(i, t) for i, t, _ in ODD], [])
    assert found(resampling.resample(none, bench)) == []


def test_runs_of_words_and_their_buckets():
    memo = resampling.Buckets(10000)
    expected = [zlib.crc32(x) % 10000 for x in (b"a", b"b", b"c", b"a b", b"b c")]
    assert memo.of([b"a", b"b", b"c"], 2).tolist() == expected and memo.of([], 2).tolist() == []


# -- search ------------------------------------------------------------------------------

def slow_search(docs, items, k=10):
    tfs = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    held = [x for x in tfs if x[2]]
    n_docs, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, tf, _ in held for t in tf)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, tf, n in held:
            m = 25 + 75 * n * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms(text) if tf[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard,block,item_bytes", [(4096, 32, 1 << 20), (64, 3, 40)])
def test_search_against_brute_force(spark, odd, none, monkeypatch, shard, block, item_bytes):  # noqa: F811
    rnd = random.Random(9)
    vocabulary = [f"T{i}" for i in range(300)] + ["é", "twice", "lorem"]
    weight = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, t) for i, t, _ in ODD] + [(i, " ".join(rnd.choices(vocabulary, weight, k=rnd.randint(1, 80)))) for i in range(100, 600)]
    docs += docs[200:215] + [(None, docs[205][1])]
    items = [(i, " ".join(rnd.choices(vocabulary, weight, k=rnd.randint(1, 12)))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "unseen words"), (93, docs[205][1]), (93, docs[205][1]), (None, "T7 T7 T9"), (94, "É -- é")]
    monkeypatch.setattr(lexical, "SHARD", shard)
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "ITEM_BYTES", item_bytes)
    given = frame(spark, [(i, t, "s") for i, t in docs]).withColumns({c: F.lit("taken") for c in ("n", "terms", "tfs", "item", "score", "rank")})
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("rank", F.lit("taken"))
    assert found(lexical.search(given.repartition(3), bench)) == slow_search(docs, items)
    assert found(lexical.search(odd, bench)) == slow_search([(i, t) for i, t, _ in ODD], items)
    assert found(lexical.search(none, bench)) == found(lexical.search(odd, bench.limit(0))) == []


def test_blocks_are_skipped_only_below_the_best(monkeypatch):
    """Every document at or above the least score is found, and most blocks are left out."""
    rnd, width = np.random.default_rng(10), 40
    table = (rnd.random((500, width)) < 0.2) * rnd.integers(1, 1000, (500, width))
    rows, columns = np.nonzero(table)
    axes = rnd.standard_normal((width, lexical.SKETCH))
    shard = lexical.Shard(columns, rows, table[rows, columns], np.arange(500), np.zeros(500, bool), width, axes, [np.arange(width)] * width)
    for _ in range(30):
        wanted = np.sort(rnd.choice(width, 5, replace=False))
        weights, best = rnd.integers(1, 9, 5).astype(float), lexical.Best(10)
        shard.search(wanted, weights, best)
        scores = table[:, wanted] @ weights
        assert best.score.tolist() == sorted(scores, reverse=True)[:10]
    for term in range(width):
        members, starts, summaries = shard.blocked(term)
        assert sorted(members) == np.flatnonzero(table[:, term]).tolist()
        assert (summaries == [table[members[a:a + lexical.BLOCK]].max(0) for a in starts]).all()


def test_all_are_registered():
    assert {"op11_collisions", "op12_resampling", "op13_search"} <= set(q.QUERIES)
