import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from duotext.functions import truncated_lengths
from duotext.operators import encoding as en

INLINE = {"inline": None, "join": 2}  # tokens looked up in the plan
TEXTS = [
    (1, "The cat  sat", "the dog sat on the mat"), (2, "", "cat"), (3, None, None), (4, "new\twords\nhere", "  the  "),
    (5, "a b c d e f g h i j", "the cat the cat the cat the cat"), (6, "quote \" and \\ slash", "naïve Übung 日本 語"),
]


def words(text):
    return [w for w in re.split(r"\s+", (text or "").lower()) if w]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "row_id long, target string, context string")


@pytest.fixture(scope="module")
def vocab(texts):
    return en.build_vocab(texts, ["target", "context"], 12)


@pytest.fixture(scope="module")
def ids(vocab):
    return {r["token"]: r["id"] for r in vocab.collect()}


def test_vocab(vocab):
    counts = Counter(w for _, a, b in TEXTS for t in (a, b) for w in words(t))
    expected = sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:12]
    got = sorted(vocab.collect(), key=lambda r: r["id"])
    assert [(r["token"], r["n"]) for r in got] == expected
    assert [r["id"] for r in got] == list(range(4, 16))


def drop_longest(a, b, budget):
    a, b = list(a), list(b)
    while len(a) + len(b) > budget:
        (a if len(a) > len(b) else b).pop()
    return a, b


@pytest.mark.parametrize("method", ["inline", "join"])
@pytest.mark.parametrize("length", [9, 12, 64])
def test_encode_pair(texts, vocab, ids, method, length):
    out = {r["row_id"]: r for r in en.encode_pair(texts, vocab, max_length=length, inline=INLINE[method]).collect()}
    for row_id, target, context in TEXTS:
        a, b = drop_longest([ids.get(w, 3) for w in words(target)], [ids.get(w, 3) for w in words(context)], length - 4)
        real = [0, *a, 2, 2, *b, 2]
        assert out[row_id]["input_ids"] == real + [1] * (length - len(real))
        assert out[row_id]["attention_mask"] == [1] * len(real) + [0] * (length - len(real))


@pytest.mark.parametrize("method", ["inline", "join"])
@pytest.mark.parametrize("pad", ["max_length", "longest"])
def test_encode_text(texts, vocab, ids, method, pad):
    df = texts.select("row_id", F.col("context").alias("text"))
    out = {r["row_id"]: r["input_ids"] for r in en.encode_text(df, vocab, max_length=7, pad=pad, inline=INLINE[method]).collect()}
    real = {i: [0, *[ids.get(w, 3) for w in words(t)][:5], 2] for i, _, t in TEXTS}
    length = 7 if pad == "max_length" else max(map(len, real.values()))
    assert out == {i: v + [1] * (length - len(v)) for i, v in real.items()}


def test_large_vocabulary_joins_what_the_plan_misses(texts, vocab):
    small = en.encode_pair(texts, vocab, max_length=16).collect()
    joined = en.encode_pair(texts, vocab, max_length=16, inline=3)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    # what is joined is distinct misses of a chunk; no text is exploded
    assert "Join" in plan and "explode" not in plan and "collect_list" not in plan
    assert sorted(joined.select(*small[0].__fields__).collect()) == sorted(small)


@pytest.mark.parametrize("rows", [1, 2, 100])
def test_chunks_of_any_size_and_a_dictionary_that_is_too_large(texts, vocab, monkeypatch, rows):
    whole = sorted(en.encode_pair(texts, vocab, max_length=16).collect())
    monkeypatch.setattr(en, "CHUNK_ROWS", rows)
    monkeypatch.setattr(en, "DICTIONARY_BYTES", 40)
    cut = en.encode_pair(texts, vocab, max_length=16)
    assert "CoGroup" in cut._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(cut.select(*whole[0].__fields__).collect()) == whole


def test_rows_of_repeated_and_missing_keys_keep_their_ids(spark, vocab):
    df = spark.createDataFrame([(None, "the cat"), (3, "mat zzz"), (4, None), (5, "")], "row_id long, text string")
    out = [en.encode_text(df, vocab, max_length=5, inline=n).orderBy("row_id").collect() for n in (100, 0)]
    assert [r["input_ids"] for r in out[0]] == [r["input_ids"] for r in out[1]]


def test_whole_vocabulary(spark):
    rows = [(" ".join(f"w{i % n}" for i in range(500)),) for n in (3, 50, 400)]
    df = spark.createDataFrame(rows, "text string")
    whole, top = en.build_vocab(df, "text", None), en.build_vocab(df, "text", 400)
    assert sorted(whole.collect()) == sorted(top.collect())


def test_unknown_share(spark):
    df = spark.createDataFrame([([0, 3, 4, 5, 3, 2, 1, 1],), ([0, 2, 1],)], "input_ids array<int>")
    assert en.unknown_share(df).first()[0] == 0.5
    assert en.unknown_share(df.limit(0)).first()[0] == 0.0


def test_inline_encoding_is_a_map(texts, vocab):
    plan = en.encode_pair(texts, vocab)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "Join" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("budget, cases", [
    (8, {(3, 4): (3, 4), (10, 2): (6, 2), (2, 10): (2, 6), (6, 6): (4, 4), (5, 4): (4, 4), (4, 5): (4, 4), (9, 9): (4, 4)}),
    (7, {(6, 6): (4, 3)}),
])
def test_truncation_table(spark, budget, cases):
    df = spark.createDataFrame(list(cases), "a int, b int")
    for r in en.pair_truncation(df, "a", "b", budget).collect():
        assert (r["kept_first"], r["kept_second"]) == cases[r["a"], r["b"]]


@settings(max_examples=5, deadline=None)
@given(budget=st.integers(0, 40))
def test_truncation_is_one_token_at_a_time(budget):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    lengths = [(a, b) for a in range(0, 45, 3) for b in range(0, 45, 2)]
    first, second = truncated_lengths(F.col("a"), F.col("b"), budget)
    for r in spark.createDataFrame(lengths, "a int, b int").select("a", "b", first.alias("x"), second.alias("y")).collect():
        a, b = drop_longest(range(r["a"]), range(r["b"]), budget)
        assert (r["x"], r["y"]) == (len(a), len(b))


@pytest.mark.parametrize("limit", range(6))
def test_first_tokens_are_those_of_the_whole_text(spark, limit):
    from duotext.functions.text import first_tokens, tokens

    texts = ["a b c d", "  a b  c ", "a", "", "   ", None, "a b c", " a\nb\tc d e f g "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select(first_tokens(F.col("t"), limit).alias("x"), tokens(F.col("t")).alias("y")).collect()
    assert all(r["x"] == r["y"][:limit] for r in out)


@pytest.mark.parametrize("size", [1, 7, 30, 64, 65, 1000])
def test_vocab_cut_at_any_band(spark, size):
    # counts 1, 1, 2, 2, 3, 3, ...: every cut falls on or beside a tie
    words_of = [f"w{i:02d}" for i in range(64) for _ in range(i // 2 + 1)]
    df = spark.createDataFrame([(w,) for w in words_of], "text string").repartition(7)
    expected = sorted(Counter(words_of).items(), key=lambda x: (-x[1], x[0]))[:size]
    got = en.build_vocab(df, "text", size).orderBy("id").collect()
    assert [(r["token"], r["n"]) for r in got] == expected
    assert [r["id"] for r in got] == list(range(4, 4 + len(expected)))


def test_vocab_of_nothing(spark):
    assert en.build_vocab(spark.createDataFrame([("",), (None,)], "text string"), "text").count() == 0


def test_memory_of_a_lookup_does_not_grow_with_the_vocabulary():
    """Beyond one number for each token of it, which is not an index of their texts."""
    import pyarrow as pa

    from duotext.operators.encoding import _numbers

    n = 200_000
    tokens, ids = pa.array([f"word {i}" for i in range(n)] + ["word 7"]), pa.array([*range(4, n + 4), 1], pa.int32())
    lists = pa.array([["word 7", "new"], [], None, ["word 199999", "word 7"]])
    usual, pool = pa.default_memory_pool(), pa.proxy_memory_pool(pa.default_memory_pool())
    pa.set_memory_pool(pool)
    try:
        found = _numbers(lists, tokens, ids).to_pylist()
    finally:
        pa.set_memory_pool(usual)
    assert found == [11, None, n + 3, 11]  # the first id of a repeated token
    assert pool.max_memory() < 6 * n
    assert _numbers(lists.slice(1, 2), tokens, ids).to_pylist() == []
