"""Quality rules on repetition inside a text, from suffix arrays over its words."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duotext.llm.texts import map_texts

WINDOW = 5
_SPACE, _SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"


def longest_repeats(codes: np.ndarray) -> np.ndarray:
    """For each position the length of the longest run of codes from it on that also starts elsewhere.

    A suffix array by prefix doubling, which sorts only what is still equal.  Two
    neighbours' common prefix is read off the ranks of the doubling steps, from the
    largest step down; of the LCP intervals around a position the innermost is the longer
    of the two neighbours' values.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    _, first, size = np.unique(codes, return_inverse=True, return_counts=True)
    rank = np.concatenate((np.cumsum(size) - size, [-1]))[first]
    levels = []
    active = np.flatnonzero(size[first] > 1)
    step = 1
    while len(active):
        levels.append((step, rank.copy()))
        ahead = active + step
        key = (rank[active] << 32) | np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        group = np.concatenate(([True], key[1:] >> 32 != key[:-1] >> 32))
        index = np.arange(len(key))
        own = np.maximum.accumulate(np.where(new, index, 0))
        rank[active] = (key >> 32) + own - np.maximum.accumulate(np.where(group, index, 0))
        single = new & np.concatenate((new[1:], [True]))
        active = active[~single]
        step *= 2
    array = np.empty(n, np.int64)
    array[rank] = np.arange(n)
    left, right = array[:-1].copy(), array[1:].copy()
    common = np.zeros(n - 1, np.int64)
    live = np.arange(n - 1)
    for step, ranks in reversed(levels):
        inside = live[(left[live] < n) & (right[live] < n)]
        same = inside[ranks[left[inside]] == ranks[right[inside]]]
        common[same] += step
        left[same] += step
        right[same] += step
    best = np.zeros(n, np.int64)
    best[array[:-1]] = common
    best[array[1:]] = np.maximum(best[array[1:]], common)
    return best


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in one of the spans."""
    edges = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(edges[:n]) > 0


def measure(texts: list[bytes], span: int = 8) -> list[list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, longest_repeat of each text.

    All texts share one suffix array; a word has another code in each text, which keeps
    repeats inside.
    """
    seen: dict[bytes, int] = {}
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    ends = np.cumsum(sizes + 1)
    codes = np.empty(int(ends[-1]) if len(texts) else 0, np.int64)
    for i, (words, size, end) in enumerate(zip(split, sizes.tolist(), ends.tolist(), strict=True)):
        codes[end - 1 - size:end - 1] = [seen.setdefault(w, len(seen)) for w in words]
        codes[end - 1 - size:end - 1] += i << 32
    codes[ends - 1] = -1 - np.arange(len(texts))
    best, n = longest_repeats(codes), len(codes)
    repeated, long = np.flatnonzero(best >= WINDOW), np.flatnonzero(best >= span)
    in_window = _covered(repeated, np.full(len(repeated), WINDOW), n)
    in_span = _covered(long, best[long], n)
    total = lambda flags: np.add.reduceat(flags.astype(np.int64), ends - sizes - 1).tolist() if n else []
    bare = [t.translate(None, _SPACE) for t in texts]
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    return [
        sizes.tolist(), [len(b.decode()) for b in bare], [len(b) - len(b.translate(None, _SYMBOLS)) for b in bare],
        [len(x) - len(set(x)) for x in lines], total(in_window), total(in_span),
        np.maximum.reduceat(best, ends - sizes - 1).tolist() if n else [],
    ]


def quality_rules(
    docs: DataFrame, span: int = 8, covered_percent: int = 20, longest: int = 100, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """``keep``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words BIGINT, base_failed, kept BOOLEAN,
    covered_words, longest_repeat BIGINT.

    base_failed: fewer than 10 words, or over 20 % of them in 5-word windows that recur.
    kept: not base_failed, at most ``covered_percent`` of the words inside maximal repeated
    runs of ``span`` words or more, and no such run of over ``longest`` words.  NULL and empty
    texts have no word and fail.
    """
    made = map_texts(
        docs, lambda: lambda texts: measure(texts, span),
        "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
        "covered_words bigint, longest_repeat bigint", keep,
    )
    n = F.col("n_words")
    failed = (n < 10) | (100 * F.col("n_repeat_words") > 20 * n)
    fine = (100 * F.col("covered_words") <= covered_percent * n) & (F.col("longest_repeat") <= longest)
    return made.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fine)
