"""Byte-level BPE: corpus-level merge replay, and its inverse."""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections import defaultdict
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise

import regex
from pyspark.sql import DataFrame

from duotext.llm.texts import map_texts

#: Words whose ids are remembered within a task.
MEMO = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with a base64 token and a rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class MergeReplay:
    """Encodes many distinct words at once.

    All words lie in one chain of symbols.  An index holds, for each rank, the positions
    where a pair of that rank stands; ranks come from a heap in ascending order, and a merge
    touches its positions and their two neighbours only.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.after: list[dict[int, int]] = [{} for _ in range(max(ranks.values()) + 1)]

    def rank(self, left: int, right: int) -> int:
        """The rank of a pair, or -1; remembered in ``after[left][right]``."""
        found = self.after[left][right] = self.ranks.get(self.bytes_of[left] + self.bytes_of[right], -1)
        return found

    def alone(self, word: bytes) -> list[int]:
        """One word by itself: the lowest rank, leftmost of equals, until no pair has one."""
        parts = [self.single[b] for b in word]
        while True:
            found = [(r, i) for i in range(len(parts) - 1) if (r := self.rank(parts[i], parts[i + 1])) >= 0]
            if not found:
                return parts
            r, i = min(found)
            parts[i:i + 2] = [r]

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word.  A word that is a token is that token."""
        done = [[self.ranks[w]] if w in self.ranks else None for w in words]
        todo = [i for i, ids in enumerate(done) if ids is None and words[i]]
        symbols: list[int] = []
        after: list[int] = []  # the next position of the word, or -1
        before: list[int] = []
        at: dict[int, list[int]] = defaultdict(list)
        single, rank, follow = self.single, self.rank, self.after
        starts = []
        for i in todo:
            base, word = len(symbols), words[i]
            starts.append(base)
            symbols += (own := [single[b] for b in word])
            before += (-1, *range(base, base + len(word) - 1))
            after += (*range(base + 1, base + len(word)), -1)
            for left, right in pairwise(own):
                if (r := follow[left].get(right)) is None:
                    r = rank(left, right)
                if r >= 0:
                    at[r].append(base)
                base += 1
        heap, odd = list(at), set()
        heapify(heap)
        while heap:
            now = heappop(heap)
            after_now = follow[now]
            for p in sorted(at.pop(now)):
                q = after[p]
                if q < 0 or (left := symbols[p]) < 0 or follow[left].get(symbols[q]) != now:
                    continue  # the pair has gone meanwhile, or was listed twice
                symbols[p], symbols[q] = now, -1
                after[p] = beyond = after[q]
                if beyond >= 0:
                    before[beyond] = p
                    right = symbols[beyond]
                    if (r := after_now.get(right)) is None:
                        r = rank(now, right)
                    if r >= 0:
                        if r < now:  # earlier than others of this rank in its word: that word goes by itself
                            odd.add(p)
                        if r not in at:
                            heappush(heap, r)
                        at[r].append(p)
                if (ahead := before[p]) >= 0:
                    left = symbols[ahead]
                    if (r := follow[left].get(now)) is None:
                        r = rank(left, now)
                    if r >= 0:
                        if r < now:
                            odd.add(p)
                        if r not in at:
                            heappush(heap, r)
                        at[r].append(ahead)
        alone = {bisect_right(starts, p) - 1 for p in odd}
        for n, (i, p) in enumerate(zip(todo, starts, strict=True)):
            if n in alone:
                done[i] = self.alone(words[i])
                continue
            ids = []
            while p >= 0:
                ids.append(symbols[p])
                p = after[p]
            done[i] = ids
        return [ids or [] for ids in done]


class Codec:
    """Texts to ids and back; remembers the ids of words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.replay, self.words, self.memo = MergeReplay(ranks), regex.compile(pattern), {}

    def encode(self, texts: list[bytes]) -> list[list[int]]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        split = [self.words.findall(t.decode()) for t in texts]
        new = list({w for words in split for w in words} - self.memo.keys())
        self.memo.update(zip(new, map(tuple, self.replay.encode([w.encode() for w in new])), strict=True))
        ids = self.memo.__getitem__
        return [list(chain.from_iterable(map(ids, words))) for words in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.replay.bytes_of.__getitem__, ids))


def encode(docs: DataFrame, ranks_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``ids`` ARRAY<INT>: the ids of each text; none for an empty or NULL one.

    The pattern cuts a text into words; each is encoded by itself, special tokens are
    ordinary text.  Words that a group of texts has and the task has not met yet are
    encoded together.
    """
    ranks = read_ranks(ranks_path)

    def make():
        codec = Codec(ranks, pattern)
        return lambda texts: [codec.encode(texts)]

    return map_texts(docs, make, "ids array<int>", keep)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """``keep``, n_tokens BIGINT, ids_sha256 (of the decimal ids joined by a space), decoded_sha256 (of the bytes
    that the ids decode to), and on request ``ids``."""
    ranks = read_ranks(ranks_path)

    def make():
        codec = Codec(ranks, pattern)
        names = {rank: str(rank) for rank in ranks.values()}
        digest = lambda data: hashlib.sha256(data).hexdigest()

        def work(texts: list[bytes]):
            ids = codec.encode(texts)
            shown = [digest(" ".join([names[i] for i in x]).encode()) for x in ids]
            out = [list(map(len, ids)), shown, [digest(codec.decode(x)) for x in ids]]
            return [*out, ids] if with_ids else out

        return work

    added = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_texts(docs, make, added, keep)
