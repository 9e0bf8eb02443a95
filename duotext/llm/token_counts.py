"""Token counts by a transducer compiled from a piece vocabulary (BPE with byte fallback)."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duotext.llm.texts import map_texts

SPACE = "▁"
#: A memo or a state table of more entries than this is emptied and built anew.
MEMO = 400_000
#: Units longer than this are not remembered.
_LONG = 64
_FREE = ""
#: The score of a pair that is no piece.
_NEVER = float("-inf")


def read_pieces(model_path: str) -> dict[str, float]:
    """Ordinary pieces and their scores; the higher one merges first."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ordinary = (i for i in range(model.vocab_size()) if not (
        model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)))
    return {model.id_to_piece(i): model.get_score(i) for i in ordinary}


class Transducer:
    """Reads characters and emits, on each transition, by how much the number of tokens changes.

    The last token of a prefix is unique: of all pieces that end there it is the one that
    stays apart from the token before it when the two are merged alone.  So all that the
    past can still decide is, for each suffix of what was read that begins some piece, the
    token before that suffix and the count up to there.  These lists are the states; they are
    finite in number (pieces are short) and made when first reached.

    No piece has a word character before a space mark, and a character outside all pieces
    never merges.  Both put the transducer into its start state whatever came before.
    """

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.begins = {p[:i] for p in pieces for i in range(1, len(p))}
        self.alphabet = {c for p in pieces for c in p}
        if any(b == SPACE != a for p in pieces for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("pieces with a space mark after another character are not supported")
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple] = [(("", _FREE, 0),)]
        self.number = {self.states[0]: 0}
        self.moves: list[dict[str, tuple[int, int]]] = [{}]
        self.apart: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text, by merging its best pair (leftmost of equals) until none is left."""
        parts, score = list(text), self.pieces.get
        scores = [score(a + b, _NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while scores and (best := max(scores)) != _NEVER:
            i = scores.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            for at in range(max(i - 1, 0), min(i + 1, len(scores))):  # the two pairs that the merged part is in
                scores[at] = score(parts[at] + parts[at + 1], _NEVER)
        return parts

    def follows(self, before: str, token: str) -> bool:
        known = self.apart.get((before, token))
        if known is None:
            known = self.apart[before, token] = self.merged(before + token) == ([before, token] if before else [token])
        return known

    def compile(self, state: int, char: str) -> tuple[int, int]:
        """The move (next state, change of the count) of a state under a character."""
        if char not in self.alphabet:
            move = (0, len(char.encode()))
        else:
            entries = self.states[state]
            if char == SPACE and not (entries[-1][1] or SPACE).endswith(SPACE):
                entries = (("", _FREE, 0),)
            for head, before, count in entries:
                token = head + char
                if (not head or token in self.pieces) and self.follows(before, token):
                    change = count + (1 if token in self.pieces else len(token.encode()))
                    break
            kept = [(h + char, before, count - change) for h, before, count in entries if h + char in self.begins]
            after = (*kept, ("", token, 0))
            if after not in self.number:
                self.number[after] = len(self.states)
                self.states.append(after)
                self.moves.append({})
            move = (self.number[after], change)
        self.moves[state][char] = move
        return move

    def run(self, chunk: str, state: int = 0) -> tuple[int, int]:
        """The state map of a chunk at one entry state: (exit state, tokens emitted)."""
        count, moves = 0, self.moves
        for char in chunk:
            try:
                state, change = moves[state][char]
            except KeyError:
                state, change = self.compile(state, char)
            count += change
        return state, count


class _Units(dict):
    """Chunk without its first space to its number of tokens; what is not remembered is read by the transducer."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine = machine

    def __missing__(self, body: str) -> int:
        count = self.machine.run(SPACE + body.replace(" ", SPACE))[1]
        if len(body) <= _LONG:
            self[body] = count
        return count


class Counter:
    """Tokens of texts.  Chunks are the runs of space marks with what follows them.

    Such a chunk enters in the start state, so its state map is constant and is remembered by
    its text; the maps of a group of documents compose by one prefix sum of their counts.
    """

    def __init__(self, pieces: dict[str, float]):
        self.machine = Transducer(pieces)
        self.memo = _Units(self.machine)

    def count(self, texts: list[str]) -> list[int]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        if len(self.machine.states) > MEMO:
            self.machine.clear()
        chunks: list[int] = []
        ends, unit = [], self.memo.__getitem__
        for text in texts:
            if text:
                marked = " " + text.replace(SPACE, " ")
                bodies = marked[1:].split(" ") if "  " not in marked else [x[1:] for x in re.findall(" +[^ ]*", marked)]
                chunks += map(unit, bodies)
            ends.append(len(chunks))
        scan = np.concatenate(([0], np.cumsum(np.array(chunks, np.int64))))
        return np.diff(scan[[0, *ends]]).tolist()


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_bytes and n_tokens BIGINT, over_limit BOOLEAN (more than ``limit`` tokens).

    The counts are those of the sentencepiece library for a BPE model with byte fallback,
    identity normalisation and a space put in front, without begin and end marks.  NULL and
    empty texts have no token.  The model is read on the driver and travels with the tasks.
    """
    pieces = read_pieces(model_path)

    def make():
        counter = Counter(pieces)
        return lambda texts: (list(map(len, texts)), counter.count([t.decode() for t in texts]))

    made = map_texts(docs, make, "n_bytes bigint, n_tokens bigint", keep)
    return made.withColumn("over_limit", F.col("n_tokens") > limit)
