"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax."""

from __future__ import annotations

import mmap
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duotext.llm.texts import groups, map_texts, shared_copy, stored, training_row

#: Classes of words; tokens looked at together; features of a context.
CLASSES, BATCH, FEATURES = 32, 8192, 5
#: Rows of weights for each hashed feature: one for so many training tokens, between bounds that keep the weights under 26 MB.
TOKENS_A_SLOT, LEAST_SLOTS, MOST_SLOTS = 64, 1 << 12, 1 << 16
#: Tokens that a context counts for before any was seen, at the frequencies of the classes.
PRIOR = 20.0
#: Share of a whole step that every weight takes along its gradient, and tokens at the frequencies of the classes that damp it.
RATE, DAMPING = 0.2, 50.0
#: Stored tokens that are looked at together, and those whose contexts are made at a time.
PIECE, _PART = 1 << 19, 1 << 16
#: Words that tasks look up in memory; their counts cover most tokens, the others are joined.
DICTIONARY = 1 << 18
#: Words with their counts that a task holds before it adds them up.
MEMO = 1_000_000
#: Words with their counts in one record batch on their way out of a task.
_SENT = 1 << 16
END = b""
_PAIRS = CLASSES * CLASSES
_ONES = np.ones(CLASSES, np.float32)
#: Exponentials of numbers nearer to 0, and the sum of those of all classes, keep the precision of 32 bits.
_SAFE = 80
#: Weight rows that travel in one record.
_BLOCK = 1024
#: Tokens that 32 bits can count.
_ROOM = (1 << 32) - 1
#: Tasks whose changes are added up at a time.
_FAN = 64
#: Tokens judged at a time in the training, and those whose shares are then added up by context; sums travel as whole multiples of 1 / _UNIT.
_STEP, _SHARES, _UNIT = 2048, 1 << 14, 1 << 12


def slots_for(tokens: int) -> int:
    """Rows of a hashed feature: a power of two that grows with the training tokens."""
    slots = LEAST_SLOTS
    while slots < MOST_SLOTS and slots * TOKENS_A_SLOT < tokens:
        slots *= 2
    return slots


def rows_of(slots: int) -> np.ndarray:
    """First weight row of: bias, word before, both words before, the word before that one, classes before, skipped classes; and the end."""
    return np.cumsum([0, 1, slots, slots, slots, _PAIRS, _PAIRS])


def word_class(word: bytes) -> int:
    """Short words by themselves, others by their ending; hashed."""
    return zlib.crc32(word if len(word) <= 3 else word[-2:]) % CLASSES


def _zeros(height: int, kind: type) -> np.ndarray:
    """A large table by class, in pages of its own: they are taken when written to and go back to the system with the table."""
    pages = mmap.mmap(-1, int(height) * CLASSES * np.dtype(kind).itemsize, flags=mmap.MAP_PRIVATE | mmap.MAP_ANONYMOUS)
    return np.frombuffer(pages, kind).reshape(-1, CLASSES)


def _before(values: np.ndarray, place: np.ndarray, n: int, fill: int) -> np.ndarray:
    """The value n positions earlier, ``fill`` where that is before the text."""
    shifted = np.empty_like(values)
    shifted[:n], shifted[n:] = fill, values[:-n]
    shifted[place < n] = fill
    return shifted


def contexts(hashes: np.ndarray, classes: np.ndarray, bounds: np.ndarray, slots: int) -> list[np.ndarray]:
    """The slot of each feature of all tokens, of texts that begin at ``bounds`` (the end of all included)."""
    place = np.arange(len(hashes), dtype=np.int32) - np.repeat(bounds[:-1], np.diff(bounds)).astype(np.int32)
    end, end_class = np.uint32(zlib.crc32(END)), word_class(END)
    first, second = (_before(hashes, place, n, end) for n in (1, 2))
    kinds = [_before(classes, place, n, end_class) for n in (1, 2, 3)]
    both = (first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second) >> np.uint64(20)
    found = [h.astype(np.uint32) % np.uint32(slots) for h in (first, both, second)]
    found += [kinds[0] * CLASSES + kinds[1], kinds[2] * CLASSES + kinds[0]]
    return [x.astype(np.uint16) for x in found]


def split_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts, A-Z lower-cased; how many each text has).  White space is exactly \\x20 \\x09-\\x0D."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.binary()).view(pa.string())))
    flat = split.flatten().view(pa.binary())
    full = pc.binary_length(flat).to_numpy() > 0  # white space at either end of a text leaves an empty word
    before = np.concatenate(([0], np.cumsum(full)))
    return flat.filter(pa.array(full)), np.diff(before[split.offsets.to_numpy()])


def number_tokens(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]:
    """(words, first position of each text and the end of all, numbers of all tokens, the distinct tokens by number)."""
    words, sizes = split_words(texts)
    bounds = np.concatenate(([0], np.cumsum(sizes + 1)))
    numbers, inside = np.zeros(bounds[-1], np.int64), np.ones(bounds[-1], bool)
    inside[bounds[1:] - 1] = False
    coded = words.dictionary_encode()
    numbers[inside] = coded.indices.to_numpy() + 1
    return words, bounds, numbers, pa.concat_arrays([pa.array([END], pa.binary()), coded.dictionary])


def _plain(words: pa.Array) -> list[bytes]:
    return words.to_numpy(zero_copy_only=False).tolist()


def _hashes(words: pa.Array) -> np.ndarray:
    return np.array(list(map(zlib.crc32, _plain(words))), np.uint32)


def _classes(words: pa.Array) -> np.ndarray:
    """``word_class`` of many words: each short word and ending is hashed once."""
    endings = pc.if_else(pc.less_equal(pc.binary_length(words), 3), words, pc.binary_slice(words, -2)).dictionary_encode()
    return np.array(list(map(word_class, _plain(endings.dictionary))), np.int32)[endings.indices.to_numpy()]


def by_hash(words: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(hashes, words, counts) of a table (word, c), by hash: arrays take a fraction of the room of a dictionary of Python objects."""
    spelled = words["word"].combine_chunks().cast(pa.binary())
    hashes = _hashes(spelled)
    order = np.argsort(hashes, kind="stable")
    return hashes[order], spelled.take(pa.array(order)), words["c"].to_numpy()[order]


class Reader:
    """Turns texts into hashes and classes of all their tokens, in numpy arrays."""

    def __init__(self, known: tuple[np.ndarray, pa.Array, np.ndarray] | None = None):
        """``known``: what ``by_hash`` makes of the dictionary."""
        self.known = known

    def _counts(self, distinct: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """How often each word occurs, NaN if it is not in the dictionary."""
        found = np.full(len(distinct), np.nan)
        if self.known is None:
            return found
        known, spelled, counts = self.known
        at, end = (np.searchsorted(known, hashes, side) for side in ("left", "right"))
        left = np.flatnonzero(at < end)
        while len(left):  # again only for words whose hash is that of several others
            same = pc.equal(distinct.take(pa.array(left)), spelled.take(pa.array(at[left]))).to_numpy(zero_copy_only=False)
            found[left[same]] = counts[at[left[same]]]
            at += 1
            left = left[~same]
            left = left[at[left] < end[left]]
        return found

    def read(self, texts: list[bytes]):
        """(words, first position of each text and the end of all, hashes, classes, log10(count + 0.5) or NaN: not in the dictionary)."""
        words, bounds, numbers, distinct = number_tokens(texts)
        hashes = _hashes(distinct)
        return words, bounds, hashes[numbers], _classes(distinct)[numbers], np.log10(self._counts(distinct, hashes) + 0.5)[numbers]


def read_training(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts, read once: their tokens, stored for all passes of the training, and the counts of their words.

    Tokens: (hashes ARRAY<INT>, classes ARRAY<TINYINT>), one row per text.  Counts: (word BINARY, class INT, c BIGINT) of
    all tokens, one end per text; added up within tasks before the shuffle.
    """
    lists = [pa.list_(pa.int32()), pa.list_(pa.int8())]
    schema = pa.schema(zip(["hashes", "classes", "word", "class", "c"], [*lists, pa.binary(), pa.int32(), pa.int64()], strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[pa.Table] = []

        def counted() -> Iterator[pa.RecordBatch]:
            if seen:
                sums = pa.concat_tables(seen).group_by("word", use_threads=False).aggregate([("c", "sum")]).combine_chunks()
                seen.clear()
                for part in sums.to_batches(_SENT):
                    empty = [pa.nulls(len(part), t) for t in lists]
                    yield pa.RecordBatch.from_arrays([*empty, part["word"], pa.array(_classes(part["word"])), part["c_sum"]], schema=schema)

        for batch in batches:
            for _, part in groups(batch, "text"):
                _, bounds, numbers, distinct = number_tokens(part)
                ends, values = pa.array(bounds, pa.int32()), (_hashes(distinct)[numbers].view(np.int32), _classes(distinct)[numbers].astype(np.int8))
                made = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in values]
                yield pa.RecordBatch.from_arrays(made + [pa.nulls(len(part), f.type) for f in list(schema)[2:]], schema=schema)
                seen.append(pa.table({"word": distinct, "c": pa.array(np.bincount(numbers, minlength=len(distinct)))}))
                if sum(map(len, seen)) > MEMO:
                    yield from counted()
        yield from counted()

    added = "hashes array<int>, classes array<tinyint>, word binary, class int, c bigint"
    both = shared_copy(texts.select("text").mapInArrow(run, added), "tokens")
    counts = both.where(F.col("c").isNotNull()).groupBy("word", "class").agg(F.sum("c").alias("c"))
    return both.where(F.col("hashes").isNotNull()).select("hashes", "classes"), counts


def tokens_of(texts: DataFrame) -> DataFrame:
    """(hashes ARRAY<INT>, classes ARRAY<TINYINT>): the tokens of each text."""
    return read_training(texts)[0]


def _read_tokens(batches: Iterator[pa.RecordBatch], slots: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(slots by feature, classes) of some texts at a time, about ``PIECE`` tokens or one text."""
    for batch in batches:
        ends = batch.column(0).offsets.to_numpy().astype(np.int64)
        after = lambda start, most: max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1)  # noqa: B023, E731
        start = 0
        while start < len(batch):
            stop, found, own = after(start, PIECE), [], []
            while start < stop:
                part = min(stop, after(start, _PART))
                hashes, classes = (batch.column(i).slice(start, part - start).flatten().to_numpy() for i in (0, 1))
                own.append(classes.astype(np.int32))
                found.append(contexts(hashes.view(np.uint32), own[-1], ends[start:part + 1] - ends[start], slots))
                start = part
            yield [np.concatenate(x) for x in zip(*found, strict=True)], np.concatenate(own)
    pa.default_memory_pool().release_unused()


def _scores(weights: np.ndarray, rows: np.ndarray, slots: list[np.ndarray], part: slice) -> np.ndarray:
    """Unnormalised log probabilities of all classes for some tokens, none too large to exponentiate."""
    scores = weights[rows[1]:rows[2]].take(slots[0][part], 0)
    for base, end, slot in zip(rows[2:-1], rows[3:], slots[1:], strict=True):
        scores += weights[base:end].take(slot[part], 0)
    scores += weights[0]
    return _below_top(scores)


def _below_top(scores: np.ndarray) -> np.ndarray:
    """Log probabilities, shifted by token where exponentials could otherwise leave the range of 32 bits."""
    if -_SAFE < scores.min(initial=0) and scores.max(initial=0) < _SAFE:
        return scores
    top = scores
    while top.shape[1] > 1:  # the maximum by halves; the number of classes is a power of two
        half = top.shape[1] // 2
        top = np.maximum(top[:, :half], top[:, half:])
    scores -= top
    return scores


def class_shares(weights: np.ndarray, rows: np.ndarray, slots: list[np.ndarray], part: slice) -> np.ndarray:
    """Probabilities of all classes for some tokens."""
    shares = _scores(weights, rows, slots, part)
    np.exp(shares, out=shares)
    shares /= (shares @ _ONES)[:, None]
    return shares


def log_shares(weights: np.ndarray, rows: np.ndarray, slots: list[np.ndarray], classes: np.ndarray) -> np.ndarray:
    """Log probabilities of the tokens' own classes."""
    out = np.empty(len(classes))
    for at in range(0, len(classes), BATCH):
        part = slice(at, at + BATCH)
        scores = _scores(weights, rows, slots, part)
        own = scores[np.arange(len(scores)), classes[part]]
        out[part] = own - np.log(np.exp(scores, out=scores) @ _ONES)
    return out


class Slopes:
    """Gradient and second derivatives of the log-likelihood by the scale of each feature, summed over tokens.

    ``weights`` are unscaled.  Each token is judged by what all others say: its own count is
    taken out of the weights of its contexts, else every context would seem to know its words.
    With ``expect`` the probabilities are also summed by weight row and class: what the model expects where
    the texts have their counts.  The counts less these are the gradient of the log-likelihood by every single weight.
    """

    def __init__(self, weights: np.ndarray, scales: np.ndarray, rows: np.ndarray, expect: bool = False):
        heights = [*np.diff(rows)[:-2], CLASSES * _PAIRS]
        self.sums = [_zeros(height, np.float64) for height in heights] if expect else None
        self.weights, self.scales, self.rows = weights, scales.astype(np.float32), rows
        self.prior = (PRIOR * np.exp(weights[0])).astype(np.float32)  # a class's share of the prior tokens
        self.first, self.second, self.tokens = np.zeros(FEATURES), np.zeros((FEATURES, FEATURES)), 0

    def add(self, slots: list[np.ndarray], classes: np.ndarray) -> None:
        for start in range(0, len(classes), _SHARES):
            part = slice(start, start + _SHARES)
            self._add([s[part] for s in slots], classes[part])

    def expected(self) -> list[np.ndarray]:
        """What the model expects: tables that, one below the other, have the weight rows."""
        bias, *words, kinds = self.sums
        # three classes before fix both pairs: (before and the one before that), (skipped and before)
        kinds = kinds.reshape(CLASSES, CLASSES, CLASSES, CLASSES)
        return [bias, *words, kinds.sum(0).reshape(_PAIRS, CLASSES), kinds.sum(2).reshape(_PAIRS, CLASSES)]

    def _expect(self, slots: list[np.ndarray], shares: np.ndarray) -> None:
        self.sums[0] += shares.sum(0, dtype=np.float64)
        pairs = shares.astype(np.float64).view(np.complex128).ravel()  # two classes are added at once
        kinds = slots[4].astype(np.int64) * CLASSES + slots[3] % CLASSES
        for total, slot in zip(self.sums[1:], (*slots[:3], kinds), strict=True):
            cells = slot.astype(np.int64)[:, None] * (CLASSES // 2) + np.arange(CLASSES // 2)
            np.add.at(total.view(np.complex128).ravel(), cells.ravel(), pairs)

    def _add(self, slots: list[np.ndarray], classes: np.ndarray) -> None:
        every_share = None if self.sums is None else np.empty((len(classes), CLASSES), np.float32)
        for at in range(0, len(classes), _STEP):
            own = classes[at:at + _STEP]
            every, prior = np.arange(len(own)), self.prior[own]
            says = np.empty((FEATURES, len(own), CLASSES), np.float32)
            for value, base, end, slot in zip(says, self.rows[1:-1], self.rows[2:], slots, strict=True):
                value[:] = self.weights[base:end].take(slot[at:at + _STEP], 0)
            # a weight is log((count + prior) / prior)
            counted = np.maximum(np.exp(says[:, every, own]) * prior - 1, prior)
            said = np.log(counted / prior)
            says[:, every, own] = said
            scores = (self.scales @ says.reshape(FEATURES, -1)).reshape(-1, CLASSES)
            scores += self.weights[0]
            shares = np.exp(_below_top(scores), out=scores)
            shares /= (shares @ _ONES)[:, None]
            if every_share is not None:
                every_share[at:at + _STEP] = shares
            pulls = shares * says
            means = pulls @ _ONES
            self.first += (said - means).sum(1, dtype=np.float64)
            for i in range(FEATURES):
                for j in range(i + 1):
                    both = float(np.vdot(pulls[i], says[j])) - float(np.vdot(means[i], means[j]))
                    self.second[i, j] += both
                    self.second[j, i] += both * (i != j)
            self.tokens += len(own)
        if every_share is not None:
            self._expect(slots, every_share)


def _packed(block: np.ndarray) -> bytes:
    """INT64 values with their lowest bytes first, then the next, as far as any value needs them; how many bytes of a value, before all."""
    planes = np.ascontiguousarray(block, np.int64).view(np.uint8).reshape(-1, 8).T
    needed = 1 + max(np.flatnonzero(planes.any(1)), default=0)
    return bytes([needed]) + planes[:needed].tobytes()


def _unpacked(data: bytes | pa.Buffer, size: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8)
    values = np.zeros((size, 8), np.uint8)
    values[:, :planes[0]] = planes[1:].reshape(planes[0], -1).T
    return values.view(np.int64).ravel()


def _blocks(tables: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Numbered blocks of ``_BLOCK`` rows of tables one below the other, which are never copied into one."""
    ends = np.cumsum([len(t) for t in tables])
    for block, start in enumerate(range(0, int(ends[-1]), _BLOCK)):
        yield block, np.concatenate([t[max(start + len(t) - end, 0):max(start + _BLOCK + len(t) - end, 0)] for t, end in zip(tables, ends, strict=True)])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One record per block: the sums of its records."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, size, counts in zip(batch["block"].to_pylist(), batch["size"].to_pylist(), batch["counts"], strict=True):
            new = _unpacked(counts.as_buffer(), size)
            if block in sums:
                sums[block] += new
            else:
                sums[block] = new
    while sums:
        yield _record(*sums.popitem())


def _record(block: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([counts.size], pa.int32()), pa.array([_packed(counts)], pa.binary())], ["block", "size", "counts"])


_COUNTS = "block int, size int, counts binary"


def _summed_rows(tokens: DataFrame, height: int, of_task: Callable[[Iterator[pa.RecordBatch]], list[np.ndarray]], unit: int = 1) -> np.ndarray:
    """The sum over all tasks of ``of_task``: tables of ``height`` rows in all, one column per class, in whole multiples of 1 / ``unit``.

    Tasks' rows meet in blocks, first those of some ``_FAN`` tasks each, then all of a block,
    level by level, so that no task reads those of all tasks at once.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, total in _blocks(of_task(batches)):
            whole = np.rint(total * unit) if unit > 1 else total
            if whole.any():
                yield _record(block, whole.astype(np.int64))

    counted = tokens.mapInArrow(count, _COUNTS)
    tasks = tokens.rdd.getNumPartitions()
    while tasks > _FAN:
        tasks = -(-tasks // _FAN)
        counted = counted.withColumn("part", F.spark_partition_id() % tasks).repartition("block", "part").mapInArrow(_added, _COUNTS)
    out = np.zeros((height, CLASSES), np.int64 if unit == 1 else np.float64)
    records = counted.repartition("block").mapInArrow(_added, _COUNTS).collect()
    while records:  # what has been copied is released
        block, size, counts = records.pop()
        found = _unpacked(counts, size).reshape(-1, CLASSES)
        out[block * _BLOCK:block * _BLOCK + len(found)] = found if unit == 1 else found / unit
    return out


def count_contexts(tokens: DataFrame, slots: int) -> np.ndarray:
    """How often each class follows each context, by weight row: the part of the gradient that the texts fix, of all tokens."""
    rows = rows_of(slots)

    def count(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
        total, room = _zeros(rows[-1], np.uint32).ravel(), _ROOM  # of 32 bits, until there are more tokens than they can count
        for found, classes in _read_tokens(batches, slots):
            room -= len(classes)
            if room < 0:
                total = total.astype(np.uint64, copy=False)
            one = total.dtype.type(1)
            total[:CLASSES] += np.bincount(classes, minlength=CLASSES).astype(total.dtype)
            for base, slot in zip(rows[1:-1], found, strict=True):
                np.add.at(total, (slot.astype(np.int64) + base) * CLASSES + classes, one)
        return [total.reshape(-1, CLASSES)]

    return _summed_rows(tokens, rows[-1], count)


def _summed_slopes(tokens: DataFrame, weights: np.ndarray, scales: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """``Slopes`` of all texts; a task sends 30 numbers."""
    shipped, rows = tokens.sparkSession.sparkContext.broadcast(weights), rows_of(slots)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slopes = Slopes(shipped.value, scales, rows)
        for found, classes in _read_tokens(batches, slots):
            slopes.add(found, classes)
        values = np.concatenate([slopes.first, slopes.second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], ["at", "value"])

    found = tokens.mapInArrow(learn, "at int, value double").groupBy("at").agg(F.sum("value")).collect()
    values = np.zeros(FEATURES * (FEATURES + 1))
    for at, value in found:
        values[at] = value
    shipped.destroy()
    return values[:FEATURES], values[FEATURES:].reshape(FEATURES, FEATURES)


def expected_contexts(tokens: DataFrame, weights: np.ndarray, scales: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``Slopes`` of all texts with the expected counts of each weight row: (first, second, expected)."""
    shipped, rows = tokens.sparkSession.sparkContext.broadcast(weights), rows_of(slots)
    n = FEATURES * (FEATURES + 1)

    def learn(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
        slopes = Slopes(shipped.value, scales, rows, expect=True)
        for found, classes in _read_tokens(batches, slots):
            slopes.add(found, classes)
        last = np.zeros((1, CLASSES))  # a row more, for the slopes
        last[0, :n] = np.concatenate([slopes.first, slopes.second.ravel()])
        return [*slopes.expected(), last]

    found = _summed_rows(tokens, rows[-1] + 1, learn, _UNIT)
    shipped.destroy()
    return found[-1, :FEATURES], found[-1, FEATURES:n].reshape(FEATURES, FEATURES), found[:-1]


def _parts(height: int) -> Iterator[slice]:
    """All weight rows, some at a time: what the driver computes on the way from one table to another takes no room of their size."""
    for start in range(0, height, _BLOCK):
        yield slice(start, start + _BLOCK)


def train(texts: DataFrame, class_counts: np.ndarray, rounds: int = 2) -> tuple[np.ndarray, int]:
    """``learn`` from texts."""
    return learn(tokens_of(texts), class_counts, rounds)


def learn(tokens: DataFrame, class_counts: np.ndarray, rounds: int = 2) -> tuple[np.ndarray, int]:
    """(weight rows by class, slots), from the tokens of all texts.

    The bias is the log frequency of the classes.  Each context's weights start from one damped gradient step, in
    closed form: observed less expected counts over the expected ones, as a logarithm.  As features
    overlap, each has a scale, learned in ``rounds`` passes: every pass sums the gradient and second derivatives of the scales
    over all tasks and makes one Newton step.  The last pass sums the gradient of every single weight as well, its observed
    counts less those that the model expects, and all weights take a step along it.  All sums are over all texts, so neither
    partitions nor their number matter.
    """
    total = class_counts.sum()
    slots = slots_for(int(total))
    prior = (class_counts + 0.5) / (class_counts + 0.5).sum()
    exact = count_contexts(tokens, slots)
    weights, counts = np.empty(exact.shape, np.float32), np.empty(exact.shape, np.float32)
    for part in _parts(len(exact)):
        weights[part], counts[part] = np.log1p(exact[part] / (PRIOR * prior)), exact[part]
    del exact  # the last step needs no more than 24 bits of them
    weights[0] = np.log(prior)
    scales, expected = np.full(FEATURES, 0.3), counts
    for left in reversed(range(rounds if total else 0)):
        if left:
            first, second = _summed_slopes(tokens, weights, scales, slots)
        else:
            first, second, expected = expected_contexts(tokens, weights, scales, slots)
        step = np.linalg.lstsq(second + 1e-6 * np.eye(FEATURES), first, rcond=None)[0]
        scales = np.round(np.clip(scales + np.clip(step, -1, 1), 0, 2), 6)
    rows = rows_of(slots)
    for base, end, scale in zip(rows[1:-1], rows[2:], scales, strict=True):
        weights[base:end] *= np.float32(scale)
    damping = DAMPING * prior
    for part in _parts(len(weights)):
        weights[part] += (RATE * np.log((counts[part] + damping) / (expected[part] + damping))).astype(np.float32)
    return weights, slots


def _dictionary(counts: DataFrame, most: int) -> int:
    """The least count whose words are at most ``most``, to a sixteenth of a doubling, from a histogram of the counts."""
    step = F.floor(16 * F.log2("c")).cast("int")
    bins = sorted(counts.groupBy(step.alias("b")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect(), reverse=True)
    total, least = 0, 1 << 62
    for _, n, c in bins:
        total += n
        if total > most:
            break
        least = c
    return least


def score(docs: DataFrame, rounds: int = 2, dictionary: int = DICTIONARY, fold: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per document.

    Tokens: the words, A-Z lower-cased, and an end; NULL texts are empty.  Training texts are
    those whose crc32(doc_id as text) modulo 5 is not ``fold`` (NULL ids train too).
    base_score: smoothed unigram log10 probability.  score: log10 of
    P(class | context) * P(word | class), where the class given the context is a softmax over
    hashed features (the word before, both before, the one skipped to, and pairs of classes),
    and the word given its class is its smoothed relative frequency; words never seen share
    one place in each class, so that the probabilities of a position add up to 1.

    Counts cover all training tokens.  The weights (up to 26 MB, by the size of the corpus) and the commonest words (at
    most ``dictionary``) are broadcast.  Other tokens are joined to the table of counts by
    word, and their logs are summed by document; no text is shuffled.  Without any training
    text the table of counts is empty and all words share one place.
    """
    spark = docs.sparkSession
    training = docs.where(training_row(F.col("doc_id"), fold))
    tokens_read, counted = read_training(training)
    counts = stored(counted)
    sums = counts.groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    tokens, distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for k, n, v in sums:
        tokens[k], distinct[k] = n, v
    total, vocabulary = int(tokens.sum()), int(distinct.sum())
    weights, slots = learn(tokens_read, tokens, rounds)
    rows = rows_of(slots)
    least = _dictionary(counts, dictionary)
    common = counts.where(F.col("c") >= least).select("word", "c").toArrow()
    shipped = spark.sparkContext.broadcast((by_hash(common), weights))
    inside = np.log10(tokens + 0.5 * (distinct + 1))
    unigram = float(np.log10(total + 0.5 * (vocabulary + 1)))

    def make():
        known, learned = shipped.value
        reader = Reader(known)

        def work(texts: list[bytes]):
            words, bounds, hashes, classes, logs = reader.read(texts)
            found = contexts(hashes, classes, bounds, slots)
            value = log_shares(learned, rows, found, classes) / np.log(10) - inside[classes]
            in_dictionary = ~np.isnan(logs)
            per_text = lambda x: np.add.reduceat(x, bounds[:-1]).tolist()
            rare = np.flatnonzero(~in_dictionary)
            cut = np.searchsorted(rare, bounds)
            text = np.repeat(np.arange(len(texts)), np.diff(cut))
            spelled = words.take(pa.array(rare - text, mask=rare == bounds[text + 1] - 1))  # NULL: the end of a text
            others = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pc.fill_null(spelled, END))
            return np.diff(bounds).tolist(), per_text(value), per_text(np.where(in_dictionary, logs, 0.0)), per_text(in_dictionary.astype(np.int64)), others

        return work

    keyed = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    read = map_texts(keyed, make, "n bigint, value double, logs double, known bigint, rare array<binary>", ("doc_id", "row"))
    # one record of the document itself (its word can't be one: it holds a line end) and one per token to join
    itself = F.encode(F.concat(F.lit("\n"), F.col("row").cast("string")), "utf-8")
    spread = read.withColumn("word", F.explode(F.concat(F.array(itself), "rare")))
    own = F.col("word") == itself
    spread = spread.select(
        "row", "word", own.alias("own"), *[F.when(own, F.col(c)).alias(c) for c in ("doc_id", "n", "value", "logs", "known")])
    joined = spread.join(counts.where(F.col("c") < least).select("word", "c"), "word", "left")
    logs = F.coalesce("logs", F.log10(F.coalesce("c", F.lit(0)) + 0.5))
    summed = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n").alias("n_tokens"), F.max("value").alias("value"), F.sum(logs).alias("logs"),
        F.sum(F.coalesce("known", (F.col("c") > 0).cast("bigint"), F.lit(0))).alias("n_known"),
    )
    return summed.select(
        "doc_id", (~training_row(F.col("doc_id"), fold)).alias("held_out"), "n_tokens", "n_known",
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("logs") - F.lit(unigram) * F.col("n_tokens")).alias("base_score"), (F.col("logs") + F.col("value")).alias("score"),
    )
