"""Periodic runs of words, found while words are appended.

Completed blocks of 2, 4, 8, ... words each keep a catcher. The catcher of a block of b words waits for the block to come
again at a distance in its own range, about 2b/3 to 4b/3; a run of period q and length 4q holds a whole block of the size
that answers for q, followed by its copy. A block that comes again is a seed: comparing suffixes to both sides makes it a
square, or less, and squares of one period that touch are one run. A run that reaches the last word stays open and goes on
with the next words. A seed inside a known run of a smaller period that divides its own says nothing new and is skipped.

Block equality is first judged by hashes of windows, all windows of a length from those of half the length; every seed is then
confirmed on the words themselves. Words come in pieces of any size, down to one; the result does not depend on the pieces.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Words that are appended at once, and words of documents that share a catcher.
PIECE = 1 << 17
#: Bytes of a text that are split into words at once.
SLICE = 1 << 20
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)
LEAST_EXPONENT = 4
_GAP = re.compile(rb"[ \t-\r]")


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * _K1 + right * _K2
    x ^= x >> _SHIFT
    x *= _K3
    return x ^ (x >> _SHIFT)


def period_range(block: int) -> tuple[int, int]:
    """The distances a catcher over ``block`` words answers for: 2b-1 <= 3q holds for this block and not for the next size."""
    return -((1 - 2 * block) // 3), -((1 - 4 * block) // 3) - 1


class _Level:
    """Windows of one length: hashes of the last of them, from window number ``base`` on."""

    def __init__(self, block: int) -> None:
        self.block, self.base = block, 0
        self.low, self.high = period_range(block)
        self.hashes = np.zeros(0, np.uint64)
        self.cover: tuple[np.ndarray, np.ndarray] | None = None  # of the runs of its periods: starts, furthest end up to each
        self.runs: dict[int, tuple[list[int], list[list[int]]]] = {}  # period: starts, and [start, end) with them

    @property
    def end(self) -> int:
        return self.base + len(self.hashes)

    def covering(self) -> tuple[np.ndarray, np.ndarray]:
        if self.cover is None:
            spans = sorted(tuple(s) for _, spans in self.runs.values() for s in spans)
            both = np.array(spans, np.int64).reshape(-1, 2)
            self.cover = both[:, 0], np.maximum.accumulate(both[:, 1])
        return self.cover

    def inside(self, period: int, start: int, end: int) -> bool:
        """Whether a known run of this period holds all of [start, end)."""
        starts, spans = self.runs.get(period, ((), ()))
        at = bisect.bisect_right(starts, start) - 1
        return at >= 0 and spans[at][1] >= end


class SquareCatcher:
    """Runs of exponent 4 or more in a growing sequence of word numbers. ``longest`` bounds the length of a run, if known."""

    def __init__(self, longest: int | None = None) -> None:
        self.words = np.zeros(1024, np.int64)
        self.size = 0
        self.longest = longest
        self.levels: list[_Level] = []
        self.open: list[tuple[_Level, int, list[int]]] = []

    def _forward(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on."""
        n, step = 0, 32
        while j + n < self.size:
            k = min(step, self.size - j - n)
            other = self.words[i + n : i + n + k] != self.words[j + n : j + n + k]
            if other.any():
                return n + int(other.argmax())
            n, step = n + k, min(2 * step, 1 << 16)
        return n

    def _backward(self, i: int, j: int) -> int:
        """How many words before i equal those before j."""
        n, step = 0, 32
        while i - n > 0:
            k = min(step, i - n)
            other = self.words[i - n - k : i - n] != self.words[j - n - k : j - n]
            if other.any():
                return n + int(other[::-1].argmax())
            n, step = n + k, min(2 * step, 1 << 16)
        return n

    def append(self, words: np.ndarray) -> None:
        """Takes the next words and advances every open run and every catcher over them."""
        if not len(words):
            return
        while self.size + len(words) > len(self.words):
            self.words = np.concatenate([self.words, np.zeros(len(self.words), np.int64)])
        self.words[self.size : self.size + len(words)] = words
        old, self.size = self.size, self.size + len(words)
        still = []
        for level, period, span in self.open:
            span[1] += self._forward(span[1] - period, span[1])
            level.cover = None
            if span[1] == self.size:
                still.append((level, period, span))
        self.open = still
        below, below_base = self.words[: self.size].view(np.uint64), 0
        number = 0
        while True:
            block = 2 << number
            low = period_range(block)[0]
            if block > self.size or (self.longest is not None and LEAST_EXPONENT * low > self.longest):
                break
            if number == len(self.levels):
                self.levels.append(_Level(block))
            level = self.levels[number]
            first, last = level.end, self.size - block + 1
            half = block // 2
            fresh = _mixed(below[first - below_base : last - below_base], below[first + half - below_base : last + half - below_base])
            level.hashes = np.concatenate([level.hashes, fresh])
            self._seeds(number, first, last)
            below, below_base = level.hashes, level.base
            number += 1
        # What later windows, catchers and longer blocks can still ask for.
        for level in self.levels:
            drop = level.end - 4 * level.block - level.base
            if drop > 0:
                level.hashes, level.base = level.hashes[drop:].copy(), level.base + drop

    def _seeds(self, number: int, first: int, last: int) -> None:
        """Blocks that came again in the windows first .. last-1, each made a run unless a run is known to hold it."""
        level = self.levels[number]
        b = level.block
        lowest = max(0, -(-(first - level.high) // b)) * b
        blocks = np.arange(lowest, max(lowest, last - level.low), b)
        if not len(blocks):
            return
        periods = np.arange(level.low, level.high + 1)
        again = blocks[:, None] + periods[None, :]
        here = (again >= first) & (again < last)
        own = level.hashes[blocks - level.base]
        same = here & (level.hashes[np.where(here, again, first) - level.base] == own[:, None])
        at, which = np.nonzero(same)
        if not len(at):
            return
        starts, periods = blocks[at], periods[which]
        fresh = np.ones(len(starts), bool)
        for lower in self.levels[:number]:
            known, ends = lower.covering()
            if len(known):
                place = np.searchsorted(known, starts, "right") - 1
                fresh &= ~((place >= 0) & (ends[place] >= starts + periods + b))
        starts, periods = starts[fresh], periods[fresh]
        for i in np.lexsort((starts, periods)).tolist():
            s, q = int(starts[i]), int(periods[i])
            if level.inside(q, s, s + q + b) or (q % 2 == 0 and level.inside(q // 2, s, s + q + b)):
                continue
            right = self._forward(s, s + q)
            if right < b:
                continue  # hashes met, words did not
            span = [s - self._backward(s, s + q), s + q + right]
            own_starts, spans = level.runs.setdefault(q, ([], []))
            own_starts.append(span[0])
            spans.append(span)
            level.cover = None
            if span[1] == self.size:
                self.open.append((level, q, span))

    def runs(self, least: int, exponent: int) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs so far of ``least`` words and ``exponent`` periods or more, by start and period."""
        return sorted(
            (s, e - s, q) for level in self.levels for q, (_, spans) in level.runs.items() for s, e in spans if e - s >= max(least, exponent * q)
        )


# --- texts -------------------------------------------------------------------------------------------------------------


def word_slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded part of it at a time."""
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            # Up to the end of the word that the cut would part.
            gap = _GAP.search(text, end)
            end = gap.start() if gap else len(text)
        yield text[at:end].split()
        at = end


def find_in_texts(texts: list[bytes], least: int, exponent: int) -> list[list[tuple[int, int, int]]]:
    """Runs of each text; texts share catchers, a word of its own ends each of them."""
    known: dict[bytes, int] = {}
    # One longer than the words, so that every text has an end mark.
    numbers = [np.array([known.setdefault(w, len(known)) for part in word_slices(t) for w in part] + [-1 - i], np.int64) for i, t in enumerate(texts)]
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = sorted((i for i in range(len(texts)) if len(numbers[i]) > least), key=lambda i: len(numbers[i]))
    at = 0
    while at < len(order):
        pack, size = [], 0
        while at < len(order) and (not pack or size + len(numbers[order[at]]) <= PIECE):
            pack.append(order[at])
            size += len(numbers[order[at]])
            at += 1
        catcher = SquareCatcher(longest=len(numbers[pack[-1]]) - 1)
        joined = np.concatenate([numbers[i] for i in pack])
        for low in range(0, size, PIECE):
            catcher.append(joined[low : low + PIECE])
        offsets = np.cumsum([0, *(len(numbers[i]) for i in pack)])
        for start, length, period in catcher.runs(least, exponent):
            which = int(np.searchsorted(offsets, start, "right")) - 1
            found[pack[which]].append((start - int(offsets[which]), length, period))
    return found


def collapsed(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by a space, of each run only the first period."""
    drops: list[list[int]] = []
    for low, high in sorted((s + q, s + n) for s, n, q in runs):
        if drops and low <= drops[-1][1]:
            drops[-1][1] = max(drops[-1][1], high)
        else:
            drops.append([low, high])
    kept, before, at = [], 0, 0
    for words in word_slices(text):
        end, here = before + len(words), before
        while at < len(drops) and drops[at][0] < end:
            low, high = drops[at]
            kept += words[here - before : max(here, low) - before]
            here = max(here, min(high, end))
            if high > end:
                break
            at += 1
        kept += words[here - before :]
        before = end
    return b" ".join(kept)


def periodic_runs(docs: DataFrame, least: int = 6, exponent: int = LEAST_EXPONENT) -> DataFrame:
    """The runs of words in each row's ``text``: doc_id, n_words, runs (start, length, period), collapsed.

    Words are parted by ASCII white space and numbered from 0. A run is a stretch with smallest period q and at least
    max(``least``, ``exponent`` * q) words that cannot be made longer; runs go by start, then period. ``collapsed`` is the text
    without the words that repeat a run's first period. A null text has no words and an empty ``collapsed``; rows that repeat
    or have no id are treated as any other; extra columns are not read; an empty table gives no rows. No rows are shuffled.
    """
    if exponent < LEAST_EXPONENT:
        raise ValueError(f"runs of less than {LEAST_EXPONENT} periods are not caught")
    kind = dict(docs.dtypes)["doc_id"]
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            found = find_in_texts(texts, least, exponent)
            rows = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in found], run_type)
            kept = pa.array([collapsed(t, runs).decode() for t, runs in zip(texts, found)], pa.string())
            counts = pa.array([sum(map(len, word_slices(t))) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, rows, kept], names=["doc_id", "n_words", "runs", "collapsed"])

    schema = f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
