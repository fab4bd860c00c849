"""Periodic runs of words by maximal pairs, and their collapse.

Two places of a text are a maximal pair when the words from them on agree
for some length and neither side can be extended.  They are found bottom-up
in the tree of longest-common-prefix intervals: when the children of an
interval are joined, two neighbouring places of different children whose
words to the left fall in different classes (the text's start is a class of
its own) are a maximal pair of the interval's length.  A run of period q and
length L is the maximal pair at distance q with common length L - q, and with
L >= 4 q its two places are neighbours, so the length constraints alone pick
the runs and nothing is extended.

Suffixes of all texts of a slice are ranked together by doubling in numpy,
and only places whose first words occur twice in their text are kept; the
tree is walked only over those.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_buffer, text_slices

#: a run has at least this many words and this many periods
MIN_LENGTH, MIN_PERIODS = 6, 4
#: such a run repeats at least this many words (MIN_LENGTH less a period of 1)
MIN_COMMON = MIN_LENGTH - 1
SLICE_BYTES = 4 << 20
_BLOCK = 2000

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUN_SQL = "struct<start: bigint, length: bigint, period: bigint>"


class Places:
    """A sorted set of places, in blocks of bounded length."""

    def __init__(self, place: int):
        self.blocks, self.lows, self.size = [[place]], [place], 1

    def around(self, x: int) -> tuple[int, int]:
        """The members before and after a place that is no member (-1: none)."""
        k = max(bisect_left(self.lows, x) - 1, 0)
        block = self.blocks[k]
        at = bisect_left(block, x)
        before = block[at - 1] if at else -1
        if at < len(block):
            return before, block[at]
        return before, self.lows[k + 1] if k + 1 < len(self.lows) else -1

    def add(self, x: int) -> None:
        k = max(bisect_left(self.lows, x) - 1, 0)
        block = self.blocks[k]
        block.insert(bisect_left(block, x), x)
        self.lows[k] = block[0]
        self.size += 1
        if len(block) > _BLOCK:
            half = len(block) // 2
            self.blocks[k:k + 1] = [block[:half], block[half:]]
            self.lows.insert(k + 1, block[half])

    def __iter__(self):
        for block in self.blocks:
            yield from block


def suffix_order(words: np.ndarray, text: np.ndarray, stop: np.ndarray,
                 common: int = MIN_COMMON) -> tuple[np.ndarray, np.ndarray]:
    """(places in suffix order, common prefix of each with the one before it)
    of the places whose first ``common`` words occur again in their text.

    ``words`` are the numbers of the words of all texts in a row; ``text`` is
    the number and ``stop`` the end of each place's text.  Suffixes of
    different texts never agree.
    """
    n = len(words)
    nothing = np.zeros(0, np.int64)
    if not n:
        return nothing, nothing
    # a place's rank is the first slot, in suffix order, of all places that
    # agree with it in ``width`` words (or up to the text's end)
    _, inverse, counts = np.unique(text * (int(words.max()) + 1) + words, return_inverse=True, return_counts=True)
    rank, width, live = (np.cumsum(counts) - counts)[inverse], 1, np.arange(n)
    levels, kept = [], nothing
    while True:
        levels.append((width, rank))
        live = live[np.bincount(rank[live], minlength=n)[rank[live]] > 1]
        if width == common:
            kept = live
        if not len(live):
            break
        step = min(width, common - width) if width < common else width
        behind = np.where(live + step < stop[live], rank[np.minimum(live + step, n - 1)] + 1, 0)
        old = rank[live]
        key = old * (n + 1) + behind
        order = np.argsort(key, kind="stable")
        key, old, index = key[order], old[order], np.arange(len(live))
        of_class = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], index, 0))
        first = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], index, 0))
        slot = old + index - of_class
        rank = rank.copy()
        rank[live[order]] = slot[first]
        width += step
    if not len(kept):
        return nothing, nothing
    kept = kept[np.argsort(rank[kept])]
    # common prefixes, the widest levels first; what is left is always
    # shorter than the level before.  Equal ranks are full windows: windows
    # that a text's end cuts have different lengths.
    a, b, length = kept[:-1].copy(), kept[1:].copy(), np.zeros(len(kept) - 1, np.int64)
    end_a, end_b = stop[a], stop[b]
    for width, rank in reversed(levels):
        same = (a < end_a) & (b < end_b) & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
        a, b, length = a + width * same, b + width * same, length + width * same
    return kept, np.r_[0, length]


def maximal_pairs(places: list[int], lcp: list[int], left: list[int]) -> list[tuple[int, int, int]]:
    """(place, later place, common length) of maximal pairs whose distance
    meets the constraints of runs.

    ``lcp[i]`` is of places i - 1 and i; ``left[p]`` is the class of the word
    before p.  The intervals are closed bottom-up; the places of the smaller
    child are looked up in, then added to, those of the larger one.
    """
    found = []

    def join(into: Places, other: Places, length: int) -> Places:
        if other.size > into.size:
            into, other = other, into
        reach = length // (MIN_PERIODS - 1)
        for p in other:
            before, after = into.around(p)
            if before >= 0 and p - before <= reach and left[before] != left[p] and length + p - before >= MIN_LENGTH:
                found.append((before, p, length))
            if after >= 0 and after - p <= reach and left[after] != left[p] and length + after - p >= MIN_LENGTH:
                found.append((p, after, length))
        for p in other:
            into.add(p)
        return into

    stack: list[tuple[int, Places]] = []
    for p, length in zip(places, lcp[1:] + [0]):
        node = Places(p)
        while stack and stack[-1][0] > length:
            inner, members = stack.pop()
            node = join(members, node, inner)
        if stack and stack[-1][0] == length:
            stack[-1] = (length, join(stack[-1][1], node, length))
        elif length >= MIN_COMMON:
            stack.append((length, node))
    return found


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each list of words, by start, then
    period."""
    numbers: dict[bytes, int] = {}
    words = np.array([numbers.setdefault(w, len(numbers)) for ws in texts for w in ws], dtype=np.int64)
    sizes = np.array([len(ws) for ws in texts], dtype=np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    starts = np.cumsum(sizes) - sizes
    stop = (starts + sizes)[text]
    places, lcp = suffix_order(words, text, stop)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(places):
        return out
    left = np.r_[-1, words[:-1]]
    left[starts[sizes > 0]] = -1  # the class of a text's start
    shortest: dict[tuple[int, int], int] = {}
    for x, y, length in maximal_pairs(places.tolist(), lcp.tolist(), left.tolist()):
        # multiples of a run's period are pairs too: the smallest counts
        key = (x, y + length)
        shortest[key] = min(y - x, shortest.get(key, y - x))
    for (start, end), period in sorted(shortest.items(), key=lambda r: (r[0][0], r[1])):
        t = int(text[start])
        out[t].append((start - int(starts[t]), end - start, period))
    return out


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of most periods; ties: smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    edge = [0] * (len(words) + 1)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [w for w, covered in zip(words, accumulate(edge)) if not covered]


def find_runs(docs: DataFrame, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, runs (start, length, period in words; by start, then period),
    strongest (the run of most periods, null if there is none) and collapsed
    (the words outside repeated periods, joined by one space) of every row.

    Words are separated by ASCII white space.  ``prepare`` may change the
    words of a text, given its id, before they are searched.  Null and blank
    texts have no words, no runs and an empty collapse; repeated rows stay, a
    null id is passed on, other columns are ignored, an empty table gives no
    rows; a very long text is searched whole, as a slice of its own.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(RUN)), ("strongest", RUN),
                        ("collapsed", pa.string())])

    def as_struct(r):
        return None if r is None else dict(zip(("start", "length", "period"), r))

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, text_col, SLICE_BYTES):
                raw, offsets = text_buffer(texts)
                raw = raw.tobytes()
                ids = part.column(id_col).cast(pa.int64())
                words = [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                if prepare:
                    words = [prepare(i, w) for i, w in zip(ids.to_pylist(), words)]
                runs = runs_of(words)
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array([[as_struct(r) for r in rs] for rs in runs], pa.list_(RUN)),
                    pa.array([as_struct(strongest(rs)) for rs in runs], RUN),
                    pa.array([b" ".join(collapse(w, rs)) for w, rs in zip(words, runs)], pa.binary()).cast(pa.string()),
                ], schema=schema)

    return docs.select(id_col, text_col).mapInArrow(
        run, f"doc_id long, runs array<{_RUN_SQL}>, strongest {_RUN_SQL}, collapsed string")
