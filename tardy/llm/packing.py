"""Hierarchical multi-length packing.

Documents are tokenized, closed with an end id and routed to the shortest
window size (tier) that holds them.  Tiers are packed from long to short: a
window takes one document of its tier, its gap is filled with the longest
shorter documents that fit, and what is left of the gap with a piece cut
from the shortest longer one, whose rest goes back to be routed again.  A
window is thus full, and its size is a power of two; only what remains at
the end of a task is padded (less than the shortest tier).

The windows of a pool are dealt to step groups of equal token budget, the
longest first and each to the group with the fewest tokens so far.

A task packs only its own rows, a pool at a time, so nothing is shuffled, no
key can be hot and memory is bounded by the pool and the longest document.
"""

from __future__ import annotations

import bisect
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import BoundedCache, rows, text_slices

TIERS = (4096, 2048, 1024, 512)
POOL_TOKENS = 1 << 20
#: tokens of a step group
STEP_TOKENS = 32 * 4096
CACHE_ENTRIES = 400_000
SLICE = 8 << 20


class WordTokenizer:
    """Ids of a tokenizer whose pre-tokens never hold white space: a text is
    cut at ASCII white space and each distinct word is encoded once a batch."""

    GROUP = 200

    def __init__(self, path: str, cache_entries: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        added = self.tool.get_added_tokens_decoder()
        # an added token between two words keeps their ids apart
        self.mark_id, mark = max(added.items(), key=lambda x: x[0])
        self.mark = mark.content
        self.known = BoundedCache(cache_entries)

    def _encode(self, words: list[str]) -> list[bytes]:
        plain = [w for w in words if self.mark not in w]
        groups = [plain[i:i + self.GROUP] for i in range(0, len(plain), self.GROUP)]
        out: dict[str, bytes] = {}
        if groups:
            coded = self.tool.encode_batch_fast([self.mark.join(g) for g in groups],
                                                add_special_tokens=False)
            for g, e in zip(groups, coded):
                ids = np.array(e.ids, dtype="<u4")
                cuts = np.flatnonzero(ids == self.mark_id)
                if len(cuts) != len(g) - 1:
                    raise ValueError("a word could not be told from its neighbours")
                raw, lo = ids.tobytes(), 0
                for w, hi in zip(g, [*cuts.tolist(), len(ids)]):
                    out[w] = raw[4 * lo:4 * hi]
                    lo = hi + 1
        return [out[w] if w in out else
                np.array(self.tool.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes()
                for w in words]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each closed with ``end_id``; offsets)."""
        cut = pc.ascii_split_whitespace(texts)
        bounds = np.asarray(cut.offsets, dtype=np.int64)
        coded = cut.values.dictionary_encode()
        at = coded.indices.to_numpy()
        words = coded.dictionary.to_pylist()
        get, put = self.known.get, self.known.put
        found = [get(w) for w in words]
        new = [i for i, f in enumerate(found) if f is None]
        for i, raw in zip(new, self._encode([words[i] for i in new])):
            found[i] = put(words[i], raw)
        store = np.frombuffer(b"".join(found), dtype="<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        # all words in text order; an end id after each text's last word
        ends = bounds[1:] + np.arange(len(texts))
        n = len(at) + len(texts)
        is_end = np.zeros(n, bool)
        is_end[ends] = True
        size, start = np.ones(n, np.int64), np.full(n, len(store), np.int64)
        size[~is_end], start[~is_end] = sizes[at], starts[at]
        store = np.append(store, np.array([end_id], dtype="<u4"))
        stop = np.cumsum(size)
        take = np.repeat(start - (stop - size), size)
        take += np.arange(len(take))
        return store[take], np.r_[0, stop[ends]]


@lru_cache(maxsize=2)
def word_tokenizer(path: str, cache_entries: int) -> WordTokenizer:
    return WordTokenizer(path, cache_entries)


class Pool:
    """Fragments (document, start, length) that wait for a window."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers = tuple(sorted(tiers, reverse=True))
        self.lengths: list[int] = []          # sorted, one entry per fragment
        self.by_length: dict[int, list] = {}

    def add(self, doc: int, start: int, length: int) -> None:
        if length:
            bisect.insort(self.lengths, length)
            self.by_length.setdefault(length, []).append((doc, start))

    def take(self, i: int) -> tuple[int, int, int]:
        length = self.lengths.pop(i)
        doc, start = self.by_length[length].pop()
        return doc, start, length

    def windows(self, flush: bool) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """(size, pieces) of full windows; with ``flush`` also of the rest."""
        for k, size in enumerate(self.tiers):
            shorter = self.tiers[k + 1] if k + 1 < len(self.tiers) else 0
            while self.lengths and self.lengths[-1] > shorter:
                got = self._fill(size)
                if got is None:
                    break
                yield size, got
        while flush and self.lengths:
            # what no window of the longest document's tier takes in full
            left = sum(self.lengths)
            size = next((t for t in self.tiers if t <= left), None)
            if size is None:
                yield self.tiers[-1], [self.take(len(self.lengths) - 1)
                                       for _ in range(len(self.lengths))]
            else:
                yield size, self._fill(size)

    def _fill(self, size: int) -> list[tuple[int, int, int]] | None:
        doc, start, length = self.take(len(self.lengths) - 1)
        used = min(length, size)
        pieces = [(doc, start, used)]
        self.add(doc, start + used, length - used)
        while used < size:
            gap = size - used
            i = bisect.bisect_right(self.lengths, gap) - 1
            if i >= 0:
                piece = self.take(i)
            elif self.lengths:
                doc, start, length = self.take(0)
                self.add(doc, start + gap, length - gap)
                piece = (doc, start, gap)
            else:
                # not enough left for this window: all goes back
                for p in pieces:
                    self.add(*p)
                return None
            pieces.append(piece)
            used += piece[2]
        return pieces


def deal_steps(sizes: list[int], budget: int) -> list[int]:
    """The step group of each window: longest first, each to the lightest."""
    groups = max(1, round(sum(sizes) / budget))
    heap = [(0, g) for g in range(groups)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (load + sizes[i], g))
    return out


PACKED = ("doc_id long, start long, length long, ids binary, doc_tokens long, "
          "sequence_id long, offset long, tier int, step_group long")


def pack(docs: DataFrame, path: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS,
         pool_tokens: int = POOL_TOKENS, step_tokens: int = STEP_TOKENS,
         slice_bytes: int = SLICE, cache_entries: int = CACHE_ENTRIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: its document, place and ids (little-endian unsigned
    32-bit), the sequence and offset there, the sequence's tier and step group.

    A null or empty text is a document of the end id alone; repeated rows are
    packed each; a null id is passed on; other columns are ignored.  Only the
    last sequence of a task is shorter than its tier.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids", pa.binary()), ("doc_tokens", pa.int64()),
                        ("sequence_id", pa.int64()), ("offset", pa.int64()),
                        ("tier", pa.int32()), ("step_group", pa.int64())])

    def run(batches):
        tool = word_tokenizer(path, cache_entries)
        base = TaskContext.get().partitionId() << 33
        pool, held, waiting, n_docs, n_seq, n_step = Pool(tiers), {}, 0, 0, 0, 0

        def emit(flush: bool):
            nonlocal n_seq, n_step
            made = list(pool.windows(flush))
            steps = deal_steps([size for size, _ in made], step_tokens)
            out = {f.name: [] for f in schema}
            for (size, pieces), step in zip(made, steps):
                offset = 0
                for doc, start, length in pieces:
                    doc_id, ids = held[doc]
                    for name, v in (("doc_id", doc_id), ("start", start), ("length", length),
                                    ("ids", ids[start:start + length].tobytes()),
                                    ("doc_tokens", len(ids)), ("sequence_id", base + n_seq),
                                    ("offset", offset), ("tier", size),
                                    ("step_group", base + n_step + step)):
                        out[name].append(v)
                    offset += length
                n_seq += 1
            n_step += max(steps, default=-1) + 1
            alive = {doc for group in pool.by_length.values() for doc, _ in group}
            for doc in [d for d in held if d not in alive]:
                del held[doc]
            return rows(out, schema)

        for batch in batches:
            for part, texts in text_slices(batch, text_col, slice_bytes):
                ids, bounds = tool.encode(texts, end_id)
                for i, doc_id in enumerate(part.column(id_col).to_pylist()):
                    own = ids[bounds[i]:bounds[i + 1]]
                    held[n_docs] = (doc_id, own)
                    pool.add(n_docs, 0, len(own))
                    n_docs += 1
                waiting += len(ids)
                if waiting >= pool_tokens:
                    waiting = 0
                    yield emit(False)
        yield emit(True)

    return docs.select(id_col, text_col).mapInArrow(run, PACKED)
