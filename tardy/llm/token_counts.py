"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a pre-token form a doubly linked list; a heap holds the
adjacent pairs by merge rank (ties: leftmost).  The lowest pair is popped
and merged until none is left, so the count is the initial symbols minus
the merges and no identifier is ever emitted.

A text is cut before every space that is followed by a non-space: no
pre-token reaches over such a place.  The pieces of a batch are
dictionary-encoded by Arrow, so each distinct piece is merged once per batch
(and mostly comes from a bounded cache).  Texts with runs of spaces, other
white space than ASCII or special strings are counted as a whole instead.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import BoundedCache, rows, segment_sums, text_slices

#: texts that are counted whole: a space before white space or the end,
#: white space outside ASCII
_WHOLE = (r" ([\t\n\x0b\f\r ]|$)|[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
          r"\x{202f}\x{205f}\x{3000}]")
CACHE_ENTRIES = 400_000


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class HeapCounter:
    """Counts for one vocabulary file with byte-level merges."""

    def __init__(self, path: str, pattern: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.width = max(vocab.values()) + 1
        self.start = [vocab[s] for s in byte_symbols()]
        self.rank, self.merged = {}, []
        for i, (a, b) in enumerate(merges):
            self.rank[vocab[a] * self.width + vocab[b]] = i
            self.merged.append(vocab[a + b])
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.split = (regex.compile("|".join(map(regex.escape, self.specials)))
                      if self.specials else None)
        self.pattern = regex.compile(pattern)
        self.known = BoundedCache(CACHE_ENTRIES)
        self.known_pieces = BoundedCache(CACHE_ENTRIES)

    def merge_count(self, pre_token: str) -> int:
        """Tokens of one pre-token."""
        start = self.start
        sym = [start[b] for b in pre_token.encode()]
        n = len(sym)
        rank, width, merged = self.rank.get, self.width, self.merged
        heap = []
        for i in range(n - 1):
            r = rank(sym[i] * width + sym[i + 1])
            if r is not None:
                heap.append((r, i))
        if not heap:
            return n
        heapq.heapify(heap)
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            # stale unless both ends live and the pair still has this rank
            if sym[i] < 0 or j >= n or rank(sym[i] * width + sym[j]) != r:
                continue
            sym[i], sym[j] = merged[r], -1
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                r = rank(sym[i] * width + sym[k])
                if r is not None:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0:
                r = rank(sym[h] * width + sym[i])
                if r is not None:
                    heapq.heappush(heap, (r, h))
        return left

    def count(self, text: str) -> int:
        """Tokens of any text; a special string is one token."""
        if self.split is None or not self.split.search(text):
            return self._plain(text)
        parts = self.split.split(text)
        return sum(map(self._plain, parts)) + len(parts) - 1

    def _plain(self, text: str) -> int:
        total, known = 0, self.known
        for p in self.pattern.findall(text):
            c = known.get(p)
            total += known.put(p, self.merge_count(p)) if c is None else c
        return total

    def counts(self, texts: pa.Array) -> np.ndarray:
        whole = pc.match_substring_regex(texts, _WHOLE)
        for s in self.specials:
            whole = pc.or_(whole, pc.match_substring(texts, s))
        whole = whole.to_numpy(zero_copy_only=False)
        out = np.zeros(len(texts), np.int64)
        for i in np.flatnonzero(whole):
            out[i] = self.count(texts[i].as_py())
        plain = np.flatnonzero(~whole)
        if len(plain):
            cut = pc.split_pattern(texts.take(pa.array(plain)), " ")
            offsets = np.asarray(cut.offsets, dtype=np.int64)
            coded = cut.values.dictionary_encode()
            at = coded.indices.to_numpy()
            words, get, put = coded.dictionary.to_pylist(), self.known_pieces.get, self.known_pieces.put
            spaced = np.empty(len(words), np.int64)
            for i, w in enumerate(words):
                c = get(w)
                spaced[i] = put(w, self.count(" " + w)) if c is None else c
            first = at[offsets[:-1]]
            bare = np.fromiter((self.count(words[i]) for i in first), np.int64, len(first))
            out[plain] = segment_sums(spaced[at], offsets) - spaced[first] + bare
        return out


@lru_cache(maxsize=4)
def counter(path: str, pattern: str) -> HeapCounter:
    return HeapCounter(path, pattern)


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = 512,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row.

    Null text counts as empty (0 tokens); repeated rows stay, a null id is
    passed on, other columns are ignored, an empty table gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()),
                        ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        tool = counter(path, pattern)
        for batch in batches:
            for part, texts in text_slices(batch, text_col):
                n = tool.counts(texts)
                yield rows({"doc_id": part.column(id_col), "n_bytes": pc.binary_length(texts),
                            "n_tokens": n, "over_limit": n > limit}, schema)

    return docs.select(id_col, text_col).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
