"""SentencePiece (merge type) encoding by a prefix table, and decoding.

For a merge vocabulary the encoding of every prefix of a text ends in one
certain token, and that token is the only one among those ending there that
is compatible with the last token of the prefix before it.  An automaton
over the vocabulary yields the tokens that end at each place; a pair test,
which walks back through the merges on both sides of the boundary, picks the
last token; the ids are then recovered backwards through the table.

No vocabulary entry has the space mark after another character, so a text is
cut before each run of spaces and every distinct piece of a batch is encoded
once.  Whitespace-only entries all share one score; they merge after all
others and from the left, which ``_space_run`` replays.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import BoundedCache, rows, text_slices

MARK = "▁"
CACHE_ENTRIES = 250_000
_NORMAL, _BYTE = 1, 6
_UNITS = re.compile(" +[^ ]*")


class PrefixTable:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as model

        spec = model.ModelProto()
        spec.ParseFromString(open(path, "rb").read())
        if spec.trainer_spec.model_type != 2 or spec.normalizer_spec.precompiled_charsmap:
            raise ValueError("a merge-type model with the identity normalizer is needed")
        self.bytes = {}
        normal = []
        for i, p in enumerate(spec.pieces):
            if p.type == _NORMAL:
                normal.append((-p.score, i, p.piece))
            elif p.type == _BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
        self.unk = spec.trainer_spec.unk_id
        self.spaces = {len(p): i for _, i, p in normal if not p.strip(MARK)}
        if any(p.startswith(MARK * 2) and p.strip(MARK) or MARK in p.lstrip(MARK)
               for _, _, p in normal):
            raise ValueError("a piece has the space mark inside")
        # single characters exist before any merge; the others are numbered
        # in the order in which they are merged
        normal = sorted(x for x in normal if x[2].strip(MARK) or x[2] == MARK)
        single = [x for x in normal if len(x[2]) == 1]
        self.n_single = len(single)
        order = single + [x for x in normal if len(x[2]) > 1]
        self.piece = [p for _, _, p in order]
        self.ids = [i for _, i, _ in order]
        self.number = {p: k for k, p in enumerate(self.piece)}
        self.joined: dict[tuple[int, int], int | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        # the two halves that a piece is merged from; None if the merges
        # never build it
        self.halves: list[tuple[int, int] | None] = [(-1, -1)] * len(order)
        found = []
        for k in range(self.n_single, len(order)):
            parts = self._replay(self.piece[k], k)
            self.halves[k] = parts if parts and len(parts) == 2 else None
        for k, p in enumerate(self.piece):
            if self.halves[k] is not None:
                found.append((p, (len(p), k)))
        self.automaton = ahocorasick.Automaton()
        for p, v in found:
            self.automaton.add_word(p, v)
        self.automaton.make_automaton()
        self.known = BoundedCache(CACHE_ENTRIES)

    def _replay(self, text: str, below: int) -> tuple[int, ...] | None:
        """The symbols of a short text after all merges earlier than ``below``."""
        sym = [self.number.get(c, -1) for c in text]
        while True:
            best, at = below, -1
            for i in range(len(sym) - 1):
                z = self.join(sym[i], sym[i + 1])
                if z is not None and z < best:
                    best, at = z, i
            if at < 0:
                return tuple(sym)
            sym[at:at + 2] = [best]

    def join(self, a: int, b: int) -> int | None:
        if a < 0 or b < 0:
            return None
        return self.number.get(self.piece[a] + self.piece[b])

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges keep a boundary between the two tokens: no pair
        that ever meets at the boundary may merge before one of its members
        is merged away from it (ties: the left pair goes first)."""
        key = (left, right)
        known = self.fits.get(key)
        if known is not None:
            return known
        x, y, end_x, end_y = left, right, len(self.piece), len(self.piece)
        ok, single = True, self.n_single
        while True:
            z = self.number.get(self.piece[x] + self.piece[y])
            if z is not None and z < end_x and z <= end_y:
                ok = False
                break
            if x < single and y < single:
                break
            # go back to before the later of the two was formed
            if y < single or (x >= single and x > y):
                end_x, x = x, self.halves[x][1]
            else:
                end_y, y = y, self.halves[y][0]
        if len(self.fits) < 500_000:
            self.fits[key] = ok
        return ok

    def _tokens(self, text: str) -> list[int]:
        """Ids of a text with at most one space mark, at its start."""
        n = len(text)
        last: list[int | None] = [None] * (n + 1)
        fits, compatible = self.fits.get, self.compatible
        for end, (length, k) in self.automaton.iter(text):
            end += 1
            if last[end] is not None:
                continue
            start = end - length
            # an unknown character before it is never merged with anything
            before = last[start] if start else None
            if before is None:
                last[end] = k
            else:
                ok = fits((before, k))
                if ok or (ok is None and compatible(before, k)):
                    last[end] = k
        out, ids, piece = [], self.ids, self.piece
        while n:
            k = last[n]
            if k is None:
                raw = text[n - 1].encode()
                out.extend([self.bytes.get(b, self.unk) for b in reversed(raw)])
                n -= 1
            else:
                out.append(ids[k])
                n -= len(piece[k])
        out.reverse()
        return out

    def _space_run(self, n: int) -> list[int]:
        """Ids of n space marks that nothing else takes: equal scores, so the
        leftmost pair that makes a piece merges first."""
        out: list[int] = []  # no two neighbours of it make a piece
        for _ in range(n):
            out.append(1)
            while len(out) > 1 and out[-2] + out[-1] in self.spaces:
                last = out.pop()
                out[-1] += last
        return [self.spaces[k] for k in out]

    def unit(self, unit: str) -> list[int]:
        """Ids of a run of spaces followed by no further space."""
        word = unit.lstrip(" ")
        run = len(unit) - len(word)
        if run == 1 and word:
            return self._tokens(MARK + word)
        if not word:
            return self._space_run(run)
        ids = self._tokens(MARK + word)
        if ids and ids[0] == self.spaces.get(1):  # the last mark stayed alone
            return self._space_run(run) + ids[1:]
        return self._space_run(run - 1) + ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        return [i for u in _UNITS.findall(" " + text.replace(MARK, " ")) for i in self.unit(u)]


class Decoder:
    """Texts from ids: pieces, byte runs as UTF-8, space marks as spaces."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as model

        spec = model.ModelProto()
        spec.ParseFromString(open(path, "rb").read())
        self.piece = [p.piece.replace(MARK, " ") if p.type == _NORMAL else "" for p in spec.pieces]
        self.byte = {i: int(p.piece[1:-1], 16) for i, p in enumerate(spec.pieces)
                     if p.type == _BYTE}
        self.unk = {i: spec.trainer_spec.unk_surface for i, p in enumerate(spec.pieces)
                    if p.type == 2}

    def raw(self, ids: list[int]) -> str:
        """With the leading space that encoding adds."""
        out, run = [], bytearray()
        for i in ids:
            b = self.byte.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append(self.unk.get(i) or self.piece[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.raw(ids)
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def codec(path: str) -> tuple[PrefixTable, Decoder]:
    return PrefixTable(path), Decoder(path)


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id",
                 text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, and with
    ``with_ids`` the ids and the decoded text themselves.

    Null text is empty: no ids, hashes of the empty string.  Repeated rows
    stay, a null id is passed on, other columns are ignored.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
              ("decoded_sha256", pa.string())]
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
        ddl += ", ids array<int>, decoded string"
    schema = pa.schema(fields)

    def digest(ids_text: str, decoded: str, n: int):
        return n, hashlib.sha256(ids_text.encode()).hexdigest(), \
            hashlib.sha256(decoded.encode()).hexdigest()

    def run(batches):
        table, decoder = codec(path)
        known = table.known

        def look(word: str):
            got = known.get(word)
            if got is None:
                ids = table.unit(" " + word)
                got = known.put(word, (",".join(map(str, ids)), decoder.raw(ids), len(ids)))
            return got

        for batch in batches:
            for part, texts in text_slices(batch, text_col):
                found: list = [None] * len(texts)
                odd = pc.match_substring_regex(texts, f"^ |  |^$|{MARK}").to_numpy(zero_copy_only=False)
                for i in np.flatnonzero(odd):
                    ids = table.encode(texts[int(i)].as_py())
                    found[i] = digest(",".join(map(str, ids)), decoder.decode(ids), len(ids))
                plain = np.flatnonzero(~odd)
                if len(plain):
                    cut = pc.split_pattern(texts.take(pa.array(plain)), " ")
                    offsets = np.asarray(cut.offsets, dtype=np.int64)
                    coded = cut.values.dictionary_encode()
                    words = [look(w) for w in coded.dictionary.to_pylist()]
                    texts_of, raw_of = [w[0] for w in words], [w[1] for w in words]
                    at = coded.indices.to_numpy()
                    sizes = np.fromiter((w[2] for w in words), np.int64, len(words))[at]
                    counts = np.add.reduceat(sizes, offsets[:-1])
                    for k, i in enumerate(plain):
                        own = at[offsets[k]:offsets[k + 1]].tolist()
                        found[i] = digest(",".join([texts_of[w] for w in own]),
                                          "".join([raw_of[w] for w in own])[1:], int(counts[k]))
                cols = {"doc_id": part.column(id_col), "n_tokens": [f[0] for f in found],
                        "ids_sha256": [f[1] for f in found],
                        "decoded_sha256": [f[2] for f in found]}
                if with_ids:
                    cols["ids"] = [table.encode(t) for t in texts.to_pylist()]
                    cols["decoded"] = [decoder.decode(i) for i in cols["ids"]]
                yield rows(cols, schema)

    return docs.select(id_col, text_col).mapInArrow(run, ddl)
