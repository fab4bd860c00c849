"""Cross-tokenizer alignment by divide and conquer at shared cuts.

Two tokenizers cut the same bytes.  The tokens of a text are an interval; a
byte offset near its middle at which tokens of both sides end is found by
bisection of one side's ends in the other's, and both halves are treated
alike.  An interval without an inner shared end is a leaf: one group.  All
intervals of a slice of texts are divided together, level by level.

The last tokens of a group end together: they are linked.  How often an id
pair is linked is counted over the whole corpus by Spark; the frequent pairs
(a bounded number) are looked up by broadcast, the rare rest is joined.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, rows, segment_sums, text_slices
from .token_counts import byte_symbols

#: texts whose words cannot be encoded one by one: a space at the start,
#: before white space or at the end, and white space outside ASCII
_WHOLE = (r"^ | ([\t\n\x0b\f\r ]|$)|[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
          r"\x{202f}\x{205f}\x{3000}]")
MARK = "▁"
#: distinct words of a slice that are encoded in one call
CHUNK_WORDS = 512
#: pairs that are broadcast at most (20 bytes each)
HOT_PAIRS = 1_000_000
SLICE_BYTES = 4 << 20


def ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all integers of the ranges, the range each belongs to)."""
    n = np.maximum(stop - start, 0)
    owner = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    return np.arange(len(owner)) - first[owner] + start[owner], owner


def shared_groups(ends_a: np.ndarray, ends_b: np.ndarray, a0: np.ndarray, a1: np.ndarray,
                  b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A stops, B stops) of the groups, in order.

    ``ends_a`` and ``ends_b`` are the increasing end offsets of all tokens;
    interval i holds tokens a0[i]:a1[i] and b0[i]:b1[i], whose last ends are
    equal.  Cuts are sought from the middle of the A tokens outward, in steps
    that double, so that a long cutless interval costs its length once.
    """
    leaves_a, leaves_b = [], []
    while len(a0):
        small = (a1 - a0 == 1) | (b1 - b0 == 1)
        leaves_a.append(a1[small])
        leaves_b.append(b1[small])
        a0, a1, b0, b1 = a0[~small], a1[~small], b0[~small], b1[~small]
        cut_a = np.full(len(a0), -1)
        cut_b = np.full(len(a0), -1)
        middle = (a0 + a1 - 2) // 2
        open_, width = np.arange(len(a0)), 1
        while len(open_):
            lo, hi, mid = a0[open_], a1[open_] - 1, middle[open_]
            right, of_right = ranges(mid + width - 1, np.minimum(mid + 2 * width - 1, hi))
            left, of_left = ranges(np.maximum(mid - 2 * width + 1, lo), mid - width + 1)
            place, owner = np.r_[right, left], np.r_[of_right, of_left]
            other = np.r_[np.searchsorted(ends_b, ends_a[right]), np.searchsorted(ends_b, ends_a[left])]
            hit = np.flatnonzero(ends_b[other] == ends_a[place])
            if len(hit):
                place, owner, other = place[hit], owner[hit], other[hit]
                near = np.lexsort((np.abs(place - mid[owner]), owner))
                near = near[np.r_[True, np.diff(owner[near]) > 0]]
                cut_a[open_[owner[near]]] = place[near]
                cut_b[open_[owner[near]]] = other[near]
            more = (cut_a[open_] < 0) & ((mid + 2 * width - 1 < hi) | (mid - 2 * width >= lo))
            open_, width = open_[more], 2 * width
        none = cut_a < 0
        leaves_a.append(a1[none])
        leaves_b.append(b1[none])
        a0, a1, b0, b1, ca, cb = (x[~none] for x in (a0, a1, b0, b1, cut_a, cut_b))
        # both halves of an interval stay side by side: look-ups go in order
        a0, a1 = np.c_[a0, ca + 1].ravel(), np.c_[ca + 1, a1].ravel()
        b0, b1 = np.c_[b0, cb + 1].ravel(), np.c_[cb + 1, b1].ravel()
    if not leaves_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.sort(np.concatenate(leaves_a)), np.sort(np.concatenate(leaves_b))


class Pair:
    """Both tokenizers of a worker, their token bytes and a bounded cache."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        plain = {c: b for b, c in enumerate(byte_symbols())}
        added = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        self.bytes_a = [added[i] if i in added else bytes(plain[c] for c in self.a.id_to_token(i))
                        for i in range(self.a.get_vocab_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode()
                        for i, p in enumerate(self.b.id_to_piece(i) for i in range(self.b.get_piece_size()))]
        self.size_a = np.array([len(x) for x in self.bytes_a])
        self.size_b = np.array([len(x) for x in self.bytes_b])
        # a decimal id and the sign after it: inside a group, and at its end
        self.text = [f"{i}{s}" for i in range(len(self.bytes_a)) for s in ",|"]
        self.text += [f"{i}{s}" for i in range(len(self.bytes_b)) for s in ",;"]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """(A ids of space+text, B ids of text, whether both spell space+text)."""
        a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        b = self.b.encode(text)
        raw = b" " + text.encode()
        ok = (b"".join(map(self.bytes_a.__getitem__, a)) == raw
              and b"".join(map(self.bytes_b.__getitem__, b)) == raw)
        return np.array(a, np.int32), np.array(b, np.int32), ok

    def encode_words(self, words: list[str], out: list) -> None:
        """Appends (A ids, tokens of each word, B ids, tokens of each word, ok)
        for words that are encoded together as one text; where the spelling
        fails, the halves are encoded apart."""
        a, b, ok = self.encode(" ".join(words))
        if ok:
            stop = np.cumsum([len(w.encode()) + 1 for w in words])
            n = [np.diff(np.searchsorted(np.cumsum(size[ids]), stop, side="right"), prepend=0)
                 for ids, size in ((a, self.size_a), (b, self.size_b))]
            out.append((a, n[0], b, n[1], np.ones(len(words), bool)))
        elif len(words) == 1:
            out.append((a, [len(a)], b, [len(b)], [False]))
        else:
            self.encode_words(words[:len(words) // 2], out)
            self.encode_words(words[len(words) // 2:], out)

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A ids, A tokens of each text, B ids, B tokens of each text); a
        text that is empty or not spelled by both has none."""
        n = len(texts)
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        whole = pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False)
        plain, rest = np.flatnonzero(~whole & ~empty), np.flatnonzero(whole & ~empty)
        cut = pc.split_pattern(texts.take(pa.array(plain)), " ")
        coded = cut.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        units: list = []
        for i in range(0, len(words), CHUNK_WORDS):
            self.encode_words(words[i:i + CHUNK_WORDS], units)
        # one more unit for each text that is encoded whole
        for i in rest:
            a, b, ok = self.encode(texts[i].as_py())
            units.append((a, [len(a)], b, [len(b)], [ok]))
        ok = np.concatenate([u[4] for u in units] + [np.zeros(0, bool)])
        count = np.zeros(n, np.int64)
        count[plain] = np.diff(np.asarray(cut.offsets, dtype=np.int64))
        count[rest] = 1
        stop = np.cumsum(count)
        unit = np.empty(count.sum(), np.int64)
        unit[np.repeat(~whole, count)] = coded.indices.to_numpy()
        unit[stop[rest] - 1] = len(words) + np.arange(len(rest))
        good = segment_sums((~ok[unit]).astype(np.int64), np.r_[0, stop]) == 0
        unit = unit[np.repeat(good, count)]
        edges = np.r_[0, np.cumsum(np.where(good, count, 0))]
        out = []
        for ids, sizes in ((0, 1), (2, 3)):
            flat = np.concatenate([u[ids] for u in units] + [np.zeros(0, np.int32)])
            size = np.concatenate([u[sizes] for u in units] + [np.zeros(0, np.int64)]).astype(np.int64)
            first = np.cumsum(size) - size
            place, _ = ranges(first[unit], first[unit] + size[unit])
            out += [flat[place], segment_sums(size[unit], edges)]
        return out[0], out[1], out[2], out[3]

    def align(self, texts: pa.Array) -> dict[str, object]:
        ids_a, n_a, ids_b, n_b = self.tokens(texts)
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        a1, b1 = np.cumsum(n_a), np.cumsum(n_b)
        has = n_a > 0
        stop_a, stop_b = shared_groups(ends_a, ends_b, (a1 - n_a)[has], a1[has], (b1 - n_b)[has], b1[has])
        group_edges = np.searchsorted(stop_a, np.r_[0, a1], side="right")
        n_groups = np.diff(group_edges)
        links = ids_a[stop_a - 1].astype(np.int64) * len(self.bytes_b) + ids_b[stop_b - 1]
        # the groups as text: A ids of a group stand before its B ids
        last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
        last_a[stop_a - 1] = True
        last_b[stop_b - 1] = True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        before_b, before_a = np.r_[0, stop_b][group_a], stop_a[group_b] if len(stop_a) else group_b
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        order[np.arange(len(ids_a)) + before_b] = 2 * ids_a.astype(np.int64) + last_a
        order[np.arange(len(ids_b)) + before_a] = 2 * (ids_b.astype(np.int64) + len(self.bytes_a)) + last_b
        digests, both = [], n_a + n_b
        at = np.cumsum(both) - both
        get = self.text.__getitem__
        for i in range(len(texts)):
            if not both[i]:
                digests.append("")
                continue
            spelled = "".join(map(get, order[at[i]:at[i] + both[i]].tolist()))
            digests.append(hashlib.sha256(spelled[:-1].encode()).hexdigest())
        return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "groups_sha256": digests,
                "links": pa.LargeListArray.from_arrays(pa.array(group_edges, pa.int64()), pa.array(links))}


@lru_cache(maxsize=2)
def tokenizer_pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def align_texts(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, groups_sha256 and ``links`` (codes
    A id * size of B + B id, one for each group in order) of every row."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                        ("n_groups", pa.int64()), ("groups_sha256", pa.string()),
                        ("links", pa.list_(pa.int64()))])

    def run(batches):
        tool, row = tokenizer_pair(path_a, path_b), TaskContext.get().partitionId() << 36
        for batch in batches:
            for part, texts in text_slices(batch, text_col, SLICE_BYTES):
                found = tool.align(texts)
                yield rows({"row": np.arange(row, row + len(texts)), "doc_id": part.column(id_col)} | found, schema)
                row += len(texts)

    return docs.select(id_col, text_col).mapInArrow(
        run, "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<long>")


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """code, n, best: how often each id pair is linked, and whether no other
    pair of its B id is linked more often."""
    n = aligned.select(F.explode("links").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    n = n.withColumn("b", F.col("code") % size_b)
    # one row for each B id: bounded by its vocabulary
    most = n.groupBy("b").agg(F.max("n").alias("most"))
    return n.join(F.broadcast(most), "b").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def hot_threshold(pairs: DataFrame, limit: int) -> int:
    """The smallest power of two such that at most ``limit`` pairs are linked
    at least that often (64 rows at most are read)."""
    classes = pairs.groupBy(F.floor(F.log2("n")).alias("k")).count().collect()
    total, at = 0, 0
    for k, count in sorted(((int(k), c) for k, c in classes), reverse=True):
        total += count
        if total > limit:
            return 2 ** (k + 1)
        at = k
    return 2 ** at if classes else 1


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
          hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts that are null, empty or not spelled alike by both tokenizers have
    no tokens (zeros and an empty digest).  Repeated rows each count and each
    stay; a null id is passed on; other columns are ignored; an empty table
    gives no rows.  A very long text is aligned whole, as a slice of its own.
    """
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    scratch = Scratch(docs.sparkSession, "alignment")
    aligned = scratch.table(align_texts(docs, path_a, path_b, id_col, text_col), "aligned")
    pairs = scratch.table(pair_counts(aligned, size_b), "pairs")
    least = hot_threshold(pairs, hot_pairs)
    keys = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    link = aligned.select(*keys, F.explode_outer("links").alias("code"))
    hot = pairs.filter(F.col("n") >= least)
    sums = [F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("n").alias("count_sum")]
    found = link.join(F.broadcast(hot), "code", "left").groupBy(*keys).agg(*sums)
    if not pairs.filter(F.col("n") < least).isEmpty():
        # rare pairs: each is linked fewer than ``least`` times, so no key is hot
        cold = pairs.filter(F.col("n") < least)
        rare = (aligned.select("row", F.explode("links").alias("code"))
                .join(F.broadcast(hot.select("code")), "code", "left_anti")
                .groupBy("row", "code").agg(F.count("*").alias("times"))
                .join(cold.hint("merge"), "code")
                .select("row", (F.col("times") * F.col("best").cast("long")).alias("best"),
                        (F.col("times") * F.col("n")).alias("n"))
                .groupBy("row").agg(F.sum("best").alias("rare_best"), F.sum("n").alias("rare_sum")))
        found = (found.join(rare, "row", "left")
                 .withColumn("n_best", F.coalesce("n_best", F.lit(0)) + F.coalesce("rare_best", F.lit(0)))
                 .withColumn("count_sum", F.coalesce("count_sum", F.lit(0)) + F.coalesce("rare_sum", F.lit(0))))
    zero = F.lit(0).cast("long")
    return scratch.result(found.select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"))
