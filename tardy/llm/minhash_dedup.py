"""Near-duplicate documents by improved consistent weighted sampling.

A document is its set of five-word shingles, each weighted by its count times
an inverse document frequency.  Consistent weighted samples collide with the
probability of the weighted Jaccard similarity; they are banded, documents
that share a band are compared exactly, and pairs of similarity 0.8 or more
are linked.  Connected components of the links are the groups.

How no group is ever gathered and no bucket compared pair by pair:

* equal word sequences are one node from the start (an aggregate),
* a bucket first compares its nodes with one leader only, which joins up large
  groups of near copies,
* in buckets that then still hold several components, every pair of nodes of
  different components is compared by whole texts: in units of a block or of
  two blocks of bounded size, which emit only the links that join nodes up,
* the pairs with a leader get their texts by joins; hot leaders are split like
  hot keys.

Document frequencies are counted over all documents, in 2**18 hash buckets
of shingles (a table of bounded size at any scale): what very many documents
share stands out, all else is even.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, rows, text_buffer, text_slices
from .components import connected_components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
#: nodes, and bytes of their texts, of a bucket that are held against each other
#: at once (a larger bucket is cut into blocks, and each pair of blocks is
#: compared), and rows and bytes of a task, about
BLOCK, BLOCK_BYTES, TASK_ROWS, TASK_BYTES = 512, 2 << 20, 8192, 16 << 20
#: equal samples of all BANDS * ROWS that a pair needs before it is compared with
#: the leader ahead of the others (what has fewer is compared later)
MIN_EQUAL = 30
IDF_BITS = 18
_HASH_BITS = 44
_CHUNK = 1 << 15
#: bytes of text that a task holds as arrays of words and shingles
SLICE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    out = []
    for b in (_BASE, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[48:58] = _WORD_BYTE[65:91] = _WORD_BYTE[97:123] = _WORD_BYTE[128:] = True


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, offsets per text).  A word is a run of
    letters, digits and characters outside ASCII, in lower case; its hash is
    a difference of prefix sums, so no word is ever cut out."""
    raw, offsets = text_buffer(pc.utf8_lower(texts))
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    inside = _WORD_BYTE[raw]
    edge = np.zeros(n, bool)
    edge[offsets[:-1][offsets[:-1] < n]] = True
    before = np.r_[False, inside[:-1]]
    starts = np.flatnonzero(inside & (~before | edge))
    after = np.r_[~inside[1:] | edge[1:], True]
    ends = np.flatnonzero(inside & after) + 1
    power, inverse = _powers(1 << max(21, (n + 1).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return words, np.searchsorted(starts, offsets)


def sequence_keys(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's word sequence."""
    place = np.arange(len(words), dtype=np.uint64) - np.repeat(offsets[:-1], np.diff(offsets)).astype(np.uint64)
    out = []
    for seed in (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)):
        term = mix(words * seed + mix(place + seed))
        total = np.r_[np.uint64(0), np.cumsum(term, dtype=np.uint64)]
        out.append(mix(total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
    return out[0], out[1]


def shingles(words: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(44-bit shingle hashes, their text); a text of fewer words is one
    shingle, a text without words has none."""
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(n)), n)
    factors = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    total = np.zeros(len(words), np.uint64)
    for k in range(min(size, len(words))):
        # words past the text's end add nothing: for short texts only
        shifted = words[k:] * factors[k]
        if k:
            same = doc[k:] == doc[:-k]
            shifted = np.where(same, shifted, np.uint64(0))
        total[:len(words) - k] += shifted
    place = np.arange(len(words)) - np.repeat(offsets[:-1], n)
    kept = (place + size <= np.repeat(n, n)) | ((place == 0) & (np.repeat(n, n) < size))
    return mix(total[kept]) >> np.uint64(64 - _HASH_BITS), doc[kept]


def weighted_sets(texts: pa.Array, ln_idf: np.ndarray | None):
    """Distinct (text, shingle) in order with counts and ln(weight)."""
    words, offsets = word_hashes(texts)
    h, doc = shingles(words, offsets)
    key, count = np.unique((doc.astype(np.uint64) << np.uint64(_HASH_BITS)) | h, return_counts=True)
    h = key & np.uint64((1 << _HASH_BITS) - 1)
    doc = (key >> np.uint64(_HASH_BITS)).astype(np.int64)
    weight = None if ln_idf is None else ln_idf[_bucket(h)] + np.log(np.arange(1, max(count.max(initial=1), 1) + 1))[count - 1]
    return words, offsets, h, doc, weight


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64((1 << IDF_BITS) - 1)).astype(np.int64)


@lru_cache(maxsize=1)
def _sampling_tables() -> tuple[np.ndarray, np.ndarray]:
    """Gamma(2, 1) quantiles at 2**16 even steps, and their logarithms."""
    x = np.concatenate([np.geomspace(1e-6, 1, 40_000)[:-1], np.linspace(1, 40, 120_000)])
    cdf = 1 - np.exp(-x) * (1 + x)
    q = np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), cdf, x)
    return q, np.log(q)


def band_keys(h: np.ndarray, doc: np.ndarray, ln_weight: np.ndarray, n_docs: int,
              bands: int = BANDS, per_band: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """[text, band] hashes of the consistent weighted samples and [text,
    sample] a byte of each; texts without shingles get zeros (they are not to
    be banded)."""
    gamma, ln_gamma = _sampling_tables()
    out = np.zeros((n_docs, bands), np.uint64)
    marks = np.zeros((n_docs, bands * per_band), np.uint8)
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(doc)])
    # whole texts, in chunks that stay in the processor's cache
    chunk = np.cumsum(sizes) // _CHUNK
    cuts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]) if len(starts) else []
    sixteen, low = np.uint64(16), np.uint64(0xFFFF)
    for a, b in zip(cuts, [*cuts[1:], len(starts)]):
        lo, hi = starts[a], starts[b - 1] + sizes[b - 1]
        x, lw, at, size = h[lo:hi], ln_weight[lo:hi], starts[a:b] - lo, sizes[a:b]
        owner = np.repeat(np.arange(b - a), size)
        keys = np.zeros((b - a, bands), np.uint64)
        for k in range(bands * per_band):
            z = (x + np.uint64((k + 1) * int(_BASE) & ((1 << 64) - 1))) * _MIX1
            z ^= z >> np.uint64(29)
            z *= _MIX2
            z ^= z >> np.uint64(32)
            r = gamma[(z >> np.uint64(48)).astype(np.int64)]
            ln_c = ln_gamma[((z >> np.uint64(32)) & low).astype(np.int64)]
            beta = ((z >> sixteen) & low) * (1.0 / (1 << 16))
            t = np.floor(lw / r + beta)
            ln_a = ln_c - r * (t - beta + 1)
            least = np.minimum.reduceat(ln_a, at)
            hit = np.flatnonzero(ln_a == least[owner])
            first = hit[np.r_[True, owner[hit[1:]] != owner[hit[:-1]]]]
            sample = mix(x[first] * _BASE + t[first].astype(np.int64).view(np.uint64))
            keys[:, k // per_band] = mix(keys[:, k // per_band] * _MIX2 + sample)
            marks[doc[starts[a:b]], k] = sample & np.uint64(0xFF)
        out[doc[starts[a:b]]] = keys
    return out, marks


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """(texts per shingle bucket, number of texts) over all rows; 2**18
    sums reach the driver, whatever the input."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total, texts_seen = np.zeros(1 << IDF_BITS, np.int64), 0
        for batch in batches:
            for _, texts in text_slices(batch, text_col, SLICE):
                words, offsets = word_hashes(texts)
                h, doc = shingles(words, offsets)
                each = np.unique((doc.astype(np.int64) << IDF_BITS) | _bucket(h))
                total += np.bincount(each & ((1 << IDF_BITS) - 1), minlength=1 << IDF_BITS)
                texts_seen += len(texts)
        at = np.flatnonzero(total)
        yield rows({"bucket": np.r_[-1, at], "n": np.r_[texts_seen, total[at]]}, schema)

    summed = (docs.select(text_col).mapInArrow(run, "bucket int, n long")
              .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())
    bucket, n = summed["bucket"].to_numpy(), summed["n"].to_numpy()
    out = np.zeros(1 << IDF_BITS, np.int64)
    out[bucket[bucket >= 0]] = n[bucket >= 0]
    return out, int(n[bucket < 0].sum())


def ln_idf(frequencies: np.ndarray, n_docs: int) -> np.ndarray:
    """ln of 1 + ln((N+1)/(df+1)) / ln(N+1): weights from 1 to 2, so that an
    edit in a very common text still counts like an edit."""
    if n_docs < 1:
        return np.zeros(len(frequencies))
    return np.log1p(np.log((n_docs + 1) / (np.minimum(frequencies, n_docs) + 1)) / np.log(n_docs + 1))


def similarities(left: pa.Array, right: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts."""
    sums, keys, values = [], [], []
    for side in (left, right):
        _, _, h, doc, lw = weighted_sets(side, weights)
        w = np.exp(lw)
        sums.append(np.bincount(doc, weights=w, minlength=len(side)))
        keys.append((doc.astype(np.uint64) << np.uint64(_HASH_BITS)) | h)
        values.append(w)
    _, i, j = np.intersect1d(*keys, assume_unique=True, return_indices=True)
    shared = np.bincount((keys[0][i] >> np.uint64(_HASH_BITS)).astype(np.int64),
                         weights=np.minimum(values[0][i], values[1][j]), minlength=len(left))
    every = sums[0] + sums[1] - shared
    return np.where(every > 0, shared / np.where(every > 0, every, 1), 0.0)


def _signatures(docs: DataFrame, weights, id_col: str, text_col: str) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()),
                        ("bands", pa.list_(pa.int64())), ("samples", pa.list_(pa.int8()))])

    def lists(values: np.ndarray) -> pa.Array:
        ends = pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1])
        return pa.ListArray.from_arrays(ends, pa.array(values.ravel()))

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, text_col, SLICE):
                words, offsets, h, doc, lw = weighted_sets(texts, weights.value)
                keys, marks = band_keys(h, doc, lw, len(texts))
                k1, k2 = sequence_keys(words, offsets)
                empty = np.diff(offsets) == 0
                yield rows({"doc_id": part.column(id_col).cast(pa.int64()),
                            "k1": pa.array(k1, mask=empty), "k2": pa.array(k2, mask=empty),
                            "bands": lists(keys.view(np.int64)), "samples": lists(marks.view(np.int8))}, schema)

    return docs.select(id_col, text_col).mapInArrow(
        run, "doc_id long, k1 long, k2 long, bands array<long>, samples array<byte>")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the keys of its word sequence."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("k1", pa.int64()), ("k2", pa.int64())])

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, "text", SLICE):
                k1, k2 = sequence_keys(*word_hashes(texts))
                yield rows({"doc_id": part.column("doc_id"), "text": texts, "k1": k1, "k2": k2}, schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, k1 long, k2 long")


def _verified(pairs: DataFrame, texts: DataFrame, weights) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""
    def run(batches):
        for batch in batches:
            for part, left in text_slices(batch, "left", SLICE):
                like = similarities(left, part.column("right"), weights.value) >= SIMILARITY
                yield part.select(["a", "b"]).filter(pa.array(like))

    named = [texts.select(F.col("node").alias(n), F.col("text").alias(t))
             for n, t in (("a", "left"), ("b", "right"))]
    both = pairs.join(named[1], "b").join(named[0], "a").select("a", "b", "left", "right")
    return both.mapInArrow(run, "a long, b long")


def _merged(groups: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """The components after further links, which are few: they are followed
    between the components, and every node is mapped on."""
    def named(column: str) -> DataFrame:
        return groups.select(F.col("node").alias(column), F.col("component").alias(f"{column}_c"))

    ends = (links.join(named("a"), "a", "left").join(named("b"), "b", "left")
            .select(F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b")))
    joined = scratch.table(connected_components(ends, scratch), "joined")
    old = (groups.join(joined.select(F.col("node").alias("component"), F.col("component").alias("c")), "component", "left")
           .select("node", F.coalesce("c", "component").alias("component")))
    return old.union(joined.join(groups, "node", "left_anti"))


def _placed(members: DataFrame, groups: DataFrame) -> DataFrame:
    return (members.join(groups, "node", "left")
            .select("bucket", "node", "samples", F.coalesce("component", "node").alias("component")))


def _with_leader(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs (a < b) of a bucket's nodes with its leader, the node with the
    smallest hash (the same for a group in all its buckets), where they are
    not in one component and enough of their samples are equal."""
    held = _placed(members, groups)
    leader = F.min_by(F.struct("node", "component", "samples"), F.struct(F.xxhash64("node"), "node"))
    first = (held.groupBy("bucket").agg(leader.alias("leader"))
             .select(F.col("bucket").alias("in_bucket"), F.col("leader.node").alias("b"),
                     F.col("leader.component").alias("c"), F.col("leader.samples").alias("s")))
    equal = F.aggregate(F.zip_with("samples", "s", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, e: n + e)
    near = (F.col("bucket") == F.col("in_bucket")) & (F.col("component") != F.col("c")) & (equal >= MIN_EQUAL)
    return (held.join(first, near)
            .select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct())


def _links_of_unit(nodes: np.ndarray, parts: np.ndarray, side: np.ndarray, keys: list, band: int,
                   texts: pa.Array, weights: np.ndarray) -> list[tuple[int, int]]:
    """Links that join up the similar nodes of a unit: each pair of different
    components is compared by its whole texts (two blocks: pairs across), unless
    it is joined already or shares an earlier band, where it is compared."""
    _, _, h, doc, lw = weighted_sets(texts, weights)
    w = np.exp(lw)
    n = len(nodes)
    total = np.bincount(doc, weights=w, minlength=n)
    ends = np.searchsorted(doc, np.arange(n + 1))
    starts, sizes = ends[:-1], np.diff(ends)
    known, shingle = np.unique(h, return_inverse=True)
    root = np.unique(parts, return_inverse=True)[1]
    own = np.zeros(len(known))
    links = []
    for i in range(n):
        # no similarity exceeds the ratio of the total weights
        fit = (root != root[i]) & (np.minimum(total, total[i]) >= (SIMILARITY - 1e-9) * np.maximum(total, total[i]))
        fit &= side > side[i] if side[0] != side[-1] else np.arange(n) > i
        others = np.flatnonzero(fit)
        if band and len(others) and len(keys[i]):
            early = keys[i][:band]
            others = others[[not len(keys[j]) or not (keys[j][:band] == early).any() for j in others]]
        if not len(others):
            continue
        mine = slice(starts[i], ends[i + 1])
        own[shingle[mine]] = w[mine]
        count = sizes[others]
        first = np.cumsum(count) - count
        at = np.arange(count.sum()) + np.repeat(starts[others] - first, count)
        shared = np.add.reduceat(np.minimum(own[shingle[at]], w[at]), first)
        own[shingle[mine]] = 0
        for j in others[shared >= SIMILARITY * (total[i] + total[others] - shared)]:
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                links.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
    return links


def _units(members: DataFrame, groups: DataFrame) -> DataFrame:
    """The nodes of each bucket with several components, in units that are
    compared at once: a bucket's blocks, and each pair of its blocks.  A
    component beyond a block has blocks of its own, which do not meet."""
    held = (members.select("bucket", "band", "node", "bytes").join(groups, "node", "left")
            .withColumn("component", F.coalesce("component", "node")))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int")
    mixed = (held.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
             .filter("low <> high").select("bucket"))
    parts = (held.join(mixed, "bucket").groupBy("bucket", "component")
             .agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).withColumn("blocks", blocks))
    large = parts.filter("blocks > 1").select("bucket", F.col("component").alias("pure"), "blocks")
    small = (parts.filter("blocks = 1").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
             .select("bucket", F.lit(None).cast("long").alias("pure"), blocks.alias("blocks")))
    dealt = large.union(small)
    numbered = dealt.select("bucket", "pure", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    block = F.xxhash64(F.coalesce("pure", F.lit(0)), F.col("pure").isNull(), "k")
    one = numbered.select("bucket", F.col("pure").alias("pure_i"), block.alias("i"))
    two = numbered.select("bucket", F.col("pure").alias("pure_j"), block.alias("j"))
    met = one.join(two, "bucket").filter("i <= j and not coalesce(pure_i = pure_j, false)").select("bucket", "i", "j")
    sides = met.select("bucket", "i", "j", F.col("i").alias("block"), F.lit(0).alias("side")).union(
        met.filter("i < j").select("bucket", "i", "j", F.col("j").alias("block"), F.lit(1).alias("side")))
    placed = (held.join(large.withColumnRenamed("pure", "component").withColumnRenamed("blocks", "own_blocks"),
                        ["bucket", "component"], "left")
              .join(small.select("bucket", F.col("blocks").alias("small_blocks")), "bucket", "left")
              .withColumn("pure", F.when(F.col("own_blocks").isNotNull(), F.col("component")))
              .withColumn("k", F.pmod(F.xxhash64("node"), F.coalesce("own_blocks", "small_blocks")).cast("int"))
              .select("bucket", "band", "node", "component", "bytes", block.alias("block")))
    return (placed.join(sides, ["bucket", "block"])
            .select(F.xxhash64("bucket", "i", "j").alias("unit"), "band", "side", "node", "component", "bytes"))


def _within_buckets(units: DataFrame, texts: DataFrame, weights) -> DataFrame:
    """Links (a, b) that join up all similar nodes of the units."""
    total = units.agg(F.count("*"), F.sum("bytes")).first()
    tasks = max(1, -(-total[0] // TASK_ROWS), -(-(total[1] or 0) // TASK_BYTES))
    held = (units.join(texts, "node").withColumn("task", F.pmod("unit", F.lit(tasks)))
            .select("task", "unit", "band", "side", "node", "component", "bands", "text"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(group: pa.Table) -> pa.Table:
        order = pc.sort_indices(group.drop_columns(["text", "bands"]),
                                [(c, "ascending") for c in ("unit", "side", "node")])
        small = group.select(["unit", "band", "side", "node", "component"]).take(order)
        unit, band, side, node, part = (small[c].to_numpy() for c in small.schema.names)
        cuts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        found = []
        for i, j in zip(cuts, [*cuts[1:], len(unit)]):
            if part[i:j].min() == part[i:j].max():
                continue
            own = group.select(["bands", "text"]).take(order[i:j])
            keys = own["bands"].to_pandas().tolist()
            found += _links_of_unit(node[i:j], part[i:j], side[i:j], keys, band[i],
                                    own["text"].combine_chunks(), weights.value)
        return pa.table([[a for a, _ in found], [b for _, b in found]], schema=schema)

    return held.groupBy("task").applyInArrow(links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id (smallest id of the group), kept (doc_id is it).

    Words ignore case and punctuation, so texts with the same words are
    copies.  Null texts and texts without words are in no group; rows with a
    null id are in none either (component null, kept).  Rows that share an id
    are one document and get one row each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    share = spark.sparkContext.broadcast(ln_idf(*document_frequencies(docs)))
    marks = scratch.table(_signatures(docs, share, "doc_id", "text"), "signatures")
    known = marks.filter("doc_id is not null and k1 is not null")
    # copies: one node per word sequence, numbered anew (an id may have several
    # texts); its owner is its smallest id
    first = known.groupBy("k1", "k2").agg(F.min("doc_id").alias("owner"), F.min("bands").alias("bands"),
                                          F.min("samples").alias("samples"))
    nodes = scratch.table(first.withColumn("node", F.monotonically_increasing_id()), "nodes")
    member_of = scratch.table(known.select("doc_id", "k1", "k2")
                              .join(nodes.select("k1", "k2", "node"), ["k1", "k2"])
                              .select("doc_id", "node"), "copies")
    # an id with several texts ties their nodes together
    ties = (member_of.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b"))
    links = scratch.table(ties.select("doc_id", "a").join(member_of, "doc_id")
                          .filter("a <> node").select("doc_id", "a", F.col("node").alias("b")).distinct(), "ties")
    banded = scratch.table(nodes.select("node", F.posexplode("bands").alias("band", "key"))
                           .select("node", "band", F.xxhash64("band", "key").alias("bucket")), "bands")
    shared = banded.groupBy("bucket").agg(F.countDistinct("node").alias("n")).filter("n > 1")
    several = scratch.table(banded.join(shared.select("bucket"), "bucket", "left_semi").distinct(), "several")
    scratch.forget(banded)
    # written, so that Spark knows how small it is before it plans the joins
    wanted = scratch.table(several.select("node").distinct(), "wanted")
    marked = nodes.join(wanted, "node", "left_semi").select("node", "owner", "k1", "k2", "samples", "bands")
    # a node's text is its owner's; of an owner with several texts, the one
    # with the node's words
    loose = links.select(F.col("doc_id").alias("owner")).distinct()
    mine = marked.select("node", "owner", "k1", "k2")
    of_one = (docs.join(mine.join(loose, "owner", "left_anti"), docs.doc_id == F.col("owner"))
              .groupBy("node").agg(F.min("text").alias("text")))
    of_some = _keyed(docs.join(loose, docs.doc_id == F.col("owner"), "left_semi"))
    of_some = (of_some.join(mine.join(loose, "owner", "left_semi").withColumnRenamed("owner", "doc_id"),
                            ["doc_id", "k1", "k2"]).groupBy("node").agg(F.min("text").alias("text")))
    texts = scratch.table(of_one.union(of_some).join(marked.select("node", "samples", "bands"), "node"), "texts")
    members = scratch.table(several.join(texts.select("node", "samples", F.octet_length("text").alias("bytes")),
                                         "node"), "members")
    texts = texts.drop("samples")
    groups = scratch.table(connected_components(links.select("a", "b"), scratch), "groups")
    near = scratch.table(_verified(_with_leader(members, groups), texts, share), "links")
    groups = scratch.table(_merged(groups, near, scratch), "groups")
    units = scratch.table(_units(members, groups), "units")
    rest = scratch.table(_within_buckets(units, texts, share), "links")
    groups = scratch.table(_merged(groups, rest, scratch), "groups")
    named = (groups.join(nodes.select("node", "owner"), "node").groupBy("component")
             .agg(F.min("owner").alias("least")))
    resolved = (nodes.select("node", "owner")
                .join(groups.join(named, "component").select("node", "least"), "node", "left")
                .select("node", F.coalesce("least", "owner").alias("component_id")))
    grouped = member_of.join(resolved, "node").select("doc_id", "component_id")
    alone = marks.filter("doc_id is null or k1 is null").select(
        "doc_id", F.col("doc_id").alias("component_id"))
    out = grouped.union(alone).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    return scratch.result(out)
