"""Language identification by prediction by partial matching.

For every language a context tree over bytes holds how often each byte
followed each context of up to ``depth`` bytes.  A byte that a context has
seen is coded with its share (escape estimate: one count for each distinct
byte), another one escapes to the context without its first byte, where the
bytes already ruled out are excluded; below the empty context all remaining
bytes are equally likely.  With the statistics frozen, the code length of a
text under a language is the sum over its bytes, and the language with the
shortest code is predicted.

All languages share one tree of contexts, so that a text is walked once and
each byte looks up a row with one exact code length per language.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, is_held_out, rows, text_buffer, text_slices
from .minhash_dedup import mix

DEPTH = 4
#: bytes of text that the trees of one language are counted from, at most a
#: piece more (a hash of id and place chooses pieces of documents)
SAMPLE_BYTES = 1_000_000
#: characters of a piece, and how much more than the bound reaches the driver
#: so that the bound is filled
PIECE, MARGIN = 8192, 1.5
#: contexts that occur less often are left out of the trees
MIN_COUNT = 16
#: contexts whose costs are worked out at once
BLOCK = 512
UNKNOWN = "und"
_LETTER = r"\p{L}"


@dataclass
class ContextTrees:
    languages: list[str]
    classes: np.ndarray             # byte -> symbol; 0: never seen
    steps: list[np.ndarray]         # per depth d: [node of depth d, symbol] -> node of depth d+1
    first: list[int]                # per depth: number of its first node in the cost table
    cost: np.ndarray                # [node * symbols + symbol, language] -> bits

    @property
    def symbols(self) -> int:
        return int(self.classes.max()) + 1

    def bits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length in bits of each text under each language."""
        n_sym = self.symbols
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        if not len(raw):
            return out
        sym = self.classes[raw].astype(np.int32)
        place = np.arange(len(raw), dtype=np.int64) - np.repeat(offsets[:-1], np.diff(offsets))
        # node of the context of d bytes that ends before each place, 0: none
        node = np.zeros(len(raw), np.int32)
        state = np.full(len(raw), self.first[0], np.int32)
        for d, step in enumerate(self.steps):
            below = np.zeros_like(node)
            if d == 0:
                below[1:] = step[0, sym[:-1]]
            else:
                below[1:] = np.where(node[:-1] > 0, step[node[:-1], sym[:-1]], 0)
            below[place <= d] = 0
            node = below
            np.copyto(state, node + (self.first[d + 1] - 1), where=node > 0)
        bits = self.cost[state.astype(np.int64) * n_sym + sym]
        full = np.flatnonzero(np.diff(offsets) > 0)
        if len(full):
            out[full] = np.add.reduceat(bits, offsets[full], axis=0, dtype=np.float64)
        return out


def fit_trees(texts: dict[str, list[str]], depth: int = DEPTH,
              min_count: int = MIN_COUNT) -> ContextTrees:
    """Trees from some texts of each language."""
    languages = sorted(texts)
    if not languages:
        return ContextTrees([], np.zeros(256, np.uint8), [], [0], np.zeros((1, 0), np.float32))
    joined = {}
    seen = np.zeros(256, bool)
    for lang in languages:
        raw = [np.frombuffer(t.lower().encode(), np.uint8) for t in texts[lang]]
        ends = np.cumsum([len(r) for r in raw])
        flat = np.concatenate(raw) if raw else np.zeros(0, np.uint8)
        place = np.arange(len(flat)) - np.repeat(ends - [len(r) for r in raw], [len(r) for r in raw])
        joined[lang] = flat, place
        seen[np.unique(flat)] = True
    classes = np.zeros(256, np.uint8)
    classes[seen] = np.arange(1, seen.sum() + 1) if seen.sum() < 256 else np.arange(256)
    n_sym, n_lang = int(classes.max()) + 1, len(languages)

    # counts of (context of d symbols, next symbol) per language
    base = 256
    counted = []
    for d in range(depth + 1):
        keys, langs, counts = [], [], []
        for k, lang in enumerate(languages):
            flat, place = joined[lang]
            sym = classes[flat].astype(np.int64)
            if len(sym) <= d:
                continue
            key = np.zeros(len(sym) - d, np.int64)
            for j in range(d + 1):
                key = key * base + sym[j:len(sym) - d + j]
            key, c = np.unique(key[place[d:] >= d], return_counts=True)
            keys.append(key), counts.append(c), langs.append(np.full(len(key), k))
        empty = np.zeros(0, np.int64)
        counted.append([np.concatenate(x) if x else empty for x in (keys, langs, counts)])

    steps, first, tables = [], [0], []
    nodes = np.zeros(1, np.int64)        # context keys of this depth
    parent = None                        # counts and lower costs of the depth before
    for d in range(depth + 1):
        key, lang, c = counted[d]
        context = key // base
        if d:
            every, inverse = np.unique(context, return_inverse=True)
            total = np.bincount(inverse, weights=c, minlength=len(every))
            kept = every[total >= min_count]
            step = np.zeros((max(len(nodes), 1) + (1 if d > 1 else 0), n_sym), np.int32)
            shorter = np.searchsorted(nodes, kept // base)
            ok = (shorter < len(nodes)) & (nodes[np.minimum(shorter, len(nodes) - 1)] == kept // base) \
                if len(nodes) else np.zeros(len(kept), bool)
            # the escape context (without the first symbol) must be a node too
            tail = kept % base ** (d - 1)
            at = np.searchsorted(nodes, tail)
            ok &= (at < len(nodes)) & (nodes[np.minimum(at, len(nodes) - 1)] == tail) \
                if len(nodes) else False
            kept, shorter, at = kept[ok], shorter[ok], at[ok]
            step[shorter + (1 if d > 1 else 0), kept % base] = np.arange(1, len(kept) + 1)
            steps.append(step)
            first.append(first[-1] + len(nodes))
        else:
            kept, at = np.zeros(1, np.int64), None
        where = np.searchsorted(kept, context)
        hit = (where < len(kept)) & (kept[np.minimum(where, max(len(kept) - 1, 0))] == context) \
            if len(kept) else np.zeros(len(context), bool)
        order = np.flatnonzero(hit)[np.argsort(where[hit], kind="stable")]
        where, follows, lang, c = where[order], (key % base)[order], lang[order], c[order]
        cost = np.empty((len(kept), n_sym, n_lang), np.float32)
        # only the next depth reads counts and lower costs of this one
        held = np.empty((2, len(kept), n_sym, n_lang), np.float32) if d < depth else None
        for i in range(0, len(kept), BLOCK):
            j = min(i + BLOCK, len(kept))
            mine = slice(*np.searchsorted(where, (i, j)))
            counts = np.zeros((j - i, n_sym, n_lang), np.float32)
            counts[where[mine] - i, follows[mine], lang[mine]] = c[mine]
            here = counts > 0
            if d == 0:
                # below the empty context: all bytes that no language model saw
                left = 256 - here.sum(axis=1, keepdims=True)
                lower = np.broadcast_to(np.log2(np.maximum(left, 1)).astype(np.float32), counts.shape)
            else:
                lower = _escaped(parent[0, at[i:j]], here, parent[1, at[i:j]])
            total, distinct = counts.sum(axis=1, keepdims=True), here.sum(axis=1, keepdims=True)
            every = np.maximum(total + distinct, 1)
            with np.errstate(divide="ignore"):
                cost[i:j] = np.where(here, -np.log2(counts / every),
                                     np.where(distinct > 0, -np.log2(distinct / every), 0) + lower)
            if held is not None:
                held[0, i:j], held[1, i:j] = counts, lower
        tables.append(cost.reshape(-1, n_lang))
        parent, nodes = held, kept
        if not len(kept):
            break
    return ContextTrees(languages, classes, steps, first[:len(steps) + 1], np.concatenate(tables))


def _escaped(counts: np.ndarray, excluded: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Bits of every symbol in contexts that are reached by an escape from a
    longer one which had seen ``excluded``; ``lower``: bits after a further
    escape."""
    left = np.where(excluded, 0, counts)
    total = left.sum(axis=1, keepdims=True)
    distinct = (left > 0).sum(axis=1, keepdims=True)
    every = np.maximum(total + distinct, 1)
    with np.errstate(divide="ignore"):
        return np.where(left > 0, -np.log2(left / every),
                        np.where(distinct > 0, -np.log2(distinct / every), 0) + lower
                        ).astype(np.float32)


def train(docs: DataFrame, depth: int = DEPTH, sample_bytes: int = SAMPLE_BYTES,
          min_count: int = MIN_COUNT, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> ContextTrees:
    """Trees from the labelled rows that are not held out.

    Documents are cut into pieces of ``PIECE`` characters; per language the
    pieces are taken in the order of a hash of id and place until they fill
    ``sample_bytes`` (the documented bound on what is learned from; a little
    more reaches the driver).  Every labelled language has a piece at least.
    """
    # 31 bits of the id's hash, as a number from 0 to 1
    code = F.xxhash64("id", F.lit("language sample"))
    labelled = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                            F.col(lang_col).cast("string").alias("lang"))
                .filter(~is_held_out(F.col("id")) & F.col("lang").isNotNull()
                        & F.col("text").rlike(_LETTER))
                .select("lang", "text", code.alias("code")))
    sizes = labelled.groupBy("lang").agg(F.sum(F.octet_length("text").cast("double")).alias("n")).collect()
    if not sizes:
        return fit_trees({})
    share = {r["lang"]: min(1.0, MARGIN * sample_bytes / r["n"]) for r in sizes}
    picked = labelled.mapInArrow(lambda batches: _pieces(batches, share), _PIECES).collect()
    texts: dict[str, list[str]] = {}
    filled = dict.fromkeys(share, 0)
    for r in sorted(picked, key=lambda r: (r["place"], r["lang"], r["text"])):
        if filled[r["lang"]] < sample_bytes:
            texts.setdefault(r["lang"], []).append(r["text"])
            filled[r["lang"]] += len(r["text"].encode())
    bare = [k for k in share if k not in texts]
    if bare:
        # the share met no piece: from the first letter of the document with the least hash
        one = F.substring(F.regexp_extract("text", r"(?s)\p{L}.*", 0), 1, PIECE)
        least = (labelled.filter(F.col("lang").isin(bare)).groupBy("lang")
                 .agg(F.min_by(one, F.struct("code", F.xxhash64("text"))).alias("text")))
        texts |= {r["lang"]: [r["text"]] for r in least.collect()}
    trees = fit_trees(texts, depth, min_count)
    give_back()
    return trees


_PIECES = "lang string, text string, place double"


def _pieces(batches, share: dict[str, float]):
    """The pieces whose hash, as a number from 0 to 1, is below their
    language's share."""
    schema = pa.schema([("lang", pa.string()), ("text", pa.string()), ("place", pa.float64())])
    for batch in batches:
        langs, codes = batch.column("lang").to_pylist(), batch.column("code").to_numpy().view(np.uint64)
        sizes = pc.utf8_length(batch.column("text")).to_numpy()
        out = {"lang": [], "text": [], "place": []}
        for i, lang in enumerate(langs):
            n = -(-int(sizes[i]) // PIECE)
            k = np.arange(n, dtype=np.uint64)
            place = ((codes[i] ^ np.where(k > 0, mix(k), k)) & np.uint64(0x7FFFFFFF)) / float(1 << 31)
            at = np.flatnonzero(place < share[lang])
            if len(at):
                text = batch.column("text")[i].as_py()
                out["lang"] += [lang] * len(at)
                out["text"] += [text[j * PIECE:(j + 1) * PIECE] for j in at.tolist()]
                out["place"] += place[at].tolist()
        if out["lang"]:
            yield rows(out, schema)


def predict(docs: DataFrame, trees: ContextTrees, id_col: str = "doc_id",
            text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns ``keep``), lang_pred, score and bits_per_byte.

    ``score`` is the posterior of the prediction under equal priors.  Null
    texts and texts without a letter, and all texts if no language was
    learned, give ``und`` with score 0 (ties: the first name).  Repeated
    rows stay, null ids are passed on.
    """
    keep = keep or [id_col]
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    source = docs.select(*dict.fromkeys([*keep, text_col]))
    names = [("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())]
    out_type = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double") \
        .add("bits_per_byte", "double")

    def run(batches):
        model = shared.value
        for batch in batches:
            for part, texts in text_slices(batch, text_col, 2 << 20):
                raw, offsets = text_buffer(pc.utf8_lower(texts))
                n = np.diff(offsets)
                lettered = pc.match_substring_regex(texts, _LETTER).to_numpy(zero_copy_only=False)
                pred = np.full(len(texts), UNKNOWN, dtype=object)
                score, per_byte = np.zeros(len(texts)), np.zeros(len(texts))
                if model.languages:
                    bits = model.bits(raw, offsets)
                    best = bits.argmin(axis=1)
                    least = bits.min(axis=1)
                    chance = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                    pred[lettered] = np.array(model.languages, dtype=object)[best[lettered]]
                    score[lettered] = chance[lettered]
                    per_byte = least / np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in keep]
                    + [pa.array(v, t) for v, (_, t) in zip((pred, score, per_byte), names)],
                    names=[*keep, *(c for c, _ in names)])

    return source.mapInArrow(run, out_type)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; see ``train`` and
    ``predict``.  Language, source and id of a row take no part in its
    prediction; a null id counts as held out."""
    trees = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **options)
    found = predict(docs, trees, id_col, text_col)
    return found.select(F.col(id_col).alias("doc_id"), is_held_out(F.col(id_col)).alias("held_out"),
                        "lang_pred", "score", "bits_per_byte")
