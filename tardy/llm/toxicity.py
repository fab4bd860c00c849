"""Toxicity scores: gradient-boosted trees over dense text features.

Features of a text, all rates per word or letter: hits of a fixed lexicon of
insults and of words learned from the labels, hits near a second-person
word, capitals, words in capitals, punctuation, exclamation marks, words
obfuscated with digits or symbols, and the logarithms of words and hits.
The boosted trees are Spark's; an isotonic regression fitted on training
rows that the trees did not see turns their output into probabilities.

The distinct words of a batch are classified once (Arrow dictionary); counts
and the proximity windows are array operations over word positions.
"""

from __future__ import annotations

import re
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, Scratch, is_held_out, segment_sums, text_buffer, text_slices

#: general insults (fixed values)
LEXICON = """
idiot idiots moron morons stupid dumb fool fools loser losers scum trash garbage clown clowns
pathetic worthless disgusting filthy jerk creep pig vermin coward liar imbecile cretin
dummkopf trottel abschaum widerlich versager blödmann drecksack
imbécile crétin connard débile minable ordure salaud dégoûtant
imbécil estúpido estúpida basura escoria asqueroso patético inútil
""".split()
#: second-person words (fixed values)
SECOND_PERSON = """
you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos
tú ti usted ustedes vosotros os
""".split()
#: signs written for letters (fixed values)
LEET = str.maketrans("013457@$!|", "oieastasil")
WINDOW = 5
#: labelled rows that the model is fitted on, at most (smallest hashes of ids)
MAX_TRAIN_ROWS = 20_000
#: learned words: most kept, fewest toxic texts with one, least ratio of the
#: shares of toxic and other texts that have it
MAX_LEARNED, MIN_TOXIC_TEXTS, MIN_RATIO = 200, 8, 20.0
TREES, DEPTH, STEP, MIN_NODE = 20, 3, 0.3, 10
CACHE_ENTRIES = 200_000

FEATURES = ["lexicon_rate", "log_lexicon", "learned_rate", "log_learned", "near_rate", "log_near",
            "second_rate", "capital_rate", "shout_rate", "punct_rate", "exclaim_rate",
            "obfuscated_rate", "log_words"]
_LEX, _LEARNED, _SECOND, _SHOUT, _OBFUSCATED, _WORD = (1 << k for k in range(6))


#: signs that never stand for a letter or mark one
_SEPARATOR = re.compile(r"[^\w@$!|*.]+")


def _trimmed(word: str) -> str:
    while word and not word[0].isalnum() and word[0] not in "@$":
        word = word[1:]
    while word and not word[-1].isalnum():
        word = word[:-1]
    return word


class WordKinds:
    """Bit sets of what the words of a white-space separated one are."""

    def __init__(self, learned: tuple[str, ...]):
        self.lexicon, self.learned = set(LEXICON), set(learned)
        self.second = set(SECOND_PERSON)
        self.known = BoundedCache(CACHE_ENTRIES)

    def classify(self, word: str) -> bytes:
        """Bit sets of the words that signs join in a white-space separated
        one: its runs of letters, as words are learned, or a word as a whole
        where signs stand for letters of the lexicon."""
        core = _trimmed(word)
        if not any(c.isalpha() for c in core):
            return b"\0"
        whole = self._kind(core)
        if core.isalpha() or whole & _LEX:
            return bytes([whole])
        kinds = []
        for piece in map(_trimmed, _SEPARATOR.split(core)):
            if self._kind(piece) & _LEX:
                kinds.append(self._kind(piece))
            else:
                kinds += [self._kind("".join(run)) for letters, run in groupby(piece, str.isalpha) if letters]
        shout = 0 if any(k & _SHOUT for k in kinds) else whole & _SHOUT
        kinds[0] |= whole & _OBFUSCATED | shout
        return bytes(kinds)

    def _kind(self, core: str) -> int:
        kind, low = _WORD, core.lower()
        if not core.isalpha():
            plain = "".join(c for c in low.translate(LEET) if c.isalpha())
            marked = any(c in "0134575@$!|*._" for c in low)
            if marked and any(c.isalpha() for c in low):
                kind |= _OBFUSCATED
                if plain in self.lexicon:
                    kind |= _LEX
        if low in self.lexicon:
            kind |= _LEX
        if low in self.learned:
            kind |= _LEARNED
        if low in self.second:
            kind |= _SECOND
        if len(core) > 1 and core.isupper():
            kind |= _SHOUT
        return kind

    def features(self, texts: pa.Array) -> np.ndarray:
        """[text, feature]; a text without words has only zeros."""
        cut = pc.utf8_split_whitespace(texts)
        offsets = np.asarray(cut.offsets, dtype=np.int64)
        coded = cut.values.dictionary_encode()
        words, get, put = coded.dictionary.to_pylist(), self.known.get, self.known.put
        kinds = []
        for w in words:
            k = get(w)
            kinds.append(put(w, self.classify(w)) if k is None else k)
        # a word of several gives one entry each
        flat, size = np.frombuffer(b"".join(kinds), np.uint8), np.array([len(k) for k in kinds], np.int64)
        at = coded.indices.to_numpy()
        ends = np.r_[0, np.cumsum(size[at])]
        kind = flat[np.repeat((np.cumsum(size) - size)[at] - ends[:-1], size[at]) + np.arange(ends[-1])]
        offsets = ends[offsets - offsets[0]]

        def count(flags: np.ndarray) -> np.ndarray:
            return segment_sums(flags.astype(np.int64), offsets).astype(np.float64)

        hit = (kind & (_LEX | _LEARNED)) > 0
        second = np.r_[0, np.cumsum((kind & _SECOND) > 0)]
        at = np.flatnonzero(hit)
        doc = np.searchsorted(offsets, at, side="right") - 1
        near = second[np.minimum(at + WINDOW + 1, offsets[doc + 1])] \
            > second[np.maximum(at - WINDOW, offsets[doc])]
        near_count = np.bincount(doc[near], minlength=len(texts)).astype(np.float64)
        raw, ends = text_buffer(texts)
        table = np.zeros((256,), np.uint8)      # 1 capital, 2 other letter, 3 punctuation, 4 "!"
        table[33:127] = 3
        table[48:58] = 0
        table[65:91], table[97:123], table[128:], table[33] = 1, 2, 2, 4
        sign = table[raw]
        capital, small, punct, exclaim = (segment_sums((sign == k).astype(np.int64), ends).astype(float)
                                          for k in (1, 2, 3, 4))
        n = np.maximum(count((kind & _WORD) > 0), 1)
        lex, learned = count((kind & _LEX) > 0), count((kind & _LEARNED) > 0)
        sizes = np.maximum(np.diff(ends), 1)
        return np.column_stack([
            lex / n, np.log1p(lex), learned / n, np.log1p(learned), near_count / n,
            np.log1p(near_count), count((kind & _SECOND) > 0) / n,
            capital / np.maximum(capital + small, 1), count((kind & _SHOUT) > 0) / n,
            punct / sizes, exclaim / sizes, count((kind & _OBFUSCATED) > 0) / n, np.log(n)])


def text_features(docs: DataFrame, learned: list[str], keep: list[str],
                  text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and one double per feature."""
    source = docs.select(*dict.fromkeys([*keep, text_col]))
    out_type = docs.select(*keep).schema
    for f in FEATURES:
        out_type = out_type.add(f, "double")
    words = tuple(learned)

    def run(batches):
        kinds = WordKinds(words)
        for batch in batches:
            for part, texts in text_slices(batch, text_col, 2 << 20):
                x = kinds.features(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in keep] + [pa.array(x[:, j]) for j in range(x.shape[1])],
                    names=[*keep, *FEATURES])

    return source.mapInArrow(run, out_type)


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id, text, toxic of at most ``max_rows`` labelled rows that are not
    held out; only this bounded part of the labels is broadcast."""
    picked = (labels.select("doc_id", F.col("toxic").cast("double").alias("toxic"))
              .filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0.0, 1.0)
                      & ~is_held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id", F.lit("toxicity sample")), "doc_id").limit(max_rows))
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def learn_words(train: DataFrame) -> list[str]:
    """Words far more frequent (by texts) in toxic training texts."""
    sizes = {r["toxic"]: r["n"] for r in
             train.dropDuplicates(["text", "toxic"]).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return []
    words = F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word")
    ratio = (F.col("toxic_texts") / sizes[1.0]) / ((F.col("texts") - F.col("toxic_texts") + 0.5) / sizes[0.0])
    least = max(MIN_TOXIC_TEXTS, int(0.02 * sizes[1.0]))
    found = (train.dropDuplicates(["text", "toxic"]).select("toxic", words)
             .filter(F.length("word") > 1).groupBy("word")
             .agg(F.count("*").alias("texts"), F.sum("toxic").alias("toxic_texts"))
             .filter((F.col("toxic_texts") >= least) & (ratio >= MIN_RATIO))
             .orderBy(F.desc("toxic_texts"), "word").limit(MAX_LEARNED))
    return sorted(r["word"] for r in found.select("word").collect())


class ToxicityModel:
    """Learned words, boosted trees and calibration; ``constant`` is the score
    of every text if the labels have fewer than two classes."""

    def __init__(self, words: list[str], trees: GBTClassificationModel | None = None,
                 calibration: IsotonicRegressionModel | None = None, constant: float = 0.0):
        self.words, self.trees, self.calibration, self.constant = words, trees, calibration, constant

    def score(self, docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
        """The columns ``keep``, score and predicted."""
        if self.trees is None:
            out = docs.select(*keep, F.lit(float(self.constant)).alias("score"))
        else:
            rows = text_features(docs, self.words, keep, text_col)
            rows = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(rows)
            rows = self.trees.transform(rows).select(
                *keep, vector_to_array("probability")[1].alias("_raw"))
            if self.calibration is None:
                out = rows.select(*keep, F.col("_raw").alias("score"))
            else:
                # a thousandth of the raw output keeps the order inside the
                # flat steps of the calibration
                fine = F.col("_score") * 0.999 + F.col("_raw") * 0.001
                out = self.calibration.transform(rows).select(
                    *keep, F.greatest(F.lit(0.0), F.least(F.lit(1.0), fine)).alias("score"))
        return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> ToxicityModel:
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    train = scratch.table(training_rows(docs, labels, max_rows), "train")
    words = learn_words(train)
    rows = scratch.table(text_features(train, words, ["doc_id", "toxic"])
                         .withColumn("_hold", F.crc32(F.concat(F.lit("calibrate "), F.col("doc_id")
                                                               .cast("string")).cast("binary")) % 5 == 0),
                         "features")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(rows)
    seen = {(r["_hold"], r["toxic"]): r["n"] for r in
            rows.groupBy("_hold", "toxic").agg(F.count("*").alias("n")).collect()}
    kinds = {toxic for _, toxic in seen}
    if len(kinds) < 2 or not (seen.get((False, 0.0)) and seen.get((False, 1.0))):
        total = sum(seen.values())
        share = sum(n for (_, toxic), n in seen.items() if toxic == 1.0) / total if total else 0.0
        scratch.drop()
        return ToxicityModel(words, constant=share if len(kinds) < 2 else min(share, 0.49))
    trees = GBTClassifier(featuresCol="_features", labelCol="toxic", maxIter=TREES, maxDepth=DEPTH,
                          stepSize=STEP, minInstancesPerNode=MIN_NODE, seed=7).fit(rows.filter(~F.col("_hold")))
    calibration = None
    if seen.get((True, 0.0), 0) and seen.get((True, 1.0), 0):
        held = trees.transform(rows.filter("_hold")).select(
            "toxic", vector_to_array("probability")[1].alias("_raw"))
        calibration = IsotonicRegression(featuresCol="_raw", labelCol="toxic",
                                         predictionCol="_score").fit(held)
    scratch.drop()
    return ToxicityModel(words, trees, calibration)


def score_documents(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Labels of rows that are not held out train the model; labels, language,
    source and id of a row take no part in its score.  Null and empty texts
    are scored by their (zero) features.  A null id counts as held out;
    repeated rows stay; labels without a document and null labels are
    ignored, of several labels for an id toxic wins.
    """
    scored = fit(docs, labels, max_rows).score(docs, ["doc_id"])
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
