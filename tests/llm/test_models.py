"""Language identification and toxicity: exact code lengths, held-out quality, edge cases."""

import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tardy.llm import language_id, queries, toxicity
from tardy.llm.common import ship, text_buffer

SF = "/root/testdata/sf0.01"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)



class Brute:
    """The same model byte by byte with dictionaries."""

    def __init__(self, texts, depth, min_count):
        self.count = {lang: defaultdict(lambda: defaultdict(int)) for lang in texts}
        self.total, self.depth, self.min_count = defaultdict(int), depth, min_count
        for lang, own in texts.items():
            for t in own:
                b = t.lower().encode()
                for i in range(len(b)):
                    for d in range(min(i, depth) + 1):
                        self.count[lang][b[i - d:i]][b[i]] += 1
                        self.total[b[i - d:i]] += 1

    def kept(self, c):
        return not c or (self.total[c] >= self.min_count and self.kept(c[1:]) and self.kept(c[:-1]))

    def bits(self, text, lang):
        b, out = text.lower().encode(), 0.0
        for i in range(len(b)):
            d = min(i, self.depth)
            while not self.kept(b[i - d:i]):
                d -= 1
            ruled_out = set()
            for k in range(d, -1, -1):
                seen = {s: n for s, n in self.count[lang][b[i - k:i]].items() if s not in ruled_out}
                every = sum(seen.values()) + len(seen)
                if b[i] in seen:
                    out -= math.log2(seen[b[i]] / every)
                    break
                if seen:
                    out -= math.log2(len(seen) / every)
                ruled_out = set(self.count[lang][b[i - k:i]])
            else:
                out += math.log2(256 - len(ruled_out))
        return out


def test_code_lengths_are_exact():
    texts = {"a": ["abracadabra abra ab", "Banana band bandana ab"], "b": ["zebra crossing zoo é", "oo zoom loop"]}
    asked = ["abra zoo", "bananaé!", "", "x", "pool band abracadabra", "\U0001f600"]
    raw, offsets = text_buffer(pa.array(asked))
    for depth, least in ((0, 1), (1, 1), (2, 1), (4, 1), (3, 3), (4, 2)):
        got = language_id.fit_trees(texts, depth, least).bits(raw, offsets)
        brute = Brute(texts, depth, least)
        assert np.allclose(got, [[brute.bits(t, x) for x in "ab"] for t in asked], atol=1e-4)


def test_language_id_on_held_out_documents(spark):
    got = queries.op1_language_id(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().merge(got, on="doc_id")
    assert len(got) == len(docs)
    assert (docs.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in docs.doc_id]).all()
    assert (docs.lang == docs.lang_pred)[docs.held_out].mean() > 0.98
    assert got.score.between(0, 1).all() and set(got.lang_pred) <= {*docs.lang, "und"}


def test_language_id_ignores_label_source_and_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trees = language_id.train(docs)
    a = language_id.predict(docs.limit(200), trees).toPandas()
    b = language_id.predict(docs.limit(200).withColumn("lang", F.lit("xx")), trees).toPandas()
    assert a.equals(b)


def test_language_sample_of_few_long_texts(spark, monkeypatch):
    """One text of a language holds nearly all its bytes: it is never left
    empty, and the sample is bounded and filled."""
    seen = []
    fit = language_id.fit_trees
    monkeypatch.setattr(language_id, "fit_trees", lambda texts, *a: seen.append(texts) or fit(texts, *a))
    for shift in range(4):
        ids = [i for i in range(shift * 1000, shift * 1000 + 100) if zlib.crc32(str(i).encode()) % 5][:8]
        rows = [(ids[0], "palabra larga " * 150_000, "es"), *((i, f"corta {i} " * 20, "es") for i in ids[1:]),
                (shift * 1000 + 500, None, "es"), (ids[0], "short words " * 100, "en")]
        trees = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_bytes=100_000)
        size = {k: sum(len(t.encode()) for t in v) for k, v in seen[-1].items()}
        assert trees.languages == ["en", "es"] and 0 < size["en"] and 60_000 <= size["es"] <= 100_000 + 8192
    few = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_bytes=1)
    assert few.languages == ["en", "es"] and all(len(t) <= 8192 for v in seen[-1].values() for t in v)


def test_language_id_edge_cases(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "", "en"),
            (5, "12 !!", "de"), (None, "the hound", None), (6, "the cat", None), (6, "the cat", None)]
    rows += [(10 + i, t, x) for i in range(30) for t, x in (("the cat and the dog sat", "en"), ("der hund und die katze", "de"))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = language_id.identify(df, min_count=1).toPandas()
    assert len(got) == len(rows)
    by = {k: g for k, g in got.groupby(got.doc_id.fillna(-1))}
    for k in (3, 4, 5):
        assert by[k].lang_pred.tolist() == ["und"] and by[k].score.tolist() == [0.0]
    assert by[6].lang_pred.tolist() == ["en", "en"] and by[-1].held_out.tolist() == [True]
    empty = language_id.identify(df.limit(0))
    assert empty.count() == 0
    unlabelled = language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).toPandas()
    assert set(unlabelled.lang_pred) == {"und"}


def test_toxicity_on_held_out_documents(spark):
    got = queries.op8_toxicity(spark, SF).toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    held = got[got.held_out].merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    assert (held.toxic == held.predicted).mean() > 0.9
    assert held[held.toxic == 0].predicted.mean() < 0.05


def test_toxicity_features():
    kinds = toxicity.WordKinds(())
    x = kinds.features(pa.array(["You are an IDIOT!!", "", "calm words here", "you id1ot", "idiot " + "w " * 8 + "you"]))
    f = dict(zip(toxicity.FEATURES, x.T))
    assert f["lexicon_rate"].tolist() == [0.25, 0, 0, 0.5, 0.1] and (x[1] == 0).all()
    assert f["near_rate"].tolist() == [0.25, 0, 0, 0.5, 0] and f["obfuscated_rate"].tolist() == [0, 0, 0, 0.5, 0]
    assert f["shout_rate"][0] == 0.25 and f["exclaim_rate"][0] == 2 / 18


def test_toxicity_words_joined_by_signs():
    kinds = toxicity.WordKinds(("vile",))
    texts = ["idiot you", "idiot,you", "idiot\u00a0you", "stupid-moron", "(1d1ot/you)", "you're VILE...so", "i.d.i.o.t 12,5", "",
             "don't / U.S.A", "\u00a0"]
    f = dict(zip(toxicity.FEATURES, kinds.features(pa.array(texts)).T))
    count = lambda name: np.round(np.expm1(f[name])).astype(int).tolist()
    assert count("log_lexicon") == [1, 1, 1, 2, 1, 0, 1, 0, 0, 0]
    assert count("log_near") == [1, 1, 1, 0, 1, 1, 0, 0, 0, 0] and count("log_learned") == [0] * 5 + [1] + [0] * 4
    assert np.round(np.exp(f["log_words"])).astype(int).tolist() == [2, 2, 2, 2, 2, 4, 1, 1, 5, 1]
    assert f["shout_rate"][5] > 0 and f["shout_rate"][8] > 0


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "you idiot", "x"), (3, "fine", "x"), (3, "fine", "x")],
                                 "doc_id long, text string, toxic string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(docs, none).toPandas()
    assert len(got) == 5 and (got.predicted == 0).all()
    one = spark.createDataFrame([(i, 0, 1) for i in range(10)] + [(None, 0, 1), (77, 0, None)], none.schema)
    got = toxicity.score_documents(docs, one).toPandas()
    assert len(got) == 5 and got.score.between(0, 1).all()
    assert toxicity.score_documents(docs.limit(0), one).count() == 0
