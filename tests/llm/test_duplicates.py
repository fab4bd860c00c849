"""Near-duplicate documents and vectors, nearest neighbours, components: against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tardy.llm import components, embedding_dedup, minhash_dedup, nearest, queries
from tardy.llm.common import Scratch, ship
from tardy.llm.components import connected_components

SF = "/root/testdata/sf0.01"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)



def classes(nodes, links):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK_EDGES", one_task)
    r = random.Random(1)
    links = [(i, i + 1) for i in range(200, 260)] + [(1000, i) for i in range(1001, 1300)]
    links += [(r.randrange(2000, 2200), r.randrange(2000, 2200)) for _ in range(150)]
    df = spark.createDataFrame(links + [(5, 5), (None, 3), (1001, 1000)], "a long, b long")
    scratch = Scratch(spark, "test")
    got = {x.node: x.component for x in connected_components(df, scratch).collect()}
    real = [(a, b) for a, b in links if a != b]
    assert got == classes({n for x in real for n in x}, real)
    assert connected_components(df.limit(0), scratch).count() == 0


def weighted_links(texts, threshold=0.8):
    """All pairs, by the operator's own weights of whole shingles."""
    sets = []
    for t in texts:
        w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    inverse, shared = defaultdict(list), defaultdict(int)
    for i, s in enumerate(sets):
        for x in s:
            inverse[x].append(i)
    for own in inverse.values():
        for a in range(len(own)):
            for b in range(a + 1, len(own)):
                shared[own[a], own[b]] += 1
    return [(a, b, c / (len(sets[a]) + len(sets[b]) - c)) for (a, b), c in shared.items()]


def test_minhash_groups_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    got = queries.op9_minhash_dedup(spark, SF).toPandas().set_index("doc_id")
    assert len(got) == len(docs) and (got.kept == (got.index == got.component_id)).all()
    links = weighted_links(docs.text.tolist())
    clear = [(docs.doc_id[a], docs.doc_id[b]) for a, b, j in links if j >= 0.85]
    assert len(clear) > 50
    missed = sum(got.component_id[a] != got.component_id[b] for a, b in clear)
    assert missed <= 0.01 * len(clear)
    loose = classes(docs.doc_id, [(docs.doc_id[a], docs.doc_id[b]) for a, b, j in links if j >= 0.74])
    assert all(loose[d] == loose[c] for d, c in got.component_id.items())


def test_similarity_is_weighted_jaccard():
    import pyarrow as pa

    weights = np.zeros(1 << minhash_dedup.IDF_BITS)
    left = ["a b c d e f", "one two", "a b c d e f a b c d e", "", "A, b! c. d e F"]
    right = ["a b c d e g", "one two", "a b c d e", "x", "a b c d e f"]
    got = minhash_dedup.similarities(pa.array(left), pa.array(right), weights)
    # the third text has its first shingle twice: a count of 2 weighs 2
    assert np.allclose(got, [1 / 3, 1, 1 / 7, 0, 1])


def test_shingles_of_very_few_words():
    import pyarrow as pa

    for text, n in (("", 0), ("one", 1), ("one two", 1), ("a b c d e", 1), ("a b c d e f", 2)):
        words, offsets = minhash_dedup.word_hashes(pa.array([text]))
        h, doc = minhash_dedup.shingles(words, offsets)
        assert len(h) == n and (doc == 0).all()
    both = minhash_dedup.shingles(*minhash_dedup.word_hashes(pa.array(["one two", "", "one two"])))
    assert both[0][0] == both[0][1] and both[1].tolist() == [0, 2]


def test_samples_collide_as_often_as_the_weighted_jaccard():
    import pyarrow as pa

    r = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    changed = list(words)
    for i in r.sample(range(400), 12):
        changed[i] = f"c{i}"
    weights = np.log(np.random.default_rng(1).uniform(1, 2, 1 << minhash_dedup.IDF_BITS))
    texts = pa.array([" ".join(words), " ".join(changed)])
    true = minhash_dedup.similarities(texts[:1], texts[1:], weights)[0]
    _, _, h, doc, lw = minhash_dedup.weighted_sets(texts, weights)
    keys, marks = minhash_dedup.band_keys(h, doc, lw, 2, bands=2000, per_band=1)
    assert abs((keys[0] == keys[1]).mean() - true) < 0.04 and abs((marks[0] == marks[1]).mean() - true) < 0.05


def test_minhash_edge_cases(spark):
    base = " ".join(f"word{i}" for i in range(120))
    near = base.replace("word60", "other")
    rows = [(5, base), (3, base.upper() + "!"), (9, near), (None, base), (1, None), (2, ""), (4, "..."), (4, "..."),
            (6, "short text"), (7, "Short, text"), (8, base + " " + " ".join(f"x{i}" for i in range(200))),
            (10, "twin " * 300), (10, base), (11, "twin " * 300)]
    df = spark.createDataFrame([(a, b, "clash") for a, b in rows], "doc_id long, text string, node string")
    got = minhash_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.component_id, r.kept))
    assert by[3] == {(3, True)} and by[5] == by[9] == by[10] == by[11] == {(3, False)}
    assert by[6] == {(6, True)} and by[7] == {(6, False)} and by[8] == {(8, True)}
    assert by[None] == {(None, True)} and by[1] == {(1, True)} and by[4] == {(4, True)}
    assert minhash_dedup.near_duplicates(df.limit(0)).count() == 0


def test_minhash_hot_groups(spark):
    """A group of hundreds of near copies and a passage in every document."""
    r = random.Random(4)
    base = [f"b{i}" for i in range(200)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for i in range(300):
        own = list(base)
        own[r.randrange(200)] = f"e{i}"
        rows.append((i, " ".join(own)))
    for i in range(300, 600):
        rows.append((i, " ".join(f"u{i}x{j}" for j in range(100)) + " " + passage))
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(x.component_id == (0 if x.doc_id < 300 else x.doc_id) for x in got)


def cosines(x):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T


def planted_vectors(n=600, dim=24, seed=3):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim))
    for i in range(0, n // 2, 3):
        x[i + 1] = x[i] + r.standard_normal(dim) * 0.02 * np.linalg.norm(x[i]) / np.sqrt(dim) * r.uniform(1, 12)
    x[400:440] = x[400]
    x[440:520] = x[440] + r.standard_normal((80, dim)) * 0.03
    return x


def test_embedding_links(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    x = planted_vectors()
    labels = np.arange(len(x)) // 100 % 3
    labels[400:520] = 1
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, labels))],
                               "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.near_duplicates(df).toPandas().set_index("vec_id").sort_index()
    near = (cosines(x) >= 0.98) & (labels[:, None] == labels[None])
    np.fill_diagonal(near, False)
    assert got.n_links.tolist() == near.sum(axis=1).tolist()
    parts = classes(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(near))])
    assert got.component_id.to_dict() == parts and (got.kept == (got.index == got.component_id)).all()


def test_embedding_links_of_the_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    x, label = np.array(e.embedding.tolist(), dtype=float), e.label.to_numpy()
    near = (cosines(x) >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    got = queries.op2_embedding_dedup(spark, "/root/testdata/sf0.1").toPandas().set_index("vec_id")
    assert (got.n_links[e.vec_id].to_numpy() == near.sum(axis=1)).all()


def test_embedding_edge_cases(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(1, one, 1), (2, [2.0, 4.0, 6.0], 1), (3, one, None), (4, None, 1), (5, [0.0] * 3, 1), (6, [1.0, None, 3.0], 1),
            (7, [float("nan"), 1.0, 1.0], 1), (8, [float("inf"), 1.0, 1.0], 1), (9, [1.0, 2.0], 1), (None, one, 1),
            (10, one, 2), (11, one, 1), (11, one, 1), (12, [1e-200, 2e-200, 3e-200], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("clash"))
    got = embedding_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert by[1] == (4, 1, True) and by[2] == by[11] == by[12] == (4, 1, False)
    for k in (3, 4, 5, 6, 7, 8, 9, 10):
        assert by[k] == (0, k, True)
    assert by[None] == (0, None, True)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def brute_nearest(ids, x, queries_, k=5):
    s = cosines(x)
    out = {}
    for q in queries_:
        order = sorted((j for j in range(len(ids)) if ids[j] != ids[q]), key=lambda j: (-round(s[q, j], 12), ids[j]))
        out[int(ids[q])] = [int(ids[j]) for j in order[:k]]
    return out


def test_nearest_recall(spark):
    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
        x, ids = np.array(e.embedding.tolist(), dtype=float), e.vec_id.to_numpy()
        expected = brute_nearest(ids, x, np.flatnonzero(ids % 50 == 0))
        got = queries.op5_nearest(spark, sf).toPandas()
        assert (got.groupby("query_id")["rank"].apply(sorted).apply(tuple) == (1, 2, 3, 4, 5)).all()
        hits = sum(len(set(expected[q]) & set(own.vec_id)) for q, own in got.groupby("query_id"))
        assert got.query_id.nunique() == len(expected) and hits >= 0.95 * 5 * len(expected)
        s = cosines(x)
        place = {int(v): i for i, v in enumerate(ids)}
        assert np.allclose(got.score, [s[place[a], place[b]] for a, b in zip(got.query_id, got.vec_id)], atol=1e-12)


def test_nearest_ties_and_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(nearest, "SHARD_ROWS", 40)
    monkeypatch.setattr(nearest, "BLOCK_QUERIES", 2)
    r = np.random.default_rng(7)
    x = r.standard_normal((200, 16)).astype(np.float32).astype(float)
    x[50:120] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(250, None), (300, [0.0] * 16), (350, [1.0]), (400, [float("nan")] * 16), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("shard", F.lit("clash"))
    got = nearest.nearest_neighbours(df, lambda v: v % 50 == 0).toPandas().sort_values(["query_id", "rank"])
    by = {q: own.vec_id.tolist() for q, own in got.groupby("query_id")}
    assert set(by) == {0, 50, 100, 150}
    assert by[50] == [51, 52, 53, 54, 55] and by[100] == [50, 51, 52, 53, 54]
    assert by == brute_nearest(np.arange(200), x, [0, 50, 100, 150]) or sum(
        len(set(a) & set(by[q])) for q, a in brute_nearest(np.arange(200), x, [0, 50, 100, 150]).items()) >= 19
    few = nearest.nearest_neighbours(df.filter("vec_id in (50, 51, 60)"), lambda v: v % 50 == 0).toPandas()
    assert few.vec_id.tolist() == [51, 60]
    assert nearest.nearest_neighbours(df.limit(0), lambda v: v % 50 == 0).count() == 0


def test_stopping_quantile():
    # known values of the chi-square table
    assert abs(nearest.chi_square_quantile(0.95, 2) - 5.991) < 1e-3
    assert abs(nearest.chi_square_quantile(0.95, 12) - 21.026) < 1e-3


def family(n, words=400, seed=6):
    """Pages of a template with five words replaced: pairs at about 0.74, and
    twins (2k, 2k + 1) that share two of the words at about 0.83."""
    r = random.Random(seed)
    texts = []
    for k in range(n // 2):
        at = r.sample(range(5, words - 5, 5), 8)
        for twin, own in enumerate((at[:5], at[:2] + at[5:])):
            page = [f"b{i}" for i in range(words)]
            for place in own:
                page[place] = f"e{k}x{place}" if place in at[:2] else f"e{k}t{twin}x{place}"
            texts.append(" ".join(page))
    return texts


@pytest.mark.parametrize("block", [512, 64])
def test_minhash_links_of_a_template_family(spark, monkeypatch, block):
    import pyarrow as pa

    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    texts = family(400)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weights = minhash_dedup.ln_idf(*minhash_dedup.document_frequencies(df))
    like = minhash_dedup.similarities(pa.array(texts[::2]), pa.array(texts[1::2]), weights)
    twins = np.flatnonzero(like >= 0.8) * 2
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(df).collect()}
    missed = sum(got[a] != got[a + 1] for a in twins.tolist())
    assert len(twins) >= 190 and len(set(got.values())) >= 190 and missed <= 0.01 * len(twins)


def test_ids_with_several_vectors_keep_the_links_of_each(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (4, [1.0, 1.0], 0),
            (9, [-1.0, 0.0], 0), (8, [-1.0, 0.0], 0), (9, [0.0, -1.0], 0), (7, [0.0, -1.0], 0), (7, [0.0, -1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True),
                   (7, 0, 7, True), (7, 1, 7, True), (8, 1, 7, False), (9, 1, 7, False), (9, 1, 7, False)]


def test_embedding_links_planted_in_the_table(spark):
    """The table itself holds no link: near copies of some of its vectors are
    added, and all rows are compared by brute force."""
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    r = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in v], None if lab is None or lab != lab else int(lab))
            for i, v, lab in table.itertuples(index=False)]
    for k, (_, v, lab) in enumerate(rows[:120]):
        noise = np.asarray(v) + r.normal(size=len(v)) * np.linalg.norm(v) / np.sqrt(len(v)) * r.uniform(0.05, 0.3)
        rows.append((10_000 + k, noise.tolist(), lab))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = np.triu(x @ x.T >= embedding_dedup.THRESHOLD, 1)
    links = [(rows[a][0], rows[b][0]) for a, b in zip(*np.nonzero(near))
             if rows[a][2] is not None and rows[a][2] == rows[b][2]]
    assert len(links) > 20
    want = classes([i for i, _, _ in rows], links)
    got = embedding_dedup.near_duplicates(df).collect()
    assert {g.vec_id: g.component_id for g in got} == want
    assert sum(g.n_links for g in got) == 2 * len(links)


def test_ids_with_several_texts_keep_the_links_of_each(spark):
    r = random.Random(8)
    text = [" ".join(f"w{r.randrange(10**6)}" for _ in range(200)) for _ in range(4)]
    near = [t + " end of it" for t in text]
    rows = [(1, text[0]), (1, text[1]), (2, near[0]), (3, near[1]), (4, text[2]), (4, text[2].upper()), (6, near[2]),
            (5, text[3]), (7, near[3]), (7, near[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.doc_id, x.component_id) for x in minhash_dedup.near_duplicates(df).collect()}
    # 7 has near copies of 1 and of 5, so all of these are one group
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (6, 4), (5, 1), (7, 1)}
