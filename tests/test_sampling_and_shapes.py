"""Samples, exact percentiles, correlation, density, indices: against plain Python and numpy."""

import hashlib
import math
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tardy.operators import distribution as D
from tardy.operators import explore as E
from tardy.operators import indexing as I
from tardy.operators import ml as M
from tardy.operators import sampling as SA
from tardy.operators import stats as S
from tardy.plans import quantiles as Q
from tardy.plans import sizing


def key(seed, row, copy):
    text = "|".join([str(seed), *["~" if v is None else str(v) for v in row], str(copy)])
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def test_capped_sample_is_the_bottom_k(spark, monkeypatch):
    monkeypatch.setattr(SA, "REPEATS", 100)
    r = random.Random(1)
    rows = [("hot", 1)] * 3000 + [(f"v{r.randrange(500)}", r.randrange(9)) for _ in range(2000)] + [(None, None)] * 5
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "a string, b long")
    seen, keyed = {}, []
    for row in rows:
        seen[row] = seen.get(row, -1) + 1
        keyed.append((key(42, row, seen[row]), row))
    for cap in (0, 1, 300, 5004, 5005, 9000):
        want = sorted([row for _, row in sorted(keyed, key=lambda k: k[0])[:cap]], key=repr)
        for parts in (1, 11):
            got = SA.capped_sample(df.repartition(parts), cap).collect()
            assert sorted([tuple(x) for x in got], key=repr) == want
    tenth = [row for k, row in keyed if k < int(0.1 * 2 ** 60)]
    assert sorted([tuple(x) for x in SA.keyed_sample(df, 0.1).collect()], key=repr) == sorted(tenth, key=repr)
    assert SA.capped_sample(df.limit(0), 5).count() == 0


def test_capped_sample_computes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(rows):
        for batch in rows:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(900, numPartitions=3).mapInArrow(look, "id long")
    assert SA.capped_sample(df, 100).count() == 100
    assert seen.value == 900


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_percentiles_are_exact(spark, accuracy):
    """Small accuracies force real brackets on small data."""
    r = random.Random(3)
    rows = [("hot", r.gauss(0, 1)) for _ in range(6000)] + [("ties", float(r.randrange(4))) for _ in range(900)]
    rows += [(None, float(i)) for i in range(7)] + [("one", 5.0), ("null", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p75": 0.75, "p999": 0.999, "p1": 1.0}
    got = {x.g: x for x in Q.exact_percentiles(df, "x", probs, ["g"], accuracy=accuracy).collect()}
    disc = {x.g: x for x in Q.exact_percentiles(df, "x", probs, ["g"], True, accuracy).collect()}
    assert set(got) == {"hot", "ties", None, "one"}
    for g in got:
        values = sorted(v for k, v in rows if k == g and v is not None)
        for name, p in probs.items():
            assert math.isclose(got[g][name], float(np.quantile(values, p)), rel_tol=0, abs_tol=1e-12)
            assert disc[g][name] == values[max(math.ceil(p * len(values)) - 1, 0)]
    whole = Q.exact_percentiles(df.drop("g"), "x", probs, accuracy=accuracy).first()
    values = [v for _, v in rows if v is not None]
    assert math.isclose(whole.p50, float(np.quantile(values, 0.5)), abs_tol=1e-12) and whole.n == len(values)
    assert Q.exact_percentiles(df.limit(0), "x", probs, ["g"]).count() == 0


def test_a_missed_bracket_falls_back_to_all_ranks(spark, monkeypatch):
    monkeypatch.setattr(Q, "REACH", -40)  # brackets beside the ranks
    df = spark.createDataFrame([(float(i),) for i in range(3000)], "x double")
    assert Q.exact_percentiles(df, "x", {"m": 0.5}, accuracy=100).first().m == 1499.5


def test_brackets_hold_a_small_part_of_the_values(spark):
    df = spark.range(40000).select((F.col("id") * 7919 % 40009).cast("double").alias("v"))
    rows, _ = Q._bracketed(df, [0.25, 0.5, 0.75], [], 1000)
    assert 0 < rows.count() < 40000 * 3 * 3 * Q.REACH / 1000


def test_correlation_is_pairwise_complete(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(2000, 4)) * [1, 50, 1e-3, 5] + [1e6, 0, 3, -7]
    x[:, 1] += 30 * (x[:, 0] - 1e6)
    holes = r.random(x.shape) < 0.2
    rows = [[None if h else float(v) for v, h in zip(a, b)] + [4.0, None] for a, b in zip(x, holes)]
    cols = list("abcdef")
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))
    got = {(g.col_a, g.col_b): g.corr for g in E.correlation_matrix(df, cols).collect()}
    for i, a in enumerate("abcd"):
        for j, b in enumerate("abcd"):
            ok = ~holes[:, i] & ~holes[:, j]
            assert math.isclose(got[a, b], np.corrcoef(x[ok, i], x[ok, j])[0, 1], abs_tol=1e-8)
    assert got["a", "f"] is None and math.isnan(got["a", "e"])
    assert {g.corr for g in E.correlation_matrix(df.limit(0), cols).collect()} == {None}


def test_density_equals_the_sum_of_kernels(spark):
    r = np.random.default_rng(4)
    x = np.r_[r.normal(size=4000), r.normal(9, 0.1, size=500), 40.0]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "ArrDelay double")
    got = D.kde_curve(df, points=100).orderBy("point").collect()
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 100)
    want = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(axis=1) / (len(x) * h * math.sqrt(2 * math.pi))
    assert len(got) == 100
    peak = 1 / (h * math.sqrt(2 * math.pi))
    assert np.abs(np.array([g.density for g in got]) - want).max() < 1e-12 * peak
    assert D.kde_curve(df.limit(0)).count() == 0


@pytest.mark.parametrize("ranges", [None, 3])
def test_category_index_over_key_ranges(spark, ranges):
    r = random.Random(6)
    rows = [(f"c{r.randrange(400)}", r.choice(["x", "y"])) for _ in range(3000)] + [(None, "x")] * 3
    df = spark.createDataFrame(rows, "c string, d string")
    index = I.category_index(df.dropna(), ["c", "d"], ranges)
    got = {(g.column, g.label): g["index"] for g in index.collect()}
    for i, c in enumerate("cd"):
        counts = {}
        for row in rows:
            if row[0] is not None:
                counts[row[i]] = counts.get(row[i], 0) + 1
        for k, v in enumerate(sorted(counts, key=lambda v: (-counts[v], v))):
            assert got[c, v] == k
    out = I.with_indices(df, index, ["c", "d"])
    assert out.count() == len(rows)
    assert {g.cIndex for g in out.filter("c is null").collect()} == {float(len({c for c, _ in rows if c}))}


def test_statistics_are_read_as_one_version(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/stats"

    def tables(value):
        df = spark.createDataFrame([("WN", 9, "A-B", "A", "B", float(value))],
                                   "UniqueCarrier string, DepHour int, Route string, Origin string, Dest string, ArrDelay double")
        rd = spark.createDataFrame([("A", "B", value)], "Origin string, Dest string, Distance int")
        return {**S.split_stats(S.all_stats_long(df)), "route_distances": rd}

    def seen():
        loaded = S.load_stats(spark, root)
        return {n: {r[-1 if n == "route_distances" else len(S.SPEC_BY_NAME[n].keys)] for r in t.collect()}
                for n, t in loaded.items()}

    S.save_stats(tables(1), root)
    assert all(v == {1} for v in seen().values())
    opened = S.load_stats(spark, root)
    # a save that stops before its last table changes nothing
    with pytest.raises(Exception):
        S.save_stats({**tables(2), "broken": spark.range(1).select(F.raise_error(F.lit("x")))}, root)
    assert all(v == {1} for v in seen().values())
    # readers during saves see one version
    stop, mixed = threading.Event(), []

    def read():
        while not stop.is_set():
            mixed.append(len(set(map(frozenset, seen().values()))))

    t = threading.Thread(target=read)
    t.start()
    for value in (3, 4):
        S.save_stats(tables(value), root)
    stop.set()
    t.join()
    assert set(mixed) == {1} and all(v == {4} for v in seen().values())
    assert opened["hour_stats"].first().AvgHourDelay == 1  # kept for its reader
    S.save_stats(tables(5), root)
    assert len(S.stats_versions(spark, root)) == 3


def test_broadcast_budget_is_spent_on_the_smallest(spark):
    assert sizing.within_budget({"a": 5, "b": 1, "c": 4, "d": 90}, 10) == {"a", "b", "c"}
    rows = [("WN", i % 24, f"R{i}", f"O{i % 9}", "D", float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "UniqueCarrier string, DepHour int, Route string, Origin string, Dest string, ArrDelay double")
    stats = S.compute_stats(df, max_broadcast_bytes=20_000)
    assert stats.large == {"route_stats"}
    assert S.compute_stats(df).large == set()


def test_salted_join_equals_the_plain_one(spark):
    df = spark.createDataFrame([("hot", i) for i in range(500)] + [("b", 1), (None, 2), ("zz", 3)], "k string, i int")
    table = spark.createDataFrame([("hot", 1.0), ("b", 2.0), ("c", 3.0)], "k string, v double")
    plain = sorted(map(tuple, df.join(table, ["k"], "left").collect()), key=repr)
    assert sorted(map(tuple, sizing.salted_left_join(df, table, ["k"]).collect()), key=repr) == plain


def test_fold_stages_never_see_their_own_rows(spark):
    numeric, cats = ["n", "m"], ["c", "d"]
    rows = [(f"v{i % 5}", float(i), float(-i), i % 3, f"w{i % 7}") for i in range(60)]
    rows += [("only0", 1e6, 0.0, 0, "w"), ("only1", -1e6, 0.0, 1, "x")]
    df = spark.createDataFrame(rows, f"c string, n double, m double, {M.FOLD} int, d string")
    statistics = M.fold_statistics(df, numeric, cats)
    for k in range(3):
        c, d, _, _, scaler, _ = M.fold_stages(df, statistics, k, numeric, cats).stages
        mine = [r for r in rows if r[3] != k]
        assert set(c.labels) == {r[0] for r in mine} and set(d.labels) == {r[4] for r in mine}
        assert list(scaler.originalMin) == [min(r[1] for r in mine), min(r[2] for r in mine)]
        assert list(scaler.originalMax) == [max(r[1] for r in mine), max(r[2] for r in mine)]
        from pyspark.ml import Pipeline
        fitted = Pipeline(stages=M.feature_stages(numeric, cats)).fit(df.filter(F.col(M.FOLD) != k))
        a, b = (p.transform(df).select(M.FEATURES).collect()
                for p in (M.fold_stages(df, statistics, k, numeric, cats), fitted))
        assert a == b
