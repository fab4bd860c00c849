"""Exact percentiles from two scans, without holding a group in one task.

The first scan builds a mergeable quantile sketch per group; its values a
little below and above each wanted share bracket the exact one.  The second
scan counts what lies below each bracket and reduces what lies inside to
(value, count): a few of ``ACCURACY`` parts of the rows, whatever the number
of distinct values.  Running counts in value order
(``prefix.exclusive_prefix_sums``) then give the value at each wanted rank.

Should a bracket miss its rank (the sketch's error is a bound in the mean of
its merges, not checked by it), all distinct values are ranked instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import exclusive_prefix_sums
from .sizing import bounded_broadcast, materialize

#: relative accuracy of the sketch (its rank error is about n / ACCURACY), and
#: how many times that error a bracket reaches to either side
ACCURACY, REACH = 10_000, 4


def ranked_values(df: DataFrame, value: str, groups: list[str]) -> DataFrame:
    """(groups..., v, c, before, n): distinct values with their counts, the
    number of values below them and the group size."""
    # written once: the running counts and the group sizes both read it
    counts = materialize(df.select(*groups, F.col(value).cast("double").alias("v"))
                           .filter(F.col("v").isNotNull())
                           .groupBy(*groups, "v").agg(F.count(F.lit(1)).alias("c")))
    ranked = exclusive_prefix_sums(counts, "v", ["c"], partition_cols=groups)
    sizes = counts.groupBy(*groups).agg(F.sum("c").alias("n")) if groups else None
    if groups:
        return ranked.join(sizes, groups)
    n = counts.agg(F.sum("c").alias("n")).scalar()
    return ranked.withColumn("n", n)


def _bracketed(data: DataFrame, probs: list[float], groups: list[str], accuracy: int) -> tuple[DataFrame, DataFrame]:
    """(groups..., n, p, v, c, c_before) and the written brackets of each
    group: for the p-th share the distinct values of its bracket with their
    counts and the number of values below.  A first row without value stands
    for all that is below the bracket."""
    reach = REACH / accuracy
    marks = [min(1.0, max(0.0, q)) for p in probs for q in (p - reach, p + reach)]
    found = data.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        F.percentile_approx("v", marks, accuracy).alias("q"))
    # a small group is its own bracket
    small = F.col("n") <= accuracy
    edges = [F.struct(F.when(small, F.col("lo")).otherwise(F.col("q")[2 * i]).alias("lo"),
                      F.when(small, F.col("hi")).otherwise(F.col("q")[2 * i + 1]).alias("hi"))
             for i in range(len(probs))]
    brackets = materialize(found.select(*[F.col(g).alias(f"_b_{g}") for g in groups], "n", F.array(*edges).alias("edges")))
    if groups:
        same = [F.col(g).eqNullSafe(F.col(f"_b_{g}")) for g in groups]
        met = data.join(bounded_broadcast(brackets, already_materialized=True), same)
    else:
        one = brackets.select(F.struct("n", "edges").alias("s")).scalar()
        met = data.withColumns({"n": one.getField("n"), "edges": one.getField("edges")})
    v = F.col("v")
    places = [F.when(v < F.col("edges")[i]["lo"], F.struct(F.lit(i).alias("p"), F.lit(None).cast("double").alias("v")))
              .when(v <= F.col("edges")[i]["hi"], F.struct(F.lit(i).alias("p"), v.alias("v")))
              for i in range(len(probs))]
    counts = (met.select(*groups, "n", F.explode(F.array_compact(F.array(*places))).alias("m"))
              .select(*groups, "n", "m.p", "m.v").groupBy(*groups, "n", "p", "v").agg(F.count(F.lit(1)).alias("c")))
    # the row without value comes first in the order of values
    ranked = exclusive_prefix_sums(counts, "v", ["c"], partition_cols=[*groups, "n", "p"])
    return ranked.filter(v.isNotNull()), brackets


def _value_at(rank: Column, place: Column | None = None) -> Column:
    hit = (F.col("c_before") <= rank) & (rank < F.col("c_before") + F.col("c"))
    return F.max(F.when(hit if place is None else hit & place, F.col("v")))


def exact_percentiles(df: DataFrame, value: str, probs: dict[str, float], groups: list[str] | None = None,
                      discrete: bool = False, accuracy: int = ACCURACY) -> DataFrame:
    """One row per group with a column per probability.  Linear
    interpolation between the neighbouring ranks (as ``percentile``), or
    the first value whose cumulative share reaches p (``percentile_disc``)."""
    groups = groups or []
    data = df.select(*groups, F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    ranked, brackets = _bracketed(data, list(probs.values()), groups, accuracy)
    out = materialize(_pick(ranked, probs, groups, discrete, True))
    if out.dropna(subset=list(probs)).count() == brackets.filter("n > 0").count():
        return out
    return _pick(ranked_values(df, value, groups), probs, groups, discrete, False)


def _pick(ranked: DataFrame, probs: dict[str, float], groups: list[str], discrete: bool, by_place: bool) -> DataFrame:
    """The values at the wanted ranks; ``by_place``: the i-th share reads the
    rows with p = i only."""
    aggs = []
    for i, (name, p) in enumerate(probs.items()):
        place = F.col("p") == i if by_place else None
        if discrete:
            k = F.greatest(F.ceil(F.lit(p) * F.col("n")) - 1, F.lit(0))
            aggs.append(_value_at(k, place).alias(name))
        else:
            pos = F.lit(p) * (F.col("n") - 1)
            aggs += [_value_at(F.floor(pos), place).alias(f"_{name}_lo"),
                     _value_at(F.ceil(pos), place).alias(f"_{name}_hi"),
                     F.first(pos).alias(f"_{name}_pos")]
    out = ranked.groupBy(*groups, "n").agg(*aggs)
    if not discrete:
        for name in probs:
            lo, hi, pos = F.col(f"_{name}_lo"), F.col(f"_{name}_hi"), F.col(f"_{name}_pos")
            lower, higher = F.floor(pos), F.ceil(pos)
            interp = F.when(higher == lower, lo).otherwise(
                (higher - pos) * lo + (pos - lower) * hi)
            out = out.withColumn(name, interp).drop(f"_{name}_lo", f"_{name}_hi", f"_{name}_pos")
    return out
