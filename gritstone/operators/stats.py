"""Ranks, quantiles and calibration over tables of any size: no group and no order is collected into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.functions import text as T
from gritstone.operators.graph import written

FEW = 4096
SPLITS = 64


def few(df: DataFrame, limit: int = FEW) -> DataFrame:
    """df marked for broadcast if it has at most ``limit`` rows, as it is otherwise."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def null_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join by keys where null equals null; the keys are left's."""
    named = right.select(*[F.col(c).alias(f"__{c}") if c in on else F.col(c) for c in right.columns])
    same = F.lit(True)
    for c in on:
        same = same & left[c].eqNullSafe(named[f"__{c}"])
    return left.join(named, same, how).drop(*[f"__{c}" for c in on])


def numbered(rows: DataFrame, *order: Column | str, name: str = "pos") -> DataFrame:
    """rows with their place, from 1, in an order that should be total. The rows are dealt by ranges of the order and numbered
    within them; what is before a range is a sum over the ranges' counts."""
    dealt = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = F.broadcast(dealt.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", before.alias("__before")))  # a row a range
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn("__place", place).join(before, "__range").withColumn(name, (F.col("__before") + F.col("__place")).cast("long")).drop("__range", "__place", "__before")


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by, n, and for each share q the value at place floor(n * q) (from 0) of a group's ascending values. Null values don't count.

    Equal values are counted first. Approximate splits cut each group's values into SPLITS bins; a bin's count says which bin holds a place,
    and only the values of such bins are cumulated."""
    values = written(rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("k")), "values")
    cuts = F.percentile_approx("v", [i / SPLITS for i in range(1, SPLITS)], 1000)
    groups = few(values.groupBy(*by).agg(F.sum("k").alias("n"), cuts.alias("cuts")))
    binned = null_join(values, groups, by).withColumn("bin", F.size(F.filter("cuts", lambda c: c <= F.col("v")))).drop("cuts")
    earlier = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = binned.groupBy(*by, "bin").agg(F.sum("k").alias("m"), F.first("n").alias("n")).withColumn("before", F.coalesce(F.sum("m").over(earlier), F.lit(0)))
    names = list(shares)
    wanted = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.floor(F.col("n") * shares[q]).cast("long").alias("place")) for q in names])).alias("w")
    wanted = bins.select(*by, "bin", "m", "before", "n", wanted).select(*by, "bin", "m", "before", "w.q", F.least(F.col("w.place"), F.col("n") - 1).alias("place"))
    wanted = wanted.filter("before <= place and place < before + m").select(*by, "bin", "q", (F.col("place") - F.col("before")).alias("inside"))
    of_bins = null_join(binned.select(*by, "bin", "v", "k"), wanted.select(*by, "bin").distinct(), [*by, "bin"])
    upto = F.sum("k").over(Window.partitionBy(*by, "bin").orderBy("v"))
    hit = null_join(of_bins.withColumn("upto", upto), wanted, [*by, "bin"]).filter("inside < upto and inside >= upto - k")
    got = hit.groupBy(*by).agg(*[F.max(F.when(F.col("q") == q, F.col("v"))).alias(q) for q in names])
    return null_join(groups.drop("cuts"), got, by) if by else got.crossJoin(groups.drop("cuts"))


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, mean_p, mean_y of predictions p against outcomes y (0 or 1)."""
    at = F.least(F.lit(bins - 1), F.floor(F.least(F.lit(0.99999), F.col("p")) * bins)).cast("int")
    return rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y"))


def calibration_errors(rows: DataFrame, bins: int = 10) -> DataFrame:
    """n, brier and ece of predictions p against outcomes y."""
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c)))
    square = rows.agg(F.count("*").alias("n"), F.avg(F.pow(clamp("p") - clamp("y"), 2)).alias("brier"))
    gap = reliability(rows, bins).agg(F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))).alias("gap"))
    return square.join(F.broadcast(gap)).select("n", F.round("brier", 6).alias("brier"), F.round(F.col("gap") / F.col("n"), 6).alias("ece"))  # one row each


def calibration_table(rows: DataFrame, least: int = 30) -> DataFrame:
    """(source, family, tp, fp) of several sources: for each family the source with most cases, its share with a 95 % interval; calibrated from ``least`` cases."""
    rows = rows.withColumn("n", F.col("tp") + F.col("fp"))
    best = rows.groupBy("family").agg(F.max_by(F.struct("source", "tp", "fp", "n"), F.struct(F.col("n"), F.col("source"))).alias("b")).select("family", "b.*")
    lo, hi = T.wilson(F.col("tp").cast("double"), F.col("n").cast("double"))
    return best.select("family", "source", "tp", "fp", "n", (F.col("n") >= least).alias("calibrated"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


def agreement(rows: DataFrame, alarm: float = 0.6, least: int = 10) -> DataFrame:
    """n, po, pe, kappa and alarm of binary judgements a and b. With chance agreement of 0.9999 or more, kappa is 1 for perfect agreement and null else."""
    c = lambda test: F.count_if(F.expr(test)).cast("double")
    t = rows.agg(F.count("*").alias("n"), c("a and b").alias("tt"), c("a and not b").alias("tf"), c("not a and b").alias("ft"), c("not a and not b").alias("ff"))
    t = t.withColumn("po", (F.col("tt") + F.col("ff")) / F.col("n"))
    t = t.withColumn("pe", ((F.col("tt") + F.col("tf")) * (F.col("tt") + F.col("ft")) + (F.col("ft") + F.col("ff")) * (F.col("tf") + F.col("ff"))) / (F.col("n") * F.col("n")))
    kappa = F.when(F.col("pe") >= 0.9999, F.when(F.col("po") == 1, F.lit(1.0))).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe")))
    t = t.withColumn("kappa", F.round(kappa, 6))
    return t.select("n", F.round("po", 6).alias("po"), F.round("pe", 6).alias("pe"), "kappa", F.coalesce((F.col("n") >= least) & (F.col("kappa") < alarm), F.lit(False)).alias("alarm"))


def drifted(rows: DataFrame, now: Column, days: int = 30, least: int = 10, gap: float = 0.15) -> DataFrame:
    """family, n, reported, realised, since: families whose mean confidence p of the last ``days`` is ``gap`` or more from the share of true ones (y)."""
    recent = rows.filter(F.col("at") >= now - F.make_dt_interval(F.lit(days)))
    t = recent.groupBy("family").agg(F.count("*").alias("n"), F.avg("p").alias("reported"), F.avg("y").alias("realised"), F.min("at").alias("since"))
    return t.filter((F.col("n") >= least) & (F.abs(F.col("reported") - F.col("realised")) >= gap)).select("family", "n", F.round("reported", 6).alias("reported"), F.round("realised", 6).alias("realised"), "since")


def prf(rows: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and f1 of found against actual, to four digits; null where undefined. f1 is null if both are, 0 if one is 0 or null."""
    c = lambda test: F.count_if(F.expr(test))
    t = rows.groupBy(*by).agg(c("found and actual").alias("tp"), c("found and not actual").alias("fp"), c("not found and actual").alias("fn"), c("not found and not actual").alias("tn"))
    share = lambda a, b: F.round(F.expr(f"{a} / nullif(cast({a} + {b} as double), 0)"), 4)
    p, r = share("tp", "fp"), share("tp", "fn")
    zero = F.coalesce(p, F.lit(0.0)) * F.coalesce(r, F.lit(0.0)) == 0
    f1 = F.when(p.isNull() & r.isNull(), None).when(zero, 0.0).otherwise(F.round(2 * p * r / (p + r), 4))
    return t.select(*by, "tp", "fp", "fn", "tn", p.alias("pr"), r.alias("rc"), f1.alias("f1"))


def digest(rows: DataFrame, *columns: str) -> DataFrame:
    """n and sha256 over the rows in canonical order: rows are hashed, hashes are dealt to bins by their first digits (16 million fine ones, 4096 of
    those), each bin's sorted hashes are hashed, then the bins' in order. Equal tables have equal digests, whatever their partitioning."""
    line = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns]), {"ignoreNullFields": "false"})
    bins = rows.select(F.sha2(line, 256).alias("h")).groupBy(F.substring("h", 1, 6).alias("fine")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    bins = bins.groupBy(F.substring("fine", 1, 3).alias("bin")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fine", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
    whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bin", "h"))), lambda x: x["h"]), ""), 256)  # 4096 at most
    return bins.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), whole.alias("sha256"))
