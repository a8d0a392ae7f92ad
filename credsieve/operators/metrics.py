"""Scores of findings against labels, and of scores against classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def labelled(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Each finding (path, lo, hi) with the label of the ranges it meets: T before F before X before none.

    An equi join on the path with a range condition; one row a finding comes back.
    """
    ranks = F.when(F.col("label") == "T", 3).when(F.col("label") == "F", 2).when(F.col("label") == "X", 1)
    marks = labels.select(F.col("path").alias("__path"), F.col("start").alias("__start"), F.col("end").alias("__end"), ranks.alias("__rank"))
    met = (F.col("path") == F.col("__path")) & (F.col("__start") <= F.col("hi")) & (F.col("lo") <= F.col("__end"))
    rows = found.join(marks, met, "left").groupBy(*found.columns).agg(F.max("__rank").alias("__best"))
    best = F.when(F.col("__best") == 3, "T").when(F.col("__best") == 2, "F").when(F.col("__best") == 1, "X").otherwise("none")
    return rows.withColumn("label", best).drop("__best")


def precision_recall(found: DataFrame, labels: DataFrame) -> DataFrame:
    """true_found, all_true, hits, judged and what follows: precision over judged findings, recall over labels, F1."""
    marked = labelled(found, labels)
    met = labels.where("label = 'T'").alias("l").join(
        found.alias("f"), F.expr("l.path = f.path and l.start <= f.hi and f.lo <= l.end"), "left_semi"
    )
    a = marked.agg(F.count_if(F.col("label") == "T").alias("hits"), F.count_if(F.col("label").isin("T", "F")).alias("judged"))
    b = met.agg(F.count(F.lit(1)).alias("true_found"))
    c = labels.agg(F.count_if(F.col("label") == "T").alias("all_true"))
    one = a.join(F.broadcast(b), F.lit(True)).join(F.broadcast(c), F.lit(True))  # a row each
    precision, recall = F.try_divide("hits", "judged"), F.try_divide("true_found", "all_true")
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return one.withColumns({"precision": precision, "recall": recall}).withColumn("f1", f1)


def capped_coverage(counts: DataFrame) -> DataFrame:
    """expected, found: what is covered (no file counts for more than it holds), files covered, and overage."""
    return counts.agg(
        F.sum(F.least("found", "expected")).alias("covered"),
        F.sum("expected").alias("expected"),
        F.count_if((F.col("found") > 0) & (F.col("expected") > 0)).alias("files_covered"),
        F.sum(F.greatest(F.col("found") - F.col("expected"), F.lit(0))).alias("overage"),
    )


def auc(rows: DataFrame, score: str = "score", positive: str = "positive") -> DataFrame:
    """Area under the curve by rank sums with average ranks of ties.

    Rows are counted by value first, so what is ranked in one order are the different values.
    """
    by = rows.groupBy(score).agg(F.count_if(positive).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = by.withColumn("won", F.col("p") * (below + F.col("q") / 2))
    return won.agg(F.try_divide(F.sum("won"), F.sum("p") * F.sum("q")).alias("auc"))


def false_positives_at(rows: DataFrame, recall: float, score: str = "score", positive: str = "positive") -> DataFrame:
    """The highest threshold that reaches the recall, and how many negatives are at it or above."""
    by = rows.groupBy(score).agg(F.count_if(positive).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    down = Window.orderBy(F.desc(score))
    sums = by.withColumns({"tp": F.sum("p").over(down), "fp": F.sum("q").over(down)})
    total = by.agg(F.sum("p").alias("total"))
    enough = sums.join(F.broadcast(total), F.lit(True)).where(F.col("tp") >= F.lit(recall) * F.col("total"))
    return enough.agg(F.max(score).alias("threshold"), F.min("fp").alias("false_positives"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper end of the interval of a share."""
    p, m = hits / n, n.cast("double")
    centre, width = p + z * z / (2 * m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    return (centre - width) / (1 + z * z / m), (centre + width) / (1 + z * z / m)


def stratified_sample(rows: DataFrame, stratum: str, key: str, n: int, seed: str = "0") -> DataFrame:
    """`n` rows of each stratum in the order of a digest of seed and key; reruns agree."""
    order = F.sha2(F.concat(F.lit(seed + ":"), F.col(key).cast("string")), 256)
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(order))
    return rows.withColumn("__k", rank).where(F.col("__k") <= n).drop("__k")


def stratified_estimate(sample: DataFrame, sizes: DataFrame, stratum: str, value: str) -> DataFrame:
    """The mean over strata of unequal sampling: sum of size times mean, over the sum of sizes."""
    means = sample.groupBy(stratum).agg(F.avg(value).alias("__mean")).join(sizes, stratum)
    return means.agg(F.try_divide(F.sum(F.col("__mean") * F.col("size")), F.sum("size")).alias("estimate"))


def bootstrap_interval(sample: DataFrame, value: str, rounds: int = 200, seed: int = 7) -> DataFrame:
    """2.5 % and 97.5 % points of the mean over resamples with Poisson(1) weights, one aggregate per round."""
    u = (F.pmod(F.xxhash64("__round", "__row", F.lit(seed)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    # Poisson(1) by its cumulated probabilities.
    weight, share, total = F.lit(0), 1.0, 0.0
    for k in range(8):
        share = share / k if k else 0.36787944117144233
        total += share
        weight = weight + (u > total).cast("int")
    rows = sample.withColumn("__row", F.monotonically_increasing_id()).withColumn("__round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    means = rows.withColumn("__w", weight).groupBy("__round").agg(F.try_divide(F.sum(F.col("__w") * F.col(value)), F.sum("__w")).alias("m"))
    return means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def category_recall(rows: DataFrame, category: str = "category", hit: str = "hit") -> DataFrame:
    """Labelled rows, hits and recall by category, and the running share of misses from the worst category on."""
    by = rows.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"))
    by = by.withColumns({"recall": F.col("hits") / F.col("n"), "missed": F.col("n") - F.col("hits")})
    down = Window.orderBy(F.desc("missed"), category)
    every = Window.partitionBy()
    return by.withColumn("missed_so_far", F.try_divide(F.sum("missed").over(down), F.sum("missed").over(every)))


def by_rule(found: DataFrame) -> DataFrame:
    """Findings by rule, most first when ordered by n."""
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


def top(counts: DataFrame, name: str, n: int) -> DataFrame:
    """The `n` largest of the counts, ties by name."""
    return counts.orderBy(F.desc("n"), name).limit(n)


#: From the weakest verdict to the strongest.
STATUS_RANKS = {"false_positive": 1, "unverified": 2, "uncertain": 3, "secret": 4}


def best_verdict(judged: DataFrame, unit: str = "file") -> DataFrame:
    """The strongest verdict of each unit."""
    rank = F.create_map(*(F.lit(x) for pair in STATUS_RANKS.items() for x in pair))
    best = judged.groupBy(unit).agg(F.max(F.coalesce(rank[F.col("status")], F.lit(0))).alias("rank"))
    names = F.create_map(*(F.lit(x) for k, v in STATUS_RANKS.items() for x in (v, k)))
    return best.select(unit, names[F.col("rank")].alias("status"))


def with_probability(found: DataFrame, judged: DataFrame, default: float = 0.0) -> DataFrame:
    """`found` with the probability that a judge gave to its file and line (the highest, if several)."""
    given = judged.groupBy("file", "line").agg(F.max("probability").alias("probability"))
    return found.join(given, ["file", "line"], "left").fillna(default, ["probability"])


def set_check(wanted: DataFrame, got: DataFrame, key: str = "fingerprint") -> DataFrame:
    """How many keys are in both, missing from `got`, and only in `got`."""
    a = wanted.select(key).distinct().withColumn("a", F.lit(1))
    b = got.select(key).distinct().withColumn("b", F.lit(1))
    both = a.join(b, key, "full")
    return both.agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"),
        F.count_if(F.col("b").isNull()).alias("missing"),
        F.count_if(F.col("a").isNull()).alias("unexpected"),
    )


def extension_recall(rows: DataFrame, path: str = "path", hit: str = "hit") -> DataFrame:
    """Labelled rows, hits and recall by file extension (lower case; empty without one)."""
    ext = F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)\z", 1))
    by = rows.groupBy(ext.alias("extension")).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"))
    return by.withColumn("recall", F.col("hits") / F.col("n"))
