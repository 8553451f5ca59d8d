"""Quality metrics of probabilities, per group and without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turfspark import constants as C
from turfspark.functions import market as M
from turfspark.operators import skew
from turfspark.session import stored


def bin_of(p: Column, edges: Sequence[float]) -> Column:
    """Index of the bin [edge, next edge); values at or past the ends go to the end bins."""
    passed = F.lit(0)
    for edge in edges[1:-1]:
        passed = passed + (p >= F.lit(float(edge))).cast("int")
    return passed


def even_edges(n_bins: int) -> list[float]:
    return [i * (1.0 / n_bins) for i in range(n_bins)] + [1.0]


def _edges_frame(df: DataFrame, edges: Sequence[float]) -> DataFrame:
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("bin_id"),
                F.lit(float(edges[i])).alias("bin_left"),
                F.lit(float(edges[i + 1])).alias("bin_right"),
            )
            for i in range(len(edges) - 1)
        ]
    )
    return df.sparkSession.range(1).select(F.inline(rows))


def auc(df: DataFrame, y: str, p: str, by: Sequence[str] = (), *, limit: int | None = None) -> DataFrame:
    """(by, auc): area under the ROC curve with ties counted half; null for one class only.

    Scores first collapse to one row per distinct value; the ordered count of
    negatives below each is a splitting running sum, so there is no global sort
    in one task even without groups.
    """
    # read three times: by the count of hot groups, the running sums and the join
    counts = stored(
        df.groupBy(*by, p).agg(
            F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("_pos"),
            F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).alias("_neg"),
        )
    )
    below = skew.running_sums(counts, list(by), p, limit=limit, _below=F.sum("_neg"))
    joined = counts.join(below, [*by, p])
    pos, neg = F.sum("_pos"), F.sum("_neg")
    wins = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2.0))
    return joined.groupBy(*by).agg(
        F.when((pos > 0) & (neg > 0), wins / (pos * neg)).alias("auc")
    )


def reliability(df: DataFrame, y: str, p: str, n_bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Non-empty bins of equal width: count, mean prediction and share of positives."""
    bounded = M.clip(F.col(p), C.PROB_EPS, 1.0 - C.PROB_EPS)
    return (
        df.withColumn("_p", bounded)
        .withColumn("bin_id", bin_of(F.col("_p"), even_edges(n_bins)))
        .groupBy(*by, "bin_id")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.avg("_p").alias("mean_pred"),
            F.avg(F.col(y).cast("double")).alias("frac_pos"),
        )
    )


def reliability_table(df: DataFrame, y: str, p: str, n_bins: int = 10) -> DataFrame:
    """All bins, the empty ones with count 0 and no rates."""
    edges = _edges_frame(df, even_edges(n_bins)).withColumnsRenamed(
        {"bin_left": "left", "bin_right": "right"}
    )
    table = edges.join(reliability(df, y, p, n_bins), "bin_id", "left")
    return table.withColumn("count", F.coalesce("count", F.lit(0).cast("bigint")))


def binary_metrics(
    df: DataFrame, y: str, p: str, *, n_bins: int = 10, by: Sequence[str] = ()
) -> DataFrame:
    """Rows, base rate, log-loss, Brier score, AUC and expected calibration error, per group."""
    known = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    bounded = known.withColumn("_p", M.clip(F.col(p), C.PROB_EPS, 1.0 - C.PROB_EPS))
    label = F.col(y).cast("double")
    keys, drop = (list(by), []) if by else (["_all"], ["_all"])
    if not by:
        bounded = bounded.withColumn("_all", F.lit(0))
    basic = bounded.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(label).alias("base_rate"),
        F.avg(M.log_loss(F.col(y), F.col("_p"))).alias("logloss"),
        F.avg(M.squared_error(label, F.col("_p"))).alias("brier"),
    )
    bins = reliability(bounded, y, "_p", n_bins, keys)
    gap = F.abs(F.col("mean_pred") - F.col("frac_pos")) * F.col("count")
    ece = bins.groupBy(*keys).agg((F.sum(gap) / F.sum("count")).alias("ece"))
    return (
        basic.join(auc(bounded, y, "_p", keys), keys).join(ece, keys).drop(*drop)
    )


def calibration_table(
    df: DataFrame, p: str, y: str, edges: Sequence[float] = C.CALIBRATION_EDGES
) -> DataFrame:
    """Expected and observed counts per probability bin; empty bins are kept."""
    label = F.col(y).cast("double")
    bins = (
        df.withColumn("bin_id", bin_of(F.col(p), edges))
        .groupBy("bin_id")
        .agg(
            F.count(F.lit(1)).alias("n_pairs"),
            F.sum(p).alias("exp_count"),
            F.sum(label).alias("act_count"),
            F.sum(F.col(p) * (1.0 - F.col(p))).alias("_var"),
        )
    )
    n = F.col("n_pairs")
    zero = F.lit(0.0)
    return _edges_frame(df, edges).join(bins, "bin_id", "left").select(
        "bin_id",
        "bin_left",
        "bin_right",
        F.coalesce(n, F.lit(0).cast("bigint")).alias("n_pairs"),
        F.coalesce("exp_count", zero).alias("exp_count"),
        F.coalesce("act_count", zero).alias("act_count"),
        (F.col("exp_count") / n).alias("pred_rate"),
        (F.col("act_count") / n).alias("obs_rate"),
        (F.col("act_count") / n - F.col("exp_count") / n).alias("diff"),
        F.when(
            F.col("_var") > 0, (F.col("act_count") - F.col("exp_count")) / F.sqrt("_var")
        ).alias("z_indep"),
    )


def race_bin_sums(
    df: DataFrame, p: str, y: str, edges: Sequence[float] = C.CALIBRATION_EDGES
) -> DataFrame:
    """Per race and bin: count, sum of predictions and of labels (the resampling unit)."""
    return (
        df.withColumn("bin_id", bin_of(F.col(p), edges))
        .groupBy("race_id", "bin_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(p).alias("sum_p"),
            F.sum(F.col(y).cast("double")).alias("sum_y"),
        )
    )


def poisson_weight(uniform: Column) -> Column:
    """Poisson(1) count from a uniform number, by its distribution function up to the last double below 1."""
    term, total, k, out = 0.36787944117144233, 0.0, 0, None
    while total + term > total:
        total += term
        out = F.when(uniform < total, k) if out is None else out.when(uniform < total, k)
        k += 1
        term /= k
    return out.otherwise(k)


def bootstrap_diff_ci(
    df: DataFrame,
    p: str,
    y: str,
    edges: Sequence[float] = C.CALIBRATION_EDGES,
    *,
    replicates: int = 1000,
    seed: int = 42,
) -> DataFrame:
    """2.5 % and 97.5 % limits of observed minus predicted rate per bin, resampling races.

    Each race takes a Poisson(1) weight per replicate from a hash of (seed,
    race, replicate). Replicated rows are combined map-side to one row per
    (replicate, bin) and task before anything is shuffled.
    """
    units = race_bin_sums(df, p, y, edges)
    drawn = units.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    bits = F.pmod(F.xxhash64(F.lit(seed), "race_id", "_rep"), F.lit(2**52))
    weighted = drawn.withColumn("_w", poisson_weight((bits + 0.5) / float(2**52)))
    sums = weighted.groupBy("_rep", "bin_id").agg(
        F.sum(F.col("_w") * F.col("n")).alias("_n"),
        F.sum(F.col("_w") * F.col("sum_p")).alias("_p"),
        F.sum(F.col("_w") * F.col("sum_y")).alias("_y"),
    )
    diffs = sums.filter("_n > 0").withColumn("_d", F.col("_y") / F.col("_n") - F.col("_p") / F.col("_n"))
    # at most `replicates` values per bin
    limits = diffs.groupBy("bin_id").agg(
        F.percentile("_d", F.array(F.lit(0.025), F.lit(0.975))).alias("_ci")
    )
    return _edges_frame(df, edges).join(limits, "bin_id", "left").select(
        "bin_id",
        "bin_left",
        "bin_right",
        F.col("_ci")[0].alias("diff_ci_low"),
        F.col("_ci")[1].alias("diff_ci_high"),
    )


def with_segments(df: DataFrame, segment: Column, name: str = "segment") -> DataFrame:
    """Each row once under `all` and once under its own segment, if it has one."""
    groups = F.filter(F.array(F.lit("all"), segment), lambda s: s.isNotNull())
    return df.withColumn(name, F.explode(groups))


def age_segment(flag: Column) -> Column:
    return F.when(flag == 1, F.lit("3yo")).when(flag == 0, F.lit("4up"))


def segment_metrics(df: DataFrame, y: str, p: str, segment: Column, by: Sequence[str] = ()) -> DataFrame:
    """Binary metrics and number of races for all rows and for each segment, within each group of `by`."""
    parts = with_segments(df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()), segment)
    keys = [*by, "segment"]
    races = parts.groupBy(*keys).agg(F.count_distinct("race_id").alias("races"))
    return binary_metrics(parts, y, p, by=keys).join(races, keys)


def summary_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, median, population deviation, min and max of fold values; not-finite ones ignored.

    Meant for fold or trial tables, which hold one row per fold.
    """
    finite = df.filter(
        F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf"))
    )
    return finite.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.median(value).alias("median"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def overall_calibration(df: DataFrame, p: str, y: str, *, n_bins: int = 10) -> DataFrame:
    """One row: Brier, log-loss, calibration error, pairs and races."""
    races = df.agg(F.count_distinct("race_id").alias("n_races"))
    one = binary_metrics(df.withColumn("_one", F.lit(0)), y, p, n_bins=n_bins, by=["_one"])
    return (
        one.join(races.withColumn("_one", F.lit(0)), "_one")
        .select("brier", "logloss", "ece", F.col("n_rows").alias("n_pairs"), "n_races")
    )
