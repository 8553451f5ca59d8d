"""Ranking model, exact probabilities, win evaluation and quality metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfspark import constants as C
from turfspark.catalog.base import Tables, cte, query
from turfspark.operators import ingroup, metrics, ranking, skew

cte(
    "weighted",
    """
    SELECT race_id, horse_no, exp(score) AS w, sum(exp(score)) OVER (PARTITION BY race_id) AS s,
           count(*) OVER (PARTITION BY race_id) AS n
    FROM scored
    """,
    "scored",
)
cte(
    "triples",
    """
    SELECT a.race_id, a.horse_no AS i, b.horse_no AS j, c.horse_no AS k,
           a.w / a.s * b.w / (a.s - a.w) * c.w / (a.s - a.w - b.w) AS prob
    FROM weighted a JOIN weighted b ON a.race_id = b.race_id AND a.horse_no <> b.horse_no
    JOIN weighted c ON a.race_id = c.race_id AND c.horse_no NOT IN (a.horse_no, b.horse_no)
    WHERE a.n > 3
    """,
    "weighted",
)
cte(
    "pair_prob",
    """
    SELECT race_id, least(x, y) AS horse_no_1, greatest(x, y) AS horse_no_2, sum(prob) AS p_wide FROM (
        SELECT race_id, i AS x, j AS y, prob FROM triples
        UNION ALL SELECT race_id, i, k, prob FROM triples
        UNION ALL SELECT race_id, j, k, prob FROM triples)
    GROUP BY ALL
    UNION ALL
    SELECT a.race_id, a.horse_no, b.horse_no, 1.0 FROM weighted a
    JOIN weighted b ON a.race_id = b.race_id AND a.horse_no < b.horse_no WHERE a.n <= 3
    """,
    "triples",
)


@query(
    "pl_pair_exact",
    "SELECT race_id, horse_no_1, horse_no_2, round(p_wide, 6) AS p_wide FROM pair_prob",
    ["pair_prob"],
)
def pl_pair_exact(t: Tables) -> DataFrame:
    return ranking.pair_probabilities(t.scored, "score").select(
        "race_id", "horse_no_1", "horse_no_2", F.round("p_wide", 6).alias("p_wide")
    )


@query(
    "pl_top3_exact",
    """
    SELECT race_id, horse_no, round(sum(prob), 6) AS p_top3 FROM (
        SELECT race_id, i AS horse_no, prob FROM triples
        UNION ALL SELECT race_id, j, prob FROM triples UNION ALL SELECT race_id, k, prob FROM triples
        UNION ALL SELECT race_id, horse_no, 1.0 FROM weighted WHERE n <= 3)
    GROUP BY race_id, horse_no
    """,
    ["triples"],
)
def pl_top3_exact(t: Tables) -> DataFrame:
    return ranking.top3_probabilities(t.scored, "score").select(
        "race_id", "horse_no", F.round("p_top3", 6).alias("p_top3")
    )


@query("gumbel_topk")
def gumbel_topk(t: Tables) -> DataFrame:
    return ranking.gumbel_topk(t.scored, "score")


# --- likelihood --------------------------------------------------------------

cte(
    "suffix",
    """
    SELECT *, ln(sum(exp(score)) OVER w) - score AS nll, sum(exp(score)) OVER w AS left_weight
    FROM scored WHERE field_size >= 2
    WINDOW w AS (PARTITION BY race_id ORDER BY finish_pos, horse_no
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    """,
    "scored",
)


@query(
    "pl_nll",
    """
    SELECT round(avg(loss), 6) AS nll, count(*) AS races
    FROM (SELECT race_id, sum(nll) AS loss FROM suffix GROUP BY race_id)
    """,
    ["suffix"],
)
def pl_nll(t: Tables) -> DataFrame:
    return ranking.pl_nll(t.scored, "score").select(F.round("nll", 6).alias("nll"), "races")


@query(
    "pl_gradient",
    """
    SELECT round(sum(nll) / count(DISTINCT race_id), 5) AS nll, count(DISTINCT race_id) AS races,
           round(sum(g * carried_weight) / count(DISTINCT race_id), 5) AS g_carried_weight,
           round(sum(g * score) / count(DISTINCT race_id), 5) AS g_score
    FROM (SELECT *, exp(score) * sum(1 / left_weight) OVER
              (PARTITION BY race_id ORDER BY finish_pos, horse_no ROWS UNBOUNDED PRECEDING) - 1 AS g
          FROM suffix)
    """,
    ["suffix"],
)
def pl_gradient(t: Tables) -> DataFrame:
    out = ranking.pl_gradient(t.scored, "score", ["carried_weight", "score"])
    return out.select(
        F.round("nll", 5).alias("nll"), "races", F.round("g_carried_weight", 5).alias("g_carried_weight"),
        F.round("g_score", 5).alias("g_score"),
    )


@query(
    "standardized_linear_score",
    """
    SELECT race_id, horse_no,
           round(0.5 * (coalesce(final3f_c, m) - avg(coalesce(final3f_c, m)) OVER ()) / stddev_pop(coalesce(final3f_c, m)) OVER ()
                 - 0.25 * (carried_weight - avg(carried_weight) OVER ()) / stddev_pop(carried_weight) OVER (), 6) AS pl_score
    FROM runner, (SELECT median(final3f_c) AS m FROM runner)
    """,
    ["runner"],
)
def standardized_linear_score(t: Tables) -> DataFrame:
    names = ["final3f_c", "carried_weight"]
    stats = ranking.feature_stats(t.runner, names)
    score = ranking.linear_score(names, [0.5, -0.25])
    return ranking.standardize(t.runner, stats).select(
        "race_id", "horse_no", F.round(score, 6).alias("pl_score")
    )


@query(
    "exact_medians",
    "SELECT supp, median(time_c) AS median_time, round(quantile_cont(price, 0.9), 6) AS p90_price FROM runner GROUP BY supp",
    ["runner"],
)
def exact_medians(t: Tables) -> DataFrame:
    middle = skew.exact_percentile(t.runner, ["supp"], "time_c", 0.5, "median_time")
    upper = skew.exact_percentile(t.runner, ["supp"], "price", 0.9, "p90_price")
    return middle.join(upper.withColumn("p90_price", F.round("p90_price", 6)), "supp")


# --- win evaluation ----------------------------------------------------------


@query(
    "softmax_beta",
    """
    SELECT race_id, horse_no, round(exp(0.7 * score) / sum(exp(0.7 * score)) OVER (PARTITION BY race_id), 6) AS c_prob
    FROM scored
    """,
    ["scored"],
)
def softmax_beta(t: Tables) -> DataFrame:
    return ingroup.add_softmax(t.scored, "score", "c_prob", 0.7).select(
        "race_id", "horse_no", F.round("c_prob", 6).alias("c_prob")
    )


@query(
    "pseudo_r2",
    """
    SELECT round(sum(-ln(c)), 4) AS nll_model, round(sum(ln(field_size)), 4) AS nll_null, count(*) AS races,
           round(1 - sum(-ln(c)) / sum(ln(field_size)), 6) AS r2
    FROM (SELECT *, exp(0.7 * score) / sum(exp(0.7 * score)) OVER (PARTITION BY race_id) AS c FROM scored)
    WHERE y_win = 1 AND field_size > 1
    """,
    ["scored"],
)
def pseudo_r2(t: Tables) -> DataFrame:
    rows = ingroup.add_softmax(t.scored, "score", "c_prob", 0.7)
    out = ranking.win_r2(rows, "c_prob")
    return out.select(
        F.round("nll_model", 4).alias("nll_model"), F.round("nll_null", 4).alias("nll_null"), "races",
        F.round("r2", 6).alias("r2"),
    )


@query(
    "beta_grid",
    f"""
    SELECT idx, round(beta, 9) AS beta, round(sum(least(ln(z) - won, -ln(1e-12))), 3) AS nll, count(*) AS races FROM (
        SELECT idx, beta, race_id, sum(exp(beta * (score - top))) AS z,
               max(CASE WHEN y_win = 1 THEN beta * (score - top) END) AS won
        FROM (SELECT *, max(score) OVER (PARTITION BY race_id) AS top FROM scored WHERE field_size > 1),
             (SELECT i AS idx, pow(10, -2 + 4.0 * i / 80) AS beta FROM range({C.BETA_POINTS}) g(i))
        GROUP BY idx, beta, race_id)
    GROUP BY idx, beta
    """,
    ["scored"],
)
def beta_grid(t: Tables) -> DataFrame:
    out = ranking.beta_losses(t.scored, "score", ranking.beta_grid())
    return out.select(
        F.col("idx").cast("bigint").alias("idx"), F.round("beta", 9).alias("beta"), F.round("nll", 3).alias("nll"), "races"
    )


@query("win_scores_at_best_beta")
def win_scores_at_best_beta(t: Tables) -> DataFrame:
    best = ranking.fit_beta(t.scored, "score")
    return ranking.add_win_scores(t.scored, "p", best).select(
        "race_id", "horse_no", "score_p", "c_p_beta1", "c_p_betahat"
    )


# --- quality metrics ---------------------------------------------------------

_clipped = "least(greatest(p, 1e-12), 1 - 1e-12)"
_loss = f"avg(-(CASE WHEN y = 1 THEN ln({_clipped}) ELSE ln(1 - {_clipped}) END))"


def _auc_sql(by: str, source: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    head = f"{by}, " if by else ""
    return f"""
        SELECT {head} (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0)
                   / (sum(y) * (count(*) - sum(y))) AS auc
        FROM (SELECT *, rank() OVER ({part} ORDER BY p) + (count(*) OVER (PARTITION BY {by + ", " if by else ""} p) - 1) / 2.0 AS r
              FROM {source}) {group}
    """


def _ece_sql(by: str, source: str) -> str:
    head = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
        SELECT {head} sum(abs(mp - fy) * n) / sum(n) AS ece FROM (
            SELECT {head} count(*) AS n, avg(p) AS mp, avg(y) AS fy
            FROM (SELECT *, {_bin10} AS b FROM {source}) GROUP BY {head} b) {group}
    """


_bin10 = " + ".join(f"(p >= {i}e0 * 0.1e0)::INT" for i in range(1, 10))


@query(
    "binary_metrics",
    f"""
    SELECT n_rows, base_rate, logloss, brier, round(auc, 8) AS auc, round(ece, 6) AS ece FROM (
        SELECT count(*) AS n_rows, round(avg(y), 8) AS base_rate, round({_loss}, 6) AS logloss,
               round(avg((p - y) * (p - y)), 6) AS brier FROM scored),
        ({_auc_sql("", "scored")}), ({_ece_sql("", "scored")})
    """,
    ["scored"],
)
def binary_metrics(t: Tables) -> DataFrame:
    out = metrics.binary_metrics(t.scored, "y", "p")
    return out.select(
        "n_rows", F.round("base_rate", 8).alias("base_rate"), F.round("logloss", 6).alias("logloss"),
        F.round("brier", 6).alias("brier"), F.round("auc", 8).alias("auc"), F.round("ece", 6).alias("ece"),
    )


@query(
    "reliability_bins",
    f"""
    SELECT b AS bin_id, CAST(count(p) AS BIGINT) AS count, round(avg(p), 6) AS mean_pred, round(avg(y), 6) AS frac_pos
    FROM range(10) g(b) LEFT JOIN (SELECT p, y, {_bin10} AS i FROM scored) ON i = b GROUP BY b
    """,
    ["scored"],
)
def reliability_bins(t: Tables) -> DataFrame:
    out = metrics.reliability_table(t.scored, "y", "p")
    return out.select(
        "bin_id", "count", F.round("mean_pred", 6).alias("mean_pred"), F.round("frac_pos", 6).alias("frac_pos")
    )


_edges = C.CALIBRATION_EDGES
_edge_bin = " + ".join(f"(p_wide >= {e}e0)::INT" for e in _edges[1:-1])
cte("binned", f"SELECT *, {_edge_bin} AS b FROM pair", "pair")


@query(
    "calibration_table",
    """
    SELECT g.b AS bin_id, CAST(count(p_wide) AS BIGINT) AS n_pairs, round(coalesce(sum(p_wide), 0), 4) AS exp_count,
           coalesce(CAST(sum(y_wide) AS DOUBLE), 0) AS act_count, round(avg(p_wide), 6) AS pred_rate,
           round(avg(y_wide), 6) AS obs_rate, round(avg(y_wide) - avg(p_wide), 6) AS diff,
           round((sum(y_wide) - sum(p_wide)) / sqrt(sum(p_wide * (1 - p_wide))), 4) AS z_indep
    FROM range(9) g(b) LEFT JOIN binned USING (b) GROUP BY g.b
    """,
    ["binned"],
)
def calibration_table(t: Tables) -> DataFrame:
    out = metrics.calibration_table(t.pair, "p_wide", "y_wide")
    return out.select(
        "bin_id", "n_pairs", F.round("exp_count", 4).alias("exp_count"), "act_count",
        F.round("pred_rate", 6).alias("pred_rate"), F.round("obs_rate", 6).alias("obs_rate"),
        F.round("diff", 6).alias("diff"), F.round("z_indep", 4).alias("z_indep"),
    )


@query(
    "race_bin_sums",
    """
    SELECT race_id, b AS bin_id, count(*) AS n, round(sum(p_wide), 6) AS sum_p, CAST(sum(y_wide) AS DOUBLE) AS sum_y
    FROM binned GROUP BY race_id, b
    """,
    ["binned"],
)
def race_bin_sums(t: Tables) -> DataFrame:
    return metrics.race_bin_sums(t.pair, "p_wide", "y_wide").withColumn("sum_p", F.round("sum_p", 6))


@query("poisson_bootstrap_ci")
def poisson_bootstrap_ci(t: Tables) -> DataFrame:
    return metrics.bootstrap_diff_ci(t.pair, "p_wide", "y_wide")


cte(
    "segmented",
    """
    SELECT s.*, u.segment FROM scored s, unnest(CASE supp % 3 WHEN 0 THEN ['all', '3yo'] WHEN 1 THEN ['all', '4up']
        ELSE ['all'] END) u(segment)
    """,
    "scored",
)


@query(
    "segment_metrics",
    f"""
    SELECT * FROM (
        SELECT segment, count(*) AS n_rows, count(DISTINCT race_id) AS races, round(avg(y), 8) AS base_rate,
               round({_loss}, 6) AS logloss, round(avg((p - y) * (p - y)), 6) AS brier
        FROM segmented GROUP BY segment)
    JOIN (SELECT segment, round(auc, 8) AS auc FROM ({_auc_sql("segment", "segmented")})) USING (segment)
    JOIN (SELECT segment, round(ece, 6) AS ece FROM ({_ece_sql("segment", "segmented")})) USING (segment)
    """,
    ["segmented"],
)
def segment_metrics(t: Tables) -> DataFrame:
    flag = F.when(F.col("supp") % 3 == 0, 1).when(F.col("supp") % 3 == 1, 0)
    out = metrics.segment_metrics(t.scored, "y", "p", metrics.age_segment(flag))
    return out.select(
        "segment", "n_rows", "races", F.round("base_rate", 8).alias("base_rate"),
        F.round("logloss", 6).alias("logloss"), F.round("brier", 6).alias("brier"), F.round("auc", 8).alias("auc"),
        F.round("ece", 6).alias("ece"),
    )


@query(
    "fold_stats",
    """
    SELECT year, round(avg(x), 6) AS mean, median(x) AS median, round(stddev_pop(x), 6) AS std, min(x) AS min, max(x) AS max
    FROM (SELECT CAST(year(o_orderdate) AS INT) AS year, count(*)::DOUBLE AS x FROM orders
          GROUP BY year(o_orderdate), month(o_orderdate))
    GROUP BY year
    """,
)
def fold_stats(t: Tables) -> DataFrame:
    monthly = t.read("orders").groupBy(
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")
    ).agg(F.count(F.lit(1)).cast("double").alias("x"))
    out = metrics.summary_stats(monthly, ["year"], "x")
    return out.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))
