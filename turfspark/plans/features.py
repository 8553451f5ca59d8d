"""The feature tables as one lazy plan each.

Rolling and entity features are computed on narrow keyed frames and joined back
by their keys; in-race features come last, after the segment filter.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turfspark import constants as C
from turfspark.functions import market as M
from turfspark.functions import scalars as S
from turfspark.operators import asof, filters, history, ingroup, joins, quality
from turfspark.plans import registry
from turfspark.session import stored

NUMBERS = (
    "distance_m", "going", "weather", "field_size", "grade_code", "race_type_code",
    "weight_type_code", "condition_code_min_age", "condition_code_2yo", "condition_code_3yo",
    "condition_code_4yo", "condition_code_5up", "condition_code_min_age_raw", "horse_no",
    "carried_weight", "body_weight", "body_weight_diff", "sex", "finish_pos", "time_sec",
    "final3f_sec",
)


def runner_values(df: DataFrame) -> DataFrame:
    """Numbers, labels, entity keys, age and season of each runner."""
    typed = df.withColumns({c: S.number(F.col(c)) for c in NUMBERS if c in df.columns})
    entity = lambda name: F.coalesce(
        S.whole(F.col(f"{name}_id")), S.first_digits(F.col(f"{name}_code_raw")), F.lit(0)
    ).cast("bigint")
    angle = S.month_angle(F.col("race_date"))
    aged = typed.withColumns(
        {
            "target_label": S.target_label(F.col("finish_pos")),
            "is_top3": S.flag(F.col("finish_pos") <= 3),
            "jockey_key": entity("jockey"),
            "trainer_key": entity("trainer"),
            "age": S.age_from_id(F.col("race_date"), F.col("horse_id")),
            "race_month": F.month("race_date"),
            "race_month_sin": F.sin(angle),
            "race_month_cos": F.cos(angle),
            "min_age_numeric": S.min_age({n: F.col(n) for n, _ in C.MIN_AGE_CODES if n in df.columns}),
        }
    )
    gap = F.col("age") - F.col("min_age_numeric")
    return aged.withColumns(
        {
            "is_3yo": S.flag(F.col("age") == 3),
            "age_minus_min_age": gap,
            "is_min_age_runner": S.flag(gap == 0),
        }
    )


def add_forecasts(df: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Time and score forecasts: the last live one before post time, else the static one."""
    out = df
    for kind, values in (("dm", ["dm_time_x10", "dm_rank"]), ("tm", ["tm_score", "tm_rank"])):
        live = asof.latest_forecast(tables[f"rt_mining_{kind}"], tables["race"], values)
        out = asof.with_fallback(out, live, tables[f"mining_{kind}"], values).withColumnsRenamed(
            {v: f"meta_{v}" for v in values}
        )
    return out


def add_in_race(df: DataFrame, *, with_te: bool) -> DataFrame:
    """In-race features of the segment, where a race has at most 18 runners: one shuffle by race."""
    shared = ingroup.add_share(df, "is_3yo", "n_3yo_in_race", "share_3yo_in_race", bounded=True)
    aged = ingroup.add_rank(shared, "age", pct="age_rank_pct_in_race", bounded=True)
    scores = {
        "lag1_speed_index": "rel_lag1_speed_index_z",
        "carried_weight": "rel_carried_weight_z",
        "jockey_top3_rate_6m": "rel_jockey_top3_rate_z",
        "meta_tm_score": "rel_meta_tm_score_z",
    }
    if with_te:
        scores["jockey_target_label_mean_6m"] = "rel_jockey_target_label_mean_z"
    scored = ingroup.add_zscores(aged, scores, bounded=True)
    return ingroup.add_rank(
        scored, "lag1_speed_index", rank="rel_lag1_speed_index_rank", pct="rel_lag1_speed_index_pct",
        descending=True, bounded=True,
    )


def base_features(
    tables: Mapping[str, DataFrame],
    from_date: str,
    to_date: str,
    *,
    history_days: int = C.HISTORY_DAYS,
    with_te: bool = False,
) -> DataFrame:
    """Leakage-safe feature table of the target segment between two dates.

    History starts `history_days` earlier. Lags need the rows of history themselves; after them only the rows of
    the output window and the segment go on, and the other features count on the stored history.
    """
    start = filters.history_start(from_date, history_days)
    rows = joins.base_rows(tables["race"], tables["runner"], tables["result"], start, to_date)
    # stored twice: as input of the race baselines, and as the history all features count on
    rows = stored(add_forecasts(runner_values(rows), tables))
    source = stored(history.add_speed_indices(rows))
    lagged = history.add_recent_change(history.add_lags(source))
    rows = filters.segment(filters.date_window(lagged, from_date, to_date))
    rows = history.add_aptitude(history.add_experience(rows, source), source)
    for entity in ("jockey", "trainer"):
        rows = history.entity_rate(
            rows, f"{entity}_key", "is_top3", f"{entity}_top3_rate_6m", C.PRIOR_TOP3_RATE, source
        )
    if with_te:
        prior: Column = history.label_prior(source, from_date).scalar()
        for entity in ("jockey", "trainer"):
            rows = history.entity_rate(
                rows, f"{entity}_key", "target_label", f"{entity}_target_label_mean_6m", prior, source
            )
    columns = registry.output_columns(with_te=with_te)
    return filters.in_order(add_in_race(rows, with_te=with_te).select(*columns))


def market_features(
    features: DataFrame, race: DataFrame, win_odds: DataFrame, place_odds: DataFrame
) -> DataFrame:
    """Odds snapshots at fixed cut-offs and what follows from them."""
    keys = features.select("race_id").distinct()
    win = asof.win_snapshots(_timed(win_odds, race, keys))
    place = asof.place_snapshots(_timed(place_odds, race, keys))
    on = list(asof.RUNNER)
    # read once per price below: in-race sums are joined back to it
    out = stored(features.join(win, on, "left").join(place, on, "left"))
    for t, raw in (("final", True), ("t20", False), ("t15", False), ("t10", True)):
        out = ingroup.add_implied(
            out, f"odds_win_{t}", f"p_win_odds_{t}_norm", raw=f"p_win_odds_{t}_raw" if raw else None
        )
    norm = lambda t: F.col(f"p_win_odds_t{t}_norm")
    bounds = lambda t: (F.col(f"odds_place_t{t}_lower"), F.col(f"odds_place_t{t}_upper"))
    columns = {f"d_logit_win_{a}_{b}": M.logit_delta(norm(a), norm(b)) for a, b in ((15, 20), (10, 15), (10, 20))}
    for t in C.SNAPSHOT_MINUTES:
        columns[f"place_mid_prob_t{t}"] = M.place_mid(*bounds(t))
        columns[f"place_width_log_ratio_t{t}"] = M.place_width(*bounds(t))
    out = out.withColumns(columns)
    return out.withColumns(
        {
            "place_width_log_ratio": F.col("place_width_log_ratio_t10"),
            "d_place_mid_10_20": F.col("place_mid_prob_t10") - F.col("place_mid_prob_t20"),
            "d_place_width_10_20": F.col("place_width_log_ratio_t10") - F.col("place_width_log_ratio_t20"),
        }
    )


def _timed(odds: DataFrame, race: DataFrame, keys: DataFrame) -> DataFrame:
    wanted = filters.in_keys(asof.keep_allowed(odds), keys)
    return asof.with_post_time(wanted, race.select("race_id", "race_date", "start_time"))


def model_features(base: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Base features with labels, finishing positions and market features."""
    keyed = filters.require_keys(base).dropna(subset=["target_label"])
    labelled = keyed.withColumns(
        {
            "y_win": S.flag(F.col("target_label") == 3),
            "y_place": S.flag(F.col("target_label") >= 1),
        }
    )
    finish = joins.finish_positions(
        tables["runner"], tables["result"], labelled.select("race_id").distinct()
    )
    with_finish = labelled.join(finish, joins.RUNNER, "left")
    return market_features(with_finish, tables["race"], tables["o1_win"], tables["o1_place"])


def as_of_pairs() -> list[tuple[str, str]]:
    """(announcement, cut-off) column pairs whose order must hold."""
    return [
        (f"odds_{kind}_t{t}_announce_dt", f"odds_{kind}_t{t}_asof_dt")
        for kind in ("win", "place")
        for t in C.SNAPSHOT_MINUTES
    ]


def add_encodings(base: DataFrame, source: DataFrame) -> DataFrame:
    """Safe target-encoding columns of another build, joined one to one and checked."""
    keys = ["race_id", "horse_id", "horse_no"]
    names = [c for c in registry.safe_encodings(source.columns) if c not in base.columns]
    if not names:
        raise ValueError("the source has no safe target-encoding column")
    return joins.one_to_one(base, source.select(*keys, *names), keys, label="target encodings")


def ranking_interactions(df: DataFrame, *, age: bool = False, eps: float = C.LOGIT_EPS) -> DataFrame:
    """Inputs of the ranking layer: logits of the stacked models and their interactions.

    A race has at most `ranking.MOST_RUNNERS` runners there, so its values share one shuffle. Rows without a race have no rank.
    """
    width = registry.WIDTH
    out = df.withColumns(
        {
            "z_win_stack": M.logit(S.number(F.col("p_win_stack")), eps),
            "z_place_stack": M.logit(S.number(F.col("p_place_stack")), eps),
            width: S.number(F.col(width)),
        }
    )
    if age:
        out = out.withColumn("prior_starts_2y", F.greatest(S.number(F.col("prior_starts_2y")), F.lit(0.0)))
        out = out.withColumn("log1p_prior_starts_2y", F.log1p("prior_starts_2y"))
    products = [n for n in registry.stack_interactions(age=age) if "_x_" in n]
    out = out.withColumns(
        {n: F.col(n.split("_x_")[0]) * S.number(F.col(n.split("_x_")[1])) for n in products}
    )
    inputs = [*registry.STACK_SCORES, width]
    out = ingroup.add_centered(out, {c: f"{c}_race_centered" for c in inputs}, bounded=True)
    for c in inputs:
        out = ingroup.add_rank(out, c, pct=f"{c}_rank_pct", descending=c != width, bounded=True)
    return out.withColumns({f"{c}_rank_pct": F.when(F.col("race_id").isNotNull(), F.col(f"{c}_rank_pct")) for c in inputs})


def build_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Coverage and missing rate per column, with rows and races of the dataset."""
    totals = df.agg(F.count_distinct("race_id").alias("races"))
    return quality.coverage(df, columns).withColumn("races", totals.scalar())
