"""History features: rolling baselines, lags, experience, aptitude and entity rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfspark import constants as C
from turfspark.functions import scalars as S
from turfspark.operators import skew
from turfspark.session import stored

DAY = 86_400
NO_KEY = -1.0
LAGGED = (
    "finish_pos",
    "time_sec",
    "final3f_sec",
    "perf_speed_index",
    "perf_up3_index",
    "distance_m",
    "surface",
)


def _tick(column: str = "race_datetime") -> Column:
    return S.epoch_seconds(F.col(column))


def rolling_stats(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    values: Sequence[str],
    width: int,
    *,
    digits: int = 2,
) -> DataFrame:
    """Mean, population deviation and count of values over [time - width, time) per key.

    Columns come out as `mean_<value>`, `std_<value>` and `n_<value>`. Values
    have at most `digits` decimals, and one with more is an error; sums are kept
    as whole numbers, so the deviation has no cancellation error.
    """
    zero = F.lit(0).cast("bigint")
    sums = {}
    for v in values:
        x = F.col(f"_x_{v}")
        sums[f"n_{v}"] = F.count(x)
        sums[f"_s_{v}"] = F.coalesce(F.sum(x), zero)
        sums[f"_q_{v}"] = F.coalesce(F.sum(x * x), zero)

    def whole(v: str) -> Column:
        x = F.col(v) * 10**digits
        off = F.abs(x - F.round(x)) > 1e-6 * F.greatest(F.lit(1.0), F.abs(x) * 1e-6)
        return F.when(off, F.raise_error(F.lit(f"{v} has more than {digits} decimals"))).otherwise(F.round(x))

    scaled = {f"_x_{v}": whole(v).cast("bigint") for v in values}
    rolled = skew.rolling_sums(df.withColumns(scaled), keys, time, width, **sums)
    out = []
    for v in values:
        n, s = F.col(f"n_{v}"), F.col(f"_s_{v}")
        wide = [F.col(c).cast("decimal(38,0)") for c in (f"n_{v}", f"_q_{v}", f"_s_{v}")]
        spread = (wide[0] * wide[1] - wide[2] * wide[2]).cast("double")
        out += [
            F.when(n > 0, s / n / 10.0**digits).alias(f"mean_{v}"),
            F.when(n > 0, F.sqrt(spread) / n / 10.0**digits).alias(f"std_{v}"),
            n,
        ]
    return rolled.select(*keys, time, *out)


def winners(df: DataFrame) -> DataFrame:
    """One row per race: its first-placed runner, the lowest number on a dead heat."""
    columns = [c for c in df.columns if c != "race_id"]
    first = F.min_by(F.struct(*columns), F.col("horse_no"))
    return (
        df.filter("finish_pos = 1").groupBy("race_id").agg(first.alias("_w")).select("race_id", "_w.*")
    )


def race_baseline(df: DataFrame) -> DataFrame:
    """Expected time and last-section time of each race, with the bias of the day so far.

    Expected times shrink the two-year mean of like races (track, surface,
    distance, going) towards that of the same surface and distance.
    """
    best = winners(df.select("race_id", "race_datetime", "race_date", "track_code", "surface",
                             "distance_m", "going", "horse_no", "finish_pos", "time_sec",
                             "final3f_sec"))
    keyed = best.withColumns(
        {
            "_tick": _tick(),
            "_track": F.coalesce(F.col("track_code").cast("double"), F.lit(NO_KEY)),
            "_surface": F.coalesce(F.col("surface").cast("double"), F.lit(NO_KEY)),
            "_distance": F.coalesce(S.distance_bucket(F.col("distance_m")), F.lit(NO_KEY)),
            "_going": F.coalesce(S.going_bucket(F.col("going")), F.lit(NO_KEY)),
            "time_sec": S.number(F.col("time_sec")),
            "final3f_sec": S.number(F.col("final3f_sec")),
        }
    )
    # one narrow row per race, read by both levels and by the join back
    keyed = stored(keyed)
    levels = {
        "fine": ["_track", "_surface", "_distance", "_going"],
        "coarse": ["_surface", "_distance"],
    }
    values = {"time": "time_sec", "3f": "final3f_sec"}
    out = keyed
    for level, keys in levels.items():
        stats = rolling_stats(keyed, keys, "_tick", list(values.values()), C.HISTORY_DAYS * DAY)
        renamed = [
            F.col(f"{part}_{v}").alias(f"_{level}_{part}_{name}")
            for name, v in values.items()
            for part in ("mean", "n")
        ]
        out = out.join(stats.select(*keys, "_tick", *renamed), [*keys, "_tick"], "left")
    for name, value in values.items():
        base = S.shrunk_mean(
            F.col(f"_fine_mean_{name}"), F.col(f"_fine_n_{name}"), F.col(f"_coarse_mean_{name}")
        )
        out = out.withColumn(f"baseline_{name}_sec", base).withColumn(
            f"_bias_{name}", F.col(value) - F.col(f"baseline_{name}_sec")
        )
    return same_day_bias(out).select(
        "race_id",
        "baseline_time_sec",
        "baseline_3f_sec",
        F.col("_mean_time").alias("daily_time_bias"),
        F.col("_mean_3f").alias("daily_up3_bias"),
    )


def same_day_bias(df: DataFrame) -> DataFrame:
    """Mean bias of the races run earlier the same day on the same track and surface."""
    day = F.unix_date(F.col("race_date").cast("date"))
    # order within the day: post time, then race id
    ordered = df.withColumns(
        {
            "_day": day,
            "_place": (F.col("_tick") - day * DAY) * F.lit(10**13) + F.col("race_id"),
        }
    )
    keys = ["_day", "_track", "_surface"]
    before = skew.running_sums(
        ordered,
        keys,
        "_place",
        _n_time=F.count("_bias_time"),
        _s_time=F.sum("_bias_time"),
        _n_3f=F.count("_bias_3f"),
        _s_3f=F.sum("_bias_3f"),
    ).select(
        *keys,
        "_place",
        F.when(F.col("_n_time") > 0, F.col("_s_time") / F.col("_n_time")).alias("_mean_time"),
        F.when(F.col("_n_3f") > 0, F.col("_s_3f") / F.col("_n_3f")).alias("_mean_3f"),
    )
    return ordered.join(before, [*keys, "_place"], "left").drop("_day", "_place")


def add_speed_indices(df: DataFrame) -> DataFrame:
    base = race_baseline(df)
    zero = F.lit(0.0)
    distance = S.number(F.col("distance_m"))
    return (
        df.join(base, "race_id", "left")
        .withColumns(
            {
                "base_time_sec": F.col("baseline_time_sec") + F.coalesce("daily_time_bias", zero),
                "base_3f_sec": F.col("baseline_3f_sec") + F.coalesce("daily_up3_bias", zero),
            }
        )
        .withColumns(
            {
                "perf_speed_index": S.speed_index(
                    F.col("base_time_sec"), S.number(F.col("time_sec")), distance
                ),
                "perf_up3_index": S.speed_index(
                    F.col("base_3f_sec"), S.number(F.col("final3f_sec")), distance
                ),
            }
        )
    )


def add_lags(df: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Last three runs of each horse and what changed since the last one."""
    values = [*LAGGED, "race_datetime", "jockey_key"]
    lagged = skew.lagged(
        df, "horse_id", ["race_datetime", "race_id"], _tick(), values, 3, limit=limit
    )
    names = {"perf_speed_index": "speed_index", "perf_up3_index": "up3_index"}
    columns = {
        f"lag{k}_{names.get(c, c)}": F.col(f"_lag{k}")[c] for k in (1, 2, 3) for c in LAGGED
    }
    columns["lag1_race_datetime"] = F.col("_lag1")["race_datetime"]
    columns["lag1_jockey_key"] = F.col("_lag1")["jockey_key"]
    flat = lagged.withColumns(columns).drop("_lag1", "_lag2", "_lag3")
    changed = F.when(
        F.col("lag1_jockey_key").isNotNull() & (F.col("jockey_key") > 0),
        S.flag(F.col("jockey_key") != F.col("lag1_jockey_key")),
    ).otherwise(0)
    same = F.when(
        F.col("lag1_surface").isNotNull(), S.flag(F.col("surface") == F.col("lag1_surface"))
    )
    return flat.withColumns(
        {
            "days_since_lag1": S.whole_days(_tick(), _tick("lag1_race_datetime")),
            "lag1_distance_diff": F.col("distance_m") - F.col("lag1_distance_m"),
            "lag1_course_type_match": same.cast("double"),
            "is_jockey_change": changed,
        }
    )


def add_recent_change(df: DataFrame) -> DataFrame:
    columns = {}
    for name in ("speed_index", "up3_index"):
        one, two, three = (F.col(f"lag{k}_{name}") for k in (1, 2, 3))
        columns[f"d_{name}_1_2"] = one - two
        columns[f"d_{name}_2_3"] = two - three
        columns[f"{name}_slope_3r"] = S.slope3(three, two, one)
    return df.withColumns(columns)


def first_in_range(df: DataFrame, keys: Sequence[str], time: str, width: int) -> DataFrame:
    """(keys, time, first): earliest time of the key within [time - width, time], itself included.

    Each time asks at `time - width`; going back in time, the last one passed is
    the answer. One row per calendar tick and key, so a key stays bounded.
    """
    ticks = df.select(*keys, F.col(time).alias("_at")).distinct()
    seen = ticks.select(*keys, "_at", F.col("_at").alias("_seen"), F.lit(None).cast("bigint").alias("_for"))
    asks = ticks.select(
        *keys, (F.col("_at") - width).alias("_at"), F.lit(None).cast("bigint").alias("_seen"),
        F.col("_at").alias("_for"),
    )
    back = (
        Window.partitionBy(*keys)
        .orderBy(F.col("_at").desc(), F.col("_seen").desc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        seen.unionByName(asks)
        .withColumn("_first", F.min("_seen").over(back))
        .filter(F.col("_for").isNotNull())
        .select(*keys, F.col("_for").alias(time), F.col("_first").alias("first"))
    )


# In the functions below `source` is the frame history is counted on, by default `df`
# itself. A plan that adds several features passes the same stored frame each time, so
# that no feature is computed again for the sake of the next one.


def add_experience(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Starts in the two years before the race, and days since the first of them."""
    width = C.HISTORY_DAYS * DAY
    keyed = (source or df).select("horse_id", _tick().alias("_tick"))
    starts = skew.rolling_sums(keyed, ["horse_id"], "_tick", width, prior_starts_2y=F.count(F.lit(1)))
    first = first_in_range(keyed, ["horse_id"], "_tick", width)
    stats = starts.join(first, ["horse_id", "_tick"]).select(
        "horse_id",
        "_tick",
        "prior_starts_2y",
        F.when(
            F.col("prior_starts_2y") > 0, S.whole_days(F.col("_tick"), F.col("first"))
        ).alias("days_since_first_seen_2y"),
    )
    ticked = df.withColumn("_tick", _tick())
    return ticked.join(stats, ["horse_id", "_tick"], "left").drop("_tick")


def smoothed(total: Column, count: Column, prior: Column | float) -> Column:
    prior = prior if isinstance(prior, Column) else F.lit(prior)
    zero = F.lit(0.0)
    return (F.coalesce(total.cast("double"), zero) + C.PRIOR_N * prior) / (
        F.coalesce(count.cast("double"), zero) + C.PRIOR_N
    )


def conditional_rate(
    df: DataFrame, same: str, output: str, source: DataFrame | None = None
) -> DataFrame:
    """Smoothed top-3 rate over the horse's past two years where `same` had today's value.

    The equality is part of the key, so no history is scanned per row. A null
    value has no like races and gets the prior.
    """
    keys = {"_tick": _tick(), "_same": F.col(same).cast("double")}
    counted = (source or df).withColumns(keys).filter(F.col("_same").isNotNull())
    sums = skew.rolling_sums(
        counted.select("horse_id", "_same", "_tick", "is_top3"),
        ["horse_id", "_same"],
        "_tick",
        C.HISTORY_DAYS * DAY,
        _top3=F.sum("is_top3"),
        _starts=F.count(F.lit(1)),
    )
    return (
        df.withColumns(keys)
        .join(sums, ["horse_id", "_same", "_tick"], "left")
        .withColumn(output, smoothed(F.col("_top3"), F.col("_starts"), C.PRIOR_TOP3_RATE))
        .drop("_tick", "_same", "_top3", "_starts")
    )


def add_aptitude(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    source = source or df
    by_distance = conditional_rate(df, "distance_m", "apt_same_distance_top3_rate_2y", source)
    return conditional_rate(by_distance, "going_bucket", "apt_same_going_top3_rate_2y", source)


def entity_daily(df: DataFrame, key: str, target: str) -> DataFrame:
    """Sum of the target and number of starts per entity and day."""
    day = F.unix_date(F.col("race_date").cast("date"))
    return (
        df.filter(F.col(key) > 0)
        .withColumn("_day", day)
        .groupBy(key, "_day")
        .agg(
            F.sum(F.col(target).cast("bigint")).alias("target_sum"),
            F.count(F.lit(1)).alias("starts"),
        )
    )


def entity_rate(
    df: DataFrame, key: str, target: str, output: str, prior: Column | float,
    source: DataFrame | None = None,
) -> DataFrame:
    """Smoothed mean of the target over the entity's previous 183 days.

    `prior` is a number or a column.
    """
    daily = entity_daily(source or df, key, target)
    sums = skew.rolling_sums(
        daily, [key], "_day", C.ENTITY_DAYS, _total=F.sum("target_sum"), _starts=F.sum("starts")
    )
    day = F.unix_date(F.col("race_date").cast("date"))
    return (
        df.withColumn("_day", day)
        .join(sums, [key, "_day"], "left")
        .withColumn(output, smoothed(F.col("_total"), F.col("_starts"), prior))
        .drop("_day", "_total", "_starts")
    )


def label_prior(df: DataFrame, from_date: str) -> DataFrame:
    """One row `prior`: mean label before `from_date`, else mean of 6 / field size, else 0."""
    earlier = F.col("race_date") < F.lit(from_date).cast("date")
    field = F.when(F.col("field_size") != 0, 6.0 / F.col("field_size"))
    return df.agg(
        F.coalesce(
            F.avg(F.when(earlier, F.col("target_label"))), F.avg(field), F.lit(0.0)
        ).alias("prior")
    )
