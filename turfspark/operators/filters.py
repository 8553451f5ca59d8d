"""Row filters, key cleaning and set logic on keys and years."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfspark import constants as C
from turfspark.functions import scalars as S


def segment(df: DataFrame) -> DataFrame:
    """Target segment: central track, dirt, race type, condition, plausible runner with a finish."""
    code = lambda name: S.number(F.col(name))
    condition = code("condition_code_min_age")
    return df.filter(
        code("track_code").between(*C.CENTRAL_TRACKS)
        & (code("surface") == C.TARGET_SURFACE)
        & code("race_type_code").isin(*C.TARGET_RACE_TYPES)
        & condition.isin(*C.TARGET_CONDITIONS)
        & ~condition.isin(*C.EXCLUDED_CONDITIONS)
        & (code("distance_m") > 0)
        & (code("field_size") > 0)
        & code("horse_no").between(1, C.MAX_TARGET_HORSE_NO)
        & code("finish_pos").isNotNull()
    )


def history_start(from_date: str, days: int = C.HISTORY_DAYS):
    return F.date_sub(F.lit(from_date).cast("date"), days)


def date_window(df: DataFrame, from_date, to_date, column: str = "race_date") -> DataFrame:
    low = from_date if not isinstance(from_date, str) else F.lit(from_date).cast("date")
    return df.filter((F.col(column) >= low) & (F.col(column) <= F.lit(to_date).cast("date")))


def require_keys(df: DataFrame, keys: Sequence[str] = ("race_id", "horse_no")) -> DataFrame:
    """Rows whose keys are all known, keys as whole numbers."""
    typed = df.withColumns({k: S.whole(F.col(k)) for k in keys})
    return typed.dropna(subset=list(keys))


def model_rows(df: DataFrame, label: str) -> DataFrame:
    """Rows for a binary model: known keys and date, year, 0/1 label (unknown counts as 0)."""
    dated = df.withColumn("race_date", F.col("race_date").cast("date")).dropna(subset=["race_date"])
    return require_keys(dated).withColumns(
        {
            "year": F.year("race_date"),
            "horse_id": F.col("horse_id").cast("string"),
            "field_size": S.number(F.col("field_size")),
            label: F.coalesce(S.whole(F.col(label)), F.lit(0)).cast("int"),
        }
    )


def ranking_rows(df: DataFrame) -> DataFrame:
    """Rows for the ranking layer, with `y_top3` unknown when the finish is unknown."""
    out = model_rows(model_rows(df, "y_win"), "y_place")
    finish = S.number(F.col("finish_pos"))
    top3 = F.when(finish.isNotNull(), (finish <= 3).cast("int"))
    return out.withColumns({"finish_pos": finish, "y_top3": top3})


def eligible(df: DataFrame, predictions: Sequence[str], holdout_year: int, year: str = "year") -> DataFrame:
    """Rows before the holdout year with every required prediction."""
    return df.dropna(subset=list(predictions)).filter(F.col(year) < holdout_year)


def holdout(df: DataFrame, holdout_year: int, year: str = "year") -> DataFrame:
    return df.filter(F.col(year) >= holdout_year)


def in_keys(df: DataFrame, keys: DataFrame, on: Sequence[str] = ("race_id",)) -> DataFrame:
    """Rows whose key is among `keys`; the key list stays distributed."""
    return df.join(keys.select(*on), list(on), "left_semi")


def union_keys(frames: Sequence[DataFrame], on: Sequence[str] = ("race_id",)) -> DataFrame:
    out = frames[0].select(*on)
    for frame in frames[1:]:
        out = out.unionByName(frame.select(*on))
    return out.distinct()


def concat_folds(frames: Sequence[DataFrame]) -> DataFrame:
    """Fold outputs under one another; a column missing in one is null there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def in_order(df: DataFrame, keys: Sequence[str] = ("race_id", "horse_no")) -> DataFrame:
    """Total order over the keys: range-partitioned, each partition sorted."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)
