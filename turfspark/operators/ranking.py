"""Plackett-Luce ranking: likelihood, gradient, exact top-3 and pair probabilities, fits.

A race has a bounded number of runners: numbers have two digits in every pair
key, so at most 99, and 18 in the target segment. Work inside one race may
therefore use a window or an array per race; a race with more runners is refused
with an error, never cut. All sums of powers are kept as logarithms, each stage
of a race by its own largest score, so scores may lie thousands apart.
"""

from __future__ import annotations

import math
import warnings
import zlib
from collections.abc import Generator, Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfspark import constants as C
from turfspark.functions import market as M
from turfspark.functions import scalars as S
from turfspark.operators import ingroup, skew
from turfspark.session import materialize, stored

# two-digit runner numbers: pair keys and the work inside a race rest on this bound
MOST_RUNNERS = 99
PAIR_CELLS = 1 << 18  # pairs of runners that are computed at a time
_NOTHING = float("-inf")
Descent = Generator[list[float], tuple[float, list[float]], tuple[list[float], float, bool]]


# --- pairs and top-k ---------------------------------------------------------


def pairs(df: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """All unordered pairs of runners of a race: lower number first, key `iijj`.

    Each column of `carry` comes out as `<name>_1` and `<name>_2`.
    """
    left = df.select("race_id", F.col("horse_no").alias("horse_no_1"), *[F.col(c).alias(f"{c}_1") for c in carry])
    right = df.select(
        F.col("race_id").alias("_race"), F.col("horse_no").alias("horse_no_2"), *[F.col(c).alias(f"{c}_2") for c in carry]
    )
    joined = left.join(
        right, (F.col("race_id") == F.col("_race")) & (F.col("horse_no_1") < F.col("horse_no_2"))
    )
    return joined.drop("_race").withColumn(
        "kumiban", S.pair_key(F.col("horse_no_1"), F.col("horse_no_2"))
    )


def _bounded(size: Column, value: Column) -> Column:
    """`value`, or an error for a race that breaks the bound on runners."""
    return F.when(size > MOST_RUNNERS, F.raise_error(F.lit(f"a race has more than {MOST_RUNNERS} runners"))).otherwise(value)


def _log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    high = np.maximum(a, b)
    return np.where(high == _NOTHING, high, high + np.log1p(np.exp(np.fmin(a, b) - high)))


def _log_less(total: np.ndarray, *parts: np.ndarray) -> np.ndarray:
    """Log of a total without some of its parts; nothing left gives minus infinity."""
    gone = sum((np.exp(part - total) for part in parts), 0.0)
    return np.where(gone < 1.0, total + np.log1p(-np.where(gone < 1.0, gone, 0.0)), _NOTHING)


def _log_total(terms: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
    """Log of the sum of powers along the last axis, of the terms to `keep`; minus infinity if there are none."""
    if not terms.shape[-1]:
        return np.full(terms.shape[:-1], _NOTHING)
    terms = terms if keep is None else np.where(keep, terms, _NOTHING)
    high = terms.max(axis=-1, keepdims=True)
    return np.where(high == _NOTHING, high, high + np.log(np.exp(terms - high).sum(axis=-1, keepdims=True)))[..., 0]


class _Races:
    """Races of one size, their scores (race, place) falling.

    Totals that leave out the heaviest runners are summed, not subtracted, so a dominant score neither cancels nor
    hides the rest. A runner has the log of the weight without it, and the logs of two totals over its rivals, the
    heaviest rival apart.
    """

    def __init__(self, s: np.ndarray) -> None:
        n = s.shape[1]
        self.s, self.n = s, n
        self.logs = [_log_total(s[:, k:])[:, None] for k in range(3)]
        self.rest = _log_less(self.logs[0], s)
        self.rest[:, :1] = self.logs[1]
        one, two = np.divmod(np.arange(n * n), n)
        left = self.without(one, two).reshape(-1, n, n)
        after = s[:, None, :] - left
        ahead = after - self.rest[:, None, :]
        top = np.where(np.arange(n) == 0, min(1, n - 1), 0)  # the heaviest rival of each place
        others = np.ones((n, n), dtype=bool)
        others[np.arange(n), np.arange(n)] = others[np.arange(n), top] = False
        self.totals = [
            (_log_total(terms, others), np.take_along_axis(terms, np.broadcast_to(top[None, :, None], (len(s), n, 1)), 2)[..., 0])
            for terms in (after, ahead)
        ]

    def without(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Log of the weight of the race without two runners, for pairs of places: the same in all races."""
        top, second = np.minimum(one, two), np.maximum(one, two)
        out = _log_less(self.logs[0], self.s[:, one], self.s[:, two])
        led = top == 0
        out[:, led] = _log_less(self.logs[1], self.s[:, second[led]])
        out[:, led & (second == 1)] = self.logs[2]
        return out

    def both_in_three(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Probability that both runners come in the first three, for pairs of places (race, pair)."""
        if self.n <= 3:
            return np.ones((len(self.s), len(one)))
        sides = [(one, two), (two, one)]
        s_one, s_two = self.s[:, one], self.s[:, two]
        left = self.without(one, two)

        def less(which: int, own: np.ndarray, other: np.ndarray, term: np.ndarray) -> np.ndarray:
            """A runner's total over its rivals, without the other member of the pair."""
            total, top = (values[:, own] for values in self.totals[which])
            is_top = other == np.where(own == 0, 1, 0)
            return np.where(is_top, total, _log_add(_log_less(total, term), top))

        stages = [-self.rest[:, own] for own, _ in sides]
        stages += [less(0, own, other, self.s[:, other] - left) - self.rest[:, own] for own, other in sides]
        stages += [less(1, own, other, self.s[:, other] - left - self.rest[:, own_rest]) for (own, other), own_rest in zip(sides, (two, one), strict=True)]
        p = 0.0
        for stage in stages:
            p = p + np.exp(s_one + s_two - self.logs[0] + stage)
        return np.fmin(np.maximum(p, 0.0), 1.0)


def _by_size(scores: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Races of one size at a time, no more than fit in PAIR_CELLS: their places in the batch, runners and scores."""
    sizes = scores.value_lengths().to_numpy(zero_copy_only=False)
    first = np.cumsum(sizes) - sizes
    flat = scores.flatten().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes > 0]):
        all_ = np.flatnonzero(sizes == size)
        step = max(1, PAIR_CELLS // int(size * size))
        for at in range(0, len(all_), step):
            races = all_[at : at + step]
            runners = first[races][:, None] + np.arange(size)
            yield races, runners, flat[runners]


def _pair_lists(numbers: pa.Array, scores: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
    """Pairs of runners of each race: race, both numbers (the lower one first) and probability, races in order."""
    no = numbers.flatten()
    parts = []
    for races, runners, s in _by_size(scores):
        one, two = np.triu_indices(s.shape[1], 1)
        if not len(one):
            continue
        a, b = runners[:, one].ravel(), runners[:, two].ravel()
        ordered = pc.fill_null(pc.less_equal(no.take(pa.array(a)), no.take(pa.array(b))), False)
        ordered = ordered.to_numpy(zero_copy_only=False).reshape(len(races), -1)
        with np.errstate(all="ignore"):
            field = _Races(s)
            p = field.both_in_three(one, two)
            if not ordered.all():
                p = np.where(ordered, p, field.both_in_three(two, one))
        flip = ~ordered.ravel()
        parts.append((np.repeat(races, len(one)), np.where(flip, b, a), np.where(flip, a, b), p.ravel()))
    if not parts:
        parts = [(np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0),)]
    race, a, b, p = (np.concatenate(v) for v in zip(*parts, strict=True))
    order = np.argsort(race, kind="stable")
    return race[order], no.take(pa.array(a[order])), no.take(pa.array(b[order])), p[order]


def _as_lists(race: np.ndarray, races: int, fields: dict[str, pa.Array]) -> pa.ListArray:
    """One list of structs per race of the batch."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(race, minlength=races))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def _race_arrays(df: DataFrame, score: str) -> DataFrame:
    """One row per race after one shuffle: the numbers of its runners and their scores, falling; equal ones by number."""
    known = df.withColumn("_s", S.number(F.col(score))).filter(F.col("_s").isNotNull())
    runner = F.struct((-F.col("_s")).alias("s"), F.col("horse_no").alias("no"))
    races = known.groupBy("race_id").agg(F.count(F.lit(1)).alias("_n"), F.collect_list(runner).alias("_rows"))
    placed = races.withColumn("_rows", _bounded(F.col("_n"), F.sort_array("_rows")))
    return placed.select("race_id", F.col("_rows.no").alias("_no"), F.col("_rows.s").alias("_s"))


def pair_probabilities(df: DataFrame, score: str) -> DataFrame:
    """Exact Plackett-Luce probability that both runners of a pair finish in the first three.

    The sum over the third runner needs two totals per runner, each over its
    rivals; the heaviest rival is kept apart in them so that taking one rival
    out again never cancels. Work and rows are quadratic in the field, as the
    output is; everything after the one shuffle by race is narrow, and races of
    a size are computed together. With three runners or fewer every pair is certain.
    """
    kind = df.schema["horse_no"].dataType.simpleString()

    @F.arrow_udf(f"array<struct<horse_no_1: {kind}, horse_no_2: {kind}, p_wide: double>>")
    def pairs_of(numbers: pa.Array, scores: pa.Array) -> pa.Array:
        race, one, two, p = _pair_lists(numbers, _negated(scores))
        return _as_lists(race, len(numbers), {"horse_no_1": one, "horse_no_2": two, "p_wide": pa.array(p)})

    rows = _race_arrays(df, score).select("race_id", F.inline(pairs_of("_no", "_s")))
    return rows.select(
        "race_id", "horse_no_1", "horse_no_2", S.pair_key(F.col("horse_no_1"), F.col("horse_no_2")).alias("kumiban"), "p_wide"
    )


def top3_probabilities(df: DataFrame, score: str) -> DataFrame:
    """Exact probability of a first-three finish; a runner in the first three makes two pairs.

    Pairs are added up per runner where their race already is; rows of one number count as one runner, and pairs
    within it don't count.
    """
    kind = df.schema["horse_no"].dataType.simpleString()

    @F.arrow_udf(f"array<struct<horse_no: {kind}, p_top3: double>>")
    def singles_of(numbers: pa.Array, scores: pa.Array) -> pa.Array:
        no = numbers.flatten()
        codes = no.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        known = no.is_valid().to_numpy(zero_copy_only=False)
        half = np.zeros(len(no))
        for _, runners, s in _by_size(_negated(scores)):
            if s.shape[1] <= 3:
                half[runners] = 1.0
                continue
            one, two = np.triu_indices(s.shape[1], 1)
            with np.errstate(all="ignore"):
                p = _Races(s).both_in_three(one, two)
            twice = (codes[runners[:, one]] == codes[runners[:, two]]) & known[runners[:, one]]
            grid = np.zeros((len(s), s.shape[1], s.shape[1]))
            grid[:, one, two] = grid[:, two, one] = np.where(twice, 0.0, p)
            half[runners] = grid.sum(axis=2) / 2.0
        sizes = numbers.value_lengths().to_numpy(zero_copy_only=False)
        race = np.repeat(np.arange(len(sizes)), sizes)
        _, first, own = np.unique(race * (len(no) + 1) + codes, return_index=True, return_inverse=True)
        certain = sizes[race[first]] <= 3
        p = np.where(certain, 1.0, np.bincount(own, weights=half, minlength=len(first)))
        return _as_lists(race[first], len(sizes), {"horse_no": no.take(pa.array(first)), "p_top3": pa.array(p)})

    return _race_arrays(df, score).select("race_id", F.inline(singles_of("_no", "_s")))


def _negated(scores: pa.Array) -> pa.Array:
    """Scores in falling order from their negatives, which Spark has put in rising order."""
    return pa.ListArray.from_arrays(scores.offsets, pc.negate(scores.values)) if len(scores) else scores


def top3_from_pairs(df: DataFrame, score: str, pair: DataFrame) -> DataFrame:
    """Probability of a first-three finish per runner with a score, from the pairs of its race."""
    ends = pair.select(
        "race_id", F.explode(F.array("horse_no_1", "horse_no_2")).alias("horse_no"), "p_wide"
    )
    half = ends.groupBy("race_id", "horse_no").agg((F.sum("p_wide") / 2.0).alias("_half"))
    scored = df.filter(S.number(F.col(score)).isNotNull()).select("race_id", "horse_no")
    sized = skew.attach_group(scored, ["race_id"], _n=F.count(F.lit(1)))
    certain = F.when(F.col("_n") <= 3, F.lit(1.0))
    return sized.join(half, ["race_id", "horse_no"], "left").select(
        "race_id", "horse_no", F.coalesce(certain, F.col("_half")).alias("p_top3")
    )


def with_members(pair: DataFrame, horses: DataFrame) -> DataFrame:
    """Pairs with the top-3 probability of both members, `p_top3_1` and `p_top3_2`."""
    out = pair
    for side in (1, 2):
        member = horses.select("race_id", F.col("horse_no").alias(f"horse_no_{side}"), F.col("p_top3").alias(f"p_top3_{side}"))
        out = out.join(member, ["race_id", f"horse_no_{side}"])
    return out


def _topk_counts(scores: np.ndarray, keys: list[np.ndarray], draws: int, top_k: int) -> np.ndarray:
    """How often each score, with Gumbel noise from its key, is among the `top_k` best of a draw.

    With noise -ln(e), e exponential, the best are the least e * exp(-score): one logarithm a draw, and the k least
    are kept while going through the runners, without sorting. Ties and scores too far apart are sorted.
    """
    if np.ptp(scores) < 600:
        times = [
            -np.log(1.0 - np.random.Generator(np.random.Philox(key=k)).random(draws)) * w
            for k, w in zip(keys, np.exp(scores.max() - scores), strict=True)
        ]
        least = [np.full(draws, np.inf) for _ in range(top_k)]
        for time in times:
            for i, held in enumerate(least):
                least[i], time = np.minimum(held, time), np.maximum(held, time)
        counts = np.array([np.count_nonzero(time <= least[-1]) for time in times])
        if counts.sum() == top_k * draws and min(time.min() for time in times) > 0:
            return counts
    noise = np.stack([np.random.Generator(np.random.Philox(key=k)).gumbel(size=draws) for k in keys])
    best = np.argsort(-(scores[:, None] + noise), axis=0, kind="stable")[:top_k]
    return np.bincount(best.ravel(), minlength=len(scores))


def gumbel_topk(
    df: DataFrame, score: str, *, draws: int = 10_000, top_k: int = 3, seed: int = 42
) -> DataFrame:
    """Monte-Carlo estimate of top-k inclusion: perturb scores, keep the k best of each draw.

    A race, at most MOST_RUNNERS, is an array after one shuffle; its draws are made
    and counted there, so no row is multiplied. Noise comes from a counter-based
    generator keyed by seed, race and runner, so a lost task redraws the same values.
    """
    scored = df.withColumn("_s", S.number(F.col(score))).filter(F.col("_s").isNotNull())
    # rows are few bytes and much work: their tasks must not be merged by size
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    spread = scored.select("race_id", "horse_no", "_s").repartition(tasks, "race_id")
    runners = F.array_sort(F.collect_list(F.struct("horse_no", "_s")))
    races = spread.groupBy("race_id").agg(runners.alias("_runners"))
    races = races.select("race_id", _bounded(F.size("_runners"), F.col("_runners")).alias("_runners"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, shares = [], [], []
            for race, runners in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = [r["horse_no"] for r in runners]
                if len(own) <= top_k:  # all of them are among the best of every draw
                    ids += [race] * len(own)
                    numbers += own
                    shares += [1.0] * len(own)
                    continue
                key = zlib.crc32(repr(race).encode())
                keys = [np.array([seed, key << 32 | int(no or 0)], dtype=np.uint64) for no in own]
                share = _topk_counts(np.array([r["_s"] for r in runners]), keys, draws, top_k) / float(draws)
                ids += [race] * len(own)
                numbers += own
                shares += share.tolist()
            fields = [batch.schema.field(0).type, batch.schema.field(1).type.value_type.field("horse_no").type]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, fields[0]), pa.array(numbers, fields[1]), pa.array(shares, pa.float64())],
                names=["race_id", "horse_no", "p_topk"],
            )

    return races.mapInArrow(draw, f"race_id {kinds['race_id']}, horse_no {kinds['horse_no']}, p_topk double")


# --- likelihood and gradient -------------------------------------------------


def finish_groups(df: DataFrame) -> DataFrame:
    """Rows that take part in the likelihood: known finish and number, two runners or more."""
    known = df.filter(F.col("finish_pos").isNotNull() & F.col("horse_no").isNotNull())
    sized = skew.attach_group(known, ["race_id"], _runners=F.count(F.lit(1)))
    # the order of finish; a dead heat is placed by number
    place = F.col("finish_pos").cast("bigint") * 1_000_000 + F.col("horse_no").cast("bigint")
    return sized.filter("_runners >= 2").withColumn("_place", place).drop("_runners")


def _running_log_totals(terms: Column) -> Column:
    """Logs of the running sums of powers of an array of logs, in its order."""

    @F.arrow_udf("array<double>")
    def totals(lists: pa.Array) -> pa.Array:
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        out = np.zeros(int(sizes.sum()))
        for _, runners, x in _by_size(lists):
            high, total = np.full(len(x), _NOTHING), np.zeros(len(x))
            with np.errstate(all="ignore"):
                for place in range(x.shape[1]):
                    top = np.maximum(high, x[:, place])
                    total = total * np.exp(high - top) + np.exp(x[:, place] - top)
                    high = top
                    out[runners[:, place]] = high + np.log(total)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(out))

    return totals(terms)


def pl_terms(groups: DataFrame, score: str, *, gradient: bool = False) -> DataFrame:
    """Per runner: `nll` = log of the weight still in the race minus the own score.

    With `gradient`, `g` is the derivative of the race's loss by the runner's
    score. A race with any unknown score is left out. The runners of a race, at
    most MOST_RUNNERS, are put in order in an array after one shuffle; rows that
    are placed by race already need none.
    """
    scored = groups.withColumn("_s", S.number(F.col(score)))
    rest = F.struct(*[c for c in scored.columns if c not in ("race_id", "_place", "_s")])
    rows = F.collect_list(F.struct("_place", "_s", rest.alias("_row")))
    gaps = F.count(F.when(F.col("_s").isNull(), 1))
    races = scored.groupBy("race_id").agg(rows.alias("_rows"), gaps.alias("_gaps"), F.count(F.lit(1)).alias("_size"))
    placed = races.filter("_gaps = 0").withColumn(
        "_rows", _bounded(F.col("_size"), F.array_sort("_rows", lambda a, b: (a["_place"] - b["_place"]).cast("int")))
    )
    left = placed.withColumn(
        "_left", F.reverse(_running_log_totals(F.reverse(F.transform("_rows", lambda r: r["_s"]))))
    )
    lists = ["_rows", "_left"]
    if gradient:
        left = left.withColumn("_past", _running_log_totals(F.transform("_left", lambda x: -x)))
        lists.append("_past")
    each = left.select("race_id", F.inline(F.arrays_zip(*lists)))
    out = each.select(
        "race_id",
        F.col("_rows._place").alias("_place"),
        F.col("_rows._s").alias("_s"),
        "_rows._row.*",
        *lists[1:],
    ).withColumn("nll", F.col("_left") - F.col("_s"))
    return out.withColumn("g", F.exp(F.col("_s") + F.col("_past")) - 1.0) if gradient else out


def pl_nll(df: DataFrame, score: str) -> DataFrame:
    """One row: mean negative log-likelihood per race, and the number of races."""
    per_race = pl_terms(finish_groups(df), score).groupBy("race_id").agg(F.sum("nll").alias("loss"))
    return per_race.agg(F.avg("loss").alias("nll"), F.count(F.lit(1)).alias("races"))


def linear_score(features: Sequence[str], weights: Sequence[float]) -> Column:
    """Dot product of feature columns and fixed weights."""
    score = F.lit(0.0)
    for name, weight in zip(features, weights, strict=True):
        score = score + F.col(name) * float(weight)
    return score


def pl_gradient(df: DataFrame, score: str, features: Sequence[str]) -> DataFrame:
    """One row: loss, number of races and the gradient by each feature's weight, per race."""
    terms = pl_terms(finish_groups(df), score, gradient=True)
    races = F.count_distinct("race_id")
    return terms.agg(
        (F.sum("nll") / races).alias("nll"),
        races.alias("races"),
        *[(F.sum(F.col("g") * F.col(f)) / races).alias(f"g_{f}") for f in features],
    )


def fit_pl(
    df: DataFrame,
    features: Sequence[str],
    *,
    l2: float = 1e-5,
    steps: int = 30,
    tolerance: float = 1e-7,
) -> tuple[list[float], float]:
    """Weights of the linear ranking model, and its training loss (see `fit_pl_by`)."""
    rows = df.select("race_id", "horse_no", "finish_pos", *features, F.lit(0).alias("_all"))
    weights, loss, converged = fit_pl_by(rows, features, "_all", l2=l2, steps=steps, tolerance=tolerance)[0]
    if not converged:
        warnings.warn(f"the ranking fit still gained after {steps} steps", RuntimeWarning, stacklevel=2)
    return weights, loss


def _descent(size: int, steps: int, tolerance: float) -> Descent:
    """Quasi-Newton steps with backtracking: yields weights, is sent their loss and slope.

    Returns the weights, their loss and whether the last step gained no more than the tolerance.
    """
    weights = [0.0] * size
    loss, slope = yield weights
    memory: list[tuple[list[float], list[float]]] = []
    for _ in range(steps):
        step = _quasi_newton_direction(slope, memory)
        descent = sum(a * b for a, b in zip(step, slope, strict=True))
        length = 1.0 if memory else min(1.0, 1.0 / max(math.sqrt(-descent), 1e-12))
        while True:
            trial = [w + length * d for w, d in zip(weights, step, strict=True)]
            trial_loss, trial_slope = yield trial
            if trial_loss <= loss + 1e-4 * length * descent or length < 1e-6:
                break
            length /= 2.0
        moved = [a - b for a, b in zip(trial, weights, strict=True)]
        turned = [a - b for a, b in zip(trial_slope, slope, strict=True)]
        gain = loss - trial_loss
        if gain < 0:
            return weights, loss, True
        weights, loss, slope = trial, trial_loss, trial_slope
        if sum(a * b for a, b in zip(moved, turned, strict=True)) > 1e-12:
            memory = [*memory, (moved, turned)][-8:]
        if gain <= tolerance * abs(loss):
            return weights, loss, True
    return weights, loss, False


def by_key(key: str, values: Mapping[Any, Any]) -> Column:
    """A value per group as a column; groups are few (folds)."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col(key))


def _race_losses(
    races: pa.ListArray, group: int, moments: np.ndarray | None, weights: np.ndarray
) -> tuple[int, int, float, np.ndarray]:
    """Races with two or more runners of a group, those with known scores, their loss and its slope by weight."""
    slope = np.zeros(len(weights))
    runners = races.flatten()
    lists = runners.field("groups")
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    mine = owner[lists.flatten().to_numpy(zero_copy_only=False) == group]
    race = np.repeat(np.arange(len(races)), races.value_lengths().to_numpy(zero_copy_only=False))[mine]
    sizes = np.bincount(race, minlength=len(races))
    if sizes.size and sizes.max() > MOST_RUNNERS:
        raise ValueError(f"a race has more than {MOST_RUNNERS} runners")
    x = runners.field("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(weights))[mine]
    if moments is not None:
        median, mean, std = moments
        x = (np.where(np.isnan(x), median, x) - mean) / std
    with np.errstate(all="ignore"):  # a score that isn't finite leaves its race out
        scores = x @ weights
    first = np.cumsum(sizes) - sizes
    usable, loss = 0, 0.0
    for size in np.unique(sizes[sizes >= 2]):
        at = first[sizes == size][:, None] + np.arange(size)
        at = at[np.isfinite(scores[at]).all(axis=1)]
        s = scores[at]
        # logs of the running sums of powers, from the last place and then from the first
        left = np.logaddexp.accumulate(s[:, ::-1], axis=1)[:, ::-1]
        past = np.logaddexp.accumulate(-left, axis=1)
        usable += len(at)
        loss += float((left - s).sum())
        slope += (np.exp(s + past) - 1.0).ravel() @ x[at.ravel()]
    return int((sizes >= 2).sum()), usable, loss, slope


def fit_pl_by(
    df: DataFrame,
    features: Sequence[str],
    by: str,
    *,
    moments: Mapping[Any, Sequence[Any]] | None = None,
    l2: float = 1e-5,
    steps: int = 30,
    tolerance: float = 1e-7,
) -> dict[Any, tuple[list[float], float, bool]]:
    """Ranking weights of every group of `by` (a fold): {group: (weights, loss, converged)}.

    The loss is convex. `by` is a group or an array of the groups a row belongs to. The runners of a race become one
    stored row after one shuffle, in their order of finish, whatever the number of groups; each step then reads
    these rows and adds up loss and gradient where they are, all groups in the same pass. The driver holds weight
    vectors only and takes limited-memory quasi-Newton steps with backtracking; a group that has converged is no longer
    counted. With `moments` (rows of `read_model` or of stats per group) features are filled and scaled for each group.
    """
    many = dict(df.dtypes)[by].startswith("array")
    member = F.explode(by) if many else F.col(by)
    keys = sorted(row[0] for row in df.select(member.alias("g")).distinct().filter("g is not null").collect())
    place = F.array(*[F.lit(k) for k in keys]) if keys else F.array().cast("array<int>")
    index = lambda g: (F.array_position(place, g) - 1).cast("int")
    groups = F.array_distinct(F.transform(F.filter(by, lambda g: g.isNotNull()), index)) if many else F.array(index(F.col(by)))
    vector = F.array(*[S.number(F.col(f)).cast("double") if moments else F.col(f).cast("double") for f in features])
    known = df.filter(F.col("finish_pos").isNotNull() & F.col("horse_no").isNotNull() & F.col(by).isNotNull())
    # the order of finish; a dead heat is placed by number
    order = F.col("finish_pos").cast("bigint") * 1_000_000 + F.col("horse_no").cast("bigint")
    runner = F.struct(order.alias("place"), groups.alias("groups"), vector.alias("x"))
    by_place = lambda a, b: F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).otherwise(0)
    rows = known.groupBy("race_id").agg(F.collect_list(runner).alias("_rows"))
    inside = F.transform(F.array_sort("_rows", by_place), lambda r: F.struct(r["groups"].alias("groups"), r["x"].alias("x")))
    races = stored(rows.select(inside.alias("_rows")))

    def sums(wanted: dict[int, list[float]]) -> dict[int, Any]:
        own = {g: np.array(weights) for g, weights in wanted.items()}
        scale = {
            g: np.array([[float(r[name]) for r in moments[keys[g]]] for name in ("median", "mean", "std")]) if moments else None
            for g in own
        }

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {g: [0, 0, 0.0, np.zeros(len(features))] for g in own}
            for batch in batches:
                for start in range(0, len(batch), 2000):
                    part = batch.column(0).slice(start, 2000)
                    for g, weights in own.items():
                        found = _race_losses(part, g, scale[g], weights)
                        total[g] = [a + b for a, b in zip(total[g], found, strict=True)]
            yield pa.RecordBatch.from_pylist(
                [{"g": g, "races": n, "usable": u, "loss": loss, "slope": v.tolist()} for g, (n, u, loss, v) in total.items()],
                pa.schema([("g", pa.int32()), ("races", pa.int64()), ("usable", pa.int64()), ("loss", pa.float64()),
                           ("slope", pa.list_(pa.float64()))]),
            )

        parts = races.mapInArrow(step, "g int, races bigint, usable bigint, loss double, slope array<double>")
        slopes = [F.sum(F.get("slope", F.lit(i))).alias(f"s{i}") for i in range(len(features))]
        totals = parts.groupBy("g").agg(F.sum("races").alias("races"), F.sum("usable").alias("usable"), F.sum("loss").alias("loss"), *slopes)
        return {row["g"]: row for row in totals.collect()}

    searches = {g: _descent(len(features), steps, tolerance) for g in range(len(keys))}
    wanted = {g: next(search) for g, search in searches.items()}
    fitted: dict[Any, tuple[list[float], float, bool]] = {}
    answers = sums(wanted) if wanted else {}
    wanted = {g: weights for g, weights in wanted.items() if g in answers and answers[g]["races"]}
    if not wanted:
        raise ValueError("no race with two or more finishers")
    missing = [keys[g] for g in wanted if not answers[g]["usable"]]
    if missing:
        raise ValueError(f"no usable race in groups {missing}")
    while wanted:
        for g, weights in list(wanted.items()):
            row, penalty = answers[g], 0.5 * l2 * sum(w * w for w in weights)
            slope = [row[f"s{i}"] / row["races"] + l2 * w for i, w in enumerate(weights)]
            try:
                wanted[g] = searches[g].send((row["loss"] / row["races"] + penalty, slope))
            except StopIteration as done:
                fitted[keys[g]] = done.value
                del wanted[g]
        answers = sums(wanted) if wanted else {}
    return fitted


def _quasi_newton_direction(
    slope: list[float], memory: list[tuple[list[float], list[float]]]
) -> list[float]:
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    q = list(slope)
    used = []
    for moved, turned in reversed(memory):
        rho = 1.0 / dot(moved, turned)
        alpha = rho * dot(moved, q)
        q = [x - alpha * y for x, y in zip(q, turned, strict=True)]
        used.append((rho, alpha, moved, turned))
    if memory:
        moved, turned = memory[-1]
        scale = dot(moved, turned) / dot(turned, turned)
        q = [x * scale for x in q]
    for rho, alpha, moved, turned in reversed(used):
        beta = rho * dot(turned, q)
        q = [x + (alpha - beta) * m for x, m in zip(q, moved, strict=True)]
    return [-x for x in q]


# --- standardised features ---------------------------------------------------


def feature_stats(df: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float, float]]:
    """Median, then mean and population deviation after filling with it, per feature (see `feature_stats_by`).

    Only one row per feature comes back.
    """
    found = feature_stats_by(df.withColumn("_all", F.lit(0)), features, "_all").collect()
    rows = {r["feature"]: (float(r["median"]), r["mean"], r["std"]) for r in found}
    return {n: rows.get(n, (0.0, 0.0, 1.0)) for n in features}


def standardize(df: DataFrame, stats: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Fill with the training median, centre and scale with the training moments."""
    return df.withColumns(
        {
            n: (F.coalesce(S.number(F.col(n)), F.lit(median)) - mean) / (std or 1.0)
            for n, (median, mean, std) in stats.items()
        }
    )


def feature_stats_by(df: DataFrame, features: Sequence[str], by: str) -> DataFrame:
    """(by, feature, median, mean, std) per group: exact median, then moments after filling with it.

    All features and groups are found together. Rows aren't moved: each pass combines map-side to a row per group.
    Approximate percentiles bracket the median; the values inside the bracket are counted, those below it too, so
    the median is exact. A bracket that misses it is replaced by the whole range. A feature without any value
    in a group has the median 0; one without deviation has the deviation 1.
    """
    values = df.select(F.col(by).alias("_g"), *[S.number(F.col(n)).alias(f"x{i}") for i, n in enumerate(features)])
    names = [f"x{i}" for i in range(len(features))]
    bracket = lambda x: F.percentile_approx(x, F.array(F.lit(0.499), F.lit(0.501)), 10_000)
    sketch = values.groupBy("_g").agg(*[F.struct(F.count(x).alias("n"), bracket(x).alias("cut")).alias(x) for x in names])
    cuts = {r["_g"]: [(r[x]["n"], *(r[x]["cut"] or (0.0, 0.0))) for x in names] for r in sketch.collect()}
    medians = {g: [0.0] * len(names) for g in cuts}
    open_ = {(g, i): bounds for g, own in cuts.items() if g is not None for i, bounds in enumerate(own) if bounds[0]}
    while open_:
        low, high = ([{g: float(open_[g, i][at]) for g in cuts if (g, i) in open_} for i in range(len(names))] for at in (1, 2))
        bound = lambda own: by_key("_g", own) if own else F.lit(None).cast("double")
        lows, highs = F.array(*[bound(own) for own in low]), F.array(*[bound(own) for own in high])
        marked = values.select("_g", F.array(*names).alias("_x"), lows.alias("_low"), highs.alias("_high"))
        # a value inside its bracket, or null for one below it
        kept = F.transform("_x", lambda x, i: F.struct(
            i.cast("int").alias("i"), F.when(x >= F.get("_low", i), x).alias("x"), (x <= F.get("_high", i)).alias("known")
        ))
        counted = marked.select("_g", F.inline(F.filter(kept, lambda v: v["known"]))).groupBy("_g", "i", "x").agg(F.count(F.lit(1)).alias("n"))
        stored_counts = materialize(counted)
        below = stored_counts.filter("x is null").select("_g", "i", F.col("n").alias("_below"))
        inside = stored_counts.filter("x is not null")
        upto = Window.partitionBy("_g", "i").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
        # only values of a bracket are left to put in order
        placed = inside.join(below, ["_g", "i"], "left").withColumn(
            "_upto", F.sum("n").over(upto) + F.coalesce("_below", F.lit(0))
        )
        sizes = values.sparkSession.createDataFrame(
            [(g, i, n) for (g, i), (n, *_) in open_.items()], f"_g {dict(values.dtypes)['_g']}, i int, _n bigint"
        )
        middle = (F.col("_n") - 1) * F.lit(0.5)
        holds = lambda at: (at >= F.col("_upto") - F.col("n")) & (at < F.col("_upto"))
        found = (
            placed.join(F.broadcast(sizes), ["_g", "i"])
            .groupBy("_g", "i", "_n")
            .agg(
                F.max(F.when(holds(F.floor(middle)), F.col("x"))).alias("low"),
                F.max(F.when(holds(F.ceil(middle)), F.col("x"))).alias("high"),
            )
            .select("_g", "i", (F.col("low") + (F.col("high") - F.col("low")) * (middle - F.floor(middle))).alias("median"))
            .collect()
        )
        for row in found:
            if row["median"] is not None:
                medians[row["_g"]][row["i"]] = row["median"]
                del open_[row["_g"], row["i"]]
        open_ = {key: (n, float("-inf"), float("inf")) for key, (n, *_) in open_.items()}
    filled = lambda i, x: F.coalesce(F.col(x), by_key("_g", {g: float(own[i]) for g, own in medians.items() if g is not None}))
    known = values.filter(F.col("_g").isNotNull())
    moments = known.groupBy("_g").agg(
        *[F.struct(F.avg(filled(i, x)).alias("mean"), F.stddev_pop(filled(i, x)).alias("std")).alias(x) for i, x in enumerate(names)]
    ) if any(g is not None for g in medians) else known.groupBy("_g").agg(
        *[F.struct(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std")).alias(x) for x in names]
    )
    median = lambda i: by_key("_g", {g: float(own[i]) for g, own in medians.items() if g is not None})
    row = lambda i, x, n: F.struct(
        F.lit(n).alias("feature"), median(i).alias("median"), F.col(x)["mean"].alias("mean"),
        F.when(F.col(x)["std"] > 0, F.col(x)["std"]).otherwise(F.lit(1.0)).alias("std"),
    )
    if all(g is None for g in medians):
        median = lambda i: F.lit(0.0)
    return moments.select(F.col("_g").alias(by), F.inline(F.array(*[row(i, x, n) for i, (x, n) in enumerate(zip(names, features, strict=True))])))


def model_table(
    stats: DataFrame, fits: Mapping[Any, tuple[list[float], float, bool]], features: Sequence[str], by: str
) -> DataFrame:
    """A fitted ranking layer as a table: per group and feature the place, moments and weight, and how the fit ended."""
    rows = [
        (key, name, at, float(weight), float(loss), converged)
        for key, (weights, loss, converged) in fits.items()
        for at, (name, weight) in enumerate(zip(features, weights, strict=True))
    ]
    kind = dict(stats.dtypes)[by]
    schema = f"{by} {kind}, feature string, at int, weight double, loss double, converged boolean"
    return stats.join(stats.sparkSession.createDataFrame(rows, schema), [by, "feature"])


def read_model(model: DataFrame, by: str) -> dict[Any, list[Any]]:
    """The rows of a model table per group, in the order of its features (a few rows per fold)."""
    out: dict[Any, list[Any]] = {}
    for row in model.orderBy(by, "at").collect():
        out.setdefault(row[by], []).append(row)
    names = {tuple(r["feature"] for r in rows) for rows in out.values()}
    if len(names) != 1:
        raise ValueError("the groups of a model table differ in their features")
    return out


def standardize_by(df: DataFrame, rows: Mapping[Any, Sequence[Any]], by: str) -> DataFrame:
    """Features filled and scaled with the moments of their own group; `rows` as of `read_model` or of stats."""
    names = [r["feature"] for r in next(iter(rows.values()))]
    value = lambda at, field: by_key(by, {k: float(r[at][field]) for k, r in rows.items()})
    return df.withColumns(
        {
            n: (F.coalesce(S.number(F.col(n)), value(at, "median")) - value(at, "mean")) / value(at, "std")
            for at, n in enumerate(names)
        }
    )


def score_by(df: DataFrame, model: DataFrame, by: str, output: str = "pl_score") -> DataFrame:
    """Rows with the score of their group's model; a group without a model is an error.

    Filling, scaling and weights of a group are one factor per feature and one constant, kept as data beside the
    plan, so its size doesn't grow with the number of groups.
    """
    rows = read_model(model, by)
    names = [r["feature"] for r in next(iter(rows.values()))]
    lists = lambda value: by_key(by, {k: F.array(*[F.lit(value(r)) for r in own]) for k, own in rows.items()})
    constant = by_key(by, {k: -sum(r["weight"] * r["mean"] / r["std"] for r in own) for k, own in rows.items()})
    filled = F.zip_with(
        F.array(*[S.number(F.col(n)) for n in names]), lists(lambda r: r["median"]), lambda x, median: F.coalesce(x, median)
    )
    products = F.zip_with(filled, lists(lambda r: r["weight"] / r["std"]), lambda x, factor: x * factor)
    score = F.aggregate(products, F.lit(0.0), lambda total, x: total + x) + constant
    lost = F.raise_error(F.concat(F.lit("no model for "), F.col(by).cast("string"))).cast("double")
    return df.withColumn(output, F.when(F.col(by).isin(list(rows)), score).otherwise(lost))


# --- win model evaluation ----------------------------------------------------


def race_fit(df: DataFrame, c_prob: str, *, y: str = "y_win") -> DataFrame:
    """Per usable race: model and null loss of the winner.

    Usable: exactly one winner, field larger than one, positive winner probability.
    """
    won = F.col(y) == 1
    per_race = df.groupBy("race_id").agg(
        F.count(F.when(won, 1)).alias("_winners"),
        F.max(F.when(won, S.number(F.col(c_prob)))).alias("_c"),
        F.max(S.number(F.col("field_size"))).alias("_field"),
    )
    return per_race.filter("_winners = 1 and _c > 0 and _field > 1").select(
        "race_id",
        (-F.ln(M.clip(F.col("_c"), C.PROB_EPS, 1.0))).alias("nll_model"),
        F.ln("_field").alias("nll_null"),
    )


def win_r2(df: DataFrame, c_prob: str, *, y: str = "y_win") -> DataFrame:
    """One row: summed losses, races and the pseudo-R² 1 - model / null."""
    model, null = F.sum("nll_model"), F.sum("nll_null")
    return race_fit(df, c_prob, y=y).agg(
        F.coalesce(model, F.lit(0.0)).alias("nll_model"),
        F.coalesce(null, F.lit(0.0)).alias("nll_null"),
        F.count(F.lit(1)).alias("races"),
        F.when(null > 0, 1.0 - model / null).alias("r2"),
    )


def beta_grid(low: float = C.BETA_MIN, high: float = C.BETA_MAX, points: int = C.BETA_POINTS) -> list[float]:
    first, last = math.log10(low), math.log10(high)
    return [10.0 ** (first + (last - first) * i / (points - 1)) for i in range(points)]


def beta_losses(df: DataFrame, score: str, betas: Sequence[float], *, y: str = "y_win") -> DataFrame:
    """(beta, nll, races) for a list of temperatures.

    All temperatures are evaluated in the same pass: one sum of powers per
    temperature and race, so rows are not multiplied by the grid.
    """
    won = F.col(y) == 1
    finite = df.withColumn("_s", S.number(F.col(score)))
    top = skew.attach_group(finite, ["race_id"], _top=F.max("_s"))
    gap = F.col("_s") - F.col("_top")
    per_race = (
        top.groupBy("race_id")
        .agg(
            F.count(F.when(won, 1)).alias("_winners"),
            F.max(F.when(won, gap)).alias("_won"),
            F.max(S.number(F.col("field_size"))).alias("_field"),
            *[F.sum(F.exp(gap * float(b))).alias(f"_z{i}") for i, b in enumerate(betas)],
        )
        .filter("_winners = 1 and _won is not null and _field > 1")
    )
    losses = per_race.agg(
        F.count(F.lit(1)).alias("races"),
        *[
            F.sum(
                F.least(
                    F.ln(f"_z{i}") - F.col("_won") * float(b), F.lit(-math.log(C.PROB_EPS))
                )
            ).alias(f"_nll{i}")
            for i, b in enumerate(betas)
        ],
    )
    table = F.array(
        *[
            F.struct(F.lit(i).alias("idx"), F.lit(float(b)).alias("beta"), F.col(f"_nll{i}").alias("nll"))
            for i, b in enumerate(betas)
        ]
    )
    return losses.select("races", F.inline(table))


def fit_beta(df: DataFrame, score: str, *, rounds: int = 4, y: str = "y_win") -> float:
    """Temperature with the least loss: the grid, then ever narrower grids around the best point."""
    points = beta_grid()
    kept = df.select("race_id", score, y, "field_size").persist()
    try:
        best = 1.0
        for _ in range(rounds):
            rows = {r["idx"]: r["nll"] for r in beta_losses(kept, score, points, y=y).collect()}
            known = {i: v for i, v in rows.items() if v is not None}
            if not known:
                return 1.0
            at = min(known, key=lambda i: (known[i], i))
            best = points[at]
            low, high = points[max(at - 1, 0)], points[min(at + 1, len(points) - 1)]
            points = beta_grid(low, high, 41)
        return min(max(best, C.BETA_MIN), C.BETA_MAX)
    finally:
        kept.unpersist()


def beta_losses_by(
    df: DataFrame, score: str, betas: Mapping[Any, Sequence[float]], by: str, *, y: str = "y_win"
) -> DataFrame:
    """(by, idx, beta, nll, races): the losses of each group (fold) at its own temperatures, in one pass over all groups."""
    won, many = F.col(y) == 1, len(next(iter(betas.values())))
    known = df.withColumn("_s", S.number(F.col(score))).filter(F.col(by).isin(list(betas)))
    top = skew.attach_group(known, [by, "race_id"], _top=F.max("_s"))
    gap = F.col("_s") - F.col("_top")
    lists = by_key(by, {k: F.array(*[F.lit(float(b)) for b in own]) for k, own in betas.items()})
    beta = [F.get("_b", i) for i in range(many)]
    per_race = (
        top.withColumn("_b", lists)
        .groupBy(by, "race_id")
        .agg(
            F.first("_b").alias("_b"),
            F.count(F.when(won, 1)).alias("_winners"),
            F.max(F.when(won, gap)).alias("_won"),
            F.max(S.number(F.col("field_size"))).alias("_field"),
            *[F.sum(F.exp(gap * b)).alias(f"_z{i}") for i, b in enumerate(beta)],
        )
        .filter("_winners = 1 and _won is not null and _field > 1")
    )
    most = F.lit(-math.log(C.PROB_EPS))
    losses = per_race.groupBy(by).agg(
        F.count(F.lit(1)).alias("races"),
        F.first("_b").alias("_b"),
        *[F.sum(F.least(F.ln(f"_z{i}") - F.col("_won") * b, most)).alias(f"_nll{i}") for i, b in enumerate(beta)],
    )
    table = F.array(
        *[F.struct(F.lit(i).alias("idx"), b.alias("beta"), F.col(f"_nll{i}").alias("nll")) for i, b in enumerate(beta)]
    )
    return losses.select(by, "races", F.inline(table))


def fit_betas(df: DataFrame, score: str, by: str, *, rounds: int = 4, y: str = "y_win") -> dict[Any, float]:
    """Temperature with the least loss of every group: one grid for all, then narrower grids of their own.

    A group without a usable race has the temperature 1.
    """
    kept = df.select(by, "race_id", score, y, "field_size").persist()
    try:
        groups = [row[0] for row in kept.select(by).distinct().collect()]
        best = dict.fromkeys(groups, 1.0)
        grids = {key: beta_grid() for key in groups}
        for _ in range(rounds if groups else 0):
            known: dict[Any, dict[int, float]] = {}
            for row in beta_losses_by(kept, score, grids, by, y=y).collect():
                if row["nll"] is not None:
                    known.setdefault(row[by], {})[row["idx"]] = row["nll"]
            if not known:
                break
            for key, losses in known.items():
                at, points = min(losses, key=lambda i: (losses[i], i)), grids[key]
                best[key] = min(max(points[at], C.BETA_MIN), C.BETA_MAX)
                grids[key] = beta_grid(points[max(at - 1, 0)], points[min(at + 1, len(points) - 1)], 41)
            grids = {key: grids[key] for key in known}
        return best
    finally:
        kept.unpersist()


def add_win_scores_by(df: DataFrame, p: str, betas: Mapping[Any, float], by: str, *, eps: float = C.LOGIT_EPS) -> DataFrame:
    """Logit score and race probabilities at temperature 1 and at the one of the row's group, with it as `beta_hat`."""
    scored = df.withColumns({f"score_{p}": M.logit(F.col(p), eps), "beta_hat": by_key(by, dict(betas))})
    one = ingroup.add_softmax(scored, f"score_{p}", f"c_{p}_beta1", 1.0)
    warm = one.withColumn("_warm", F.col(f"score_{p}") * F.col("beta_hat"))
    return ingroup.add_softmax(warm, "_warm", f"c_{p}_betahat", 1.0).drop("_warm")


def win_r2_by(df: DataFrame, c_prob: str, by: str, *, y: str = "y_win") -> DataFrame:
    """(by, nll_model, nll_null, races, r2) per group; a race belongs to one group."""
    groups = df.groupBy("race_id").agg(F.first(by).alias(by))
    model, null = F.sum("nll_model"), F.sum("nll_null")
    return race_fit(df, c_prob, y=y).join(groups, "race_id").groupBy(by).agg(
        model.alias("nll_model"),
        null.alias("nll_null"),
        F.count(F.lit(1)).alias("races"),
        F.when(null > 0, 1.0 - model / null).alias("r2"),
    )


def add_win_scores(df: DataFrame, p: str, beta: float, *, eps: float = C.LOGIT_EPS) -> DataFrame:
    """Logit score and race probabilities at beta 1 and at the fitted beta."""
    scored = df.withColumn(f"score_{p}", M.logit(F.col(p), eps))
    one = ingroup.add_softmax(scored, f"score_{p}", f"c_{p}_beta1", 1.0)
    return ingroup.add_softmax(one, f"score_{p}", f"c_{p}_betahat", beta)
