"""From pair probabilities to a settled ledger and its reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfspark import constants as C
from turfspark.operators import wager
from turfspark.session import stored


def settled_bets(
    pair: DataFrame,
    odds: DataFrame,
    payouts: DataFrame,
    strategies: Sequence[Mapping[str, object]] = ({},),
    *,
    cap_days: bool = True,
) -> DataFrame:
    """Settled bets of every strategy.

    `pair` holds race_id, race_date, horse_no_1/2, kumiban and p_wide; `odds` the
    odds log; `payouts` the payout table, of which the pair bets are used.
    """
    most = [int(s.get("max_bets", wager.DEFAULTS["max_bets"])) for s in strategies]
    priced = wager.candidates(pair, wager.latest_pair_odds(odds), strategies)
    bets = wager.race_stakes(priced, most=max(most) if min(most) > 0 else None)
    # the daily cap applies the floor of chosen bets itself, race by race
    bets = wager.daily_cap(bets) if cap_days else wager.selected_floor(bets)
    paid = payouts
    if "selection" in payouts.columns:
        paid = payouts.filter(F.col("bet_type") == C.BET_TYPES["wide"]).withColumnRenamed(
            "selection", "kumiban"
        )
    # the ledger feeds every report
    return stored(wager.settle(bets, paid))


def report(settled: DataFrame, considered: DataFrame | None = None) -> dict[str, DataFrame]:
    return {
        "ledger": wager.ledger(settled),
        "monthly": wager.monthly(settled),
        "summary": wager.summary(settled, considered),
    }
