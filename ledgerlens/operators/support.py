"""Support states: what is not supported is NULL, never zero."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.config import MINIMUM


def support_state(family: str, n: Column, *, enough: Column | None = None, complete: Column | None = None, valid: Column | None = None) -> Column:
    """UNRESOLVED for an invalid wallet, INSUFFICIENT below the family's sample, PARTIAL if evidence is incomplete."""
    small = F.coalesce(n, F.lit(0)) < MINIMUM[family]
    if enough is not None:
        small = small | ~F.coalesce(enough, F.lit(False))
    state = F.when(small, "INSUFFICIENT_EVIDENCE")
    if complete is not None:
        state = state.when(~F.coalesce(complete, F.lit(True)), "PARTIAL")
    state = state.otherwise("SUPPORTED")
    return state if valid is None else F.when(~valid, "UNRESOLVED").otherwise(state)


def gated(rows: DataFrame, values: Mapping[str, Column], state: Column, keys: tuple[str, ...] = ("wallet",)) -> DataFrame:
    """keys, support_state and the values, NULL unless the state is SUPPORTED or PARTIAL."""
    stated = rows.withColumn("support_state", state)
    open_ = F.col("support_state").isin("SUPPORTED", "PARTIAL")
    return stated.select(*keys, "support_state", *[F.when(open_, v).alias(k) for k, v in values.items()])


def combined(states: list[Column]) -> Column:
    """The weakest of several states; a missing one counts as insufficient."""
    worst = lambda s: F.array_contains(F.array(*[F.coalesce(x, F.lit("INSUFFICIENT_EVIDENCE")) for x in states]), s)
    return F.when(worst("UNRESOLVED"), "UNRESOLVED").when(worst("INSUFFICIENT_EVIDENCE"), "INSUFFICIENT_EVIDENCE").when(worst("PARTIAL"), "PARTIAL").otherwise("SUPPORTED")
