"""Temporal and periodicity families: one shuffle by wallet serves gaps, sessions, bursts, weeks and lags."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.config import BURST_GAP, BURST_SIZE, SESSION_GAP, TOLERANCE
from ledgerlens.functions import stats as S
from ledgerlens.operators.support import gated, support_state


def along() -> Window:
    return Window.partitionBy("wallet").orderBy("ts", F.coalesce("idx", F.lit(0)), "tx")


def gaps(tx: DataFrame) -> DataFrame:
    """Timestamped transactions with the seconds since the wallet's last one; gap is NULL unless positive."""
    seen = tx.filter(F.col("ts").isNotNull()).withColumn("since", F.col("ts") - F.lag("ts").over(along()))
    return seen.withColumn("gap", F.when(F.col("since") > 0, F.col("since")))


def runs(tx: DataFrame, longest_gap: int) -> DataFrame:
    """wallet, run, n, duration of runs of transactions at most longest_gap seconds apart."""
    marked = gaps(tx).withColumn("run", F.sum(F.when(F.col("since") <= longest_gap, 0).otherwise(1)).over(along()))
    return marked.groupBy("wallet", "run").agg(F.count("*").alias("n"), (F.max("ts") - F.min("ts")).alias("duration"), F.min("ts").alias("started"))


def sessions(tx: DataFrame) -> DataFrame:
    return runs(tx, SESSION_GAP)


def bursts(tx: DataFrame) -> DataFrame:
    return runs(tx, BURST_GAP).filter(F.col("n") >= BURST_SIZE)


def temporal_features(tx: DataFrame) -> DataFrame:
    hour, day = F.expr("pmod(ts div 3600, 24)"), F.expr("pmod(ts div 86400 + 4, 7)")
    hours, days = [F.count_if(hour == h) for h in range(24)], [F.count_if(day == d) for d in range(7)]
    g = F.col("gap")
    base = gaps(tx).groupBy("wallet").agg(
        F.count("*").alias("n"), F.count(g).alias("g"), F.avg(g).alias("mean"), F.percentile(g, F.array(*[F.lit(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9)])).alias("q"),
        F.stddev_pop(g).alias("std"), S.cv(g).alias("cv"), S.skewness(g).alias("skew"), S.kurtosis(g).alias("kurt"), F.array(*[F.count_if(F.when(g.isNotNull(), S.duration_bin(g)) == k) for k in range(7)]).alias("bins"),
        F.array(*hours).alias("hours"), F.array(*days).alias("days"),
    )
    s = sessions(tx).groupBy("wallet").agg(F.count("*").alias("sn"), F.avg("duration").alias("sd"), F.median("duration").alias("sm"), F.avg("n").alias("st"), F.max("n").alias("sx"))
    b = bursts(tx).groupBy("wallet").agg(F.count("*").alias("bn"), F.avg("n").alias("bs"), F.max("n").alias("bx"), F.avg("duration").alias("bd"), F.sum("n").alias("bt"))
    rows = base.join(s, "wallet", "left").join(b, "wallet", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    values = {
        "transaction_count": F.col("n"), "positive_gap_count": F.col("g"), "interarrival_mean": F.col("mean"), "interarrival_median": F.col("q")[2],
        "interarrival_std": F.col("std"), "interarrival_cv": F.col("cv"), "interarrival_p10": F.col("q")[0], "interarrival_p25": F.col("q")[1],
        "interarrival_p75": F.col("q")[3], "interarrival_p90": F.col("q")[4], "interarrival_skewness": F.col("skew"), "interarrival_kurtosis": F.col("kurt"),
        "gap_entropy": S.entropy_of_array(F.col("bins"), 7), "activity_session_count": F.col("sn"), "mean_session_duration": F.col("sd"), "median_session_duration": F.col("sm"),
        "mean_transactions_per_session": F.col("st"), "max_transactions_per_session": F.col("sx"), "burst_count": zero("bn"),
        "mean_burst_size": zero("bs").cast("double"), "max_burst_size": zero("bx"), "mean_burst_duration": zero("bd").cast("double"),
        "transactions_in_bursts_ratio": zero("bt") / F.col("n"), "hour_of_day_entropy": S.entropy_of_array(F.col("hours"), 24), "weekday_entropy": S.entropy_of_array(F.col("days"), 7),
        "active_hour_concentration": F.array_max("hours") / F.col("n"), "active_day_concentration": F.array_max("days") / F.col("n"),
    }
    return gated(rows, values, support_state("temporal", F.col("n"), enough=F.col("g") >= 4))


def _lagged(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def found(wallet: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.r_[True, wallet[1:] != wallet[:-1]])
        n = np.diff(np.r_[first, len(x)])
        last = np.maximum(1, np.minimum(most, n // 2))
        own = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(x)) - first[own]
        made = []
        for lag in range(1, int(last.max(initial=0)) + 1):
            i = np.flatnonzero((last[own] >= lag) & (at + lag < n[own]))
            if not len(i):
                continue
            head = np.flatnonzero(np.r_[True, own[i][1:] != own[i][:-1]])
            count = np.diff(np.r_[head, len(i)])
            group = np.repeat(np.arange(len(head)), count)
            centred, flat = [], count < 2
            for v in (x[i], x[i + lag]):
                flat |= np.maximum.reduceat(v, head) == np.minimum.reduceat(v, head)
                centred.append(v - (np.add.reduceat(v, head) / count)[group])
            xx, yy, xy = (np.add.reduceat(a * b, head) for a, b in ((centred[0], centred[0]), (centred[1], centred[1]), centred))
            with np.errstate(divide="ignore", invalid="ignore"):
                made.append((wallet[first[own[i][head]]], np.full(len(head), lag), xy / (np.sqrt(xx) * np.sqrt(yy)), flat))
        if not made:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.float64())], ["wallet", "lag", "r"])
        w, lags, r, flat = (np.concatenate(c) for c in zip(*made, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(w, pa.int64()), pa.array(lags, pa.int32()), pa.array(r, pa.float64(), mask=flat)], ["wallet", "lag", "r"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # gaps of the wallet that may go on in the next batch
        for batch in batches:
            wallet, x = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("wallet", "x"))
            if not len(wallet):
                continue
            cut = int(np.flatnonzero(np.r_[True, wallet[1:] != wallet[:-1]])[-1])
            if cut or (held and held[-1][0][-1] != wallet[0]):
                done = [*held, (wallet[:cut], x[:cut])]
                yield found(*(np.concatenate(c) for c in zip(*done, strict=True)))
                held = []
            held.append((wallet[cut:], x[cut:]))
        if held:
            yield found(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return fold


def autocorrelation(tx: DataFrame, most: int = 50) -> DataFrame:
    """wallet, lag, r: correlation of the gap sequence with itself moved by each lag up to min(most, n / 2).

    Rows move once, by wallet, and stream through one fold in the order of time that holds the gaps of a batch and of the
    wallet at hand; no pair of gaps is a row.
    """
    seen = gaps(tx).filter(F.col("gap").isNotNull() & F.col("wallet").isNotNull())
    ordered = seen.select("wallet", F.col("gap").cast("double").alias("x"), "ts", F.coalesce("idx", F.lit(0)).alias("idx"), "tx").repartition("wallet").sortWithinPartitions("wallet", "ts", "idx", "tx")
    return ordered.select("wallet", "x").mapInArrow(_lagged(most), "wallet long, lag int, r double")


def weekly_gaps(tx: DataFrame, start: int) -> DataFrame:
    """wallet, week (0 to 3), gaps, median of gaps between transactions of one week; days 29 and 30 are left out."""
    week = tx.withColumn("week", F.expr(f"(ts - {start}) div 604800")).filter((F.col("ts") >= start) & (F.col("week") < 4))
    inside = Window.partitionBy("wallet", "week").orderBy("ts", F.coalesce("idx", F.lit(0)), "tx")
    g = week.withColumn("gap", F.col("ts") - F.lag("ts").over(inside)).filter("gap > 0")
    return g.groupBy("wallet", "week").agg(F.count("*").alias("gaps"), F.median("gap").alias("median"))


def gap_clusters(tx: DataFrame) -> DataFrame:
    """wallet, clusters: tolerant clusters of the positive gaps in ascending order."""
    listed = gaps(tx).groupBy("wallet").agg(F.sort_array(F.collect_list(F.col("gap").cast("double"))).alias("g"))
    return listed.select("wallet", S.tolerant_clusters(F.col("g"), TOLERANCE).alias("clusters"))


def periodicity_features(tx: DataFrame, start: int) -> DataFrame:
    g = gaps(tx)
    mid = g.groupBy("wallet").agg(F.count("*").alias("n"), F.count("gap").alias("g"), F.median("gap").alias("period"), F.min("ts").alias("t0"))
    turn = 2 * math.pi * F.pmod((F.col("ts") - F.col("t0")).cast("double"), F.col("period")) / F.col("period")
    spread = g.join(mid.select("wallet", "period", "t0"), "wallet").groupBy("wallet").agg(
        F.median(F.abs(F.col("gap") - F.col("period"))).alias("mad"), (F.sqrt(F.pow(F.sum(F.cos(turn)), F.lit(2.0)) + F.pow(F.sum(F.sin(turn)), F.lit(2.0))) / F.count("*")).alias("phase")
    )
    best = autocorrelation(tx).filter("r is not null").groupBy("wallet").agg(F.max_by(F.struct("r", "lag"), F.struct(F.round("r", 9), -F.col("lag"))).alias("peak"))
    c = gap_clusters(tx).select("wallet", "clusters", F.get(F.array_sort(F.transform("clusters", lambda x: F.struct((-F.size(x)).alias("s"), S.array_median(x).alias("m")))), 0).alias("top"))
    weeks = weekly_gaps(tx, start).filter("gaps >= 3").join(mid.select("wallet", "period"), "wallet")
    present = F.abs(F.col("median") - F.col("period")) <= F.greatest(F.lit(1.0), 0.1 * F.col("period"))
    w = weeks.groupBy("wallet").agg(F.count("*").alias("eligible"), F.count_if(present).alias("present"), S.cv(F.when(present, F.col("median"))).alias("week_cv"))
    rows = mid.join(spread, "wallet", "left").join(best, "wallet", "left").join(c, "wallet", "left").join(w, "wallet", "left")
    share = -F.col("top.s") / F.col("g")
    stable = F.when(F.col("eligible") >= 2, F.col("present") / F.col("eligible") / (1 + F.coalesce("week_cv", F.lit(0.0))))
    values = {
        "dominant_period_seconds": F.col("period"), "periodicity_strength": F.exp(-F.col("mad") / F.nullif(F.col("period"), F.lit(0.0))), "phase_stability": F.col("phase"),
        "autocorrelation_peak_strength": F.col("peak.r"), "autocorrelation_peak_lag": F.col("peak.lag"), "interval_cluster_concentration": share,
        "dominant_interval_cluster": F.col("top.m"), "dominant_interval_cluster_ratio": share,
        "multi_period_candidate_count": F.size(F.filter("clusters", lambda x: F.size(x) >= 2)), "eligible_subwindow_count": F.coalesce("eligible", F.lit(0)),
        "period_presence_count": F.coalesce("present", F.lit(0)), "period_stability_score": stable,
        "spectral_power": F.lit(None).cast("double"), "spectral_peak_ratio": F.lit(None).cast("double"),
    }
    return gated(rows, values, support_state("periodicity", F.col("n"), enough=F.col("g") >= 7))
