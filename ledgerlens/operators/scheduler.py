"""Manifest and collection state as pure DataFrame functions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.codec import sampling_stratum

TERMINAL = ("COMPLETE", "INVALID_ADDRESS", "FAILED_RETRY_EXHAUSTED")
#: Rank of the requirement categories in the queue.
CATEGORY_RANK = {"ZERO_REMOTE": 0, "PARTIAL_REFILL": 1, "FULL_COLLECTION": 2}


def build_manifest(rows: DataFrame) -> DataFrame:
    """One record for each address of rows (address, source, label, tx_count, priority): sources, occurrences, label
    (UNKNOWN on conflict), lifetime count of the best priority, conflict flag and stratum."""
    agg = rows.groupBy("address").agg(
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count("*").alias("occurrences"), F.collect_set("label").alias("_l"),
        F.min_by("tx_count", F.when(F.col("tx_count").isNotNull(), F.struct("priority", "source", "tx_count"))).alias("lifetime_tx_count"), F.count_distinct("tx_count").alias("_n"),
    )
    return agg.select(
        "address", "sources", "occurrences", F.when(F.size("_l") == 1, F.col("_l")[0]).when(F.size("_l") > 1, "UNKNOWN").alias("label"), "lifetime_tx_count",
        F.when(F.col("_n") > 1, "CONFLICT").when(F.col("_n") == 1, "KNOWN").otherwise("MISSING").alias("lifetime_status"), sampling_stratum(F.col("lifetime_tx_count")).alias("stratum"),
    )


def population_hash(manifest: DataFrame) -> DataFrame:
    """A digest of the population that does not depend on row order: one hash a record, summed by 32-bit pieces."""
    h = F.sha2(F.to_json(F.struct(*sorted(manifest.columns))), 256)
    piece = [F.sum(F.conv(F.substring(F.col("h"), 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")) for k in range(8)]
    return manifest.select(h.alias("h")).agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *[p.cast("string") for p in piece]), 256).alias("population_hash"))


def requirement(cached: Column, wanted: Column) -> Column:
    return F.when(cached >= wanted, "ZERO_REMOTE").when(cached > 0, "PARTIAL_REFILL").otherwise("FULL_COLLECTION")


def merge_states(states: DataFrame, manifest: DataFrame) -> DataFrame:
    """States after a merge with the manifest: new addresses start, terminal states stick, the category is renewed."""
    m = manifest.select("address", F.col("category").alias("_category"))
    both = states.join(m, "address", "full")
    sticky = F.col("collection_state").isin(*TERMINAL)
    return both.select(
        "address", F.when(F.col("collection_state").isNull(), "NOT_STARTED").otherwise(F.col("collection_state")).alias("collection_state"),
        F.coalesce("attempts", F.lit(0)).alias("attempts"), F.when(sticky, F.col("category")).otherwise(F.coalesce("_category", "category")).alias("category"),
    )


def recover(states: DataFrame) -> DataFrame:
    """Interrupted wallets become PARTIAL."""
    return states.withColumn("collection_state", F.when(F.col("collection_state") == "IN_PROGRESS", "PARTIAL").otherwise(F.col("collection_state")))


def finalize(states: DataFrame, most: int = 3) -> DataFrame:
    """Unfinished wallets without attempts left are exhausted."""
    done = ~F.col("collection_state").isin(*TERMINAL) & (F.col("attempts") >= most)
    return states.withColumn("collection_state", F.when(done, "FAILED_RETRY_EXHAUSTED").otherwise(F.col("collection_state")))


def next_wallets(states: DataFrame, limit: int, most: int = 3) -> DataFrame:
    """The head of the queue: by category, attempts, address."""
    rank = F.lit(9)
    for name, k in CATEGORY_RANK.items():
        rank = F.when(F.col("category") == name, k).otherwise(rank)
    ready = states.filter((F.col("collection_state") == "NOT_STARTED") & (F.col("attempts") < most))
    return ready.withColumn("rank", rank).orderBy("rank", "attempts", "address").limit(limit)


def evidence_state(collection_state: Column, detail: Column, inputs: Column) -> Column:
    return (
        F.when(collection_state == "INVALID_ADDRESS", "UNRESOLVED").when((collection_state == "COMPLETE") & detail & inputs, "SUPPORTED")
        .when(collection_state.isin("COMPLETE", "PARTIAL", "FAILED_RETRY_EXHAUSTED"), "PARTIAL").otherwise("INSUFFICIENT_EVIDENCE")
    )


#: Error types of a service that may answer later, and of faults that need a change of code.
SERVICE_ERRORS = ("EXPLORER_TIMEOUT", "EXPLORER_RATE_LIMIT", "EXPLORER_HTTP_ERROR", "EXPLORER_NETWORK_ERROR", "RETRY_EXHAUSTED", "EXPLORER_UNAVAILABLE")
CODE_ERRORS = ("CACHE_CORRUPTION", "SCHEMA_INCOMPATIBILITY", "PARSER_NORMALIZATION_ERROR")
INVALID_ADDRESS = "%invalid frozen wallet address%"


def migrate_failures(states: DataFrame) -> DataFrame:
    """Wallets in the old state FAILED get the state that their last error tells, with its type and scope where unset."""
    invalid = F.lower(F.coalesce("last_error", F.lit(""))).like(INVALID_ADDRESS)
    old = F.col("collection_state") == "FAILED"
    return states.select(
        *[c for c in states.columns if c not in ("collection_state", "last_error_type", "failure_scope")],
        F.when(old & invalid, "FAILED_INVALID_ADDRESS").when(old, "FAILED_RETRY_EXHAUSTED").otherwise(F.col("collection_state")).alias("collection_state"),
        F.when(old, F.coalesce("last_error_type", F.when(invalid, "INVALID_ADDRESS").otherwise("RETRY_EXHAUSTED"))).otherwise(F.col("last_error_type")).alias("last_error_type"),
        F.when(old, F.coalesce("failure_scope", F.lit("WALLET"))).otherwise(F.col("failure_scope")).alias("failure_scope"),
    )


def retry_candidates(states: DataFrame) -> DataFrame:
    """Unfinished wallets with the category of their last error and a recommendation."""
    service, code = F.col("last_error_type").isin(*SERVICE_ERRORS), F.col("last_error_type").isin(*CODE_ERRORS)
    todo = states.filter(F.col("collection_state").isin("PARTIAL", "FAILED_RETRY_EXHAUSTED"))
    return todo.select(
        "address", "collection_state", F.when(service, "Explorer timeout/service").when(code, "schema/data issue").otherwise("other").alias("failure_category"),
        F.when(service, "RETRY_LATER").when(code, "NEEDS_CODE_FIX").otherwise("NEEDS_MANUAL_REVIEW").alias("recommendation"),
    )


def freeze(contract: dict, frozen: dict | None) -> dict:
    """The contract with the digest of its content; a frozen one of the same content is returned, any other is refused."""
    digest = hashlib.sha256(json.dumps(contract, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    if frozen is not None and frozen.get("digest") != digest:
        raise ValueError("the frozen contract has another content")
    return frozen if frozen is not None else contract | {"digest": digest}


def safety_stop(summary: dict, limits: dict) -> str | None:
    """The first safety condition that holds, by name, or None."""
    requests = max(1, summary.get("requests", 0))
    checks = [
        ("wallet limit", summary.get("wallets", 0) >= limits.get("wallets", float("inf"))),
        ("request limit", summary.get("requests", 0) >= limits.get("requests", float("inf"))),
        ("elapsed limit", summary.get("elapsed", 0) >= limits.get("elapsed", float("inf"))),
        ("consecutive failures", summary.get("consecutive_failures", 0) >= limits.get("consecutive_failures", float("inf"))),
        ("rate limits", summary.get("rate_limits", 0) >= limits.get("rate_limits", float("inf"))),
        ("global request failure rate", summary.get("failures", 0) / requests >= limits.get("failure_rate", 2) and summary.get("requests", 0) >= limits.get("failure_sample", 1)),
        ("unresolved inputs", summary.get("unresolved_ratio", 0) >= limits.get("unresolved_ratio", 2)),
        ("disk", summary.get("disk_free", float("inf")) <= limits.get("disk_free", -1)),
    ]
    return next((name for name, hit in checks if hit), None)
