"""Plans that put adapters and families together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import cells as C
from ledgerlens.operators import temporal as T
from ledgerlens.sources.adapters import build_cells, build_orders, cell_graph, graph_files, order_stream
from ledgerlens.sources.store import once

#: Start of the weekly windows over orders: 1995-01-01T00:00:00Z.
ORDER_START = 788918400
FAMILIES = ("temporal", "periodicity", "topology", "lifecycle", "templates", "scripts", "typed_assets", "capacity", "lineage")


def order_families(spark: SparkSession, sf_dir: str, wallets: list[int] | None = None) -> dict[str, DataFrame]:
    """All nine families of the order graph; a list of wallets is pushed down to the scans.

    Without a list each family is stored once a session in the buckets of the cells, so that a task holds the sorts of one
    family and families meet without a move.
    """
    tx = order_stream(spark, sf_dir) if wallets is None else build_orders(spark, sf_dir)
    cells = cell_graph(spark, sf_dir) if wallets is None else build_cells(spark, sf_dir)
    if wallets is not None:
        tx, cells = tx.filter(F.col("wallet").isin(wallets)), cells.filter(F.col("wallet").isin(wallets))
    tx = tx.select("wallet", "tx", "ts", "idx")

    def kept(name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return build() if wallets is not None else once(spark, f"family_{name}", graph_files(sf_dir), build, by="wallet", dealt=True)

    period = kept("periodicity", lambda: T.periodicity_features(tx, ORDER_START))
    plans = {
        "temporal": lambda: T.temporal_features(tx), "topology": lambda: C.topology_features(tx, cells), "lifecycle": lambda: C.lifecycle_features(cells),
        "templates": lambda: C.template_features(C.template_of_cells(tx, cells), period), "scripts": lambda: C.script_features(cells), "typed_assets": lambda: C.typed_asset_features(cells),
        "capacity": lambda: C.capacity_features(cells), "lineage": lambda: C.lineage_features(cells),
    }
    return {name: period if name == "periodicity" else kept(name, plans[name]) for name in FAMILIES}


def feature_matrix(spark: SparkSession, sf_dir: str, wallets: list[int] | None = None) -> DataFrame:
    """One wide row a wallet, with topology__n, its number of transactions.

    Families meet the wallets of the orders, which all cells have.  The families of all wallets are stored; those of a list
    of wallets are a plan whose filter reaches the scans.
    """
    tx = order_stream(spark, sf_dir) if wallets is None else build_orders(spark, sf_dir).filter(F.col("wallet").isin(wallets))
    wide = tx.groupBy("wallet").agg(F.count("*").alias("topology__n"))
    for name, df in order_families(spark, sf_dir, wallets).items():
        wide = wide.join(df.select("wallet", *[F.col(c).alias(f"{name}__{c}") for c in df.columns if c != "wallet"]), "wallet", "left")
    return wide.select("wallet", *[c for c in wide.columns if c not in ("wallet", "topology__n")], "topology__n")


def value_names(features: DataFrame) -> list[str]:
    """Numeric family__value columns of a matrix, in its order."""
    return [f.name for f in features.schema if "__" in f.name and f.dataType.typeName() not in ("string", "boolean", "void") and f.name != "topology__n"]


def feature_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """wallet and the numeric values as doubles of six places, which the audits read several times: stored once a session."""

    def build() -> DataFrame:
        m = feature_matrix(spark, sf_dir)
        return m.select("wallet", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in value_names(m)])

    return once(spark, "values", graph_files(sf_dir), build, by="wallet", dealt=True)
