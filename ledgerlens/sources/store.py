"""Tables that several plans read, written once a session below the shared folder.

The cell graph and the feature matrix feed every family and every audit.  Writing them once cuts the lineage and spares
each reader the joins and windows behind them.  A stored table is known by its name and by the names, lengths and times
of the files that it was made from, so a changed input is never answered from an old table.

Tables of wallets are stored in buckets by wallet: aggregates, windows and joins by wallet read a bucket a task and move no
rows.  The number of buckets follows the input, so that a bucket keeps its size.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder that driver and executors share; a local master may go without."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or getattr(context, "_ledgerlens_dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="ledgerlens-")
        context._ledgerlens_dir = found
    return found.rstrip("/")


#: Bytes of input files a bucket.
BUCKET_BYTES = 4 << 20


def _files(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, int]]:
    made = []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = at.getFileSystem(spark._jsc.hadoopConfiguration())
        files = system.listFiles(at, True)
        while files.hasNext():
            f = files.next()
            made.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(made)


def listing(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the files below the paths: names, lengths and times."""
    return hashlib.sha256(repr(_files(spark, paths)).encode()).hexdigest()


def buckets(spark: SparkSession, paths: list[str]) -> int:
    """Buckets of a table made from these files: one for each BUCKET_BYTES, and at least one a core up to the shuffle partitions."""
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(1, least, -(-sum(size for _, size, _ in _files(spark, paths)) // BUCKET_BYTES))


@contextmanager
def in_place(spark: SparkSession) -> Iterator[None]:
    """Joins by more columns than those of the buckets stay in the buckets too; for what is run inside, not for later plans."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def once(spark: SparkSession, name: str, paths: list[str], build: Callable[[], DataFrame], by: str | None = None, order: tuple[str, ...] = (), dealt: bool = False) -> DataFrame:
    """The rows of build(), written at the first call of the session for these files and read back at each; with `by` they
    lie in buckets by that column, as many as buckets(paths), and sorted by it and by `order`; `dealt` rows come from such
    buckets and stay where they are."""
    context = spark.sparkContext
    known = getattr(context, "_ledgerlens_tables", None)
    if known is None:
        known = context._ledgerlens_tables = {}
    key = (name, listing(spark, paths))
    if key not in known:
        made, mark = build(), uuid.uuid4().hex[:12]
        path = f"{shared_dir(spark)}/{context.applicationId}/tables/{name}-{mark}"
        if by is None:
            made.write.parquet(path)
            known[key] = (path, made.schema)
        else:
            n, table = buckets(spark, paths), f"default.ledgerlens_{name}_{mark}"
            with in_place(spark):
                (made if dealt else made.repartition(n, by)).write.format("parquet").option("path", path).bucketBy(n, by).sortBy(by, *order).saveAsTable(table)
            known[key] = (table, None)
    found, schema = known[key]
    return spark.table(found) if schema is None else spark.read.schema(schema).parquet(found)
