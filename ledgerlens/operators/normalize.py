"""Raw transaction payloads to typed rows: parsing with alias chains, conservation and input resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.codec import epoch_seconds, to_int

_SCRIPT = "struct<code_hash:string,hash_type:string,args:string>"
_CELL = (
    f"struct<capacity:string,lock:{_SCRIPT},lock_script:{_SCRIPT},resolved_lock:{_SCRIPT},type:{_SCRIPT},type_script:{_SCRIPT},output_data:string,data:string,"
    "previous_output:struct<tx_hash:string,index:string>,out_point:struct<tx_hash:string,index:string>,from_cellbase:boolean,generated_tx_hash:string,cell_index:string,"
    "output_index:string,address_hash:string,lock_hash:string,occupied_capacity:string>"
)
_BODY = f"struct<transaction_hash:string,tx_hash:string,block_number:string,block_timestamp:string,transaction_index:string,transaction_fee:string,display_inputs:array<{_CELL}>,display_outputs:array<{_CELL}>>"
PAYLOAD = f"struct<data:struct<id:string,attributes:{_BODY}>,{_BODY[7:-1]}>"


def parse_payloads(raw: DataFrame, column: str = "payload") -> DataFrame:
    """One row for each payload: wrapped (data.attributes) and root-level ones give the same row; a payload without a
    transaction hash is malformed and keeps a NULL tx_hash."""
    p = raw.withColumn("_p", F.from_json(column, PAYLOAD))
    pick = lambda *paths: F.coalesce(*[F.col(f"_p.{x}") for x in paths])
    both = lambda name: pick(f"data.attributes.{name}", name)
    return p.select(
        *raw.columns, pick("data.attributes.transaction_hash", "transaction_hash", "tx_hash", "data.id").alias("tx_hash"), to_int(both("block_number")).alias("block_number"),
        epoch_seconds(to_int(both("block_timestamp"))).alias("block_timestamp"), to_int(both("transaction_index")).alias("transaction_index"), to_int(both("transaction_fee")).alias("reported_fee"),
        both("display_inputs").alias("inputs"), both("display_outputs").alias("outputs"),
    )


def _script(c: Column, *names: str) -> Column:
    return F.coalesce(*[F.when(c[n]["code_hash"].isNotNull(), F.struct(c[n]["code_hash"].alias("code_hash"), c[n]["hash_type"].alias("hash_type"), F.coalesce(c[n]["args"], F.lit("0x")).alias("args"))) for n in names])


def cell_rows(parsed: DataFrame) -> DataFrame:
    """Flat cells of parsed payloads: side, pos, capacity, scripts, previous outpoint and resolution status."""

    def side(name: str, column: str) -> DataFrame:
        rows = parsed.filter("tx_hash is not null").select("tx_hash", F.posexplode(column).alias("at", "c"))
        c = F.col("c")
        prev_hash = F.coalesce(c["previous_output"]["tx_hash"], c["out_point"]["tx_hash"], c["generated_tx_hash"])
        prev_index = to_int(F.coalesce(c["previous_output"]["index"], c["out_point"]["index"], c["cell_index"]))
        capacity, lock = to_int(c["capacity"]), _script(c, "lock", "lock_script", "resolved_lock")
        known = capacity.isNotNull() & (lock.isNotNull() | c["lock_hash"].isNotNull() | c["address_hash"].isNotNull())
        base = F.coalesce(c["from_cellbase"], F.lit(False))
        status = F.when(base, "not_applicable").when(known, "complete").otherwise("incomplete") if name == "in" else F.lit(None).cast("string")
        return rows.select(
            "tx_hash", F.lit(name).alias("side"), (F.coalesce(to_int(F.coalesce(c["output_index"], c["cell_index"])), F.col("at").cast("bigint")) if name == "out" else F.col("at").cast("bigint")).alias("pos"),
            capacity.alias("capacity"), lock.alias("lock"), _script(c, "type", "type_script").alias("type"), F.coalesce(c["output_data"], c["data"]).alias("data"),
            F.coalesce(c["lock_hash"], c["address_hash"]).alias("lock_id"), (prev_hash if name == "in" else F.lit(None).cast("string")).alias("prev_hash"),
            (prev_index if name == "in" else F.lit(None).cast("bigint")).alias("prev_index"), status.alias("resolution_status"),
            (F.when(base, "cellbase").when(known, "payload") if name == "in" else F.lit(None).cast("string")).alias("resolution_source"),
        )

    return side("in", "inputs").unionByName(side("out", "outputs"))


def conservation(tx: DataFrame, cells: DataFrame) -> DataFrame:
    """tx, input_total, output_total, fee and status: not_applicable, incomplete, failed (fee below 0 or not the one
    reported) or complete.  tx has tx and reported_fee; cells tx, side, capacity, resolution_status."""
    i, o = F.col("side") == "in", F.col("side") == "out"
    known = F.col("capacity").isNotNull()
    per = cells.groupBy("tx").agg(
        F.count_if(i).alias("ni"), F.count_if(o).alias("no"), F.count_if(i & (F.col("resolution_status") == "not_applicable")).alias("base"),
        F.bool_and(F.when(i, known & (F.col("resolution_status") == "complete"))).alias("in_known"), F.bool_and(F.when(o, known)).alias("out_known"),
        F.sum(F.when(i, F.col("capacity").cast("decimal(38,0)"))).alias("si"), F.sum(F.when(o, F.col("capacity").cast("decimal(38,0)"))).alias("so"),
    )
    rows = tx.select("tx", "reported_fee").join(per, "tx", "left")
    ok_in, ok_out = (F.col("ni") > 0) & F.coalesce("in_known", F.lit(False)), F.coalesce("out_known", F.lit(True)) & F.col("no").isNotNull()
    total_in, total_out = F.when(ok_in, F.col("si")), F.when(ok_out, F.coalesce("so", F.lit(0).cast("decimal(38,0)")))
    fee = total_in - total_out
    status = (
        F.when(F.coalesce("base", F.lit(0)) > 0, "not_applicable").when(~F.coalesce(ok_in & ok_out, F.lit(False)), "incomplete")
        .when((fee < 0) | F.coalesce(fee != F.col("reported_fee"), F.lit(False)), "failed").otherwise("complete")
    )
    return rows.select("tx", total_in.cast("bigint").alias("input_total"), total_out.cast("bigint").alias("output_total"), fee.cast("bigint").alias("fee"), status.alias("status"))


def resolve_inputs(inputs: DataFrame, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Unresolved inputs (prev_tx, prev_pos) against sources (tx, pos, capacity, lock) in order of preference.

    Each source is one left join; the first that knows the outpoint wins, and its name is kept.
    """
    rows = inputs
    for k, (_, cells) in enumerate(sources):
        c = cells.select(F.col("tx").alias("prev_tx"), F.col("pos").alias("prev_pos"), F.struct(F.col("capacity"), F.col("lock")).alias(f"_c{k}")).dropDuplicates(["prev_tx", "prev_pos"])
        rows = rows.join(c, ["prev_tx", "prev_pos"], "left")
    found = F.coalesce(*[F.col(f"_c{k}") for k in range(len(sources))])
    source = reduce(lambda a, k: F.when(F.col(f"_c{k}").isNotNull(), sources[k][0]).otherwise(a), range(len(sources) - 1, -1, -1), F.lit(None).cast("string"))
    return rows.select(
        *inputs.columns, found["capacity"].alias("resolved_capacity"), found["lock"].alias("resolved_lock"), source.alias("resolution_source"),
        F.when(found.isNotNull(), "complete").otherwise("missing").alias("resolution_status"),
    )


def target_matches(lock_id: Column, address: Column, targets: Column) -> Column:
    return F.coalesce(F.array_contains(targets, lock_id), F.lit(False)) | F.coalesce(F.array_contains(targets, address), F.lit(False))


def observation_id(lock: Column, start: Column, end: Column, contract: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit("mainnet"), lock, start.cast("string"), end.cast("string"), F.lit(contract)), 256)


def check_window(start: int, end: int) -> None:
    """Observation windows are thirty days, neither more nor less."""
    if end - start != 30 * 86400:
        raise ValueError("an observation window has exactly 30 days")


def in_window(ts: Column, start: int, end: int) -> Column:
    return (ts >= start) & (ts < end)


def listed(rows: DataFrame, end: int, ts: str = "ts") -> DataFrame:
    """Listing items before the end of a window; those without a time are kept."""
    return rows.filter(F.col(ts).isNull() | (F.col(ts) < end))


def seen_payloads(seen: DataFrame, raw: DataFrame, start: int, end: int) -> DataFrame:
    """Raw payloads of the transactions that each address was seen in within [start, end)."""
    return seen.filter(in_window(F.col("ts"), start, end)).join(raw, "tx")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))).filter("_k = 1").drop("_k")


def boundaries(blocks: DataFrame, windows: DataFrame) -> DataFrame:
    """window, start_block, end_block: first block at or after the start, last at or before the end, in one pass.

    windows has window, start and end and is small by contract: one row for each observation window.
    """
    marks = windows.select("window", F.col("start").alias("s"), F.col("end").alias("e"))
    per = blocks.join(F.broadcast(marks), (F.col("timestamp") >= F.col("s")) & (F.col("timestamp") <= F.col("e")))
    return per.groupBy("window").agg(F.min("number").alias("start_block"), F.max("number").alias("end_block"))


def rolling_median_low(blocks: DataFrame, width: int = 37) -> DataFrame:
    """Lower median of the timestamps of the preceding blocks; the first block uses itself.  Blocks are dealt to
    groups of 10,000 numbers, each with the rows before it, so that no task holds the chain."""
    size = 10_000
    g = F.floor(F.col("number") / size)
    own = blocks.select("number", "timestamp", g.alias("g"), F.lit(True).alias("own"))
    halo = blocks.filter(F.pmod("number", F.lit(size)) >= size - width).select("number", "timestamp", (g + 1).alias("g"), F.lit(False).alias("own"))
    before = F.collect_list("timestamp").over(Window.partitionBy("g").orderBy("number").rowsBetween(-width, -1))
    s = F.sort_array(F.when(F.size(before) > 0, before).otherwise(F.array("timestamp")))
    return own.unionByName(halo).withColumn("m", F.element_at(s, F.ceil(F.size(s) / 2).cast("int"))).filter("own").select("number", "timestamp", F.col("m").alias("median_timestamp"))
