"""Sharding by fixed virtual slots.

Records hash into a fixed number of slots. Bytes are added up per slot, and a
map, a table with a version, says which shard a slot is in. To rebalance or to
grow, the map is edited and records of the moved slots follow; no record changes
its slot. Sizes are to be equal, which asks for no tie between id and slot. Only
DataFrame functions are used.

The map has one row per slot, so its size is bounded by the number of slots,
whatever the data. Records are numbered within pieces of slots (a slot's rows by
the input partition they came from), so a key with a third of all rows does not
meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.llm.common import column, write_once

SLOTS = 4096
PIECES = 64


def sized(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS):
    """Per record: id, size, text_crc32, virtual slot, piece. Written once.

    Size is the UTF-8 bytes of the text plus one; a null text has none. A record's
    slot follows from its id, its text and its place in the table, so rows with one
    id, or repeated ones, spread over all slots. The slot is kept with the record.
    Null ids and repeated rows count like any. No text is kept.
    """
    text = column(documents, text_col).cast("string")
    key = column(documents, id_col)
    data = F.coalesce(text, F.lit("")).cast("binary")
    by = F.xxhash64(key, text, F.monotonically_increasing_id())
    rows = documents.select(
        key.alias("id"),
        (F.octet_length(data).cast("bigint") + 1).alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.pmod(by, F.lit(slots)).cast("int").alias("vslot"),
        F.pmod(F.spark_partition_id(), F.lit(PIECES)).alias("piece"),
    )
    return write_once(rows, "shard-records")


def slot_bytes(records: DataFrame) -> DataFrame:
    """Bytes per slot; at most one row per slot."""
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"))


def _dealt(items: Column, loads: Column) -> Column:
    """Deal items (bytes, vslot), largest first, each to the shard with the least so far."""

    def step(state: Column, item: Column) -> Column:
        least = F.array_position(state["loads"], F.array_min(state["loads"]))
        return F.struct(
            F.transform(
                state["loads"],
                lambda load, i: load + F.when(i + 1 == least, item["bytes"]).otherwise(0),
            ).alias("loads"),
            F.concat(state["dealt"], F.array((least - 1).cast("int"))).alias("dealt"),
        )

    start = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("dealt"))
    return F.aggregate(items, start, step, lambda state: state["dealt"])


def _deal(slots: DataFrame, loads: Column, state: DataFrame | None = None) -> DataFrame:
    """vslot, bytes, shard for the given slots; `loads`, an array, is held already.

    `state` is one row that `loads` may refer to. All slots meet in one row: there
    are at most as many as slots in the map.
    """
    items = F.reverse(F.array_sort(F.collect_list(F.struct("bytes", "vslot"))))
    one = slots.agg(items.alias("items")).withColumn("one", F.lit(1))
    if state is not None:
        one = one.join(state.withColumn("one", F.lit(1)), "one")
    one = one.select("items", _dealt(F.col("items"), loads).alias("dealt"))
    pair = F.explode(F.arrays_zip("items", "dealt")).alias("pair")
    return one.select(pair).select(
        F.col("pair.items.vslot").alias("vslot"),
        F.col("pair.items.bytes").alias("bytes"),
        F.col("pair.dealt").alias("shard"),
    )


def first_map(records: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map: version, vslot, bytes, shard; bytes near equal per shard. Stored."""
    if shards < 1:
        raise ValueError("shards must be positive")
    dealt = _deal(slot_bytes(records), F.array_repeat(F.lit(0).cast("bigint"), shards))
    return write_once(dealt.select(F.lit(1).alias("version"), "vslot", "bytes", "shard"), "slot-map")


def edited_map(old: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version: the same map with few slots moved, for new sizes or more shards.

    A shard keeps its slots, largest first, up to an equal share. The rest, and
    slots that are new, go to the shards that hold least; if shards are added,
    only to those. With sizes unchanged and one more shard, about 1/shards of the
    bytes move, all into it.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    facts = old.agg(
        F.coalesce(F.max("version"), F.lit(0)).alias("version"),
        F.coalesce(F.max("shard") + 1, F.lit(0)).alias("known"),
        F.lit(1).alias("one"),
    )
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total"), F.lit(1).alias("one"))
    facts = facts.join(total, "one")
    order = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot")
    now = sizes.join(old.select("vslot", "shard"), "vslot", "left")
    now = now.withColumn("upto", F.sum("bytes").over(order)).withColumn("one", F.lit(1))
    stays = F.col("shard").isNotNull() & (F.col("shard") < shards)
    stays = F.coalesce(stays & (F.col("upto") * shards <= F.col("total")), F.lit(False))
    marked = now.join(facts, "one").select(
        "vslot", "bytes", "shard", "version", "known", "total", stays.alias("stays")
    )
    marked = write_once(marked, "slot-marks")
    held = F.map_from_entries(F.collect_list(F.struct("shard", "held")))
    kept = marked.filter("stays").groupBy("shard").agg(F.sum("bytes").alias("held"))
    known = marked.agg(F.max("known").alias("known"), F.max("total").alias("total"))
    state = kept.agg(held.alias("held")).withColumn("one", F.lit(1))
    state = state.join(known.withColumn("one", F.lit(1)), "one").drop("one")
    closed = lambda i: (i < F.col("known")) & (F.col("known") < shards)
    loads = F.transform(
        F.array(*[F.lit(i) for i in range(shards)]),
        lambda i: F.coalesce(F.col("held")[i], F.lit(0).cast("bigint"))
        + F.when(closed(i), F.col("total")).otherwise(0),
    )
    moved = _deal(marked.filter("not stays").select("vslot", "bytes"), loads, state)
    version = marked.agg(F.max("version").alias("version")).withColumn("one", F.lit(1))
    edited = marked.filter("stays").select("vslot", "bytes", "shard").unionByName(moved)
    edited = edited.withColumn("one", F.lit(1)).join(version, "one")
    edited = edited.select((F.col("version") + 1).alias("version"), "vslot", "bytes", "shard")
    return write_once(edited, "slot-map")


def placed(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Records with their shard and a place in it, gapless from 0."""
    place = slot_map.select("vslot", "shard")
    counts = records.groupBy("vslot", "piece").agg(F.count(F.lit(1)).alias("n")).join(place, "vslot")
    before = Window.partitionBy("shard").orderBy("vslot", "piece")
    before = before.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = counts.select(
        "vslot", "piece", "shard", (F.sum("n").over(before) - F.col("n")).alias("start")
    )
    order = Window.partitionBy("vslot", "piece").orderBy("id", "text_crc32", "size")
    numbered = records.withColumn("nth", F.row_number().over(order))
    return numbered.join(starts, ["vslot", "piece"]).select(
        "id", "size", "text_crc32", "shard", (F.col("start") + F.col("nth") - 1).alias("place"), "vslot"
    )


def sharded(
    documents: DataFrame,
    shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    slots: int = SLOTS,
) -> DataFrame:
    """id, size, text_crc32, shard, place, vslot for every row, bytes near equal per shard.

    Sizes are equal to within about one slot, so long as no slot outweighs a
    shard's share. Nulls, empty texts and repeated rows: see `sized`. An empty
    table gives no rows.
    """
    records = sized(documents, id_col, text_col, slots)
    return placed(records, first_map(records, shards))
