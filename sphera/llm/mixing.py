"""Mixing sources to target weights: Pfair scheduling of source blocks, all of it DataFrame operations.

Rows of a source are dealt into blocks of `block_docs`. Target weights are integer shares of
`RESOLUTION` slots. Block i (from 1) of a source with share w among W gets the release time
floor((i-1)W/w) and the deadline ceil(iW/w); each slot goes to the released block with the earliest
deadline, so that after every slot each source is within one block of its target. The pattern repeats
every W slots, so only one cycle of it is ever worked out. When a source runs dry, a new phase starts
with the shares of the others: no row is dropped or repeated, and there are at most two phases a source.

The driver sees one row for each source (its number of rows), nothing that grows with the rows.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sphera.llm.kernels import table

RESOLUTION = 1000
BLOCK_DOCS = 8
MIX = ["__mix_block", "__mix_slot", "__mix_offset", "__mix_release", "__mix_deadline"]


def shares(sizes: dict[str, int], weights: dict[str, float] | None = None, resolution: int = RESOLUTION) -> dict[str, int]:
    """Integer shares, at least 1 each. Without weights: in proportion to the square root of a source's rows."""
    raw = {s: (weights or {}).get(s, 0.0) if weights else math.sqrt(n) for s, n in sizes.items()}
    total = sum(raw.values()) or 1.0
    return {s: max(1, round(resolution * w / total)) for s, w in raw.items()}


def phases(blocks: dict[str, int], share: dict[str, int]) -> list[dict]:
    """Cycles of slots: which sources take part with which shares, how often, from which slot and block on."""
    left, done, slot, out = {s: n for s, n in sorted(blocks.items()) if n}, dict.fromkeys(blocks, 0), 0, []
    while left:
        cycles = max(1, min(n // share[s] for s, n in left.items()))
        part = {s: min(share[s], n) for s, n in left.items()}
        width = sum(part.values())
        out.append({"phase": len(out), "cycles": cycles, "start": slot, "names": list(part), "share": list(part.values()), "first": [done[s] for s in part], "width": width})
        for s, w in part.items():
            done[s] += w * cycles
            left[s] -= w * cycles
        slot += width * cycles
        left = {s: n for s, n in left.items() if n}
    return out


def _earliest_deadline(width: Column, share: Column) -> Column:
    """The source's index for each slot of one cycle, by a fold over the slots."""
    never = F.lit(2**40)

    def pick(done: Column, t: Column) -> Column:
        return F.array_min(
            F.transform(
                done,
                lambda d, i: F.struct(
                    F.when((d < share[i]) & (F.floor(d * width / share[i]) <= t), F.ceil((d + 1) * width / share[i])).otherwise(never).alias("deadline"),
                    i.alias("source"),
                ),
            )
        )["source"]

    def step(acc: Column, t: Column) -> Column:
        return F.transform(
            F.array(pick(acc["done"], t)),
            lambda p: F.struct(F.transform(acc["done"], lambda d, i: F.when(i == p, d + 1).otherwise(d)).alias("done"), F.concat(acc["order"], F.array(p)).alias("order")),
        )[0]

    start = F.struct(F.transform(share, lambda _: F.lit(0).cast("bigint")).alias("done"), F.array().cast("array<int>").alias("order"))
    return F.aggregate(F.sequence(F.lit(0).cast("bigint"), width - 1), start, step, lambda acc: acc["order"])


def pattern(spark, plan: list[dict]) -> DataFrame:
    """One row a source: __mix_source, __mix_phases array<struct<first, last, share, width, start, slots>> with the source's slots in one cycle."""
    kind = "array<struct<phase:int,cycles:bigint,start:bigint,names:array<string>,share:array<bigint>,first:array<bigint>,width:bigint>>"
    rows = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(plan)), kind)))
    rows = rows.withColumn("order", _earliest_deadline(F.col("width"), F.col("share")))
    each = rows.select("*", F.posexplode("names").alias("i", "__mix_source"))
    slots = F.filter(F.transform("order", lambda s, at: F.when(s == F.col("i"), at)), lambda x: x.isNotNull())
    return each.groupBy("__mix_source").agg(
        F.collect_list(
            F.struct(
                F.col("first")[F.col("i")].alias("first"),
                (F.col("first")[F.col("i")] + F.col("cycles") * F.col("share")[F.col("i")]).alias("last"),
                F.col("share")[F.col("i")].alias("share"),
                "width",
                "start",
                slots.alias("slots"),
            )
        ).alias("__mix_phases")
    )


def source_key(source: str) -> Column:
    """Null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source", block_docs: int = BLOCK_DOCS, order: str = "doc_id") -> DataFrame:
    """docs with the columns of MIX: block of its source, slot, place in the block, release and deadline of the block.

    Within a source rows go by a hash of all their columns, then by a hash of `order`; rows that are equal in every
    column may swap. weights: by source value (None for null); those not named get the least share. Empty
    docs give no rows. A source's rows are ranked in many salted parts, so that a hot one is not one task.
    """
    spark = docs.sparkSession
    salts = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    hashed = F.xxhash64(order)
    # of all columns, so that an id that stands on many rows is not one task
    salt = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.withColumns({"__mix_key": source_key(source), "__mix_salt": F.pmod(salt, F.lit(salts))})
    parts = rows.groupBy("__mix_key", "__mix_salt").agg(F.count("*").alias("__mix_n"))
    counts = {r[0]: r[1] for r in parts.groupBy("__mix_key").agg(F.sum("__mix_n")).collect()}  # a row for each source
    keyed = None if weights is None else {("null" if k is None else f"={k}"): w for k, w in weights.items()}
    plan = phases({s: -(-n // block_docs) for s, n in counts.items()}, shares(counts, keyed))
    before = F.sum("__mix_n").over(Window.partitionBy("__mix_key").orderBy("__mix_salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("__mix_key", "__mix_salt", F.coalesce(before, F.lit(0)).alias("__mix_before"))
    own = Window.partitionBy("__mix_key", "__mix_salt").orderBy(hashed, order, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    ranked = rows.withColumn("__mix_rank", F.row_number().over(own) - 1).join(starts, ["__mix_key", "__mix_salt"])
    ranked = ranked.withColumn("__mix_rank", F.col("__mix_rank") + F.col("__mix_before"))
    # a row for each source with at most 2 * sources phases of RESOLUTION slots together
    ranked = ranked.join(F.broadcast(pattern(spark, plan)), F.col("__mix_key") == F.col("__mix_source"))
    block = F.floor(F.col("__mix_rank") / block_docs)
    now = F.filter("__mix_phases", lambda p: (p["first"] <= F.col("__mix_block")) & (F.col("__mix_block") < p["last"]))[0]
    ranked = ranked.withColumn("__mix_block", block).withColumn("__mix_now", now)
    inside = F.col("__mix_block") - F.col("__mix_now.first")
    share, width = F.col("__mix_now.share"), F.col("__mix_now.width")
    cycle, place = F.floor(inside / share), F.pmod(inside, share)
    return ranked.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        "__mix_block",
        (F.col("__mix_now.start") + cycle * width + F.get("__mix_now.slots", place.cast("int"))).alias("__mix_slot"),
        F.pmod("__mix_rank", F.lit(block_docs)).alias("__mix_offset"),
        (F.col("__mix_now.start") + F.floor(inside * width / share)).alias("__mix_release"),
        (F.col("__mix_now.start") + F.ceil((inside + 1) * width / share)).alias("__mix_deadline"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op3: every document with its source's block, the slot of that block, its place in it, release and deadline."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs).select("doc_id", "source", *[F.col(c).alias(c.removeprefix("__mix_")) for c in MIX])


def ordered(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the same documents, laid out in mixed order (files and the rows in them follow the slots)."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mixed = mix(docs)
    return mixed.repartitionByRange(parts, "__mix_slot", "__mix_offset").sortWithinPartitions("__mix_slot", "__mix_offset").drop(*MIX)
