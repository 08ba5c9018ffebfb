"""Document fingerprints by SimHash, all of it DataFrame operations.

Terms are five-word shingles (a shorter text with words: its whole sequence), weighted by how often
they occur. Every occurrence's 64-bit hash votes on the 64 bits; a bit is set if over half the weight
sets it. The votes of bits i and i+32 are summed in one long, so that 32 plain sums do, in code that
Spark compiles, with partial sums before the shuffle. Texts without words have fingerprint 0.

`near` finds all fingerprints within a Hamming radius: 64 bits are cut into `blocks` blocks; two
fingerprints within the radius agree on at least blocks - radius of them, so one table for each choice
of that many blocks, keyed by their bits, holds every pair. A pair is kept in the first such table only.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sphera.llm.kernels import cut_lineage, table

SHINGLE = 5
RADIUS = 3
BLOCKS = 6
_LANES = (1 << 32) | 1
_RANK_BITS = 40  # of a row id: the rank in its id range


def terms(rows: DataFrame, text: str, out: str) -> DataFrame:
    """rows with `out`: the hashes of the text's terms, one for each occurrence (null text: none). The text column goes."""
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " ", -1), "")
    rows = rows.withColumn("__words", words).drop(text)
    rows = rows.withColumn("__hashed", F.transform("__words", lambda w: F.xxhash64(w))).drop("__words")
    n = F.size("__hashed")
    runs = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get("__hashed", i + j) for j in range(SHINGLE)]))
    found = F.when(n >= SHINGLE, runs).when(n > 0, F.array(F.xxhash64("__hashed")))
    return rows.withColumn(out, found).drop("__hashed")


def vote(terms: DataFrame, keys: list[str], term: str) -> DataFrame:
    """keys, fingerprint bigint: one row for each key of an exploded term table; null terms don't vote, without any it is null.

    (Explode with explode_outer: of a plain explode the optimizer derives a filter that repeats the term
    expressions below the projections, once for each element.)
    """
    sums = [F.sum(F.shiftrightunsigned(term, i).bitwiseAND(F.lit(_LANES))).alias(f"__v{i}") for i in range(32)]
    votes = terms.groupBy(*keys).agg(*sums, F.count(term).alias("__n"))
    bits = [F.shiftleft((2 * F.col(f"__v{i}").bitwiseAND(F.lit((1 << 32) - 1)) > F.col("__n")).cast("bigint"), i) for i in range(32)]
    bits += [F.shiftleft((2 * F.shiftrightunsigned(f"__v{i}", 32) > F.col("__n")).cast("bigint"), i + 32) for i in range(32)]
    fingerprint = bits[0]
    for b in bits[1:]:
        fingerprint = fingerprint.bitwiseOR(b)
    return votes.select(*keys, fingerprint.alias("fingerprint"))


def hexed(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def near(fingerprints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """a, b bigint, distance: all pairs a < b of different values of the column `fingerprint` within the radius, each once. Nulls match nothing."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    one = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    masks = [sum(one[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    values = fingerprints.select("fingerprint").where("fingerprint is not null").distinct()
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("key"), F.lit(m).alias("mask")) for t, m in enumerate(masks)])
    keyed = values.select("fingerprint", F.inline(tables))
    a, b = keyed.select("t", "key", F.col("fingerprint").alias("a")), keyed.select("t", "key", F.col("fingerprint").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    earlier = F.lit(False)
    for t, m in enumerate(masks[:-1]):
        earlier = earlier | ((F.col("t") > t) & (differ.bitwiseAND(F.lit(m)) == 0))
    joined = a.join(b, ["t", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(differ) <= radius) & ~earlier)
    return joined.select("a", "b", F.bit_count(differ).alias("distance"))


def with_next(docs: DataFrame) -> DataFrame:
    """rid, doc_id, text, next_rid, next_text: each row with the next by descending id (after the last, the first).

    Nulls come last among ids and equal ids go by text; null texts count as empty. Rows are dealt into
    ranges of the id cut at its approximate percentiles; the first row of the range below is lent to
    each range, so no task sees more than its range.
    """
    parts = min(1000, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lowest = F.lit(-(1 << 63))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", lowest).alias("__key"))
    cuts = rows.agg(F.percentile_approx("__key", [i / parts for i in range(1, parts)], 20_000)).first()[0]  # parts - 1 numbers
    cuts = F.array(*[F.lit(c) for c in sorted(set(cuts or []))]).cast("array<bigint>")
    rows = rows.withColumn("__range", F.size(F.filter(cuts, lambda c: c < F.col("__key"))))
    tops = [tuple(r) for r in rows.groupBy("__range").agg(F.max("__key")).orderBy("__range").collect()]  # a row for each range
    lent = [(tops[i - 1][0], tops[i - 1][1], tops[i][0]) for i in range(len(tops))]  # range below, its top id, to which range
    if not lent:
        return rows.select(F.lit(0).cast("bigint").alias("rid"), "doc_id", "text", F.lit(0).cast("bigint").alias("next_rid"), F.col("text").alias("next_text"))
    place = F.map_from_entries(F.array(*[F.struct(F.lit(r), F.lit(to)) for r, _, to in lent]))
    ghosts = rows.where(F.col("__key").isin([k for _, k, _ in lent])).groupBy("__range", "__key").agg(F.min("text").alias("text"))
    ghosts = ghosts.select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text", "__key", place[F.col("__range")].alias("__range"), F.col("__range").alias("__from"))
    rows = rows.withColumn("__from", F.lit(None).cast("int")).unionByName(ghosts)
    order = Window.partitionBy("__range").orderBy(F.col("__from").isNotNull(), F.col("__key").desc(), "text")
    rid = F.shiftleft(F.col("__range").cast("bigint"), _RANK_BITS) + F.row_number().over(order)
    origin = F.lead("__from").over(order)
    rows = rows.withColumns({"rid": rid, "next_text": F.lead("text").over(order), "__origin": origin})
    following = F.when(F.col("__origin").isNull(), F.col("rid") + 1).otherwise(F.shiftleft(F.col("__origin").cast("bigint"), _RANK_BITS) + 1)
    return rows.where("__from is null").select("rid", "doc_id", "text", following.alias("next_rid"), "next_text")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: sizes, digests, fingerprints and likenesses of every document; n_near: other fingerprints within RADIUS bits of its own."""
    n = F.length("text")
    rows = with_next(table(spark, sf_dir, "documents")).withColumn("edited", F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 3) as int))"), F.expr("left(next_text, cast(floor(length(text) / 3) as int))")))
    facts = ["rid", "next_rid", "doc_id", "n_chars", "edited_sha256"]
    rows = rows.withColumns({"n_chars": n.cast("bigint"), "edited_sha256": F.sha2("edited", 256)})
    both = rows.select(*facts, F.posexplode(F.array("text", "edited")).alias("which", "body"))
    voted = vote(terms(both, "body", "__terms").select(*facts, "which", F.explode_outer("__terms").alias("term")), [*facts, "which"], "term")
    pairs = voted.groupBy(*facts).agg(*[F.max(F.when(F.col("which") == i, F.col("fingerprint"))).alias(c) for i, c in enumerate(("fp", "edited_fp"))])
    # read three times from here on, while the texts are shuffled and hashed once
    pairs = cut_lineage(pairs.fillna(0, ["fp", "edited_fp"]))
    after = pairs.select(F.col("rid").alias("next_rid"), F.col("fp").alias("next_fp"))
    facts = pairs.join(after, "next_rid", "left").fillna(0, ["next_fp"])
    links = near(pairs.select(F.col("fp").alias("fingerprint")))
    degree = links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_near"))
    return facts.join(degree, "fp", "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hexed(F.col("fp")).alias("fingerprint"),
        hexed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )
