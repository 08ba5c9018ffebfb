"""N-gram Jaccard join by rare-first prefix filtering, and the components of its links.

A text's set is that of its k-word shingles (64-bit hashes). Shingles are ordered rare first by
document frequency, counted over all texts in a table of `DF_SLOTS` slots (so its size is fixed; sharing a slot only
costs order, never a link). Two sets that link share one of their first n - ceil(t n) + 1 shingles, so
postings of those prefixes are grouped by shingle. Pairs pass the length filter, the positional
filter and the suffix filter, then each pair is verified once on the texts. The suffix filter cuts what follows the shared
shingle in both sets at the same PARTS - 1 pivots of the shingle order (equal shares of all shingles, by the frequency table):
the counts between pivots must differ by no more than the threshold leaves room for.

Equal sets count once. A group of m near copies doesn't make m^2 pairs: in a first round only sets that stand
next to each other under a shingle (by size) are compared, and each with the shingle's hub, the set with the
most common shingles; the links found give components. In the second,
pairs are made only between different components, and the sets of a shingle's main component meet only those outside it. Pairs
left out are those already in one component, so components are whole.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sphera.llm.components import connected
from sphera.llm.kernels import as_long, cut_lineage, fresh, shingles, slices, table, text_bytes, words

DF_SLOTS = 1 << 20
_CHUNK = 1 << 14
PARTS = 64
_ROWS = 2048  # pairs that the suffix filter looks at together
U64 = np.uint64


def sets_of(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending within it, and their rows."""
    _, _, hashes, first = words(data, offsets)
    value, row = shingles(hashes, first, k)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (row[1:] != row[:-1])][: len(value)]
    return value[new], row[new]


def _slot(value: np.ndarray) -> np.ndarray:
    return (value >> U64(44)).astype(np.int64)


def document_frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """Of each slot: how many (text, shingle) fall into it. Tasks send compressed chunks, which are added up by chunk."""
    parts = DF_SLOTS // _CHUNK

    def count(batches):
        total = np.zeros(DF_SLOTS, np.int64)
        for _, data, offsets in slices(batches, "text"):
            total += np.bincount(_slot(sets_of(data, offsets, k)[0]), minlength=DF_SLOTS)
        yield pa.RecordBatch.from_pydict({"chunk": np.arange(parts, dtype=np.int32), "counts": [zlib.compress(c.tobytes(), 1) for c in total.reshape(parts, _CHUNK)]})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(zlib.decompress(blob), np.int64)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(sums), pa.int32()), "counts": pa.array([zlib.compress(c.tobytes(), 1) for c in sums.values()], pa.binary())})

    kind = "chunk int, counts binary"
    out = np.zeros(DF_SLOTS, np.int64)
    for chunk, blob in docs.select("text").mapInArrow(count, kind).repartition(parts, "chunk").mapInArrow(add, kind).collect():  # parts rows
        out[chunk * _CHUNK : (chunk + 1) * _CHUNK] = np.frombuffer(zlib.decompress(blob), np.int64)
    return out


def _part_of_slot(frequency: np.ndarray) -> np.ndarray:
    """Between which pivots the shingles of a slot stand: order is by frequency, then by value."""
    order = np.argsort(frequency, kind="stable")
    mass = np.cumsum(frequency[order].astype(np.int64))
    part = np.empty(len(order), np.uint8)
    part[order] = (mass - 1).clip(min=0) * PARTS // max(1, int(mass[-1]))
    return part


def _summaries(docs: DataFrame, part_of_slot, k: int) -> DataFrame:
    """rid, doc_id, n, sid (digest of the set; null if empty), parts (how many of its shingles stand between pivots, 16-bit, saturating)."""

    def run(batches):
        for rows, data, offsets in slices(batches, "text"):
            value, row = sets_of(data, offsets, k)
            n = np.bincount(row, minlength=rows.num_rows)
            ends = np.cumsum(n)
            raw = value.tobytes()
            sid = [xxhash.xxh3_64_intdigest(raw[8 * (e - c) : 8 * e]) for c, e in zip(n, ends, strict=True)]
            hist = np.bincount(row * PARTS + part_of_slot.value[_slot(value)], minlength=rows.num_rows * PARTS).clip(max=65535).astype(np.uint16).tobytes()
            yield pa.RecordBatch.from_pydict({
                "rid": rows.column(0), "doc_id": rows.column(1), "n": n, "sid": pa.array(np.array(sid, U64).view(np.int64), mask=n == 0),
                "parts": [hist[i : i + 2 * PARTS] for i in range(0, len(hist), 2 * PARTS)],
            })

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("rid", "doc_id", "text").mapInArrow(run, f"rid long, doc_id {kind}, n long, sid long, parts binary")


def _postings(docs: DataFrame, frequency, k: int, num: int, den: int) -> DataFrame:
    """token, sid, n, pos of every prefix; equal sets of a slice once."""

    def run(batches):
        for rows, data, offsets in slices(batches, "text"):
            value, row = sets_of(data, offsets, k)
            n = np.bincount(row, minlength=rows.num_rows)
            ends = np.cumsum(n)
            raw = value.tobytes()
            sid = np.array([xxhash.xxh3_64_intdigest(raw[8 * (e - c) : 8 * e]) for c, e in zip(n, ends, strict=True)], U64)
            once = np.zeros(rows.num_rows, bool)
            once[np.unique(sid, return_index=True)[1]] = True
            order = np.lexsort((value, frequency.value[_slot(value)], row))
            value = value[order]
            pos = np.arange(len(value)) - (ends - n)[row]
            keep = (pos < (n - -(-num * n // den) + 1)[row]) & once[row]
            yield pa.RecordBatch.from_pydict({"token": as_long(value[keep]), "sid": as_long(sid[row[keep]]), "n": n[row[keep]].astype(np.int32), "pos": pos[keep].astype(np.int32)})

    return docs.select("text").mapInArrow(run, "token long, sid long, n int, pos int")


def _may_link(n1: Column, p1: Column, n2: Column, p2: Column, num: int, den: int) -> Column:
    """Length and positional filters of two sets by their sizes and the places of a shared shingle."""
    small, large = F.least(n1, n2).cast("bigint"), F.greatest(n1, n2).cast("bigint")
    overlap = 1 + F.least(n1 - p1, n2 - p2).cast("bigint") - 1
    return (small * den >= large * num) & (overlap * (den + num) >= num * (small + large))


def _pairs(df: DataFrame, one: tuple[str, str], two: tuple[str, str]) -> DataFrame:
    """a, b, pos_a, pos_b (sets, the lesser first, and where the shared shingle stands in them) from two (set, place) of each row."""
    first = F.col(one[0]) < F.col(two[0])
    pick = lambda i, j: F.when(first, F.col(one[i])).otherwise(F.col(two[i])) if not j else F.when(first, F.col(two[i])).otherwise(F.col(one[i]))
    return df.select(pick(0, 0).alias("a"), pick(0, 1).alias("b"), pick(1, 0).alias("pos_a"), pick(1, 1).alias("pos_b"))


def _once(pairs: DataFrame) -> DataFrame:
    """Each pair once, by its first shared shingle found."""
    return pairs.groupBy("a", "b").agg(F.min(F.struct("pos_a", "pos_b")).alias("at")).select("a", "b", "at.pos_a", "at.pos_b")


def suffixes_allow(na: np.ndarray, nb: np.ndarray, pos_a: np.ndarray, pos_b: np.ndarray, parts_a: np.ndarray, parts_b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of na and nb shingles that share one, at pos_a and pos_b, can link; parts: counts between pivots."""
    after_a, after_b = (np.clip(np.minimum(p, np.cumsum(p, 1) - at[:, None] - 1), 0, None) for p, at in ((parts_a, pos_a), (parts_b, pos_b)))
    suffix = (na - pos_a - 1 + nb - pos_b - 1 - np.abs(after_a - after_b).sum(1)) // 2
    whole = (na + nb - np.abs(parts_a - parts_b).sum(1)) // 2
    shared = np.minimum(whole, np.minimum(pos_a, pos_b) + 1 + suffix)
    full = (parts_a == 65535).any(1) | (parts_b == 65535).any(1)
    return full | (den * shared >= num * (na + nb - shared))


def _suffix_filter(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """pairs (a, b, pos_a, pos_b) with the rid of a text of each, as far as their suffixes allow a link."""
    side = lambda s: sets.select(F.col("sid").alias(s), F.col("n").alias(f"n_{s}"), F.col("rid").alias(f"rid_{s}"), F.col("parts").alias(f"parts_{s}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "rid_a", "rid_b", "n_a", "n_b", "pos_a", "pos_b", "parts_a", "parts_b")

    def run(batches):
        for batch in (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS)):
            numbers = [batch.column(i).to_numpy().astype(np.int64) for i in range(4, 8)]
            parts = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, PARTS).astype(np.int64) for i in (8, 9)]
            yield batch.select(["a", "b", "rid_a", "rid_b"]).filter(pa.array(suffixes_allow(*numbers, *parts, num, den)))

    return joined.mapInArrow(run, "a long, b long, rid_a long, rid_b long")


def _verified(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b, rid_a, rid_b) whose texts' sets link."""
    one = pairs.join(docs.select(F.col("rid").alias("rid_a"), F.col("text").alias("text_a")), "rid_a")
    two = one.join(docs.select(F.col("rid").alias("rid_b"), F.col("text").alias("text_b")), "rid_b").select("a", "b", "text_a", "text_b")

    def run(batches):
        for rows, data, offsets in slices(batches, "text_a"):
            va, ra = sets_of(data, offsets, k)
            vb, rb = sets_of(*text_bytes(rows.column(3)), k)
            value, row = np.concatenate([va, vb]), np.concatenate([ra, rb])
            order = np.lexsort((value, row))
            value, row = value[order], row[order]
            twice = (value[1:] == value[:-1]) & (row[1:] == row[:-1])
            shared = np.bincount(row[1:][twice], minlength=rows.num_rows)
            union = np.bincount(row, minlength=rows.num_rows) - shared
            yield rows.select(["a", "b"]).filter(pa.array((den * shared >= num * union) & (union > 0)))

    return two.mapInArrow(run, "a long, b long")


def _hub_pairs(shared: DataFrame, num: int, den: int) -> DataFrame:
    """Each set of a shingle with the shingle's hub, the set whose shingles are the most common: the text that others vary."""
    size = shared.groupBy("token").agg(F.count("*").alias("size"))
    common = shared.select("token", "sid").join(size, "token").groupBy("sid").agg(F.sum("size").alias("common"))
    hub = shared.join(common, "sid").groupBy("token").agg(F.max(F.struct("common", F.col("sid").alias("hub"), F.col("n").alias("n_hub"), F.col("pos").alias("pos_hub"))).alias("h")).select("token", "h.*")
    pairs = shared.join(hub, "token").where((F.col("sid") != F.col("hub")) & _may_link(F.col("n"), F.col("pos"), F.col("n_hub"), F.col("pos_hub"), num, den))
    return _pairs(pairs, ("sid", "pos"), ("hub", "pos_hub"))


def keyed(docs: DataFrame) -> DataFrame:
    """rid, doc_id, text: rid is the row's place in its source, which must read the same twice."""
    return docs.select("doc_id", "text").withColumn("rid", F.monotonically_increasing_id())


def join(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """rid, doc_id, n, component of each row of docs (rid, doc_id, text); rows link if den * |A & B| >= num * |A | B|.

    component: equal for rows that links connect; null for rows without words (or text), which link with nothing.
    Repeated rows are rows of equal sets. An empty table gives no rows.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("rid", "doc_id", "text")
    counts = np.minimum(document_frequencies(docs, k), 2**31 - 1).astype(np.int32)
    frequency, part_of_slot = (docs.sparkSession.sparkContext.broadcast(x) for x in (counts, _part_of_slot(counts)))  # DF_SLOTS numbers each
    rows = cut_lineage(_summaries(docs, part_of_slot, k))
    sets = rows.where("sid is not null").groupBy("sid").agg(F.min(F.struct("rid", "n", "parts")).alias("s")).select("sid", "s.*")
    own = Window.partitionBy("token").orderBy("n", "sid")
    postings = _postings(docs, frequency, k, num, den).repartition(parts, "token").distinct()
    near = {f"{c}_before": F.lag(c).over(own) for c in ("sid", "n", "pos")} | {"sid_after": F.lead("sid").over(own)}
    shared = cut_lineage(postings.withColumns(near).where("sid_before is not null or sid_after is not null").drop("sid_after"))
    chain = shared.where(F.col("sid_before").isNotNull() & _may_link(F.col("n"), F.col("pos"), F.col("n_before"), F.col("pos_before"), num, den))
    chain = cut_lineage(_once(_pairs(chain, ("sid", "pos"), ("sid_before", "pos_before")).union(_hub_pairs(shared, num, den))))
    first = connected(_verified(_suffix_filter(chain, sets, num, den), docs, k, num, den))
    first = first.withColumnRenamed("node", "sid")
    placed = shared.select("token", "sid", "n", "pos").join(first, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    sizes = placed.groupBy("token", "component").agg(F.count("*").alias("m"))
    main = sizes.groupBy("token").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.count("*").alias("kinds")).where("kinds > 1").drop("kinds")
    mixed = placed.join(main, "token")
    few = mixed.where("component <> main").select("token", *[F.col(c).alias(f"{c}_a") for c in ("sid", "n", "pos", "component")])
    apart = (F.col("component_a") != F.col("component")) & ((F.col("component") == F.col("main")) | (F.col("sid_a") < F.col("sid")))
    cross = few.join(mixed, "token").where(apart & _may_link(F.col("n_a"), F.col("pos_a"), F.col("n"), F.col("pos"), num, den))
    cross = _once(_pairs(cross, ("sid", "pos"), ("sid_a", "pos_a"))).join(chain, ["a", "b"], "left_anti")
    second = _verified(_suffix_filter(cross, sets, num, den), docs, k, num, den)
    whole = connected(first.select(F.col("sid").alias("a"), F.col("component").alias("b")).union(second))
    whole = whole.withColumnRenamed("node", "sid")
    return rows.join(whole, "sid", "left").select("rid", "doc_id", "n", F.coalesce("component", "sid").alias("component"))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: shingle sets of three words, links at a likeness of 0.9; the least doc_id of each component."""
    linked = join(keyed(table(spark, sf_dir, "documents")), 3, 90, 100)
    least = linked.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return linked.join(least, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of documents that links at a likeness of 0.8 of their five-word shingles connect, the one with the least doc_id stays."""
    key = fresh(docs, "rid")
    rows = docs.withColumn(key, F.monotonically_increasing_id())
    linked = join(rows.select(F.col(key).alias("rid"), "doc_id", "text"), 5, 80, 100)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    first = linked.where("component is not null").groupBy("component").agg(F.min(order)["rid"].alias("first"))
    dropped = linked.join(first, "component").where("rid <> first").select(F.col("rid").alias(key))
    return rows.join(dropped, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
