"""Suffix-array dedup: exact removal of every repeated `LENGTH`-byte string, across and within texts.

Only suffixes that can have an equal are ever sorted. The anchor of a LENGTH-byte window is its first
ANCHOR-byte gram of least hash, a function of the window's bytes alone, so equal windows have equal
anchors at equal offsets. Windows in a row with the same anchor make a run: about two runs per LENGTH
bytes. Runs whose anchor occurs once in the corpus can't repeat and go no further. The text of the
others (a segment: the run's windows together) is grouped by the anchor's hash; equal segments are
counted and merged before and after that shuffle, so copies of a passage cost one segment a batch.
Anchors of over HOT runs are dealt out by longer ones (the anchor with half a window's other bytes, before or after it).
What is left of a group is sorted as suffixes, deep-shallow: multikey quicksort on 8-byte
digits to depth SHALLOW, then blind tries, which look at the rest only where a suffix leaves the path of its
block's first one. Suffixes that stay equal for LENGTH bytes are repeats. A task holds the segments of one
group and sorts at most about _SUFFIXES of their suffixes (or one place in the window) at once.

All byte comparisons are on the texts themselves (segments are told apart by 128-bit digests).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sphera.llm.kernels import hash_sums, range_hash, slices, table

LENGTH = 200
ANCHOR = 48
SHALLOW = 32
_POS_BITS = 28
_BUFFER = 2000  # segments, about half a MB and a quarter of a million suffixes
_SUFFIXES = 1 << 17  # that are sorted at once
HOT = 1000  # runs of an anchor from which on they are dealt out by longer anchors
U64 = np.uint64


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Anchor hash, row, anchor position, first window, windows of every run; positions count from the row's start."""
    n = len(data)
    if n >> _POS_BITS:
        raise ValueError(f"texts of {n} bytes: more than {_POS_BITS} bits can place")
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    width = length - ANCHOR + 1
    if n < length:
        return none
    sums = hash_sums(data)
    at = np.arange(n - ANCHOR + 1)
    grams = range_hash(sums, at, at + ANCHOR)
    least = (grams & ~U64((1 << _POS_BITS) - 1)) | at.astype(U64)
    size = 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if width > size:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.flatnonzero(row[: n - length + 1] == row[length - 1 :])
    if not len(start):
        return none
    anchor = (least[start] & U64((1 << _POS_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])
    count = np.diff(np.r_[first, len(start)])
    own, base = row[start[first]], offsets[row[start[first]]]
    return grams[anchor[first]].view(np.int64), own, anchor[first] - base, start[first] - base, count


def _digits(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a big-endian number."""
    return np.lib.stride_tricks.sliding_window_view(text, 8)[at].copy().view(">u8").ravel().astype(U64)


def _blocks(number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place of each run of equal numbers, its length, and the run of each place."""
    new = np.r_[True, number[1:] != number[:-1]][: len(number)]
    first = np.flatnonzero(new)
    return first, np.diff(np.r_[first, len(number)]), np.cumsum(new) - 1


def sorted_suffixes(text: np.ndarray, at: np.ndarray, group: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Deep-shallow sort of the suffixes of each group by their first `length` bytes.

    Returns the suffixes' numbers in order (groups ascending), and of each whether it equals the one before it in its group in
    all `length` bytes. text: at least 8 bytes beyond the last suffix.
    """
    order = np.argsort(group, kind="stable")
    equal = np.zeros(len(at), bool)
    slot, number = np.arange(len(at)), group[order]  # places of `order` that aren't settled, and the block of each
    depth = np.zeros(len(at), np.int64)
    deep_slot, deep_number, deep_from, blocks = [], [], [], 0

    def digit(start: np.ndarray, depth: np.ndarray) -> np.ndarray:
        beyond = np.maximum(0, 8 - (length - depth)).astype(U64) * U64(8)
        return _digits(text, start + depth) >> beyond

    # multikey quicksort, all blocks at once: three ways by a digit of 8 bytes against the block's pivot; who equals it goes 8 bytes deeper
    first, size, number = _blocks(number)
    alone = size[number] == 1
    slot, number, depth = slot[~alone], number[~alone], depth[~alone]
    while len(slot):
        first, size, number = _blocks(number)
        item = order[slot]
        key = digit(at[item], depth)
        three = np.sort(np.stack([key[first], key[first + size // 2], key[first + size - 1]]), axis=0)
        pivot = three[1][number]
        way = 3 * number + 1 + (key > pivot) - (key < pivot)
        moved = np.argsort(way, kind="stable")
        order[slot] = item[moved]
        way = way[moved]  # depth is the same in all of a block
        depth = depth + 8 * (way % 3 == 1)
        first, size, number = _blocks(way)
        begins = np.zeros(len(slot), bool)
        begins[first] = True
        whole = depth >= length
        equal[slot[whole & ~begins]] = True
        rest = (size[number] > 1) & ~whole
        deep = rest & (depth >= SHALLOW)
        deep_slot.append(slot[deep])
        deep_number.append(number[deep] + blocks)
        deep_from.append(depth[deep])
        blocks += len(first)
        rest &= ~deep
        slot, number, depth = slot[rest], number[rest], depth[rest]
    slot, number, low = (np.concatenate([*parts, np.zeros(0, np.int64)]) for parts in (deep_slot, deep_number, deep_from))

    # a blind trie of each block, path by path: the first suffix is the path; an inner node is a depth at which others leave it,
    # their digit there the edge. Who goes down the same edge makes a block of the next round, known equal up to that digit.
    while len(slot):
        first, _, number = _blocks(number)
        item = order[slot]
        lead = item[first][number]
        leaves = np.full(len(slot), length)
        edge, side = np.zeros(len(slot), U64), np.ones(len(slot), np.int8)
        ask = np.flatnonzero(item != lead)
        depth = low.copy()
        while len(ask):
            ask = ask[depth[ask] < length]
            a, b = digit(at[item[ask]], depth[ask]), digit(at[lead[ask]], depth[ask])
            off = a != b
            out = ask[off]
            leaves[out], edge[out], side[out] = depth[out], a[off], np.where(a[off] < b[off], 0, 2)
            ask = ask[~off]
            depth[ask] += 8
        # in order: smaller edges by rising depth, the path, larger edges by falling depth
        moved = np.lexsort((edge, np.where(side == 0, leaves, -leaves), side, number))
        order[slot] = item[moved]
        number, side, leaves, edge = number[moved], side[moved], leaves[moved], edge[moved]
        new = np.r_[True, (number[1:] != number[:-1]) | (side[1:] != side[:-1]) | (leaves[1:] != leaves[:-1]) | (edge[1:] != edge[:-1])]
        equal[slot[(side == 1) & ~new]] = True
        number = np.cumsum(new) - 1
        rest = (np.bincount(number)[number] > 1) & (side != 1)
        slot, number, low = slot[rest], number[rest], leaves[rest] + 8
        # whose edge ends the string has nothing left that differs
        whole = low >= length
        if whole.any():
            begins = np.r_[True, number[1:] != number[:-1]]
            equal[slot[whole & ~begins]] = True
            slot, number, low = slot[~whole], number[~whole], low[~whole]
    return order, equal


def equal_suffixes(text: np.ndarray, at: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Of each suffix: whether another one of its group has the same first `length` bytes. text: at least 8 bytes beyond the last suffix."""
    found = np.zeros(len(at), bool)
    order, equal = sorted_suffixes(text, at, group, length)
    found[order] = equal | np.r_[equal[1:], False][: len(equal)]
    return found


def _ranges(flags: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first and end of the maximal runs of set flags that don't cross owners; as places in flags."""
    cut = np.r_[True, owner[1:] != owner[:-1]]
    begin = np.flatnonzero(flags & (cut | ~np.r_[False, flags[:-1]]))
    end = np.flatnonzero(flags & np.r_[cut[1:] | ~flags[1:], True]) + 1
    return owner[begin], begin, end


def repeats_of_groups(anchor: np.ndarray, lead: np.ndarray, count: np.ndarray, copies: np.ndarray, text: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Segment, first and end of its repeated windows. Segments come with all of their group (equal anchor hashes next to each other).

    lead: where the anchor stands in the segment; count: its windows; copies: how many equal segments it stands for.
    """
    owner = np.repeat(np.arange(len(anchor)), count)
    first = np.r_[0, np.cumsum(count)]
    window = np.arange(first[-1]) - first[owner]
    group = np.cumsum(np.r_[False, anchor[1:] != anchor[:-1]])
    shared = np.bincount(group)[group] > 1
    flags = (copies > 1)[owner]
    ask = np.flatnonzero(shared[owner])
    if len(ask):
        text = np.r_[text, np.zeros(length + 8, np.uint8)]
        # equal windows have the anchor at the same place in them, so places can be sorted a few at a time
        place = lead[owner[ask]] - window[ask]
        turn = np.cumsum(np.bincount(place)) // _SUFFIXES
        for t in np.unique(turn[place]) if turn[-1] else (None,):
            now = ask if t is None else ask[turn[place] == t]
            key = group[owner[now]] * (length + 1) + lead[owner[now]] - window[now]
            flags[now] |= equal_suffixes(text, offsets[owner[now]] + window[now], key, length)
    own, begin, end = _ranges(flags, owner)
    return own, begin - first[own], end - first[own]


def _runs_of(docs: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for rows, data, offsets in slices(batches, "text"):
            anchor, row, lead, start, count = runs(data, offsets, length)
            rid = rows.column(0).to_numpy()
            yield pa.RecordBatch.from_pydict({"anchor": anchor, "rid": rid[row], "lead": (lead - start).astype(np.int32), "start": start.astype(np.int32), "windows": count.astype(np.int32)})

    return docs.select("rid", "text").mapInArrow(run, "anchor long, rid long, lead int, start int, windows int")


def _anchor_counts(docs: DataFrame, length: int) -> DataFrame:
    """Anchors of two or more runs; counts are summed in each slice before they leave it."""

    def run(batches):
        for _, data, offsets in slices(batches, "text"):
            anchor, n = np.unique(runs(data, offsets, length)[0], return_counts=True)
            yield pa.RecordBatch.from_pydict({"anchor": anchor, "n": n})

    return docs.select("text").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select(F.col("anchor").bitwiseXOR(F.lit(0)).alias("anchor"), (F.col("n") > HOT).alias("hot"))  # a new column: the join deals it out anew, and can then split a hot anchor


def _divided(data: np.ndarray, offsets: np.ndarray, anchor: np.ndarray, owner: np.ndarray, lead: np.ndarray, start: np.ndarray, count: np.ndarray, hot: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The runs with those of hot anchors in two: windows that have at least `more` bytes before the anchor, and those that have
    as many after it. The anchor and these bytes make the new anchor, which equal windows share too.
    """
    more = (length - ANCHOR) // 2
    sums = hash_sums(data)
    place = offsets[owner] + start + lead
    left = np.clip(lead - more + 1, 0, count)  # windows of the first kind come first
    kinds = [(anchor[~hot], owner[~hot], lead[~hot], start[~hot], count[~hot])]
    for side, (skip, size) in enumerate(((np.zeros_like(left), left), (left, count - left))):
        i = np.flatnonzero(hot & (size > 0))
        begin = place[i] - (more if side == 0 else 0)
        longer = range_hash(sums, begin, begin + ANCHOR + more) ^ U64(side)
        kinds.append((longer.view(np.int64), owner[i], lead[i] - skip[i], start[i] + skip[i], size[i]))
    parts = [np.concatenate(p) for p in zip(*kinds, strict=True)]
    order = np.argsort(parts[1], kind="stable")
    return tuple(p[order] for p in parts)


def _segments(joined: DataFrame, length: int, merge: bool) -> DataFrame:
    """joined: rid, doc_id, text, runs. merge: distinct segments of each slice with their number, else where each stands."""

    def run(batches):
        for rows, data, offsets in slices(batches, "text"):
            lists = rows.column(3)
            if isinstance(lists, pa.ChunkedArray):
                lists = lists.combine_chunks()
            inner = lists.flatten()
            size = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(rows.num_rows), size)
            anchor, lead, start, count, hot = (inner.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5))
            if hot.any():
                anchor, owner, lead, start, count = _divided(data, offsets, anchor, owner, lead, start, count, hot > 0, length)
            begin = offsets[owner] + start
            raw, tail = data.tobytes(), np.stack([lead, count], 1)
            texts = [raw[a:b] for a, b in zip(begin, begin + count + length - 1, strict=True)]
            digests = [xxhash.xxh3_128_digest(t + k.tobytes()) for t, k in zip(texts, tail, strict=True)]
            if not merge:
                yield pa.RecordBatch.from_pydict({"anchor": anchor, "digest": pa.array(digests, pa.binary()), "rid": rows.column(0).to_numpy()[owner], "start": start.astype(np.int32)})
                continue
            seen: dict[bytes, int] = {}
            first, copies = [], []
            for i, d in enumerate(digests):
                if (j := seen.setdefault(d, len(first))) == len(first):
                    first.append(i)
                    copies.append(0)
                copies[j] += 1
            first = np.array(first, np.int64)
            yield pa.RecordBatch.from_pydict({
                "anchor": anchor[first], "digest": pa.array([digests[i] for i in first], pa.binary()), "lead": lead[first].astype(np.int32), "windows": count[first].astype(np.int32),
                "copies": pa.array(copies, pa.int64()), "segment": pa.array([texts[i] for i in first], pa.binary()),
            })

    wide = "anchor long, digest binary, lead int, windows int, copies long, segment binary"
    return joined.mapInArrow(run, wide if merge else "anchor long, digest binary, rid long, start int")


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about _BUFFER rows that end where the first column's value changes; a longer group is held as it came."""
    held: list[pa.RecordBatch] = []
    rows, last = 0, None
    for batch in batches:
        for at in range(0, batch.num_rows, _BUFFER):
            part = batch.slice(at, _BUFFER)
            key = part.column(0).to_numpy()
            if rows >= _BUFFER and (other := key != last).any():
                cut = int(other.argmax())
                yield pa.Table.from_batches([*held, part.slice(0, cut)])
                part = part.slice(cut)
                held, rows = [], 0
            held.append(part)
            rows, last = rows + part.num_rows, key[-1]
    if rows:
        yield pa.Table.from_batches(held)


def _repeats(segments: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for whole in _whole_groups(batches):
            anchor, lead, count, copies = (whole.column(c).to_numpy().astype(np.int64) for c in ("anchor", "lead", "windows", "copies"))
            cells = whole.column("segment").combine_chunks()
            offsets = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1].astype(np.int64)
            text = np.frombuffer(cells.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            own, begin, end = repeats_of_groups(anchor, lead, count, copies, text, offsets - offsets[0], length)
            yield pa.RecordBatch.from_pydict({"anchor": anchor[own], "digest": whole.column("digest").take(pa.array(own)).combine_chunks(), "first": begin.astype(np.int32), "last": end.astype(np.int32)})

    return segments.mapInArrow(run, "anchor long, digest binary, first int, last int")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs (rid, doc_id, text) with `spans` array<struct<from,to>>: byte ranges that repeated windows cover, unordered; null if none."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    repeated = _runs_of(docs, length).join(_anchor_counts(docs, length), "anchor")
    lists = repeated.groupBy("rid").agg(F.collect_list(F.struct("anchor", "lead", "start", "windows", "hot")).alias("runs"))
    joined = docs.join(lists, "rid")
    merged = _segments(joined, length, True).repartition(parts, "anchor").groupBy("anchor", "digest").agg(
        F.first("lead").alias("lead"), F.first("windows").alias("windows"), F.sum("copies").alias("copies"), F.first("segment").alias("segment")
    )
    found = _repeats(merged.sortWithinPartitions("anchor"), length)
    placed = _segments(joined, length, False).join(found, ["anchor", "digest"])
    spans = placed.groupBy("rid").agg(F.collect_list(F.struct((F.col("start") + F.col("first")).alias("from"), (F.col("start") + F.col("last") + (length - 1)).alias("to"))).alias("spans"))
    return docs.join(spans, "rid", "left")


def remove(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row. Null texts are empty; rows may repeat, ids too.

    Rows are told apart by their place in the input, so docs must come from a source that reads the same twice.
    """
    keyed = docs.select("doc_id", "text").withColumn("rid", F.monotonically_increasing_id()).select("rid", "doc_id", "text")

    def run(batches):
        for rows, data, offsets in slices(batches, "text"):
            lists = rows.column(3)
            inner = lists.flatten()
            owner = np.repeat(np.arange(rows.num_rows), np.diff(lists.offsets.to_numpy()))
            change = np.zeros(len(data) + 1, np.int64)
            begin, end = (inner.field(i).to_numpy(zero_copy_only=False).astype(np.int64) + offsets[owner] for i in range(2))
            np.add.at(change, begin, 1)
            np.add.at(change, end, -1)
            gone = np.cumsum(change[:-1]) > 0
            row = np.repeat(np.arange(rows.num_rows), np.diff(offsets))
            n = rows.num_rows
            spans = np.bincount(_ranges(gone, row)[0], minlength=n) if len(data) else np.zeros(n, np.int64)
            removed = np.bincount(row[gone], minlength=n)
            kept, ends = data[~gone].tobytes(), np.cumsum(np.diff(offsets) - removed)
            yield pa.RecordBatch.from_pydict({
                "doc_id": rows.column(1), "n_bytes": np.diff(offsets), "n_removed": removed, "n_spans": spans,
                "kept_sha256": [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)],
            })

    kind = docs.schema["doc_id"].dataType.simpleString()
    return repeated_spans(keyed, length).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: what is left of every document without its repeated 200-byte strings."""
    return remove(table(spark, sf_dir, "documents"))
