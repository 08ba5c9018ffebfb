"""SentencePiece encoding and decoding of BPE models by suffix-array matching.

A text with its blanks as piece marks falls into chunks (marks, then other characters) that no piece
crosses. The distinct chunks of a slice are concatenated and indexed by a suffix array, sorted to the
longest piece: by 8 bytes, and those that a longer piece begins with by the rest. Every piece is
binary-searched for its occurrence range; the ranges give edges (position, length, piece), which go by
position into a table. Relaxing then takes, chunk by chunk and all chunks at once, the best-scored
edge over two adjacent symbols, leftmost first, until none is left: the merges of the model. In a chunk
of over `LONG` characters a heap finds that edge, in n log n; the edges are those of the same table.

A least-cost path over the edges would be right for unigram models; for the BPE models given here it
isn't, so relaxing follows the merge order. Characters without a piece fall back to bytes.
Results equal the reference library's ids.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sphera.llm.kernels import fresh, slices, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
LONG = 48
_CACHE = 300_000  # chunks a task remembers
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
U64 = np.uint64
_NONE = np.iinfo(np.int64).max


class Vocabulary:
    """Pieces of a model: text, score and kind, as plain lists, so that the driver can broadcast them."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        self.pieces, self.kinds = pieces, kinds
        order = sorted((i for i, k in enumerate(kinds) if k == "normal"), key=lambda i: -scores[i])
        self.rank = np.full(len(pieces), _NONE, np.int64)
        self.rank[order] = np.arange(len(order))
        self.byte_id = np.zeros(256, np.int32)
        for i, k in enumerate(kinds):
            if k == "byte":
                self.byte_id[int(pieces[i][1:-1], 16)] = i
        raw = [pieces[i].encode() for i in order]
        self.chars = np.array([len(pieces[i]) for i in order])
        self.most_chars = int(self.chars.max(initial=1))
        self.width = -(-max(map(len, raw), default=1) // 8) * 8
        self.order = np.array(order, np.int64)
        size = np.array([len(r) for r in raw])
        self.short = np.flatnonzero(size <= 8)
        low = np.array([int.from_bytes(raw[i].ljust(8, b"\0"), "big") for i in self.short], U64)
        self.low, self.high = low, low | np.array([(1 << 8 * (8 - int(size[i]))) - 1 for i in self.short], U64)
        self.longer = np.flatnonzero(size > 8)
        self.heads = np.unique(np.array([int.from_bytes(raw[i][:8], "big") for i in self.longer], U64))
        self.long_low = np.array([raw[i] for i in self.longer], f"S{self.width}")
        self.long_high = np.array([raw[i].ljust(self.width, b"\xff") for i in self.longer], f"S{self.width}")
        spoken = [b"" if k == "control" else " ⁇ ".encode() if k == "unknown" else bytes([int(p[1:-1], 16)]) if k == "byte" else p.replace(MARK, " ").encode() for p, k in zip(pieces, kinds, strict=True)]
        self.spoken = np.frombuffer(b"".join(spoken), np.uint8)
        self.spoken_at = np.r_[0, np.cumsum([len(s) for s in spoken])]
        self.marked = np.array([k == "normal" and p.startswith(MARK) for p, k in zip(pieces, kinds, strict=True)])

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        kind = lambda i: "unknown" if model.is_unknown(i) else "control" if model.is_control(i) or model.is_unused(i) else "byte" if model.is_byte(i) else "normal"
        return cls([model.id_to_piece(i) for i in range(n)], [model.get_score(i) for i in range(n)], [kind(i) for i in range(n)])

    def edges(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Piece id by character and length in characters; -1 for none. data: `width` zero bytes follow the text."""
        out = np.full((len(starts), self.most_chars + 1), -1, np.int32)
        first = np.lib.stride_tricks.sliding_window_view(data, 8)[starts].copy().view(">u8").ravel().astype(U64)
        suffix = np.argsort(first, kind="stable")
        first = first[suffix]

        def put(order: np.ndarray, low: np.ndarray, high: np.ndarray, which: np.ndarray) -> None:
            count = high - low
            at = np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            piece = np.repeat(which, count)
            out[order[at], self.chars[piece]] = self.order[piece]

        put(suffix, np.searchsorted(first, self.low), np.searchsorted(first, self.high, "right"), self.short)
        if len(self.longer):
            low, high = np.searchsorted(first, self.heads), np.searchsorted(first, self.heads, "right")
            count = high - low
            deep = suffix[np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())]
            text = np.lib.stride_tricks.sliding_window_view(data, self.width)[starts[deep]].copy().view(f"S{self.width}").ravel()
            order = np.argsort(text, kind="stable")
            text = text[order]
            put(deep[order], np.searchsorted(text, self.long_low), np.searchsorted(text, self.long_high, "right"), self.longer)
        return out

    def _relax_heap(self, edge: np.ndarray) -> list[tuple[int, int]]:
        """Symbols (first, end) of one chunk; edge: its rows of the edge table."""
        n = len(edge)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and end[j] - i <= self.most_chars and (p := edge.item(i, end[j] - i)) >= 0:
                heapq.heappush(heap, (self.rank.item(p), i, end[i], end[j]))

        alive = [True] * n
        for i in range(n):
            offer(i)
        while heap:
            _, i, mid, to = heapq.heappop(heap)
            if not alive[i] or end[i] != mid or mid >= n or not alive[mid] or end[mid] != to:
                continue
            alive[mid] = False
            end[i] = to
            after[i] = after[mid]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [(i, end[i]) for i in range(n) if alive[i]]

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets of the chunks' encodings."""
        data = np.frombuffer(("\0".join(chunks) + "\0").encode("utf-8", "replace") + b"\0" * self.width, np.uint8)
        body = data[: len(data) - self.width]
        starts = np.flatnonzero((body & 0xC0) != 0x80)
        size = np.array([len(c) for c in chunks])
        begin = np.r_[0, np.cumsum(size + 1)[:-1]]
        edge = self.edges(data, starts)
        chunk = np.repeat(np.arange(len(chunks)), size + 1)
        finish = begin + size
        short = size <= LONG
        first, last = [], []
        for c in np.flatnonzero(~short):
            for a, b in self._relax_heap(edge[begin[c] : finish[c]]):
                first.append(np.array([begin[c] + a]))
                last.append(np.array([begin[c] + b]))
        live = np.flatnonzero(short[chunk] & (np.arange(len(chunk)) < finish[chunk]))
        while len(live):
            own = chunk[live]
            new = np.r_[True, own[1:] != own[:-1]]
            ends = np.r_[live[1:], 0]
            final = np.r_[new[1:], True]
            ends[final] = finish[own[final]]
            pair_end = np.r_[ends[1:], 0]
            length = np.where(final, 0, pair_end - live)
            piece = np.where((length > 0) & (length <= self.most_chars), edge[live, np.minimum(length, self.most_chars)], -1)
            key = np.where(piece >= 0, (self.rank[piece] << 32) + np.arange(len(live)), _NONE)
            best = np.minimum.reduceat(key, np.flatnonzero(new))
            number = np.cumsum(new) - 1
            done = (best == _NONE)[number]
            first.append(live[done])
            last.append(ends[done])
            keep = ~done
            keep[(best[best != _NONE] & 0xFFFFFFFF) + 1] = False
            live = live[keep]
        first, last = np.concatenate([*first, np.zeros(0, np.int64)]), np.concatenate([*last, np.zeros(0, np.int64)])
        order = np.argsort(first)
        first, last = first[order], last[order]
        length = last - first
        piece = edge[first, length]
        bytes_of = np.diff(np.r_[starts, len(body)])
        count = np.where(piece >= 0, 1, bytes_of[first])
        at = np.repeat(starts[first], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        flat = np.where(np.repeat(piece, count) >= 0, np.repeat(piece, count), self.byte_id[data[at]]).astype(np.int32)
        return flat, np.r_[0, np.cumsum(np.bincount(chunk[first], count, len(chunks)).astype(np.int64))]

    def speak(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes that ids stand for and the n+1 offsets; one blank that the encoder put before a text goes."""
        size = np.diff(self.spoken_at)[flat]
        at = np.repeat(self.spoken_at[flat] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        ends = np.r_[0, np.cumsum(size)][offsets]
        keep = np.ones(len(at), bool)
        has = np.flatnonzero(np.diff(offsets) > 0)
        keep[ends[has][self.marked[flat[offsets[has]]]]] = False
        return self.spoken[at[keep]].tobytes(), np.r_[0, np.cumsum(keep)][ends]


class Encoder:
    """A task's encoder: it remembers chunks."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.flat, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets; null and empty texts have none."""
        split = [_CHUNK.findall((MARK + t).replace(" ", MARK)) if t else [] for t in texts]
        if len(self.seen) > _CACHE:
            self._forget()
        seen = self.seen
        fresh: list[str] = []
        numbers = []
        for chunks in split:
            for c in chunks:
                if c not in seen:
                    seen[c] = len(seen)
                    fresh.append(c)
            numbers.append([seen[c] for c in chunks])
        if fresh:
            flat, offsets = self.vocabulary.encode_chunks(fresh)
            self.offsets = np.r_[self.offsets, self.offsets[-1] + offsets[1:]]
            self.flat = np.r_[self.flat, flat]
        number = np.array([i for part in numbers for i in part], np.int64)
        size = self.offsets[number + 1] - self.offsets[number]
        at = np.repeat(self.offsets[number] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.flat[at], np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum([len(p) for p in numbers])].astype(np.int64)]


NEW = ("ids", "n_tokens", "decoded_sha256")


def encode(docs: DataFrame, model: str = MODEL, text: str = "text", new: tuple[str, str, str] = NEW) -> DataFrame:
    """docs with ids array<int>, n_tokens int and decoded_sha256 of the text that the ids decode to (columns of the names in `new` are replaced).

    Null and empty texts have no ids. Repeated rows stay; an empty table gives an empty one.
    """
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))  # its size is the model's
    kept = docs.drop(*new)
    names = kept.columns

    def run(batches):
        coder = Encoder(held.value)
        for rows, _, _ in slices(batches, text, 1 << 20):
            flat, offsets = coder.encode(rows.column(rows.schema.get_field_index(text)).to_pylist())
            said, ends = coder.vocabulary.speak(flat, offsets)
            digests = [hashlib.sha256(said[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*rows.columns, ids, pa.array(np.diff(offsets), pa.int32()), pa.array(digests)], names=[*names, *new])

    kinds = (T.ArrayType(T.IntegerType()), T.IntegerType(), T.StringType())
    schema = T.StructType([*kept.schema, *[T.StructField(n, k) for n, k in zip(new, kinds, strict=True)]])
    return kept.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str = MODEL, ids: str = "ids") -> DataFrame:
    """rows with `text`, decoded from ids (null ids: empty; bytes that aren't UTF-8 give U+FFFD)."""
    held = rows.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    kept = rows.drop("text")
    names = kept.columns

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column(part.schema.get_field_index(ids))
                offsets = np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy())].astype(np.int64)
                said, ends = held.value.speak(lists.flatten().to_numpy(), offsets)
                texts = [said[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*names, "text"])

    return kept.mapInArrow(run, T.StructType([*kept.schema, T.StructField("text", T.StringType())]))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: ids of every text, their number, and the digests of the text and of what the ids decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs).select("doc_id", "n_tokens", "ids", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "decoded_sha256")


def encoded(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the documents with ids and n_tokens; where documents has columns of these names, underscores go before the new ones."""
    new = tuple(fresh(docs, n) for n in NEW)
    return encode(docs, new=new).drop(new[2])
