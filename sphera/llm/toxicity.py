"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its byte n-grams (3 to 6 bytes, word ends marked) and of itself, all hashed
into a fixed number of rows; a window of at most `WINDOW` words is the mean of its words, and softmax(U x mean + b)
scores it. A text scores as its most toxic window, in training and in use alike: the loss of a text is that of
the window which scores most at that step (multi-instance learning). A misspelling that training never saw shares
most n-gram rows with the word it distorts.

Training takes whole texts of a bounded sample of labelled rows (`max_train_docs`, by a hash of the id). They go to one
task, which turns each into word numbers as it comes and trains; the driver gets the finished weights alone.
Scoring is linear in the embeddings, so the broadcast model is one float per embedding row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sphera.llm.kernels import fresh, hash_sums, id_crc, mix, range_hash, slices, table

BUCKETS = 1 << 18
DIM = 8
#: Text bytes handled at once.
SLICE = 1 << 19
WINDOW = 96
#: A shorter passage than this counts as so many words, so that one or two words can't make the mean.
SHORT = 24
LEAST_STEP = 0.003
NGRAMS = (3, 4, 5, 6)
U64 = np.uint64
_SPACE = 0x20
#: Bytes of a word: ASCII letters, digits and every non-ASCII byte; capitals fold.
_FOLD = np.full(256, _SPACE, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass
class Model:
    weight: np.ndarray  # embedding rows times the softmax direction
    bias: float


@dataclass
class Words:
    """Texts as numbers of distinct words, and the embedding rows of each distinct word."""

    word: np.ndarray  # of every place in the texts
    first: np.ndarray  # first place of each text (n+1)
    key: np.ndarray  # hash of each distinct word
    rows: np.ndarray  # embedding rows of the distinct words, end to end
    start: np.ndarray  # first of them of each distinct word (n+1)


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first[i] .. first[i] + size[i] - 1 of all i, end to end."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes with a space before, between and after the rows, and the rows' new starts (n+1)."""
    rows = len(offsets) - 1
    out = np.full(len(data) + rows + 1, _SPACE, np.uint8)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    out[np.arange(len(data)) + row + 1] = _FOLD[data]
    return out, offsets + np.arange(rows + 1)


def _subwords(text: np.ndarray, begin: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows, and how many each word has; text: words with one space before each and one at the end."""
    code = text.astype(U64)
    blank = text == _SPACE
    gap = np.cumsum(np.r_[0, blank])  # spaces before each byte
    word_at = gap[1:] - 1  # the word a byte, or the space before it, belongs to
    ids, owner = [whole & U64(BUCKETS - 1)], [np.arange(len(begin))]
    for n in NGRAMS:
        if len(text) < n:
            continue
        h = np.zeros(len(text) - n + 1, U64)
        for i in range(n):
            h = (h << U64(8)) | code[i : len(code) - n + 1 + i]
        # the n-gram may touch a word's end only with its first or last byte
        at = np.flatnonzero(gap[n - 1 : n - 1 + len(h)] == gap[1 : 1 + len(h)])
        ids.append(mix(h[at] + U64(n << 56)) & U64(BUCKETS - 1))
        owner.append(word_at[at])
    ids, owner = np.concatenate(ids), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return ids[order].astype(np.int32), np.bincount(owner, minlength=len(begin))


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    text, starts = _fold(data, offsets)
    inside = text != _SPACE
    begin = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    finish = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    key, at, word = np.unique(range_hash(hash_sums(text), begin, finish), return_index=True, return_inverse=True)
    size = finish[at] - begin[at]
    short = np.append(text[_spans(begin[at] - 1, size + 1)], np.uint8(_SPACE))  # each word with the space before it
    rows, count = _subwords(short, np.cumsum(size + 1) - size, key)
    return Words(word.astype(np.int32), np.searchsorted(begin, starts + 1), key, rows, np.r_[0, np.cumsum(count)])


def gathered(parts: list[Words]) -> Words:
    """Several slices' texts with one numbering of the words, by where they come first."""
    keys = np.concatenate([p.key for p in parts])
    _, first, back = np.unique(keys, return_index=True, return_inverse=True)
    number = np.empty(len(first), np.int32)
    number[np.argsort(first)] = np.arange(len(first), dtype=np.int32)
    number, first = number[back], np.sort(first)
    words, rows, count, at = [], [], [], 0
    for p in parts:  # one at a time, as the rows of a slice are many
        new = first[(first >= at) & (first < at + len(p.key))] - at
        size = np.diff(p.start)[new]
        words.append(number[at : at + len(p.key)][p.word])
        rows.append(p.rows[_spans(p.start[:-1][new], size)])
        count.append(size)
        at += len(p.key)
    length = np.concatenate([np.diff(p.first) for p in parts])
    return Words(np.concatenate(words), np.r_[0, np.cumsum(length)], keys[first], np.concatenate(rows), np.r_[0, np.cumsum(np.concatenate(count))])


def _windows(value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: its largest window mean and where that window begins; value: of each word. Texts without words: 0."""
    size = np.diff(first)
    best, begin = np.zeros(len(size)), first[:-1].copy()
    has = np.flatnonzero(size)
    if len(has):
        sums = np.r_[0.0, np.cumsum(value)]
        at = np.arange(len(value))
        width = np.repeat(np.minimum(WINDOW, size), size)
        to = np.minimum(at + width, np.repeat(first[1:], size))
        mean = (sums[to] - sums[to - width]) / np.maximum(width, SHORT)
        best[has] = np.maximum.reduceat(mean, first[has])
        top = np.flatnonzero(mean == np.repeat(best, size))
        owner, i = np.unique(np.repeat(np.arange(len(size)), size)[top], return_index=True)
        begin[owner] = (to - width)[top[i]]
    return best, begin


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: Words, labels: np.ndarray, epochs: int = 20, rate: float = 40.0, least: float = 8e-4, turn_rate: float = 0.05, batch: int = 64, seed: int = 7) -> Model:
    """Joint training of embeddings and softmax: dual averaging with AdaGrad steps for the embeddings, AdaGrad for the softmax.

    Embedding rows start at random. A row counts only as far as its gradients add up to more than `least` times the
    root of the number of texts, the noise of rows without a meaning; this group penalty keeps rows that a few texts
    happen to use from memorising them. One class only: a constant score of that class.
    """
    labels = np.asarray(labels, float)
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS, np.float32), -4.0 if not len(labels) or labels[0] == 0 else 4.0)
    least = least * np.sqrt(len(labels))
    count = np.diff(texts.start)
    seen = np.bincount(texts.word, minlength=len(texts.key))
    often = np.zeros(BUCKETS)
    for at in range(0, len(seen), 1 << 14):  # a part of the words at a time
        to = min(len(seen), at + (1 << 14))
        often += np.bincount(texts.rows[texts.start[at] : texts.start[to]], np.repeat(seen[at:to], count[at:to]), BUCKETS)
    used = np.flatnonzero(often > 1)
    number = np.full(BUCKETS, -1, np.int32)
    number[used] = np.arange(len(used))
    rows = number[texts.rows]
    stays = rows >= 0
    kept = np.r_[0, np.cumsum(np.add.reduceat(stays, texts.start[:-1], dtype=np.int64))] if len(count) else np.zeros(1, np.int64)
    rows = rows[stays]
    rng = np.random.default_rng(seed)
    start = rng.normal(0, 0.1, (len(used), DIM)).astype(np.float32)
    emb, total = np.zeros((len(used), DIM), np.float32), np.zeros((len(used), DIM), np.float32)
    square = np.zeros(len(used), np.float32)
    soft = rng.normal(0, 0.5, (2, DIM)).astype(np.float32)
    soft /= np.linalg.norm(soft[1] - soft[0])
    soft_square = np.full((2, DIM), 1e-3, np.float32)
    bias = np.array([0.0, np.log(labels.mean() / (1 - labels.mean()))])
    order = np.arange(len(labels))
    for _ in range(epochs):
        rng.shuffle(order)
        for at in range(0, len(order), batch):
            docs = order[at : at + batch]
            size = texts.first[docs + 1] - texts.first[docs]
            word, back = np.unique(texts.word[_spans(texts.first[docs], size)], return_inverse=True)
            many = kept[word + 1] - kept[word]
            row, owner = rows[_spans(kept[word], many)], np.repeat(np.arange(len(word)), many)
            away = soft[1] - soft[0]
            value = np.bincount(owner, (emb @ away)[row], len(word)) / count[word]  # rows that stay out count as nothing
            best, begin = _windows(value[back], np.r_[0, np.cumsum(size)])
            width = np.minimum(size, WINDOW)
            err = _sigmoid(best + bias[1] - bias[0]) - labels[docs]  # of class 1; class 0 has the opposite
            pull = np.bincount(back[_spans(begin, width)], np.repeat(err / np.maximum(width, SHORT), width), len(word)) / count[word]
            g = np.bincount(row, pull[owner], len(used)).astype(np.float32)
            hit = np.flatnonzero(g)
            turn = (g[hit] @ emb[hit]) / len(docs)
            before = np.sqrt(square[hit])
            square[hit] += g[hit] ** 2
            after = np.sqrt(square[hit])
            total[hit] += g[hit, None] * away - ((after - before) / rate)[:, None] * emb[hit]
            norm = np.linalg.norm(total[hit], axis=1)
            live = np.maximum(0, 1 - least / np.maximum(norm, 1e-12))[:, None]
            emb[hit] = live * (start[hit] - total[hit] * (rate / (LEAST_STEP + after))[:, None])
            turn = np.stack([-turn, turn])
            soft_square += turn**2
            soft -= turn_rate * turn / np.sqrt(soft_square)
            bias += 0.02 * err.mean() * np.array([1, -1])
    full = np.zeros(BUCKETS, np.float32)
    full[used] = emb @ (soft[1] - soft[0])
    return Model(full, float(bias[1] - bias[0]))


def score_slice(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Score of each row: the largest over its windows; without words the bias alone."""
    texts = words_of(data, offsets)
    if not len(texts.key):
        return np.full(len(offsets) - 1, _sigmoid(model.bias))
    value = np.add.reduceat(model.weight[texts.rows], texts.start[:-1]) / np.diff(texts.start)
    return _sigmoid(_windows(value[texts.word], texts.first)[0] + model.bias)


def training_rows(docs: DataFrame, labels: DataFrame, max_train_docs: int) -> DataFrame:
    """label, text of the bounded sample: smallest hashes of the id first, never those of the held-out fold.

    An id that stands on many rows, of labels or of docs, gives many rows; the bound is on the rows that come out.
    """
    order = [F.xxhash64("doc_id"), "doc_id", "label"]
    sample = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (id_crc("doc_id") % 3 != 1))
        .select("doc_id", (F.col("toxic") > 0).cast("int").alias("label"))
        .orderBy(*order)
        .limit(max_train_docs)
    )
    # at most max_train_docs rows of two numbers, so its size is bounded
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return found.orderBy(*order, F.xxhash64("text"), "text").limit(max_train_docs).select("label", "text")


def train(docs: DataFrame, labels: DataFrame, max_train_docs: int = 4000) -> Model:
    """Trains in one task, which the limit of training_rows gives all rows of the sample to."""

    def run(batches):
        parts, marks = [], []
        for rows, data, offsets in slices(batches, "text", SLICE):
            parts.append(words_of(data, offsets))
            marks.append(rows.column(0).to_numpy())
        model = fit(gathered(parts), np.concatenate(marks)) if parts else fit(None, np.zeros(0))
        row = np.flatnonzero(model.weight)
        yield pa.RecordBatch.from_pydict({"row": np.r_[BUCKETS, row], "weight": np.r_[model.bias, model.weight[row]].astype(float)})

    weight, bias = np.zeros(BUCKETS, np.float32), fit(None, np.zeros(0)).bias
    for row, value in training_rows(docs, labels, max_train_docs).mapInArrow(run, "row long, weight double").collect():  # at most BUCKETS + 1 rows
        if row == BUCKETS:
            bias = value
        else:
            weight[row] = value
    return Model(weight, bias)


def score(docs: DataFrame, model: Model, column: str = "tox_score") -> DataFrame:
    """docs with the score of each text in `column` (a column of that name is replaced). Null and empty texts get the prior."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats
    kept = docs.drop(column)
    names = kept.columns

    def run(batches):
        for rows, data, offsets in slices(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(score_slice(held.value, data, offsets))], names=[*names, column])

    schema = T.StructType([*kept.schema, T.StructField(column, T.DoubleType())])
    return kept.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: doc_id, held_out, score, predicted of every document; a null id is in no fold (held_out false) and has no label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = docs.sparkSession.sparkContext.broadcast(train(docs, table(spark, sf_dir, "labels")))

    def run(batches):
        for rows, data, offsets in slices(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(score_slice(held.value, data, offsets))], names=["doc_id", "score"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    held_out = F.coalesce(id_crc("doc_id") % 3 == 1, F.lit(False))
    return docs.mapInArrow(run, schema).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def keep_clean(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored below 0.7 stay, with their columns."""
    model = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    name = fresh(docs, "tox_score")
    return score(docs, model, name).where(F.col(name) < 0.7).drop(name)
