"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Character n-grams (1 to 3 code points, lower case, runs of other characters as one blank) are hashed
into `BUCKETS` columns. Document frequencies come from every learnable document. Weights are trained
by follow-the-regularised-leader with elastic-net penalties on a bounded sample of labelled
documents (`max_train_docs`, smallest hashes of the id), part of which calibrates the temperature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sphera.llm.kernels import id_crc, slices, table

BITS = 13
BUCKETS = 1 << BITS
#: Odd multipliers of an n-gram's first, second and third code point.
_MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917], np.uint32)
_alpha: np.ndarray | None = None
UNKNOWN = "und"
_CELLS = 1 << 22  # of a dense block of rows x columns


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray  # BUCKETS
    weight: np.ndarray  # BUCKETS x languages
    temperature: float


def _alphabet() -> np.ndarray:
    """Of every code point: whether it is a letter."""
    global _alpha
    if _alpha is None:
        _alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _alpha


def counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Dense n-gram counts (texts x BUCKETS) and whether each text has a letter."""
    parts = [np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32) for text in texts]
    code, row = np.concatenate(parts), np.repeat(np.arange(len(texts)), [len(x) for x in parts])
    letter = _alphabet()[code]
    has = np.bincount(row[letter], minlength=len(texts)) > 0
    keep = np.r_[True, letter[1:] | letter[:-1] | (row[1:] != row[:-1])]
    code, row = np.where(letter, code, np.uint32(32))[keep], row[keep] * BUCKETS
    total, key = np.zeros(len(code), np.uint32), []
    for n, multiplier in enumerate(_MULTIPLIERS):
        total = total[: len(code) - n] + code[n:] * multiplier
        same = row[n:] == row[: len(code) - n]
        key.append((row[: len(total)] + (total >> np.uint32(32 - BITS)))[same])
    return np.bincount(np.concatenate(key), minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS), has


def _blocks(texts: list):
    step = max(1, _CELLS // BUCKETS)
    for at in range(0, len(texts), step):
        yield at, texts[at : at + step]


def _features(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = count.astype(np.float32) * idf
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def fit(texts: list[str], labels: list[str], idf: np.ndarray, epochs: int = 6, alpha: float = 4.0, l1: float = 0.002, l2: float = 0.0005, batch: int = 32, seed: int = 11) -> Model:
    """FTRL-proximal on four fifths of the rows, temperature by least log loss on the rest."""
    langs = sorted(set(labels))
    if not langs:
        return Model([], idf, np.zeros((BUCKETS, 0), np.float32), 1.0)
    y = np.searchsorted(langs, labels)
    x = np.concatenate([_features(counts(part)[0], idf) for _, part in _blocks(texts)])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    cut = len(y) // 5
    held, train = order[:cut], order[cut:]
    z, square, weight = (np.zeros((BUCKETS, len(langs)), np.float32) for _ in range(3))
    for _ in range(epochs):
        rng.shuffle(train)
        for at in range(0, len(train), batch):
            rows = train[at : at + batch]
            err = _softmax(x[rows] @ weight)
            err[np.arange(len(rows)), y[rows]] -= 1
            g = x[rows].T @ err
            after = np.sqrt(square + g * g)
            z += g - (after - np.sqrt(square)) / alpha * weight
            square += g * g
            weight = np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((0.1 + after) / alpha + l2)).astype(np.float32)
    logits = x[held] @ weight
    loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(cut), y[held]], 1e-12)).mean()
    grid = np.geomspace(0.05, 5, 60)
    return Model(langs, idf, weight, float(min(grid, key=loss)) if cut else 1.0)


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and calibrated probability of each text; `und` with score 0 for null, letterless texts or without a model."""
    langs, scores = [], []
    for _, part in _blocks(texts):
        count, has = counts(part)
        if not model.langs:
            langs += [UNKNOWN] * len(part)
            scores.append(np.zeros(len(part)))
            continue
        p = _softmax(_features(count, model.idf) @ model.weight / model.temperature)
        best = p.argmax(1)
        ok = has & np.array([t is not None for t in part])
        langs += [model.langs[b] if k else UNKNOWN for b, k in zip(best, ok, strict=True)]
        scores.append(np.where(ok, p[np.arange(len(part)), best], 0.0))
    return langs, np.concatenate([*scores, np.zeros(0)]).astype(float)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each column occurs, over all rows of docs; each task sends at most BUCKETS + 1 pairs."""

    def run(batches):
        total, n = np.zeros(BUCKETS, np.int64), 0
        for rows, _, _ in slices(batches, "text"):
            for _, part in _blocks(rows.column("text").to_pylist()):
                total += (counts(part)[0] > 0).sum(0)
                n += len(part)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"column": np.r_[used, BUCKETS], "docs": np.r_[total[used], n]})

    found = docs.select("text").mapInArrow(run, "column long, docs long").groupBy("column").agg(F.sum("docs").alias("docs"))
    out = np.zeros(BUCKETS + 1, np.int64)
    for r in found.collect():  # at most BUCKETS + 1 rows
        out[r[0]] = r[1]
    return out[:BUCKETS], int(out[BUCKETS])


def training_rows(rows: DataFrame, max_train_docs: int) -> DataFrame:
    """lang, text of the bounded sample: smallest hashes of the id first. The bound is on rows, however often an id stands there."""
    order = [F.xxhash64("doc_id"), "doc_id", "lang"]
    ids = rows.select("doc_id", "lang").orderBy(*order).limit(max_train_docs).select("doc_id").distinct()
    # at most max_train_docs rows of one number
    found = rows.select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id")
    return found.orderBy(*order, F.xxhash64("text"), "text").limit(max_train_docs).select("lang", "text")


def train(learnable: DataFrame, max_train_docs: int = 3000) -> Model:
    """learnable: text, lang, doc_id of the rows one may learn from (null languages don't count).

    Training runs in one task, which the limit of training_rows gives the whole sample to; the driver gets the weights.
    """
    rows = learnable.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    df, n = document_frequencies(rows)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def run(batches):
        sample = [r for batch in batches for r in batch.to_pylist()]
        model = fit([r["text"] for r in sample], [r["lang"] for r in sample], idf)
        column, lang = np.nonzero(model.weight)
        size = len(model.langs)
        yield pa.RecordBatch.from_pydict({
            "column": np.r_[np.full(size, BUCKETS), column],
            "lang": pa.array(model.langs + [model.langs[i] for i in lang], pa.string()),
            "weight": np.r_[np.full(size, model.temperature), model.weight[column, lang]].astype(float),
        })

    found = training_rows(rows, max_train_docs).mapInArrow(run, "column long, lang string, weight double").collect()  # BUCKETS + 1 rows a language
    langs = sorted(r[1] for r in found if r[0] == BUCKETS)
    place = {lang: i for i, lang in enumerate(langs)}
    weight, temperature = np.zeros((BUCKETS, len(langs)), np.float32), 1.0
    for column, lang, value in found:
        if column == BUCKETS:
            temperature = value
        else:
            weight[column, place[lang]] = value
    return Model(langs, idf, weight, temperature)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: doc_id, held_out, lang_pred, score of every document; a null id is in no fold (held_out false) and is not learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(id_crc("doc_id") % 5 == 0, F.lit(False))
    model = spark.sparkContext.broadcast(train(docs.where(F.col("doc_id").isNotNull() & ~held_out)))

    def run(batches):
        for rows, _, _ in slices(batches, "text"):
            langs, scores = predict(model.value, rows.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    scored = docs.select("doc_id", "text").mapInArrow(run, schema)
    return scored.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
