"""Language identification by averaged hashed subword embeddings.

A text is the average of the embeddings of its subwords (byte n-grams of its words, hashed to buckets); a linear
softmax reads the language from it. Embeddings and softmax are trained by stochastic gradient descent in numpy
on a sample of labelled documents, drawn evenly by language: every language is learned, from fewer documents each
where there are many. The driver holds the sample as sparse bags. A part of the sample sets the temperature
that makes scores honest and the score below which a prediction counts as rejected.

Since average and softmax are linear, a word adds the same to the logits wherever it stands: tasks compute it
once for each word of a batch.

Defined cases: null texts and texts without a letter are `und` with score 0; without learned languages all are;
rows without language teach nothing; each row is judged by itself, over its whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.llm import rolling
from tracelode.llm.byte_bpe import slices
from tracelode.llm.common import row_key
from tracelode.llm.toxicity import held_out

BUCKETS = 8192
DIMENSIONS = 24
WIDTHS = (1, 2, 3, 4)
#: Documents of each language to learn from, at most about; of all languages; and of each where there are very many.
SAMPLE = 600
SAMPLE_ALL = 30_000
SAMPLE_LEAST = 20
STEPS = 2500
BATCH = 32
RATE = 20.0
#: A prediction is rejected below the score that keeps this precision on the calibration part.
PRECISION = 0.98
UNKNOWN = "und"
LETTER = re.compile("[A-Za-z]")


def subwords(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words in brackets, and the word of each."""
    flat = np.frombuffer(b"".join([b"<" + w + b">" for w in vocabulary]), np.uint8).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in vocabulary], np.int64)
    word = np.repeat(np.arange(len(vocabulary)), lengths)
    buckets, owners = [], []
    for width in WIDTHS:
        if len(flat) < width:
            continue
        inside = word[: len(word) - width + 1] == word[width - 1:]
        h = np.full(len(flat) - width + 1, width, np.uint64)
        for j in range(width):
            h = (h ^ flat[j:len(flat) - width + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        buckets.append((rolling.mix(h)[inside] >> np.uint64(32)).astype(np.int64) % BUCKETS)
        owners.append(word[: len(word) - width + 1][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(LETTER.search(text)) or any(map(str.isalpha, text)))


def bags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's buckets and how often it has them."""
    for batch in batches:
        langs, found, counts = [], [], []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            index, _, vocabulary = rolling.index_words([text.as_py()], fold=True)
            if not vocabulary:
                continue
            bucket, word = subwords(vocabulary)
            n = np.bincount(bucket, weights=np.bincount(index)[word], minlength=BUCKETS)
            at = np.flatnonzero(n)
            langs.append(lang)
            found.append(at.astype(np.int32))
            counts.append(n[at].astype(np.float32))
        yield pa.RecordBatch.from_arrays([
            pa.array(langs, pa.string()), pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32()))], ["lang", "buckets", "counts"])


@dataclass
class Model:
    languages: list[str]
    #: Each bucket's share in the logits, embedding times softmax, divided by the temperature.
    logits: np.ndarray
    bias: np.ndarray
    reject_below: float


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Bags:
    """Rows of bucket shares, held sparse; some of them at a time become an array."""

    def __init__(self, buckets: np.ndarray, shares: np.ndarray, ends: np.ndarray):
        self.buckets, self.shares, self.ends = buckets, shares, ends

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), BUCKETS), np.float32)
        for i, r in enumerate(rows):
            at = slice(self.ends[r], self.ends[r + 1])
            x[i, self.buckets[at]] = self.shares[at]
        return x

    def times(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The rows' product with a matrix."""
        return np.concatenate([self[rows[a:a + 1000]] @ weights for a in range(0, len(rows), 1000)])


def descend(x: Bags, rows: np.ndarray, y: np.ndarray, classes: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, softmax weights and bias by mini-batches with a falling rate."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out = np.zeros((DIMENSIONS, classes), np.float32)
    out[:] = rng.normal(0, 0.1, out.shape)
    bias = np.zeros(classes, np.float32)
    done = 0
    while done < STEPS:
        order = rng.permutation(len(rows))
        for a in range(0, len(rows), BATCH):
            some = order[a:a + BATCH]
            rate = RATE * max(0.0, 1 - done / STEPS)
            found = x[rows[some]]
            hidden = found @ emb
            error = softmax(hidden @ out + bias)
            error[np.arange(len(some)), y[rows[some]]] -= 1
            error /= len(some)
            back = found.T @ (error @ out.T)
            out -= rate * 0.05 * (hidden.T @ error)
            bias -= rate * 0.01 * error.sum(0)
            emb -= rate * back
            done += 1
    return emb, out, bias


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Train and calibrate on at most about `sample` documents of each language."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out() & (F.col("lang") != UNKNOWN)).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 0.0)
    wide = 1 << 30
    each = min(sample, max(SAMPLE_LEAST, SAMPLE_ALL // len(sizes)))
    limits = docs.sparkSession.createDataFrame([(k, int(min(1.0, each / n) * wide)) for k, n in sorted(sizes.items())], "lang string, below long")
    chosen = rows.withColumn("at", F.pmod(F.xxhash64(row_key()), F.lit(wide))).join(F.broadcast(limits), "lang").where(F.col("at") < F.col("below"))
    table = chosen.select("lang", "text").mapInArrow(bags, "lang string, buckets array<int>, counts array<float>").toArrow()
    languages = sorted(set(table["lang"].to_pylist()))
    number = {v: k for k, v in enumerate(languages)}
    y = np.array([number[v] for v in table["lang"].to_pylist()], np.int64)
    if not len(y):
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 0.0)
    buckets, counts = (table[c].combine_chunks() for c in ("buckets", "counts"))
    sizes_of = buckets.value_lengths().to_numpy()
    ends = np.concatenate([[0], np.cumsum(sizes_of)])
    buckets, counts, owner = buckets.flatten().to_numpy(), counts.flatten().to_numpy(), np.repeat(np.arange(len(y)), sizes_of)
    shares = (counts / np.maximum(np.bincount(owner, counts, len(y)), 1)[owner]).astype(np.float32)
    x = Bags(buckets, shares, ends)
    # Rows come in no fixed order; the rows' own content gives one.
    order = np.lexsort((np.bincount(owner, shares * buckets, len(y)), y))
    late = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    emb, out, bias = descend(x, order[~late], y, len(languages))
    check = order[late if late.any() else ~late]
    z, truth = x.times(check, emb) @ out + bias, y[check]
    loss = {t: -np.log(softmax(z / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in np.geomspace(0.25, 4, 33)}
    temperature = min(loss, key=loss.get)
    p = softmax(z / temperature)
    best, right = p.max(1), p.argmax(1) == truth
    order = np.argsort(-best)
    fine = np.flatnonzero(np.cumsum(right[order]) >= PRECISION * np.arange(1, len(order) + 1))
    limit = float(best[order][fine[-1]]) if len(fine) and fine[-1] + 1 < len(order) else 0.0
    return Model(languages, (emb @ out / temperature).astype(np.float32), bias / np.float32(temperature), limit)


def predict(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    index, counts, vocabulary = rolling.index_words(texts, fold=True)
    letters = np.array([has_letter(t) for t in texts], bool)
    if not model.languages or not vocabulary:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    bucket, word = subwords(vocabulary)
    n = np.bincount(word, minlength=len(vocabulary))
    text = np.repeat(np.arange(len(texts)), counts)
    total = np.maximum(np.bincount(text, weights=n[index], minlength=len(texts)), 1)
    z = np.stack([
        np.bincount(text, weights=np.bincount(word, weights=model.logits[bucket, k], minlength=len(vocabulary))[index], minlength=len(texts)) / total + model.bias[k]
        for k in range(len(model.languages))], 1)
    p = softmax(z)
    names = [model.languages[k] if ok else UNKNOWN for k, ok in zip(p.argmax(1), letters, strict=True)]
    return names, np.where(letters, p.max(1), 0.0)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and whether the prediction is rejected, of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model or learn(docs))

    def judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in slices([len(t or "") for t in texts], 2 << 20):
                names, p = predict(texts[a:b], m)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[a:b], batch.column(1)[a:b], pa.array(names, pa.string()), pa.array(p), pa.array(p < m.reject_below)],
                    ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(judged, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
