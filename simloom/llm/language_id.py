"""Language ID: multinomial logistic regression on TF-IDF character n-grams, trained by FTRL-proximal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, release, settle, slices, table, text_rows, trimmed

#: n-grams are hashed to 2 ** BITS features.
BITS = 16
ORDERS = (1, 2, 3)
UNDETERMINED = "und"

_M = np.uint32(0x9E3779B1)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters, by Unicode's general category."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def ngram_features(bodies: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts on end, the place where each text starts among them, and whether it has a letter.

    Texts are put in lower case; everything but letters becomes one code point, so n-grams see word borders only.
    """
    texts = [x.decode("utf-8", "replace") for x in bodies]
    texts = [x.lower() for x in texts] if lower else texts
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    letter = _letters()[codes]
    seen = np.concatenate([[0], np.cumsum(letter)])
    has = seen[starts[1:]] > seen[starts[:-1]]
    codes = np.where(letter, codes, np.uint32(32))
    # n-grams don't cross texts: those that would are given the place's unigram instead, so every place has as many.
    rest = np.repeat(starts[1:], sizes) - np.arange(len(codes))
    out = np.empty((len(codes), len(ORDERS)), np.uint16 if BITS <= 16 else np.uint32)
    h = np.zeros(len(codes), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        nxt = np.zeros(len(codes), np.uint32)
        nxt[: len(codes) - order + 1] = codes[order - 1 :]
        whole = rest >= order
        h = np.where(whole, (h ^ nxt) * _M + np.uint32(order), h)
        if order in ORDERS:
            mixed = h ^ (h >> np.uint32(15))
            out[:, ORDERS.index(order)] = (mixed * _M) >> np.uint32(32 - BITS)
    return out, starts, has


#: Texts of more bytes are counted in parts of as many characters.
LONG = 4 << 20


def long_counts(body: bytes) -> tuple[np.ndarray, bool]:
    """How often each hashed n-gram occurs in one very long text, and whether it has a letter."""
    text = body.decode("utf-8", "replace").lower()
    out, any_letter = np.zeros(1 << BITS, np.int64), False
    for a in range(0, len(text), LONG):
        part = text[a : a + LONG + max(ORDERS) - 1]  # n-grams that start in the part end beyond it
        grams, _, has = ngram_features([part.encode()], lower=False)
        out += np.bincount(grams[:LONG].ravel(), minlength=1 << BITS)
        any_letter |= bool(has[0])
    return out, any_letter


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # features x labels: idf times weight
    bias: np.ndarray
    temperature: float

    def predict(self, bodies: list[bytes]) -> tuple[list[str], np.ndarray]:
        """The label of each whole text and its calibrated probability; `und` with 0 for texts without a letter."""
        if not self.labels:
            return [UNDETERMINED] * len(bodies), np.zeros(len(bodies))
        long = [i for i, x in enumerate(bodies) if len(x) > LONG]
        grams, starts, has = ngram_features([b"" if len(x) > LONG else x for x in bodies])
        scores = np.zeros((len(bodies), len(self.labels)))
        sizes = np.diff(starts)
        full = np.flatnonzero(sizes)
        if len(full):
            for k in range(grams.shape[1]):
                scores[full] += np.add.reduceat(self.table[grams[:, k]], starts[full], axis=0, dtype=np.float64)
            scores[full] /= (sizes[full] * grams.shape[1])[:, None]
        for i in long:
            seen, has[i] = long_counts(bodies[i])
            scores[i] = seen @ self.table.astype(np.float64) / max(1, seen.sum())
        scores = (scores + self.bias) / self.temperature
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        scores /= scores.sum(axis=1, keepdims=True)
        best = scores.argmax(axis=1)
        return [self.labels[b] if ok else UNDETERMINED for b, ok in zip(best, has, strict=True)], np.where(has, scores.max(axis=1), 0.0)


def train_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]],
    labels: np.ndarray,
    n_labels: int,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 1e-4,
    l2: float = 1e-4,
    epochs: int = 4,
    seed: int = 7,
) -> tuple[np.ndarray, np.ndarray]:
    """Follow-the-regularised-leader (proximal) with elastic-net penalties; rows are (features, values).

    Returns weights (features x labels; zero where the l1 penalty holds them) and the bias.
    """
    size = (1 << BITS) + 1  # the last one is the bias
    z, n = np.zeros((size, n_labels)), np.zeros((size, n_labels))

    def weights(at):
        zs = z[at]
        w = -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zs) <= l1, 0.0, w)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, value = rows[i]
            w = weights(at)
            logits = value @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1.0
            g = value[:, None] * p
            g2 = g * g
            sigma = (np.sqrt(n[at] + g2) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g2
    w = weights(np.arange(size))
    return w[:-1], w[-1]


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by golden-section search over its logarithm."""

    def loss(t: float) -> float:
        x = logits / np.exp(t)
        x = x - x.max(axis=1, keepdims=True)
        return float(-(x[np.arange(len(x)), labels] - np.log(np.exp(x).sum(axis=1))).mean())

    low, high, ratio = np.log(0.02), np.log(50.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit_language_model(docs: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_label: int = 1200) -> Model:
    """Fits a model on at most per_label rows of each label, chosen by a hash of the id; every fifth calibrates.

    The rows that may be learnt from are those given with a label. The inverse document frequencies, a corpus
    statistic, are counted over all of them. Only the sample's feature counts reach the driver. Training is
    deterministic. Without labelled rows the model calls every text `und`.
    """
    labelled = docs.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    base = labelled.select(F.col(label_col).cast("string").alias("label"), F.xxhash64(F.col(id_col).cast("string")).alias("h"), as_bytes(text_col).alias("body"))
    counts = {r["label"]: r["n"] for r in base.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0)
    labels = sorted(counts)
    # The share of each label's rows whose hash falls below its threshold is per_label rows or all.
    share = F.lit(None).cast("double")
    for x in labels:
        share = F.when(F.col("label") == x, F.lit(min(1.0, per_label / counts[x]))).otherwise(share)
    picked = base.select("label", "body", (F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).alias("chosen"), F.pmod("h", F.lit(1 << 40)).alias("h"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of the sample, with their features, and one row a task with the documents' number and frequencies."""
        df, n_docs = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 20):  # about 50 bytes of features a character
                bodies = batch.column(1)[a:b].to_pylist()
                grams, starts, has = ngram_features([b"" if len(x) > LONG else x for x in bodies])
                chosen = batch.column(2)[a:b].to_pylist()
                for i in range(len(bodies)):
                    if len(bodies[i]) > LONG:
                        seen, has[i] = long_counts(bodies[i])
                    else:
                        seen = np.bincount(grams[starts[i] : starts[i + 1]].ravel(), minlength=0)
                    if not has[i]:
                        continue
                    at = np.flatnonzero(seen)
                    df[at] += 1
                    n_docs += 1
                    if chosen[i]:
                        packed = np.concatenate([at.astype(np.int32), seen[at].astype(np.int32)]).tobytes()
                        yield _row(batch.column(0)[a + i].as_py(), batch.column(3)[a + i].as_py(), packed)
        yield _row(None, n_docs, df.tobytes())

    def _row(label, h, packed) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([label], pa.string()), pa.array([h], pa.int64()), pa.array([packed], pa.binary())], names=["label", "h", "packed"])

    made = settle(picked.mapInArrow(trimmed(work), "label string, h bigint, packed binary"), "language-features")
    df, n_docs = _frequencies(made.filter("label is null"))
    idf = np.log((1 + n_docs) / (1 + df)) + 1.0
    sample = sorted(((r["label"], r["h"], bytes(r["packed"])) for r in made.filter("label is not null").toLocalIterator()), reverse=True)
    rows, ys, hold = [], [], []
    while sample:  # a row's counts go as its features come
        label, h, packed = sample.pop()
        at, tf = np.frombuffer(packed, np.int32).reshape(2, -1)
        value = tf / tf.sum() * idf[at] * SCALE
        rows.append((np.append(at, np.int32(1 << BITS)), np.append(value, 1.0).astype(np.float32)))
        ys.append(labels.index(label))
        hold.append(h % 5 == 0)
    ys, hold = np.array(ys), np.array(hold)
    fit = np.flatnonzero(~hold) if (~hold).any() else np.arange(len(rows))
    weights, bias = train_ftrl([rows[i] for i in fit], ys[fit], len(labels))
    check = np.flatnonzero(hold) if hold.any() else fit
    full = np.vstack([weights, bias])
    temperature = calibrate(np.array([rows[i][1] @ full[rows[i][0]] for i in check]), ys[check]) if len(check) else 1.0
    del rows
    release()
    return Model(labels, (weights * (idf * SCALE)[:, None]).astype(np.float32), bias, max(temperature, 0.02))


#: Puts relative frequencies times idf on the scale of the penalties.
SCALE = 10.0


#: Tasks that sum up frequencies, of 512 KB each.
SUMS = 32


def _frequencies(parts: DataFrame) -> tuple[np.ndarray, int]:
    """Sums the tasks' document frequencies on the executors; SUMS vectors at most reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for h, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                df += np.frombuffer(packed, np.int64)
                n += h
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([n], pa.int64()), pa.array([df.tobytes()], pa.binary())], names=["label", "h", "packed"])

    summed = parts.coalesce(SUMS).mapInArrow(trimmed(add), "label string, h bigint, packed binary")
    df, n = np.zeros(1 << BITS, np.int64), 0
    for r in summed.toLocalIterator():
        df, n = df + np.frombuffer(bytes(r["packed"]), np.int64), n + r["h"]
    return df, n


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, lang_pred, score. No shuffle; the whole text counts.

    Text that is null or has no letter gets `und` and 0. Of equally probable labels the first in the alphabet is taken.
    Very long texts are counted in parts. Null ids pass through, repeated rows repeat, other columns are ignored; an
    empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS features times the labels

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 20):
                found, score = shared.value.predict(batch.column(1)[a:b].to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(found, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    return text_rows(docs, id_col, text_col).mapInArrow(trimmed(work), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_language_model(docs.filter(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
