"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its own hashed feature and of its hashed character n-grams,
so an unseen misspelling shares most of the vectors of the word it stands for.
The vectors of a window of words are averaged and go through a linear softmax;
embeddings and softmax are trained jointly in numpy. A text is as toxic as its
few most toxic windows on average: in training, the windows that now score highest
stand for a text (all windows do in the first rounds), so a few words are found in
a text of any length. A part of the labelled rows that is not trained on sets the scale, so
that a score of 0.3 is the cut that told those rows apart best.

Training takes at most ``most_rows`` labelled rows, those of least hash of the
id, of at most ``most_bytes`` bytes each; scoring takes every whole text. Window,
number of windows, rounds and buckets come from four-fold cross-validation on rows
outside the held-out remainder.

Defined results: a null or empty text, or one without words, has one empty
window, so the score is that of the bias alone; several labels of an id count as
their largest, of several texts of an id the least is learned from; a null id is not held out; no usable labels (one class only) score 0 everywhere; repeated
rows have equal scores; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorix import ship
from quorix.llm.common import CHUNK, LOWER_TABLE, Spans, chunks, id_mod, table, texts_of, word_hashes, words_of

#: Words of half a window; windows overlap by that much.
HALF = 1
#: Windows of a text whose mean is its score.
TOP = 3
ROWS, BYTES = 3000, 50_000
CUT = 0.3


@dataclass
class Model:
    #: What each hashed feature adds to the difference of the two logits.
    weight: np.ndarray
    bias: float
    slope: float
    at: float

    def probability(self, z: np.ndarray) -> np.ndarray:
        x = self.slope * (z - self.at) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int, least: int = 3, most: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets and the offsets of each word in them: the word, then its n-grams with < and > around."""
    size = ends - starts + 2
    at = np.cumsum(size) - size
    total = int(size.sum())
    word = np.repeat(np.arange(len(starts)), size)
    inside = np.arange(total) - at[word]
    buffer = np.full(total, 0x3C, np.uint8)
    body = (inside > 0) & (inside < size[word] - 1)
    buffer[body] = data[starts[word[body]] + inside[body] - 1]
    buffer[at + size - 1] = 0x3E
    spans = Spans(buffer)
    hashes, owner = [spans.hash(at, at + size) ^ np.uint64(0x51ED27)], [np.arange(len(starts))]
    for n in range(least, most + 1):
        i = np.flatnonzero(inside + n <= size[word])
        hashes.append(spans.hash(i, i + n))
        owner.append(word[i])
    owner_all = np.concatenate(owner)
    order = np.argsort(owner_all, kind="stable")
    found = (np.concatenate(hashes)[order] % np.uint64(buckets)).astype(np.int64)
    return found, np.append(0, np.cumsum(np.bincount(owner_all, minlength=len(starts)))).astype(np.int64)


def bags(data: np.ndarray, offsets: np.ndarray, buckets: int):
    """Distinct words with their features, the distinct word at each place, and the row of each place."""
    data = LOWER_TABLE[data]
    starts, ends, row = words_of(data, offsets)
    _, first, word = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    feature, at = features(data, starts[first], ends[first], buckets)
    return feature, at, word, row


def bags_of(texts: list[str], buckets: int, most: int = 1 << 20):
    """The same for many texts, with the memory of a few of them."""
    known: dict[int, int] = {}
    found, sizes, words, rows, held, start = [], [], [], [], [], 0
    for i, text in enumerate(texts):
        held.append(text.encode())
        if i + 1 < len(texts) and sum(map(len, held[-64:])) < most and len(held) < 64:
            continue
        data = LOWER_TABLE[np.frombuffer(b"".join(held), np.uint8)]
        starts, ends, row = words_of(data, np.append(0, np.cumsum([len(b) for b in held])).astype(np.int64))
        hashes, first, inverse = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        new = np.array([k for k, h in enumerate(hashes.tolist()) if h not in known], np.int64)
        for h in hashes[new].tolist():
            known[h] = len(known)
        if len(new):
            feature, at = features(data, starts[first[new]], ends[first[new]], buckets)
            found.append(feature.astype(np.int32))
            sizes.append(np.diff(at))
        words.append(np.array([known[h] for h in hashes.tolist()], np.int32)[inverse])
        rows.append((row + start).astype(np.int32))
        start, held = i + 1, []
    none = np.zeros(0, np.int32)
    return np.concatenate([none, *found]), np.append(0, np.cumsum(np.concatenate([none, *sizes]))).astype(np.int64), np.concatenate([none, *words]), np.concatenate([none, *rows])


def halves(row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each half window starts among the words, and its row."""
    n = np.bincount(row, minlength=rows)
    pieces = -(-n // HALF)
    owner = np.repeat(np.arange(rows), pieces)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.repeat(np.cumsum(n) - n, pieces) + HALF * k, owner


def window_sums(x: np.ndarray, begin: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Sums of each half window and the next of its row."""
    half = np.add.reduceat(x, begin, axis=0)
    out = half.copy()
    same = np.flatnonzero(owner[1:] == owner[:-1])
    out[same] += half[same + 1]
    return out


def pooled(z: np.ndarray, owner: np.ndarray, rows: int, empty: float) -> tuple[np.ndarray, np.ndarray]:
    """The mean of the highest windows of each row, and which windows they are."""
    n = np.bincount(owner, minlength=rows)
    has = np.flatnonzero(n)
    first = (np.cumsum(n) - n)[has]
    rest, total, found = z.copy(), np.zeros(len(has)), []
    for k in range(TOP):
        most = np.maximum.reduceat(rest, first) if len(first) else total
        live = n[has] > k
        total[live] += most[live]
        peak = np.zeros(rows)
        peak[has] = most
        at = np.flatnonzero((rest == peak[owner]) & (n[owner] > k))
        at = at[np.append(True, owner[at][1:] != owner[at][:-1])] if len(at) else at
        rest[at] = -np.inf
        found.append(at)
    out = np.full(rows, float(empty))
    out[has] = total / np.minimum(n[has], TOP)
    return out, np.concatenate(found)


def train(texts: list[str], toxic: list[int], dim: int = 8, buckets: int = 1 << 16, epochs: int = 120, seed: int = 11) -> Model | None:
    y = np.array(toxic, np.float64)
    rng = np.random.default_rng(seed)
    held = rng.random(len(y)) < 0.25
    if not all(0 < y[m].sum() < m.sum() for m in (held, ~held)):
        held[:] = False
    if not len(y) or not 0 < y.sum() < len(y):
        return None
    feature, at, word, row = bags_of(texts, buckets)
    begin, owner = halves(row, len(y))
    if not len(begin):
        return None
    stop = np.append(begin[1:], len(word))
    both = np.append(owner[1:] == owner[:-1], False)
    last = np.where(both, np.append(stop[1:], 0), stop)
    per_word = np.diff(at).astype(np.float64)
    bag = window_sums(per_word[word], begin, owner)
    emb = rng.normal(0, 0.05, (buckets, dim))
    out, bias = rng.normal(0, 0.3, (dim, 2)), np.zeros(2)
    moments = [np.zeros_like(p) for p in (emb, out, bias) for _ in (0, 1)]
    word_of_feature = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))

    def logits() -> np.ndarray:
        per = (emb @ (out[:, 1] - out[:, 0]))[feature]
        return window_sums(np.add.reduceat(per, at[:-1])[word], begin, owner) / bag + bias[1] - bias[0]

    for epoch in range(epochs):
        z = logits()
        used = np.arange(0, len(z), 2)
        if epoch >= 4:
            chosen = (y[owner] == 0) & (rng.random(len(z)) < 0.1)
            chosen[pooled(z, owner, len(y), 0.0)[1]] = True
            used = np.flatnonzero(chosen)
        used = used[~held[owner[used]]]
        label = y[owner[used]]
        weight = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum()))
        delta = weight * (1 / (1 + np.exp(-np.clip(z[used], -40, 40))) - label)
        # Back to the words of the windows, then to their features.
        length = last[used] - begin[used]
        places = np.repeat(begin[used], length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        to_word = np.bincount(word[places], np.repeat(delta / bag[used], length), len(at) - 1)
        to_feature = np.bincount(feature, to_word[word_of_feature], buckets)
        diff = out[:, 1] - out[:, 0]
        toward = emb.T @ to_feature
        grads = [np.outer(to_feature, diff) + 1e-7 * emb, np.stack([-toward, toward], 1), np.array([-delta.sum(), delta.sum()])]
        for k, (p, g) in enumerate(zip((emb, out, bias), grads)):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.2 * (g - m)
            v += 0.02 * (g * g - v)
            p -= 0.05 * (m / (1 - 0.8 ** (epoch + 1))) / (np.sqrt(v / (1 - 0.98 ** (epoch + 1))) + 1e-8)
    z = pooled(logits(), owner, len(y), float(bias[1] - bias[0]))[0]
    scale = held if held.any() else np.ones(len(y), bool)
    zs, ys = z[scale], y[scale]
    cuts = np.unique(zs)
    cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
    hit = np.array([(ys[zs >= c] == 1).sum() for c in cuts])
    f1 = 2 * hit / (ys.sum() + np.array([(zs >= c).sum() for c in cuts]))
    best = f1 >= f1.max() - 1e-9
    spread = max(1e-6, float(zs[ys == 1].mean() - zs[ys == 0].mean()))
    return Model((emb @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]), 8 / spread, float(np.median(cuts[best])))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", most_rows: int = ROWS, most_bytes: int = BYTES) -> Model | None:
    """Train on at most ``most_rows`` rows of docs (doc_id, text) that labels (doc_id, label_col) mark."""
    marked = labels.groupBy("doc_id").agg(F.max(label_col).cast("int").alias("y")).where("y is not null")
    short = docs.select("doc_id", "text").where((F.octet_length("text") > 0) & (F.octet_length("text") <= most_bytes))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    # One text for each id, so no more rows than labels come to the driver.
    rows = short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).collect()
    rows = sorted(rows, key=lambda r: r["doc_id"])
    return train([r["text"] for r in rows], [r["y"] for r in rows])


def window_scores(data: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    rows = len(offsets) - 1
    z = np.full(rows, model.bias)
    feature, at, word, row = bags(data, offsets, len(model.weight))
    if len(word):
        begin, owner = halves(row, rows)
        sums = np.add.reduceat(model.weight[feature].astype(np.float64), at[:-1])
        each = window_sums(sums[word], begin, owner) / window_sums(np.diff(at)[word].astype(np.float64), begin, owner) + model.bias
        z = pooled(each, owner, rows, model.bias)[0]
    return z


def score(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """docs with the score as a last column; text is the only input of it. A column of that name is replaced."""
    ship(docs.sparkSession)
    docs = docs.drop(name)
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in chunks(batches, most=CHUNK // 2):
            data, offsets = texts_of(batch)
            p = held.value.probability(window_scores(data, offsets, held.value))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, name])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(id_mod("doc_id", 4) != 2)
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", F.coalesce(id_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


QUERIES = {"op10_toxicity": op10_toxicity}
