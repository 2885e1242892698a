"""Quality classifier: naive Bayes support vectors.

A document is the set of its n-grams: character trigrams, single words, word pairs, and runs of one
word said two, three or four times, hashed to ``BUCKETS``. Each indicator is scaled by the log-count ratio of its bucket between the two classes, the
vector is brought to the length of the root of its size, and a linear hinge-loss model is fitted by
dual coordinate descent. The model is one array of ``BUCKETS`` weights, whatever the corpus.

It is fitted on at most ``SAMPLE`` labelled rows per class, those whose id has the smallest hash; all
documents are scored, over their whole texts, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.llm.common import BLOCK, Hasher, mixed, slices, tidied, utf8, words_of
from quire.session import ship_with_tasks

BUCKETS = 1 << 18
#: Labelled rows per class that the model is fitted on, at most.
SAMPLE = 4000


def held_out(doc_id) -> object:
    """Rows that no model learns from: those whose id, as text, has a CRC-32 of remainder 1 by 3."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_rows(labels: DataFrame, label: str, sample: int) -> DataFrame:
    """``(doc_id, label)``: at most ``sample`` rows per class of what may be learnt from.

    Rows without an id or a label are left out; of several labels of one id the smallest counts.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out("doc_id"))
    one = usable.groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    classes = [one.filter(F.col("label") == c).orderBy(*order).limit(sample) for c in (0, 1)]
    return classes[0].unionByName(classes[1])


def features(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> list[np.ndarray]:
    """The sorted buckets of each text."""
    begin = int(offsets[0])
    text = data[begin : int(offsets[-1])].astype(np.uint64)
    count = max(len(text) - 2, 0)
    three = text[:count] | text[1 : count + 1] << np.uint64(8) | text[2 : count + 2] << np.uint64(16)
    shift = np.uint64(64 - 18)
    three = (mixed(three + np.uint64(1)) >> shift).astype(np.int32)
    packed, starts, ends, first = words_of(data, offsets)
    words = hasher.spans(packed, starts, ends)
    # Of longer n-grams only those of one word, whatever it is: said two, three or four times in a row.
    pairs = (mixed(words[:-1] * np.uint64(3) + words[1:]) >> shift).astype(np.int32)
    again = words[:-1] == words[1:]
    edge = first[(first > 0) & (first < len(words))]
    again[edge - 1] = False
    for times in range(2, 5):
        pairs[len(pairs) - len(again) :][again] = times
        again = again[1:] & again[:-1]
    words = (words >> shift).astype(np.int32)
    seen = np.zeros(BUCKETS, bool)
    result = []
    for low, high, a, b in zip((offsets[:-1] - begin).tolist(), (offsets[1:] - begin).tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
        seen[three[low : max(high - 2, low)]] = True
        seen[words[a:b]] = True
        seen[pairs[a : max(b - 1, a)]] = True
        own = np.flatnonzero(seen)
        seen[own] = False
        result.append(own.astype(np.int32))
    return result


def fit(rows: list[np.ndarray], labels: np.ndarray, rounds: int = 12, cost: float = 1.0, mix: float = 0.25) -> dict:
    """Weights per bucket, and what turns a margin into a probability.

    One row in five only calibrates. With one class or none, the score is the share of label 1
    (a half without rows) whatever the text.
    """
    share = float(labels.mean()) if len(labels) else 0.5
    if len(set(labels.tolist())) < 2:
        return {"weights": np.zeros(BUCKETS, np.float32), "bias": 0.0, "slope": 0.0, "shift": float(np.log((share + 1e-6) / (1 - share + 1e-6)))}
    learn = np.flatnonzero(np.arange(len(rows)) % 5 != 4)
    counts = np.ones((2, BUCKETS))
    for i in learn:
        counts[labels[i], rows[i]] += 1
    known = counts.sum(axis=0) > 2
    counts /= counts.sum(axis=1, keepdims=True)
    ratio = np.where(known, np.log(counts[1] / counts[0]), 0)
    x = [(ratio[r] / max(len(r), 1) ** 0.5).astype(np.float32) for r in rows]
    y = np.where(labels == 1, 1.0, -1.0)
    # Both classes weigh the same.
    upper = cost * len(learn) / 2 / np.array([(labels[learn] == c).sum() for c in (0, 1)])[labels]
    w, bias = np.zeros(BUCKETS), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for v in x])
    chance = np.random.default_rng(7)
    for _ in range(rounds):
        for i in chance.permutation(learn).tolist():
            gradient = y[i] * (float(w[rows[i]] @ x[i]) + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), upper[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * x[i]
                bias += step
                alpha[i] = new
    w = (1 - mix) * np.abs(w).mean() + mix * w
    weights = w * ratio
    margin = np.array([weights[r].sum() / max(len(r), 1) ** 0.5 for r in rows]) + bias * mix
    return {"weights": weights.astype(np.float32), "bias": bias * mix, **calibrated(margin, labels, np.arange(len(rows)) % 5 == 4)}


def calibrated(margin: np.ndarray, labels: np.ndarray, use: np.ndarray) -> dict:
    """Slope and shift of a logistic curve over margins, both classes weighing the same."""
    use = use if len(set(labels[use].tolist())) == 2 else np.ones(len(labels), bool)
    m, t = margin[use], labels[use].astype(float)
    scale = max(float(np.abs(m).mean()), 1e-9)
    m = m / scale
    weight = np.where(t == 1, 0.5 / t.mean(), 0.5 / (1 - t.mean()))
    slope, shift = 1.0, 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(slope * m + shift, -30, 30)))
        error = weight * (p - t)
        slope -= 0.5 * (float((error * m).mean()) + 0.005 * slope)
        shift -= 0.5 * float(error.mean())
    return {"slope": slope / scale, "shift": shift}


def _featured(batches):
    hasher = Hasher()
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for a, b in slices(offsets, BLOCK // 2):
            own = [x.astype("<i4").tobytes() for x in features(data, offsets[a : b + 1], hasher)]
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(own, pa.binary())], names=["doc_id", "label", "buckets"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> dict:
    """Fit on ``docs(doc_id, text)`` and ``labels(doc_id, <label>)``; the bounded sample goes to the driver."""
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(training_rows(labels, label, sample)), "doc_id")
        .mapInArrow(tidied(_featured), "doc_id long, label int, buckets binary")
        .groupBy("doc_id", "label")
        .agg(F.min("buckets").alias("buckets"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .collect()
    )
    return fit([np.frombuffer(r.buckets, "<i4") for r in rows], np.array([r.label for r in rows], int))


def _scorer(model, names: list[str], text_col: str, schema: pa.Schema):
    def run(batches):
        m, hasher = model.value, Hasher()
        for batch in batches:
            data, offsets = utf8(batch.column(text_col))
            scores = []
            for a, b in slices(offsets, BLOCK // 2):
                scores += [float(m["weights"][x].sum(dtype=np.float64)) / max(len(x), 1) ** 0.5 for x in features(data, offsets[a : b + 1], hasher)]
            margin = np.array(scores, float) + m["bias"]
            p = 1 / (1 + np.exp(-np.clip(m["slope"] * margin + m["shift"], -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(p)], schema=schema)

    return run


def score(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``, the probability of label 1; null and empty texts get that of no n-gram."""
    docs = docs.drop(score_col)
    out = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(tidied(_scorer(shared, docs.columns, text_col, to_arrow_schema(out))), out)


ship_with_tasks(__name__)
