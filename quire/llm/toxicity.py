"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as an embedding of itself (lower case, without punctuation around it) and the mean of the
embeddings of its character n-grams, both hashed to fixed tables. Texts are cut into windows of
``WINDOW`` words that overlap by a quarter; a text's score is that of its worst window. Training takes, for
each document, the window the network now finds worst, and fits that one to the document's label.

The model is fitted on at most ``SAMPLE`` labelled rows per class on the driver and is a few megabytes
whatever the corpus; all windows of all whole texts are scored, without a shuffle.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.llm.common import BLOCK, Hasher, Numbers, slices, utf8
from quire.llm.quality import training_rows
from quire.session import ship_with_tasks

#: Labelled rows per class that the network is fitted on, at most.
SAMPLE = 2000
#: Words of a window, and from one window to the next.
WINDOW, STRIDE = 32, 24
#: Rows of the tables of words and character n-grams; sizes of the n-grams in bytes.
WORDS, GRAMS, SIZES = 1 << 14, 1 << 15, (3, 5, 7)
EMBEDDING, HIDDEN = 8, 8
#: Distinct words that a task remembers before it starts anew; windows that are scored together.
REMEMBERED, TOGETHER = 200_000, 1024


def inputs_of(words: list[bytes], hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table row of each word, table rows of the n-grams of all words, where each word's begin."""
    bare = [w.decode("utf-8", "replace").lower() for w in words]
    marked = [f"<{b.strip(string.punctuation) or b}>".encode() for b in bare]
    ends = np.cumsum([len(m) for m in marked], dtype=np.int64)
    starts = ends - np.array([len(m) for m in marked], np.int64)
    data = np.frombuffer(b"".join(marked), np.uint8)
    word = (hasher.spans(data, starts, ends) % np.uint64(WORDS)).astype(np.int64)
    owner, rows = [], []
    for size in SIZES:
        many = np.maximum(ends - starts - size + 1, 0)
        total = np.cumsum(many)
        begin = np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - many - starts, many)
        rows.append((hasher.spans(data, begin, begin + size) % np.uint64(GRAMS)).astype(np.int64))
        owner.append(np.repeat(np.arange(len(words)), many))
    owner, rows = np.concatenate(owner), np.concatenate(rows)
    order = np.argsort(owner, kind="stable")
    return word, rows[order], np.searchsorted(owner[order], np.arange(len(words) + 1))


def sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)))
    return total[edges[1:]] - total[edges[:-1]]


def embedded(model: dict, word: np.ndarray, grams: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Input of each word, a few thousand words at a time."""
    result = np.empty((len(word), 2 * EMBEDDING), np.float32)
    result[:, :EMBEDDING] = model["words"][word]
    for at in range(0, len(word), 8192):
        own = edges[at : at + 8193]
        mean = sums(model["grams"][grams[own[0] : own[-1]]], own - own[0]) / np.maximum(np.diff(own), 1)[:, None]
        result[at : at + 8192, EMBEDDING:] = mean
    return result


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word (in all words of the texts together) and words of each window."""
    many = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(counts)), many)
    place = (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * STRIDE
    return text, place + np.repeat(np.cumsum(counts) - counts, many), np.minimum(WINDOW, np.repeat(counts, many) - place)


def forward(model: dict, gates: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Logit of each window. ``gates`` has the input of both directions' gates for each word;
    ``index`` and ``mask`` are windows by words. ``keep`` takes what training needs."""
    rows, steps, h3 = len(index), index.shape[1], 3 * HIDDEN
    full = keep is None and mask.all()
    state = np.zeros((2, rows, HIDDEN), np.float32)
    out = np.empty((steps, rows, 2 * HIDDEN), np.float32)
    for t in range(steps):
        back = steps - 1 - t
        given = np.stack((gates[index[:, t], :h3], gates[index[:, back], h3:]))
        own = state @ model["recur"]
        zr = 1 / (1 + np.exp(-(given[..., : 2 * HIDDEN] + own[..., : 2 * HIDDEN])))
        z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
        n = np.tanh(given[..., 2 * HIDDEN :] + r * own[..., 2 * HIDDEN :])
        new = n + z * (state - n)
        if not full:
            real = np.stack((mask[:, t], mask[:, back]))[..., None]
            new = np.where(real, new, state)
        if keep is not None:
            keep.append((state, z, r, n, own[..., 2 * HIDDEN :], real))
        state = new
        out[t, :, :HIDDEN], out[back, :, HIDDEN:] = new[0], new[1]
    weight = np.where(mask.T, out @ model["attend"], -1e9)
    weight = np.exp(weight - weight.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = (weight[..., None] * out).sum(axis=0)
    if keep is not None:
        keep.append((out, weight, pooled))
    return pooled @ model["decide"] + model["bias"][0]


def gradients(model: dict, gates: np.ndarray, index: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the mean logistic loss; that of ``gates`` apart."""
    keep: list = []
    logit = forward(model, gates, index, mask, keep)
    out, weight, pooled = keep.pop()
    steps, h3 = index.shape[1], 3 * HIDDEN
    error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels).astype(np.float32) / len(labels)
    g = {"decide": pooled.T @ error, "bias": np.array([error.sum()], np.float32)}
    d_pooled = error[:, None] * model["decide"]
    d_weight = (out * d_pooled).sum(axis=2)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    g["attend"] = np.einsum("tbh,tb->h", out, d_score)
    d_out = weight[..., None] * d_pooled + d_score[..., None] * model["attend"]
    g["recur"] = np.zeros_like(model["recur"])
    d_gates = np.zeros_like(gates)
    d_state = np.zeros((2, len(index), HIDDEN), np.float32)
    for t in reversed(range(steps)):
        back = steps - 1 - t
        state, z, r, n, own, real = keep[t]
        d = d_state + np.stack((d_out[t, :, :HIDDEN], d_out[back, :, HIDDEN:]))
        live = np.where(real, d, 0)
        d_n = live * (1 - z) * (1 - n * n)
        d_z = live * (state - n) * z * (1 - z)
        d_r = d_n * own * r * (1 - r)
        d_own = np.concatenate((d_z, d_r, d_n * r), axis=2)
        d_given = np.concatenate((d_z, d_r, d_n), axis=2)
        g["recur"] += state.transpose(0, 2, 1) @ d_own
        d_state = np.where(real, live * z, d) + d_own @ model["recur"].transpose(0, 2, 1)
        np.add.at(d_gates[:, :h3], index[:, t], d_given[0])
        np.add.at(d_gates[:, h3:], index[:, back], d_given[1])
    return g, d_gates


def start(chance) -> dict:
    def small(*shape, scale=0.1):
        return (chance.standard_normal(shape) * scale).astype(np.float32)

    return {
        "words": small(WORDS, EMBEDDING), "grams": small(GRAMS, EMBEDDING, scale=0.3),
        "input": small(2 * EMBEDDING, 6 * HIDDEN, scale=0.4), "shift": np.zeros(6 * HIDDEN, np.float32),
        "recur": small(2, HIDDEN, 3 * HIDDEN, scale=0.3), "attend": small(2 * HIDDEN), "decide": small(2 * HIDDEN, scale=0.5), "bias": np.zeros(1, np.float32),
    }


def scores_of(model: dict, gates: np.ndarray, sequence: np.ndarray, first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Logits of windows of ``sequence`` (rows of ``gates``)."""
    logits = np.empty(len(first), np.float32)
    for alike in (np.flatnonzero(many == WINDOW), np.flatnonzero(many < WINDOW)):  # full ones need no mask
        for at in range(0, len(alike), TOGETHER):
            own = alike[at : at + TOGETHER]
            logits[own] = forward(model, gates, *taken(sequence, first[own], many[own]))
    return logits


def taken(sequence: np.ndarray, first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.arange(WINDOW)
    mask = step < many[:, None]
    return sequence[np.where(mask, first[:, None] + step, first[:, None])], mask


def fit(texts: list[str], labels: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01) -> dict:
    """With one class or none, every score is the share of label 1 (a half without rows)."""
    chance = np.random.default_rng(5)
    model = start(chance)
    share = float(labels.mean()) if len(labels) else 0.5
    if len(set(labels.tolist())) < 2:
        return {**model, "decide": model["decide"] * 0, "bias": np.array([np.log((share + 1e-6) / (1 - share + 1e-6))], np.float32)}
    number = Numbers()
    parts = [np.fromiter(map(number.__getitem__, (t or "").encode("utf-8", "replace").split()), np.int64) for t in texts]
    counts = np.array([len(p) for p in parts])
    sequence = np.concatenate(parts)
    word, grams, edges = inputs_of(list(number), Hasher())
    text, first, many = windows_of(counts)
    firsts = np.searchsorted(text, np.arange(len(texts) + 1))
    usable = np.flatnonzero(counts > 0)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    # Both classes weigh the same: the rarer one is drawn more often.
    rare = int(2 * labels[usable].sum() < len(usable))
    scarce, other = usable[labels[usable] == rare], usable[labels[usable] != rare]
    step = 0
    for epoch in range(epochs):
        if epoch < 2:
            worst = firsts[:-1] + (chance.random(len(texts)) * np.diff(firsts)).astype(int)
        else:
            gates = embedded(model, word, grams, edges) @ model["input"] + model["shift"]
            logits = scores_of(model, gates, sequence, first, many)
            del gates
            worst = np.zeros(len(texts), int)
            for i in usable.tolist():
                worst[i] = firsts[i] + int(logits[firsts[i] : firsts[i + 1]].argmax())
        drawn = np.concatenate((other, scarce, chance.choice(scarce, max(0, min(len(other), 3 * len(scarce)) - len(scarce)))))
        chance.shuffle(drawn)
        for at in range(0, len(drawn), batch):
            rows = drawn[at : at + batch]
            index, mask = taken(sequence, first[worst[rows]], many[worst[rows]])
            seen, local = np.unique(index, return_inverse=True)
            own = np.concatenate([np.arange(edges[i], edges[i + 1]) for i in seen.tolist()])
            own_edges = np.concatenate(([0], np.cumsum(edges[seen + 1] - edges[seen])))
            x = embedded(model, word[seen], grams[own], own_edges)
            gates = x @ model["input"] + model["shift"]
            g, d_gates = gradients(model, gates, local.reshape(index.shape), mask, labels[rows])
            g["input"], g["shift"] = x.T @ d_gates, d_gates.sum(axis=0)
            d_x = d_gates @ model["input"].T
            g["words"], g["grams"] = np.zeros_like(model["words"]), np.zeros_like(model["grams"])
            np.add.at(g["words"], word[seen], d_x[:, :EMBEDDING])
            lengths = np.diff(own_edges)
            np.add.at(g["grams"], grams[own], np.repeat(d_x[:, EMBEDDING:] / np.maximum(lengths, 1)[:, None], lengths, axis=0))
            step += 1
            for k, v in g.items():
                m, s = moments[k]
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                model[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> dict:
    """Fit on ``docs(doc_id, text)`` and ``labels(doc_id, <label>)``; the bounded sample goes to the driver."""
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(training_rows(labels, label, sample)), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .collect()
    )
    return fit([r.text for r in rows], np.array([r.label for r in rows], np.float32))


def _scorer(shared, names: list[str], text_col: str, schema: pa.Schema):
    def run(batches):
        model, hasher = shared.value, Hasher()
        number, gates = Numbers(), np.zeros((0, 6 * HIDDEN), np.float32)
        for batch in batches:
            column = batch.column(text_col)
            scores = []
            for a, b in slices(utf8(column)[1], BLOCK):
                if len(number) > REMEMBERED:
                    number, gates = Numbers(), gates[:0]
                get = number.__getitem__
                parts = [np.fromiter(map(get, (t or "").encode("utf-8", "replace").split()), np.int64) for t in column.slice(a, b - a).to_pylist()]
                new = list(number)[len(gates) :]
                if new:
                    gates = np.concatenate((gates, embedded(model, *inputs_of(new, hasher)) @ model["input"] + model["shift"]))
                text, first, many = windows_of(np.array([len(p) for p in parts]))
                logits = np.full(len(parts), -np.inf)
                np.maximum.at(logits, text, scores_of(model, gates, np.concatenate(parts), first, many))
                logits[~np.isfinite(logits)] = model["bias"][0]  # no words, no windows
                scores.append(1 / (1 + np.exp(-np.clip(logits, -30, 30))))
            values = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(values)], schema=schema)

    return run


def score(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``, the probability of label 1 of the worst window.

    Null texts and texts without words have no window and get the network's bias.
    """
    docs = docs.drop(score_col)
    out = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_scorer(shared, docs.columns, text_col, to_arrow_schema(out)), out)


ship_with_tasks(__name__)
