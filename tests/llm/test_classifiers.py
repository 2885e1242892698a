"""Quality and toxicity: held-out accuracy, and the cases every operator has to bear."""

import random
import zlib

import numpy as np
import pytest

from quire.llm import quality, toxicity
from quire.llm.common import Hasher

from .fixtures import documents, prose

BAD = "idiot clown moron trash".split()


def corpus(kind, n=240):
    chance = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words = prose(i, chance.randrange(20, 120)).split()
        label = int(chance.random() < 0.4)
        if kind == "quality" and not label:
            words = [w.upper() + "!!" for w in words]
        if kind == "toxic" and label:
            for _ in range(4):
                words[chance.randrange(len(words))] = chance.choice(BAD) + chance.choice(["", ",", "!"])
        rows.append((i, " ".join(words)))
        labels.append((i, label))
    return rows, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_rows_and_odd_ones(spark, module, label):
    rows, labels = corpus(label)
    odd = [(1000, None), (1001, ""), (1002, " \n"), (1003, prose(1, 20_000)), (1004, "x"), (3, rows[3][1]), (None, "y")]
    docs = documents(spark, rows + odd)
    marks = spark.createDataFrame([*labels, (5, None), (None, 1), (7, 2), labels[9]], f"doc_id long, {label} int")
    model = module.train(docs.select("doc_id", "text"), marks)
    scored = module.score(docs, model)
    assert scored.columns == [*docs.columns, "score"]
    found = [(r.doc_id, r.score) for r in scored.collect()]
    assert len(found) == len(rows) + len(odd) and all(0 <= s <= 1 for _, s in found)
    by_id = dict(found)
    test = [i for i, _ in rows if held(i)]
    right = [(by_id[i] >= 0.5) == dict(labels)[i] for i in test]
    assert sum(right) / len(right) > 0.9
    assert module.score(docs.limit(0), model).count() == 0
    assert by_id[1000] == by_id[1001] == by_id[1002] if module is toxicity else by_id[1000] == by_id[1001]


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_one_class_or_no_labels(spark, module, label):
    docs = documents(spark, [(i, prose(i, 9)) for i in range(6)])
    for labels, low, high in (([], 0.5, 0.5), ([(i, 1) for i in range(6)], 0.99, 1.0)):
        marks = spark.createDataFrame(labels, f"doc_id long, {label} int")
        scores = {r.score for r in module.score(docs, module.train(docs, marks)).collect()}
        assert len(scores) == 1 and low <= scores.pop() <= high


def test_training_takes_no_held_out_row(spark):
    marks = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    ids = [r.doc_id for r in quality.training_rows(marks, "quality", 50).collect()]
    assert len(ids) == 100 and not any(map(held, ids))


def test_gradients_of_the_network():
    chance = np.random.default_rng(1)
    model = {k: v.astype(np.float64) for k, v in toxicity.start(chance).items()}
    gates = chance.standard_normal((7, 6 * toxicity.HIDDEN))
    index = chance.integers(0, 7, (3, 5))
    mask = np.arange(5) < np.array([[5], [3], [1]])
    labels = np.array([1.0, 0.0, 1.0])

    def loss():
        p = toxicity.forward(model, gates, index, mask)
        return float(np.mean(np.logaddexp(0, p) - labels * p))

    g, d_gates = toxicity.gradients(model, gates, index, mask, labels)
    for array, slope in [(gates, d_gates), *((model[k], g[k]) for k in ("recur", "attend", "decide", "bias"))]:
        for at in [tuple(x) for x in chance.integers(0, array.shape, (6, array.ndim))]:
            before = array[at]
            array[at] = before + 1e-3
            up = loss()
            array[at] = before - 1e-3
            down = loss()
            array[at] = before
            assert abs((up - down) / 2e-3 - slope[at]) < 2e-3 * max(1, abs(slope[at])) + 1e-4
    assert d_gates.shape == gates.shape


def test_windows_overlap_and_cover():
    counts = np.array([0, 1, toxicity.WINDOW, toxicity.WINDOW + 1, 200])
    text, first, many = toxicity.windows_of(counts)
    base = np.cumsum(counts) - counts
    for t, n in enumerate(counts.tolist()):
        own = [(f - base[t], m) for x, f, m in zip(text, first, many, strict=True) if x == t]
        assert {k for f, m in own for k in range(f, f + m)} == set(range(n))
        assert all(b[0] < a[0] + a[1] for a, b in zip(own, own[1:], strict=False))


def test_coordinate_descent_separates():
    rows = [np.array([0, 5], np.int32), np.array([1, 5], np.int32)] * 20
    labels = np.array([1, 0] * 20)
    model = quality.fit(rows, labels)
    margin = [model["weights"][r].sum() / 2**0.5 + model["bias"] for r in rows[:2]]
    p = [1 / (1 + np.exp(-(model["slope"] * m + model["shift"]))) for m in margin]
    assert p[0] > 0.5 > p[1]


def test_features_do_not_depend_on_neighbours():
    texts = ["", "so so", "so so so", "x", "so", " ", "so so so so so"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    together = quality.features(data, offsets, Hasher())
    for t, own in zip(texts, together, strict=True):
        alone = quality.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), Hasher())[0]
        assert own.tolist() == alone.tolist()
    assert [2 in x.tolist() for x in together] == [False, True, True, False, False, False, True]
    assert [4 in x.tolist() for x in together] == [False] * 6 + [True]
