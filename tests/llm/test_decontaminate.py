import random
import time

import numpy as np

from quire.llm import decontaminate as D

from .fixtures import documents, prose


def edits(item, text):
    """Least edits of ``item`` against any piece of ``text``."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def changed(text, n, chance):
    text = list(text)
    for _ in range(n):
        at = chance.randrange(len(text))
        kind = chance.randrange(3)
        if kind == 0:
            text[at] = chance.choice("abcxyz")
        elif kind == 1:
            del text[at]
        else:
            text.insert(at, chance.choice("abcxyz"))
    return "".join(text)


def test_against_full_alignment():
    chance = random.Random(5)
    items = [(k, "".join(chance.choice("abcde ") for _ in range(chance.randrange(60, 160))).strip()) for k in range(12)]
    index = D.index_of(items, D.EDITS)
    kept = D.letters()

    def normal(t):
        return "".join(map(chr, D.normal(t, kept)[0])).strip()

    texts = []
    for k in range(80):
        item = chance.choice(items)[1]
        texts.append("".join(chance.choice("abcde ") for _ in range(40)) + changed(item, chance.randrange(22), chance) + "".join(chance.choice("abcde ") for _ in range(30)))
    got = D.found(texts, index)
    for text, hits in zip(texts, got, strict=True):
        found = {h["item_id"]: h["edits"] for h in hits}
        for item_id, item in items:
            form = normal(item)
            if len(form) < D.SHORTEST:
                continue
            true = edits(form, normal(text))
            limit = int(index["edits"][index["ids"].index(item_id)])
            assert (item_id in found) == (true <= limit)
            if item_id in found:
                assert found[item_id] == true


def test_documents(spark):
    passage = "The quick brown fox jumps over the lazy dog while seven wizards brew dark tea."
    shout = passage.upper().replace(" ", "!! ")
    rows = [(1, f"{prose(1, 30)} {passage} {prose(2, 20)}"), (2, shout), (3, prose(3, 4000) + "\n" + passage), (4, passage[:45]), (5, None), (6, ""), (7, prose(4, 50)), (1, passage), (None, passage), (8, "x\0" + passage)]
    bench = spark.createDataFrame([(10, passage), (11, passage), (12, None), (None, passage), (13, "too short"), (14, ""), (15, prose(9, 40))], "item_id long, text string")
    found = sorted(((r.doc_id, r.item_id, r.edits) for r in D.contaminations(documents(spark, rows), bench).collect()), key=repr)
    assert found == sorted([(i, item, 0) for i in (1, 1, 2, 3, 8, None) for item in (10, 11)], key=repr)
    hit = D.contaminations(documents(spark, rows[:1]), bench).first()
    assert rows[0][1].lower()[hit.start : hit.end] == passage.lower()[:-1]
    clean = D.decontaminated(documents(spark, rows), bench)
    assert sorted(r.doc_id for r in clean.collect()) == [4, 5, 6, 7]
    assert clean.columns == documents(spark, rows).columns
    assert D.contaminations(documents(spark, rows), bench.limit(0)).count() == 0
    assert D.contaminations(documents(spark, rows).limit(0), bench).count() == 0


def test_several_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(D, "ITEM_CHARS", 200)
    items = [(k, prose(k, 15)) for k in range(9)]
    docs = documents(spark, [(k, f"{prose(90 + k, 10)} {t}") for k, t in items])
    found = D.contaminations(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(k, k) for k in range(9)]


def test_bands_cover_every_diagonal():
    index = D.index_of([(1, "abcdefghij" * 8)], D.EDITS)
    points = np.frombuffer(("x" * 7 + "abcdefghij" * 8).encode("utf-32-le"), np.uint32)
    [(item, band)] = D.candidates(points, index)
    alignment = D.Alignment(points, int(index["edits"][0]), index["longest"], np.array([0]), np.array([len(points)]))
    found = list(alignment.of(index["forms"], [band]))
    assert len(item) and min(e for _, _, edits, _, _ in found for e in edits.tolist()) == 0


def test_items_cut_at_the_edges_of_a_text():
    chance = random.Random(8)
    item = "".join(chance.choice("abcdefgh ") for _ in range(90)).strip()
    index = D.index_of([(1, item)], D.EDITS)
    form = "".join(map(chr, index["forms"][0]))
    k = int(index["edits"][0])
    other = ["", "zz zz " * 30, "q", form[-12:] + " zz", "zz " + form[:12]]
    cut = [x for n in range(1, k + 1) for x in (form[n:], form[:-n], form[n:] + " zz zz", "zz zz " + form[:-n])]
    cut += [form[k + 2 :], form[: -k - 2]]
    texts = [x for i, c in enumerate(cut) for x in (other[i % 5], c, other[(i * 3 + 1) % 5])] + ["zz"]
    for mine in (texts, cut):
        for text, hits in zip(mine, D.found(mine, index), strict=True):
            true = edits(form, "".join(map(chr, D.normal(text, index["kept"])[0])))
            assert [h["edits"] for h in hits] == ([true] if true <= k else [])
            assert all(0 <= h["start"] < h["end"] <= len(text) for h in hits)


def test_short_items(spark):
    # Below 16 letters word for word; from there on with edits, between edges of words.
    items = [(1, "Name the largest moon."), (2, "two plus two"), (3, "Why?"), (4, "name the LARGEST moon"), (5, "月亮有多远"), (6, "..."), (7, "plus")]
    texts = ["He said: name, the largest moon!", "rename the largest moon", "name the largest moons", "x two plus two plus two", "why", "whyever", "他问月亮有多远。", "name the", "largest moon", "name the largest mon", "two plus to"]
    expected = [[1, 4], [], [1, 4], [2, 7], [3], [], [5], [], [], [1, 4], [7]]
    assert [[h["item_id"] for h in hits] for hits in D.found(texts, D.index_of(items, D.EDITS))] == expected
    assert [[h["item_id"] for h in hits] for hits in D.found(texts, D.index_of(items, D.EDITS, 8))] == [[1, 4], [], [1, 4], [2], [], [], [], [], [], [1, 4], []]
    hit = D.found(["a", "- two  plus two, two plus two"], D.index_of(items[1:2], D.EDITS))[1]
    assert hit == [{"item_id": 2, "start": 2, "end": 15, "edits": 0}]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, list(enumerate(texts)))
    assert sorted(r.doc_id for r in D.decontaminated(docs, bench).collect()) == [k for k, e in enumerate(expected) if not e]


def test_items_below_forty_letters_have_their_edits():
    chance = random.Random(4)
    item = "how many moons has the planet jupiter ?"
    form = "how many moons has the planet jupiter"
    items = [(1, item), (2, "name a large moon"), (3, "name a large moon of the planet mars")]
    index = D.index_of(items, D.EDITS)
    texts = [changed(form, n, chance) for n in (0, 1, 1, 2, 2, 3, 3, 4, 5) for _ in range(6)]
    texts = [f"aa bb {t} cc dd" for t in texts] + ["aa " + form[1:], form + "s", "show many moons has the planet jupiter", form[:-1]]
    k = int(index["edits"][0])
    assert k == 3
    for text, hits in zip(texts, D.found(texts, index), strict=True):
        t = "".join(map(chr, D.normal(text, index["kept"])[0]))
        opens = [i for i, c in enumerate(t) if c != " " and (i == 0 or t[i - 1] == " ")]
        closes = [i + 1 for i, c in enumerate(t) if c != " " and (i + 1 == len(t) or t[i + 1] == " ")]
        true = min(edits_whole(form, t[a:b]) for a in opens for b in closes if a < b)
        assert [h["edits"] for h in hits if h["item_id"] == 1] == ([true] if true <= k else [])
    assert [h["item_id"] for h in D.found(["x nome a large moon y", "name a large moons", "rename a large moon", "ename a large moo"], index)[0]] == [2]
    assert D.found(["rename a large moon thing"], index) == [[]]


def edits_whole(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def test_many_items_of_one_stem(monkeypatch):
    chance = random.Random(6)
    stem = "which of the following statements about the text above is true "
    items = [(k, stem + "".join(chance.choice("abcdefghij ") for _ in range(30)).strip() + "z") for k in range(1500)]
    items += [(1500, stem.strip()), (1501, items[7][1] + " and more of the same to the end")]
    index = D.index_of(items, D.EDITS)
    text = " ".join(stem + prose(k, 20) for k in range(40)) + " " + items[7][1] + " and " + changed(items[9][1], 2, chance)
    begun = time.time()
    hits = {h["item_id"]: h["edits"] for h in D.found([text], index)[0]}
    assert time.time() - begun < 60
    whole = "".join(map(chr, D.normal(text, index["kept"])[0]))
    for number in [7, 9, 1500, 1501, *range(20, 22)]:
        true = edits("".join(map(chr, index["forms"][number])), whole)
        assert hits.get(number) == (true if true <= int(index["edits"][number]) else None)
    # Small pieces of postings and states give the same.
    assert max(len(item) for item, _ in D.candidates(D.normal(text, index["kept"])[0], index)) < 4 * D.POSTINGS
    few = D.index_of([items[k] for k in (7, 9, 11, 1500, 1501)], D.EDITS)
    monkeypatch.setattr(D, "POSTINGS", 50)
    monkeypatch.setattr(D, "CELLS", 100)
    assert {h["item_id"]: h["edits"] for h in D.found([text], few)[0]} == {k: e for k, e in hits.items() if k in (7, 9, 11, 1500, 1501)}
