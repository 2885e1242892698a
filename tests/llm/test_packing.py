import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import packing
from quire.llm.queries import op11_packing
from quire.llm.vocabulary import ranks_of

from .fixtures import documents, prose

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def encoded(texts):
    with open(PATH, encoding="utf-8") as file:
        encoder = packing.Encoder((file.read(), *ranks_of(PATH, b"\n")))
    ids, edges = encoder.encode([t.encode() for t in texts])
    return [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)]


def test_ids_as_the_library_on_hard_texts(library):
    chance = random.Random(1)
    letters = " \n\t    abAB'sré12!=#$é日本\U0001f600̀\r \x1c\x85\xa0İſŉßÇΣςªº<|>endoftext"
    texts = ["".join(chance.choice(letters) for _ in range(chance.randrange(60))) for _ in range(5000)]
    pieces = ["the", "ing", "tion", "aaa", " ", "==", "ab", "rese", "ent", "'s", "'re", "ness", "Ü", "éc", "12", "?!", "<|endoftext|>", "<|startoftext|>"]
    texts += ["".join(chance.choice(pieces) for _ in range(chance.randrange(20))) for _ in range(5000)]
    some = [*map(chr, range(33, 127)), *map(chr, range(0xC0, 0x200)), *"abcdefghijklmnopqrstuvwxyz" * 12]
    texts += ["".join(chance.choice(some) for _ in range(chance.randrange(15))) for _ in range(30_000)]
    texts += ["a" * 3000, "", " ", "=" * 999, "é", "don't I'll"]
    assert encoded(texts) == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_hilbert_neighbours_differ_by_one():
    for n, bits in ((1, 4), (2, 5), (3, 3), (4, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
        key = packing.hilbert(cells, bits)
        assert sorted(key.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def checked(pieces, expected, length=2048):
    """Every id of every document lies in one piece, sequences are gapless, all but the last are full."""
    rows = pieces.collect()
    by_document, by_sequence = {}, {}
    for r in rows:
        by_document.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_document, key=repr) == sorted(expected, key=repr)
    for name, lists in expected.items():
        found = sorted(((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.length, r.doc_tokens) for r in by_document[name]), key=lambda x: x[:2])
        if len(lists) == 1:
            assert [i for _, ids, _, _ in found for i in ids] == lists[0]
            assert [s for s, *_ in found] == np.cumsum([0, *(n for *_, n, _ in found)])[:-1].tolist()
        assert sum(n for *_, n, _ in found) == sum(map(len, lists)) and all(len(ids) == n for _, ids, n, _ in found)
        assert {t for *_, t in found} == {len(x) for x in lists}
    for number, members in by_sequence.items():
        members.sort(key=lambda r: r.offset)
        at = 0
        for r in members:
            assert r.offset == at
            at += r.length
        assert at == length or number == max(by_sequence) and at <= length
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return rows


def test_special_rows(spark, library):
    rows = [(1, "Hello there"), (2, None), (3, ""), (1, "Hello there"), (4, prose(1, 9000)), (None, "x  y"), (5, " \n "), (6, "A" * 20_000), (7, "é́ <|endoftext|>")]
    docs = documents(spark, rows).coalesce(2)
    expected = {}
    for name, text in rows:
        expected.setdefault(name, []).append([*library.encode(text or "", add_special_tokens=False).ids, 1])
    for size in (packing.RANGE, 3000):
        checked(packing.packed(docs, PATH, size=size), expected)
    checked(packing.packed(docs, PATH, length=50, end=49407), {k: [[*x[:-1], 49407] for x in v] for k, v in expected.items()}, 50)
    assert packing.packed(docs.limit(0), PATH).count() == 0
    one = packing.sequences(packing.packed(docs, PATH)).orderBy("sequence_id").collect()
    assert [len(r.ids) // 4 for r in one][:-1] == [2048] * (len(one) - 1) and sum(p.length for r in one for p in r.pieces) == sum(len(x) for v in expected.values() for x in v)


def test_a_hot_group_of_copies_is_cut_into_ranges(spark):
    rows = [(k, "the same words again and again " * 20 if k % 3 == 0 else prose(k, 40)) for k in range(1500)]
    stored, _ = packing.encoded(documents(spark, rows), PATH)
    ranged, before = packing.ranged(stored, 20_000)
    sizes = [r[0] for r in ranged.groupBy("range").agg(F.sum("tokens")).collect()]
    assert len(before) == len(sizes) > 5 and max(sizes) < 2 * 20_000


def test_neighbours_are_alike(spark):
    chance = random.Random(8)
    subjects = [prose(100 + s, 60).split() for s in range(8)]
    rows = [(k, " ".join(chance.choice(subjects[k % 8]) for _ in range(200))) for k in range(800)]
    stored, _ = packing.encoded(documents(spark, rows), PATH)
    order = [r.doc_id % 8 for r in stored.orderBy("place").collect()]
    same = sum(a == b for a, b in zip(order, order[1:], strict=False)) / len(order)
    assert same > 0.5  # an eighth by chance


def test_query_against_the_library(spark, small, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    ids = {k: [*library.encode(t, add_special_tokens=False).ids, 1] for k, t in texts.items()}
    covered = dict.fromkeys(texts, 0)
    filled = {}
    for r in op11_packing(spark, small).collect():
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        covered[r.doc_id] += r.length
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(covered[k] == len(ids[k]) for k in texts)
    for parts in filled.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist()
    assert sum(2048 - sum(n for _, n in p) for p in filled.values()) < 2048
