import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quire.llm import alignment
from quire.llm.queries import op12_tokenizer_alignment
from quire.llm.vocabulary import alphabet, ranks_of, read

from .fixtures import documents, prose

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """Whole texts by the libraries, all pairs of tokens compared."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    byte = alphabet()

    def bytes_of(piece):
        return bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") and len(piece) == 6 else piece.replace("\u2581", " ").encode()

    def run(rows):
        out, total = [], Counter()
        for name, text in rows:
            x = a.encode(" " + text, add_special_tokens=False) if text else None
            y = b.encode(text) if text else []
            left = [bytes(byte[c] for c in t) for t in x.tokens] if text else []
            right = [bytes_of(b.id_to_piece(i)) for i in y]
            if not text or b"".join(left) != (" " + text).encode() or b"".join(right) != (" " + text).encode():
                out.append((name, 0, 0, 0, [], ""))
                continue
            spans = []
            for parts in (left, right):
                at, found = 0, []
                for part in parts:
                    found.append((at, at + len(part)))
                    at += len(part)
                spans.append(found)
            cut = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
            groups = []
            for low, high in zip([0, *cut], cut, strict=False):
                groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, some, strict=True) if low <= s and e <= high) for ids, some in zip((x.ids, y), spans, strict=True)))
            linked = [(x.ids[i], y[j]) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if s < f and t < e]
            total.update(linked)
            out.append((name, len(left), len(right), len(groups), linked, ";".join(groups)))
        best = {}
        for (_, y), n in total.items():
            best[y] = max(best.get(y, 0), n)
        return [(name, n_a, n_b, n, len(linked), sum(total[p] == best[p[1]] for p in linked), sum(total[p] for p in linked), groups) for name, n_a, n_b, n, linked, groups in out]

    return run


def columns(df):
    return [tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()]


def hard_texts(seed, count):
    chance = random.Random(seed)
    letters = " \n\t    abAB'sré12!=#$é日本\U0001f600̀\r \x1c\x85\xa0\u200b\u2581<|>endoftext"
    pieces = ["the", "ing", " ", "tion", "aaa", "  ", "\n", "==", "ab", "rese", " ent", "'s", " é", "\n\n", "<s>", "<0x0A>", "<|endoftext|>", "12", "\r\n"]
    texts = ["".join(chance.choice(letters) for _ in range(chance.randrange(30))) for _ in range(count)]
    return texts + ["".join(chance.choice(pieces) for _ in range(chance.randrange(15))) for _ in range(count)]


def test_special_rows_and_hard_texts_as_by_definition(spark, plain):
    texts = ["Hello there", None, "", "Hello there", "x  y", " a", "a ", "\n", "\na", "a\nb", "a \nb", " \na", "a\n\nb", "\u2581a", "a \u2581 b", "a" * 300, " " * 40, "<s></s><unk>", "\0a \0"]
    texts += [prose(1, 200), *hard_texts(4, 300)]
    rows = [*((k if k % 50 else None, t) for k, t in enumerate(texts)), (3, texts[3]), (3, texts[3])]
    got = columns(alignment.counted(alignment.aligned(documents(spark, rows), A, B)))
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)
    assert alignment.digests(documents(spark, rows).limit(0), A, B).count() == 0


def test_a_very_long_text_and_many_blocks(spark, plain, monkeypatch):
    rows = [(1, prose(2, 4000)), *((k, prose(k % 40, 30)) for k in range(2, 400))]
    docs = documents(spark, rows)
    whole = alignment.counted(alignment.aligned(docs, A, B)).drop("groups")
    few = alignment.counted(alignment.aligned(docs.repartition(40), A, B)).drop("groups")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, few.collect()))
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    assert sorted(tuple(r) for r in whole.filter("doc_id > 1").select(*names[:5]).collect()) == sorted(x[:5] for x in plain(rows[1:]))


def test_words_of_a_text_are_the_text():
    for text in [*hard_texts(5, 3000), "a b\nc", "a", "a  b"]:
        if text:
            assert "".join(map(alignment.spelled, alignment.words_of(text))) == " " + text


def test_fast_ids_as_the_library():
    with open(A, encoding="utf-8") as file, open(B, "rb") as model:
        tokens = read(A)["tokens"]
        aligner = alignment.Aligner((file.read(), *ranks_of(A), [tokens[k] for k in range(len(tokens))], model.read()))
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    chance = random.Random(9)
    some = [*map(chr, range(33, 127)), *map(chr, range(0xC0, 0x180)), *"abcdefghijklmnopqrstuvwxyz" * 12]
    words = ["".join(chance.choice(some) for _ in range(chance.randrange(1, 15))) for _ in range(30_000)]
    words += ["\n" + w for w in words[:3000]]
    assert aligner.ids_a(words)[0] == [x.ids for x in library.encode_batch([alignment.spelled(w) for w in words], add_special_tokens=False)]


def test_query_against_the_definition(spark, small, plain):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").filter("length(text) < 4000").collect()]
    every = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {r.doc_id: r for r in op12_tokenizer_alignment(spark, small).collect()}
    assert sorted(got) == sorted(i for i, _ in every)
    for name, n_a, n_b, n_groups, n_links, *_, groups in plain(rows):
        r = got[name]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (n_a, n_b, n_groups, n_links)
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
    # Counts over the whole corpus: each link adds the count of its pair, so the sums are squares of counts.
    docs = spark.read.parquet(f"{small}/documents.parquet")
    pairs = alignment.pair_counts(alignment.aligned(docs, A, B)).collect()
    assert sum(r.count_sum for r in got.values()) == sum(p.links**2 for p in pairs)
    assert sum(r.n_best for r in got.values()) == sum(p.links for p in pairs if p.best)
