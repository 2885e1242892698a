import base64
import random

import public_tokenizers
import pytest
import tiktoken

from quire.llm import bpe

from .fixtures import documents, prose

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(texts):
    encoder = bpe.Encoder(bpe.Ranks.of(bpe.read_ranks(PATH)), bpe.explicit(public_tokenizers.PATTERN))
    numbered = encoder.numbered(texts)
    encoder.learn()
    ids, counts = encoder.ids_of(*numbered)
    ends = counts.cumsum().tolist()
    return [ids[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)]


def test_as_the_library_on_hard_texts(library):
    chance = random.Random(3)
    letters = " \n\t    abAB'sré12!=#$é日本\U0001f600̀\r "
    texts = ["".join(chance.choice(letters) for _ in range(chance.randrange(60))) for _ in range(4000)]
    texts += ["a" * 3000, " " * 2000, "=" * 999, " \n \n x", "", " ", "  ", " a", "a ", "a  b", "\n a", "'s 's", "don't I'll", "<|endoftext|>"]
    pieces = ["the", "ing", " ", "tion", "aaa", "  ", "\n", "==", "ab", "rese", "ent"]
    texts += ["".join(chance.choice(pieces) for _ in range(chance.randrange(40))) for _ in range(2000)]
    assert encoded(texts) == [library.encode_ordinary(t) for t in texts]


def test_every_code_point_as_the_library(library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"{c}a1 {c} " for c in points[k : k + 256]) for k in range(0, len(points), 256)]
    assert encoded(texts) == [library.encode_ordinary(t) for t in texts]


def test_merges_that_lead_back_to_lower_ranks():
    # "abc" is cheaper than "ab", which leads to it; the second pair of the word has to wait.
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"ab": 257, b"ca": 258}
    by_library = tiktoken.Encoding("tiny", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    words = [w.encode() for w in ("abcab", "ababc", "abcabcab", "cabca", "aabb")]
    ids, edges = bpe.replay(bpe.Ranks.of(ranks), words)
    assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)] == [by_library.encode_ordinary(w.decode()) for w in words]


def test_table_round_trip(spark, library):
    rows = [(1, "Hello there"), (2, None), (3, ""), (1, "Hello there"), (4, prose(1, 30_000)), (None, "x  y")]
    docs = documents(spark, rows)
    back = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert back.columns == [*docs.columns, "token_ids", "decoded"]
    found = [(r.doc_id, r.text, list(r.token_ids), bytes(r.decoded)) for r in back.collect()]
    expected = [(i, t, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert bpe.encode(docs.limit(0), PATH).count() == 0
