import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import substring
from quire.llm.common import Hasher, words_of

from .fixtures import documents, prose

W = substring.WINDOW


def brute(rows):
    """Words, words removed and kept words of each row, by definition."""
    words = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in words:
        for k in range(len(w) - W + 1) if i is not None else ():
            key = tuple(w[k : k + W])
            least[key] = min(least.get(key, i), i)
    result = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - W + 1) if i is not None else ():
            if least[tuple(w[k : k + W])] < i:
                gone[k : k + W] = [True] * W
        result.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return result


def test_against_brute_force(spark):
    shared, line = prose(1, 60), prose(2, 13)
    rows = [
        (5, shared), (3, prose(3, 20) + "\n" + shared + "\t" + prose(4, 9)), (9, line), (8, line + "  " + line), (7, line.replace(" ", " ")),
        (2, None), (1, ""), (4, "a b"), (3, prose(3, 20)), (10, prose(5, 30_000)), (11, prose(5, 30_000)[500:]), (None, shared),
        (12, "same " * 400), (13, "same " * 200 + "end"), (6, shared), (6, shared),
    ]
    rows += [(100 + k, f"{prose(k, 12)} {shared} {prose(k + 50, 5)}") for k in range(300)]
    found = [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in substring.deduplicated(documents(spark, rows)).collect()]
    assert sorted(found, key=repr) == sorted(brute(rows), key=repr)
    assert substring.deduplicated(documents(spark, rows).limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"cc"]), min_size=W, max_size=40), min_size=1, max_size=6))
def test_every_window_is_in_one_string(texts):
    data = np.frombuffer(b"\n".join(b" ".join(t) for t in texts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(b" ".join(t)) + 1 for t in texts])))
    offsets[-1] -= 1
    packed, starts, ends, first = words_of(data, offsets)
    words = Hasher().spans(packed, starts, ends)
    value, begin, end = substring.super_kmers(words, first, W, substring.MINIMISER)
    covered = [k for a, b in zip(begin, end, strict=True) for k in range(a, b - W + 1)]
    assert sorted(covered) == [first[i] + k for i, t in enumerate(texts) for k in range(len(t) - W + 1)]


def test_equal_hashes_of_different_words():
    class Same(Hasher):
        def spans(self, data, starts, ends):
            return np.zeros(len(starts), np.uint64)

    strings = [" ".join(f"{x}{k}" for k in range(W)).encode() for x in "abab"]
    string, place = substring.repeated_windows(strings, np.array([1, 2, 3, 2]), Same())
    assert (string.tolist(), place.tolist()) == ([2], [0])


def test_digest_of_a_known_row(spark):
    row = substring.deduplicated(documents(spark, [(1, "x  y\nz")])).first()
    assert hashlib.sha256(bytes(row.kept)).hexdigest() == hashlib.sha256(b"x y z").hexdigest()
