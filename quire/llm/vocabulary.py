"""Byte-level vocabularies of the ``tokenizers`` library, and their words encoded many at a time.

The library takes a merge only where its list has that very pair; ``tiktoken`` takes any two tokens whose
joined bytes are a token, lowest rank first, and is several times faster. Both agree on every word if each
token is what the library makes of the token's own bytes: a token that no merge has crossed was made from
its bytes alone, the same way in every word. ``ranks_of`` leaves out the tokens for which that is not so;
the library never makes them. Only words of plain letters, digits and signs go this way; for all others
(``PLAIN`` does not match) the library itself is asked.
"""

from __future__ import annotations

import json
import re

import numpy as np

from quire.session import ship_with_tasks

#: Letters that every Unicode version has, that no normal form changes and that lower-casing keeps single.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
#: What is encoded fast: visible ASCII and these letters.
PLAIN = "!-~À-ÖØ-öø-įı-ſ"


def alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 characters
    for themselves, those after U+00FF for the other bytes in their order."""
    seen = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(hidden)}


def merged(symbols: list[str], order: dict[tuple[str, str], int], last: tuple[str, str]) -> list[str]:
    """What the merges of ``order`` but for ``last`` make of ``symbols``: the lowest first, the leftmost of equals."""
    while len(symbols) > 1:
        pairs = zip(symbols, symbols[1:])
        rank, at = min((len(order) if pair == last else order.get(pair, len(order)), k) for k, pair in enumerate(pairs))
        if rank == len(order):
            break
        symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
    return symbols


def read(path: str) -> dict:
    """The parsed file, its bytes per id and its end-of-word suffix (or the empty text)."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, byte = whole["model"], alphabet()
    suffix = model["end_of_word_suffix"] or ""
    tokens: dict[int, bytes] = {}
    for token, number in model["vocab"].items():
        body = token.removesuffix(suffix) if suffix else token
        tokens[number] = bytes(byte[c] for c in body)
    return {"model": model, "tokens": tokens, "suffix": suffix}


def ranks_of(path: str, end: bytes = b"") -> tuple[dict[bytes, int], np.ndarray]:
    """Ranks for ``tiktoken``, where ``end`` (one byte that no word holds) follows each word in place of
    the suffix; and the id of each rank. Tokens that hold ``end`` otherwise are left out."""
    whole = read(path)
    vocab, suffix = whole["model"]["vocab"], whole["suffix"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in whole["model"]["merges"]]
    order = {pair: k for k, pair in reversed(list(enumerate(pairs)))}
    ranks: dict[bytes, int] = {}
    ids: list[int] = []

    def enter(token: str) -> None:
        body = whole["tokens"][vocab[token]]
        ends = bool(suffix) and token.endswith(suffix)
        if len(body) > 1 and end and end in body:
            return
        key = body + end if ends else body
        if key not in ranks and (len(body) > 1 or not ends or body != end):
            ranks[key] = len(ids)
            ids.append(vocab[token])

    single = sorted(alphabet(), key=lambda c: alphabet()[c])
    for c in single:
        enter(c)
    for c in single:
        if suffix and c + suffix in vocab:
            enter(c + suffix)
    for left, right in pairs:
        token = left + right
        body = token.removesuffix(suffix) if suffix else token
        symbols = list(body)
        if body != token:
            symbols[-1] += suffix
        if merged(symbols, order, (left, right)) == [left, right]:
            enter(token)
    return ranks, np.array(ids, np.int32)


def cut_at(ids: np.ndarray, mark: int) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` without the ``mark`` between neighbours, and where each part begins (one more entry)."""
    marks = np.flatnonzero(ids == mark)
    edges = np.concatenate(([0], marks - np.arange(len(marks)), [len(ids) - len(marks)]))
    return np.delete(ids, marks), edges


def gathered(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], count: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists that lie apart put in one order: each part has places, values and edges of its lists."""
    lengths = np.zeros(count, np.int64)
    for places, _, edges in parts:
        lengths[places] = np.diff(edges)
    to = np.concatenate(([0], np.cumsum(lengths)))
    values = np.zeros(int(to[-1]), np.int32)
    for places, found, edges in parts:
        long = np.diff(edges)
        values[np.arange(len(found)) + np.repeat(to[places] - edges[:-1], long)] = found
    return values, to


def plain(extra: str = "") -> re.Pattern:
    """What a whole text matches that may go the fast way; ``extra`` may stand before it once."""
    return re.compile(f"{extra}[{PLAIN}]+")


ship_with_tasks(__name__)
