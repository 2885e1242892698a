"""Benchmark decontamination: q-gram lemma filtering and banded alignment.

Texts and items are brought to lower-case letters and digits with single spaces. A place of a text that
is within ``k`` edits of an item of ``m`` characters shares at least ``m - q + 1 - k * q`` q-grams with it
on ``k + 1`` neighbouring diagonals (place in the text less place in the item). Diagonals are cut into
bands of ``2 * (k + 1)`` that overlap by half, so such a place lies in one band. Shared q-grams are counted
per item and band; bands that reach the bound are verified by an alignment confined to the band, which
items that begin alike share as far as they do. Near short items a piece must begin and end where words do;
items too short for the lemma must stand in a text word for word: runs of as many words are looked up by their hash.

Items are the side that is broadcast, in blocks of at most ``ITEM_CHARS`` characters; documents stay where
they are, and every block sees every whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.llm.common import Hasher, slices, tidied, utf8
from quire.session import ship_with_tasks

#: Length of a q-gram in characters.
GRAM = 8
#: Edits allowed for each character of an item.
EDITS = 0.1
#: Pieces that come near shorter items (after normalization) must begin and end where words do.
SHORTEST = 40
#: From here on the lemma bounds at least one edit; shorter items must be held word for word.
BOUNDED = 2 * GRAM
#: Postings that are expanded at a time, about, and cells of a state of the alignment.
POSTINGS, CELLS = 1 << 20, 1 << 16
#: Characters of items that are broadcast at a time.
ITEM_CHARS = 8 << 20
#: Bytes of text that are looked through at a time.
PART = 1 << 20
#: Bits of the first look-up.
SIEVE = 22

#: Code points of scripts that put no space between words; each is a word of its own.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))

HITS = "array<struct<item_id:bigint,start:bigint,end:bigint,edits:int>>"


def letters() -> np.ndarray:
    """Whether a code point is a letter or digit."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def normal(text: str, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normal form (zero stands for itself) and their places in the lower-cased text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    word = kept[points]
    gap = ~word & (points != 0)
    after_word = np.concatenate(([False], word[:-1])) if len(word) else word
    place = np.flatnonzero(~gap | after_word)
    return np.where(word[place] | (points[place] == 0), points[place], 32).astype(np.uint32), place


def grams(points: np.ndarray, size: int = GRAM) -> np.ndarray:
    """32-bit hash of the q-gram that begins at each place."""
    count = max(len(points) - size + 1, 0)
    total = np.zeros(count, np.uint32)
    for k in range(size):
        total *= np.uint32(0x01000193)
        total += points[k : k + count]
    total ^= total >> np.uint32(15)
    total *= np.uint32(0x85EBCA6B)
    return total ^ (total >> np.uint32(13))


def words_in(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a normal form begins and ends."""
    letter = (points != 32) & (points != 0)
    alone = np.zeros(len(points), bool)
    for low, high in UNSPACED:
        alone |= (points >= low) & (points <= high)
    edge = np.ones(len(points) + 1, bool)
    edge[1:-1] = ~letter[:-1] | ~letter[1:] | alone[:-1] | alone[1:]
    return np.flatnonzero(letter & edge[:-1]), np.flatnonzero(letter & edge[1:]) + 1


def runs_of(forms: list[np.ndarray]) -> dict[int, tuple[np.ndarray, list[np.ndarray], list[list[int]]]]:
    """Short forms by their number of words: sorted hashes, the forms, and the numbers of each one's items."""
    numbers: dict[bytes, list[int]] = {}
    for number, form in enumerate(forms):
        numbers.setdefault(form.tobytes(), []).append(number)
    hasher, by = Hasher(), {}
    for key, own in numbers.items():
        form = np.frombuffer(key, np.uint32)
        value = hasher.spans(form, np.array([0]), np.array([len(form)]))[0]
        by.setdefault(len(words_in(form)[0]), []).append((value, form, own))
    return {n: (np.array([x[0] for x in own], np.uint64), [x[1] for x in own], [x[2] for x in own]) for n, own in ((n, sorted(x, key=lambda y: y[0])) for n, x in by.items())}


def index_of(items: list[tuple[int, str]], rate: float, shortest: int = 1) -> dict:
    """Items in normal form, with a q-gram index: sorted hashes and their (item, place) lists; short items apart."""
    kept = letters()
    ids, forms, short_ids, short = [], [], [], []
    for item_id, text in items:
        form = normal((text or "").replace("\0", " "), kept)[0]
        form = form[:-1] if len(form) and form[-1] == 32 else form
        if len(form) >= max(BOUNDED, shortest):
            ids.append(item_id)
            forms.append(form)
        elif len(form) >= max(shortest, 1):
            short_ids.append(item_id)
            short.append(form)
    size = np.array([len(f) for f in forms], np.int64)
    # As many edits as the lemma still bounds by one shared q-gram.
    edits = np.minimum((size * rate + 1e-9).astype(np.int64), (size - GRAM) // GRAM)
    hashes = [grams(f) for f in forms]
    key = np.concatenate(hashes) if forms else np.zeros(0, np.uint32)
    item = np.repeat(np.arange(len(forms)), [len(h) for h in hashes])
    place = np.concatenate([np.arange(len(h)) for h in hashes]) if forms else np.zeros(0, np.int64)
    order = np.argsort(key, kind="stable")
    values, first = np.unique(key[order], return_index=True)
    rank = np.empty(len(forms), np.int64)
    rank[sorted(range(len(forms)), key=lambda n: forms[n].astype(">u4").tobytes())] = np.arange(len(forms))
    sieve = np.zeros(1 << SIEVE, bool)
    sieve[values >> np.uint32(32 - SIEVE)] = True
    return {
        "kept": kept, "ids": ids + short_ids, "runs": runs_of(short), "forms": forms, "size": size, "edits": edits,
        "bound": size - GRAM + 1 - edits * GRAM, "order": rank, "values": values, "first": np.append(first, len(key)),
        "item": item[order], "place": place[order], "sieve": sieve, "longest": int(size.max()) if forms else 0,
    }


def candidates(points: np.ndarray, index: dict):
    """Item and band of every place that reaches its item's bound, in pieces.

    Postings are expanded along the text, about ``POSTINGS`` at a time; what lies at the end of a piece
    goes on to the next one, as its band may be met there again.
    """
    hashes = grams(points)
    at = np.flatnonzero(index["sieve"][hashes >> np.uint32(32 - SIEVE)])
    row = np.searchsorted(index["values"], hashes[at])
    row = np.minimum(row, max(len(index["values"]) - 1, 0))
    same = index["values"][row] == hashes[at] if len(index["values"]) else np.zeros(0, bool)
    at, row = at[same], row[same]
    many = index["first"][row + 1] - index["first"][row]
    span = np.int64(len(points) + 2 * index["longest"] + 2)
    key = count = np.zeros(0, np.int64)
    for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(many) // POSTINGS)) + 1):
        if not len(part):
            continue
        own, total = many[part], np.cumsum(many[part])
        entry = np.arange(int(total[-1])) - np.repeat(total - own - index["first"][row[part]], own)
        item = index["item"][entry]
        diagonal = np.repeat(at[part], own) - index["place"][entry] + index["longest"]  # not below zero
        band = diagonal // (index["edits"][item] + 1)
        fresh, times = np.unique(np.concatenate((item * span + band + 1, item * span + band)), return_counts=True)
        key, place = np.unique(np.concatenate((key, fresh)), return_inverse=True)
        count = np.bincount(place, np.concatenate((count, times)), len(key)).astype(np.int64)
        item, band = key // span, key % span - 1
        if part[-1] + 1 < len(at):  # a band is over when its last diagonal's last q-gram is
            over = (band + 2) * (index["edits"][item] + 1) - index["longest"] + index["size"][item] < at[part[-1] + 1]
        else:
            over = np.ones(len(key), bool)
        reached = over & (count >= index["bound"][item])
        if reached.any():
            yield item[reached], band[reached]
        key, count = key[~over], count[~over]


class Alignment:
    """Least edits of items against pieces of a text, confined to bands; items of one number of edits.

    A place is a band and the text it lies in, and a piece stays between that text's ``first`` and ``last``
    letter; with ``whole`` it begins and ends where words do. The state has a row per place and a cell per
    diagonal of its band, edits and begin of the piece in one number, so that a minimum takes both along.
    It goes on letter by letter of an item, for all places at once, and only the places that can still do with
    the edits go on. Items that begin alike share the rows of what they have in common.
    """

    UNIT = np.int64(1) << 40

    def __init__(self, points: np.ndarray, edits: int, shift: int, first: np.ndarray, last: np.ndarray, whole: bool = False) -> None:
        self.text, self.edits, self.shift, self.first, self.last = np.append(points, 0), edits, shift, first, last
        self.cell = np.arange(2 * (edits + 1))
        self.wall = (edits + 1) * self.UNIT
        self.opens = self.closes = None
        if whole:
            self.opens, self.closes = np.zeros(len(self.text), bool), np.zeros(len(self.text), bool)
            starts, stops = words_in(points)
            self.opens[starts] = True
            self.closes[stops] = True

    def _column(self, places: np.ndarray) -> np.ndarray:
        return (places // len(self.first) * (self.edits + 1) - self.shift)[:, None] + self.cell

    def _bounds(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = places % len(self.first)
        return self.first[own][:, None], self.last[own][:, None]

    def begun(self, places: np.ndarray) -> np.ndarray:
        column, (first, last) = self._column(places), self._bounds(places)
        good = (column >= first) & (column <= last)
        state = np.where(good, np.clip(column, 0, self.UNIT - 1), self.wall)
        if self.opens is None:
            return state
        # A piece that has to begin here may have letters before the item's first one.
        state = np.where(self.opens[np.where(good, column, len(self.text) - 1)], state, self.wall)
        gap = self.cell * self.UNIT
        return np.where(good, np.minimum.accumulate(state - gap, axis=1) + gap, self.wall)

    def advanced(self, places: np.ndarray, state: np.ndarray, letters_: np.ndarray, done: int) -> tuple[np.ndarray, np.ndarray]:
        """Places that go on, and their state behind the next letters of an item; ``done`` are behind it already."""
        column, (first, last) = self._column(places), self._bounds(places)
        gap = self.cell * self.UNIT
        for i, letter in enumerate(letters_.tolist(), done):
            at = column + i  # the text letter that this row takes on its diagonal
            inside = at < last
            real = (at >= first) & inside
            same = self.text[np.where(real, at, len(self.text) - 1)] == letter
            take = np.where(real, state + np.where(same, 0, self.UNIT), self.wall)
            leave = np.full_like(state, self.wall + self.UNIT)
            leave[:, :-1] = state[:, 1:] + self.UNIT
            state = np.minimum.accumulate(np.minimum(take, leave) - gap, axis=1) + gap
            state = np.where(inside, state, leave)  # nothing behind the last letter is taken
            if i % 4 == 3:
                live = (state < self.wall).any(axis=1)
                if not live.all():
                    places, state, column, first, last = places[live], state[live], column[live], first[live], last[live]
                    if not len(places):
                        break
        return places, state

    def ended(self, places: np.ndarray, state: np.ndarray, size: int):
        """Places, edits, begin and end of the pieces that an item of ``size`` letters is near to."""
        end = self._column(places) + size
        if self.closes is not None:
            inside = (end >= 0) & (end < len(self.text))
            state = np.where(inside & self.closes[np.where(inside, end, 0)], state, self.wall)
        best = state.argmin(axis=1)
        line = np.arange(len(places))
        value, end = state[line, best], end[line, best]
        near = value < self.wall
        return places[near], value[near] // self.UNIT, value[near] % self.UNIT, end[near]

    def of(self, forms: list[np.ndarray], places: list[np.ndarray]):
        """For forms in order and the sorted places of each: number of a form, and what ``ended`` says."""
        every = np.unique(np.concatenate(places))
        share = max(CELLS // len(self.cell), 1)
        for begin in range(0, len(every), share):
            part = every[begin : begin + share]
            own = [x[np.searchsorted(x, part[0]) : np.searchsorted(x, part[-1], "right")] for x in places]
            at = [i for i, x in enumerate(own) if len(x)]
            yield from self._walk([(i, forms[i], own[i]) for i in at], part)

    def _walk(self, forms: list[tuple[int, np.ndarray, np.ndarray]], places: np.ndarray):
        waiting = [(forms, 0, places, self.begun(places))]
        while waiting:
            forms, done, places, state = waiting.pop()
            while forms and len(places):
                number, form, own = forms[0]
                if len(form) == done:
                    mine = np.isin(places, own, assume_unique=True)
                    yield number, *self.ended(places[mine], state[mine], done)
                    forms = forms[1:]
                    continue
                other = forms[-1][1]
                both = min(len(form), len(other))
                differ = np.flatnonzero(form[done:both] != other[done:both])
                common = done + int(differ[0]) if len(differ) else both
                if common > done:
                    places, state = self.advanced(places, state, form[done:common], done)
                    done = common
                    continue
                letter = np.array([f[done] for _, f, _ in forms])
                edges = [0, *(np.flatnonzero(np.diff(letter.astype(np.int64))) + 1).tolist(), len(forms)]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    mine = np.isin(places, np.concatenate([x for _, _, x in forms[a:b]]))
                    if mine.any():
                        waiting.append((forms[a:b], done, places[mine], state[mine]))
                break


def placed(bands: np.ndarray, size: int, edits: int, shift: int, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bands, and texts of which a band covers enough letters for an item of ``size``."""
    # Texts that are too short are left out first, so a band meets few of the others.
    long = np.flatnonzero(ends - starts >= size - edits)
    low = bands * (edits + 1) - shift
    high = low + 2 * (edits + 1) - 1 + size
    begin = np.searchsorted(ends[long], low + size - edits)
    many = np.maximum(np.searchsorted(starts[long], high - size + edits, "right") - begin, 0)
    pair = np.repeat(begin, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(bands, many), long[pair]


def near(points: np.ndarray, index: dict, item: np.ndarray, band: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Text, item, edits, begin and end for the candidates that are near enough; items in order of their letters."""
    order = np.argsort(item, kind="stable")
    item, band = item[order], band[order]
    head = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1])))
    groups: dict[tuple[int, bool], list] = {}
    for number, bands in zip(item[head].tolist(), np.split(band, head[1:]), strict=True):
        size, edits = int(index["size"][number]), int(index["edits"][number])
        bands, owner = placed(bands, size, edits, index["longest"], starts, ends)
        if len(bands):
            groups.setdefault((edits, size < SHORTEST), []).append((int(index["order"][number]), number, np.unique(bands * len(starts) + owner)))
    for (edits, whole), own in groups.items():
        own.sort(key=lambda x: x[0])
        _, numbers, places = zip(*own, strict=True)
        alignment = Alignment(points, edits, index["longest"], starts, ends, whole)
        for k, *where in alignment.of([index["forms"][n] for n in numbers], list(places)):
            for place, e, begin, end in zip(*(x.tolist() for x in where), strict=True):
                yield place % len(starts), numbers[k], e, begin, end


def exact(points: np.ndarray, runs: dict, ends: np.ndarray):
    """Text, item, begin and end of each text's first copy of a short item; items are numbered from 0."""
    if not runs:
        return
    hasher, (starts, stops) = Hasher(), words_in(points)
    for words, (values, forms, numbers) in runs.items():
        begin = starts[: max(len(starts) - words + 1, 0)]
        hashes = hasher.spans(points, begin, stops[words - 1 :])
        row = np.minimum(np.searchsorted(values, hashes), len(values) - 1)
        same = np.flatnonzero(values[row] == hashes)
        same = same[np.argsort(row[same], kind="stable")]
        for part in np.split(same, np.flatnonzero(np.diff(row[same])) + 1) if len(same) else []:
            # Forms of one hash stand side by side.
            for k in range(int(row[part[0]]), int(np.searchsorted(values, hashes[part[0]], "right"))):
                at = begin[part][begin[part] + len(forms[k]) <= len(points)]
                at = at[(points[at[:, None] + np.arange(len(forms[k]))] == forms[k]).all(axis=1)]
                text, head = np.unique(np.searchsorted(ends, at), return_index=True)
                for own, low in zip(text.tolist(), at[head].tolist(), strict=True):
                    yield from ((own, number, low, low + len(forms[k])) for number in numbers[k])


def found(texts: list[str], index: dict) -> list[list[dict]]:
    """For each text, the items it holds: the place of fewest edits, the first of equals."""
    result: list[list[dict]] = [[] for _ in texts]
    if not index["ids"]:
        return result
    # Texts are kept apart by zeros, which no item has.
    whole = "\0".join(t.replace("\0", " ") for t in texts) + "\0"
    points, place = normal(whole, index["kept"])
    ends = np.flatnonzero(points == 0)
    starts = np.concatenate(([0], ends[:-1] + 1))
    best: dict[tuple[int, int], tuple] = {}
    for item, band in candidates(points, index):
        for text, number, *where in near(points, index, item, band, starts, ends):
            best[text, number] = min(best.get((text, number), tuple(where)), tuple(where))
    for text, number, begin, end in exact(points, index["runs"], ends):
        best[text, len(index["forms"]) + number] = (0, begin, end)
    for (text, number), (e, begin, end) in best.items():
        base = int(place[ends[text - 1]]) + 1 if text else 0
        result[text].append({"item_id": index["ids"][number], "start": int(place[begin]) - base, "end": int(place[end - 1]) + 1 - base, "edits": int(e)})
    for hits in result:
        hits.sort(key=lambda h: (h["item_id"], h["start"]))
    return result


def _marker(index, names: list[str], text_col: str, hits_col: str, schema: pa.Schema, first: bool):
    def run(batches):
        own = index.value
        for batch in batches:
            column = batch.column(text_col)
            for a, b in slices(utf8(column)[1], PART):
                part = batch.slice(a, b - a)
                hits = found([t or "" for t in part.column(text_col).to_pylist()], own)
                if not first:
                    hits = [x + y for x, y in zip(part.column(hits_col).to_pylist(), hits, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(hits, schema.field(hits_col).type)], schema=schema)

    return run


def marked(docs: DataFrame, benchmark: DataFrame, rate: float = EDITS, text_col: str = "text", hits_col: str = "contamination", shortest: int = 1) -> DataFrame:
    """``docs`` with ``hits_col``: the items of ``benchmark(item_id, text)`` that a text holds.

    A hit has ``item_id``, ``start`` and ``end`` in code points of the lower-cased text, and ``edits``,
    at most ``rate`` times the item's length and what the lemma bounds (an eighth of it, less one). Pieces near
    items below ``SHORTEST`` begin and end where words do; items below ``BOUNDED`` are held word for word;
    those below ``shortest`` letters are not looked for. Null texts hold nothing; null
    items are found nowhere; repeated items give a hit each. Rows are kept as they are.
    """
    docs = docs.drop(hits_col)
    items = benchmark.select("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(chars // ITEM_CHARS) + 1
    out = T.StructType([*docs.schema.fields, T.StructField(hits_col, T._parse_datatype_string(HITS))])
    names, result = docs.columns, docs
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        index = index_of([(r.item_id, r.text) for r in own.orderBy("item_id", "text").collect()], rate, shortest)
        shared = docs.sparkSession.sparkContext.broadcast(index)
        result = result.mapInArrow(tidied(_marker(shared, names, text_col, hits_col, to_arrow_schema(out), block == 0)), out)
    return result


def contaminations(docs: DataFrame, benchmark: DataFrame, rate: float = EDITS) -> DataFrame:
    """``(doc_id, item_id, start, end, edits)``: a row for each item that a document holds."""
    rows = marked(docs.select("doc_id", "text"), benchmark, rate).select("doc_id", F.explode("contamination").alias("hit"))
    return rows.select("doc_id", "hit.item_id", "hit.start", "hit.end", "hit.edits")


def decontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = EDITS) -> DataFrame:
    """``docs`` without the rows whose text holds an item."""
    return marked(docs, benchmark, rate, hits_col="__hits").filter(F.size("__hits") == 0).drop("__hits")


ship_with_tasks(__name__)
