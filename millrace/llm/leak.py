"""Evaluation items leaking into a corpus: template windows, joined by hash, with consistent slots.

Numbers, units and names become typed placeholders; what is left of a window of words is its template. A word of an item is a name
if the item writes it with a capital within a sentence, or as an identifier; a document's word is one if no item uses it as an
ordinary word. Windows of documents join the items' on the hash of the template and one slot's value, each slot in turn, so that
common templates are split by their slots; then the slots are checked: enough of a window's slots must agree. A window whose template
has no ordinary word must agree in all of them. Pairs with enough agreeing windows are verified by aligning the item with
the document's words: a passage is a dozen or so aligned words whose slots hold the item's values. A question built alike, with
other names and numbers, shares the templates and not the slots. Running words without slots count unless the corpus has their
sentence without the item: then it is a stock instruction.

Which words of an item are slots depends on the item alone, so that its leaks don't depend on what other items there are.
The items' windows are a fixed set held out from training; their number is checked before they are shared with the tasks. A
document's own windows never leave its task unless they match, and no pair is made between documents.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millrace.llm.stuffing import FUNCTION
from millrace.storage import spread, stage

#: Words in a window; template words that a window needs to be joined by single slots.
WINDOW, LEAST_WORDS = 5, 2
#: A passage: aligned words, slots within it, and the share of its slots that must hold the item's values.
PASSAGE, PASSAGE_SLOTS, CONSISTENT = 11, 3, 0.7
#: Running words that are a passage with fewer slots, and words around them in which no slot may differ.
RUNNING, NEARBY = 12, 8
#: A sentence without slots that so many items hold is stock. A name is no slot if that many times more documents have it than an item's rarer names.
SHARED, OFTEN = 3, 4
MOST_ITEM_WINDOWS = 2_000_000
BLOCK_CHARS, BLOCK_MEETINGS = 1_000_000, 200_000
NUMBER, UNIT, NAME = 1, 2, 3
# Units.
UNITS = """percent inch inches foot feet yard yards mile miles mm cm m km g kg mg lb lbs oz ounce ounces pound pounds gram grams kilogram kilograms tonne tonnes litre
litres liter liters ml l second seconds minute minutes hour hours day days week weeks month months year years degree degrees dollar dollars euro euros cent cents
byte bytes kb mb gb watt watts volt volts meter meters metre metres kilometer kilometers kilometre kilometres prozent tage stunden minuten sekunden jahre jours heures
minutes ans días horas minutos años""".split()
_PLAIN = re.compile(r"[a-z0-9]+")
_WORD = re.compile(r"[^\W_]+")
_GONE = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))
_GONE |= {c: None for c in range(0x300, 0x1E000) if unicodedata.combining(chr(c))} | {c: None for c in range(0xFE20, 0xFE30)}
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\[nrt]")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
_GROUPED = re.compile(r"(?<=\d)[,'’ ](?=\d{3}(?!\d))")
_BROKEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n\s*(?=[^\W\d_])")


def words(text: str | None) -> list[str]:
    """Words and numbers in lower case, without accents, mark-up, escapes, soft hyphens, grouped digits and broken lines."""
    if not text:
        return []
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else " ", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "-\n" in text or "- \n" in text or "-\r" in text:
        text = _BROKEN.sub("", text)
    if text.isascii():
        text = text.lower()
        return _PLAIN.findall(_GROUPED.sub("", text) if "," in text or "'" in text else text)
    text = unicodedata.normalize("NFKD", text).casefold().translate(_GONE)
    return _WORD.findall(_GROUPED.sub("", text))


class _Words(dict):
    """The number of each word, in order of appearance, with its template code and hash."""

    def __init__(self, template: dict[str, int]):
        super().__init__()
        self.template, self.code, self.hash = template, [], []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.code.append(code_of(word, self.template))
        self.hash.append(word)
        return n


def code_of(word: str, template: dict[str, int]) -> int:
    """A word's placeholder, or its number among the template words."""
    return NUMBER if word[0].isdigit() else template.get(word, NAME)


#: How a window is joined: by its template alone, by all of its slots at once, by each slot.
ALONE, WHOLE, EACH = 0, 1, 2


def _windows(codes: np.ndarray, hashes: np.ndarray, function: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each place where a window may begin: its keys (one column a slot), which of them count, its way of joining, and the keys that must agree.

    Template words up to the code ``function`` are function words.
    """
    n = max(0, len(codes) - WINDOW + 1)
    template, slots = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    filled, ordinary = np.zeros(n, np.int8), np.zeros(n, np.int8)
    for j in range(WINDOW):
        c, h = codes[j : j + n], hashes[j : j + n]
        template = template * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64) + np.uint64(1)
        slot = c <= NAME
        filled += slot
        ordinary += c > function
        slots = slots * np.uint64(0xC2B2AE3D27D4EB4F) + np.where(slot, h, np.uint64(7))
    way = np.where(filled == 0, ALONE, np.where(filled > WINDOW - LEAST_WORDS, WHOLE, EACH))
    keys, counts = np.zeros((n, WINDOW), np.uint64), np.zeros((n, WINDOW), bool)
    for j in range(WINDOW):
        c, h = codes[j : j + n], hashes[j : j + n]
        keys[:, j] = (template ^ (h + np.uint64(j + 1)) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xFF51AFD7ED558CCD)
        counts[:, j] = (c <= NAME) & (way == EACH)
    whole = way != EACH
    keys[whole, 0] = (template[whole] ^ slots[whole] * np.uint64(0xA24BAED4963EE407)) * np.uint64(0x9FB21C651E98DF25)
    counts[whole, 0] = (way[whole] == WHOLE) | (ordinary[whole] >= LEAST_WORDS)
    need = np.where(whole, 1, np.where(ordinary == 0, filled, (filled + 1) // 2))
    return keys, counts, way, need


def _hashes(found: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(found, dtype=object), categorize=False) if found else np.empty(0, np.uint64)


def _sentences(text: str) -> list[str]:
    return re.split(r"(?<=[.!?。？！])\s+|\n+", text)


def _names(text: str) -> set[str]:
    """The words that a text writes with a capital within a sentence, or as identifiers."""
    found: set[str] = set()
    for p in _sentences(text):
        for k, m in enumerate(re.finditer(r"\w+", p)):
            if k and m[0][0].isupper() or "_" in m[0] or any(c.isdigit() for c in m[0]):
                found.update(words(m[0]))
    return found - _FUNCTION


_FUNCTION = frozenset(w for x in FUNCTION for w in words(x))
_UNITS = frozenset(w for x in UNITS for w in words(x))


class Items:
    """The items' words, slots and windows. Small and fixed; built on the driver."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        merged: dict[int, str] = {}
        for i, text in sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: (r[0], r[1])):
            merged.setdefault(i, text)
        self.words: dict[int, list[str]] = {}
        self.slots: dict[int, np.ndarray] = {}
        #: Of each word of an item its sentence, and whether that sentence has slots.
        self.sentence: dict[int, np.ndarray] = {}
        stock: Counter[tuple[str, ...]] = Counter()
        parts = {i: [w for p in _sentences(t) if (w := words(p))] for i, t in merged.items()}
        for i, own in parts.items():
            if not own:
                continue
            names = _names(merged[i])
            self.words[i] = [w for p in own for w in p]
            self.slots[i] = np.array([w[0].isdigit() or w in _UNITS or w in names for w in self.words[i]])
            self.sentence[i] = np.repeat(np.arange(len(own)), [len(p) for p in own])
            stock.update({tuple(p) for p in own})
        ordinary = {w for i, own in self.words.items() for w, s in zip(own, self.slots[i]) if not s} - _FUNCTION - _UNITS
        self.template = {w: UNIT for w in _UNITS} | {w: NAME + 1 + k for k, w in enumerate([*sorted(_FUNCTION - _UNITS), *sorted(ordinary)])}
        self.function = NAME + len(_FUNCTION - _UNITS)
        #: Words that are slots of some item for their capitals, and of each item.
        self.named = {i: {w for w, s in zip(own, self.slots[i]) if s and w not in _UNITS and not w[0].isdigit()} for i, own in self.words.items()}
        self.every_name = {w: k for k, w in enumerate(sorted(set().union(*self.named.values())))}
        self.parts, self.seen_in = parts, stock
        self.stock: dict[int, set[int]] = {}
        self.rows: list[tuple[int, int, int, int, int, int | None]] = []
        self.settle({})

    def settle(self, documents_with: dict[str, int]) -> None:
        """Slots, stock sentences and windows, once it is known how many documents have each name.

        Where all nouns have capitals, most of an item's capitals are ordinary words: of these, words far more frequent than the
        item's rarest ones are no names.
        """
        self.rows = []
        for i, own in self.words.items():
            rare = sorted(documents_with.get(w, 0) for w in self.named[i])
            most = OFTEN * rare[len(rare) // 4] + OFTEN if rare else 0
            self.slots[i] = np.array([s and (w not in self.named[i] or documents_with.get(w, 0) <= most) for w, s in zip(own, self.slots[i])], bool)
            sentence = self.sentence[i]
            bare = {k for k in range(len(self.parts[i])) if not self.slots[i][sentence == k].any()}
            self.stock[i] = {k for k in bare if self.seen_in[tuple(self.parts[i][k])] >= SHARED}
            known = np.isin(sentence, list(self.stock[i]))
            codes = np.array([code_of(w, self.template) for w in own], np.int64)
            keys, counts, way, need = _windows(codes, _hashes(own), self.function)
            for k, j in np.argwhere(counts):
                if not known[k : k + WINDOW].all():
                    total = int(counts[k].sum())
                    at = [int(k + j)] if way[k] == EACH else [int(k + x) for x in range(WINDOW) if codes[k + x] <= NAME]
                    self.rows.append((int(keys[k, j].view(np.int64)), i, int(k), int(need[k]), total, [x for x in at if self.slots[i][x]]))
        if len(self.rows) > MOST_ITEM_WINDOWS:
            raise ValueError(f"{len(self.rows)} windows of items; the bound is {MOST_ITEM_WINDOWS}")


class Windows:
    """The items' windows by key, as columns, to be met by those of documents."""

    def __init__(self, own: Items):
        rows = sorted(own.rows, key=lambda r: r[0])
        self.items = list(own.words)
        number = {i: n for n, i in enumerate(self.items)}
        self.key, self.place, self.need, self.total = (np.array([r[c] for r in rows], np.int64) for c in (0, 2, 3, 4))
        self.item = np.array([number[r[1]] for r in rows], np.int64)
        self.slots = np.array([len(r[5]) for r in rows], np.int64)
        self.first_slot = np.cumsum(self.slots) - self.slots
        self.slot = np.array([x for r in rows for x in r[5]], np.int64)
        self.running = np.array([min(RUNNING, len(w)) for w in own.words.values()], np.int64) - (WINDOW - 1)

    def meetings(self, windows: pa.ListArray) -> np.ndarray:
        """Of each row, how many times its windows meet the items'."""
        sought, ends = windows.flatten().to_numpy(), windows.offsets.to_numpy()
        met = np.r_[0, np.cumsum(np.searchsorted(self.key, sought, "right") - np.searchsorted(self.key, sought, "left"))]
        return np.diff(met[ends - ends[0]])

    def near(self, windows: pa.ListArray, places: pa.ListArray) -> Iterator[tuple[int, int, list[int]]]:
        """(row, item, places): items of which a row's windows have enough slots, or running words, and where; in order of rows."""
        size = np.diff(windows.offsets.to_numpy())
        sought, where, row = windows.flatten().to_numpy(), places.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(size)), size)
        low, high = np.searchsorted(self.key, sought, "left"), np.searchsorted(self.key, sought, "right")
        of, w = _spans(low, high - low)
        met = np.stack([row[of], self.item[w], where[of], self.place[w]])
        order = np.lexsort(met[::-1])
        met, w = met[:, order], w[order]
        if not len(w):
            return
        begins = np.flatnonzero(np.r_[True, (met[:, 1:] != met[:, :-1]).any(axis=0)])
        agreeing = np.diff(np.r_[begins, len(w)])
        enough = agreeing >= self.need[w[begins]]
        kept = np.repeat(enough, agreeing)
        begins, agreeing = begins[enough], agreeing[enough]
        # what is kept, by row and item
        n = len(self.items)
        pair, at, place, whole = met[0, begins] * n + met[1, begins], met[2, begins], met[3, begins], agreeing == self.total[w[begins]]
        pairs, number = np.unique(pair, return_inverse=True)
        running = _distinct(number[whole], place[whole], len(pairs))
        of, s = _spans(self.first_slot[w[kept]], self.slots[w[kept]])
        slots = _distinct(np.searchsorted(pairs, met[0, kept] * n + met[1, kept])[of], self.slot[s], len(pairs))
        bounds = np.searchsorted(pair, pairs, "left"), np.searchsorted(pair, pairs, "right")
        for k in np.flatnonzero((slots >= PASSAGE_SLOTS) | (running >= self.running[pairs % n])):
            yield int(pairs[k] // n), self.items[pairs[k] % n], np.unique(at[bounds[0][k] : bounds[1][k]]).tolist()


def _spans(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of spans of so many numbers from a first one on: the span of each number, and the number."""
    of = np.repeat(np.arange(len(size)), size)
    return of, np.arange(len(of)) - (np.cumsum(size) - size - first)[of]


def _distinct(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """How many distinct values each of n groups has; values are no negative numbers."""
    most = int(value.max(initial=0)) + 1
    return np.bincount(np.unique(group * most + value) // most, minlength=n)


def _aligned(item: list[str], doc: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence of two short word lists, as pairs of places; rows of numpy, one word of the document each."""
    index = {w: k for k, w in enumerate(dict.fromkeys(item))}
    a, b = np.array([index[w] for w in item]), np.array([index.get(w, -1) for w in doc])
    table = np.zeros((len(b) + 1, len(a) + 1), np.int32)
    for i in range(len(b)):
        table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], table[i, :-1] + (a == b[i])))
    pairs, i, j = [], len(b), len(a)
    while i and j:
        if table[i, j] == table[i - 1, j]:
            i -= 1
        elif table[i, j] == table[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((j, i))
    return pairs[::-1]


#: How surely a document holds an item: not, by a sentence without slots only, by a passage.
NOT, WEAKLY, SURELY = 0, 1, 2


def holds(own: Items, i: int, doc: list[str], around: list[int]) -> tuple[int, int]:
    """How surely the document holds item i, or a passage of it, near one of the places where windows agree; and a weak passage's sentence."""
    item = own.words[i]
    reach = 2 * len(item) + 40
    groups: list[list[int]] = []
    for p in sorted(around):
        if groups and p - groups[-1][-1] <= reach:
            groups[-1].append(p)
        else:
            groups.append([p])
    best = (NOT, -1)
    for g in groups:
        for begin in range(g[0], g[-1] + 1, 4 * reach):  # a document that repeats an item is aligned piece by piece
            end = min(g[-1], begin + 4 * reach)
            piece = doc[max(0, begin - len(item)) : end + WINDOW + len(item)]
            found = _passage(_aligned(item, piece), own, i, piece)
            if found[0] == SURELY:
                return found
            best = max(best, found)
    return best


def _stretch(at: dict[int, int], slots: np.ndarray) -> tuple[int, int]:
    """The stretch of the item that the alignment covers best.

    Aligned words beside other aligned words count for it, missing words and above all missing slots against it, as do
    long interruptions in the document.
    """
    score, begin, best, before = 0.0, 0, (0.0, 0, -1), None
    for j in range(len(slots)):
        i = at.get(j)
        if i is None:
            gain = -2.0 if slots[j] else -0.6
        else:
            gap = 0 if before is None else i - before - 1
            solid = at.get(j - 1) == i - 1 or at.get(j + 1) == i + 1
            gain = (1.0 if solid else 0.2) - min(3.0, 0.15 * gap)
            before = i
        if score + gain <= gain or score <= 0:
            score, begin = 0.0, j
        score += gain
        if score > best[0]:
            best = (score, begin, j)
    return best[1], best[2]


def _differs(item: list[str], slots: np.ndarray, doc: list[str], j: int, i: int, step: int) -> bool:
    """Whether the template goes on beyond word j of the item (word i of the document), one way, with other values in its slots."""
    same = other = apart = 0
    for k in range(1, NEARBY + 1):
        p, q = j + step * k, i + step * k
        if not (0 <= p < len(item) and 0 <= q < len(doc)):
            break
        if slots[p]:
            apart += item[p] != doc[q]
        else:
            same, other = same + (item[p] == doc[q]), other + (item[p] != doc[q])
    return apart > 0 and same >= 2 and same > other


def _passage(pairs: list[tuple[int, int]], own: Items, n: int, doc: list[str]) -> tuple[int, int]:
    """Whether the alignment of item n with the document's words is a passage, and of a weak one the sentence."""
    item, slots, sentence = own.words[n], own.slots[n], own.sentence[n]
    at = dict(pairs)
    begin, end = _stretch(at, slots)
    bare = {k for k in set(sentence.tolist()) if not slots[sentence == k].any()}
    few = int(slots.sum()) < PASSAGE_SLOTS  # such an item is known by its running words only
    held = [j for j in range(begin, end + 1) if j in at and (few or int(sentence[j]) not in bare)]
    right, there = int(sum(slots[j] for j in held)), int(slots[begin : end + 1].sum())
    if len(held) >= PASSAGE and right >= PASSAGE_SLOTS and right >= CONSISTENT * there:
        return SURELY, -1
    weak = (NOT, -1)
    j = 0
    while j < len(item):
        last = j
        while last in at and at.get(last + 1) == at[last] + 1:
            last += 1
        if j in at and last - j + 1 >= min(RUNNING, len(item)):
            if not (_differs(item, slots, doc, last, at[last], 1) or _differs(item, slots, doc, j, at[j], -1)):
                # stock sentences are no passage, nor are words without slots from a sentence that the corpus has without the item
                specific = [k for k in range(j, last + 1) if int(sentence[k]) not in own.stock[n]]
                if few and len(specific) >= min(RUNNING, len(item)) or sum(int(sentence[k]) not in bare for k in range(j, last + 1)) >= RUNNING:
                    return SURELY, -1
                if len(specific) >= RUNNING:
                    weak = WEAKLY, int(sentence[specific[len(specific) // 2]])
        j = last + 1
    return weak


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """(key, item_key): each document and item such that the document holds the item or a passage of it.

    Null, empty and wordless texts hold nothing; items of under WINDOW words leak nowhere; a repeated item id counts by its least text;
    repeated documents give one row. Documents are read whole, whatever their length. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = items.select(item_key, text).limit(MOST_ITEM_WINDOWS + 1).collect()
    if len(rows) > MOST_ITEM_WINDOWS:
        raise ValueError(f"more than {MOST_ITEM_WINDOWS} items")
    held = Items([(r[0], r[1]) for r in rows])
    shared = spark.sparkContext.broadcast(held)
    known = np.unique(np.array([r[0] for r in held.rows], np.int64))
    # most windows are told apart by some bits of their keys
    bits = np.zeros(1 << 22, bool)
    bits[known.view(np.uint64) >> np.uint64(42)] = True
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    docs_key, items_key = to_arrow_type(docs.schema[key].dataType), to_arrow_type(items.schema[item_key].dataType)
    NEAR = [key, text, "windows", "places", "n"]

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        seen = _Words(own.template)
        hashes, codes = np.empty(0, np.uint64), np.empty(0, np.int64)
        names, width = np.empty(0, np.int64), len(own.every_name)
        having = np.zeros(width, np.int64)
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            while at < len(texts):
                size, begin, found, counts = 0, at, [], []
                while at < len(texts) and size < BLOCK_CHARS:
                    w = words(texts[at])
                    found += w
                    counts.append(len(w))
                    size += len(texts[at] or "")
                    at += 1
                if len(seen) > 500_000:
                    seen, hashes, codes, names = _Words(own.template), hashes[:0], codes[:0], names[:0]
                n = np.fromiter(map(seen.__getitem__, found), np.int64, len(found))
                if len(seen) > len(codes):
                    hashes = np.concatenate([hashes, _hashes(seen.hash[len(codes) :])])
                    names = np.concatenate([names, np.array([own.every_name.get(w, -1) for w in seen.hash[len(codes) :]], np.int64)])
                    codes = np.array(seen.code, np.int64)
                if not len(known) or len(n) < WINDOW:
                    continue
                ends = np.cumsum(counts)
                which = np.flatnonzero(names[n] >= 0)
                having += np.bincount(np.unique(np.searchsorted(ends, which, side="right") * max(1, width) + names[n[which]]) % max(1, width), minlength=width)
                keys, here, _, need = _windows(codes[n], hashes[n], own.function)
                here &= bits[keys >> np.uint64(42)]
                spot = np.flatnonzero(here.sum(axis=1) >= need)
                sought = keys[spot].view(np.int64)
                here = here[spot] & (known[np.searchsorted(known, sought).clip(max=len(known) - 1)] == sought)
                doc = np.searchsorted(ends, spot, side="right")
                good = (here.sum(axis=1) >= need[spot]) & (spot + WINDOW <= ends[doc])
                which, j = np.nonzero(here & good[:, None])
                if len(which):
                    spot, doc, sought = spot[which], doc[which], sought[which, j]
                    own_docs, first = np.unique(doc, return_index=True)
                    offsets = pa.array(np.append(first, len(doc)), pa.int32())
                    rows_at = pa.array(begin + own_docs)
                    place = (spot - (ends - np.array(counts))[doc]).astype(np.int32)
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (sought, place)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows_at), batch.column(1).take(rows_at), *lists, pa.nulls(len(own_docs), pa.list_(pa.int64()))], NEAR)
        there = np.flatnonzero(having)  # a last row without key: how many documents have each name
        lists = [pa.array([x.tolist()], pa.list_(t)) for x, t in ((there, pa.int64()), (there[:0], pa.int32()), (having[there], pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, docs_key), pa.nulls(1, pa.string()), *lists], NEAR)

    # texts go on only for documents with a window whose template and slots an item has
    near = stage(spread(docs.select(key, text), key, docs).mapInArrow(candidates, f"`{key}` {kind}, `{text}` string, windows array<bigint>, places array<int>, n array<bigint>"), "near-items")
    counted = near.where("n is not null").select(F.explode(F.arrays_zip(F.col("windows").alias("name"), "n")).alias("x")).groupBy("x.name").agg(F.sum("x.n").alias("n"))
    by_number = {r["name"]: r["n"] for r in counted.collect()}  # at most a row for each name in the items
    held.settle({w: by_number.get(k, 0) for w, k in held.every_name.items()})
    settled = spark.sparkContext.broadcast(held)
    near = near.where(F.col("n").isNull() & F.col(key).isNotNull()).drop("n")
    windows = spark.sparkContext.broadcast(Windows(held))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sought = settled.value, windows.value
        for batch in batches:
            at, out, doc, last = 0, [], [], -1
            meetings = np.r_[0, np.cumsum(sought.meetings(batch.column(2)))]
            while at < len(batch):
                # so many rows that their meetings are a bounded number, one at least
                begin, at = at, max(at + 1, int(np.searchsorted(meetings, meetings[at] + BLOCK_MEETINGS, "right")) - 1)
                for d, item, places in sought.near(*(batch.column(c).slice(begin, at - begin) for c in (2, 3))):
                    if begin + d != last:
                        last = begin + d
                        doc = words(batch.column(1)[last].as_py())
                    f = holds(own, item, doc, places)
                    if f[0] != NOT:
                        out.append((last, item, *f))
            rows, found, sure, sentence = zip(*out) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, items_key), pa.array(sure, pa.int32()), pa.array(sentence, pa.int32())], [key, item_key, "sure", "sentence"])

    # a document is matched and verified where it is: neither its windows nor its text are shuffled
    both = spread(near.select(key, text, "windows", "places"), key, near)
    checked = stage(both.mapInArrow(verified, f"`{key}` {kind}, `{item_key}` {item_kind}, sure int, sentence int").distinct(), "checked-items")
    sure = checked.where(F.col("sure") == SURELY).select(key, item_key)
    # at most a row an item, or a sentence of one
    surely = sure.groupBy(item_key).agg(F.count("*").alias("surely"))
    weak = checked.where(F.col("sure") == WEAKLY)
    stock = weak.groupBy(item_key, "sentence").agg(F.count("*").alias("weakly")).join(surely, item_key, "left").where(F.col("weakly") > 2 * F.coalesce("surely", F.lit(0)) + 1)
    return sure.unionByName(weak.join(stock, [item_key, "sentence"], "left_anti").select(key, item_key)).distinct()
