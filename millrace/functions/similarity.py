"""String similarity over whole columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of longest common subsequences of a[i] and b[i], bit-parallel over all pairs for words of up to 63 letters."""
    n = len(a)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    swap = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b)]
    long = np.array([len(x) > 63 or len(y) > 400 for x, y in swap])
    for i in np.flatnonzero(long):
        out[i] = lcs_length(*swap[i])
    for begin in range(0, n, 20_000):
        at = np.flatnonzero(~long[begin : begin + 20_000]) + begin
        if not len(at):
            continue
        x, y = _codes([swap[i][0] for i in at], [swap[i][1] for i in at])
        who = np.arange(len(at))
        masks = np.zeros((len(at), max(1, int(x.max(initial=0)) + 1)), np.uint64)
        for j in range(x.shape[1]):
            masks[who, x[:, j]] |= np.uint64(1 << j)
        masks[:, 0] = 0
        v = np.full(len(at), ~np.uint64(0))
        for j in range(y.shape[1]):
            u = v & masks[who, y[:, j]]
            v = (v + u) | (v - u)
        out[at] = np.bitwise_count(~v)
    return out


def _codes(short: list[str], long: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters as numbers from 1 in the order of the letters of the short words; 0: none, or a letter no short word has."""
    grids = []
    for words in (short, long):
        size = max(1, max(map(len, words)))
        grids.append(np.array(words, dtype=f"U{size}").view(np.uint32).reshape(len(words), size))
    letters = np.unique(grids[0][grids[0] > 0])
    if not len(letters):
        return tuple(np.zeros(g.shape, np.int64) for g in grids)
    at = [np.searchsorted(letters, g).clip(max=len(letters) - 1) for g in grids]
    return tuple(np.where(letters[i] == g, i + 1, 0) for i, g in zip(at, grids))


def lcs_length(a: str, b: str) -> int:
    """The same for one pair, bit-parallel over a Python number of any length."""
    masks: dict[str, int] = {}
    for j, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << j
    every = v = (1 << len(a)) - 1
    for c in b:
        u = v & masks.get(c, 0)
        v = (v + u | v - u) & every
    return len(a) - v.bit_count()


def with_lcs(df: DataFrame, a: str, b: str, name: str = "lcs") -> DataFrame:
    """df with the LCS length of two of its string columns (null if either is null)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            there = (x[a].notna() & x[b].notna()).to_numpy()
            found = pd.array([None] * len(x), dtype="Int64")
            found[there] = lcs_lengths(x[a][there].tolist(), x[b][there].tolist())
            yield x.assign(**{name: found})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, `{name}` long")


def letter_bags(words: list[str], classes: int = 32, most: int = 4) -> np.ndarray:
    """A few numbers a word: how often each class of letters occurs, up to ``most`` times, as so many bits.

    The bits in which two words differ are at most the letters that one of them has more than the other; so of letters la and lb, a
    common subsequence has at most (la + lb - bits) / 2.
    """
    each = 64 // most
    parts = -(-classes // each)
    out = np.zeros((len(words), parts), np.uint64)
    lengths = np.array([len(w) for w in words], np.int64)
    for begin in range(0, len(words), 10_000):
        at = np.flatnonzero(lengths[begin : begin + 10_000] <= 400) + begin
        for some in ([at] if len(at) else []) + [[i] for i in np.flatnonzero(lengths[begin : begin + 10_000] > 400) + begin]:
            size = max(1, int(lengths[some].max()))
            grid = np.array([words[i] for i in some], dtype=f"U{size}").view(np.uint32).reshape(len(some), size)
            cell = np.where(grid > 0, grid % classes, parts * each) + (parts * each + 1) * np.arange(len(some))[:, None]
            counts = np.bincount(cell.ravel(), minlength=(parts * each + 1) * len(some)).reshape(len(some), -1)[:, :-1].clip(max=most)
            bits = ((1 << counts) - 1).astype(np.uint64) << np.uint64(most) * (np.arange(parts * each, dtype=np.uint64) % np.uint64(each))
            out[some] = np.bitwise_or.reduce(bits.reshape(-1, parts, each), axis=2)
    return out.view(np.int64)


def with_letter_bags(df: DataFrame, c: str) -> DataFrame:
    """df with the letter bags of a string column that is never null, as bag and bag2."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            bags = letter_bags(x[c].tolist())
            yield x.assign(bag=bags[:, 0], bag2=bags[:, 1])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, bag long, bag2 long")
