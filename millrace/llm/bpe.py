"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Texts are cut into pieces (words with their leading space, numbers, signs, white space); a piece is encoded once a task. All new
pieces of a block of texts are merged together through an index of pair occurrences: each mergeable pair knows all its positions,
the ranks that occur are applied in ascending order to all their positions at once, and the lists of the pairs that a merge
creates are updated. A merge can only create pairs of tokens that are adjacent within one piece, so pieces do not affect
each other. The vocabulary file is read on the driver and broadcast: its size is fixed and checked.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.storage import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
MOST_VOCABULARY_BYTES = 64 << 20
#: Texts are encoded in blocks of about so many characters; a longer text is a block of its own.
BLOCK_CHARS = 1_000_000
#: Pieces that a task remembers; beyond that it forgets all and begins anew.
MOST_PIECES = 400_000
#: The public pattern that cuts a text into pieces, and its form for ASCII texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASCII = re.compile(r"""'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+""")
_made: dict[int, Encoder] = {}


def byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary file writes each byte: itself if printable, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(free)) for b in range(256)]


class Encoder:
    """Merges of one vocabulary, and the pieces encoded so far."""

    def __init__(self, file: str):
        import regex

        model = json.loads(file)["model"]
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.first = np.array([vocab[c] for c in byte_letters()], np.int64)
        self.rule = {(vocab[a] << 32) | vocab[b]: (r, vocab[a + b]) for r, (a, b) in enumerate(merges)}
        keys = np.fromiter(self.rule, np.int64, len(self.rule))
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.made = [vocab[a + b] for a, b in merges]
        self.pair = [(vocab[a], vocab[b]) for a, b in merges]
        self.cut = regex.compile(PATTERN).findall
        self.forget()

    def forget(self) -> None:
        self.code: dict[str, int] = _Codes()
        self.ids, self.starts = np.empty(0, np.int32), np.zeros(1, np.int64)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces one after another, and where each piece begins (one more at the end)."""
        flat = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        n = len(flat)
        if n > 1:
            inside = np.ones(n - 1, bool)
            inside[ends[:-1] - 1] = False
            keys = (flat[:-1] << 32) | flat[1:]
            at = np.searchsorted(self.keys, keys).clip(max=len(self.keys) - 1)
            positions = np.flatnonzero(inside & (self.keys[at] == keys))
            ranks = self.ranks[at[positions]]
            order = np.argsort(ranks, kind="stable")
            present, first = np.unique(ranks[order], return_index=True)
            index = {int(r): p.tolist() for r, p in zip(present, np.split(positions[order], first[1:]))} if len(positions) else {}
        else:
            index = {}
        token, left, right = flat.tolist(), list(range(-1, n - 1)), list(range(1, n + 1))
        for e in ends.tolist():
            right[e - 1] = -1
            if e < n:
                left[e] = -1
        heap, rule = sorted(index), self.rule
        while heap:
            rank = heapq.heappop(heap)
            (a, b), new = self.pair[rank], self.made[rank]
            for i in sorted(index.pop(rank)):
                j = right[i]
                if token[i] != a or j < 0 or token[j] != b:
                    continue  # another merge took one of the two
                k, h = right[j], left[i]
                token[i], token[j], right[i] = new, -1, k
                if k >= 0:
                    left[k] = i
                    if (x := rule.get((new << 32) | token[k])) is not None:
                        if x[0] not in index:
                            index[x[0]] = []
                            heapq.heappush(heap, x[0])
                        index[x[0]].append(i)
                if h >= 0 and (x := rule.get((token[h] << 32) | new)) is not None:
                    if x[0] not in index:
                        index[x[0]] = []
                        heapq.heappush(heap, x[0])
                    index[x[0]].append(h)
        out = np.array(token, np.int32)
        alive = out >= 0
        kept = np.concatenate([[0], np.cumsum(alive)])
        return out[alive], kept[np.concatenate([[0], ends])]

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        pieces: list[str] = []
        counts = []
        for t in texts:
            if t:
                p = ASCII.findall(t) if t.isascii() else self.cut(t)
                pieces += p
                counts.append(len(p))
            else:
                counts.append(0)
        known = len(self.code)
        codes = np.fromiter(map(self.code.__getitem__, pieces), np.int64, len(pieces))
        if len(self.code) > known:
            new = _after(self.code, known)
            ids, starts = self.merge([p.encode("utf-8", "surrogatepass") for p in new])
            self.starts = np.concatenate([self.starts, starts[1:] + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids])
        begin = self.starts[codes]
        size = self.starts[codes + 1] - begin
        ends = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(int(ends[-1])) + np.repeat(begin - ends[:-1], size)
        offsets = ends[np.concatenate([[0], np.cumsum(np.array(counts, np.int64))]).astype(np.int64)]
        out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(self.ids[take], pa.int32()))
        if len(self.code) > MOST_PIECES:
            self.forget()
        return out


class _Codes(dict):
    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


def _after(codes: dict[str, int], known: int) -> list[str]:
    new = []
    for p in reversed(codes):
        if len(new) == len(codes) - known:
            break
        new.append(p)
    return new[::-1]


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>): the ids of every row's text, without special tokens, whose strings are ordinary text here.

    A null, and an empty text, give an empty array; blank texts are encoded as they are. Texts are encoded whole; repeated
    rows give repeated rows; other columns are not read. No shuffle takes place, but for inputs too small for a task on each core.
    """
    file = Path(vocabulary).read_text(encoding="utf-8")
    if len(file.encode()) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} holds more than {MOST_VOCABULARY_BYTES} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(file)
    name = hash(file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _made:
            _made[name] = Encoder(shared.value)
        encoder = _made[name]
        for batch in batches:
            texts = batch.column(1)
            lengths = np.diff(np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)) if len(texts) and texts.type == pa.string() else np.zeros(len(texts), np.int64)
            block = np.cumsum(lengths, dtype=np.int64) // BLOCK_CHARS
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)]
            for i, j in zip(cuts, cuts[1:]):
                if j > i:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), encoder.encode(texts.slice(i, j - i).to_pylist())], [key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return spread(docs.select(key, text), key, docs).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
