"""Keyword-stuffed and link-list pages: perplexity of function-word and word-class sequences under a prose-trained n-gram model.

A text becomes a sequence of classes: function words stand for themselves, other words for their shape, a word that keeps
coming back within its own text for "repeated", and numbers, addresses, tags and signs for their kind. A trigram model of these
classes is counted over all sentences of the corpus that are built like prose (one pass, counts combined in the tasks before they
are shuffled; the number of classes is fixed, and with it the model's size). A second pass measures every text: its perplexity,
how much of it lies in sentences or lines far above prose's perplexity, how much these differ, and on which kinds of tokens the
surprise falls. A page is spam if a linear score of these measures is high: surprise that falls on words, links, tags and
separators speaks for it; surprise on numbers, code, capitals, rules and sentence ends, as in tables, logs and receipts, against.
There is no list of shop words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.storage import spread

#: Common function words.
FUNCTION = """
the a an of and or but to in on at by for from with without is are was were be been it its this that these those as if when while
which who whose not no than then so we you they he she his her their our your can has have had will would there about after before
le la les un une des du de et ou mais est sont dans sur pour par avec sans que qui pas ne se son sa ses il elle au aux en plus
der die das den dem ein eine einen und oder aber ist sind im in mit von zu auf für nicht auch sich nach bei aus zum vor über wird
el los las una y o pero es son con sin por para del al su sus lo se como más que no
os as um uma e mas dos das da do na no em ao com sem não foi
""".split()
#: How far above prose, in nats a token, a sentence or line must lie to count as strange.
ABOVE = 0.8
#: Least tokens of a page that can be spam.
LEAST_TOKENS = 8
#: A word comes back if it is that share of a text's words and occurs that often.
COMES_BACK, OFTEN = 0.06, 4
#: Most labelled pages that weights are fitted on.
MOST_LABELLED = 20_000
BLOCK_CHARS = 1_000_000
_URL = re.compile(r"<a\s[^<>]*>|(?:https?://|www\.)[^\s<>\"')\]]+|\b[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}/[^\s<>\"')\]]*")
_TOKEN = re.compile(r"\x01|#\w+|[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+(?:[.,:/-]\d+)*|\w+|\n|[^\w\s]")
_ENDS = ".!?。！？।؟"
_SIGNS = ",;:|>/-–—()[]\"'`«»“”‘’*&%"
_CODE = "{}=<+\\_^~$@"

NAMES = ["edge", "newline", "url", "hashtag", "number", "money", "star", "code", "mixed", "other", "lower", "upper", "caps", "repeated", "end", *(f"sign {c}" for c in _SIGNS), "sign", *(f"word {w}" for w in dict.fromkeys(FUNCTION))]
ID = {n: i for i, n in enumerate(NAMES)}
N_CLASSES = len(NAMES)
_FUNCTION = {w: ID[f"word {w}"] for w in FUNCTION}
_FIRST_FUNCTION = ID["sign"] + 1


def class_of(token: str) -> int:
    c = token[0]
    if c == "\x01":
        return ID["url"]
    if c == "\n":
        return ID["newline"]
    if c == "#" and len(token) > 1:
        return ID["hashtag"]
    if c.isdigit():
        return ID["number"] if token[-1].isdigit() else ID["mixed"]
    if c.isalpha():
        low = token.lower()
        if low in _FUNCTION:
            return _FUNCTION[low]
        if c > "ɏ":
            return ID["other"]
        if len(token) > 30 or not all(x.isalpha() or x in "'’-" for x in token):
            return ID["mixed"]
        return ID["lower"] if c.islower() else ID["caps"] if len(token) > 1 and token.isupper() else ID["upper"]
    if c in _ENDS:
        return ID["end"]
    if c in "€£$":
        return ID["money"]
    if c in "★☆":
        return ID["star"]
    if c in _CODE:
        return ID["code"]
    return ID.get(f"sign {c}", ID["mixed"] if token.isalnum() else ID["sign"])


def tokens(text: str | None) -> list[str]:
    if not text:
        return []
    if "/" in text or "www." in text or "<a" in text:
        text = _URL.sub(" \x01 ", text)
        if "</a>" in text:
            text = text.replace("</a>", " ")
    return _TOKEN.findall(text)


class _Numbers(dict):
    """Tokens by order of appearance, with their classes; a word's forms in other case, and with a final s, share a stem."""

    def __init__(self):
        super().__init__()
        self.kind: list[int] = []
        self.stem: list[int] = []
        self.stems: dict[str, int] = {}
        self.long: list[bool] = []

    def __missing__(self, token: str) -> int:
        self[token] = n = len(self)
        self.kind.append(class_of(token))
        low = token.lower()
        self.stem.append(self.stems.setdefault(low[:-1] if low.endswith("s") else low, len(self.stems)))
        if len(self.stems) > len(self.long):
            self.long.append(len(low) > 3)
        return n


@dataclass
class Block:
    """Token classes of several texts, one after another; segment: number of the sentence or line that a token is in."""

    kinds: np.ndarray
    doc: np.ndarray
    segment: np.ndarray
    segment_doc: np.ndarray
    distinct: np.ndarray


class Reader:
    def __init__(self):
        self.numbers = _Numbers()

    def read(self, texts: list[str | None]) -> Block:
        if len(self.numbers) > 500_000:
            self.numbers = _Numbers()
        found: list[str] = []
        counts = []
        for t in texts:
            own = tokens(t)
            found += own
            counts.append(len(own))
        n = np.fromiter(map(self.numbers.__getitem__, found), np.int64, len(found))
        kinds = np.array(self.numbers.kind, np.int64)[n]
        doc = np.repeat(np.arange(len(texts)), counts)
        long = np.array(self.numbers.long, bool)[np.array(self.numbers.stem, np.int64)[n]] if len(n) else np.zeros(0, bool)
        content = (kinds == ID["lower"]) | (kinds == ID["upper"]) | (kinds == ID["caps"]) | (kinds == ID["other"]) & long
        distinct = np.zeros(len(texts), np.int64)
        if content.any():
            key = doc[content] * (len(self.numbers.stems) + 1) + np.array(self.numbers.stem, np.int64)[n[content]]
            own, back, times = np.unique(key, return_inverse=True, return_counts=True)
            width = len(self.numbers.stems) + 1
            distinct = np.bincount(own[np.array(self.numbers.long, bool)[own % width]] // width, minlength=len(texts))
            words = np.bincount(doc[(kinds >= ID["other"]) & (kinds <= ID["repeated"]) | (kinds >= _FIRST_FUNCTION)], minlength=len(texts))
            often = (times[back] >= OFTEN) & (times[back] >= COMES_BACK * words[doc[content]])
            kinds[np.flatnonzero(content)[often]] = ID["repeated"]
        # a segment ends after an end sign that isn't followed by another, and at a new line
        ends = (kinds == ID["end"]) | (kinds == ID["newline"])
        starts = np.ones(len(kinds), bool)
        starts[1:] = (ends[:-1] & ~ends[1:]) | (doc[1:] != doc[:-1])
        segment = np.cumsum(starts) - 1
        return Block(kinds, doc, segment, doc[starts], distinct)


def _trigrams(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Class trigrams that end at each token (edges at a segment's start), and the tokens' segments. New lines are left out."""
    keep = b.kinds != ID["newline"]
    k, s = b.kinds[keep], b.segment[keep]
    one, two = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
    if len(k) > 1:
        one[1:] = np.where(s[1:] == s[:-1], k[:-1], 0)
        two[2:] = np.where(s[2:] == s[:-2], k[:-2], 0)
    return (two * N_CLASSES + one) * N_CLASSES + k, s


def _prose(b: Block, s: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Which segments are built like prose: closed by an end sign, long enough, with function words and few odd tokens."""
    n = len(b.segment_doc)
    k = grams % N_CLASSES
    size = np.bincount(s, minlength=n)
    last = np.full(n, -1)
    last[s] = k
    share = lambda m: np.bincount(s[m], minlength=n) / np.maximum(size, 1)
    functional = share(k >= _FIRST_FUNCTION)
    foreign = share(k == ID["other"])
    odd = share((k == ID["url"]) | (k == ID["hashtag"]) | (k == ID["code"]) | (k == ID["mixed"]) | (k == ID["repeated"]))
    return (last == ID["end"]) & (size >= 6) & (odd <= 0.1) & ((functional >= 0.15) | (foreign >= 0.5))


class Model:
    """Interpolated class trigrams. counts: trigram number to count."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        order = np.argsort(grams)
        self.grams, self.counts = grams[order], counts[order].astype(float)
        pair = self.grams % (N_CLASSES * N_CLASSES)
        history = self.grams // N_CLASSES
        self.history = np.bincount(history, self.counts, N_CLASSES * N_CLASSES)
        self.pair = np.bincount(pair, self.counts, N_CLASSES * N_CLASSES)
        self.before = np.bincount(pair // N_CLASSES, self.counts, N_CLASSES)
        self.one = (np.bincount(pair % N_CLASSES, self.counts, N_CLASSES) + 0.5) / (self.counts.sum() + 0.5 * N_CLASSES)
        own = self.surprise(self.grams) if len(grams) else np.zeros(0)
        self.mean = float((own * self.counts).sum() / self.counts.sum()) if len(grams) else 0.0

    def surprise(self, grams: np.ndarray) -> np.ndarray:
        """Negative log probability of each trigram's last class."""
        z, yz, xy = grams % N_CLASSES, grams % (N_CLASSES * N_CLASSES), grams // N_CLASSES
        y = xy % N_CLASSES
        two = (self.pair[yz] + 5 * self.one[z]) / (self.before[y] + 5)
        if not len(self.grams):
            return -np.log(two)
        at = np.searchsorted(self.grams, grams).clip(max=len(self.grams) - 1)
        three = np.where(self.grams[at] == grams, self.counts[at], 0.0)
        return -np.log((three + 5 * two) / (self.history[xy] + 5))


#: Groups of classes by which surprise is shared out; what is in none is "sign".
GROUPS = {
    "lower": ["lower"], "upper": ["upper"], "caps": ["caps"], "repeated": ["repeated"], "url": ["url"], "hashtag": ["hashtag"], "number": ["number"], "mixed": ["mixed"], "money": ["money", "star"],
    "code": ["code", "sign (", "sign )", "sign `", "sign [", "sign ]"], "menu": ["sign |", "sign >"], "list": ["sign ,", "sign ;", "sign /"], "dash": ["sign -", "sign –", "sign —"], "colon": ["sign :"],
    "other": ["other"], "end": ["end"],
}
MEASURES = ["nats", "strange", "spread", "tokens", "line", "distinct", *GROUPS, "function", "sign"]
_GROUP = np.full(N_CLASSES, len(GROUPS) + 1)
for _i, _names in enumerate(GROUPS.values()):
    _GROUP[[ID[_n] for _n in _names]] = _i
_GROUP[_FIRST_FUNCTION:] = len(GROUPS)
#: Weights of the measures, and what is added: fixed values, fitted by fit() on 10,000 pages labelled beforehand, 623 of them spam. A page is spam from this score on (odds of 2 to 3).
LEAST_SCORE = -0.4
WEIGHTS = {
    "nats": 0.68, "strange": 2.71, "spread": -0.26, "tokens": 0.8, "line": 2.67, "distinct": 0.95, "lower": 8.76, "upper": 10.17, "caps": -9.31, "repeated": 6.61, "url": 12.65, "hashtag": 13.25, "number": -36.35, "mixed": 5.76, "money": 30.16, "code": 1.83, "menu": 1.99, "list": 2.84, "dash": 1.49, "colon": -43.21, "other": -12.33, "end": -36.89, "function": -4.49, "sign": -18.07,
}
BIAS = -18.99


@dataclass
class Page:
    """Of each text of a block: its tokens, its mean surprise in nats a token, and its measures (one column each)."""

    size: np.ndarray
    nats: np.ndarray
    measures: np.ndarray


def measure(b: Block, n_docs: int, model: Model) -> Page:
    """The measures of n_docs texts: log of the surprise, share of tokens in strange segments, spread of the segments' surprise, sizes, and shares of surprise by group."""
    grams, s = _trigrams(b)
    k, n = grams % N_CLASSES, len(b.segment_doc)
    each = model.surprise(grams)
    d = b.segment_doc[s]
    size = np.bincount(d, minlength=n_docs)
    some = np.maximum(size, 1)
    total = np.bincount(d, each, n_docs)
    length = np.bincount(s, minlength=n)
    mean = np.bincount(s, each, n) / np.maximum(length, 1)
    strange = np.bincount(d, (mean[s] > model.mean + ABOVE).astype(float), n_docs) / some
    spread = np.bincount(b.segment_doc, length * mean**2, n_docs) / some - (total / some) ** 2
    segments = np.maximum(np.bincount(b.segment_doc, minlength=n_docs), 1)
    width = len(GROUPS) + 2
    shares = np.bincount(d * width + _GROUP[k], each, n_docs * width).reshape(n_docs, width) / np.maximum(total, 1e-9)[:, None]
    nats = total / some
    whole = [np.minimum(np.log(np.maximum(nats, 0.1)), 2.5), strange, np.sqrt(np.maximum(spread, 0)), np.log1p(size), np.log1p(some / segments), np.log1p(b.distinct)]
    return Page(size, nats, np.column_stack([*whole, shares]))


def is_stuffed(p: Page) -> np.ndarray:
    return (p.size >= LEAST_TOKENS) & (p.measures @ np.array([WEIGHTS[m] for m in MEASURES]) + BIAS > LEAST_SCORE)


def fit(texts: list[str | None], spam: list[bool], model: Model, ridge: float = 1e-4, rounds: int = 40) -> tuple[dict[str, float], float]:
    """Weights and bias from at most MOST_LABELLED labelled pages, by ridge-penalised logistic regression (Newton's steps)."""
    texts, y = texts[:MOST_LABELLED], np.array(spam[:MOST_LABELLED], float)
    reader = Reader()
    x = np.concatenate([measure(reader.read(texts[i : i + 500]), len(texts[i : i + 500]), model).measures for i in range(0, len(texts), 500)])
    middle, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.column_stack([(x - middle) / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        curve = a.T @ (a * (p * (1 - p) + 1e-9)[:, None]) + ridge * len(a) * np.eye(len(w))
        w -= np.linalg.solve(curve, a.T @ (p - y) + ridge * len(a) * w)
    weights = w[:-1] / scale
    return dict(zip(MEASURES, weights.tolist())), float(w[-1] - (weights * middle).sum())


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str | None]]]:
    texts = batch.column(1).to_pylist()
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= BLOCK_CHARS or i + 1 == len(texts):
            yield begin, texts[begin : i + 1]
            begin, size = i + 1, 0


def train(docs: DataFrame, text: str = "text") -> Model:
    """Count class trigrams over all sentences built like prose, in all texts. The result has at most N_CLASSES ** 3 rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        total: dict[int, int] = {}
        for batch in batches:
            for _, texts in _blocks(batch):
                b = reader.read(texts)
                grams, s = _trigrams(b)
                if not len(grams):
                    continue
                values, times = np.unique(grams[_prose(b, s, grams)[s]], return_counts=True)
                for v, t in zip(values.tolist(), times.tolist()):
                    total[v] = total.get(v, 0) + t
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["gram", "n"])

    rows = spread(docs.select(F.lit(0).alias("k"), text), F.xxhash64(text), docs).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    return Model(rows["gram"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))


def scores(docs: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, perplexity, stuffed) of every row. A text without tokens has perplexity null and isn't stuffed."""
    model = model or train(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, own = Reader(), shared.value
        for batch in batches:
            for begin, texts in _blocks(batch):
                p = measure(reader.read(texts), len(texts), own)
                nats = pa.array(np.exp(p.nats), mask=p.size == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), pa.array(p.size.astype(np.int64)), nats, pa.array(is_stuffed(p))], [key, "n_tokens", "perplexity", "stuffed"])

    return spread(docs.select(key, text), key, docs).mapInArrow(run, f"`{key}` {kind}, n_tokens long, perplexity double, stuffed boolean")


def stuffed_pages(docs: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key): the documents most of whose text is keywords, links, tags, sales lines or menu words.

    Null, empty and very short texts (under 8 tokens) are never found; texts are read whole; a repeated row is found again; an
    empty table gives no rows. Other columns are not read.
    """
    return scores(docs, model, key, text).where("stuffed").select(key)
