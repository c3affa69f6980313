"""Quality classifier: overlapping heuristic labellers, their accuracies by expectation-maximisation, and a hashed linear scorer."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, spare, table

#: Frequent function words of the languages that the labellers know.
STOP = frozenset(
    "a an and are as at be by for from he in is it of on or that the this to was with "
    "auf auch das dem den der des die ein eine für ist mit nicht sich und von zu "
    "al con de del el en es la las los no para por que se su un una y "
    "au dans du est et il le les par pas pour qui sur une".split()
)
LABELLERS = ("symbols", "capitals", "marks", "repeats", "redundancy", "function_words", "sentences", "word_length")
WIDTH = 1 << 16
#: Texts are looked at together up to about this many characters (a longer one by itself).
TOGETHER = 400_000
_TOP = 0x20000  # code points from here to 0x3FFFF are letters without case, later ones signs
_SPACE, _LETTER, _CAPITAL, _ALNUM, _SIGN = 1, 2, 4, 8, 16
_HELD: dict[str, object] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """What kind of character each code point is, and its small letter."""
    if "characters" not in _HELD:
        kind, small = np.zeros(_TOP + 2, np.uint8), np.arange(_TOP + 2, dtype=np.uint64)
        for i in range(_TOP):
            c = chr(i)
            kind[i] = _SPACE * c.isspace() | _LETTER * c.isalpha() | _CAPITAL * c.isupper() | _ALNUM * c.isalnum() or _SIGN
            if kind[i] & _CAPITAL:
                small[i] = ord(c.lower()[0])
        kind[[ord(c) for c in ".,;:?'’-\"()"]] = 0
        kind[_TOP], kind[_TOP + 1] = _LETTER | _ALNUM, _SIGN
        _HELD["characters"] = kind, small
    return _HELD["characters"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts, all at once: where they stand, their hashes (of letters and digits in lower case), and their shapes."""

    def __init__(self, texts: list[str]):
        kinds, small = _tables()
        self.texts = texts
        cps = np.frombuffer("".join([t + " " for t in texts]).encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.array([len(t) + 1 for t in texts])
        self.first = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
        cut = np.where(cps < _TOP, cps, np.where(cps < 0x40000, _TOP, _TOP + 1))
        self.kind = kinds[cut]
        space = (self.kind & _SPACE).astype(bool)
        self.start = np.flatnonzero(~space & np.r_[True, space[:-1]])
        self.end = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
        self.doc = np.searchsorted(self.first, self.start, side="right") - 1
        self.n = np.bincount(self.doc, minlength=len(texts))
        alnum = (self.kind & _ALNUM).astype(bool)
        if not len(self.start):
            self.hash = np.zeros(0, np.uint64)
            return
        place = np.cumsum(alnum)
        gaps = np.diff(np.r_[self.start, len(cps)])
        place[self.start[0] :] -= np.repeat(place[self.start] - alnum[self.start], gaps)  # counts from 1 in each word
        with np.errstate(over="ignore"):
            letter = np.where(cps < _TOP, small[cut], cps.astype(np.uint64))
            value = _mix(letter * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
            value[~alnum] = 0
            self.hash = np.add.reduceat(value, self.start)
        self.last, self.before = cps[self.end - 1], cps[np.maximum(self.end - 2, 0)]
        self.plain_end = alnum[self.end - 1]
        self.opening = np.where(alnum[self.start], 0, cps[self.start])

    def per_word(self, bit: int) -> np.ndarray:
        return np.add.reduceat((self.kind & bit > 0).astype(np.int32), self.start)

    def per_text(self, bit: int) -> np.ndarray:
        return np.add.reduceat((self.kind & bit > 0).astype(np.int64), self.first)

    def share(self, which: np.ndarray) -> np.ndarray:
        """Of each text's words (0 of no words)."""
        return np.bincount(self.doc, which, len(self.texts)) / np.maximum(1, self.n)

    def again(self) -> np.ndarray:
        """Whether a word is the same as the one before it in its text."""
        same = (self.hash[1:] == self.hash[:-1]) & (self.doc[1:] == self.doc[:-1]) & (self.hash[1:] != 0)
        return np.r_[False, same] if len(self.hash) else same


def groups(texts: list[str]):
    """The texts in runs of about TOGETHER characters."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > TOGETHER:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def votes(words: Words) -> list[str]:
    """For each text one sign for each labeller: + good, - bad, 0 no opinion (too little text, or in between)."""
    texts, n = words.texts, words.n
    if not len(words.start):
        return ["0" * len(LABELLERS)] * len(texts)
    letters, alone = words.per_text(_LETTER), np.maximum(1, np.array([len(t) for t in texts]) + 1 - words.per_text(_SPACE))
    signs, capitals = words.per_text(_SIGN) / alone, words.per_text(_CAPITAL) / np.maximum(1, letters)
    marked = words.share((words.last == words.before) & ~words.plain_end & (words.end - words.start > 1))
    again, stop = words.share(words.again()), words.share(np.isin(words.hash, _stop_hashes()))
    ends, size = words.share(np.isin(words.last, [46, 33, 63])), alone / np.maximum(1, n)
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    long = np.array([len(d) >= 200 for d in data])
    packed = np.array([len(zlib.compress(d, 1)) / len(d) if some else 1.0 for d, some in zip(data, long)])
    every = np.ones(len(texts), bool)
    table_ = [
        (every, signs < 0.03, signs > 0.06),
        (letters >= 20, capitals < 0.2, capitals > 0.5),
        (every, marked < 0.05, marked > 0.3),
        (n >= 8, again < 0.1, again > 0.3),
        (long, packed > 0.3, packed < 0.15),
        (n >= 25, stop > 0.1, stop < 0.04),
        (n >= 40, (ends > 0.02) & (ends < 0.4), (ends < 0.005) | (ends > 0.8)),
        (n >= 8, (size >= 3) & (size <= 9), (size < 2) | (size > 14)),
    ]
    signs_ = np.stack([np.where(enough & (n > 0), np.where(bad, "-", np.where(good, "+", "0")), "0") for enough, good, bad in table_])
    return ["".join(column) for column in signs_.T.tolist()]


def _stop_hashes() -> np.ndarray:
    if "stop" not in _HELD:
        _HELD["stop"] = Words(sorted(STOP)).hash
    return _HELD["stop"]


def label_model(counts: dict[str, int], rounds: int = 200) -> tuple[dict[str, float], np.ndarray, float]:
    """P(good) of every pattern of votes, each labeller's accuracy on good and on bad texts, and the share of good texts.

    Expectation-maximisation over the counts of patterns (3 ** labellers at most, whatever the corpus holds), which counts every
    document; it starts from whether any labeller objects, as
    each knows one sort of bad text. Labellers are taken as independent in each class, a 0 as a vote that is missing.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}, np.full((len(LABELLERS), 2), 0.5), 0.5
    v = np.array([[{"+": 1, "-": -1}.get(c, 0) for c in p] for p in patterns])
    n = np.array([counts[p] for p in patterns], float)
    good = np.where((v == -1).any(axis=1), 0.1, 0.95)
    accuracy, share = np.full((v.shape[1], 2), 0.5), 0.5
    for _ in range(rounds):
        wg, wb = n * good, n * (1 - good)
        share = float(np.clip((wg.sum() + 1) / (n.sum() + 2), 0.01, 0.99))
        accuracy = np.stack(
            [(wg @ (v == 1) + 2) / (wg @ (v != 0) + 3), (wb @ (v == -1) + 2) / (wb @ (v != 0) + 3)], axis=1
        )  # a labeller is expected to be better than chance
        a, b = accuracy[:, 0], accuracy[:, 1]
        odds = np.log(share / (1 - share)) + (v == 1) @ np.log(a / (1 - b)) + (v == -1) @ np.log((1 - a) / b)
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        moved, good = np.abs(new - good).max(), new
        if moved < 1e-9:
            break
    return dict(zip(patterns, good.tolist())), accuracy, share


def features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hashed feature, weight) of all features, by text: words, shapes of words and words that follow themselves; the weights of
    a text have length one. The labellers' votes are no features, so that the scorer learns from the text what they tell together."""
    if not len(words.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    letters, capitals, alnum = (words.per_word(bit) for bit in (_LETTER, _CAPITAL, _ALNUM))
    form = np.where((capitals > 1) & (capitals == letters), 1, np.where(capitals > 0, 2, np.where(letters > 0, 3, np.where(alnum > 0, 4, 5))))
    run = ~words.plain_end & (words.last == words.before) & (words.end - words.start > 1)
    with np.errstate(over="ignore"):
        shape = ((words.opening.astype(np.uint64) * np.uint64(1 << 21) + np.where(words.plain_end, 0, words.last)) * np.uint64(2) + run) * np.uint64(64)
        shape = _mix(shape + (form * 10 + np.minimum(9, alnum // 3)).astype(np.uint64) + np.uint64(1 << 60))
    again = words.again()
    names = np.concatenate([words.hash % WIDTH, shape % WIDTH, np.full(int(again.sum()), 1, np.uint64)]).astype(np.int64)
    docs = np.concatenate([words.doc, words.doc, words.doc[again]])
    scale = np.concatenate([np.ones(2 * len(words.doc)), np.full(int(again.sum()), 4.0)])
    found, at = np.unique(docs * WIDTH + names, return_inverse=True)
    doc, name = found // WIDTH, found % WIDTH
    weight = np.bincount(at, scale)
    return doc, name, np.sqrt(weight / np.bincount(doc, weight, len(words.texts))[doc])


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 150, ridge: float = 1e-5) -> np.ndarray:
    """Weights of a logistic scorer (the last one is the constant) for soft labels, by Adam over all rows."""
    w = np.zeros(WIDTH + 1)
    if not rows:
        return w
    doc = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    name, value = np.concatenate([r[0] for r in rows]).astype(np.int64), np.concatenate([r[1] for r in rows])
    label = np.array([r[2] for r in rows])
    m, s = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, value * w[name], len(rows)) + w[-1], -30, 30)))
        miss = (p - label) / len(rows)
        g = np.bincount(name, value * miss[doc], WIDTH + 1) + ridge * w
        g[-1] = miss.sum()
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w = w - 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-10)
    return w


def classify(docs: DataFrame, sample: int = 8_000, threshold: float = 0.5, most: int = 2_000) -> DataFrame:
    """`docs` with votes, posterior (P(good) by the votes alone), score (P(good) by the scorer) and kept (score >= threshold).

    Votes of every whole text are counted by pattern, the label model is fitted to all counts, and about `sample` rows, drawn from all
    of them by a hash of doc_id and text, train the scorer with their posteriors as labels, each with its `most` heaviest features (so the
    driver gets 12 x `most` bytes a row at most); it then scores every row by all its features. No row gets a label from outside, and no
    partitioning changes a score by more than rounding. Null texts count as empty; a text without words has no votes, and its score is that of the constant alone. Other
    columns and repeated rows stay; columns of the names above are replaced. An empty table gives an empty result.
    """
    docs = docs.drop("votes", "posterior", "score", "kept")
    small_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit("")).alias("text")

    def count(batches):
        for batch in batches:
            for some in groups(batch.column(0).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(votes(Words(some)), pa.string())], names=["votes"])

    counts = {r["votes"]: r["count"] for r in docs.select(text).mapInArrow(count, "votes string").groupBy("votes").count().collect()}
    posterior, _, share = label_model(counts)
    n = sum(counts.values())

    def featured(batches):
        for batch in batches:
            for some in groups(batch.column(0).to_pylist()):
                words = Words(some)
                signs = votes(words)
                doc, name, weight = features(words)
                heavy = np.lexsort((name, -weight, doc))
                place = np.arange(len(doc)) - np.searchsorted(doc, doc)
                heavy = np.sort(heavy[place < most])
                doc, name, weight = doc[heavy], name[heavy], weight[heavy]
                ends = np.searchsorted(doc, np.arange(1, len(some)))
                cut = lambda x, kind: pa.array([part.astype(kind).tobytes() for part in np.split(x, ends)], pa.binary())
                label = pa.array([posterior.get(v, share) for v in signs], pa.float64())
                yield pa.RecordBatch.from_arrays([cut(name, "<i4"), cut(weight, "<f4"), label], names=["f", "w", "label"])

    below = min(1 << 40, (sample << 40) // max(1, n))
    by = [F.col(c) for c in docs.columns if c in ("doc_id", "text")]
    drawn = docs.filter(F.pmod(F.xxhash64(*by), F.lit(1 << 40)) < below).select(text).mapInArrow(featured, "f binary, w binary, label double")
    rows = sorted(drawn.limit(4 * sample).collect(), key=lambda r: (r["f"], r["w"]))  # more than that only if very many rows are the same
    weights = fit_scorer([(np.frombuffer(r["f"], "<i4"), np.frombuffer(r["w"], "<f4").astype(float), r["label"]) for r in rows])

    @F.pandas_udf("votes string, posterior double, score double, kept boolean")
    def scored(texts: pd.Series) -> pd.DataFrame:
        found, scores = [], []
        for some in groups(texts.tolist()):
            words = Words(some)
            signs = votes(words)
            doc, name, weight = features(words)
            found += signs
            scores.append(1 / (1 + np.exp(-np.clip(np.bincount(doc, weight * weights[name], len(some)) + weights[-1], -30, 30))))
        score = np.concatenate(scores) if scores else np.zeros(0)
        return pd.DataFrame({"votes": found, "posterior": [posterior.get(v, share) for v in found], "score": score, "kept": score >= threshold})

    found = spare(docs, "_found")
    return docs.withColumn(found, scored(text)).select(*docs.columns, f"{found}.*")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


QUERIES = {"op1_quality": op1_quality}
ORACLE: dict[str, str] = {}
