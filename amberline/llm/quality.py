"""Quality by weak labels: overlapping heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer.

1. Every labeller votes good, bad or nothing on a text, in one pass over all texts that
   also takes down the hashed features.
2. Equal vote patterns are counted; expectation-maximisation over the pattern counts of
   the whole corpus estimates each labeller's vote probabilities for good and bad texts
   and the share of bad ones. There are at most 3 to the number of labellers patterns.
3. A logistic scorer over the hashed features is trained on posterior labels. Its rows
   are a bounded sample: each pattern gets the same expected number, picked by a hash of
   the content, and rows weigh as much as they stand for.
4. The scorer judges every text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amberline.llm.common import map_rows, texts
from amberline.session import materialise

GOOD, BAD, NONE = 1, 0, -1
SIZE = 4_096  # slots of the hashed features
REMEMBERED = 400_000


@dataclass(frozen=True)
class Shape:
    """What the labellers look at."""

    words: int
    upper: float  # share of words in capitals
    marked: float  # share of words that end in two or more marks
    symbols: float  # share of words without a letter or digit
    plain: float  # share of words of letters, not all capitals, with at most a sentence mark after them
    repeated: float  # share of words equal to the one before
    distinct: float  # distinct words to words, within 100 words at a time
    stops: float  # share of words that end a sentence
    lines: float  # share of lines that repeat an earlier one


# Each labeller votes on a shape; they overlap and may err.
LABELLERS = {
    "capitals": lambda s: BAD if s.upper > 0.3 else NONE,
    "marks": lambda s: BAD if s.marked > 0.3 else NONE,
    "tables": lambda s: BAD if s.symbols > 0.2 else NONE,
    "stutter": lambda s: BAD if s.repeated > 0.3 else NONE,
    "prose": lambda s: NONE if not s.words else BAD if s.plain < 0.65 and s.words >= 12 else GOOD if s.plain > 0.8 and s.repeated < 0.2 else NONE,
    "variety": lambda s: NONE if s.words < 20 else BAD if s.distinct < 0.35 else GOOD if s.distinct > 0.6 else NONE,
    "sentences": lambda s: NONE if s.words < 30 else BAD if s.stops < 0.015 else GOOD if s.stops < 0.3 and s.plain > 0.65 and s.repeated < 0.2 else NONE,
    "lines": lambda s: BAD if s.lines > 0.5 else NONE,
    "empty": lambda s: BAD if not s.words else NONE,
}


def _kind(word: str) -> str:
    """A word's form: case, letters or not, and the marks it ends in."""
    core = word.rstrip(".,;:!?")
    end = word[len(core):][:2]
    if not any(c.isalnum() for c in core):
        return "s" + core[:2] + end
    case = "U" if core.isupper() and len(core) > 1 else "T" if core[0].isupper() else "l"
    return case + ("" if core.isalpha() else "m") + ("" if core[-1].isalnum() else core[-1]) + end


class Words(dict):
    """A word as one number, remembered while there is room: 32 bits of hash, 16 of its kind's hash, 5 of marks."""

    def __missing__(self, word: str) -> int:
        marks = (word.isupper() and sum(c.isalpha() for c in word) > 1) | (len(word) > 2 and not word[-1].isalnum() and not word[-2].isalnum()) << 1
        marks |= (not any(c.isalnum() for c in word)) << 2 | (word[-1] in ".!?") << 3
        core = word[:-1] if len(word) > 1 and word[-1] in ".,;:!?" else word
        marks |= (core.isalpha() and not marks & 1) << 4
        value = zlib.crc32(word.encode("utf-8", "surrogatepass")) << 21 | (zlib.crc32(_kind(word).encode("utf-8", "surrogatepass")) & 0xFFFF) << 5 | marks
        if len(self) < REMEMBERED:
            self[word] = value
        return value


def described(text: str, known: Words) -> tuple[Shape, np.ndarray, np.ndarray]:
    """The text's shape, and its hashed features as slots and values."""
    codes = np.fromiter(map(known.__getitem__, text.split()), np.int64)
    rows = [row for row in text.split("\n") if row.strip()]
    n = len(codes)
    if not n:
        shape = Shape(0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
        return shape, np.array([0], np.uint16), np.array([1.0], np.float32)
    upper, marked, symbols, stops, plain = (float((codes >> bit & 1).mean()) for bit in range(5))
    word, kind = codes >> 21, codes >> 5 & 0xFFFF
    same = word[1:] == word[:-1]
    repeated = float(same.sum()) / n
    padded = np.concatenate([word, -1 - np.arange(-n % 100)]).reshape(-1, 100)
    padded.sort(1)
    distinct = (float((padded[:, 1:] != padded[:, :-1]).sum()) + len(padded) - (-n % 100)) / n
    shape = Shape(n, upper, marked, symbols, plain, repeated, distinct, stops, 1 - len(set(rows)) / max(len(rows), 1))
    pairs = (kind[:-1] * 31 + kind[1:] * 17 + same * 7 + 1) % SIZE
    slots, count = np.unique(np.concatenate([kind % SIZE, pairs]), return_counts=True)
    steps = [int(v * 20) for v in (upper, marked, symbols, plain, repeated, distinct, stops * 4, shape.lines)] + [min(n, 1 << 20).bit_length()]
    own = np.array([(at * 131 + step * 7 + 3) * 2_654_435_761 % SIZE for at, step in enumerate(steps)])
    return shape, np.concatenate([slots, own]).astype(np.uint16), np.concatenate([count / n, np.full(len(own), 0.5)]).astype(np.float32)


def votes(shape: Shape) -> str:
    """One letter a labeller: + good, - bad, . nothing."""
    return "".join({GOOD: "+", BAD: "-", NONE: "."}[vote(shape)] for vote in LABELLERS.values())


@dataclass(frozen=True)
class LabelModel:
    """P(good), and for good and bad texts each labeller's probabilities of its three votes."""

    share_good: float
    given: np.ndarray  # (class: bad, good; labeller; vote: -, ., +)

    def good(self, patterns: list[str]) -> np.ndarray:
        """The posterior probability of good for each pattern."""
        codes = np.array([["-.+".index(c) for c in p] for p in patterns])
        # a labeller that does not vote says nothing: most only know one sort of bad text
        log = np.where(codes == 1, 0.0, np.log(self.given)[:, np.arange(codes.shape[1]), codes]).sum(-1)
        odds = log[1] - log[0] + np.log(self.share_good / (1 - self.share_good))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit_label_model(counts: dict[str, int], steps: int = 200) -> LabelModel:
    """Expectation-maximisation over vote patterns and their counts.

    It begins with good where nobody votes bad. Each labeller keeps a small share of
    votes of every sort, and better votes good than bad of good texts, so that the
    classes cannot change places.
    """
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    codes = np.array([["-.+".index(c) for c in p] for p in patterns])
    good = np.array([0.05 if "-" in p else 0.95 for p in patterns])
    share, given = 0.5, np.full((2, codes.shape[1], 3), 1 / 3)
    for _ in range(steps):
        share = float(np.clip((n * good).sum() / n.sum(), 0.01, 0.99))
        given = np.empty((2, codes.shape[1], 3))
        for cls, weight in ((0, n * (1 - good)), (1, n * good)):
            for vote in range(3):
                given[cls, :, vote] = (weight[:, None] * (codes == vote)).sum(0)
            # smoothing: a hundredth of the class, and a vote against the class at most as likely as in the other
            given[cls] = (given[cls] + 0.01 * weight.sum() + 1) / (weight.sum() * 1.03 + 3)
        given[1, :, 0] = np.minimum(given[1, :, 0], given[0, :, 0])
        given /= given.sum(-1, keepdims=True)
        before, good = good, LabelModel(share, given).good(patterns)
        if np.abs(before - good).max() < 1e-7:
            break
    return LabelModel(share, given)


def fit_scorer(slots: list[np.ndarray], values: list[np.ndarray], target: np.ndarray, weight: np.ndarray, steps: int = 300) -> np.ndarray:
    """Weights of a logistic scorer (the last is the intercept) for soft targets, by Adam on all rows at once."""
    design = np.zeros((len(slots), SIZE + 1), np.float32)
    for row, at, v in zip(design, slots, values):
        np.add.at(row, at, v)
    design[:, SIZE] = 1
    weight = (weight / weight.sum()).astype(np.float32)
    beta, mean, square = (np.zeros(SIZE + 1, np.float32) for _ in range(3))
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (p - target)) + 1e-5 * beta
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        beta = beta - 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
    return beta.astype(np.float32)


@dataclass(frozen=True)
class Scorer:
    weights: np.ndarray

    def good(self, slots: np.ndarray, values: np.ndarray) -> float:
        raw = float((self.weights[slots] * values).sum() + self.weights[SIZE])
        return 1 / (1 + float(np.exp(-np.clip(raw, -30, 30))))


def _described(docs: DataFrame) -> DataFrame:
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        known = Words()
        for doc_id, text in rows:
            shape, slots, values = described(text, known)
            yield doc_id, votes(shape), zlib.crc32(text.encode("utf-8", "surrogatepass")), slots.tobytes(), values.tobytes()

    return materialise(map_rows(texts(docs), run, "doc_id long, votes string, content long, slots binary, features binary"), "described")


def _fit(found: DataFrame, sample: int) -> tuple[LabelModel, dict[str, float], Scorer]:
    counts = {r["votes"]: r["n"] for r in found.groupBy("votes").agg(F.count("*").alias("n")).collect()}  # at most 3 to the labellers
    if not counts:
        return LabelModel(0.5, np.full((2, len(LABELLERS), 3), 1 / 3)), {}, Scorer(np.zeros(SIZE + 1, np.float32))
    model = fit_label_model(counts)
    patterns = sorted(counts)
    posterior = dict(zip(patterns, model.good(patterns).tolist()))
    quota = sample / len(patterns)
    rates = found.sparkSession.createDataFrame(pd.DataFrame({"votes": patterns, "rate": [min(1.0, quota / counts[p]) for p in patterns]}))
    picked = found.join(F.broadcast(rates), "votes").where(F.col("content") < F.col("rate") * float(1 << 32))
    # copies share their hash and so come together; no more than the stated bound goes to the driver
    rows = picked.orderBy("content", "votes").limit(2 * sample).select("votes", "slots", "features").collect()
    if not rows:
        return model, posterior, Scorer(np.zeros(SIZE + 1, np.float32))
    drawn = pd.Series([r["votes"] for r in rows]).value_counts()
    weight = np.array([(counts[r["votes"]] / drawn[r["votes"]]) ** 0.5 for r in rows])
    weights = fit_scorer([np.frombuffer(r["slots"], np.uint16) for r in rows], [np.frombuffer(r["features"], np.float32) for r in rows],
                         np.array([posterior[r["votes"]] for r in rows], np.float32), weight)
    return model, posterior, Scorer(weights)


def classify(docs: DataFrame, sample: int = 4_000, threshold: float = 0.5) -> DataFrame:
    """(doc_id, votes, weak_label, score, kept) of every row.

    ``weak_label`` is the label model's posterior of good for the row's votes, ``score``
    the scorer's. The scorer is fitted to at most twice ``sample`` rows; everything else
    counts all rows. Null and blank texts are judged like others (a labeller votes them
    bad); repeated rows are judged each; an empty table gives no row.
    """
    found = _described(docs)
    _, posterior, scorer = _fit(found, sample)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, own, slots, values in rows:
            score = scorer.good(np.frombuffer(slots, np.uint16), np.frombuffer(values, np.float32))
            yield doc_id, own, posterior[own], score, score >= threshold

    return map_rows(found.select("doc_id", "votes", "slots", "features"), run, "doc_id long, votes string, weak_label double, score double, kept boolean")


def keep_good(docs: DataFrame, sample: int = 4_000, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows the scorer rejects; all columns as they were."""
    _, _, scorer = _fit(_described(docs), sample)
    at = docs.columns.index("text")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        known = Words()
        for row in rows:
            _, slots, values = described(row[at] or "", known)
            if scorer.good(slots, values) >= threshold:
                yield row

    return map_rows(docs, run, docs.schema)
