"""Toxic passages by maximum-scoring segments over token log-odds.

A token is a word or, for words too rare to be judged themselves, the beginning of a
word (many languages inflect and compound). A word said again and again counts once.

1. Token document counts by class come from all labelled training rows; a Dirichlet
   prior, half a document plus a part in proportion to the corpus, shrinks each token's
   log-odds, and a token scores what is left of them after three standard deviations
   (where nothing is left, the drift).
2. A linear scan (Ruzzo and Tompa's all maximal scoring subsequences) finds every
   passage whose sum cannot be enlarged.
3. Passages of clean training rows set the tail: in a clean text of n tokens about
   K n exp(-lambda s) passages score s or more, which gives the best few passages of a
   text together an extreme-value p-value. -ln p is turned into a probability by a
   logistic fit on a histogram of the training rows.

Held-out rows give neither token counts nor tail nor fit. The token table sent to the
workers holds every token that scores, and of the others those that keep a word from
being judged by its beginning.
"""

from __future__ import annotations

import logging
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amberline.llm.common import map_rows, texts
from amberline.session import materialise

WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = range(4, 9)  # letters of a word's beginning
COUNTED = 400_000
REMEMBERED = 400_000
PASSAGES = "array<struct<start:int,end:int,score:double>>"
BIN = 0.25  # width of a bin of -ln p
CAP = 60.0  # -ln p beyond this is one bin


class WordScores(dict):
    """Each word's score, worked out once while there is room."""

    def __init__(self, tokens: dict[str, float], drift: float):
        super().__init__()
        self.tokens, self.drift = tokens, drift

    def __missing__(self, word: str) -> float:
        score = self.tokens.get(word)
        if score is None:
            beginnings = (self.tokens.get(word[:n] + "*") for n in BEGINNINGS)
            score = max((b for b in beginnings if b is not None), key=abs, default=0.0)
        score = score or -self.drift
        if len(self) < REMEMBERED:
            self[word] = score
        return score


def held_out(doc_id: Column | str) -> Column:
    """crc32 of the id's decimal text leaves remainder 1 by 3."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of labelled rows outside the held-out third, one row per id; of differing labels the larger holds."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    return rows.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def token_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(token, toxic, clean): training documents of each class that hold the token; the empty token counts documents."""
    # labels grow with the corpus, so the join is never left to depend on their size
    rows = texts(docs).where(~held_out("doc_id")).join(training_labels(labels).hint("merge"), "doc_id").select("toxic", "text")

    def run(found: Iterator[tuple]) -> Iterator[tuple]:
        by_class: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def counted() -> Iterator[tuple]:
            for token in by_class[0].keys() | by_class[1].keys():
                yield token, by_class[1][token], by_class[0][token]
            for c in by_class:
                c.clear()

        for toxic, text in found:
            by_class[bool(toxic)].update({"", *WORD.findall(text.lower())})
            if len(by_class[0]) + len(by_class[1]) > COUNTED:
                yield from counted()
        yield from counted()

    return map_rows(rows, run, "token string, toxic long, clean long").groupBy("token").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def token_scores(counts: DataFrame, lexicon_size: int, prior: float = 100.0, deviations: float = 3.0, rare: int = 7) -> dict[str, float]:
    """Shrunk log-odds of words in more than ``rare`` training documents and of the beginnings of rarer ones.

    Zero where a token does not tell the classes apart by ``deviations`` standard
    deviations. Tokens without a score are left out, as they get the drift anyway, except
    words that begin like a scoring beginning: those score zero, so it is not asked. No
    token is left out for want of room; a table of more than ``lexicon_size`` is logged,
    since every worker holds it.
    """
    counts = materialise(counts, "toxic-tokens")
    totals = {r["is_doc"]: (r["toxic"] or 0, r["clean"] or 0) for r in counts.groupBy((F.col("token") == "").alias("is_doc")).agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect()}
    toxic, clean = totals.get(False, (0, 0))
    if not toxic or not clean:
        return {}
    alpha = F.lit(0.5) + F.lit(prior) * (F.col("toxic") + F.col("clean")) / F.lit(float(toxic + clean))
    in_toxic, in_clean = F.col("toxic") + alpha, F.col("clean") + alpha
    odds = F.log(in_toxic / (F.lit(toxic + prior) - in_toxic)) - F.log(in_clean / (F.lit(clean + prior) - in_clean))
    sure = F.greatest(F.abs(odds) - F.lit(deviations) * F.sqrt(1 / in_toxic + 1 / in_clean), F.lit(0.0))

    def begun(rows: DataFrame) -> DataFrame:
        return rows.withColumn("beginning", F.explode(F.array(*[
            F.when(F.length("token") >= n, F.concat(F.substring("token", 1, n), F.lit("*"))) for n in BEGINNINGS]))).where(F.col("beginning").isNotNull())

    words = counts.where(F.col("token") != "")
    many = F.col("toxic") + F.col("clean") > rare
    scored = F.signum(odds) * sure
    beginnings = begun(words.where(~many)).groupBy(F.col("beginning").alias("token")).agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    beginnings = materialise(beginnings.where(many & (sure > 0)).select("token", scored.alias("score")), "toxic-beginnings")
    silent = begun(words.where(many & (sure <= 0)).select("token")).join(
        beginnings.select(F.col("token").alias("beginning")), "beginning", "left_semi").select("token", F.lit(0.0).alias("score")).distinct()
    found = words.where(many & (sure > 0)).select("token", scored.alias("score")).unionByName(beginnings).unionByName(silent).collect()
    if len(found) > lexicon_size:
        logging.getLogger(__name__).warning("the table of toxic tokens has %d entries, more than %d", len(found), lexicon_size)
    return {r["token"]: r["score"] for r in found}


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring subsequences as (begin, end, sum), in linear time."""
    kept: list[tuple[int, int, float, float]] = []  # begin, end, sum before, sum through
    total = 0.0
    for at, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        segment = (at, at + 1, before, total)
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= segment[2]:
                j -= 1
            if j < 0 or kept[j][3] >= segment[3]:
                break
            segment = (kept[j][0], segment[1], kept[j][2], segment[3])
            del kept[j:]
        kept.append(segment)
    return [(b, e, through - before) for b, e, before, through in kept]


def passages(docs: DataFrame, scores: dict[str, float], drift: float = 0.2) -> DataFrame:
    """(doc_id, n_tokens, passages): every maximal passage of a text with its code point offsets and score."""
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        known = WordScores(scores, drift)
        for doc_id, text in rows:
            lowered = text.lower()
            lowered = lowered if len(lowered) == len(text) else "".join(c.lower()[0] for c in text)
            words = WORD.findall(lowered)
            values = [0.0 if w == before else known[w] for w, before in zip(words, [None, *words])]
            found = []
            if values and max(values) > 0:
                at = [m.span() for m in WORD.finditer(lowered)]
                found = [{"start": at[b][0], "end": at[e - 1][1], "score": s} for b, e, s in maximal_segments(values)]
            yield doc_id, len(words), found

    return map_rows(texts(docs), run, "doc_id long, n_tokens long, passages " + PASSAGES)


@dataclass(frozen=True)
class Tail:
    """Passages of clean text: ``rate`` a token, their scores above zero exponential with ``decay``."""

    rate: float
    decay: float

    def surprise(self, scores: list[float], tokens: int) -> float:
        """-ln of the probability that a clean text of so many tokens holds passages this good.

        The sum statistic of extreme-value theory: with s the r best scores' sum, each
        scaled by the decay and less the log of the passages expected,
        P = exp(-s) s^(r-1) / (r! (r-1)!); a factor of two is paid for each further r.
        """
        base = math.log(self.rate * max(tokens, 1))
        best, total, factorials = 0.0, 0.0, 0.0
        for r, score in enumerate(sorted(scores, reverse=True), 1):
            total += self.decay * score - base
            factorials += math.log(r) + math.log(max(r - 1, 1))
            if total > 0:
                best = max(best, total - (r - 1) * math.log(total) + factorials - r * math.log(2))
        return min(best, CAP)


def fit_tail(found: DataFrame, labels: DataFrame) -> Tail:
    """From the passages of clean training rows, with one passage of score 1 added."""
    clean = found.join(training_labels(labels).where("toxic = 0"), "doc_id")
    r = clean.select("n_tokens", F.size("passages").alias("n"), F.aggregate("passages", F.lit(0.0), lambda a, p: a + p["score"]).alias("s")).agg(
        F.sum("n_tokens").alias("tokens"), F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    n, total = (r["n"] or 0) + 1, (r["s"] or 0.0) + 1.0
    return Tail(n / ((r["tokens"] or 0) + 100), n / total)


def fit_logistic(x: np.ndarray, weight_bad: np.ndarray, weight_good: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(intercept, slope) of P(bad | x) over weighted bins by Newton steps, with a weak prior on the slope."""
    beta, penalty = np.zeros(2), np.diag([1e-3, 1e-2])
    design, weight = np.stack([np.ones_like(x), x], 1), weight_bad + weight_good
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight_bad - weight * p) - penalty @ beta
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + penalty
        step = np.linalg.solve(curve, gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, lexicon_size: int = 50_000) -> DataFrame:
    """(doc_id, held_out, score, predicted, surprise, n_passages, passages) for every row.

    A null or empty text has no passage and the score of such texts. Without labels of
    both classes no token scores and every row gets the base rate (0.5 without any).
    Rows repeated in ``docs`` are scored each; in ``labels`` an id counts once. Neither
    ids nor labels nor any column but the text enters a score.
    """
    lexicon = token_scores(token_counts(docs, labels), lexicon_size)
    found = materialise(passages(docs, lexicon), "toxic-passages")
    tail = fit_tail(found, labels)

    def judged(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, n_tokens, passed in rows:
            yield doc_id, tail.surprise([p["score"] for p in passed], n_tokens), passed

    found = map_rows(found, judged, "doc_id long, surprise double, passages " + PASSAGES)
    bins = found.join(training_labels(labels), "doc_id").groupBy(F.round(F.col("surprise") / BIN).cast("int").alias("bin")).agg(
        F.sum("toxic").alias("bad"), F.count("*").alias("n")).collect()  # at most CAP / BIN rows
    x = np.array([r["bin"] * BIN for r in bins], float)
    bad, n = np.array([r["bad"] for r in bins], float), np.array([r["n"] for r in bins], float)
    intercept, slope = fit_logistic(x, bad, n - bad) if len(bins) else (0.0, 0.0)
    p = 1 / (1 + F.exp(-(F.lit(intercept) + F.lit(slope) * F.col("surprise"))))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), p.alias("score"), (p >= threshold).cast("int").alias("predicted"),
                        "surprise", F.size("passages").alias("n_passages"), "passages")
