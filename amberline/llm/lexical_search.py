"""Ranked lexical search by scanning documents with an automaton of all items' terms.

There is no index of documents. The items' distinct terms become one Aho-Corasick
automaton, each term guarded by a boundary on both sides, so that it is found as a
whole term only; a term's output leads to the items that hold it. Two scans of the
documents answer all items:

1. how many documents hold a term of any kind (N), their terms with repeats (L), and
   the documents that hold each item term (df);
2. every document's matches are its tf; the outputs spread each term's part of the
   score over the items, and a task keeps ``top`` documents an item.

Items are dealt to shards, so that an automaton and its outputs have a size bound
whatever the number of items; each shard scans the documents by itself.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from amberline.llm.common import map_rows, texts
from amberline.session import materialise

MOST_PAIRS = 1_000_000  # (item, term) pairs of a shard: what a task's automaton and outputs are made of
SALTS = 256  # first level of the final ranking
_GUARD = 0x20
# what bounds a term becomes a blank, A-Z is lowered, bytes of longer characters stay
_PLAIN = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else _GUARD for b in range(256))


def plain(text: str) -> bytes:
    """The text's UTF-8 bytes: letters lowered, everything outside a term blank."""
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN)


def guarded_automaton(terms: list[bytes]) -> ahocorasick.Automaton:
    """Finds ``terms`` between boundaries in a guarded plain text; a match gives the term's place in the list."""
    automaton = ahocorasick.Automaton()
    for place, term in enumerate(terms):
        automaton.add_word(f" {term.decode('latin-1')} ", place)
    automaton.make_automaton()
    return automaton


def frequencies(automaton: ahocorasick.Automaton, text: bytes) -> Counter:
    """How often each term of the automaton occurs in a plain text."""
    return Counter(map(itemgetter(1), automaton.iter(f" {text.decode('latin-1')} ")))


def length_part(n: int, n_docs: int, n_terms: int) -> int:
    """m: a document's length beside the mean one, in per cent of its weight."""
    return 100 - 90 + (90 * n * n_docs) // n_terms


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _item_terms(items: DataFrame, key: str) -> DataFrame:
    """(item_id, term) once each, items with their shard key."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for item_id, text in rows:
            for term in set(plain(text).split()):
                yield item_id, term

    found = map_rows(texts(items, key=key), run, "item_id long, term binary")
    return materialise(found.distinct(), "item-terms")


def _shards(pairs: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Pairs with the shard of their item; no shard holds over ``most`` pairs unless it is one item."""
    sizes = materialise(pairs.groupBy("item_id").agg(F.count("*").alias("n")), "item-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // most))
    while True:
        dealt = F.pmod(F.xxhash64("item_id"), F.lit(shards)).alias("shard")
        over = sizes.groupBy(dealt).agg(F.sum("n").alias("n"), F.count("*").alias("items")).where((F.col("n") > most) & (F.col("items") > 1))
        if over.isEmpty():
            return pairs.select("*", dealt), shards
        shards *= 2


class Outputs:
    """A shard's terms and, for every term, its items: the automaton's outputs as flat arrays."""

    def __init__(self, pairs: list[tuple]):
        self.items = sorted({item for item, _ in pairs}, key=lambda item: (item is None, item))
        self.terms = sorted({bytes(term) for _, term in pairs})
        item_place = {item: i for i, item in enumerate(self.items)}
        term_place = {term: i for i, term in enumerate(self.terms)}
        flat = sorted((term_place[bytes(term)], item_place[item]) for item, term in pairs)
        self.flat = np.array([item for _, item in flat], np.int64)
        self.begin = np.searchsorted(np.array([term for term, _ in flat], np.int64), np.arange(len(self.terms) + 1))

    def spread(self, terms: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """Each item's sum of the parts of its terms."""
        counts = self.begin[terms + 1] - self.begin[terms]
        ahead = np.cumsum(counts) - counts
        places = np.arange(counts.sum()) + np.repeat(self.begin[terms] - ahead, counts)
        sums = np.zeros(len(self.items), np.int64)
        np.add.at(sums, self.flat[places], np.repeat(parts, counts))
        return sums


def _statistics(text: DataFrame, outputs: Outputs) -> tuple[int, int, np.ndarray]:
    """N, L and the shard's df."""
    terms = outputs.terms

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        automaton = guarded_automaton(terms)
        held: Counter = Counter()
        for (own,) in rows:
            words = plain(own)
            if n := len(words.split()):
                held.update(frequencies(automaton, words).keys())
                held[-1] += 1
                held[-2] += n
        yield from held.items()

    counted = map_rows(text.select("text"), run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = dict(counted.collect())  # a shard's terms at most
    return found.get(-1, 0), found.get(-2, 0), np.array([found.get(i, 0) for i in range(len(terms))], np.int64)


def _best(text: DataFrame, outputs: Outputs, n_docs: int, n_terms: int, df: np.ndarray, top: int) -> DataFrame:
    """(item_id, doc_id, score): every task's ``top`` documents an item."""
    weights = np.array([term_weight(n_docs, int(n)) for n in df], np.int64)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        automaton = guarded_automaton(outputs.terms)
        kept: list[list[tuple]] = [[] for _ in outputs.items]
        least = np.zeros(len(outputs.items), np.int64)  # a document with this score may still come in by its id
        for order, (doc_id, own) in enumerate(rows):
            words = plain(own)
            found = frequencies(automaton, words)
            if not found:
                continue
            m = length_part(len(words.split()), n_docs, n_terms)
            terms, tf = np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))
            scores = outputs.spread(terms, weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m)))
            for item in np.flatnonzero((scores >= least) & (scores > 0)).tolist():
                heap = kept[item]
                # smallest first: low scores, then large ids, rows without an id before all of them
                entry = (int(scores[item]), doc_id is not None, -(doc_id or 0), order)
                if len(heap) < top:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
                if len(heap) == top:
                    least[item] = heap[0][0]
        for item, heap in zip(outputs.items, kept):
            for score, has_id, minus, _ in heap:
                yield item, -minus if has_id else None, score

    return map_rows(text, run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = 10, item_key: str = "item_id", most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents with a score above 0, all if fewer.

    Equal scores go by ascending doc_id; rows without an id count in the statistics and
    rank behind equal scores with one; rows that repeat an id rank each by itself. Rows
    that repeat an item_id are one item with all their terms, so are those without one.
    Null texts have no terms; an item without terms, or without documents, has no row.
    ``most_pairs`` bounds a shard and changes no result.
    """
    if top < 1 or most_pairs < 1:
        raise ValueError("top and most_pairs are at least 1")
    text = texts(docs)
    pairs, shards = _shards(_item_terms(items, item_key), most_pairs)
    found = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    for shard in range(shards):
        outputs = Outputs(pairs.where(F.col("shard") == shard).select("item_id", "term").collect())  # at most ``most_pairs``
        if not outputs.terms:
            continue
        n_docs, n_terms, df = _statistics(text, outputs)
        best = _best(text, outputs, n_docs, max(n_terms, 1), df, top)
        if shards > 1:
            best = materialise(best, "best-of-shard")
        found = found.unionByName(best)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")
