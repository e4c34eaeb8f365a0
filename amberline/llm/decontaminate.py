"""Benchmark passages in documents by a prefix-filtered set join.

An item's windows (``window`` consecutive words; a shorter item is one window) and the
documents are sequences of word shingles. A document holds a window only if it holds
all the window's shingles, each at its place.

1. Shingles are ordered by rarity: one scan counts those of the items in all documents.
2. All of a window's shingles are asked for, so its prefix is one shingle, its rarest.
   A window whose rarest shingle occurs nowhere is finished.
3. A second scan posts a document's places of prefix shingles, each with the words
   around it that a window may reach. Both scans look shingles up in a bitmap of fixed
   size first, so other text posts nothing.
4. Posts and windows are joined on the shingle. Positional and length bounds: the
   window begins and ends inside the document. The words at its place are compared
   with the window's, so hashes decide nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amberline.llm.common import map_rows, sha256, texts
from amberline.session import materialise

BITMAP = 32768  # bits in one value of bitmap_construct_agg
_RNG = np.random.default_rng(20250213)
_PLACES = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# A-Z is lowered, digits, small letters and bytes of longer characters are words, all else is blank
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
KNOWN = 300_000  # words whose hashes a task remembers


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < KNOWN:
            self[word] = value
        return value


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each ``size`` consecutive word hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        mixed = np.full(n, size, np.uint64)
        for place in range(size):
            mixed = mixed + hashes[place:place + n] * _PLACES[place % 64]
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return mixed ^ (mixed >> np.uint64(32))


def _windows(items: DataFrame, window: int, key: str) -> tuple[DataFrame, DataFrame]:
    """(words, size) of every different window, and (words, item_id)."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for item_id, text in rows:
            own = words(text)
            size = min(window, len(own))
            for start in range(len(own) - size + 1 if own else 0):
                yield item_id, size, b" ".join(own[start:start + size]).decode()

    held = materialise(map_rows(texts(items, key=key), run, "item_id long, size int, words string").distinct(), "item-windows")
    return held.select("words", "size").distinct(), held.select("words", "item_id")


def _window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """(words, size, shingle, width, place) of every window; ``width`` words a shingle."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        known = _Hashes()
        for own, size in rows:
            width = min(shingle, size)
            hashes = np.fromiter(map(known.__getitem__, own.encode().split(b" ")), np.uint64)
            for place, value in enumerate(shingle_hashes(hashes, width).view(np.int64).tolist()):
                yield own, size, value, width, place

    return map_rows(windows, run, "words string, size int, shingle long, width int, place int")


class Looked:
    """A bitmap of shingle hashes by width: at most ``bits / 8`` bytes, whatever it was made from."""

    def __init__(self, shingles: DataFrame, bits: int):
        slot = F.pmod(F.col("shingle"), F.lit(bits))
        parts = shingles.groupBy(F.floor(slot / BITMAP).cast("int").alias("part")).agg(F.bitmap_construct_agg(slot % BITMAP).alias("taken"))
        taken = np.zeros(bits // 8, np.uint8)
        for part, own in parts.collect():
            taken[part * BITMAP // 8:(part + 1) * BITMAP // 8] = np.frombuffer(own, np.uint8)
        self.bits, self.taken = np.int64(bits), taken
        self.widths = sorted(r["width"] for r in shingles.select("width").distinct().collect())  # at most ``shingle`` of them

    def places(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Where a text's shingles may be among those looked for, and their hashes."""
        values = shingle_hashes(hashes, width).view(np.int64)
        slots = values % self.bits
        found = np.flatnonzero((self.taken[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1)
        return found, values[found]


def _counts(text: DataFrame, looked: Looked) -> DataFrame:
    """(shingle, n): how often the items' shingles occur in all documents."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        known, waiting, held = _Hashes(), [], 0

        def summed() -> Iterator[tuple]:
            values, counts = np.unique(np.concatenate(waiting), return_counts=True)
            yield from zip(values.tolist(), counts.tolist())

        for (own,) in rows:
            hashes = np.fromiter(map(known.__getitem__, words(own)), np.uint64)
            for width in looked.widths:
                _, values = looked.places(hashes, width)
                if len(values):
                    waiting.append(values)
                    held += len(values)
            if held > 1 << 20:
                yield from summed()
                waiting, held = [], 0
        if waiting:
            yield from summed()

    return map_rows(text.select("text"), run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def _posts(text: DataFrame, looked: Looked, window: int) -> DataFrame:
    """(row, doc_id, n_words, posts): one row a document; a post is (shingle, place, ahead, around).

    ``around`` holds the words a window over the shingle may reach, ``ahead`` of them before it.
    """
    numbered = text.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        known = _Hashes()
        for row, doc_id, own in rows:
            split = words(own)
            hashes = np.fromiter(map(known.__getitem__, split), np.uint64)
            posts = []
            for width in looked.widths:
                places, values = looked.places(hashes, width)
                for place, value in zip(places.tolist(), values.tolist()):
                    begin = max(0, place + width - window)
                    posts.append({"shingle": value, "place": place, "ahead": place - begin, "around": b" ".join(split[begin:place + window]).decode()})
            yield row, doc_id, len(split), posts

    return materialise(map_rows(
        numbered, run, "row long, doc_id long, n_words long, posts array<struct<shingle:long,place:int,ahead:int,around:string>>"), "posts")


def _merged(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Runs of hit words from the sorted places of windows."""
    for row, found in rows:
        runs: list[dict] = []
        for x in found:
            if runs and x["start"] <= runs[-1]["end"]:
                runs[-1]["end"] = max(runs[-1]["end"], x["end"])
            else:
                runs.append({"start": x["start"], "end": x["end"]})
        yield row, sum(r["end"] - r["start"] for r in runs), runs


def contaminated(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, item_key: str = "item_id", bits: int = 1 << 24) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids, spans) of every row.

    A word is hit when it lies in an occurrence of any window; ``spans`` are the hit
    runs of words (first, last + 1). Null texts have no words; items without words have
    no window. Rows that repeat an item_id are one item; windows of items without id hit
    words, but are nobody's: they are not counted in ``n_items``. Rows that repeat a
    doc_id, or have none, each get their own result. Empty tables: no document, no row;
    no item, nothing hit. ``bits`` sizes the bitmap and changes no result.
    """
    if not 1 <= shingle <= window or bits % BITMAP:
        raise ValueError(f"shingle lies between 1 and window, bits is a multiple of {BITMAP}")
    text = texts(docs)
    windows, owners = _windows(items, window, item_key)
    shingles = materialise(_window_shingles(windows, shingle), "window-shingles")
    counts = materialise(_counts(text, Looked(shingles, bits)), "shingle-counts")
    rarest = shingles.join(counts, "shingle", "left").groupBy("words", "size").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "place", "width")).alias("first"))
    prefix = materialise(rarest.where("first.n > 0").select("words", "size", F.col("first.shingle").alias("shingle"), F.col("first.place").alias("inside"),
                                                            F.col("first.width").alias("width")), "window-prefixes")
    posts = _posts(text, Looked(prefix, bits), window)
    posted = posts.where(F.size("posts") > 0).select("row", "n_words", F.explode("posts").alias("post")).select("row", "n_words", "post.*")
    # a shingle that many documents hold is a hot key; Spark broadcasts prefixes of a small measured size, else splits it
    met = posted.join(prefix, "shingle")
    start = F.col("place") - F.col("inside")
    inside = (F.col("inside") <= F.col("ahead")) & (start + F.col("size") <= F.col("n_words"))
    met = met.where(inside).select("row", start.alias("start"), "size", "words", (F.col("ahead") - F.col("inside")).alias("skip"), "around")
    at = F.slice(F.split("around", " "), F.col("skip") + 1, F.col("size"))
    same = met.where(F.array_join(at, " ") == F.col("words")).select("row", "start", (F.col("start") + F.col("size")).alias("end"), "words")
    same = materialise(same, "occurrences")

    hit = same.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("found"))
    spans = map_rows(hit, _merged, "row long, n_hit long, spans array<struct<start:int,end:int>>")
    held = same.select("row", "words").distinct().join(owners, "words").where(F.col("item_id").isNotNull()).select("row", F.col("item_id").cast("string").alias("item"))
    held = held.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    none = F.array().cast("array<string>")
    out = posts.select("row", "doc_id", "n_words").join(spans, "row", "left").join(held, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(F.coalesce("item_ids", none)).cast("long").alias("n_items"),
        sha256(F.array_join(F.coalesce("item_ids", none), ",")).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))
