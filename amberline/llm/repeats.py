"""Repeated byte strings by column-wise construction of collection suffix arrays.

Which bytes lie in a ``length``-byte string that starts anywhere else, too?

* Every string of that length has an anchor: the leftmost of its inner ``inner``-byte
  strings with the smallest hash. Equal strings have equal anchors at equal places, so
  only strings around equal anchors need to be compared. The strings that share an
  anchor's place form one segment of the text, about 1.4 lengths long.
* Equal segments are counted first. An anchor with one kind of segment is finished, and
  so is a segment that occurs twice: all its strings do. Copies, however many, go no
  further than these counts.
* The segments of the anchors that are left form collections, in sorted external files
  (the shuffle's, by anchor). One sequential pass builds each collection's suffix array
  column by column from the right: every round inserts one symbol of every segment,
  which is the Burrows-Wheeler column of the round before, by a stable counting sort,
  and updates the common prefixes of neighbours. A string is repeated when its common
  prefix with a neighbour reaches its length.
* A collection too long for one task's block goes by hashes of all its strings instead,
  which are counted with map-side aggregates: the exact way for the rest.

The symbols are the text's bytes. The same construction over the text's words, four
bytes a word (:func:`word_codes`) that are one symbol, finds passages of a number of
words, which may have fewer bytes than ``length``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from amberline.llm.common import map_rows, texts
from amberline.session import materialise

STEP = 1 << 22  # string starts looked at together; places fit in 24 bits
BLOCK = 6_000  # segments of a block, and of the longest collection that is not split
FOUND = 50_000  # anchors that a task gathers for one batch
GROUP = 1 << 17  # bytes of short texts that are looked at together
WORD = 4  # bytes of a word's code
BITMAP = 32768  # bits in one value of bitmap_construct_agg
BITS = 1 << 26  # of the bitmap of anchors met twice: 8 MiB at most
ABSENT = 256  # the symbol of a column that a segment does not have
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_P), -1, 2**64))
_MASK = np.uint64((1 << 24) - 1)


SPACE = np.zeros(256, bool)
SPACE[list(b" \t\n\r\x0b\x0c")] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base, np.uint64))])


class Hasher:
    """Hashes of all strings of ``size`` symbols, or of given ones, from prefix sums of a polynomial mod 2**64."""

    def __init__(self, size: int = 1):
        self.size = size
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        return self.between(data, slice(0, len(data) - self.size + 1), slice(self.size, None))

    def between(self, data: np.ndarray, first: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        n = len(data)
        if len(self.up) < n + 1:
            self.up, self.down = _powers(_P, 2 * n), _powers(_INVERSE, 2 * n)
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n])])
            h = (sums[end] - sums[first]) * self.down[first]
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` values in a row."""
    n = len(values) - width + 1
    full = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    full[:len(values)] = values
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def anchor_runs(data: np.ndarray, length: int, hasher: Hasher, ends: Iterable[int] = ()) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Arrays (key, place, first, last): the strings that start from first to last have their anchor at place.

    ``ends`` says where texts end that lie in ``data`` one after another; no string crosses one.
    """
    whole = np.ones(max(0, len(data) - length + 1), bool)
    for end in ends:
        whole[max(0, end - length + 1):end] = False
    width = length - hasher.size + 1
    for begin in range(0, len(whole), STEP):
        starts = np.flatnonzero(whole[begin:begin + STEP])
        if not len(starts):
            continue
        part = data[begin:begin + STEP + length - 1]
        hashes = hasher(part)
        packed = (hashes & ~_MASK) | np.arange(len(hashes), dtype=np.uint64)
        place = (sliding_least(packed, width) & _MASK).astype(np.int64)[starts]
        edges = np.flatnonzero(np.diff(place)) + 1
        firsts, lasts = starts[np.concatenate([[0], edges])], starts[np.concatenate([edges - 1, [len(place) - 1]])]
        own = place[np.concatenate([[0], edges])]
        yield hashes[own].view(np.int64), own + begin, firsts + begin, lasts + begin


def anchors(data: np.ndarray, length: int, hasher: Hasher) -> Iterator[tuple[int, int, int, int]]:
    """The rows of :func:`anchor_runs`."""
    for found in anchor_runs(data, length, hasher):
        yield from zip(*(c.tolist() for c in found))


def repeated_starts(collection: np.ndarray, symbols: np.ndarray, length: int, absent: int = ABSENT) -> np.ndarray:
    """Which columns of which segments start a string of ``length`` symbols that another segment of its collection has there.

    ``collection`` numbers each row's collection, ascending; ``symbols`` has a row a
    segment, aligned at the anchor, ``absent`` where a segment has no symbol.
    """
    n, columns = symbols.shape
    out = np.zeros((n, columns), bool)
    order = np.arange(n)  # the suffix array of the columns inserted so far, collection by collection
    common = np.zeros(n + 1, np.int32)  # of each suffix with the one before it
    groups = collection.astype(np.uint16)
    for column in range(columns - 1, -1, -1):
        inserted = symbols[order, column]
        by_symbol = np.argsort(inserted, kind="stable")
        by_both = by_symbol[np.argsort(groups[order[by_symbol]], kind="stable")]
        shown = inserted[by_both]
        new_order = order[by_both]
        between = np.minimum.reduceat(common, by_both + 1)[:-1] if n > 1 else common[:0]
        same = (shown[1:] == shown[:-1]) & (shown[1:] != absent) & (groups[new_order[1:]] == groups[new_order[:-1]])
        common = np.zeros(n + 1, np.int32)
        common[1:n][same] = between[same] + 1
        order = new_order
        hit = np.maximum(common[:n], common[1:]) >= length
        out[order[hit], column] = True
    return out


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], starts.view(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2])]


def same_bytes(texts: list[bytes]) -> list[bytes]:
    return texts


_words = Hasher()


def word_codes(texts: list[bytes]) -> list[bytes]:
    """Of each text four bytes a word, words between ASCII white space: equal words have equal codes, and unlike ones hardly ever."""
    data = b" ".join(texts)
    out, firsts, begin = [], [], 0
    while begin < len(data):
        end = begin + STEP
        while end < len(data) and not SPACE[data[end]]:  # no word is cut
            end += 1
        part = np.frombuffer(data, np.uint8)[begin:end]
        edges = np.flatnonzero(np.diff(SPACE[part], prepend=True, append=True))
        out.append((_words.between(part, edges[::2], edges[1::2]) >> np.uint64(32)).astype("<u4"))
        firsts.append(edges[::2] + begin)
        begin = end
    if not out:
        return [b""] * len(texts)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return [c.tobytes() for c in np.split(np.concatenate(out), np.searchsorted(np.concatenate(firsts), ends[:-1]))]


def grouped(texts: Iterable[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts that are looked at together, and the place of the first: short ones, or one longer text."""
    first, group, held = 0, [], 0
    for text in texts:
        if group and held + len(text) > GROUP:
            yield first, group
            first, group, held = first + len(group), [], 0
        group.append(text)
        held += len(text)
    if group:
        yield first, group


RUNS = "key long, segment binary, first int, last int"


def _symbols(block: list[tuple], before: int, length: int, unit: int) -> tuple[np.ndarray, int]:
    """A row of symbols a segment, aligned at the anchor, and the symbol of columns it does not have."""
    if unit == 1:
        shown, absent = [np.frombuffer(row[3], np.uint8) for row in block], ABSENT
    else:  # words by their number among the block's words
        sizes = np.cumsum([len(row[3]) // unit for row in block])
        kinds, numbers = np.unique(np.frombuffer(b"".join(row[3] for row in block), "<u4"), return_inverse=True)
        shown, absent = np.split(numbers, sizes[:-1]), len(kinds)
    symbols = np.full((len(block), (before + length) // unit), absent, np.uint16 if absent < 1 << 16 else np.uint32)
    for row, (_, _, ahead, _), own in zip(symbols, block, shown):
        at = (before - ahead) // unit
        row[at:at + len(own)] = own
    return symbols, absent


def _collections(length: int, inner: int, unit: int):
    """One pass over segments sorted by key: blocks of whole collections."""
    before = length - inner  # the furthest a string's start lies before its anchor

    def solved(block: list[tuple]) -> Iterator[tuple]:
        keys = [row[0] for row in block]
        collection = np.concatenate([[0], np.cumsum([a != b for a, b in zip(keys, keys[1:])])])
        symbols, absent = _symbols(block, before, length, unit)
        for (key, segment, ahead, _), starts in zip(block, repeated_starts(collection, symbols, length // unit, absent)):
            for first, last in _runs(starts):
                yield key, segment, first * unit - before + ahead, last * unit - before + ahead

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        block: list[tuple] = []
        current: list[tuple] = []
        for row in rows:
            if current and row[0] == current[-1][0]:
                if row[1] != current[-1][1]:  # a repeated row gave the same segment again
                    current.append(row)
                continue
            if len(block) + len(current) > BLOCK:
                yield from solved(block) if block else ()
                block = []
            block += current
            current = [row]
        if len(block) + len(current) > BLOCK and block:
            yield from solved(block)
            block = []
        block += current
        if block:
            yield from solved(block)

    return run


def _met_twice(found: DataFrame) -> DataFrame:
    """The rows whose anchor occurs at least twice, and the few that share a bit with one: no other row has a partner."""
    slot, part = F.pmod(F.col("key"), F.lit(BITS)), F.floor(F.pmod(F.col("key"), F.lit(BITS)) / BITMAP).cast("int")
    often = found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    taken = materialise(often.groupBy(part.alias("part")).agg(F.bitmap_construct_agg(slot % BITMAP).alias("taken")), "anchor-bitmap")
    at = slot % BITMAP
    byte = F.conv(F.hex(F.substring("taken", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2 == 1
    # at most BITS / 8 bytes whatever the input's size
    return found.withColumn("part", part).join(F.broadcast(taken), "part").where(held).drop("part", "taken")


def repeated_spans(docs: DataFrame, length: int = 400, inner: int = 100, stream: Callable[[list[bytes]], list[bytes]] = same_bytes, unit: int = 1) -> DataFrame:
    """(text_key, spans): for every text with repeats, the sorted bounds of the covered ranges (not merged) of ``stream`` of its bytes.

    Strings start at multiples of ``unit`` bytes (1, or :data:`WORD` for codes of words), which divides ``length`` and ``inner``.
    """
    text = _keyed(docs)
    found_schema = StructType.fromDDL("text_key binary, doc_id long, key long, segment binary, place int, first int, last int")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, arrow = Hasher(inner // unit), to_arrow_schema(found_schema)

        def gathered(batch: pa.RecordBatch, rows: list[np.ndarray], runs: list[tuple], segments: list[bytes]) -> pa.RecordBatch:
            at = pa.array(np.concatenate(rows))
            key, place, first, last = (np.concatenate(c) for c in zip(*runs))
            columns = [batch.column("text_key").take(at), batch.column("doc_id").take(at), key, segments, *(c.astype(np.int32) for c in (place, first, last))]
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            rows, runs, segments = [], [], []
            for at, group in grouped(c.as_py() for c in batch.column("data")):
                streams = stream(group)
                data, ends = b"".join(streams), np.cumsum([len(d) for d in streams])
                for key, *bounds in anchor_runs(np.frombuffer(data, np.uint8 if unit == 1 else "<u4"), length // unit, hasher, (ends // unit).tolist()):
                    place, first, last = (b * unit for b in bounds)
                    own = np.searchsorted(ends, first, "right")
                    before = (ends - [len(d) for d in streams])[own]
                    rows.append(own + at)
                    runs.append((key, place - before, first - before, last - before))
                    segments += [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(first.tolist(), (last + length).tolist())]
                if len(segments) >= FOUND:
                    yield gathered(batch, rows, runs, segments)
                    rows, runs, segments = [], [], []
            if segments:
                yield gathered(batch, rows, runs, segments)

    found = materialise(text.mapInArrow(find, found_schema), "anchors")
    found = _met_twice(found)
    kinds = found.groupBy("key", "segment").agg(
        F.count("*").alias("n"), F.min(F.struct("text_key", "doc_id", "place", "first", "last")).alias("at")).select("key", "segment", "n", "at.*")
    kinds = materialise(kinds, "segments")
    anchor = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).where("total > 1")
    anchor = materialise(anchor.where("kinds > 1"), "mixed-anchors")
    whole = kinds.where("n > 1").select("key", "segment", F.lit(0).alias("first"), (F.col("last") - F.col("first")).alias("last"))

    # cut each kind of segment out of one row that holds it, not out of every copy of the text
    wanted = kinds.join(anchor, "key").groupBy("text_key", F.coalesce("doc_id", F.lit(0)).alias("row")).agg(
        F.collect_list(F.struct("key", "segment", "kinds", "place", "first", "last")).alias("wanted"))
    wanted = materialise(wanted, "wanted-segments")

    def cut(rows: Iterator[tuple]) -> Iterator[tuple]:
        for whole, *columns in rows:
            data, = stream([whole])
            for key, segment, number, place, first, last in zip(*columns):
                yield key, segment, number, place - first, data[first:last + length]

    # a list a field: Python gets a list of structs as dictionaries
    held = text.withColumn("row", F.coalesce("doc_id", F.lit(0))).join(wanted, ["text_key", "row"]).select(
        "data", *[F.col("wanted")[c].alias(c) for c in ("key", "segment", "kinds", "place", "first", "last")])
    pieces = materialise(map_rows(held, cut, "key long, segment binary, kinds long, ahead int, data binary"), "collections")
    short = pieces.where(F.col("kinds") <= BLOCK).select("key", "segment", "ahead", "data").repartition("key").sortWithinPartitions("key", "segment")
    runs = map_rows(short, _collections(length, inner, unit), RUNS)

    def windows(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, segment, data in rows:
            for start in range(0, len(data) - length + 1, unit):
                yield key, segment, start, xxhash.xxh3_128_digest(data[start:start + length])

    long = pieces.where(F.col("kinds") > BLOCK).select("key", "segment", "data").dropDuplicates(["key", "segment"])
    strings = materialise(map_rows(long, windows, "key long, segment binary, start int, string binary"), "strings")
    often = materialise(strings.groupBy("string").agg(F.count("*").alias("n")).where("n > 1").select("string"), "repeated-strings")
    single = strings.join(often, "string").select("key", "segment", F.col("start").alias("first"), F.col("start").alias("last"))

    runs = materialise(whole.unionByName(runs).unionByName(single), "runs")
    runs = runs.select("key", "segment", F.col("first").alias("run_first"), F.col("last").alias("run_last"))
    covered = found.join(runs, ["key", "segment"]).select(
        "text_key", F.struct((F.col("first") + F.col("run_first")).alias("start"), (F.col("first") + F.col("run_last") + length).alias("end")).alias("span"))
    return materialise(covered.groupBy("text_key").agg(F.sort_array(F.collect_set("span")).alias("spans")), "covered")


def _keyed(docs: DataFrame) -> DataFrame:
    data = F.encode("text", "UTF-8")
    return texts(docs).select("doc_id", F.unhex(F.substring(F.sha2(data, 256), 1, 32)).alias("text_key"), data.alias("data"))


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in spans:
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def removed(docs: DataFrame, length: int = 400, inner: int = 100, passage_words: int = 51, keep_bytes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, n_passage_words[, kept]) of every row.

    Each byte covered by a ``length``-byte string that also starts elsewhere, in the same
    text or another row's, is removed; strings are judged on the input. Texts are UTF-8
    bytes, null texts empty; shorter texts lose nothing. Equal texts in two rows are each
    other's repeats, repeated rows too. An empty table gives no row. Bytes kept may begin
    or end inside a character.

    ``n_passage_words`` counts the words covered by a passage of ``passage_words`` words
    that also starts elsewhere. Such a passage may be shorter than ``length`` bytes, so
    the column is above 0 in rows that lose nothing; it removes nothing. With 0
    ``passage_words`` it is 0.
    """
    if not 1 < inner < length:
        raise ValueError("inner lies between 1 and length")
    spans = repeated_spans(docs, length, inner)

    def finish(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, data, starts, ends, passage_starts, passage_ends in rows:
            joined = merged(zip(starts or [], ends or []))
            kept, last = [], 0
            for start, end in joined:
                kept.append(data[last:start])
                last = end
            left = b"".join([*kept, data[last:]])
            bounds = [{"start": a, "end": b} for a, b in joined]
            covered = sum(b // WORD - -(-a // WORD) for a, b in merged(zip(passage_starts or [], passage_ends or [])))
            yield doc_id, len(data), len(data) - len(left), len(joined), hashlib.sha256(left).hexdigest(), bounds, covered, *([left] if keep_bytes else [])

    rows = _keyed(docs).join(spans, "text_key", "left")
    if passage_words:
        passages = repeated_spans(docs, WORD * passage_words, WORD * max(1, passage_words // 5), word_codes, WORD)
        rows = rows.join(passages.withColumnRenamed("spans", "passages"), "text_key", "left")
    else:
        rows = rows.withColumn("passages", F.lit(None).cast("array<struct<start:int,end:int>>"))
    bounds = [F.col(c)[b].alias(f"{c}_{b}") for c in ("spans", "passages") for b in ("start", "end")]
    return map_rows(rows.select("doc_id", "data", *bounds), finish,
                    "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>, n_passage_words long"
                    + (", kept binary" if keep_bytes else ""))
