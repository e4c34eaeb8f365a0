"""Near duplicates by an inverted join over the coordinates of MinHash signatures.

1. Every text becomes the set of its word shingles, and of equal sets only the smallest
   id goes on. A signature has 64 posted coordinates, and 256 of eight bits for counting.
2. Representatives are posted under each coordinate-value pair. A pair of texts above
   the threshold agrees in at least ``t`` of the 64 (but for one in 100,000 borderline
   pairs), so it meets under one of the 64 - t + 1 pairs that are rarest in each text: the
   prefix. Values nobody shares fill the prefix first, so a text with too many of them
   is skipped without being posted, and common passages post nothing.
3. Under one posting, matches are counted over the long signature; of postings with the
   very same texts one is enough. Long lists are dealt to pairs of blocks. The first
   round keeps, for each list, a forest of the best matches, one link a text at most.
   Those are confirmed on full shingle sets and joined to components.
4. Texts that matches connect, confirmed or not, form a family. The second round goes
   back only to families that hold several components, dealt to pairs of blocks again,
   and compares the full sets of matching texts while they are in different
   components. Pairs within one component cannot change it, so neither round writes out
   more than one link a text and block.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amberline.llm.common import content_key, drop_rows, map_rows, texts
from amberline.llm.components import components
from amberline.session import materialise

POSTED, COUNTED = 64, 256
MISS = 1e-5
BLOCK = 1_000  # members of a block of a long list
_RNG = np.random.default_rng(20240531)
_FACTORS = _RNG.integers(0, 2**63, COUNTED, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """A word's 64-bit hash, remembered while there is room."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 400_000:
            self[word] = value
        return value


def shingle_set(text: str, k: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; A-Z is lowered, words lie between ASCII white space.

    A text of fewer than ``k`` words has its whole sequence as one shingle, one without
    words has none.
    """
    words = np.fromiter(map(known.__getitem__, text.encode("utf-8", "surrogatepass").lower().split()), np.uint64)
    if not len(words):
        return words
    size = min(k, len(words))
    with np.errstate(over="ignore"):
        mixed = np.full(len(words) - size + 1, size, np.uint64)
        for place in range(size):
            mixed = mixed + words[place:len(words) - size + 1 + place] * _PLACES[place % 64]
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest of each coordinate's hash values."""
    least = np.full(COUNTED, np.uint64(2**64 - 1))
    with np.errstate(over="ignore"):
        for begin in range(0, len(shingles), 1024):
            hashed = shingles[begin:begin + 1024, None] * _FACTORS
            np.minimum(least, hashed.min(0), out=least)
    return least >> np.uint64(24)


def least_matches(n: int, similarity: float) -> int:
    """How many of n coordinates all but one in 1 / MISS pairs of this similarity agree in, at least."""
    below = 0.0
    for matches in range(n + 1):
        below += math.comb(n, matches) * similarity**matches * (1 - similarity) ** (n - matches)
        if below > MISS:
            return matches
    return n


def _signed(text: DataFrame, k: int) -> DataFrame:
    """The signature of every row of (doc_id, content, text)."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        known = WordHashes()
        for doc_id, content, text in rows:
            shingles = shingle_set(text, k, known)
            if not len(shingles):
                yield doc_id, content, 0, None, None, None
                continue
            coordinates = signature(shingles)
            yield (doc_id, content, len(shingles), xxhash.xxh3_128_hexdigest(shingles.tobytes()),
                   coordinates[:POSTED].astype(np.uint32).view(np.int32).tolist(), coordinates.astype(np.uint8).tobytes())

    return map_rows(text, run, "doc_id long, content string, n_shingles long, set_key string, posted array<int>, counted binary")


def _vertices(named: DataFrame) -> DataFrame:
    """(set_key, first_id, doc_id): every set's smallest id, and its vertex in the graph.

    The vertex is that id. Where several sets have the same smallest id, the first of
    them takes it and the others a hash, so that texts under one id stay apart.
    """
    first = materialise(named.groupBy("set_key").agg(F.min("doc_id").alias("first_id")), "first-of-set")
    owner = first.groupBy("first_id").agg(F.min("set_key").alias("owner"), F.count("*").alias("sets")).where("sets > 1").drop("sets")
    other = F.col("owner").isNotNull() & (F.col("owner") != F.col("set_key"))
    return materialise(first.join(owner, "first_id", "left").select(
        "set_key", "first_id", F.when(other, F.xxhash64("first_id", "set_key")).otherwise(F.col("first_id")).alias("doc_id")), "vertices")


def _postings(signed: DataFrame, matches: int) -> DataFrame:
    """(list, left, right, doc_id, own, counted): members of each list of two or more, by pairs of blocks."""
    posts = signed.select("doc_id", F.posexplode("posted").alias("at", "value")).select("doc_id", F.xxhash64("at", "value").alias("token"))
    shared = posts.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(shared, "shared-values")
    # the prefix has POSTED - matches + 1 places; values nobody shares take theirs first
    spare = F.size("rarest") - (matches - 1)
    rarest = posts.join(shared, "token").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("rarest")).where(spare > 0)
    listed = rarest.select("doc_id", F.explode(F.slice("rarest", F.lit(1), spare)).alias("post")).select("doc_id", "post.token")
    listed = materialise(listed, "postings")
    own = F.xxhash64("doc_id")
    sizes = listed.groupBy("token").agg(F.count("*").alias("n"), F.sum(own % (1 << 40)).alias("sum"), F.bit_xor(own).alias("xor")).where("n > 1")
    lists = materialise(sizes.groupBy("n", "sum", "xor").agg(F.min("token").alias("token")).select("token", "n"), "lists")
    members = _blocks(listed.join(lists, "token").withColumnRenamed("token", "list"))
    return materialise(members.join(signed.select("doc_id", "counted"), "doc_id"), "members")


def _blocks(members: DataFrame) -> DataFrame:
    """(doc_id, list, left, right, own): each member in all pairs of blocks of its list of ``n`` that hold its own block."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    return members.select("doc_id", "list", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")).select(
        "doc_id", "list", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "own")


def _groups(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows in runs of equal first three values."""
    for _, run in itertools.groupby(rows, key=lambda row: row[:3]):
        yield sorted(run, key=lambda row: row[3])


def _grouped(members: DataFrame, columns: list[str], find: Callable[[list[tuple]], Iterator[tuple]]) -> DataFrame:
    """Links (a, b) that ``find`` sees in each pair of blocks; rows are (list, left, right, doc_id, *columns)."""
    place = ["list", "left", "right"]
    sorted_rows = members.select(*place, "doc_id", *columns).repartition(*place).sortWithinPartitions(*place)
    found = map_rows(sorted_rows, lambda rows: (link for group in _groups(rows) for link in find(group)), "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _signatures(group: list[tuple], at: int) -> np.ndarray:
    return np.frombuffer(b"".join(row[at] for row in group), np.uint8).reshape(len(group), COUNTED)


def _counts(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return (many == one).sum(1)


def _forest(group: list[tuple], matches: int) -> Iterator[tuple[int, int]]:
    """Prim's tree of most matches over the members, cut where fewer than ``matches`` agree."""
    rows = _signatures(group, 4)
    best, link, waiting = np.full(len(group), -1), np.zeros(len(group), int), np.ones(len(group), bool)
    at = 0
    for _ in range(len(group) - 1):
        waiting[at] = False
        left = np.flatnonzero(waiting)
        counts = _counts(rows[at], rows[left])
        nearer = counts > best[left]
        best[left[nearer]], link[left[nearer]] = counts[nearer], at
        at = left[np.argmax(best[left])]
        if best[at] >= matches:
            yield group[link[at]][3], group[at][3]


def _across(group: list[tuple], matches: int, percent: int) -> Iterator[tuple[int, int]]:
    """Links that join components: full sets of matching members are compared while their components differ.

    Rows are (list, left, right, doc_id, own block, component, signature, set).
    """
    rows = _signatures(group, 6)
    own = np.array([row[4] for row in group])
    component = np.array([row[5] for row in group])
    sets = [np.frombuffer(row[7], np.uint64) for row in group]
    sizes = np.array([len(s) for s in sets])
    split = own.min() != own.max()
    for at in range(len(group)):
        other = np.flatnonzero(component[at + 1:] != component[at]) + at + 1
        if split:
            other = other[own[other] != own[at]]  # pairs inside a block are its own pair's work
        # sets of very different size cannot be similar
        other = other[(100 * np.minimum(sizes[other], sizes[at]) >= percent * np.maximum(sizes[other], sizes[at]))]
        if len(other):
            other = other[_counts(rows[at], rows[other]) >= matches]
        for some in np.split(other, range(256, len(other), 256)):
            some = some[component[some] != component[at]]
            if not len(some):
                continue
            joined = np.concatenate([sets[j] for j in some])
            place = np.minimum(np.searchsorted(sets[at], joined), sizes[at] - 1)
            common = np.add.reduceat((sets[at][place] == joined).astype(np.int64), np.cumsum(sizes[some]) - sizes[some])
            for j in some[100 * common >= percent * (sizes[at] + sizes[some] - common)]:
                if component[j] != component[at]:
                    component[component == component[j]] = component[at]
                    yield group[at][3], group[j][3]


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    a, b = (sets.select(F.col("doc_id").alias(f"id_{s}"), F.col("shingles").alias(f"set_{s}")) for s in "ab")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for first, second, *both in rows:
            x, y = (np.frombuffer(s, np.uint64) for s in both)
            common = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * common >= percent * (len(x) + len(y) - common):
                yield first, second

    both = pairs.join(a, pairs["a"] == F.col("id_a")).join(b, pairs["b"] == F.col("id_b"))
    return map_rows(both.select("a", "b", "set_a", "set_b"), run, "a long, b long")


def classes(docs: DataFrame, k: int = 5, percent: int = 80, contents: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, set_key[, content]) for every row.

    Two texts are linked when 100 times what their sets share is at least ``percent``
    times their union; a component's id is its smallest doc_id and that row is kept.
    Texts without words (null, empty, blank) are linked with nothing. A row without
    doc_id is linked with nothing, has no component and is kept. Rows that repeat an id
    are linked by their texts like any others. An empty table gives no row. ``contents``
    adds :func:`common.content_key`, which tells such rows apart.
    """
    if not 50 <= percent <= 100 or not 1 <= k <= 64:
        raise ValueError("percent lies between 50 and 100, k between 1 and 64")
    text = texts(docs)
    matches = least_matches(POSTED, percent / 100)
    content = content_key("text") if contents else F.lit(None).cast("string")
    signed = materialise(_signed(text.select("doc_id", content.alias("content"), "text"), k), "signatures")
    named = signed.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    first = _vertices(named)
    shown = named.withColumnRenamed("doc_id", "first_id").join(first, ["set_key", "first_id"]).select("doc_id", "set_key", "posted", "counted").dropDuplicates(["set_key"])
    groups = _postings(shown, matches)
    counted = least_matches(COUNTED, percent / 100)

    trees = materialise(_grouped(groups, ["counted"], lambda group: _forest(group, counted)), "best-matches")
    wanted = trees.select(F.col("a").alias("wanted")).union(trees.select("b")).distinct()

    def full(rows: Iterator[tuple]) -> Iterator[tuple]:
        known = WordHashes()
        for vertex, key, own_text in rows:
            shingles = shingle_set(own_text, k, known)
            if xxhash.xxh3_128_hexdigest(shingles.tobytes()) == key:
                yield vertex, shingles.tobytes()

    keyed = first.join(wanted, first["doc_id"] == wanted["wanted"], "left_semi").select("first_id", F.col("doc_id").alias("vertex"), "set_key")
    sets = map_rows(text.join(keyed, text["doc_id"] == keyed["first_id"]).select("vertex", "set_key", "text"), full, "doc_id long, shingles binary")
    sets = materialise(sets.dropDuplicates(["doc_id"]), "full-sets")
    links = materialise(_confirmed(trees, sets, percent), "links")

    family = components(trees).select(F.col("id").alias("doc_id"), F.col("component_id").alias("list"))
    near = components(links)
    placed = family.join(near, family["doc_id"] == near["id"], "left").select("doc_id", "list", F.coalesce("component_id", "doc_id").alias("component_id"))
    placed = materialise(placed, "families")
    divided = placed.groupBy("list").agg(F.count("*").alias("n"), F.min("component_id").alias("low"), F.max("component_id").alias("high"))
    # a family of two has been compared already
    divided = materialise(divided.where("low <> high AND n > 2").select("list", "n"), "divided-families")
    rest = placed.join(divided, "list")
    known = rest.select("doc_id", "component_id").join(shown.select("doc_id", "counted"), "doc_id").join(sets, "doc_id")
    rest = _blocks(rest).join(known, "doc_id")
    across = _grouped(rest, ["own", "component_id", "counted", "shingles"], lambda group: _across(group, counted, percent))
    links = links.union(materialise(across, "links"))

    # equal sets under one id each: a class's members take its component
    near = components(links.select("a", "b"))
    placed = materialise(first.join(near, first["doc_id"] == near["id"], "left").select("set_key", "first_id", F.col("component_id").alias("component")), "placed-sets")
    least = placed.where("component IS NOT NULL").groupBy("component").agg(F.min("first_id").alias("least"))
    labelled = materialise(placed.join(least, "component", "left").select("set_key", F.coalesce("least", "first_id").alias("class_id")), "classes")
    out = signed.select("doc_id", "n_shingles", "set_key", "content")
    joined = out.withColumn("join_key", F.coalesce("set_key", F.concat(F.lit("none-"), F.col("doc_id").cast("string")), F.lit("none"))).join(
        labelled.withColumnRenamed("set_key", "join_key"), "join_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), "set_key", *(["content"] if contents else []))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id.

    Rows go by id and text, so another text under a dropped row's id stays, and rows of
    one component that share its smallest id all stay.
    """
    return drop_rows(docs, classes(docs, k, percent, contents=True).where(~F.col("kept")).select("doc_id", "content"))
