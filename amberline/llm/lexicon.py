"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

Words are counted over all documents; the most frequent ones (a parameter) are merged
exactly and compiled into a minimal acyclic automaton: words share prefixes and
suffixes, every arc carries how many words lie before it, and the sum along a word's
path is its row in the table of ids. The automaton is one flat file that Spark hands to
every executor, where workers map it into memory together. Words outside it are merged
exactly, rank by rank. Each worker remembers a bounded number of recent words.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amberline.llm.common import map_rows, texts
from amberline.llm.packing import _byte_letters
from amberline.session import work_dir

# Fixed values of the vocabulary file's pre-tokeniser: its pattern and its white space.
BLANK = "\t\n\x0b\x0c\r \x85\xa0  -     　"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{BLANK}\p{{L}}\p{{N}}]+")
BLANKS = regex.compile(f"[{BLANK}]+")
# str.split() also splits at these, which are no white space to the pre-tokeniser
ODD = regex.compile("[\x1c-\x1f]")
END = "</w>"
NEVER = 1 << 30
KEPT_CHUNKS = 450_000
COUNTED_WORDS = 400_000
BLOCK_CHARS = 2_000_000


class Merges:
    """Exact byte-level BPE with word ends, from a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        self.ids: dict[str, int] = content["model"]["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in content["model"]["merges"])
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(pairs)}
        self.special = {token["content"]: token["id"] for token in content["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        self.letters = {b: c for c, b in _byte_letters().items()}

    def word(self, word: str) -> list[int]:
        symbols = [self.letters[b] for b in word.encode("utf-8")]
        symbols[-1] += END
        merged = self._short(symbols) if len(symbols) <= 48 else self._long(symbols)
        return [self.ids[s] for s in merged]

    def _short(self, symbols: list[str]) -> list[str]:
        rank = self.ranks.get
        found = [rank(pair, NEVER) for pair in zip(symbols, symbols[1:])]
        while found and (best := min(found)) != NEVER:
            at = found.index(best)
            symbols[at] += symbols.pop(at + 1)
            del found[at]
            if at:
                found[at - 1] = rank((symbols[at - 1], symbols[at]), NEVER)
            if at < len(found):
                found[at] = rank((symbols[at], symbols[at + 1]), NEVER)
        return symbols

    def _long(self, symbols: list[str]) -> list[str]:
        """The same with a heap of pairs and a linked list, for words of any length."""
        n = len(symbols)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := self.ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or symbols[i] != left or symbols[j] != right:
                continue
            symbols[i], alive[j], after[i] = left + right, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := self.ranks.get((symbols[a], symbols[b]))) is not None:
                    heapq.heappush(heap, (r, a, symbols[a], symbols[b]))
        return [s for s, kept in zip(symbols, alive) if kept]


@lru_cache(maxsize=1)
def _merges(path: str) -> Merges:
    return Merges(path)


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The transducer of sorted, distinct, non-empty words as one flat block of bytes.

    States are registered once per set of outgoing arcs as soon as no further word can
    change them, so suffixes are shared and the automaton is minimal.
    """
    register: dict[tuple, int] = {}
    finals: list[int] = []
    arcs_of: list[tuple] = []
    words_of: list[int] = []

    def settle(final: int, arcs: list) -> int:
        key = (final, tuple(arcs))
        if key not in register:
            register[key] = len(finals)
            finals.append(final)
            arcs_of.append(key[1])
            words_of.append(final + sum(words_of[target] for _, target in arcs))
        return register[key]

    open_states: list[list] = [[0, []]]  # along the last word: [final, arcs]; the last arc of each is still open
    last, outputs, starts = b"", [], [0]
    for word, ids in entries:
        shared = len(os.path.commonprefix([last, word]))
        for depth in range(len(last), shared, -1):
            final, arcs = open_states.pop()
            open_states[-1][1].append((last[depth - 1], settle(final, arcs)))
        open_states += [[0, []] for _ in range(len(word) - shared)]
        open_states[-1][0] = 1
        outputs += ids
        starts.append(len(outputs))
        last = word
    for depth in range(len(last), 0, -1):
        final, arcs = open_states.pop()
        open_states[-1][1].append((last[depth - 1], settle(final, arcs)))
    root = settle(*open_states[0])

    keys, targets, skips = [], [], []
    for state, arcs in enumerate(arcs_of):
        skip = finals[state]
        for letter, target in arcs:
            keys.append(state << 8 | letter)
            targets.append(target)
            skips.append(skip)
            skip += words_of[target]
    parts = [np.array(keys, "<i8"), np.array(targets, "<i4"), np.array(skips, "<i4"), np.array(finals, "<i4"),
             np.array(starts, "<i4"), np.array(outputs, "<i4")]
    header = np.array([root, len(keys), len(finals), len(starts), len(outputs)], "<i8")
    return header.tobytes() + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """A compiled transducer, mapped into memory."""

    def __init__(self, path: str):
        block = np.asarray(np.memmap(path, dtype=np.uint8, mode="r"))  # a plain view of the mapped pages
        self.root, arcs, states, starts, outputs = block[:40].view("<i8").tolist()
        at = 40

        def part(n: int, kind: str) -> np.ndarray:
            nonlocal at
            begin, at = at, at + n * np.dtype(kind).itemsize
            return block[begin:at].view(kind)

        self.keys, self.targets, self.skips = part(arcs, "<i8"), part(arcs, "<i4"), part(arcs, "<i4")
        self.finals, self.starts, self.outputs = part(states, "<i4"), part(starts, "<i4"), part(outputs, "<i4")

    def find(self, words: list[bytes]) -> list[list[int] | None]:
        """The ids of each word, None for words outside; one automaton step a letter for all words at once."""
        if not words or not len(self.keys):
            return [None] * len(words)
        lengths = np.array([len(w) for w in words])
        order = np.argsort(-lengths, kind="stable")
        joined = np.frombuffer(b"".join(words), np.uint8)
        begins = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        state = np.full(len(words), self.root, np.int64)
        row = np.zeros(len(words), np.int64)
        for depth in range(int(lengths[0])):
            live = np.searchsorted(-lengths, -depth)  # words longer than depth come first
            on = np.flatnonzero(state[:live] >= 0)
            if not len(on):
                break
            key = state[on] << 8 | joined[begins[on] + depth]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            row[on] += self.skips[arc]
            state[on] = np.where(hit, self.targets[arc], -1)
        known = state >= 0
        known[known] = self.finals[state[known]] == 1
        out: list[list[int] | None] = [None] * len(words)
        begin, end = self.starts[row[known]].tolist(), self.starts[row[known] + 1].tolist()
        for at, b, e in zip(order[known].tolist(), begin, end):
            out[at] = self.outputs[b:e].tolist()
        return out


@lru_cache(maxsize=1)
def _lexicon(name: str) -> Lexicon:
    return Lexicon(SparkFiles.get(name))


def chunks_of(text: str) -> list[str]:
    """A text's chunks between white space after the file's normalisation: NFC, lower case."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each letter is lowered alone: no final sigma
    text = text.lower()
    if ODD.search(text):
        return [c for c in BLANKS.split(text) if c]
    return text.split()


class Coder:
    """Encodes whole texts with a lexicon; remembers recent chunks."""

    def __init__(self, merges: Merges, lexicon: Lexicon):
        self.merges, self.lexicon = merges, lexicon
        self.known: dict[str, tuple[str, str]] = {}  # a chunk's ids and tokens, each joined by blanks
        self.specials = regex.compile("(" + "|".join(map(regex.escape, merges.special)) + ")")

    def learn(self, chunks: set[str]) -> None:
        new = [c for c in chunks if c not in self.known]
        if len(self.known) + len(new) > KEPT_CHUNKS:
            self.known.clear()
            new = list(chunks)
        words = [[c] if c.isalpha() else WORDS.findall(c) for c in new]  # letters alone are one word
        distinct = list({w for ws in words for w in ws})
        found = {w: ids if ids is not None else self.merges.word(w)
                 for w, ids in zip(distinct, self.lexicon.find([w.encode("utf-8") for w in distinct]))}
        tokens = self.merges.tokens
        for chunk, ws in zip(new, words):
            ids = found[ws[0]] if len(ws) == 1 else [i for w in ws for i in found[w]]
            self.known[chunk] = " ".join(map(str, ids)), " ".join([tokens[i] for i in ids])

    def pieces(self, text: str) -> list[str | int]:
        """Chunks, and special tokens as their ids."""
        if not any(token in text for token in self.merges.special):
            return chunks_of(text)
        out: list[str | int] = []
        for at, part in enumerate(self.specials.split(text)):
            out += [self.merges.special[part]] if at % 2 else chunks_of(part)
        return out

    def encode(self, pieces: list[str | int]) -> tuple[str, str]:
        """Decimal ids joined by blanks, and the decoded text."""
        if not pieces:
            return "", ""
        try:
            ids, tokens = zip(*map(self.known.__getitem__, pieces))
        except KeyError:
            ids, tokens = zip(*[(str(p), self.merges.tokens[p]) if isinstance(p, int) else self.known[p] for p in pieces])
        return " ".join(ids), " ".join(tokens)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents; each task adds up its own words before the shuffle."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        chunks: Counter[str] = Counter()

        def words() -> Iterator[tuple]:
            out: Counter[str] = Counter()
            for chunk, n in chunks.items():
                for word in WORDS.findall(chunk):
                    out[word] += n
            yield from out.items()

        for _, text in rows:
            chunks.update(chunks_of(text))
            if len(chunks) > COUNTED_WORDS:
                yield from words()
                chunks.clear()
        yield from words()

    return map_rows(texts(docs), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocabulary: str, size: int) -> str:
    """Compiles the ``size`` most frequent words and returns the name under which executors find the file."""
    spark = docs.sparkSession

    def merge(rows: Iterator[tuple]) -> Iterator[tuple]:
        merges = _merges(vocabulary)
        for word, in rows:
            yield word, merges.word(word)

    frequent = word_counts(docs).where(F.length("word") <= 64).orderBy(F.desc("n"), "word").limit(size).select("word")
    found = map_rows(frequent, merge, "word string, ids array<int>").collect()  # at most ``size`` words of 64 letters
    block = compile_lexicon(sorted((r["word"].encode("utf-8"), r["ids"]) for r in found))
    name = f"lexicon-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{work_dir(spark)}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(block))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def encode(docs: DataFrame, vocabulary: str, lexicon_words: int = 200_000) -> DataFrame:
    """(doc_id, ids, decoded): decimal ids joined by one space and the text they decode to.

    The ids are those of the vocabulary file's own library without added special tokens;
    special strings inside a text become their id, as there. A null, empty or blank text
    has no ids and decodes to the empty text. The lexicon only decides where a word's
    ids come from, never what they are. Repeated rows give repeated results and an empty
    table gives none. ``lexicon_words`` bounds the lexicon and so the file each executor
    fetches (about 40 bytes a word).
    """
    return map_rows(texts(docs), _coded(docs, vocabulary, lexicon_words, lambda ids, decoded: (ids, decoded)), "doc_id long, ids string, decoded string")


def digests(docs: DataFrame, vocabulary: str, lexicon_words: int = 200_000) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of :func:`encode`, without moving the ids."""

    def digest(ids: str, decoded: str) -> tuple[int, str, str]:
        return (ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())

    return map_rows(texts(docs), _coded(docs, vocabulary, lexicon_words, digest),
                    "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _coded(docs: DataFrame, vocabulary: str, lexicon_words: int, result):
    name = build_lexicon(docs, vocabulary, lexicon_words)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        coder = Coder(_merges(vocabulary), _lexicon(name))
        block: list[tuple[int | None, list]] = []
        held = 0

        def coded() -> Iterator[tuple]:
            chunks = set().union(*(pieces for _, pieces in block))
            coder.learn(chunks.difference(coder.merges.special.values()))
            for doc_id, pieces in block:
                yield doc_id, *result(*coder.encode(pieces))

        for doc_id, text in rows:
            block.append((doc_id, coder.pieces(text)))
            held += len(text)
            if held >= BLOCK_CHARS:
                yield from coded()
                block, held = [], 0
        yield from coded()

    return run
