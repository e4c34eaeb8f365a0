"""Hierarchical packing of tokenised documents into windows of several context sizes.

Every task packs the documents of its own input split, so nothing is shuffled and a
lost task is simply run again. Within a task documents come in blocks of a bounded
number of tokens.

* Routing: a document is cut into whole windows of the longest size, and what remains
  goes to the tier of the smallest context size that holds it.
* Packing: tiers are packed one by one, from the longest down. A tier's own pieces open
  its windows, the longest first. The gap of a window is filled from the shorter tiers,
  always with the longest piece that fits, and within the shortest tier from that tier.
  Where none fits, the head of the shortest piece fills the gap and the rest of that
  piece is routed again. Only a block's last window can stay short: it is closed at the
  smallest power of two that holds it.
* Steps: a step group holds windows of one tier and always the same number of tokens, in
  whichever task it was made. What a task has left of each tier at its end is put
  together to mixed groups of that very number, so that all step groups of the table are
  equal but for one a task.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from amberline.llm.common import map_rows, texts

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_length long, padded_length long, step_group long")
SEPARATOR = b"\0\0\0\0"  # id 0 ends every document


class ByteBpe:
    """Ids of a byte-level BPE vocabulary file, as little-endian unsigned 32-bit bytes.

    A text is encoded by one call. Where words have a long tail, most of the time would
    go into filling a memory of words that are not seen again.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        self.special = [token["content"] for token in content["added_tokens"]]
        to_byte = _byte_letters()
        ranks = {bytes(to_byte[c] for c in token): rank for token, rank in content["model"]["vocab"].items() if token not in self.special}
        self.encoding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        if any(token in text for token in self.special):
            return b"".join(i.to_bytes(4, "little") for i in self.library.encode(text, add_special_tokens=False).ids)
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, others from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=1)
def _encoder(path: str) -> ByteBpe:
    return ByteBpe(path)


class Tiers:
    """Pieces (document, start, length) of a block by length; a tier is a range of lengths.

    One bit a length says where pieces are, so the longest piece that fits a gap and the
    shortest piece of all are found without going through the lengths.
    """

    def __init__(self, longest: int):
        self.pieces: list[list[tuple[int, int, int]]] = [[] for _ in range(longest + 1)]
        self.held = 0

    def route(self, piece: tuple[int, int, int]) -> None:
        self.pieces[piece[2]].append(piece)
        self.held |= 1 << piece[2]

    def longest_within(self, size: int) -> tuple[int, int, int] | None:
        """Takes the longest piece of at most ``size`` tokens."""
        fits = self.held & ((2 << size) - 1)
        return self._take(fits.bit_length() - 1) if fits else None

    def shortest(self) -> tuple[int, int, int] | None:
        return self._take((self.held & -self.held).bit_length() - 1) if self.held else None

    def _take(self, length: int) -> tuple[int, int, int]:
        stack = self.pieces[length]
        piece = stack.pop()
        if not stack:
            self.held ^= 1 << length
        return piece


@dataclass
class Packer:
    """Packs one task's blocks; ``ids`` are byte strings of four bytes a token."""

    longest: int
    shortest: int
    step_windows: int
    first_id: int
    windows: int = 0
    steps: int = 0
    open_steps: dict[int, list[list[tuple]]] = field(default_factory=dict)  # padded length -> windows without a full step

    def pack(self, docs: list[tuple[object, bytes]]) -> Iterator[tuple]:
        """Rows of all windows whose step is full; the others wait for the next block or :meth:`finish`."""
        tiers = Tiers(self.longest)
        for at, (_, ids) in enumerate(docs):
            tokens = len(ids) // 4
            whole = tokens // self.longest * self.longest
            for start in range(0, whole, self.longest):
                yield from self._close([(at, start, self.longest)], docs)
            if tokens > whole:
                tiers.route((at, whole, tokens - whole))
        tier = self.longest
        while tier >= self.shortest:
            below = tier // 2 if tier > self.shortest else 0
            while tiers.held.bit_length() - 1 > below:
                yield from self._close(self._window(tier, tiers), docs)
            tier //= 2

    def _window(self, tier: int, tiers: Tiers) -> list[tuple[int, int, int]]:
        """A window of the tier, opened by its longest piece and filled from the tiers below."""
        window = [tiers.longest_within(tier)]
        gap = tier - window[0][2]
        while gap and tiers.held:
            if (piece := tiers.longest_within(gap)) is None:
                doc, start, length = tiers.shortest()
                piece = doc, start, gap
                tiers.route((doc, start + gap, length - gap))
            window.append(piece)
            gap -= piece[2]
        return window

    def _close(self, window: list[tuple[int, int, int]], docs: list[tuple[object, bytes]]) -> Iterator[tuple]:
        total = sum(length for _, _, length in window)
        padded = 1 << (total - 1).bit_length()
        offset, sequence = 0, self.first_id + self.windows
        self.windows += 1
        rows = []
        for doc, start, length in window:
            doc_id, ids = docs[doc]
            crc = zlib.crc32(memoryview(ids)[4 * start: 4 * (start + length)])
            rows.append((doc_id, start, length, crc, len(ids) // 4, sequence, offset, total, padded))
            offset += length
        waiting = self.open_steps.setdefault(padded, [])
        waiting.append(rows)
        if len(waiting) * padded == self.step_windows * self.longest:
            yield from self._step(self.open_steps.pop(padded))

    def _step(self, windows: list[list[tuple]]) -> Iterator[tuple]:
        step = self.first_id + self.steps
        self.steps += 1
        return (row + (step,) for rows in windows for row in rows)

    def finish(self) -> Iterator[tuple]:
        """Rows of the windows still waiting: longest first they fill steps exactly, as sizes are powers of two."""
        step, room = [], self.step_windows * self.longest
        for padded in sorted(self.open_steps, reverse=True):
            for rows in self.open_steps.pop(padded):
                step.append(rows)
                room -= padded
                if not room:
                    yield from self._step(step)
                    step, room = [], self.step_windows * self.longest
        if step:
            yield from self._step(step)


def pack(docs: DataFrame, vocabulary: str, longest: int = 1024, shortest: int = 128, step_windows: int = 8,
         block_tokens: int = 4_000_000) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    ``longest`` and ``shortest`` are powers of two; the tiers' context sizes are the
    powers between them. ``block_tokens`` bounds what a task holds at once and changes no
    row's meaning. A document's ids are the vocabulary's, then id 0; a null or empty text
    is the single id 0, so it has one piece. Equal or repeated rows are packed as often as
    they occur. A ``step_group`` holds windows of ``step_windows`` times ``longest``
    tokens with padding, each task's last one possibly fewer. An empty table gives no row.
    """
    for size in (longest, shortest):
        if size < 1 or size & (size - 1):
            raise ValueError("tiers are powers of two")
    if shortest > longest:
        raise ValueError("the shortest tier is longer than the longest")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        encoder = _encoder(vocabulary)
        packer = Packer(longest, shortest, step_windows, TaskContext.get().partitionId() << 33)
        block: list[tuple[int | None, bytes]] = []
        held = 0
        for doc_id, text in rows:
            ids = encoder.ids(text) + SEPARATOR
            block.append((doc_id, ids))
            held += len(ids) // 4
            if held >= block_tokens:
                yield from packer.pack(block)
                block, held = [], 0
        yield from packer.pack(block)
        yield from packer.finish()

    return map_rows(texts(docs), run, SCHEMA)
