"""Packing against a plain tokenisation: each id in one piece, gapless sequences, little padding."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from amberline.llm import packing

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a", "two  blanks and\ttabs \n lines\n\n end ", "it's <|endoftext|> inside", "Ünï¢ødé 你好 ²³ Ⅷ١٢", " lead", "trail ",
         "x" * 5000, "word " * 3000, "word " * 3000, "a\x1cb c\x85 d e", "don't we'll\nI'm 12 345,6"]


@pytest.fixture(scope="module")
def rows(spark):
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "x", 1), (3, "a", "x", 1)],
                                  "doc_id long, text string, length string, offset int").coalesce(2)
    return frame, [r.asDict() for r in packing.pack(frame, VOCABULARY, longest=256).collect()]


def test_each_id_lies_in_one_piece(rows):
    library = Tokenizer.from_file(VOCABULARY)
    for i, text in enumerate(TEXTS):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        own = sorted((r for r in rows[1] if r["doc_id"] == i), key=lambda r: (r["start"], r["sequence_id"]))
        assert {r["doc_tokens"] for r in own} == {len(ids)}
        copies = 2 if i == 3 else 1
        assert sum(r["length"] for r in own) == copies * len(ids)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes())
    assert sum(r["doc_id"] is None for r in rows[1]) == 1


def test_a_text_of_rare_words_is_encoded_by_one_call(monkeypatch):
    """op6: no call a word, however many words were never seen."""
    encoder, calls = packing.ByteBpe(VOCABULARY), []

    class Spy:
        def encode_to_numpy(self, text, **options):
            calls.append(text)
            return own.encode_to_numpy(text, **options)

    own = encoder.encoding
    monkeypatch.setattr(encoder, "encoding", Spy())
    text = " ".join(f"w{i}x{i * 7}" for i in range(2000))
    found = np.frombuffer(encoder.ids(text), "<u4").tolist()
    assert found == Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids
    assert calls == [text]


def test_sequences_are_gapless_and_nearly_full(rows):
    sequences = {}
    for r in rows[1]:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == list(np.cumsum([0] + [r["length"] for r in pieces])[:-1])
        total = sum(r["length"] for r in pieces)
        assert total == pieces[0]["sequence_length"] <= 256 and total <= pieces[0]["padded_length"] < 2 * total
    padding = sum(p[0]["padded_length"] - p[0]["sequence_length"] for p in sequences.values())
    assert padding < 2 * 256  # the last window of each of two tasks


def test_step_groups_hold_equal_tokens(rows):
    groups = {}
    for r in {r["sequence_id"]: r for r in rows[1]}.values():
        groups.setdefault(r["step_group"], []).append(r["padded_length"])
    short = [g for g, sizes in groups.items() if sum(sizes) != 8 * 256]
    assert max(map(sum, groups.values())) == 8 * 256
    assert len(short) == len({g >> 33 for g in short}) <= 2  # one a task, its last


def _packed(lengths, longest=64, shortest=8, step_windows=4, blocks=1):
    """Windows of a packer over documents of these token counts, as (padded length, [(doc, start, length)], step)."""
    packer = packing.Packer(longest, shortest, step_windows, 0)
    docs = [(i, bytes(4 * n)) for i, n in enumerate(lengths)]
    size = -(-len(docs) // blocks) or 1
    out = [r for b in range(blocks) for r in packer.pack(docs[b * size:(b + 1) * size])] + list(packer.finish())
    windows = {}
    for doc, start, length, _, _, sequence, offset, _, padded, step in out:
        windows.setdefault(sequence, []).append((offset, doc, start, length, padded, step))
    return [(w[0][4], [p[1:4] for p in w], w[0][5]) for w in (sorted(windows[s]) for s in sorted(windows))]


def test_a_window_is_opened_by_its_tier_and_filled_from_shorter_ones():
    # tiers 8, 16, 32, 64: 40 and 50 open windows of 64, 20 one of 32
    windows = _packed([40, 50, 20, 24, 14, 12, 6, 2])
    assert windows[0] == (64, [(1, 0, 50), (4, 0, 14)], 0)
    assert windows[1] == (64, [(0, 0, 40), (3, 0, 24)], 0)
    assert windows[2] == (32, [(2, 0, 20), (5, 0, 12)], windows[2][2])
    assert windows[3] == (8, [(6, 0, 6), (7, 0, 2)], windows[3][2])


def test_tiers_of_a_mixed_table_are_all_used_and_full():
    rng = np.random.default_rng(5)
    lengths = [int(n) for n in np.concatenate([rng.integers(1, 9, 300), rng.integers(9, 33, 60), rng.integers(33, 65, 10), rng.integers(65, 900, 9)])]
    windows = _packed(lengths)
    assert {w[0] for w in windows} >= {64, 32, 16, 8}
    assert sum(sum(p[2] for p in pieces) != padded for padded, pieces, _ in windows) <= 1
    for padded, pieces, _ in windows[:-1]:
        if padded > 8 and pieces[0][2] < padded:
            assert padded // 2 < pieces[0][2]  # the opener is of the window's tier, the others fit beneath it
            assert all(p[2] <= padded // 2 for p in pieces[1:])
    for doc, n in enumerate(lengths):
        own = sorted((p[1], p[2]) for _, pieces, _ in windows for p in pieces if p[0] == doc)
        assert [s for s, _ in own] == list(np.cumsum([0] + [k for _, k in own])[:-1]) and sum(k for _, k in own) == n


def test_steps_of_several_blocks_are_equal():
    rng = np.random.default_rng(6)
    windows = _packed([int(n) for n in rng.integers(1, 200, 500)], blocks=5)
    steps = {}
    for padded, _, step in windows:
        steps[step] = steps.get(step, 0) + padded
    assert sorted(steps) == list(range(len(steps))) and sum(v != 4 * 64 for v in steps.values()) <= 1


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).count() == 0


def test_tiers_are_powers_of_two(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY, longest=1000)
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY, longest=128, shortest=256)
