"""The lexicon's ids and decoded texts against the tokenizers library on the same file."""

import hashlib
import itertools

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from amberline.llm import lexicon
from amberline.llm.common import read

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " \n\t ", "Hello, WORLD's don't WE'LL", "a\x1cb\x1f c\x85d\xa0e　f", "x<|endoftext|>y <|startoftext|>", "ΣΑΣ ΟΔΟΣ İstanbul ǅ",
         "éà Å ½²Ⅷ 12345 你好 🙂🙂!?", "ab" * 2000, "repeated repeated", "repeated repeated", "un<|endoftext"]


@pytest.mark.parametrize("words", [0, 3, 5000])
def test_ids_and_decoded_text_are_the_librarys(spark, words):
    own = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id")]
    given = read(spark, "/root/testdata/sf0.001", "documents").limit(60).selectExpr("doc_id + 1000 AS doc_id", "text")
    docs = spark.createDataFrame(own, "doc_id long, text string").union(given).selectExpr("doc_id", "text", "1 AS ids", "'x' AS word")
    library = Tokenizer.from_file(VOCABULARY)
    expected = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        expected.append((r["doc_id"], " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)))
    got = [tuple(r) for r in lexicon.encode(docs, VOCABULARY, words).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected))
    digests = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in lexicon.digests(docs, VOCABULARY, words).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert digests == {(i, len(ids.split()), sha(ids), sha(text)) for i, ids, text in expected}


def test_transducer_is_minimal_and_finds_exactly_its_words(tmp_path):
    words = sorted("".join(p).encode() for n in (1, 2, 3, 4) for p in itertools.product("abc", repeat=n) if p[-1] != "b")
    block = lexicon.compile_lexicon((w, [i, len(w)]) for i, w in enumerate(words))
    (tmp_path / "f").write_bytes(block)
    found = lexicon.Lexicon(str(tmp_path / "f"))
    assert found.find(words) == [[i, len(w)] for i, w in enumerate(words)]
    assert found.find([b"b", b"ab", b"abcab", b"d", b"aaaaa"]) == [None] * 5
    # states by what may follow: (up to 4, 3, 2, 1 letters, none) x final or not; the root is never final
    assert len(found.finals) <= 9


def test_empty_table(spark):
    assert lexicon.digests(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY, 10).count() == 0


def test_long_words_merge_like_short_ones():
    merges = lexicon.Merges(VOCABULARY)
    for word in ("internationalisation", "aaaaaaaaaaaaaaaa", "the" * 10):
        letters = [merges.letters[b] for b in word.encode()]
        letters[-1] += "</w>"
        assert merges._short(list(letters)) == merges._long(list(letters))
