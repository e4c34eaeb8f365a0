"""Each stage of the pipeline against a plain version, on the stage's own input, and the registered queries' shape."""

import public_tokenizers
from pyspark.sql import Row
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline as p
from amberline.llm import pii, quality
from amberline.llm.common import read

from test_minhash_join import brute

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_do_what_they_say(spark):
    assert [name for name, _ in p.STAGES] == ["quality classifier", "exact dedup", "minhash near-dedup", "pii", "packing"]
    junk = [Row(doc_id=9000 + i, text="LOUD!! NOISE!! AGAIN!! " * 30, lang="en", source="s", n_chars=1) for i in range(3)]
    twins = [Row(doc_id=9100 + i, text="The same fine sentence, said twice. And another one here.", lang="en", source="s", n_chars=1) for i in range(2)]
    docs = read(spark, SF, "documents").unionByName(spark.createDataFrame([*junk, *twins])).withColumnRenamed("source", "source")
    stages = dict(p.STAGES)
    kept = stages["quality classifier"](spark, docs, SF)
    assert kept.columns == docs.columns
    good = {r["doc_id"] for r in quality.classify(docs).collect() if r["kept"]}
    assert rows_of(kept) == [r for r in rows_of(docs) if r[docs.columns.index("doc_id")] in good] and not good & {9000, 9001, 9002}

    exact = stages["exact dedup"](spark, kept, SF)
    last = {}
    for r in kept.collect():
        last[r["text"]] = max(last.get(r["text"], -1), r["doc_id"])
    assert {r["doc_id"] for r in exact.collect()} == set(last.values()) and exact.columns == docs.columns

    near = stages["minhash near-dedup"](spark, exact, SF)
    plain = brute([(r["doc_id"], r["text"]) for r in exact.collect()], 5, 80)
    assert {r["doc_id"] for r in near.collect()} == {i for i, (_, c) in plain.items() if i == c} and near.columns == docs.columns

    clean = stages["pii"](spark, near, SF)
    before, after = ({r["doc_id"]: r for r in d.collect()} for d in (near, clean))
    assert before.keys() == after.keys() and clean.columns == docs.columns
    for i, r in after.items():
        spans = pii.base_spans(before[i]["text"])
        assert not pii.base_spans(r["text"]) or spans
        assert r["n_chars"] == len(r["text"]) or not spans
        assert all(before[i]["text"][s:e] not in r["text"] for s, kind, e in spans if kind == "email")

    pieces = stages["packing"](spark, clean, SF).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    held = {}
    for r in pieces:
        held[r["doc_id"]] = held.get(r["doc_id"], 0) + r["length"]
    assert held == {i: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for i, r in after.items()}


def test_run_on_a_table_without_rows(spark, tmp_path):
    read(spark, SF, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_its_query():
    names = contract.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
