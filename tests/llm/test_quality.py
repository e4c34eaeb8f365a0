"""The label model on made votes, the scorer against given labels, odd rows."""

import numpy as np

from amberline.llm import quality as q
from amberline.llm.common import read


def test_label_model_finds_the_labellers_accuracies():
    rng = np.random.default_rng(4)
    good = rng.random(20_000) < 0.8
    right = [0.95, 0.9, 0.8, 0.7]
    counts = {}
    for g in good:
        pattern = "".join("." if rng.random() < 0.2 else "+-"[int((rng.random() < a) != g)] for a in right)
        counts[pattern] = counts.get(pattern, 0) + 1
    model = q.fit_label_model(counts)
    assert abs(model.share_good - 0.8) < 0.03
    for at, a in enumerate(right):
        assert abs(model.given[1, at, 2] / (1 - model.given[1, at, 1]) - a) < 0.04
    assert model.good(["++++"])[0] > 0.98 and model.good(["----"])[0] < 0.05


def test_kept_are_the_good_ones_of_labels_it_never_saw(spark):
    sf = "/root/testdata/sf0.1"
    rows = q.classify(read(spark, sf, "documents")).join(read(spark, sf, "labels"), "doc_id").select("kept", "weak_label", "quality").collect()
    good, bad = [r for r in rows if r["quality"]], [r for r in rows if not r["quality"]]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good)
    assert sum(not r["kept"] for r in bad) >= 0.9 * len(bad)
    assert sum(r["weak_label"] > 0.5 for r in good) >= 0.97 * len(good)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "One good sentence. And one more, as it should be."), (4, "One good sentence. And one more, as it should be."),
            (None, "same same same same same same same same"), (6, "LOUD!! " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS votes", "1 AS content", "2 AS score")
    got = q.classify(docs).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    kept = q.keep_good(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if r["kept"])
    assert q.classify(docs.limit(0)).count() == 0 and q.keep_good(docs.limit(0)).count() == 0


def test_shape():
    shape, slots, values = q.described("AB!! AB!! x | y. y.\nab\nab", q.Words())
    assert shape.words == 8 and shape.upper == 0.25 and shape.marked == 0.25 and shape.symbols == 0.125
    assert shape.repeated == 0.375 and abs(shape.lines - 1 / 3) < 1e-9 and shape.stops == 0.5 and shape.distinct == 5 / 8
    assert len(slots) == len(values)
