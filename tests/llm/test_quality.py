import os
import random

import numpy as np
import pytest
from helpers import docs
from pyspark.sql import functions as F

from turnweave.llm import subwords
from turnweave.llm.op_quality import op10_quality_classifier, quality_model

FOLDER = "/root/testdata/sf0.01"


def sample(count, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(count):
        w = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(8, 60))]
        rows.append((k, " ".join(x + "###" if k % 2 else x for x in w), 1 - k % 2))
    return rows


def test_learns_marks_it_has_not_seen_whole(spark):
    rows = sample(300)
    table = docs(spark, [(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (None, "x"), (902, "word " * 40_000)])
    labels = spark.createDataFrame([(i, q, 1) for i, _, q in rows] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_model(table, labels)
    found = {r["doc_id"]: r["score"] for r in subwords.scored(table, model, carried=["doc_id"]).select("row.doc_id", "score").collect()}
    assert np.mean([(found[i] >= 0.5) == bool(q) for i, _, q in rows if i % 3]) > 0.95
    assert len(found) == 304 and all(0 <= s <= 1 for s in found.values()) and found[900] == found[901]
    assert quality_model(table, labels).folded()[1] == model.folded()[1]


def test_without_labels_and_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    table = docs(spark, [(1, "a b c")])
    found = subwords.scored(table, quality_model(table, none)).collect()
    assert found[0]["score"] == 0.5 and found[0]["row"]["rep"] == 7
    assert subwords.scored(docs(spark, []), quality_model(docs(spark, []), none)).collect() == []


def test_conflicting_labels_are_left_out(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1)], "_row_id long, _label int")
    table = docs(spark, [(1, "a"), (2, "b")]).select(F.col("doc_id").alias("_row_id"), F.col("text").alias("_text"))
    assert np.isfinite(subwords.fit(table, labels).table).all()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{FOLDER}/labels.parquet").filter("quality is not null").select("doc_id", "quality")
    rows = op10_quality_classifier(spark, FOLDER).filter("held_out").join(truth, "doc_id").collect()
    assert len(rows) > 50 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
