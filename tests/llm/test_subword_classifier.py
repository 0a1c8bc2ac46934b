import re
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from lanewise.llm.queries import QUERIES
from lanewise.llm.shared import hand_back
from lanewise.llm.subword_classifier import ACCEPT, features, fit, score

SF = "/root/testdata/sf0.01"


def test_features():
    ids, sizes = features(["ab", "b", "ab", "x" * 400, "aé"], 1 << 17)
    cut = np.split(ids, np.cumsum(sizes)[:-1])
    assert sizes.tolist() == [1 + 2 + 1, 1 + 1, 4, 1 + 400 + 399, 4]
    assert cut[0].tolist() == cut[2].tolist() and cut[0][0] != cut[4][0]
    assert features(["ba"], 1 << 17)[0][0] != cut[0][0]
    assert features([], 8)[0].tolist() == []


def test_held_out_accuracy(spark):
    rows = QUERIES["op5_subword_classifier"](spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(r.predicted, labels[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and len(rows) == 1000
    assert sum(p == y for p, y, _ in held) / len(held) > 0.95
    good, bad = [s for _, y, s in held if y], [s for _, y, s in held if not y]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97


def test_documents(spark, documents):
    labels = spark.createDataFrame([(3, 1), (5, 0), (None, 1), (6, None), (99, 1), (3, 0)], "doc_id long, quality int")
    model = fit(documents, labels, "doc_id", "text", "quality")
    out = score(documents, model, "text")
    rows = out.collect()
    assert out.columns == [*documents.columns, "score"]
    assert len(rows) == documents.count()
    blank = {r.score for r in rows if not (r.text or "").strip()}
    assert len(blank) == 1 and all(0 <= r.score <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.text, set()).add(r.score)
    assert all(len(v) == 1 for v in by.values())
    assert by["one"].pop() > ACCEPT
    assert score(documents.limit(0), model, "text").count() == 0
    none = fit(documents, labels.limit(0), "doc_id", "text", "quality")
    assert {r.score for r in score(documents, none, "text").collect()} == {0.5}


def _own_mb():
    return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024


def test_training_gives_memory_back(spark):
    """What the driver collects to train on must not stay with it for the stages that follow."""
    word = lambda i: F.substring(F.md5(F.concat_ws("-", "doc_id", i).cast("binary")), 1, 12)
    docs = spark.range(1500).select(
        F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(150)), word), " ").alias("text")
    )
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    fit(docs, labels, "doc_id", "text", "quality", sample=20)
    hand_back()
    before = _own_mb()
    model = fit(docs, labels, "doc_id", "text", "quality")
    assert len(model.shares) and _own_mb() - before < 25
