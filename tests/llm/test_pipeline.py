import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The small tables with planted copies, nulls, blanks and repeated rows."""
    rng = random.Random(1)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = [tuple(r) for r in docs]
    clean = [r for r in docs if len(r.text.split()) > 150][:20]
    for n, r in enumerate(clean):
        words = r.text.split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((10_000 + n, " ".join(words), r.lang, r.source, r.n_chars))
        rows.append((20_000 + n, r.text, r.lang, r.source, r.n_chars))
    rows += [(30_000, None, "en", "s", None), (30_001, "", None, None, 0), (None, "no id but some words", "en", "s", 1), rows[0], rows[0]]
    to = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema).write.parquet(f"{to}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{to}/labels.parquet")
    return to, [c.doc_id for c in clean]


def test_stages(spark, folder):
    to, planted = folder
    docs = spark.read.parquet(f"{to}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{to}/labels.parquet").collect()}
    (_, quality), (_, copies), (_, mixing), (_, pieces) = corpus_pipeline.STAGES

    good = quality(spark, docs, to).cache()
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    assert {i for i, r in labels.items() if r.quality == 1} <= kept
    assert not {i for i, r in labels.items() if r.quality == 0} & kept

    single = copies(spark, good, to).cache()
    assert single.columns == docs.columns
    left = single.collect()
    assert len({r.doc_id for r in left}) == len(left)
    ids = sorted((r.doc_id for r in left), key=repr)
    assert not {10_000 + n for n in range(20)} & set(ids) and not {20_000 + n for n in range(20)} & set(ids)
    # exactly one row stays of all that chains of a similarity of 0.8 link
    given = [(r.doc_id, shingles(r.text)) for r in good.collect()]
    group = list(range(len(given)))
    for i, (_, a) in enumerate(given):
        for j, (_, b) in enumerate(given[:i]):
            if group[i] != group[j] and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                group = [group[j] if g == group[i] else g for g in group]
    assert len(left) == len(set(group))
    assert len({group[[g[0] for g in given].index(i)] for i in ids}) == len(left)

    mixed = mixing(spark, single, to).cache()
    assert mixed.columns == docs.columns
    times = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert set(times) <= set(ids)
    toxic = {i for i, r in labels.items() if r.toxic == 1} & set(ids)
    calm = {i for i, r in labels.items() if r.toxic == 0} & set(ids)
    assert sum(i in times for i in calm) >= 0.97 * len(calm)
    assert sum(times.get(i, 0) for i in toxic) < 0.8 * len(toxic)

    out = pieces(spark, mixed, to).collect()
    texts = {r.doc_id: r.text or "" for r in left}
    assert sum(r.sample == 1 for r in out) == mixed.count()
    assert all(r.decoded_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in out)


def test_empty_tables(spark, folder):
    to, _ = folder
    docs = spark.read.parquet(f"{to}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, to).count() == 0


def test_clashing_columns(spark, folder):
    to, _ = folder
    names = ["score", "posteriors", "tokens", "copies", "_buckets", "_text_hash", "node", "word", "more", "id", "hash"]
    docs = spark.read.parquet(f"{to}/documents.parquet").limit(40).withColumns({n: F.lit("x") for n in names})
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, to)
        assert out.columns == docs.columns and out.count() > 0
    assert corpus_pipeline.STAGES[3][1](spark, docs, to).count() == 80
