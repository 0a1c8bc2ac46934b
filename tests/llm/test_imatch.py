import hashlib
import re

from pyspark.sql import functions as F

from lanewise.llm import imatch


def test_documents(spark, documents):
    words = imatch.lexicon(documents, "text", 0.1, 0.5)
    placed = imatch.in_order(documents.withColumnRenamed("bucket", "clash"), "doc_id", F.xxhash64("text"))
    rows = imatch.fingerprints(placed, ["bucket", "place"], {"text": "fp"}, words, ["doc_id"])
    got = rows.collect()
    assert len(got) == documents.count()
    given = documents.collect()
    terms = lambda t: {w for w in re.split(r"[^\w]+", (t or "").lower().replace("_", " ")) if w}
    df = {}
    for d in given:
        for w in terms(d.text):
            df[w] = df.get(w, 0) + 1
    band = {w for w, n in df.items() if 0.1 * len(given) <= n <= 0.5 * len(given)}
    assert {r.term for r in words.collect()} == band
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()

    def plain(text):
        own = sorted(terms(text) & band)
        if not own:
            return md5(text or "")
        out = ""
        for k in range(imatch.SUBSETS):
            sub = [w for w in own if int(md5(f"{w}:{k}")[:8], 16) % imatch.RATES[k // imatch.EACH] == 0]
            out += md5(" ".join(sub))[:4] if sub else imatch.BLANK
        return out

    want = sorted(((d.doc_id, plain(d.text)) for d in given), key=repr)
    assert sorted(((r.doc_id, r.fp) for r in got), key=repr) == want


def test_next_row(spark):
    ids = [None, None, 1, 2, 2, 255, 256, 300, 5000, 5001, 256 * 4096 * 3 + 7, 256 * 4096 * 9, -5, -400]
    rows = [(i, f"t{n}") for n, i in enumerate(ids)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    placed = imatch.in_order(frame, "doc_id", F.col("text"))
    got = {(r.doc_id, r.text): r.after for r in imatch.with_next(placed, "text", "after").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == {r: order[(n + 1) % len(order)][1] for n, r in enumerate(order)}
    one = imatch.with_next(imatch.in_order(frame.limit(1), "doc_id", F.col("text")), "text", "after").collect()
    assert one[0].after == one[0].text
    assert imatch.with_next(imatch.in_order(frame.limit(0), "doc_id", F.col("text")), "text", "after").count() == 0


def test_likeness(spark):
    blank, size = imatch.BLANK, 4 * imatch.SUBSETS
    pad = lambda s: s + blank * ((size - len(s)) // 4)
    cases = [
        (pad("aaaabbbb"), pad("aaaabbbb"), 1.0), (pad("aaaabbbb"), pad("aaaacccc"), 0.5), (pad("aaaa" + blank + "bbbb"), pad("aaaacccc"), 1 / 3),
        ("0" * 32, "0" * 32, 1.0), ("0" * 32, "1" * 32, 0.0), ("0" * 32, pad("0000"), 0.0),
    ]
    frame = spark.createDataFrame(cases, "a string, b string, want double")
    for r in frame.select("want", imatch.likeness(F.col("a"), F.col("b")).alias("got")).collect():
        assert r.got == r.want
