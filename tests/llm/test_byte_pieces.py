import base64
import hashlib
import random
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken

from lanewise.llm import byte_pieces
from lanewise.llm.byte_pieces import Codec, decode, encode, read_ranks, serialise
from lanewise.llm.queries import op11_byte_pieces

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def check(library, texts):
    own = Codec(PATH, public_tokenizers.PATTERN)
    ids, counts = own.encode(pa.array(texts, pa.string()))
    data, sizes = own.decode(ids)
    ends = np.concatenate([[0], np.cumsum(counts)])
    for text, lo, hi in zip(texts, ends, ends[1:]):
        assert ids[lo:hi].tolist() == library.encode_ordinary(text or ""), text[:80]
    assert data.tobytes() == "".join(t or "" for t in texts).encode()
    assert int(sizes.sum()) == len(data)


def test_equals_library(spark, library):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    texts += [None, "", " ", "  ", " a", "a ", "a  b", "a \n b\n", "\n\n x", "it's don't'll  'tis", "1234 56", "é ́e", "漢字 かな 한글", "😀👍🏽 ok", "<|endoftext|>"]
    texts += ["x" * 5000, " " * 3000 + "y", "\n" * 100, "ab" * 3000, "\x00\x01\x1c\x1f\x7f\x80 \x85 x\xa0 y", "a  b　c ​ d"]
    check(library, texts)


def test_random_texts(library):
    rng = random.Random(5)
    signs = [" ", " ", "\n", "\t", "\xa0", "　", "'", "s", "ll", "a", "the", "é", "1", "²", ".", "漢", "😀", "\r", "’"]
    check(library, ["".join(rng.choices(signs, k=rng.randrange(1, 40))) for _ in range(20_000)])


def test_every_code_point_in_both_ways(library):
    # code points assigned lately are letters to one library's Unicode tables and not to the other's
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x20000 or c % 97 == 0)]
    points = [c for c in points if unicodedata.category(c) != "Cn"]
    check(library, [f"{c}a {c} {c}" for c in points])


def test_model_file_can_be_read_by_the_library(tmp_path):
    ranks = read_ranks(PATH)
    (tmp_path / "own.model").write_bytes(serialise(ranks))
    model = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "own.model"))
    assert model.vocab_size() == len(ranks) + 1 and model.is_unknown(len(ranks))
    assert model.get_score(77) == -77.0


def test_ranks_with_gaps_and_tokens_no_merge_reaches(tmp_path):
    # "abc" has no merge that leads to it; 300 and 1000 leave gaps
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abcd": 1000, b"xyz": 301, b"ab": 1001}
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
    library = tiktoken.Encoding("gaps", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = Codec(str(path), public_tokenizers.PATTERN)
    texts = ["xyz", "xyzxyz", "abc", "ab", "abcd", "aabcd", "abab abc"]
    ids, counts = own.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode_ordinary(t) for t in texts]
    with pytest.raises(ValueError):
        own.decode(np.array([500], np.uint32))
    with pytest.raises(ValueError):
        serialise({b"a": 0})


def test_cache_starts_anew(spark, library, monkeypatch):
    monkeypatch.setattr(byte_pieces, "CACHE_PARTS", 10)
    own = Codec(PATH, public_tokenizers.PATTERN)
    for lo in range(0, 300, 30):
        texts = [f"wörd{i} {i} and {i + 1}" for i in range(lo, lo + 30)]
        ids, _ = own.encode(pa.array(texts))
        assert ids.tolist() == [i for t in texts for i in library.encode_ordinary(t)]
        assert len(own.place) < 150


def test_documents(spark, documents, library):
    tokens = encode(documents.withColumn("ids", documents.text), "doc_id", "text", PATH)
    rows = decode(tokens.withColumn("decoded", tokens.ids), PATH).collect()
    want = sorted((d.doc_id if d.doc_id is not None else -1, library.encode_ordinary(d.text or ""), (d.text or "").encode()) for d in documents.collect())
    assert sorted((r.doc_id if r.doc_id is not None else -1, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in rows) == want
    assert decode(encode(documents.limit(0), "doc_id", "text", PATH), PATH).count() == 0
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert bytes(decode(nulls, PATH).first().decoded) == b""


def test_query(spark, library):
    rows = op11_byte_pieces(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = {d.doc_id: library.encode_ordinary(d.text or "") for d in docs}
    want = [(d.doc_id, len(ids[d.doc_id]), sha(np.array(ids[d.doc_id], "<u4").tobytes()), sha((d.text or "").encode())) for d in docs]
    assert sorted(map(tuple, rows)) == sorted(want)
    assert rows[0].__fields__ == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
