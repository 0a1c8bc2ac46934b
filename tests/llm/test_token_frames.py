import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from tokenizers import Tokenizer

from lanewise.llm.shared import put
from lanewise.llm.token_frames import TokenFile, WordCache, file_parts, read_tokens, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [2]


def test_words_in_turn_equal_whole_texts(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += [None, "", " ", "a b c", "é ́e", "İstanbul ΣΑΣ Σ", "it's  'twas\tn't", "漢字 かな 한글", "​ x\u0085y", "😀👍🏽 ok"]
    texts += ["J̌A ǰa A\u030a", "a\xa0b", "ǅ Ǆ ŉ ſt", "don't o'Clock'LL", "1234.5,6", "<|endoftext|> x<|startoftext|>y", "soft\xadhyphen", "²½ ¼x", "ªº µ", "ß.ÿ"]
    texts += ["".join(map(chr, range(0x21, 0x250))), " ".join(map(chr, range(0x21, 0x250))), "\x00\x01\x1f\x7f\x80 x"]
    ids, counts = WordCache(PATH).encode(pa.array(texts), 2)
    for text, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert got.tolist() == ids_of(text)


def test_documents(spark, documents):
    files = write_tokens(documents, "doc_id", "text", PATH, 2)
    rows = sorted(read_tokens(files).collect(), key=lambda r: r.start)
    given = sorted(documents.collect(), key=lambda d: (d.doc_id is not None, d.doc_id or 0))
    assert [r.doc_id for r in rows] == [d.doc_id for d in given]
    crc = lambda t: (len(ids_of(t)), zlib.crc32(np.array(ids_of(t), "<u4").tobytes()))
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in rows) == sorted((d.doc_id if d.doc_id else -1, *crc(d.text)) if d.doc_id != 0 else (-1, *crc(d.text)) for d in given)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert read_tokens(write_tokens(documents.limit(0), "doc_id", "text", PATH, 2)).count() == 0


def test_file_format(tmp_path):
    docs = [(i, np.arange(i * 7 % 50, dtype=np.uint32) * (3000 if i % 2 else 1)) for i in range(40)]
    uri = f"file:{tmp_path}/a.zst"
    put(uri, file_parts(iter(docs), frame_tokens=100))
    file = TokenFile(uri)
    assert len(file.seeks) > 5
    for i, ids in docs:
        assert file.document(i).tolist() == ids.tolist()
    raw = (tmp_path / "a.zst").read_bytes()
    whole = b"".join(iter(lambda r=zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True): r.read(1 << 16), b""))
    assert len(whole) == int(file.seeks[:, 1].sum())
    at = int(file.starts[3]) + 12
    bad = bytearray(raw)
    bad[at] ^= 255
    put(uri, [bytes(bad)])
    with pytest.raises((ValueError, zstandard.ZstdError)):
        TokenFile(uri).frame(3)
