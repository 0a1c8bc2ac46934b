"""Byte-level BPE by a sentencepiece model that is written straight from a file of ranks.

Every byte gets a printable sign of its own, so a token of the rank file is a piece of such signs with the negative rank as its
score. The model is a BPE model with identity normalisation: it joins the neighbouring pieces of the highest
score first, the leftmost on a tie, which are the merges of the ranks. A text is cut by the pattern, each match is
encoded by itself (a match that is a token is that token, whatever its merges give), and ids turn back into bytes by the
inverse of the signs.

Most matches begin at a blank, so a text without other white space before a blank is cut at its blanks first; each distinct
part is then matched and encoded once per worker.
"""

from __future__ import annotations

import base64
import struct
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices, spread

# Fixed values of the model format: field numbers, piece kinds and the kind of model.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, KIND = 1, 2, 3
NORMAL, UNKNOWN = 1, 2
MODEL_TYPE, VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID, UNK_PIECE = 3, 4, 40, 41, 42, 43, 45
BPE = 2
NAME, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES = 1, 3, 4, 5

#: Stands for what is not in the vocabulary; no byte has this sign.
UNKNOWN_PIECE = "⁇"
#: White space (as in the pattern) before a blank: matches may then begin elsewhere than at the blank.
SPACES = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}] "
CACHE_PARTS = 200_000
SLICE_BYTES = 4 << 20

_codecs: dict[tuple[str, str], Codec] = {}


def byte_signs() -> list[str]:
    """A printable sign for each byte: itself where it is one in Latin-1, else the next code point from 256 on."""
    signs, more = [], 256
    for b in range(256):
        printable = 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD
        signs.append(chr(b) if printable else chr(more))
        more += not printable
    return signs


SIGNS = byte_signs()
_TO_SIGNS = dict(enumerate(SIGNS))
_TO_BYTES = {ord(s): b for b, s in enumerate(SIGNS)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file of lines ``base64 rank``."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def _piece(piece: str, score: float, kind: int) -> bytes:
    fields = _bytes(PIECE, piece.encode()) + _varint(SCORE << 3 | 5) + struct.pack("<f", score) + _number(KIND, kind)
    return _bytes(PIECES, fields)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model of a rank table: a piece per token by ascending rank, the unknown piece last."""
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the ranks must hold every single byte")
    if max(ranks.values()) >= 1 << 24:
        raise ValueError("ranks from 2^24 on are not exact as scores")
    tokens = sorted(ranks, key=ranks.__getitem__)
    pieces = [_piece(t.decode("latin-1").translate(_TO_SIGNS), -ranks[t], NORMAL) for t in tokens]
    pieces.append(_piece(UNKNOWN_PIECE, 0.0, UNKNOWN))
    trainer = _number(MODEL_TYPE, BPE) + _number(VOCAB_SIZE, len(pieces)) + _number(UNK_ID, len(tokens))
    trainer += _number(BOS_ID, -1) + _number(EOS_ID, -1) + _number(PAD_ID, -1) + _bytes(UNK_PIECE, UNKNOWN_PIECE.encode())
    normalizer = _bytes(NAME, b"identity") + _number(DUMMY_PREFIX, 0) + _number(EXTRA_SPACES, 0) + _number(ESCAPE_SPACES, 0)
    return b"".join(pieces) + _bytes(TRAINER, trainer) + _bytes(NORMALIZER, normalizer)


class Codec:
    """Encoder and decoder of one rank file, with the ids of the parts met so far in this worker.

    The cache starts anew once it holds ``CACHE_PARTS`` parts.
    """

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.cut = regex.compile(pattern)
        self.ids = np.array(sorted(ranks.values()), np.uint32)
        pieces = [self.processor.id_to_piece(i) for i in range(len(ranks))]
        self.token = {p: i for i, p in enumerate(pieces)}
        tokens = [p.translate(_TO_BYTES).encode("latin-1") for p in pieces]
        # by id, for decoding
        self.sizes = np.full(int(self.ids[-1]) + 1, -1, np.int64)
        self.sizes[self.ids] = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.zeros(len(self.sizes), np.int64)
        self.starts[self.ids] = np.cumsum(self.sizes[self.ids]) - self.sizes[self.ids]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.clear()

    def clear(self):
        self.place: dict[str, int] = {}
        self.parts: list[np.ndarray] = []

    def matches(self, found: list[str]) -> dict[str, list[int]]:
        """Token ids of distinct matches of the pattern."""
        signs = [m.encode().decode("latin-1").translate(_TO_SIGNS) for m in found]
        whole = [self.token.get(s) for s in signs]
        merged = iter(self.processor.encode([s for s, w in zip(signs, whole) if w is None], num_threads=1))
        return {m: next(merged) if w is None else [w] for m, w in zip(found, whole)}

    def _of(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct parts: all in one array, and each part's start and size in it."""
        if len(self.place) > CACHE_PARTS:
            self.clear()
        new = [p for p in parts if p not in self.place]
        cut = [self.cut.findall(p) for p in new]
        known = self.matches(list({m for found in cut for m in found}))
        for part, found in zip(new, cut):
            self.place[part] = len(self.parts)
            self.parts.append(self.ids[[i for m in found for i in known[m]]])
        mine = [self.parts[self.place[p]] for p in parts]
        sizes = np.fromiter(map(len, mine), np.int64, len(mine))
        return np.concatenate([np.zeros(0, np.uint32), *mine]), np.cumsum(sizes) - sizes, sizes

    def _at_blanks(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(text, " ")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        first = np.zeros(len(flat), bool)
        first[np.cumsum(counts) - counts] = True
        heads, rest = flat.filter(pa.array(first)).dictionary_encode(), flat.filter(pa.array(~first)).dictionary_encode()
        ids, starts, sizes = self._of([" " + p for p in rest.dictionary.to_pylist()] + heads.dictionary.to_pylist())
        codes = np.zeros(len(flat), np.int64)
        codes[~first] = rest.indices.to_numpy(zero_copy_only=False)
        codes[first] = heads.indices.to_numpy(zero_copy_only=False).astype(np.int64) + len(rest.dictionary)
        return ids[spread(starts[codes], sizes[codes])], _per_text(sizes[codes], counts)

    def _by_matches(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [self.cut.findall(t) for t in text.to_pylist()]
        coded = pa.array([m for each in found for m in each], pa.string()).dictionary_encode()
        own = coded.dictionary.to_pylist()
        known = self.matches(own)
        parts = [self.ids[known[m]] for m in own]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids = np.concatenate([np.zeros(0, np.uint32), *parts])[spread((np.cumsum(sizes) - sizes)[codes], sizes[codes])]
        return ids, _per_text(sizes[codes], np.fromiter(map(len, found), np.int64, len(found)))

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in turn and the ids per text; null is empty."""
        text = pc.fill_null(text, "")
        odd = pc.match_substring_regex(text, SPACES).to_numpy(zero_copy_only=False)
        ids, counts = self._at_blanks(text.filter(pa.array(~odd)))
        if not odd.any():
            return ids, counts
        more, of_more = self._by_matches(text.filter(pa.array(odd)))
        sizes, starts = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        sizes[~odd], sizes[odd] = counts, of_more
        starts[~odd], starts[odd] = np.cumsum(counts) - counts, len(ids) + np.cumsum(of_more) - of_more
        return np.concatenate([ids, more])[spread(starts, sizes)], sizes

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids in turn and the bytes per id."""
        known = ids < len(self.sizes)
        if not known.all() or (self.sizes[ids] < 0).any():
            raise ValueError("an id is not in the vocabulary")
        return self.bytes[spread(self.starts[ids], self.sizes[ids])], self.sizes[ids]


def _per_text(sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])])


def codec(path: str, pattern: str = public_tokenizers.PATTERN) -> Codec:
    """The worker's codec of a rank file."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _packed(values: np.ndarray, counts: np.ndarray, width: int) -> pa.Array:
    """Binary array of ``counts`` values each, of ``width`` bytes."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * width
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(values)]).cast(pa.binary())


def encode(docs: DataFrame, id_col: str, text_col: str, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``id_col`` and ``ids``, the token ids of every whole text as little-endian unsigned 32-bit integers.

    ``path`` names a file of ranks that every worker can read. No special tokens are known. Letters, numbers and white space of
    the pattern are those of the ``regex`` library's Unicode version.

    Defined cases: a null or empty text has no ids; any row gives a row, null and repeated ids included; other columns are not
    passed on, whatever their names; an empty table stays empty.
    """

    def run(batches):
        own = codec(path, pattern)
        for batch in slices(batches, 1, SLICE_BYTES):
            ids, counts = own.encode(batch[1])
            yield pa.RecordBatch.from_arrays([batch[0], _packed(ids.astype("<u4"), counts, 4)], names=["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids binary").select(F.col("id").alias(id_col), "ids")


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``tokens`` with the bytes (``out_col``) that the ids in ``ids_col`` stand for, after all its columns.

    Defined cases: null or no ids decode to no bytes; an id outside the vocabulary is an error; an empty table stays
    empty; a column that is named ``out_col`` already is replaced.
    """
    rest = tokens.drop(out_col)
    at = rest.columns.index(ids_col)

    def run(batches):
        own = codec(path, pattern)
        for batch in slices(batches, at, SLICE_BYTES):
            given = pc.fill_null(batch[at], b"")
            counts = pc.binary_length(given).to_numpy(zero_copy_only=False).astype(np.int64) // 4
            ids = np.frombuffer(b"".join(given.to_pylist()), "<u4")
            values, sizes = own.decode(ids)
            decoded = _packed(values, _per_text(sizes, counts), 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=[*batch.schema.names, out_col])

    return rest.mapInArrow(run, rest.withColumn(out_col, F.lit(None).cast("binary")).schema)
