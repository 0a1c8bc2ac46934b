"""Token files: independent zstandard frames, a trailing seek table and checksums per frame.

A file is a plain zstandard stream that any decoder can read from end to end. Each frame holds whole documents:
``uint32 n, uint8 width, uint8 known[n], int64 ids[n], uint32 lengths[n]``, then the token ids of all, of
``width`` bytes each, little-endian. Two skippable frames follow: a directory (first document's number,
documents and tokens of each frame) and the public seek table format (compressed size, size
and low 32 bits of XXH64 of each frame). A reader finds a document's frame in the directory and
decompresses that frame alone.

Files are numbered in ascending document order. Their token totals, one row per file, are
summed on the driver; nothing else passes it.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import open_fs, put, scratch
from .words import slices, with_ends, words_of

# Fixed values of the file format.
SKIPPABLE = 0x184D2A5E
DIRECTORY = 0x184D2A50
SEEKABLE = 0x8F92EAB1
CHECKSUMS = 0x80

FRAME_TOKENS = 1 << 16
LEVEL = 1
CACHE_PIECES = 400_000

_caches: dict[str, WordCache] = {}


class WordCache:
    """Token ids of the pieces of words met so far in this worker.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    words in turn. For the tokenizers whose rules are known (:func:`known_split`) a plain Latin word is cut into the pieces that the
    library's own pre-tokenizer would make, and the library's model encodes each distinct piece once; all other words go
    through the library whole. The cache starts anew once it holds ``CACHE_PIECES`` pieces.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = known_split(json.loads(self.tokenizer.to_str()))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self):
        # a line end separates words and has no ids
        self.place: dict[str, int] = {"\n": 0}
        self.flat, self.starts, self.sizes = (np.zeros(1 << 16, t) for t in (np.uint32, np.int64, np.int64))
        self.used = 0

    def _places(self, pieces: list[str], encode) -> np.ndarray:
        new = list(set(pieces) - self.place.keys())
        if new:
            ids = encode(new)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            total, at = int(sizes.sum()), len(self.place)
            self.flat = _grown(self.flat, self.used + total)
            self.starts, self.sizes = _grown(self.starts, at + len(new)), _grown(self.sizes, at + len(new))
            self.flat[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), np.uint32, total)
            self.starts[at : at + len(new)] = self.used + np.cumsum(sizes) - sizes
            self.sizes[at : at + len(new)] = sizes
            self.used += total
            self.place.update(zip(new, range(at, at + len(new))))
        return np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))

    def _model(self, pieces: list[str]) -> list[list[int]]:
        tokenize = self.tokenizer.model.tokenize
        return [[t.id for t in tokenize(p.encode().decode("latin-1").translate(_BYTE_LEVEL))] for p in pieces]

    def _whole(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([w[1:] for w in words], add_special_tokens=False)]

    def word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids of distinct words: all in one array, and each word's start and size in it."""
        if len(self.place) > CACHE_PIECES:
            self.clear()
        plain = np.zeros(len(words), bool)
        if self.split is not None and len(words):
            plain = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False)
            for token in self.special:
                plain = plain & ~pc.match_substring(words, token).to_numpy(zero_copy_only=False)
        starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        places = []
        if plain.any():
            own = words.filter(pa.array(plain))
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), "\n")[0].as_py()
            at = self._places(self.split.findall(joined.lower() + "\n"), self._model)
            ends = np.cumsum(self.sizes[at])[at == 0]
            sizes[plain] = np.diff(ends, prepend=0)
            places.append(at)
        if not plain.all():
            at = self._places(["\n" + w for w in words.filter(pa.array(~plain)).to_pylist()], self._whole)
            sizes[~plain] = self.sizes[at]
            places.append(at)
        at = np.concatenate([np.zeros(0, np.int64), *places])
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return self.flat[_spread(self.starts[at], self.sizes[at])], starts, sizes

    def encode(self, text: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in turn, ``end`` after each, and the ids per text."""
        words, codes, counts = words_of(text, lower=False)
        flat, starts, sizes = self.word_ids(words)
        flat, starts, sizes = np.append(flat, np.uint32(end)), np.append(starts, len(flat)), np.append(sizes, 1)
        codes, counts = with_ends(codes, counts, len(words))
        ids = flat[_spread(starts[codes], sizes[codes])]
        before = np.concatenate([[0], np.cumsum(sizes[codes])])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(before)


# Words of printable ASCII without the apostrophe, and of precomposed Latin letters and signs: no normal
# form changes them, and each letter has one lower-case letter.
PLAIN = r"^[\x21-\x26\x28-\x7E\x{A1}-\x{AC}\x{AE}-\x{12F}\x{131}-\x{24F}]+$"


def known_split(spec: dict):
    """Pattern of the pieces of plain words, or None for a tokenizer of other rules.

    Known are: normal form C, white space to blanks, lower case; then runs of letters, single digits and runs of other
    signs (contractions need an apostrophe); then byte-level signs.
    """
    normal = spec.get("normalizer") or {}
    cut = spec.get("pre_tokenizer") or {}
    steps = [(n.get("type"), n.get("pattern")) for n in normal.get("normalizers", [])]
    parts = cut.get("pretokenizers", [])
    if steps != [("NFC", None), ("Replace", {"Regex": "\\s+"}), ("Lowercase", None)] or [p.get("type") for p in parts] != ["Split", "ByteLevel"]:
        return None
    kinds = parts[0].get("pattern", {}).get("Regex", "").split("|")
    if [k for k in kinds if not k.startswith("'")] != ["[\\p{L}]+", "[\\p{N}]", "[^\\s\\p{L}\\p{N}]+"]:
        return None
    if not parts[0].get("invert") or parts[0].get("behavior") != "Removed" or parts[1].get("add_prefix_space") or parts[1].get("use_regex"):
        return None
    return regex.compile(r"\n|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def _byte_level() -> dict[int, int]:
    """Sign of every byte: printable ones stand for themselves, the rest follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: b for b in own} | {b: 256 + n for n, b in enumerate(rest)}


_BYTE_LEVEL = _byte_level()


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of the stretches that start and size give, in turn."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _grown(a: np.ndarray, need: int) -> np.ndarray:
    return a if need <= len(a) else np.concatenate([a, np.zeros(max(need, 2 * len(a)) - len(a), a.dtype)])


def word_cache(path: str) -> WordCache:
    if path not in _caches:
        _caches[path] = WordCache(path)
    return _caches[path]


def _frame(docs: list, tokens: list, sizes: list) -> bytes:
    ids = np.concatenate(tokens)
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    known = np.array([d is not None for d in docs], np.uint8)
    keys = np.array([0 if d is None else d for d in docs], "<i8")
    head = struct.pack("<IB", len(docs), width) + known.tobytes() + keys.tobytes() + np.array(sizes, "<u4").tobytes()
    return head + ids.astype(f"<u{width}").tobytes()


def file_parts(documents, level: int = LEVEL, frame_tokens: int = FRAME_TOKENS, totals: dict | None = None):
    """Byte strings of a token file. ``documents``: (doc id, uint32 ids) in file order."""
    packer = zstandard.ZstdCompressor(level=level)
    seeks, places = [], []
    docs, tokens, sizes = [], [], []
    done = {"documents": 0, "tokens": 0}

    def close():
        raw = _frame(docs, tokens, sizes)
        packed = packer.compress(raw)
        seeks.append(struct.pack("<III", len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        places.append(struct.pack("<QQQ", done["documents"], len(docs), sum(sizes)))
        done["documents"] += len(docs)
        done["tokens"] += sum(sizes)
        for x in (docs, tokens, sizes):
            x.clear()
        return packed

    held = 0
    for doc, ids in documents:
        docs.append(doc)
        tokens.append(ids)
        sizes.append(len(ids))
        held += len(ids)
        if held >= frame_tokens:
            yield close()
            held = 0
    if docs:
        yield close()
    table = b"".join(places)
    yield struct.pack("<II", DIRECTORY, len(table)) + table
    table = b"".join(seeks) + struct.pack("<IBI", len(seeks), CHECKSUMS, SEEKABLE)
    yield struct.pack("<II", SKIPPABLE, len(table)) + table
    if totals is not None:
        totals.update(done)


class TokenFile:
    """Reader of one token file; decompresses only the frames it is asked for."""

    def __init__(self, uri: str):
        store, path = open_fs(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError(f"{uri} has no seek table")
        self.seeks = np.frombuffer(self._at(size - 9 - 12 * count, 12 * count), "<u4").reshape(count, 3)
        self.places = np.frombuffer(self._at(size - 17 - 36 * count, 24 * count), "<u8").reshape(count, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.seeks[:, 0], dtype=np.int64)])
        self.token_starts = np.concatenate([[0], np.cumsum(self.places[:, 2])])

    def _at(self, offset: int, size: int) -> bytes:
        return self.file.read_at(size, offset)

    def frame(self, k: int):
        """Document ids and token ids of frame ``k``, its checksum verified."""
        packed, size, checksum = (int(x) for x in self.seeks[k])
        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[k]), packed), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} is damaged")
        n, width = struct.unpack_from("<IB", raw)
        known = np.frombuffer(raw, np.uint8, n, 5)
        keys = np.frombuffer(raw, "<i8", n, 5 + n)
        ends = np.cumsum(np.frombuffer(raw, "<u4", n, 5 + 9 * n), dtype=np.int64)
        ids = np.frombuffer(raw, f"<u{width}", -1, 5 + 13 * n).astype("<u4")
        return [k if ok else None for k, ok in zip(keys.tolist(), known)], np.split(ids, ends[:-1])

    def document(self, number: int) -> np.ndarray:
        """Token ids of the ``number``-th document of the file."""
        k = int(np.searchsorted(self.places[:, 0], number, "right")) - 1
        return self.frame(k)[1][number - int(self.places[k, 0])]


def write_tokens(
    docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, folder: str | None = None
) -> DataFrame:
    """Encode whole texts and write them in ascending ``id_col`` order; returns the files.

    ``tokenizer``: path of a tokenizers file that drops white space. Returns one row per file: file (URI),
    documents, tokens, start (tokens of all files before it).

    Defined cases: a null text counts as empty and holds the end id alone; a null id sorts first
    and reads back as null; repeated ids are all written, in the order of a hash of their text; an
    empty table gives no files; other columns are not read.
    """
    spark = docs.sparkSession
    root = folder or scratch(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = (
        rows.withColumn("h", F.xxhash64("text")).repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")
    )

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        cache, totals = word_cache(tokenizer), {}

        def documents():
            for batch in slices(batches, 1):
                ids, counts = cache.encode(batch[1], end_id)
                yield from zip(batch[0].to_pylist(), np.split(ids, np.cumsum(counts)[:-1]))

        source = documents()
        first = next(source, None)
        if first is None:
            return
        uri = f"{root}/part-{part:07d}.zst"

        def all_documents():
            yield first
            yield from source

        put(uri, file_parts(all_documents(), totals=totals))
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([part], pa.int64()), "file": [uri], "documents": pa.array([totals["documents"]], pa.int64()),
             "tokens": pa.array([totals["tokens"]], pa.int64())}
        )

    found = sorted(ordered.mapInArrow(write, "part long, file string, documents long, tokens long").collect())
    files, start = [], 0
    for row in found:
        files.append((row["file"], row["documents"], row["tokens"], start))
        start += row["tokens"]
    return spark.createDataFrame(files, "file string, documents long, tokens long, start long")


def read_tokens(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents of the files: ``id_col``, start, n_tokens, ids_crc32 (of little-endian uint32 ids)."""
    schema = pa.schema([(id_col, pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches):
        for batch in batches:
            for uri, start in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                file = TokenFile(uri)
                for k in range(len(file.seeks)):
                    docs, ids = file.frame(k)
                    sizes = np.array([len(x) for x in ids], np.int64)
                    at = start + int(file.token_starts[k]) + np.cumsum(sizes) - sizes
                    sums = [zlib.crc32(x.tobytes()) for x in ids]
                    yield pa.RecordBatch.from_pydict(
                        {id_col: pa.array(docs, pa.int64()), "start": at, "n_tokens": sizes, "ids_crc32": pa.array(sums, pa.int64())},
                        schema=schema,
                    )

    tasks = max(1, files.count())
    return files.select("file", "start").repartition(tasks, "file").mapInArrow(
        read, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long"
    )
