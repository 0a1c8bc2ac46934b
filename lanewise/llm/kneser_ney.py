"""Interpolated modified Kneser-Ney n-gram model, counted in Spark, read through memory maps.

The model is a set of sorted arrays in the shared folder, cut into shards by the hash of an
n-gram's first word. Order 1 holds the sorted 64-bit hashes of the words; a word's id is its place over
all shards. Order k holds sorted keys ``place of the first k-1 words << 32 | id of the last``, so an n-gram is
found by k searches in the shard of its first word, and its place is in turn the prefix of the next order. Beside
the keys lie the counts, the continuation counts and, for every context, the sums that its
back-off weight needs. Workers map the files and look up sorted, distinct keys.

Counting: every task counts distinct n-grams of its texts, and sends one compressed sorted
array per shard; a shard merges what it gets and writes its files. The number of shards follows the
size of the text. The driver sees one row of totals per shard.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import mapped, put, scratch
from .words import slices, with_ends, words_of

ORDER = 2
SHARD_BYTES = 64 << 20
HOLD = 6_000_000

# Hashes of strings that hold white space, and so are no words.
END = xxhash.xxh64_intdigest(b"\n end")
BEGIN = xxhash.xxh64_intdigest(b"\n begin")


@dataclass(frozen=True)
class Model:
    """Where the arrays lie and the totals that every scorer needs."""

    folder: str
    order: int
    bases: tuple[int, ...]  # first word id of each shard, and the number of words after the last
    tokens: int  # N: training tokens, ends included
    types: int  # V: distinct training tokens, the end included
    discounts: tuple[tuple[float, float, float], ...]  # per order
    unigrams: int  # sum of the adjusted counts of order 1
    freed: float  # share of order 1 that the discounts leave to unknown words

    def file(self, kind: str, k: int, shard: int) -> str:
        return f"{self.folder}/{kind}{k}-{shard:06d}.bin"


# --- arrays -----------------------------------------------------------------------------------


def _pack(keys: np.ndarray, *counts: np.ndarray) -> bytes:
    """Sorted uint64 keys as differences, then uint32 columns, zstandard-compressed by byte planes."""
    planes = lambda a: np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()
    raw = planes(np.diff(keys, prepend=np.uint64(0))) + b"".join(planes(c.astype(np.uint32)) for c in counts)
    return zstandard.ZstdCompressor(level=1).compress(len(keys).to_bytes(8, "little") + raw)


def _unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    planes = lambda at, dtype: np.ascontiguousarray(
        np.frombuffer(raw, np.uint8, n * np.dtype(dtype).itemsize, at).reshape(-1, n).T if n else np.zeros((0, np.dtype(dtype).itemsize), np.uint8)
    ).view(dtype).ravel()
    return [np.cumsum(planes(8, np.uint64), dtype=np.uint64), *(planes(8 + 8 * n + 4 * n * i, np.uint32) for i in range(columns))]


def _summed(keys: np.ndarray, counts: np.ndarray):
    """Distinct sorted keys with their summed counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts.astype(np.int64), first) if len(first) else counts.astype(np.int64)


def _counted(keys: np.ndarray):
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


class _Counter:
    """Counts of (shard, key) pairs that are merged whenever ``HOLD`` keys are held."""

    def __init__(self):
        self.parts: dict[int, list] = {}
        self.held = 0

    def add(self, shard: int, keys: np.ndarray, counts: np.ndarray):
        self.parts.setdefault(shard, []).append((keys, counts))
        self.held += len(keys)

    def blobs(self):
        for shard in list(self.parts):
            keys, counts = zip(*self.parts.pop(shard))
            yield shard, _pack(*_summed(np.concatenate(keys), np.concatenate(counts)))
        self.held = 0


_BLOB = pa.schema([("shard", pa.int32()), ("blob", pa.binary())])


def _rows(blobs):
    for shard, blob in blobs:
        yield pa.RecordBatch.from_pydict({"shard": [shard], "blob": [blob]}, schema=_BLOB)


def _merge(parts: DataFrame, shards: int, finish, totals: list[str]) -> list[dict]:
    """Merge the blobs of each shard in one task; ``finish(shard, keys, counts)`` writes its
    files and returns its totals. Shards without blobs are finished empty."""
    schema = pa.schema([("shard", pa.int32())] + [(c, pa.int64()) for c in totals])
    empty = parts.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(None).cast("binary").alias("blob"))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        found = [_unpack(b, 1) for b in table["blob"].to_pylist() if b is not None]
        keys, counts = _summed(
            np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in found)]), np.concatenate([np.zeros(0, np.uint32), *(c for _, c in found)])
        )
        del found
        return pa.Table.from_pylist([{"shard": shard, **finish(shard, keys, counts)}], schema=schema)

    columns = ", ".join(["shard int", *(f"{c} long" for c in totals)])
    merged = parts.unionByName(empty).groupBy("shard").applyInArrow(run, columns)
    return sorted((r.asDict() for r in merged.collect()), key=lambda r: r["shard"])


# --- words ------------------------------------------------------------------------------------


def _hashes(words: pa.Array) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in words.to_pylist()] + [END, BEGIN], np.uint64)


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the hash, so ids ascend over shards as hashes do."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


class _Maps:
    """Files of the model that this task has mapped so far."""

    def __init__(self, model: Model):
        self.model = model
        self.bases = np.array(model.bases, np.int64)
        self.open: dict = {}

    def get(self, kind: str, k: int, shard: int, dtype) -> np.ndarray:
        key = (kind, k, shard)
        if key not in self.open:
            self.open[key] = mapped(self.model.file(kind, k, shard), dtype)
        return self.open[key]

    def gather(self, kind: str, k: int, shard: np.ndarray, place: np.ndarray, dtype, width: int = 1) -> np.ndarray:
        """Values at (shard, place); zero where the place is negative."""
        out = np.zeros((len(place), width), dtype)
        for s, rows in _by_shard(shard, place >= 0):
            out[rows] = self.get(kind, k, s, dtype).reshape(-1, width)[place[rows]]
        return out[:, 0] if width == 1 else out

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """Word ids of hashes; -1 for unknown words."""
        shard = _shard_of(hashes, len(self.bases) - 1)
        out = np.full(len(hashes), -1, np.int64)
        for s, rows in _by_shard(shard, np.ones(len(hashes), bool)):
            place = _find(self.get("keys", 1, s, np.uint64), hashes[rows])
            out[rows] = np.where(place >= 0, place + self.bases[s], -1)
        return out

    def step(self, k: int, shard: np.ndarray, place: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places in order ``k`` of the n-grams that extend the given places by a word; else -1."""
        out = np.full(len(place), -1, np.int64)
        for s, rows in _by_shard(shard, (place >= 0) & (word >= 0)):
            keys, back = np.unique(_key(place[rows], word[rows]), return_inverse=True)
            out[rows] = _find(self.get("keys", k, s, np.uint64), keys)[back]
        return out

    def chains(self, ids: np.ndarray, bound: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Shard of each word, and the places in order 1, 2, .. ``bound`` of the n-grams that start at it."""
        shard = np.searchsorted(self.bases, ids, "right") - 1
        places = [np.where(ids >= 0, ids - self.bases[np.maximum(shard, 0)], -1)]
        for k in range(2, bound + 1):
            nxt = np.full(len(ids), -1, np.int64)
            nxt[: max(0, len(ids) - k + 1)] = ids[k - 1 :]
            places.append(self.step(k, shard, places[-1], nxt))
        return shard, places


def _by_shard(shard: np.ndarray, use: np.ndarray):
    rows = np.flatnonzero(use)
    rows = rows[np.argsort(shard[rows].astype(np.int32), kind="stable")]
    cuts = np.flatnonzero(np.diff(shard[rows])) + 1
    for part in np.split(rows, cuts) if len(rows) else []:
        yield int(shard[part[0]]), part


def _find(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.full(len(asked), -1, np.int64)
    at = np.searchsorted(keys, asked)
    return np.where(keys[np.minimum(at, len(keys) - 1)] == asked, at, -1)


def _key(place: np.ndarray, word: np.ndarray) -> np.ndarray:
    return place.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64)


# --- counting ---------------------------------------------------------------------------------


def _count_words(shards: int, lower: bool):
    def run(batches):
        held = _Counter()
        for batch in slices(batches, 0):
            words, codes, counts = words_of(batch[0], lower)
            hashes = _hashes(words)[:-1]
            seen = np.bincount(codes, minlength=len(hashes))
            seen[-1] = len(counts)
            for s, rows in _by_shard(_shard_of(hashes, shards), seen > 0):
                held.add(s, hashes[rows], seen[rows])
            if held.held > HOLD:
                yield from _rows(held.blobs())
        yield from _rows(held.blobs())

    return run


def _stream(maps: _Maps, text: pa.Array, lower: bool):
    """Word ids of texts in turn, each as begin, words, end; begins' and unknown flags apart."""
    words, codes, counts = words_of(text, lower)
    ids = maps.words(_hashes(words))
    end, begin = len(words), len(words) + 1
    codes, counts = with_ends(codes, counts, end)
    codes = np.insert(codes, np.cumsum(counts) - counts, begin)
    return ids[codes], codes == begin, counts


def _inside(first: np.ndarray, k: int) -> np.ndarray:
    """Whether the k words from each place on lie in one text (no begin among the later ones)."""
    ok = np.ones(len(first), bool)
    ok[max(0, len(first) - k + 1) :] = False
    for j in range(1, min(k, len(first))):
        ok[: len(first) - j] &= ~first[j:]
    return ok


def _count_grams(model: Model, k: int, lower: bool):
    def run(batches):
        maps, held = _Maps(model), _Counter()
        for batch in slices(batches, 0):
            ids, first, _ = _stream(maps, batch[0], lower)
            shard, places = maps.chains(ids, k - 1)
            last = np.full(len(ids), -1, np.int64)
            last[: max(0, len(ids) - k + 1)] = ids[k - 1 :]
            for s, rows in _by_shard(shard, _inside(first, k) & (places[-1] >= 0) & (last >= 0)):
                held.add(s, *_counted(_key(places[-1][rows], last[rows])))
            if held.held > HOLD:
                yield from _rows(held.blobs())
        yield from _rows(held.blobs())

    return run


def _continuations(model: Model, k: int):
    """Counts of distinct words before each n-gram of order ``k``, from the keys of order k + 1."""

    def run(batches):
        maps, held = _Maps(model), _Counter()
        for batch in batches:
            for shard in batch[0].to_pylist():
                keys = maps.get("keys", k + 1, shard, np.uint64)
                for at in range(0, len(keys), HOLD):
                    part = keys[at : at + HOLD]
                    words, place = [], (part >> np.uint64(32)).astype(np.int64)
                    words.append((part & np.uint64(0xFFFFFFFF)).astype(np.int64))
                    for j in range(k, 1, -1):
                        upper = maps.get("keys", j, shard, np.uint64)[place]
                        words.append((upper & np.uint64(0xFFFFFFFF)).astype(np.int64))
                        place = (upper >> np.uint64(32)).astype(np.int64)
                    words.reverse()  # the n-gram without its first word
                    to = np.searchsorted(maps.bases, words[0], "right") - 1
                    place = words[0] - maps.bases[to]
                    for j in range(2, k + 1):
                        place = maps.step(j, to, place, words[j - 1])
                    for s, rows in _by_shard(to, place >= 0):
                        held.add(s, *_counted(place[rows].astype(np.uint64)))
                    if held.held > HOLD:
                        yield from _rows(held.blobs())
        yield from _rows(held.blobs())

    return run


_TOTALS = ["n", "total", "used", "n1", "n2", "n3", "n4"]


def _totals(counts: np.ndarray) -> dict:
    return {"n": len(counts), "total": int(counts.sum()), "used": int((counts > 0).sum()), **{f"n{i}": int((counts == i).sum()) for i in range(1, 5)}}


def _context_sums(keys: np.ndarray, counts: np.ndarray, contexts: int) -> np.ndarray:
    """For each context: summed counts and the number of counts of 1, 2 and over."""
    place = (keys >> np.uint64(32)).astype(np.int64)
    columns = [np.bincount(place, counts, contexts)] + [np.bincount(place[m], minlength=contexts) for m in (counts == 1, counts == 2, counts > 2)]
    return np.stack(columns, axis=1).astype(np.float32)


def _discounts(rows: list[dict]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and over; 0.5, 1 and 1.5 where undefined."""
    n1, n2, n3, n4 = (sum(r[f"n{i}"] for r in rows) for i in range(1, 5))
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return found if all(0 < d <= i for i, d in enumerate(found, 1)) else (0.5, 1.0, 1.5)


def fit(texts: DataFrame, text_col: str, order: int = ORDER, lower: bool = True) -> Model:
    """Count and store the model of whole texts (null: empty).

    The shards hold about ``SHARD_BYTES`` of text each. Word ids and places within a shard must be below
    2**32, which is checked. An empty table gives a model that scores every token alike.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    spark: SparkSession = texts.sparkSession
    rows = texts.select(F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(4, math.ceil(size / SHARD_BYTES))
    folder = scratch(spark, "ngrams")
    blank = Model(folder, order, (0,) * (shards + 1), 0, 0, (), 0, 0.0)
    begin_shard = int(_shard_of(np.array([BEGIN], np.uint64), shards)[0])

    def finish_words(shard, keys, counts):
        if shard == begin_shard:
            at = int(np.searchsorted(keys, np.uint64(BEGIN)))
            keys, counts = np.insert(keys, at, np.uint64(BEGIN)), np.insert(counts, at, 0)
        put(blank.file("keys", 1, shard), [keys.tobytes()])
        put(blank.file("raw", 1, shard), [counts.astype(np.uint64).tobytes()])
        return _totals(counts)

    found = _merge(rows.mapInArrow(_count_words(shards, lower), "shard int, blob binary"), shards, finish_words, _TOTALS)
    bases = tuple(np.concatenate([[0], np.cumsum([r["n"] for r in found])]).tolist())
    if bases[-1] >= 1 << 32:
        raise ValueError("more than 2**32 distinct words")
    tokens = sum(r["total"] for r in found)
    model = Model(folder, order, bases, tokens, bases[-1] - 1, (), 0, 0.0)
    sizes = {1: [r["n"] for r in found]}
    grams = {1: found}

    def writer(k):
        contexts = sizes[k - 1]

        def finish(shard, keys, counts):
            put(model.file("keys", k, shard), [keys.tobytes()])
            put(model.file("raw", k, shard), [counts.astype(np.float32).tobytes()])
            if k == order:
                put(model.file("sums", k, shard), [_context_sums(keys, counts, contexts[shard]).tobytes()])
            return _totals(counts)

        return finish

    for k in range(2, order + 1):
        parts = rows.mapInArrow(_count_grams(model, k, lower), "shard int, blob binary")
        grams[k] = _merge(parts, shards, writer(k), _TOTALS)
        sizes[k] = [r["n"] for r in grams[k]]
        if max(sizes[k]) >= 1 << 32:
            raise ValueError("a shard has more than 2**32 n-grams")

    def adjuster(k):
        contexts = sizes.get(k - 1)

        def finish(shard, places, counts):
            full = np.zeros(sizes[k][shard], np.int64)
            full[places.astype(np.int64)] = counts
            if k > 1:
                # n-grams that begin a text have no word before them and keep their counts
                raw = mapped(model.file("raw", k, shard), np.float32)
                keys = mapped(model.file("keys", k, shard), np.uint64)
                full = np.where(full == 0, raw, full)
                put(model.file("sums", k, shard), [_context_sums(keys, full, contexts[shard]).tobytes()])
            put(model.file("adjusted", k, shard), [full.astype(np.float32).tobytes()])
            return _totals(full)

        return finish

    adjusted = {order: grams[order]}
    for k in range(order - 1, 0, -1):
        tasks = spark.range(0, shards, numPartitions=min(shards, 4096)).select(F.col("id").cast("int"))
        parts = tasks.mapInArrow(_continuations(model, k), "shard int, blob binary")
        adjusted[k] = _merge(parts, shards, adjuster(k), _TOTALS)
    discounts = tuple(_discounts(adjusted[k]) for k in range(1, order + 1))
    unigrams, used, n1, n2 = (sum(r[c] for r in adjusted[1]) for c in ("total", "used", "n1", "n2"))
    freed = float(np.dot(discounts[0], (n1, n2, used - n1 - n2))) / max(1, unigrams)
    return Model(folder, order, bases, tokens, bases[-1] - 1, discounts, unigrams, freed)


# --- scoring ----------------------------------------------------------------------------------


def _less(counts: np.ndarray, discounts) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *discounts])[np.minimum(counts, 3).astype(np.int64)], 0.0)


def log_probabilities(maps: _Maps, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the model's probability of each token (0 for begins), and its training count."""
    model = maps.model
    shard, places = maps.chains(ids, model.order)
    kind = lambda k: ("raw", np.uint64 if k == 1 else np.float32) if k == model.order else ("adjusted", np.float32)
    name, dtype = kind(1)
    adjusted = maps.gather(name, 1, shard, places[0], dtype).astype(np.float64)
    p = _unigram(maps, adjusted)
    for k in range(2, model.order + 1):
        d1, d2, d3 = model.discounts[k - 1]
        name, dtype = kind(k)
        n = len(ids)
        if n < k:
            break
        sums = maps.gather("sums", k, shard, np.where(_inside(first, k - 1), places[k - 2], -1), np.float32, 4).astype(np.float64)
        counts = maps.gather(name, k, shard, places[k - 1], dtype).astype(np.float64)
        sums, counts = sums[: n - k + 1], counts[: n - k + 1]
        seen = (sums[:, 0] > 0) & _inside(first, k)[: n - k + 1]
        total = np.maximum(sums[:, 0], 1.0)
        weight = (d1 * sums[:, 1] + d2 * sums[:, 2] + d3 * sums[:, 3]) / total
        p[k - 1 :] = np.where(seen, _less(counts, (d1, d2, d3)) / total + weight * p[k - 1 :], p[k - 1 :])
    raw = maps.gather("raw", 1, shard, places[0], np.uint64).astype(np.int64)
    return np.where(first, 0.0, np.log10(p)), raw


def _unigram(maps: _Maps, adjusted: np.ndarray) -> np.ndarray:
    model = maps.model
    if not model.unigrams:
        return np.full(len(adjusted), 1.0 / (model.types + 1))
    return _less(adjusted, model.discounts[0]) / model.unigrams + model.freed / (model.types + 1)


def score(docs: DataFrame, model: Model, id_col: str, text_col: str, lower: bool = True) -> DataFrame:
    """``id_col``, n_tokens, n_known, train_tokens, base_score, score of each whole text.

    ``score`` is the log10 probability of the words and the end; ``base_score`` that of an add-one unigram
    model. Perplexity is ``10 ** (-score / n_tokens)``. Defined cases: a null text counts as empty and has
    the end alone; ids of any kind, null or repeated, are passed on row by row; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col), F.col(text_col))
    kind = rows.schema[id_col].dataType.simpleString()
    out = f"`{id_col}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(batches):
        maps = _Maps(model)
        rest = math.log10(model.tokens + model.types + 1)
        for batch in slices(batches, 1):
            ids, first, counts = _stream(maps, batch[1], lower)
            logs, raw = log_probabilities(maps, ids, first)
            starts = np.cumsum(counts + 1) - counts - 1
            base = np.where(first, 0.0, np.log10(raw + 1.0) - rest)
            columns = [
                counts, np.add.reduceat(((raw > 0) & ~first).astype(np.int64), starts), np.full(len(counts), model.tokens),
                np.add.reduceat(base, starts), np.add.reduceat(logs, starts),
            ]
            yield pa.RecordBatch.from_arrays(
                [batch[0], *(pa.array(c) for c in columns)], names=[id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"]
            )

    return rows.mapInArrow(run, out)
