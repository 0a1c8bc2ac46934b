"""Supervised subword embeddings: a linear softmax over averaged hashed word and character n-gram vectors.

A word's features are the word itself and its character n-grams with boundary marks, hashed into
``BUCKETS`` vectors. A document is the mean of the vectors of all features of all its words. The
vectors and the softmax layer are trained by stochastic gradient descent in numpy on a sample of
at most ``SAMPLE`` labelled rows; every row is scored over its whole text. As the output is linear in the
mean, a worker needs only each feature's share of the logits, summed once per distinct word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .shared import hand_back, trimmed
from .words import slices, words_of

BUCKETS = 1 << 17
GRAMS = (3, 4)
DIM = 16
EPOCHS = 6
RATE = 0.5
SAMPLE = 3000
CACHE_WORDS = 120_000
PART = 10_000
SLICE = 2 << 20
ACCEPT = 0.3


@dataclass(frozen=True)
class Classifier:
    """Logits per feature bucket (buckets x classes) and the bias; classes in the order of ``classes``."""

    classes: tuple
    shares: np.ndarray
    bias: np.ndarray
    grams: tuple[int, ...] = GRAMS


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def features(words: list[str], buckets: int, grams=GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every feature of the words, ordered by word, and the features per word."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    step = np.uint64(0x100000001B3)
    # the whole word: an order-dependent sum over its characters
    place = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole = np.add.reduceat(_mixed(points + _mixed(place.astype(np.uint64) + np.uint64(1))), np.cumsum(sizes) - sizes)
    found, owners = [_mixed(whole)], [np.arange(len(words))]
    for n in grams:
        if len(points) < n:
            continue
        h = np.full(len(points) - n + 1, n, np.uint64)
        for i in range(n):
            h = h * step + points[i : len(points) - n + 1 + i]
        inside = owner[: len(h)] == owner[n - 1 :]
        found.append(_mixed(h[inside]))
        owners.append(owner[: len(h)][inside])
    by = np.concatenate(owners)
    order = np.argsort(by, kind="stable")
    return (np.concatenate(found)[order] % np.uint64(buckets)).astype(np.int64), np.bincount(by, minlength=len(words))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, buckets: int = BUCKETS, dim: int = DIM,
          epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Gradient descent over (buckets, counts) bags; returns logits per bucket and the bias.

    The step of a bag's vectors isn't divided by their number, so that long texts train them as fast as
    short ones; it moves the mean by the same amount.
    """
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out, bias = np.zeros((classes, dim), np.float32), np.zeros(classes, np.float32)
    left = total = epochs * len(bags)
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, counts = bags[i]
            lr = np.float32(rate * left / total)
            left -= 1
            if not len(ids):
                mean = np.zeros(dim, np.float32)
            else:
                mean = counts @ table[ids] / counts.sum()
            z = out @ mean + bias
            z = np.exp(z - z.max())
            g = z / z.sum()
            g[labels[i]] -= 1
            back = g @ out
            out -= lr * np.outer(g, mean)
            bias -= lr * np.float32(0.1) * g
            if len(ids):
                table[ids] -= lr * back
    return table @ out.T, bias


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE,
        buckets: int = BUCKETS, seed: int = 7) -> Classifier:
    """Train on ``sample`` labelled rows at most, chosen by a hash of their id, over their whole texts.

    Rows of ``labels`` with a null id or label are ignored; of several labels of an id the larger one
    counts. Without labelled rows the scores are 0.5.
    """
    seen = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("_label"))
    # only rows that have a document count against the bound
    known = seen.join(docs.select(id_col).distinct(), id_col, "left_semi")
    chosen = known.orderBy(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), id_col).limit(sample)
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), "_label")

    def bags(batches):
        for batch in slices(batches, 1, SLICE):
            words, codes, counts = words_of(batch[1], lower=False)
            ids, sizes = features(words.to_pylist(), buckets)
            ends = np.cumsum(sizes)
            cut = np.split(codes, np.cumsum(counts)[:-1])
            out = []
            for own in cut:
                at = [ids[ends[c] - sizes[c] : ends[c]] for c in own]
                b, n = np.unique(np.concatenate(at) if at else ids[:0], return_counts=True)
                out.append((b.astype(np.int32).tobytes(), n.astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch[0], batch[2].cast(pa.int64()), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())],
                names=["id", "label", "buckets", "counts"],
            )

    found = rows.mapInArrow(trimmed(bags), "id string, label long, buckets binary, counts binary").toArrow()
    order = np.argsort(np.array(found["id"].to_pylist(), dtype=object)) if found.num_rows else []
    given = found["label"].to_numpy()
    classes = tuple(sorted(set(given.tolist()) | {0, 1}))
    if not found.num_rows:
        return Classifier(classes, np.zeros((buckets, len(classes)), np.float32), np.zeros(len(classes), np.float32))
    # views of the collected rows, not copies
    bag = [(np.frombuffer(found["buckets"][int(i)].as_buffer(), np.int32), np.frombuffer(found["counts"][int(i)].as_buffer(), np.float32)) for i in order]
    shares, bias = train(bag, np.searchsorted(classes, given[order]), len(classes), buckets, seed=seed)
    # the driver lives on through the stages that follow
    del bag, found
    hand_back()
    return Classifier(classes, shares, bias)


class _Words:
    """Summed logits and feature counts of the words met so far; starts anew at ``CACHE_WORDS``."""

    def __init__(self, model: Classifier):
        self.model = model
        self.clear()

    def clear(self):
        self.place: dict[str, int] = {}
        self.sums = np.zeros((1024, len(self.model.classes) + 1), np.float32)

    def places(self, words: list[str]) -> np.ndarray:
        if len(self.place) > CACHE_WORDS:
            self.clear()
        fresh = [w for w in words if w not in self.place]
        for first in range(0, len(fresh), PART):
            new = fresh[first : first + PART]
            at = len(self.place)
            ids, sizes = features(new, len(self.model.shares), self.model.grams)
            starts = np.cumsum(sizes) - sizes
            if at + len(new) > len(self.sums):
                grown = np.zeros((2 * (at + len(new)), self.sums.shape[1]), np.float32)
                grown[:at] = self.sums[:at]
                self.sums = grown
            self.sums[at : at + len(new), :-1] = np.add.reduceat(self.model.shares[ids], starts)
            self.sums[at : at + len(new), -1] = sizes
            self.place.update(zip(new, range(at, at + len(new))))
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))


def score(docs: DataFrame, model: Classifier, text_col: str, label: int = 1, out_col: str = "score") -> DataFrame:
    """``docs`` with the probability of ``label`` for each whole text in ``out_col``.

    Defined cases: null and blank texts have no features and get the bias' probability; repeated rows
    score alike; an empty table stays empty; all other columns are passed on, whatever their names.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)
    schema = docs.schema
    at = schema.names.index(text_col)
    target = model.classes.index(label)

    def run(batches):
        held = _Words(shipped.value)
        for batch in slices(batches, at, SLICE):
            words, codes, counts = words_of(batch[at], lower=False)
            places = held.places(words.to_pylist())
            sums = np.zeros((len(counts), held.sums.shape[1]))
            full = np.flatnonzero(counts)
            if len(full):
                sums[full] = np.add.reduceat(held.sums[places[codes]], (np.cumsum(counts) - counts)[full], dtype=np.float64)
            z = sums[:, :-1] / np.maximum(sums[:, -1:], 1) + held.model.bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            p = z[:, target] / z.sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, out_col])

    if out_col in schema.names:
        raise ValueError(f"the documents have a column {out_col} already")
    return docs.mapInArrow(trimmed(run), StructType([*schema.fields, StructField(out_col, DoubleType())]))
