"""Exact top-k inner products over a bit-sliced index.

Every vector component is quantised to ``floor(scale * x)``. An index block holds the bits of
each component, less the block's minimum, as one bitmap per (component, bit). A query adds the
slices of all components, shifted by the bits of its own components, with carry-save bitmap
adders; the sum's slices are then walked from the most significant one downward, which keeps
the rows that are certainly in the top k and those tied with its last place. Boundary rows, all
of equal score, are resolved by the smaller id. No score is approximated.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
BLOCK_ROWS = 16_384
QUERY_ROWS = 96

_INDEX = "block long, dim int, n int, ids binary, lows binary, widths binary, slices binary"
_QUERIES = "slot long, first long, dim int, ids binary, vectors binary"
_HITS = "query_key long, query_id long, vec_id long, score long"


def quantise(x: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of each component; an error where that is no 64-bit integer."""
    far = F.raise_error(F.lit("a scaled component does not fit into 64 bits")).cast("long")
    step = lambda v: F.when(F.abs(v.cast("double") * scale) < 2.0**63, F.floor(v.cast("double") * scale)).otherwise(far)
    return F.transform(x, step)


def usable(x: Column) -> Column:
    """True for a vector that is not null and holds finite numbers only."""
    bad = lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf"))
    return x.isNotNull() & ~F.exists(x, bad)


def slice_block(values: np.ndarray):
    """Lowest value, bit width and stacked bitmaps (uint64 words) of each component."""
    n, dim = values.shape
    lows = values.min(axis=0) if dim else np.zeros(0, np.int64)
    # differences of 64-bit integers fit into 64 unsigned bits
    above = (values - lows).T.astype(np.int64).view(np.uint64)
    widths = np.array([int(r.max()).bit_length() for r in above], np.int32)
    words = -(-n // 64)
    out = np.zeros((int(widths.sum()), words * 8), np.uint8)
    at = 0
    for row, width in zip(above, widths):
        for bit in range(width):
            packed = np.packbits((row >> np.uint64(bit) & np.uint64(1)).astype(np.uint8), bitorder="little")
            out[at, : len(packed)] = packed
            at += 1
    return lows.astype(np.int64), widths, out.view(np.uint64)


def add_slices(query: np.ndarray, lows, widths, slices):
    """Bitmaps of ``query . row - base`` by weight (least first), and ``base``.

    A negative factor takes the complement of its slices, so that all terms are positive.
    """
    starts = np.concatenate([[0], np.cumsum(widths)[:-1]]).astype(np.int64) if len(widths) else widths
    base = int(np.dot(query.astype(object), lows.astype(object))) if len(query) else 0
    picks: list[list[int]] = []
    flips: list[list[bool]] = []
    for q, width, start in zip(query.tolist(), widths.tolist(), starts.tolist()):
        if q < 0:
            base += q * ((1 << width) - 1)
        size = abs(q)
        for j in range(size.bit_length()):
            if size >> j & 1:
                while len(picks) < j + width:
                    picks.append([])
                    flips.append([])
                for i in range(width):
                    picks[i + j].append(start + i)
                    flips[i + j].append(q < 0)
    sums = []
    carried = np.zeros((0, slices.shape[1]), np.uint64)
    weight = 0
    while weight < len(picks) or len(carried):
        x = carried
        if weight < len(picks) and picks[weight]:
            own = slices[picks[weight]]
            turned = np.array(flips[weight])
            own[turned] = ~own[turned]
            x = np.concatenate([carried, own])
        carries = []
        while len(x) > 2:
            m = len(x) // 3
            a, b, c = x[:m], x[m : 2 * m], x[2 * m : 3 * m]
            half = a ^ b
            carries.append((a & b) | (c & half))
            x = np.concatenate([half ^ c, x[3 * m :]])
        if len(x) == 2:
            carries.append(x[:1] & x[1:])
            x = x[:1] ^ x[1:]
        sums.append(x[0] if len(x) else np.zeros(slices.shape[1], np.uint64))
        carried = np.concatenate(carries) if carries else carried[:0]
        weight += 1
    return sums, base


def top_rows(sums, allowed: np.ndarray, k: int):
    """Positions of the ``k`` largest sums among ``allowed`` rows; ties go to lower positions."""
    sure, open_ = np.zeros_like(allowed), allowed.copy()
    count = lambda m: int(np.bitwise_count(m).sum())
    held = 0
    if count(open_) > k:
        for s in reversed(sums):
            upper = open_ & s
            got = held + count(upper)
            if got >= k:
                open_ = upper
                if got == k:
                    break
            else:
                sure |= upper
                held = got
                open_ &= ~s
    rows = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
    return np.concatenate([rows(sure), rows(open_)[: k - held]])


def _build(batches, block_rows: int):
    from pyspark import TaskContext

    block = TaskContext.get().partitionId()
    held: dict[int, list] = {}

    def close(dim):
        ids, vectors = zip(*held.pop(dim))
        ids = np.concatenate(ids)
        values = np.concatenate(vectors)
        order = np.argsort(ids, kind="stable")
        lows, widths, slices = slice_block(values[order])
        return pa.RecordBatch.from_pylist(
            [{"block": block, "dim": dim, "n": len(ids), "ids": ids[order].tobytes(), "lows": lows.tobytes(),
              "widths": widths.tobytes(), "slices": slices.tobytes()}],
            schema=pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()),
                              ("lows", pa.binary()), ("widths", pa.binary()), ("slices", pa.binary())]),
        )

    for ids, dim, values in _by_dim(batches):
        for at in range(0, len(ids), block_rows):
            held.setdefault(dim, []).append((ids[at : at + block_rows], values[at : at + block_rows]))
            if sum(len(x[0]) for x in held[dim]) >= block_rows:
                yield close(dim)
    for dim in list(held):
        yield close(dim)


def _by_dim(batches):
    """Ids and value matrices of one dimension at a time."""
    for batch in batches:
        ids = batch["vec_id"].to_numpy(zero_copy_only=False)
        lists = batch["v"]
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.asarray(pa.compute.list_value_length(lists)))
        dims = np.diff(ends, prepend=0)
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            at = (ends[rows] - dim)[:, None] + np.arange(dim)
            yield ids[rows], int(dim), flat[at].reshape(len(rows), int(dim)).astype(np.int64)


def _pack_queries(batches):
    from pyspark import TaskContext

    slot, first = TaskContext.get().partitionId(), 0
    rows = []
    for ids, dim, values in _by_dim(batches):
        rows.append({"slot": slot, "first": first, "dim": dim, "ids": ids.tobytes(), "vectors": values.tobytes()})
        first += len(ids)
    schema = pa.schema([("slot", pa.int64()), ("first", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])
    yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _search(batches, k: int):
    schema = pa.schema([(c, pa.int64()) for c in ("query_key", "query_id", "vec_id", "score")])
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.frombuffer(row["ids"], np.int64)
            lows, widths = np.frombuffer(row["lows"], np.int64), np.frombuffer(row["widths"], np.int32)
            words = -(-len(ids) // 64)
            slices = np.frombuffer(row["slices"], np.uint64).reshape(int(widths.sum()), words)
            real = np.zeros(words * 64, np.uint8)
            real[: len(ids)] = 1
            asked = np.frombuffer(row["q_ids"], np.int64)
            vectors = np.frombuffer(row["vectors"], np.int64).reshape(len(asked), row["dim"])
            out = {c: [] for c in schema.names}
            for i, (q_id, q) in enumerate(zip(asked.tolist(), vectors)):
                sums, base = add_slices(q, lows, widths, slices)
                free = real.copy()
                free[np.searchsorted(ids, q_id) : np.searchsorted(ids, q_id, "right")] = 0
                hits = top_rows(sums, np.packbits(free, bitorder="little").view(np.uint64), k)
                word, bit = hits // 64, (hits % 64).astype(np.uint64)
                kind = np.int64 if len(sums) < 62 and abs(base) < 1 << 62 else object
                scores = np.full(len(hits), base, kind)
                for w, s in enumerate(sums):
                    scores += ((s[word] >> bit) & np.uint64(1)).astype(np.int64).astype(kind) << w
                if any(not -(1 << 63) <= x < 1 << 63 for x in scores.tolist()):
                    raise OverflowError("a score does not fit into 64 bits")
                out["query_key"] += [(row["slot"] << 32) + row["first"] + i] * len(hits)
                out["query_id"] += [q_id] * len(hits)
                out["vec_id"] += ids[hits].tolist()
                out["score"] += scores.tolist()
            yield pa.RecordBatch.from_pydict(out, schema=schema)


def top_inner_products(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str,
    vector_col: str,
    k: int = 5,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """The ``k`` best rows of ``vectors`` for each row of ``queries`` by integer inner product.

    Both frames hold ``id_col`` (long) and ``vector_col`` (array of numbers); other columns are
    ignored. Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id.

    Defined cases: rows with a null id, a null vector or a null or non-finite component take no
    part; vectors of another length than the query's are no candidates; a query's candidates
    leave out all rows of its own id; a repeated query row is answered once for each row; fewer
    than ``k`` candidates are all returned; an empty table gives no rows. Scaled
    components and the scores returned must fit into 64 bits, else the run fails.

    Queries and candidates meet in blocks: one equi-join on (block, slot), in which every
    block of the index meets every block of queries once; each meeting returns ``k`` rows a query.
    """
    frame = lambda df: df.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("vec_id"), quantise(F.col(vector_col)).alias("v")
    )
    rows, asked = frame(vectors), frame(queries)
    blocks = max(1, math.ceil(rows.count() / block_rows))
    slots = max(1, math.ceil(asked.count() / query_rows))
    index = rows.repartition(blocks).mapInArrow(lambda b: _build(b, block_rows), _INDEX)
    packed = asked.repartition(slots).mapInArrow(_pack_queries, _QUERIES)
    left = index.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    right = packed.withColumnRenamed("ids", "q_ids").withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    )
    best = left.join(right, ["block", "slot", "dim"]).mapInArrow(lambda b: _search(b, k), _HITS)
    ranked = Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
