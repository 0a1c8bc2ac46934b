"""Near copies by the Jaccard similarity of the texts' five-word shingles.

Rows are classes of equal shingle sets. The SimHash trie join links classes whose fingerprints of the distinct shingles differ in at most
``BITS`` bits, which are the closest copies. All others meet by MinHash bands of the shingle sets: two texts meet if all ``ROWS`` minima of
one of ``BANDS`` bands agree, which at a similarity of 0.8 fails for 1 - 0.8 ** ROWS of a band only, for 7 pairs in 100,000 of all bands. Every
link is confirmed with the exact similarity of the two sets, so no group holds a link below ``SIMILARITY``.

Rows that meet in a band are a cell. First the trie's links and a tree of the likeliest pairs of each cell are confirmed, which joins dense
groups without all of their pairs. Then all pairs of a cell's rows that are still in different components and whose signatures
agree in ``LEAST`` of the minima (0.8 less five deviations) are confirmed within the cell, in the first band that the two share; only the
rows that have such a pair take their texts there, and only a forest of links comes out, so no step writes more rows than it takes.
Cells of more than ``CELL`` rows are cut into blocks; in the second step every two blocks meet, but for those within the
cell's largest component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored, trimmed
from .simhash_trie import SEED, majority, merge_stars, trie_links
from .words import slices

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
LEAST = 72
CELL = 256
#: Differing bits of fingerprints that the trie join links.
BITS = 3
CHUNK = 4096
#: Bytes of text taken at a time.
SLICE = 1 << 20

_rng = np.random.default_rng(SEED)
_FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles; none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: max(1, len(words) - shingle + 1)].tolist()
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(joined[s:e], SEED) for s, e in zip(starts, last)]), "<u8"))


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two shingle sets have a Jaccard similarity of ``least``; two empty sets have."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def minima(hashes: np.ndarray) -> np.ndarray:
    """Least value of each of the hash functions over a set that is not empty."""
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), CHUNK):
            part = hashes[at : at + CHUNK, None] * _FACTORS + _SHIFTS
            np.minimum(out, part.min(axis=0), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """A signed 64-bit key of each band."""
    key = np.arange(BANDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for column in least.reshape(BANDS, ROWS).T:
            key = (key ^ column) * _MIX
            key ^= key >> np.uint64(32)
    return key.view(np.int64)


def tree(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tree of the greatest agreement between rows of signatures, as far as it reaches ``LEAST``."""
    n = len(marks)
    best, near = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    at, u, v = 0, [], []
    free = np.ones(n, bool)
    free[0] = False
    for _ in range(n - 1):
        alike = (marks == marks[at]).sum(axis=1)
        better = alike > best
        best[better], near[better] = alike[better], at
        at = int(np.argmax(np.where(free, best, -1)))
        free[at] = False
        if best[at] >= LEAST:
            u.append(at)
            v.append(int(near[at]))
    return np.array(u, np.int64), np.array(v, np.int64)


def across(marks: np.ndarray, keys: np.ndarray, group: np.ndarray, side: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of different groups and sides (a side of -1 meets all) that agree in ``LEAST`` minima and share ``band`` as their first."""
    u, v = [], []
    for i in range(len(marks) - 1):
        later = i + 1 + np.flatnonzero((group[i + 1 :] != group[i]) & ((side[i + 1 :] != side[i]) | (side[i] < 0)))
        later = later[(marks[later] == marks[i]).sum(axis=1) >= LEAST]
        later = later[(keys[later] == keys[i]).argmax(axis=1) == band]
        u.append(np.full(len(later), i, np.int64))
        v.append(later)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(u or none), np.concatenate(v or none)


def _likely(cells: DataFrame) -> DataFrame:
    """Distinct pairs (u, v) of the trees of cells (cell, node, mark), each with one of its cells."""

    def run(batches):
        for batch in batches:
            sizes, flat = batch["rows"].value_lengths().to_numpy(), batch["rows"].flatten()
            nodes = flat.field("node").to_numpy()
            marks = _signatures(flat.field("mark"))
            cell, us, vs, at = [], [], [], 0
            for key, n in zip(batch["cell"].to_pylist(), sizes.tolist()):
                mine = slice(at, at + n)
                u, v = tree(marks[mine])
                cell.append(np.full(len(u), key, np.int64))
                us.append(nodes[mine][u])
                vs.append(nodes[mine][v])
                at += n
            columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (cell, us, vs)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cell", "u", "v"])

    held = cells.groupBy("cell").agg(F.collect_list(F.struct("node", "mark")).alias("rows")).filter(F.size("rows") > 1)
    found = held.mapInArrow(trimmed(run), "cell long, u long, v long").filter("u <> v")
    return found.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("cell").alias("cell"))


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)


def _bands(column) -> np.ndarray:
    return np.array(column.to_pylist(), np.int64).reshape(-1, BANDS)


_MEMBER = "cell long, band int, node long, group long, side int, mark binary, keys array<long>"


def _paired(cells: DataFrame) -> DataFrame:
    """The rows of cells that have a pair to confirm; columns of ``_MEMBER``."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        u, v = across(
            _signatures(table["mark"]), _bands(table["keys"]), table["group"].to_numpy(), table["side"].to_numpy(), table["band"][0].as_py()
        )
        return table.take(pa.array(np.unique(np.concatenate([u, v]))))

    return cells.select(*[c.split()[0] for c in _MEMBER.split(", ")]).groupBy("cell").applyInArrow(run, _MEMBER)


def _joined(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v), a forest of each cell, among the pairs of its rows whose texts (node, text) are similar."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        nodes = table["node"].to_pylist()
        u, v = across(
            _signatures(table["mark"]), _bands(table["keys"]), table["group"].to_numpy(), table["side"].to_numpy(), table["band"][0].as_py()
        )
        sets = [shingle_set(t) for t in table["text"].to_pylist()]
        return _forest(nodes, sets, zip(u.tolist(), v.tolist()))

    return rows.join(texts, "node").select(*[c.split()[0] for c in _MEMBER.split(", ")], "text").groupBy("cell").applyInArrow(run, "u long, v long")


def _forest(nodes: list[int], sets: list[np.ndarray], pairs) -> pa.Table:
    """The similar ones of the pairs of places; pairs of one local component need no comparison."""
    root = list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    links = []
    for u, v in pairs:
        a, b = find(u), find(v)
        if a != b and similar(sets[u], sets[v]):
            root[a] = b
            links.append((nodes[u], nodes[v]))
    return pa.table({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([x for _, x in links], pa.int64())})


def _confirm(table: pa.Table) -> pa.Table:
    """The pairs of a cell that are similar; pairs of one local component need no comparison."""
    nodes = table["node"].to_pylist()
    place = {n: i for i, n in enumerate(nodes)}
    pairs = [(place[u], place[v]) for u, others in zip(nodes, table["others"].to_pylist()) for v in others]
    return _forest(nodes, [shingle_set(t) for t in table["text"].to_pylist()], pairs)


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) among ``pairs`` (cell, u, v) whose texts (node, text) are similar; a cell's are read once."""
    ends = pairs.select("cell", F.col("u").alias("node"), F.col("v").alias("other")).unionByName(
        pairs.select("cell", F.col("v").alias("node"), F.lit(None).cast("long").alias("other"))
    )
    asked = ends.groupBy("cell", "node").agg(F.collect_list("other").alias("others"))
    return asked.join(texts, "node").select("cell", "node", "others", "text").groupBy("cell").applyInArrow(_confirm, "u long, v long")


def _of_stars(links: DataFrame, cell: int) -> DataFrame:
    """Links of the trie join as pairs (cell, u, v): the links of one star's centre, a large star in several cells."""
    stars = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    sizes = stars.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.xxhash64("u"), F.ceil(F.col("n") / cell).cast("long"))
    return stars.join(sizes, "v").select(F.xxhash64("v", part).alias("cell"), "u", "v")


def _met(rows: DataFrame, cell: int) -> DataFrame:
    """Cells in which all rows of different groups meet that share a key. ``rows``: key, band, n, node, group.

    Rows of one side of a cell meet in another cell, or are of one group; a side of -1 meets all.
    """
    many = rows.groupBy("key").agg((F.min("group") < F.max("group")).alias("many")).filter("many").select("key")
    rows = rows.join(many, "key")
    small = rows.filter(F.col("n") <= cell).select(F.col("key").alias("cell"), "band", "node", "group", F.lit(-1).alias("side"))
    half = max(1, cell // 2)
    zero = F.lit(0).cast("long")
    hot = rows.filter(F.col("n") > cell)
    parts = hot.groupBy("key", "group").agg(F.count(F.lit(1)).alias("m"))
    whole = parts.groupBy("key").agg(F.max(F.struct("m", "group")).alias("top"), F.sum("m").alias("all"))
    blocks = whole.select(
        "key", F.col("top.group").alias("largest"), F.ceil(F.col("top.m") / half).alias("nd"),
        F.ceil((F.col("all") - F.col("top.m")) / half).alias("nr"),
    )
    dealt = hot.join(blocks, "key").withColumn("dense", F.col("group") == F.col("largest"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("dense"), F.col("nd")).otherwise(F.col("nr"))))
    with_rest = dealt.withColumn("at", F.explode(F.sequence(zero, F.col("nr") - 1)))
    rest = F.xxhash64("key", F.lit("rest"), F.least("own", "at"), F.greatest("own", "at"))
    side = F.when(F.col("dense"), 0).when(F.col("own") == F.col("at"), -1).otherwise((F.col("own") > F.col("at")).cast("int"))
    first = with_rest.select(
        F.when(F.col("dense"), F.xxhash64("key", F.lit("dense"), "own", "at")).otherwise(rest).alias("cell"), "band", "node", "group", side.alias("side")
    )
    with_dense = dealt.filter(~F.col("dense")).withColumn("at", F.explode(F.sequence(zero, F.col("nd") - 1)))
    second = with_dense.select(F.xxhash64("key", F.lit("dense"), "at", "own").alias("cell"), "band", "node", "group", F.lit(1).alias("side"))
    return small.unionByName(first).unionByName(second)


def one_of_each_group(docs: DataFrame, id_col: str, text_col: str, cell: int = CELL) -> DataFrame:
    """``docs`` with one row of each group of near copies.

    Two texts are linked if their sets of five-word shingles, lower-cased in A-Z and cut at ASCII white space, have a Jaccard similarity
    of 0.8 at least. A group is what links connect; its row of the smallest id stays (null ids last, then the smaller text hash).

    Defined cases: null and blank texts are copies of each other; fewer than five words are one shingle; of repeated rows
    one stays; an empty table stays empty; all other columns are passed on.
    """

    def run(batches):
        for batch in slices(batches, 2, SLICE):
            nodes, words, keys, marks = [], [], [], []
            for text in batch[2].to_pylist():
                mine = shingle_set(text)
                nodes.append(xxhash.xxh64_intdigest(mine.tobytes(), SEED))
                words.append(majority(mine))
                least = minima(mine)
                keys.append(band_keys(least) if len(mine) else [])
                marks.append((least & np.uint64(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch[0], batch[1], *(pa.array(np.array(c, np.uint64).view(np.int64)) for c in (nodes, words)), pa.array(keys, pa.list_(pa.int64())),
                 pa.array(marks, pa.binary())],
                names=["id", "hash", "node", "word", "keys", "mark"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col))
    kind = rows.schema["id"].dataType.simpleString()
    marked = rows.mapInArrow(trimmed(run), f"id {kind}, hash long, node long, word long, keys array<long>, mark binary")
    row = F.struct(F.col("id").isNull().alias("none"), "id", "hash")
    # a class: equal sets of shingles; its number is a hash of them
    first = [F.first(c).alias(c) for c in ("word", "keys", "mark")]
    classes = stored(marked.groupBy("node").agg(F.min(row).alias("least"), *first), "classes")
    spread = classes.select("node", F.posexplode("keys").alias("band", "key"))
    sizes = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = stored(spread.join(sizes, "key"), "met")
    signed = classes.select("node", "mark", "keys")

    mark = "_text_hash"
    while mark in docs.columns:
        mark += "_"
    held = docs.withColumn(mark, F.xxhash64(text_col)).alias("d")
    of_row = F.col(f"d.{id_col}").eqNullSafe(F.col("k.id")) & (F.col(f"d.{mark}") == F.col("k.hash"))

    blocks = F.ceil(F.col("n") / cell).cast("long")
    own = F.when(F.col("n") <= cell, F.col("key")).otherwise(F.xxhash64("key", F.pmod(F.xxhash64("node", "key"), blocks)))
    prints = classes.select("node", "word", F.lit(None).cast("binary").alias("more"))
    close = _of_stars(trie_links(prints, BITS), cell)
    trees = _likely(met.select(own.alias("cell"), "node").join(signed.drop("keys"), "node")).select("cell", "u", "v")
    likely = stored(close.unionByName(trees), "pairs")
    asked = likely.select(F.explode(F.array("u", "v")).alias("node")).unionByName(met.filter(F.col("n") > cell).select("node")).distinct()
    wanted = classes.join(asked, "node").select("node", "least.id", "least.hash").alias("k")
    texts = held.join(wanted, of_row).select("k.node", F.col(f"d.{text_col}").alias("text")).dropDuplicates(["node"])
    texts = stored(texts, "texts")
    links = stored(confirmed(likely, texts), "links")
    roots = stored(merge_stars(links), "roots")
    grouped = met.join(roots, "node", "left").select("key", "band", "n", "node", F.coalesce("root", "node").alias("group"))
    open_ = _paired(_met(stored(grouped, "grouped"), cell).join(signed, "node"))
    further = stored(_joined(stored(open_, "paired"), texts), "links")
    if not further.isEmpty():
        roots = merge_stars(links.unionByName(further))
    last = classes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = last.groupBy("root").agg(F.min("least").alias("least")).select("least.id", "least.hash").alias("k")
    return held.join(kept, of_row).select("d.*").dropDuplicates([id_col, mark]).drop(mark)
