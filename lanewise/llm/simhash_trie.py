"""SimHash near-duplicates by a binary trie self-join.

A fingerprint has a bit set where more than half of the text's shingle hashes have it. Pairs of
fingerprints within ``max_bits`` differing bits are found by walking pairs of trie nodes
together: differing bits add up on the way down and a pair is dropped once its budget is
spent. Four tries are walked, over the fingerprint rotated by 0, 16, 32 and 48 bits. For every pair there
is a rotation in which the first j quarters differ in at most j * max_bits / 4 bits, so each walk
has only that budget on its way, and together they miss nothing.

The upper levels are walked by Spark: a row says that a fingerprint takes part in a node pair,
and rows of node pairs with more than ``leaf`` fingerprints step down until none is left; whole words that
more rows share are compared block by block. The
lower levels are walked in numpy within a leaf pair, which returns a spanning star per local
component instead of all pairs, and passes over node pairs that are one component already. Stars
are merged by alternating large-star and small-star rounds, each written to the shared folder.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored, trimmed

SEED = 42
LEAF = 1024
STEP = 4
CHUNK = 1 << 16


def simhash(text: str | None, shingle: int, lower: bool = True) -> int:
    """Unsigned 64-bit fingerprint of a text; 0 without words."""
    raw = (text or "").encode()
    words = (raw.lower() if lower else raw).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        pairs = zip(starts[at : min(n, at + CHUNK)].tolist(), last[at : at + CHUNK].tolist())
        hashed = np.frombuffer(b"".join([digest(joined[s:e], SEED) for s, e in pairs]), np.uint8)
        counts += np.unpackbits(hashed.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n)
    return int.from_bytes(bits.tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """``id_col`` and fingerprint (signed 64-bit) of each row's whole text; null counts as empty."""

    def run(batches):
        for batch in batches:
            prints = np.array([simhash(t, shingle) for t in batch[1].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(prints.view(np.int64))], names=[id_col, "fingerprint"])

    rows = docs.select(id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(trimmed(run), f"`{id_col}` {kind}, fingerprint long")


def _budget(depth: int, max_bits: int) -> int:
    """Differing bits allowed in the first ``depth`` bits."""
    return max_bits * -(-depth // 16) // 4


def _flips(width: int, most: int) -> list[int]:
    return [sum(1 << b for b in bits) for n in range(most + 1) for bits in combinations(range(width), n)]


def _child(word: Column, depth: int, width: int) -> Column:
    """Bits ``depth`` .. ``depth + width`` of a word, counted from the most significant."""
    return F.shiftrightunsigned(word, 64 - depth - width).bitwiseAND((1 << width) - 1)


def _step_down(rows: DataFrame, depth: int, width: int, max_bits: int) -> DataFrame:
    """Rows of node pairs at ``depth``, put into the pairs of child nodes within the budget.

    Columns: trie, low, high (the nodes' prefixes; equal for a node with itself), side (of the
    row's own node), err (differing bits of the prefixes), word (rotated fingerprint), node, more.
    """
    budget = _budget(depth + width, max_bits)
    kept = rows.filter(F.col("err") <= budget)
    masks = F.array(*[F.lit(m).cast("long") for m in _flips(width, budget)])
    spread = kept.withColumn("mask", F.explode(masks)).withColumn("wrong", F.col("err") + F.bit_count("mask"))
    own = F.when(F.col("side") == 0, F.col("low")).otherwise(F.col("high"))
    other = F.when(F.col("side") == 0, F.col("high")).otherwise(F.col("low"))
    moved = spread.filter(F.col("wrong") <= budget).select(
        "trie",
        "word",
        "node",
        "more",
        "side",
        (F.col("low") == F.col("high")).alias("same"),
        F.col("wrong").cast("int").alias("err"),
        (F.shiftleft(own, width).bitwiseOR(_child(F.col("word"), depth, width))).alias("mine"),
        (F.shiftleft(other, width).bitwiseOR(_child(F.col("word"), depth, width).bitwiseXOR(F.col("mask")))).alias("its"),
    )
    side = F.when(F.col("same"), (F.col("mine") > F.col("its")).cast("int")).otherwise(F.col("side"))
    return moved.withColumn("side", side).select(
        "trie",
        F.when(F.col("side") == 0, F.col("mine")).otherwise(F.col("its")).alias("low"),
        F.when(F.col("side") == 0, F.col("its")).otherwise(F.col("mine")).alias("high"),
        "side",
        "err",
        "word",
        "node",
        "more",
    )


def _split(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """First position of each node range whose ``bit`` is set."""
    shift = np.uint64(bit + 1)
    edge = ((words[lo] >> shift) << shift) if bit < 63 else np.zeros(len(lo), np.uint64)
    return np.clip(np.searchsorted(words, edge | np.uint64(1 << bit)), lo, hi)


def _merged(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component after adding links."""
    root = root.copy()
    while len(u):
        low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        open_ = low != high
        u, v, low, high = u[open_], v[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    return root


def _one(root: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The component that each range lies in, -1 if in several."""
    at = np.stack([lo, hi], axis=1).ravel()
    padded = np.append(root, 0)
    least, most = np.minimum.reduceat(padded, at)[::2], np.maximum.reduceat(padded, at)[::2]
    return np.where(least == most, least, -1)


def join_nodes(words: np.ndarray, more: np.ndarray | None, left: int | None, depth: int, err: int, max_bits: int, max_more: int) -> np.ndarray:
    """Components of the fingerprints below two trie nodes, by a joint walk.

    ``words``: sorted uint64 of one node (``left`` is None), or of two, the first ``left`` of them sorted and the rest
    sorted. ``err`` bits of the nodes' prefixes of ``depth`` bits differ. ``more``: rows of further bits, of which linked
    rows may differ in ``max_more``. Small node pairs are compared word by word.
    """
    n = len(words)
    root = np.arange(n)

    def link(root, i, j):
        new = root[i] != root[j]
        i, j = i[new], j[new]
        ok = np.bitwise_count(words[i] ^ words[j]) <= max_bits
        i, j = i[ok], j[ok]
        if more is not None and len(i):
            ok = np.bitwise_count(more[i] ^ more[j]).sum(axis=1, dtype=np.int64) <= max_more
            i, j = i[ok], j[ok]
        return _merged(root, i, j) if len(i) else root

    if n > 256:
        # neighbours in sorted order join most of a dense cluster beforehand, so its node pairs need no walk
        for turn in (0, 16, 32, 48):
            order = np.argsort(words << np.uint64(turn) | words >> np.uint64(64 - turn) if turn else words, kind="stable")
            for gap in (1, 2, 3):
                root = link(root, order[:-gap], order[gap:])
    same = left is None
    one = lambda *v: [np.array([x], np.int64) for x in v]
    a0, a1, b0, b1, wrong = one(0, n if same else left, 0 if same else left, n, err)
    first, second = (words, words) if same else (words[:left], words[left:])
    shift = 0 if same else left
    while len(a0):
        own, other = _one(root, a0, a1), _one(root, b0, b1)
        open_ = (own < 0) | (own != other)
        sizes = (a1 - a0) * (b1 - b0)
        near = np.flatnonzero(open_ & ((sizes <= 256) | (depth >= 64)))
        for part in np.array_split(near, max(1, int(sizes[near].sum()) >> 20)):
            m, n_b = sizes[part], (b1 - b0)[part]
            node = np.repeat(np.arange(len(part)), m)
            k = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            root = link(root, a0[part][node] + k // n_b[node], b0[part][node] + k % n_b[node])
        far = open_ & (sizes > 256) & (depth < 64)
        a0, a1, b0, b1, wrong = a0[far], a1[far], b0[far], b1[far], wrong[far]
        if not len(a0):
            break
        bit = 63 - depth
        am, bm = _split(first, a0, a1, bit), _split(second, b0 - shift, b1 - shift, bit) + shift
        depth += 1
        budget = _budget(depth, max_bits)
        alike = (a0 == b0) & (a1 == b1)
        all_ = np.ones(len(a0), bool)
        kept = []
        for l0, l1, r0, r1, w, use in (
            (a0, am, b0, bm, wrong, all_), (am, a1, bm, b1, wrong, all_), (a0, am, bm, b1, wrong + 1, all_), (am, a1, b0, bm, wrong + 1, ~alike),
        ):
            use = use & (l1 > l0) & (r1 > r0) & (w <= budget)
            kept.append([x[use] for x in (l0, l1, r0, r1, w)])
        a0, a1, b0, b1, wrong = (np.concatenate(x) for x in zip(*kept))
    return root


def _leaf_links(depth: int, max_bits: int, max_more: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        low, high = (int(k.as_py()) for k in key[1:3])
        words, side = table["word"].to_numpy().view(np.uint64), table["side"].to_numpy()
        order = np.lexsort((words, side))
        more = table["more"].to_pylist()
        bits = np.frombuffer(b"".join(more), np.uint64).reshape(len(more), -1)[order] if more[0] is not None else None
        err = ((low ^ high) & (1 << 64) - 1).bit_count()
        left = None if low == high else int((side == 0).sum())
        root = join_nodes(words[order], bits, left, depth, err, max_bits, max_more)
        nodes = table["node"].to_numpy()[order]
        member = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"u": nodes[member], "v": nodes[root[member]]})

    return run


def _blocks_met(rows: DataFrame, leaf: int) -> DataFrame:
    """Rows of whole node pairs of more than ``leaf`` rows, put into all pairs of blocks of about half as many rows.

    Words have no bits left to step down by here, so every two rows meet by their block numbers, pair_low and pair_high. Equal
    words lie together in every trie, of which the first is enough.
    """
    blocks = F.ceil(F.col("n") / max(1, leaf // 2)).cast("long")
    its = rows.filter((F.col("low") != F.col("high")) | (F.col("trie") == 0)).withColumn("own", F.pmod(F.xxhash64("node"), blocks))
    met = its.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return met.withColumn("pair_low", F.least("own", "other")).withColumn("pair_high", F.greatest("own", "other"))


def trie_links(prints: DataFrame, max_bits: int = 3, leaf: int = LEAF, max_more: int = 0) -> DataFrame:
    """Links (u, v) whose components are those of all pairs within ``max_bits``.

    ``prints``: node (long, unique), word (fingerprint, long) and more (binary of the same length
    in all rows, a multiple of 8, or null): further bits, of which linked rows may differ in ``max_more`` at most.
    Within a leaf pair, a star around one member of each local component stands for all of its links.
    """
    if not 0 <= max_bits <= 12:
        raise ValueError("max_bits must be from 0 to 12")
    n = prints.count()
    first = min(16, max(1, math.ceil(math.log2(max(2, 2 * n / leaf)))))
    zero = F.lit(0).cast("long")
    turned = [
        F.struct(
            F.lit(t).alias("trie"),
            (F.shiftleft("word", 16 * t).bitwiseOR(F.shiftrightunsigned("word", 64 - 16 * t)) if t else F.col("word")).alias("word"),
        )
        for t in range(4)
    ]
    rows = prints.select("node", "more", F.explode(F.array(*turned)).alias("r")).select(
        "node", "more", "r.*", zero.alias("low"), zero.alias("high"), F.lit(0).alias("side"), F.lit(0).alias("err")
    )
    keys = ["trie", "low", "high"]
    links = []
    depth, width = 0, first
    while True:
        rows = _step_down(rows, depth, width, max_bits)
        depth += width
        sizes = rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.sum((F.col("side") == 1).cast("long")).alias("n1")
        )
        met = F.when(F.col("low") == F.col("high"), F.col("n") > 1).otherwise(
            (F.col("n1") > 0) & (F.col("n1") < F.col("n"))
        )
        sizes = sizes.filter(met).select(*keys, "n")
        rows = stored(rows.join(sizes, keys), "trie")
        links.append(
            rows.filter(F.col("n") <= leaf)
            .select(*keys, "side", "word", "node", "more")
            .groupBy(*keys)
            .applyInArrow(_leaf_links(depth, max_bits, max_more), "u long, v long")
        )
        rows = rows.filter(F.col("n") > leaf)
        if rows.isEmpty():
            break
        if depth >= 64:
            links.append(
                _blocks_met(rows, min(leaf, LEAF))
                .select(*keys, "pair_low", "pair_high", "side", "word", "node", "more")
                .groupBy(*keys, "pair_low", "pair_high")
                .applyInArrow(_leaf_links(depth, max_bits, max_more), "u long, v long")
            )
            break
        rows = rows.drop("n")
        width = min(STEP, 64 - depth)
    out = links[0]
    for further in links[1:]:
        out = out.unionByName(further)
    return out


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def merge_stars(links: DataFrame) -> DataFrame:
    """Connected components of links (u, v): node and its smallest reachable node (root).

    Nodes that are their own root are not listed. Alternating large-star and small-star rounds
    need about log2 of the longest chain; minima per node are combined before their shuffle.
    """
    edges = stored(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.*")
        edges = stored(small.filter("u <> v").distinct(), "stars")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(
    docs: DataFrame, id_col: str, text_col: str, shingle: int = 3, max_bits: int = 3, leaf: int = LEAF
) -> DataFrame:
    """``id_col``, fingerprint (16 hex digits) and component_id of each row.

    Texts are lower-cased in A-Z and cut into words at ASCII white space. component_id is the
    smallest ``id_col`` among the rows whose fingerprints are reachable over links of at most
    ``max_bits`` differing bits, the row itself included.

    Defined cases: a null or blank text has fingerprint zero, linked like any other; fewer words
    than ``shingle`` are hashed as one sequence; repeated rows stay; a null id never is a
    component's id unless all are null; an empty table gives no rows; other columns are not read.
    """
    marked = stored(fingerprints(docs, id_col, text_col, shingle), "prints")
    classes = stored(marked.groupBy("fingerprint").agg(F.min(id_col).alias("least")), "classes")
    prints = classes.select(F.col("fingerprint").alias("node"), F.col("fingerprint").alias("word"), F.lit(None).cast("binary").alias("more"))
    roots = merge_stars(trie_links(prints, max_bits, leaf))
    grouped = classes.join(roots, classes["fingerprint"] == roots["node"], "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root"), "least"
    )
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    classed = grouped.join(smallest, "root").select("fingerprint", "component_id")
    return marked.join(classed, "fingerprint").select(
        id_col, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def majority(hashes: np.ndarray) -> int:
    """Unsigned 64-bit SimHash of 64-bit hashes; 0 without any."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        counts += np.unpackbits(np.ascontiguousarray(hashes[at : at + CHUNK]).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")
