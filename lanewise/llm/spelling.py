"""Spelling variants: words one inserted, deleted or replaced letter apart, by a bit-sliced position index.

The index of a block of words holds, for each (position, letter), the set of its words with that letter there, as a bitset. For
a query word the sets of words that match its first ``i`` letters without an error (``exact``), with one letter replaced,
with one letter more (shifted by one position) and with one letter less all move on together, letter by letter:
a few bitwise operations per letter for all words of the block.

Two words with one edit between them agree on all letters before and after it. With ``m`` letters in the shorter word they agree on the first
half or on the rest, so words meet in cells of (m, first letters, last letters) in which the edit lies in the gap between. A cell of
more than ``CELL`` words is cut again: its gap is halved, until the gap is one letter, whose cells the alphabet bounds. A
pair belongs to the first half's cell if the letters before the middle agree too, else to the other's (``bar`` is the place
up to which they must not agree), so each pair is found in one cell alone, and each word's near words can
be counted before the shuffle. Blocks take whole cells, told apart by one more bitset per cell.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .words import slices

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
MOD = 97
LENGTH, COUNT = 5, 3
CELL = 2048
#: Letters of all words of a block.
BLOCK = 1 << 15
#: Bitset words of all queries that move on together.
STEP = 1 << 18

_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")


def runs_of(text: str | None, doc_id, mod: int = MOD) -> list[bytes]:
    """Runs of letters of a text, lower-cased in A-Z; a run whose checksum with the document's id ``mod`` divides lacks one letter."""
    runs = _LETTERS.findall((text or "").encode().lower())
    start = zlib.crc32(("" if doc_id is None else str(doc_id)).encode() + b":")
    sums = np.fromiter(map(zlib.crc32, runs, repeat(start)), np.int64, len(runs))
    for i in np.flatnonzero(sums % mod == 0).tolist():
        run = runs[i].decode()
        at = int(sums[i]) % len(run)
        runs[i] = (run[:at] + run[at + 1 :]).encode()
    return runs


def vocabulary(docs: DataFrame, id_col: str, text_col: str, length: int = LENGTH, count: int = COUNT, mod: int = MOD) -> DataFrame:
    """word and n: distinct words of ``length`` code points at least that occur ``count`` times at least in all whole texts.

    Defined cases: null texts have no words; a null id is the empty text in checksums; repeated rows count again; an empty
    table has no words; other columns are not read.
    """

    def run(batches):
        for batch in slices(batches, 1):
            found: Counter[bytes] = Counter()
            for doc_id, text in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                found.update(runs_of(text, doc_id, mod))
            words = [w.decode() for w in found]
            long = [len(w) >= length for w in words]
            columns = [pa.array([w for w, x in zip(words, long) if x], pa.string()), pa.array([n for n, x in zip(found.values(), long) if x], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= count)


class PositionIndex:
    """Bitsets of words by (position, letter), by length and by cell. ``words``: code points, one row per word, zero-filled."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, cells: np.ndarray):
        self.words, self.sizes, self.cells = words, sizes, cells
        self.letters, self.codes = np.unique(words, return_inverse=True)
        self.codes = self.codes.reshape(words.shape)
        n, width = words.shape
        self.at = np.zeros((width, len(self.letters), -(-n // 64)), np.uint64)
        row = np.arange(n)
        bit = np.uint64(1) << (row % 64).astype(np.uint64)
        for p in range(width):
            np.bitwise_or.at(self.at[p], (self.codes[:, p], row // 64), bit)
        self.all = self._set(np.ones(n, bool))
        self.of_size = {int(s): self._set(sizes == s) for s in np.unique(sizes)}
        _, self.cell = np.unique(cells, return_inverse=True)
        self.of_cell = np.zeros((int(self.cell.max(initial=-1)) + 1, self.at.shape[2]), np.uint64)
        np.bitwise_or.at(self.of_cell, (self.cell, row // 64), bit)

    def _set(self, use: np.ndarray) -> np.ndarray:
        padded = np.zeros(-(-len(use) // 64) * 64, bool)
        padded[: len(use)] = use
        return np.packbits(padded, bitorder="little").view(np.uint64)

    def near(self, rows: np.ndarray, bars: np.ndarray, shorter: int) -> np.ndarray:
        """For queries ``rows`` of one length: bitsets of the words of their cells that are one edit away.

        ``shorter`` letters are in the shorter word of each pair; words that agree up to a query's bar are left out.
        """
        size = int(self.sizes[rows[0]])
        none = np.zeros_like(self.all)
        # sets after i letters of the query: no error; one replaced; one letter more in the word; one less
        exact = np.broadcast_to(self.all, (len(rows), len(none)))
        replaced = np.zeros(exact.shape, np.uint64)
        more, less = exact, replaced
        barred = np.zeros(exact.shape, np.uint64)
        for i in range(size):
            here = self.at[i][self.codes[rows, i]]
            after = self.at[i + 1][self.codes[rows, i]] if i + 1 < len(self.at) else none
            before = self.at[i - 1][self.codes[rows, i]] if i else none
            replaced = replaced & here | exact & ~here
            less = less & before | exact
            exact = exact & here
            more = more & after | exact
            at_bar = bars == i + 1
            barred[at_bar] = exact[at_bar]
        near = less & self.of_size.get(size - 1, none) if size > shorter else replaced & self.of_size[size] | more & self.of_size.get(size + 1, none)
        return near & self.of_cell[self.cell[rows]] & ~barred


def near_words(words: list[str], n: np.ndarray, cells: np.ndarray, bars: np.ndarray, shorter: int) -> list[tuple[str, int, int, str]]:
    """(word, near words, largest n among them, the smallest such word) of the words that have near words in their cells."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    points = np.array(words, f"<U{int(sizes.max())}").view(np.uint32).reshape(len(words), -1)
    index = PositionIndex(points, sizes, cells)
    # best first: a word's form is its near word of the least place
    best = np.array(sorted(range(len(words)), key=lambda i: (-int(n[i]), words[i])))
    place = np.zeros(len(words), np.int64)
    place[best] = np.arange(len(words))
    out = []
    for size in (shorter, shorter + 1):
        mine = np.flatnonzero(sizes == size)
        step = max(1, STEP // len(index.all))
        for rows in np.array_split(mine, -(-len(mine) // step)) if len(mine) else []:
            found = np.unpackbits(index.near(rows, bars[rows], shorter).view(np.uint8), axis=1, count=len(words), bitorder="little")
            many = found.sum(axis=1, dtype=np.int64)
            q, w = np.nonzero(found)
            form = np.full(len(rows), len(words), np.int64)
            np.minimum.at(form, q, place[w])
            for i in np.flatnonzero(many).tolist():
                top = int(best[form[i]])
                out.append((words[rows[i]], int(many[i]), int(n[top]), words[top]))
    return out


def _cell_key():
    first = F.substring(F.col("word"), F.lit(1), F.col("a"))
    last = F.when(F.col("b") > 0, F.substring(F.col("word"), F.length("word") - F.col("b") + 1, F.col("b"))).otherwise("")
    return F.concat_ws(" ", "m", "a", "b", "bar", first, last)


def _halved(cells: DataFrame) -> DataFrame:
    """Both halves of the cells (m, a, b, bar): letters fixed before and after, and the place up to which pairs must not agree."""
    half = F.floor((F.col("m") - F.col("a") - F.col("b")) / 2).cast("int")
    middle = F.col("a") + half
    former = F.struct(middle.alias("a"), F.col("b"), F.col("bar"))
    latter = F.struct(F.col("a"), (F.col("m") - middle).alias("b"), middle.alias("bar"))
    return cells.withColumn("part", F.explode(F.array(former, latter))).select("word", "n", "m", "part.a", "part.b", "part.bar")


def cells_of(words: DataFrame, cell: int = CELL) -> DataFrame:
    """Rows (word, n, m, bar, key) that put every pair of near words in one common cell exactly."""
    size = F.length("word")
    whole = words.withColumn("m", F.explode(F.array(size, size - 1))).filter("m > 0")
    zero = F.lit(0)
    open_ = _halved(whole.select("word", "n", "m", zero.alias("a"), zero.alias("b"), zero.alias("bar")))
    done = None
    while True:
        keyed = stored(open_.withColumn("key", _cell_key()), "cells")
        sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.first(F.col("m") - F.col("a") - F.col("b")).alias("gap")).filter("size > 1")
        rows = keyed.join(sizes, "key")
        hot = (F.col("size") > cell) & (F.col("gap") > 1)
        ready = rows.filter(~hot).select("word", "n", "m", "bar", "key")
        done = ready if done is None else done.unionByName(ready)
        large = rows.filter(hot).select("word", "n", "m", "a", "b", "bar")
        if large.isEmpty():
            return done
        open_ = _halved(large)


def forms(words: DataFrame, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """``words`` (distinct word, n) with n_near and the likeliest spelling: form and form_n.

    Words are near if they differ by exactly one inserted, deleted or replaced code point. The form is the near word of the largest n (on ties the
    smallest in code-point order) if that is at least twice the word's n.
    """
    rows = stored(cells_of(words.select("word", "n"), cell), "cells")
    letters = rows.groupBy("m").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * F.col("m") / block)).alias("blocks"))
    dealt = rows.join(letters, "m").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks").cast("long")))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = near_words(
            table["word"].to_pylist(), table["n"].to_numpy(), table["cell"].to_numpy(), table["bar"].to_numpy(), key[0].as_py()
        )
        kinds = [("word", pa.string()), ("n_near", pa.int64()), ("top_n", pa.int64()), ("top", pa.string())]
        return pa.table([pa.array(c, k) for c, (_, k) in zip(zip(*found) if found else [[]] * 4, kinds)], names=[k for k, _ in kinds])

    near = (
        dealt.select("m", "block", "word", "n", F.xxhash64("key").alias("cell"), "bar")
        .groupBy("m", "block")
        .applyInArrow(run, "word string, n_near long, top_n long, top string")
    )
    best = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("top_n")).alias("less"), "top")).alias("best"))
    joined = words.join(best, "word", "left")
    large = -F.col("best.less") >= 2 * F.col("n")
    return joined.select(
        *words.columns,
        F.when(large, F.col("best.top")).alias("form"),
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(large, -F.col("best.less")).alias("form_n"),
    )


def with_roots(formed: DataFrame) -> DataFrame:
    """``formed`` (word, form, ...) with root: the last word on the way from form to form. Every round doubles the steps taken.

    Forms must not run in circles; those of :func:`forms` double n at each step.
    """
    kept = stored(formed, "forms")
    # words without a form are their own root and need no row
    ahead = kept.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("to"))
    while True:
        ahead = stored(ahead, "ahead")
        further = ahead.select(F.col("word").alias("to"), F.col("to").alias("next"))
        moved = ahead.join(further, "to", "left")
        if moved.filter(F.col("next").isNotNull()).isEmpty():
            break
        ahead = moved.select("word", F.coalesce("next", "to").alias("to"))
    return kept.join(ahead, "word", "left").withColumn("root", F.coalesce("to", "word")).drop("to")


def variants(docs: DataFrame, id_col: str, text_col: str, length: int = LENGTH, count: int = COUNT, mod: int = MOD) -> DataFrame:
    """word, n, form, n_near, form_n and root of all words of the texts: see :func:`vocabulary`, :func:`forms` and :func:`with_roots`."""
    return with_roots(forms(stored(vocabulary(docs, id_col, text_col, length, count, mod), "vocabulary")))
