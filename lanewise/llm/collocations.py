"""Collocations: frequent phrases of a few words, counted by double-array tries level by level.

Words of at least ``least`` occurrences get an id per (group, word), and the texts are written once as runs of ids; a piece's end or a rarer
word ends a run, so no frequent phrase is lost. Level ``k`` of the trie takes the state of a phrase of ``k - 1`` words and the id of
the next word to the state of the longer phrase: ``check[base[row] + id] == row``. A state's children are dealt by id to rows of about
``ROW``, for many children lie far apart, and such rows fit between each other only in arrays far larger than the trie. Workers start at
all positions of a run at once, and one array step per level takes every position to its phrase of two, three, .. words. Accepting states
are counted per stretch of a text and summed.

Only candidates enter a level, and they are safe: a phrase is as rare as its rarest part, so a position can begin
one of ``k + 1`` words only if the tries accept the ``k`` words there and the ``k`` words at the next position. Such
positions are proposed as (state, next word), and what is proposed ``least`` times at least becomes the next level.

A level is cut into shards of at most about ``SHARD`` states by the state it starts from. One task builds a shard, and its arrays lie in the
shared folder, where the workers map them: their size does not bear on a worker's memory. The driver
holds one row per shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.operators.skew import salted_join, top_per_group

from .shared import hand_back, mapped, put, scratch, stored, trimmed
from .words import slices, spread

WORDS, LEAST = 5, 100
TOP = 2000
#: Percent of a phrase's occurrences in a longer phrase that make it a mere part of that.
SHARE = 100
SHARD = 1 << 20
#: Children of a state per row of the double array.
ROW = 8
#: Places tried at a time for a row, and how often, before those passed over are left to rows of one child.
TRIES, ROUNDS = 128, 8
#: Ids taken at a time, ids per row of the encoded texts, and sums held by a task before they are given out. Rows are short, for
#: Spark hands over 10,000 at once, and its buffers for them lie outside of the heap.
STRETCH, ROW_IDS, HOLD = 1 << 17, 1 << 7, 1 << 20
#: Bytes of text taken at a time.
SLICE_BYTES = 2 << 20

#: What ends a piece, as a class of a regular expression.
PIECE_END = r"[.,;:!?\n-\r]"
_BREAK = "."


# --- words --------------------------------------------------------------------------------------


def _words(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, and the code of every word of all texts in turn, -1 between pieces; then the codes per text."""
    text = pc.ascii_lower(pc.fill_null(text, ""))
    marked = pc.replace_substring_regex(text, "(?:" + PIECE_END + ")+", " . ")
    lists = pc.split_pattern(pc.replace_substring(marked, "\t", " "), " ")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # the piece's end is a word by itself, for a full stop is in no word
    ends = pc.index(coded.dictionary, _BREAK).as_py()
    blank = pc.index(coded.dictionary, "").as_py()
    codes[codes == ends] = -1
    if blank >= 0:
        use = codes != blank
        counts = np.diff(np.concatenate([[0], np.cumsum(use)])[np.concatenate([[0], np.cumsum(counts)])])
        codes = codes[use]
    return coded.dictionary, codes, counts


def _groups(column: pa.Array) -> tuple[list, np.ndarray]:
    coded = column.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word, n of all words of ``texts`` (lang, text)."""

    def run(batches):
        for batch in slices(batches, 1, SLICE_BYTES):
            words, codes, counts = _words(batch[1])
            langs, lang = _groups(batch[0])
            key = np.repeat(lang, counts) * len(words) + codes
            keys, n = np.unique(key[codes >= 0], return_counts=True)
            found = words.take(pa.array(keys % max(1, len(words))))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(pa.array(keys // max(1, len(words)))), found, pa.array(n, pa.int64())], names=["lang", "word", "n"])

    return texts.mapInArrow(trimmed(run), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _digest(lang: str, word: str) -> int:
    return xxhash.xxh64_intdigest(f"{lang}\n{word}")


class Vocabulary:
    """Ids of frequent words in files of sorted hashes; every hit is compared with the word itself."""

    def __init__(self, folder: str, starts: list[int]):
        self.folder, self.starts = folder, np.array([*starts, 0], np.int64)
        self.open: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    def _file(self, kind: str, shard: int, dtype) -> np.ndarray:
        if (kind, shard) not in self.open:
            self.open[kind, shard] = mapped(f"{self.folder}/{shard}.{kind}", dtype)
        return self.open[kind, shard]

    def ids(self, langs: list[str], words: list[str]) -> np.ndarray:
        """Ids from 1 on; 0 for words that are not frequent."""
        out = np.zeros(len(words), np.int64)
        hashes = np.fromiter(map(_digest, langs, words), np.uint64, len(words))
        shards = (hashes % np.uint64(len(self.starts) - 1)).astype(np.int64) if len(self.starts) > 1 else np.zeros(0, np.int64)
        for shard in np.unique(shards).tolist():
            rows = np.flatnonzero(shards == shard)
            keys, ends, data = (self._file(k, shard, t) for k, t in (("keys", np.uint64), ("ends", np.int64), ("text", np.uint8)))
            at = np.searchsorted(keys, hashes[rows])
            while len(rows):
                same = at < len(keys)
                same[same] = keys[at[same]] == hashes[rows[same]]
                rows, at = rows[same], at[same]
                held = spread_bytes(data, ends, at)
                equal = np.array([f"{langs[r]}\n{words[r]}".encode() == h for r, h in zip(rows.tolist(), held)], bool)
                out[rows[equal]] = self.starts[shard] + at[equal] + 1
                rows, at = rows[~equal], at[~equal] + 1
        return out


def spread_bytes(data: np.ndarray, ends: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The byte strings of the given places of an array file."""
    starts = np.where(at > 0, ends[np.maximum(at, 1) - 1], 0) if len(at) else at
    sizes = ends[at] - starts
    cut = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    flat = data[spread(starts, sizes)].tobytes()
    return [flat[a:b] for a, b in zip(cut, cut[1:])]


def _vocabulary(frequent: DataFrame, shard: int) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary's files, and ``frequent`` (lang, word, n) with the ids."""
    spark = frequent.sparkSession
    folder = scratch(spark, "words")
    shards = -(-frequent.count() // shard)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        at = key[0].as_py()
        names = [f"{a}\n{b}".encode() for a, b in zip(table["lang"].to_pylist(), table["word"].to_pylist())]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
        order = np.argsort(hashes, kind="stable")
        put(f"{folder}/{at}.keys", [hashes[order].tobytes()])
        put(f"{folder}/{at}.ends", [np.cumsum([len(names[i]) for i in order.tolist()], dtype=np.int64).tobytes()])
        put(f"{folder}/{at}.text", [names[i] for i in order.tolist()])
        place = pa.array(np.arange(1, len(order) + 1))
        return table.take(pa.array(order)).append_column("place", place).append_column("shard", pa.array(np.full(len(order), at)))

    # the hash is not Spark's, so that workers find the shard of a word by themselves
    def shard_of(batches):
        for batch in batches:
            digests = np.fromiter(map(_digest, batch["lang"].to_pylist(), batch["word"].to_pylist()), np.uint64, batch.num_rows)
            yield batch.append_column("at", pa.array((digests % np.uint64(shards)).astype(np.int64)))

    dealt = frequent.select("lang", "word", "n").mapInArrow(shard_of, "lang string, word string, n long, at long")
    written = dealt.groupBy("at").applyInArrow(run, "lang string, word string, n long, at long, place long, shard long")
    placed = stored(written, "words")
    sizes = {r.shard: r.n for r in placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts = np.concatenate([[0], np.cumsum([sizes.get(s, 0) for s in range(shards)])]).tolist()
    start = F.array(*[F.lit(s) for s in starts]) if starts else F.array(F.lit(0))
    ids = placed.select("lang", "word", "n", (F.col("place") + F.get(start, F.col("shard").cast("int"))).cast("long").alias("id"))
    return Vocabulary(folder, starts[:-1]), ids


def encoded(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``ids``: the texts as little-endian 32-bit word ids, 0 between runs; words without a frequent neighbour are left out."""

    def run(batches):
        for batch in slices(batches, 1, SLICE_BYTES):
            words, codes, counts = _words(batch[1])
            langs, lang = _groups(batch[0])
            lang = np.repeat(lang, counts)
            keys, back = np.unique(np.where(codes < 0, -1, lang * len(words) + codes), return_inverse=True)
            known = keys >= 0
            ids = np.zeros(len(keys), np.int64)
            names = words.take(pa.array(keys[known] % max(1, len(words)))).to_pylist()
            ids[known] = vocabulary.ids([langs[i] for i in (keys[known] // max(1, len(words))).tolist()], names)
            # a text's end is a break, too
            flat = np.insert(ids[back], np.cumsum(counts), 0)
            for part in _compact(flat):
                offsets = 4 * np.concatenate([[0], _ends(part, ROW_IDS)])
                rows = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(part.astype("<i4"))]
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(offsets) - 1, rows)], names=["ids"])

    return texts.mapInArrow(trimmed(run), "ids binary")


def _compact(ids: np.ndarray):
    """Runs of two ids at least with one zero after each, in stretches of about ``STRETCH``."""
    beside = np.concatenate([[0], ids, [0]])
    use = (ids > 0) & ((beside[:-2] > 0) | (beside[2:] > 0))
    # one zero stays after each run that stays
    use |= np.concatenate([[False], use[:-1]]) & (ids == 0)
    return _stretches(ids[use])


def _ends(ids: np.ndarray, most: int) -> np.ndarray:
    """Ends of stretches of about ``most`` ids, each after a zero; a longer run stands alone. The last id is a zero."""
    ends = np.flatnonzero(ids == 0) + 1
    return np.unique(ends[np.searchsorted(ends, np.minimum(np.arange(most, len(ids) + most, most), len(ids)))])


def _stretches(ids: np.ndarray):
    at = 0
    for end in _ends(ids, STRETCH).tolist():
        yield ids[at:end]
        at = end


# --- double arrays ------------------------------------------------------------------------------


def dealt(parents: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row of each edge, and the first row of every parent, with the number of rows at the end: ``label % rows`` deals a parent's edges."""
    firsts = np.concatenate([[0], np.cumsum(-(-np.bincount(parents) // ROW))])
    return firsts[parents] + labels % (firsts[parents + 1] - firsts[parents]), firsts


def double_array(parents: np.ndarray, labels: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``base`` of ``width`` states and ``check``, such that ``check[base[p] + label] == p`` for the given edges alone.

    States with several children take the first free place that holds them all, tried from the widest to the smallest; states with one
    child fill the places left over. The arrays stay about as large as the edges if no state has many children (see ``dealt``).
    """
    order = np.lexsort((labels, parents))
    parents, labels = parents[order], labels[order]
    first = np.flatnonzero(np.diff(parents, prepend=-1))
    sizes = np.diff(np.append(first, len(parents)))
    base = np.zeros(width, np.int64)
    check = np.full(int(len(parents) * 1.1) + 64, -1, np.int64)
    low = 0
    for i in np.argsort(-sizes, kind="stable")[: int((sizes > 1).sum())].tolist():
        mine = labels[first[i] : first[i] + sizes[i]]
        shape = mine - mine[0]
        while low < len(check) and check[low] >= 0:
            low += 1
        at, place = low, -1
        while place < 0:
            if at + TRIES + int(shape[-1]) > len(check):
                check = np.concatenate([check, np.full(max(len(check) // 2, TRIES + int(shape[-1])), -1, np.int64)])
            starts = at + np.flatnonzero(check[at : at + TRIES] < 0)
            fits = (check[starts[:, None] + shape] < 0).all(axis=1)
            if fits.any():
                place = int(starts[np.argmax(fits)])
            else:
                at += TRIES
        if at - low >= ROUNDS * TRIES:
            low = at
        check[place + shape] = parents[first[i]]
        base[parents[first[i]]] = place - int(mine[0])
    alone = first[sizes == 1]
    free = np.flatnonzero(check < 0)
    if len(free) < len(alone):
        more = np.arange(len(check), len(check) + len(alone) - len(free))
        check, free = np.concatenate([check, np.full(len(more), -1, np.int64)]), np.concatenate([free, more])
    check[free[: len(alone)]] = parents[alone]
    base[parents[alone]] = free[: len(alone)] - labels[alone]
    used = np.flatnonzero(check >= 0)
    return base, check[: int(used[-1]) + 1 if len(used) else 0]


class Level:
    """One level of the trie: shards of double arrays by ``state % shards``, their states numbered from ``starts`` on.

    ``rows``: states are dealt to rows (``dealt``), and the files have each one's first row; else a state is a row.
    """

    def __init__(self, folder: str, starts: list[int], rows: bool = False):
        self.folder, self.starts, self.rows, self.open = folder, starts, rows, {}

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    def _file(self, kind: str, shard: int) -> np.ndarray:
        if (kind, shard) not in self.open:
            self.open[kind, shard] = mapped(f"{self.folder}/{shard}.{kind}", np.int64)
        return self.open[kind, shard]

    def step(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """States after one more word each; -1 where there is none. Negative states and labels below 1 have none."""
        out = np.full(len(states), -1, np.int64)
        shards = len(self.starts) - 1
        for shard in range(shards):
            rows = np.flatnonzero((states >= 0) & (labels > 0) & (states % shards == shard))
            base, check = self._file("base", shard), self._file("check", shard)
            own = states[rows] // shards
            if self.rows:
                firsts = self._file("rows", shard)
                rows, own = rows[own < len(firsts) - 1], own[own < len(firsts) - 1]
                many = firsts[own + 1] - firsts[own]
                rows, own, many = rows[many > 0], own[many > 0], many[many > 0]
                own = firsts[own] + labels[rows] % many
            else:
                rows, own = rows[own < len(base)], own[own < len(base)]
            place = base[own] + labels[rows]
            inside = (place >= 0) & (place < len(check))
            rows, own, place = rows[inside], own[inside], place[inside]
            hit = check[place] == own
            out[rows[hit]] = self.starts[shard] + place[hit]
        return out


def _level(edges: DataFrame, shard: int, states: int = 0) -> tuple[Level, DataFrame]:
    """The level's files, and ``edges`` (state, word) with the state ``to`` that each leads to; ``states``: the last level's number of states."""
    folder = scratch(edges.sparkSession, "level")
    # a shard has a few numbers for each state, too
    shards = max(1, -(-edges.count() // shard), -(-states // (4 * shard)))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        at = key[0].as_py()
        parents, labels = table["state"].to_numpy() // shards, table["word"].to_numpy()
        rows, firsts = dealt(parents, labels)
        base, check = double_array(rows, labels, int(firsts[-1]))
        for kind, numbers in (("rows", firsts), ("base", base), ("check", check)):
            put(f"{folder}/{at}.{kind}", [memoryview(numbers)])
        to = pa.array(base[rows] + labels)
        del rows, firsts, base
        hand_back()
        return pa.table({"at": table["at"], "state": table["state"], "word": table["word"], "place": to, "states": pa.array(np.full(len(parents), len(check)))})

    sharded = edges.select(F.pmod("state", F.lit(shards)).alias("at"), "state", "word")
    built = stored(sharded.groupBy("at").applyInArrow(run, "at long, state long, word long, place long, states long"), "edges")
    sizes = {r.at: r.states for r in built.groupBy("at").agg(F.max("states").alias("states")).collect()}
    # a shard without edges has empty arrays
    for at in set(range(shards)) - sizes.keys():
        for kind in ("rows", "base", "check"):
            put(f"{folder}/{at}.{kind}", [])
    starts = np.concatenate([[0], np.cumsum([sizes.get(s, 0) for s in range(shards)])]).tolist()
    start = F.get(F.array(*[F.lit(s) for s in starts]), F.col("at").cast("int"))
    return Level(folder, starts, True), built.select("state", "word", (F.col("place") + start).cast("long").alias("to"))


# --- phrases ------------------------------------------------------------------------------------


class _Sums:
    """Counts of (state, word) pairs, summed and given out as rows whenever ``HOLD`` are held."""

    def __init__(self, width: int):
        self.width, self.keys, self.counts, self.held = width, [], [], 0

    def add(self, states: np.ndarray, words, counts: np.ndarray):
        self.keys.append(states * self.width + words)
        self.counts.append(counts)
        self.held += len(states)

    def batches(self, least: int):
        if not self.keys or self.held < least:
            return
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        self.keys, self.counts, self.held = [], [], 0
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        sums = np.add.reduceat(counts, first) if len(first) else counts
        keys = keys[first]
        for at in range(0, len(keys), HOLD // 8):
            part = slice(at, at + HOLD // 8)
            columns = [keys[part] // self.width, keys[part] % self.width, sums[part]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["state", "word", "m"])


def advanced(ids: np.ndarray, levels: list[Level]) -> list[np.ndarray]:
    """States of all positions after 1, 2, .. words: a word's state is its id."""
    states = [np.where(ids > 0, ids, -1)]
    for k, level in enumerate(levels, 1):
        nxt = np.zeros(len(ids), np.int64)
        nxt[:-k] = ids[k:]
        states.append(level.step(states[-1], nxt))
    return states


def pass_over(runs: DataFrame, levels: list[Level], width: int, least: int, propose: bool) -> DataFrame:
    """state, word, m: occurrences of the last level's states (word 0), and what is proposed ``least`` times for the level after it (word: the next one's id).

    Word ids lie below ``width``.
    """

    def run(batches):
        sums = _Sums(width)
        for batch in batches:
            ends = np.frombuffer(batch[0].buffers()[1], np.int32)[batch[0].offset : batch[0].offset + len(batch[0]) + 1] // 4
            # the rows lie one after the other, each with a zero at its end
            flat = np.frombuffer(batch[0].buffers()[2] or b"", "<i4")[ends[0] : ends[-1]] if len(batch[0]) else ends
            for part in _stretches(flat):
                ids = part.astype(np.int64)
                states = advanced(ids, levels)[-1]
                if levels:
                    # a stretch has few states beside all of a level, so its memory and time don't grow with the level
                    found, counts = np.unique(states[states >= 0], return_counts=True)
                    sums.add(found, 0, counts)
                if propose:
                    nxt = np.zeros(len(ids), np.int64)
                    nxt[: -len(levels) - 1] = ids[len(levels) + 1 :]
                    after = np.concatenate([states[1:], [-1]])
                    both = (states >= 0) & (after >= 0) & (nxt > 0)
                    keys, counts = np.unique(states[both] * width + nxt[both], return_counts=True)
                    sums.add(keys // width, keys % width, counts)
                yield from sums.batches(HOLD)
        yield from sums.batches(0)

    summed = runs.mapInArrow(trimmed(run), "state long, word long, m long").groupBy("state", "word").agg(F.sum("m").alias("m"))
    return summed.filter((F.col("word") == 0) | (F.col("m") >= least))


def phrases(texts: DataFrame, words: int = WORDS, least: int = LEAST, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases (lang, phrase: array of words, f) of 1 to ``words`` words, and n (lang, n), all words of each lang."""
    counts = stored(word_counts(texts), "counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    vocabulary, ids = _vocabulary(counts.filter(F.col("n") >= least), shard)
    level_words = stored(ids, "ids")
    found = level_words.select("lang", F.array("word").alias("phrase"), F.col("n").alias("f"))
    if words < 2:
        return found, totals
    runs = stored(encoded(texts, vocabulary), "runs")
    names = level_words.select(F.col("id").alias("word"), F.col("word").alias("name"))
    # phrases of the last level by state
    ends = level_words.select(F.col("id").alias("state"), "lang", F.array("word").alias("phrase"))
    levels: list[Level] = []
    width = (level_words.agg(F.max("id")).first()[0] or 0) + 1
    proposed = stored(pass_over(runs, levels, width, least, True), "pass")
    while True:
        edges = proposed.filter("word > 0").select("state", "word")
        if edges.isEmpty():
            return found, totals
        level, placed = _level(edges, shard, levels[-1].starts[-1] if levels else width)
        levels.append(level)
        ends = placed.join(ends, "state").join(names, "word").select(F.col("to").alias("state"), "lang", F.concat("phrase", F.array("name")).alias("phrase"))
        ends = stored(ends, "phrases")
        more = len(levels) + 1 < words
        proposed = stored(pass_over(runs, levels, width, least, more), "pass")
        accepted = proposed.filter("word = 0").join(ends, "state").select("lang", "phrase", F.col("m").alias("f"))
        found = found.unionByName(accepted)
        if not more:
            return found, totals


def collocations(
    docs: DataFrame, text_col: str, group_col: str, words: int = WORDS, least: int = LEAST, share: int = SHARE, top: int | None = TOP, shard: int = SHARD
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the phrases of each group (``group_col``, null: ``und``) that belong together most.

    Texts are lower-cased in A-Z, cut into pieces at ``[.,;:!?`` and line ends, and into words at blanks and tabs. a, l and r are the occurrences of a phrase and of
    the two parts of its weakest cut, n all words of the group, score ``floor(1000 * a * n / (l * r))``. Phrases of which
    ``share`` percent lie in one longer frequent phrase are dropped. The first ``top`` of each group (None: all) come by score, a and phrase.

    Defined cases: a null text is empty; repeated rows count again; an empty table has no phrases; other columns, whatever
    their names, are not read.
    """
    texts = docs.select(F.coalesce(F.col(group_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    found, totals = phrases(texts, words, least, shard)
    known = stored(found, "found")
    scored = _scored(known, totals)
    longer = known.filter(F.size("phrase") > 2).select(
        "lang", F.explode(F.array(F.slice("phrase", F.lit(1), F.size("phrase") - 1), F.slice("phrase", F.lit(2), F.size("phrase") - 1))).alias("phrase"),
        F.col("f").alias("of_longer"),
    )
    # a share in a longer phrase is no larger than the share in the phrase of one word more within that, so those suffice
    most = longer.groupBy("lang", "phrase").agg(F.max("of_longer").alias("of_longer"))
    kept = scored.join(most, ["lang", "phrase"], "left").filter(F.col("of_longer").isNull() | (100 * F.col("of_longer") < share * F.col("a")))
    rows = kept.select("lang", F.array_join("phrase", " ").alias("phrase"), "a", "l", "r", "n", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = top_per_group(rows, ["lang"], order, (1 << 31) - 1 if top is None else top, ["phrase"])
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(19,0)")


def _scored(known: DataFrame, totals: DataFrame) -> DataFrame:
    """Phrases of two words at least with a, l, r, n and the score of their weakest cut."""
    sizes = F.size("phrase")
    cuts = known.filter(sizes > 1).select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), sizes - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("phrase", F.lit(1), F.col("k"))).withColumn("right", F.slice("phrase", F.col("k") + 1, F.size("phrase") - F.col("k")))
    left = known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    rated = salted_join(cuts, left, ["lang", "left"], ["phrase"])
    rated = salted_join(rated, right, ["lang", "right"], ["phrase"])
    rated = salted_join(rated, totals, ["lang"], ["phrase"])
    rated = rated.withColumns({c: _exact(c) for c in ("a", "l", "r", "n")}).withColumn("score", F.expr("(1000 * (a * n)) div (l * r)"))
    weakest = rated.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut"))
    return weakest.select("lang", "phrase", *[F.col(f"cut.{c}").cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])
