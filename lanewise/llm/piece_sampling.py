"""Sampled segmentations into SentencePiece pieces: Gumbel top-k without replacement.

A text's lattice has every way to cut it into pieces of the vocabulary (bytes where a character
is none). A segmentation's probability is the product of its pieces' weights, made to sum to one by a
backward pass. Perturbing the log-probabilities of all segmentations by Gumbel noise and taking the ``k``
largest draws ``k`` distinct ones without replacement. The search is an A* from the top: a subtree of
the lattice's paths is bounded by the maximum of its perturbed leaves, which is a Gumbel variable
located at the subtree's exact log-mass. Walking down from a node, one child inherits the node's
maximum with its conditional probability, and its siblings' maxima are drawn truncated
below it, so the order in which leaves appear is the order of their perturbed values.

As no piece runs past the blanks before a word, lattices are built once per distinct word, and all words
of a batch are walked together in numpy. Random numbers are hashes of (row key, sample, word, step), so
results don't depend on batches or partitions.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import trimmed
from .words import slices

BLANK = "▁"
SAMPLES = 2
SHARPNESS = 1.0
EARLY = 512
SLICE = 1 << 20
SLICE_ROWS = 500
CACHE_UNITS = 100_000
BUILD_UNITS = 5_000
# -log of the smallest exponential variable that a 53-bit uniform number can give
REACH = 38.0
# shares down to this log keep all digits, and so do their sums
LEAST_LOG = -700.0

_UNIT = re.compile(" *[^ ]+| +$")


class Vocabulary:
    """Pieces and their log-weights.

    The model's scores are merge ranks, not probabilities, so a piece weighs 1 / (rank + 10), to the
    power of ``sharpness``; a byte ranks after all pieces.
    """

    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, int] = {}
        self.bytes = [b""] * len(model)
        self.byte_ids = [-1] * 256
        for i in range(len(model)):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.pieces[piece.replace(BLANK, " ")] = i
                self.bytes[i] = piece.replace(BLANK, " ").encode()
        order = sorted(self.pieces.values(), key=lambda i: (-model.get_score(i), i))
        self.weights = dict(zip(order, (-sharpness * math.log(r + 10) for r in range(len(order)))))
        self.byte_weight = -sharpness * math.log(len(order) + 10)
        # by length: sorted hashes of all beginnings of pieces, and the piece that each one is (or -1)
        known: list[dict[int, int]] = [{} for _ in range(max(map(len, self.pieces)) + 1)]
        for piece, number in self.pieces.items():
            h = 0
            for n, c in enumerate(piece, 1):
                h = _joined(h, ord(c))
                known[n][h] = number if n == len(piece) else known[n].get(h, -1)
        self.begins = []
        for k in known[1:]:
            keys = np.array(sorted(k), np.uint64)
            self.begins.append((keys, np.array([k[h] for h in keys.tolist()], np.int64)))
        self.weight_of = np.zeros(len(model))
        self.weight_of[list(self.weights)] = list(self.weights.values())


def _joined(h, c):
    """Hash of a string from that of the string without its last character."""
    if isinstance(h, int):
        return (h * 0x9E3779B97F4A7C15 + c + 1) % (1 << 64)
    with np.errstate(over="ignore"):
        return h * np.uint64(0x9E3779B97F4A7C15) + c + np.uint64(1)


@lru_cache(maxsize=2)
def vocabulary(path: str, sharpness: float) -> Vocabulary:
    return Vocabulary(path, sharpness)


class Lattices:
    """Lattices of the units met lately, as states with edges; each task has its own.

    A state is a place in a unit. Its edges have the log-probability of going that way given the state, the log-mass of
    the state's other edges, the next state (-1 at the unit's end) and the piece ids they emit. Units are held in two halves: once the
    newer one has ``CACHE_UNITS / 2`` units the older one goes, and units of the half that is older now move over when they are met again.
    """

    def __init__(self, path: str, sharpness: float):
        self.vocabulary = vocabulary(path, sharpness)
        self.room, self.spare = self._rooms(), None
        self.first: dict[str, int] = {}
        self.arrays = self._none(self.room)
        self.turn()

    @staticmethod
    def _rooms() -> list[np.ndarray]:
        """Room for edge bounds of the states; cumulative and log-probability, next state and emission bounds of edges; piece ids; log-mass beside edges."""
        kinds = (np.int64, np.float64, np.float64, np.int32, np.int32, np.int32, np.float64)
        half = CACHE_UNITS // 2
        room = [np.empty(n, t) for n, t in zip((12 * half, *(30 * half,) * 6), kinds)]  # pages count when they are first written
        room[0][0] = room[4][0] = 0
        return room

    @staticmethod
    def _none(room: list[np.ndarray]) -> tuple:
        return tuple(r[:n] for r, n in zip(room, (1, 0, 0, 0, 1, 0, 0)))

    def turn(self):
        """The newer half becomes the older one."""
        self.old_first, self.old_arrays = self.first, self.arrays
        self.room, self.spare = self.spare or self._rooms(), self.room
        self.first, self.arrays = {}, self._none(self.room)

    def starts(self, texts: list[str]) -> list[np.ndarray]:
        """First states of the units of each text: words with the blanks before them, and blanks at the end.

        Texts whose words stand between single blanks, the common case, are cut by Arrow.
        """
        if len(self.first) > CACHE_UNITS // 2:
            self.turn()
        rows = pa.array(texts, pa.string())
        odd = pc.or_(pc.match_substring(rows, "  "), pc.or_(pc.starts_with(rows, " "), pc.ends_with(rows, " ")))
        odd = pc.or_(odd, pc.equal(rows, "")).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(rows.filter(pa.array(~odd)), " ")
        coded = cut.flatten().dictionary_encode()
        known = [" " + w for w in coded.dictionary.to_pylist()]
        own = {int(i): _UNIT.findall(" " + texts[i]) if texts[i] else [] for i in np.flatnonzero(odd)}
        met = dict.fromkeys(chain(known, *own.values())) if own else known
        new = [u for u in met if u not in self.first]
        held = [u for u in new if u in self.old_first]
        if held:
            self._keep(held)
            new = [u for u in new if u not in self.old_first]
        for at in range(0, len(new), BUILD_UNITS):
            self._add(new[at : at + BUILD_UNITS])
        of = np.fromiter(map(self.first.__getitem__, known), np.int64, len(known))
        found = of[coded.indices.to_numpy(zero_copy_only=False)]
        ends = np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))
        plain = iter(np.split(found, ends[:-1]) if len(ends) else [])
        return [np.array([self.first[u] for u in own[i]], np.int64) if bad else next(plain) for i, bad in enumerate(odd.tolist())]

    def _keep(self, units: list[str]):
        """Move units over from the older half."""
        bounds, cum, logs, nexts, emitted, ids, beside = self.old_arrays
        at = np.fromiter(map(self.old_first.__getitem__, units), np.int64, len(units))
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        places = _stretches(at, sizes)
        degrees = bounds[places + 1] - bounds[places]
        edges = _stretches(bounds[places], degrees)
        count = (emitted[edges + 1] - emitted[edges]).astype(np.int64)
        base = len(self.arrays[0]) - 1
        own = base + np.cumsum(sizes) - sizes
        after = nexts[edges] + np.repeat(own - at, bounds[at + sizes] - bounds[at])
        kept = ids[_stretches(emitted[edges].astype(np.int64), count)]
        self._append(units, own, degrees, cum[edges], logs[edges], np.where(nexts[edges] < 0, -1, after), count, kept, beside[edges])

    def _add(self, units: list[str]):
        """Build the lattices of new units, all characters at a time."""
        voc = self.vocabulary
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        ends = np.cumsum(sizes)
        rest = np.repeat(ends, sizes) - np.arange(len(points))  # characters from each place to its unit's end
        froms, steps, pieces = [], [], []
        alive, h = np.arange(len(points)), np.zeros(len(points), np.uint64)
        for n, (keys, number) in enumerate(voc.begins, 1):
            use = rest[alive] >= n
            alive, h = alive[use], h[use]
            if not len(alive):
                break
            h = _joined(h, points[alive + n - 1])
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            use = keys[at] == h
            alive, h, at = alive[use], h[use], at[use]
            whole = number[at] >= 0
            froms.append(alive[whole])
            steps.append(np.full(int(whole.sum()), n))
            pieces.append(number[at[whole]])
        lone = np.ones(len(points), bool)
        if froms:
            lone[froms[0]] = False
        lone = np.flatnonzero(lone)  # characters that are no piece
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in points[lone].tolist()]
        froms.append(lone)
        steps.append(np.ones(len(lone), np.int64))
        pieces.append(-1 - np.arange(len(lone)))
        # edges by place, shorter ones first: every list holds a place once at most
        degrees = np.bincount(np.concatenate(froms), minlength=len(points))
        first = np.cumsum(degrees) - degrees
        free, start, step, piece = first.copy(), *(np.zeros(int(degrees.sum()), np.int64) for _ in range(3))
        for place, size, number in zip(froms, steps, pieces):
            at = free[place]
            free[place] += 1
            start[at], step[at], piece[at] = place, size, number
        is_byte = piece < 0
        count = np.ones(len(piece), np.int64)
        count[is_byte] = [len(raw[-1 - k]) for k in piece[is_byte].tolist()]
        weight = np.where(is_byte, voc.byte_weight * count, voc.weight_of[piece])
        ids = np.repeat(piece, count)
        ids[np.repeat(is_byte, count)] = [voc.byte_ids[b] for k in piece[is_byte].tolist() for b in raw[-1 - k]]
        after = np.where(step == rest[start], -1, start + step)

        # log-mass of all ways on from each place, by its distance to the end; the last slot is the end
        mass, logs = np.zeros(len(points) + 1), np.zeros(len(start))
        by_rest = np.argsort(rest.astype(np.uint16) if int(rest.max()) < 1 << 16 else rest, kind="stable")
        for places in np.split(by_rest, np.flatnonzero(np.diff(rest[by_rest])) + 1):
            d = degrees[places]
            edges = _stretches(first[places], d)
            cuts = np.cumsum(d) - d
            value = weight[edges] + mass[after[edges]]
            top = np.maximum.reduceat(value, cuts)
            mass[places] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, d)), cuts))
            logs[edges] = value - np.repeat(mass[places], d)
        bounds = np.cumsum(degrees)
        share = np.exp(logs)
        sums = np.cumsum(share)
        cum = sums - np.repeat(sums[first] - share[first], degrees)
        cum[bounds - 1] = 2.0  # the last edge takes what rounding leaves
        base = len(self.arrays[0]) - 1
        self._append(units, base + ends - sizes, degrees, cum, logs, np.where(after < 0, -1, base + after), count, ids, _beside(logs, first, degrees))

    def _append(self, units, own, degrees, cum, logs, after, count, ids, beside):
        old = self.arrays
        self.first.update(zip(units, own.tolist()))
        added = (old[0][-1] + np.cumsum(degrees), cum, logs, after, old[4][-1] + np.cumsum(count), ids, beside)
        self.arrays = tuple(self._appended(i, len(old[i]), new) for i, new in enumerate(added))

    def _appended(self, i: int, used: int, new: np.ndarray) -> np.ndarray:
        """Array ``i`` with ``new`` after its ``used`` values; its room grows by half at least."""
        need = used + len(new)
        if need > len(self.room[i]):
            grown = np.empty(max(need, used + (used >> 1)), self.room[i].dtype)
            grown[:used] = self.room[i][:used]
            self.room[i] = grown
        self.room[i][used:need] = new
        return self.room[i][:need]


def _beside(logs: np.ndarray, first: np.ndarray, degrees: np.ndarray) -> np.ndarray:
    """Log of the summed ``exp(logs)`` of the other edges of each edge's state: sums from both sides, nothing is subtracted.

    Shares are summed as they are, unless one is so small that it would lose digits.
    """
    if not len(logs):
        return np.zeros(0)
    plain = float(logs.min()) > LEAST_LOG
    value, none, add = (np.exp(logs), 0.0, np.add) if plain else (logs, -np.inf, np.logaddexp)
    out = np.full(len(logs), none)
    fewer = int(degrees.max()) - degrees
    order = np.argsort(fewer.astype(np.uint16) if int(degrees.max()) < 1 << 16 else fewer, kind="stable")  # states with more than n edges come first
    begin, end = first[order], (first + degrees - 1)[order]
    many = np.cumsum(np.bincount(degrees)[::-1])[::-1][1:].tolist()
    for edges_of in (lambda n, k: begin[:k] + n, lambda n, k: end[:k] - n):
        so_far = np.full(len(first), none)
        for n, k in enumerate(many):
            edges = edges_of(n, k)
            out[edges] = add(out[edges], so_far[:k])
            so_far[:k] = add(so_far[:k], value[edges])
    if not plain:
        return out
    with np.errstate(divide="ignore"):
        return np.log(out)


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def _stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of the stretches that start and size give, in turn."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _uniform(seed: np.ndarray, word: np.ndarray, step) -> np.ndarray:
    """Numbers in (0, 1) from hashes of their place."""
    with np.errstate(over="ignore"):
        x = seed + word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step) * np.uint64(0xD1B54A32D192ED03)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _walk(held: Lattices, state: np.ndarray, seed: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Walk every unit from its state to its end; edges in turn and the edges per unit."""
    bounds, cum, _, nexts, *_ = held.arrays
    owners, taken = [], []
    alive = np.arange(len(state))
    step = 0
    while len(alive):
        u = _uniform(seed[alive], word[alive], step)
        edge = bounds[state]
        late = np.flatnonzero(u >= cum[edge])
        while len(late):
            edge[late] += 1
            late = late[u[late] >= cum[edge[late]]]
        owners.append(alive)
        taken.append(edge)
        state = nexts[edge].astype(np.int64)
        going = state >= 0
        alive, state = alive[going], state[going]
        step += 1
    if not owners:
        return np.zeros(0, np.int64), np.zeros(len(seed), np.int64)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(taken)[order], np.bincount(owner, minlength=len(seed))


def _uniform_one(seed: int, step: int) -> float:
    """:func:`_uniform` of one place, word 0."""
    x = (seed + step * 0xD1B54A32D192ED03) % (1 << 64)
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % (1 << 64)
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % (1 << 64)
    x ^= x >> 31
    return ((x >> 11) + 0.5) * 2.0**-53


def _truncated(bound, location, u):
    """Gumbel variables at ``location``, given that they are below ``bound``."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return -np.logaddexp(-bound, np.log(-np.log(u)) - location)


@dataclass
class _Path:
    """A segmentation: its edges, the unit that each lies in, its log-probability and perturbed value."""

    edges: np.ndarray
    words: np.ndarray
    log_prob: float
    bound: float


@dataclass
class _Node:
    """The subtree to walk next: it leaves ``parent`` at its edge number ``place`` by another ``edge``."""

    bound: float
    parent: _Path | None = None
    place: int = -1
    edge: int = -1
    before: float = 0.0  # log-probability up to and with that edge


class _Search:
    """A* over one document's segmentations; :func:`sample_batch` walks the paths it asks for.

    The queue holds bounds of sibling subtrees: (-bound, path, edge number, log-probability before it, edges taken).
    """

    def __init__(self, held: Lattices, key: int, starts: np.ndarray):
        self.held, self.key, self.starts = held, key, starts
        self.queue: list = []
        self.paths: list[_Path] = []
        self.next: _Node | None = _Node(-math.log(-math.log(_uniform_one(key, 1 << 40))))

    def seed(self, what: int) -> int:
        return xxhash.xxh64_intdigest(what.to_bytes(8, "little"), self.key)

    def ask(self) -> tuple[int, int]:
        """Start of the next path to walk: state within a unit (or -1), first whole unit."""
        node = self.next
        if node.parent is None:
            return -1, 0
        return int(self.held.arrays[3][node.edge]), int(node.parent.words[node.place]) + 1

    def take(self, edges: np.ndarray, words: np.ndarray, log_sum: float):
        """Add the path of the walked edges after the node's own."""
        node = self.next
        if node.parent is not None:
            edges = np.concatenate([node.parent.edges[: node.place], [node.edge], edges])
            words = np.concatenate([node.parent.words[: node.place + 1], words])
        self.paths.append(_Path(edges, words, node.before + log_sum, node.bound))

    def push(self, value: float, place: int, before: float):
        """Queue the siblings of edge number ``place`` of the newest path."""
        number = len(self.paths) - 1
        heapq.heappush(self.queue, (-value, number, place, before, (int(self.paths[number].edges[place]),)))

    def push_rest(self, fixed: int, done: int, before: float, k: int, best: list[float]):
        """Queue what the early edges left open; see :func:`_push_early`."""
        path, log_probs, beside = self.paths[-1], self.held.arrays[2], self.held.arrays[6]
        seed = np.uint64(self.seed(len(self.paths)))
        at = fixed + done
        while at < len(path.edges) and not (len(best) > k and before + REACH < best[k]):
            edges = path.edges[at : at + 16 * EARLY]
            logs = log_probs[edges]
            prefix = before + np.cumsum(logs) - logs
            use = np.flatnonzero(beside[edges] > -np.inf)
            if len(use):
                u = _uniform(np.full(len(use), seed), (at + use).astype(np.uint64), 1 << 41)
                values = _truncated(path.bound, prefix[use] + beside[edges[use]], u)
                for i in np.argsort(-values)[: k + 1].tolist():
                    self.push(float(values[i]), at + int(use[i]), float(prefix[use[i]]))
                best = sorted([*best, *values.tolist()], reverse=True)[: k + 1]
            before += float(logs.sum())
            at += len(edges)

    def pop(self):
        """Choose the best subtree of siblings and the child that holds its maximum."""
        self.next = None
        if not self.queue:
            return
        value, number, place, before, used = heapq.heappop(self.queue)
        path = self.paths[number]
        bounds, _, log_probs, *_ = self.held.arrays
        state = int(np.searchsorted(bounds, path.edges[place], "right")) - 1
        rest = [e for e in range(int(bounds[state]), int(bounds[state + 1])) if e not in used]
        logs = [float(log_probs[e]) for e in rest]
        top = max(logs)
        weights = [math.exp(x - top) for x in logs]
        stamp = self.seed((number + 1 << 32) + (place << 8) + len(used) + (1 << 60))
        u, at = _uniform_one(stamp, 1) * sum(weights), 0
        while at < len(rest) - 1 and u >= weights[at]:
            u -= weights[at]
            at += 1
        if len(rest) > 1:
            left = _log_sum(logs[:at] + logs[at + 1 :])
            lower = float(_truncated(-value, before + left, _uniform_one(stamp, 2)))
            heapq.heappush(self.queue, (-lower, number, place, before, (*used, rest[at])))
        self.next = _Node(-value, path, place, rest[at], before + logs[at])


def _push_early(searches: list[_Search], fixed: list[int], edges: np.ndarray, starts: np.ndarray, sizes: np.ndarray, before: np.ndarray, k: int):
    """Queue the siblings of the first ``EARLY`` walked edges of the newest paths, all documents at a time.

    The best k + 1 of them are enough, as no more are ever taken. Prefixes only fall, and no bound exceeds its
    location by more than ``REACH``; so later edges matter only if they come within that of the last bound kept.
    """
    log_probs, beside = searches[0].held.arrays[2], searches[0].held.arrays[6]
    column = np.arange(min(EARLY, int(sizes.max())))
    inside = column < sizes[:, None]
    walked = edges[np.minimum(starts[:, None] + column, len(edges) - 1)]
    logs = np.where(inside, log_probs[walked], 0.0)
    ends = np.cumsum(logs, axis=1)
    prefix = before[:, None] + ends - logs
    place = np.array(fixed)[:, None] + column
    seeds = np.array([s.seed(len(s.paths)) for s in searches], np.uint64)[:, None]
    u = _uniform(np.broadcast_to(seeds, place.shape), place, 1 << 41)
    left = np.where(inside, beside[walked], -np.inf)
    values = _truncated(np.array([s.paths[-1].bound for s in searches])[:, None], prefix + left, u)
    values = np.where(left > -np.inf, values, -np.inf)
    order = np.argsort(-values, axis=1, kind="stable")[:, : k + 1]
    best = np.take_along_axis(values, order, axis=1)
    whole = before + ends[:, -1]
    for s, at, columns, found, n, after, row in zip(searches, fixed, order.tolist(), best.tolist(), sizes.tolist(), whole.tolist(), prefix):
        kept = [v for v in found if v > -math.inf]
        for c, v in zip(columns, kept):
            s.push(v, at + c, float(row[c]))
        if n > EARLY:
            s.push_rest(at, EARLY, after, k, kept)


def sample_batch(held: Lattices, keys: list[int], texts: list[str], k: int):
    """For each text its ``k`` (or all, if fewer) samples: (piece ids, log probability, perturbed, log inclusion).

    Samples come in the order of their perturbed log-probabilities. The inclusion score is the log of the probability
    that the segmentation's perturbed value exceeds the (k+1)-th largest one.
    """
    searches = [_Search(held, key, s) for key, s in zip(keys, held.starts(texts))]
    _, _, log_probs, _, emitted, ids, _ = held.arrays
    for number in range(k):
        open_ = [s for s in searches if s.next is not None]
        if not open_:
            break
        states, seeds, words, counts_of = [], [], [], []
        for s in open_:
            inside, unit = s.ask()
            own = np.concatenate([[inside], s.starts[unit:]]) if inside >= 0 else s.starts[unit:]
            first = unit - 1 if inside >= 0 else unit
            states.append(own)
            words.append(np.arange(first, first + len(own)))
            seeds.append(s.seed(number + (1 << 50)))
            counts_of.append(len(own))
        many = np.array(counts_of)
        word = np.concatenate(words)
        edges, counts = _walk(held, np.concatenate(states).astype(np.int64), np.repeat(np.array(seeds, np.uint64), many), word)
        unit = np.repeat(word, counts)
        sizes = np.add.reduceat(np.append(counts, 0), np.cumsum(many) - many) * (many > 0)
        ends = np.cumsum(sizes)
        logs = np.append(log_probs[edges], 0.0)
        sums = np.where(sizes > 0, np.add.reduceat(logs, ends - sizes), 0.0)
        before = np.array([s.next.before for s in open_])
        fixed = [s.next.place + 1 for s in open_]
        for s, lo, hi, total in zip(open_, (ends - sizes).tolist(), ends.tolist(), sums.tolist()):
            s.take(edges[lo:hi], unit[lo:hi], total)
        if len(edges):
            _push_early(open_, fixed, edges, ends - sizes, sizes, before, k)
        if number < k - 1:
            for s in open_:
                s.pop()
    out = []
    for s in searches:
        level = -s.queue[0][0] if s.queue else -math.inf
        rows = []
        for p in s.paths:
            size = (emitted[p.edges + 1] - emitted[p.edges]).astype(np.int64)
            rows.append((ids[_stretches(emitted[p.edges], size)], p.log_prob, p.bound, _log_inclusion(p.log_prob - level)))
        out.append(rows)
    return out


def _log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x)))."""
    if x > 3.5:
        return 0.0 if x > 6 else math.log1p(-math.exp(-math.exp(x)))
    rate = math.exp(x) if x > -700 else 0.0
    return x - rate / 2 if rate < 1e-8 else math.log(-math.expm1(-rate))


_OUT = "sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double, decoded_crc32 long"


def sample_pieces(
    docs: DataFrame, id_col: str, text_col: str, model_path: str, k: int = SAMPLES, sharpness: float = SHARPNESS, seed: int = 0
) -> DataFrame:
    """``k`` distinct segmentations of every whole text: ``id_col``, sample (from 1), ids, log_prob, perturbed, log_inclusion, decoded_crc32.

    Random numbers hang on ``id_col`` as text and ``seed``. Defined cases: a null or empty text
    has one segmentation, no pieces at all; a text with fewer than ``k`` segmentations gives all of
    them, with inclusion score 0 (probability one); rows that repeat an id and text repeat its samples; null ids
    share one key; an empty table gives no rows; other columns are not read; ``id_col`` must not be named like an output. ``decoded_crc32`` is taken of the
    UTF-8 bytes that the ids decode to.
    """
    rows = docs.select(F.col(id_col), F.col(text_col))
    kind = rows.schema[id_col].dataType
    if id_col in [c.split()[0] for c in _OUT.split(", ")]:
        raise ValueError(f"the id column must not be named {id_col}")

    def run(batches):
        held = Lattices(model_path, sharpness)
        for batch in slices(batches, 1, SLICE, SLICE_ROWS):
            given = batch[0].to_pylist()
            keys = [xxhash.xxh64_intdigest("" if g is None else str(g), seed) for g in given]
            found = sample_batch(held, keys, [t or "" for t in batch[1].to_pylist()], k)
            flat = [(i, n, *s) for i, rows_ in enumerate(found) for n, s in enumerate(rows_, 1)]
            ids = [f[2] for f in flat]
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            ends = np.concatenate([[0], np.cumsum(counts)])
            whole = np.concatenate([np.zeros(0, np.int32), *ids])
            sums = [zlib.crc32(t) for t in decode_flat(held.vocabulary, whole, counts)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(whole))
            yield pa.RecordBatch.from_arrays(
                [batch[0].take(pa.array([f[0] for f in flat], pa.int64())), pa.array([f[1] for f in flat], pa.int32()), lists,
                 *(pa.array([f[c] for f in flat], pa.float64()) for c in (3, 4, 5)), pa.array(sums, pa.int64())],
                names=[id_col, "sample", "ids", "log_prob", "perturbed", "log_inclusion", "decoded_crc32"],
            )

    return rows.mapInArrow(trimmed(run), f"`{id_col}` {kind.simpleString()}, {_OUT}")


def decode_flat(voc: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Bytes of texts from their piece ids in turn; the blank before the first word goes."""
    sizes = np.array([len(b) for b in voc.bytes], np.int64)
    starts = np.cumsum(sizes) - sizes
    store = np.frombuffer(b"".join(voc.bytes), np.uint8)
    size = sizes[ids]
    ends = np.cumsum(size)
    raw = store[_stretches(starts[ids], size)].tobytes()
    cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
    return [raw[a + 1 : b] if raw[a : a + 1] == b" " else raw[a:b] for a, b in zip(cuts, cuts[1:])]


def decode_pieces(rows: DataFrame, ids_col: str, model_path: str, out_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of their piece ids in ``out_col``; null ids give null, unknown bytes U+FFFD."""
    schema = rows.schema
    at = schema.names.index(ids_col)
    from pyspark.sql.types import StringType, StructField, StructType

    def run(batches):
        voc = vocabulary(model_path, SHARPNESS)
        for batch in batches:
            col = batch[at]
            counts = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = decode_flat(voc, col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
            decoded = [t.decode("utf-8", "replace") if ok else None for t, ok in zip(texts, col.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.string())], names=[*batch.schema.names, out_col])

    return rows.mapInArrow(trimmed(run), StructType([*schema.fields, StructField(out_col, StringType())]))
