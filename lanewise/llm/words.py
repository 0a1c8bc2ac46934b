"""Words of Arrow text columns, encoded as codes into a dictionary of distinct words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 8 << 20


def slices(batches, column: int, most: int = SLICE_BYTES, rows: int = 1 << 30):
    """Cut record batches where the bytes of a text column reach ``most`` or the rows ``rows``; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
        for lo, hi in zip(*_runs(part)):
            for at in range(lo, hi, rows):
                yield batch.slice(at, min(rows, hi - at))


def _runs(values: np.ndarray):
    """Starts and ends of runs of equal values."""
    starts = np.flatnonzero(np.diff(values, prepend=values[0] - 1))
    return starts.tolist(), [*starts[1:].tolist(), len(values)]


def words_of(text: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the code of each word of all texts in turn, and the words per text.

    Words lie between ASCII white space; nulls count as empty; ``lower`` lower-cases A-Z.
    """
    text = pc.fill_null(text, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    blank = pc.equal(flat, "").to_numpy(zero_copy_only=False)
    if blank.any():
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[~blank], minlength=len(counts))
        flat = flat.filter(pa.array(~blank))
    encoded = flat.dictionary_encode()
    return encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts


def with_ends(codes: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """``codes`` with ``end`` after each text, and the counts with it."""
    return np.insert(codes, np.cumsum(counts), end), counts + 1


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of the stretches that start and size give, in turn."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)
