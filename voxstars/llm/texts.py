"""Whole columns of text as byte arrays: slices, tokens and token hashes without a loop over words."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
PRIME = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: ASCII letters and digits, and every byte of a character beyond ASCII.
LETTER = np.zeros(256, bool)
LETTER[48:58] = LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def text_bytes(column):
    """(bytes, offsets) of an Arrow column of strings or binaries; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(data, offsets, limit=SLICE):
    """(first row, bytes, offsets) of runs of rows of about ``limit`` bytes; a longer text is one run."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def runs(member, offsets):
    """Starts and ends of maximal runs of marked bytes within each text."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.r_[False, member[:-1]] & ~cut[:n]
    after = np.r_[member[1:], False] & ~cut[1:]
    return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1


def words(data, offsets):
    """Starts and ends of the words between white space."""
    return runs(~SPACE[data], offsets)


def pieces(data, offsets):
    """Starts and ends of runs of letters and of runs of other signs, in order of place."""
    letters, signs = runs(LETTER[data], offsets), runs(~(LETTER[data] | SPACE[data]), offsets)
    starts, ends = np.r_[letters[0], signs[0]], np.r_[letters[1], signs[1]]
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order]


def mixed(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = {}


def _power_tables(n):
    """Powers of the prime and of its inverse; tables beyond the usual size are not kept."""
    size = max(2 * SLICE + 1, n)
    if size > _powers.get("size", 0):
        up, down = np.full(size, PRIME), np.full(size, INVERSE)
        up[0] = down[0] = 1
        up, down = np.cumprod(up), np.cumprod(down)
        if size > 2 * SLICE + 1:
            return up, down
        _powers.update(size=size, up=up, down=down)
    return _powers["up"], _powers["down"]


def _hashes(data, starts, ends):
    up, down = _power_tables(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def token_hashes(data, starts, ends):
    """A 64-bit hash of each token's bytes: differences of one running polynomial, moved to power 0.

    Starts and ends ascend. Long texts are taken in parts, so memory follows the longest token only.
    """
    if len(data) <= 2 * SLICE:
        return _hashes(data, starts, ends)
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + SLICE, "right")))
        out[i:j] = _hashes(data[low : ends[j - 1]], starts[i:j] - low, ends[i:j] - low)
        i = j
    return out


def rows_of(offsets, starts):
    """The text that each token is in."""
    return np.searchsorted(offsets, starts, "right") - 1
