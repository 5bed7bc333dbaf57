"""Words of UTF-8 texts as 64-bit hashes, found with whole-buffer numpy operations.

A word is a maximal run of the characters outside \\x00-\\x2F, \\x3A-\\x60 and \\x7B-\\x7F,
after A-Z are lower-cased: ASCII letters and digits, and everything beyond ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at a time; a longer text is a block of its own, hashed in pieces of so many bytes.
BLOCK = 1 << 19
#: Odd multiplier of the polynomial hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)


@cache
def _lower() -> np.ndarray:
    """Each byte's lower-case form, 0 where the byte separates words."""
    t = np.zeros(256, np.uint8)
    for b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
        t[b] = b
    for b in range(0x41, 0x5B):
        t[b] = b + 32
    return t


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of BASE and of its inverse."""
    out = np.full((2, n), np.array([[BASE], [UNBASE]], np.uint64))
    out[:, 0] = 1
    np.multiply.accumulate(out, axis=1, out=out)
    return out[0], out[1]


@cache
def _work(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Space that every piece is worked in, kept by the process: fresh pages would cost as much as the work. The second begins with 0."""
    return np.zeros(n, np.uint64), np.zeros(n + 1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes each, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _piece(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums, starts, ends) of the words of at most BLOCK bytes; a word does not go on over a break."""
    b = _lower()[data]
    inside = b != 0
    edge = np.empty(len(b) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    edge[breaks] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    is_word = inside[starts] if len(starts) else np.zeros(0, bool)
    starts, ends = starts[is_word], ends[is_word]
    (power, inverse), (part, sums) = _powers(BLOCK + 1), _work(BLOCK + 1)
    np.multiply(b, power[: len(b)], out=part[: len(b)])
    np.cumsum(part[: len(b)], out=sums[1 : len(b) + 1])
    return (sums[ends] - sums[starts]) * inverse[starts], starts, ends


def hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the index of its first word (and the end).

    Besides the result, memory is that of a piece of BLOCK bytes: a word that goes on in the
    next piece is put together from its parts.
    """
    hashes, first, n = [np.zeros(0, np.uint64)], np.zeros(len(offsets), np.int64), 0
    open_at, open_bytes = -1, 0  # where the last word would go on, and how much of it there is
    for s in range(0, len(data), BLOCK):
        part = data[s : s + BLOCK]
        i, j = np.searchsorted(offsets, (s, s + len(part)))
        h, starts, ends = _piece(part, offsets[i:j] - s)
        goes_on = bool(len(h)) and open_at == s and starts[0] == 0 and not (i < j and offsets[i] == s)
        if goes_on:
            last = hashes[-1]
            last[-1] = (int(last[-1]) + pow(BASE, open_bytes, 1 << 64) * int(h[0])) % (1 << 64)
        size = int(ends[-1] - starts[-1]) if len(h) else 0
        if len(h) and ends[-1] == len(part):
            open_at, open_bytes = s + len(part), size + (open_bytes if goes_on and len(h) == 1 else 0)
        first[i:j] = n + np.searchsorted(starts, offsets[i:j] - s) - goes_on
        if len(h) > goes_on:
            hashes.append(h[int(goes_on) :])
        n += len(h) - goes_on
    first[np.searchsorted(offsets, len(data)) :] = n
    return mix(np.concatenate(hashes)), first


def hash_string(words: list[str]) -> np.ndarray:
    """Hashes of single words, as ``hash_words`` gives them."""
    out = np.zeros(len(words), np.uint64)
    for i, w in enumerate(words):
        h = 0
        for k, b in enumerate(w.encode()):
            h += b * pow(BASE, k, 1 << 64)
        out[i] = h % (1 << 64)
    return mix(out)


def shingles(words: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words within a text, and where each text's begin.

    A text of fewer words, but not none, has one shingle of all of them.
    """
    count = np.diff(starts)
    if len(count) == 1 and len(words) >= n:  # nothing to sort out: no more memory than the result and one step
        run = words[: len(words) - n + 1] * np.uint64(0xD6E8FEB86659FD93)
        for k in range(1, n):
            run += words[k : len(words) - n + 1 + k]
            if k < n - 1:
                run *= np.uint64(0xD6E8FEB86659FD93)
        return mix(run), np.array([0, len(run)])
    many = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    begins = np.concatenate(([0], np.cumsum(many)))
    out = np.empty(int(begins[-1]), np.uint64)
    if len(words) >= n:
        run = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            run = run * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - n + 1 + k]
        run = mix(run)
        text = np.repeat(np.arange(len(count)), many)
        pos = np.arange(len(out)) - begins[text] + starts[text]
        long = count[text] >= n
        out[long] = run[pos[long]]
    for i in np.flatnonzero((count > 0) & (count < n)):
        h = np.uint64(int(count[i]))
        for w in words[starts[i] : starts[i + 1]]:
            h = np.uint64((int(h) * 0xD6E8FEB86659FD93 + int(w)) % (1 << 64))
        out[begins[i]] = mix(np.array([h], np.uint64))[0]
    return out, begins
