"""Words of texts as byte ranges, piece by piece, and packed counts of hashed runs of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .suffixes import _ranges
from .words import BLOCK

#: Kinds of bytes: of a word, between words, between words that form no run.
WORD, BLANK, BREAK = 0, 1, 2


def lower_case() -> np.ndarray:
    """Each byte, A-Z in lower case."""
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 32
    return t


def word_pieces(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray, carry: int = 0, block: int = BLOCK) -> Iterator[tuple]:
    """(lower-cased bytes, starts, ends, text, stretch, carried) of the words of pieces of some ``block`` bytes.

    Words next to each other form runs where ``stretch`` is the same: no break and no end of a
    text is between them. A piece ends between words and begins with the ``carry`` last words of
    the one before, of which there are ``carried``. A piece with no more words than that grows.
    """
    s, carried, size, lower = 0, 0, block, lower_case()
    while s < len(data):
        e = s + size
        while e < len(data):  # on to the end of the word
            until = int(offsets[np.searchsorted(offsets, e)])
            gap = np.flatnonzero(kinds[data[e : min(until, e + 4096)]] != WORD)
            if len(gap) or until <= e + 4096:
                e = e + int(gap[0]) if len(gap) else until
                break
            e += 4096
        e = min(e, len(data))
        kind = kinds[data[s:e]]
        inside = kind == WORD
        edge = np.concatenate(([True], inside[1:] != inside[:-1], [True]))
        i, j = np.searchsorted(offsets, (s, e))
        edge[offsets[i:j] - s] = True
        at = np.flatnonzero(edge)
        word = inside[at[:-1]]
        starts, ends = at[:-1][word], at[1:][word]
        if e < len(data) and carry and len(starts) <= carry + carried:
            size *= 2
            continue
        text = np.searchsorted(offsets, starts + s, "right") - 1
        stretch = np.cumsum(kind == BREAK)[starts] + text
        yield lower[data[s:e]], starts, ends, text, stretch, carried
        if e == len(data):
            return
        carried, size = carry, block
        s = s + int(starts[-carry]) if carry else e


def joined(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with one space between them, and where each begins there."""
    size = ends - starts
    out, to = np.full(int(size.sum()) + len(size), 0x20, np.uint8), np.cumsum(size + 1) - size - 1
    if len(size):
        out[_ranges(to, size)] = low[_ranges(starts, size)]
    return out, to


def pack(part: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """A row of lists for each value of ``part``: columns part, c0, c1 and so on."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))[: len(part)])
    cuts = pa.array(np.append(at, len(part)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(cuts, pa.array(c[order])) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int64)), *lists], ["part", *(f"c{i}" for i in range(len(columns)))])


def unpack(table: pa.Table) -> list[np.ndarray]:
    """The lists of all rows, column by column."""
    return [table.column(c).combine_chunks().flatten().to_numpy() for c in table.column_names if c != "part"]
