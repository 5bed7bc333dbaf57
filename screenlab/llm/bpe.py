"""BPE encoding and decoding with a pair occurrence index over each partition's words."""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import long_rows
from .words import blocks, text_buffer

#: The pattern that splits text before byte-level merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts within Latin-1 but for the white space on which the two libraries differ; twice as fast.
LETTERS, DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾"
LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^\s{LETTERS}{DIGITS}]+|\s+(?!\S)|\s+")
BEYOND = re.compile("[^\x00-\x1b\x20-\xff]")
#: Bytes of text taken at a time, and words and their characters remembered between blocks; characters of a long text split at a time.
BLOCK_BYTES, CACHE_WORDS, CACHE_CHARS, PIECE_CHARS = 4_000_000, 200_000, 8_000_000, 1_000_000
#: Bytes of words indexed at once, and tokens by which a stretch of a longer word reaches back into the one before.
MERGE_BYTES, OVERLAP = 1_000_000, 64
#: Where a text can be cut: a word ends wherever letters, numbers or signs end, but between an apostrophe and a letter.
SEAM = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=[^\s\p{L}\p{N}])(?=[\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=\p{L})")


class Vocabulary:
    """Byte-level BPE tables read from a tokenizer's JSON file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in printable)}
        raw = {c: b for b, c in shown.items()}
        vocab = spec["model"]["vocab"]
        self.byte_id = np.array([vocab[shown[b]] for b in range(256)], np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(raw[c] for c in t) if all(c in raw for c in t) else t.encode() for t, i in (vocab | self.special).items()}
        self.size = np.zeros(max(self.bytes_of) + 1, np.int32)  # bytes of each id
        self.size[list(self.bytes_of)] = [len(b) for b in self.bytes_of.values()]
        # Pairs as left id << 32 | right id, ascending, with the rank and the merged id of each.
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.ranks = np.argsort(keys)
        self.keys, self.merged = keys[self.ranks], np.array([vocab[a + b] for a, b in pairs], np.int64)[self.ranks]
        self.split = regex.compile(PATTERN)
        self.stop = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def words(self, text: str) -> list[str | int]:
        """Words of a text in order; an added token is its id."""
        if not self.stop or not self.stop.search(text):
            return (self.split if BEYOND.search(text) else LATIN).findall(text)
        out, at = [], 0
        for m in self.stop.finditer(text):
            out += self.split.findall(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self.split.findall(text[at:])


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs of ids as one number each."""
    return a.astype(np.int64) << 32 | b


def merge_words(v: Vocabulary, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after another, and how many each has.

    The index maps each pair to all its positions in the words of a block. Active ranks are
    taken in ascending order; a rank's pair is merged at every position still valid, from the
    left, and the lists of the neighbouring pairs get the new positions.
    """
    size = np.array([len(r) for r in raw], np.int64)
    sym = np.append(v.byte_id[np.frombuffer(b"".join(raw), np.uint8)], np.int32(-1))
    n, ends = len(sym) - 1, np.cumsum(size)
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    after[ends - 1] = n  # a slot of its own, where no symbol is
    before[ends - size] = -1
    index: dict[int, list[np.ndarray]] = {}
    active: list[tuple[int, int]] = []

    def file(keys: np.ndarray, pos: np.ndarray) -> None:
        at = np.minimum(np.searchsorted(v.keys, keys), len(v.keys) - 1)
        hit = v.keys[at] == keys
        at, pos = at[hit], pos[hit]
        order = np.argsort(at, kind="stable")
        at, pos = at[order], pos[order]
        cuts = np.flatnonzero(np.diff(at, prepend=-1))
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=False):
            k = int(at[i])
            if k in index:
                index[k].append(pos[i:j])
            else:
                index[k] = [pos[i:j]]
                heapq.heappush(active, (int(v.ranks[k]), k))

    pos = np.flatnonzero(after[:n] < n).astype(np.int32)
    file(paired(sym[pos], sym[pos + 1]), pos)
    while active:
        _, k = heapq.heappop(active)
        a, b, new = int(v.keys[k]) >> 32, int(v.keys[k]) & 0xFFFFFFFF, v.merged[k]
        found = index.pop(k)
        p = found[0] if len(found) == 1 and a != b else np.unique(np.concatenate(found))
        q = after[p]
        ok = (sym[p] == a) & (sym[q] == b)
        p, q = p[ok], q[ok]
        if a == b and len(p) > 1:  # of a run of equal symbols, every other pair
            chain = np.concatenate(([False], q[:-1] == p[1:]))
            i = np.arange(len(p))
            odd = (i - np.maximum.accumulate(np.where(chain, 0, i))) % 2
            p, q = p[odd == 0], q[odd == 0]
        if not len(p):
            continue
        r = after[q]
        sym[p], sym[q] = new, -1
        after[p], before[r] = r, p
        o = before[p]
        right, left = r < n, o >= 0
        file(np.concatenate((new << 32 | sym[r[right]], paired(sym[o[left]], new))), np.concatenate((p[right], o[left])))
    live = sym[:n] >= 0
    count = np.add.reduceat(live.astype(np.int64), ends - size) if len(size) else size
    return sym[:n][live], count


def merge_long(v: Vocabulary, raw: bytes, most: int = MERGE_BYTES, overlap: int = OVERLAP) -> np.ndarray:
    """Ids of one long word, indexed in stretches of about ``most`` bytes.

    A stretch begins at a token of the one before, ``overlap`` tokens before its end. At a token that
    both have at the same place the first is left and the second goes on. Tokens are side by side in a
    whole word just when each two neighbours stay apart as merged on their own, as a merge over a border
    would have to be the first over it in these two as well; and each two were neighbours in a stretch.
    Without such a token the stretch begins four times as many tokens before, at last with the word, so
    only a word that never settles takes more memory.
    """
    parts, begin, end = [], 0, min(most, len(raw))  # what is settled, and where the open ids begin and end
    ids = merge_words(v, [raw[:end]])[0]
    sizes = lambda x: v.size[x].astype(np.int64)
    while end < len(raw):
        back, goal = overlap, None
        while True:
            while back > len(ids) and parts:
                ids = np.concatenate((parts.pop(), ids))
                begin = end - int(sizes(ids).sum())
            tail = max(0, len(ids) - back)
            at = begin + int(sizes(ids[:tail]).sum())
            goal = goal or min(len(raw), at + most if at + most > end else end + most)
            further = merge_words(v, [raw[at:goal]])[0]
            if at == 0:
                ids = further
                break
            starts, heads = (at + np.cumsum(sizes(x)) - sizes(x) for x in (ids[tail:], further))
            _, i, j = np.intersect1d(starts, heads, assume_unique=True, return_indices=True)
            same = np.flatnonzero(ids[tail + i] == further[j])
            if len(same):
                i, j = tail + int(i[same[0]]), int(j[same[0]])
                if i:
                    parts.append(ids[:i])
                ids, begin = further[j:], int(heads[j])
                break
            back *= 4
        end = goal
    return np.concatenate([*parts, ids])


def merge_all(v: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after another, and how many each has; about MERGE_BYTES of them are indexed at once."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw], dtype=np.int64)))
    flat, count = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for i, j in blocks(offsets, MERGE_BYTES):
        if offsets[j] - offsets[i] > MERGE_BYTES:
            ids = merge_long(v, raw[i], MERGE_BYTES)
            n = np.array([len(ids)])
        else:
            ids, n = merge_words(v, raw[i:j])
        flat.append(ids)
        count.append(n)
    return np.concatenate(flat), np.concatenate(count)


class Words(dict):
    """Word -> number; a new word gets the next one. Ids of word i: flat[start[i] : start[i] + count[i]]."""

    def __init__(self, v: Vocabulary):
        self.v, self.fresh, self.chars = v, [], 0
        self.flat, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, word):
        self.fresh.append(word)
        self.chars += len(word) if type(word) is str else 1
        self[word] = n = len(self)
        return n

    def settle(self) -> None:
        """Ids of the words that are new since the last call."""
        texts = [w for w in self.fresh if type(w) is str]
        flat, count = merge_all(self.v, texts)
        if len(texts) < len(self.fresh):  # added tokens among them
            own, parts = iter(np.split(flat, np.cumsum(count)[:-1]) if texts else []), []
            for w in self.fresh:
                parts.append(next(own) if type(w) is str else np.array([w], np.int32))
            flat, count = np.concatenate(parts), np.array([len(x) for x in parts])
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(count) - count))
        self.flat, self.count = np.concatenate((self.flat, flat)), np.concatenate((self.count, count))
        self.fresh = []


#: Of the worker's process, by tokenizer file.
_words: dict[str, Words] = {}


def pieces(v: Vocabulary, text: str) -> Iterator[str]:
    """A text in parts whose words, one part after another, are the words of the whole; text without a seam is one word."""
    at = 0
    while len(text) - at > PIECE_CHARS:
        seams = (m.start() for m in SEAM.finditer(text, at + PIECE_CHARS))
        # An added token is not cut.
        end = next((e for e in seams if not any(text.find(t, max(at, e - len(t) + 1), e + len(t) - 1) >= 0 for t in v.special)), None)
        if end is None:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def encode_texts(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, one after another, and how many each has; besides these, memory holds the words of some pieces."""
    words = _words.get(path) or Words(vocabulary(path))
    count, done = np.zeros(len(texts), np.int64), [np.zeros(0, np.int32)]
    open_, of = [], []  # the words of pieces, and whose they are

    def settle() -> None:
        if words.fresh:
            words.settle()
        w = np.concatenate(open_)
        each = words.count[w]
        total = np.cumsum(each)
        at = np.arange(total[-1] if len(total) else 0) + np.repeat(words.start[w] - total + each, each)
        done.append(words.flat[at])
        bounds = np.concatenate(([0], total))[np.concatenate(([0], np.cumsum([len(x) for x in open_])))]
        np.add.at(count, of, np.diff(bounds))
        open_.clear()
        of.clear()

    for k, t in enumerate(texts):
        for part in pieces(words.v, t):
            found = words.v.words(part)
            open_.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
            of.append(k)
            if len(words) > CACHE_WORDS or words.chars > CACHE_CHARS:
                settle()
                words = Words(words.v)
    if open_:
        settle()
    _words[path] = words
    return np.concatenate(done), count


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", keep_text: bool = True) -> DataFrame:
    """``docs`` with a column ``ids`` array<int>: what the tokenizer at ``path`` encodes.

    Without ``keep_text`` the texts themselves do not travel back from the Python workers.

    Added tokens in a text become their ids; nothing is added, cut or padded. Null and empty
    texts have no ids. Any other columns stay, except one named ``ids``, which is replaced;
    repeated rows stay repeated. Memory holds a block of texts, a bounded cache of words and the
    index of a stretch. Texts of any length are encoded whole, also those without any blanks:
    a run of letters, of numbers or of signs is one word, and long words are merged in stretches.
    """
    base = long_rows(docs).drop(ids)
    keep = [c for c in base.columns if keep_text or c != text]
    schema = T.StructType([*(base.schema[c] for c in keep), T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            for i, j in blocks(text_buffer(batch.column(text))[1], BLOCK_BYTES):
                part = batch.slice(i, j - i)
                flat, count = encode_texts(path, [x or "" for x in part.column(text).to_pylist()])
                offsets = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[*keep, ids])

    return base.mapInArrow(run, schema)


def own_ids(ids: np.ndarray) -> list[int]:
    """The ids of a row without nulls."""
    return ids.tolist() if ids.dtype.kind in "iu" else [int(i) for i in ids if i is not None and i == i]


def bytes_for(v: Vocabulary, ids: list[int]) -> bytes:
    """The bytes of the ids; one that is not in the vocabulary stands for nothing, as in the library."""
    try:
        return b"".join(map(v.bytes_of.__getitem__, ids))
    except KeyError:
        return b"".join(v.bytes_of.get(i, b"") for i in ids)


def decode_ids(v: Vocabulary, ids: list[int]) -> str:
    """The text of the ids."""
    return bytes_for(v, ids).decode("utf-8", "replace")


def decoder(path: str):
    """A function of an ids column: the decoded text, added tokens included, broken UTF-8 as U+FFFD.

    Null ids and ids outside the vocabulary give nothing; a null row stays null.
    """

    def run(ids: pd.Series) -> pd.Series:
        v = vocabulary(path)
        return ids.map(lambda x: decode_ids(v, own_ids(x)), na_action="ignore")

    return F.pandas_udf(run, "string")


def digests(path: str):
    """A function of an ids column: struct of n_tokens, and SHA-256 of the ids joined by commas and of the decoded text.

    Null ids do not count; a null row is one without ids.
    """

    def run(ids: pd.Series) -> pd.DataFrame:
        v, out = vocabulary(path), []
        for x in ids:
            n, named, text = 0, hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace")
            decoded = hashlib.sha256()
            for s in range(0, len(x) if x is not None else 0, 100_000):
                own = own_ids(x[s : s + 100_000])
                named.update(("," * (n > 0 and bool(own)) + ",".join(map(str, own))).encode())
                decoded.update(text.decode(bytes_for(v, own)).encode())
                n += len(own)
            decoded.update(text.decode(b"", True).encode())
            out.append((n, named.hexdigest(), decoded.hexdigest()))
        return pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return F.pandas_udf(run, "n_tokens long, ids_sha256 string, decoded_sha256 string")
