"""Quality classifier: Bradley-Terry scores from preference pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import long_rows
from .words import BLOCK, blocks, hash_words, text_buffer

#: Labelled rows fitted at most (those of the least hash), pairs drawn for each row of the rarer label.
SAMPLE_ROWS, PAIRS = 20_000, 20
#: The score at which a document is taken as good, in the contract's scale.
CUT = 0.3

CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".,;:?",
    "bang": b"!",
    "bar": b"|",
    "symbol": b"#$%&*@^~+=<>\\/_{}[]`",
    "quote": b"\"'()-",
    "space": b" \t\r",
    "line": b"\n",
}


def _classes() -> np.ndarray:
    t = np.full(256, len(CLASSES), np.uint8)
    for k, chars in enumerate(CLASSES.values()):
        t[np.frombuffer(chars, np.uint8)] = k
    return t


CLASS_OF = _classes()
N_FEATURES = 2 * (len(CLASSES) + 1) + 8


def described(n: np.ndarray, counts: np.ndarray, many: np.ndarray, distinct: np.ndarray, top: np.ndarray, alike: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """The features of texts from their bytes, bytes of each class, words, different words, the most frequent one, and repeats at distances 1 and 2."""
    share, words = counts / np.maximum(1, n)[:, None], np.maximum(1, many)
    extra = [np.log1p(n), np.log1p(many), distinct / words, distinct / np.sqrt(words), top / words, alike / words, twice / words, np.minimum(20, n / words)]
    return np.column_stack([share, np.sqrt(share), *extra])


def of_one(data: np.ndarray) -> np.ndarray:
    """Features of a single text, however long: besides its words' hashes, memory is that of a piece."""
    kinds = len(CLASSES) + 1
    counts = sum((np.bincount(CLASS_OF[data[s : s + BLOCK]], minlength=kinds) for s in range(0, len(data), BLOCK)), np.zeros(kinds, np.int64))
    h, _ = hash_words(data, np.array([0, len(data)]))
    alike, twice = np.count_nonzero(h[1:] == h[:-1]), np.count_nonzero(h[2:] == h[:-2])
    h.sort()
    begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    top = np.diff(np.append(begin, len(h))).max(initial=0)
    one = lambda x: np.array([x])
    return described(one(len(data)), counts[None, :], one(len(h)), one(len(begin)), one(top), one(alike), one(twice))


def of_many(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Features of the texts of a block."""
    n, rows, kinds = np.diff(at), len(at) - 1, len(CLASSES) + 1
    counts = np.bincount(np.repeat(np.arange(rows), n) * kinds + CLASS_OF[data], minlength=rows * kinds).reshape(rows, -1)
    h, first = hash_words(data, at)
    many = np.diff(first)
    own = np.repeat(np.arange(rows), many)
    order = np.lexsort((h, own))
    hs, ts = h[order], own[order]
    new = np.concatenate(([True], (hs[1:] != hs[:-1]) | (ts[1:] != ts[:-1]))) if len(hs) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    top = np.zeros(rows)
    np.maximum.at(top, ts[begin], np.diff(np.append(begin, len(hs))))
    repeats = [np.bincount(own[k:][(h[k:] == h[:-k]) & (own[k:] == own[:-k])], minlength=rows) for k in (1, 2)]
    return described(n, counts, many, np.bincount(ts[new], minlength=rows), top, *repeats)


def features(column: pa.Array) -> np.ndarray:
    """A row of numbers for each text: shares of character classes, and how words vary, repeat and spread."""
    data, offsets = text_buffer(column)
    out = np.zeros((len(offsets) - 1, N_FEATURES))
    for i, j in blocks(offsets):
        part = data[offsets[i] : offsets[j]]
        out[i:j] = of_one(part) if j - i == 1 else of_many(part, offsets[i : j + 1] - offsets[i])
    return out


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, steps: int = 30) -> dict:
    """Weights of the scores under which good documents win their pairs, and the cut.

    Bradley-Terry: the chance that document a is preferred to b is the logistic of the
    difference of their scores, so the weights come from the logistic loss on differences of
    features, by Newton steps. The cut is the quantile of the scores at the share of label 0,
    between the last rejected and the first kept score. With one label only, all weights are 0.
    """
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.clip((x - mean) / scale, -8, 8)
    w = np.zeros(x.shape[1])
    a, b = np.flatnonzero(good == 1), np.flatnonzero(good != 1)
    if not len(a) or not len(b):
        return {"mean": mean, "scale": scale, "w": w, "cut": -1.0 if len(a) or not len(b) else 1.0, "width": 1.0}
    rng, n = np.random.default_rng(7), pairs * min(len(a), len(b))
    # Every document is in some pair, the rarer ones in many.
    won = np.concatenate((a, rng.choice(a, n)))
    lost = np.concatenate((rng.choice(b, len(a)), np.tile(b, -(-n // len(b)))[:n]))
    d = z[won] - z[lost]
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # chance of the wrong order
        gradient = -(d * p[:, None]).mean(0) + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    low, high = np.quantile(s, len(b) / len(s), method="lower"), np.quantile(s, len(b) / len(s), method="higher")
    return {"mean": mean, "scale": scale, "w": w, "cut": float((low + high) / 2), "width": float(max(1e-6, np.std(s)))}


def score_of(model: dict, x: np.ndarray) -> np.ndarray:
    """0 to 1; CUT at the model's cut."""
    s = np.clip((x - model["mean"]) / model["scale"], -8, 8) @ model["w"]
    return 1 / (1 + np.exp(-np.clip(4 * (s - model["cut"]) / model["width"] + np.log(CUT / (1 - CUT)), -40, 40)))


def held_out(doc_id: Column) -> Column:
    """Rows kept from the fit: the CRC-32 of the id as text divides by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> dict:
    """A model from the labelled rows that are not held out, at most ``rows`` of them.

    ``docs``: doc_id, text; ``labels``: doc_id, quality. The rows are those of the least hash
    of their id, so the sample is bounded and repeatable; it alone reaches the driver, as features.
    Of a doc_id with several labels the highest counts; of one with several rows, that of the
    least text hash. Rows without text count as empty; null labels and ids are left out. With
    no labelled row every score is that of the cut. Other columns are ignored.
    """
    some = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    some = some.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = long_rows(docs).select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(F.broadcast(some), "doc_id")

    def run(batches):
        for batch in batches:
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "quality", "text_hash")), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "quality", "text_hash", "x"])

    got = texts.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality {labels.schema['quality'].dataType.simpleString()}, text_hash long, x array<double>")
    got = got.groupBy("doc_id", "quality").agg(F.min_by("x", "text_hash").alias("x")).toPandas()
    got = got.sort_values("doc_id", ignore_index=True)
    x = np.stack(got["x"].to_list()) if len(got) else np.zeros((0, N_FEATURES))
    return fit(x, got["quality"].to_numpy())


def scored(docs: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text in column ``out``; null and empty texts have one too.

    Other columns and repeated rows stay; a column named ``out`` is replaced. The model is a
    few hundred bytes, so scoring is one pass without a shuffle.
    """

    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(score_of(model, features(pa.array(texts, pa.string(), from_pandas=True))))

    return long_rows(docs).withColumn(out, F.pandas_udf(score, "double")(F.coalesce(text, F.lit(""))))
