"""Quality classifier: hashed word n-grams, follow-the-regularised-leader, sparse dot products.

Features of a text are its words and its pairs of neighbouring words. A word is a run of word characters or a
run of other visible characters, so marks that stick to words count by themselves; a word equal to the one
before it becomes the word "repeated". Each n-gram is hashed to one of ``2**bits`` weights and counts with
``scale / number of n-grams``, so a score does not depend on length.

Nothing but the text enters a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from evenkeel.llm.common import WordHashes, append_columns, mix64

WORD = re.compile(r"\w+|[^\w\s]+")
REPEATED = np.uint64(0x5851F42D4C957F2D)
ORDER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """``rows``: at most so many labelled rows are learned from (those with the smallest hash of the id)."""

    bits: int = 18
    rows: int = 12_000
    scale: float = 40.0
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.1


@dataclass(frozen=True)
class Model:
    weights: bytes
    bias: float
    settings: Settings

    def array(self) -> np.ndarray:
        return np.frombuffer(self.weights, np.float32)


class Features:
    """Text -> indices of its hashed n-grams, repeats included."""

    def __init__(self, bits: int):
        self.words, self.shift = WordHashes(), np.uint64(64 - bits)

    def __call__(self, text: str | None) -> np.ndarray:
        found = WORD.findall(text) if text else []
        h = self.words.array([w.encode("utf-8", "surrogatepass") for w in found])
        if len(h) > 1:
            again = np.flatnonzero(h[1:] == h[:-1]) + 1
            h[again] = REPEATED
            h = np.concatenate([h, mix64(h[:-1] * ORDER + h[1:])])
        return (mix64(h) >> self.shift).astype(np.int64)


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


class FollowTheLeader:
    """FTRL-proximal logistic regression, one row at a time; weight ``2**bits`` is the bias (not shrunk)."""

    def __init__(self, s: Settings):
        self.s, self.z, self.n = s, np.zeros((1 << s.bits) + 1), np.zeros((1 << s.bits) + 1)

    def weights(self, at) -> np.ndarray:
        s, z, n = self.s, self.z[at], self.n[at]
        free = np.sign(z) * np.maximum(np.abs(z) - s.l1, 0)
        return -free / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)

    def learn(self, idx: np.ndarray, label: float) -> None:
        at, counts = np.unique(idx, return_counts=True)
        x = np.append(counts * (self.s.scale / max(1, len(idx))), 1.0)
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = (_sigmoid(float(w @ x)) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.s.alpha * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from the documents that ``labels(id_col, label_col)`` marks 0 or 1.

    At most ``settings.rows`` labelled ids are used, picked by the hash of the id. An id that is labelled
    both ways counts as 0; rows without id, label or text are left out. The picked texts are read once, in hash
    order, by one task that holds one text at a time; without any row the model scores 0.5.
    """
    s = settings
    picked = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
              .groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("double").alias("_y"))
              .withColumn("_h", F.xxhash64("_id")).orderBy("_h", "_id").limit(s.rows))
    # at most s.rows rows of three numbers: small enough to send to every executor
    rows = (docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
            .join(F.broadcast(picked), "_id").repartition(1).sortWithinPartitions("_h", "_id", "_text"))

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, features = FollowTheLeader(s), Features(s.bits)
        for batch in batches:
            for text, y in zip(batch["_text"], batch["_y"], strict=True):
                model.learn(features(text), y)
        w = model.weights(slice(None))
        yield pd.DataFrame({"w": [w[:-1].astype(np.float32).tobytes()], "b": [float(w[-1])]})

    got = rows.select("_text", "_y").mapInPandas(train, "w binary, b double").collect()
    if not got:
        return Model(np.zeros(1 << s.bits, np.float32).tobytes(), 0.0, s)
    return Model(bytes(got[0]["w"]), got[0]["b"], s)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``, the chance (0 to 1) that the text has label 1; a null text scores like an empty one.

    Every column and row stays; a column already named ``out`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.settings))

    def make():
        raw, bias, s = shared.value
        w, features = np.frombuffer(raw, np.float32), Features(s.bits)

        def work(texts: list) -> list:
            out = []
            for text in texts:
                idx = features(text)
                out.append(_sigmoid(bias + s.scale * (float(w[idx].sum(dtype=np.float64)) / len(idx) if len(idx) else 0.0)))
            return [out]
        return work

    return append_columns(docs, [text_col], StructType([StructField(out, DoubleType())]), make)
