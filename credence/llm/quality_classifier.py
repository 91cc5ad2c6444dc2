"""Quality classifier: a factorisation machine.

A text becomes a sparse vector: its words hashed into a fixed number of slots, weighted by
the logarithm of their counts and scaled to unit length, and its structure (length, word
length, shares of signs, capitals, digits and repeats) and length metadata as one slot
per range. The model has a weight and a short vector for each slot; interactions of all
pairs of slots are scored in linear time, as half of the square of the sum less the sum of
the squares. It is fitted on a bounded sample of labelled rows; scoring is one narrow
pass over all documents with the model, of fixed size, sent along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import documents, utf8, word_hashes, word_spans

WORD_SLOTS = 1 << 16
#: Ranges of each structure statistic: a statistic in [0, 1) falls into one of these.
RANGES = 16
FACTORS = 8
#: Most labelled rows that the model is fitted on, those of the least hash of their id.
MAX_ROWS = 6000
EPOCHS = 12
STATISTICS = 10


def features(text: str | None, n_chars: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text. `n_chars`: its length as the table has it, if it does."""
    text = text or ""
    buf = utf8(text)
    starts, ends = word_spans(buf)
    n = len(starts)
    slots, counts = np.unique(word_hashes(buf, starts, ends) >> np.uint64(64 - 16), return_counts=True)
    values = 1 + np.log(counts)
    values /= max(np.linalg.norm(values), 1e-9)
    size = max(len(buf), 1)
    inside = np.zeros(len(buf) + 1, np.int64)
    signs = ((buf > 32) & (buf < 48)) | ((buf > 57) & (buf < 65)) | ((buf > 90) & (buf < 97)) | ((buf > 122) & (buf < 127))
    np.cumsum(signs, out=inside[1:])
    lines = text.split("\n")
    length = len(text) if n_chars is None else n_chars
    shares = [
        np.log1p(n) / 12, (len(buf) / max(n, 1)) / 16, 4 * inside[-1] / size,
        2 * ((buf > 64) & (buf < 91)).sum() / size, 4 * ((buf > 47) & (buf < 58)).sum() / size,
        len(slots) / max(n, 1), len(set(lines)) / len(lines), np.log1p(len(lines)) / 8,
        2 * (inside[ends] - inside[starts] > 1).sum() / max(n, 1), np.log1p(max(length, 0)) / 16,
    ]
    bins = np.clip((np.array(shares, np.float64) * RANGES).astype(np.int64), 0, RANGES - 1)
    own = WORD_SLOTS + np.arange(STATISTICS) * RANGES + bins
    return np.concatenate([slots.astype(np.int64), own]), np.concatenate([values, np.ones(STATISTICS)])


@dataclass
class FactorisationMachine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def margin(self, slots: np.ndarray, values: np.ndarray) -> float:
        x = self.factor[slots] * values[:, None]
        total = x.sum(axis=0)
        return float(self.bias + self.weight[slots] @ values + 0.5 * ((total * total).sum() - (x * x).sum()))

    def score(self, text: str | None, n_chars: int | None = None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(*features(text, n_chars)), -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, *, epochs: int = EPOCHS, batch: int = 32,
        rate: float = 0.1, decay: float = 1e-5, seed: int = 0) -> FactorisationMachine:
    """Logistic loss by AdaGrad over small batches."""
    rng = np.random.default_rng(seed)
    size = WORD_SLOTS + STATISTICS * RANGES
    weight, factor, bias = np.zeros(size), rng.normal(0, 0.02, (size, FACTORS)), 0.0
    g_weight, g_factor, g_bias = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6), 1e-6
    labels = np.asarray(labels, np.float64)
    for _ in range(epochs if len(rows) else 0):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            slots = np.concatenate([rows[i][0] for i in own])
            values = np.concatenate([rows[i][1] for i in own])
            sizes = np.array([len(rows[i][0]) for i in own])
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            which = np.repeat(np.arange(len(own)), sizes)
            x = factor[slots] * values[:, None]
            total = np.add.reduceat(x, first)
            margin = bias + np.add.reduceat(weight[slots] * values, first) + 0.5 * (
                (total * total).sum(axis=1) - np.add.reduceat((x * x).sum(axis=1), first))
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[own]) / len(own)
            touched, place = np.unique(slots, return_inverse=True)
            each = error[which] * values
            grad_w = np.bincount(place, each, len(touched)) + decay * weight[touched]
            grad_v = np.zeros((len(touched), FACTORS))
            np.add.at(grad_v, place, each[:, None] * (total[which] - x))
            grad_v += decay * factor[touched]
            g_weight[touched] += grad_w**2
            g_factor[touched] += grad_v**2
            weight[touched] -= rate * grad_w / np.sqrt(g_weight[touched])
            factor[touched] -= rate * 0.2 * grad_v / np.sqrt(g_factor[touched])
            g_bias += (grad_b := error.sum()) ** 2
            bias -= rate * grad_b / np.sqrt(g_bias)
    return FactorisationMachine(bias, weight.astype(np.float32), factor.astype(np.float32))


def held_out(id_col):
    """Rows that no model may learn from: crc32 of the id as text leaves 1 modulo 3."""
    return F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "utf-8")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          chars_col: str | None = "n_chars", max_rows: int = MAX_ROWS) -> FactorisationMachine:
    """Fit on up to max_rows labelled ids that are not held out. Null labels do not count; of
    several labels of one id the largest does, and of several texts that of the least hash."""
    chosen = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
              .groupBy(F.col(id_col).alias("key")).agg(F.max(label_col).alias("label"))
              .orderBy(F.xxhash64("key"), "key").limit(max_rows))
    chars = F.col(chars_col).cast("bigint") if chars_col else F.lit(None).cast("bigint")
    text = F.col(text_col).cast("string")
    # at most max_rows keys and labels: a bounded table to send along
    rows = (docs.select(F.col(id_col).alias("key"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), text.alias("text"), chars.alias("chars"))
            .join(F.broadcast(chosen), "key"))

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [features(t, None if pd.isna(c) else int(c)) for t, c in zip(batch["text"], batch["chars"])]
            yield pd.DataFrame({"key": batch["key"], "h": batch["h"], "label": batch["label"].to_numpy(), "slots": [s.astype(np.int32) for s, _ in own], "values": [v for _, v in own]})

    kind = rows.schema["key"].dataType.simpleString()
    own = F.struct("label", "slots", "values")
    # one row per chosen id, in an order that does not depend on how Spark returns rows
    table = (rows.mapInPandas(found, f"key {kind}, h bigint, label int, slots array<int>, values array<double>")
             .groupBy("key").agg(F.min_by(own, "h").alias("own")).orderBy(F.xxhash64("key"), "key").select("own.*").toPandas())
    return fit([(np.asarray(s, np.int64), np.asarray(v, np.float64)) for s, v in zip(table["slots"], table["values"])], table["label"].to_numpy())


def classify(docs: DataFrame, model: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text",
             chars_col: str | None = "n_chars") -> DataFrame:
    """One row per input row: id, held_out, score, predicted. Null texts score as empty ones."""
    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["score"] = [model.score(t, None if pd.isna(c) else int(c)) for t, c in zip(batch["text"], batch["chars"])]
            yield batch[["id", "score"]]

    chars = F.col(chars_col).cast("bigint") if chars_col else F.lit(None).cast("bigint")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), chars.alias("chars"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInPandas(scored, f"id {kind}, score double").select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs, model)
