"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eoframe.llm.packing import in_slices
from eoframe.llm.tables import count_parts, free_name, unit_hash

#: Features are hashed to this many bits.
BITS = 18
#: At most about this many labelled rows are used for the fit, drawn by a hash of the id.
MOST_LABELLED = 32_768
#: Labelled rows of one local model; the local models are averaged.
ROWS_PER_MODEL = 4096
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1e-4, 1e-4
#: A feature's value is its share of the document's features, times this.
SCALE = 16.0
CHARS_AT_ONCE = 2_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SAME, _UPPER, _PAIR = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F), np.uint64(0x2545F4914F6CDD1D)


def _byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind = np.full(256, 2, dtype=np.uint8)  # symbols
    for b in range(256):
        if b in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D):
            kind[b] = 0
        elif b >= 0x80 or chr(b).isalnum():
            kind[b] = 1
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += np.uint64(32)
    small = np.zeros(256, dtype=np.int64)
    small[97:123] = 1
    return kind, lower, small


_KIND, _LOWER, _SMALL = _byte_tables()


def features(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts in one array, and where each text begins in it (one more entry than texts).

    Words are runs of letters and digits, and runs of symbols. A text's features are its lower-cased words and its word pairs,
    in which a word equal to its predecessor is written as "same" and a word of capitals as "capitals".
    """
    raw = [(t or "").encode("utf-8") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    text_start = np.concatenate([[0], np.cumsum(size + 1)])
    kind = _KIND[data]
    change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    begin = np.concatenate([[0], change])
    end = np.concatenate([change, [len(data)]])
    word = kind[begin] != 0
    begin, end = begin[word], end[word]
    power = np.full(len(data), _BASE, dtype=np.uint64)
    power[0] = 1
    back = np.full(len(data), _BACK, dtype=np.uint64)
    back[0] = 1
    with np.errstate(over="ignore"):
        np.multiply.accumulate(power, out=power)
        np.multiply.accumulate(back, out=back)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[data] + np.uint64(1)) * power, dtype=np.uint64)])
        h = (sums[end] - sums[begin]) * back[begin]
        h = (h ^ (h >> np.uint64(31))) * _MIX
        h ^= h >> np.uint64(29)
        letters = np.concatenate([[0], np.cumsum(_SMALL[data])])
        capitals = (letters[end] == letters[begin]) & (kind[begin] == 1) & (end - begin > 1) & (data[begin] > 64)
        of_text = np.searchsorted(text_start, begin, side="right") - 1
        first = np.ones(len(h), dtype=bool)
        first[1:] = of_text[1:] != of_text[:-1]
        before = np.zeros_like(h)
        before[1:] = h[:-1]
        before[first] = 0
        second = np.where(h == before, _SAME, np.where(capitals, _UPPER, h))
        lead = np.where(h == before, _SAME, np.where(np.concatenate([[False], capitals[:-1]]) & ~first, _UPPER, before))
        pair = (lead * _PAIR + second) * _MIX
        pair ^= pair >> np.uint64(32)
        pair *= _PAIR
    shift = np.uint64(64 - bits)
    both = np.empty(2 * len(h), dtype=np.int64)
    both[0::2], both[1::2] = h >> shift, pair >> shift
    return both, 2 * np.concatenate([np.searchsorted(of_text, np.arange(len(raw))), [len(h)]])


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1; a text without features has the bias alone."""
        found, bounds = features(texts, int(len(self.weights)).bit_length() - 1)
        sums = np.concatenate([[0.0], np.cumsum(self.weights[found].astype(np.float64))])
        n = np.maximum(np.diff(bounds), 1)
        logit = self.bias + SCALE * (sums[bounds[1:]] - sums[bounds[:-1]]) / n
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -500, 500)))


def train(texts: list[str | None], labels: list[int], bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Follow-the-regularised-leader over the rows in the given order: weights and bias."""
    z, n, w = np.zeros(1 << bits), np.zeros(1 << bits), np.zeros(1 << bits)
    bias_z = bias_n = bias = 0.0
    rows = []
    for a, b in in_slices(texts, CHARS_AT_ONCE):
        found, bounds = features(texts[a:b], bits)
        for i in range(b - a):
            own, counts = np.unique(found[bounds[i] : bounds[i + 1]], return_counts=True)
            rows.append((own, SCALE * counts / max(1, counts.sum())))
    for _ in range(epochs):
        for (own, x), label in zip(rows, labels):
            p = 1.0 / (1.0 + np.exp(-np.clip(bias + float(w[own] @ x), -500, 500)))
            g = (p - label) * x
            was = n[own]
            now = was + g * g
            zz = z[own] + g - (np.sqrt(now) - np.sqrt(was)) / ALPHA * w[own]
            z[own], n[own] = zz, now
            w[own] = np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(now)) / ALPHA + L2))
            gb = p - label
            bias_z += gb - (np.sqrt(bias_n + gb * gb) - np.sqrt(bias_n)) / ALPHA * bias
            bias_n += gb * gb
            bias = -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA + L2)
    return w, bias


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3; a null id is the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Fits on labelled documents outside fold 1. Null labels and labels other than 0 and 1 are left out.

    At most about ``most`` labelled rows take part. They are dealt by a hash of the id to local models of ``ROWS_PER_MODEL`` rows,
    each trained in a task of its own over whole texts; the average of the models is the result, whose size is fixed. Without
    labelled rows the model scores every text 0.5.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 1))
    known = known.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_label"))
    count = known.count()
    share = min(1.0, most / max(1, count))
    models = count_parts(min(count, most), ROWS_PER_MODEL)
    drawn = unit_hash(F.col("doc_id"), "fit") < share
    texts = docs.where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 1) & drawn).select("doc_id", "text")
    rows = texts.join(known, F.col("doc_id") == F.col("_id")).select(
        F.pmod(F.xxhash64("doc_id"), F.lit(models)).alias("_model"), unit_hash(F.col("doc_id"), "order").alias("_order"),
        "doc_id", "text", F.col("_label").alias("label"),
    )
    width, pieces = (1 << BITS) // 64, 64

    def local(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_order", "doc_id", "label"])
        w, bias = train(part["text"].tolist(), part["label"].tolist())
        return pd.DataFrame({
            "piece": range(pieces), "weights": [w[i * width : (i + 1) * width] for i in range(pieces)], "bias": [bias] * pieces,
        })

    def mean(part: pd.DataFrame) -> pd.DataFrame:
        w = np.stack(part["weights"].to_numpy())
        w = np.sort(w, axis=0).mean(axis=0)  # the same sum whatever order the models come in
        return pd.DataFrame({"piece": part["piece"][:1], "weights": [w], "bias": [float(np.sort(part["bias"]).mean())]})

    schema = "piece int, weights array<double>, bias double"
    found = rows.groupBy("_model").applyInPandas(local, schema).groupBy("piece").applyInPandas(mean, schema).collect()
    weights, bias = np.zeros(1 << BITS, dtype=np.float32), 0.0
    for r in found:
        weights[r["piece"] * width : (r["piece"] + 1) * width] = r["weights"]
        bias = r["bias"]
    return Model(weights, bias)


def score_column(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` and the score of each row's whole text (null: empty)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.schema.fields]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            parts = [shared.value.scores(texts[a:b]) for a, b in in_slices(texts, CHARS_AT_ONCE)]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, name])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(score, StructType([*fields, StructField(name, DoubleType())]))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, from its text alone. Rows that repeat stay as they are."""
    model = fit(docs, labels)
    scored = score_column(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return scored.select(
        "doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    name = free_name(docs, "_quality")
    return score_column(docs, fit(docs, labels), name).where(F.col(name) >= 0.5).select(*docs.columns)
