"""Quality classifier: linear hinge loss on n-gram indicators scaled by Naive Bayes log-count ratios.

Indicators, hashed: byte trigrams, word unigrams and bigrams, unigrams and bigrams of word shapes, and trigrams of marks that tell
whether a word repeats one of the two before it. Each is scaled by the log ratio of its class frequencies; dual coordinate descent then fits a linear
hinge-loss model, whose weights are drawn towards their mean magnitude. A logistic curve, fitted to margins of
documents left out of the fit, turns margins into scores.

The fit uses at most `most_per_class` labelled documents per class, those with the least hash of id and text (equal rows
counted once), and of these as many as have indicators of at most `most_bytes` in all, by an upper bound. Scoring reads every whole text.

Defined cases: null and empty texts have no indicators and get the score of the bare intercept; null labels and ids are not learned
from; an id with several labels counts with the largest; without both classes the score is the share of label 1 (0.5 without
labels); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded_sample, checkpointed, mapped, pieces, place_of, release_memory, spread, texts
from ._words import SPACED, Words, mix

GRAM_BITS, WORD_BITS = 16, 17
SIZE = (1 << GRAM_BITS) + (1 << WORD_BITS)
_SHAPE = np.full(256, 5, np.uint64)  # punctuation keeps its own shape
_SHAPE[ord("a") : ord("z") + 1] = 1
_SHAPE[ord("A") : ord("Z") + 1] = 2
_SHAPE[ord("0") : ord("9") + 1] = 3
_SHAPE[128:] = 4
for _c in range(33, 48):
    _SHAPE[_c] = 10 + _c
_SHAPE[124] = 9


def indicators(batch: list[bytes]) -> list[np.ndarray]:
    """Sorted indicator numbers of each text."""
    words = Words(batch, SPACED)
    raw = np.frombuffer(b" ".join(batch) + b" ", np.uint8)
    first, last, size = raw[words.starts], raw[words.ends - 1], words.ends - words.starts
    space = np.uint8(32)
    second = np.where(size > 1, raw[np.minimum(words.starts + 1, len(raw) - 1)], space)
    before = np.where(size > 1, raw[np.maximum(words.ends - 2, 0)], space)
    shape = ((_SHAPE[first] * np.uint64(64) + _SHAPE[second]) * np.uint64(64) + _SHAPE[last]) * np.uint64(64) + _SHAPE[before] + (np.minimum(size, 3).astype(np.uint64) << np.uint64(32))
    h = words.hashes
    again = np.zeros(len(h), np.uint64)
    again[1:] |= (h[1:] == h[:-1]).astype(np.uint64)
    again[2:] |= (h[2:] == h[:-2]).astype(np.uint64) << np.uint64(1)
    # a text's first word repeats nothing, its second only the first
    begins = words.bounds[:-1][words.bounds[:-1] < words.bounds[1:]]
    again[begins] = 0
    again[begins[begins + 1 < len(h)] + 1] &= np.uint64(1)
    runs = mix(again[:-2] * np.uint64(16) + again[1:-1] * np.uint64(4) + again[2:] + np.uint64(1 << 51)) if len(h) > 2 else h[:0]
    shape = mix(shape + (again << np.uint64(40)) + np.uint64(1 << 50))
    low = np.uint64((1 << WORD_BITS) - 1)
    kinds = [h, mix(h[:-1] * np.uint64(3) + h[1:]), shape, mix(shape[:-1] * np.uint64(3) + shape[1:]), runs]
    kinds = [(k & low).astype(np.int32) + (1 << GRAM_BITS) for k in kinds]
    wide = raw.astype(np.uint32)
    grams = (wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA6B) + wide[2:] * np.uint32(0xC2B2AE35)) if len(raw) > 2 else np.empty(0, np.uint32)
    grams = ((grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - GRAM_BITS)).astype(np.int32)
    out, at, flags = [], 0, np.zeros(SIZE, bool)
    for text, a, b in zip(batch, words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        flags[grams[at : max(at, at + len(text) - 2)]] = True
        for k, short in zip(kinds, (0, 1, 0, 1, 2), strict=True):
            flags[k[a : max(a, b - short)]] = True
        found = np.flatnonzero(flags).astype(np.int32)
        flags[found] = False
        out.append(found)
        at += len(text) + 1
    return out


def log_ratios(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) of smoothed counts of each indicator in class 1 and 0."""
    counts = [alpha + np.bincount(np.concatenate([np.empty(0, np.int32), *(r for r, y in zip(rows, labels, strict=True) if y == k)]), minlength=SIZE) for k in (1, 0)]
    return (np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())).astype(np.float32)


def dual_descent(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, cost: float = 0.1, rounds: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights on scaled indicators and intercept of the linear hinge-loss model."""
    y = np.where(labels == 1, 1.0, -1.0)
    upper = cost * np.where(labels == 1, len(labels) / (2 * max(1, (labels == 1).sum())), len(labels) / (2 * max(1, (labels == 0).sum())))
    values = [scale[r] / max(1e-9, float(np.sqrt((scale[r] ** 2).sum() + 1e-12))) for r in rows]
    norms = np.array([float(v @ v) + 1.0 for v in values])
    weights, bias, alpha, rng = np.zeros(SIZE, np.float32), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (float(weights[rows[i]] @ values[i]) + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), upper[i])
            if (step := (new - alpha[i]) * y[i]) != 0.0:
                weights[rows[i]] += np.float32(step) * values[i]
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3 * cost:
            break
    return weights, bias


class Quality:
    """A fitted model: margin and score of indicator rows."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, share: np.ndarray, beta: float = 0.25) -> None:
        """share: what each document stands for, so that scores fit the classes' true shares."""
        self.flat, self.n_rows = None, len(rows)
        if len(set(labels.tolist())) < 2:
            self.flat = 0.5 if not len(labels) else float(labels[0])
            return
        folds = np.arange(len(rows)) % 4
        margins = np.empty(len(rows))
        for k in range(4):
            part = np.flatnonzero(folds != k)
            if len(set(labels[part].tolist())) < 2:
                part = np.arange(len(rows))
            model = self._fit([rows[i] for i in part], labels[part], beta)
            for i in np.flatnonzero(folds == k):
                margins[i] = self._margin(model, rows[i])
        self.model = self._fit(rows, labels, beta)
        self.slope, self.shift = self._logistic(margins, labels, share)

    @staticmethod
    def _fit(rows: list[np.ndarray], labels: np.ndarray, beta: float) -> tuple[np.ndarray, np.ndarray, float]:
        scale = log_ratios(rows, labels)
        weights, bias = dual_descent(rows, labels, scale)
        used = weights != 0
        mean = float(np.abs(weights[used]).mean()) if used.any() else 0.0
        return ((1 - beta) * mean + beta * weights) * scale, scale, bias

    @staticmethod
    def _margin(model: tuple[np.ndarray, np.ndarray, float], row: np.ndarray) -> float:
        weights, scale, bias = model
        return float(weights[row].sum()) / max(1e-9, float(np.sqrt((scale[row] ** 2).sum() + 1e-12))) + bias

    @staticmethod
    def _logistic(margins: np.ndarray, labels: np.ndarray, share: np.ndarray) -> tuple[float, float]:
        """Slope and shift of the curve, by Newton steps with a little shrinkage."""
        spread = margins.std() or 1.0
        x = np.stack([margins / spread, np.ones(len(margins))])
        w = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            gradient = x @ (share * (p - labels)) + 1e-2 * w
            w = w - np.clip(np.linalg.solve((x * (share * p * (1 - p))) @ x.T + 1e-2 * np.eye(2), gradient), -2, 2)
        return float(max(w[0], 1e-6) / spread), float(w[1])

    def score(self, row: np.ndarray) -> float:
        if self.flat is not None:
            return self.flat
        return float(1 / (1 + np.exp(-np.clip(self.slope * self._margin(self.model, row) + self.shift, -30, 30))))


def held_out(id_col: str, modulus: int = 5, rest: int = 0) -> Column:
    """Whether crc32 of the id as text leaves this remainder."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % modulus == rest, F.lit(False))


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_per_class: int = 4000, most_bytes: int = 256 << 20
) -> Quality:
    """The model of the labelled documents that are not held out."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect() if r["label"] in (0, 1)}
    # of the labels, so many that a class is not short of documents though some labels have none
    chosen = checkpointed(bounded_sample(known.filter("label in (0, 1)").withColumn("place", place_of(F.col("id"))), "label", 4 * most_per_class).drop("place"))
    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    sample = bounded_sample(found.withColumn("place", place_of(F.col("id"), F.col("text"))), "label", most_per_class)
    bound = F.least(F.lit(4 * SIZE), 16 + 8 * F.coalesce(F.octet_length("text"), F.lit(0)))
    held = F.sum(bound).over(Window.partitionBy("label").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    sample = sample.withColumn("held", F.coalesce(held, F.lit(0))).filter(F.col("held") < most_bytes // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(2), 2 << 20):
                rows = indicators(texts(batch.column(2).slice(a, b - a)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([r.tobytes() for r in rows], pa.binary())], ["id", "label", "row"])

    taken = spread(sample.select("id", "label", "text")).transform(mapped, run, f"id {kind}, label int, row binary").toArrow()
    order = np.argsort([str(x) for x in taken.column(0).to_pylist()], kind="stable")
    rows = [np.frombuffer(x, np.int32) for x in taken.column(2).to_pylist()]
    y = np.array(taken.column(1).to_pylist(), np.int64)
    share = {k: n / max(1, (y == k).sum()) for k, n in counts.items()}
    y = y[order]
    share = np.array([share[k] for k in y.tolist()])
    found = Quality([rows[i] for i in order], y, share / (share.mean() if len(share) else 1.0))
    del rows, taken
    release_memory()
    return found


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, most_per_class: int = 4000) -> DataFrame:
    """Per row: id_col, held_out, score, predicted."""
    model = fit_quality(docs, labels, id_col, text_col, most_per_class=most_per_class)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # three arrays of SIZE numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(2), 2 << 20):
                scores = [shared.value.score(r) for r in indicators(texts(batch.column(2).slice(a, b - a)))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())],
                    [id_col, "held_out", "score", "predicted"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias(text_col))
    return rows.transform(mapped, run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")
