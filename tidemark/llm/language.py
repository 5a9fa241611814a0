"""Language ID: nearest of several centroids per language, by cosine of TF-IDF n-gram vectors.

N-grams: hashed bytes of lower-cased text, one to three at a time, everything but letters read as a space. Counts are damped
(1 + log), weighted by inverse document frequency and scaled to length one. Per language, spherical k-means finds the
centroids. A text gets the language of the nearest centroid; `score` is that cosine. A text is rejected if it has no letters, or if
its cosine is under `reject` times the least cosine that a training text of that language has to its nearest centroid.

The fit uses at most `most_per_language` texts per language and most_total in all, shared evenly by the languages, but at least one of
each: those with the least hash of id and text, equal rows counted once. More languages than most_total are a ValueError.
Prediction reads every whole text.

Defined cases: null, empty and letterless texts are `und` with score 0, rejected; null langs and null ids are not learned from;
ties go to the language that sorts first; without a training text every text is `und`; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bounded_sample, mapped, pieces, place_of, release_memory

BITS = 13
SIZE = 1 << BITS
_WORDLIKE = re.compile(r"[^\W\d_]")
_KEEP = np.full(256, 32, np.uint8)
_KEEP[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_KEEP[128:] = np.arange(128, 256)


def has_letters(text: str | None) -> bool:
    """Whether a text has a letter; digits and number signs of any script are none."""
    found = _WORDLIKE.search(text or "")
    return found is not None and (found[0].isalpha() or any(map(str.isalpha, text)))


def counts(text: str, block: int = 1 << 20) -> np.ndarray:
    """Counts of hashed n-grams, read block by block."""
    total = np.zeros(SIZE, np.int64)
    raw = np.frombuffer(f" {text.lower()} ".encode(), np.uint8)
    for a in range(0, len(raw) - 2, block):
        one = _KEEP[raw[a : a + block + 2]].astype(np.uint32)
        two = one[:-1] * np.uint32(0x9E3779B1) + one[1:] * np.uint32(0x85EBCA6B)
        three = two[:-1] * np.uint32(0xC2B2AE35) + one[2:] * np.uint32(0x27D4EB2F)
        for grams in (one[:-2] * np.uint32(0x165667B1), two[:-1], three):
            mixed = (grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS)
            total += np.bincount(mixed, minlength=SIZE)
    return total


def sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the n-grams of a text and their damped counts."""
    n = counts(text)
    at = np.flatnonzero(n).astype(np.int32)
    return at, (1 + np.log(n[at])).astype(np.float32)


def k_means(vectors: np.ndarray, k: int, rounds: int = 15, seed: int = 3) -> np.ndarray:
    """Unit centroids of unit vectors (rows), by cosine."""
    rng = np.random.default_rng(seed)
    centres = vectors[rng.choice(len(vectors), min(k, len(vectors)), replace=False)]
    label = None
    for _ in range(rounds):
        new = (vectors @ centres.T).argmax(axis=1)
        if label is not None and (new == label).all():
            break
        label = new
        for j in range(len(centres)):
            if (label == j).any():
                centres[j] = vectors[label == j].sum(axis=0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


class Centroids:
    """Centroids of each language and how near its own texts are to them."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str], clusters: int = 4, reject: float = 0.25) -> None:
        self.langs = sorted(set(langs))
        if not rows:
            return
        seen = np.bincount(np.concatenate([at for at, _ in rows]), minlength=SIZE)
        self.idf = (np.log((1 + len(rows)) / (1 + seen)) + 1).astype(np.float32)
        centres, owner, floor = [], [], []
        for i, lang in enumerate(self.langs):
            own = self.dense([r for r, x in zip(rows, langs, strict=True) if x == lang])
            found = k_means(own, clusters)
            floor.append(max(1e-6, reject * float((own @ found.T).max(axis=1).min())))
            centres.append(found)
            owner += [i] * len(found)
        self.by_gram, self.owner, self.floor = np.ascontiguousarray(np.concatenate(centres).T), np.array(owner), np.array(floor)

    def dense(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(rows), SIZE), np.float32)
        for i, (at, value) in enumerate(rows):
            weighted = value * self.idf[at]
            out[i, at] = weighted / max(1e-12, float(np.sqrt(weighted @ weighted)))
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, cosine, rejected) of each text."""
        out = [("und", 0.0, True)] * len(texts)
        live = [i for i, t in enumerate(texts) if has_letters(t)] if self.langs else []
        for i in live:
            at, value = sparse(texts[i])
            weighted = value * self.idf[at]
            near = weighted @ self.by_gram[at] / max(1e-12, float(np.sqrt(weighted @ weighted)))
            best = int(near.argmax())
            lang, cosine = int(self.owner[best]), float(near[best])
            out[i] = (self.langs[lang], min(1.0, max(0.0, cosine)), cosine < self.floor[lang])
        return out


def held_out(id_col: str, modulus: int = 4, rest: int = 2) -> Column:
    """Whether crc32 of the id as text leaves this remainder."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % modulus == rest, F.lit(False))


def fit_languages(docs: DataFrame, id_col: str, text_col: str, lang_col: str, most_per_language: int = 1000, most_total: int = 4000) -> Centroids:
    """Centroids of the documents that are not held out."""
    text, lang = F.col(text_col).cast("string"), F.col(lang_col).cast("string")
    known = docs.filter(F.col(id_col).isNotNull() & lang.isNotNull() & text.isNotNull() & ~held_out(id_col))
    known = known.select(F.col(id_col).cast("string").alias("id"), lang.alias("lang"), text.alias("text"))
    known = known.filter(F.regexp_like("text", F.lit(r"\p{L}"))).withColumn("place", place_of(F.col("id"), F.col("text")))
    sample = bounded_sample(known, "lang", most_per_language, most_total).select("id", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sparse(t) if has_letters(t) else None for t in batch.column(2).to_pylist()]
            kept = pa.array([r is not None for r in rows])
            rows = [r for r in rows if r is not None]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(kept), batch.column(1).filter(kept), pa.array([a.tobytes() for a, _ in rows], pa.binary()), pa.array([v.tobytes() for _, v in rows], pa.binary())], ["id", "lang", "at", "value"]
            )

    taken = sample.transform(mapped, run, "id string, lang string, at binary, value binary").toArrow().to_pydict()  # at most most_total rows
    order = sorted(range(len(taken["id"])), key=lambda i: (taken["id"][i], taken["lang"][i], taken["at"][i]))
    rows = [(np.frombuffer(taken["at"][i], np.int32), np.frombuffer(taken["value"][i], np.float32)) for i in order]
    found = Centroids(rows, [taken["lang"][i] for i in order])
    del rows, taken
    release_memory()
    return found


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_per_language: int = 1000) -> DataFrame:
    """Per row: id_col, held_out, lang_pred, score, rejected."""
    model = fit_languages(docs, id_col, text_col, lang_col, most_per_language)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most most_total / 4 languages of 4 centroids of SIZE numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(2), 2 << 20):
                found = shared.value.predict(batch.column(2).slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([bool(x[2]) for x in found])],
                    [id_col, "held_out", "lang_pred", "score", "rejected"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias(text_col))
    return rows.transform(mapped, run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def recognised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_per_language: int = 1000) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns."""
    model = fit_languages(docs, id_col, text_col, lang_col, most_per_language)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(text_col), 2 << 20):
                part = batch.slice(a, b - a)
                kept = part.filter(pa.array([not x[2] for x in shared.value.predict(part.column(text_col).to_pylist())]))
                if kept.num_rows:
                    yield kept

    return docs.transform(mapped, run, docs.schema)
