import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm._common import bounded_sample, place_of
from tidemark.llm.language import Centroids, counts, fit_languages, has_letters, identify_languages, k_means, recognised, sparse
from tidemark.llm.quality import Quality, dual_descent, fit_quality, indicators, log_ratios, score_quality

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables absent")


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


@needs_data
def test_language_accuracy(spark):
    docs = table(spark, "documents")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = identify_languages(docs).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.99
    assert all(0 <= r.score <= 1 for r in got) and not any(r.rejected for r in held)


@needs_data
def test_language_ignores_ids_and_labels(spark):
    """The same text gets the same verdict whatever its row says."""
    docs = table(spark, "documents")
    text = "Quelque chose de la rue dans les maisons"
    odd = spark.createDataFrame([(10**9 + i, text, lang, s, 1) for i, (lang, s) in enumerate([("en", "a"), ("fr", "b"), (None, None)] * 5)], docs.schema)
    got = {(r.lang_pred, round(r.score, 6)) for r in identify_languages(docs.unionByName(odd)).collect() if r.doc_id >= 10**9}
    assert len(got) == 1


def test_language_odd_rows(spark, docs_of):
    rows = [(1, None), (2, ""), (3, "123 !? ½ ² Ⅳ ٣"), (4, "the cat and the dog"), (5, "words of the house"), (6, "漢字かな交じり文" * 5), (None, "the"), (7, "long words " * 50_000), (7, "x")]
    got = {(r.doc_id, r.lang_pred, r.rejected) for r in identify_languages(docs_of(rows)).collect()}
    assert {(1, "und", True), (2, "und", True), (3, "und", True)} <= got
    assert all(p == "en" for i, p, _ in got if i in (4, 5, 7, None))
    kept = recognised(docs_of(rows))
    assert kept.columns == docs_of(rows).columns and {1, 2, 3}.isdisjoint({r.doc_id for r in kept.collect()})
    assert identify_languages(docs_of([])).collect() == []
    assert [r.lang_pred for r in identify_languages(docs_of([(1, None)])).collect()] == ["und"]


@pytest.mark.parametrize("doc", [9, 12])
def test_language_of_one_id(spark, docs_of, doc):
    """However many rows share an id, and whatever its hash, their language is learned."""
    rows = [(doc, f"the house and the garden number {i}") for i in range(3000)]
    fit = zlib.crc32(str(doc).encode()) % 4 != 2
    assert {r.lang_pred for r in identify_languages(docs_of(rows)).collect()} == ({"en"} if fit else {"und"})


def test_every_language_is_learned(spark):
    """Rare languages, too: each has one text at least in the bounded sample."""
    rows = [(i, f"{'common words of the land' if i % 2 else 'autres mots du pays'} {i}", "en" if i % 2 else "fr") for i in range(2000)]
    rows += [(9000 + i, chr(0x4E00 + 40 * i) * 12, f"x{i}") for i in range(25) for _ in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_languages(docs, "doc_id", "text", "lang", most_total=60)
    fit = {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    assert set(model.langs) == fit
    with pytest.raises(ValueError, match="more than 5"):
        fit_languages(docs, "doc_id", "text", "lang", most_total=5)


def test_bounded_sample(spark):
    rows = [("a", i % 5000, i) for i in range(20_000)] + [("b", 7, i) for i in range(3000)] + [("c", i, i) for i in range(40)]
    frame = spark.createDataFrame(rows, "kind string, x long, y long").withColumn("place", place_of(F.col("x")))
    got = [tuple(r) for r in bounded_sample(frame, "kind", 50).select("kind", "x", "place").collect()]
    assert Counter(k for k, *_ in got) == {"a": 50, "b": 1, "c": 40}
    places = sorted({r.place for r in frame.filter("kind = 'a'").select("place").distinct().collect()})
    assert sorted(p for k, _, p in got if k == "a") == places[:50]
    assert Counter(k for k, *_ in (tuple(r) for r in bounded_sample(frame, "kind", 50, 30).select("kind").collect())) == {"a": 10, "b": 1, "c": 10}


def plain_language(docs, clusters=4):
    """(lang, cosine) by plain counts of byte n-grams, without hashing: other words for the same centroids."""
    keep = set(b"abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))

    def grams(text):
        raw = bytes(b if b in keep else 32 for b in f" {text.lower()} ".encode())
        return Counter(raw[i : i + n] for n in (1, 2, 3) for i in range(len(raw) - 2))

    fit = [(t, lang) for i, t, lang in docs if t and zlib.crc32(str(i).encode()) % 4 != 2]
    seen = Counter(g for t, _ in fit for g in grams(t))
    seen = Counter({g: sum(g in c for c in [grams(t) for t, _ in fit]) for g in seen})

    def vector(text):
        found = {g: (1 + np.log(n)) * (np.log((1 + len(fit)) / (1 + seen[g])) + 1) for g, n in grams(text).items()}
        size = np.sqrt(sum(x * x for x in found.values()))
        return {g: x / size for g, x in found.items()}

    number = {g: k for k, g in enumerate(seen)}
    centres = {}
    for lang in sorted({x for _, x in fit}):
        own = np.zeros((sum(x == lang for _, x in fit), len(number)), np.float32)
        for row, (t, _) in zip(own, [r for r in fit if r[1] == lang], strict=True):
            for g, x in vector(t).items():
                row[number[g]] = x
        centres[lang] = k_means(own, min(clusters, len(own)))
    out = []
    for _, t, _ in docs:
        v = {number[g]: x for g, x in vector(t).items() if g in number}
        at, x = np.array(list(v)), np.array(list(v.values()))
        out.append(max((float((c[:, at] @ x).max()), lang) for lang, c in centres.items()))
    return out


@needs_data
def test_language_against_plain_counts(spark):
    """Each text's language, and nearly its cosine, by centroids over plain n-gram counts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").filter("length(text) between 20 and 4000").orderBy("doc_id").limit(120)
    rows = [tuple(r) for r in docs.collect()]
    got = {r.doc_id: r for r in identify_languages(spark.createDataFrame(rows, docs.schema)).collect()}
    want = plain_language(rows)
    assert np.mean([got[i].lang_pred == lang for (i, _, _), (_, lang) in zip(rows, want, strict=True)]) > 0.99
    assert np.mean([abs(got[i].score - score) for (i, _, _), (score, _) in zip(rows, want, strict=True)]) < 0.1


def test_counts_do_not_depend_on_blocks():
    text = "Ab cé! 漢 x" * 50
    assert (counts(text, block=7) == counts(text)).all()


def test_letters():
    assert [has_letters(t) for t in (None, "", "½ 12_", "½ é", "漢", "x")] == [False, False, False, True, True, True]


def test_distance_rejects():
    model = Centroids([sparse(t) for t in ("the house of the", "in the house", "la maison de la", "dans la maison")], ["en", "en", "fr", "fr"], clusters=2)
    (near, far) = model.predict(["the house", "ЖЖЖЖ ЩЩЩЩ"])
    assert near[0] == "en" and not near[2] and far[2]


def test_k_means():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 0.05, (30, 3)) for c in ([1, 0, 0], [0, 1, 0])]).astype(np.float32)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    found = k_means(points, 2, seed=5)
    assert sorted(found.argmax(axis=1).tolist()) == [0, 1]


@needs_data
def test_quality(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = score_quality(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    good, bad = ([s for s, y in held if y == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_quality_odd_rows(spark, docs_of):
    rows = [(i, f"plain words here number {i}") for i in range(40)] + [(i, f"BUY!! NOW!! {i}!!") for i in range(40, 80)]
    rows += [(100, None), (101, ""), (None, "BUY!!"), (102, "long text " * 40_000), (103, "z"), (103, "z")]
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in range(80)] + [(None, 1, 0), (5, None, 0), (6, 1, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    got = score_quality(docs_of(rows), labels).collect()
    score = {r.doc_id: r.score for r in got}
    assert len(got) == len(rows) and min(score[i] for i in range(40)) > max(score[i] for i in range(40, 80))
    assert score[100] == score[101]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in score_quality(docs_of(rows), none).collect()} == {0.5}
    assert score_quality(docs_of([]), labels).collect() == []


def test_indicators_do_not_depend_on_neighbours():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "B!", "c|", "é"]) for _ in range(rng.randrange(9))).encode() for _ in range(30)]
    for text, row in zip(texts, indicators(texts), strict=True):
        assert row.tolist() == indicators([text])[0].tolist()


def plain_indicators(text):
    """The same features, by name."""
    shape_of = lambda c: "a" if 97 <= c <= 122 else "A" if 65 <= c <= 90 else "0" if 48 <= c <= 57 else "é" if c >= 128 else chr(c) if 33 <= c < 48 or c == 124 else "."
    words = text.split()
    out = {("gram", text[i : i + 3]) for i in range(len(text) - 2)}
    again = [(i > 0 and w == words[i - 1], i > 1 and w == words[i - 2]) for i, w in enumerate(words)]
    shapes = [(shape_of(w[0]), shape_of(w[1]) if len(w) > 1 else "", shape_of(w[-1]), shape_of(w[-2]) if len(w) > 1 else "", min(len(w), 3), g) for w, g in zip(words, again, strict=True)]
    for name, row in (("word", words), ("shape", shapes)):
        out |= {(name, x) for x in row} | {(name, x) for x in zip(row, row[1:], strict=False)}
    return out | {("again", x) for x in zip(again, again[1:], again[2:], strict=False)}


@needs_data
def test_quality_against_plain_features(spark):
    """A plain fit, with named features and another solver (projected gradient on the dual), ranks held-out texts alike."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").filter("length(text) < 3000")
    labels = table(spark, "labels").select("doc_id", "quality")
    rows = sorted(tuple(r) for r in docs.join(labels, "doc_id").collect())
    rows = [r for r in rows if r[2] == 0][:60] + [r for r in rows if r[2] == 1][:140]
    fit = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    sets = [plain_indicators((t or "").encode()) for _, t, _ in fit]
    y = np.array([1 if q else -1 for *_, q in fit])
    number = {f: k for k, f in enumerate(sorted(set().union(*sets), key=str))}
    x = np.zeros((len(fit), len(number)))
    for row, s in zip(x, sets, strict=True):
        row[[number[f] for f in s]] = 1
    up, down = 1 + x[y > 0].sum(axis=0), 1 + x[y < 0].sum(axis=0)
    ratio = np.log(up / up.sum()) - np.log(down / down.sum())
    scaled = x * ratio
    norms = np.linalg.norm(scaled, axis=1, keepdims=True)
    gram = ((scaled / norms) @ (scaled / norms).T + 1) * np.outer(y, y)
    most = 0.1 * np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    alpha = np.zeros(len(y))
    for _ in range(4000):
        alpha = np.clip(alpha + (1 - gram @ alpha) / np.linalg.norm(gram, 2), 0, most)
    weights, bias = (alpha * y) @ (scaled / norms), float((alpha * y).sum())

    model_rows = [indicators([(t or "").encode()])[0] for _, t, _ in fit]
    scale = log_ratios(model_rows, (y > 0).astype(int))
    found, intercept = dual_descent(model_rows, (y > 0).astype(int), scale, rounds=400)
    # margins of all texts, in and out of the fit, by both
    ours, plain = [], []
    for _, t, _ in rows:
        row = indicators([(t or "").encode()])[0]
        ours.append(float(found[row] @ scale[row]) / max(1e-9, float(np.linalg.norm(scale[row]))) + intercept)
        own = [number[f] for f in plain_indicators((t or "").encode()) if f in number]
        plain.append(float(weights[own] @ ratio[own]) / max(1e-9, float(np.linalg.norm(ratio[own]))) + bias)
    assert np.corrcoef(ours, plain)[0, 1] > 0.97
    assert np.mean(np.sign(ours) == np.sign(plain)) > 0.95


def test_quality_sample_is_bounded(spark, docs_of):
    """Many rows of one id, and long texts, are drawn from up to the bounds; every class stays."""
    rows = [(1, f"plain words {i}") for i in range(400)] + [(2, f"BUY!! NOW!! {i}") for i in range(400)] + [(3, "long words " * 5000), (4, "LONG!! NOW!! " * 5000)]
    docs = docs_of([(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 5])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "doc_id long, quality int")
    model = fit_quality(docs, labels, most_per_class=30)
    assert model.n_rows <= 60 and model.flat is None
    assert fit_quality(docs, labels, most_per_class=30, most_bytes=2000).n_rows <= 30


def test_dual_descent_separates():
    rng = np.random.default_rng(2)
    labels = np.array([0, 1] * 40)
    rows = [np.unique(np.r_[rng.integers(100, 400, 20), y]).astype(np.int32) for y in labels]
    scale = log_ratios(rows, labels)
    weights, bias = dual_descent(rows, labels, scale)
    margins = [float(weights[r] @ scale[r]) + bias for r in rows]
    assert all((m > 0) == (y == 1) for m, y in zip(margins, labels, strict=True))
    model = Quality(rows, labels, np.ones(80))
    assert all((model.score(r) > 0.5) == (y == 1) for r, y in zip(rows, labels, strict=True))
