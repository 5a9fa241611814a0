import hashlib
import random
import re

import numpy as np
import pytest

from tidemark.llm._words import ALNUM, Words
from tidemark.llm.decontaminate import FMIndex, Phrases, Shard, decontaminated, find_contamination, suffix_array


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(rows, items, window=13):
    phrases = {}
    for k, text in items:
        w = words_of(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else ():
            phrases.setdefault(tuple(w[i : i + n]), set()).add(k)
    sizes = {len(p) for p in phrases}
    out = []
    for i, text in rows:
        w, found = words_of(text), set()
        hit = [False] * len(w)
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (p := tuple(w[s : s + n])) in phrases:
                    hit[s : s + n] = [True] * n
                    found |= phrases[p]
        listed = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), sum(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return sorted(out, key=str)


def corpus(seed, short):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "é", "A1", "x"] + [f"v{i}" for i in range(30)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, make(rng.randrange(13, 40))) for k in range(12)] + [(50, None), (51, ""), (52, "..."), (7, make(14)), (None, make(15))]
    if short:
        items += [(60, "only three words"), (61, "the of"), (62, "the  OF!")]
    rows = [(900, None), (901, ""), (902, "?!"), (None, items[0][1])]
    for i in range(40):
        text = make(rng.randrange(0, 80))
        if rng.random() < 0.6:
            text += rng.choice(["! ", "\n", " -- "]) + items[rng.randrange(12)][1].upper() + " " + make(rng.randrange(0, 300))
        rows.append((i, text))
    return [*rows, rows[10], rows[10], (903, (items[3][1] + " ") * 50)], items


@pytest.mark.parametrize(("seed", "short", "size"), [(1, False, 1 << 20), (2, True, 1 << 20), (3, True, 500), (4, False, 1)])
def test_against_all_windows(spark, docs_of, seed, short, size):
    rows, items = corpus(seed, short)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = find_contamination(docs_of(rows), benchmark, shard_bytes=size, block_bytes=size).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == plain(rows, items)
    for r in got:
        assert sum(s.words for s in r.spans) == r.n_hit
    clean = decontaminated(docs_of(rows), benchmark)
    assert clean.columns == docs_of(rows).columns
    kept = clean.collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted((r[0] for r in plain(rows, items) if not r[5]), key=str)
    hits = {(i, t): plain([(i, t)], items)[0][2] for i, t in rows}
    for r in kept:
        assert plain([(r.doc_id, r.text)], items)[0][2] == 0
        assert hits.get((r.doc_id, r.text)) == 0 or r.n_chars == len(r.text)
    assert sum((r.doc_id, r.text) in hits for r in kept) == sum(hits[x] == 0 for x in rows)


def test_nothing(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_contamination(docs_of([]), none).collect() == []
    assert [tuple(r)[1:4] for r in find_contamination(docs_of([(1, "a b")]), none).collect()] == [(2, 0, 0)]


def test_suffix_array():
    rng = np.random.default_rng(1)
    for n, few in ((0, 1), (1, 1), (50, 2), (200, 3), (64, 1)):
        text = np.r_[np.tile(rng.integers(1, few + 1, n), 3), 0]
        n *= 3
        want = sorted(range(n + 1), key=lambda i: text[i:].tolist())
        assert suffix_array(text).tolist() == want


def test_index():
    rng = np.random.default_rng(2)
    text = rng.integers(1, 6, 400).astype(np.int32)
    index = FMIndex(text, 4)
    assert index.search(np.array([[-1, 2], [2, -1]], np.int32))[1].tolist() == [0, 0]
    for n in (1, 2, 4):
        phrases = rng.integers(2, 6, (30, n)).astype(np.int32)
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high, strict=True):
            want = [i for i in range(400 - n + 1) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_the_index_holds_every_word():
    """Words that no phrase has are in the index, too."""
    words = Words([b"the cat sat on", b"", b"the mat the cat"], ALNUM)
    shard = Shard(words)
    assert shard.index.n == len(words) + 3 + 1 and len(shard.alphabet) == 5
    found = [(f.tolist(), n) for f, n, *_ in shard.occurrences(Phrases([("a", b"the cat"), ("b", b"on the"), ("c", b"dog")], 13))]
    assert [(sorted(f), n) for f, n in found] == [([0, 6], 2)]


def test_a_benchmark_of_many_blocks(spark, docs_of, monkeypatch):
    """More blocks than a worker keeps; they are written by tasks."""
    rng = random.Random(5)
    items = [(k, " ".join(f"q{rng.randrange(3000)}" for _ in range(60))) for k in range(90)]
    rows = [(i, f"start {items[i][1]} stop") for i in range(0, 90, 7)] + [(500 + i, " ".join(f"q{rng.randrange(3000)}" for _ in range(80))) for i in range(20)]
    got = find_contamination(docs_of(rows), spark.createDataFrame(items, "item_id long, text string").repartition(3), block_bytes=2000).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == plain(rows, items)


def test_a_cut_that_brings_a_phrase_together(spark, docs_of):
    phrase = " ".join(f"p{i}" for i in range(13))
    half = phrase.split()
    text = " ".join(["clean"] * 600 + half[:6] + half + half[6:] + ["end"] * 600)
    benchmark = spark.createDataFrame([(1, phrase)], "item_id long, text string")
    (row,) = decontaminated(docs_of([(1, text)]), benchmark).collect()
    assert row.text.split() == ["clean"] * 600 + ["end"] * 600 and row.n_chars == len(row.text)
