import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm.near_dedup import LABEL, LEAF, TREES, Search, jaccard_join, label_of, labels, leaves, overlap, prefix_codes, sized, walk

DATA = "/root/testdata/sf0.01"


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def plain_join(rows, threshold=0.8):
    """(id, class_id, n_links, copies) by comparing all pairs of rows."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    out = []
    for i, (k, _) in enumerate(rows):
        least = min((m for m in members[find(i)] if m is not None), default=None)
        out.append((k, least if sets[i] else k, links[i], sum(s == sets[i] for s in sets) if sets[i] else 1))
    return sorted(out, key=str)


def corpus(seed, groups=12, size=6):
    """Groups of copies and near copies of random texts, with odd rows among them."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "one two"), (905, "one  two"), (None, "one two"), (906, "a a a a a a a a a a"), (907, "a a a a a a"), (907, "a a a a a a")]
    for g in range(groups):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([6, 40, 120, 700]))]
        for k in range(size):
            near = list(words)
            for _ in range(rng.randrange(0, 1 + len(words) // 20)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            rows.append((g * size + k, " ".join(near)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("block", [256, 2])
def test_join(docs_of, seed, block):
    rows = corpus(seed)
    got = jaccard_join(docs_of(rows), block=block).drop("text_key", "class_key").collect()
    assert sorted(map(tuple, got), key=str) == plain_join(rows)


def test_join_beyond_broadcast(docs_of, monkeypatch):
    monkeypatch.setattr("tidemark.llm._common.BROADCAST_ROWS", 3)
    rows = corpus(3, groups=5)
    got = jaccard_join(docs_of(rows), block_shingles=100).drop("text_key", "class_key").collect()
    assert sorted(map(tuple, got), key=str) == plain_join(rows)


def test_nothing(docs_of):
    assert jaccard_join(docs_of([])).collect() == []
    assert [tuple(r)[:4] for r in jaccard_join(docs_of([(1, None)])).collect()] == [(1, 1, 0, 1)]


def test_crowds(docs_of):
    """With crowded nodes all about, the search stays deep where recall allows and still finds every link."""
    rng = random.Random(8)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for g in range(40):
        own = [f"o{g}x{i}" for i in range(rng.choice([3, 12, 40]))]
        for k in range(3):
            near = own + common
            near[rng.randrange(len(near))] = f"z{g}x{k}"
            rows.append((3 * g + k, " ".join(near)))
    got = jaccard_join(docs_of(rows), crowd=2).drop("text_key", "class_key").collect()
    assert sorted(map(tuple, got), key=str) == plain_join(rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables absent")
@pytest.mark.parametrize("crowd", [32, 4])
def test_recall_on_documents(spark, crowd):
    """Links found of all links of the test documents, by comparing all pairs that share a shingle."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: shingle_set(r.text) for r in docs.collect()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    met = Counter((a, b) for ids in holders.values() for a in ids for b in ids if a != b)
    want = Counter(a for (a, b), c in met.items() if c >= 0.8 * (len(sets[a]) + len(sets[b]) - c) - 1e-9)
    got = {r.doc_id: r.n_links for r in jaccard_join(docs, crowd=crowd).collect()}
    assert all(got[i] <= want[i] for i in got)
    assert sum(got.values()) / sum(want.values()) >= 0.999


def test_an_unreachable_recall_is_refused(docs_of):
    with pytest.raises(ValueError, match="less than 0.99"):
        jaccard_join(docs_of([(1, "a")]), threshold=0.05, recall=0.99)


def test_least_depth():
    search = Search(0.8, 0.99999, 32)
    assert search.least == 3
    assert search.recall(np.full((1, TREES), search.least + 1))[0] >= 0.99999 > search.recall(np.full((1, TREES), search.least + 2))[0]


def plain_depths(search, sizes):
    """One class, step by step."""
    depths = [LABEL] * TREES
    missed = lambda: np.prod([1 - 0.8**d for d in depths])
    size = lambda t, d: sizes[t][d - search.least]
    for level in range(LABEL - 1, search.least - 1, -1):
        if missed() <= 1 - 0.99999:
            return depths
        depths = [level if d == level + 1 and size(t, level) <= search.crowd else d for t, d in enumerate(depths)]
    while missed() > 1 - 0.99999:
        _, t = min((size(t, d - 1), t) for t, d in enumerate(depths) if d > search.least)
        depths[t] -= 1
    return depths


def test_prefixes_are_shortened_until_the_recall_is_reached():
    search, rng = Search(0.8, 0.99999, 32), np.random.default_rng(1)
    sizes = rng.integers(1, 60, (200, TREES, LABEL + 1 - search.least))
    sizes[:50, :, :] = 1
    sizes[50:100, :, 0] = 500
    sizes[100:120] = 900
    sizes = -np.sort(-sizes, axis=2)
    got = search.depths(sizes)
    assert got.tolist() == [plain_depths(search, x) for x in sizes.tolist()]
    assert (search.recall(got) >= 0.99999).all()
    assert (got[:50] == 4).all()
    # a partner of one's own, or a few, change nothing
    few = sizes[:50].copy()
    few[rng.random(few.shape) < 0.5] = 20
    assert (search.depths(-np.sort(-few, axis=2)) == 4).all()
    # crowded nodes stay deeper than the others
    assert got[(sizes[:, :, 0] > 32)].mean() > got[(sizes[:, :, 0] <= 32)].mean()


def test_recall_at_the_threshold():
    rng = np.random.default_rng(0)
    hits = 0
    for _ in range(300):
        shared = rng.integers(0, 2**63, 80, dtype=np.uint64)
        a, b = (labels(np.unique(np.r_[shared, rng.integers(0, 2**63, 10, dtype=np.uint64)])) for _ in range(2))
        hits += (a[:, :4] == b[:, :4]).all(axis=1).any()
    assert hits == 300


def test_leaves_sort_as_labels_and_come_back():
    rng = np.random.default_rng(4)
    made = rng.integers(0, 2**16, (30, TREES, LABEL)).astype(np.uint16)
    raw = [leaves(x) for x in made]
    assert (label_of(raw) == made).all()
    for t in (0, TREES - 1):
        assert sorted(range(30), key=lambda i: made[i, t].tolist()) == sorted(range(30), key=lambda i: raw[i][t * LEAF : (t + 1) * LEAF])
    codes = prefix_codes(np.repeat(made[:1], 2, axis=0))
    assert (codes[0] == codes[1]).all() and len(np.unique(codes[0])) == TREES * LABEL


def test_walk():
    rows = sorted([t, *m] for t in range(2) for m in ([0, 1, 0, 1, 0, 2, 0, 3, 0, 4, 0, 5], [0, 1, 0, 1, 0, 2, 0, 3, 0, 4, 0, 6], [0, 1, 0, 1, 0, 9, 0, 3, 0, 4, 0, 6]))
    assert walk(np.array(rows, np.uint8), 2).tolist() == [[3, 2, 2, 2, 1], [3, 2, 2, 2, 1], [3, 1, 1, 1, 1]] * 2


@pytest.mark.parametrize("rows_at_once", [3, 10_000])
def test_sizes_of_nodes_over_many_tasks(spark, rows_at_once):
    """Runs that go on in another batch or task are counted whole."""
    rng = np.random.default_rng(6)
    made = rng.integers(0, 3, (120, TREES, LABEL)).astype(np.uint16)
    made[:40] = made[0]
    rows = [(i, 7, bytearray(leaves(x))) for i, x in enumerate(made)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_at_once))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sized(spark.createDataFrame(rows, "cls long, n long, leaves binary"), 3).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    counts = Counter((t, tuple(x[t, :d])) for x in made for t in range(TREES) for d in range(3, LABEL + 1))
    want = {(i, t): [counts[t, tuple(x[t, :d])] for d in range(3, LABEL + 1)] for i, x in enumerate(made) for t in range(TREES)}
    assert {(r.cls, r.leaf[0]): r.sizes for r in got} == {k: v for k, v in want.items() if v[0] > 1}
    assert len(got) == len({(r.cls, r.leaf[0]) for r in got}) and all(r.n == 7 for r in got)


def test_overlap():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (3, 50, 20, 1, 40)]
    want = [[0 if i == j else len(np.intersect1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    got = overlap(sets, columns=7)
    np.fill_diagonal(got, 0)
    assert got.tolist() == want
