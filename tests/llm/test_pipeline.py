import hashlib
import os
import random
import re

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")

DATA = "/root/testdata/sf0.001"


def words(rng, n):
    vocabulary = ["the", "house", "of", "and", "river", "stone", "where", "people", "walk", "under"] + [f"name{i}" for i in range(60)]
    return [rng.choice(vocabulary) for _ in range(n)]


def corpus():
    """(rows, ids that must stay, groups of which one stays, ids that must go)."""
    rng = random.Random(11)
    rows = [(i, " ".join(words(rng, 80))) for i in range(60)]
    stay = set(range(30))
    copies = [[200, 201, 31], [202, 32]]
    rows += [(200, rows[31][1]), (201, rows[31][1]), (202, rows[32][1])]
    near = []
    for k in (40, 41):
        w = rows[k][1].split()
        w[3] = "changed"
        rows.append((300 + k, " ".join(w)))
        near.append([k, 300 + k])
    items = [(k, " ".join(words(rng, 25))) for k in range(5)]
    rows += [(400 + k, f"{' '.join(words(rng, 30))} {t} {' '.join(words(rng, 30))}") for k, t in items]
    rows.append((700, f"{' '.join(words(rng, 300))}, {' '.join(items[0][1].split()[4:18])}. {' '.join(words(rng, 300))}"))  # a short passage, cut out
    rows += [(500, None), (501, ""), (502, "12 34 !"), (503, "漢字かな交じり文" * 9)]
    rows += [(600, "the people walk under the stone house"), (600, "the people walk under the stone house")]
    return rows, stay, copies, near, {400, 401, 402, 403, 404, 500, 501, 502, 503}, items


@pytest.fixture
def folder(spark, tmp_path):
    rows, *_, items = corpus()
    docs = spark.createDataFrame([(i, t, "en" if i % 9 and i < 500 else None, "s", 1, i * 2, "c") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, keep_id long, `key` string")
    docs.repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    return f"file://{tmp_path}"


def test_planted_cases(spark, folder):
    _, stay, copies, near, gone, _ = corpus()
    kept = [r.doc_id for r in pipeline.run(spark, folder).collect()]
    assert len(kept) == len(set(kept))
    kept = set(kept)
    assert (stay - kept, gone & kept) == (set(), set()) and 600 in kept
    assert 201 in kept and 202 in kept  # the largest id of exact copies
    for group in (*copies, *near):
        assert len(kept & set(group)) == 1
    assert 40 in kept and 41 in kept  # the least id of linked texts


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def hits(text, items):
    """(spans of words, mask of words in a window of 13 words of an item, or in a whole shorter item)."""
    spans = [m.span() for m in WORD.finditer(lowered(text))]
    found = [lowered(text)[a:b] for a, b in spans]
    mask = [False] * len(found)
    for _, item in items:
        w = WORD.findall(lowered(item))
        n = min(13, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(found) - n + 1):
            if tuple(found[i : i + n]) in windows:
                mask[i : i + n] = [True] * n
    return spans, mask


def cut(text, items):
    """The text without passages, None if they are 5 % of it or more."""
    spans, mask = hits(text, items)
    if any(mask) and 20 * sum(mask) >= len(mask):
        return None
    while any(mask):
        runs, i = [], 0
        while i < len(mask):
            j = i
            while j < len(mask) and mask[j]:
                j += 1
            if j > i:
                runs.append((spans[i][0], spans[j - 1][1]))
            i = j + 1
        for a, b in reversed(runs):
            text = text[:a] + text[b:]
        spans, mask = hits(text, items)
    return text


def plain_pipeline(rows, items):
    """Rows (id, text) of the last stage, from those that the language stage keeps: every stage by comparing all with all."""
    best = {}
    for i, t in rows:
        best[t] = max(best.get(t, i), i)
    rows = sorted({(i, t) for i, t in rows if best[t] == i})
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    root = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i in root:
            for j in root:
                if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                    low, high = sorted((root[i], root[j]))
                    root = {k: low if v == high else v for k, v in root.items()}
                    changed = True
    rows = [(i, t) for i, t in rows if root[i] == i]
    return [(i, c) for i, t in rows if (c := cut(t, items)) is not None]


def test_against_a_plain_version(spark, folder):
    """Ids, texts and piece ids of the last stage; what the language stage keeps is taken from its operator."""
    import sentencepiece

    from tidemark.llm.language import identify_languages

    *_, items = corpus()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    known = {r.doc_id for r in identify_languages(docs).collect() if not r.rejected}
    want = plain_pipeline([(r.doc_id, r.text) for r in docs.collect() if r.doc_id in known], items)
    library = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    got = sorted((r.doc_id, r.ids, r.decoded_sha256) for r in pipeline.run(spark, folder).collect())
    assert got == sorted((i, library.encode(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in want)
    (short,) = [t for i, t in want if i == 700]
    assert not any(hits(short, items)[1]) and len(short.split()) in (600, 601, 602)


def test_stages_keep_rows_as_they_are(spark, folder):
    *_, items = corpus()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    whole = {tuple(r) for r in docs.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        changed = [r for r in map(tuple, out.collect()) if r not in whole]
        if name != "decontaminate":
            assert changed == []
            continue
        (row,) = changed
        (old,) = [r for r in whole if r[0] == row[0] == 700]
        assert row[1] == cut(old[1], items) and row[4] == len(row[1])
        assert row[2:4] + row[5:] == old[2:4] + old[5:]


def test_stages_on_nothing(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, folder).collect() == []


def test_beyond_broadcast(spark, folder, monkeypatch):
    want = sorted(r.doc_id for r in pipeline.run(spark, folder).collect())
    for module in ("_common", "stages"):
        monkeypatch.setattr(f"tidemark.llm.{module}.BROADCAST_ROWS", 0)
    assert sorted(r.doc_id for r in pipeline.run(spark, folder).collect()) == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables absent")
def test_against_the_operators_one_by_one(spark):
    """run() keeps what a plain reading of each operator's verdicts keeps."""
    from tidemark.llm.decontaminate import find_contamination
    from tidemark.llm.near_dedup import jaccard_join

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    last = {t: i for i, t in sorted(rows.items())}
    left = docs.filter(F.col("doc_id").isin(list(last.values())))
    joined = jaccard_join(left).collect()
    left = left.filter(F.col("doc_id").isin([r.doc_id for r in joined if r.class_id == r.doc_id]))
    judged = find_contamination(left, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()
    want = sorted(r.doc_id for r in judged if not r.contaminated)
    got = pipeline.run(spark, DATA).collect()
    assert sorted(r.doc_id for r in got) == want and all(r.round_trip for r in got)
