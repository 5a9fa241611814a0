import hashlib
import zlib
from collections import defaultdict

import pytest

from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.sharding import ROUNDS, domain, shard

ROWS = [(5, "a"), (9, "a"), (9, "a"), (1, None), (2, ""), (3, "b "), (4, "b"), (None, "c"), (7, "c"), (None, "d"), (8, "é" * 5000), (6, "é" * 5000)]


def plain_dedup(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = 1
        for i in ids:
            kept = i == keep and left > 0
            left -= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [ROWS, [], ROWS * 20, [(1, None)] * 3])
@pytest.mark.parametrize("support", [1 / 1024, 0.2])
def test_exact_dedup(docs_of, rows, support):
    got = [tuple(r) for r in exact_dedup(docs_of(rows), support=support).collect()]
    assert sorted(got, key=str) == plain_dedup(rows)


def place(number, n, seed=17):
    a, b = domain(n)

    def mix(value, step, modulus):
        return int(hashlib.md5(f"{seed}:{step}:{value}".encode()).hexdigest()[:15], 16) % modulus

    while True:
        left, right = divmod(number, b)
        for step in range(ROUNDS):
            if step % 2 == 0:
                left = (left + mix(right, step, a)) % a
            else:
                right = (right + mix(left, step, b)) % b
        number = left * b + right
        if number < n:
            return number


@pytest.mark.parametrize("rows", [ROWS, [], [(1, "x")], [(i % 7, "same" if i % 3 else f"{i}") for i in range(333)]])
def test_sharding(docs_of, rows):
    got = shard(docs_of(rows)).collect()
    sizes = sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows if i is not None)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == sizes
    assert sorted(r.row_number for r in got) == list(range(len(rows)))
    by_number = sorted(got, key=lambda r: r.row_number)
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in by_number]
    assert keys == sorted(keys)
    for r in got:
        p = place(r.row_number, len(rows))
        assert (r.shard, r.slot, r.law, r.grown_shard) == (p % 8, p // 8, "rows", None)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[k]) for k in range(8)]
    assert max(counts) - min(counts) <= 1
