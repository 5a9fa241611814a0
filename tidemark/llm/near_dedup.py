"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

A text is the set of its runs of `n` white-space separated words (all its words if fewer). Texts with equal sets form one class,
joined once.

The forest: each of TREES prefix tries holds every class under a label of LABEL MinHashes. A trie is its labels in sorted order,
range-partitioned over the tasks: a node of depth d is a run of labels with d MinHashes in common, found by the longest common prefixes
of neighbours. Runs that go on in the next task are added up from a table of one row per end of a task and depth.

The search: a class starts with its whole label in every trie and shortens the prefixes that it matches, one MinHash at a time in all
tries together. A trie stops where the next shorter prefix would lead to a crowded node, of more than `crowd` classes. It ends as soon as the
recall of a partner at the threshold, 1 - product over the tries of (1 - threshold ** depth), reaches the target; crowded nodes go on
only if all others are at the least depth and recall still falls short, the least crowded first. So crowded nodes stay as deep as
recall allows. Depths depend on a crowd, never on whether a single partner is there: a class with one partner is searched as one
without, and the recall is that of the formula. The least depth is one less than that at which all tries together reach the
target; a target that no depth reaches is a ValueError.

Two classes meet in a trie if their labels share the shorter of the two prefixes. Members of a node in which a class ends its search
are dealt, by a hash of their class, into blocks of about `block` classes; a node of many members becomes pairs of blocks, so no task
gets a whole node, and counting stays exact. A pair that meets in several tries counts in the first one only; texts go only to blocks that
own such a pair. Every pair is verified with the whole shingle sets; what leaves a task is, per class and block, a number of links and one edge per
class of a spanning forest, never the pairs. Links form connected components by alternating large-star and
small-star rounds on checkpointed edges.

Defined cases: null, empty and blank texts have no shingles and no links, each is its own class; repeated rows are copies and link to each
other; null ids are kept, and class ids ignore them; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed, mapped, pieces, restrict, spread, text_key, text_of, texts
from ._words import SPACED, Words, grams, mix

TREES, LABEL = 24, 6
#: Bytes of a leaf: the trie's number and its label.
LEAF = 1 + 2 * LABEL


class Search:
    """How deep a class is searched in each trie."""

    def __init__(self, threshold: float, recall: float, crowd: int) -> None:
        self.crowd, self.target = crowd, -math.log(1 - recall)
        #: What a trie adds to the recall (as minus the logarithm of what is missed) at each depth.
        self.gain = np.array([0.0] + [-math.log(1 - threshold**d) if threshold < 1 else math.inf for d in range(1, LABEL + 1)])
        enough = [d for d in range(1, LABEL + 1) if TREES * self.gain[d] >= self.target]
        if not enough:
            raise ValueError(f"{TREES} tries find less than {recall} of the pairs at {threshold}")
        self.least = max(1, enough[-1] - 1)

    def recall(self, depths: np.ndarray) -> np.ndarray:
        """The recall of a partner at the threshold, for rows of depths."""
        return 1 - np.exp(-self.gain[depths].sum(axis=1))

    def depths(self, sizes: np.ndarray) -> np.ndarray:
        """Depths (class, trie) for sizes of the nodes (class, trie, depth from the least one on)."""
        roomy = (sizes <= self.crowd).sum(axis=2)  # deeper nodes are no larger
        stop = np.where(roomy > 0, LABEL + 1 - roomy, LABEL)
        out = np.full(stop.shape, LABEL)
        short = np.arange(len(out))
        for level in range(LABEL, self.least - 1, -1):
            out[short] = np.maximum(level, stop[short])
            short = short[self.gain[out[short]].sum(axis=1) < self.target]
        for i in short.tolist():
            while self.gain[out[i]].sum() < self.target:
                shorter = [(int(sizes[i, t, d - 1 - self.least]), t) for t, d in enumerate(out[i].tolist()) if d > self.least]
                out[i, min(shorter)[1]] -= 1
        return out


def shingles(batch: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words(batch, SPACED)
    runs = grams(words.hashes, n)
    out = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        out.append(np.unique(runs[a : b - n + 1]) if b - a >= n else grams(words.hashes[a:b], b - a) if b > a else runs[:0])
    return out


_RNG = np.random.Generator(np.random.PCG64(40))
_MUL = _RNG.integers(0, 2**31, (TREES, LABEL), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 2**32, (TREES, LABEL), dtype=np.uint32)


def labels(shingle_set: np.ndarray, block: int = 512) -> np.ndarray:
    """The label of a set in each trie: 16 bits of each MinHash."""
    low = (shingle_set >> np.uint64(32)).astype(np.uint32)
    best = np.full(TREES * LABEL, 2**32 - 1, np.uint32)
    times, plus = _MUL.reshape(-1, 1), _ADD.reshape(-1, 1)
    for a in range(0, len(low), block):
        h = low[None, a : a + block] * times
        h ^= plus
        np.minimum(best, h.min(axis=1), out=best)
    return (best * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16).reshape(TREES, LABEL)


_TREE = np.arange(TREES, dtype=np.uint8)[:, None]


def leaves(label: np.ndarray) -> bytes:
    """The leaves of a class, one after another: bytes that sort as (trie, label) does."""
    return np.hstack([_TREE, label.astype(">u2").view(np.uint8)]).tobytes()


def label_of(raw: list[bytes]) -> np.ndarray:
    """Labels (class, trie, MinHash) from leaves."""
    return np.ascontiguousarray(np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), TREES, LEAF)[:, :, 1:]).view(">u2").astype(np.uint16)


def prefix_codes(label: np.ndarray) -> np.ndarray:
    """A 64-bit code of each prefix: (class, trie, depth - 1)."""
    out = np.empty(label.shape, np.uint64)
    key = np.zeros(label.shape[:2], np.uint64)
    for i in range(LABEL):
        out[:, :, i] = key = mix(key * np.uint64(0x9E3779B97F4A7C15) + label[:, :, i].astype(np.uint64) + np.uint64(1))
    return out


def sketch(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(id, text_key, set_key, n, leaves) of every row; set_key is null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(2), 2 << 20):
                sets = shingles(texts(batch.column(2).slice(a, b - a)), n)
                both = [None if not len(s) else np.array([s.sum(), mix(s).sum() + np.uint64(len(s))], np.uint64).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.array(both, pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([leaves(labels(s)) if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["id", "text_key", "set_key", "n", "leaves"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_key(text_of(text_col)).alias("text_key"), text_of(text_col).alias("text"))
    return rows.transform(mapped, run, f"id {kind}, text_key binary, set_key binary, n long, leaves binary")


def walk(leaf: np.ndarray, least: int) -> np.ndarray:
    """Sizes of the nodes over each of some sorted leaves (rows of bytes), by depth from the least one on."""
    differs = leaf[1:] != leaf[:-1]
    common = np.where(differs.any(axis=1), (differs.argmax(axis=1) - 1) // 2, LABEL)  # of neighbours; -1 in other tries
    out = np.empty((len(leaf), LABEL + 1 - least), np.int64)
    for k, depth in enumerate(range(least, LABEL + 1)):
        edges = np.r_[0, np.flatnonzero(common < depth) + 1, len(leaf)]
        out[:, k] = np.repeat(np.diff(edges), np.diff(edges))
    return out


def sized(classes: DataFrame, least: int) -> DataFrame:
    """(leaf, cls, n, sizes) of the leaves that are not alone under their node of the least depth."""
    depths = range(least, LABEL + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        begun = False

        def done(part: pa.RecordBatch, leaf: np.ndarray, at_end: bool) -> pa.RecordBatch:
            """Sizes of runs that an end of the task cuts are negative; `leads` has a bit for each that begins at the row."""
            sizes = walk(leaf, least)
            leads = np.zeros(len(leaf), np.int32)
            for k in range(sizes.shape[1]):
                whole = sizes[:, k].copy()
                if not begun:
                    sizes[: whole[0], k] *= -1
                    leads[0] |= 1 << k
                if at_end and (begun or whole[0] < len(leaf)):
                    sizes[len(leaf) - whole[-1] :, k] *= -1
                    leads[len(leaf) - whole[-1]] |= 1 << k
            some = np.flatnonzero((sizes[:, 0] > 1) | (sizes < 0).any(axis=1))
            flat = pa.array(sizes[some].ravel(), pa.int64())
            edges = pa.array(np.arange(len(some) + 1) * sizes.shape[1], pa.int32())
            part = part.take(pa.array(some))
            return pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.ListArray.from_arrays(edges, flat), pa.array(leads[some])], ["leaf", "cls", "n", "sizes", "leads"])

        def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

        def raw(part: pa.RecordBatch) -> np.ndarray:
            return np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint8).reshape(part.num_rows, LEAF)

        for batch in batches:
            if not batch.num_rows:
                continue
            # the last run of the least depth may go on in the next batch
            last = raw(batch.slice(batch.num_rows - 1))[0, : 1 + 2 * least]
            own = raw(batch)[:, : 1 + 2 * least]
            cut = batch.num_rows - int((own[::-1] != last).any(axis=1).argmax()) if (own != last).any() else 0
            if cut or (held and (raw(held[-1].slice(held[-1].num_rows - 1))[0, : 1 + 2 * least] != own[0]).any()):
                part = joined([*held, batch.slice(0, cut)]) if cut else joined(held)
                yield done(part, raw(part), False)
                held, begun = [], True
            held.append(batch.slice(cut))
        if held:
            part = joined(held)
            yield done(part, raw(part), True)

    size = 2 * LABEL + 1
    rows = classes.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substring(F.col("leaves"), t * size + 1, F.lit(size)))).alias("leaf"), "cls", "n")
    rows = rows.repartitionByRange("leaf", "cls").sortWithinPartitions("leaf", "cls")
    found = checkpointed(rows.transform(mapped, run, "leaf binary, cls long, n long, sizes array<long>, leads int"))
    # runs cut by the ends of tasks: two for each task and depth, whatever the number of classes
    cut = None
    for k, depth in enumerate(depths):
        one = found.filter(F.col("leads").bitwiseAND(1 << k) != 0).select(F.substring("leaf", 1, 1 + 2 * depth).alias("prefix"), (-F.col("sizes")[k]).alias("size"))
        cut = one if cut is None else cut.unionByName(one)
    cut = checkpointed(cut.groupBy("prefix").agg(F.sum("size").alias("size")))
    sizes = []
    for k, depth in enumerate(depths):
        own = cut.select(F.col("prefix").alias(f"prefix{k}"), F.col("size").alias(f"size{k}"))
        found = found.join(F.broadcast(own), (F.col("sizes")[k] < 0) & (F.substring("leaf", 1, 1 + 2 * depth) == F.col(f"prefix{k}")), "left")
        sizes.append(F.coalesce(f"size{k}", F.col("sizes")[k]))
    return found.select("leaf", "cls", "n", F.array(*sizes).alias("sizes")).filter(F.col("sizes")[0] > 1)


def seats(held: DataFrame, search: Search) -> DataFrame:
    """(node, cls, n, asks, depths): the nodes that a class may be found in or (asks) ends its search in."""
    least = search.least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = batch.column("where").to_pylist()
            sizes = np.ones((len(where), TREES, LABEL + 1 - least), np.int64)
            for i, found in enumerate(where):
                for x in found:
                    sizes[i, x["leaf"][0]] = x["sizes"]
            depths = search.depths(sizes)
            rows = [
                (x["leaf"][: 1 + 2 * d], cls, n, d == own[x["leaf"][0]], own)
                for cls, n, found, own in zip(batch.column("cls").to_pylist(), batch.column("n").to_pylist(), where, map(bytes, depths.astype(np.uint8)), strict=True)
                for x in found
                for d in range(least, own[x["leaf"][0]] + 1)
                if x["sizes"][d - least] > 1
            ]
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], ["node", "cls", "n", "asks", "depths"]
                )

    whole = held.groupBy("cls").agg(F.first("n").alias("n"), F.collect_list(F.struct("leaf", "sizes")).alias("where"))
    return whole.transform(mapped, run, "node binary, cls long, n long, asks boolean, depths binary")


BLOCK_KEY = ("node", "left", "right")


def asked_blocks(seated: DataFrame, block: int, block_shingles: int) -> DataFrame:
    """(node, left, right, mine, cls, depths): members dealt to pairs of blocks, of the nodes in which a class ends its search and is not alone."""
    nodes = seated.groupBy("node").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total"), F.max("asks").alias("asked")).filter("members > 1 and asked")
    held = seated.join(checkpointed(nodes), "node")
    parts = F.ceil(F.greatest(F.col("members") / F.lit(block), F.col("total") / F.lit(block_shingles))).cast("int")
    mine = F.pmod(F.xxhash64("cls"), parts.cast("long")).cast("int")
    held = held.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return held.select("node", F.least("mine", "other").alias("left"), F.greatest("mine", "other").alias("right"), "mine", "cls", "depths")


def owned_pairs(at: tuple[bytes, int, int], mine: np.ndarray, codes: np.ndarray, depths: np.ndarray, n: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs this pair of blocks has to verify: of fitting sizes, that meet in this node and in no trie before."""
    node, left, right = at
    tree, depth = node[0], (len(node) - 1) // 2
    wanted = (mine[:, None] == left) & (mine[None, :] == right)
    wanted |= wanted.T
    np.fill_diagonal(wanted, False)
    wanted &= np.minimum(n[:, None], n[None, :]) + 1e-9 >= threshold * np.maximum(n[:, None], n[None, :])
    ends = depths[:, tree] == depth
    wanted &= ends[:, None] | ends[None, :]
    for t in range(tree):
        shorter = np.minimum(depths[:, None, t], depths[None, :, t])
        for d in np.unique(depths[:, t]).tolist():
            same = codes[:, None, t, d - 1] == codes[None, :, t, d - 1]
            wanted &= ~(same & (shorter == d))
    return wanted


def grouped(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], of_text: int | None = None) -> Iterator[tuple[tuple[bytes, int, int], list[tuple]]]:
    """Rows of each pair of blocks, in partitions sorted by it; with of_text, the shingle sets of their texts come last."""
    held: list[tuple] = []
    at = None
    for batch in batches:
        for a, b in pieces(batch.column("text"), 2 << 20) if of_text else [(0, batch.num_rows)]:
            part = batch.slice(a, b - a)
            values = [part.column(c).to_pylist() for c in (*BLOCK_KEY, *columns)]
            if of_text:
                values.append(shingles(texts(part.column("text")), of_text))
            for row in zip(*values, strict=True):
                if row[:3] != at:
                    if len(held) > 1:
                        yield at, held
                    held, at = [], row[:3]
                held.append(row[3:])
    if len(held) > 1:
        yield at, held


def candidates(blocks: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The rows of blocks that take part in a pair to be verified there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, held in grouped(batches, ("mine", "cls", "n", "leaves", "depths")):
            mine, names, n, raw, depths = zip(*held, strict=True)
            found = owned_pairs(at, np.array(mine), prefix_codes(label_of(raw)), depths_of(depths), np.array(n), threshold)
            some = np.flatnonzero(found.any(axis=1)).tolist()
            if some:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([at[0]] * len(some), pa.binary()),
                        pa.array([at[1]] * len(some), pa.int32()),
                        pa.array([at[2]] * len(some), pa.int32()),
                        pa.array([mine[i] for i in some], pa.int32()),
                        pa.array([names[i] for i in some], pa.int64()),
                        pa.array([depths[i] for i in some], pa.binary()),
                    ],
                    [*BLOCK_KEY, "mine", "cls", "depths"],
                )

    dealt = blocks.join(classes.select("cls", "n", "leaves"), "cls").repartition(*BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY)
    return dealt.select(*BLOCK_KEY, "mine", "cls", "n", "leaves", "depths").transform(mapped, run, "node binary, left int, right int, mine int, cls long, depths binary")


def depths_of(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), TREES)


def overlap(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections, from the shingles that two sets or more hold."""
    m = len(sets)
    if m == 2:
        return np.array([[0, n := len(np.intersect1d(*sets, assume_unique=True))], [n, 0]], np.int64)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.r_[True, flat[1:] != flat[:-1]]
    number = np.cumsum(fresh) - 1
    shared = np.bincount(number)[number] > 1
    owner, number = owner[shared], number[shared]
    if not len(owner):
        return np.zeros((m, m), np.int64)
    number = np.cumsum(np.r_[True, number[1:] != number[:-1]]) - 1
    total = np.zeros((m, m), np.float32)
    for a in range(0, int(number[-1]) + 1, columns):
        lo, hi = np.searchsorted(number, [a, a + columns])
        part = np.zeros((m, min(columns, int(number[-1]) + 1 - a)), np.float32)
        part[owner[lo:hi], number[lo:hi] - a] = 1
        total += part @ part.T
    return total.astype(np.int64)


def spanning(rows: np.ndarray, columns: np.ndarray, m: int) -> np.ndarray:
    """The least member of each member's component under the given links."""
    root = np.arange(m)
    while True:
        low = np.minimum(root[rows], root[columns])
        new = root.copy()
        np.minimum.at(new, rows, low)
        np.minimum.at(new, columns, low)
        np.minimum.at(new, root[rows], low)
        np.minimum.at(new, root[columns], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def verify(
    at: tuple[bytes, int, int], mine: np.ndarray, codes: np.ndarray, depths: np.ndarray, sets: list[np.ndarray], size: np.ndarray, threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """(links of each member, weighted by class sizes; least linked member) among the pairs that this pair of blocks owns."""
    n = np.array([len(s) for s in sets])
    wanted = owned_pairs(at, mine, codes, depths, n, threshold)
    if not wanted.any():
        return np.zeros(len(sets), np.int64), np.arange(len(sets))
    common = overlap(sets)
    linked = wanted & (common >= threshold * (n[:, None] + n[None, :] - common) - 1e-9)
    rows, columns = np.nonzero(linked)
    return linked @ size, spanning(rows, columns, len(sets))


def components(edges: DataFrame) -> DataFrame:
    """(rep, root): the least vertex of each vertex's component, for edges (a, b).

    A round that leaves the number of edges and the exclusive or of their hashes alone has changed none.
    """

    def stamp(found: DataFrame) -> tuple[int, int | None]:
        return tuple(found.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = stamp(edges)
    while True:
        # large star: larger neighbours move to the least neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        large = both.join(spread(least), "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        # small star: smaller neighbours, and the vertex, move to the least neighbour
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(spread(low), "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b")
        edges = checkpointed(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct())
        now = stamp(edges)
        if now == before:
            return edges.groupBy(F.col("a").alias("rep")).agg(F.min("b").alias("root"))
        before = now


def jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.99999, block: int = 256, block_shingles: int = 400_000, crowd: int = 32
) -> DataFrame:
    """One row per input row: id_col, class_id (least id of its connected component), n_links (other rows with similarity at least
    the threshold), copies (rows with the same shingle set), text_key, class_key (a number of the component; null without shingles).
    """
    search = Search(threshold, recall, crowd)
    rows = checkpointed(sketch(docs, id_col, text_col, n))
    full = rows.filter("set_key is not null")
    classes = full.groupBy("set_key").agg(F.min_by(F.struct("text_key", "n", "leaves"), "text_key").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    classes = checkpointed(classes.select(F.monotonically_increasing_id().alias("cls"), "set_key", "rep.text_key", "rep.n", "rep.leaves", "copies", "least"))
    seated = checkpointed(seats(sized(classes, search.least), search))
    blocks = checkpointed(candidates(asked_blocks(seated, block, block_shingles), classes, threshold))
    wanted = checkpointed(classes.select("cls", "text_key", "leaves", "copies").join(spread(blocks.select("cls").distinct()), "cls", "left_semi"))
    # whole texts of the classes to verify, one row each
    chosen = docs.select(text_key(text_of(text_col)).alias("text_key"), text_of(text_col).alias("text"))
    chosen = restrict(chosen, wanted.select("text_key"), "text_key").groupBy("text_key").agg(F.first("text").alias("text"))
    chosen = chosen.join(wanted, "text_key").drop("text_key")
    dealt = blocks.join(chosen, "cls").repartition(*BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY, "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, held in grouped(batches, ("mine", "cls", "leaves", "depths", "copies"), n):
            mine, names, raw, depths, copies, sets = zip(*held, strict=True)
            links, root = verify(at, np.array(mine), prefix_codes(label_of(raw)), depths_of(depths), list(sets), np.array(copies), threshold)
            some = np.flatnonzero(links).tolist()
            if some:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[i] for i in some], pa.int64()), pa.array([names[root[i]] for i in some], pa.int64()), pa.array(links[some], pa.int64())], ["a", "b", "links"]
                )

    linked = checkpointed(dealt.select(*BLOCK_KEY, "mine", "cls", "leaves", "depths", "copies", "text").transform(mapped, run, "a long, b long, links long"))
    links = linked.groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    roots = components(linked.select("a", "b"))
    classes = classes.drop("leaves", "n", "text_key").join(links, "cls", "left").join(roots.withColumnRenamed("rep", "cls"), "cls", "left")
    classes = checkpointed(classes.select("set_key", "copies", "least", F.coalesce("root", "cls").alias("root"), F.coalesce("links", F.lit(0)).alias("links")))
    leasts = classes.groupBy("root").agg(F.min("least").alias("class_id"))
    classes = classes.join(spread(leasts), "root").select("set_key", "copies", "class_id", "links", F.col("root").alias("class_key"))
    out = rows.select("id", "text_key", "set_key").join(classes, "set_key", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("set_key").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        "text_key",
        "class_key",
    )
