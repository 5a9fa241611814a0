"""Benchmark decontamination with an FM-index per training shard.

Words are runs of digits, letters and non-ASCII characters, A-Z lowered. A shard is some MB of whole documents. Over all its words,
in an alphabet of its own with a separator after each document, stand a suffix array (prefix doubling on what is not yet told apart),
its Burrows-Wheeler transform, a wavelet matrix for ranks, and suffix positions sampled at every 32nd place. The index depends
on the shard alone; it is built once and all test phrases are searched backward in it, many at a time. Occurrences are located
by walking to sampled rows; their spans are merged.

Phrases: 13 consecutive words of an item, or all words of a shorter item. Tasks write them in blocks of bounded size to the shared
checkpoint folder; the driver sees the blocks' names only. A worker keeps the last KEPT blocks, so a benchmark of up to so
many is read once per worker, and a larger one once per shard. Words are compared by 64-bit hashes.

Defined cases: null and empty texts have no words and no hits; an item without words is no phrase; items with a null id are
searched but not listed; items that repeat count once per id; an empty table gives an empty result; an empty benchmark gives no hits; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import mapped, pieces, scratch, texts
from ._words import ALNUM, LOWER, Words, grams
from .warc import filesystem

SAMPLE = 32
#: Blocks of test phrases that a worker keeps in memory.
KEPT = 4
#: Symbols below those of words: the end of a shard, and of a document.
END, SEPARATOR, FIRST = 0, 1, 2


class Phrases:
    """Test phrases of some benchmark items, by length, in numbers of their alphabet."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int) -> None:
        found = Words([t.translate(LOWER) for _, t in items], ALNUM)
        self.alphabet, codes = np.unique(found.hashes, return_inverse=True)
        codes = codes.astype(np.int32)
        self.names = [item for item, _ in items]
        grouped: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for i, (a, b) in enumerate(zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist(), strict=True)):
            if b > a:
                size = min(window, b - a)
                grouped[size].append((i, a, b - size + 1))
        #: For each length: phrases as rows of codes; numbers of items, those of row k from `begins[k]` to `begins[k + 1]`.
        self.by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for size, spans in sorted(grouped.items()):
            starts = np.concatenate([np.arange(a, b) for _, a, b in spans])
            owner = np.repeat([i for i, _, _ in spans], [b - a for _, a, b in spans])
            _, first, row = np.unique(grams(found.hashes, size)[starts], return_index=True, return_inverse=True)
            held = np.unique(np.stack([row, owner]), axis=1)
            self.by_length.append((codes[starts[first][:, None] + np.arange(size)], held[1], np.searchsorted(held[0], np.arange(len(first) + 1))))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the sorted suffixes of a text whose last symbol occurs once. Prefix doubling; what is told apart is left alone."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    new = np.r_[True, text[order[1:]] != text[order[:-1]]]
    slot = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # the first place of each group of equal prefixes
    rank = np.empty(n, np.int64)
    rank[order] = slot
    step = 1
    while True:
        alone = new & np.r_[new[1:], True]
        open_places = np.flatnonzero(~alone)
        if not len(open_places):
            return order
        some = order[open_places]
        key = rank[some] * (n + 1) + rank[np.minimum(some + step, n - 1)]
        by = np.argsort(key, kind="stable")
        some, key = some[by], key[by]
        order[open_places] = some
        heads = np.r_[True, key[1:] != key[:-1]]
        new[open_places] = heads
        rank[some] = np.maximum.accumulate(np.where(heads, open_places, 0))
        step *= 2


class FMIndex:
    """Backward search and location in a text of symbols from FIRST on (and separators)."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        text = np.r_[symbols, END].astype(np.int64)
        order = suffix_array(text)
        self.bwt = text[order - 1].astype(np.int32)
        self.n, self.bits = len(text), max(1, int(FIRST + sigma).bit_length())
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=FIRST + sigma + 1))]
        self.levels: list[tuple[np.ndarray, int]] = []  # ones before each place, number of zeros
        left = self.bwt
        for level in range(self.bits - 1, -1, -1):
            bit = ((left >> level) & 1).astype(bool)
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((ones, self.n - int(ones[-1])))
            left = np.concatenate([left[~bit], left[bit]])
        marked = order % SAMPLE == 0
        self.marks = np.r_[0, np.cumsum(marked)]
        self.sampled = order[marked]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place of the transform."""
        start, stop = np.zeros(len(at), np.int64), at.astype(np.int64)
        for level, (ones, zeros) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            bit = (symbol >> level) & 1
            a, b = ones[start], ones[stop]
            start, stop = np.where(bit, zeros + a, start - a), np.where(bit, zeros + b, stop - b)
        return stop - start

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array intervals of phrases (rows of symbols; -1: not in the text)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.flatnonzero((phrases >= 0).all(axis=1))
        high[(phrases < 0).any(axis=1)] = 0
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, column].astype(np.int64)
            low[live] = self.before[symbol] + self.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.rank(symbol, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows."""
        out, at, steps = np.empty(len(rows), np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            here = at[live]
            hit = self.marks[here + 1] > self.marks[here]
            done = live[hit]
            out[done] = self.sampled[self.marks[at[done]]] + steps[done]
            live = live[~hit]
            symbol = self.bwt[at[live]].astype(np.int64)
            at[live] = self.before[symbol] + self.rank(symbol, at[live])
            steps[live] += 1
        return out


class Shard:
    """The index of all words of some texts."""

    def __init__(self, words: Words) -> None:
        lengths = np.diff(words.bounds)
        place = np.arange(len(words)) + np.repeat(np.arange(len(lengths)), lengths)
        self.alphabet, codes = np.unique(words.hashes, return_inverse=True)
        symbols = np.full(len(words) + len(lengths), SEPARATOR, np.int32)
        symbols[place] = codes + FIRST
        self.word = np.zeros(len(symbols), np.int64)  # the word at a place
        self.word[place] = np.arange(len(words))
        self.index = FMIndex(symbols, len(self.alphabet)) if len(words) else None

    def occurrences(self, phrases: Phrases, at_once: int = 1 << 18) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first words of occurrences, phrase length, phrase row of each, numbers of items, where a row's begin)."""
        if self.index is None or not phrases.by_length:
            return
        near = np.minimum(np.searchsorted(self.alphabet, phrases.alphabet), len(self.alphabet) - 1)
        symbol = np.where(self.alphabet[near] == phrases.alphabet, near + FIRST, -1).astype(np.int32)
        for rows, items, begins in phrases.by_length:
            for first in range(0, len(rows), at_once):
                low, high = self.index.search(symbol[rows[first : first + at_once]])
                total = np.cumsum(high - low)
                for a in range(0, int(total[-1]), at_once):
                    nth = np.arange(a, min(a + at_once, int(total[-1])))
                    which = np.searchsorted(total, nth, side="right")
                    places = self.index.locate(low[which] + nth - (total[which] - (high - low)[which]))
                    yield self.word[places], rows.shape[1], which + first, items, begins


def removal_spans(covered: np.ndarray) -> list[tuple[int, int]]:
    """Merged spans (first word, words) of a mask."""
    edges = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return list(zip(edges[0::2].tolist(), (edges[1::2] - edges[0::2]).tolist(), strict=True))


@lru_cache(maxsize=KEPT)
def load(folder: str, block: str) -> Phrases:
    system, base = filesystem(folder)
    with system.open_input_stream(f"{base}/{block}", compression=None) as file:
        return pickle.loads(file.read())


def store_phrases(benchmark: DataFrame, folder: str, id_col: str, text_col: str, window: int, block_bytes: int) -> list[str]:
    """Writes the test phrases, by tasks, in blocks of about block_bytes of text; the blocks' names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(folder)
        held: list[tuple[str | None, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            name = f"phrases-{uuid.uuid4().hex}"  # of a task that runs twice, one attempt's names come back
            with system.open_output_stream(f"{base}/{name}", compression=None) as file:
                file.write(pickle.dumps(Phrases(held, window)))
            return pa.RecordBatch.from_pydict({"block": [name]})

        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                held.append((item, text))
                size += len(text)
                if size >= block_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    rows = benchmark.select(benchmark[id_col].cast("string").alias("item"), benchmark[text_col].cast("string").alias("text")).filter("text <> ''")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    found = rows.repartition(max(1, -(-int(total) // block_bytes))).transform(mapped, run, "block string")
    return sorted(r["block"] for r in found.collect())


class Judgement:
    """What the test phrases hit in a shard of texts."""

    def __init__(self, body: list[bytes], folder: str, blocks: list[str], share: int) -> None:
        words = Words([t.translate(LOWER) for t in body], ALNUM)
        shard = Shard(words) if blocks else None
        change = np.zeros(len(words) + 1, np.int64)
        self.items: dict[int, set[str]] = defaultdict(set)
        for block in blocks:
            phrases = load(folder, block)
            for first, size, which, items, begins in shard.occurrences(phrases):
                np.add.at(change, first, 1)
                np.add.at(change, first + size, -1)
                doc = np.searchsorted(words.bounds, first, side="right") - 1
                for d, w in np.unique(np.stack([doc, which]), axis=1).T.tolist():
                    self.items[d].update(x for i in items[begins[w] : begins[w + 1]].tolist() if (x := phrases.names[i]) is not None)
        self.words, self.bounds, self.covered = words, words.bounds, np.cumsum(change[:-1]) > 0
        self.begins = np.cumsum([0] + [len(t) + 1 for t in body])
        self.n_words = np.diff(words.bounds)
        self.n_hit = np.diff(np.r_[0, np.cumsum(self.covered)][words.bounds])
        self.contaminated = (self.n_hit > 0) & (share * self.n_hit >= self.n_words)

    def spans(self) -> list[list[dict[str, int]]]:
        ranges = zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), self.n_hit.tolist(), strict=True)
        return [[{"first": f, "words": w} for f, w in removal_spans(self.covered[a:b])] if n else [] for a, b, n in ranges]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = 13, share: int = 20, shard_bytes: int = 3 << 20, block_bytes: int = 4 << 20
) -> DataFrame:
    """Per row: id_col, n_words, n_hit, n_items, items_sha256, contaminated, spans (first word, words)."""
    folder = scratch(docs.sparkSession, "phrases")
    blocks = store_phrases(benchmark, folder, item_col, "text", window, block_bytes)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(1), shard_bytes):
                found = Judgement(texts(batch.column(1).slice(a, b - a)), folder, blocks, share)
                listed = [sorted(found.items.get(i, ())) for i in range(b - a)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(found.n_words, pa.int64()),
                        pa.array(found.n_hit, pa.int64()),
                        pa.array([len(x) for x in listed], pa.int64()),
                        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in listed]),
                        pa.array(found.contaminated),
                        pa.array(found.spans(), pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))),
                    ],
                    [id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
                )

    schema = f"`{id_col}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<first: long, words: long>>"
    return docs.select(id_col, text_col).transform(mapped, run, schema)


def without_passages(body: list[bytes], found: Judgement, which: list[int]) -> list[bytes]:
    """The texts `which` without their removal spans, from each span's first word to its last."""
    out = []
    for i in which:
        text, begin, first = body[i], int(found.begins[i]), int(found.bounds[i])
        for at, n in reversed(removal_spans(found.covered[first : found.bounds[i + 1]])):
            text = text[: found.words.starts[first + at] - begin] + text[found.words.ends[first + at + n - 1] - begin :]
        out.append(text)
    return out


def cut_until_clean(body: list[bytes], found: Judgement, which: list[int], judge: Callable[[list[bytes]], Judgement]) -> dict[int, bytes]:
    """Number -> text of the texts `which`, cut again should a cut have brought a phrase together."""
    out: dict[int, bytes] = {}
    numbers = which
    while which:
        body = without_passages(body, found, which)
        out.update(zip(numbers, body, strict=True))
        found = judge(body)
        which = np.flatnonzero(found.n_hit).tolist()
        numbers = [numbers[k] for k in which]
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", window: int = 13, share: int = 20, shard_bytes: int = 3 << 20, block_bytes: int = 4 << 20, length_col: str = "n_chars") -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns. Rows with fewer hits lose the spans that are hit (and length_col,
    if there is one, follows); all others stay as they are.
    """
    folder = scratch(docs.sparkSession, "phrases")
    blocks = store_phrases(benchmark, folder, item_col, "text", window, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(text_col), shard_bytes):
                part = batch.slice(a, b - a)
                body = texts(part.column(text_col))
                found = Judgement(body, folder, blocks, share)
                some = np.flatnonzero(~found.contaminated & (found.n_hit > 0)).tolist()
                edited = cut_until_clean(body, found, some, lambda x: Judgement(x, folder, blocks, share))
                if edited:
                    columns = {c: part.column(c) for c in part.schema.names}
                    plain = part.column(text_col).to_pylist()
                    lengths = part.column(length_col).to_pylist() if length_col in columns else None
                    for i, text in edited.items():
                        plain[i] = text.decode()
                        if lengths is not None:
                            lengths[i] = len(plain[i])
                    columns[text_col] = pa.array(plain, part.column(text_col).type)
                    if lengths is not None:
                        columns[length_col] = pa.array(lengths, part.column(length_col).type)
                    part = pa.RecordBatch.from_arrays(list(columns.values()), schema=part.schema)
                kept = part.filter(pa.array(~found.contaminated))
                if kept.num_rows:
                    yield kept

    return docs.transform(mapped, run, docs.schema)
