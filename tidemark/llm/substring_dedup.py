"""Substring dedup by recompression.

A word inside a window of `WINDOW` consecutive words whose sequence also starts earlier (smaller id, then earlier start, then smaller
text key, for texts that share an id or have none) is removed; windows are judged on the input.

Recompression: a text is a row of symbols, at first its words. A round names every run of equal symbols, then pairs symbols of the
left side with following ones of the right side (a bit of the name tells the side) and names the pairs. A name is a hash of what the
symbol is made of, so equal stretches have equal names everywhere. Each symbol knows its region: the words that settle that it is a
symbol at all. Wherever the words of the region come again, the symbol does; so the symbols whose region lies in
a window (its interior symbols) are the same wherever the window's words occur.

Each of `ROUNDS` Spark rounds has three steps:

1. Tasks send the names that the round made, once per shard of texts, by hash bucket, with whether a name has several places there.
2. The global table of a bucket counts the places of each name over all shards and answers, a bit per name: has it two places or more?
3. Back at its shard, a name of one place ends all windows that it is interior to: their words occur once. Of the
   texts, only the stretches of windows that are left go on to the next round, which works on longer symbols.

In what is left each window is made of interior symbols that have other places, too. These windows are verified: hashed in full and
sent by hash bucket; all but the first occurrence of a window come back as starts, which meet their texts and cover words.

Shards travel as compressed rows of bounded size, bucket by bucket names are columns of 4 bytes (the bucket's number tells more: a
bucket gets a bounded share of the names whatever the input, so clashes stay rare; a clash only spares a window until it is
verified). A name that is everywhere arrives once per shard. Copies of a whole text are settled from a table of text keys: all but the
first are removed whole (if they have a window), and only one text of each group is searched. Whole texts are not shuffled but those
that lose words (up to BROADCAST_ROWS texts their keys are broadcast; beyond, texts are joined by shuffle).

Defined cases: null, empty and blank texts have no words; texts under WINDOW words lose none; null ids come last; rows that
repeat id and text are one occurrence, and each gets the same result; ids are whole numbers; an empty table gives an empty result; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed, forget, mapped, restrict, scratch, spread, text_key, text_of, texts
from ._words import SPACED, Words, grams, mix

WINDOW, ROUNDS = 20, 3
NO_ID = 2**63 - 1
#: Beyond every word: the region of a symbol that the end of its text helps to settle.
FAR = 1 << 29
_U = np.uint64


class Symbols:
    """The symbols of some texts, over all their words: first words, names, and regions [low, high) of words."""

    def __init__(self, words: Words) -> None:
        self.words = words
        self.at = np.arange(len(words), dtype=np.int32)
        self.names, self.low, self.high = words.hashes, self.at, self.at + 1
        self.made = np.ones(len(words), bool)  # in the last round
        self.level = 0
        self._opens = np.zeros(len(words) + 1, bool)
        self._opens[words.bounds] = True

    def _edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether a symbol is the first, the last of its text."""
        first = self._opens[self.at]
        return first, np.r_[first[1:], True][: len(first)]

    def round(self) -> Symbols:
        """Names runs, then pairs."""
        self.level += 1
        self.made = np.zeros(len(self.at), bool)
        if len(self.at):
            self._runs()
            self._pairs()
        return self

    def _runs(self) -> None:
        first, last = self._edges()
        names, word = self.names, self.words.hashes
        head = np.flatnonzero(np.r_[True, names[1:] != names[:-1]] | first)
        tail = np.r_[head[1:], len(names)] - 1
        size = tail - head + 1
        ends = np.r_[self.at[1:], len(word)]  # beyond each symbol
        low, high = np.minimum.reduceat(self.low, head), np.maximum.reduceat(self.high, head)
        # the symbol before a run differs: one word tells, if its last word differs; else its whole region does
        some = np.flatnonzero(~first[head])
        before = head[some] - 1
        tells = word[self.at[head[some]] - 1] != word[ends[head[some]] - 1]
        low[some] = np.minimum(low[some], np.where(tells, self.at[head[some]] - 1, self.low[before]))
        high[some] = np.maximum(high[some], np.where(tells, 0, self.high[before]))
        some = np.flatnonzero(~last[tail])
        after = tail[some] + 1
        tells = word[self.at[after]] != word[self.at[tail[some]]]
        high[some] = np.maximum(high[some], np.where(tells, self.at[after] + 1, self.high[after]))
        low[some] = np.minimum(low[some], np.where(tells, FAR, self.low[after]))
        low[first[head]], high[last[tail]] = -FAR, FAR
        named = np.where(size > 1, mix(names[head] * _U(0xA0761D6478BD642F) + size.astype(_U) * _U(0xE7037ED1A0B428DB) + _U(self.level)), names[head])
        self.at, self.names, self.low, self.high, self.made = self.at[head], named, low, high, size > 1

    def _pairs(self) -> None:
        first, last = self._edges()
        names, low, high = self.names, self.low.copy(), self.high.copy()
        right = (mix(names + _U(self.level * 0x9E3779B97F4A7C15 % (1 << 64))) >> _U(63)).astype(bool)
        joins = np.zeros(len(names), bool)  # with the symbol before
        joins[1:] = ~right[:-1] & right[1:] & ~first[1:]
        paired = np.r_[joins[1:], False]
        # a symbol that stays alone on the left side is settled by the one after it, on the right side by the one before
        alone = ~joins & ~paired
        some = np.flatnonzero(alone & ~right & ~last)
        low[some], high[some] = np.minimum(low[some], self.low[some + 1]), np.maximum(high[some], self.high[some + 1])
        some = np.flatnonzero(alone & right & ~first)
        low[some], high[some] = np.minimum(low[some], self.low[some - 1]), np.maximum(high[some], self.high[some - 1])
        high[alone & ~right & last], low[alone & right & first] = FAR, -FAR
        head = np.flatnonzero(paired)
        named, made = names.copy(), self.made.copy()
        named[head] = mix(names[head] * _U(0xD6E8FEB86659FD93) + names[head + 1] + _U(self.level + 7))
        low[head], high[head], made[head] = np.minimum(low[head], low[head + 1]), np.maximum(high[head], high[head + 1]), True
        stay = ~joins
        self.at, self.names, self.low, self.high, self.made = self.at[stay], named[stay], low[stay], high[stay], made[stay]


class Stretches:
    """Stretches of texts of a shard: ids, short text keys, numbers of their first words, bodies."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, offsets: np.ndarray, bodies: list[bytes]) -> None:
        self.ids, self.keys, self.offsets, self.bodies = ids, keys, offsets, bodies
        self.words = Words(bodies, SPACED)

    def pack(self) -> bytes:
        batch = pa.RecordBatch.from_arrays([pa.array(self.ids, pa.int64()), pa.array(self.keys, pa.uint64()), pa.array(self.offsets, pa.int64()), pa.array(self.bodies, pa.large_binary())], ["id", "key", "offset", "body"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes()

    @classmethod
    def unpack(cls, raw: bytes) -> Stretches:
        found = pa.ipc.open_stream(raw).read_all().combine_chunks()
        return cls(*(found.column(c).to_numpy() for c in ("id", "key", "offset")), found.column("body").to_pylist())

    def owners(self) -> np.ndarray:
        """The number of the stretch of each word."""
        return np.repeat(np.arange(len(self.bodies)), np.diff(self.words.bounds))

    def windows(self) -> np.ndarray:
        """Whether a window of one stretch begins at each word."""
        good = np.zeros(len(self.words), bool)
        left = np.repeat(self.words.bounds[1:], np.diff(self.words.bounds)) - np.arange(len(self.words))
        good[left >= WINDOW] = True
        return good

    def cut(self, live: np.ndarray) -> Stretches:
        """The stretches of the windows that are left."""
        edges = np.flatnonzero(np.diff(live.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
        first, last = edges[0::2], edges[1::2] + WINDOW - 2
        owner = np.searchsorted(self.words.bounds, first, side="right") - 1
        begins = np.cumsum([0] + [len(x) + 1 for x in self.bodies])[owner]
        bodies = [self.bodies[o][a:b] for o, a, b in zip(owner.tolist(), (self.words.starts[first] - begins).tolist(), (self.words.ends[last] - begins).tolist(), strict=True)]
        return Stretches(self.ids[owner], self.keys[owner], self.offsets[owner] + first - self.words.bounds[owner], bodies)


class Names:
    """The names that a round made in a shard and that are interior to a window, in order: `once` tells those of one place.

    low, high: the regions of all their places, of name number `of`.
    """

    def __init__(self, shard: Stretches, level: int, buckets: int) -> None:
        found, words = Symbols(shard.words), shard.words
        for _ in range(level):
            found.round()
        wanted = found.high - found.low <= WINDOW
        if level > 1:  # the other names were judged before
            wanted &= found.made
        names, at = found.names[wanted], found.at[wanted]
        owner = np.searchsorted(words.bounds, at, side="right") - 1
        # stretches of a text may overlap: a place counts once
        place = mix(shard.keys[owner]) + (at - words.bounds[owner] + shard.offsets[owner]).astype(_U)
        order = np.lexsort((place, names)) if level > 1 else np.argsort(names)
        names, place = names[order], place[order]
        new = np.r_[True, names[1:] != names[:-1]][: len(names)]
        self.of = np.cumsum(new) - 1
        self.low = np.maximum(found.high[wanted][order] - WINDOW, words.bounds[owner][order])
        self.high = found.low[wanted][order] + 1
        fresh = new.copy()
        fresh[1:] |= place[1:] != place[:-1]
        heads = np.flatnonzero(new)
        self.once = np.bincount(self.of, fresh, len(heads)) == 1
        self.short = names[heads].astype(np.uint32)
        self.bucket = ((names[heads] >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int32)  # in the order of names

    def sent(self, shard: int) -> pa.RecordBatch:
        edges = np.flatnonzero(np.r_[True, self.bucket[1:] != self.bucket[:-1]][: len(self.bucket)])
        rows = [(int(self.bucket[a]), self.short[a:b], self.once[a:b]) for a, b in zip(edges.tolist(), np.r_[edges[1:], len(self.bucket)].tolist(), strict=True)]
        return pa.RecordBatch.from_pylist([{"bucket": k, "shard": shard, "once": s[o].tobytes(), "more": s[~o].tobytes()} for k, s, o in rows], ROUND)

    def lonely(self, answers: list[dict]) -> np.ndarray:
        """Which places hold a name that has no other place anywhere."""
        bits = [np.unpackbits(np.frombuffer(x["mask"], np.uint8), count=x["n"]) for x in sorted(answers, key=lambda x: x["bucket"])]
        shared = np.ones(len(self.once), bool)
        shared[self.once] = np.concatenate(bits) if bits else False
        return ~shared[self.of]


ROUND = pa.schema([("bucket", pa.int32()), ("shard", pa.int64()), ("once", pa.binary()), ("more", pa.binary()), ("body", pa.binary())])
ROUND_SQL = "bucket int, shard long, once binary, more binary, body binary"


def surviving(shard: Stretches, level: int, buckets: int, answers: list[dict]) -> Stretches:
    """What the answers to a round's names leave of a shard."""
    names = Names(shard, level, buckets)
    gone = names.lonely(answers)
    change = np.zeros(len(shard.words) + 1, np.int64)
    np.add.at(change, names.low[gone], 1)
    np.add.at(change, names.high[gone], -1)
    return shard.cut(shard.windows() & (np.cumsum(change[:-1]) <= 0))


def sent_round(shard: Stretches, number: int, level: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """A shard's names, and the shard itself (rows with a body)."""
    names = Names(shard, level, buckets)
    if len(names.bucket):
        yield names.sent(number)
    yield pa.RecordBatch.from_pylist([{"shard": number, "body": shard.pack()}], ROUND)


def gathered_texts(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[list[tuple[int, bytes, bytes]]]:
    """(id, text key, text) of shards of about shard_bytes: the larger a shard, the more of its names come twice in it."""
    held, size = [], 0
    for batch in batches:
        for row in zip(batch.column("id").to_pylist(), batch.column("text_key").to_pylist(), texts(batch.column("text")), strict=True):
            held.append(row)
            size += len(row[2])
            if size >= shard_bytes:
                yield held
                held, size = [], 0
    if held:
        yield held


def first_round(docs: DataFrame, buckets: int, shard_bytes: int) -> DataFrame:
    """Whole texts of a window and more, in shards, and the names of the first round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for held in gathered_texts(batches, shard_bytes):
            ids, keys, bodies = map(list, zip(*held, strict=True))
            whole_texts = Stretches(np.array(ids, np.int64), short_key(keys), np.zeros(len(ids), np.int64), bodies)
            shard = whole_texts.cut(whole_texts.windows())
            if shard.bodies:
                yield from sent_round(shard, number, 1, buckets)
                number += 1

    return docs.select("id", "text_key", "text").transform(mapped, run, ROUND_SQL)


def written(sent: DataFrame, path: str) -> DataFrame:
    """A round, written to the shared folder and read from there; the next round is all that needs it."""
    sent.write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)
    return sent.sparkSession.read.schema(ROUND_SQL).parquet(path)


def answers(sent: DataFrame, buckets: int) -> DataFrame:
    """The global table of names, asked: (shard, answers), for each bucket a bit per name of one place: whether it has another elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (shards, once, more) in gathered(batches, "bucket", ["shard", "once", "more"]):
            one, rest = (np.frombuffer(b"".join(x), np.uint32) for x in (once, more))
            names, group = np.unique(np.r_[one, rest], return_inverse=True)
            places = np.bincount(group[: len(one)], minlength=len(names)) + 2 * np.bincount(group[len(one) :], minlength=len(names))
            shared = places[group[: len(one)]] > 1
            ends = np.cumsum([len(x) // 4 for x in once])
            rows = [{"shard": s, "bucket": bucket, "n": len(x) // 4, "mask": np.packbits(shared[e - len(x) // 4 : e]).tobytes()} for s, x, e in zip(shards, once, ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("shard", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()), ("mask", pa.binary())]))

    rows = sent.filter("body is null").select("bucket", "shard", "once", "more").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return rows.transform(mapped, run, "shard long, bucket int, n int, mask binary").groupBy("shard").agg(F.collect_list(F.struct("bucket", "n", "mask")).alias("answers"))


def answered(sent: DataFrame, buckets: int) -> DataFrame:
    """(shard, body, answers): a round's shards with the answers to their names."""
    return sent.filter("body is not null").select("shard", "body").repartition(buckets, "shard").join(answers(sent, buckets), "shard", "left")


def shards(batches: Iterator[pa.RecordBatch], level: int, buckets: int) -> Iterator[tuple[int, Stretches]]:
    """(number, what is left of it) of each shard that has windows left."""
    for batch in batches:
        for i in range(batch.num_rows):
            left = surviving(Stretches.unpack(batch.column("body")[i].as_py()), level, buckets, batch.column("answers")[i].as_py() or [])
            if left.bodies:
                yield batch.column("shard")[i].as_py(), left


def next_round(sent: DataFrame, level: int, buckets: int) -> DataFrame:
    """As first_round, on what the round before leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, shard in shards(batches, level - 1, buckets):
            yield from sent_round(shard, number, level, buckets)

    return answered(sent, buckets).transform(mapped, run, ROUND_SQL)


def by_bucket(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    """Columns of each bucket, in the given order within it."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    columns = [c[order] for c in columns]
    for a, b in zip(edges.tolist(), np.r_[edges[1:], len(bucket)].tolist(), strict=True):
        yield int(bucket[a]), [c[a:b].tobytes() for c in columns]


def place(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values >> _U(20)) % _U(buckets)).astype(np.int32)


PAIRS = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("values", pa.binary())])


def pair_rows(kind: int, keys: np.ndarray, values: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch | None:
    rows = [{"kind": kind, "bucket": b, "keys": k, "values": v} for b, (k, v) in by_bucket(bucket, [keys, values])]
    return pa.RecordBatch.from_pylist(rows, PAIRS) if rows else None


def short_key(raw: list[bytes]) -> np.ndarray:
    """The first eight bytes of text keys."""
    return np.frombuffer(b"".join(x[:8] for x in raw), _U)


def gathered(batches: Iterator[pa.RecordBatch], by: str, columns: list[str]) -> Iterator[tuple[int, list[list]]]:
    """Rows of a partition that is sorted by `by`, gathered: (value, columns)."""
    at, held = None, [[] for _ in columns]
    for batch in batches:
        values = [batch.column(c).to_pylist() for c in columns]
        for i, value in enumerate(batch.column(by).to_pylist()):
            if value != at:
                if at is not None:
                    yield at, held
                at, held = value, [[] for _ in columns]
            for h, v in zip(held, values, strict=True):
                h.append(v[i])
    if at is not None:
        yield at, held


def distinct_keys(pairs: DataFrame) -> DataFrame:
    """short: the first eight bytes of the distinct texts of (texts, values) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.unique(np.frombuffer(b"".join(batch.column("keys").to_pylist()), _U)).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([found[i : i + 8] for i in range(0, len(found), 8)], pa.binary())], ["short"])

    return pairs.select("keys").transform(mapped, run, "short binary").distinct()


def text_place(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a text, by the first four bytes of its key; see bucket_of."""
    return (keys.view(">u4")[::2] % buckets).astype(np.int32)


def bucket_of(buckets: int) -> Column:
    return (F.conv(F.hex(F.substring("text_key", 1, 4)), 16, 10).cast("long") % F.lit(buckets)).cast("int")


def meet(docs: DataFrame, pairs: DataFrame, buckets: int) -> DataFrame:
    """(id, text_key, text, keys, values): the texts of a bucket after its (texts, values) rows."""
    empty = F.lit(None).cast("binary")
    notes = pairs.select("bucket", F.lit(0).cast("long").alias("id"), empty.alias("text_key"), F.lit(None).cast("string").alias("text"), "keys", "values")
    both = notes.unionByName(docs.select(bucket_of(buckets).alias("bucket"), "id", "text_key", "text", empty.alias("keys"), empty.alias("values")))
    return both.withColumn("last", F.col("keys").isNull()).repartition(buckets, "bucket").sortWithinPartitions("bucket", "last").drop("last")


def met(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[int], list[bytes], list[bytes]]]:
    """(noted keys, noted values, ids, text keys, texts) for shards of texts of one bucket."""
    at, keys, values, held, size = None, [], [], [], 0

    def close() -> tuple:
        nonlocal keys, values
        keys, values = [b"".join(keys)], [b"".join(values)]
        return np.frombuffer(keys[0], _U), np.frombuffer(values[0], _U), *map(list, zip(*held, strict=True))

    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("bucket", "id", "text_key", "keys", "values")), texts(batch.column("text")), strict=True)
        for bucket, doc, key, noted, value, text in rows:
            if bucket != at:
                if held:
                    yield close()
                at, keys, values, held, size = bucket, [], [], [], 0
            if noted is not None:
                keys.append(noted)
                values.append(value)
                continue
            if held and size + len(text) > shard_bytes:
                yield close()
                held, size = [], 0
            held.append((doc, key, text))
            size += len(text)
    if held:
        yield close()


SENT = pa.schema([("kind", pa.int32()), ("bucket", pa.int32())] + [(c, pa.binary()) for c in ("ids", "keys", "window", "check", "values")])
SENT_SQL = "kind int, bucket int, ids binary, keys binary, window binary, check binary, values binary"


def later(window: np.ndarray, check: np.ndarray, ids: np.ndarray, starts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, whether first of its window, whether a repeat), sorted by window, id, start and text key."""
    order = np.lexsort((keys, starts, ids, check, window))
    if not len(order):
        return order, np.empty(0, bool), np.empty(0, bool)
    w, c, i, s, k = window[order], check[order], ids[order], starts[order], keys[order]
    first = np.r_[True, (w[1:] != w[:-1]) | (c[1:] != c[:-1])]
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    return order, first, (i != i[head]) | (s != s[head]) | (k != k[head])


def send_windows(sent: DataFrame, buckets: int) -> DataFrame:
    """Windows of what the last round leaves. Kind 0: windows, once per shard. Kind 1: (texts, starts) of repeats within a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, shard in shards(batches, ROUNDS, buckets):
            wanted = np.flatnonzero(shard.windows())
            window = grams(shard.words.hashes, WINDOW)[wanted]
            check = (grams(mix(shard.words.hashes), WINDOW)[wanted] >> _U(48)).astype(np.uint16)
            owner = np.searchsorted(shard.words.bounds, wanted, side="right") - 1
            start = (wanted - shard.words.bounds[owner] + shard.offsets[owner]).astype(np.uint64)
            number, key = shard.ids[owner], shard.keys[owner]
            order, first, repeat = later(window, check, number, start, key)
            if (out := pair_rows(1, key[order[repeat]], start[order[repeat]], text_place(key[order[repeat]], buckets))) is not None:
                yield pa.RecordBatch.from_pylist(out.to_pylist(), SENT)
            # in text order, so that ids and keys compress
            kept = np.sort(order[~repeat])
            columns = [number[kept], key[kept], window[kept], check[kept], start[kept].astype(np.uint32)]
            rows = [{"kind": 0, "bucket": b, **dict(zip(("ids", "keys", "window", "check", "values"), c, strict=True))} for b, c in by_bucket(place(window[kept], buckets), columns)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, SENT)

    return answered(sent, buckets).transform(mapped, run, SENT_SQL)


def repeats(sent: DataFrame, buckets: int) -> DataFrame:
    """(bucket of the text, texts, starts) of windows that also start earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (kind, ids, keys, window, check, values) in gathered(batches, "bucket", ["kind", "ids", "keys", "window", "check", "values"]):
            count = [i for i, k in enumerate(kind) if k == 0]
            read = lambda column, dtype: np.frombuffer(b"".join(column[i] for i in count), dtype)
            start = read(values, np.uint32).astype(np.uint64)
            order, _, repeat = later(read(window, _U), read(check, np.uint16), read(ids, np.int64), start, read(keys, _U))
            found = order[repeat]
            sure = [i for i, k in enumerate(kind) if k == 1]
            key = np.r_[read(keys, _U)[found], np.frombuffer(b"".join(keys[i] for i in sure), _U)]
            start = np.r_[start[found], np.frombuffer(b"".join(values[i] for i in sure), _U)]
            if (out := pair_rows(0, key, start, text_place(key, buckets))) is not None:
                yield out

    return sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").transform(mapped, run, "kind int, bucket int, keys binary, values binary").drop("kind")


def kept_words(body: bytes, starts: np.ndarray) -> tuple[int, bytes]:
    """(words removed, the others joined by a space) of a text with repeats at these starts."""
    words = body.split()
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + WINDOW, -1)
    covered = np.cumsum(change[:-1]) > 0
    return int(covered.sum()), b" ".join(w for w, c in zip(words, covered.tolist(), strict=True) if not c)


def cover(docs: DataFrame, found: DataFrame, buckets: int, shard_bytes: int) -> DataFrame:
    """(text_key, n_removed, kept_sha256) of texts with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for noted, values, _, keys, body in met(batches, shard_bytes):
            order = np.argsort(noted, kind="stable")
            noted, starts = noted[order], values[order].astype(np.int64)
            key = short_key(keys)
            rows = []
            for k, low, high, text in zip(keys, np.searchsorted(noted, key).tolist(), np.searchsorted(noted, key, side="right").tolist(), body, strict=True):
                if high > low:
                    removed, kept = kept_words(text, np.unique(starts[low:high]))
                    rows.append({"text_key": k, "n_removed": removed, "kept_sha256": hashlib.sha256(kept).hexdigest()})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("text_key", pa.binary()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]))

    return meet(docs, found, buckets).transform(mapped, run, "text_key binary, n_removed long, kept_sha256 string")


def whole(docs: DataFrame) -> DataFrame:
    """(id, text_key, size, n_words, all_sha256) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [t.split() for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_key"), batch.column("size"), pa.array([len(w) for w in split], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in split])],
                ["id", "text_key", "size", "n_words", "all_sha256"],
            )

    rows = docs.select("id", "text_key", F.octet_length("text").cast("long").alias("size"), "text")
    return rows.transform(mapped, run, "id long, text_key binary, size long, n_words long, all_sha256 string")


def searched(docs: DataFrame, copied: DataFrame) -> DataFrame:
    """One row of each text: the first."""
    one = restrict(docs, copied, "text_key", "left").filter("first is null or (id = first and n_first = 1)").select("id", "text_key", "text")
    many = checkpointed(copied.filter("n_first > 1").select("text_key", F.col("first").alias("id")))
    if many.isEmpty():
        return one
    return one.unionByName(restrict(docs, many, ["text_key", "id"]).groupBy("text_key", "id").agg(F.max("text").alias("text")))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 6 << 20, bucket_bytes: int = 24 << 20) -> DataFrame:
    """One row per input row: id_col, n_words, n_removed, kept_sha256. Ids are whole numbers."""
    text = text_of(text_col)
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text_key(text).alias("text_key"), text.alias("text"))
    rows = checkpointed(whole(docs))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // bucket_bytes))
    copied = rows.groupBy("text_key", "id").agg(F.count(F.lit(1)).alias("n")).groupBy("text_key").agg(F.min("id").alias("first"), F.sum("n").alias("n"), F.min_by("n", "id").alias("n_first"))
    copied = checkpointed(spread(copied.filter("n > 1").drop("n")))
    folder = scratch(docs.sparkSession, "rounds")
    sent = written(first_round(searched(docs, copied), buckets, shard_bytes), f"{folder}/1")
    for level in range(2, ROUNDS + 1):
        sent = written(next_round(sent, level, buckets), f"{folder}/{level}")
        forget(docs.sparkSession, f"{folder}/{level - 1}")
    found = checkpointed(repeats(send_windows(sent, buckets), buckets))
    forget(docs.sparkSession, f"{folder}/{ROUNDS}")
    # texts that lose words, one row each: the first
    some = rows.join(copied, "text_key", "left").filter("first is null or id = first")
    some = some.join(distinct_keys(found), F.substring("text_key", 1, 8) == F.col("short")).select("text_key", "id")
    some = checkpointed(spread(some).distinct())
    changed = cover(restrict(docs, some, ["text_key", "id"]), found, buckets, shard_bytes).groupBy("text_key").agg(F.max("n_removed").alias("n_removed"), F.max("kept_sha256").alias("kept_sha256"))
    out = rows.join(spread(copied.select("text_key", "first").join(changed, "text_key", "full")), "text_key", "left")
    gone = F.coalesce(F.col("id") > F.col("first"), F.lit(False)) & (F.col("n_words") >= WINDOW)
    return out.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col),
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"),
    )
