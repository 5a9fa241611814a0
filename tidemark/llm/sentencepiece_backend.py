"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is parsed here; normaliser, metaspace marker, unigram scores or BPE merges and byte fallback
are rebuilt for the tokenizers library. Where no piece holds a marker behind another character (checked
at load), no piece crosses a word start, so a text's ids are those of its words in turn: every distinct
word of a batch is encoded once, in multithreaded batches, and kept in a bounded cache. Models without that property are
encoded text by text.

The ids are the tokenizers library's. Parity: of the strings that are encoded (words, or texts that are encoded whole) those whose CRC-32 is
divisible by `parity` are also encoded by the sentencepiece library, which must give the same ids: a difference ends the job with
a ParityError that names the string. The sample depends on the strings alone, so it is the same share, and the same
strings, at every size. Decoding starts from the ids alone, by a table of each piece's bytes.

Defined cases: null and empty texts have no ids and decode to the empty text; whole texts are encoded whatever their length; null ids are
kept; repeated rows each give a row; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import mapped, pieces, tokenizer_threads

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    at = 0
    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + n]
            at += n


class Model:
    """What a SentencePiece model file says."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.charsmap = 1, False, b""
        self.dummy_prefix = self.strip = self.escape = True
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                self.pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
            elif number == 2:
                spec = dict(fields(value))
                self.kind, self.byte_fallback = spec.get(3, 1), bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(fields(value))
                self.charsmap = spec.get(2, b"")
                self.dummy_prefix, self.strip, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        #: Whether words can be encoded one by one.
        self.by_word = (
            self.escape and not self.strip and not self.charsmap and self.dummy_prefix and not any(MARK in p.lstrip(MARK) or t == USER for p, _, t in self.pieces)
        )

    def merges(self) -> list[tuple[str, str]]:
        """BPE merges, best piece first."""
        known = {p: i for i, (p, _, t) in enumerate(self.pieces) if t == NORMAL}
        made = []
        for i, (piece, score, kind) in enumerate(self.pieces):
            if kind == NORMAL:
                for cut in range(1, len(piece)):
                    if (left := piece[:cut]) in known and (right := piece[cut:]) in known:
                        made.append((-score, i, known[left], known[right], left, right))
        return [x[4:] for x in sorted(made)]

    def tokenizer(self):
        from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

        if any(t == USER for _, _, t in self.pieces) or self.kind not in (1, 2):
            raise ValueError("only unigram and BPE models without user-defined pieces")
        if self.kind == 1:
            found = Tokenizer(models.Unigram([(p, s) for p, s, _ in self.pieces], unk_id=self.unknown, byte_fallback=self.byte_fallback))
        else:
            vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            found = Tokenizer(models.BPE(vocab, self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback))
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.strip:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK if self.escape else " "))
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        found.normalizer = normalizers.Sequence(steps)
        if self.by_word:
            found.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
        return found


class ParityError(ValueError):
    """The rebuilt model and the sentencepiece library give different ids."""


class Codec:
    """Encoder and decoder of one model file. One string in `parity` is checked against the sentencepiece library."""

    def __init__(self, path: str, cache: int = 240_000, parity: int = 64) -> None:
        import sentencepiece

        tokenizer_threads()
        with open(path, "rb") as file:
            self.model = Model(file.read())
        self.backend = self.model.tokenizer()
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.most, self.words, self.parity = cache, {}, parity
        self.opens = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])
        shown = [self._bytes(p, t) for p, _, t in self.model.pieces]
        self.lengths = np.array([len(x) for x in shown], np.int64)
        self.starts = np.r_[0, np.cumsum(self.lengths)[:-1]]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)

    def _bytes(self, piece: str, kind: int) -> bytes:
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return bytes([int(piece[3:5], 16)]) if kind == BYTE else piece.replace(MARK, " ").encode()

    def backend_ids(self, strings: list[str]) -> list[np.ndarray]:
        """Ids of each string, by the tokenizers library, in a multithreaded batch."""
        return [np.array(x.ids, np.int32) for x in self.backend.encode_batch(strings, add_special_tokens=False)]

    def check(self, strings: list[str], found: list[bytes]) -> None:
        """Raises ParityError unless the sentencepiece library gives the same ids for the strings of the sample."""
        some = [i for i, x in enumerate(strings) if zlib.crc32(x.encode()) % self.parity == 0]
        for i, right in zip(some, self.library.encode([strings[i] for i in some], num_threads=1), strict=True):
            if np.array(right, np.int32).tobytes() != found[i]:
                raise ParityError(f"the backend and the sentencepiece library differ on {strings[i][:200]!r}")

    def learn(self, words: list[str]) -> None:
        """Puts words (without marker) into the cache; runs of 512 words are encoded as one string, 16 runs at once."""
        for begin in range(0, len(words), 512 * 16):
            some = words[begin : begin + 512 * 16]
            runs = [some[i : i + 512] for i in range(0, len(some), 512)]
            made: list[bytes] = []
            for run, ids in zip(runs, self.backend_ids([" ".join(x) for x in runs]), strict=True):
                cuts = np.flatnonzero(self.opens[ids])
                if len(cuts) != len(run):  # not reached while by_word holds
                    raise ValueError("a piece crosses a word start")
                ends = np.r_[cuts[1:], len(ids)]
                raw = ids.tobytes()
                made += [raw[4 * a : 4 * b] for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]
            self.check(some, made)
            self.words.update(zip(some, made, strict=True))

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that are encoded as they are."""
        found = [x.tobytes() for x in self.backend_ids(texts)]
        self.check(texts, found)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian int32."""
        out = [b""] * len(texts)
        plain, rest = {}, {}
        for i, text in enumerate(texts):
            if text:
                simple = self.model.by_word and MARK not in text and "  " not in text and text[0] != " " and text[-1] != " "
                (plain if simple else rest)[i] = text.split(" ") if simple else text
        if len(self.words) > self.most:
            self.words.clear()
        words = self.words
        self.learn([w for w in set(chain.from_iterable(plain.values())) if w not in words])
        for i, split in plain.items():
            out[i] = b"".join(map(words.__getitem__, split))
        for i, ids in zip(rest, self.whole(list(rest.values())), strict=True):
            out[i] = ids
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids."""
        if not len(ids):
            return ""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        where = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - n), n)
        text = self.shown[where].tobytes()
        if self.model.dummy_prefix and text[:1] == b" ":
            text = text[1:]
        return text.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", at_once: int = 1 << 20) -> DataFrame:
    """Per row: id_col, n_tokens, ids, decoded_sha256 (of the text decoded from the ids), round_trip."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(model_path)
        for batch in batches:
            for a, b in pieces(batch.column(1), at_once):
                texts = [x or "" for x in batch.column(1).slice(a, b - a).to_pylist()]
                coded = model.encode(texts)
                flat = np.frombuffer(b"".join(coded), np.int32)
                ends = np.cumsum([len(x) // 4 for x in coded])
                back = [model.decode(flat[e - len(x) // 4 : e]) for e, x in zip(ends.tolist(), coded, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(x) // 4 for x in coded], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(flat)),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back]),
                        pa.array([x == y for x, y in zip(back, texts, strict=True)]),
                    ],
                    [id_col, "n_tokens", "ids", "decoded_sha256", "round_trip"],
                )

    def forgetful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        codec(model_path).words.clear()

    schema = f"`{id_col}` {kind}, n_tokens long, ids array<int>, decoded_sha256 string, round_trip boolean"
    return docs.select(id_col, text_col).transform(mapped, forgetful, schema)
