"""SentencePiece models on the tokenizers library: the model file is parsed here, and normaliser, metaspace marker, scores or
merges and byte fallback are rebuilt; batches are encoded with several threads; parity with the original library is verified.

Unigram models keep their scores. In BPE models the scores order the merges. Segments that no piece spans (runs of spaces with what
follows up to the next space or line end) are encoded once each; the vocabulary is checked for that when a model is loaded.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.pieces import Found, SegmentIds, flattened
from tideline.llm.words import chunks, text_bytes

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
_SEGMENT = re.compile(rb" +[^ \n]*|[^ \n]+|\n+")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protobuf message: number and value; fixed-width values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            if kind not in (1, 2, 5) or at + n > len(data):
                raise ValueError("not a SentencePiece model")
            yield tag >> 3, data[at : at + n]
            at += n


@dataclass
class Model:
    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    dummy_prefix: bool
    squeeze: bool
    charsmap: bytes

    @classmethod
    def parse(cls, data: bytes) -> Model:
        pieces, trainer, normaliser = [], {}, {}
        for number, value in fields(data):
            if number == 1:
                own = dict(fields(value))
                pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normaliser = dict(fields(value))
        kind = trainer.get(3, UNIGRAM)
        if kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if not normaliser.get(5, 1) or trainer.get(24, 0):
            raise ValueError("models without escaped white space, or with it as a suffix, are not supported")
        return cls(pieces, kind, bool(trainer.get(35, 0)), bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)), normaliser.get(2, b""))

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def merges(self) -> list[tuple[str, str]]:
        """Every split of every piece into two pieces, pieces of higher scores first."""
        usable = {p: (-score, i) for i, (p, score, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        order = sorted((p for p in usable if len(p) > 1), key=usable.__getitem__)
        return [(p[:i], p[i:]) for p in order for i in range(1, len(p)) if p[:i] in usable and p[i:] in usable]

    def separable(self) -> bool:
        """Whether no piece has a marker after another character, or a line end beside one."""
        return not any(MARK in p.lstrip(MARK) or ("\n" in p and p.strip("\n")) for p, _, kind in self.pieces if kind in (NORMAL, USER))

    def tokenizer(self):
        """The library's tokenizer, without the prefix: encoder() sees to that."""
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        if self.kind == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback)
        else:
            model = models.BPE({p: i for i, (p, _, _) in enumerate(self.pieces)}, self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        out = Tokenizer(model)
        steps = [normalizers.Replace(" ", MARK)]
        out.normalizer = normalizers.Sequence(steps)
        if self.separable():
            out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n+"), "isolated")
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        return out

    def normaliser(self):
        from tokenizers import normalizers

        return normalizers.Precompiled(self.charsmap) if self.charsmap else None

    def prepared(self, text: str, normaliser=None) -> str:
        """What is encoded: characters mapped, spaces squeezed, a space before."""
        if normaliser:
            text = normaliser.normalize_str(text)
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return f" {text}" if self.dummy_prefix and text else text

    def piece_bytes(self) -> list[bytes]:
        """What each id stands for in the decoded text."""
        out = []
        for p, _, kind in self.pieces:
            if kind == BYTE:
                out.append(bytes([int(_BYTE_PIECE.fullmatch(p)[1], 16)]))
            else:
                out.append(b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode())
        return out


class Encoder:
    """Encode and decode lists of texts; one for each model file, process and number of threads."""

    _held: dict[tuple[str, int], Encoder] = {}

    def __init__(self, path: str, threads: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        with open(path, "rb") as f:
            self.model = Model.parse(f.read())
        tokenizer, self.map = self.model.tokenizer(), self.model.normaliser()
        self.path, self.split = path, self.model.separable()
        self.tokenizer, self.segments = tokenizer, SegmentIds(self._ids)
        self.marked = np.array([p.startswith(MARK) for p, *_ in self.model.pieces])
        self.bytes = self.model.piece_bytes()

    def _ids(self, segments: list[str]) -> Found:
        """Segments that begin with their only marker are encoded many in a row: a piece with a leading marker begins the next."""
        if not self.split:
            return flattened([e.ids for e in self.tokenizer.encode_batch_fast(segments, add_special_tokens=False)])
        one = [s[:1] == " " and s.count(" ") == 1 and MARK not in s for s in segments]
        rows, rest = ([s for s, o in zip(segments, one, strict=True) if o == want] for want in (True, False))
        joined = self.tokenizer.encode_batch_fast(["".join(rows[i : i + 256]) for i in range(0, len(rows), 256)], add_special_tokens=False)
        flat = np.fromiter(chain.from_iterable(e.ids for e in joined), np.int32)
        begins = np.flatnonzero(self.marked[flat])
        if len(begins) != len(rows) or (len(rows) and begins[0]):
            return flattened([e.ids for e in self.tokenizer.encode_batch_fast(segments, add_special_tokens=False)])
        others = flattened([e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)])
        sizes, of = np.empty(len(segments), np.int64), np.array(one, bool)
        sizes[of], sizes[~of] = np.diff(np.append(begins, len(flat))), others[1]
        out, own = np.empty(int(sizes.sum()), np.int32), np.repeat(of, sizes)
        out[own], out[~own] = flat, others[0]
        return out, sizes

    @classmethod
    def of(cls, path: str, threads: int = 2) -> Encoder:
        return cls._held.setdefault((path, threads), None) or cls._held.__setitem__((path, threads), cls(path, threads)) or cls._held[path, threads]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        m = self.model
        if self.map or m.squeeze or not m.dummy_prefix:
            texts = [m.prepared(t.decode(), self.map).encode() for t in texts]
        else:
            texts = [b" " + t if t else t for t in texts]
        return self.segments.ids([_SEGMENT.findall(t) if self.split else [t] if t else [] for t in texts])

    def decode(self, ids: list[int]) -> bytes:
        out = b"".join(map(self.bytes.__getitem__, ids))
        return out[1:] if self.model.dummy_prefix and out[:1] == b" " else out


def _encoded(path: str, threads: int, verify: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, original = Encoder.of(path, threads), None
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in chunks(offsets, 1 << 19):
                texts = [bytes(data[offsets[i] : offsets[i + 1]]) for i in range(a, b)]
                flat, sizes = encoder.encode(texts)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                own = [flat[ends[i] : ends[i + 1]].tolist() for i in range(b - a)]
                decoded, parity = list(map(encoder.decode, own)), [None] * (b - a)
                if verify:
                    if original is None:
                        import sentencepiece

                        original = sentencepiece.SentencePieceProcessor(model_file=path)
                    parity = [x == y for x, y in zip(original.encode([t.decode() for t in texts], num_threads=1), own, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, pa.int32()))
                columns = [batch.column("doc_id").slice(a, b - a), lists, pa.array(sizes, pa.int64()), pa.array(decoded, pa.binary()).cast(pa.string()), pa.array([x == y.replace(MARK.encode(), b" ") for x, y in zip(decoded, texts, strict=True)]), pa.array(parity, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "n_ids", "decoded", "round_trip", "parity"])

    return run


def encode_pieces(docs: DataFrame, model: str, threads: int = 2, verify: bool = True) -> DataFrame:
    """Per row of docs (doc_id, text): ids, n_ids, decoded, round_trip (decoded is the text; a
    marker that stands in a text comes back as a space, as it does in the original library) and parity.

    parity compares the ids of every text with the original library's; without verify it is null. Null and empty texts have no ids;
    an empty table gives none; equal rows get a row each; other columns, whatever their names, are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_encoded(model, threads, verify), "doc_id bigint, ids array<int>, n_ids bigint, decoded string, round_trip boolean, parity boolean")
