"""Token-id files: ORC with run-length coded ids, row indexes and Bloom filters on document ids.

Documents go to blocks, ranges of doc_id; each block is encoded in order and is one file. So stripes hold ascending ids, their
statistics and row indexes do not overlap, and a reader skips all stripes and rows that it is not asked for. Stripes are read in
parallel.

The tokenizer's pre-tokens never cross ASCII white space, and white space itself has no ids, so a text's ids are those of its
words in a row; each distinct word is encoded once by the library (tests hold this against whole texts; see TextIds).
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.pieces import SegmentIds, flattened
from tideline.llm.store import block_of, byte_blocks, new_path, written
from tideline.llm.words import SPACE, chunks, text_bytes

#: Fixed value: a pre-tokenizer pattern under which words are encoded apart; it drops white space and parts letters from the rest.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters that are lower case, composed and two bytes at most: neither normaliser nor pre-tokenizer changes or parts them.
_LETTERS = re.compile("[a-zß-öø-ÿ]+")
_CODES = np.arange(256)
_ALNUM = np.isin(_CODES, [*b"abcdefghijklmnopqrstuvwxyz0123456789"])
_UPPER = (_CODES >= 0x41) & (_CODES <= 0x5A)
_PUNCT = (_CODES > 0x20) & (_CODES < 0x7F) & ~_ALNUM & ~_UPPER
#: Second bytes, after 0xC3, of the letters from U+00C0 to U+00FF, and of those in upper case with a lower one 32 further on.
_LATIN = (_CODES >= 0x80) & (_CODES < 0xC0) & (_CODES != 0x97) & (_CODES != 0xB7)
_LATIN_UPPER = _LATIN & (_CODES < 0x9F)
#: Bytes that begin no character which the normaliser would join with the letter before it.
_APART = (_CODES < 0x80) | (_CODES == 0xC3)
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: The character that byte-level vocabularies write for each byte: itself if it is printed, else the next one from 256 on.
_BYTE_CHARS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}
_models: dict[str, TextIds] = {}


class TextIds:
    """The ids of texts by a tokenizer file.

    Where the file's settings are a lower-casing normaliser, WORD_PATTERN and special tokens that hold `<|`, words are encoded apart,
    each distinct one once, in lower case and without the ASCII punctuation after them; words of plain letters go to the file's model at
    once. Texts that hold `<|` are parted at white space only. Under other settings whole texts are encoded."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        settings = json.loads(self.tokenizer.to_str())
        steps = [n["type"] for n in (settings["normalizer"] or {}).get("normalizers", [])]
        before = (settings["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        pattern = before[0].get("pattern", {}).get("Regex"), before[0].get("behavior"), before[0].get("invert")
        special = all("<|" in t["content"] and not (t["lstrip"] or t["rstrip"]) for t in settings["added_tokens"])
        self.by_words = steps == ["NFC", "Replace", "Lowercase"] and pattern == (WORD_PATTERN, "Removed", True) and special
        self.segments = SegmentIds(lambda words: flattened(self._encode(words)), 240 << 20)

    def _encode(self, segments: list[str]) -> list[list[int]]:
        if not self.by_words:
            return [e.ids for e in self.tokenizer.encode_batch_fast(segments, add_special_tokens=False)]
        model, plain = self.tokenizer.model, [bool(_LETTERS.fullmatch(s)) for s in segments]
        rest = iter(self.tokenizer.encode_batch_fast([s for s, p in zip(segments, plain, strict=True) if not p], add_special_tokens=False))
        written = lambda s: s if s.isascii() else s.encode().decode("latin-1").translate(_BYTE_CHARS)
        return [[t.id for t in model.tokenize(written(s))] if p else next(rest).ids for s, p in zip(segments, plain, strict=True)]

    def _split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The segments of all texts in a row, and how many each has."""
        n = len(offsets) - 1
        d = np.insert(data, offsets, 0x20)  # a space before each text and at the end
        begins = offsets + np.arange(n + 1) + 1
        changed = np.ones(n, bool)
        changed[np.searchsorted(begins, np.flatnonzero((d[:-1] == 0x3C) & (d[1:] == 0x7C)), "right") - 1] = False
        mine = (lambda at: at) if changed.all() else (lambda at: at[changed[np.searchsorted(begins, at, "right") - 1]])
        at = np.flatnonzero(_UPPER[d])
        d[mine(at[_APART[d[at + 1]]])] += 32  # not before a mark, which may join with one case only
        at = np.flatnonzero(d == 0xC3) + 1
        d[mine(at[_LATIN_UPPER[d[at]] & _APART[d[at + 1]]])] += 32
        space, punct = SPACE[d], _PUNCT[d]
        first = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        stop = np.flatnonzero(~space[:-1] & space[1:]) + 1
        runs = np.flatnonzero(punct[1:] & ~punct[:-1]) + 1
        last = stop[punct[stop - 1]] - 1
        cut = runs[np.searchsorted(runs, last, "right") - 1] if len(last) else last
        cut = mine(cut[_ALNUM[d[cut - 1]] | _LATIN[d[cut - 1]] & (d[cut - 2] == 0xC3)])
        first, stop = np.sort(np.concatenate([first, cut])), np.sort(np.concatenate([stop, cut]))
        ends = np.concatenate([[0], np.cumsum(stop - first)]).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(d[~space])])
        return parts, np.diff(np.searchsorted(first, begins))

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self.row_ids(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))

    def row_ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of texts as UTF-8 bytes in a row, with where each begins and ends: all ids in a row, and how many each text has."""
        if self.by_words:
            return self.segments.array_ids(*self._split(data, offsets))
        return self.segments.ids([[bytes(data[a:b])] for a, b in zip(offsets[:-1], offsets[1:], strict=True)])

    @classmethod
    def of(cls, path: str) -> TextIds:
        """One for each file and Python process."""
        if path not in _models:
            _models[path] = cls(path)
        return _models[path]


def _encoded(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = TextIds.of(path)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in chunks(offsets, 1 << 21):
                flat, sizes = model.row_ids(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ends = np.cumsum(sizes)
                flat = np.insert(flat, ends, end_id)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends + np.arange(1, b - a + 1)]).astype(np.int32)), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), lists], ["doc_id", "ids"])

    return run


def _block(bounds: list[int], spread: Column, n: int) -> Column:
    """Blocks of ids, from 1 on; below 0 those of rows without one, which spread over n."""
    return F.when(F.col("doc_id").isNull(), -1 - F.pmod(spread, F.lit(n)).cast("int")).otherwise(block_of(F.col("doc_id"), bounds))


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, block_bytes: int = 10 << 20, stripe_bytes: int = 16 << 20) -> tuple[str, list[int]]:
    """Write the ids of docs (doc_id, text), end_id after each document, to ORC files in ascending order of doc_id, one for about
    `block_bytes` of text. Returns the path and the blocks' bounds. Null texts have the end id alone; rows with a null id go to files
    of their own; equal ids stay next to each other; an empty table gives no ids; other columns, whatever their names, are ignored."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n, bounds = byte_blocks(docs, block_bytes)
    path = path or new_path(docs.sparkSession, "tokens")
    blocks = docs.withColumn("blk", _block(bounds, F.xxhash64("text"), n)).repartitionById(n + 1, F.col("blk")).drop("blk").sortWithinPartitions("doc_id")
    rows = blocks.mapInArrow(_encoded(tokenizer, end_id), "doc_id bigint, ids array<int>")
    options = {"orc.compress": "ZLIB", "orc.stripe.size": str(stripe_bytes), "orc.row.index.stride": "1000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
    rows.write.options(**options).orc(path)
    return path, bounds


def read_token_files(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """(doc_id, ids) of a path; with ids given, of those documents only, by stripe statistics, row indexes and Bloom filters."""
    rows = spark.read.schema("doc_id bigint, ids array<int>").orc(path)
    return rows if ids is None else rows.where(F.col("doc_id").isin([int(i) for i in ids]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        ends = lists.offsets.to_numpy()
        values = lists.values.to_numpy().astype("<u4", copy=False)
        sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends), pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "n_tokens", "ids_crc32"])


def token_index(rows: DataFrame, bounds: list[int]) -> DataFrame:
    """Per row of token files: start (ids of all documents before it), n_tokens and ids_crc32 of its little-endian 32-bit ids.

    Rows with a null id come first, in an order that their ids give. Sums run within the blocks; a block's own start comes from the
    totals of the blocks, of which there are as many as files."""
    held = written(rows.mapInArrow(_digests, "doc_id bigint, n_tokens bigint, ids_crc32 bigint").withColumn("blk", _block(bounds, F.col("ids_crc32"), len(bounds) + 1)), "token-index")
    totals = held.groupBy("blk").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("blk", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("blk").orderBy(F.col("doc_id").asc_nulls_first(), "ids_crc32", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = held.withColumn("before", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return placed.join(F.broadcast(totals), "blk").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
