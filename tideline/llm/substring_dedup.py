"""Repeated passages: Rabin-Karp hashes of every window of `width` words, counted in Spark; repeated windows merge into maximal
intervals, which are removed from all but the first document.

1. Documents go to blocks, ranges of doc_id, one block a group. A block sends its distinct window hashes, sorted and delta-coded, to
   nodes, by their leading bits. So a passage that many documents share costs a block one entry, however many hold it.
2. A node of the first level has the hashes of some leading bits of as many blocks as it has siblings, 4096 at most; it sends the
   distinct ones on by the next bits, to nodes of 4096 times as many blocks, and so on until one level has all blocks. So a block
   sends 4096 rows at most at any size of the input (256 up to 256 blocks), a node holds about as many hashes as a block, and there
   is one level up to 4096 blocks (40 GB of text), and there are two up to 16 million.
3. Answers go back down with one bit an entry: whether a block of smaller ids has that window.
4. A block rolls its hashes again, adds what repeats within the block, and cuts the covered words.

A window has two rolling hashes of different bases, 64 and 32 bits: among n windows about n**2 / 2**97 are taken for others, none
expected up to 10**14.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.store import block_of, byte_blocks
from tideline.llm.words import Words, chunks, text_bytes

_OUT = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, removed array<struct<start:bigint,end:bigint>>"
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_RUNS, _RUNS_ARROW = "g int, p bigint, child int, run binary", pa.schema([("g", pa.int32()), ("p", pa.int64()), ("child", pa.int32()), ("run", pa.binary())])
_BITS, _BITS_ARROW = "g int, p bigint, digit int, bits binary", pa.schema([("g", pa.int32()), ("p", pa.int64()), ("digit", pa.int32()), ("bits", pa.binary())])
_FEWEST, _MOST = 8, 12  # leading bits that a level looks at
_SECOND = 0xC2B2AE3D27D4EB4F | 1


def _packed(first: np.ndarray, second: np.ndarray) -> bytes:
    """Ascending hashes as differences of 6 bytes, or of 8 where one needs more, then the second hashes."""
    steps = np.diff(first)
    size = 6 if not len(steps) or int(steps.max()) < 1 << 48 else 8
    return bytes([size]) + np.uint32(len(first)).tobytes() + first[:1].tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :size].tobytes() + second.tobytes()


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    size, n, raw = blob[0], int(np.frombuffer(blob, np.uint32, 1, 1)[0]), np.frombuffer(blob, np.uint8)
    end = 13 + (n - 1) * size
    steps = np.zeros((n, 8), np.uint8)
    steps[0] = raw[5:13]
    steps[1:, :size] = raw[13:end].reshape(-1, size)
    return np.cumsum(steps.view(np.uint64).reshape(-1), dtype=np.uint64), np.frombuffer(blob, np.uint32, n, end)


class Distinct:
    """The distinct pairs among windows' hashes, ascending; which of them each window is, and whether it is the first that is."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        order = np.argsort(first, kind="stable")  # equal hashes stay in their order
        one, two = first[order], second[order]
        same = one[1:] == one[:-1]
        if (two[1:][same] != two[:-1][same]).any():
            order = np.lexsort((second, first))
            one, two = first[order], second[order]
            same = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
        new = np.ones(len(order), bool)
        new[1:] = ~same
        self.first, self.second = one[new], two[new]
        self.which, self.begins = np.empty(len(order), np.int64), np.empty(len(order), bool)
        self.which[order], self.begins[order] = np.cumsum(new) - 1, new

    def cuts(self, level: int, bits: int) -> list[int]:
        """Where the runs of one value of this level's bits begin; all bits before those are the same."""
        digit = (self.first >> np.uint64(64 - bits * (level + 1))) & np.uint64((1 << bits) - 1)
        return [*np.searchsorted(digit, np.arange(1 << bits, dtype=np.uint64)).tolist(), len(self.first)]


def _texts(table: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """Ids and texts in order of the ids."""
    table = table.select(["doc_id", "text"]).combine_chunks()
    ids = table.column("doc_id").to_numpy()
    if len(ids) > 1 and (np.diff(ids) < 0).any():
        order = np.argsort(ids, kind="stable")
        ids, table = ids[order], table.take(pa.array(order))
    return ids, table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())


def _windows(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[tuple[int, int, Words, np.ndarray, np.ndarray, np.ndarray]]:
    """In parts: first and last text, words, both hashes of the windows and each one's first word."""
    for a, b in chunks(offsets):
        w = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        first, starts = w.windows(width)
        yield a, b, w, first, w.windows(width, _SECOND)[0].astype(np.uint32), starts


def _joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _sent(own: Distinct, level: int, place: int, prefix: int, bits: int) -> pa.Table:
    """The rows that a block (level 0) or node sends: one for each value of the next bits."""
    fan, cuts = 1 << bits, own.cuts(level, bits)
    digits = [d for d in range(fan) if cuts[d] < cuts[d + 1]]
    runs = [_packed(own.first[cuts[d] : cuts[d + 1]], own.second[cuts[d] : cuts[d + 1]]) for d in digits]
    return pa.table({"g": [place // fan] * len(digits), "p": [prefix * fan + d for d in digits], "child": [place % fan] * len(digits), "run": runs}, schema=_RUNS_ARROW)


def _send(width: int, bits: int):
    def send(table: pa.Table) -> pa.Table:
        block = table.column("blk")[0].as_py()
        if block < 1:
            return _RUNS_ARROW.empty_table()
        parts = [(first, second) for *_, first, second, _ in _windows(*text_bytes(_texts(table)[1]), width)]
        return _sent(Distinct(_joined([f for f, _ in parts], np.uint64), _joined([s for _, s in parts], np.uint32)), 0, block - 1, 0, bits)

    return send


def _node(table: pa.Table) -> tuple[int, int, list[int], list[int], Distinct]:
    """Place and prefix of a node, its children in order, their numbers of entries, and the entries of all."""
    children = table.column("child").to_pylist()
    order = sorted(range(len(children)), key=children.__getitem__)
    blobs = table.column("run")
    runs = [_unpacked(blobs[i].as_py()) for i in order]
    return table.column("g")[0].as_py(), table.column("p")[0].as_py(), [children[i] for i in order], [len(r[0]) for r in runs], Distinct(np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs]))


def _rise(level: int, bits: int):
    def rise(table: pa.Table) -> pa.Table:
        place, prefix, _, _, all_ = _node(table)
        return _sent(all_, level, place, prefix, bits)

    return rise


def _seen(own: Distinct, answers: pa.Table, level: int, bits: int) -> np.ndarray:
    """For each distinct entry, whether something of smaller ids outside has it."""
    cuts = own.cuts(level, bits)
    out = np.zeros(len(own.first), bool)
    for d, x in zip(answers.column("digit").to_pylist(), answers.column("bits").to_pylist(), strict=True):
        out[cuts[d] : cuts[d + 1]] = np.unpackbits(np.frombuffer(x, np.uint8), count=cuts[d + 1] - cuts[d])
    return out


def _answers(runs: pa.Table, answers: pa.Table | None, level: int, bits: int) -> pa.Table:
    """Bits for the children: what a child before it, or something before this node, has. Without answers to itself: nothing is before it."""
    if not runs.num_rows:
        return _BITS_ARROW.empty_table()
    place, prefix, children, sizes, all_ = _node(runs)
    again = ~all_.begins
    if answers is not None:
        again |= _seen(all_, answers, level, bits)[all_.which]
    ends = np.cumsum(sizes).tolist()
    packed = [np.packbits(again[e - n : e]).tobytes() for n, e in zip(sizes, ends, strict=True)]
    fan = 1 << bits
    return pa.table({"g": [place * fan + c for c in children], "p": [prefix // fan] * len(children), "digit": [prefix % fan] * len(children), "bits": packed}, schema=_BITS_ARROW)


def _top(level: int, bits: int):
    def top(runs: pa.Table) -> pa.Table:
        return _answers(runs, None, level, bits)

    return top


def _fall(level: int, bits: int):
    def fall(runs: pa.Table, answers: pa.Table) -> pa.Table:
        return _answers(runs, answers, level, bits)

    return fall


def _cut(width: int, bits: int):
    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _OUT_ARROW.empty_table()
        known = left.column("blk")[0].as_py() > 0
        ids, texts = _texts(left) if known else (None, left.column("text").combine_chunks())
        data, offsets = text_bytes(texts)
        if known:
            one, two, owners = [], [], []
            for a, _, w, first, second, starts in _windows(data, offsets, width):
                one.append(first)
                two.append(second)
                owners.append(ids[a + w.text[starts]])
            own, owner = Distinct(_joined(one, np.uint64), _joined(two, np.uint32)), _joined(owners, np.int64)
            least = np.zeros(len(own.first), np.int64)
            least[own.which[own.begins]] = owner[own.begins]  # windows stand in order of their ids
            again = _seen(own, right, 0, bits)[own.which] | (owner > least[own.which])
            del one, two, owners, owner, own, least
        out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "kept_text": [], "removed": []}
        done = 0
        for a, b in chunks(offsets):
            w = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            gone = np.zeros(len(w.hash), bool)
            if known:
                _, starts = w.windows(width)
                repeated = starts[again[done : done + len(starts)]]
                done += len(starts)
                gone = np.cumsum(np.bincount(repeated, minlength=len(gone) + 1)[:-1] - np.bincount(repeated + width, minlength=len(gone) + 1)[: len(gone)]) > 0
            for i in range(a, b):
                lo, hi = w.first[i - a], w.first[i - a + 1]
                words = bytes(data[offsets[i] : offsets[i + 1]]).split()
                mask = gone[lo:hi]
                spans = []
                if mask.any():
                    words = [x for x, g in zip(words, mask.tolist(), strict=True) if not g]
                    turns = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                    spans = [{"start": int(s), "end": int(e)} for s, e in turns.reshape(-1, 2)]
                out["doc_id"].append(int(ids[i]) if known else None)
                out["n_words"].append(int(hi - lo))
                out["n_removed"].append(int(mask.sum()))
                out["kept_text"].append(b" ".join(words).decode())
                out["removed"].append(spans)
        return pa.table(out, schema=_OUT_ARROW)

    return cut


def _dealt(rows: DataFrame, n: int, *place: Column):
    """rows of one node together, nodes dealt to n tasks in turn."""
    turn = sum(place[1:], place[0])
    return rows.withColumn("turn", F.pmod(turn, F.lit(n)).cast("int")).repartitionById(n, F.col("turn")).groupBy("turn", "g", "p")


def remove_repeats(docs: DataFrame, width: int = 13, block_bytes: int = 10 << 20) -> DataFrame:
    """Per row of docs (doc_id, text): n_words, n_removed, kept_text and removed, the maximal intervals of word places cut out.

    A word goes if a window of `width` words that covers it also starts in a document with a smaller doc_id. Null texts have no
    words; rows with equal ids count as one document and lie in one block; rows with a null id lose nothing and give nothing, and
    are dealt to blocks of their own by their texts. An empty table gives none; other columns, whatever their names, are ignored.
    block_bytes: text of a block; a task holds one block, or the hashes of one node, about as many.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n, bounds = byte_blocks(docs, block_bytes)
    block = F.when(F.col("doc_id").isNull(), -1 - F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")).otherwise(block_of(F.col("doc_id"), bounds))
    blocks = docs.withColumn("blk", block).repartitionById(n + 1, F.col("blk"))
    levels = max(1, math.ceil(math.log2(n) / _MOST))
    bits = max(_FEWEST, math.ceil(math.log2(n) / levels))
    node = lambda l: (F.col("g").cast("bigint") * F.lit(1 << bits * l), F.col("p"))  # noqa: E731, E741
    runs = {1: blocks.groupBy("blk").applyInArrow(_send(width, bits), _RUNS)}
    for l in range(1, levels):  # noqa: E741
        runs[l + 1] = _dealt(runs[l], n, *node(l)).applyInArrow(_rise(l, bits), _RUNS)
    found = _dealt(runs[levels], n, *node(levels)).applyInArrow(_top(levels, bits), _BITS)
    for l in range(levels - 1, 0, -1):  # noqa: E741
        found = _dealt(runs[l], n, *node(l)).cogroup(_dealt(found, n, *node(l))).applyInArrow(_fall(l, bits), _BITS)
    found = found.select((F.col("g") + 1).alias("blk"), "digit", "bits")
    return blocks.groupBy("blk").cogroup(found.repartitionById(n + 1, F.col("blk")).groupBy("blk")).applyInArrow(_cut(width, bits), _OUT)
