"""Near duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

1. One pass over the texts hashes each document's distinct word shingles once, keeps the smallest value of each bin, fills empty
   bins from bins that a fixed random sequence names, and hashes rows of bins to band keys.
2. Equal sets fall together, so a group of copies counts once from here on.
3. Each bucket draws edges from its smallest member to the others: as many as members, never pairs. Edges are confirmed on the
   full sets, and confirmed links give components.
4. A bucket of three or more sets may still hold two of several components that are linked though neither is the centre. The centre,
   compared with all, leaves the bucket. If several components are left, the bucket takes a new centre, the smallest member of the
   component that has the fewest members there; it is compared with all members of other components and leaves in its turn. So a
   bucket of one large component and few stragglers is done in as many rounds as it has stragglers, each as large as the bucket.
   After the first round, a bucket of up to a block's members with more stragglers than rounds to come, whose components the last
   round did not halve, takes no further ones: they would not finish it.
5. What still holds several components after that is compared in square blocks (a matrix product of their sets, so no pair becomes a
   row), bounded in members and in bytes.

So every pair that shares a bucket is either confirmed, refused, or already in one component. With 40 bands of 6 rows a pair of
similarity 0.8 shares none with probability 5e-6. Sets are compared by 48 bits of each shingle's hash: a pair of sets of n shingles
has a wrong one in common with probability n ** 2 / 2 ** 48.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.graph import components
from tideline.llm.store import written
from tideline.llm.words import LOWER, Words, chunks, mixed, powers, text_bytes

ROUNDS = 3
_SIDE = 1024  # members of a block
_SIDE_BYTES = 16 << 20  # of their sets
_SALT = 8  # parts of a bucket's rows in a join
_SLAB = 4096  # shingles that are multiplied at a time


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: words lower-cased in A-Z, `size` words each; fewer words make one."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    for a, b in chunks(offsets):
        w = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        hashes, starts = w.windows(size)
        cuts = np.searchsorted(starts, w.first)
        for i in range(b - a):
            n = w.first[i + 1] - w.first[i]
            if n == 0:
                yield np.zeros(0, np.uint64)
            elif n < size:
                own, power = w.hash[w.first[i] : w.first[i + 1]], powers(3, 16)[0]
                yield mixed((own * power[:n]).sum(keepdims=True) + np.uint64(n))
            else:
                yield np.unique(hashes[cuts[i] : cuts[i + 1]])


@lru_cache(1)
def _donors(bins: int) -> np.ndarray:
    """How early each bin (row) asks each other bin (column) for a value: random orders, the same for all documents."""
    return np.random.default_rng(6).permuted(np.tile(np.arange(bins, dtype=np.int16), (bins, 1)), axis=1)


def signature(own: np.ndarray, bins: int) -> np.ndarray:
    """The smallest hash of each bin; an empty bin has that of the first full one in its order. own: sorted distinct hashes, not empty."""
    place = ((own >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    out, full = np.zeros(bins, np.uint64), place[first]
    out[full] = own[first]
    if len(first) < bins:
        empty = np.setdiff1d(np.arange(bins), full, assume_unique=True)
        out[empty] = out[full[_donors(bins)[np.ix_(empty, full)].argmin(1)]]
    return out


def _signed(bands: int, rows: int, size: int):
    weights = mixed(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    salt = mixed(np.arange(1000, 1000 + bands, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, keys = [], [], [], []
            for own in shingle_sets(batch.column("text"), size):
                n.append(len(own))
                one.append(int(own.sum().astype(np.int64)) if len(own) else 0)
                two.append(int(mixed(own).sum().astype(np.int64)) if len(own) else 0)
                keys.append(mixed((signature(own, bands * rows).reshape(bands, rows) * weights).sum(1) + salt).view(np.int64) if len(own) else np.zeros(0, np.int64))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            values = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["doc_id", "n_shingles", "one", "two", "keys"])

    return run


def _blobs(size: int):
    """Sets as 6 bytes a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [own.view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for own in shingle_sets(batch.column("text"), size)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], ["node", "shingles"])

    return run


def _set(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).reshape(-1)


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("us"), batch.column("vs"), strict=True):
                x, y = _set(a.as_buffer().to_pybytes()), _set(b.as_buffer().to_pybytes())
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _compare(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Links between components among the members of two blocks, at most one for each that falls together."""
        table = table.combine_chunks()
        comp = table.column("component").to_numpy()
        side = table.column("side").to_numpy()
        sets = [_set(x.as_py()) for x in table.column("shingles")]
        size = np.array([len(s) for s in sets])
        rows = np.repeat(np.arange(len(sets)), size)
        _, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count > 1
        column = np.cumsum(shared) - 1
        keep = shared[which]
        rows, which = rows[keep], column[which[keep]]
        left, right = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
        common = np.zeros((len(left), len(right)), np.float32)
        place = np.zeros(len(sets), np.int64)
        place[left], alike = np.arange(len(left)), side.min() == side.max()
        place[right] = np.arange(len(right))
        order = np.argsort(which, kind="stable")
        rows, which = rows[order], which[order]
        for low in range(0, int(shared.sum()), _SLAB):
            a, b = np.searchsorted(which, [low, low + _SLAB])
            r, c = rows[a:b], which[a:b] - low
            l, m = np.zeros((len(left), _SLAB), np.float32), np.zeros((len(right), _SLAB), np.float32)
            on = slice(None) if alike else side[r] == side.min()
            l[place[r[on]], c[on]] = 1
            on = slice(None) if alike else side[r] != side.min()
            m[place[r[on]], c[on]] = 1
            common += l @ m.T
        union = size[left][:, None] + size[right][None, :] - common
        i, j = np.nonzero((100 * common >= percent * union) & (comp[left][:, None] != comp[right][None, :]))
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        u, v = [], []
        for a, b in zip(comp[left[i]].tolist(), comp[right[j]].tolist(), strict=True):
            x, y = top(a), top(b)
            if x != y:
                root[max(x, y)] = min(x, y)
                u.append(a)
                v.append(b)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _salted(rows: DataFrame, picks: DataFrame) -> DataFrame:
    """rows joined with picks, one for each key; a key's rows go to several tasks."""
    each = picks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALT - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(_SALT)).cast("int")).join(each, ["key", "salt"]).drop("salt")


def _joined(linked: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """linked (node, component) after further links (u, v) of nodes, and (component, lower) of the components that go up in others."""
    of = lambda c: linked.select(F.col("node").alias(c), F.col("component").alias(f"{c}c"))
    between = links.join(of("u"), "u").join(of("v"), "v").select(F.col("uc").alias("u"), F.col("vc").alias("v"))
    joined = written(components(between).select(F.col("node").alias("component"), F.col("component").alias("lower")), "joined")
    return written(linked.join(joined, "component", "left").select("node", F.coalesce("lower", "component").alias("component")), "components"), joined


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 80, bands: int = 40, rows: int = 6) -> DataFrame:
    """Per row of docs (doc_id, text): n_shingles, component_id (the smallest doc_id that links reach) and kept.

    Links hold documents whose sets of distinct `words`-word shingles have at least `percent` hundredths of their union in common.
    Texts without words, null texts among them, have no shingles and are linked with nothing. Rows with equal ids are one
    document, linked by any of its texts. Rows with a null id are kept and linked with nothing (component null). Equal rows get a
    row each; an empty table gives none; other columns, whatever their names, are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(docs.mapInArrow(_signed(bands, rows, words), "doc_id bigint, n_shingles bigint, one bigint, two bigint, keys array<bigint>"), "signatures")
    full = signed.where("doc_id is not null and n_shingles > 0")
    sets = written(full.groupBy("one", "two").agg(F.min(F.struct("doc_id", "keys")).alias("m")).select("one", "two", F.col("m.doc_id").alias("node"), "m.keys"), "sets")
    members = sets.select(F.explode("keys").alias("key"), "node")
    centres = members.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1")
    stars = written(members.join(centres, "key"), "buckets")
    edges = written(stars.where("node <> centre").select(F.col("centre").alias("u"), F.col("node").alias("v")).distinct(), "edges")
    asked = edges.select(F.col("u").alias("doc_id")).union(edges.select(F.col("v").alias("doc_id"))).distinct()
    shingles = written(docs.join(asked.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(_blobs(words), "node bigint, shingles binary"), "shingles")
    of = lambda c: shingles.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}s"))
    links = edges.join(of("u"), "u").join(of("v"), "v").select("u", "v", "us", "vs").mapInArrow(_confirmed(percent), "u bigint, v bigint")
    found = components(links)
    linked = written(asked.select(F.col("doc_id").alias("node")).join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "components")

    # buckets of three or more sets that still hold several components
    placed = written(stars.where("n > 2 and node <> centre").select("key", "node").join(linked, "node").withColumn("before", F.lit(None).cast("bigint")), "placed")
    waiting = linked.select("node", F.col("component").alias("lowest")).limit(0)  # members of buckets that take no further rounds, and a component there
    for left in range(ROUNDS, 0, -1):
        per = placed.groupBy("key", "component").agg(F.count("*").alias("n"), F.min("node").alias("centre"), F.max("before").alias("before"))
        picks = per.groupBy("key").agg(F.count("*").alias("several"), F.sum("n").alias("members"), F.max("n").alias("most"), F.max("before").alias("before"), F.min("component").alias("lowest"), F.min(F.struct("n", "centre", "component")).alias("m")).where("several > 1")
        waits = F.expr(f"coalesce(members <= {_SIDE} and members - most > {left} and 2 * several > before, false)")
        picks = written(picks.select("key", "several", "m.centre", F.col("m.component").alias("own"), "lowest", waits.alias("waits")), "centres")
        if picks.isEmpty():
            break
        rows = written(_salted(placed.drop("before"), picks), "buckets")
        waiting = waiting.union(rows.where("waits").select("node", "lowest"))
        rows = rows.where("not waits")
        asks = written(rows.where("component <> own").select(F.least("centre", "node").alias("u"), F.greatest("centre", "node").alias("v")).distinct(), "edges")
        more = asks.join(of("u"), "u").join(of("v"), "v").select("u", "v", "us", "vs").mapInArrow(_confirmed(percent), "u bigint, v bigint")
        linked, joined = _joined(linked, more)
        placed = written(rows.where("node <> centre").select("key", "node", "component", "several").join(joined, "component", "left").select("key", "node", F.coalesce("lower", "component").alias("component"), F.col("several").alias("before")), "placed")
    mixed_up = placed.groupBy("key").agg(F.min("component").alias("u"), F.max("component").alias("top")).where("u <> top").select("key", "u")
    now = linked.select(F.col("node").alias("lowest"), F.col("component").alias("u"))  # a component bears the name of one of its nodes
    waited = waiting.distinct().join(linked, "node").join(now, "lowest").select("node", "component", "u")
    rest = written(_salted(placed, mixed_up).select("node", "component", "u").union(waited).distinct(), "rest")
    if not rest.isEmpty():
        near = components(rest.select("u", F.col("component").alias("v")))
        near = rest.select("node", "component").distinct().join(near.select(F.col("node").alias("component"), F.col("component").alias("cluster")), "component")
        near = written(near.join(shingles.select("node", F.octet_length("shingles").alias("size")), "node"), "clusters")
        sides = near.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / _SIDE), F.ceil(F.sum("size") / _SIDE_BYTES)).cast("int").alias("sides"), F.min("component").alias("u"), F.max("component").alias("top"))
        sides = sides.where("u <> top").select("cluster", "sides")
        own = near.join(sides, "cluster").withColumn("side", F.pmod(F.xxhash64("node"), "sides").cast("int"))
        dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
        dealt = dealt.withColumn("a", F.least("side", "other")).withColumn("b", F.greatest("side", "other")).select("cluster", "component", "node", "side", "a", "b")
        more = dealt.join(shingles, "node").groupBy("cluster", "a", "b").applyInArrow(_compare(percent), "u bigint, v bigint")
        joined = components(more).select(F.col("node").alias("component"), F.col("component").alias("lower"))
        linked = linked.join(joined, "component", "left").select("node", F.coalesce("lower", "component").alias("component"))
    labels = sets.select("one", "two", "node").join(linked, "node", "left").select("one", "two", F.coalesce("component", "node").alias("found"))
    out = signed.select("doc_id", "n_shingles", "one", "two").join(labels, ["one", "two"], "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("found")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
