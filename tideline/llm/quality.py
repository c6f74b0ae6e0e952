"""Quality classifier by importance resampling: the ratio of hashed n-gram models of target and raw text, and a Gumbel top-k sample.

Features of a text are its lower-cased words, the shapes of its space-parted tokens, pairs of neighbouring shapes, and words that come
two or five times in a row, each hashed to one of 2 ** BITS buckets; a bucket that a text meets c times counts log2(1 + c). Raw counts
cover every document, target counts a bounded set of labelled good ones. A document's log-weight is the sum, over its buckets, of
count times the log of the target's share by the raw text's share: positive for what target text has more of, negative for what it
has less of. A bucket's ratio is smoothed, and is taken for 1 while the two counts differ by less than `clear` standard deviations,
since the target is small. The document's own counts are left out of both models, so labelled documents are judged as unseen ones.

The sample: key = sharpness * log-weight + Gumbel noise; the k largest keys stay. k is the number of documents at or above the
log-weight that parts the labelled rows best, so k follows the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.store import written
from tideline.llm.words import LOWER, Words, chunks, mixed, text_bytes

BITS = 20
_SLICE = 1 << 14

#: Bytes of the shapes: upper case, lower case and beyond ASCII, digits; white space stays, other characters stay.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:], _SHAPE[48:58] = 65, 97, 97, 48
#: Lower-cased letters and digits; all else is a space.
_PLAIN = LOWER.copy()
_PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 32


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct buckets of each text, the text of each, and how much it counts there, in sixteenths."""
    words = Words(_PLAIN[data], offsets)
    shape = _SHAPE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    keep = np.ones(len(data), bool)
    keep[1:] = (shape[1:] != shape[:-1]) | edge[1:-1]
    at = np.concatenate([[0], np.cumsum(keep)])
    shapes = Words(shape[keep], at[offsets])
    one, two = shapes.windows(1), shapes.windows(2)
    again = np.flatnonzero((words.hash[1:] == words.hash[:-1]) & (words.text[1:] == words.text[:-1]))
    often = again[3:][again[3:] - again[:-3] == 3]
    runs = np.repeat(mixed(np.array([11, 12], np.uint64)), [len(again), len(often)])
    hashes = np.concatenate([mixed(words.hash), mixed(one[0] + np.uint64(1)), mixed(two[0] + np.uint64(2)), runs])
    text = np.concatenate([words.text, shapes.text[one[1]], shapes.text[two[1]], words.text[again], words.text[often]])
    pairs, times = np.unique((text << BITS) | (hashes >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    return pairs & ((1 << BITS) - 1), pairs >> BITS, np.rint(16 * np.log2(1 + times)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the task's raw and target features, in slices of the buckets."""
    raw, target = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for batch in batches:
        good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
        data, offsets = text_bytes(batch.column("text"))
        for a, b in chunks(offsets):
            bucket, text, counts = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            np.add.at(raw, bucket, counts)
            if good[a:b].any():
                own = good[a:b][text]
                np.add.at(target, bucket[own], counts[own])
    for k in range(0, 1 << BITS, _SLICE):
        at = np.flatnonzero(raw[k : k + _SLICE])
        if len(at):  # places, raw and target counts of the buckets that the task has met
            blobs = at.astype(np.uint16), raw[k + at], target[k + at]
            yield pa.RecordBatch.from_arrays([pa.array([k]), *[pa.array([b.tobytes()]) for b in blobs]], ["slice", "places", "raw", "target"])


def _summed(table: pa.Table) -> pa.Table:
    raw, target = np.zeros(_SLICE, np.int64), np.zeros(_SLICE, np.int64)
    for p, r, t in zip(*(table.column(n) for n in ("places", "raw", "target")), strict=True):
        at = np.frombuffer(p.as_py(), np.uint16)
        raw[at] += np.frombuffer(r.as_py(), np.int64)
        target[at] += np.frombuffer(t.as_py(), np.int64)
    return pa.table({"slice": pa.array([table.column("slice")[0].as_py()]), "raw": pa.array([raw.tobytes()]), "target": pa.array([target.tobytes()])})


class Ratio:
    """Raw and target counts of all buckets, in sixteenths."""

    def __init__(self, raw: np.ndarray, target: np.ndarray, prior: float = 1.0, clear: float = 2.5):
        self.raw, self.target, self.prior, self.clear = raw, target, prior, clear
        self.share = target.sum() / max(1, raw.sum())

    def logs(self, bucket: np.ndarray, counts: np.ndarray, good: np.ndarray) -> np.ndarray:
        """log((target + prior) / (expected + prior)) of each bucket without the document's own counts (in the target too if it is
        good), expected being its raw count at the target's size; 0 unless the two differ by `clear` deviations."""
        expected = (self.raw[bucket] - counts) / 16 * self.share
        target = (self.target[bucket] - np.where(good, counts, 0)) / 16
        differs = np.abs(target - expected) >= self.clear * np.sqrt(expected + 1)
        return np.where(differs, np.log((target + self.prior) / (expected + self.prior)), 0.0)


def _sample(labels: DataFrame, most: int) -> DataFrame:
    """At most so many labelled ids, by the order of their hashes; an id is good if all its rows say so."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    per = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min(good).alias("good"))
    return written(per.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "labels")


def _marked(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """docs with good, whether a document is one of the target's; the sample has a bounded number of rows, so it is broadcast."""
    return docs.join(F.broadcast(sample), "doc_id", "left").withColumn("good", F.coalesce("good", F.lit(False)))


def fit(docs: DataFrame, sample: DataFrame) -> Ratio:
    """Counts over all documents and over the good ones of the labelled sample."""
    marked = _marked(docs, sample).select("text", "good")
    counts = marked.mapInArrow(_counted, "slice bigint, places binary, raw binary, target binary")
    rows = counts.groupBy("slice").applyInArrow(_summed, "slice bigint, raw binary, target binary").toArrow()  # a row for each slice of the buckets
    raw, target = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for k, r, t in zip(*(rows.column(n).to_pylist() for n in ("slice", "raw", "target")), strict=True):
        raw[k : k + _SLICE], target[k : k + _SLICE] = np.frombuffer(r, np.int64), np.frombuffer(t, np.int64)
    return Ratio(raw, target)


def log_weights(docs: DataFrame, sample: DataFrame, ratio: Ratio) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
            data, offsets = text_bytes(batch.column("text"))
            for a, b in chunks(offsets):
                bucket, text, counts = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                total = np.bincount(text, weights=sent.value.logs(bucket, counts, good[a:b][text]) * counts / 16, minlength=b - a)
                size = np.bincount(text, minlength=b - a)
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in (batch.column("doc_id"), batch.column("text_hash"))], pa.array(size, pa.int64()), pa.array(np.round(total, 6), pa.float64())], ["doc_id", "text_hash", "n_features", "log_weight"])

    marked = _marked(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), sample)
    return marked.select("doc_id", "text_hash", "text", "good").mapInArrow(run, "doc_id bigint, text_hash bigint, n_features bigint, log_weight double")


def best_cut(scored: DataFrame, sample: DataFrame, good_counts: float = 4.0) -> float:
    """The log-weight at and above which a labelled document is taken for good, with the least sum of the shares of both classes that
    are taken wrongly, a good one's counting `good_counts` times: midway between the labelled ones beside it, and 0 at most, so that texts of
    which nothing is known stay; -1 where the labels hold one class only."""
    step = F.floor(F.least(F.greatest(F.col("log_weight"), F.lit(-64.0)), F.lit(64.0)) * 16).cast("int")
    rows = scored.join(F.broadcast(sample), "doc_id").groupBy(step.alias("step"), "good").count().collect()  # 2049 steps at most
    good, bad = ({r["step"]: r["count"] for r in rows if r["good"] == g} for g in (True, False))
    if not good or not bad:
        return -1.0
    all_good, all_bad = sum(good.values()), sum(bad.values())
    below_good = below_bad = 0
    best, cut = good_counts + 2.0, 0.0
    steps = sorted({*good, *bad})
    for s, after in zip(steps, [*steps[1:], steps[-1] + 1], strict=True):  # a cut between two steps
        below_good += good.get(s, 0)
        below_bad += bad.get(s, 0)
        cost = good_counts * below_good / all_good + (all_bad - below_bad) / all_bad
        if cost < best - 1e-9:
            best, cut = cost, (s + 1 + after) / 32
    return min(cut, 0.0) if best < 1.0 else -64.0


def gumbel(column: Column, seed: int) -> Column:
    """Noise that depends on the value and the seed only."""
    uniform = (F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def top_k(keyed: DataFrame, k: int, column: str = "key") -> DataFrame:
    """keyed with `kept`, true for the k rows of the largest keys (equal keys: the smaller doc_id, then text_hash, first; rows alike
    in all of these stay or go together).

    No sort of all rows: counts in 4096 bins find the bin of the k-th key, which is cut again until few rows are left in it."""
    ends = keyed.agg(F.min(column).alias("a"), F.max(column).alias("b"), F.count("*").alias("n")).first()
    if k >= ends["n"]:
        return keyed.withColumn("kept", F.lit(True))
    if k <= 0:
        return keyed.withColumn("kept", F.lit(False))
    low, high, above = ends["a"], ends["b"], 0
    inside = keyed
    for _ in range(12):
        width = (high - low) / 4096
        if width <= 0 or low + width == low:
            break
        place = F.least(F.floor((F.col(column) - low) / width), F.lit(4095)).cast("int")
        counts = sorted((r["p"], r["count"], r["a"], r["b"]) for r in inside.groupBy(place.alias("p")).agg(F.count("*").alias("count"), F.min(column).alias("a"), F.max(column).alias("b")).collect())
        for _, n, a, b in reversed(counts):
            if above + n >= k:
                low, high = a, b
                break
            above += n
        inside = keyed.where(F.col(column).between(low, high))
        if n <= 1000:
            break
    # the k-th row is one of few, or of rows with one key: rows alike count together before any sort
    few = inside.groupBy(column, "doc_id", "text_hash").agg(F.count("*").alias("n"))
    running = Window.orderBy(F.col(column).desc(), F.col("doc_id").asc_nulls_last(), F.col("text_hash")).rowsBetween(Window.unboundedPreceding, 0)
    last = few.withColumn("n", F.sum("n").over(running)).where(F.col("n") >= k - above).orderBy("n").first()
    by_id = F.lit(True) if last["doc_id"] is None else F.coalesce((F.col("doc_id") < last["doc_id"]) | ((F.col("doc_id") == last["doc_id"]) & (F.col("text_hash") <= last["text_hash"])), F.lit(False))
    return keyed.withColumn("kept", (F.col(column) > last[column]) | ((F.col(column) == last[column]) & by_id))


def quality(docs: DataFrame, labels: DataFrame, most_labels: int = 20_000, sharpness: float = 2.0, seed: int = 4) -> DataFrame:
    """Per row of docs (doc_id, text): text_hash, n_features, log_weight, score (0 to 1), key, kept.

    labels: (doc_id, quality, toxic); at most `most_labels` of them, by hash, serve as target and to place the cut. Without any
    label of a good document nothing is known of the target: all log-weights are 0 and all documents stay. Null, empty and
    featureless texts have the log-weight 0. Rows alike in id and text get one result each, the same; equal keys go by id. An empty
    table gives none. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = _sample(labels, most_labels)
    nothing = np.zeros(1 << BITS, np.int64)
    ratio = fit(docs, sample) if not sample.where("good").isEmpty() else Ratio(nothing, nothing)
    scored = written(log_weights(docs, sample, ratio), "weights")
    cut = best_cut(scored, sample)
    k = scored.where(F.col("log_weight") >= cut).count()
    keyed = scored.withColumn("key", sharpness * (F.col("log_weight") - cut) + gumbel(F.struct("doc_id", "text_hash"), seed))
    return top_k(keyed, k).withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.col("log_weight") - cut))))
