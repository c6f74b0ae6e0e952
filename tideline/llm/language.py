"""Language identification: interpolated Kneser-Ney models of characters, one a language, in sorted hash arrays.

Texts become symbols: lower-cased letters (one or two 16-bit units each, as in UTF-16), and one boundary for each run of other
characters. Counts of 4-symbol runs are gathered over all training documents in Spark; lower orders are continuation counts of the
order above. The model holds, for every run seen in any language, the interpolated log-probability in each; a run seen in none is
worked out from the lower orders. No run is left out: the tables are made in Spark, and lie in a file that each executor maps. A text
gets the language of the lowest cross-entropy a symbol.

Rejection is calibrated: a sixteenth of the training documents, by a hash of their texts, is not counted. How far the model finds each
of these above its language's mean cross-entropy, in deviations at its length, gives for each language the bound that a given share
of its documents exceeds; a text above the bound of its predicted language is rejected.
"""

from __future__ import annotations

import atexit
import math
import os
import shutil
import tempfile
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.store import written
from tideline.llm.words import chunks, mixed, text_bytes

_MASKS = [np.uint64((1 << (16 * k)) - 1) if k < 4 else np.uint64(0xFFFFFFFFFFFFFFFF) for k in range(5)]
_SHIFT = np.uint64(16)
UNCALIBRATED = 12.0  # deviations above which a language without calibration rejects


@lru_cache(1)
def _symbols() -> np.ndarray:
    """The lower-cased letter of each code point, 0 for all but letters."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and unicodedata.category(ch := chr(c))[0] == "L":
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the 4-symbol runs of some texts, the text of each, and each text's number of letters."""
    n = len(offsets) - 1
    begins = (data & 0xC0) != 0x80  # the first byte of each character
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    symbols = _symbols()[points]
    text = np.searchsorted(offsets, np.flatnonzero(begins), "right") - 1
    letters = np.bincount(text[symbols > 0], minlength=n)
    if (symbols > 0xFFFF).any():  # two units
        at = np.repeat(np.arange(len(symbols)), 1 + (symbols > 0xFFFF))
        second = np.append(False, at[1:] == at[:-1])
        symbols, text = symbols[at], text[at]
        wide, rest = symbols > 0xFFFF, symbols - np.uint32(0x10000)
        symbols = np.where(wide, np.where(second, 0xDC00 | (rest & 0x3FF), 0xD800 | (rest >> 10)), symbols)
    before = np.zeros(len(symbols), bool)
    before[1:] = (symbols[:-1] > 0) & (text[1:] == text[:-1])
    keep = (symbols > 0) | before
    symbols, text = symbols[keep].astype(np.uint64), text[keep]
    code = symbols.copy()
    for k in (1, 2, 3):
        same = text[k:] == text[:-k]
        code[k:] |= np.where(same, symbols[:-k], np.uint64(0)) << np.uint64(16 * k)
    return code, text, letters


class Table:
    """Values by 64-bit code in an array sorted by hash; a table of the leading bits says where to look."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        keys = mixed(codes)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.bits = max(1, int(len(codes) * 2).bit_length())
        self.index = np.searchsorted(self.keys >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.longest = int(np.diff(self.index).max()) if len(codes) else 0

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The row of each code, or -1."""
        keys = mixed(codes)
        lead = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        at, stop = self.index[lead], self.index[lead + 1]
        out = np.full(len(codes), -1, np.int64)
        open_ = np.flatnonzero(at < stop)
        for step in range(self.longest):
            here = at[open_] + step
            hit = self.keys[here] == keys[open_]
            out[open_[hit]] = here[hit]
            open_ = open_[~hit]
            open_ = open_[at[open_] + step + 1 < stop[open_]]
            if not len(open_):
                break
        return out


class KneserNey:
    """One language's counts in memory: for each order the runs, their (continuation) counts, and the totals of their contexts.
    train() works out the same in Spark; tests hold it to this."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, symbols: int):
        self.orders, self.symbols = {}, symbols
        for k in (4, 3, 2, 1):
            if k < 4:
                codes, counts = np.unique(codes & _MASKS[k], return_counts=True)
            once, twice = int((counts == 1).sum()), int((counts == 2).sum())
            discount = once / (once + 2 * twice) if once else 0.5
            context, first = np.unique(codes >> _SHIFT, return_index=True)  # codes are sorted, so contexts are runs
            totals = np.add.reduceat(counts.astype(np.float64), first)
            kinds = np.diff([*first, len(codes)])
            self.orders[k] = (Table(codes, counts.astype(np.float64)), Table(context, np.stack([totals, kinds.astype(np.float64)], 1)), discount)

    def probability(self, codes: np.ndarray, k: int = 4) -> np.ndarray:
        if k == 0:
            return np.full(len(codes), 1 / self.symbols)
        lower = self.probability(codes & _MASKS[k - 1], k - 1)
        table, contexts, discount = self.orders[k]
        at, own = contexts.find(codes >> _SHIFT), table.find(codes)
        known = at >= 0
        total = np.where(known, contexts.values[at, 0], 1.0)
        count = np.where(own >= 0, table.values[own], 0.0)
        return np.where(known, np.maximum(count - discount, 0) / total + discount * contexts.values[at, 1] / total * lower, lower)


class Files:
    """Sorted hash tables in one file, which Spark gives to each executor; its Python workers map the file and share its pages."""

    def __init__(self, path: str):
        self.name, self.places, self.end = os.path.basename(path), {}, 0
        self.file = open(path, "w+b")  # noqa: SIM115

    def put(self, at: int, values: np.ndarray) -> None:
        self.file.seek(at)
        self.file.write(np.ascontiguousarray(values).data)

    def add(self, name: str, held: DataFrame, kind: str, width: int, gathered: int) -> None:
        """Add the table of held (code, hash, value: array of `width`), gathered in runs of hashes of about `gathered` rows."""
        n = held.count()
        cut = max(0, math.ceil(math.log2(max(1, n / gathered))))
        bits = max(cut, 1, int(n * 2).bit_length())
        keys = self.end
        values = keys + 8 * n
        index = values + -(-np.dtype(kind).itemsize * width * n // 8) * 8
        self.end = index + 8 * ((1 << bits) + 1)
        done = longest = 0
        for k in range(1 << cut):
            part = held
            if cut:
                low = np.array([k << (64 - cut), ((k + 1) << (64 - cut)) - 1], np.uint64).view(np.int64)
                part = held.where(F.col("hash").between(int(low[0]), int(low[1])))
            table = part.select("hash", "value").toArrow()
            own = table.column("hash").to_numpy().view(np.uint64)
            order = np.argsort(own)
            own = own[order]
            self.put(keys + 8 * done, own)
            value = table.column("value").combine_chunks().flatten().to_numpy().reshape(-1, width)[order].astype(kind)
            self.put(values + value.itemsize * width * done, value)
            lead = np.arange(k << (bits - cut), (k + 1) << (bits - cut), dtype=np.uint64)
            at = np.searchsorted(own >> np.uint64(64 - bits), lead)
            self.put(index + 8 * int(lead[0]), at.astype(np.int64) + done)
            longest = max(longest, int(np.diff([*at[-1:], len(own)]).max()), int(np.diff(at).max(initial=0)))
            done += len(own)
        self.put(index + 8 * (1 << bits), np.array([done], np.int64))
        self.places[name] = keys, values, index, n, width, kind, bits, longest

    def shipped(self, spark: SparkSession) -> tuple[str, dict]:
        self.file.close()
        spark.sparkContext.addFile(self.file.name)
        return self.name, self.places


def _mapped(path: str, place: tuple) -> Table:
    keys, values, index, n, width, kind, bits, longest = place
    out = Table.__new__(Table)
    held = np.asarray(np.memmap(path, np.uint8, "r"))
    out.keys = held[keys : keys + 8 * n].view(np.uint64)
    out.values = held[values : values + np.dtype(kind).itemsize * width * n].view(kind).reshape(n, width)
    out.index = held[index : index + 8 * ((1 << bits) + 1)].view(np.int64)
    out.bits, out.longest = bits, longest
    return out


class LanguageModel:
    """langs in order; tables: for each order the runs' probabilities by run and language (their logarithms for the longest), and what
    each context leaves to the order below; centre and spread of each language's own cross-entropy, and the bound above which it rejects."""

    _held: dict[str, dict[str, Table]] = {}

    def __init__(self, langs: list[str], symbols: int, files: tuple[str, dict], centre: np.ndarray, spread: np.ndarray):
        self.langs, self.symbols, self.files, self.centre, self.spread = langs, symbols, files, centre, spread
        self.bounds = np.full(len(langs), UNCALIBRATED)

    @property
    def tables(self) -> dict[str, Table]:
        name, places = self.files
        if name not in self._held:
            self._held.clear()
            path = SparkFiles.get(name)
            self._held[name] = {k: _mapped(path, place) for k, place in places.items()}
        return self._held[name]

    def probability(self, codes: np.ndarray, k: int) -> np.ndarray:
        """In each language; a run seen in none has what its contexts leave of the lower orders."""
        if k == 0:
            return np.full((len(codes), len(self.langs)), 1 / self.symbols)
        at = self.tables[f"runs{k}"].find(codes) if k < 4 else np.full(len(codes), -1)
        out = np.empty((len(codes), len(self.langs)))
        seen, new = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        if len(seen):
            out[seen] = self.tables[f"runs{k}"].values[at[seen]]
        if len(new):
            context = self.tables[f"left{k}"].find(codes[new] >> _SHIFT)
            left = np.ones((len(new), len(self.langs)))
            left[context >= 0] = self.tables[f"left{k}"].values[context[context >= 0]]
            out[new] = left * self.probability(codes[new] & _MASKS[k - 1], k - 1)
        return out

    def logs(self, codes: np.ndarray) -> np.ndarray:
        table = self.tables["runs4"]
        at = table.find(codes)
        out = table.values[at].astype(np.float64)
        new = np.flatnonzero(at < 0)
        if len(new):
            some, which = np.unique(codes[new], return_inverse=True)
            out[new] = np.log(self.probability(some, 4))[which]
        return out

    def excess(self, entropy: np.ndarray, sizes: np.ndarray, which: np.ndarray | int) -> np.ndarray:
        """How far cross-entropies are above a language's mean, in its deviations at the texts' lengths; beyond 256 symbols a text's
        neighbours tell little more."""
        return (entropy - self.centre[which]) * np.sqrt(np.clip(sizes, 1, 256)) / np.maximum(self.spread[which], 1e-9)

    def entropies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy a symbol of each text in each language, and its numbers of symbols and letters."""
        n = len(offsets) - 1
        codes, text, letters = grams(data, offsets)
        logs = self.logs(codes)
        sizes = np.bincount(text, minlength=n)
        sums = np.stack([np.bincount(text, weights=logs[:, i], minlength=n) for i in range(len(self.langs))], 1)
        return -sums / np.maximum(sizes, 1)[:, None], sizes, letters

    def classify(self, data: np.ndarray, offsets: np.ndarray):
        """For each text: language (None without letters), score, cross-entropy and whether it is rejected."""
        n = len(offsets) - 1
        entropy, sizes, letters = self.entropies(data, offsets)
        best = entropy.argmin(1)
        low = entropy[np.arange(n), best]
        score = 1 / np.exp(low[:, None] - entropy).sum(1)
        rejected = self.excess(low, sizes, best) > self.bounds[best]
        known = letters > 0
        return [self.langs[b] if k else None for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0), np.where(known, low, np.nan), rejected | ~known


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        codes, which = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return codes, np.bincount(which, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        data, offsets = text_bytes(batch.column("text"))
        for a, b in chunks(offsets):
            codes, text, _ = grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            names, which = np.unique(langs[a:b].astype(str), return_inverse=True)
            own = which[text]
            for i, name in enumerate(names.tolist()):
                parts = held.setdefault(name, [])
                parts.append(np.unique(codes[own == i], return_counts=True))
                if len(parts) >= 16:
                    held[name] = [merged(parts)]
    for name, parts in held.items():
        codes, n = merged(parts)
        for low in range(0, len(codes), 1 << 16):
            part = codes[low : low + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(part.view(np.int64)), pa.array(n[low : low + (1 << 16)])], ["lang", "code", "n"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = mixed(batch.column("code").to_numpy(zero_copy_only=False).view(np.uint64))
        yield batch.append_column("hash", pa.array(keys.view(np.int64)))


def _by_hash(rows: DataFrame, name: str) -> DataFrame:
    """rows with the hash of their code, stored in its order, so that a run of hashes is read alone."""
    fields = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return written(rows.mapInArrow(_hashed, f"{fields}, hash bigint").repartitionByRange("hash").sortWithinPartitions("hash"), name)


def held_back(text: Column, calibrate: int = 16) -> Column:
    """Whether a text serves the calibration and is not counted; copies of a text go together."""
    return F.pmod(F.xxhash64(text), F.lit(calibrate)) == 0


def _calibrated(model: LanguageModel, docs: DataFrame, false_rejections: float) -> LanguageModel:
    """The model with each language's bound, from documents (text, lang) that it has not counted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            langs = batch.column("lang").to_pylist()
            for a, b in chunks(offsets):
                entropy, sizes, letters = own.entropies(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                which = np.array([own.langs.index(x) for x in langs[a:b]], np.int64)
                far = own.excess(entropy[np.arange(b - a), which], sizes, which)
                known = letters > 0
                yield pa.RecordBatch.from_arrays([pa.array(which[known]), pa.array(far[known])], ["which", "far"])

    docs = docs.where(F.col("lang").isin(model.langs))
    found = docs.mapInArrow(run, "which bigint, far double").groupBy("which").agg(F.count("*").alias("n"), F.percentile_approx("far", 1 - false_rejections, 10_000).alias("bound")).collect()  # a row for each language
    for r in found:
        if r["n"] >= 1 / false_rejections / 4:
            model.bounds[r["which"]] = r["bound"]
    return model


def train(docs: DataFrame, gathered: int = 1 << 25, calibrate: int = 16, false_rejections: float = 0.01) -> LanguageModel | None:
    """A model of docs (text, lang): rows with a null text or lang count for nothing; None if there is no letter in any.

    calibrate: of languages with at least 64 documents one in so many is held back from the counts, to find the bound that
    `false_rejections` of a language's documents exceed; 0 holds back none. Languages with fewer have a bound of UNCALIBRATED
    deviations. Equal texts count as often as they come, or calibrate together.

    Every other run that is seen counts, however rare. Counts, discounts and probabilities are worked out in Spark; the driver writes the
    tables to a local file, `gathered` bytes at once, and holds none of them."""
    spark = docs.sparkSession
    docs = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    aside = None
    if calibrate:
        many = [r["lang"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).where("n >= 64").collect()]  # a row for each language
        back = F.col("lang").isin(many) & held_back(F.col("text"), calibrate)
        docs, aside = docs.where(~back), docs.where(back)
    rows = docs.mapInArrow(_counted, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    counts = {4: written(rows, "runs")}
    for k in (3, 2, 1):
        lower = counts[k + 1].select("lang", F.col("code").bitwiseAND(F.lit(int(_MASKS[k]))).alias("code"))
        counts[k] = written(lower.groupBy("lang", "code").agg(F.count("*").alias("n")), f"runs{k}")
    langs = sorted(r["lang"] for r in counts[1].select("lang").distinct().collect())
    if not langs:
        return None
    symbols = counts[1].select("code").distinct().count() + 1
    names = F.array(*[F.lit(x) for x in langs])

    def dense(rows: DataFrame, *columns: str) -> DataFrame:
        """A row for each code, with an array over the languages for each column, 0 where a language lacks the code."""
        held = rows.groupBy("code").agg(F.map_from_entries(F.collect_list(F.struct("lang", F.struct(*columns)))).alias("held"))
        of = lambda c: lambda x: F.coalesce(F.try_element_at("held", x)[c].cast("double"), F.lit(0.0))
        return held.select("code", *[F.transform(names, of(c)).alias(c) for c in columns])

    folder = tempfile.mkdtemp(prefix="tideline-model-")
    atexit.register(shutil.rmtree, folder, True)
    files = Files(f"{folder}/model-{uuid.uuid4().hex}")
    each = max(1, gathered // (8 + 8 * len(langs)))
    below = spark.range(1).select(F.lit(0).cast("bigint").alias("below"), F.array_repeat(F.lit(1 / symbols), len(langs)).alias("low"))
    for k in (1, 2, 3, 4):
        few = {r["lang"]: (r["once"], r["twice"]) for r in counts[k].groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).collect()}
        discounts = F.array(*[F.lit(once / (once + 2 * twice) if once else 0.5) for once, twice in map(few.get, langs)])
        contexts = counts[k].groupBy("lang", F.shiftrightunsigned("code", 16).alias("code")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        at = F.sequence(F.lit(0), F.lit(len(langs) - 1))
        left = F.transform(at, lambda i: F.when(F.get("total", i) > 0, F.get(discounts, i) * F.get("kinds", i) / F.get("total", i)).otherwise(1.0))  # noqa: B023
        lefts = _by_hash(dense(contexts, "total", "kinds").select("code", "total", left.alias("value")), f"left{k}")
        files.add(f"left{k}", lefts, "f8", len(langs), each)
        own = dense(counts[k], "n").withColumn("context", F.shiftrightunsigned("code", 16)).withColumn("below", F.col("code").bitwiseAND(F.lit(int(_MASKS[k - 1]))))
        met = own.join(lefts.select(F.col("code").alias("context"), "total", F.col("value").alias("left")), "context").join(below, "below")
        most = F.transform(at, lambda i: F.when(F.get("total", i) > 0, F.greatest(F.get("n", i) - F.get(discounts, i), F.lit(0.0)) / F.get("total", i)).otherwise(0.0) + F.get("left", i) * F.get("low", i))  # noqa: B023
        value = F.transform(most, lambda p: F.log(p)) if k == 4 else most
        runs = _by_hash(met.select("code", "n", value.alias("value")), f"runs{k}")
        files.add(f"runs{k}", runs, "f4" if k == 4 else "f8", len(langs), each)
        below = runs.select(F.col("code").alias("below"), F.col("value").alias("low"))
    per = runs.select(F.posexplode(F.arrays_zip("n", "value"))).select("pos", F.col("col.n").alias("n"), (-F.col("col.value").cast("float").cast("double")).alias("own"))
    sums = per.groupBy("pos").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("own")).alias("own"), F.sum(F.col("n") * F.col("own") * F.col("own")).alias("square")).orderBy("pos").collect()
    n, own, square = (np.array([r[c] for r in sums]) for c in ("n", "own", "square"))
    centre = own / n
    model = LanguageModel(langs, symbols, files.shipped(spark), centre, np.sqrt(np.maximum(square / n - centre**2, 0)))
    return _calibrated(model, aside, false_rejections) if aside is not None else model


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """Per row of docs (doc_id, text): lang_pred (`und` where the text is null or has no letter), score, cross_entropy, rejected. Equal
    texts get equal results, each row its own; equal cross-entropies go to the first language; an empty table gives none; other columns,
    whatever their names, are ignored."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in chunks(offsets):
                langs, score, entropy, rejected = sent.value.classify(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                columns = [batch.column("doc_id").slice(a, b - a), pa.array([x or "und" for x in langs]), pa.array(score), pa.array(entropy, mask=np.isnan(entropy)), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return docs.mapInArrow(run, "doc_id bigint, lang_pred string, score double, cross_entropy double, rejected boolean")
