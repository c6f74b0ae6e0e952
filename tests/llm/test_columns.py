"""Media, token files and sentence pieces: exact round trips and parity with the libraries."""

import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tideline.llm import media, sentence_pieces, token_files

TEXTS = [
    None, "", " ", "Hello World's it's", "a\tb\x0bc\x0cd\re\nf  g", "naïve ÉCOLE café ΣΑΣ", "x<|endoftext|>y <|startoftext|>", "<s> </s> <unk> <0x41> ▁▁a ▁b", "   lead and trail   ", "日本語 😀👍🏽 ‍", "a b c\x1fd\x00e",
    "don't we'll I'M they'RE 123 4.5e6 !!!???", "\n\n\n x \n y", "w" * 3000, "same text", "same text", "ab " * 5000 + "é́" * 3, "l'été d'en  haut\r\n--", "́x ́", "İstanbul ǅ ﬁ",
]


def test_media(make):
    docs = make(TEXTS)
    for adaptive in (False, True):
        got = {r.doc_id: r for r in media.read_media(media.text_media(docs, adaptive=adaptive)).collect()}
        for i, t in enumerate(TEXTS):
            data = (t or "").encode()
            want = data + bytes(-len(data) % 64) if data else bytes(64)
            assert bytes(got[i].payload) == want and got[i].n_bytes == len(data) and len(got[i].feature) == 16
        assert got[14].feature == got[15].feature and bytes(got[14].media) == bytes(got[15].media)
    assert media.read_media(media.text_media(make([]))).count() == 0


def test_png_filters():
    """All five row filters against a plain decoder, one channel and three."""
    rng = np.random.default_rng(1)
    for colour, step in ((0, 1), (2, 3)):
        width, height = 7, 15
        raw = rng.integers(0, 256, (height, width * step + 1), dtype=np.uint8)
        raw[:, 0] = rng.integers(0, 5, height)
        want = np.zeros((height, width * step), int)
        for y in range(height):
            for x in range(width * step):
                a = want[y, x - step] if x >= step else 0
                b = want[y - 1, x] if y else 0
                c = want[y - 1, x - step] if y and x >= step else 0
                p = a + b - c
                paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                want[y, x] = (int(raw[y, 1 + x]) + [0, a, b, (a + b) // 2, paeth][raw[y, 0]]) & 255
        png = media._SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + media._chunk(b"IDAT", zlib.compress(raw.tobytes())) + media._chunk(b"IEND", b"")
        assert (media.decode_png(png).reshape(height, -1) == want).all()


def plain_png(data):
    """Samples of a grey image by a plain decoder, and its rows' filters."""
    at, body = 8, b""
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind = data[at + 4 : at + 8]
        assert zlib.crc32(data[at + 4 : at + 8 + n]) == struct.unpack_from(">I", data, at + 8 + n)[0]
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", data, at + 8)
        body += data[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    raw, before, out, kinds = zlib.decompress(body), [0] * width, bytearray(), []
    for y in range(height):
        kind, *row = raw[y * (width + 1) : (y + 1) * (width + 1)]
        kinds.append(kind)
        for x in range(width):
            a, b, c = (row[x - 1] if x else 0), before[x], (before[x - 1] if x else 0)
            p = a + b - c
            row[x] = (row[x] + [0, a, b, (a + b) // 2, min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]][kind]) & 255
        out += bytes(row)
        before = row
    return bytes(out), kinds


def plain_feature(payload):
    """The cosine hash from its definition: means of 32 by 32 cells, cosine sums, signs against the median."""
    import math
    from statistics import median

    height = len(payload) // 64
    cells = lambda n: [range(i * n // 32, max((i + 1) * n // 32, i * n // 32 + 1)) for i in range(32)]
    mean = [[sum(payload[y * 64 + x] for y in ys for x in xs) / (len(ys) * len(xs)) for xs in cells(64)] for ys in cells(height)]
    wave = [[math.cos(math.pi * k * (2 * x + 1) / 64) for x in range(32)] for k in range(1, 9)]
    part = [[sum(wave[u][y] * mean[y][x] for y in range(32)) for x in range(32)] for u in range(8)]
    low = [round(sum(part[u][x] * wave[v][x] for x in range(32)), 6) for u in range(8) for v in range(8)]
    middle = median(low)
    return f"{int(''.join('01'[v > middle] for v in low), 2):016x}"


def test_media_query_against_plain_code(spark):
    """Every document of the smallest table: stored bytes, payload, digests and feature by code that shares nothing with the operator."""
    from tideline.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    media_of = {r.doc_id: bytes(r.media) for r in media.text_media(docs).collect()}
    met = set()
    for r in queries.op5_media_columns(spark, "/root/testdata/sf0.001").collect():
        data, png = texts[r.doc_id], media_of[r.doc_id]
        payload, kinds = plain_png(png)
        met |= set(kinds)
        assert payload == data + bytes(-len(data) % 64) if data else bytes(64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(png), hashlib.sha256(png).hexdigest())
        assert len(data) > 20_000 or r.feature == plain_feature(payload)
    assert met == {0, 1, 2, 3, 4}


def test_media_of_long_texts_and_clashing_names(clashing):
    """Blocks of rows are filtered apart; images of many heights are unfiltered together."""
    texts = ["".join(chr(97 + (i * k) % 23) for i in range(n)) for k, n in ((3, 64 * 4096 * 2 + 5), (5, 64 * 4097), (7, 10), (11, 640), (2, 64 * 300))]
    got = {r.doc_id: r for r in media.read_media(media.text_media(clashing([*texts, None]))).collect()}
    assert all(bytes(got[i].payload)[: len(t)] == t.encode() for i, t in enumerate(texts)) and len(got) == 6
    assert plain_png(media.encode_png(media.payload_of(texts[0])))[0] == media.payload_of(texts[0])


def test_png_damage():
    png = media.encode_png(bytes(range(64)) * 4)
    for bad in (png[:20], png[:-1], png[:30] + bytes([png[30] ^ 1]) + png[31:], b"x" + png[1:], png[:50] + b"zz" + png[52:]):
        with pytest.raises(ValueError):
            media.decode_png(bad)


def tokens(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(text or "", add_special_tokens=False).ids, 2]


def test_word_ids_of_documents_and_other_tokenizers():
    """Words apart against whole texts; a tokenizer of other settings takes whole texts."""
    import duckdb
    from tokenizers import Tokenizer

    texts = [t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()] + [t or "" for t in TEXTS]
    texts += ["END., of; the: LINE!?\n", "a,,b .,x c.̸ d,", "<|ENDOFTEXT|> word.<|endoftext|>. x,<|y", "é, É. e\u0301, \u0130."]
    for name, apart in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        path = public_tokenizers.path(name)
        own, whole = token_files.TextIds(path), Tokenizer.from_file(path)
        assert own.by_words == apart
        flat, sizes = own.ids([t.encode() for t in texts])
        for t, part in zip(texts, np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
            assert part.tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_word_ids_of_marks_and_punctuation():
    """Capitals before a combining mark keep their case until the normaliser has run; one entry serves a word in either case and
    with any ASCII punctuation after it."""
    import random

    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, whole = token_files.TextIds(path), Tokenizer.from_file(path)
    rng = random.Random(9)
    parts = [*"aAJHTWYEé1 ..,%#&*'<|~\n\t\x00\x1c\x7f\x85\xa0ÉßÿŸ×÷Þİı本²—", "\u0301", "\u030c", "\u0308", "\u0331", "\u0338", "'s", "'re", "<|endoftext|>", "<|EndOfText|>"]
    texts = ["J\u030c H\u0331 T\u0308 W\u030a Y\u030a", "É\u0327É ×! ÷? Þ.", "", *("".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(1500))]
    texts += [t.replace("<|", "") for t in texts]
    flat, sizes = own.ids([t.encode() for t in texts])
    assert len(sizes) == len(texts)
    for t, part in zip(texts, np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
        assert part.tolist() == whole.encode(t, add_special_tokens=False).ids, t
    own = token_files.TextIds(path)
    own.ids([t.encode() for t in ("wort WORT wort%%% Wort.*** wort$$$", "größe GRÖßE Größe### größe,***")])
    assert own.segments.n == 7 and own.ids([])[0].tolist() == []


def test_token_files(spark, make):
    ids = [100 - i for i in range(len(TEXTS))]
    path, bounds = token_files.write_token_files(make(TEXTS, ids), public_tokenizers.path("word_bpe_49k.json"), 2)
    rows = token_files.read_token_files(spark, path)
    want = {d: tokens(t) for d, t in zip(ids, TEXTS, strict=True)}
    assert {r.doc_id: r.ids for r in rows.collect()} == want
    start = 0
    for r in token_files.token_index(rows, bounds).orderBy("doc_id").collect():
        own = want[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)
    some = token_files.read_token_files(spark, path, ids=[90, 95])
    assert {r.doc_id for r in some.collect()} == {90, 95} and "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()


def scanned_rows(df):
    """Rows that the scan gave, after what the reader skipped."""
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return rows, leaves.apply(0).metrics().apply("numOutputRows").value()


def test_token_files_are_pruned(spark, tmp_path):
    """Files of other id ranges and row groups are skipped by statistics and row indexes, and by Bloom filters where those do not help."""
    n = 12_000
    docs = spark.range(n).select((F.col("id") * 2).alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string"), F.lit(" again")).alias("text"))
    path, bounds = token_files.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), 2, path=f"{tmp_path}/t", block_bytes=1 << 20)
    rows, read = scanned_rows(token_files.read_token_files(spark, path, ids=[5000]))
    assert [r.doc_id for r in rows] == [5000] and rows[0].ids == tokens("word 2500 again") and read <= 1000
    for odd in (5001, 7777, 12_345):  # within the statistics of a row group, which a Bloom filter denies
        rows, read = scanned_rows(token_files.read_token_files(spark, path, ids=[odd]))
        assert not rows and read == 0
    files = [str(f) for f in sorted((tmp_path / "t").glob("*.orc"))]
    jvm = spark._jvm.org.apache
    readers = [jvm.orc.OrcFile.createReader(jvm.hadoop.fs.Path(f), jvm.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration())) for f in files]
    assert sum(r.getNumberOfRows() for r in readers) == n and all(r.getRowIndexStride() == 1000 for r in readers)
    whole = [r for r in readers if r.getNumberOfRows()]
    ranges = sorted((r.getStatistics()[1].getMinimum(), r.getStatistics()[1].getMaximum()) for r in whole)
    assert len(whole) > 1 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    # stripes are read apart: small splits give several tasks for one file, and the same rows
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        again = token_files.read_token_files(spark, path)
        assert again.rdd.getNumPartitions() > len(whole) and again.count() == n
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_token_files_null_and_repeated_ids(spark, make):
    path, bounds = token_files.write_token_files(make(["a", "b", "b", None, "c c"], [5, 3, 3, None, None]), public_tokenizers.path("word_bpe_49k.json"), 2)
    got = token_files.token_index(token_files.read_token_files(spark, path), bounds).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 3, 3, 5] and [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    path, bounds = token_files.write_token_files(make([]), public_tokenizers.path("word_bpe_49k.json"), 2)
    assert token_files.token_index(token_files.read_token_files(spark, path), bounds).count() == 0


def test_sentence_pieces(spark, make):
    got = {r.doc_id: r for r in sentence_pieces.encode_pieces(make(TEXTS), public_tokenizers.path("piece_bpe_32k.model")).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i].parity, t
        assert got[i].round_trip and got[i].decoded == (t or "").replace("▁", " ")
        assert got[i].n_ids == len(got[i].ids)


def test_sentence_pieces_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sentence_pieces.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert got and all(r.parity and r.round_trip for r in got)


def test_bounded_tables():
    """Tables far smaller than the texts' words, and long unbroken words, change no ids and keep their bytes."""
    from tokenizers import Tokenizer

    texts = [" ".join(f"Wört{i * 7 % 1000}x{k}" for i in range(300)) + "y" * 5000 * (k % 3) for k in range(12)]
    encoder = sentence_pieces.Encoder(public_tokenizers.path("piece_bpe_32k.model"), 1)
    encoder.segments.limit = 20_000
    words = token_files.TextIds(public_tokenizers.path("word_bpe_49k.json"))
    words.segments.limit = 20_000
    import sentencepiece

    original, whole = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for t in texts:
        assert encoder.encode([t.encode()])[0].tolist() == original.encode(t)
        assert words.ids([t.encode()])[0].tolist() == whole.encode(t, add_special_tokens=False).ids
        assert encoder.segments.held < 20_000 + 400 * 400 + 40_000


def test_parity_of_every_text(spark, make):
    """The query and the pipeline's last stage compare each text with the original library."""
    from tideline.llm import queries

    pipeline = pytest.importorskip("corpus_pipeline")
    got = queries.op8_sentence_pieces(spark, "/root/testdata/sf0.001").select("parity").collect()
    assert len(got) == 200 and all(r.parity is True for r in got)
    got = pipeline.token_stage(spark, make(TEXTS), "").collect()
    assert len(got) == len(TEXTS) and all(r.parity is True for r in got)


def test_unigram_model(tmp_path):
    """A hand-made unigram model with byte fallback against the library that defines the format."""
    import sentencepiece

    def field(number, value):
        if isinstance(value, bytes):
            return bytes([*varint(number << 3 | 2), *varint(len(value))]) + value
        if isinstance(value, float):
            return bytes(varint(number << 3 | 5)) + struct.pack("<f", value)
        return bytes([*varint(number << 3), *varint(value)])

    def varint(n):
        out = []
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return [*out, n]

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256))]
    pieces += [(p, -float(i + 1), 1) for i, p in enumerate(["▁", "a", "b", "c", "▁a", "ab", "bc", "▁ab", "abc", "▁abc", "▁▁", "cab"])]
    data = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in pieces)
    data += field(2, field(3, 1) + field(35, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0))
    path = tmp_path / "u.model"
    path.write_bytes(data)
    original, own = sentencepiece.SentencePieceProcessor(model_file=str(path)), sentence_pieces.Encoder(str(path), 1)
    for text in ("abc", "ab c  abcab", "a é b", "", "  ", "cabcab\nabc"):
        assert own.encode([text.encode()])[0].tolist() == original.encode(text), text


def test_hashes():
    assert hashlib.sha256(media.encode_png(media.payload_of("x"))).digest() == hashlib.sha256(media.encode_png(media.payload_of("x"))).digest()
