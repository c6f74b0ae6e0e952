"""Language models, the quality classifier and the pipeline."""

import math
import os
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import language, quality, queries, store

SF = "/root/testdata/sf0.01"
CLASHING = ("kept", "blob", "blob_id", "Blob_spans", "out_id", "out_hash", "text_hash", "spans", "good", "key")


def test_grams_and_letters():
    texts = ["Ab-c", "", "!!", "é𝒜"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    codes, text, letters = language.grams(data, offsets)
    assert letters.tolist() == [3, 0, 0, 2] and text.tolist() == [0, 0, 0, 0, 3, 3, 3]
    assert codes[:4].tolist() == [ord("a"), ord("a") << 16 | ord("b"), ord("a") << 32 | ord("b") << 16, ord("a") << 48 | ord("b") << 32 | ord("c")]


def test_letters_beyond_the_first_plane():
    """Letters that once shared a symbol are told apart."""
    code = lambda t: language.grams(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0].tolist()
    one, two = chr(0x20000), chr(0x20000 + 6400)
    assert code(one) != code(two) and len(code(one)) == 2 and code("a" + one)[1:] != code("a" + two)[1:] and code("𐐀") == code("𐐨")


def brute_languages(training, texts):
    """Interpolated Kneser-Ney by dictionaries: (language, score) of each text."""
    import unicodedata

    def runs(text):
        symbols = []
        for c in text or "":
            if unicodedata.category(c)[0] == "L":
                low = c.lower() if len(c.lower()) == 1 else c
                symbols += list(np.frombuffer(low.encode("utf-16-le"), np.uint16).tolist())
            elif symbols and symbols[-1]:
                symbols.append(0)
        padded = [0, 0, 0, *symbols]
        return [tuple(padded[i : i + 4]) for i in range(len(symbols))]

    models = {}
    for lang in sorted({x for t, x in training if runs(t)}):
        counts = {4: Counter(r for t, x in training if x == lang for r in runs(t))}
        for k in (3, 2, 1):
            counts[k] = Counter(r[1:] for r in counts[k + 1])
        model = {}
        for k, own in counts.items():
            total, kinds = Counter(), Counter()
            for r, n in own.items():
                total[r[:-1]] += n
                kinds[r[:-1]] += 1
            n1, n2 = sum(n == 1 for n in own.values()), sum(n == 2 for n in own.values())
            model[k] = own, total, kinds, n1 / (n1 + 2 * n2) if n1 else 0.5
        models[lang] = model
    symbols = len({r for m in models.values() for r in m[1][0]}) + 1

    def probability(model, run):
        if not run:
            return 1 / symbols
        own, total, kinds, d = model[len(run)]
        lower = probability(model, run[1:])
        n = total[run[:-1]]
        return max(own[run] - d, 0) / n + d * kinds[run[:-1]] / n * lower if n else lower

    out = []
    for t in texts:
        own = runs(t)
        if not any(any(r) for r in own):
            out.append(("und", 0.0))
            continue
        each = Counter(own)
        entropy = {x: -sum(n * math.log(probability(m, r)) for r, n in each.items()) / len(own) for x, m in models.items()}
        best = min(entropy, key=entropy.get)
        out.append((best, 1 / sum(math.exp(entropy[best] - e) for e in entropy.values())))
    return out


def test_language_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text", "lang", language.held_back(F.col("text")).alias("back")).orderBy("doc_id").collect()
    learnt = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.text is not None and r.lang is not None]
    many = {x for x, n in Counter(r.lang for r in learnt).items() if n >= 64}
    want = brute_languages([(r.text, r.lang) for r in learnt if not (r.back and r.lang in many)], [r.text for r in rows])
    got = {r.doc_id: r for r in queries.op2_language_id(spark, sf).collect()}
    assert len(got) == len(rows)
    for r, (lang, score) in zip(rows, want, strict=True):
        assert got[r.doc_id].lang_pred == lang and got[r.doc_id].score == pytest.approx(score, abs=1e-5)


def test_rejection_is_calibrated(spark):
    """Of documents that the model has not seen about the asked share is rejected, of noise nearly all."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang is not null and text is not null")
    seen = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    model = language.train(docs.where(seen), false_rejections=0.05)
    got = language.identify(docs.where(~seen), model).agg(F.avg(F.col("rejected").cast("double")).alias("r")).first().r
    assert 0.02 < got < 0.09 and all(b != language.UNCALIBRATED for b in model.bounds)
    rng = np.random.default_rng(4)
    noise = spark.createDataFrame([(i, "".join(rng.choice(list("qxzjvkwyq "), 300))) for i in range(50)], "doc_id bigint, text string")
    assert language.identify(noise, model).where("rejected").count() >= 49


def test_language_clashing_names(spark, clashing):
    train = spark.createDataFrame([("the cat sat", "en", "x", 1), ("der hund", "de", "y", 2)], "text string, lang string, code string, which int")
    got = language.identify(clashing(["the cat", None]), language.train(train)).collect()
    assert sorted(r.lang_pred for r in got) == ["en", "und"]


def test_table():
    codes = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    t = language.Table(codes, np.arange(len(codes)))
    assert (t.values[t.find(codes)] == np.arange(len(codes))).all() and (t.find(codes + np.uint64(1)) < 0).mean() > 0.99
    assert (language.Table(codes[:0], codes[:0]).find(codes) == -1).all()


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(2)
    text = "".join(rng.choice(list("abcd "), 400))
    data = np.frombuffer(text.encode(), np.uint8)
    codes, n = np.unique(language.grams(data, np.array([0, len(data)]))[0], return_counts=True)
    symbols = [0, *map(ord, "abcd")]
    model = language.KneserNey(codes, n, len(symbols))
    for context in (codes[3] >> np.uint64(16), codes[40] >> np.uint64(16), np.uint64(ord("a") << 32 | ord("z") << 16 | ord("b"))):
        every = np.array([(int(context) << 16 | s) & (2**64 - 1) for s in symbols], np.uint64)
        assert model.probability(every).sum() == pytest.approx(1)


def test_language_on_documents(spark):
    got = queries.op2_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98


def test_language_of_odd_texts(spark, make):
    train = spark.createDataFrame([("the cat sat on the mat and the dog", "en"), ("der hund und die katze sind im haus", "de"), (None, "fr"), ("un chat", None), ("", "es")], "text string, lang string")
    model = language.train(train)
    texts = [None, "", "123 !!", "the dog", "die katze", "ħħħ ŋŋŋ " * 20, "the dog " * 20_000, "the dog", "the dog"]
    got = {r.doc_id: r for r in language.identify(make(texts), model).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 3, 4, 6)] == ["und", "und", "und", "en", "de", "en"] and got[0].score == 0 and got[5].lang_pred in ("de", "en") and got[5].rejected
    assert got[3].score == got[7].score > 0.5
    assert {r.lang_pred for r in language.identify(make(texts), language.train(train.where("false"))).collect()} == {"und"}
    assert language.identify(make([]), model).count() == 0


def test_language_model_keeps_every_run(spark):
    """Each run's probability in each language against counts in memory, a rare alphabet's single runs included; tables come in many parts."""
    rng = np.random.default_rng(6)
    texts = [("".join(rng.choice(list("abcde "), 300)), lang) for lang in ("x", "y") for _ in range(20)]
    texts += [("".join(map(chr, rng.integers(0x4E00, 0x9FA5, 900))), "z")]
    model = language.train(spark.createDataFrame(texts, "text string, lang string"), gathered=1 << 15)
    counts = {}
    for lang in model.langs:
        own = [t.encode() for t, own in texts if own == lang]
        data, ends = b"".join(own), np.cumsum([0, *map(len, own)])
        counts[lang] = np.unique(language.grams(np.frombuffer(data, np.uint8), ends)[0], return_counts=True)
    every = np.unique(np.concatenate([c for c, _ in counts.values()]))
    assert model.langs == ["x", "y", "z"] and len(model.tables["runs4"].keys) == len(every) > 900
    plain = [language.KneserNey(*counts[lang], model.symbols) for lang in model.langs]
    unseen = np.setdiff1d(np.concatenate([every ^ np.uint64(1), every ^ np.uint64(1 << 48), every ^ np.uint64(1 << 16)]), every)
    for codes in (every, unseen):
        assert np.allclose(model.logs(codes), np.log(np.stack([m.probability(codes) for m in plain], 1)), rtol=1e-5)
    own = -np.log(plain[2].probability(counts["z"][0]))
    assert model.centre[2] == pytest.approx(np.average(own, weights=counts["z"][1]), rel=1e-5) and model.spread[2] == pytest.approx(math.sqrt(np.average((own - model.centre[2]) ** 2, weights=counts["z"][1])), rel=1e-3)


def test_quality_on_documents(spark):
    """Each document's own counts are left out of the models, so these are figures of unseen documents."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality(docs, labels).join(labels, "doc_id").select("quality", "toxic", "kept").collect()
    good = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    bad, toxic = [r.kept for r in rows if r.quality == 0], [r.kept for r in rows if r.toxic == 1]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.02 and np.mean(toxic) < 0.12


def brute_features(text):
    """How often each feature stands in a text, without hashes."""
    data = (text or "").encode().decode("latin-1")
    words = re.findall("[a-z0-9\x80-\xff]+", data.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    shape = re.sub(r"(?s)(.)\1+", r"\1", re.sub("[0-9]", "0", re.sub("[a-z\x80-\xff]", "a", re.sub("[A-Z]", "A", data))))
    shapes = re.findall("[^ \t\n\x0b\x0c\r]+", shape)
    again = [i for i in range(len(words) - 1) if words[i] == words[i + 1]]
    often = [i for i in again if {i + 1, i + 2, i + 3} <= set(again)]
    return Counter([("word", w) for w in words] + [("shape", s) for s in shapes] + list(zip(shapes, shapes[1:])) + ["again"] * len(again) + ["often"] * len(often))


def brute_log_weights(texts, good, prior=1.0, clear=2.5):
    """Every document's log-weight, from the models of all the others."""
    own = [{f: round(16 * math.log2(1 + n)) / 16 for f, n in brute_features(t).items()} for t in texts]
    raw, target = Counter(), Counter()
    for counts, g in zip(own, good, strict=True):
        raw.update(counts)
        target.update(counts if g else {})
    share, out = sum(target.values()) / max(1, sum(raw.values())), []
    for counts, g in zip(own, good, strict=True):
        total = 0.0
        for f, n in counts.items():
            e, t = (raw[f] - n) * share, target[f] - n * g
            total += n * math.log((t + prior) / (e + prior)) if abs(t - e) >= clear * math.sqrt(e + 1) else 0
        out.append(total)
    return out


def test_log_weights_against_brute_force(spark, make):
    rng = np.random.default_rng(8)
    good_words, bad_words = [f"w{i}é" for i in range(60)], [f"w{i}é" for i in range(30)] + ["BUY", "now!!", "$$$", "now now"]
    texts = [" ".join(rng.choice(bad_words if i % 3 == 0 else good_words, 40)) for i in range(400)] + [None, "", "\t \n", "a A\x0bB 9,9"] * 3 + ["w1é w2é " * 8000] * 2
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 7 == 1)) for i in range(0, 300)] + [(0, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    good = [i < 300 and i % 3 != 0 and i % 7 != 1 for i in range(len(texts))]
    want = brute_log_weights(texts, good)
    got = {r.doc_id: r for r in quality.quality(make(texts), labels).collect()}
    assert len(got) == len(texts) and all(got[i].log_weight == pytest.approx(w, abs=1e-4) for i, w in enumerate(want))
    assert min(want) < -20 and max(want) > 2 and [got[i].n_features for i in (0, 400, 402)] == [len(brute_features(texts[0])), 0, 0]
    clean = [got[i].kept for i in range(300, 400) if i % 3]
    assert np.mean(clean) > 0.9 and np.mean([got[i].kept for i in range(0, 400, 3)]) < 0.05 and all(0 <= r.score <= 1 for r in got.values())


def test_quality_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    want = brute_log_weights([t for _, t in docs], [d in good for d, _ in docs])
    got = {r.doc_id: r.log_weight for r in queries.op4_quality_classifier(spark, sf).collect()}
    # two features may share one of the 2 ** 20 buckets, so a few of a text's many features differ
    apart = np.abs([got[d] - w for (d, _), w in zip(docs, want, strict=True)])
    assert len(got) == len(docs) and np.median(apart) < 0.02 and np.mean(apart < 0.02) > 0.6 and np.corrcoef(want, [got[d] for d, _ in docs])[0, 1] > 0.99


def test_quality_without_labels_or_rows(spark, make, clashing):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert all(r.kept for r in quality.quality(clashing(["a", None]), labels).collect())
    assert quality.quality(make([]), labels).count() == 0


def test_top_k(spark):
    rows = [(float(i % 50), i, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "key double, doc_id bigint, text_hash bigint")
    for k in (0, 1, 59, 60, 61, 1500, 2999, 3000):
        want = {i for _, i, _ in sorted(rows, key=lambda r: (-r[0], r[1]))[:k]}
        assert {r.doc_id for r in quality.top_k(df, k).where("kept").collect()} == want
    alike = spark.createDataFrame([(1.0, None, 7)] * 500 + [(2.0, 1, 1)] * 3 + [(0.5, 2, 2)] * 300, df.schema)
    assert [quality.top_k(alike, k).where("kept").count() for k in (1, 3, 4, 503, 504)] == [3, 3, 503, 503, 803]


def test_gumbel(spark):
    x = [r.g for r in spark.range(4000).select(quality.gumbel(F.col("id"), 1).alias("g")).collect()]
    assert abs(np.mean(x) - 0.5772) < 0.1 and abs(np.std(x) - math.pi / 6**0.5) < 0.1


@pytest.fixture(scope="module")
def small_corpus(spark, tmp_path_factory):
    """A folder with documents that each stage has to act on."""
    import test_text_operators as t

    rng = np.random.default_rng(5)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(n))
    texts = [prose(80) for _ in range(60)]
    texts += [texts[0], texts[1] + " end", "x " + t.ITEMS[0][1], texts[2] + " password = hunter22 ok", None, ""]
    texts += [prose(3).upper() + "!!! " + " ".join(f"{w.upper()}!!" for w in prose(60).split()) for _ in range(40)]
    folder = tmp_path_factory.mktemp("corpus")
    rows = [(i, x, "en", "s", len(x or "")) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(60)] + [(i, 0, 0) for i in range(66, 106)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(t.ITEMS, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), texts


def test_pipeline(spark, small_corpus, tmp_path):
    """Each stage against brute force on its own input; run() against the stages."""
    pipeline = pytest.importorskip("corpus_pipeline")
    import sentencepiece
    import public_tokenizers
    import test_text_operators as t

    folder, texts = small_corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({c: F.lit("x") for c in CLASHING})
    inputs, outputs = [], []
    for i, (_, stage) in enumerate(pipeline.STAGES):
        inputs.append({r.doc_id: r for r in docs.collect()})
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        outputs.append({r.doc_id: r for r in docs.collect()})
        assert i == 4 or set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars", *CLASHING}
    assert set(outputs[0]) == set(range(66))  # the shouting ones go
    near = t.brute_near([(d, r.text) for d, r in sorted(inputs[1].items())], size=5)
    assert set(outputs[1]) == {d for d, _, c in near if d == c} and {60, 61} & set(outputs[1]) == set()
    hits = {d: t.brute_hits(r.text, t.ITEMS) for d, r in inputs[2].items()}
    assert set(outputs[2]) == {d for d, (n, h, _) in hits.items() if not (h and 20 * h >= n)} and 62 not in outputs[2]
    for d, r in inputs[3].items():
        if not t.brute_base(r.text):
            assert outputs[3][d].text == r.text and outputs[3][d].n_chars == r.n_chars
        else:
            assert "hunter22" not in outputs[3][d].text and "[SECRET]" in outputs[3][d].text and outputs[3][d].n_chars == len(outputs[3][d].text)
    assert set(outputs[3]) == set(inputs[3])
    original = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {d: r.ids for d, r in outputs[4].items()} == {d: original.encode(r.text or "") for d, r in inputs[4].items()}
    assert {(r.doc_id, tuple(r.ids)) for r in pipeline.run(spark, folder).collect()} == {(d, tuple(r.ids)) for d, r in outputs[4].items()}


def test_pipeline_deletes_its_own_tables_only(spark, small_corpus):
    """A result of another query that is not read yet stays whole; of a run only the last stage's input is left."""
    pipeline = pytest.importorskip("corpus_pipeline")
    folder, texts = small_corpus
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    other = queries.op1_secret_scan(spark, folder)
    before = set(os.listdir(shared))
    result = pipeline.run(spark, folder)
    assert other.count() == len(texts) and result.count() == pipeline.run(spark, folder).count()
    assert sum(x.startswith("stage-") for x in set(os.listdir(shared)) - before) == 2


def test_pipeline_of_nothing(spark, small_corpus):
    pipeline = pytest.importorskip("corpus_pipeline")
    folder, _ = small_corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_storage(spark, tmp_path):
    assert store.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    outside = store.written(spark.range(2).toDF("a"), "y")
    with store.scope() as made:
        df = store.written(spark.range(3).toDF("a"), "x")
    assert df.count() == 3 and len(made) == 1
    at = df.inputFiles()[0].removeprefix("file:")
    assert os.path.exists(at)
    store.release(spark, made)
    assert not os.path.exists(at) and outside.count() == 2


def test_blocks(spark):
    df = spark.createDataFrame([(None,), *((i,) for i in range(-5, 200))], "a bigint")
    for bounds in ([], [0], [0, 50, 51, 100], list(range(0, 180, 3))):
        for r in df.select("a", store.block_of(F.col("a"), bounds).alias("b")).collect():
            assert r.b == (0 if r.a is None else 1 + sum(x <= r.a for x in bounds))
