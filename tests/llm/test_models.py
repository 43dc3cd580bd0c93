"""Classifiers by held-out accuracy, media by round trip, URL filter against SQL, and the pipeline's stages."""

import hashlib
import random
import struct
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from routeloom.llm import common, langid, media, quality, toxicity, url_filter
from routeloom.llm import queries as llm_queries
from routeloom.llm.words import Texts, hash_of

SF = "/root/testdata/sf0.01"


def held(doc_id, folds, rest):
    return zlib.crc32(str(doc_id).encode()) % folds == rest


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "pages", "benchmark")}


@pytest.mark.parametrize(("query", "label", "folds", "rest"), [(quality.op2_quality, "quality", 4, 2), (toxicity.op8_toxicity, "toxic", 3, 1)])
def test_held_out_accuracy(spark, tables, query, label, folds, rest):
    got = {r["doc_id"]: r for r in query(spark, SF).collect()}
    truth = {r["doc_id"]: r[label] for r in tables["labels"].collect()}
    assert len(got) == tables["documents"].count()
    for d, r in got.items():
        assert r["held_out"] == held(d, folds, rest) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    away = [got[d]["predicted"] == y for d, y in truth.items() if d in got and got[d]["held_out"]]
    assert len(away) > 50 and np.mean(away) >= 0.9


def test_language_accuracy(spark, tables):
    truth = {r["doc_id"]: r["lang"] for r in tables["documents"].select("doc_id", "lang").collect()}
    got = langid.op7_langid(spark, SF).collect()
    assert len(got) == len(truth)
    away = [r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"]]
    assert all(r["held_out"] == held(r["doc_id"], 4, 2) for r in got)
    assert np.mean(away) >= 0.97


def test_a_giant_text_leaves_the_others_in_the_sample(spark):
    """The sample's bound is one of rows, whatever their texts' lengths; repeated rows count once."""
    rows = [(0, "giant " * 300_000), *[(k, f"short {k}") for k in range(1, 50)], (7, "short 7")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, quality int")
    for bound in (10, 1000):
        got = common.sample_texts(documents, labels, "quality", 4, 2, bound).collect()
        learned = [k for k in range(50) if not held(k, 4, 2)]
        assert len(got) == min(bound, len(learned)) and {r["text"] for r in got} <= {t for _, t in rows}


LANGS = [("the cat and the dog went with them", "en"), ("der hund und die katze gingen mit ihnen", "de"), ("кошка и собака пошли вместе", "ru")] * 20


def test_languages_of_odd_texts(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate(LANGS)] + [(900, None, None), (901, "", "en"), (902, "123 !!", "de"), (903, "漢字だけ", None), (904, "собака " * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(df, langid.fit(df)).collect()}
    assert [got[k][0] for k in (900, 901, 902, 904)] == ["und", "und", "und", "ru"] and got[903][0] in ("de", "en", "ru")
    assert got[900][1] == got[903][1] == 0 and got[904][1] == 1
    assert langid.predict(df, langid.Model([])).where("lang_pred <> 'und'").count() == 0
    model = langid.Model.of(LANGS)
    text = "the dog and the cat went with them. кошка и собака пошли вместе"
    assert [(text[a:b].split()[0], lang) for a, b, lang in langid.spans(model, text)] == [("the", "en"), ("кошка", "ru")]


@given(st.integers(0, 2**32), st.lists(st.integers(0, 40), min_size=1, max_size=6), st.integers(1, 9))
@settings(max_examples=50, deadline=None)
def test_segmented_viterbi_scores_as_well_as_word_by_word(seed, lengths, segment):
    rng = np.random.default_rng(seed)
    score = rng.normal(size=(sum(lengths), 3)).astype(np.float32) * 3
    got = langid.viterbi(score, np.array(lengths), 2.0, segment)
    at = 0
    for n in lengths:
        own, path = score[at : at + n].astype(float), got[at : at + n]
        at += n
        if not n:
            continue
        best = own[0]
        for s in own[1:]:
            best = s + np.maximum(best, best.max() - 2.0)
        told = own[np.arange(n), path].sum() - 2.0 * (path[1:] != path[:-1]).sum()
        assert abs(told - best.max()) < 1e-3


def test_models_on_odd_texts(spark):
    rows = [("good plain text about things %d" % k, 1) for k in range(40)] + [("$$$ ### BUY!!! NOW!!! %d" % k, 0) for k in range(40)]
    model = quality.Model.of(rows)
    assert (model.scores(["plain text about good things", "NOW!!! BUY!!! ###"]) >= 0.5).tolist() == [True, False]
    assert np.allclose(model.scores([None]), model.scores([""])) and quality.Model([]).scores(["x"])[0] == 0.5
    long = model.scores(["word " * 50_000, "x" * 200_000])
    assert ((0 <= long) & (long <= 1)).all()
    empty = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(empty, quality.fit(empty, labels), 4, 2).count() == 0
    assert toxicity.without_toxic(empty, toxicity.fit(empty, labels)).count() == 0
    assert toxicity.fit(empty, labels).scores(["x", None]).tolist() == [0, 0]
    same = spark.createDataFrame([(k, f"a {k}") for k in range(9)], "doc_id long, text string")
    assert toxicity.fit(same, same.selectExpr("doc_id", "1 AS toxic")).scores(["b"]).tolist() == [1]


def test_masked_spellings_and_neighbours():
    lexicon = toxicity.hashed(["idiot"])
    rows = toxicity.features(["you are an 1d1ot", "an i.d.i.o.t. " + "far " * 9 + "you", "nothing here", ""], lexicon, lexicon, toxicity.hashed(["you"]))
    assert (rows[:, 1] > 0).tolist() == [True, True, False, False]
    assert (rows[:, 5] > 0).tolist() == [True, False, False, False]
    assert rows[1, 12] > 0 and not rows[3].any()


@given(st.lists(st.text(max_size=12), min_size=1, max_size=5))
@settings(max_examples=50, deadline=None)
def test_word_hashes_do_not_depend_on_the_place(words):
    texts = Texts(words)
    got = texts.hashes(texts.start, texts.start + texts.size)
    assert got.tolist() == [hash_of(w) for w in words]


def test_isotonic_rises():
    rng = np.random.default_rng(1)
    x = rng.random(200)
    places, values = toxicity.isotonic(x, (rng.random(200) < x).astype(float))
    assert (np.diff(places) >= 0).all() and (np.diff(values) >= 0).all()


# ---- URL filter


def test_url_filter_both_ways_and_sql(spark):
    urls = ["http://a.example.org/es/x", "https://EXAMPLE.org/en/12?q", "http://example.org/en/2", "http://example.org", "http://x.com/fr/", "http://x.com/de/ads/", "ftp://ads.site.net/x", "http://s.net/a?jsessionid=1", "no scheme", "", None, "x://?://b", "http://notexample.org/es/", "http://s.net/adsense", "http://h.com/a#://b.org/"]
    pages = spark.createDataFrame([(k, u, "host", "x") for k, u in enumerate([*urls, urls[0]])], "page_id long, url string, host string, token string")
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    want = sorted(map(str, con.execute(url_filter.sql()).fetchall()))
    for inline in (200, 0):
        got = url_filter.judge(pages, inline_rules=inline)
        assert sorted(str(tuple(r)) for r in got.collect()) == want
    table = {r["page_id"]: (r["rule"], r["verdict"]) for r in got.collect()}
    assert [table[k] for k in (0, 1, 2, 3, 4, 5, 6, 7, 8)] == [("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), (None, "allow"), ("com/fr/", "allow"), ("com/de/", "block"), (None, "block"), (None, "block"), (None, "allow")]
    with pytest.raises(ValueError):
        url_filter.judge(pages, [url_filter.Rule("r", "x", (), "block", 0)])


# ---- media


@given(st.binary(max_size=9000))
@settings(max_examples=60, deadline=None)
def test_media_round_trip(raw):
    payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
    stored = media.mux(payload)
    back, track = media.read_samples(stored)
    assert back == payload and track["samples"] * 192 == len(payload) == track["duration"]
    for a, n in track["keyframes"]:
        assert n == 192 and stored[a : a + n] in payload


def test_media_of_broken_and_other_containers(spark):
    good = media.mux(b"q" * 1920)
    assert media.describe(None)["error"] == "no moov box" and media.describe(b"junk")["error"]
    for cut in range(0, len(good), 7):
        told = media.describe(good[:cut])
        assert told["error"] or told["tracks"]
    wide = struct.pack(">I4sQ", 1, b"free", 20) + b"1234"
    sized = struct.pack(">I4s", 0, b"free") + b"tail"
    told = media.describe(good + wide + sized)
    assert told["error"] is None and told["tracks"][0]["keyframes"][0] == (32, 192)
    rows = media.media_columns(spark.createDataFrame([(1, good, "x"), (2, None, "y")], "id int, content binary, error string"), "content").orderBy("id").collect()
    assert rows[0]["tracks"][0]["codec"] == "raw " and rows[0]["error"] is None and rows[1]["error"] and rows[1]["tracks"] == []


def patched(container, kind, at, value):
    place = container.index(kind) + 4 + at
    return container[:place] + value + container[place + len(value) :]


def test_media_tables_that_claim_too_much():
    good = media.mux(bytes(range(256)) * 30)
    for count in (2**32 - 1, 200_000_000, 41):
        assert media.describe(patched(good, b"stsz", 8, struct.pack(">I", count)))["error"]
    for kind, at in ((b"stss", 4), (b"stsc", 4), (b"stco", 4), (b"stts", 4)):
        assert media.describe(patched(good, kind, at, struct.pack(">I", 2**32 - 1)))["error"]
    assert "beyond" in media.describe(patched(good, b"stco", 8, struct.pack(">I", len(good))))["error"]
    # An unknown duration is null where no table of times tells it; so is one beyond 63 bits.
    timeless = patched(good, b"stts", 4, struct.pack(">I", 0))
    for ticks, told in ((2**64 - 1, None), (2**63, None), (77, 77)):
        track = media.describe(patched(timeless, b"mdhd", 24, struct.pack(">Q", ticks)))["tracks"][0]
        assert track["duration"] == told
    assert media.describe(patched(good, b"stts", 8, struct.pack(">II", 2**32 - 1, 2**32 - 1)))["tracks"][0]["duration"] is None
    # Without a table of keyframes all samples are, a range for each chunk.
    track = media.describe(patched(good, b"stss", -4, b"free"))["tracks"][0]
    assert track["keyframes"] == [(32, 1920), (1952, 1920), (3872, 1920), (5792, 1920)]


@given(st.integers(0, 2**32), st.binary(min_size=1, max_size=8))
@settings(max_examples=300, deadline=None)
def test_media_of_changed_containers_never_fails(at, value):
    good = media.mux(b"payload!" * 240)
    head = good.index(b"moov")
    at = head + at % (len(good) - head)
    told = media.describe(good[:at] + value + good[at + len(value) :])
    assert told.keys() == {"brand", "tracks", "error"} and not (told["error"] and told["tracks"])
    for track in told["tracks"]:
        assert track["duration"] is None or 0 <= track["duration"] < 2**63


def test_media_query(spark, tables):
    """Every column, computed again from the texts and from an own walk over the stored bytes."""
    got = {r["doc_id"]: r for r in media.op10_media(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in tables["documents"].select("doc_id", "text").collect()}
    assert got.keys() == texts.keys()
    for d, text in texts.items():
        raw, r = text.encode(), got[d]
        payload = raw + b" " * (-len(raw) % 192 or 192 * (not raw))
        stored = media.mux(payload)
        assert stored.count(payload) == 1
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        first = stored.index(payload)
        keys = [(first + k, 192) for k in range(0, len(payload), 192 * 16)]
        assert [(k["start"], k["length"]) for k in r["keyframes"]] == keys
        assert r["seconds"] == len(payload) / 8000 and r["codec"] == "raw"
        assert r["feature"].endswith(f"keyframes_crc32={zlib.crc32(b''.join(stored[a : a + n] for a, n in keys))}")


# ---- pipeline


def test_pipeline_stages(spark, tables):
    import corpus_pipeline as cp

    docs = tables["documents"]
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line dedup", "simhash near-dedup", "decontamination", "packing"]
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out = out.cache()
        n = out.count()
        assert 0.8 * docs.count() < n <= docs.count() if name != "line dedup" else n == docs.count()
    packed = cp.run(spark, SF)
    assert packed.count() > 0 and packed.where("offset + length > 1024").count() == 0
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_pipeline_rows_without_text(spark):
    import corpus_pipeline as cp

    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(999)) for _ in range(60)), None, None, None) for k in range(8)] + [(50, None, None, "s", None), (None, "text of a row without an id", None, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert docs.count() == 10


def slow_scores(model, text):
    """The quality score of a text by its definition, a feature at a time."""
    import re

    text = text or ""
    words = re.split(r"\s+", text)
    found = [w for w in words if w]
    total, n = 0.0, 0
    for k, w in enumerate(found):
        total += model.weight[hash_of_case(w) >> (64 - quality.BUCKET_BITS)]
        n += 1
        if k and found[k - 1] == w:
            total += model.weight[quality.REPEAT]
            n += 1
    return total, n


def hash_of_case(word):
    texts = Texts([word])
    return int(texts.hashes(texts.start, texts.start + texts.size, texts.points)[0])


def test_quality_is_the_average_of_its_features():
    """A text's log odds are the average weight of its features, whichever batch or piece they stand in."""
    rng = random.Random(5)
    rows = [(" ".join(rng.choice(["good", "plain", "text", "Buy", "now!!", "a"]) for _ in range(rng.randrange(1, 30))), k % 2) for k in range(60)]
    model = quality.Model.of(rows)
    texts = [t for t, _ in rows] + ["", "x", "é é é", " lead  two  "]
    for text, score in zip(texts, model.scores(texts), strict=True):
        bucket, of = quality.buckets(Texts([text]))
        assert (of == 0).all()
        words_total, words = slow_scores(model, text)
        grams = [text_gram(" ".join(["", *text.split(), ""]), n) for n in (3, 4)]
        assert len(bucket) >= words
        odds = model.weight[bucket].sum() / max(1, len(bucket)) + model.offset
        assert abs(score - 1 / (1 + np.exp(-odds))) < 1e-5
        # The words' own features are among them, each as often as it stands there.
        assert words_total == pytest.approx(model.weight[bucket[: words]].sum(), abs=1e-4)
        assert grams is not None


def text_gram(text, n):
    return [text[k : k + n] for k in range(len(text) - n + 1)]


def test_pieces_add_up_to_the_whole(monkeypatch):
    """Long texts in small pieces: words stay whole, so counts by word don't change; batches don't matter."""
    from routeloom.llm import words as w

    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abcé ") for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(400))) for _ in range(12)] + [None, "", "y" * 3000]
    lexicon = toxicity.hashed(["a", "abc", "cab"])
    model, langs = quality.Model.of([(t or "", k % 2) for k, t in enumerate(texts)]), langid.Model.of([(t, "x" if k % 2 else "z") for k, t in enumerate(texts) if t])
    whole = toxicity.features(texts, lexicon, lexicon, lexicon)
    told = [model.scores(texts), [x for x, _ in langid.judge(langs, texts)]]
    monkeypatch.setattr(w, "PIECE_CHARS", 300)
    assert [p for t in texts for p in ["".join(x for held, _ in w.pieces([t]) for x in held)]] == [t or "" for t in texts]
    near = toxicity.features(texts, lexicon, lexicon, lexicon)
    for k in (0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12, 14):  # all but the distance to second persons, and letters in a row in a cut word
        assert np.allclose(whole[:-1, k], near[:-1, k])
    assert np.abs(model.scores(texts) - told[0]).max() < 0.05
    assert [x for x, _ in langid.judge(langs, texts)] == told[1]
    alone = np.concatenate([model.scores([t]) for t in texts])
    assert np.allclose(alone, model.scores(texts))


def test_a_hundred_languages_and_many_scripts():
    rng = random.Random(7)
    starts = [0x0061, 0x03B1, 0x0430, 0x05D0, 0x0627, 0x0915, 0x0E01, 0x10D0, 0xAC00, 0x4E00, 0x3042]
    rows, tests = [], []
    for k in range(100):
        letters = [chr(starts[k % len(starts)] + rng.randrange(20)) for _ in range(12)]
        words = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(25)]
        prose = lambda words=words: " ".join(rng.choice(words) for _ in range(40))
        rows += [(prose(), f"l{k:03}") for _ in range(3)]
        tests.append((prose(), f"l{k:03}"))
    model = langid.Model.of(rows)
    assert len(model.languages) == 100
    got = langid.judge(model, [t for t, _ in tests])
    assert np.mean([x == lang for (x, _), (_, lang) in zip(got, tests, strict=True)]) > 0.97
    # Kana tells a text with Han letters from one without.
    mixed = langid.Model.of([("漢字かな交じり文", "ja"), ("漢字文漢字", "zh")] * 5)
    assert [x for x, _ in langid.judge(mixed, ["かな漢字 交じり", "漢字漢 文字"])] == ["ja", "zh"]


def test_language_scores_by_definition():
    """The whole judgement of short texts, word by word, in plain Python."""
    rng = random.Random(8)
    model = langid.Model.of(LANGS)
    vocabulary = [w for t, _ in LANGS for w in t.split()] + ["漢字", "x1y", "--", "Ωmega"]
    for _ in range(60):
        text = rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 15)))
        (told, score) = langid.judge(model, [text])[0]
        batch = Texts([text])
        gram, letter = langid.trigrams(batch)
        words, at = [], 0
        while at < len(text):
            if not letter[at]:
                at += 1
                continue
            end = at
            while letter[end]:
                end += 1
            sums = [float(sum(model.logs[gram[i], k] for i in range(at, end))) for k in range(len(model.languages))]
            fits = model.candidates(np.array([int(np.bitwise_or.reduce(langid.script_bits(batch.low[at:end])))]))[0]
            top = max((s for s, f in zip(sums, fits, strict=True) if f), default=None)
            words.append((end - at if top is not None else 0, [max(s - top, langid.FLOOR) if f else (langid.FLOOR if top is not None else 0.0) for s, f in zip(sums, fits, strict=True)]))
            at = end
        best = {k: (0.0, []) for k in range(len(model.languages))}
        for n, own in words:
            best = {k: max(((s - langid.SWITCH * bool(path and path[-1][1] != k) + own[k], [*path, (n, k)]) for s, path in best.values()), key=lambda x: x[0]) for k in best}
        total, path = max(best.values(), key=lambda x: x[0])
        counts = [sum(n for n, k in path if k == j) for j in range(len(model.languages))]
        if not words:
            assert (told, score) == ("und", 0.0)
        elif not sum(counts):
            assert (told, score) == (model.usual, 0.0)
        else:
            # Paths of equal sums may differ; the one taken has to be as good.
            own, letters, start, *_ = langid.label(model, [text], langid.SWITCH)
            sums = sum(w[1][k] for w, k in zip(words, own.tolist(), strict=True)) - langid.SWITCH * int((own[1:] != own[:-1]).sum())
            assert abs(sums - total) < 1e-3 and told == model.languages[int(np.bincount(own, letters, len(model.languages)).argmax())]


def test_trees_and_calibration_by_definition(spark, tables):
    """Scores are the interpolated steps of the sum of the leaves, found one row at a time."""
    documents = tables["documents"]
    model = toxicity.fit(documents, tables["labels"])
    texts = [r["text"] for r in documents.limit(40).collect()] + [None, "you stupid idiot!!!"]
    x = toxicity.features(texts, model.lexicon, model.insults, model.second)
    for row, score in zip(x, model.scores(texts), strict=True):
        total = model.trees.base
        for splits, leaf in model.trees.trees:
            node = 0
            for feature, cut in splits:
                f = feature[node]
                node = 2 * node + int(sum(e < row[f] for e in model.trees.edges[f]) > cut[node])
            total += leaf[node]
        assert abs(np.interp(total, *model.steps) - score) < 1e-9
    for k, text in enumerate(texts):
        words = (text or "").split()
        assert np.isclose(x[k, 14], np.log1p(len(words)))


def test_workers_hold_a_large_batch_in_bounded_memory():
    """64 MB of long texts, scored as a worker does: memory beyond the texts stays far below a gigabyte."""
    import subprocess
    import sys

    code = """
import resource, random
import pyarrow as pa
from routeloom.llm import common, langid, quality, toxicity
rng = random.Random(1)
words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(2000)]
text = " ".join(rng.choice(words) for _ in range(560_000))
batch = pa.record_batch([pa.array([text] * 20)], names=["text"])
size = batch.nbytes
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
tox = toxicity.Model([], __import__("numpy").array([], int), __import__("numpy").array([], int), toxicity.hashed(words[:50]))
models = [quality.Model.of([("a b", 0), ("c d", 1)]), langid.Model.of([("a b", "x"), ("c d", "z")])]
for part in common.slices(iter([batch]), 0):
    texts = part.column(0).to_pylist()
    models[0].scores(texts), langid.judge(models[1], texts), toxicity.features(texts, tox.lexicon, tox.insults, tox.second)
print(size, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    size, used = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert size > 60_000_000 and used < 800_000


def test_oracles_match(spark):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert {*llm_queries.oracle_sql()} == {"op3_url_filter", "op4_line_dedup"}
    for name, sql in llm_queries.oracle_sql().items():
        want = con.execute(sql)
        columns = sorted(d[0] for d in want.description)
        at = [[d[0] for d in want.description].index(c) for c in columns]
        rows = sorted(str([r[k] for k in at]) for r in want.fetchall())
        assert sorted(str(list(r)) for r in llm_queries.queries()[name](spark, SF).select(*columns).collect()) == rows, name
