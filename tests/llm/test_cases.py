"""Every text operator and pipeline stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import random
import zlib

import pytest

from routeloom.llm import decontaminate, langid, line_dedup, media, packing, quality, simhash, suffix_dedup, toxicity, url_filter

SF = "/root/testdata/sf0.001"
RNG = random.Random(2)
WORDS = ["".join(RNG.choice("abcdefghijklm") for _ in range(RNG.randrange(2, 9))) for _ in range(400)]
prose = lambda n: " ".join(RNG.choice(WORDS) for _ in range(n))
LONG = prose(120_000)
ROWS = [(0, None, "en", "a"), (1, "", "en", "a"), (2, " \t\n ", None, None), (3, LONG, "de", "a"), (4, prose(60), "en", "b"), (4, "another text of the same id", "en", "b"), (None, prose(60), "en", "a"), (6, "x" * 300_000, "de", "a"), (7, "one line\n" * 3, "en", "b")]
ROWS += [ROWS[4], ROWS[0], ROWS[6]]
#: Names that the operators use themselves, dots, quotes and other cases of their names.
CLASHES = ["key", "host", "lines", "whole", "id", "text_hash", "copies", "row", "order", "bucket", "h", "node", "component", "fp", "n_lines", "media", "error", "DOC", "a.b", "q`t", "__copies", "Kept"]


@pytest.fixture(scope="module")
def odd(spark):
    """documents with odd rows and clashing columns."""
    from pyspark.sql import functions as F

    base = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return base.select("*", *[F.lit(f"mine {k}").alias(c) for k, c in enumerate(CLASHES)])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(12)] + [(3, None, None), (4, 0, 0)], "doc_id long, quality int, toxic int")


def counted(rows):
    out = {}
    for r in rows:
        out[r] = out.get(r, 0) + 1
    return out


def all_ids():
    return counted(r[0] for r in ROWS)


OPERATORS = {
    "op1": lambda d, lab: packing.pack(d).where("piece = 0"),
    "op2": lambda d, lab: quality.score(d, quality.fit(d, lab), 4, 2),
    "op5": lambda d, lab: suffix_dedup.dedup(d),
    "op7": lambda d, lab: langid.predict(d, langid.fit(d)),
    "op8": lambda d, lab: quality.score(d, toxicity.fit(d, lab), 3, 1),
    "op9": lambda d, lab: simhash.near_duplicates(d),
    "op10": lambda d, lab: media.round_trip(d),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_a_row_for_each_row(spark, odd, labels, name):
    """Whatever the rows and the other columns are, each row has its result, and equal rows have equal ones; no rows have none."""
    got = OPERATORS[name](odd, labels).collect()
    assert counted(r["doc_id"] for r in got) == all_ids()
    if name != "op1":
        by = {}
        for r in got:
            by.setdefault(r["doc_id"], set()).add(str(r))
        assert all(len(v) == 1 for k, v in by.items() if k != 4) and len(by[4]) <= 2
    else:
        assert {r["length"] for r in got if r["doc_id"] in (0, 1)} == {1}
    assert OPERATORS[name](odd.limit(0), labels.limit(0)).count() == 0


def test_sequences_of_long_and_repeated_rows(spark, odd):
    pieces = packing.pack(odd, block_pieces=4).collect()
    by = {}
    for r in pieces:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        assert [o for o, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= 1024


def test_urls(spark):
    from pyspark.sql import functions as F

    rows = [(1, "http://ads.example.org/es/x"), (1, "http://ads.example.org/es/x"), (2, None), (None, ""), (4, "http://h.com/" + "a/" * 200_000 + "?affid=1"), (5, "http://x.org")]
    pages = spark.createDataFrame(rows, "page_id long, url string").select("*", *[F.lit(0).alias(c) for c in ("host", "path", "rule", "verdict", "token", "pattern", "rank")])
    for inline in (200, 0):
        got = url_filter.judge(pages, inline_rules=inline)
        assert counted((r["page_id"], r["verdict"]) for r in got.collect()) == {(1, "block"): 2, (2, "allow"): 1, (None, "allow"): 1, (4, "block"): 1, (5, "allow"): 1}
        assert url_filter.judge(pages.limit(0), inline_rules=inline).count() == 0


def test_lines_with_clashing_columns(spark, odd):
    for bound in (100_000, 0):
        out = line_dedup.dedup_lines(odd, n_lines="lines_before", n_removed="gone", broadcast_lines=bound)
        assert out.columns == [*odd.columns, "lines_before", "gone"]
        rows = out.collect()
        assert counted(r["doc_id"] for r in rows) == all_ids()
        for r in rows:
            assert [r[c] for c in CLASHES] == [f"mine {k}" for k in range(len(CLASHES))]
        # Repeated rows are copies of one page: none of their lines stands on two pages.
        assert {r["text"] for r in rows if r["doc_id"] == 3} == {LONG} and all(r["gone"] == 0 for r in rows)


def test_items_and_texts_of_every_kind(spark, odd):
    from pyspark.sql import functions as F

    items = spark.createDataFrame([(1, LONG[5_000:5_400]), (2, None), (3, " "), (1, LONG[5_000:5_400]), (None, "another text of the same id"), (5, "x" * 50)], "item_id long, text string").withColumn("doc_id", F.lit(9))
    found = counted((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(odd, items).collect())
    assert found == {(3, 1): 1, (4, None): 1, (6, 5): 1}
    clean = decontaminate.decontaminate(odd, items)
    assert clean.columns == odd.columns and {r["doc_id"] for r in clean.collect()} == {0, 1, 2, 4, None, 7}
    assert decontaminate.decontaminate(odd, items.limit(0)).count() == len(ROWS) and decontaminate.leaks(odd, items.limit(0)).count() == 0


def test_one_of_near_copies_with_clashing_columns(spark, odd):
    """Rows without words are copies of each other; of rows with one id and text one stays, the first by its columns."""
    from pyspark.sql import functions as F

    other = odd.where("doc_id = 3").withColumn("lang", F.lit("aa"))
    kept = simhash.keep_one(odd.union(other))
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert counted(r["doc_id"] for r in rows) == {0: 1, 3: 1, 4: 2, None: 1, 6: 1, 7: 1}
    assert {r["lang"] for r in rows if r["doc_id"] == 3} == {"aa"}
    assert all(r["a.b"] == f"mine {CLASHES.index('a.b')}" for r in rows)
    assert simhash.keep_one(odd.limit(0)).count() == 0


def test_pipeline_stages_with_odd_rows(spark, odd):
    import corpus_pipeline as cp

    docs = odd
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == odd.columns, name
    rows = docs.collect()
    assert {r["doc_id"] for r in rows} >= {3, None, 7} and all(r["Kept"] == f"mine {CLASHES.index('Kept')}" for r in rows)
    packed = cp.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in rows}


def test_stages_equal_their_definitions(spark):
    """Each filtering stage of the pipeline on real rows against its rule, a document at a time."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    stages = dict(cp.STAGES)
    model = toxicity.fit(docs, labels)
    told = dict(zip(rows, model.scores([r["text"] for r in rows.values()]), strict=True))
    assert ids(stages["toxicity"](spark, docs, SF)) == {d for d, s in told.items() if s < 0.7}
    items = [dc for dc in (decontaminate.normal(r["text"]) for r in benchmark.collect()) if dc]
    index = decontaminate.Items(list(enumerate(items)), decontaminate.EDIT_RATE)
    leaked = {d for d, r in rows.items() if any(x in decontaminate.normal(r["text"]) for x in items)}
    kept = ids(stages["decontamination"](spark, docs, SF))
    assert not kept & leaked and all(decontaminate.matches(index, [decontaminate.normal(rows[d]["text"])]) for d in rows.keys() - kept)
    sets = {}
    for d, r in rows.items():
        words = (r["text"] or "").lower().split()
        sets[d] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    order = sorted(sets)
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            x, y = sets[a], sets[b]
            if (not x and not y) or min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and 10 * len(x & y) >= 8 * len(x | y):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    assert ids(stages["simhash near-dedup"](spark, docs, SF)) == {root(d) for d in sets}


def test_folds_are_by_the_text_of_the_id(spark, odd, labels):
    got = {r["doc_id"]: r["held_out"] for r in quality.score(odd, quality.fit(odd, labels), 4, 2).collect()}
    assert all(h == (d is not None and zlib.crc32(str(d).encode()) % 4 == 2) for d, h in got.items())
