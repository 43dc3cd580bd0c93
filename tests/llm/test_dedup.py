"""Packing, suffix dedup, SimHash, decontamination and line dedup against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from routeloom.llm import decontaminate as dc
from routeloom.llm import line_dedup, packing, simhash, suffix_dedup
from routeloom.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], DOCS)


# ---- packing


def slow_ids(texts):
    """The ids of the public tokenizer as its JSON file has it."""
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [slow.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_equal_tokenizers():
    fast = packing.Encoder("byte_bpe_50k")
    rng = random.Random(1)
    texts = ["", " ", "\n\n  a", "don't  STOP 12345 ¿qué? naïve 日本語 🙂\t\r\n x", "a" * 3000, "\u0301e\u200b", "one two<|endoftext|>three", "<|endoftext|>", " <|endoftext|> <|endoftext|><|endoftext|>\n", "<|endoftext|", "<|<|endoftext|>|>", "<|ENDOFTEXT|>", "é<|endoftext|>日本語"]
    texts += ["".join(rng.choice(["a", "b", " ", "'", "st", "\n", "1", "é", ".,", "!", "日", "\t", "<|endoftext|>", "<|"]) for _ in range(rng.randrange(200))) for _ in range(300)]
    assert [fast.ids(t).tolist() for t in texts] == slow_ids(texts)
    assert fast.ids("one two<|endoftext|>three").tolist() == [505, 734, 50256, 15542]


def test_ids_of_runs_that_are_too_long_for_the_fast_tokenizer():
    texts = ["x" + " " * 400_000 + "y", "\n" * 300_000 + "z"]
    fast = packing.Encoder("byte_bpe_50k")
    assert [fast.ids(t).tolist() for t in texts] == slow_ids(texts)


@given(st.lists(st.integers(1, 64), max_size=300), st.booleans())
@settings(max_examples=60, deadline=None)
def test_sum_of_squares_places_all_within_capacity(lengths, early):
    bins, offsets, made = packing.sum_of_squares(np.array(sorted(lengths, reverse=True), np.int64), 64, early)
    assert made == len({*bins.tolist()})
    held = {}
    for b, o, n in zip(bins, offsets, sorted(lengths, reverse=True), strict=True):
        assert o == held.get(b, 0)
        held[b] = o + n
    assert all(v <= 64 for v in held.values())


@pytest.mark.parametrize("early", [True, False])
def test_sum_of_squares_is_the_rule(early):
    """Each placement makes the sum of squares least among the open bins with room and, in one form, a new bin."""
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 21, 200)
    bins, _, _ = packing.sum_of_squares(lengths, 20, early)
    gaps = {}
    for b, s in zip(bins.tolist(), lengths.tolist(), strict=True):
        def total(change):
            after = list((gaps | change).values())
            return sum(after.count(g) ** 2 for g in range(1, 20))

        fits = [k for k, g in gaps.items() if g >= s]
        options = [total({k: gaps[k] - s}) for k in fits] + [total({"new": 20 - s})] * (early or not fits)
        assert total({b: gaps.get(b, 20) - s}) == min(options)
        assert b in gaps or early or not fits
        gaps[b] = gaps.get(b, 20) - s


def test_pack_pieces_and_few_sequences(spark):
    rng = random.Random(2)
    rows = [(k, " ".join("word" for _ in range(rng.randrange(1, 2600)))) for k in range(60)] + [(60, None), (61, ""), (62, ""), (None, "x"), (1, "again")]
    got = packing.pack(docs(spark, rows)).collect()
    want = []
    for (i, _), ids in zip(rows, slow_ids([t or "" for _, t in rows]), strict=True):
        ids = [*ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 1024
    assert sum(r["length"] == 1024 for r in got) == sum(max(p)[1] == 1024 for p in by.values())
    assert len(by) <= sum(r["length"] for r in got) / 1024 * 1.1 + 2
    assert packing.pack(docs(spark, [])).count() == 0


# ---- suffix dedup


def brute_spans(rows, width=100):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if (s := b[i : i + width]) in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(s)
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out[doc_id] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def test_suffix_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    passages = ["".join(rng.choice("abcdef é\n") for _ in range(rng.randint(60, 400))) for _ in range(12)]
    rows = []
    for d in range(120):
        text = ""
        for _ in range(rng.randint(0, 5)):
            kind, p = rng.random(), rng.choice(passages)
            if kind < 0.5:
                text += p[rng.randrange(0, 40) : len(p) - rng.randrange(0, 40)]
            elif kind < 0.7:
                text += rng.choice(["ab ", "xyz\0q", "w"]) * rng.randint(10, 90)
            else:
                text += "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 200)))
        rows.append((d, text))
    rows += [(500, rows[3][1]), (501, None), (502, "")]
    got = suffix_dedup.dedup(docs(spark, rows).repartition(5))
    assert {r["doc_id"]: tuple(r)[1:5] for r in got.collect()} == brute_spans(rows)


def test_suffix_dedup_pieces_and_repeated_rows(spark, monkeypatch):
    rng = random.Random(6)
    text = "".join(rng.choice("abc") for _ in range(900))
    monkeypatch.setattr(suffix_dedup, "PIECE", 150)
    whole = suffix_dedup.anchors([text.encode(), b"", b"x" * 99])
    monkeypatch.setattr(suffix_dedup, "PIECE", 10_000)
    assert sorted({*zip(whole[0].tolist(), whole[1].tolist(), strict=True)}) == sorted(zip(*(x.tolist() for x in suffix_dedup.anchors([text.encode(), b"", b"x" * 99])[:2]), strict=True))
    # A repeated row isn't its own copy; a null id comes last.
    got = {(r["doc_id"], r["n_removed"]) for r in suffix_dedup.dedup(docs(spark, [(1, text), (1, text), (None, text)])).collect()}
    assert got == {(1, 0), (None, 900)}
    assert suffix_dedup.dedup(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.repeated_spans(docs(spark, []), 300)


@given(st.lists(st.lists(st.binary(min_size=6, max_size=6), max_size=30), max_size=7))
@settings(max_examples=80, deadline=None)
def test_loser_tree_merges_with_right_prefixes(lists):
    import pyarrow as pa

    runs, rows = [], []
    for items in lists:
        items = sorted(set(items))
        if not items:
            continue
        rows += items
        matrix = np.frombuffer(b"".join(items), np.uint8).reshape(-1, 6)
        prefix = suffix_dedup.shared_prefix(matrix)
        rest = b"".join(x[p:] for x, p in zip(items, prefix, strict=True))
        runs.append(suffix_dedup.Run(prefix.astype(np.uint8).tobytes(), pa.Codec("zstd").compress(rest, asbytes=True), 6))
    out = list(suffix_dedup.merge(runs)) if runs else []
    assert [k for *_, k in out] == sorted(rows)
    for (*_, a), (_, _, shared, b) in zip(out, out[1:], strict=False):
        assert shared == next((i for i in range(6) if a[i] != b[i]), 6)


# ---- SimHash


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def union(pairs, items):
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


@given(st.integers(0, 2**32), st.integers(0, 5))
@settings(max_examples=30, deadline=None)
def test_gray_index_equals_all_pairs(seed, limit):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, 6, dtype=np.uint64)
    n = 150
    code = base[rng.integers(0, 6, n)]
    for _ in range(int(rng.integers(0, 6))):
        code = code ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
    group = rng.integers(0, 3, n)
    a, b = simhash.forest(group, code, limit)
    want = union([(i, j) for i in range(n) for j in range(i) if group[i] == group[j] and int(code[i] ^ code[j]).bit_count() <= limit], range(n))
    got = union(zip(a.tolist(), b.tolist(), strict=True), range(n))
    assert len({*zip(want.values(), got.values(), strict=True)}) == len({*want.values()}) == len({*got.values()})


def test_every_pair_within_the_limit_shares_a_mask():
    rng = random.Random(3)
    for items in (10, 10**8, 10**12):
        masks = simhash.segment_masks(4, items)
        for _ in range(300):
            x = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not x & m for m in masks)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for d in range(150):
        text = [rng.choice(words) for _ in range(rng.randrange(0, 300))]
        rows.append((2 * d, " ".join(text)))
        if d % 3 == 0 and text:
            text[rng.randrange(len(text))] = "CHANGED"
            rows.append((2 * d + 1, "\n".join(text)))
    rows += [(900, None), (901, ""), (902, " \t\x0b"), (903, "É é"), (904, "É É")]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    prints = {d: slow_print(t) for d, t in rows}
    ids = sorted(prints)
    want = union([(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4], ids)
    assert got == {d: (f"{prints[d]:016x}", want[d]) for d in ids}
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("in_one_task", [0, 10_000])
def test_components_of_chains_and_stars(spark, in_one_task):
    rng = random.Random(9)
    pairs = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 300)] + [(rng.randrange(500, 700), rng.randrange(500, 700)) for _ in range(120)]
    pairs = [p for p in pairs if p[0] != p[1]]
    want = union(pairs, {x for p in pairs for x in p})
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame([*pairs, (400, 400)], "a long, b long"), in_one_task).collect()}
    assert got == want


@pytest.mark.parametrize("in_one_task", [0, 10_000])
def test_components_of_a_hub(spark, in_one_task):
    pairs = [(0, k) for k in range(1, 3000)] + [(5000 + k, 5000 + k // 2) for k in range(1, 500)] + [(2999, 5499)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long"), in_one_task).collect()}
    assert got == dict.fromkeys({x for p in pairs for x in p}, 0)


def test_keep_one_of_similar_documents(spark):
    rng = random.Random(8)
    words = [f"word{k}" for k in range(3000)]
    rows, copies = [], []
    for d in range(60):
        text = [rng.choice(words) for _ in range(300)]
        rows.append((d, " ".join(text)))
        if d % 4 == 0:
            text[rng.randrange(300)] = "other"
            copies.append((1000 + d, " ".join(text)))
    rows += copies + [(2000, rows[1][1]), (2, rows[2][1]), (3000, None), (3001, "")]
    kept = simhash.keep_one(docs(spark, rows).withColumnRenamed("lang", "wide"))
    assert kept.columns == ["doc_id", "text", "wide", "source", "n_chars"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(60), 3000]


def shingle_set(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b)


def test_block_edits_are_near_copies(spark):
    """Appended, cut-off and replaced blocks that leave a similarity of 0.8 to 0.9."""
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows = []
    for d in range(120):
        n = rng.randrange(60, 500)
        text = fresh(n)
        share = rng.uniform(0.02, 0.07) if d % 3 == 2 else rng.uniform(0.11, 0.19)
        k = int(n * share)
        other = {0: lambda: text + fresh(k), 1: lambda: text[: n - k], 2: lambda: text[: n // 3] + fresh(k) + text[n // 3 + k :]}[d % 3]()
        if 0.8 <= similarity(" ".join(text), " ".join(other)) <= 0.9:
            rows += [(2 * d, " ".join(text)), (2 * d + 1, " ".join(other))]
    assert len(rows) > 120
    kept = {r["doc_id"] for r in simhash.keep_one(docs(spark, rows)).collect()}
    assert kept == {d for d, _ in rows if d % 2 == 0}


def test_near_copies_are_the_components_of_exact_similarity(spark):
    """Pairs, chains and a star around 0.8: what goes is exactly what the similarities of the whole sets say."""
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows = []
    for _ in range(90):
        text = fresh(rng.randrange(40, 300))
        rows.append(" ".join(text))
        for _ in range(rng.choice([1, 1, 1, 3])):
            k = int(len(text) * rng.uniform(0.15, 0.4))
            text = [*text, *fresh(k)] if rng.random() < 0.7 else text[k // 3 :]
            rows.append(" ".join(text))
    base = fresh(200)
    rows += [" ".join(base[:180] + fresh(k)) for k in range(10, 40)] + [" ".join(fresh(n)) for n in range(1, 9)] + ["a b c d e f g h", "a b c d e f g h i", "one", "ONE"]
    rows = list(enumerate(rows))
    sets = [shingle_set(t.lower()) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    near = sum(5 * len(sets[i] | sets[j]) < 8 * len(sets[i] & sets[j]) < 6.4 * len(sets[i] | sets[j]) for i in range(len(rows)) for j in range(i))
    assert len(pairs) > 30 and near > 30
    want = union(pairs, range(len(rows)))
    kept = {r["doc_id"] for r in simhash.keep_one(docs(spark, rows)).collect()}
    assert kept == set(want.values())


@pytest.mark.parametrize("most", [7, 50_000])
def test_large_groups_are_split_and_lose_no_link(spark, most):
    """A group of near copies, strays that share its bands, and a chain; small parts and one whole group give the components of all pairs."""
    rng = random.Random(21)
    fresh = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    base, rows = fresh(200), []
    for k in range(60):
        rows.append(" ".join(base[:190] + fresh(rng.randrange(1, 12))))
    for k in range(20):
        rows.append(" ".join(base[: rng.randrange(120, 185)] + fresh(rng.randrange(20, 60))))
    chain = fresh(150)
    for k in range(6):
        rows.append(" ".join(chain[12 * k :] + fresh(12 * k)))
    rows += [rows[0]] * 40 + [" ".join(fresh(80)) for _ in range(20)]
    sets = [shingle_set(t) for t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    want = union(pairs, range(len(rows)))
    got = {r["doc_id"]: r["component"] for r in simhash.similar_groups(docs(spark, list(enumerate(rows))), most=most).collect()}
    assert len({*zip(want.values(), [bytes(got[k]) for k in want], strict=True)}) == len({*want.values()}) == len({bytes(x) for x in got.values()})


@pytest.mark.parametrize("most", [70, 50_000])
def test_links_of_a_group_are_fewer_than_its_members_and_leaders(spark, most):
    """200 near copies held against 100 of them: a forest in each part, not all pairs."""
    rng = random.Random(22)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = docs(spark, [(k, " ".join([*base, f"end{k}"])) for k in range(200)] + [(900, "quite another text of some words")])
    prints = simhash.set_prints(rows, 5)
    members = prints.select(F.lit(b"g").alias("g"), "node", F.col("node").alias("component"))
    leaders = members.join(prints.where("doc_id < 100").select("node"), "node").select("g", "node", "component")
    links = simhash.similar_pairs(members, leaders, simhash.whole_sets(rows, prints, prints.select("node"), 5), 0.8, most).collect()
    parts = math.ceil(201 / most)
    assert len(links) <= 201 + 100 * parts
    near = {bytes(r["node"]) for r in prints.where("doc_id < 900").collect()}
    want = union([(bytes(a), bytes(b)) for a, b in links], near)
    assert len(set(want.values())) == 1


def test_leaders_of_a_round_are_bounded_by_their_items(spark, monkeypatch):
    """Texts alike in part: the leaders that a task holds have few items in all, few strays go in one round, and no link is lost."""
    rng = random.Random(23)
    fresh = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    base = fresh(200)
    rows = [" ".join(base[:168] + fresh(32)) for _ in range(40)] + [" ".join(base[: 186 + k] + fresh(6)) for k in range(6)]
    sets = [shingle_set(t) for t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    want, calls, held = union(pairs, range(len(rows))), [], simhash.similar_pairs
    assert 20 < len({*want.values()}) < 46

    def seen(members, leaders, found, *rest):
        calls.append(leaders.join(found.select("node", F.size(F.udf(lambda x: simhash.unpacked(bytes(x), 5).tolist(), "array<bigint>")("items")).alias("size")), "node").groupBy("g").agg(F.sum("size").alias("items")).agg(F.max("items")).first()[0])
        return held(members, leaders, found, *rest)

    monkeypatch.setattr(simhash, "similar_pairs", seen)
    for items, rounds in ((1500, None), (simhash.LEADERS * 1000, 2)):
        calls.clear()
        monkeypatch.setattr(simhash, "LEADER_ITEMS", items, raising=False)
        got = {r["doc_id"]: bytes(r["component"]) for r in simhash.similar_groups(docs(spark, list(enumerate(rows)))).collect()}
        assert len({*zip(want.values(), [got[k] for k in want], strict=True)}) == len({*want.values()}) == len({*got.values()})
        assert max(calls) <= items and len(calls) == (rounds or len(calls)) >= 2


def test_sets_travel_whole():
    for text in (None, b"", b"one", b"A b\tC\x0bd e F g", b"x " * 5000, "ß €ö a b c d".encode(), b"\xff a\x00b c d e f " * 3, " ".join(map(str, range(9000))).encode()):
        own = np.unique(simhash.hashes(simhash.shingles(simhash.words_of(text), 5)))
        sent = simhash.packed(text, own)
        assert len(sent) <= own.nbytes + 1
        assert (simhash.unpacked(sent, 5) == own).all()


# ---- decontamination


def test_leaks_with_edits_and_without(spark):
    rng = random.Random(7)
    words = ["the", "of", "thing", "er", "onth", "re", "and", "quick", "blend", "sto"]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))
    items = [(k, prose(rng.randrange(12, 30))) for k in range(20)] + [(50, "abc"), (51, ""), (None, None)]
    rows, want = [], set()
    for d in range(100):
        k = rng.randrange(20)
        held = list(items[k][1])
        for _ in range(rng.randrange(0, len(held) // 14)):
            held[rng.randrange(len(held))] = rng.choice("xyz")
        if d % 2:
            rows.append((d, prose(rng.randrange(60)) + "  " + "".join(held).upper() + "\n" + prose(40)))
            want.add((d, k))
        else:
            rows.append((d, prose(rng.randrange(120))))
    rows += [(200, None), (201, ""), (202, "xx ABC yy")]
    want.add((202, 50))
    found = dc.leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block_bytes=700).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want
    for r in found:
        region = dc.normal(dict(rows)[r["doc_id"]])[r["start"] : r["start"] + r["length"]]
        item = dc.normal(dict(items)[r["item_id"]])
        assert edit_distance(item, region) == r["edits"] <= len(item) * 0.1
    clean = dc.decontaminate(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in want}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(last + (x != y), row[j] + 1, row[j + 1] + 1)
    return row[-1]


def test_leaks_equal_all_pairs(spark):
    """Every text against every item by plain edit distance: what is found is what lies within the allowed edits."""
    rng = random.Random(17)
    prose = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    items = [(k, prose(rng.randrange(9, 70))) for k in range(25)] + [(40, "dcba"), (41, "  "), (42, None)]
    rows = []
    for d in range(90):
        held = list(items[rng.randrange(25)][1])
        for _ in range(rng.randrange(0, 8)):
            at = rng.randrange(len(held))
            held[at : at + rng.randrange(2)] = rng.choice(["", "x", "yz"])
        rows.append((d, prose(rng.randrange(60)) + "".join(held) * (d % 3 > 0) + prose(rng.randrange(40))))
    index = dc.Items([(k, dc.normal(t)) for k, t in items if dc.normal(t)], 0.1)
    want = set()
    for d, t in rows:
        text = dc.normal(t)
        for item_id, item, edits in zip(index.ids, index.texts, index.edits.tolist(), strict=True):
            row = [0] * (len(text) + 1)
            for i, x in enumerate(item):
                last, row[0] = row[0], i + 1
                for j, y in enumerate(text):
                    last, row[j + 1] = row[j + 1], min(last + (x != y), row[j] + 1, row[j + 1] + 1)
            if min(row) <= edits:
                want.add((d, item_id))
    assert 40 < len(want) < 2000
    found = dc.leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want


def test_leaks_in_windows_of_a_long_text(spark, monkeypatch):
    rng = random.Random(18)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    items = [(k, prose(20)) for k in range(30)]
    text = " ".join(prose(rng.randrange(5, 30)) + " " + x for _, x in items)
    whole = dc.Items([(k, dc.normal(t)) for k, t in items], 0.1)
    want = dc.matches(whole, [dc.normal(text)])
    assert [k for _, k, *_ in want] == list(range(30))
    monkeypatch.setattr(dc, "WINDOW", 97)
    assert dc.matches(whole, [dc.normal(text)]) == want


# ---- line dedup


def slow_lines(rows, ratio=0.05, least=2):
    """(id, text, lines, removed) of rows (id, text, host)."""
    out = []
    hosts = {}
    for _, t, h in rows:
        hosts.setdefault(h, set()).add(t)
    for i, t, h in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        has = lambda x, line: x is not None and line in {y.strip(" ") for y in x.split("\n")}
        kept = []
        for line in t.split("\n"):
            n = sum(has(x, line.strip(" ")) for x in hosts[h])
            if not line.strip(" ") or n < least or n / len(hosts[h]) <= ratio:
                kept.append(line)
        out.append((i, "\n".join(kept), len(t.split("\n")), len(t.split("\n")) - len(kept)))
    return sorted(map(str, out))


def test_line_dedup(spark):
    rng = random.Random(3)
    rows = [(k, f"Menu\nunique {k} is a long line of its own text\n Menu \nFooter {k % 2}", "a") for k in range(20)]
    rows += [(100 + k, f"Menu\nother {k}", None) for k in range(2)] + [(200 + k, "copied whole page\nof two lines", "b") for k in range(9)] + [(300, None, "a"), (301, "", "a"), (302, "Menu\nFooter 1", "a"), (303, "Menu\n \n", "")]
    rows += [(400 + k, "\n".join(rng.choice(["x", "y ", "z", "", "\t"]) + str(rng.randrange(40)) for _ in range(rng.randrange(9))), "c") for k in range(80)]
    df = spark.createDataFrame([(i, t, "en", h, 1) for i, t, h in rows], DOCS)
    got = line_dedup.dedup_lines(df)
    told = {r["doc_id"]: r for r in got.collect()}
    assert told[3]["text"] == "unique 3 is a long line of its own text" and told[3]["n_removed"] == 3
    assert told[302]["text"] == "" and told[302]["n_removed"] == 2  # all of it is boilerplate
    assert told[200]["text"] == "copied whole page\nof two lines" and told[100]["text"] == "other 0"
    view = lambda frame: sorted(str((r["doc_id"], r["text"], r["n_lines"], r["n_removed"])) for r in frame.collect())
    assert view(got) == slow_lines(rows)
    assert view(line_dedup.dedup_lines(df, broadcast_lines=0)) == slow_lines(rows)
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0
