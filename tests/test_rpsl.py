"""The dump scan: no loss, splits, odd line ends and encodings."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from routeloom.sources import rpsl

DUMP = """# leading comment

aut-num:  AS65001   # a comment
descr:    one
          two
+
+three
members:  AS1, AS2,, AS3,
          AS-FOO
source:   TEST

route: 192.0.2.0/24
origin: AS65001
nonsense line
SOURCE : RIPE
 \t
as-set: AS-X
source: TEST"""


@given(st.lists(st.sampled_from(["a: b", " c", "+", "\td # x", "# e", "junk", "", ":", "x y: z\r"]), max_size=12))
@settings(max_examples=200, deadline=None)
def test_nothing_is_lost(lines):
    raw = [x + "\n" for x in lines]
    assert rpsl.parse_object(raw).text() == "".join(raw)


def test_attribute_values():
    o = rpsl.parse_object(DUMP.split("\n\n")[1].splitlines(keepends=True))
    assert [(a.name, a.value) for a in o.attrs] == [("aut-num", "AS65001"), ("descr", "one\ntwo\n\nthree"), ("members", "AS1, AS2,, AS3,\nAS-FOO"), ("source", "TEST")]
    assert rpsl.list_items(o.first("members")) == ["AS1", "AS2", "", "AS3", "AS-FOO"]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", ["30", "64", "100000"])
def test_scan_over_splits(spark, tmp_path, end, size):
    (tmp_path / "a.db").write_bytes(DUMP.replace("\n", end).encode() + b"\n")
    (tmp_path / "b.db").write_bytes(b"person: J\xf6rg\nsource: TEST\n\n\n" + b"mntner: M" + b"\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        rows = rpsl.scan(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    by = {r["key"]: r for r in rows}
    assert sorted(by) == ["192.0.2.0/24", "AS-X", "AS65001", "Jörg", "M"] and len(rows) == 5
    assert by["192.0.2.0/24"]["source"] == "RIPE" and [d["rule"] for d in by["192.0.2.0/24"]["diags"]] == ["lexer/malformed-line"]
    assert [d["rule"] for d in by["Jörg"]["diags"]] == ["rpsl/not-utf8"] and by["AS-X"]["diags"] == []
    assert [a["value"] for a in by["AS65001"]["attrs"]][1] == "one\ntwo\n\nthree"


def test_columns(spark):
    rows = spark.createDataFrame([("AS65001",), (" as1.10 ",), ("AS4294967296",), ("65001",), ("AS-FOO",)], "t string")
    assert [r[0] for r in rows.select(rpsl.as_number(F.col("t"))).collect()] == [65001, 65546, None, None, None]


def test_rpki_files(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"roas": [{"prefix": "10.0.0.0/8", "maxLength": 9, "asn": "AS1", "ta": "x"}, {"prefix": "10.0.0.0/8", "asn": 2}]}))
    assert [(r["plen"], r["max_length"], r["asn"]) for r in rpsl.read_vrps(spark, str(tmp_path / "v.json")).collect()] == [(8, 9, 1), (8, 8, 2)]
    (tmp_path / "bad.json").write_text(json.dumps({"roas": [{"prefix": "x", "asn": "AS1"}]}))
    with pytest.raises(Exception, match="not a ROA"):
        rpsl.read_vrps(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "a.json").write_text(json.dumps({"aspas": [{"customer": "AS1", "providers": ["AS2", "3"]}, {"customer": "AS1", "providers": [3]}]}))
    assert {tuple(r) for r in rpsl.read_aspas(spark, str(tmp_path / "a.json")).collect()} == {(1, 2), (1, 3)}
    filters, added = rpsl.read_slurm(json.dumps({"slurmVersion": 1, "validationOutputFilters": {"prefixFilters": [{"asn": 1}]}, "locallyAddedAssertions": {"prefixAssertions": [{"asn": 2, "prefix": "10.0.0.0/9"}]}}))
    assert filters == [{"prefix": None, "asn": 1}] and added[0]["max_length"] == 9
