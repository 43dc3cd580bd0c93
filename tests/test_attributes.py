"""Single attributes, edits, mirror files and the server's frames."""

import io
import json
import socketserver
import threading

import pytest
from pyspark.sql import functions as F

from routeloom.functions import attributes as at
from routeloom.functions.policy import Unreadable
from routeloom.sources import irrd, nrtm
from routeloom.streaming.mirror import Mirror


def test_aggregation():
    assert at.parse_components("ATOMIC {10.0.0.0/8^+} protocol BGP4 AS1 protocol OSPF ANY") == {"atomic": True, "filter": "{10.0.0.0/8^+}", "protocols": [("BGP4", "AS1"), ("OSPF", "ANY")]}
    assert at.parse_aggr_mtd("outbound AS1 EXCEPT AS2") == {"kind": "outbound", "ases": ("except", ("as", 1), ("as", 2))}
    got = at.parse_inject("at 1.2.3.4 action pref=1; upon HAVE-COMPONENTS {10.0.0.0/8} AND (STATIC OR EXCLUDE {10.1.0.0/16})")
    assert got["at"] == "1.2.3.4" and got["actions"] == (("pref", "=", "1"),) and got["upon"][0] == "and" and got["upon"][2] == ("or", ("static",), ("exclude", ("prefixes", (("10.1.0.0/16", ""),))))
    assert at.parse_ifaddr("192.0.2.1 masklen 30") == {"address": "192.0.2.1", "masklen": 30, "actions": ()}
    assert at.parse_peer("BGP4 192.0.2.2 asno(65001), flap_damp()") == {"protocol": "BGP4", "peer": "192.0.2.2", "options": (("asno", "65001"), ("flap_damp", ""))}
    assert at.parse_mnt_routes("M-A, M-B {10.0.0.0/8^+}") == {"mntners": ("M-A", "M-B"), "ranges": (("10.0.0.0/8", "^+"),)} and at.parse_mnt_routes("m ANY")["ranges"] is None
    for f, bad in ((at.parse_aggr_mtd, "sideways"), (at.parse_inject, "upon SOMETIMES"), (at.parse_ifaddr, "1.2.3.4 masklen 33"), (at.parse_peer, "BGP4"), (at.parse_mnt_routes, "{10.0.0.0/8}"), (at.parse_components, "AS1 }")):
        with pytest.raises(Unreadable):
            f(bad)


def test_names_and_paths():
    assert at.peer_name("RIPE::as01:AS-CUST:PeerAS", 7) == "RIPE::AS1:AS-CUST:AS7"
    assert [at.every_path(x) for x in (".*", "^.*$", "^ .* $", "^$", ".", "AS1", ".* AS1")] == [True, True, True, False, False, False, False]


def test_actions(spark):
    rows = [([("pref", "=", "10"), ("med", "=", "igp_cost"), ("aspath", "prepend", "AS1 as1 x"), ("community", "append", "1:2 no_export"), ("community", ".=", "3:4")],)]
    df = spark.createDataFrame(rows, "actions array<struct<attribute:string,op:string,value:string>>")
    a = F.col("actions")
    got = df.select(at.action_number(a, "pref"), at.action_number(a, "med"), at.prepended(a), at.communities(a), at.community_match(at.communities(a), F.array(F.lit("3:4"))), at.community_match(at.communities(a), F.array(F.lit("3:4")), equals=True)).first()
    assert list(got) == [10, None, [1, 1], ["1:2", "65535:65281", "3:4"], True, False]


def test_edits(spark):
    attr = lambda n, v: (0, n, v, f"{n}: {v}\n", 1)
    df = spark.createDataFrame([([attr("as-set", "AS-X"), attr("members", "AS1"), attr("descr", "d"), attr("members", "AS2")],)], "attrs array<struct<ord:int,name:string,value:string,raw:string,line:int>>")
    text = lambda c: df.select(F.array_join(F.transform(c, lambda a: a["raw"]), "")).first()[0]
    a = F.col("attrs")
    assert text(at.appended(a, "source", F.lit("TEST"))) == "as-set: AS-X\nmembers: AS1\ndescr: d\nmembers: AS2\nsource: TEST\n"
    assert text(at.replaced(a, "members", F.array(F.lit("AS3"), F.lit("AS4,\nAS5")))) == "as-set: AS-X\nmembers: AS3\nmembers: AS4,\n+ AS5\ndescr: d\n"
    assert text(at.replaced(a, "tech-c", F.array(F.lit("T")))).endswith("members: AS2\ntech-c: T\n")


def test_mirror_files(spark, tmp_path):
    def sequence(name, kind, version, records):
        head = {"nrtm_version": 4, "type": kind, "source": "TEST", "session_id": "s", "version": version}
        (tmp_path / name).write_text("".join(f"\x1e{json.dumps(r)}\n" for r in [head, *records]))

    route = "route: 192.0.2.0/24\norigin: AS1\nsource: TEST\n"
    sequence("1.json", "snapshot", 3, [{"object": route}, {"object": "person: P\nnic-hdl: P1\nsource: TEST\n"}])
    sequence("2.json", "delta", 4, [{"action": "delete", "object_class": "person", "primary_key": "P"}, {"action": "add_modify", "object": "mntner: M\nsource: TEST\n"}])
    records = nrtm.read_sequence(spark, str(tmp_path))
    mirror = Mirror(spark, str(tmp_path / "state"))
    assert mirror.apply(records)["version"] == 4
    assert {(r["class"], r["pk"], r["source"]) for r in mirror.objects().collect()} == {("route", "192.0.2.0/24AS1", "TEST"), ("mntner", "M", "TEST")}
    (tmp_path / "2.json").write_text('\x1e{"nrtm_version": 4, "type": "delta", "source": "T", "session_id": "s", "version": 4}\n\x1e{"bro')
    with pytest.raises(Exception, match="not a record"):
        nrtm.read_sequence(spark, str(tmp_path / "2.json")).collect()


def test_notifications():
    told = {"nrtm_version": 4, "type": "notification", "session_id": "s", "version": 7, "timestamp": 0, "snapshot": {"version": 5, "url": "S"}, "deltas": [{"version": v, "url": f"D{v}"} for v in (5, 6, 7)]}
    read = lambda t, state, now=10: nrtm.read_notification(json.dumps(t), state, nrtm.unsigned, now)
    assert not read(told, {})["stale"] and read(told, {}, 10**6)["stale"]
    assert nrtm.plan(told, {"session": "s", "version": 5}) == ["D6", "D7"] and nrtm.plan(told, {"session": "s", "version": 7}) == []
    assert nrtm.plan(told, {"session": "s", "version": 2}) == nrtm.plan(told, {}) == nrtm.plan(told, {"session": "s", "version": 6}, failures=3) == ["S", "D6", "D7"]
    for bad, state in ((told, {"session": "s", "version": 9}), ({**told, "nrtm_version": 3}, {}), ({**told, "deltas": told["deltas"][::2]}, {}), ({**told, "snapshot": {"version": 8}}, {})):
        with pytest.raises(nrtm.Refused):
            read(bad, state)
    with pytest.raises(nrtm.Refused):
        nrtm.read_notification("junk", {}, nrtm.unsigned, 0)
    assert nrtm.parse_source("ripe=dump:a,b") == {"name": "RIPE", "kind": "dump", "files": ["a", "b"]} and nrtm.parse_source("X=nrtm4:https://h/x,key=k")["key"] == "k"
    for bad in ("X", "X=ftp:a", "X=nrtm4:u", "=dump:a"):
        with pytest.raises(ValueError):
            nrtm.parse_source(bad)


def test_frames():
    read = lambda b: irrd.read_frame(io.BytesIO(b))
    assert read(b"A4\nabc\nC\n") == b"abc" and read(b"C\n") == b"" and read(b"D\n") is None
    for bad in (b"", b"F no\n", b"A9\nabc\nC\n", b"Ax\n", b"A4\nabc\nX\n", b"A9999999999\n"):
        with pytest.raises(irrd.ServerError):
            read(bad)


class Answers(socketserver.StreamRequestHandler):
    def handle(self):
        for line in self.rfile:
            q = line.decode().strip()
            if q == "!q":
                return
            if q != "!!":
                data = {"!gAS1": "10.0.0.0/8", "!gAS2": ""}.get(q)
                self.wfile.write(f"A{len(data) + 1}\n{data}\nC\n".encode() if data else b"C\n" if data == "" else b"F bad\n" if q == "!x" else b"D\n")


def test_server_as_a_source(spark):
    with socketserver.ThreadingTCPServer(("127.0.0.1", 0), Answers) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        spark.dataSource.register(irrd.IRRd)
        df = spark.read.format("irrd").option("host", "127.0.0.1").option("port", server.server_address[1]).option("queries", "!gAS1\n!gAS2\n!gAS3\n!x").load()
        assert {tuple(r) for r in df.collect()} == {("!gAS1", "10.0.0.0/8", None), ("!gAS2", "", None), ("!gAS3", None, None), ("!x", None, "bad")}
        server.shutdown()
