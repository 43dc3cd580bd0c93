"""The mirror against a plain replay."""

import json

from routeloom.streaming.mirror import Mirror


def record(version, pk, payload=None, kind="delta", session="s1", operation=None):
    return {"session": session, "version": version, "kind": kind, "operation": operation or ("ADD" if payload is not None else "DEL"), "class": "route", "pk": pk, "source": "TEST", "payload": payload}


def held(mirror):
    return {r["pk"]: r["payload"] for r in mirror.objects().collect()}


def test_follow(spark, tmp_path):
    source, n = tmp_path / "in", 0
    source.mkdir()
    mirror = Mirror(spark, str(tmp_path / "state"))

    def arrive(*records):
        nonlocal n
        n += 1
        (source / f"{n}.json").write_text("\n".join(map(json.dumps, records)))
        q = mirror.follow(str(source), str(tmp_path / "checkpoint"))
        q.awaitTermination()
        return mirror.status()["version"]

    assert mirror.needs_snapshot() and held(mirror) == {}
    assert arrive(record(1, "a", "x")) == 0
    assert arrive(record(5, "a", "1", "snapshot"), record(5, "b", "2", "snapshot"), record(6, "a", "3"), record(7, "b")) == 7
    assert held(mirror) == {"a": "3"}
    assert arrive(record(7, "a", "old"), record(9, "c", "gap")) == 7 and held(mirror) == {"a": "3"}
    assert arrive(record(8, "d", "4")) == 8 and held(mirror) == {"a": "3", "d": "4"}
    assert arrive(record(9, "d", "5", session="s2")) == 8
    for _ in range(2):
        arrive(record(20, "z", "far"))
    assert mirror.needs_snapshot()
    assert arrive(record(2, "q", "6", "snapshot", "s2"), record(3, "q", "7", session="s2")) == 3
    assert held(mirror) == {"q": "7"} and not mirror.needs_snapshot() and mirror.status()["session"] == "s2"
    assert arrive(record(2, "q", "old", "snapshot", "s2")) == 3 and held(mirror) == {"q": "7"}


def test_order_inside_a_delta(spark, tmp_path):
    """An object that one delta adds and deletes, or deletes and adds again, ends as the last record says."""
    source = tmp_path / "in"
    source.mkdir()
    records = [record(1, "a", "1", "snapshot"), record(2, "a", "2"), record(2, "a"), record(2, "b"), record(2, "b", "3"), record(2, "c", "4"), record(2, "c"), record(2, "c", "0"), record(3, "d", "5"), record(3, "d")]
    (source / "1.json").write_text("\n".join(map(json.dumps, records)))
    mirror = Mirror(spark, str(tmp_path / "state"))
    mirror.follow(str(source), str(tmp_path / "checkpoint")).awaitTermination()
    assert held(mirror) == {"b": "3", "c": "0"} and mirror.status()["version"] == 3
    mirror.apply(spark.createDataFrame([(*("s1", 4, "delta", o, "route", "z", "TEST", p), k) for k, (o, p) in enumerate([("DEL", None), ("ADD", "9"), ("DEL", None), ("ADD", "8")])], "session string, version long, kind string, operation string, class string, pk string, source string, payload string, place long"))
    assert held(mirror) == {"b": "3", "c": "0", "z": "8"}
