"""Values of single attributes: aggregation components, interfaces, peers, maintainers of routes, actions, communities; edits of objects."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .policy import Parser, Unreadable, as_number, text_of

# Names of well-known communities.
WELL_KNOWN = {"NO_EXPORT": "65535:65281", "NO_ADVERTISE": "65535:65282", "NO_EXPORT_SUBCONFED": "65535:65283", "BLACKHOLE": "65535:666"}


def parse_components(text: str) -> dict:
    """ATOMIC, a filter, and the filters by protocol of a components attribute."""
    p = Parser(text)
    out: dict = {"atomic": p.maybe("ATOMIC"), "filter": None, "protocols": []}
    if p.peek() and p.word() != "PROTOCOL":
        out["filter"] = text_of(p.filter_until("PROTOCOL"))
    while p.maybe("PROTOCOL"):
        out["protocols"].append((p.take().upper(), text_of(p.filter_until("PROTOCOL"))))
    if p.peek():
        raise Unreadable(f"unexpected {p.peek()}")
    return out


def parse_aggr_mtd(text: str) -> dict:
    p = Parser(text)
    kind = p.take("INBOUND", "OUTBOUND").lower()
    inner = p.as_expression() if p.peek() else None
    if p.peek() or kind == "inbound" and inner:
        raise Unreadable(f"unexpected {p.peek() or 'AS expression'}")
    return {"kind": kind, "ases": inner}


def parse_inject(text: str) -> dict:
    """Where, with what actions and under which condition an aggregate is injected."""
    p = Parser(text)
    out: dict = {"at": None, "actions": (), "upon": None}
    if p.maybe("AT"):
        words = []
        while p.peek() and p.word() not in ("ACTION", "UPON"):
            words.append(p.take())
        out["at"] = " ".join(words)
    if p.maybe("ACTION"):
        p.at -= 1
        actions = []
        p.take("ACTION")
        while p.peek() and p.word() != "UPON":
            actions.append(p.action())
            p.maybe(";")
        out["actions"] = tuple(actions)
    if p.maybe("UPON"):
        out["upon"] = condition(p)
    if p.peek():
        raise Unreadable(f"unexpected {p.peek()}")
    return out


def condition(p: Parser) -> tuple:
    left = condition_and(p)
    while p.maybe("OR"):
        left = ("or", left, condition_and(p))
    return left


def condition_and(p: Parser) -> tuple:
    left = condition_test(p)
    while p.maybe("AND"):
        left = ("and", left, condition_test(p))
    return left


def condition_test(p: Parser) -> tuple:
    if p.maybe("("):
        inner = condition(p)
        p.take(")")
        return inner
    kind = p.take("STATIC", "HAVE-COMPONENTS", "EXCLUDE").lower()
    return (kind,) if kind == "static" else (kind, p.primary())


def parse_ifaddr(text: str) -> dict:
    p = Parser(text)
    out: dict = {"address": p.take(), "masklen": None, "actions": ()}
    p.take("MASKLEN")
    length = p.take()
    if not length.isdigit() or int(length) > (128 if ":" in out["address"] else 32):
        raise Unreadable(f"not a mask length: {length}")
    out["masklen"] = int(length)
    if p.maybe("ACTION"):
        actions = []
        while p.peek():
            actions.append(p.action())
            p.maybe(";")
        out["actions"] = tuple(actions)
    if p.peek():
        raise Unreadable(f"unexpected {p.peek()}")
    return out


def parse_peer(text: str) -> dict:
    """Protocol, peer and options of a peer attribute: `BGP4 192.0.2.1 asno(65001), flap_damp()`."""
    m = re.match(r"^\s*(\S+)\s+(\S+?)\s*(?:[\s,]\s*(.*))?$", text, re.S)
    if not m:
        raise Unreadable("expected a protocol and a peer")
    options = re.findall(r"([A-Za-z_][\w.-]*)\s*\(([^()]*)\)", m[3] or "")
    rest = re.sub(r"[A-Za-z_][\w.-]*\s*\([^()]*\)", "", m[3] or "").replace(",", " ").strip()
    if rest:
        raise Unreadable(f"unexpected {rest}")
    return {"protocol": m[1].upper(), "peer": m[2], "options": tuple((n.lower(), v.strip()) for n, v in options)}


def parse_mnt_routes(text: str) -> dict:
    """Maintainers, and the prefixes that their right is limited to (None: all)."""
    head, brace, rest = text.partition("{")
    names = [n for n in re.split(r"[\s,]+", head) if n]
    everything = bool(names) and names[-1].upper() == "ANY"
    if everything:
        names.pop()
    if not names or everything and brace:
        raise Unreadable("expected a maintainer, and ANY or a prefix list behind it")
    ranges = None
    if brace:
        p = Parser("{" + rest)
        ranges = p.primary()[1]
        if p.peek():
            raise Unreadable(f"unexpected {p.peek()}")
    return {"mntners": tuple(n.upper() for n in names), "ranges": ranges}


# ---- actions (attribute, op, value) as columns


def action_values(actions: Column, attribute: str, *ops: str) -> Column:
    return F.transform(F.filter(actions, lambda a: (a["attribute"] == attribute) & a["op"].isin(*ops)), lambda a: a["value"])


def action_number(actions: Column, attribute: str) -> Column:
    """The last number that an attribute is set to; null for none and for words such as igp_cost."""
    return F.try_element_at(action_values(actions, attribute, "="), F.lit(-1)).try_cast("long")


def prepended(actions: Column) -> Column:
    """AS numbers that are put before a path."""
    words = F.flatten(F.transform(action_values(actions, "aspath", "prepend"), lambda v: F.split(F.upper(v), " ")))
    return F.array_compact(F.transform(words, lambda w: F.regexp_extract(w, r"^AS(\d+)$", 1).try_cast("long")))


def communities(actions: Column, *ops: str) -> Column:
    return F.flatten(F.transform(action_values(actions, "community", *(ops or ("append", ".=", "="))), lambda v: F.split(canonical(v), " ")))


def canonical(text: Column) -> Column:
    """Communities in upper case with well-known names as numbers."""
    out = F.upper(text)
    for name, value in WELL_KNOWN.items():
        out = F.regexp_replace(out, rf"\b{name}\b", value)
    return out


def community_match(have: Column, want: Column, equals: bool = False) -> Column:
    """Whether communities hold all that are wanted, or are exactly these; text is compared without case."""
    up = lambda c: F.array_distinct(F.transform(c, lambda x: F.upper(x)))
    missing = F.size(F.array_except(up(want), up(have))) == 0
    return missing & (F.size(F.array_except(up(have), up(want))) == 0) if equals else missing


# ---- edits of attribute arrays


def appended(attrs: Column, name: str, value: Column) -> Column:
    """attrs with one more attribute behind the last."""
    raw = F.concat(F.lit(f"{name}: "), F.regexp_replace(value, "\n", "\n+ "), F.lit("\n"))
    line = F.coalesce(F.try_element_at(attrs, F.lit(-1))["line"], F.lit(0)) + 1
    new = F.struct(F.size(attrs).cast("int").alias("ord"), F.lit(name).alias("name"), value.alias("value"), raw.alias("raw"), line.cast("int").alias("line"))
    return F.concat(attrs, F.array(new))


def replaced(attrs: Column, name: str, values: Column) -> Column:
    """attrs with all of an attribute's values replaced, in the place of the first, or behind all."""
    made = F.transform(values, lambda v: F.struct(F.lit(0).alias("ord"), F.lit(name).alias("name"), v.alias("value"), F.concat(F.lit(f"{name}: "), F.regexp_replace(v, "\n", "\n+ "), F.lit("\n")).alias("raw"), F.lit(0).alias("line")))
    at = F.array_position(F.transform(attrs, lambda a: a["name"]), name)
    rest = lambda part: F.filter(part, lambda a: a["name"] != name)
    before = F.when(at > 0, F.slice(attrs, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int"))).otherwise(attrs)
    after = F.when(at > 0, rest(F.slice(attrs, F.greatest(at, F.lit(1)).cast("int"), F.size(attrs)))).otherwise(F.slice(attrs, 1, 0))
    both = F.concat(before, made, after)
    return F.transform(both, lambda a, i: F.struct(i.cast("int").alias("ord"), a["name"].alias("name"), a["value"].alias("value"), a["raw"].alias("raw"), a["line"].alias("line")))


def every_path(expression: str) -> bool:
    """Whether an AS-path expression takes every path for sure: only dots and anchors, with nothing that asks for an AS."""
    words = re.sub(r"\s+", "", expression)
    return bool(re.fullmatch(r"\^?(?:\.\*|\(\.\*\))*\$?|\^?(?:\.\*)+\$?", words)) and words not in ("^$",)


def peer_name(name: str, peer: int) -> str:
    """A set name with PeerAS components bound."""
    parts = name.split("::")[-1].split(":")
    bound = ":".join(f"AS{peer}" if p.upper() == "PEERAS" else f"AS{n}" if (n := as_number(p)) is not None else p.upper() for p in parts)
    return "::".join([*name.split("::")[:-1], bound])
