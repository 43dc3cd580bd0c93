"""Registry queries as text commands, answered from tables.

A command is planned as a DataFrame, and only its answer, which the asker gets as one text, comes to the driver. Answers are framed:
`A<bytes>`, the data and `C`; `C` alone for success without data; `D` for a key that isn't there; `F <message>` for an error.
"""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import prefix_text
from . import cover, expand


@dataclass
class Tables:
    """sets (set_name, class, source, mbrs_by_ref), members (set_name, source, asn, child), routes (af, prefix, plen, key, origin, source) of
    both families, or (addr, plen, key, origin, source) of IPv4 alone,
    objects (class, pk, source, text), attributes (class, pk, source, name, value); sources in order of precedence, with serials."""

    sets: DataFrame
    members: DataFrame
    routes: DataFrame
    objects: DataFrame
    attributes: DataFrame
    serials: dict[str, int] = field(default_factory=dict)


class NotThere(Exception):
    pass


class Refused(Exception):
    pass


# Attributes that have an inverse index.
INVERSE = ("origin", "member-of", "mbrs-by-ref", "members", "mp-members", "mnt-by")


class Session:
    def __init__(self, tables: Tables, version: str = "routeloom") -> None:
        self.tables, self.version = tables, version
        self.sources, self.persistent, self.closed = list(tables.serials), False, False

    def do(self, line: str) -> str:
        """The framed answer of one command."""
        line = line.strip("\r\n")
        try:
            if line.startswith("!"):
                data = self.bang(line[1:])
            else:
                return self.ripe(line)
        except NotThere:
            return "D\n"
        except Refused as e:
            return f"F {e}\n"
        return f"A{len(data.encode()) + 1}\n{data}\nC\n" if data else "C\n"

    # ---- commands

    def bang(self, line: str) -> str:
        command, arg = line[:1], line[1:].strip()
        if command == "!" or command == "q":
            self.persistent, self.closed = command == "!", command == "q"
            return ""
        if command in "nt" and command:
            return ""
        if command == "v":
            return self.version
        if command == "s":
            return self.select(arg)
        if command == "j":
            names = self.sources if arg == "-*" else arg.upper().split(",")
            return "\n".join(f"{n}:Y:0-{self.tables.serials[n]}" if n in self.tables.serials else f"{n}:X:" for n in names)
        if command in "g6" and command:
            return self.originated(arg, 4 if command == "g" else 6)
        if command == "i":
            name, _, recursive = arg.partition(",")
            return self.members(name.upper(), recursive.strip() == "1")
        if command == "a":
            m = re.match(r"^([46]?)(.+)$", arg)
            if not m:
                raise Refused("Missing set name")
            return self.set_prefixes(m[2].upper(), [int(m[1])] if m[1] else [4, 6])
        if command == "m":
            kind, _, key = arg.partition(",")
            return self.object(kind.lower(), key)
        if command == "r":
            prefix, _, option = arg.partition(",")
            return self.search(prefix, option)
        if command in "eJo" and command:
            raise Refused("Command not supported")
        raise Refused("Unrecognized command")

    def select(self, arg: str) -> str:
        if arg == "-lc":
            return ",".join(self.sources)
        wanted = [s.strip().upper() for s in arg.split(",") if s.strip()]
        if not wanted or any(s not in self.tables.serials for s in wanted):
            raise Refused("One or more selected sources are unavailable.")
        self.sources = wanted
        return ""

    def own(self, df: DataFrame) -> DataFrame:
        return df.where(F.col("source").isin(self.sources))

    def asn(self, text: str) -> int:
        m = re.match(r"^AS(\d+)$", text.strip(), re.I)
        if not m or int(m[1]) >= 2**32:
            raise Refused("Malformed AS number")
        return int(m[1])

    def originated(self, text: str, family: int) -> str:
        found = self.listed(self.routes(family).where(F.col("origin") == self.asn(text)))
        if not found:
            raise NotThere
        return " ".join(found)

    def routes(self, family: int) -> DataFrame:
        """(prefix, plen, key, origin, source) of the routes of a family in the selected registries."""
        held = self.own(self.tables.routes)
        if "af" in held.columns:
            return held.where(F.col("af") == family).select("prefix", "plen", "key", "origin", "source")
        return held.where(F.lit(family == 4)).select(prefix_text(F.col("addr"), F.col("plen")).alias("prefix"), "plen", "key", "origin", "source")

    def listed(self, routes: DataFrame) -> list[str]:
        """Distinct prefixes by address, then length."""
        return [r["prefix"] for r in routes.select("prefix", "plen", "key").distinct().orderBy(F.rpad("key", 128, "0"), "plen").collect()]

    def closure(self, name: str) -> tuple[DataFrame, DataFrame]:
        sets, members = self.own(self.tables.sets), self.own(self.tables.members)
        if sets.where(F.col("set_name") == name).isEmpty():
            raise NotThere
        tops = sets.sparkSession.createDataFrame([(name,)], "top string")
        return expand.expand_sets(tops, sets, members, tuple(self.sources)), expand.chosen_members(sets, members, tuple(self.sources))

    def members(self, name: str, recursive: bool) -> str:
        if recursive:
            nodes, own = self.closure(name)
            found = expand.expand_as(nodes, own).select(F.concat(F.lit("AS"), F.col("asn").cast("string")).alias("m"), F.col("asn").alias("n"))
        else:
            sets, members = self.own(self.tables.sets), self.own(self.tables.members)
            own = expand.chosen_members(sets.where(F.col("set_name") == name), members, tuple(self.sources))
            if sets.where(F.col("set_name") == name).isEmpty():
                raise NotThere
            found = own.select(F.coalesce(F.concat(F.lit("AS"), F.col("asn").cast("string")), "child").alias("m"), F.col("asn").alias("n"))
        return " ".join(r["m"] for r in found.distinct().orderBy(F.col("n").asc_nulls_last(), "m").collect())

    def set_prefixes(self, name: str, families: list[int]) -> str:
        nodes, own = self.closure(name)
        asns = expand.expand_as(nodes, own).select(F.col("asn").alias("origin"))
        return " ".join(p for family in families for p in self.listed(self.routes(family).join(asns, "origin", "left_semi")))

    def object(self, kind: str, key: str) -> str:
        found = self.own(self.tables.objects).where((F.col("class") == kind) & (F.upper("pk") == key.strip().upper()))
        best = expand.winners(found.select("class", "pk", "source", "text"), ["class", "pk"], tuple(self.sources)).limit(1).collect()
        if not best:
            raise NotThere
        return best[0]["text"].rstrip("\n")

    def search(self, prefix: str, option: str) -> str:
        try:
            net = ipaddress.ip_network(prefix.strip(), strict=False)
        except ValueError as e:
            raise Refused("Malformed prefix") from e
        key = f"{int(net.network_address):0{net.max_prefixlen}b}"[: net.prefixlen]
        routes = self.routes(net.version)
        asked = routes.sparkSession.createDataFrame([(key, net.prefixlen)], "key string, plen int")
        if option in ("", "o"):
            found = routes.where(F.col("key") == key)
        elif option in ("l", "L"):
            less = routes.where((F.col("plen") <= net.prefixlen) & F.lit(key).startswith(F.col("key")) if option == "L" else (F.col("plen") < net.prefixlen) & F.lit(key).startswith(F.col("key")))
            longest = less.agg(F.max("plen")).first()[0] if option == "l" else None
            found = less.where(F.col("plen") == longest) if option == "l" else less
        elif option == "M":
            found = cover.more_specific(routes, asked)
        else:
            raise Refused("Unknown option")
        rows = found.select("prefix", "plen", "key", "origin", "source").distinct().orderBy("plen", "key", "origin", "source").collect()
        if not rows:
            raise NotThere
        if option == "o":
            return " ".join(f"AS{n}" for n in sorted({r["origin"] for r in rows}))
        name = "route" if net.version == 4 else "route6"
        return "\n\n".join(f"{name}: {r['prefix']}\norigin: AS{r['origin']}\nsource: {r['source']}" for r in rows)

    def ripe(self, line: str) -> str:
        """Text look-ups with flags: -i (inverse), -T (class), -s (sources), -K (keys only), -k, -r and -V (accepted); others are refused."""
        words, flags = line.split(), {}
        while words and words[0].startswith("-"):
            flag = words.pop(0)
            if flag in ("-k", "-r", "-K"):
                flags[flag] = ""
            elif flag in ("-i", "-T", "-s", "-V") and words:
                flags[flag] = words.pop(0)
            else:
                return "%% unsupported flag\n\n"
        key = " ".join(words)
        sources = [s.upper() for s in flags.get("-s", ",".join(self.sources)).split(",")]
        objects = self.tables.objects.where(F.col("source").isin(sources))
        if "-T" in flags:
            objects = objects.where(F.col("class").isin([c.strip().lower() for c in flags["-T"].split(",")]))
        if "-i" in flags:
            names = [n.strip().lower() for n in flags["-i"].split(",")]
            if any(n not in INVERSE for n in names):
                return "%% no inverse index\n\n"
            hits = self.tables.attributes.where(F.col("name").isin(names)).select("class", "pk", "source", F.explode(F.split("value", "[,\n]")).alias("v")).where(F.upper(F.trim("v")) == key.upper()).select("class", "pk", "source").distinct()
            found = objects.join(hits, ["class", "pk", "source"], "left_semi")
        else:
            found = objects.where(F.upper("pk") == key.upper())
        rows = found.orderBy("class", "pk", "source").select("text").collect()
        if not rows:
            return "% No entries found\n\n"
        texts = [r["text"].rstrip("\n") for r in rows]
        return "\n\n".join(t.split("\n")[0] if "-K" in flags else t for t in texts) + "\n\n"
