"""Prefixes and prefix ranges as columns: IPv4 addresses as numbers, any prefix as a string of bits.

A range is a base prefix with a window [lo, hi] of lengths. An operator stack of one family is four numbers (a, c, k, h): a range whose
lower bound is x becomes one with the lower bound max(a, x + c) and the upper bound h, and is deleted if x > k or the window is empty.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

V4_BITS = 32


def bits(addr: Column, plen: Column, width: int = V4_BITS) -> Column:
    """The first plen bits of a numeric address, as text."""
    return F.substring(F.lpad(F.conv(addr.cast("string"), 10, 2), width, "0"), F.lit(1), plen.cast("int"))


def dotted(addr: Column) -> Column:
    octet = lambda k: F.shiftright(addr.cast("long"), k).bitwiseAND(F.lit(255)).cast("string")
    return F.concat_ws(".", octet(24), octet(16), octet(8), octet(0))


def prefix_text(addr: Column, plen: Column) -> Column:
    return F.concat(dotted(addr), F.lit("/"), plen.cast("string"))


def address(text: Column) -> Column:
    """The number of a dotted IPv4 address, zero-padded octets read as decimal; null if it isn't one."""
    octets = F.split(text, r"\.")
    value = F.aggregate(octets, F.lit(0).cast("long"), lambda s, x: s * 256 + x.cast("long"))
    return F.when(text.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(octets, lambda x: F.try_to_number(F.lpad(x, 3, "0"), F.lit("999")) <= 255), value)


PARSED = T.StructType([T.StructField("af", T.IntegerType()), T.StructField("plen", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("text", T.StringType())])


@F.udf(PARSED, useArrow=True)
def parsed(text):
    """Family, length, bits and canonical text of a prefix or address of either family, host bits cleared; null if it is neither."""
    try:
        net = ipaddress.ip_network((text or "").strip(), strict=False)
    except ValueError:
        return None
    return {"af": net.version, "plen": net.prefixlen, "key": f"{int(net.network_address):0{net.max_prefixlen}b}"[: net.prefixlen], "text": str(net)}


def masked(addr: Column, plen: Column, width: int = V4_BITS) -> Column:
    size = F.pow(F.lit(2.0), F.lit(width) - plen).cast("long")
    return addr - F.pmod(addr, size)


def operator_window(op: Column, width: int = V4_BITS) -> tuple[Column, Column, Column]:
    """(n, m, d) of an operator: the window it asks for and what ^- adds to a lower bound; nulls for no operator."""
    n = F.regexp_extract(op, r"^\^(\d+)", 1).try_cast("int")
    m = F.coalesce(F.regexp_extract(op, r"^\^\d+-(\d+)$", 1).try_cast("int"), n)
    whole = op.isin("^+", "^-")
    return F.when(whole, 0).otherwise(n), F.when(whole, width).otherwise(F.least(m, F.lit(width))), F.when(op == "^-", 1).otherwise(0)


def apply_operator(lo: Column, hi: Column, op: Column, width: int = V4_BITS) -> tuple[Column, Column]:
    """The window of a range under an operator, null where it is deleted.

    ^n-m over [k, l] is [max(n, k), m]; ^+ is [k, max] and ^- is [k + 1, max].
    """
    n, m, d = operator_window(op, width)
    low, high = F.greatest(n, lo + d), m
    kept = low <= high
    none = F.coalesce(op, F.lit("")) == ""
    return F.when(none, lo).when(kept, low), F.when(none, hi).when(kept, high)


def push_operator(stack: dict[str, Column], op: Column, width: int = V4_BITS) -> dict[str, Column]:
    """The stack with one more operator innermost. Stacks that delete everything are one value, and c is 0 where a decides alone, so that equal stacks mostly look equal and a closure over them ends."""
    n, m, d = operator_window(op, width)
    a, c, k, h = (stack[x] for x in "ackh")
    empty = h.isNull()
    last = F.when(empty, m).otherwise(F.least(m, k))
    new_a = F.when(empty, n).otherwise(F.greatest(a, n + c))
    new_c = F.least(F.when(empty, d).otherwise(c + d), F.lit(width + 1))
    new_k = F.when(n > last, -1).otherwise(last - d)
    new_h = F.when(empty, m).otherwise(h)
    dead = new_k < 0
    alone = new_a >= new_k + new_c
    none = F.coalesce(op, F.lit("")) == ""
    out = {"a": F.when(dead, 0).otherwise(new_a), "c": F.when(dead | alone, 0).otherwise(new_c), "k": F.when(dead, -1).otherwise(new_k), "h": F.when(dead, 0).otherwise(new_h)}
    return {x: F.when(none, stack[x]).otherwise(v).cast("int") for x, v in out.items()}


def apply_stack(lo: Column, hi: Column, stack: dict[str, Column]) -> tuple[Column, Column]:
    """The window of a range under a stack, null where it is deleted; h is null for an empty stack."""
    a, c, k, h = (stack[x] for x in "ackh")
    low = F.greatest(a, lo + c)
    kept = (lo <= k) & (low <= h)
    return F.when(h.isNull(), lo).when(kept, low), F.when(h.isNull(), hi).when(kept, h)


def intersect(key: Column, lo: Column, hi: Column, key2: Column, lo2: Column, hi2: Column) -> dict[str, Column]:
    """Base and window of what two ranges share, null where nothing is."""
    longer = F.when(F.length(key) >= F.length(key2), key).otherwise(key2)
    low, high = F.greatest(lo, lo2, F.length(longer)), F.least(hi, hi2)
    some = (F.startswith(key, key2) | F.startswith(key2, key)) & (low <= high)
    return {"key": F.when(some, longer), "lo": F.when(some, low), "hi": F.when(some, high)}


def contains(key: Column, lo: Column, hi: Column, prefix: Column) -> Column:
    return F.startswith(prefix, key) & F.length(prefix).between(lo, hi)


def materialized(addr: Column, plen: Column, lo: Column, hi: Column, width: int = V4_BITS) -> Column:
    """The prefixes of a range as an array of (addr, plen), shortest first, then by address."""

    def of_length(n: Column) -> Column:
        step = F.pow(F.lit(2.0), F.lit(width) - n).cast("long")
        count = F.pow(F.lit(2.0), n - plen).cast("long")
        return F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: F.struct((addr + i * step).alias("addr"), n.alias("plen")))

    return F.flatten(F.transform(F.sequence(lo, hi), of_length))


def range_size(plen: Column, lo: Column, hi: Column) -> Column:
    """How many prefixes a range has, to guard `materialized`."""
    return (F.pow(F.lit(2.0), hi - plen + 1) - F.pow(F.lit(2.0), lo - plen)).cast("long")
