"""URL filtering by longest-match rules and host lists, through exact Bloom filter cascades."""

from __future__ import annotations

import math
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import LOWER, UPPER, durable

#: A level's bit array is embedded in the plan as one value; lists that need more are split by hash into several cascades.
MAX_LEVEL_BITS = 1 << 24
MAX_LEVELS = 64


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and for strings without ``://``."""
    pattern = "://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def _position(key: Column, salt: Column, i: Column, bits: Column) -> Column:
    return F.pmod(F.xxhash64(key, salt, i), bits)


def byte_at(packed: Column, i: Column) -> Column:
    """Byte ``i`` (0 to 127) of a binary constant: read in place, while a large array constant slows down planning."""
    return F.ascii(F.substring(packed, i.cast("int") + 1, 1).cast("string"))


class Level(NamedTuple):
    salt: int
    hashes: int
    bits: int
    packed: bytes  # seven bits in each byte, so that a byte is one ASCII character

    def passes(self, key: Column) -> Column:
        """Whether every bit of ``key`` is set."""
        packed = F.lit(self.packed)

        def is_set(i: Column) -> Column:
            pos = _position(key, F.lit(self.salt), i, F.lit(self.bits).cast("bigint"))
            return F.call_function("shiftright", byte_at(packed, F.floor(pos / 7)), (pos % 7).cast("int")).bitwiseAND(F.lit(1)) == 1

        return F.forall(F.sequence(F.lit(0), F.lit(self.hashes - 1)), is_set)


def level_bits(count: int, rate: float) -> int:
    """Size of a Bloom filter of ``count`` keys."""
    return max(64, -(-math.ceil(count * 1.4427 * math.log2(1 / rate)) // 64) * 64)


def build_level(keys: DataFrame, count: int, rate: float, salt: int) -> Level:
    """A Bloom filter of the column ``key``; bits are or-ed in partial aggregates, and the bytes, at most
    ``MAX_LEVEL_BITS / 7``, become a constant of the plan."""
    bits = level_bits(count, rate)
    if bits > MAX_LEVEL_BITS:
        raise ValueError(f"a level of {bits} bits exceeds {MAX_LEVEL_BITS}: build_cascade splits such lists")
    hashes = max(1, round(bits / max(1, count) * 0.6931)) if count > 8 else max(1, round(math.log2(1 / rate)))
    pos = F.explode(F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: _position(F.col("key"), F.lit(salt), i, F.lit(bits).cast("bigint"))))
    # 63 bits to a row, then seven to a byte
    set_bits = keys.select(pos.alias("pos")).groupBy(F.floor(F.col("pos") / 63).alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("pos") % 63).cast("int"))).alias("word")
    )
    packed = bytearray(9 * (bits // 63 + 1))
    for at, word in set_bits.collect():
        packed[9 * at : 9 * at + 9] = bytes(word >> 7 * k & 127 for k in range(9))
    return Level(salt, hashes, bits, bytes(packed))


class Cascade:
    """Exact membership for every key of the universe it was built over.

    Level 0 encodes the listed keys, level 1 the other keys of the universe that pass level 0, level 2 the listed
    keys that pass level 1, and so on until no wrong key is left. A key's status is the parity of the first level
    that rejects it: no join, no lookup table.
    """

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def contains(self, key: Column) -> Column:
        status = F.lit(len(self.levels) % 2 == 1)
        for depth in reversed(range(len(self.levels))):
            status = F.when(~self.levels[depth].passes(key), F.lit(depth % 2 == 1)).otherwise(status)
        return F.coalesce(status, F.lit(False))


class SplitCascade:
    """Cascades over the parts of a universe that a hash deals out; as exact as each of them."""

    def __init__(self, parts: list[Cascade | SplitCascade], salt: int):
        self.parts, self.salt = parts, salt

    @property
    def levels(self) -> list[Level]:
        return [level for part in self.parts for level in part.levels]

    def contains(self, key: Column) -> Column:
        of, found = _part(key, self.salt, len(self.parts)), F.lit(False)
        for i, part in enumerate(self.parts):
            found = F.when(of == i, part.contains(key)).otherwise(found)
        return found


def _part(key: Column, salt: int, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(f"part {salt}")), F.lit(parts))


def build_cascade(listed: DataFrame, universe: DataFrame, seed: int = 17) -> Cascade | SplitCascade:
    """Cascade of ``listed.key`` over ``universe.key`` (both distinct, no nulls). An empty list needs no level.

    The first level's false-positive rate is chosen so that its false positives are about as many as the listed
    keys, which keeps all levels together within a small multiple of the list; the others use one half. Where a level would
    exceed ``MAX_LEVEL_BITS``, the keys are split by hash into parts that each have a cascade.
    """
    inside = durable(listed.select("key"), "listed")
    outside = durable(universe.select("key").join(inside, "key", "left_anti"), "unlisted")
    n_in, n_out = inside.count(), outside.count()
    levels: list[Level] = []
    sides, counts = [inside, outside], [n_in, n_out]
    rate = min(0.5, max(1e-4, n_in / max(1, n_out)))
    while counts[0]:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("cascade did not end")
        if (bits := level_bits(counts[0], rate)) > MAX_LEVEL_BITS:
            n = max(2, math.ceil(1.1 * bits / MAX_LEVEL_BITS))
            of = _part(F.col("key"), seed, n)
            whole = inside.unionByName(outside)
            return SplitCascade([build_cascade(inside.where(of == i), whole.where(of == i), seed + 1) for i in range(n)], seed)
        levels.append(build_level(sides[0], counts[0], rate, seed + 1000 * len(levels)))
        passed, left = sides[1], 0
        if counts[1]:
            passed = durable(passed.where(levels[-1].passes(F.col("key"))), "passed")
            left = passed.count()
        sides, counts, rate = [passed, sides[0]], [left, counts[0]], 0.5
    return Cascade(levels)


def _candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> list[Column]:
    """The url's own keys of each shape (labels of the host's end, characters of the path's start)."""
    made = []
    for labels, chars in shapes:
        start = F.when(F.length(path) >= chars, F.substring(path, 1, chars) if chars else F.lit(""))
        made.append(F.concat(F.substring_index(host, ".", -labels), start))
    return made


def filter_urls(
    pages: DataFrame,
    rules: Iterable[tuple[str, str, str]],
    blocked_sites: Iterable[str] = (),
    url_col: str = "url",
) -> DataFrame:
    """Judge every url: adds ``host``, ``path``, ``rule`` and ``verdict`` to the rows of ``pages``.

    ``rules``: ``(verdict, host, path)`` with verdict ``block`` or ``allow``; a rule fits its host and all of its
    subdomains when the url's path starts with the rule's path, and the longest fitting rule wins. Where none fits,
    a host is blocked if one of its labels is in ``blocked_sites`` and allowed otherwise.

    Membership is decided by three cascades (blocked rules, allowed rules, blocked hosts) over all distinct keys that
    the urls of the table can ask for, so the wide rows are never shuffled or joined. A null url and one
    without ``://`` have empty host and path, no rule, and are allowed. Columns of ``pages`` that are named like a
    result are replaced. Repeated rows stay; an empty table gives no rows.
    """
    rules = [tuple(r) for r in rules]
    if bad := [r for r in rules if r[0] not in ("block", "allow")]:
        raise ValueError(f"unknown verdicts: {bad}")
    keys = [h + p for _, h, p in rules]
    if len(set(keys)) < len(keys):
        raise ValueError("a rule is listed twice")
    spark = pages.sparkSession
    host, path = host_path(F.col(url_col))
    shapes = sorted({(h.count(".") + 1, len(p)) for _, h, p in rules})
    cascades = {}
    if rules:
        own = F.explode(F.array_compact(F.array(*_candidates(host, path, shapes))))
        universe = durable(pages.select(own.alias("key")).distinct(), "rule-universe")
        for verdict in ("block", "allow"):
            of = [(h + p,) for v, h, p in rules if v == verdict]
            cascades[verdict] = build_cascade(spark.createDataFrame(of, "key string"), universe) if of else Cascade([])
    hosts = pages.select(host.alias("key")).distinct()
    sites = list(blocked_sites)
    overlap = F.arrays_overlap(F.split("key", r"\."), F.array(*map(F.lit, sites))) if sites else F.lit(False)
    hosts = durable(hosts.select("key", overlap.alias("_bad")), "hosts")
    blocked = build_cascade(hosts.where("_bad"), hosts)

    out = pages.drop("host", "path", "rule", "verdict").withColumn("host", host).withColumn("path", path)
    fits = []
    for key in _candidates(F.col("host"), F.col("path"), shapes):
        for verdict, cascade in cascades.items():
            if cascade.levels:
                fits.append(F.when(cascade.contains(key), F.struct(F.length(key).alias("n"), key.alias("key"), F.lit(verdict).alias("verdict"))))
    best = F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<n:int,key:string,verdict:string>")
    default = F.when(blocked.contains(F.col("host")), F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumn("_best", best).withColumns({"rule": F.col("_best.key"), "verdict": F.coalesce(F.col("_best.verdict"), default)}).drop("_best")
