"""Operator 4: URL rules by a cascade of Bloom filters.

A cascade gives exact membership over a known universe of keys. Level 1 encodes the listed keys; the keys of the universe that it takes wrongly
are encoded by level 2, the listed keys that level 2 takes by level 3, and so on until a level takes nothing wrongly. A key is listed if the first level that does not
take it is an even one. Levels are arrays of 64-bit words in the expression itself. The error of level 1 is chosen so that it takes about as many wrong keys of the universe as there are listed
ones, so all levels together have bits in proportion to the list and to the logarithm of the universe's size. A list of more than KEYS keys is
dealt by a hash into groups of about so many, each with a cascade of its own, which the urls pass one after another: exact for lists of any length.

The universe is every pair of a host's suffix and a path's prefix (up to a slash) of the corpus, with no more labels and no deeper paths than the list has, so a url's rules are found by
asking the cascade for its own pairs: no join with the rules. The universe is never stored: level 1 reads it, and only what level 1 takes is kept. A rule's path must
begin and end with a slash, else ValueError.

Nulls: a null url, or one without ://, has an empty host and path and no rule; null rules are ignored. Ties between rules of one length go to the longer host. Repeated rows are judged alike. Very long
urls cost as much as their length: they have no more pairs than others. Empty tables: an empty cascade or no row. Other columns are kept, but for columns named host, path, rule or
verdict, which the results replace. A url that no rule fits is allowed: the method lists keys, and an unlisted key blocks nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import let, remove_stored, stored

#: Keys of one cascade, about: over a universe of a million times as many, level 1 then has 0.95 million bits.
KEYS = 1 << 15
#: The least error that level 1 is asked for.
LEAST_ERROR = 1e-12


@dataclass
class Level:
    words: list[int]
    probes: int

    def takes(self, key: Column, number: int) -> Column:
        bits = 64 * len(self.words)
        table = F.array(*[F.lit(w).cast("long") for w in self.words]) if len(self.words) < 64 else F.from_json(F.lit("[" + ",".join(map(str, self.words)) + "]"), "array<long>")
        holds = F.lit(True)
        for h in _places(key, number, self.probes, bits):
            holds = holds & (F.getbit(F.get(table, F.floor(h / 64).cast("int")), (h % 64).cast("int")) == 1)
        return holds


def _places(key: Column, number: int, probes: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(number), F.lit(k), key), F.lit(bits).cast("long")) for k in range(probes)]


def _level(keys: DataFrame, count: int, number: int, error: float) -> Level:
    """keys: a column key, without repeats."""
    words = max(1, math.ceil(-count * math.log(error) / math.log(2) ** 2 / 64))
    probes = min(40, max(1, round(64 * words / max(1, count) * math.log(2))))
    place = keys.select(F.explode(F.array(*_places(F.col("key"), number, probes, 64 * words))).alias("h"))
    one = F.expr("shiftleft(1L, cast(h % 64 as int))")
    held = place.groupBy(F.expr("h div 64").alias("w")).agg(F.bit_or(one).alias("bits")).collect()  # at most `words` rows
    out = [0] * words
    for r in held:
        out[r.w] = r.bits
    return Level(out, probes)


@dataclass
class Cascade:
    levels: list[Level]

    def lists(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for number in range(len(self.levels) - 1, -1, -1):
            out = F.when(~self.levels[number].takes(key, number), F.lit(number % 2 == 1)).otherwise(out)
        return out


def build(listed: DataFrame, universe: DataFrame, error: float = 0.01) -> Cascade:
    """listed, universe: a column key each, repeats allowed. Keys of the universe that are listed count as listed alone. error: that of level 1 at most."""
    own = stored(listed.where("key is not null").select("key").distinct(), "listed")
    n = own.count()
    if not n:
        return Cascade([])
    size = universe.agg(F.approx_count_distinct("key")).first()[0]  # for the size of a level alone: levels go on until nothing is wrong
    levels = [_level(own, n, 0, min(error, max(LEAST_ERROR, n / max(size, 1))))]
    # of the universe, what level 1 takes: the listed keys and the few others, told apart by counting
    taken = universe.where(levels[0].takes(F.col("key"), 0)).select("key", F.lit(0).alias("own")).unionByName(own.withColumn("own", F.lit(1)))
    inside, outside = stored(taken.groupBy("key").agg(F.max("own").alias("own")).where("own = 0").select("key"), "wrong"), own
    while n := inside.count():
        levels.append(_level(inside, n, len(levels), 0.5))
        wrong = stored(outside.where(levels[-1].takes(F.col("key"), len(levels) - 1)), "wrong")
        remove_stored(outside)
        inside, outside = wrong, inside
    remove_stored(inside, outside)
    return Cascade(levels)


def parts(url: Column) -> dict[str, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ://."""
    rest = F.when(url.contains("://"), url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return {"host": F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "path": F.coalesce(path, F.lit(""))}


def pairs(labels: int, depth: int) -> Column:
    """Of columns host and path: the suffixes of the host of at most so many labels with the prefixes of the path of at most so many steps that end in a slash, longest first."""
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -k) for k in range(1, labels + 1)]))
    steps = F.split("path", "/", depth + 2)
    prefixes = let(steps, lambda x: F.transform(F.sequence(F.lit(1), F.least(F.size(x) - 1, F.lit(depth + 1))), lambda k: F.concat(F.array_join(F.slice(x, F.lit(1), k), "/"), F.lit("/"))))
    every = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct((-F.length(s) - F.length(p)).alias("size"), (-F.length(s)).alias("host"), F.concat(s, p).alias("key")))))
    ordered = F.transform(F.array_sort(every), lambda x: x["key"])
    return F.when((F.col("host") != "") & F.col("path").startswith("/"), ordered).otherwise(F.array().cast("array<string>"))


def judge(pages: DataFrame, rules: DataFrame, error: float = 0.01) -> DataFrame:
    """pages with host, path, rule and verdict. rules: key (host and path, like example.net/en/) and verdict (allow or block)."""
    rules = rules.where("key is not null")
    host = F.substring_index("key", "/", 1)
    seen = rules.agg(F.count("*"), F.max(F.size(F.split(host, r"\."))), F.max(F.size(F.split("key", "/")) - 2), F.max(F.when(~F.col("key").rlike("^[^/]+/(.*/)?$"), F.col("key")))).first()
    n, labels, depth, wrong = seen
    if wrong is not None:
        raise ValueError(f"a rule is a host and a path that begins and ends with a slash: {wrong!r}")
    made = pages.drop("host", "path", "rule", "verdict").withColumns(parts(F.coalesce("url", F.lit(""))))
    asked = made.withColumn("_pairs", pairs(labels or 1, depth or 0))
    groups = max(1, -(-n // KEYS))
    for g in range(groups):
        found, blocking = _first_listed(asked, rules, groups, g, error)
        if groups == 1:
            asked = asked.withColumn("rule", found).withColumn("_block", F.col("rule").isNotNull() & blocking.lists(F.col("rule")))
            break
        # one group after another: the longer rule stays, with its verdict
        held = asked if g else asked.withColumns({"rule": F.lit(None).cast("string"), "_block": F.lit(False)})
        better = F.col("_new").isNotNull() & (F.col("rule").isNull() | (F.array_position("_pairs", F.col("_new")) < F.array_position("_pairs", F.col("rule"))))
        told = held.withColumn("_new", found).withColumn("_better", better)
        asked = stored(told.withColumns({"_block": F.when(F.col("_better"), blocking.lists(F.col("_new"))).otherwise(F.col("_block")), "rule": F.when(F.col("_better"), F.col("_new")).otherwise(F.col("rule"))}).drop("_new", "_better"), "judged")
        if g:
            remove_stored(held)
    return asked.withColumn("verdict", F.when(F.col("_block"), "block").otherwise("allow")).drop("_pairs", "_block")


def _first_listed(asked: DataFrame, rules: DataFrame, groups: int, g: int, error: float) -> tuple[Column, Cascade]:
    """The first pair of a url that is a listed key of group g, and the cascade of the group's keys that block (its universe is the list)."""

    def mine(key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit("group")), F.lit(groups)) == g

    own = rules.where(mine(F.col("key")))
    listed = build(own.select("key"), asked.select(F.explode("_pairs").alias("key")).where(mine(F.col("key"))), error)
    blocking = build(own.where("verdict = 'block'").select("key"), own.select("key"), error)
    return F.get(F.filter("_pairs", lambda k: mine(k) & listed.lists(k)), F.lit(0)), blocking


def listing(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """A table of key and verdict."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("verdict")) for k, v in rules])))


#: Fixed values of the query: rule and verdict.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

ORACLE = r"""
with rest as (
  select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as r from pages
), cut as (
  select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest
), rules(h, p, v) as (
  values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
)
select page_id, host, path,
  (select arg_max(h || p, length(h || p)) from rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p)) as rule,
  coalesce((select arg_max(v, length(h || p)) from rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p)), 'allow') as verdict
from cut
"""
