"""URL rules and host lists answered by a Bloom filter cascade.

The keys of a URL are its host and parent domains, alone and joined with those prefixes of its path that have the length
of some rule's path. A cascade encodes the listed keys in a first Bloom filter, those keys of the whole corpus that this
filter wrongly admits in a second one, the listed keys that the second wrongly admits in a third, and so on until no
error is left. Over the keys of the corpus membership is then exact, and asking needs no join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from nearby_engine.functions.text import let

#: Most bits of one level; the words of a level are a literal of the plan. Larger lists are cut into several cascades.
MOST_BITS = 1 << 23
MOST_LEVELS = 40


@dataclass(frozen=True)
class Level:
    words: tuple[int, ...]
    bits: int
    seeds: tuple[int, ...]

    def admits(self, key: Column) -> Column:
        """Whether all bits of a key are set."""
        stored = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        at = lambda seed: F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(self.bits).cast("long"))
        found = None
        for seed in self.seeds:
            one = let(at(seed), lambda p: F.getbit(F.get(stored, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1)
            found = one if found is None else found & one
        return found


@dataclass(frozen=True)
class Cascade:
    """Levels of each part; a key belongs to one part by its hash."""

    parts: tuple[tuple[Level, ...], ...]

    def holds(self, key: Column) -> Column:
        found = None
        for i, levels in enumerate(self.parts):
            answer = F.lit(False)
            for depth in reversed(range(len(levels))):
                # Admitted by level d and not by d+1: listed if d is even. The deepest level has no errors.
                answer = levels[depth].admits(key) & (~answer if depth + 1 < len(levels) else F.lit(True))
            mine = answer if len(self.parts) == 1 else (_part(key, len(self.parts)) == i) & answer
            found = mine if found is None else found | mine
        return F.lit(False) if found is None else found


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(parts).cast("long"))


def _level(keys: DataFrame, count: int, rate: float, depth: int) -> Level:
    """A Bloom filter of distinct keys, built by OR-ing the bits of each 64-bit word."""
    bits = max(64, math.ceil(-count * math.log(rate) / math.log(2) ** 2))
    seeds = tuple(1000 * depth + j for j in range(max(1, round(bits / max(1, count) * math.log(2)))))[:24]
    places = F.array(*[F.pmod(F.xxhash64("key", F.lit(s)), F.lit(bits).cast("long")) for s in seeds])
    word, bit = F.shiftright("p", 6), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))
    rows = keys.select(F.explode(places).alias("p")).groupBy(word.alias("w")).agg(F.bit_or(bit).alias("b")).collect()
    words = [0] * (bits // 64 + 1)
    for w, b in rows:
        words[w] = b
    return Level(tuple(words), bits, seeds)


def build_cascade(listed: DataFrame, universe: DataFrame, universe_size: int) -> Cascade:
    """A cascade of the column ``key`` of ``listed``, exact on every key of ``universe``.

    The first level's error rate is sqrt(1/2) * listed / universe, the others' 1/2, which keeps the whole near the
    smallest size. The universe is read once, for the keys that the first level wrongly admits; from there on only the
    errors left are read. Each level has at most MOST_BITS bits (1 MB); a longer list is dealt into parts by hash.
    Null keys are left out; repeated keys count once.
    """
    listed = listed.where(F.col("key").isNotNull()).distinct()
    size = listed.count()
    if not size:
        return Cascade(())
    rate = min(0.5, max(1e-6, math.sqrt(0.5) * size / max(1, universe_size)))
    parts = math.ceil(-size * math.log(rate) / math.log(2) ** 2 / MOST_BITS)
    made = []
    for i in range(parts):
        here = (lambda df, i=i: df if parts == 1 else df.where(_part(F.col("key"), parts) == i))
        wanted = here(listed)
        count = wanted.count()
        if not count:
            made.append((Level((0, 0), 64, (0,)),))
            continue
        levels = [_level(wanted, count, rate, 0)]
        others = here(universe).where(levels[0].admits(F.col("key"))).distinct().join(wanted, "key", "left_anti")
        others = others.persist()
        while (errors := others.count()) > 0:
            if len(levels) == MOST_LEVELS:
                raise ValueError("the cascade does not end: two keys share all their hashes")
            levels.append(_level(others, errors, 0.5, len(levels)))
            wanted, others = others, wanted.where(levels[-1].admits(F.col("key"))).persist()
        made.append(tuple(levels))
    return Cascade(tuple(made))


# --- URLs ----------------------------------------------------------------------------------------------------------------

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_AFTER = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _AFTER, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _AFTER, 2), F.lit(""))


def keys_of(host: Column, path: Column, most_labels: int, lengths: list[int]) -> Column:
    """The host and its parents of at most ``most_labels`` labels, each joined with the prefixes of the given lengths."""
    labels = F.split(host, r"\.")
    first = F.greatest(F.lit(1), F.size(labels) - most_labels + 1)
    parents = let(labels, lambda all_: F.transform(F.sequence(first, F.size(all_)), lambda i: F.array_join(F.slice(all_, i, F.size(all_)), ".")))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    return F.flatten(F.transform(parents, lambda p: F.transform(fitting, lambda n: F.concat(p, F.substring(path, F.lit(1), n)))))


def judge(
    pages: DataFrame, allow: DataFrame, block: DataFrame, listed_hosts: DataFrame, default: str = "allow"
) -> DataFrame:
    """page_id, host, path, rule, verdict of every URL; ``allow``, ``block``: rules ``host/path``; ``listed_hosts``: hosts to block.

    A rule fits its host and all subdomains if the path starts with the rule's path (the part from its first slash on).
    The longest fitting rule wins; a rule in both lists blocks. Without a rule a listed host (or a subdomain of one) is
    blocked, anything else gets ``default``. A null URL, or one without ``://``, has empty parts and gets the default.
    Repeated pages give repeated rows; extra columns are left out; empty lists and tables are fine.
    """
    rules = block.select("key").unionByName(allow.select("key"))
    shape = rules.unionByName(listed_hosts.select("key")).where("key is not null").agg(
        F.max(F.size(F.split(F.substring_index("key", "/", 1), r"\."))), F.collect_set(F.length("key") - F.length(F.substring_index("key", "/", 1)))
    ).first()
    most_labels, lengths = shape[0] or 1, sorted({0, *shape[1]})
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keyed = parts.select("page_id", "host", "path", keys_of(F.col("host"), F.col("path"), most_labels, lengths).alias("keys"))
    universe = keyed.select(F.explode("keys").alias("key"))
    size = universe.agg(F.approx_count_distinct("key")).first()[0]
    allowed, blocked, hosts = (build_cascade(x.select("key"), universe, size) for x in (allow, block, listed_hosts))
    ruled = F.filter("keys", lambda k: k.contains("/") & (blocked.holds(k) | allowed.holds(k)))
    # Of several fitting rules, all are suffix-and-prefix parts of the same URL, so the length decides.
    longest = F.array_max(F.transform(ruled, lambda k: F.struct(F.length(k).alias("n"), k.alias("rule"))))["rule"]
    found = keyed.select("page_id", "host", "path", "keys", longest.alias("rule"))
    by_host = F.exists("keys", lambda k: ~k.contains("/") & hosts.holds(k))
    verdict = F.when(F.col("rule").isNotNull(), F.when(blocked.holds(F.col("rule")), "block").otherwise("allow"))
    return found.select("page_id", "host", "path", "rule", verdict.otherwise(F.when(by_host, "block").otherwise(default)).alias("verdict"))


def key_table(spark: SparkSession, keys: list[str]) -> DataFrame:
    """A given list as a table (column key)."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in keys]).cast("array<string>")).alias("key"))
