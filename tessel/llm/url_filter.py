"""Rules for URLs, looked up in a Bloom filter cascade by DataFrame functions alone.

A rule is a host and the beginning of a path. Its key is the two joined; the keys that could match a URL are each suffix
of its host at a dot with each beginning of its path of a length that some rule has. The cascade holds the rules' keys
exactly over the complete universe of keys that the table can ask for: level 1 encodes the rules' keys, level 2 the keys
of the universe that pass level 1 without being a rule's, level 3 the rules' keys that pass level 2, and so on until a
level passes none wrongly. A key is a rule's if the first level that it fails is an even one.

Level 1 is sized so that about as many keys pass wrongly as there are rules, so the bits of all levels depend on the
number of rules times log2(universe / rules) and hardly on the corpus. They become literals in the plan. Rules are taken
`chunk` at a time, with a cascade for each chunk, so a literal has a bound; a key is listed if a chunk lists it.

Defined cases: a null url or one without :// has an empty host and path, which no rule fits; of rules that repeat, one
counts, and if one key is both allowed and blocked, block counts; equal rows give equal rows; columns beyond those
named are kept, but host, path, rule and verdict are replaced; an empty table gives no rows; without rules every verdict is the default.
"""

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import cut

MAX_LEVELS = 64
UPPER_CASE, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER = str.maketrans(UPPER_CASE, LOWER_CASE)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, UPPER_CASE, LOWER_CASE)
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys that rules for this URL would have, the longest host first, then the longest path."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    begins = F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(lengths, reverse=True)))
    begins = F.filter(begins, lambda p: p.isNotNull())
    return F.when(F.length(host) > 0, F.flatten(F.transform(suffixes, lambda h: F.transform(begins, lambda p: F.concat(h, p))))).otherwise(F.array().cast("array<string>"))


def positions(key: Column, level: int, n_bits: int, n_hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level * 64 + k), key), F.lit(n_bits)) for k in range(n_hashes)]


def bits(keys: DataFrame, level: int, n_bits: int, n_hashes: int) -> list[int]:
    """A Bloom filter of a column `key` as 64-bit words; the words, not the keys, come to the driver."""
    at = keys.select(F.explode(F.array(*positions(F.col("key"), level, n_bits, n_hashes))).alias("at"))
    words = at.groupBy(F.floor(F.col("at") / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(at, 64) as int)))").alias("w"))
    out = [0] * -(-n_bits // 64)
    for r in words.collect():
        out[r.word] = r.w
    return out


def passes(key: Column, level: int, words: list[int], n_bits: int, n_hashes: int) -> Column:
    array = F.array(*(F.lit(w).cast("long") for w in words)) if len(words) <= 64 else F.from_json(F.lit(str(words)), "array<long>")
    ok = F.lit(True)
    for at in positions(key, level, n_bits, n_hashes):
        word = F.get(array, F.floor(at / 64).cast("int"))
        ok = ok & (F.expr("1L") == F.call_function("shiftrightunsigned", word, F.pmod(at, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")))
    return ok


class Cascade:
    """Exact membership of listed keys within a universe: levels of (words, bits, hashes)."""

    def __init__(self, listed: DataFrame, universe: DataFrame, n_listed: int, n_universe: int):
        """listed, universe: distinct values in a column key; the universe needn't hold the listed keys."""
        self.levels: list[tuple[list[int], int, int]] = []
        inside, outside, n_inside = listed, universe.join(F.broadcast(listed), "key", "left_anti"), n_listed
        rate = min(0.5, max(1e-9, n_listed * math.sqrt(0.5) / max(1, n_universe)))
        while n_inside:
            if len(self.levels) == MAX_LEVELS:
                raise RuntimeError("two keys have the same hashes at all levels")
            n_hashes = max(1, round(math.log2(1 / rate)))
            n_bits = max(64, math.ceil(n_inside * math.log2(1 / rate) / math.log(2)))
            level = len(self.levels)
            words = bits(inside, level, n_bits, n_hashes)
            self.levels.append((words, n_bits, n_hashes))
            # What passes wrongly is the next level's to encode; what it is held against is what this level encoded.
            wrong = outside.where(passes(F.col("key"), level, words, n_bits, n_hashes))
            n_wrong = wrong.count()
            inside, outside, n_inside, rate = wrong, inside, n_wrong, 0.5

    def lists(self, key: Column) -> Column:
        answer = F.lit(len(self.levels) % 2 == 1)  # a key that passes all levels is of the kind that the last one encodes
        for level in range(len(self.levels) - 1, -1, -1):
            words, n_bits, n_hashes = self.levels[level]
            answer = F.when(passes(key, level, words, n_bits, n_hashes), answer).otherwise(F.lit(level % 2 == 1))
        return answer


def listed(spark: SparkSession, keys: list[str]) -> DataFrame:
    """Keys as rows of a column key, without a Python worker."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(keys)), "array<string>")).alias("key"))


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = "allow", chunk: int = 50_000) -> DataFrame:
    """pages with host, path, rule (the longest that fits, or null) and verdict. rules: (allow or block, host, beginning of path)."""
    kinds: dict[str, str] = {}
    for verdict, host, path in rules:
        key = host.translate(LOWER) + path
        kinds[key] = "block" if "block" in (verdict, kinds.get(key)) else verdict
    lengths = sorted({len(path) for _, _, path in rules})
    host, path = split_url(F.col(url))
    pages = pages.drop("host", "path", "rule", "verdict").withColumn("host", host).withColumn("path", path)
    if not kinds:
        return pages.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    spark = pages.sparkSession
    asked = pages.select("host", "path").distinct().select(F.explode(keys_of(F.col("host"), F.col("path"), lengths)).alias("key")).distinct()
    asked = cut(asked)
    n_universe = asked.count()
    names = {"block": sorted(k for k, v in kinds.items() if v == "block"), "allow": sorted(k for k, v in kinds.items() if v == "allow")}
    cascades = []
    for verdict, keys in names.items():
        for i in range(0, len(keys), chunk):
            part = keys[i : i + chunk]
            cascades.append((verdict, Cascade(listed(spark, part), asked, len(part), n_universe)))

    def kind(key: Column) -> Column:
        out = F.lit(None).cast("string")
        for verdict, cascade in cascades:
            out = F.when(cascade.lists(key), F.lit(verdict)).otherwise(out)
        return out

    fits = F.filter(F.transform(keys_of(F.col("host"), F.col("path"), lengths), lambda k: F.struct(k.alias("key"), kind(k).alias("kind"))), lambda s: s["kind"].isNotNull())
    best = F.array_sort(F.transform(fits, lambda s: F.struct((-F.length(s["key"])).alias("size"), s["key"].alias("key"), s["kind"].alias("kind"))))
    name = "best" + "_" * max(map(len, pages.columns))  # no column of the caller's
    return pages.withColumn(name, F.try_element_at(best, F.lit(1))).withColumn("rule", F.col(f"{name}.key")).withColumn("verdict", F.coalesce(f"{name}.kind", F.lit(default))).drop(name)
