"""URL filters: an exact block list as a cascade of Bloom filters.

Level 0 encodes the listed keys. The keys of the corpus that pass it by mistake are encoded in
level 1, the listed keys that pass level 1 in level 2, and so on until no key is wrong. As all
keys of the corpus take part, membership of every one of them is exact, and testing rows needs
the filters only: no join and no list.

Sizes: the filters of one group of keys are broadcast. A group is a hash class of keys, and there
are as many groups as keep each group's filters below ``limit`` bytes, whatever the number of keys;
every group is tested in a pass of its own over its rows.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule
and is not listed. An empty table gives an empty result. Repeated rows are judged alike.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerframe.session import materialize

BITS_PER_KEY = 12
HASHES = 6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def parse_rules(lines: list[str]) -> list[Rule]:
    """Rules such as ``block example.org/es/``; the longest, then the longest host, comes first."""
    rules = []
    for line in lines:
        verdict, place = line.split()
        host, _, path = place.partition("/")
        rules.append(Rule(verdict, host.translate(str.maketrans(UPPER, LOWER)), "/" + path))
    return sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text))


def suffixes(host: Column) -> Column:
    """The host and its parent domains."""
    labels = F.split(host, r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(tails)


#: Share of strangers that pass a level, about.
FALSE_SHARE = 0.005


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``words`` holds its bits."""

    number: int
    words: np.ndarray

    def places(self, first: np.ndarray, second: np.ndarray) -> list[np.ndarray]:
        return _places(first, second, self.number, len(self.words) * 64)

    def has(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        found = np.ones(len(first), bool)
        for at in self.places(first, second):
            found &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _places(first: np.ndarray, second: np.ndarray, number: int, bits: int) -> list[np.ndarray]:
    start = _mix(first + np.uint64(2 * number + 1))
    step = _mix(second + np.uint64(2 * number + 1)) | np.uint64(1)
    return [_mix(start + np.uint64(j) * step) % np.uint64(bits) for j in range(HASHES)]


def _hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("first", "second"))


def passes(levels: list[Level], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Membership of keys of the corpus: the first level that lacks a key decides by its parity."""
    listed = np.zeros(len(first), bool)
    open_ = np.ones(len(first), bool)
    for level in levels:
        open_ &= level.has(first, second)
        # a key that leaves at level i is listed for odd i; one that stays to the end is decided by the last
        listed[open_] = level.number % 2 == 0
    return listed


def _fill(keys: DataFrame, number: int, count: int) -> Level:
    """The Bloom filter of the keys; only its words, bounded by ``count``, come to the driver."""
    words = max(1, -(-count * BITS_PER_KEY // 64))

    def bits(batches):
        for batch in batches:
            at = np.concatenate(_places(*_hashes(batch), number, words * 64))
            word, mask = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
            order = np.argsort(word, kind="stable")
            starts = np.flatnonzero(np.diff(word[order], prepend=-1))
            if len(order):
                joined = np.bitwise_or.reduceat(mask[order], starts).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(word[order][starts]), pa.array(joined)], names=["word", "mask"])

    rows = keys.select("first", "second").mapInArrow(bits, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    filled = np.zeros(words, np.uint64)
    filled[rows["word"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
    return Level(number, filled)


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.has(*_hashes(batch))))

    return keys.mapInArrow(keep, keys.schema)


def build(keys: DataFrame, count: int) -> list[Level]:
    """The cascade over keys (first, second, listed); ``count`` listed ones."""
    levels: list[Level] = []
    inside, outside = keys.filter("listed"), keys.filter("not listed")
    while count:
        level = _fill(inside, len(levels), count)
        levels.append(level)
        wrong = materialize(_passing(outside, level), "cascade")
        inside, outside = wrong, inside
        count = wrong.count()
    return levels


def grouped_cascades(keys: DataFrame, listed: int, unlisted: int, limit: int) -> list[list[Level]]:
    """A cascade for each of as many groups of keys as keep every one below ``limit`` bytes.

    The first level holds the listed keys, the second the unlisted ones that pass it, which may be
    more where few keys are listed. If a group comes out too large all the same, twice as many
    groups are made, until groups are as small as single keys.
    """
    expected = (listed + unlisted * FALSE_SHARE) * BITS_PER_KEY // 8 * 2
    groups = max(1, int(-(-expected // limit)))
    while True:
        made = []
        for number in range(groups):
            own = keys.filter(F.pmod("first", F.lit(groups)) == number)
            made.append(build(own, own.filter("listed").count()))
            if groups < listed + unlisted and sum(level.words.nbytes for level in made[-1]) > limit:
                break
        else:
            return made
        groups *= 2


def listed_hosts(hosts: DataFrame, blocked: DataFrame) -> DataFrame:
    """host, listed: whether the block list (column ``domain``) has the host or a parent domain."""
    domains = blocked.select(F.translate("domain", UPPER, LOWER).alias("domain")).distinct()
    hit = hosts.withColumn("domain", F.explode(suffixes(F.col("host")))).join(domains, "domain", "left_semi")
    hit = hit.select("host").distinct().withColumn("listed", F.lit(True))
    return hosts.join(hit, "host", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


def url_filter(pages: DataFrame, rules: list[str], blocked: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """Judge every url: page_id, host, path, rule, verdict, listed.

    A url is listed if ``blocked`` (column ``domain``) has its host or a parent domain; listed
    urls are blocked and others allowed where no rule fits. The keys of the cascade are the
    distinct hosts of all pages.
    """
    spark = pages.sparkSession
    known = parse_rules(rules)
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hashes = {"first": F.xxhash64("host"), "second": F.xxhash64("host", F.lit(1))}
    keys = listed_hosts(judged.select("host").distinct(), blocked).withColumns(hashes)
    keys = materialize(keys.select("first", "second", "listed"), "url-keys")
    listed = keys.filter("listed").count()
    cascades = grouped_cascades(keys, listed, keys.count() - listed, limit)
    group = F.pmod("first", F.lit(len(cascades)))
    tested = []
    for number, levels in enumerate(cascades):
        shared = spark.sparkContext.broadcast(levels)
        tested.append(_tested(judged.withColumns(hashes).filter(group == number), shared))
    rows = reduce(DataFrame.unionByName, tested)
    host, path = F.col("host"), F.col("path")
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("listed"), "block").otherwise("allow")
    for known_rule in reversed(known):
        fits = known_rule.fits(host, path)
        rule = F.when(fits, F.lit(known_rule.text)).otherwise(rule)
        verdict = F.when(fits, F.lit(known_rule.verdict)).otherwise(verdict)
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "listed")


def _tested(rows: DataFrame, shared) -> DataFrame:
    """The rows with ``listed``, by the filters of their group."""

    @F.pandas_udf("boolean")
    def member(first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series(passes(shared.value, first.to_numpy().view(np.uint64), second.to_numpy().view(np.uint64)))

    return rows.withColumn("listed", member("first", "second"))
