"""URL rules by a Bloom filter cascade; DataFrame functions only.

The key universe are the (host suffix, path prefix) pairs that the corpus's urls can be asked for: every suffix of a
host at a label, with a path prefix of each length that some rule has. Level 0 of a cascade encodes the listed keys;
level 1 the keys of the universe that level 0 takes wrongly; level 2 the listed keys that level 1 takes, and so on until
a level has nothing to encode. A key of the universe is listed exactly if the first level that rejects it has an odd
number (or, when none does, if the number of levels is odd). Level 0 is sized by log2(universe / listed) bits a key, so that what level 1 encodes
is about as many keys as are listed: all levels together are bounded by the list and the logarithm of the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.llm.common import LOWER, UPPER, durable

#: (host, path, verdict); the production list.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: Bits of a level at most (1 MB as a literal); longer lists are refused.
MAX_BITS = 1 << 23


class Level:
    """One Bloom filter: 64-bit words, and its number of probes."""

    def __init__(self, words: list[int], probes: int) -> None:
        self.words, self.probes = words, probes

    @staticmethod
    def _bit(key: Column, level: int, probe: int, bits: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(level * 64 + probe), key), F.lit(bits))

    @classmethod
    def encode(cls, keys: DataFrame, level: int, n: int, bits_per_key: float) -> Level:
        """``keys``: (key), distinct. Sums the filter's words in Spark; the words, not the keys, come to the driver."""
        words = max(1, math.ceil(n * bits_per_key / 64))
        if words * 64 > MAX_BITS:
            raise ValueError(f"a level of {words * 64} bits is above the bound of {MAX_BITS}; split the list by host")
        probes = max(1, round(bits_per_key * math.log(2)))
        at = keys.select(F.explode(F.array(*[cls._bit(F.col("key"), level, p, words * 64) for p in range(probes)])).alias("bit"))
        rows = at.groupBy(F.expr("bit div 64").cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 AS int))")).alias("v")).collect()
        full = [0] * words
        for row in rows:
            full[row.w] = row.v
        return cls(full, probes)

    def takes(self, key: Column, level: int) -> Column:
        words = F.array(*[F.lit(w).cast("long") for w in self.words]) if len(self.words) <= 16 else F.from_json(F.lit(str(self.words)), "array<bigint>")
        tests = []
        for p in range(self.probes):
            bit = self._bit(key, level, p, len(self.words) * 64)
            word = F.get(words, F.floor(bit / 64).cast("int"))
            tests.append(word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))) != 0)
        whole = tests[0]
        for t in tests[1:]:
            whole = whole & t
        return whole


class Cascade:
    """Exact membership of ``listed`` (key, distinct) within ``universe`` (key, distinct, durable)."""

    def __init__(self, listed: DataFrame, universe: DataFrame) -> None:
        self.levels: list[Level] = []
        n, total = listed.count(), max(1, universe.count())
        inside, outside = listed, universe.join(F.broadcast(listed), "key", "left_anti") if n <= 100_000 else universe.join(listed, "key", "left_anti")
        while n and len(self.levels) < 40:
            level = len(self.levels)
            per_key = 1.44 * max(1.0, math.log2(total / n)) if not level else 1.44 * 1.5
            self.levels.append(made := Level.encode(inside, level, n, per_key))
            wrong = durable(outside.where(made.takes(F.col("key"), level)), "cascade")
            inside, outside = wrong, inside
            n = wrong.count()
        if n:
            raise RuntimeError("the cascade did not end")

    def has(self, key: Column) -> Column:
        """Whether a key of the universe is listed: the parity of the first level that rejects it."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in range(len(self.levels) - 1, -1, -1):
            out = F.when(~self.levels[level].takes(key, level), F.lit(level % 2 == 1)).otherwise(out)
        return out


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for urls without ``://``."""
    rest = F.coalesce(F.regexp_extract(url.cast("string"), r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys ``host suffix + \\n + path prefix`` that a url can be listed under, longest first (then the longer host)."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lens = F.array(*[F.lit(n) for n in lengths])
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(F.filter(lens, lambda n: n <= F.char_length(path)), lambda n: F.struct(
        (-(F.char_length(s) + n)).alias("o"), (-F.char_length(s)).alias("h"), F.concat(s, F.lit("\n"), F.substring(path, F.lit(1), n)).alias("key")))))
    return F.transform(F.array_sort(pairs), lambda x: x["key"])


def judge_urls(urls: DataFrame, rules: list[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """``urls`` (url, ...) -> all its columns with ``_host``, ``_path``, ``_rule`` (null if none) and ``_verdict``.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest rule (host and path
    together, then host) wins; urls under no rule get ``default``. Null and malformed urls have empty host and path and no
    rule. Input columns with those names are replaced. Repeated rows each get their answer; other columns pass through. An empty table gives an empty result.
    """
    spark: SparkSession = urls.sparkSession
    lengths = sorted({len(p) for _, p, _ in rules})
    host, path = split_url(F.col("url"))
    out = ("_host", "_path", "_rule", "_verdict")
    parts = urls.select(F.struct(*[c for c in urls.columns if c not in out]).alias("_row"), host.alias("_host"), path.alias("_path"))
    keys = candidates(F.col("_host"), F.col("_path"), lengths) if rules else F.array().cast("array<string>")
    universe = durable(urls.select("url").distinct().withColumn("_host", host).withColumn("_path", path).select(F.explode(keys).alias("key")).distinct(), "url-keys")
    by = {}
    for verdict in ("allow", "block"):
        listed = [f"{h}\n{p}" for h, p, v in dict.fromkeys(rules) if v == verdict]
        by[verdict] = Cascade(spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in listed]).cast("array<string>")).alias("key")), universe)
    allowed, blocked = by["allow"].has, by["block"].has
    judged = parts.withColumn("_m", F.get(F.filter(F.transform(keys, lambda k: F.struct(k.alias("key"), F.when(allowed(k), "allow").when(blocked(k), "block").alias("verdict"))), lambda x: x["verdict"].isNotNull()), F.lit(0)))
    return judged.withColumn("_rule", F.replace(F.col("_m.key"), F.lit("\n"), F.lit(""))).withColumn("_verdict", F.coalesce(F.col("_m.verdict"), F.lit(default))).select("_row.*", *out)


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages).select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))


ORACLE_OP7 = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(h, q, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (SELECT page_id, host, path, h || q AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC NULLS LAST, length(h) DESC) AS n
      FROM p LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE n = 1
"""
