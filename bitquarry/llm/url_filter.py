"""URL filters by a Bloom filter cascade.

Level 1 holds the listed keys; level 2 those other keys of the universe that
level 1 takes for listed; level 3 the listed keys that level 2 takes for
others; and so on until a level takes none wrongly. Looking a key of the
universe up stops at the first level that doesn't hold it, and the level's
number says, without error, whether the key is listed. The universe is every
key of the corpus, so every row's answer is exact and needs no join.

A key is a host. Listed are the hosts of which a rule blocks some page of the
corpus, and those in ``blocked``. A url that a rule fits gets that rule's
verdict; any other is blocked if its host is listed, which the cascade says.

Keys are hashed to 64 bits. Hashes that a listed and another host share are
found when the universe is built, and their rows are answered by the host
itself.

The keys are dealt to shards by hash, so that a shard's levels stay within
``shard_keys`` keys. Filters up to ``most_bytes`` in all are broadcast; beyond
it rows are dealt to the shards, each of which reads its own levels.

Defined results: a null url, or one without ``://``, has an empty host and
path, no rule, and is allowed (the empty host is never listed); repeated rows give equal rows; an empty table
gives an empty result; other columns are kept by ``verdicts`` untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitquarry.llm._common import arrow_batches, lean, materialize, read

#: (action, host, path prefix): a rule fits its host and all subdomains
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
BITS_PER_KEY = 10.0
MOST_BYTES = 64 << 20
SHARD_KEYS = 2_000_000
_HASHES = 5
MOST_SHARED = 1_000


def host(url: Column) -> Column:
    """After the first ``://``, up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule(h: Column, p: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (host and path as one string) and its action; null without one."""
    best = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1]))
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rh, rp in reversed(best):
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        name, action = F.when(fits, F.lit(rh + rp)).otherwise(name), F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _bits(keys: np.ndarray, level: int, m: int) -> np.ndarray:
    """The places of each key in a level of m bits."""
    with np.errstate(over="ignore"):
        a = _mix(keys + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15))
        b = _mix(a) | np.uint64(1)
        return (a[:, None] + np.arange(_HASHES, dtype=np.uint64) * b[:, None]) % np.uint64(m)


def bloom(keys: np.ndarray, level: int, bits_per_key: float = BITS_PER_KEY) -> np.ndarray:
    m = max(64, math.ceil(len(keys) * bits_per_key))
    flags = np.zeros(-(-m // 8) * 8, np.uint8)
    if len(keys):
        flags[_bits(keys, level, len(flags)).reshape(-1)] = 1
    return np.packbits(flags)


def holds(level_bits: np.ndarray, keys: np.ndarray, level: int) -> np.ndarray:
    at = _bits(keys, level, len(level_bits) * 8)
    return (level_bits[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8) & 1).all(1)


def cascade(listed: np.ndarray, others: np.ndarray) -> list[np.ndarray]:
    """The levels for a universe of listed and other keys."""
    levels: list[np.ndarray] = []
    inside, outside = listed, others
    while len(inside):
        levels.append(bloom(inside, len(levels)))
        wrong = outside[holds(levels[-1], outside, len(levels) - 1)] if len(outside) else outside
        inside, outside = wrong, inside
    return levels


def listed_by(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Whether each key of the universe is listed: the number of levels that hold it in turn is odd."""
    depth = np.zeros(len(keys), np.int64)
    alive = np.arange(len(keys))
    for k, level in enumerate(levels):
        alive = alive[holds(level, keys[alive], k)] if len(alive) else alive
        depth[alive] += 1
    return depth % 2 == 1


def build(keys: DataFrame, shards: int) -> DataFrame:
    """keys (key long, shard int, listed boolean; distinct) to shard, level, bits."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        k = pdf["key"].to_numpy(np.int64).view(np.uint64)
        yes = pdf["listed"].to_numpy(bool)
        levels = cascade(np.sort(k[yes]), np.sort(k[~yes]))
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])] * len(levels), "level": range(len(levels)), "bits": [x.tobytes() for x in levels]})

    return keys.groupBy("shard").applyInPandas(one, "shard int, level int, bits binary")


def verdicts(pages: DataFrame, rules=RULES, blocked: DataFrame | None = None, most_bytes: int = MOST_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """pages with __bq_host, __bq_path, __bq_rule and __bq_verdict. blocked: a table of more listed hosts (column host)."""
    spark = pages.sparkSession
    arrow_batches(spark, 10_000)
    hosted = pages.withColumns({"__bq_host": host(F.col("url")), "__bq_path": path(F.col("url"))})
    name, action = rule(F.col("__bq_host"), F.col("__bq_path"), rules)
    hosted = hosted.withColumns({"__bq_rule": name, "__bq_action": action, "__bq_key": F.xxhash64("__bq_host")})
    hosts = hosted.groupBy("__bq_host").agg(F.max((F.col("__bq_action") == "block") & (F.col("__bq_host") != "")).alias("listed")).select(F.col("__bq_host").alias("host"), F.coalesce("listed", F.lit(False)).alias("listed"))
    if blocked is not None:
        hosts = hosts.join(blocked.filter("host <> ''").select("host").distinct().withColumn("b", F.lit(True)), "host", "left").select("host", (F.col("listed") | F.coalesce("b", F.lit(False))).alias("listed"))
    universe = materialize(hosts.select("host", "listed", F.xxhash64("host").alias("key")))
    n = universe.count()
    shards = max(1, -(-n // shard_keys))
    keys = universe.groupBy("key").agg(F.max("listed").alias("listed"), (F.max("listed") != F.min("listed")).alias("shared"))
    # hosts of shared hashes: about n * n / 2**65 of them, so next to none
    apart = [r.host for r in universe.join(keys.filter("shared"), "key").filter(~universe["listed"]).select("host").limit(MOST_SHARED + 1).collect()]
    if len(apart) > MOST_SHARED:
        raise RuntimeError("too many hosts share a 64-bit hash")
    shard_of = lambda key: F.pmod(F.xxhash64(key, F.lit(1)), F.lit(shards)).cast("int")
    shard = shard_of(F.col("__bq_key"))
    filters = materialize(build(keys.select("key", shard_of(F.col("key")).alias("shard"), "listed"), shards))
    size = filters.agg(F.sum(F.length("bits"))).first()[0] or 0
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hosted.schema.fields)
    spec = f"{fields}, __bq_shard int, __bq_listed boolean"
    dealt = hosted.withColumn("__bq_shard", shard)

    if size <= most_bytes:
        levels: dict[int, list[np.ndarray]] = {}
        for r in filters.orderBy("shard", "level").toLocalIterator():
            levels.setdefault(r.shard, []).append(np.frombuffer(r.bits, np.uint8))
        held = spark.sparkContext.broadcast(levels)

        @lean
        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = {c: i for i, c in enumerate(b.schema.names)}
                keys = b.column(at["__bq_key"]).to_numpy().view(np.uint64)
                to = b.column(at["__bq_shard"]).to_numpy()
                out = np.zeros(len(keys), bool)
                for s in np.unique(to).tolist():
                    out[to == s] = listed_by(held.value.get(s, []), keys[to == s])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "__bq_listed"])

        answered = dealt.mapInArrow(look, spec)
    else:
        salts = 64

        def meet(levels: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            found = [np.frombuffer(x, np.uint8) for x in levels.sort_values("level")["bits"]]
            return rows.drop(columns="__bq_salt").assign(__bq_listed=listed_by(found, rows["__bq_key"].to_numpy(np.int64).view(np.uint64)))

        left = filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        right = dealt.withColumn("__bq_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in ("__bq_host", "__bq_path", "url")]), F.lit(salts)).cast("int"))
        answered = left.groupBy("shard", "salt").cogroup(right.groupBy("__bq_shard", "__bq_salt")).applyInPandas(meet, spec)
    listed = F.col("__bq_listed") & ~F.col("__bq_host").isin(apart) if apart else F.col("__bq_listed")
    return answered.withColumn("__bq_verdict", F.coalesce("__bq_action", F.when(listed, "block").otherwise("allow"))).drop("__bq_key", "__bq_shard", "__bq_listed", "__bq_action")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verdicts(read(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", F.col("__bq_host").alias("host"), F.col("__bq_path").alias("path"), F.col("__bq_rule").alias("rule"), F.col("__bq_verdict").alias("verdict"))


ORACLE_SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
h AS (SELECT page_id,
             translate(regexp_extract(url, '^(?:(?s:.)*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(url, '^(?:(?s:.)*?)://[^/?#]*([^?#]*)', 1) AS path FROM u),
rules AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS t(action, rh, rp)),
f AS (SELECT page_id, rh || rp AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) AS k
      FROM (SELECT DISTINCT page_id, host, path FROM h) JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT h.page_id, h.host, h.path, f.rule,
       coalesce(f.action, CASE WHEN h.host IN (SELECT b.host FROM h b JOIN f g ON b.page_id = g.page_id AND g.k = 1 AND g.action = 'block' AND b.host <> '') THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN f ON h.page_id = f.page_id AND f.k = 1
"""
