"""Synthetic record streams: rows of (rec_id, rec, truth), the same under any partitioning.

Every draw is a hash of (rec_id, place, salt, seed), so nothing depends on
order or on the number of tasks. rec is map<string,string>; truth is never an
input of a learner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def draw(seed: int, salt: str, n: int | Column, *place: Column) -> Column:
    """An integer from 0 to n - 1 that depends on the record, the place and the salt."""
    return F.pmod(F.xxhash64(F.col("rec_id"), *place, F.lit(salt), F.lit(seed)), n if isinstance(n, Column) else F.lit(n)).cast("int")


def chance(seed: int, salt: str, p: float | Column, *place: Column) -> Column:
    """True with probability p."""
    return F.pmod(F.xxhash64(F.col("rec_id"), *place, F.lit(salt), F.lit(seed)), F.lit(1 << 30)) < F.lit(float(1 << 30)) * (p if isinstance(p, Column) else F.lit(p))


def _rows(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1).withColumnRenamed("id", "rec_id")


def _map(keys: Column, value) -> Column:
    """A map from an array of keys; value(i, key) gives the values."""
    return F.map_from_arrays(keys, F.transform(keys, lambda k, i: value(i, k)))


def _s(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def _keys(k: int, name) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), name)


def two_group(spark: SparkSession, n: int = 2000, k: int = 4, d: int = 10, seed: int = 0) -> DataFrame:
    """Two groups with keys and values of their own, in turn."""
    g = (F.col("rec_id") % 2).cast("int")
    return _rows(spark, n).withColumn("truth", g).withColumn("rec", _map(_keys(k, lambda j: _s("g", g, "k", j)), lambda j, _: _s("g", g, "v", draw(seed, "v", d, j))))


def planted(spark: SparkSession, n: int = 3000, groups: int = 8, k: int = 3, d: int = 8, value_noise: float = 0.1, key_noise: float = 0.0, random_share: float = 0.0, seed: int = 0) -> DataFrame:
    """Groups with keys of their own; a noisy value comes from another group, a noisy key too; some records are random."""
    g = F.col("truth")
    other = lambda salt, j: (g + 1 + draw(seed, salt, max(1, groups - 1), j)) % groups
    key = lambda j: _s("c", F.when(chance(seed, "kn", key_noise, j), other("ko", j)).otherwise(g), "k", j)
    value = lambda j, _: _s("c", F.when(chance(seed, "vn", value_noise, j), other("vo", j)).otherwise(g), "v", draw(seed, "v", d, j))
    rows = _rows(spark, n).withColumn("truth", draw(seed, "g", groups))
    noise = _map(_keys(k, lambda j: _s("c", draw(seed, "rg", groups, j), "k", j)), lambda j, _: _s("c", draw(seed, "rv", groups, j), "v", draw(seed, "rw", d, j)))
    random = chance(seed, "r", random_share)
    return rows.withColumn("rec", F.when(random, noise).otherwise(_map(_keys(k, key), value))).withColumn("truth", F.when(random, -1).otherwise(g))


def shared_key(spark: SparkSession, n: int = 2000, groups: int = 3, d: int = 8, both: float = 0.15, seed: int = 0) -> DataFrame:
    """All records share three keys; each has its group's, and some a second group's too."""
    g = F.col("truth")
    second = (g + 1 + draw(seed, "s", groups - 1)) % groups
    shared = _keys(3, lambda j: _s("s", j))
    own = _keys(3, lambda j: _s("g", g, "k", j))
    more = F.when(chance(seed, "b", both), _keys(3, lambda j: _s("g", second, "k", j))).otherwise(F.array().cast("array<string>"))
    keys = F.concat(shared, own, more)
    value = lambda j, k: F.when(j < 3, _s("sv", draw(seed, "v", d, j))).otherwise(_s(F.substring(k, 1, 2), "v", draw(seed, "v", d, j)))
    return _rows(spark, n).withColumn("truth", draw(seed, "g", groups)).withColumn("rec", _map(keys, value))


def typo_stream(spark: SparkSession, n: int = 6000, k: int = 3, d: int = 8, rate: float = 0.01, seed: int = 0) -> DataFrame:
    """two_group in which a value is a misspelling with the given rate; is_typo says in which records."""
    g = F.col("truth")
    bad = lambda j: chance(seed, "t", rate, j)
    rec = _map(_keys(k, lambda j: _s("g", g, "k", j)), lambda j, _: F.when(bad(j), _s("TYPO", F.col("rec_id"), "_", j)).otherwise(_s("g", g, "v", draw(seed, "v", d, j))))
    return _rows(spark, n).withColumn("truth", (F.col("rec_id") % 2).cast("int")).withColumn("rec", rec).withColumn("is_typo", F.exists(F.map_values("rec"), lambda v: v.startswith("TYPO")))


def cost_stream(spark: SparkSession, n: int, groups: int, regime: str = "disjoint", k: int = 3, d: int = 8, seed: int = 0) -> DataFrame:
    """Groups with disjoint keys, or the same keys with values of their own."""
    g = F.col("truth")
    key = (lambda j: _s("c", g, "k", j)) if regime == "disjoint" else (lambda j: _s("k", j))
    return _rows(spark, n).withColumn("truth", draw(seed, "g", groups)).withColumn("rec", _map(_keys(k, key), lambda j, _: _s("g", g, "v", draw(seed, "v", d, j))))


def uniform_null(spark: SparkSession, n: int = 3000, keys: int = 4, d: int = 10, seed: int = 0) -> DataFrame:
    return _rows(spark, n).withColumn("truth", F.lit(-1)).withColumn("rec", _map(_keys(keys, lambda j: _s("k", j)), lambda j, _: _s("v", draw(seed, "v", d, j))))


def zipf_null(spark: SparkSession, n: int = 3000, keys: int = 4, d: int = 10, s: float = 1.0, seed: int = 0) -> DataFrame:
    """As uniform_null, value i with a share in proportion to 1 / (i + 1) ** s."""
    weights = [1 / (i + 1) ** s for i in range(d)]
    total, cdf, at = sum(weights), [], 0.0
    for w in weights:
        at += w / total
        cdf.append(at)
    u = lambda j: F.pmod(F.xxhash64(F.col("rec_id"), j, F.lit("z"), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    pick = lambda j: F.size(F.filter(F.array(*[F.lit(x) for x in cdf[:-1]]), lambda x: x <= u(j)))
    return _rows(spark, n).withColumn("truth", F.lit(-1)).withColumn("rec", _map(_keys(keys, lambda j: _s("k", j)), lambda j, _: _s("v", pick(j))))


def presence_null(spark: SparkSession, n: int = 3000, keys: int = 4, d: int = 10, p: float = 0.8, seed: int = 0) -> DataFrame:
    """As uniform_null, each key there with probability p."""
    return uniform_null(spark, n, keys, d, seed).withColumn("rec", F.map_filter("rec", lambda k, _: chance(seed, "p", p, k)))


def shuffled_values(records: DataFrame, seed: int = 0) -> DataFrame:
    """Each key's values dealt anew among the records that have the key."""
    from pyspark.sql import Window

    cells = records.select("rec_id", F.explode("rec").alias("key", "value"))
    here = cells.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("rec_id")))
    there = cells.select("key", "value", F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("rec_id", F.lit(seed)), "rec_id")).alias("k"))
    dealt = here.drop("value").join(there, ["key", "k"]).groupBy("rec_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("rec"))
    return records.drop("rec").join(dealt, "rec_id")


def independent_null(records: DataFrame, seed: int = 0) -> DataFrame:
    """Each key drawn by its share of the records, its value from the key's own values; no key meets another but by chance."""
    from pyspark.sql import Window

    cells = records.select("rec_id", F.explode("rec").alias("key", "value"))
    pool = cells.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("rec_id")) - 1)
    share = cells.groupBy("key").agg(F.count("*").alias("n"))  # one row for each key of the schema
    drawn = records.select("rec_id").crossJoin(F.broadcast(share.crossJoin(records.agg(F.count("*").alias("all"))).withColumn("p", F.col("n") / F.col("all"))))
    drawn = drawn.filter(chance(seed, "i", F.col("p"), F.col("key"))).withColumn("k", draw(seed, "j", F.col("n"), F.col("key")).cast("long"))
    return drawn.join(pool.select("key", "k", "value"), ["key", "k"]).groupBy("rec_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("rec")).withColumn("truth", F.lit(-1))


def values_only(spark: SparkSession, n: int = 3000, groups: int = 8, keys: int = 6, alphabet: int = 64, signal: float = 1.0, seed: int = 0) -> DataFrame:
    """All records have the same keys; a group is a slice of the values, followed with probability signal."""
    g, width = F.col("truth"), alphabet // groups
    value = lambda j, _: F.when(chance(seed, "s", signal, j), _s("v", g * width + draw(seed, "v", width, j))).otherwise(_s("v", draw(seed, "w", alphabet, j)))
    return _rows(spark, n).withColumn("truth", draw(seed, "g", groups)).withColumn("rec", _map(_keys(keys, lambda j: _s("k", j)), value))


def by_mixture(spark: SparkSession, n: int = 3000, signal: float = 0.5, seed: int = 0) -> DataFrame:
    """values_only records with probability signal, and noise records (truth -1) otherwise."""
    clean = values_only(spark, n, seed=seed)
    noise = values_only(spark, n, signal=0.0, seed=seed + 1).select("rec_id", F.col("rec").alias("noise"))
    keep = chance(seed, "m", signal)
    return clean.join(noise, "rec_id").select("rec_id", F.when(keep, F.col("rec")).otherwise(F.col("noise")).alias("rec"), F.when(keep, F.col("truth")).otherwise(-1).alias("truth"))


def by_corruption(spark: SparkSession, n: int = 3000, signal: float = 0.5, seed: int = 0) -> DataFrame:
    return values_only(spark, n, signal=signal, seed=seed)


def two_level(spark: SparkSession, n: int = 3000, families: int = 3, species: int = 3, noise: float = 0.1, d: int = 6, seed: int = 0) -> DataFrame:
    """Records with their family's keys and their species' keys."""
    f, s = F.col("family"), F.col("species")
    keys = F.concat(_keys(2, lambda j: _s("f", f, "k", j)), _keys(2, lambda j: _s("f", f, "s", s, "k", j)))
    value = lambda j, k: _s(F.when(chance(seed, "n", noise, j), F.lit("x")).otherwise(F.lit("v")), draw(seed, "v", d, j))
    return _rows(spark, n).withColumn("family", draw(seed, "f", families)).withColumn("species", draw(seed, "s", species)).withColumn("rec", _map(keys, value)).withColumn("truth", f * species + s)


def three_level(spark: SparkSession, n: int = 3000, seed: int = 0) -> DataFrame:
    o, f, s = F.col("order"), F.col("family"), F.col("species")
    keys = F.concat(_keys(2, lambda j: _s("o", o, "k", j)), _keys(2, lambda j: _s("o", o, "f", f, "k", j)), _keys(2, lambda j: _s("o", o, "f", f, "s", s, "k", j)))
    return _rows(spark, n).withColumn("order", draw(seed, "o", 2)).withColumn("family", draw(seed, "f", 2)).withColumn("species", draw(seed, "s", 2)).withColumn("rec", _map(keys, lambda j, _: _s("v", draw(seed, "v", 6, j)))).withColumn("truth", o * 4 + f * 2 + s)


def relations(spark: SparkSession, n: int = 4000, families: int = 3, species: int = 2, seed: int = 0) -> DataFrame:
    """A schema with known relations: sp implies fam, sp of a family never meet, alias stands for famaux, city gives country."""
    f, s = F.col("family"), F.col("species")
    fam, sp = _s("fam", f), _s("sp", f, "_", s)
    aux = F.when(chance(seed, "a", 0.5), _s("famaux", f)).otherwise(_s("alias", f))
    city = draw(seed, "c", 12)
    base = F.array(F.struct(fam.alias("key"), _s("f", f, "v", draw(seed, "v", 5)).alias("value")), F.struct(sp.alias("key"), _s("s", f, "_", s, "v", draw(seed, "w", 5)).alias("value")), F.struct(aux.alias("key"), _s("a", f, "v", draw(seed, "x", 6)).alias("value")))
    place = F.when(chance(seed, "p", 0.6), F.array(F.struct(F.lit("city").alias("key"), _s("city", city).alias("value")), F.struct(F.lit("country").alias("key"), _s("country", city % 4).alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    passport = F.when(chance(seed, "q", 0.3), F.array(F.struct(F.lit("passport").alias("key"), _s("p", draw(seed, "pp", 1000)).alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    return _rows(spark, n).withColumn("family", draw(seed, "f", families)).withColumn("species", draw(seed, "s", species)).withColumn("rec", F.map_from_entries(F.concat(base, place, passport))).withColumn("truth", f * species + s)


def relations_gold(spark: SparkSession, families: int = 3, species: int = 2) -> DataFrame:
    """kind, a, b of what relations() holds."""
    rows = []
    for f in range(families):
        for s in range(species):
            rows.append(("specialises", f"sp{f}_{s}", f"fam{f}"))
            rows += [("sibling", f"sp{f}_{s}", f"sp{f}_{t}") for t in range(s + 1, species)]
        rows += [("specialises", f"famaux{f}", f"fam{f}"), ("specialises", f"alias{f}", f"fam{f}"), ("synonym", f"alias{f}", f"famaux{f}")]
    return spark.createDataFrame([*rows, ("value_edge", "city", "country")], "kind string, a string, b string")


def cover(spark: SparkSession, n: int = 1500, groups: int = 8, shared: int = 4, private: int = 2, per_group: int = 4, values: int = 6, noise: float = 0.05, seed: int = 0) -> DataFrame:
    """Records of one to three groups (truth: array); groups share a pool of keys; a value tells the group that made it."""
    size = 1 + draw(seed, "n", 3)
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: F.struct(F.xxhash64(F.col("rec_id"), g, F.lit("o"), F.lit(seed)).alias("h"), g.alias("g"))))
    mine = F.array_sort(F.transform(F.slice(order, 1, size), lambda x: x.g))
    one = lambda g: F.concat(
        F.transform(F.sequence(F.lit(0), F.lit(private - 1)), lambda j: F.struct(_s("p", g, "_", j).alias("key"), _s("g", g, "v", draw(seed, "v", values, g, j)).alias("value"))),
        F.transform(F.sequence(F.lit(0), F.lit(per_group - private - 1)), lambda j: F.struct(_s("s", (g * 2 + j) % shared).alias("key"), _s("g", F.when(chance(seed, "z", noise, g, j), draw(seed, "zg", groups, g, j)).otherwise(g), "v", draw(seed, "w", values, g, j)).alias("value"))))
    cells = F.flatten(F.transform(F.col("truth"), one))
    first = F.filter(cells, lambda e, i: ~F.exists(F.slice(cells, 1, i), lambda x: x.key == e.key))
    return _rows(spark, n).withColumn("truth", mine).withColumn("rec", F.map_from_entries(first))


def multi_membership(spark: SparkSession, n: int = 2000, groups: int = 8, keys: int = 3, d: int = 8, noise: float = 0.05, weights: tuple[float, ...] = (0.6, 0.3, 0.1), seed: int = 0) -> DataFrame:
    """Records of one or more groups with keys of their own (truth: array)."""
    u = F.pmod(F.xxhash64(F.col("rec_id"), F.lit("u"), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    size, at = F.lit(len(weights)), 0.0
    for k, w in reversed(list(enumerate(weights[:-1], 1))):
        at = sum(weights[:k])
        size = F.when(u < at, k).otherwise(size)
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: F.struct(F.xxhash64(F.col("rec_id"), g, F.lit("o"), F.lit(seed)).alias("h"), g.alias("g"))))
    mine = F.array_sort(F.transform(F.slice(order, 1, size), lambda x: x.g))
    cells = F.flatten(F.transform(F.col("truth"), lambda g: F.transform(F.sequence(F.lit(0), F.lit(keys - 1)), lambda j: F.struct(_s("g", g, "k", j).alias("key"), _s("g", F.when(chance(seed, "z", noise, g, j), draw(seed, "zg", groups, g, j)).otherwise(g), "v", draw(seed, "v", d, g, j)).alias("value")))))
    return _rows(spark, n).withColumn("truth", mine).withColumn("rec", F.map_from_entries(cells))


def key_synonyms(spark: SparkSession, per_role: int = 500, overlap: float = 1.0, d: int = 8, seed: int = 0) -> DataFrame:
    """Two keys that never meet and draw from vocabularies with the given overlap, beside keys of other roles."""
    n = 4 * per_role
    role = (F.col("rec_id") % 4).cast("int")
    shared = lambda: chance(seed, "o", overlap)
    key = F.when(role == 0, "name").when(role == 1, "label").otherwise(_s("other", role))
    value = F.when(role <= 1, F.when(shared() | (role == 0), _s("n", draw(seed, "v", d))).otherwise(_s("m", draw(seed, "v", d)))).otherwise(_s("o", role, "_", draw(seed, "v", d)))
    return _rows(spark, n).withColumn("truth", F.when(role <= 1, 0).otherwise(role)).withColumn("rec", F.create_map(key, value, F.lit("kind"), _s("r", F.least(role, F.lit(2)))))


def tree(spark: SparkSession, depth: int = 3, n: int = 512, missing: float = 0.0, background: float = 0.0, seed: int = 0) -> DataFrame:
    """Binary taxonomy: level l has three keys whose value is twice the path so far plus a bit (truth: path as a string)."""
    bit = lambda level: draw(seed, "b", 2, F.lit(level))
    entries, path, name = [], F.lit(0), F.lit("")
    for level in range(1, depth + 1):
        path = path * 2 + bit(level)
        name = F.concat(name, bit(level).cast("string"))
        for r in range(3):
            k = 3 * (level - 1) + r
            noisy = chance(seed, "bg", background, F.lit(k))
            entries.append(F.struct(F.lit(f"k{k}").alias("key"), _s("v", F.when(noisy, draw(seed, "bv", 2**level, F.lit(k))).otherwise(path)).alias("value")))
    rec = F.map_from_entries(F.array(*entries)) if entries else F.create_map(F.lit("k0"), F.lit("v0"))
    return _rows(spark, n).withColumn("rec", F.map_filter(rec, lambda k, _: ~chance(seed, "m", missing, k))).withColumn("truth", name)


def intersecting(spark: SparkSession, n: int = 512, seed: int = 0) -> DataFrame:
    """Two groupings a and b with keys of their own, and a joint group of a0 and b0 with two parents."""
    a, b = draw(seed, "a", 2), draw(seed, "b", 2)
    both = (a == 0) & (b == 0)
    entries = [F.struct(F.lit(f"k{j}").alias("key"), _s("a", a).alias("value")) for j in range(3)] + [F.struct(F.lit(f"k{j}").alias("key"), _s("b", b).alias("value")) for j in range(3, 6)]
    entries += [F.struct(F.lit(f"k{j}").alias("key"), F.when(both, F.lit("joint")).otherwise(_s("x", draw(seed, "x", 4, F.lit(j)))).alias("value")) for j in range(6, 9)]
    return _rows(spark, n).withColumn("rec", F.map_from_entries(F.array(*entries))).withColumn("truth", _s(a, b, F.when(both, "j").otherwise("")))


def bipartite(spark: SparkSession, records: int = 20, atoms: int = 12, p: float = 0.3, seed: int = 0) -> DataFrame:
    """Random record-atom edges."""
    return _rows(spark, records).withColumn("atom", F.explode(F.sequence(F.lit(0), F.lit(atoms - 1)))).filter(chance(seed, "e", p, F.col("atom")))
