"""Evidence by chance against the published figures; mergeable reservoirs."""

import random

from bitquarry.operators import nulls

#: Published: the share of 20,000 null runs of 200 steps whose evidence ever reaches so many bits.
PUBLISHED = {1: 0.09785, 2: 0.0324, 4: 0.0064, 8: 0.0002, 12: 0.0}


def test_exceedance_is_the_published_one_within_two_errors(spark):
    sups = nulls.null_sups(spark, 20_000).cache()
    rows = nulls.exceedance(sups, list(PUBLISHED)).collect()
    assert len(rows) == len(PUBLISHED)
    for r in rows:
        p = PUBLISHED[int(r.level)]
        error = 2 ** 0.5 * max(r.error, (1 / r.runs) * 2)  # both figures are draws of 20,000
        assert abs(r.share - p) <= 2 * error, r
        assert r.share <= r.bound + 3e-3
    slack = nulls.least_slack(sups, 2.0).first().slack
    assert slack == 0.0
    few = nulls.null_sups(spark, 300).repartition(7)
    assert {(r.run, r.sup) for r in few.collect()} == {(r.run, r.sup) for r in sups.filter("run < 300").collect()}


def test_reservoirs_merge_and_quantiles_have_ceil_ranks(spark):
    rng = random.Random(1)
    rows = [(g, i, float(rng.randint(0, 50))) for i in range(500) for g in "ab"]
    df = spark.createDataFrame(rows, "g string, i long, v double")
    whole = nulls.reservoir(df, ["g"], "i", "v", 60)
    parts = [df.filter(f"i % 3 = {k}") for k in range(3)]
    kept = None
    for p in parts:  # named again, as merging needs the names
        import hashlib

        mine = sorted(p.collect(), key=lambda r: hashlib.md5(str(r.i).encode()).hexdigest())
        for g in "ab":
            few = [r for r in mine if r.g == g][:60]
            kept = (kept or []) + few
    merged = nulls.reservoir(spark.createDataFrame(kept, df.schema), ["g"], "i", "v", 60)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))
    s = {r.g: r for r in nulls.summaries(df, ["g"], "i", "v", {"lo": 0.0, "mid": 0.5, "hi": 1.0}).collect()}
    for g in "ab":
        v = sorted(x for h, _, x in rows if h == g)
        assert (s[g].lo, s[g].mid, s[g].hi, s[g].n) == (v[0], v[249], v[-1], 500)


def test_reservoir_sorts_few_rows_of_a_large_group(spark):
    import hashlib

    from pyspark.sql import functions as F

    df = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, F.lit("a")).alias("g"), F.col("id").alias("i"), (F.col("id") * 1.0).alias("v"))
    kept = nulls.reservoir(df, ["g"], "i", "v", 50)
    got = {g: sorted(r.v for r in kept.collect() if r.g == g) for g in ("a", None)}
    for g, odd in (("a", 0), (None, 1)):
        assert got[g] == sorted(map(float, sorted(range(odd, 200_000, 2), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:50]))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "__last" in plan  # what is ranked is cut off by bins before
