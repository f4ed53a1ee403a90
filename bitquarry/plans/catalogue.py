"""The queries over the driver's tables, and DuckDB SQL for those that SQL can express.

Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitquarry.functions import bits as B
from bitquarry.functions import text as T
from bitquarry.operators import accounts, baselines, blocks, engine, evidence, metrics, mining, nearest, objective, prequential
from bitquarry.plans import duck as D
from bitquarry.sources import generators as G
from bitquarry.sources import records as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(x: Column | str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


def long(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("long")


# records, cells, dictionaries


@query(f"WITH cells AS ({D.ORDERS}) SELECT rec_id, key, value FROM cells")
def cells_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.orders(spark, sf_dir)


@query(f"WITH cells AS ({D.ORDERS}) SELECT rec_id, string_agg(key || ': ' || value, '; ' ORDER BY key) AS rec FROM cells GROUP BY rec_id")
def records_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.records(R.orders(spark, sf_dir)).select("rec_id", T.record_text("rec").alias("rec"))


@query(f"WITH cells AS ({D.MIXED}) SELECT key, count(*) AS published, count(DISTINCT value) AS inventory, min(rec_id) AS first_seen FROM cells GROUP BY key")
def key_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.key_dictionary(R.mixed(spark, sf_dir))


@query(f"WITH cells AS ({D.MIXED}) SELECT key, value, count(*) AS c FROM cells GROUP BY key, value")
def value_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.value_blocks(R.mixed(spark, sf_dir))


@query(f"WITH cells AS ({D.ORDERS}) SELECT a.rec_id, a.key, a.value FROM cells a")
def record_cell_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cells(R.records(R.orders(spark, sf_dir)))


@query(f"WITH cells AS ({D.ORDERS}) SELECT rec_id, key, value FROM cells UNION ALL SELECT rec_id, 'has:' || key, '1' FROM cells")
def presence_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cells(R.presence_facets(R.records(R.orders(spark, sf_dir))))


# prequential statistics


def _background(cells: DataFrame) -> DataFrame:
    p = prequential.background_bits(cells)
    return p.groupBy("key").agg(r6(F.sum("value_bits")).alias("bits"), F.count("*").alias("cells"))


_BACKGROUND = "WITH cells AS ({}), " + D.PRIOR + f" SELECT key, round(sum({D.blockcost('c', 'n', 'u', D.naming('u'))}), 6) AS bits, count(*) AS cells FROM q GROUP BY key"


@query(_BACKGROUND.format(D.ORDERS))
def prequential_background_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _background(R.orders(spark, sf_dir))


@query(_BACKGROUND.format(D.EVENTS))
def prequential_background_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _background(R.events(spark, sf_dir))


@query(f"WITH cells AS ({D.MIXED}), o AS (SELECT rec_id, row_number() OVER (ORDER BY rec_id) - 1 AS past FROM (SELECT DISTINCT rec_id FROM cells)), s AS (SELECT rec_id, key, row_number() OVER (PARTITION BY key ORDER BY rec_id) - 1 AS p FROM cells) SELECT key, round(sum({D.kt('p', 'past', '2')}), 6) AS bits FROM s JOIN o USING (rec_id) GROUP BY key")
def prequential_presence_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = R.mixed(spark, sf_dir)
    return prequential.presence_bits(cells, cells.select("rec_id").distinct()).groupBy("key").agg(r6(F.sum("presence_bits")).alias("bits"))


@query(f"WITH cells AS ({D.PART}), {D.PRIOR} SELECT rec_id, key, CAST(u + 1 AS BIGINT) AS inventory FROM q WHERE c = 0")
def running_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prequential.running_inventory(R.part(spark, sf_dir))


@query(f"WITH cells AS ({D.PART}), {D.PRIOR} SELECT rec_id, key, CAST(c AS BIGINT) AS c, CAST(n AS BIGINT) AS n, CAST(u AS BIGINT) AS u FROM q")
def prior_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prequential.prior_counts(R.part(spark, sf_dir), chunk=500).select("rec_id", "key", "c", "n", "u")


@query(f"WITH cells AS ({D.ORDERS}), t AS (SELECT key, value, count(*) AS total FROM cells GROUP BY 1, 2) SELECT key, CAST(sum(total) AS BIGINT) AS cells, CAST(sum(CASE WHEN total <= 1 THEN total ELSE 0 END) AS BIGINT) AS rare_final, count(*) AS rare_first FROM t GROUP BY key")
def rare_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prequential.rare_cells(R.orders(spark, sf_dir))


_SEEDED = f"""WITH cells AS ({D.ORDERS}), {D.PRIOR},
per AS (SELECT rec_id, count(*) AS size, sum({D.blockcost('c', 'n', 'u', D.naming('u'))}) AS gain, sum({D.naming('u')}) AS own FROM q GROUP BY rec_id),
born AS (SELECT first AS rec_id, count(*) AS born FROM (SELECT key, min(rec_id) AS first FROM cells GROUP BY key) GROUP BY 1),
w AS (SELECT per.*, row_number() OVER (ORDER BY per.rec_id) AS n, sum(coalesce(born, 0)) OVER (ORDER BY per.rec_id) AS a FROM per LEFT JOIN born USING (rec_id)),
m AS (SELECT rec_id, {D.price('1.0', 'size', 'n', '0.0', '0.0', 'a')} AS price, gain - own AS gain FROM w)"""


@query(_SEEDED + """ SELECT count(*) AS records, CAST(count(*) FILTER (WHERE gain > price) AS BIGINT) AS minted, round(avg(gain - price), 6) AS margin, round(max(gain - price), 6) AS best FROM m""")
def immediate_mint(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prequential.new_value_price(R.orders(spark, sf_dir))
    return p.agg(F.count("*").alias("records"), F.count_if(F.col("margin") > 0).alias("minted"), r6(F.avg("margin")).alias("margin"), r6(F.max("margin")).alias("best"))


@query(_SEEDED + " SELECT min(rec_id) AS first_mint FROM m WHERE gain > price")
def first_mint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.first_mint(prequential.new_value_price(R.orders(spark, sf_dir)))


@query(f"WITH cells AS ({D.ORDERS}), {D.PRIOR}, z AS (SELECT key, count(DISTINCT value) AS size FROM cells GROUP BY key), g AS (SELECT key, rec_id, sum(log2(size) - {D.kt('c', 'n', 'size')}) OVER (PARTITION BY key ORDER BY rec_id) AS g FROM q JOIN z USING (key)) SELECT key, round(arg_max(g, rec_id), 6) AS final, round(greatest(max(g), 0), 6) AS sup FROM g GROUP BY key")
def evidence_sup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.evidence_against_uniform(R.orders(spark, sf_dir)).select("key", r6("final").alias("final"), r6("sup").alias("sup"))


@query("SELECT p_partkey AS k, round(coalesce(list_sum(list_transform(range(1, p_partkey + 1), lambda i: 1.0::DOUBLE / i)), 0), 6) AS h FROM part")
def harmonic_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), r6(evidence.harmonic("p_partkey")).alias("h"))


@query(f"WITH p AS (SELECT DISTINCT CAST(p_size AS DOUBLE) AS k FROM part), s AS (SELECT k, greatest(50.0, 2 * k) AS a, t, greatest(t + 1, floor(t / (0.5 / 10))) AS n FROM p CROSS JOIN (SELECT unnest(range(2, 500)) AS t)) SELECT k AS size, CAST(min(t) FILTER (WHERE t * k >= {D.price('t', 'k', 'n', '0.0', '0.0', 'a')}) AS INTEGER) AS t FROM s GROUP BY k")
def detection_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size").cast("double")
    rates = R.table(spark, sf_dir, "part").select(k.alias("rate"), k.alias("size"), F.lit(10.0).alias("values"), F.lit(50.0).alias("keys"))
    return evidence.detection_times(rates, 500).select("size", "t")


# codelengths of blocks


@query(f"WITH cells AS ({D.LINEITEM}), b AS (SELECT key, value, count(*) AS c FROM cells GROUP BY 1, 2), g AS (SELECT key, sum(c) + (count(*) + 1) / 2 AS d FROM b GROUP BY key) SELECT key, value, round((c + 0.5) / d, 6) AS probability, round(0.5 / d, 6) AS escape FROM b JOIN g USING (key)")
def value_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evidence.value_probabilities(blocks.value_blocks(R.lineitem(spark, sf_dir)))
    return out.select("key", "value", r6("probability").alias("probability"), r6("escape").alias("escape"))


@query(f"""WITH t AS (SELECT list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: length(x) >= 2) AS ts FROM part), e AS (SELECT CASE WHEN len(ts) > 0 THEN ts ELSE [''] END AS ts FROM t),
c AS (SELECT t, count(*) AS c FROM (SELECT unnest(ts) AS t FROM e) GROUP BY t), g AS (SELECT sum(c) AS n, count(*) AS u, sum({D.term('(c - 1)')}) AS s FROM c), l AS (SELECT sum({D.universal('(len(ts) + 1)')}) AS lengths FROM e)
SELECT u AS distinct_tokens, round(lengths + {D.vblock('s', 'n', 'u', 'log2(u + 1)')}, 6) AS bits FROM g CROSS JOIN l""")
def field_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.field_bits(R.table(spark, sf_dir, "part"), "p_name").select("distinct_tokens", r6("bits").alias("bits"))


@query(f"WITH cells AS ({D.LINEITEM}), b AS (SELECT key, value, count(*) AS c FROM cells GROUP BY 1, 2), g AS (SELECT key, sum(c) AS n, count(*) AS u, sum({D.term('c')}) AS k, sum({D.term('(c - 1)')}) AS s FROM b GROUP BY key) SELECT key, CAST(n AS BIGINT) AS total, u AS distinct_values, round({D.ktblock('k', 'n', 'u')}, 6) AS kt_bits, round({D.vblock('s', 'n', 'u', D.naming('u'))}, 6) AS vblock_bits FROM g")
def block_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = blocks.block_bits(blocks.value_blocks(R.lineitem(spark, sf_dir)), ["key"])
    return out.select("key", "total", F.col("distinct").alias("distinct_values"), r6("kt_bits").alias("kt_bits"), r6("vblock_bits").alias("vblock_bits"))


def _vb(n: str, u: str, name: str) -> str:
    safe = f"greatest({u}, 1)"
    return f"(CASE WHEN {n} > 0 THEN {D.col(u, n)} + {D.lg2(f'{n} - {u} + {safe} / 2.0')} - {D.lg2(f'{safe} / 2.0')} + {u} * {name} ELSE 0 END)"


_DELTAS = f"""WITH cells AS ({D.LINEITEM}), b AS (SELECT key, value, count(*) AS c FROM cells GROUP BY 1, 2), g AS (SELECT key, sum(c) AS n, count(*) AS u FROM b GROUP BY key),
j AS (SELECT b.key, value, c, n, u, {D.naming('u')} AS nm FROM b JOIN g ON b.key = g.key)
SELECT key, value, round({_vb('(n + 1)', 'u', 'nm')} - {_vb('n', 'u', 'nm')} + {D.term('c')} - {D.term('(c - 1)')}, 6) AS add_delta,
round(-({_vb('n', 'u', 'nm')} - {_vb('(n - 1)', '(CASE WHEN c = 1 THEN u - 1 ELSE u END)', 'nm')} + CASE WHEN c = 1 THEN {D.term('0')} ELSE {D.term('(c - 1)')} - {D.term('(greatest(c, 2) - 2)')} END), 6) AS remove_delta FROM j"""


@query(_DELTAS)
def block_delta_add_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = blocks.block_deltas(blocks.value_blocks(R.lineitem(spark, sf_dir)), ["key"])
    return out.select("key", "value", r6("add_delta").alias("add_delta"), r6("remove_delta").alias("remove_delta"))


@query(f"WITH cells AS ({D.EVENTS}), b AS (SELECT key, value, count(*) AS c FROM cells GROUP BY 1, 2) SELECT key, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS entropy FROM b GROUP BY key")
def block_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.entropy(blocks.value_blocks(R.events(spark, sf_dir)), ["key"]).select("key", r6("entropy").alias("entropy"))


@query(f"""WITH cells AS ({D.EVENTS}), l AS (SELECT event_id AS rec_id, event_type AS label FROM events), j AS (SELECT * FROM cells JOIN l USING (rec_id)),
b AS (SELECT label, key, value, count(*) AS c FROM j GROUP BY 1, 2, 3), g AS (SELECT label, key, sum(c) AS n, count(*) AS u, sum({D.term('c')}) AS k FROM b GROUP BY 1, 2), m AS (SELECT label, count(*) AS t FROM l GROUP BY 1)
SELECT g.label, round(sum({D.ktblock('k', 'n', 'u')} + {D.col('n', 't')}), 6) AS bits FROM g JOIN m ON g.label = m.label GROUP BY g.label""")
def partition_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = R.table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("rec_id"), F.col("event_type").alias("label"))
    return blocks.partition_bits(R.events(spark, sf_dir), labels).select("label", r6("bits").alias("bits"))


@query(f"""WITH p AS (SELECT p_partkey AS k FROM part WHERE p_partkey > 0) SELECT k, round({D.universal('k')}, 6) AS universal, CAST(2 * floor(log2(k + 1)) + 1 AS DOUBLE) AS gamma,
round({D.col('k', '2 * k')}, 6) AS column_bits, round({D.support('k', '2 * k')}, 6) AS support_bits, round({D.price('k', '3.0', '(2 * k)', '4.0', '2.0', '9.0')}, 6) AS price,
round(log2((2 * k - 1 - k + 0.5) / (k + 0.5)), 6) AS attach FROM p""")
def integer_and_price_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return R.table(spark, sf_dir, "part").filter("p_partkey > 0").select(
        k.alias("k"), r6(B.universal_int(k)).alias("universal"), B.elias_gamma(k).alias("gamma"), r6(B.column_bits(k, 2 * k)).alias("column_bits"),
        r6(B.support_bits(k, 2 * k)).alias("support_bits"), r6(B.node_price(k, F.lit(3.0), 2 * k, F.lit(4.0), F.lit(2.0), F.lit(9.0))).alias("price"), r6(B.attach_bits(k, 2 * k)).alias("attach"))


@query(f"""WITH t AS (SELECT n, t FROM (SELECT unnest(range(1, 41)) AS n) CROSS JOIN (SELECT unnest(range(0, 41)) AS t) WHERE t <= n)
SELECT CAST(n AS BIGINT) AS n, round(sum(pow(2, {D.choose('n', 't')} - {D.col('t', 'n')})), 6) AS mass FROM t GROUP BY n""")
def kraft_column_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of all columns of n places take one unit of probability."""
    n = spark.range(1, 41).withColumnRenamed("id", "n")
    t = n.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("n").cast("int"))))
    return t.groupBy("n").agg(r6(F.sum(F.pow(F.lit(2.0), B.log2_choose("n", "t") - B.column_bits("t", "n")))).alias("mass"))


@query(f"WITH k AS (SELECT unnest(range(1, 100001)) AS k) SELECT round(sum(pow(2, -{D.universal('k')})), 6) AS universal, round(sum(pow(2, -(2 * floor(log2(k)) + 1))), 6) AS gamma FROM k")
def kraft_integer_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = spark.range(1, 100_001)
    return k.agg(r6(F.sum(F.pow(F.lit(2.0), -B.universal_int("id")))).alias("universal"), r6(F.sum(F.pow(F.lit(2.0), -B.elias_gamma(F.col("id") - 1)))).alias("gamma"))


@query("""WITH RECURSIVE g AS (SELECT n FROM (SELECT unnest([5, 20, 100]) AS n)),
two AS (SELECT n, sum(exp(lgamma(n + 1.0) - lgamma(h + 1.0) - lgamma(n - h + 1.0) + CASE WHEN h > 0 THEN h * ln(h / n) ELSE 0 END + CASE WHEN n - h > 0 THEN (n - h) * ln((n - h) / n) ELSE 0 END)) AS c FROM (SELECT CAST(n AS DOUBLE) AS n, CAST(unnest(range(0, n + 1)) AS DOUBLE) AS h FROM g) GROUP BY n),
r AS (SELECT n, 2 AS k, CAST(1 AS DOUBLE) AS before, c AS now FROM two UNION ALL SELECT n, k + 1, now, now + n / (k - 1) * before FROM r WHERE k < 6)
SELECT CAST(n AS INTEGER) AS n, k, round(log2(now), 6) AS bits FROM r""")
def nml_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.createDataFrame([(n, k) for n in (5, 20, 100) for k in range(2, 7)], "n int, k int")
    return grid.select("n", "k", r6(B.nml_complexity("n", "k")).alias("bits"))


@query(f"""WITH l AS (SELECT l_orderkey % 50 + 2 AS a, l_linenumber AS b FROM lineitem), m AS (SELECT a, b, count(*) AS n FROM l GROUP BY 1, 2)
SELECT CAST(a AS BIGINT) AS a, b, n, round(least(a + 1.0, b + 1.0) - log2(1 + pow(2, -abs(a - b + 0.0))), 6) AS mixture, CASE WHEN n >= 100 THEN 'head' WHEN n >= 10 THEN 'mid' WHEN n >= 2 THEN 'tail' ELSE 'singleton' END AS stratum FROM m""")
def mixture_and_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = R.table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 50 + 2).alias("a"), F.col("l_linenumber").alias("b")).agg(F.count("*").alias("n"))
    return m.select("a", "b", "n", r6(B.mixture_bits("a", "b")).alias("mixture"), T.stratum("n").alias("stratum"))


# relations between keys


@query(f"WITH cells AS ({D.MIXED}), {D.PAIRS} SELECT key_a, key_b, both_n AS both_records FROM pr")
def cooccurring_key_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.cooccurring_pairs(R.mixed(spark, sf_dir)).select("key_a", "key_b", F.col("both").alias("both_records"))


_SYN = "SELECT rec_id, CASE WHEN key = 'nation' AND rec_id % 2 = 0 THEN 'country' ELSE key END AS key, value FROM ({})"
_SYN2 = "SELECT rec_id, CASE WHEN key = 'region' AND rec_id % 2 = 0 THEN 'area' ELSE key END AS key, value FROM ({})"


@query(f"WITH cells AS ({_SYN2.format(_SYN.format(D.CUSTOMER))}), {D.PAIRS} SELECT key_a, key_b, shared, values_a, values_b FROM shv")
def value_sharing_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.value_sharing_pairs(_more_synonym_cells(spark, sf_dir))


def _synonym_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, with the nation of every second one under another key."""
    return R.customer(spark, sf_dir).withColumn("key", F.when((F.col("key") == "nation") & (F.col("rec_id") % 2 == 0), "country").otherwise(F.col("key")))


def _more_synonym_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with the region of every second customer under another key too."""
    return _synonym_cells(spark, sf_dir).withColumn("key", F.when((F.col("key") == "region") & (F.col("rec_id") % 2 == 0), "area").otherwise(F.col("key")))


@query(f"WITH cells AS ({_SYN.format(D.CUSTOMER)}), {D.PAIRS} SELECT s.key_a, s.key_b, shared, x.n AS n_a, y.n AS n_b FROM shv s JOIN kn x ON x.key = key_a JOIN kn y ON y.key = key_b WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.key_a = s.key_a AND pr.key_b = s.key_b) AND x.n + y.n >= 7")
def candidate_key_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.merge_candidates(_synonym_cells(spark, sf_dir)).select("key_a", "key_b", "shared", "n_a", "n_b")


_MERGE = f"""WITH cells AS ({_SYN.format(D.CUSTOMER)}), {D.PAIRS}, c AS (SELECT key, value, count(*) AS c FROM cells GROUP BY 1, 2),
cand AS (SELECT s.key_a, s.key_b FROM shv s JOIN kn x ON x.key = key_a JOIN kn y ON y.key = key_b WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.key_a = s.key_a AND pr.key_b = s.key_b) AND x.n + y.n >= 7),
own AS (SELECT key, sum(c) AS n, count(*) AS u, sum({D.term('(c - 1)')}) AS s FROM c GROUP BY key),
bv AS (SELECT key_a, key_b, value, sum(CASE WHEN key = key_a THEN c ELSE 0 END) AS a, sum(CASE WHEN key = key_b THEN c ELSE 0 END) AS b FROM cand JOIN c ON key IN (key_a, key_b) GROUP BY 1, 2, 3),
jn AS (SELECT key_a, key_b, sum(a + b) AS mn, count(*) AS mu, sum({D.term('(a + b - 1)')}) AS ms, sum({D.col('least(a, b)', '(a + b)')}) AS spelling FROM bv GROUP BY 1, 2),
one AS (SELECT (SELECT count(DISTINCT rec_id) FROM cells) AS records, (SELECT count(DISTINCT key) FROM cells) AS keys, (SELECT count(*) FROM pr) AS met)
SELECT key_a, key_b, round(spelling, 6) AS spelling_bits, round({D.vblock('ms', 'mn', 'mu', D.naming('mu'))} - {D.vblock('x.s', 'x.n', 'x.u', D.naming('x.u'))} - {D.vblock('y.s', 'y.n', 'y.u', D.naming('y.u'))}
+ {D.col('mn', 'records')} - {D.col('x.n', 'records')} - {D.col('y.n', 'records')} + spelling + log2(greatest(keys * (keys - 1) / 2 - met, 1)), 6) AS delta
FROM jn JOIN own x ON x.key = key_a JOIN own y ON y.key = key_b CROSS JOIN one"""


@query(_MERGE)
def key_merge_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.merge_deltas(_synonym_cells(spark, sf_dir)).select("key_a", "key_b", r6("spelling_bits").alias("spelling_bits"), r6("delta").alias("delta"))


_SPECIAL = "SELECT rec_id, key, value FROM ({c}) UNION ALL SELECT rec_id, 'in_' || value, '1' FROM ({c}) WHERE key = 'segment' UNION ALL SELECT rec_id, 'loc', '1' FROM ({c}) WHERE key = 'region' AND rec_id % 3 <> 0"


def _special_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with keys that only some records have: one for each segment, and one for two thirds."""
    c = R.customer(spark, sf_dir)
    seg = c.filter("key = 'segment'").select("rec_id", F.concat(F.lit("in_"), "value").alias("key"), F.lit("1").alias("value"))
    loc = c.filter("key = 'region' AND rec_id % 3 <> 0").select("rec_id", F.lit("loc").alias("key"), F.lit("1").alias("value"))
    return c.unionByName(seg).unionByName(loc)


_IMPLIED = f"""WITH cells AS ({_SPECIAL.format(c=D.CUSTOMER)}), {D.PAIRS}, bo AS (SELECT key_a AS child, key_b AS parent, both_n FROM pr UNION ALL SELECT key_b, key_a, both_n FROM pr),
im AS (SELECT child, parent, both_n, x.n AS n_child, y.n AS n_parent FROM bo JOIN kn x ON x.key = child JOIN kn y ON y.key = parent WHERE x.n >= 20 AND both_n >= 0.95 * x.n AND y.n > x.n)"""


@query(_IMPLIED + " SELECT child, parent, both_n AS both_records, n_child, n_parent FROM im")
def key_implications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.implications(_special_cells(spark, sf_dir)).select("child", "parent", F.col("both").alias("both_records"), "n_child", "n_parent")


@query(_IMPLIED + " SELECT DISTINCT a.child AS key_a, b.child AS key_b FROM im a JOIN im b ON a.parent = b.parent AND a.child < b.child WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.key_a = a.child AND pr.key_b = b.child)")
def key_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _special_cells(spark, sf_dir)
    return mining.siblings(cells, mining.implications(cells))


@query(f"WITH cells AS ({_SYN2.format(_SYN.format(D.CUSTOMER))}), {D.PAIRS} SELECT s.key_a, s.key_b, round(shared / (values_a + values_b - shared), 6) AS jaccard FROM shv s JOIN kn x ON x.key = key_a JOIN kn y ON y.key = key_b WHERE shared / (values_a + values_b - shared) >= 0.9 AND x.n >= 20 AND y.n >= 20 AND NOT EXISTS (SELECT 1 FROM pr WHERE pr.key_a = s.key_a AND pr.key_b = s.key_b)")
def key_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.synonyms(_more_synonym_cells(spark, sf_dir)).select("key_a", "key_b", r6("jaccard").alias("jaccard"))


@query(f"""WITH cells AS ({D.CUSTOMER}), jt AS (SELECT a.key AS a, b.key AS b, a.value AS va, b.value AS vb, count(*) AS c FROM cells a JOIN cells b ON a.rec_id = b.rec_id AND a.key <> b.key GROUP BY 1, 2, 3, 4),
tp AS (SELECT a, b, va, max(c) AS top, sum(c) AS n, arg_min(vb, struct_pack(m := -c, v := vb)) AS image FROM jt GROUP BY 1, 2, 3)
SELECT a, b, CAST(sum(n) AS BIGINT) AS n, round(sum(top) / sum(n), 6) AS determinism, count(*) AS values_a, count(DISTINCT image) AS images FROM tp GROUP BY 1, 2 HAVING sum(n) >= 20 AND sum(top) / sum(n) >= 0.99 AND count(DISTINCT image) > 1""")
def functional_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.dependencies(R.customer(spark, sf_dir)).select("a", "b", "n", r6("determinism").alias("determinism"), "values_a", "images")


@query(f"""WITH cells AS ({D.CUSTOMER}), co AS (SELECT a.key, a.value, count(DISTINCT b.key) AS co_keys, count(DISTINCT b.key || '=' || b.value) AS co_values FROM cells a JOIN cells b ON a.rec_id = b.rec_id AND a.key <> b.key GROUP BY 1, 2)
SELECT c.key, c.value, c.records, coalesce(co_keys, 0) AS co_keys, coalesce(co_values, 0) AS co_values FROM (SELECT key, value, count(*) AS records FROM cells GROUP BY 1, 2) c LEFT JOIN co ON co.key = c.key AND co.value = c.value""")
def behaviour_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.behaviour(R.customer(spark, sf_dir))


@query(f"WITH cells AS ({D.MIXED}), b AS (SELECT key, value, count(*) AS c FROM cells GROUP BY 1, 2) SELECT count(*) AS pairs, round(avg(c), 6) AS average, max(c) AS greatest FROM b")
def recurrence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.recurrence(R.mixed(spark, sf_dir)).select("pairs", r6("average").alias("average"), "greatest")


@query(f"WITH cells AS ({D.MIXED}) SELECT truth, max(c) AS best FROM (SELECT truth, key, value, count(*) AS c FROM cells GROUP BY 1, 2, 3) GROUP BY truth")
def seed_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = R.mixed(spark, sf_dir)
    return mining.seed_cohorts(cells.drop("truth"), cells.select("rec_id", "truth").distinct())


@query(f"WITH cells AS ({D.MIXED}), {D.PAIRS} SELECT kn.key, n AS records, coalesce(co.c, 0) AS co_keys FROM kn LEFT JOIN (SELECT key, count(*) AS c FROM (SELECT key_a AS key FROM pr UNION ALL SELECT key_b FROM pr) GROUP BY key) co ON co.key = kn.key")
def support_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.geometry(R.mixed(spark, sf_dir))


@query(f"WITH cells AS ({D.MIXED}), b AS (SELECT key, value, count(*) AS c FROM cells GROUP BY 1, 2) SELECT key, rnk AS rank, value, c FROM (SELECT *, CAST(row_number() OVER (PARTITION BY key ORDER BY c DESC, value) AS INTEGER) AS rnk FROM b) WHERE rnk <= 3")
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.top_values(R.mixed(spark, sf_dir)).select("key", "rank", "value", "c")


@query(f"""WITH cells AS ({D.MIXED}), o AS (SELECT key, value, count(*) AS c FROM cells GROUP BY 1, 2), b AS (SELECT truth, max(c) AS best FROM (SELECT truth, key, value, count(*) AS c FROM cells GROUP BY 1, 2, 3) GROUP BY truth),
x AS (SELECT count(*) AS pairs, count(*) FILTER (WHERE c >= 20) AS pairs_enough, round(avg(CASE WHEN c >= 20 THEN 1.0 ELSE 0 END), 6) AS share_enough, round(avg(CASE WHEN c = 1 THEN 1.0 ELSE 0 END), 6) AS share_once FROM o),
y AS (SELECT min(best) AS cohort_min, CAST(median(best) AS DOUBLE) AS cohort_median, count(*) FILTER (WHERE best >= 20) AS kinds_reachable, count(*) AS kinds FROM b) SELECT * FROM x CROSS JOIN y""")
def stream_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = R.mixed(spark, sf_dir)
    out = evidence.stream_stats(cells.drop("truth"), cells.select("rec_id", "truth").distinct(), 20)
    return out.withColumns({c: r6(c) for c in ("share_enough", "share_once")})


@query("SELECT r_subset AS subset, coalesce(string_agg(r_name, ',' ORDER BY r_regionkey), '') AS names FROM (SELECT unnest(range(0, CAST(pow(2, (SELECT count(*) FROM region)) AS BIGINT))) AS r_subset) LEFT JOIN region ON (r_subset >> r_regionkey) & 1 = 1 GROUP BY r_subset")
def region_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = R.table(spark, sf_dir, "region").agg(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))), lambda r: r["r_name"]).alias("names"))
    return names.select(F.posexplode(evidence.subsets("names")).alias("subset", "names")).select(F.col("subset").cast("long").alias("subset"), F.array_join("names", ",").alias("names"))


# strings


@query("WITH t AS (SELECT p_partkey, unnest(list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: length(x) >= 2))) AS token FROM part) SELECT token, count(*) AS n_rows FROM t GROUP BY token HAVING count(*) >= 2")
def name_token_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.token_frequency(R.table(spark, sf_dir, "part"), "p_name").withColumnRenamed("rows", "n_rows")


@query("""WITH n AS (SELECT DISTINCT name FROM (SELECT n_name AS name FROM nation UNION ALL SELECT upper(r_name) || 'S' FROM region UNION ALL SELECT lower(r_name) FROM region UNION ALL SELECT r_name FROM region)),
k AS (SELECT name, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS k FROM n),
c AS (SELECT name, CASE WHEN k LIKE '%es' AND length(k) > 4 THEN left(k, length(k) - 2) WHEN k LIKE '%s' AND length(k) > 3 THEN left(k, length(k) - 1) ELSE k END AS canonical FROM k)
SELECT canonical, string_agg(name, '|' ORDER BY name) AS names, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS pairs FROM c WHERE canonical <> '' GROUP BY canonical HAVING count(*) > 1""")
def key_name_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.table(spark, sf_dir, "region").select("r_name")
    names = R.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).unionByName(r.select(F.concat(F.upper("r_name"), F.lit("S")).alias("name"))).unionByName(r.select(F.lower("r_name").alias("name"))).unionByName(r.select(F.col("r_name").alias("name")))
    return mining.name_variants(names).select("canonical", F.array_join("names", "|").alias("names"), "pairs")


@query("""WITH n AS (SELECT DISTINCT n_name AS name FROM nation), g AS (SELECT name, gram, count(*) AS c FROM (SELECT name, unnest(list_concat(list_concat(
list_transform(range(1, greatest(length(name) - 1, 1)), lambda i: substr(lower(name), i, 3)), list_transform(range(1, greatest(length(name) - 2, 1)), lambda i: substr(lower(name), i, 4))), list_transform(range(1, greatest(length(name) - 3, 1)), lambda i: substr(lower(name), i, 5)))) AS gram FROM n) GROUP BY 1, 2),
q AS (SELECT name, sum(c * c) AS q FROM g GROUP BY 1), d AS (SELECT a.name AS name_a, b.name AS name_b, sum(a.c * b.c) AS d FROM g a JOIN g b ON a.gram = b.gram AND a.name < b.name GROUP BY 1, 2)
SELECT name_a, name_b, round(d / sqrt(CAST(x.q AS DOUBLE) * y.q), 6) AS cosine FROM d JOIN q x ON x.name = name_a JOIN q y ON y.name = name_b WHERE d / sqrt(CAST(x.q AS DOUBLE) * y.q) >= 0.1""")
def char_ngram_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.ngram_cosine(R.table(spark, sf_dir, "nation"), "n_name", least=0.1).select("name_a", "name_b", r6("cosine").alias("cosine"))


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part), t AS (SELECT name, list_distinct(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda x: length(x) >= 2)) AS ts FROM n), e AS (SELECT name, len(ts) AS n, unnest(ts) AS t FROM t),
b AS (SELECT a.name AS name_a, b.name AS name_b, a.n AS na, b.n AS nb, count(*) AS both_n FROM e a JOIN e b ON a.t = b.t AND a.name < b.name GROUP BY 1, 2, 3, 4)
SELECT name_a, name_b, round(both_n / (na + nb - both_n), 6) AS jaccard FROM b WHERE both_n / (na + nb - both_n) >= 0.3""")
def token_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.token_jaccard(R.table(spark, sf_dir, "part"), "p_name").select("name_a", "name_b", r6("jaccard").alias("jaccard"))


@query("SELECT a.n_name AS name_a, b.n_name AS name_b, round(1 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name)), 6) AS similarity FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name")
def edit_similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = R.table(spark, sf_dir, "nation").select("n_name", "n_regionkey")
    j = n.select(F.col("n_name").alias("name_a"), "n_regionkey").join(n.select(F.col("n_name").alias("name_b"), "n_regionkey"), "n_regionkey").filter("name_a < name_b")
    return j.select("name_a", "name_b", r6(T.edit_similarity("name_a", "name_b")).alias("similarity"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 = 0 THEN CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS DOUBLE) * 60 + 7 END AS seconds FROM events WHERE lower(trim(event_type)) NOT IN ('', 'null', 'unknown', 'none', 'nan', 'n/a', '-')")
def json_props_and_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    clock = F.when(k.cast("int") % 4 == 0, F.concat(k, F.lit(":07"))).otherwise("soon")
    return R.table(spark, sf_dir, "events").filter(~T.is_missing("event_type")).select("event_id", k.alias("k"), T.parse_duration(clock).alias("seconds"))


@query("SELECT p_partkey, p_brand AS brand, array_to_string(list_sort([CAST(p_size AS VARCHAR), p_type]), ', ') AS kinds FROM part")
def spec_map_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat(F.lit("{brand=["), "p_brand", F.lit("], kinds=["), F.col("p_size").cast("string"), F.lit(", "), "p_type", F.lit("]}"))
    m = T.parse_specs(s)
    return R.table(spark, sf_dir, "part").select("p_partkey", F.element_at(m, "brand").alias("brand"), F.element_at(m, "kinds").alias("kinds"))


@query("SELECT page_id, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang, CAST(length(html) - length(replace(html, '<p>', '')) AS BIGINT) // 3 AS paragraphs, md5(html) AS digest FROM pages")
def page_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"), F.floor((F.length("html") - F.length(F.replace("html", F.lit("<p>"), F.lit("")))) / 3).cast("long").alias("paragraphs"), F.md5(F.col("html").cast("binary")).alias("digest"))


# scores


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return d.select(F.col("doc_id").alias("rec_id"), F.col("lang").alias("truth"), F.pmod(F.col("doc_id"), F.lit(7)).alias("m"), "source").withColumn("label", F.when(F.col("m") < 3, F.col("truth")).otherwise(F.col("source"))).drop("m", "source")


_LAB = "l AS (SELECT doc_id AS rec_id, lang AS truth, CASE WHEN doc_id % 7 < 3 THEN lang ELSE source END AS label FROM documents), c AS (SELECT truth, label, count(*) AS n FROM l GROUP BY 1, 2), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS both_n, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY label)) AS il, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY truth)) AS it, (SELECT sum(n) FROM c) AS nn)"


@query(f"WITH {_LAB} SELECT round((both_n - il * it / (nn * (nn - 1) / 2)) / ((il + it) / 2 - il * it / (nn * (nn - 1) / 2)), 6) AS ari FROM s")
def adjusted_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.adjusted_rand(_labelled(spark, sf_dir)).select(r6("ari").alias("ari"))


@query(f"WITH {_LAB} SELECT round(both_n / il, 6) AS precision, round(both_n / it, 6) AS recall, round(2 * both_n / (il + it), 6) AS f1 FROM s")
def pairwise_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pairwise(_labelled(spark, sf_dir)).select(*[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {_LAB}, per AS (SELECT label, sum(n) AS size, max(n) AS top, count(*) AS k FROM c GROUP BY label) SELECT count(*) AS clusters, round(sum(top) / sum(size), 6) AS purity, count(*) FILTER (WHERE k > 1) AS wrong_merges, count(*) FILTER (WHERE size = 1) AS singletons, round(max(size) / sum(size), 6) AS largest_share, (SELECT count(DISTINCT truth) FROM c) AS kinds FROM per")
def cluster_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cluster_metrics(_labelled(spark, sf_dir)).select("clusters", r6("purity").alias("purity"), "wrong_merges", "singletons", r6("largest_share").alias("largest_share"), "kinds")


def _covers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two covers of the benchmark items."""
    b = R.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("rec_id"))
    t = b.select("rec_id", F.explode(F.array(F.col("rec_id") % 5, F.col("rec_id") % 3 + 10)).alias("group"))
    p = b.select("rec_id", F.explode(F.array(F.col("rec_id") % 5, F.col("rec_id") % 4 + 20)).alias("group"))
    return t, p


_COV = "t AS (SELECT item_id AS rec_id, item_id % 5 AS g FROM benchmark UNION ALL SELECT item_id, item_id % 3 + 10 FROM benchmark), p AS (SELECT item_id AS rec_id, item_id % 5 AS g FROM benchmark UNION ALL SELECT item_id, item_id % 4 + 20 FROM benchmark)"


@query(f"""WITH {_COV}, tt AS (SELECT a.rec_id AS x, b.rec_id AS y, count(*) AS t FROM t a JOIN t b ON a.g = b.g AND a.rec_id < b.rec_id GROUP BY 1, 2), pp AS (SELECT a.rec_id AS x, b.rec_id AS y, count(*) AS p FROM p a JOIN p b ON a.g = b.g AND a.rec_id < b.rec_id GROUP BY 1, 2),
a AS (SELECT m.item_id AS x, n.item_id AS y FROM benchmark m JOIN benchmark n ON m.item_id < n.item_id), j AS (SELECT coalesce(t, 0) AS t, coalesce(p, 0) AS p FROM a LEFT JOIN tt USING (x, y) LEFT JOIN pp USING (x, y)),
o AS (SELECT avg(CASE WHEN t = p THEN 1.0 ELSE 0 END) AS obs FROM j), e AS (SELECT sum(nt * np) / pow((SELECT count(*) FROM j), 2) AS ex FROM (SELECT t AS k, count(*) AS nt FROM j GROUP BY 1) JOIN (SELECT p AS k, count(*) AS np FROM j GROUP BY 1) USING (k))
SELECT round((obs - ex) / (1 - ex), 6) AS omega FROM o CROSS JOIN e""")
def omega_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, p = _covers(spark, sf_dir)
    return metrics.omega(t, p, R.table(spark, sf_dir, "benchmark").count()).select(r6("omega").alias("omega"))


@query(f"""WITH {_COV}, o AS (SELECT t.g AS gold, p.g AS grp, count(*) AS both_n FROM t JOIN p ON t.rec_id = p.rec_id GROUP BY 1, 2), b AS (SELECT grp, arg_min(gold, struct_pack(m := -both_n, v := gold)) AS gold FROM o GROUP BY grp),
n AS (SELECT DISTINCT rec_id, gold AS g FROM p JOIN b ON p.g = b.grp), x AS (SELECT (SELECT count(*) FROM n JOIN t USING (rec_id, g)) AS tp, (SELECT count(*) FROM n) AS pr, (SELECT count(*) FROM t) AS go)
SELECT round(tp / pr, 6) AS precision, round(tp / go, 6) AS recall, round(2 * (tp / pr) * (tp / go) / (tp / pr + tp / go), 6) AS f1 FROM x""")
def membership_many_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, p = _covers(spark, sf_dir)
    return metrics.membership_many_to_one(t, p).select(*[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {_COV}, s AS (SELECT g, count(*) AS t FROM p GROUP BY g) SELECT CAST(item_id AS BIGINT) AS rec_id, coalesce((SELECT arg_min(p.g, struct_pack(m := -t, v := p.g)) FROM p JOIN s ON s.g = p.g WHERE p.rec_id = item_id), -1) AS label FROM benchmark")
def record_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, p = _covers(spark, sf_dir)
    return metrics.largest_group_labels(p, R.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("rec_id")))


@query(f"WITH {_COV}, s AS (SELECT g, count(*) AS t, min(rec_id) AS birth FROM p GROUP BY g) SELECT CAST(p.rec_id AS BIGINT) AS rec_id, arg_min(p.g, struct_pack(m := t, v := p.g)) AS smallest, arg_min(p.g, struct_pack(m := birth, v := p.g)) AS earliest FROM p JOIN s ON s.g = p.g GROUP BY p.rec_id")
def record_labels_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, p = _covers(spark, sf_dir)
    by = [metrics.largest_group_labels(p, p.select("rec_id").distinct(), rule).withColumnRenamed("label", rule) for rule in ("smallest", "earliest")]
    return by[0].join(by[1], "rec_id")


@query("""WITH r AS (SELECT 0 AS run, doc_id, lang AS label FROM documents UNION ALL SELECT 1, doc_id, source FROM documents UNION ALL SELECT 2, doc_id, CASE WHEN doc_id % 7 < 3 THEN lang ELSE source END FROM documents),
c AS (SELECT a.run AS ra, b.run AS rb, a.label AS la, b.label AS lb, count(*) AS n FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.run < b.run GROUP BY 1, 2, 3, 4),
s AS (SELECT ra, rb, sum(n * (n - 1) / 2) AS both_n, sum(n) * (sum(n) - 1) / 2 AS every FROM c GROUP BY 1, 2), x AS (SELECT ra, rb, sum(n * (n - 1) / 2) AS i FROM (SELECT ra, rb, la, sum(n) AS n FROM c GROUP BY 1, 2, 3) GROUP BY 1, 2), y AS (SELECT ra, rb, sum(n * (n - 1) / 2) AS i FROM (SELECT ra, rb, lb, sum(n) AS n FROM c GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT ra AS run_a, rb AS run_b, round((both_n - x.i * y.i / every) / ((x.i + y.i) / 2 - x.i * y.i / every), 6) AS ari FROM s JOIN x USING (ra, rb) JOIN y USING (ra, rb)""")
def pairwise_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rec_id"), "lang", "source")
    labels = ("lang", "source", F.when(F.pmod(F.col("rec_id"), F.lit(7)) < 3, F.col("lang")).otherwise(F.col("source")))
    runs = [d.select(F.lit(k).alias("run"), "rec_id", (F.col(x) if isinstance(x, str) else x).alias("label")) for k, x in enumerate(labels)]
    return evidence.pairwise_rand(runs[0].unionByName(runs[1]).unionByName(runs[2])).select("run_a", "run_b", r6("ari").alias("ari"))


@query("SELECT round(corr(p_size, p_retailprice), 6) AS pearson FROM part")
def pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.pearson(R.table(spark, sf_dir, "part"), "p_size", "p_retailprice").select(r6("pearson").alias("pearson"))


@query("SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, CAST(min(l_quantity) AS DOUBLE) AS least, CAST(max(l_quantity) AS DOUBLE) AS greatest FROM lineitem GROUP BY l_returnflag")
def quantity_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("q"))
    return evidence.spread(rows, ["l_returnflag"], "q").withColumn("mean", r6("mean"))


@query("WITH f AS (SELECT 'l_discount' AS feature, CAST(l_discount AS DOUBLE) AS x FROM lineitem UNION ALL SELECT 'l_tax', CAST(l_tax AS DOUBLE) FROM lineitem UNION ALL SELECT 'l_quantity', CAST(l_quantity AS DOUBLE) FROM lineitem) SELECT feature, round(avg(CASE WHEN x = 0 THEN 1.0 ELSE 0 END), 6) AS share_zero, count(DISTINCT x) AS distinct_values, max(x) AS greatest, count(DISTINCT x) > 20 AND avg(CASE WHEN x = 0 THEN 1.0 ELSE 0 END) < 0.95 AS usable FROM f WHERE x IS NOT NULL GROUP BY feature")
def feature_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.feature_resolution(R.table(spark, sf_dir, "lineitem"), ["l_discount", "l_tax", "l_quantity"]).withColumn("share_zero", r6("share_zero"))


_PAIRDEC = "d AS (SELECT CASE WHEN c_acctbal > 5000 THEN 'rich' WHEN c_acctbal > 0 THEN 'plain' ELSE 'debt' END AS stratum, c_custkey % 3 = 0 AS gold, c_custkey % 2 = 0 AS predicted FROM customer)"


@query(f"""WITH {_PAIRDEC}, c AS (SELECT coalesce(stratum, 'ALL') AS stratum, count(*) FILTER (WHERE gold AND predicted) AS tp, count(*) FILTER (WHERE NOT gold AND predicted) AS fp, count(*) FILTER (WHERE gold AND NOT predicted) AS fn FROM d GROUP BY ROLLUP (stratum))
SELECT stratum, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def stratified_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.when(F.col("c_acctbal") > 5000, "rich").when(F.col("c_acctbal") > 0, "plain").otherwise("debt")
    d = R.table(spark, sf_dir, "customer").select(band.alias("stratum"), (F.col("c_custkey") % 3 == 0).alias("gold"), (F.col("c_custkey") % 2 == 0).alias("predicted"))
    return metrics.stratified_confusion(d).select("stratum", "tp", "fp", "fn", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query("WITH d AS (SELECT c_custkey, c_acctbal AS score, c_custkey % 5 = 0 AS good FROM customer), t AS (SELECT * FROM d ORDER BY score DESC, c_custkey LIMIT 50) SELECT round(avg(CASE WHEN good THEN 1.0 ELSE 0 END), 6) AS precision, round(avg(CASE WHEN good THEN 1.0 ELSE 0 END) / (SELECT avg(CASE WHEN good THEN 1.0 ELSE 0 END) FROM d), 6) AS lift, count(*) FILTER (WHERE good) AS hits FROM t")
def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("score"), (F.col("c_custkey") % 5 == 0).alias("good"))
    return metrics.precision_at_k(d, "score", "good", 50, "c_custkey").select(r6("precision").alias("precision"), r6("lift").alias("lift"), "hits")


@query("WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS rx, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS ry FROM part) SELECT round(corr(rx, ry), 6) AS spearman FROM r")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.spearman(R.table(spark, sf_dir, "part"), "p_size", "p_retailprice").select(r6("spearman").alias("spearman"))


@query("""WITH r AS (SELECT run, CAST(n_nationkey AS BIGINT) AS rec_id, CASE run WHEN 0 THEN n_regionkey WHEN 1 THEN n_nationkey % 5 ELSE n_nationkey % 3 END AS label, n_regionkey AS truth FROM nation CROSS JOIN (SELECT unnest([0, 1, 2]) AS run)),
t AS (SELECT a.rec_id AS x, b.rec_id AS y, count(*) AS together, bool_and(a.truth = b.truth) AS same FROM r a JOIN r b ON a.run = b.run AND a.label = b.label AND a.rec_id < b.rec_id GROUP BY 1, 2)
SELECT together, count(*) AS pairs, round(avg(CASE WHEN same THEN 1.0 ELSE 0 END), 6) AS same FROM t GROUP BY together""")
def confidence_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = R.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("rec_id"), F.col("n_regionkey").alias("truth"))
    runs = [n.select(F.lit(k).alias("run"), "rec_id", label.cast("int").alias("label")) for k, label in enumerate((F.col("truth"), F.col("rec_id") % 5, F.col("rec_id") % 3))]
    return metrics.calibration(runs[0].unionByName(runs[1]).unionByName(runs[2]), n).select("together", "pairs", r6("same").alias("same"))


# the objective


def _types_state(spark: SparkSession, sf_dir: str) -> objective.State:
    labels = R.table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("rec_id"), F.when(F.col("event_type") != "purchase", F.col("event_type")).alias("label"))
    return objective.from_partition(R.events(spark, sf_dir), labels)


_STATE = f"""cells AS ({D.EVENTS}), m AS (SELECT CAST(event_id AS BIGINT) AS rec_id, event_type AS node FROM events WHERE event_type <> 'purchase'), ow AS (SELECT node, rec_id, key, value FROM cells JOIN m USING (rec_id)), su AS (SELECT DISTINCT node, key FROM ow),
tot AS (SELECT count(DISTINCT rec_id) AS n, count(DISTINCT key) AS a FROM cells), inv AS (SELECT key, count(DISTINCT value) AS inv, count(*) AS p FROM cells GROUP BY key), tt AS (SELECT node, count(*) AS t FROM m GROUP BY node),
ob AS (SELECT node, key, value, count(*) AS c FROM ow GROUP BY 1, 2, 3), og AS (SELECT node, key, sum(c) AS n, count(*) AS u, sum({D.term('(c - 1)')}) AS s FROM ob GROUP BY 1, 2),
nv AS (SELECT node, sum({D.vblock('s', 'n', 'u', D.naming('inv'))}) AS v, sum({D.col('n', 't')}) AS pres, count(*) AS size FROM og JOIN inv USING (key) JOIN tt USING (node) GROUP BY node),
nt AS (SELECT node, {D.col('t', 'n')} + {D.support('size', 'a')} AS st, pres, v FROM nv JOIN tt USING (node) CROSS JOIN tot),
cov AS (SELECT key, count(*) AS covered FROM su JOIN m USING (node) GROUP BY key), pub AS (SELECT key, count(*) AS pub FROM ow GROUP BY key),
fb AS (SELECT key, value, count(*) AS c FROM cells WHERE rec_id NOT IN (SELECT rec_id FROM m) GROUP BY 1, 2), fg AS (SELECT key, sum(c) AS n, count(*) AS u, sum({D.term('(c - 1)')}) AS s FROM fb GROUP BY key),
bt AS (SELECT inv.key, CASE WHEN tot.n - coalesce(covered, 0) > 0 THEN {D.col('least(p - coalesce(pub, 0), tot.n - coalesce(covered, 0))', '(tot.n - coalesce(covered, 0))')} ELSE 0 END AS bp, coalesce({D.vblock('fg.s', 'fg.n', 'fg.u', D.naming('inv'))}, 0) AS bv FROM inv LEFT JOIN cov USING (key) LEFT JOIN pub USING (key) LEFT JOIN fg USING (key) CROSS JOIN tot),
k AS (SELECT count(*) AS nodes FROM tt)"""


@query(f"WITH {_STATE} SELECT nodes, round({D.universal('(nodes + 1)')} - CASE WHEN nodes > 1 THEN {D.lg2('nodes + 1')} ELSE 0 END + (SELECT sum(st) FROM nt), 6) AS structure, round((SELECT sum(pres) FROM nt) + (SELECT sum(bp) FROM bt), 6) AS presence, round((SELECT sum(v) FROM nt) + (SELECT sum(bv) FROM bt), 6) AS value_bits FROM k")
def batch_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = objective.total(_types_state(spark, sf_dir))
    return t.select("nodes", r6("structure").alias("structure"), r6("presence").alias("presence"), r6("values").alias("value_bits"))


@query(f"WITH {_STATE} SELECT node, round(st, 6) AS structure, round(pres, 6) AS presence, round(v, 6) AS value_bits FROM nt")
def node_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objective.node_terms(_types_state(spark, sf_dir)).select("node", r6("structure").alias("structure"), r6("presence").alias("presence"), r6("values").alias("value_bits"))


# the total of every state that one delete or merge away from _types_state leads to
_MOVES = f"""cells AS ({D.EVENTS}), m0 AS (SELECT CAST(event_id AS BIGINT) AS rec_id, event_type AS node FROM events WHERE event_type <> 'purchase'), ns AS (SELECT DISTINCT node FROM m0),
mv AS (SELECT '' AS mv, NULL AS a, NULL AS b UNION ALL SELECT node, node, NULL FROM ns UNION ALL SELECT x.node || ' ' || y.node, x.node, y.node FROM ns x JOIN ns y ON x.node < y.node),
m AS (SELECT mv, rec_id, CASE WHEN node = b THEN a ELSE node END AS node FROM m0 CROSS JOIN mv WHERE a IS NULL OR b IS NOT NULL OR node <> a), ow AS (SELECT mv, node, rec_id, key, value FROM cells JOIN m USING (rec_id)), su AS (SELECT DISTINCT mv, node, key FROM ow),
tot AS (SELECT count(DISTINCT rec_id) AS n, count(DISTINCT key) AS a FROM cells), inv AS (SELECT key, count(DISTINCT value) AS inv, count(*) AS p FROM cells GROUP BY key), tt AS (SELECT mv, node, count(*) AS t FROM m GROUP BY 1, 2),
ob AS (SELECT mv, node, key, value, count(*) AS c FROM ow GROUP BY 1, 2, 3, 4), og AS (SELECT mv, node, key, sum(c) AS n, count(*) AS u, sum({D.term('(c - 1)')}) AS s FROM ob GROUP BY 1, 2, 3),
nv AS (SELECT mv, node, sum({D.vblock('s', 'n', 'u', D.naming('inv'))} + {D.col('n', 't')}) AS own, count(*) AS size FROM og JOIN inv USING (key) JOIN tt USING (mv, node) GROUP BY 1, 2),
nt AS (SELECT mv, sum({D.col('t', 'n')} + {D.support('size', 'tot.a')} + own) AS bits, count(*) AS nodes FROM nv JOIN tt USING (mv, node) CROSS JOIN tot GROUP BY mv),
cov AS (SELECT mv, key, count(*) AS covered FROM su JOIN m USING (mv, node) GROUP BY 1, 2), pub AS (SELECT mv, key, count(*) AS pub FROM ow GROUP BY 1, 2),
fb AS (SELECT mv, key, value, count(*) AS c FROM (SELECT mv.mv, rec_id, key, value FROM cells CROSS JOIN mv) ANTI JOIN m USING (mv, rec_id) GROUP BY 1, 2, 3), fg AS (SELECT mv, key, sum(c) AS n, count(*) AS u, sum({D.term('(c - 1)')}) AS s FROM fb GROUP BY 1, 2),
every AS (SELECT mv.mv, inv.* FROM inv CROSS JOIN mv),
bt AS (SELECT mv, sum(CASE WHEN tot.n - coalesce(covered, 0) > 0 THEN {D.col('least(p - coalesce(pub, 0), tot.n - coalesce(covered, 0))', '(tot.n - coalesce(covered, 0))')} ELSE 0 END + coalesce({D.vblock('fg.s', 'fg.n', 'fg.u', D.naming('inv'))}, 0)) AS bits FROM every LEFT JOIN cov USING (mv, key) LEFT JOIN pub USING (mv, key) LEFT JOIN fg USING (mv, key) CROSS JOIN tot GROUP BY mv),
total AS (SELECT mv, nt.bits + bt.bits + {D.universal('(nodes + 1)')} - CASE WHEN nodes > 1 THEN {D.lg2('nodes + 1')} ELSE 0 END AS bits FROM nt JOIN bt USING (mv)),
d AS (SELECT a, b, round(bits - (SELECT bits FROM total WHERE mv = ''), 6) AS delta FROM total JOIN mv USING (mv) WHERE mv <> '')"""


@query(f"WITH {_MOVES} SELECT a AS node, delta FROM d WHERE b IS NULL")
def delete_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objective.delete_deltas(_types_state(spark, sf_dir)).select("node", r6("delta").alias("delta"))


@query(f"WITH {_MOVES} SELECT a, b, delta FROM d WHERE b IS NOT NULL")
def merge_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objective.partition_merge_deltas(_types_state(spark, sf_dir)).select("a", "b", r6("delta").alias("delta"))


# vectors


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_inner_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id")
def embedding_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every two vectors of one label."""
    e = R.table(spark, sf_dir, "embeddings")
    kind = e.schema["vec_id"].dataType
    pairs = nearest.pair_cosines(e.select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("v")), "label")
    scaled = F.col("cosine") * 1e6
    # F.round goes through decimals, most of the time for so many rows; only near a half and for NaN could another way differ from it
    cosine = F.when((F.abs(scaled - F.rint(scaled)) < 0.499) & (F.abs(scaled) < 1e9), F.rint(scaled) / 1e6 + 0.0).otherwise(r6("cosine"))
    return pairs.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), cosine.alias("cosine"))


@query("WITH d AS (SELECT label, i AS dim, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings CROSS JOIN (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2) SELECT label, round(sqrt(sum(m * m)), 6) AS norm FROM d GROUP BY label")
def label_centroid_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.table(spark, sf_dir, "embeddings").select(F.col("label").alias("value"), F.col("embedding").alias("vector"))
    return R.mean_vectors(e).select(F.col("value").alias("label"), r6(F.sqrt(T.dot("vector", "vector"))).alias("norm"))


# graphs of records and atoms


@query(f"WITH cells AS ({D.CUSTOMER}), d AS (SELECT count(*) AS d FROM cells GROUP BY rec_id UNION ALL SELECT count(*) FROM cells GROUP BY key, value), v AS (SELECT sum(d) AS v FROM d) SELECT round(-sum(d / v * log2(d / v)), 6) AS entropy, CAST(max(v) AS BIGINT) AS volume FROM d CROSS JOIN v")
def structural_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = R.customer(spark, sf_dir)
    d = cells.groupBy("rec_id").count().select("count").unionByName(cells.groupBy("key", "value").count().select("count"))
    v = d.agg(F.sum("count").alias("v"))
    return d.crossJoin(F.broadcast(v)).agg(r6(F.sum(B.entropy_term(F.col("count") / F.col("v")))).alias("entropy"), F.max("v").alias("volume"))  # one row


# evidence accounts


_LEDGER = f"""WITH cells AS ({D.CUSTOMER}), n AS (SELECT count(DISTINCT rec_id) AS n, count(DISTINCT key) AS a FROM cells), kv AS (SELECT key, value, count(*) AS bc FROM cells GROUP BY 1, 2), k AS (SELECT key, sum(bc) AS bp, count(*) AS bu FROM kv GROUP BY 1),
j AS (SELECT s.key AS seed_key, s.value AS seed_value, x.bc AS t, c.key, c.value, count(*) AS c FROM cells s JOIN kv x ON x.key = s.key AND x.value = s.value AND x.bc >= 2 JOIN cells c ON c.rec_id = s.rec_id GROUP BY 1, 2, 3, 4, 5),
per AS (SELECT seed_key, seed_value, t, j.key, sum(c) AS p, count(*) AS u, max(bp) AS bp, max(bu) AS bu, sum(c * {D.kt('bc', 'bp', 'bu')}) AS bg, sum({D.term('(c - 1)')}) AS less FROM j JOIN kv ON kv.key = j.key AND kv.value = j.value JOIN k ON k.key = j.key GROUP BY 1, 2, 3, 4),
led AS (SELECT seed_key, seed_value, t, key, CAST(p AS BIGINT) AS p, bg + p * {D.kt('bp', 'n', '2')} + (t - p) * {D.kt('(n - bp)', 'n', '2')} - {D.vblock('less', 'p', 'u', D.naming('bu'))} - {D.col('p', 't')} AS g, n, a FROM per CROSS JOIN n)"""


@query(_LEDGER + " SELECT seed_key, seed_value, t, key, p, round(g, 6) AS g FROM led")
def account_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.ledger(R.customer(spark, sf_dir)).select("seed_key", "seed_value", "t", "key", "p", r6("g").alias("g"))


@query(_LEDGER + f""", pre AS (SELECT *, row_number() OVER w AS size, sum(g) OVER (PARTITION BY seed_key, seed_value ORDER BY g DESC, key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS released FROM led WHERE g > 0 WINDOW w AS (PARTITION BY seed_key, seed_value ORDER BY g DESC, key)),
pri AS (SELECT *, {D.price('t', 'size', 'n', '0.0', '0.0', 'a')} AS price FROM pre), b AS (SELECT *, row_number() OVER (PARTITION BY seed_key, seed_value ORDER BY released - price DESC, size) AS k FROM pri)
SELECT seed_key, seed_value, t, CAST(size AS INTEGER) AS size, round(released, 6) AS released, round(price, 6) AS price, round(released - price, 6) AS margin FROM b WHERE k = 1""")
def account_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = R.customer(spark, sf_dir)
    n, keys = cells.agg(F.count_distinct("rec_id"), F.count_distinct("key")).first()
    out = accounts.releases(accounts.ledger(cells), n, keys)
    return out.select("seed_key", "seed_value", "t", "size", r6("released").alias("released"), r6("price").alias("price"), r6("margin").alias("margin"))


@query()
def engine_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record-exact learner over four streams: nodes found and their bits. Tested against known groups."""
    streams = [("two_group", G.two_group(spark, 1000)), ("planted", G.planted(spark, 1500)), ("null", G.uniform_null(spark, 1000)), ("typos", G.typo_stream(spark, 1000))]
    out = None
    for name, df in streams:
        rows = df.select(F.lit(name).alias("stream"), "rec_id", "rec")
        out = rows if out is None else out.unionByName(rows)
    return engine.summary(out).select("stream", "records", "nodes", r6("bits").alias("bits"))


@query()
def engine_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record-exact learner over the customers (nation, region, segment) as one stream: each record's label."""
    cells = R.customer(spark, sf_dir)
    return engine.run(R.records(cells).withColumn("stream", F.lit("customers")))


# clustering baselines


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "embeddings").select(F.lit("all").alias("stream"), F.col("vec_id").cast("long").alias("rec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("truth"))


def _scored(spark: SparkSession, sf_dir: str, fit) -> DataFrame:
    v = _vectors(spark, sf_dir)
    labels = baselines.fit_groups(v.select("stream", "rec_id", "v"), "stream", fit)
    return metrics.adjusted_rand(labels.join(v.select("rec_id", "truth"), "rec_id")).select(r6("ari").alias("ari"))


@query()
def dp_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, lambda x: baselines.dp_means(x, 1.2))


@query()
def leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, lambda x: baselines.leader(x, 1.1))


@query()
def summary_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, lambda x: baselines.summaries(x, 0.9))


@query()
def sequential_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, lambda x: baselines.sequential_kmeans(x, 10))


@query()
def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return metrics.adjusted_rand(baselines.kmeans(v, 10).join(v.select("rec_id", "truth"), "rec_id")).select(r6("ari").alias("ari"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prequential_background_bits(spark, sf_dir)
