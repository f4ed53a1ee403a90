"""Tables as records (rec_id, rec) and as cells (rec_id, key, value), and files of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitquarry.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cells_of(df: DataFrame, rec_id: str | Column, columns: dict[str, str | Column]) -> DataFrame:
    """One row for each record and non-null column: rec_id, key, value (string)."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    entries = F.array(*[F.struct(F.lit(k).alias("key"), c(v).cast("string").alias("value")) for k, v in columns.items()])
    return df.select(c(rec_id).cast("long").alias("rec_id"), F.explode(entries).alias("e")).select("rec_id", "e.key", "e.value").filter("value IS NOT NULL")


def cells(records: DataFrame) -> DataFrame:
    return records.select("rec_id", F.explode("rec").alias("key", "value")).filter("value IS NOT NULL")


def records(cells_: DataFrame) -> DataFrame:
    """One row for each rec_id with its map, keys sorted."""
    return cells_.groupBy("rec_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("rec"))


def presence_facets(records_: DataFrame) -> DataFrame:
    """Each record with ``has:key`` = '1' beside every key."""
    return records_.withColumn("rec", F.map_concat("rec", F.transform_values(F.transform_keys("rec", lambda k, _: F.concat(F.lit("has:"), k)), lambda k, _: F.lit("1"))))


def rename_keys(records_: DataFrame, names: dict[str, str]) -> DataFrame:
    """Keys by a mapping of bounded size; others stay."""
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return records_.withColumn("rec", F.transform_keys("rec", lambda k, _: F.coalesce(F.element_at(m, k), k)))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells_of(table(spark, sf_dir, "orders"), "o_orderkey", {"prio": "o_orderpriority", "status": "o_orderstatus", "year": F.year("o_orderdate")})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return cells_of(table(spark, sf_dir, "events"), "event_id", {"event_type": "event_type", "hour": F.hour("ts"), "k": k, "weekday": F.dayofweek("ts")})


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.when(F.col("l_quantity") < 10, "low").when(F.col("l_quantity") < 30, "mid").otherwise("high")
    return cells_of(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") * 10 + F.col("l_linenumber"), {"linestatus": "l_linestatus", "qty_band": band, "returnflag": "l_returnflag", "ship_year": F.year("l_shipdate")})


def customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with nation and region (a dependency: nation gives region)."""
    t = lambda n: table(spark, sf_dir, n)
    joined = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return cells_of(joined, "c_custkey", {"nation": "n_name", "region": "r_name", "segment": "c_mktsegment"})


def supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    joined = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return cells_of(joined, "s_suppkey", {"nation": "n_name", "region": "r_name"})


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("p_size") < 15, "small").when(F.col("p_size") < 35, "medium").otherwise("large")
    return cells_of(table(spark, sf_dir, "part"), "p_partkey", {"brand": "p_brand", "size_band": size, "type": "p_type"})


#: Offsets that keep rec_ids of the tables of the mixed stream apart.
MIXED = (("orders", 0), ("part", 10_000_000_000), ("supplier", 20_000_000_000), ("customer", 30_000_000_000))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, parts, suppliers and customers as one stream: cells with truth (the table's name)."""
    out = None
    for name, base in MIXED:
        part_ = globals()[name](spark, sf_dir).select((F.col("rec_id") + base).alias("rec_id"), "key", "value", F.lit(name).alias("truth"))
        out = part_ if out is None else out.unionByName(part_)
    return out


def spec_csv(spark: SparkSession, path: str, id_column: str = "product_id", specs: str = "specifications") -> tuple[DataFrame, DataFrame]:
    """Records of a CSV with ``{k=[v]}`` specifications, in hash order, and how many rows dropped out and why."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    parsed = raw.withColumn("rec", F.when(F.col(specs).isNotNull() & (F.lower(F.trim(specs)) != "null"), T.parse_specs(F.col(specs))))
    kept = parsed.filter(F.size("rec") > 0).withColumn("order_id", F.xxhash64(id_column))
    dropped = parsed.agg(F.count("*").alias("rows"), F.count_if(F.col("rec").isNull()).alias("without_specs"), F.count_if(F.size("rec") == 0).alias("empty"))
    return kept, dropped


def silver_types(nodes: DataFrame, edges: DataFrame, edge_type: str = "is_a", type_type: str = "type") -> DataFrame:
    """product_id, type_id: over typed edges, the smallest type of each product."""
    types = nodes.filter(F.col("node_type") == type_type).select(F.col("node_id").alias("type_id"))
    e = edges.filter(F.col("edge_type") == edge_type).select(F.col("source_node_id").alias("product_id"), F.col("target_node_id").alias("type_id"))
    return e.join(types, "type_id").groupBy("product_id").agg(F.min("type_id").alias("type_id"))


def triples_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """subject, relation, object of JSON lines with triple_norm, white space made plain, triples with an empty part left out; with the subject's gold link."""
    raw = spark.read.schema("_id string, triple_norm array<string>, true_link struct<subject:string>").json(path)
    part_ = lambda i: F.trim(F.regexp_replace(F.get("triple_norm", F.lit(i)), r"\s+", " "))
    out = raw.select(part_(0).alias("subject"), part_(1).alias("relation"), part_(2).alias("object"), F.col("true_link.subject").alias("gold"))
    return out.filter("subject <> '' AND relation <> '' AND object <> ''")


def triple_records(triples: DataFrame, least: int = 2) -> DataFrame:
    """One record for each subject: relation to its sorted distinct objects joined by " ; ", and ``s:token`` for tokens in ``least`` subjects or more."""
    relation = F.regexp_replace("relation", " ", "_")
    facts = triples.groupBy("subject", relation.alias("key")).agg(F.array_join(F.array_sort(F.collect_set("object")), " ; ").alias("value"))
    tok = triples.select("subject").distinct().select("subject", F.explode(F.array_distinct(T.tokens("subject"))).alias("tok"))
    often = tok.groupBy("tok").count().filter(F.col("count") >= least).select("tok")
    facets = tok.join(often, "tok", "left_semi").select("subject", F.concat(F.lit("s:"), "tok").alias("key"), F.lit("1").alias("value"))
    return facts.unionByName(facets).groupBy("subject").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("rec"))


def gold_clusters(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Subject to gold links, and gold link to subjects."""
    t = triples.filter("gold IS NOT NULL")
    return t.groupBy("subject").agg(F.array_sort(F.collect_set("gold")).alias("golds")), t.groupBy("gold").agg(F.array_sort(F.collect_set("subject")).alias("subjects"))


def labelled_json(spark: SparkSession, path: str, schema: str, pattern: str = r"\.([A-Za-z0-9_]+)\.json$") -> DataFrame:
    """JSON array files with a label in the file's name."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("label", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def catalogue_json(df: DataFrame, json_column: str, department: str | None = None, most: int = 60, least: int = 2) -> DataFrame:
    """Records of a JSON object column: scalar values cut to ``most`` characters, ``least`` keys or more."""
    kept = df.filter(F.col("department") == department) if department else df
    rec = F.map_filter(F.transform_values(F.from_json(json_column, "map<string,string>"), lambda k, v: F.substring(v, 1, most)), lambda k, v: v.isNotNull() & (F.trim(v) != ""))
    return kept.withColumn("rec", rec).filter(F.size("rec") >= least)


def token_filter(df: DataFrame, text: str, prefix: str, least: int = 2) -> DataFrame:
    """rec_id, key (prefix and token), value '1' for tokens in ``least`` rows or more."""
    tok = df.select("rec_id", F.explode(F.array_distinct(T.tokens(text))).alias("tok"))
    often = tok.groupBy("tok").count().filter(F.col("count") >= least).select("tok")
    return tok.join(often, "tok", "left_semi").select("rec_id", F.concat(F.lit(prefix), "tok").alias("key"), F.lit("1").alias("value"))


def large_groups(df: DataFrame, label: str, least: int) -> DataFrame:
    """Rows of labels with ``least`` rows or more."""
    return df.join(df.groupBy(label).count().filter(F.col("count") >= least).select(label), label, "left_semi")


def hash_sample(df: DataFrame, id_column: str, n: int, seed: int = 0) -> DataFrame:
    """n rows, the same under any partitioning, with their order."""
    return df.withColumn("order_id", F.xxhash64(id_column, F.lit(seed))).orderBy("order_id", id_column).limit(n)


def claims(entities: DataFrame, labels_property: str, banned: tuple[str, ...] = ()) -> DataFrame:
    """qid, rec, labels of rows (qid, property, position, kind, value): the first value of each property, times as years, banned properties left out."""
    value = F.when(F.col("kind") == "time", F.regexp_extract("value", r"^[+-]?0*(\d+)-", 1)).when(F.col("kind") == "entity", F.col("value"))
    typed = entities.withColumn("v", value).filter("v IS NOT NULL AND v <> ''")
    labels = typed.filter(F.col("property") == labels_property).groupBy("qid").agg(F.array_sort(F.collect_set("v")).alias("labels"))
    first = typed.filter((F.col("property") != labels_property) & ~F.col("property").isin(*banned) if banned else F.col("property") != labels_property).groupBy("qid", "property").agg(F.min_by("v", F.struct("position", "v")).alias("v"))
    rec = first.groupBy("qid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("property", "v")))).alias("rec"))
    return rec.join(labels, "qid")


def embedding_cache(spark: SparkSession, path: str) -> DataFrame:
    """value, vector of a JSON cache {"vectors": {value: [float]}}."""
    raw = spark.read.schema("vectors map<string,array<float>>").option("multiLine", True).json(path)
    return raw.select(F.explode("vectors").alias("value", "vector"))


def mean_vectors(occurrences: DataFrame) -> DataFrame:
    """value, vector: the mean of each value's vectors (value, vector), by dimension."""
    dims = occurrences.select("value", F.posexplode("vector").alias("dim", "x"))
    means = dims.groupBy("value", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("value").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda e: e.x).alias("vector"))
