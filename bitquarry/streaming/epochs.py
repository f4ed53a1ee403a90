"""Learning a stream in epochs, with Structured Streaming.

Each micro-batch is an epoch. Its records are judged against the nodes as they
stood when it began: a record joins the node that saves it most bits. What
stays in the background feeds evidence accounts, priced in bulk; accounts that
pay become nodes at the epoch's end, the best first, as long as their members
are mostly free. State lives in Parquet tables (one folder for each epoch,
named by the batch id), so a repeated batch overwrites its own folder and a
lost executor costs nothing.

The answers differ from the record-exact learner's (``operators.engine``),
which decides inside an epoch; compare description totals, not node ids.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from bitquarry.functions import bits as B
from bitquarry.operators import accounts, objective


@dataclass
class Epochs:
    """State folder: cells/, membership/, support/ by epoch."""

    path: str
    most_nodes: int = 8

    def tables(self, spark: SparkSession, before: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """cells, membership, support of the epochs before one."""
        read = lambda name, schema: self._read(spark, name, schema).filter(F.col("epoch") < before).drop("epoch")
        return read("cells", "rec_id bigint, key string, value string"), read("membership", "node string, rec_id bigint"), read("support", "node string, key string")

    def _read(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        try:
            return spark.read.schema(f"{schema}, epoch int").parquet(f"{self.path}/{name}")
        except Exception as e:  # no epoch was written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], f"{schema}, epoch int")

    def _write(self, df: DataFrame, name: str, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/epoch={epoch}")

    def step(self, records: DataFrame, epoch: int) -> None:
        """One epoch of (rec_id, rec)."""
        spark = records.sparkSession
        new = records.select("rec_id", F.explode("rec").alias("key", "value")).filter("value IS NOT NULL")
        self._write(new, "cells", epoch)
        cells, membership, support = self.tables(spark, epoch)
        new = spark.read.schema("rec_id bigint, key string, value string").parquet(f"{self.path}/cells/epoch={epoch}")
        every = cells.unionByName(new)
        joined = assign(new, cells, membership, support) if epoch else new.limit(0).select(F.lit("").alias("node"), "rec_id")
        self._write(joined, "membership", epoch)
        joined = spark.read.schema("node string, rec_id bigint").parquet(f"{self.path}/membership/epoch={epoch}")
        placed = membership.unionByName(joined)
        free = every.join(placed.select("rec_id").distinct(), "rec_id", "left_anti")
        self._mint(every, free, placed, epoch)

    def _mint(self, every: DataFrame, free: DataFrame, placed: DataFrame, epoch: int) -> None:
        spark = every.sparkSession
        n, keys = every.agg(F.count_distinct("rec_id"), F.count_distinct("key")).first()
        nodes = placed.select("node").distinct().count()
        paying = accounts.releases(accounts.ledger(every, free), n, keys, nodes, nodes).filter("margin > 0")
        best = paying.orderBy(F.desc("margin"), "seed_key", "seed_value").limit(64).collect()  # candidates of one epoch
        new_members, new_support, taken = None, [], None
        supports: list[set[str]] = []
        minted = 0
        for r in best:
            if minted == self.most_nodes:
                break
            if any(set(r.support) <= keys_ for keys_ in supports):
                continue  # its records went with a better account
            m = free.filter((F.col("key") == r.seed_key) & (F.col("value") == r.seed_value)).select("rec_id")
            if taken is not None:
                left = m.join(taken, "rec_id", "left_anti")
                if 2 * left.count() < r.t:
                    continue
                m = left
            name = f"e{epoch}_{minted}"
            # all free records with the support's keys join the node
            share = free.filter(F.col("key").isin(r.support)).groupBy("rec_id").agg(F.count("*").alias("k")).filter(F.col("k") == len(r.support)).select("rec_id")
            m = m.unionByName(share if taken is None else share.join(taken, "rec_id", "left_anti")).distinct()
            rows = m.select(F.lit(name).alias("node"), "rec_id")
            new_members = rows if new_members is None else new_members.unionByName(rows)
            taken = new_members.select("rec_id").distinct()
            new_support += [(name, k) for k in r.support]
            supports.append(set(r.support))
            minted += 1
        if new_members is not None:
            new_members.write.mode("append").parquet(f"{self.path}/membership/epoch={epoch}")
        self._write(spark.createDataFrame(new_support, "node string, key string"), "support", epoch)

    def state(self, spark: SparkSession, epoch: int = 1 << 30) -> objective.State:
        cells, membership, support = self.tables(spark, epoch)
        owner = cells.join(membership, "rec_id").join(support, ["node", "key"]).groupBy("rec_id", "key").agg(F.min("node").alias("node")).select("node", "rec_id", "key")
        return objective.State(cells, membership, support, owner)

    def start(self, records: DataFrame, checkpoint: str) -> StreamingQuery:
        """Runs over a stream of (rec_id, rec)."""
        return records.writeStream.foreachBatch(lambda df, k: self.step(df, k)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def assign(new: DataFrame, cells: DataFrame, membership: DataFrame, support: DataFrame) -> DataFrame:
    """node, rec_id: the node that saves each new record most bits against the background, if any does."""
    n = cells.agg(F.count_distinct("rec_id").alias("n"))
    bg = cells.groupBy("key", "value").agg(F.count("*").alias("bc"))
    bk = bg.groupBy("key").agg(F.sum("bc").alias("bp"), F.count("*").alias("bu"))
    t = membership.groupBy("node").agg(F.count("*").alias("t"))
    own = cells.join(membership, "rec_id").join(support, ["node", "key"]).groupBy("node", "key", "value").agg(F.count("*").alias("c"))
    ok = own.groupBy("node", "key").agg(F.sum("c").alias("p"), F.count("*").alias("u"))
    keyed = support.join(t, "node").join(ok, ["node", "key"], "left").fillna(0, ["p", "u"]).join(bk, "key").crossJoin(F.broadcast(n))  # one row
    silent = (B.kt(F.col("n") - F.col("bp"), F.col("n"), 2) - B.kt(F.col("t") - F.col("p"), F.col("t"), 2)).alias("silent")
    keyed = keyed.select("node", "key", "t", "p", "u", "bp", "bu", "n", silent)
    base = keyed.groupBy("node").agg(F.sum("silent").alias("all_silent"), (F.max("t")).alias("t"), F.max("n").alias("n"))
    hit = new.join(keyed, "key").join(own, ["node", "key", "value"], "left").join(bg, ["key", "value"], "left").fillna(0, ["c", "bc"])
    node_bits = B.block_cost("c", "p", "u", B.naming_charge("bu")) + B.kt("p", "t", 2)
    back_bits = B.block_cost("bc", "bp", "bu", B.naming_charge("bu")) + B.kt("bp", "n", 2)
    per = hit.groupBy("rec_id", "node").agg(F.sum(back_bits - node_bits - F.col("silent")).alias("saved"))
    gain = F.col("saved") + F.col("all_silent") - B.attach_bits("t", F.col("n") + 1)
    scored = per.join(base, "node").withColumn("gain", gain).filter("gain > 0")
    return scored.groupBy("rec_id").agg(F.min_by("node", F.struct(-F.col("gain"), "node")).alias("node")).select("node", "rec_id")


def windowed_records(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Records of an event stream: per user and window, each event type to the band of its count."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "user_id", "event_type").agg(F.count("*").alias("n"))
    band = F.when(F.col("n") >= 10, "many").when(F.col("n") >= 3, "some").otherwise("few")
    return counts.select("w", "user_id", "event_type", band.alias("band"))
