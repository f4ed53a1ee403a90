"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import time

from bitquarry.plans import catalogue
from bitquarry.plans.session import local

HEADLINE = (
    "prequential_background_bits", "prequential_background_events", "prequential_presence_bits", "block_bits", "partition_bits",
    "cooccurring_key_pairs", "functional_dependencies", "key_implications", "key_merge_deltas", "adjusted_rand", "batch_objective",
    "merge_deltas", "account_releases", "engine_streams",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local(os.environ.get("BENCH_CPUS", "8"), **{"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        if name not in catalogue.QUERIES:
            continue
        began = time.time()
        catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total wall time of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
