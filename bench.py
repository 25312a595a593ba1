"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line of seconds."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time
import warnings

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera import DatasetCollection, Loader
from tessera.queries import QUERIES, n_orders, orders, sparse
from tessera.samplers import RandomSampler
from tessera.types import Annotated

HEADLINE = ["seq_batches_dense", "random_batches", "replacement_batches", "drop_last_batches", "csr_rows", "csr_indptr", "var_outer_join", "aligned_rows", "unique_names", "preshuffle_create", "preshuffle_groupby", "append_route", "bytes_per_row", "batch_label_mix"]


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    warnings.simplefilter("ignore")
    scratch = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.sql.warehouse.dir", f"{scratch}/warehouse").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name: str, f, repeat: int = 2) -> None:
        best = float("inf")
        for _ in range(repeat):
            t = time.perf_counter()
            f()
            best = min(best, time.perf_counter() - t)
        took[name] = round(best, 3)

    QUERIES["seq_batches_dense"](spark, d).collect()  # starts the engine
    for name in HEADLINE:
        timed(name, lambda n=name: QUERIES[n](spark, d).write.format("noop").mode("overwrite").save())
    n = n_orders(spark, d)
    data = Annotated(sparse(spark, d).withColumnRenamed("obs_id", "row_id"), None, ["row_id"])
    made = DatasetCollection(f"{scratch}/c.parquet", spark)
    timed("collection_create", lambda: made.add_adatas([data], dataset_size=max(2, n // 4), shuffle_chunk_size=max(1, n // 100), rng=1), 1)
    more = Annotated(orders(spark, d).filter("obs_id % 10 = 0").select(F.col("obs_id").alias("row_id"), F.struct(F.array(F.lit(1)).alias("indices"), F.array(F.lit(1.0)).alias("values")).alias("x")), None, ["row_id"])
    timed("collection_append", lambda: made.add_adatas([more], shuffle_chunk_size=max(1, n // 1000), rng=2), 1)
    loader = Loader(spark, batch_sampler=RandomSampler(512, 8, 256, rng=1)).use_collection(made)
    count = {"rows": 0, "batches": 0}

    def epoch() -> None:
        for b in loader:
            count["rows"] += b["X"].shape[0]
            count["batches"] += 1

    timed("loader_epoch", epoch, 1)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": took, "sf": d.rsplit("sf", 1)[-1], "rates": {"create_rows_s": round(n / took["collection_create"]), "append_rows_s": round((n + n // 10) / took["collection_append"]), "epoch_rows_s": round(count["rows"] / took["loader_epoch"]), "epoch_batches_s": round(count["batches"] / took["loader_epoch"], 1)}}))
    spark.stop()
    shutil.rmtree(scratch, ignore_errors=True)


if __name__ == "__main__":
    main()
