"""Preshuffled collections: many sources as K shuffled, sharded datasets; created once, appended to later.

Layout: ``<path>/data-<id>/dataset_id=<k>/*.parquet``, ``<path>/var-<id>`` and ``<path>/_manifest-<n>.json``, which names the two and is
written last by a rename; the newest counts. A reader sees the old state or the new one; a failed or interrupted create or append
leaves the old one.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.abc import seed_of
from tessera.functions.categories import categories, sort_keys, with_categories
from tessera.functions.sizes import bytes_per_row, check_at_least_one, parse_size
from tessera.operators.align import align, intersect_var, make_unique, remap, subset_var
from tessera.operators.checks import check_groupby, normalize_groupby, warn_mismatch
from tessera.operators.intervals import offsets
from tessera.plans.blocks import BlockPlan, place
from tessera.sources.scan import Load, concat_rows, default_load, fs, read_state, scan_sources, write_state
from tessera.sources.sink import write_sharded
from tessera.types import Annotated

_INNER = ("_file_idx", "_row_idx", "block_pos")


def mean_bytes(parts: Sequence[Annotated]) -> float:
    """Bytes of a row: the mean over sources, each counted once whatever its rows."""
    each = [bytes_per_row(p.rows.drop(*p.order, "obs_name")) for p in parts]
    return sum(each) / len(each)


class DatasetCollection:
    def __init__(self, path: str, spark: SparkSession | None = None, *, mode: str = "a"):
        if not isinstance(path, str):
            raise TypeError(f"a collection is a path, not {type(path).__name__}")
        if mode not in ("a", "r", "r+"):
            raise ValueError(f"unknown mode {mode!r}")
        self.path, self.mode = path.rstrip("/"), mode
        self.spark = spark or SparkSession.getActiveSession()
        if not self.path.endswith(".parquet"):
            warnings.warn(f"{self.path} does not end in .parquet", stacklevel=2)

    # ---- reading

    @property
    def manifest(self) -> dict | None:
        return read_state(self.spark, self.path, "_manifest")

    @property
    def is_empty(self) -> bool:
        m = self.manifest
        return m is None or not m["rows"]

    @property
    def dataset_ids(self) -> list[int]:
        """Numeric, not lexical, order."""
        m = self.manifest
        return sorted(map(int, m["rows"])) if m else []

    def dataset_path(self, k: int) -> str:
        return f"{self.path}/{self.manifest['data']}/dataset_id={k}"

    @property
    def var(self) -> DataFrame | None:
        m = self.manifest
        return self.spark.read.parquet(f"{self.path}/{m['var']}") if m and m["var"] else None

    def rows(self) -> DataFrame:
        """All rows with dataset_id, pos and obs_id (the virtual row range)."""
        m = self.manifest
        if m is None:
            raise ValueError(f"{self.path} is empty")
        d = self.spark.read.parquet(f"{self.path}/{m['data']}")
        for c, known in m["categories"].items():
            d = with_categories(d, c, known)
        sizes = self.spark.createDataFrame([(int(k), n) for k, n in m["rows"].items()], "dataset_id int, n_rows long")
        base = offsets(sizes).select("dataset_id", F.col("start").alias("_start"))
        return d.join(F.broadcast(base), "dataset_id").withColumn("obs_id", F.col("_start") + F.col("pos")).drop("_start")

    def dataset(self, k: int) -> Annotated:
        """One dataset: its partition alone is read."""
        return self._dataset(self.manifest, self.var, k)

    def _dataset(self, m: dict, var: DataFrame | None, k: int) -> Annotated:
        base = f"{self.path}/{m['data']}"  # the partition's folder alone is listed
        d = self.spark.read.option("basePath", base).parquet(f"{base}/dataset_id={k}").filter(F.col("dataset_id") == k).drop("dataset_id")
        for c, known in m["categories"].items():
            d = with_categories(d, c, known)
        return Annotated(d.withColumnRenamed("pos", "row_id"), var, ["row_id"])

    def whole(self) -> tuple[Annotated, int, int]:
        """All datasets as one matrix in the order of the virtual row range, its rows, and the numbers that ``_dataset`` stays below.

        One scan, however many datasets there are; sizes come from the manifest.
        """
        m = self.manifest
        rows = self.rows().drop("pos").withColumnRenamed("obs_id", "row_id").withColumnRenamed("dataset_id", "_dataset")
        return Annotated(rows, self.var, ["row_id"]), sum(m["rows"].values()), max(map(int, m["rows"])) + 1

    def __iter__(self) -> Iterator[Annotated]:
        m, var = self.manifest, self.var
        return (self._dataset(m, var, k) for k in self.dataset_ids)

    def __len__(self) -> int:
        return len(self.dataset_ids)

    # ---- writing

    def add_adatas(self, paths: Sequence[str | Annotated], *, load_adata: Load | None = None, groupby: str | Sequence[str] | None = None, var_subset: Sequence[str] | None = None, n_obs_per_chunk: int = 64, shard_size: int | str = "1GB", compression: str = "zstd", dataset_size: int | str = "20GB", shuffle_chunk_size: int = 1000, shuffle: bool = True, rng=None, batch: tuple[str, int] | None = None) -> DatasetCollection:
        """Creates the collection from sources (paths, or matrices at hand), or appends to each of its datasets.

        On append var_subset and dataset_size do nothing: features and the number of datasets stay as they are. batch: a stream's
        name and the number of its batch; the manifest keeps the last one, and one that is in already is not added again.
        """
        if self.mode == "r":
            raise ValueError("the collection was opened to read")
        check_at_least_one(n_obs_per_chunk=n_obs_per_chunk, shuffle_chunk_size=shuffle_chunk_size)
        keys, seed = normalize_groupby(groupby), seed_of(rng)
        if batch and ((self.manifest or {}).get("streams", {}).get(batch[0], -1) >= batch[1]):
            return self
        load = load_adata or default_load
        names = [p if isinstance(p, str) else f"source_{i}" for i, p in enumerate(paths)]
        if not names:
            raise ValueError("no sources")
        scratch = f"{self.path}/_scratch-{uuid.uuid4().hex}"
        try:
            parts = scan_sources([p if isinstance(p, Annotated) else load(self.spark, p) for p in paths], names, scratch)
            write = {"n_obs_per_chunk": n_obs_per_chunk, "shard_size": shard_size, "compression": compression, "batch": batch}
            if self.is_empty:
                self._create(parts, keys, var_subset, dataset_size, shuffle_chunk_size, shuffle, seed, write)
            else:
                self._append(parts, keys, shuffle_chunk_size, shuffle, seed, write)
        finally:
            f, p = fs(self.spark, scratch)
            f.delete(p, True)
        return self

    def _virtual(self, parts: Sequence[Annotated]) -> tuple[DataFrame, int]:
        """All rows of the parts in one order, with dense row_id: part offsets plus row indexes."""
        sizes = [p.rows.count() for p in parts]
        out, base = [], 0
        for p, n in zip(parts, sizes, strict=True):
            out.append(p.rows.withColumn("row_id", F.col("_row_idx") + base))
            base += n
        return concat_rows(out), base

    def _create(self, parts, keys, var_subset, dataset_size, block, shuffle, seed, write) -> None:
        check_groupby([p.rows for p in parts], keys)
        warn_mismatch(parts)
        rows_per = dataset_size if isinstance(dataset_size, int) else max(1, int(parse_size(dataset_size) / max(mean_bytes(parts), 1e-9)))
        if block > rows_per:
            raise ValueError(f"shuffle_chunk_size {block} is over the {rows_per} rows of a dataset")
        aligned, var = align(parts)
        if var_subset is not None and var is not None:
            kept = subset_var(var, var_subset)
            aligned = [Annotated(remap(p.rows, var, kept, _matrices(p.rows)), kept, p.order) for p in aligned]
            var = kept
        rows, n = self._virtual(aligned)
        if "obs_name" in rows.columns:
            rows = make_unique(rows, "obs_name", ["row_id"])
        plan = BlockPlan(n, block, shuffle, seed, rows_per_dataset=min(n, rows_per))
        plan.check()
        dealt = plan.deal(rows)
        self._commit(place(dealt, seed=seed, shuffle=shuffle, sort=sort_keys(dealt, keys), ids=["row_id"], n_rows=n, n_datasets=plan.datasets), var, n, write)

    def _append(self, parts, keys, block, shuffle, seed, write) -> None:
        check_groupby([p.rows for p in parts], keys)
        old = self.rows().drop("obs_id")
        check_groupby([p.rows for p in parts] + [old], keys)
        warn_mismatch(parts)
        m, var = self.manifest, self.var
        if var is not None:
            parts = [Annotated(p.rows, p.var, p.order) for p in parts]
            shared = [intersect_var(p.var, var) for p in parts]
            narrowed = [Annotated(remap(p.rows, p.var, s, _matrices(p.rows)), s, p.order) for p, s in zip(parts, shared, strict=True)]
            parts, _ = align(narrowed, var)
        rows, n = self._virtual(parts)
        k = len(m["rows"])
        plan = BlockPlan(n, block, shuffle, seed, n_datasets=k)
        plan.check()
        new = plan.deal(rows).withColumn("_src", F.lit(1))
        had = old.withColumnRenamed("pos", "row_id").withColumn("block_pos", F.col("row_id")).withColumn("_src", F.lit(0))
        both = concat_rows([had, new])
        n_old = sum(m["rows"].values())
        if "obs_name" in both.columns:
            both = make_unique(both, "obs_name", ["_src", "dataset_id", "row_id"])
        self._commit(place(both, seed=seed, shuffle=shuffle, sort=sort_keys(both, keys), ids=["_src", "row_id"] if shuffle else ["row_id"], n_rows=n + n_old, n_datasets=k) if shuffle or keys else _after(both), var, n + n_old, write)

    def _commit(self, rows: DataFrame, var: DataFrame | None, n_rows: int, write: dict) -> None:
        before, run, batch = self.manifest, uuid.uuid4().hex[:12], write.pop("batch")
        data, var_at = f"data-{run}", f"var-{run}" if var is not None else None
        known = {c: k for c in rows.columns if (k := categories(rows, c))}
        rows = rows.drop("_row_idx", "_file_idx", "block_pos", "row_id", "_src")
        try:
            shard = write_sharded(rows, f"{self.path}/{data}", dataset="dataset_id", n_rows=n_rows, **write)
            if var is not None:
                var.sort("var_id").coalesce(1).write.parquet(f"{self.path}/{var_at}")
            sizes = self.spark.read.parquet(f"{self.path}/{data}").groupBy("dataset_id").count().collect()  # one row a dataset
        except Exception:
            self._delete(data, var_at)
            raise
        streams = {**(before or {}).get("streams", {}), **({batch[0]: batch[1]} if batch else {})}
        write_state(self.spark, self.path, "_manifest", {"encoding": "tessera-collection", "version": 1, "data": data, "var": var_at, "categories": known, "shard_rows": shard, "rows": {str(r[0]): r[1] for r in sorted(sizes)}, "streams": streams})
        if before:
            self._delete(before["data"], before["var"])

    def _delete(self, *names: str | None) -> None:
        for name in names:
            if name:
                f, p = fs(self.spark, f"{self.path}/{name}")
                f.delete(p, True)


def _matrices(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c == "x" or c.startswith("layer_")]


def _after(both: DataFrame) -> DataFrame:
    """Unshuffled append: old rows in their order, then new ones in theirs."""
    from pyspark.sql.window import Window as W

    w = W.partitionBy("dataset_id").orderBy("_src", "block_pos", "row_id")
    return both.withColumn("pos", (F.row_number().over(w) - 1).cast("long"))
