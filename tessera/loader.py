"""The batch loader: datasets as one virtual row range, read by a sampler's plan, handed over as mini-batches.

A pass is one Spark job. Rows get (request, batch, position) from the plan, are dealt to partitions by ranges of requests, sorted
there, and each task packs its batches into Arrow; the driver receives finished batches partition by partition, with the next
partition prefetched. Nothing but the batches in hand is on the driver.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.abc import Sampler
from tessera.operators.align import is_sparse, same_var
from tessera.operators.intervals import virtual_rows
from tessera.samplers import RandomSampler, SequentialSampler
from tessera.sources.scan import Load, fs, numbered, scratch_dir
from tessera.types import CSR, Annotated, LoaderOutput

_PLAN = ("chunk_id", "chunk_pos", "request_id", "batch_id", "pos_in_batch", "_ordinal")

#: A request of a sampler without a plan, up to so many rows and chunks, is fetched at once; tasks pack the batches of a larger one.
REQUEST_ROWS, REQUEST_CHUNKS = 16_384, 64
#: Rows of a task that packs batches, about.
TASK_ROWS = 8192
#: Rows of a request that are told to the engine at a time.
PLACES = 1_000_000


class Loader:
    """Batches {X, obs, var, index} of one or more datasets.

    A sampler, or the arguments that make one. concat_strategy is taken for compatibility and does nothing. preload_to_gpu
    promotes sparse values (promote_dtype) and hands over cupy arrays; without cupy it warns and they stay on the host. scratch: a folder all executors share, for datasets whose rows aren't numbered (spark.checkpoint.dir if unset).
    """

    def __init__(self, spark: SparkSession | None = None, *, batch_sampler: Sampler | None = None, chunk_size: int | None = None, preload_nchunks: int | None = None, shuffle: bool | None = None, batch_size: int | None = None, drop_last: bool | None = None, return_index: bool = False, rng=None, concat_strategy: str | None = None, preload_to_gpu: bool = False, to_torch: bool = False, scratch: str | None = None):
        own = {"chunk_size": chunk_size, "preload_nchunks": preload_nchunks, "shuffle": shuffle, "batch_size": batch_size, "drop_last": drop_last}
        if batch_sampler is not None:
            given = [k for k, v in own.items() if v is not None]
            if given:
                raise ValueError(f"give batch_sampler or {', '.join(given)}, not both")
            self._sampler = batch_sampler
        else:
            size = {"chunk_size": chunk_size or 512, "preload_nchunks": preload_nchunks or 32, "batch_size": batch_size or 1, "drop_last": bool(drop_last)}
            self._sampler = RandomSampler(**size, rng=rng) if shuffle else SequentialSampler(**size)
        if concat_strategy is not None:
            warnings.warn("concat_strategy does nothing", DeprecationWarning, stacklevel=2)
        self.spark = spark or SparkSession.getActiveSession()
        self.return_index, self.to_torch, self._scratch = return_index, to_torch, scratch
        self._device = preload_to_gpu
        self._cupy = None
        if preload_to_gpu:
            try:
                import cupy

                self._cupy = cupy
            except ImportError:
                warnings.warn("preload_to_gpu: cupy is not installed, batches stay on the host", stacklevel=2)
        self._parts: list[tuple[Annotated, int, int]] = []
        self._collection = False
        self._var: DataFrame | None = None

    # ---- data

    def use_collection(self, collection, *, load_adata: Load | None = None) -> Loader:
        """All datasets of a collection; once only."""
        if self._collection:
            raise RuntimeError("a collection is in use already")
        if collection.is_empty:
            raise ValueError("the collection is empty")
        if load_adata is None:
            data, n, span = collection.whole()
            self._attach([data], [n], [span])
        else:
            self.add_adatas([load_adata(self.spark, collection.dataset_path(k)) for k in collection.dataset_ids])
        self._collection = True
        return self

    def add_adata(self, data: Annotated) -> Loader:
        return self.add_adatas([data])

    def add_adatas(self, data: Sequence[Annotated]) -> Loader:
        """All are checked before any is added."""
        return self._attach(data)

    def _attach(self, data: Sequence[Annotated], sizes: Sequence[int] | None = None, spans: Sequence[int] | None = None) -> Loader:
        """sizes: rows of each, counted if not known. spans: how many datasets each holds, told apart by ``_dataset``."""
        known = [p for p, *_ in self._parts]
        for d in data:
            if not isinstance(d, Annotated) or "x" not in d.rows.columns:
                raise TypeError("a dataset is an Annotated with a matrix column x; in-memory arrays must be stored first")
            first = (known or [data[0]])[0]
            if bool(d.obs_columns) != bool(first.obs_columns):
                raise ValueError("obs must be present for all datasets or none")
            if (d.var is None) != (first.var is None):
                raise ValueError("var must be present for all datasets or none")
            if is_sparse(d.rows) != is_sparse(first.rows):
                raise ValueError("all datasets must be dense or all sparse")
            if d.var is not None and d.var is not first.var and not same_var(d.var, first.var):
                raise ValueError("All datasets must have identical var")
        sizes = [d.rows.count() for d in data] if sizes is None else sizes
        self._sampler.validate(self.n_obs + sum(sizes))
        for d, n, span in zip(data, sizes, spans or [1] * len(data), strict=True):
            scratch = f"{self._scratch or scratch_dir(self.spark)}/loader-{id(self)}-{len(self._parts)}"
            self._parts.append((numbered(d, scratch), n, span))
        self._var = self._parts[0][0].var
        return self

    def add_dataset(self, dataset: DataFrame, obs: DataFrame | None = None, var: DataFrame | None = None, *, key: str = "row_id") -> Loader:
        """dataset: (key, x); obs: (key, annotations), joined by key; rows stand in the order of key."""
        return self.add_datasets([dataset], None if obs is None else [obs], None if var is None else [var], key=key)

    def add_datasets(self, datasets: Sequence[DataFrame], obs: Sequence[DataFrame] | None = None, var: Sequence[DataFrame] | None = None, *, key: str = "row_id") -> Loader:
        n = len(datasets)
        obs, var = obs or [None] * n, var or [None] * n
        return self.add_adatas([Annotated(d if o is None else d.join(o, key), v, [key]) for d, o, v in zip(datasets, obs, var, strict=True)])

    # ---- properties

    @property
    def dataset_type(self) -> str:
        return "sparse" if is_sparse(self._parts[0][0].rows) else "dense"

    @property
    def n_obs(self) -> int:
        return sum(n for _, n, _ in self._parts)

    @property
    def n_var(self) -> int:
        if not self._parts:
            raise ValueError("no dataset was added")
        if self._var is not None:
            return self._var.count()
        if self.dataset_type == "sparse":
            return 1 + (self.rows().agg(F.max(F.array_max("x.indices"))).first()[0] or 0)
        return self.rows().select(F.size("x")).first()[0]

    @property
    def var(self) -> DataFrame | None:
        return self._var

    @property
    def batch_sampler(self) -> Sampler:
        return self._sampler

    def __len__(self) -> int:
        return self._sampler.n_iters(self.n_obs)

    # ---- passes

    def rows(self) -> DataFrame:
        """All datasets as one table with obs_id and dataset_id."""
        if not self._parts:
            raise ValueError("no dataset was added")
        out, base, before = None, 0, 0
        for p, n, span in self._parts:
            of = F.col("_dataset") + before if "_dataset" in p.rows.columns else F.lit(before)
            d = p.rows.withColumns({"obs_id": (F.col("row_id") + base).cast("long"), "dataset_id": of.cast("int")}).drop("row_id", "_dataset")
            out = d if out is None else out.unionByName(d, allowMissingColumns=True)
            base, before = base + n, before + span
        return out

    def batches(self) -> DataFrame:
        """The pass as a DataFrame: every row with request_id, batch_id and pos_in_batch."""
        plan = self._sampler.plan(self.n_obs)
        rows = self.rows()
        return plan.rows(rows, dataset="dataset_id")

    def __iter__(self) -> Iterator[LoaderOutput]:
        if not self._parts or self.n_obs == 0:
            raise ValueError("no rows to load: add a dataset first")
        self._sampler.validate(self.n_obs)
        names = None if self._var is None else np.array([r[0] for r in self._var.sort("var_id").select("var_name").collect()])
        n_var = len(names) if names is not None else self.n_var
        worker = getattr(self._sampler, "worker", None)
        if hasattr(self._sampler, "plan") and not (worker and worker[1] > 1):
            yield from (self._output(b, names, n_var) for b in self._planned())
            return
        for request in self._sampler.sample(self.n_obs):
            yield from self._requested(request, names, n_var)

    def _planned(self) -> Iterator[pa.Table]:
        rows = self.batches()
        plan = self._sampler.plan(self.n_obs)
        parts = max(1, min(plan.n_requests, -(-plan.n_rows // TASK_ROWS), 4096))  # each is a job of its own: small requests share one
        yield from self._packed(rows.repartitionByRange(parts, "request_id").sortWithinPartitions("request_id", "batch_id", "pos_in_batch"))

    def _packed(self, dealt: DataFrame) -> Iterator[pa.Table]:
        """The batches of rows that stand in order, one after the other."""

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            at = None

            def done() -> pa.RecordBatch:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, held[0].schema) as w:
                    for h in held:
                        w.write_batch(h)
                return pa.RecordBatch.from_pydict({"batch": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

            for batch in batches:
                r, b = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("request_id", "batch_id"))
                cut = [0, *(np.flatnonzero((np.diff(r) != 0) | (np.diff(b) != 0)) + 1).tolist(), len(r)]
                for lo, hi in zip(cut, cut[1:], strict=False):
                    if hi == lo:
                        continue
                    if at is not None and at != (r[lo], b[lo]):
                        yield done()
                        held = []
                    at = (r[lo], b[lo])
                    held.append(batch.slice(lo, hi - lo))
            if held:
                yield done()

        for row in dealt.mapInArrow(pack, "batch binary").toLocalIterator(prefetchPartitions=True):
            yield pa.ipc.open_stream(bytes(row[0])).read_all()

    def _requested(self, request, names, n_var: int) -> Iterator[LoaderOutput]:
        """A sampler of one's own: a request's rows are fetched by their ranges (pushed to the scan), then split."""
        asked = np.concatenate([np.empty(0, np.int64), *(np.arange(c.start, c.stop) for c in request["chunks"])])
        if not len(asked):
            return
        if len(asked) > REQUEST_ROWS or len(request["chunks"]) > REQUEST_CHUNKS:
            yield from (self._output(t, names, n_var) for t in self._dealt(asked, [np.asarray(s) for s in request["splits"] if len(s)]))
            return
        rows = self.rows()
        inside = None
        for c in request["chunks"]:
            own = (F.col("obs_id") >= c.start) & (F.col("obs_id") < c.stop)
            inside = own if inside is None else inside | own
        held = rows.filter(inside).toArrow()
        ids = np.asarray(held["obs_id"])
        sorter = np.argsort(ids)
        of = np.asarray(held["dataset_id"])[sorter]
        at = np.searchsorted(ids[sorter], asked)
        memory = sorter[at[np.argsort(of[at], kind="stable")]]  # by dataset, then as asked
        for split in request["splits"]:
            if len(split):
                yield self._output(held.take(pa.array(memory[np.asarray(split)])), names, n_var)

    def _dealt(self, asked: np.ndarray, splits: list[np.ndarray]) -> Iterator[pa.Table]:
        """The batches of a large request: its rows get (batch, place) by an equi-join and are packed by tasks.

        The driver holds row numbers of the request, 8 bytes each, and batches in hand, no rows. Numbers go out PLACES at a time, through a
        scratch table if there are more.
        """
        if not splits:
            return
        memory = asked[np.argsort(np.searchsorted(self._starts(), asked, "right"), kind="stable")]  # by dataset, then as asked
        ids, size = memory[np.concatenate(splits)], np.array([len(s) for s in splits])
        first = np.cumsum(size) - size

        def places(lo: int, hi: int) -> DataFrame:
            at = np.arange(lo, min(hi, len(ids)))
            batch = np.searchsorted(first, at, "right") - 1
            return self.spark.createDataFrame(pa.table({"_at": ids[lo:hi].astype(np.int64), "batch_id": batch, "pos_in_batch": at - first[batch]}))

        scratch = f"{self._scratch or scratch_dir(self.spark)}/request-{uuid.uuid4().hex}"
        try:
            told = places(0, PLACES)
            if len(ids) > PLACES:
                for lo in range(0, len(ids), PLACES):
                    places(lo, lo + PLACES).write.mode("append").parquet(scratch)
                told = self.spark.read.parquet(scratch)
            inside = self.rows().filter((F.col("obs_id") >= int(ids.min())) & (F.col("obs_id") <= int(ids.max())))
            placed = inside.join(told, F.col("obs_id") == F.col("_at")).drop("_at").withColumn("request_id", F.lit(0))
            parts = max(1, min(-(-len(ids) // TASK_ROWS), len(splits), 4096))
            dealt = placed.repartitionByRange(parts, "batch_id").sortWithinPartitions("batch_id", "pos_in_batch")
            for n, batch in zip(size, self._packed(dealt), strict=True):
                if batch.num_rows != n:
                    raise ValueError(f"a batch of {n} rows came with {batch.num_rows}: the sampler asked for rows that are not there")
                yield batch
        finally:
            f, p = fs(self.spark, scratch)
            f.delete(p, True)

    def _starts(self) -> np.ndarray:
        """The first row number of each dataset."""
        if all(span == 1 for *_, span in self._parts):
            return np.cumsum([0, *(n for _, n, _ in self._parts)])[:-1]
        first = self.rows().groupBy("dataset_id").agg(F.min("obs_id").alias("first")).select("first").toArrow()["first"]  # one row a dataset
        return np.sort(np.asarray(first))

    def _output(self, table: pa.Table, names, n_var: int) -> LoaderOutput:
        col = table["x"].combine_chunks()
        if pa.types.is_struct(col.type):
            idx, val = col.field("indices"), col.field("values")
            ptr = np.asarray(idx.offsets).astype(np.int64)
            x = CSR(np.asarray(val.values)[ptr[0] : ptr[-1]], np.asarray(idx.values)[ptr[0] : ptr[-1]], ptr - ptr[0], (len(col), n_var))
        else:
            shape, flat = [len(col)], col
            while pa.types.is_list(flat.type) or pa.types.is_large_list(flat.type):
                n = len(flat)
                flat = flat.flatten()
                shape.append(len(flat) // max(n, 1))
            x = np.asarray(flat).reshape(shape)
        if self._device:
            if isinstance(x, CSR):
                x = CSR(x.values.astype(promote_dtype(x.values.dtype)), x.indices, x.indptr, x.shape)
            if self._cupy is not None:
                x = CSR(*map(self._cupy.asarray, (x.values, x.indices, x.indptr)), x.shape) if isinstance(x, CSR) else self._cupy.asarray(x)
        if self.to_torch:
            import torch

            x = torch.from_numpy(np.ascontiguousarray(x)) if isinstance(x, np.ndarray) else torch.sparse_csr_tensor(torch.from_numpy(x.indptr), torch.from_numpy(x.indices), torch.from_numpy(x.values), size=x.shape)
        obs = [c for c in self._parts[0][0].obs_columns if c in table.column_names and c not in (*_PLAN, "obs_id", "dataset_id", "pos", "x")]
        return {"X": x, "obs": table.select(obs).to_pandas() if obs else None, "var": names, "index": np.asarray(table["obs_id"]) if self.return_index else None}


def promote_dtype(kind: np.dtype) -> np.dtype:
    """The dtype that sparse matrices take on accelerators: float32, float64 and bool stay; below 4 bytes float32, else float64."""
    kind = np.dtype(kind)
    if kind == np.bool_ or kind in (np.dtype("f4"), np.dtype("f8")):
        return kind
    return np.dtype("f4") if kind.itemsize < 4 else np.dtype("f8")


__all__ = ["Loader", "promote_dtype", "virtual_rows"]
