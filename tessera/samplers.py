"""Samplers: random and sequential chunks, and shards of them by rank."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator

import numpy as np

from tessera.abc import Sampler, check_mask, seed_of
from tessera.functions.keys import key_of
from tessera.functions.sizes import check_at_least_one
from tessera.plans.chunks import ChunkPlan
from tessera.types import LoadRequest

__all__ = ["ChunkSampler", "DistributedSampler", "RandomSampler", "SequentialSampler"]


class _Chunks(Sampler):
    def __init__(self, chunk_size: int, preload_nchunks: int, batch_size: int, *, shuffle: bool, replacement: bool = False, num_samples: int | None = None, drop_last: bool = False, mask: slice | None = None, rng=None, worker: tuple[int, int] | None = None):
        check_at_least_one(chunk_size=chunk_size, preload_nchunks=preload_nchunks, batch_size=batch_size)
        rows = chunk_size * preload_nchunks
        if batch_size > rows:
            raise ValueError(f"batch_size {batch_size} is over the {rows} rows of a request (chunk_size * preload_nchunks)")
        if rows % batch_size:
            raise ValueError(f"chunk_size * preload_nchunks ({rows}) must be a multiple of batch_size ({batch_size})")
        if num_samples is not None:
            check_at_least_one(num_samples=num_samples)
        if replacement and not shuffle:
            raise ValueError("replacement needs a shuffled sampler")
        self._chunk_size, self._preload, self._batch_size, self._shuffle = chunk_size, preload_nchunks, batch_size, shuffle
        self._replacement, self._num_samples, self._drop_last = replacement, num_samples, drop_last
        self._mask = check_mask(mask or slice(0, None))
        self._seed = seed_of(rng) if shuffle else 0
        self.worker = worker

    @property
    def batch_size(self) -> int:
        return self._batch_size

    @property
    def shuffle(self) -> bool:
        return self._shuffle

    @property
    def drop_last(self) -> bool:
        return self._drop_last

    def range_of(self, n_obs: int) -> tuple[int, int]:
        return self._mask.start, n_obs if self._mask.stop is None else self._mask.stop

    def n_iters(self, n_obs: int) -> int:
        """Batches that a pass yields. With replacement and drop_last the rows of a last short draw don't count."""
        start, stop = self.range_of(n_obs)
        if self._replacement:
            return self._plan(start, stop).n_batches
        total = stop - start if self._num_samples is None else self._num_samples
        return total // self._batch_size if self._drop_last else math.ceil(total / self._batch_size)

    def _plan(self, start: int, stop: int) -> ChunkPlan:
        return ChunkPlan(start, stop, self._chunk_size, self._preload, self._batch_size, self._shuffle, self._seed, self._drop_last, self._replacement, self._num_samples)

    def plan(self, n_obs: int) -> ChunkPlan:
        self.validate(n_obs)
        return self._plan(*self.range_of(n_obs))

    def validate(self, n_obs: int) -> None:
        start, stop = self.range_of(n_obs)
        if stop > n_obs:
            raise ValueError(f"mask stops at {stop}, beyond {n_obs} rows")
        if start >= stop:
            raise ValueError(f"mask starts at {start}, at or beyond its stop {stop}")
        n = stop - start
        if self._num_samples is not None:
            if not self._replacement and self._num_samples > n:
                raise ValueError(f"num_samples {self._num_samples} is over the {n} rows; use replacement=True")
            if self._replacement and n < self._chunk_size and self._num_samples > n:
                raise ValueError(f"{n} rows are less than a chunk of {self._chunk_size} and num_samples {self._num_samples} is over them")
        if self._replacement and self._plan(start, stop).n_chunks == 0:
            raise ValueError("no observations: num_samples is below chunk_size and drop_last leaves the rest out")
        if self.worker and self.worker[1] > 1:
            if not self._shuffle:
                raise ValueError("several workers need a shuffled sampler")
            if self._replacement:
                raise ValueError("several workers can't draw with replacement")
            if not self._drop_last and self._batch_size != 1:
                raise ValueError("several workers need drop_last=True or batch_size=1")
            if self.worker[1] > self._plan(start, stop).n_chunks:
                raise ValueError(f"{self.worker[1]} workers share {self._plan(start, stop).n_chunks} chunks: a worker would have none")

    def _sample(self, n_obs: int) -> Iterator[LoadRequest]:
        plan = self._plan(*self.range_of(n_obs))
        chunks = list(enumerate(plan.slices()))
        if self.worker and self.worker[1] > 1:
            chunks = [chunks[i] for i in np.array_split(np.arange(len(chunks)), self.worker[1])[self.worker[0]]]
        left = None if self._num_samples is None else plan._wanted
        for lo in range(0, len(chunks), self._preload):
            part = chunks[lo : lo + self._preload]
            sizes = [c.stop - c.start for _, c in part]
            n = sum(sizes)
            if self._drop_last and lo + self._preload >= len(chunks):
                n = n // self._batch_size * self._batch_size
                if n == 0:
                    return
            order = np.arange(n)
            if self._shuffle:
                ids = [(p, r) for p, c in part for r in range(c.start, c.stop)][:n]
                keys = [key_of(self._seed, "row", p, r) for p, r in ids]
                order = np.array(sorted(range(n), key=lambda i: (keys[i], *ids[i])), np.int64)
            splits = [order[i : i + self._batch_size] for i in range(0, n, self._batch_size)]
            if left is not None:
                splits, left = splits[:left], left - min(left, len(splits))
            if splits:
                yield {"chunks": [c for _, c in part], "splits": splits}


class RandomSampler(_Chunks):
    """Chunks in random order, rows of a request permuted; with replacement chunks start anywhere and may overlap."""

    def __init__(self, chunk_size: int, preload_nchunks: int, batch_size: int, *, replacement: bool = False, num_samples: int | None = None, drop_last: bool = False, mask: slice | None = None, rng=None, worker: tuple[int, int] | None = None):
        super().__init__(chunk_size, preload_nchunks, batch_size, shuffle=True, replacement=replacement, num_samples=num_samples, drop_last=drop_last, mask=mask, rng=rng, worker=worker)


class SequentialSampler(_Chunks):
    """Rows in their order."""

    def __init__(self, chunk_size: int, preload_nchunks: int, batch_size: int, *, drop_last: bool = False, mask: slice | None = None):
        super().__init__(chunk_size, preload_nchunks, batch_size, shuffle=False, drop_last=drop_last, mask=mask)


class ChunkSampler(_Chunks):
    """Deprecated: RandomSampler or SequentialSampler say the same."""

    def __init__(self, chunk_size: int, preload_nchunks: int, batch_size: int, *, shuffle: bool = False, drop_last: bool = False, mask: slice | None = None, rng=None):
        warnings.warn("ChunkSampler is deprecated; use RandomSampler or SequentialSampler", DeprecationWarning, stacklevel=2)
        super().__init__(chunk_size, preload_nchunks, batch_size, shuffle=shuffle, drop_last=drop_last, mask=mask, rng=rng)


class DistributedSampler(Sampler):
    """The inner sampler on one rank's equal share of the rows; the rest below one share is read by no rank.

    dist_info: a callable that returns (rank, world size), "torch" (an initialised process group), "jax", or "spark" within a task
    of a barrier stage.
    """

    def __init__(self, sampler: _Chunks, *, dist_info: str | Callable[[], tuple[int, int]], enforce_equal_batches: bool = True):
        if sampler.mask != slice(0, None):
            raise ValueError("the inner sampler must not have a mask: ranks set it")
        self.inner, self.equal = sampler, enforce_equal_batches
        if callable(dist_info):
            self.rank, self.world = dist_info()
        elif dist_info == "spark":
            from pyspark import BarrierTaskContext

            context = BarrierTaskContext.get()
            if context is None:
                raise RuntimeError("dist_info='spark' needs a barrier task")
            self.rank, self.world = context.partitionId(), len(context.getTaskInfos())
        elif dist_info == "torch":
            from torch import distributed

            if not distributed.is_available() or not distributed.is_initialized():
                raise RuntimeError("dist_info='torch' needs an initialised process group")
            self.rank, self.world = distributed.get_rank(), distributed.get_world_size()
        elif dist_info == "jax":
            import jax

            self.rank, self.world = jax.process_index(), jax.process_count()
        else:
            raise ValueError(f"unknown dist_info {dist_info!r}")
        if not 0 <= self.rank < self.world:
            raise ValueError(f"rank {self.rank} is not below {self.world}")

    batch_size = property(lambda self: self.inner.batch_size)
    shuffle = property(lambda self: self.inner.shuffle)

    def share(self, n_obs: int) -> int:
        p = n_obs // self.world
        p = p // self.batch_size * self.batch_size if self.equal else p
        if p == 0:
            raise ValueError(f"{n_obs} rows leave none for each of {self.world} ranks")
        return p

    def _set(self, n_obs: int) -> _Chunks:
        p = self.share(n_obs)
        self._mask = self.inner.mask = slice(self.rank * p, (self.rank + 1) * p)
        return self.inner

    def n_iters(self, n_obs: int) -> int:
        return self._set(n_obs).n_iters(n_obs)

    def validate(self, n_obs: int) -> None:
        self._set(n_obs).validate(n_obs)

    def plan(self, n_obs: int) -> ChunkPlan:
        return self._set(n_obs).plan(n_obs)

    def _sample(self, n_obs: int) -> Iterator[LoadRequest]:
        return self._set(n_obs)._sample(n_obs)
