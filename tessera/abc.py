"""The sampler protocol: what to read together, and how it becomes batches."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np

from tessera.types import LoadRequest


def seed_of(rng) -> int | str:
    """A seed from a number, a text, a numpy generator (one draw), or nothing (fresh entropy)."""
    if rng is None:
        return int(np.random.SeedSequence().generate_state(1, np.uint64)[0])
    if isinstance(rng, np.random.Generator):
        return int(rng.integers(0, 1 << 63))
    return rng


class Sampler(ABC):
    """Subclasses say how rows are read. A subclass with ``plan(n_obs)`` (a ChunkPlan) is carried out as DataFrame operations;
    one with ``_sample`` alone is read request by request."""

    _mask: slice = slice(0, None)
    _seed: int | str | None = None

    @property
    def mask(self) -> slice:
        return self._mask

    @mask.setter
    def mask(self, value: slice) -> None:
        self._mask = check_mask(value)

    @property
    def rng(self) -> int | str | None:
        return self._seed

    @rng.setter
    def rng(self, value) -> None:
        self._seed = seed_of(value)

    @property
    @abstractmethod
    def batch_size(self) -> int | None:
        """Rows of a batch; None if the sampler gives splits itself."""

    @property
    @abstractmethod
    def shuffle(self) -> bool | None:
        """Whether rows of a request are permuted; None if the sampler gives splits itself."""

    @abstractmethod
    def n_iters(self, n_obs: int) -> int:
        """Batches of a pass over n_obs rows."""

    @abstractmethod
    def validate(self, n_obs: int) -> None:
        """ValueError if the sampler can't serve n_obs rows."""

    @abstractmethod
    def _sample(self, n_obs: int) -> Iterator[LoadRequest]: ...

    def sample(self, n_obs: int) -> Iterator[LoadRequest]:
        """Requests with splits; where a request has none, its rows are tiled by batch_size, permuted if shuffle."""
        self.validate(n_obs)
        for i, request in enumerate(self._sample(n_obs)):
            if request.get("splits") is None:
                if self.batch_size is None or self.shuffle is None:
                    raise ValueError("a sampler without splits needs batch_size and shuffle")
                n = sum(c.stop - c.start for c in request["chunks"])
                rows = np.arange(n)
                if self.shuffle:
                    text = f"{self._seed if self._seed is not None else 0}:split:{i}"
                    rows = np.random.default_rng(list(text.encode())).permutation(n)
                request = {**request, "splits": [rows[k : k + self.batch_size] for k in range(0, n, self.batch_size)]}
            yield request


def check_mask(mask: slice) -> slice:
    start = 0 if mask.start is None else mask.start
    if mask.step not in (None, 1):
        raise ValueError("mask must have a step of 1")
    if start < 0 or (mask.stop is not None and mask.stop < 0):
        raise ValueError("mask must not be negative")
    if mask.stop is not None and start >= mask.stop:
        raise ValueError("mask's start must be below its stop")
    return slice(start, mask.stop)
