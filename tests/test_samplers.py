from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.abc import Sampler
from tessera.samplers import ChunkSampler, DistributedSampler, RandomSampler, SequentialSampler


def seen(sampler, n):
    """Row numbers of each batch, as the requests say."""
    out = []
    for r in sampler.sample(n):
        rows = np.concatenate([np.arange(c.start, c.stop) for c in r["chunks"]])
        out += [rows[s] for s in r["splits"]]
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(1, 20), st.integers(1, 4), st.integers(0, 50), st.booleans(), st.booleans())
def test_coverage(n, chunk, preload, start, shuffle, drop):
    start = min(start, n - 1)
    batch = max(b for b in range(1, chunk * preload + 1) if (chunk * preload) % b == 0 and b <= 7)
    make = RandomSampler if shuffle else SequentialSampler
    s = make(chunk, preload, batch, mask=slice(start, None), drop_last=drop, **({"rng": 1} if shuffle else {}))
    got = seen(s, n)
    rows = np.concatenate(got) if got else np.zeros(0, int)
    assert len(set(rows.tolist())) == len(rows)
    assert len(got) == s.n_iters(n)
    if drop:
        assert all(len(b) == batch for b in got)
        assert len(rows) == (n - start) // batch * batch
    else:
        assert sorted(rows.tolist()) == list(range(start, n))
    if not shuffle:
        assert rows.tolist() == list(range(start, start + len(rows)))


def test_last_batch_and_requests():
    s = SequentialSampler(10, 2, 5)
    requests = list(s.sample(103))
    assert len(requests) == 6 and len(requests[-1]["splits"][-1]) == 3


@pytest.mark.parametrize(("num", "batch", "drop", "want"), [(37, 5, False, 8), (37, 5, True, 7), (40, 5, False, 8), (1, 5, False, 1)])
def test_num_samples(num, batch, drop, want):
    s = RandomSampler(10, 2, batch, num_samples=num, drop_last=drop, rng=0)
    assert len(seen(s, 100)) == want == s.n_iters(100)


def test_replacement():
    s = RandomSampler(10, 2, 5, replacement=True, num_samples=137, rng=4)
    got = seen(s, 60)
    assert sum(map(len, got)) == 137 and all(0 <= r < 60 for b in got for r in b)
    assert len(got) == s.n_iters(60)
    dropped = RandomSampler(10, 2, 5, replacement=True, num_samples=37, drop_last=True, rng=4)
    assert len(seen(dropped, 60)) == dropped.n_iters(60) == 6


def test_same_seed_same_order():
    a, b, c = (np.concatenate(seen(RandomSampler(10, 2, 5, rng=r), 103)) for r in (1, 1, 2))
    assert a.tolist() == b.tolist() != c.tolist()


def test_workers_are_disjoint_and_complete():
    got = [np.concatenate(seen(RandomSampler(10, 2, 1, rng=3, worker=(w, 3)), 107)) for w in range(3)]
    assert sorted(np.concatenate(got).tolist()) == list(range(107))
    for bad in (RandomSampler(10, 2, 5, rng=0, worker=(0, 2)), RandomSampler(10, 2, 5, rng=0, replacement=True, worker=(0, 2)), RandomSampler(60, 2, 1, rng=0, worker=(0, 3))):
        with pytest.raises(ValueError):
            list(bad.sample(107))


@pytest.mark.parametrize(("equal", "want"), [(True, 30), (False, 35)])
def test_ranks(equal, want):
    got = [np.concatenate(seen(DistributedSampler(SequentialSampler(10, 1, 10), dist_info=lambda r=r: (r, 3), enforce_equal_batches=equal), 107)) for r in range(3)]
    assert [len(g) for g in got] == [want] * 3 and len(set(np.concatenate(got).tolist())) == 3 * want
    with pytest.raises(ValueError):
        DistributedSampler(SequentialSampler(10, 1, 10), dist_info=lambda: (0, 30)).validate(107)
    with pytest.raises(ValueError):
        DistributedSampler(SequentialSampler(10, 1, 10), dist_info="unknown")


@pytest.mark.parametrize("make", [
    lambda: RandomSampler(0, 1, 1), lambda: RandomSampler(2, 2, 5), lambda: RandomSampler(5, 2, 3), lambda: RandomSampler(2, 2, 2, num_samples=0),
    lambda: SequentialSampler(2, 2, 2, mask=slice(3, 3)), lambda: SequentialSampler(2, 2, 2, mask=slice(-1, 3)), lambda: SequentialSampler(2, 2, 2, mask=slice(0, 4, 2)),
])
def test_rejected_arguments(make):
    with pytest.raises(ValueError):
        make()


def test_validation_by_rows():
    for s, n in ((SequentialSampler(2, 2, 2, mask=slice(0, 9)), 8), (SequentialSampler(2, 2, 2, mask=slice(9, None)), 9), (RandomSampler(2, 2, 2, num_samples=9, rng=0), 8), (RandomSampler(20, 1, 2, num_samples=19, replacement=True, rng=0), 8)):
        with pytest.raises(ValueError):
            s.validate(n)


def test_deprecated_alias():
    with pytest.warns(DeprecationWarning):
        assert len(seen(ChunkSampler(10, 2, 5), 100)) == 20


class Own(Sampler):
    def __init__(self, batch, shuffle):
        self.b, self.s = batch, shuffle

    batch_size = property(lambda self: self.b)
    shuffle = property(lambda self: self.s)

    def n_iters(self, n_obs):
        return -(-n_obs // self.b)

    def validate(self, n_obs):
        pass

    def _sample(self, n_obs):
        yield {"chunks": [slice(0, n_obs)]}


def test_splits_are_filled_in():
    assert [len(b) for b in seen(Own(4, False), 10)] == [4, 4, 2]
    assert sorted(np.concatenate(seen(Own(4, True), 10)).tolist()) == list(range(10))
    with pytest.raises(ValueError):
        list(Own(None, True).sample(10))
