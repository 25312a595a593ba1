"""What samplers and loaders hand over."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, NotRequired, TypedDict

import numpy as np
from pyspark.sql import DataFrame


class LoadRequest(TypedDict):
    """Rows to hold in memory at once, and how they become batches.

    chunks: slices of the virtual row range, in the order asked for. In memory rows stand by dataset, then in that order.
    splits: for each batch the positions of its rows in memory; a sampler may leave them out.
    """

    chunks: list[slice]
    splits: NotRequired[list[np.ndarray]]


class LoaderOutput(TypedDict):
    """One batch: the matrix, its rows' annotations, the features' annotations, and the rows' global numbers if asked for."""

    X: Any
    obs: Any
    var: Any
    index: np.ndarray | None


@dataclass
class CSR:
    """Sparse rows: row i holds values[indptr[i]:indptr[i+1]] at columns indices[...]."""

    values: np.ndarray
    indices: np.ndarray
    indptr: np.ndarray
    shape: tuple[int, int]

    def toarray(self) -> np.ndarray:
        out = np.zeros(self.shape, self.values.dtype)
        np.add.at(out, (np.repeat(np.arange(self.shape[0]), np.diff(self.indptr)), self.indices), self.values)
        return out

    def to_scipy(self):
        """A scipy.sparse.csr_matrix of the same arrays; needs scipy."""
        from scipy.sparse import csr_matrix

        return csr_matrix((self.values, self.indices, self.indptr), shape=self.shape)

    def take(self, rows: np.ndarray) -> CSR:
        n = np.diff(self.indptr)[rows]
        ptr = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(self.indptr[rows] - ptr[:-1], n) + np.arange(ptr[-1])
        return CSR(self.values[at], self.indices[at], ptr, (len(rows), self.shape[1]))


@dataclass
class Annotated:
    """A matrix with annotated rows and columns.

    rows: one row an observation: ``obs_name`` and annotations, the matrix as ``x`` (array, nested arrays, or
    struct<indices, values>), further matrices of the same rows as ``layer_*`` and ``obsm_*``.
    var: ``var_id`` (0..) and ``var_name``, or None. order: columns that give the rows' order.
    """

    rows: DataFrame
    var: DataFrame | None = None
    order: list[str] = field(default_factory=list)

    @property
    def obs_columns(self) -> list[str]:
        return [c for c in self.rows.columns if c != "x" and not c.startswith(("layer_", "obsm_", "_")) and c not in self.order]
