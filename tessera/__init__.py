"""Spark-native preparation and serving of mini-batches from annotated matrices."""

from tessera import abc, samplers, types
from tessera.collection import DatasetCollection
from tessera.loader import Loader
from tessera.samplers import ChunkSampler
from tessera.sources import write_sharded

__all__ = ["ChunkSampler", "DatasetCollection", "Loader", "abc", "samplers", "types", "write_sharded"]
__version__ = "0.1.0"
