"""Read plans (chunks, requests, batches) and preshuffle plans (blocks, datasets) as DataFrames."""

from tessera.plans.blocks import BlockPlan
from tessera.plans.chunks import ChunkPlan

__all__ = ["BlockPlan", "ChunkPlan"]
