"""Scans and sinks over Parquet."""

from tessera.sources.scan import concat_rows, default_load, scan_sources, with_row_ids, write_source
from tessera.sources.sink import write_sharded

__all__ = ["concat_rows", "default_load", "scan_sources", "with_row_ids", "write_sharded", "write_source"]
