"""Token-ID files: flat unsigned integers with 64-bit document offsets, memory-mapped.

Documents are range-partitioned and sorted by doc_id; each task writes one part: ``.bin`` (ids, 16 bits where the vocabulary
fits, else 32), ``.idx`` (int64 offsets of its documents within the part, one more than documents) and ``.doc`` (int64 doc_ids).
A part's first id in the whole corpus, its base, is the prefix sum of the parts before it. Files of a failed or repeated
attempt have other names and no row points at them. Readers map the files and touch only what they return.

The ids are those of the tokenizers library for the file; they come from the segment-tree encoder.

Edge cases: null and empty texts hold the end id alone; null doc_ids come first and are stored as the least int64; equal
doc_ids keep all their rows, in the order of a hash of their texts; an empty table gives no parts. The shared folder must be mounted
(``file:``) since files are mapped.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.llm.bpe import _STEP, texts_of, tree_tokenizer
from tessera.llm.common import enter, local_path, materialize, new_path, steps

_NULL = np.iinfo(np.int64).min


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None) -> DataFrame:
    """Writes the parts below path (in the shared folder); returns part, name, n_docs, n_tokens, base, width."""
    where = local_path(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("bpe")
        bpe, cache = tree_tokenizer(tokenizer)
        kind = "<u2" if max(len(bpe.strings), (end_id or 0) + 1) <= 1 << 16 else "<u4"
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        os.makedirs(where, exist_ok=True)
        n_docs = n_tokens = 0
        with open(f"{where}/{name}.bin", "wb") as ids_f, open(f"{where}/{name}.idx", "wb") as idx_f, open(f"{where}/{name}.doc", "wb") as doc_f:
            idx_f.write(np.zeros(1, "<i8").tobytes())
            for batch in batches:
                for rows in steps(batch, limit=_STEP):
                    got = cache.encode(texts_of(rows))
                    ids, ends = got.ids, got.ends[1:]
                    if end_id is not None:
                        ids, ends = np.insert(ids, ends, np.uint32(end_id)), ends + np.arange(1, len(ends) + 1)
                    ids_f.write(ids.astype(kind).tobytes())
                    idx_f.write((n_tokens + ends).astype("<i8").tobytes())
                    doc_f.write(np.asarray(pc.fill_null(rows.column(0), int(_NULL)), "<i8").tobytes())
                    n_docs, n_tokens = n_docs + len(ends), n_tokens + len(ids)
        if n_docs:
            yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "n_docs": [n_docs], "n_tokens": [n_tokens], "width": [int(kind[2])]})
        else:
            for x in ("bin", "idx", "doc"):
                os.remove(f"{where}/{name}.{x}")

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_x"))  # rows of one doc_id are dealt by their texts
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "_x").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_x", "text").select("doc_id", "text")
    parts, _ = materialize(ordered.mapInArrow(run, "part long, name string, n_docs long, n_tokens long, width long"), "token-parts")
    return parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def read_token_files(parts: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the mapped files."""
    where = local_path(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.to_pylist():
                idx = np.memmap(f"{where}/{p['name']}.idx", "<i8", "r")
                doc = np.memmap(f"{where}/{p['name']}.doc", "<i8", "r")
                ids = np.memmap(f"{where}/{p['name']}.bin", f"<u{p['width']}", "r") if idx[-1] else np.zeros(0, "<u2")
                for lo in range(0, len(doc), 4096):
                    hi = min(lo + 4096, len(doc))
                    at = idx[lo : hi + 1].tolist()
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at, at[1:], strict=False)]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc[lo:hi], pa.int64(), mask=np.asarray(doc[lo:hi] == _NULL)), "start": pa.array(idx[lo:hi] + p["base"], pa.int64()), "n_tokens": pa.array(np.diff(idx[lo : hi + 1]), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    spark = parts.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return parts.select("part", "name", "base", "width").repartition(n, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-files")
    parts = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    return read_token_files(parts, path)
