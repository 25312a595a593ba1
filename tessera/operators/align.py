"""Aligning feature spaces: outer union by name, restriction, and the rewriting of rows to the united space."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tessera.types import Annotated

#: Up to so many entries, the map from local to united feature numbers is a constant of the expression.
LITERAL_ENTRIES = 200_000
#: Up to so many entries, a source's map from local to united feature numbers is broadcast as one array of 4 bytes each.
MAP_ENTRIES = 32_000_000
#: Up to so many names of a subset are constants of a filter; more are a table to join with.
FILTER_NAMES = 1000
#: Rows of one block in which equal names are numbered.
NAME_BLOCK = 100_000


def union_var(parts: Sequence[DataFrame]) -> DataFrame:
    """var_id, var_name of all parts' features, in the order of their first appearance. Feature tables are small."""
    every = parts[0].select(F.lit(0).alias("_part"), "var_id", "var_name")
    for i, p in enumerate(parts[1:], 1):
        every = every.union(p.select(F.lit(i), "var_id", "var_name"))
    first = every.groupBy("var_name").agg(F.min(F.struct("_part", "var_id")).alias("_first"))
    return first.select((F.row_number().over(W.partitionBy(F.lit(0)).orderBy("_first")) - 1).cast("int").alias("var_id"), "var_name")


def subset_var(var: DataFrame, names: Sequence[str]) -> DataFrame:
    """The features among names, renumbered in var's order; unknown names are ignored."""
    names = list(names)
    if len(names) <= FILTER_NAMES:
        return renumber(var.filter(F.col("var_name").isin(names)))
    given = var.sparkSession.createDataFrame(pa.table({"var_name": pa.array(map(str, names), pa.string())}))
    return renumber(var.join(given, "var_name", "left_semi"))


def intersect_var(var: DataFrame, other: DataFrame) -> DataFrame:
    """var's features that other has too, renumbered in var's order."""
    return renumber(var.join(other.select("var_name"), "var_name", "left_semi"))


def renumber(var: DataFrame) -> DataFrame:
    return var.select((F.row_number().over(W.partitionBy(F.lit(0)).orderBy("var_id")) - 1).cast("int").alias("var_id"), "var_name")


def is_sparse(rows: DataFrame, column: str = "x") -> bool:
    return rows.schema[column].dataType.simpleString().startswith("struct<indices")


def _mapping(old: DataFrame, new: DataFrame) -> DataFrame:
    """_old, _new feature numbers; null _new where the feature is not in new."""
    return old.select("var_name", F.col("var_id").alias("_old")).join(new.select("var_name", F.col("var_id").alias("_new")), "var_name", "left").select("_old", "_new")


def remap(rows: DataFrame, old: DataFrame, new: DataFrame, columns: Sequence[str] = ("x",), n_old: int | None = None, to: pa.Table | None = None) -> DataFrame:
    """rows with their matrices in new's feature numbers. Absent features: 0 (not stored) if sparse, NaN if dense.

    Every row is rewritten where it is: no shuffle, and no row carries the map. It is a constant up to LITERAL_ENTRIES features; beyond,
    sparse matrices take it from an array broadcast to the workers, and beyond MAP_ENTRIES from an equi-join of their elements. A dense
    one's map, no longer than a row of it, is then a row that the join copies beside each.
    """
    own = collected(old)
    target = None if own is None else collected(new) if to is None else to
    if own is not None and target is not None:  # the map is part of the expression: no row carries it
        there, here = ({n: i for i, n in zip(*t.to_pydict().values(), strict=True)} for t in (target, own))
        forth, back = _literal(own, there), _literal(target, here)
        for c in columns:
            rows = rows.withColumn(c, _sparse(F.col(c), forth) if is_sparse(rows, c) else _dense(F.col(c), back))
        return rows
    thin = [c for c in columns if is_sparse(rows, c)]
    if thin and (old.count() if n_old is None else n_old) > MAP_ENTRIES:
        for c in thin:
            rows = _remap_by_join(rows, _mapping(old, new), c)
    elif thin:
        sent = rows.sparkSession.sparkContext.broadcast(_numbers(old, new))
        for c in thin:
            rows = rows.withColumn(c, _renumbering(sent, rows.schema[c].dataType)(F.col(c)))
    if len(thin) == len(columns):
        return rows
    back = new.select("var_name", F.col("var_id").alias("_new")).join(old.select("var_name", F.col("var_id").alias("_old")), "var_name", "left")
    to_old = back.groupBy().agg(F.transform(F.sort_array(F.collect_list(F.struct("_new", "_old"))), lambda s: s["_old"]).alias("_to_old"))  # one row
    out = rows.join(F.broadcast(to_old), F.lit(True))
    for c in columns:
        if c not in thin:
            out = out.withColumn(c, _dense(F.col(c)))
    return out.drop("_to_old")


def _numbers(old: DataFrame, new: DataFrame) -> np.ndarray:
    """The new number of each old one, -1 where the feature is not in new: 8 bytes a feature on their way to the driver, no names."""
    pairs = _mapping(old, new).filter("_new is not null").toArrow()
    before, after = (np.asarray(pairs[c]) for c in ("_old", "_new"))
    out = np.full(int(before.max(initial=-1)) + 1, -1, np.int32)
    out[before] = after
    return out


def _renumbering(sent, kind: T.StructType):
    """A function of a sparse column: its rows in the numbers that the broadcast array gives, ascending, others left out."""

    def renumbered(x: pa.Array) -> pa.Array:
        to_new = sent.value
        idx, val = x.flatten()
        n, n_val = (np.asarray(pc.list_value_length(c).fill_null(0)).astype(np.int64) for c in (idx, val))
        row = np.repeat(np.arange(len(x)), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        local = idx.flatten()
        i = np.asarray(local.fill_null(-1)).astype(np.int64)
        known = (i >= 0) & (i < len(to_new))
        i = np.where(known, to_new[np.where(known, i, 0)], -1) if len(to_new) else np.full(len(i), -1)
        row, place, i = (a[i >= 0] for a in (row, place, i))
        v = val.flatten().take(pa.array((np.cumsum(n_val) - n_val)[row] + place, mask=place >= n_val[row]))
        key = row << 32 | i
        if (np.diff(key) <= 0).any():
            order = np.argsort(key, kind="stable")
            if (np.diff(key[order]) == 0).any():  # a number that a row has twice: by value, as SQL sorts pairs
                order = np.asarray(pc.sort_indices(pa.table({"k": key, "there": v.is_valid(), "v": v}), [(c, "ascending") for c in ("k", "there", "v")]))
            i, v = i[order], v.take(pa.array(order))
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(x)))]).astype(np.int32)
        gone = pa.array(np.asarray(pc.or_(idx.is_null(), val.is_null())))
        lists = [pa.ListArray.from_arrays(pa.array(ends), own, mask=gone) for own in (pa.array(i, pa.int32()), v)]
        return pa.StructArray.from_arrays(lists, ["indices", "values"], mask=x.is_null())

    own = T.StructType([T.StructField("indices", T.ArrayType(T.IntegerType())), T.StructField("values", kind["values"].dataType)])
    return F.arrow_udf(renumbered, own)


def collected(var: DataFrame) -> pa.Table | None:
    """var_id, var_name on the driver, None if there are over LITERAL_ENTRIES of them."""
    out = var.select("var_id", "var_name").limit(LITERAL_ENTRIES + 1).toArrow()
    return out if out.num_rows <= LITERAL_ENTRIES else None


def _literal(var: pa.Table, numbers: dict[str, int]) -> Column:
    """For each feature of var in order its number, -1 where it has none: a constant array, as one text that the optimizer folds."""
    ids, names = var.to_pydict().values()
    out = [-1] * (max(ids, default=-1) + 1)
    for i, name in zip(ids, names, strict=True):
        out[i] = numbers.get(name, -1)
    return F.split(F.lit(",".join(map(str, out))), ",").cast("array<int>") if out else F.array().cast("array<int>")


def _sparse(x: Column, to_new: Column | None = None) -> Column:
    to_new = F.col("_to_new") if to_new is None else to_new
    pairs = F.transform(F.arrays_zip(x["indices"], x["values"]), lambda e: F.struct(F.get(to_new, e["indices"]).alias("i"), e["values"].alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda e: e["i"] >= 0))
    return F.when(x.isNotNull(), F.struct(F.transform(kept, lambda e: e["i"]).alias("indices"), F.transform(kept, lambda e: e["v"]).alias("values")))


def _dense(x: Column, to_old: Column | None = None) -> Column:
    return F.when(x.isNotNull(), F.transform(F.col("_to_old") if to_old is None else to_old, lambda i: F.coalesce(F.when(i >= 0, F.get(x, i)), F.lit(float("nan")))))


def _remap_by_join(rows: DataFrame, maps: DataFrame, column: str) -> DataFrame:
    """By elements; the rest of a row goes along with its first one, as rows made a second time could come in another order."""
    x, rest = F.col(column), F.struct(*(F.col(f"`{c}`") for c in rows.columns if c != column), F.col(column).isNull().alias("_none"))
    keyed = rows.select(F.monotonically_increasing_id().alias("_row"), rest.alias("_rest"), F.arrays_zip(x["indices"].alias("i"), x["values"].alias("v")).alias("_e"))
    long = keyed.select("_row", "_rest", F.posexplode_outer("_e").alias("_at", "_e")).select("_row", F.when(F.coalesce("_at", F.lit(0)) == 0, F.col("_rest")).alias("_rest"), "_e.i", "_e.v")
    pair = F.when(F.col("_new").isNotNull(), F.struct(F.col("_new").alias("i"), "v"))
    back = long.join(maps, long["i"] == maps["_old"], "left").groupBy("_row").agg(F.first("_rest", True).alias("_rest"), F.array_sort(F.collect_list(pair)).alias("_e"))
    made = F.when(~F.col("_rest._none"), F.struct(F.transform("_e", lambda e: e["i"]).alias("indices"), F.transform("_e", lambda e: e["v"]).alias("values")))
    out = back.select(*(made.alias(c) if c == column else F.col(f"_rest.`{c}`").alias(c) for c in rows.columns))
    for c in rows.columns:
        if c != column and rows.schema[c].metadata:
            out = out.withMetadata(c, rows.schema[c].metadata)
    return out


def align(parts: Sequence[Annotated], var: DataFrame | None = None) -> tuple[list[Annotated], DataFrame | None]:
    """All parts in one feature space: the union of theirs, or the one given."""
    if all(p.var is None for p in parts):
        return list(parts), None
    if any(p.var is None for p in parts):
        raise ValueError("features must be named in all parts or in none")
    whole = union_var([p.var for p in parts]) if var is None else var
    out, to = [], collected(whole)
    for p in parts:
        matrices = [c for c in p.rows.columns if c == "x" or c.startswith("layer_")]
        out.append(Annotated(remap(p.rows, p.var, whole, matrices, to=to), whole, p.order))
    return out, whole


def make_unique(rows: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """The first row of a name keeps it; the others get ``-1``, ``-2``, ... in order. order: columns that tell rows apart, the last a number.

    Only repeated names and order columns are ranked, in blocks of NAME_BLOCK of the last one, whose counts are summed before: a name
    that most rows share is spread over blocks. Rows get their number by a join; the matrices are not sorted.
    """
    *lead, last = order
    own = rows.select(name, *order, F.floor(F.col(last) / NAME_BLOCK).alias("_block"))
    repeated = own.groupBy(name).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(name)
    own = own.join(repeated, name)
    count = own.groupBy(name, *lead, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(name).orderBy(*lead, "_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = count.select(name, *lead, "_block", before.alias("_base"))
    inner = F.row_number().over(W.partitionBy(name, *lead, "_block").orderBy(last)) - 1
    rank = own.withColumn("_in", inner).join(base, [name, *lead, "_block"]).select(*order, (F.col("_base") + F.col("_in")).alias("_n")).filter("_n > 0")
    out = rows.join(rank, list(order), "left")
    return out.withColumn(name, F.when(F.col("_n").isNull(), F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), F.col("_n").cast("string")))).select(*rows.columns)


def same_var(a: DataFrame, b: DataFrame) -> bool:
    """Equal names at equal numbers."""
    on = ["var_id", "var_name"]
    return a.select(*on).exceptAll(b.select(*on)).isEmpty() and b.select(*on).exceptAll(a.select(*on)).isEmpty()
