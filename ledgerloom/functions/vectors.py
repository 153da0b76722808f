"""Small dense vectors held as array<double>."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

HELD_VALUES = 4_000_000  # sums that one task holds before it hands them on
SALTS = 64  # tasks' partial sums of one key are added in so many groups first


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def let(value: Column, body) -> Column:
    """Evaluates `value` once per row and hands it to `body`, even inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def l2_normalize(vector: Column) -> Column:
    """Unit vector, or zeros for a zero vector."""
    norm = F.sqrt(total(F.transform(vector, lambda x: x * x)))
    return let(norm, lambda n: F.transform(vector, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x / n)))


def softmax(logits: Column) -> Column:
    def shifted(values: Column) -> Column:
        return let(F.array_max(values), lambda top: F.transform(values, lambda x: F.exp(x - top)))

    scaled = let(logits, shifted)
    return let(scaled, lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t)))


def round6(value: Column) -> Column:
    return F.floor(value * 1_000_000 + 0.5) / 1_000_000


def _partial_sums(keys: list[str], held_values: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums and counts per key and dimension of the `_vector` column, or of the `_sum` and `_n` columns of earlier partial sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        size, kinds = 0, None

        def out() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in held], kind) for i, kind in enumerate(kinds)]
            sums = [pa.array([list(v[j]) for v in held.values()], pa.list_(kind)) for j, kind in enumerate((pa.float64(), pa.int64()))]
            return pa.RecordBatch.from_arrays([*columns, *sums], names=[*keys, "_sum", "_n"])

        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            named = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True))
            place: dict[tuple, int] = {}
            group = np.array([place.setdefault(k, len(place)) for k in named], np.int64)
            merging = "_sum" in batch.schema.names
            lists = batch.column("_sum" if merging else "_vector")
            owner = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
            if not len(owner):
                continue
            first = np.concatenate([[True], owner[1:] != owner[:-1]])
            start = np.flatnonzero(first)
            at = np.arange(len(owner)) - np.repeat(start, np.diff(np.append(start, len(owner))))
            flat = pc.list_flatten(lists)
            n = pc.list_flatten(batch.column("_n")).to_numpy() if merging else flat.is_valid().to_numpy(zero_copy_only=False)
            value = pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
            wide = int(at.max()) + 1
            cell = group[owner] * wide + at
            sums = np.bincount(cell, weights=value, minlength=len(place) * wide).reshape(-1, wide)
            counts = np.bincount(cell, weights=n, minlength=len(place) * wide).astype(np.int64).reshape(-1, wide)
            length = np.zeros(len(place), np.int64)
            np.maximum.at(length, group[owner], at + 1)
            for key, i in place.items():
                if not length[i]:
                    continue
                mine = sums[i, : length[i]], counts[i, : length[i]]
                old = held.get(key)
                if old is None:
                    held[key] = mine[0].copy(), mine[1].copy()
                    size += 2 * int(length[i])
                    continue
                longer, other = (mine, old) if length[i] > len(old[0]) else (old, mine)
                held[key] = longer[0].copy(), longer[1].copy()
                for total, part in zip(held[key], other, strict=True):
                    total[: len(part)] += part
            if size > held_values:
                yield out()
                held, size = {}, 0
        if held:
            yield out()

    return run


def mean_vectors(rows: DataFrame, keys: list[str], vector: Column, name: str, held_values: int = HELD_VALUES, salts: int = SALTS) -> DataFrame:
    """Mean of `vector` per key and dimension, as (keys, `name`).

    Each task adds its vectors up per key; only these sums are shuffled, first within a salt of a key and then per key, so a key
    with a third of all rows is no more than one sum per salt. A null element does not count in its dimension, a shorter vector
    not in the dimensions it lacks; a dimension of nulls alone is null; a key without any element has no row.
    """
    values = rows.select(*keys, vector.cast("array<double>").alias("_vector"))
    schema = StructType([f for f in values.schema if f.name != "_vector"]).add("_sum", ArrayType(DoubleType())).add("_n", ArrayType(LongType()))
    add = _partial_sums(keys, held_values)
    partial = values.mapInArrow(add, schema).withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    merged = partial.repartition(*keys, "_salt").drop("_salt").mapInArrow(add, schema)

    def whole(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(_partial_sums(keys, 1 << 62)(iter(table.combine_chunks().to_batches()))))

    summed = merged.groupBy(*keys).applyInArrow(whole, schema)
    return summed.select(*keys, F.zip_with("_sum", "_n", lambda s, n: F.when(n > 0, s / n)).alias(name))
