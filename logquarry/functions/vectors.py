"""Vector functions: unit vectors, blockwise cosine search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logquarry.session import durable


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector has no length."""
    n = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / F.nullif(n, F.lit(0.0)))


def _unit(v: list) -> np.ndarray:
    m = np.array(v, dtype=np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


#: Queries and rows of one matrix product.
QUERY_BLOCK, ROW_BLOCK = 2048, 8192


def _query_blocks(files: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors of the stored queries, a block at a time."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    for uri in files:
        where, path = fs.FileSystem.from_uri(uri)
        with where.open_input_file(path) as f:
            for b in pq.ParquetFile(f).iter_batches(QUERY_BLOCK, columns=["q", "v"]):
                yield b.column(0).to_numpy(), _unit(b.column(1).to_pylist())


def search(rows: DataFrame, queries: DataFrame, key: str, vec: str, k: int | None = None, threshold: float | None = None) -> DataFrame:
    """Exact cosine search of a stated query set against all rows, in blocks: (q, key, cos).

    With ``k`` the k best rows of each query (ties: lower key first) and their
    ``rank``, with ``threshold`` all rows at or above it; a row is no neighbour
    of itself.  The rows stay in their partitions: each task holds those of
    its own, reads the queries from the shared folder block by block, and
    hands on k rows a query at most.  NULL vectors are left out.
    """
    q = durable(queries.where(F.col(vec).isNotNull()).select(F.col(key).cast("bigint").alias("q"), F.col(vec).cast("array<double>").alias("v")))
    files = q.inputFiles()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), _unit(b.column(1).to_pylist())) for b in batches if b.num_rows]
        if not held:
            return
        keys, units = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        for ids, qs in _query_blocks(files):
            got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a in range(0, len(keys), ROW_BLOCK):
                near = keys[a : a + ROW_BLOCK]
                sims = qs @ units[a : a + ROW_BLOCK].T
                sims[ids[:, None] == near[None, :]] = -2.0
                if k is None:
                    i, j = np.nonzero(sims >= threshold)
                else:
                    shown = np.round(sims, 12)
                    least = -np.partition(-shown, min(k, len(near)) - 1, axis=1)[:, min(k, len(near)) - 1]
                    i, j = np.nonzero((shown >= least[:, None]) & (sims > -2.0))  # the k best with all ties
                    order = np.lexsort((near[j], -shown[i, j], i))
                    i, j = i[order], j[order]
                    first = np.searchsorted(i, np.arange(len(ids)))
                    kept = np.arange(len(i)) - first[i] < k
                    i, j = i[kept], j[kept]
                got.append((ids[i], near[j], sims[i, j]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([g[c] for g in got])) for c in range(3)], names=["q", "key", "cos"])

    r = rows.where(F.col(vec).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(vec).cast("array<double>").alias("v"))
    found = r.mapInArrow(run, "q bigint, key bigint, cos double")
    if k is None:
        return found
    return found.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.round("cos", 12).desc(), "key"))).where(F.col("rank") <= k)
