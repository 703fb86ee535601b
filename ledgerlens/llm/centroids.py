"""Lloyd's clustering with vectors and centroids sharded by dimension, in whole numbers.

Vectors are laid out once as blocks: a chunk of up to CHUNK vectors, cut into column blocks of
DIMS / BLOCKS components. In each round a task computes, for one chunk and one column block, the exact partial
distances of its vectors to the centroids' slices; the partial distances of a chunk are summed over
its blocks and the least one, of equal ones the first, names the cluster. Each block then sums its own components by
cluster, and each slice of a centroid is updated from the sums of its own columns. What
a task holds is the partial distances of one chunk; what is broadcast is the centroids, K * DIMS numbers.

A chunk is named by the partition and the place in which the scan found it, so laying it out shuffles nothing, and a
vec_id that repeats is no hot key. Each round's centroids are written to the shared folder.

Cases: vectors with another number of components, nulls or non-finite components are left out, and so are null vectors; repeated
rows are vectors of their own, of which those with the same id are ordered by their components in the choice
of centroids; a null id can't be chosen as long as there are others; with fewer than K vectors there are as many centroids;
components of 2**27 and more after scaling are an error, as their squares could not be summed in a long;
empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import table, written

DIMS, K, ROUNDS, BLOCKS, CHUNK, SCALE, SEED = 64, 40, 5, 4, 4096, 256, 2
WIDTH = DIMS // BLOCKS
MOST = 1 << 27

LAID_OUT = "chunk string, block int, n int, ids array<long>, cells array<int>"
PARTIAL = "chunk string, ids array<long>, partial array<long>"
NEAREST = "chunk string, ids array<long>, clusters array<int>, distances array<long>"
SUMS = "cluster int, dim int, total long, n long"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, cells: the vectors that take part, in whole numbers."""
    x = F.col("embedding")
    whole = (F.size(x) == DIMS) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(x.isNotNull() & whole).select("vec_id", F.transform(x, lambda v: F.floor(v.cast("double") * SCALE)).alias("cells"))


def blocks(kept: DataFrame) -> DataFrame:
    """The vectors as chunks of column blocks; the ids stand in a chunk's first block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                piece = batch.slice(at, CHUNK)
                cells = piece.column("cells").flatten().to_numpy().reshape(-1, DIMS)
                if (np.abs(cells) >= MOST).any():
                    raise ValueError(f"components beyond {MOST / SCALE:g} have no exact distance in a long")
                n = len(cells)
                columns = [pa.array(cells[:, b * WIDTH : (b + 1) * WIDTH].ravel().astype(np.int32)) for b in range(BLOCKS)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "chunk": pa.array([f"{part}-{made}"] * BLOCKS),
                        "block": pa.array(range(BLOCKS), pa.int32()),
                        "n": pa.array([n] * BLOCKS, pa.int32()),
                        "ids": pa.array([piece.column("vec_id").to_pylist(), *[None] * (BLOCKS - 1)], pa.list_(pa.int64())),
                        "cells": pa.ListArray.from_arrays(pa.array(np.arange(BLOCKS + 1, dtype=np.int32) * n * WIDTH), pa.concat_arrays(columns)),
                    }
                )
                made += 1

    return written(kept.mapInArrow(run, LAID_OUT), "lloyd-blocks")


def slices(centroids: DataFrame) -> DataFrame:
    """block, slice: for each column block the centroids' components there, centroid by centroid."""
    rows = centroids.groupBy(F.floor(F.col("dim") / WIDTH).cast("int").alias("block"))
    return rows.agg(F.array_sort(F.collect_list(F.struct("cluster", "dim", "value"))).alias("s")).select("block", F.col("s.value").alias("slice"))


def distances(laid: DataFrame, centroids: DataFrame) -> DataFrame:
    """The partial distances of every chunk and column block, vector by vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at = np.array(batch.column("slice")[k].values.to_numpy(), np.int64).reshape(-1, WIDTH)
                cells = batch.column("cells")[k].values.to_numpy().astype(np.int64).reshape(-1, WIDTH)
                out = np.empty((len(cells), len(at)), np.int64)
                for c, centre in enumerate(at):
                    off = cells - centre
                    out[:, c] = np.einsum("ij,ij->i", off, off)
                yield pa.RecordBatch.from_pydict({"chunk": batch.column("chunk").slice(k, 1), "ids": batch.column("ids").slice(k, 1), "partial": pa.array([out.ravel()], pa.list_(pa.int64()))})

    return laid.join(F.broadcast(slices(centroids)), "block").select("chunk", "ids", "cells", "slice").mapInArrow(run, PARTIAL)


def nearest(partial: DataFrame) -> DataFrame:
    """For each chunk the nearest centroid of every vector, and its distance."""

    def run(group: pa.Table) -> pa.Table:
        total, ids = None, None
        for some, own in zip(group.column("partial"), group.column("ids"), strict=True):
            part = some.values.to_numpy()
            total = part if total is None else total + part
            ids = own.as_py() if own.is_valid else ids
        rows = total.reshape(len(ids), -1)
        at = rows.argmin(1)
        return pa.table({"chunk": group.column("chunk").slice(0, 1), "ids": pa.array([ids], pa.list_(pa.int64())), "clusters": pa.array([at.astype(np.int32)], pa.list_(pa.int32())), "distances": pa.array([rows[np.arange(len(rows)), at]], pa.list_(pa.int64()))})

    return partial.groupBy("chunk").applyInArrow(run, NEAREST)


def block_sums(laid: DataFrame, assigned: DataFrame, k: int) -> DataFrame:
    """cluster, dim, total, n: each block's sums of its own components by cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(batch.num_rows):
                cells = batch.column("cells")[j].values.to_numpy().astype(np.int64).reshape(-1, WIDTH)
                clusters = batch.column("clusters")[j].values.to_numpy()
                total = np.zeros((k, WIDTH), np.int64)
                np.add.at(total, clusters, cells)
                n = np.bincount(clusters, minlength=k)
                some = np.flatnonzero(n)
                dims = batch.column("block")[j].as_py() * WIDTH + np.arange(WIDTH)
                yield pa.RecordBatch.from_pydict({"cluster": pa.array(np.repeat(some, WIDTH).astype(np.int32)), "dim": pa.array(np.tile(dims, len(some)).astype(np.int32)), "total": pa.array(total[some].ravel()), "n": pa.array(np.repeat(n[some], WIDTH))})

    both = laid.select("chunk", "block", "cells").join(assigned.select("chunk", "clusters"), "chunk")
    return both.select("block", "cells", "clusters").mapInArrow(run, SUMS).groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def updated(centroids: DataFrame, sums: DataFrame) -> DataFrame:
    """Every centroid moved to the floor of its vectors' mean; one without vectors stays."""
    floor = F.expr("(total - pmod(total, n)) div n")
    return centroids.join(sums, ["cluster", "dim"], "left").select("cluster", "dim", F.coalesce(floor, "value").alias("value"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> DataFrame:
    """cluster, dim, value: the k vectors whose ids have the least hashes."""
    named = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("name"), "cells")
    least = named.orderBy(F.asc_nulls_last("name"), "cells").limit(k)
    numbered = least.agg(F.array_sort(F.collect_list(F.struct(F.col("name").isNull().alias("last"), "name", "cells"))).alias("all")).select(F.posexplode("all").alias("cluster", "one"))
    return numbered.select("cluster", F.posexplode("one.cells").alias("dim", "value"))


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    kept = usable(vectors)
    laid = blocks(kept)
    centroids = written(first_centroids(kept, k, seed), "lloyd-centroids")
    for _ in range(rounds):
        sums = block_sums(laid, nearest(distances(laid, centroids)), k)
        centroids = written(updated(centroids, sums), "lloyd-centroids")
    last = written(nearest(distances(laid, centroids)), "lloyd-nearest")
    rows = last.select(F.explode(F.arrays_zip("ids", "clusters", "distances")).alias("r")).select(F.col("r.ids").alias("vec_id"), F.col("r.clusters").alias("cluster"), F.col("r.distances").alias("distance"))
    per = written(rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")), "lloyd-inertia")
    names = centroids.groupBy("cluster").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("dim", "value"))).getField("value"), ","), 256).alias("centroid_sha256"))
    of_cluster = per.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy())).join(names, "cluster")  # a row a cluster
    return rows.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings in K clusters."""
    return clustered(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _sql() -> str:
    far = "list_sum(list_transform(range(1, {d} + 1), lambda i: (v.cells[i] - c.cells[i]) * (v.cells[i] - c.cells[i])))".format(d=DIMS)
    ctes = [
        "v as (select row_number() over () as id, vec_id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * {s}) as bigint)) as cells from embeddings where len(embedding) = {d} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {d})".format(s=SCALE, d=DIMS),
        f"c0 as (select cast(row_number() over (order by sha256('{SEED}:' || vec_id) nulls last, cells) - 1 as int) as cluster, cells from v qualify cluster < {K})",
    ]
    for r in range(ROUNDS + 1):
        ctes.append(f"a{r} as (select id, vec_id, v.cells, arg_min(cluster, (distance, cluster)) as cluster, min(distance) as distance from (select v.id, v.vec_id, v.cells, c.cluster, cast({far} as bigint) as distance from v cross join c{r} c) v group by all)")
        if r < ROUNDS:
            ctes.append(f"m{r} as (select cluster, list(mean order by i) as cells from (select cluster, i, cast((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) as bigint) as mean from (select cluster, unnest(range(1, {DIMS} + 1)) as i, unnest(cells) as x from a{r}) group by 1, 2) group by 1)")
            ctes.append(f"c{r + 1} as (select c.cluster, coalesce(m.cells, c.cells) as cells from c{r} c left join m{r} m using (cluster))")
    last = ROUNDS
    return f"""with {', '.join(ctes)}
    select vec_id, cluster, distance, cast(sum(distance) over (partition by cluster) as bigint) as cluster_inertia, cast(sum(distance) over () as bigint) as inertia, sha256(array_to_string(c.cells, ',')) as centroid_sha256
    from a{last} join c{last} c using (cluster)"""


OP12_SQL = _sql()
