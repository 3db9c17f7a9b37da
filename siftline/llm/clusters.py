"""Clustering of integer vectors around centroids by partial-distance search.

Components become integers, so distances, sums and centroids are exact and equal on any machine. Squared
differences are added up in blocks of components, those of most variance first; a centroid is abandoned
once its partial sum is strictly above the vector's best distance so far, which is at first that of the
centroid nearest in the first block. What is left after the last block has its whole distance, and the
nearest of these, the smaller number among equals, is the nearest of all.

Vectors stay in their tasks: a task returns its sums for each cluster and component, so a round shuffles
and brings to the driver some 2,600 numbers, and the centroids (20 kB) travel with the function.

Rows: vectors that are null, of another length, or with a null or non-finite component are left out; components
beyond 524,288 in absolute value are held to it, for squares of larger ones do not fit a distance of 64 bits;
repeated rows count each; of equal ids the least vector comes first among starts, null ids hash as '';
with fewer vectors than clusters there are as many clusters as vectors; an empty table gives no row.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise

SIZE = 64
CLUSTERS = 40
ROUNDS = 5
BLOCK = 8
SCALE = 256
MOST = 1 << 27
_ROWS = 2048


def quantised(vector: Column | str, size: int = SIZE, scale: int = SCALE) -> Column:
    """The components as integers floor(scale * x); null where the vector cannot be used."""
    own = (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")
    whole = (F.size(own) == size) & F.forall(own, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    held = F.transform(own, lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(-float(MOST))), F.lit(float(MOST)))).cast("int"))
    return F.when(whole, held)


def nearest(rows: np.ndarray, centroids: np.ndarray, order: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each row; ``order`` has the components, most variance first."""
    x, c = rows[:, order].astype(np.int64), centroids[:, order].astype(np.int64)
    partial = ((x[:, None, :block] - c[None, :, :block]) ** 2).sum(axis=2)
    guess = partial.argmin(axis=1)
    best = ((x - c[guess]) ** 2).sum(axis=1)
    row, number = np.nonzero(partial <= best[:, None])
    distance = partial[row, number]
    for lo in range(block, x.shape[1], block):
        distance = distance + ((x[row, lo : lo + block] - c[number, lo : lo + block]) ** 2).sum(axis=1)
        alive = distance <= best[row]
        row, number, distance = row[alive], number[alive], distance[alive]
    first = np.lexsort((number, distance, row))
    first = first[np.concatenate([[True], row[first][1:] != row[first][:-1]])] if len(first) else first
    return number[first], distance[first]


def _matrices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[tuple[int, np.ndarray]]:
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    for lo in range(0, len(flat), _ROWS):
        yield lo, flat[lo : lo + _ROWS]


def _spread(vectors: DataFrame, size: int) -> np.ndarray:
    """The components in order of their variance, the largest first; equal ones by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, size))
        for batch in batches:
            for _, x in _matrices(batch, 0, size):
                x = x.astype(np.float64)
                sums += np.stack([np.full(size, len(x)), x.sum(axis=0), (x * x).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), *map(pa.array, sums)], names=["place", "n", "s", "q"])

    found = vectors.select("vector").mapInArrow(run, "place int, n double, s double, q double").groupBy("place").agg(*(F.sum(c).alias(c) for c in "nsq")).collect()
    variance = np.zeros(size)
    for r in found:
        variance[r.place] = r.q / r.n - (r.s / r.n) ** 2 if r.n else 0.0
    return np.argsort(-variance, kind="stable")


def _moved(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray, block: int) -> np.ndarray:
    """The centroids after one round; the driver gets a row for each cluster and component."""
    clusters, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((clusters, size), np.int64), np.zeros(clusters, np.int64)
        for batch in batches:
            for _, x in _matrices(batch, 0, size):
                number, _ = nearest(x, centroids, order, block)
                np.add.at(sums, number, x.astype(np.int64))
                counts += np.bincount(number, minlength=clusters)
        cluster, place = np.nonzero(np.repeat(counts[:, None], size, axis=1))
        columns = [pa.array(cluster, pa.int32()), pa.array(place, pa.int32()), pa.array(sums[cluster, place]), pa.array(counts[cluster])]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "place", "total", "n"])

    out = centroids.copy()
    found = vectors.select("vector").mapInArrow(run, "cluster int, place int, total long, n long")
    for r in found.groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        out[r.cluster, r.place] = r.total // r.n
    return out


def _assigned(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray, block: int) -> DataFrame:
    """vec_id, cluster, distance of each of ``vectors``."""
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [nearest(x, centroids, order, block) for _, x in _matrices(batch, 1, size)]
            number, distance = (np.concatenate(x) if own else np.zeros(0, np.int64) for x in (list(zip(*own, strict=True)) or [(), ()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "vector").mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def start_hash(vec_id: Column | str) -> Column:
    return F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col(vec_id).cast("string") if isinstance(vec_id, str) else vec_id, F.lit(""))), 256)


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of ``vectors`` (vec_id, vector of ``size`` integers), and the final centroids."""
    starts = vectors.withColumn("hash", start_hash("vec_id")).orderBy("hash", "vector").limit(clusters).collect()
    centroids = np.array([r.vector for r in starts], np.int64).reshape(-1, size)
    order = _spread(vectors, size)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(vectors, centroids, order, block)
    return _assigned(vectors, centroids, order, block), centroids


def centroid_digest(centroid: np.ndarray) -> str:
    import hashlib

    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster_vectors(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each usable vector of ``embeddings`` (vec_id, embedding)."""
    vectors = materialise(embeddings.select("vec_id", quantised("embedding").alias("vector")).filter("vector is not null"), "vectors")
    found, centroids = cluster(vectors, clusters, rounds)
    found = materialise(found, "clusters")
    sums = {r.cluster: r.total for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # one number for each cluster
    digests = [(k, sums[k], sum(sums.values()), centroid_digest(centroids[k])) for k in sorted(sums)]
    named = embeddings.sparkSession.createDataFrame(digests, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The same in SQL, every distance in full."""
    assign = """a{r} AS (SELECT rid, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT rid, k, sum((x - y) * (x - y)) AS d FROM q JOIN c{r} USING (i) GROUP BY rid, k) GROUP BY rid)"""
    move = """c{n} AS (SELECT c.k, c.i, coalesce(m.y, c.y) AS y FROM c{r} c LEFT JOIN (SELECT k, i, (s - ((s % n) + n) % n) // n AS y
  FROM (SELECT k, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM q JOIN a{r} USING (rid) GROUP BY k, i)) m ON m.k = c.k AND m.i = c.i)"""
    parts = [
        "v AS (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "q AS (SELECT rid, unnest(range(1, 65)) AS i, unnest(list_transform(e, lambda x: floor(256 * x)::HUGEINT)) AS x FROM v)",
        f"s AS (SELECT rid, row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, ''))) - 1 AS k FROM v ORDER BY k LIMIT {clusters})",
        "c0 AS (SELECT k, i, x AS y FROM q JOIN s USING (rid))",
    ]
    for r in range(rounds):
        parts += [assign.format(r=r), move.format(r=r, n=r + 1)]
    parts += [assign.format(r=rounds), f"h AS (SELECT k, sha256(string_agg(y::BIGINT::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)"]
    heads = ",\n".join(p.replace(" AS (", " AS MATERIALIZED (", 1) for p in parts)
    return f"""WITH {heads}
SELECT vec_id, k::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN v USING (rid) JOIN h USING (k)"""
