"""Near-duplicates by SimHash, diversification, clusters of titles.

Fingerprints at most ``bits`` apart are found with block keys: of ``bits + 3`` blocks at least three
are equal, so rows meet on each choice of three blocks. Only distinct fingerprints meet; copies are
attached by their fingerprint. What is kept is decided in rounds over the pairs, never in one task.
"""

from __future__ import annotations

import tempfile
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.hashing import hamming

MAX_BITS, MIN_CHARS = 3, 500
LAMBDA = 0.75


def _block_keys(fp: Column, bits: int) -> Column:
    n = bits + 3
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [(a, (1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:])]
    keys = []
    for k, chosen in enumerate(combinations(blocks, 3)):
        parts = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit(mask).cast("long")) for a, mask in chosen]
        keys.append(F.struct(F.lit(k).alias("t"), parts[0].alias("a"), parts[1].alias("b"), parts[2].alias("c")))
    return F.array(*keys)


def near_pairs(prints: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct ``fp`` at most ``bits`` apart. Each pair is verified and given once."""
    keyed = _cut(prints.select("fp").distinct()).select("fp", F.explode(_block_keys(F.col("fp"), bits)).alias("key"))
    left, right = keyed.select(F.col("fp").alias("a"), "key"), keyed.select(F.col("fp").alias("b"), "key")
    pairs = left.join(right, "key").filter((F.col("a") < F.col("b")) & (hamming(F.col("a"), F.col("b")) <= bits))
    return pairs.select("a", "b").distinct()


def keep_first(prints: DataFrame, bits: int = MAX_BITS, least_rank: str = "rank") -> DataFrame:
    """(fp, kept): scanning by ``rank`` (distinct), a fingerprint stays unless an earlier one that stays is at most ``bits`` away.

    Each round keeps every undecided fingerprint without an earlier undecided neighbour and drops the
    neighbours of the kept, which gives what the scan gives.
    """
    spark = prints.sparkSession
    ranks = prints.groupBy("fp").agg(F.min(least_rank).alias("rank"))
    pairs = near_pairs(ranks, bits)
    by = [ranks.select(F.col("fp").alias(c), F.col("rank").alias(f"r{c}")) for c in "ab"]
    edges = pairs.join(by[0], "a").join(by[1], "b")
    first = F.col("ra") < F.col("rb")
    edges = edges.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("early"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("late"))
    edges = _cut(edges)
    dropped = spark.createDataFrame([], "fp long")
    live = edges
    while not live.isEmpty():
        heads = live.select(F.col("early").alias("fp")).distinct().join(live.select(F.col("late").alias("fp")).distinct(), "fp", "left_anti")
        gone = _cut(live.join(heads.withColumnRenamed("fp", "early"), "early", "left_semi").select(F.col("late").alias("fp")).distinct())
        dropped = _cut(dropped.unionByName(gone))
        live = _cut(live.join(heads.withColumnRenamed("fp", "early"), "early", "left_anti").join(gone.withColumnRenamed("fp", "early"), "early", "left_anti").join(gone.withColumnRenamed("fp", "late"), "late", "left_anti"))
    return ranks.join(dropped.withColumn("gone", F.lit(True)), "fp", "left").select("fp", F.col("gone").isNull().alias("kept"))


def _cut(df: DataFrame) -> DataFrame:
    """Cuts lineage through the checkpoint folder that the cluster shares."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="siftline-"))
    return df.checkpoint()


def dedupe_near(ranked: DataFrame, fp: str, rank: str, long_enough: Column) -> DataFrame:
    """The rows that stay of a ranked pool; short texts have no fingerprint and always stay."""
    rows = ranked.withColumn("__fp", F.when(long_enough, F.col(fp)))
    best = _cut(rows.filter("__fp is not null").groupBy("__fp").agg(F.min(rank).alias("__best")))
    kept = keep_first(best.select(F.col("__fp").alias("fp"), F.col("__best").alias("rank"))).filter("kept").select(F.col("fp").alias("__fp"))
    winners = best.join(kept, "__fp").select(F.col("__fp").alias("__kept"), "__best")
    copies = rows.filter("__fp is not null").join(winners, (F.col("__fp") == F.col("__kept")) & (F.col(rank) == F.col("__best")), "left_semi")
    return copies.unionByName(rows.filter("__fp is null")).drop("__fp")


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def scan_near(pool: DataFrame, group: str, fp: str, rank: str, bits: int = MAX_BITS) -> DataFrame:
    """(group, rank) of what stays of bounded pools: in the order of ``rank``, a row goes if an earlier one that stays is at most ``bits`` away; null fingerprints stay."""

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        stays = []
        rows = rows.sort_values(rank)
        for x in rows[fp]:
            own = None if pd.isna(x) else int(x) & (1 << 64) - 1
            good = own is None or all((own ^ k).bit_count() > bits for k in kept)
            stays.append(good)
            if good and own is not None:
                kept.append(own)
        return rows[stays][[group, rank]]

    kinds = dict(pool.dtypes)
    # as a decimal a fingerprint beside nulls stays whole in pandas
    return pool.select(group, rank, F.col(fp).cast("decimal(20,0)").alias(fp)).groupBy(group).applyInPandas(scan, f"{group} {kinds[group]}, {rank} {kinds[rank]}")


def diversify(pool: DataFrame, group: str, weight: float = LAMBDA) -> DataFrame:
    """Maximal marginal relevance over bounded pools (a top-k of each group): adds ``mmr_pos``.

    ``pool`` has group, id (for ties), score and tokens. Each pick depends on the ones before, so a
    pool is one task; pools are as small as what a reader looks at.
    """

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        sets = [set(t) for t in rows["tokens"]]
        n = len(rows)

        def jaccard(i: int, j: int) -> float:
            a, b = sets[i], sets[j]
            both = len(a & b)
            return both / (len(a) + len(b) - both) if a and b else 0.0

        alike = [[jaccard(i, j) for j in range(n)] for i in range(n)]
        most = max((alike[i][j] for i in range(n) for j in range(i)), default=0.0)
        top = max(rows["score"].max(), 1e-9)
        gain = [s / top for s in rows["score"]]
        picked, left = ([*range(n)], []) if n <= 2 else ([0], [*range(1, n)])
        near = {i: alike[i][0] / most if most else 0.0 for i in left}
        while left:
            best = min(left, key=lambda i: ((1 - weight) * near[i] - weight * gain[i], rows["id"][i]))
            left.remove(best)
            picked.append(best)
            for i in left:
                near[i] = max(near[i], alike[i][best] / most if most else 0.0)
        return rows.iloc[picked].assign(mmr_pos=range(1, n + 1))[[group, "id", "mmr_pos"]]

    kinds = dict(pool.dtypes)
    return pool.groupBy(group).applyInPandas(order, f"{group} {kinds[group]}, id {kinds['id']}, mmr_pos int")


def cluster_titles(pool: DataFrame, group: str, least: float = 0.2) -> DataFrame:
    """Adds ``cluster``: in the order of ``pos``, a title joins the first cluster whose tokens overlap enough, and adds its own.

    ``pool`` has group, id, pos and tokens, and is bounded like that of ``diversify``.
    """

    def assign(rows: pd.DataFrame) -> pd.DataFrame:
        clusters: list[set[str]] = []
        out = []
        for tokens in rows.sort_values("pos")["tokens"]:
            own = set(tokens)
            if not own:
                out.append(-1)
                continue
            for k, c in enumerate(clusters):
                both = len(c & own)
                if both / (len(c) + len(own) - both) >= least:
                    c |= own
                    out.append(k)
                    break
            else:
                clusters.append(own)
                out.append(len(clusters) - 1)
        return rows.sort_values("pos").assign(cluster=out)[[group, "id", "cluster"]]

    kinds = dict(pool.dtypes)
    return pool.groupBy(group).applyInPandas(assign, f"{group} {kinds[group]}, id {kinds['id']}, cluster int")


def angle_labels(tokens: DataFrame, cluster: str) -> DataFrame:
    """cluster, label: the three most frequent tokens, ties by token. ``tokens`` has a row for each occurrence."""
    counts = tokens.groupBy(cluster, "token").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    best = counts.withColumn("rn", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("n"), "token"))).filter("rn <= 3")
    return best.groupBy(cluster).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "token"))), lambda x: x["token"]), " ").alias("label"))
