import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from siftline.llm import exact_dedup, shared, simhash

from .helpers import ROWS, documents, groups, lower, sha, spaced, tuples


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 7, 1000, 5000):
        digests = rng.integers(0, 256, (n, 32), dtype=np.uint8)
        h = exact_dedup.PerfectHash.build(digests)
        assert sorted(h.slots(digests).tolist()) == list(range(n))
        others = rng.integers(0, 256, (50, 32), dtype=np.uint8)
        assert ((0 <= h.slots(others)) & (h.slots(others) < n)).all()


def expected(rows):
    out = []
    for text, ids in groups(rows).items():
        best = max((i for i in ids if i is not None), default=None)
        out += [(i, best, len(ids), sha(text)) for i in ids]
    return sorted(out, key=repr)


def test_exact_groups(spark):
    rows = ROWS + [(100 + i, "Hot Copy" if i % 2 else "hot copy") for i in range(300)] + [(500 + i, f"single {i}") for i in range(200)]
    found = exact_dedup.deduplicate(documents(spark, rows))
    assert tuples(found, "doc_id", "keep_id", "group_size", "text_sha256") == expected(rows)
    kept = found.filter("kept").groupBy("text_sha256").count().collect()
    assert all(r["count"] == 1 for r in kept) and len(kept) == len(groups(rows))
    assert all(r.doc_id == r.keep_id for r in found.filter("kept").collect())


def test_buckets_are_bounded_by_both_deliveries(spark, monkeypatch):
    """One historical digest and many new ones: no task takes more than its share."""
    monkeypatch.setattr(exact_dedup, "BUCKET_DIGESTS", 256)
    seen = []
    whole = exact_dedup.look_up
    monkeypatch.setattr(exact_dedup, "look_up", lambda index, new, buckets: seen.append(new.withColumn("b", exact_dedup._bucket(buckets)).groupBy("b").count()) or whole(index, new, buckets))
    new = spark.range(20_000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("n"))
    found = exact_dedup.group_digests(new.limit(1), new)
    assert found.count() == 20_000 and found.agg(F.sum("group_size")).first()[0] == 20_001
    sizes = [r["count"] for r in seen[0].collect()]
    assert len(sizes) == 79 and max(sizes) < 2 * 256
    none = spark.createDataFrame([], new.schema)
    assert exact_dedup.group_digests(none, new).filter("not historical").count() == 20_000


def test_hot_groups_are_joined_where_their_rows_are(spark):
    rows = spark.range(6000).select(F.when(F.col("id") < 4000, -1).otherwise(F.col("id")).alias("k"), "id")
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("size"))
    got = shared.join_groups(rows, sizes, "k", "size")
    assert got.count() == 6000 and got.filter("k = -1 and size = 4000").count() == 4000


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master, getCheckpointDir = "spark://host:7077", staticmethod(lambda: None)

    class Session:
        sparkContext, conf = Context(), type("Conf", (), {"get": staticmethod(lambda key, default: default)})()

    with pytest.raises(RuntimeError):
        shared.shared_root(Session())


def test_exact_rows_stay_with_their_columns(spark):
    docs = documents(spark)
    kept = exact_dedup.keep_last_of_each(docs)
    assert kept.columns == docs.columns
    want = sorted(((max((i for i in ids if i is not None), default=None), text) for text, ids in groups(ROWS).items()), key=repr)
    assert sorted(((r.doc_id, lower(r.text)) for r in kept.collect()), key=repr) == want


def test_no_rows(spark):
    empty = documents(spark, [])
    assert exact_dedup.deduplicate(empty).collect() == [] and exact_dedup.keep_last_of_each(empty).collect() == []
    assert simhash.near_duplicates(empty).collect() == [] and simhash.keep_one_of_each(empty).collect() == []


def brute_print(text):
    w = spaced(text)
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """prints: list of (id, unsigned); the least id reachable by links of at most 2 bits."""
    keys = sorted({p for _, p in prints})
    root = {p: p for p in keys}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for d, p in prints:
        r = find(p)
        if d is not None and (least.get(r) is None or d < least[r]):
            least[r] = d
        least.setdefault(r)
    return [(d, f"{p:016x}", least[find(p)]) for d, p in prints]


def test_fingerprints_and_components(spark):
    rows = ROWS + [(200 + i, "some words that nearly all of these texts share again and again " * 20 + f"tail{i % 5}") for i in range(40)]
    found = tuples(simhash.near_duplicates(documents(spark, rows)), "doc_id", "fingerprint", "component_id")
    assert found == sorted(brute_components([(d, brute_print(t)) for d, t in rows]), key=repr)


def test_links_of_planted_fingerprints(spark):
    random.seed(7)
    prints, at = [], 0
    for _ in range(30):
        p = random.getrandbits(64)
        for _ in range(random.randint(1, 12)):  # chains of steps of 1 to 3 bits, the sign bit among them
            prints.append((at, p))
            at += 1
            for b in random.sample(range(64), random.randint(1, 3)):
                p ^= 1 << b
    prints += [(at, 0), (at + 1, 1 << 63), (at + 2, (1 << 64) - 1), (None, 3), (at + 3, 0)]
    rows = spark.createDataFrame([(d, p - (1 << 64) if p >> 63 else p) for d, p in prints], "doc_id long, fp long")
    comps = simhash.fingerprint_components(rows)
    got = rows.join(comps, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    assert tuples(got, "doc_id", "fingerprint", "component_id") == sorted(brute_components(prints), key=repr)


def test_one_of_each_component_stays(spark):
    docs = documents(spark)
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    want = {c for _, _, c in brute_components([(d, brute_print(t)) for d, t in ROWS])}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_held_out_rows_are_drawn_by_crc(spark):
    from siftline.llm.quality import held_out

    got = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)
