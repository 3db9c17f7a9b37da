import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from siftline.llm import quality

from .test_duplicates import brute_components, brute_print
from .test_text_operators import brute_contamination
from .test_tokens_and_files import ids_of
from .helpers import PASSAGE, ROWS, documents, groups, lower


def test_pipeline_by_brute_force(spark, small):
    """Each stage on what its predecessor kept; the classifier's own scores decide the first."""
    import zlib

    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    scored = quality.score_documents(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"))
    good = {r.doc_id for r in scored.filter("predicted = 1").collect()}
    left = [(d, t) for d, t in docs if d in good]
    best = {}
    for d, t in left:
        best[lower(t)] = max(d, best.get(lower(t), d))
    left = [(d, t) for d, t in left if best[lower(t)] == d]
    alive = {c for _, _, c in brute_components([(d, brute_print(t)) for d, t in left])}
    left = [(d, t) for d, t in left if d in alive]
    clean = []
    for d, t in left:
        n, hit, _ = brute_contamination(t, items)
        if not (hit > 0 and 20 * hit >= n):
            clean.append((d, t))
    pieces = corpus_pipeline.run(spark, small).collect()
    got = {}
    for p in pieces:
        got.setdefault(p.doc_id, []).append((p.start, p.length, p.ids_crc32))
    assert set(got) == {d for d, _ in clean} and 0 < len(clean) < len(docs)
    for d, t in clean:
        ids = np.array(ids_of(t, 1), "<u4")
        at = 0
        for start, length, crc in sorted(got[d]):
            assert start == at and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)


def test_stages_return_the_columns_of_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns
        assert stage(spark, docs.limit(0), small).count() == 0


def run_stages(spark, docs, folder, names):
    for name, stage in corpus_pipeline.STAGES:
        if name in names:
            docs = stage(spark, docs, folder)
    return docs


def tables(spark, folder, rows, labels, items):
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_awkward_rows_pass_all_stages(spark, tmp_path):
    """Nulls, repeats, ties, long texts, extra columns with clashing names, and labels that reject nothing."""
    folder = tables(spark, tmp_path, ROWS, [(4, 1, 0), (5, 1, 0), (None, 0, None)], [(1, PASSAGE), (None, None)])
    docs = documents(spark).withColumn("__sl_key", F.lit("mine"))
    left = run_stages(spark, docs, folder, {"quality", "exact_dedup", "near_dedup", "decontamination"})
    assert left.columns == docs.columns
    got = left.collect()
    assert {r["__sl_key"] for r in got} == {"mine"}
    kept = {max((i for i in ids if i is not None), default=None): t for t, ids in groups(ROWS).items()}
    alive = {c for _, _, c in brute_components([(d, brute_print(t)) for d, t in kept.items()])}
    clean = {d for d in alive if not 0 < 20 * brute_contamination(kept[d], [(1, PASSAGE)])[1] >= brute_contamination(kept[d], [])[0]}
    assert sorted(r.doc_id for r in got) == sorted(clean)
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {p.doc_id for p in pieces} == clean


def test_empty_tables_and_missing_labels(spark, tmp_path):
    folder = tables(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, folder).collect() == []
    docs = documents(spark)
    assert run_stages(spark, docs, folder, {"quality"}).collect() == []  # every score is 0.5 without labels
    assert run_stages(spark, docs, folder, {"decontamination"}).count() == len(ROWS)
    assert run_stages(spark, docs.limit(0), folder, {"packing"}).collect() == []
