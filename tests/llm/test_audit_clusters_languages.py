import hashlib
import math
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import audit, clusters, languages

from .helpers import ROWS, documents, sha, tuples

# --- filter interaction audit


def brute_failures(text, doc_id, first):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    failed = ""
    failed += "A" * (len(words) < 200)
    failed += "B" * (100 * len(set(words)) < 50 * len(words))
    failed += "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text))
    failed += "D" * bool(re.search("[#$%&*|]", text))
    return failed + "E" * (doc_id is not None and first is not None and doc_id > first)


def brute_audit(rows, labels):
    """Every order applied to every document, one after another."""
    firsts = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            firsts[text or ""] = min(doc_id, firsts.get(text or "", doc_id))
    failed = [(part or "", doc_id, brute_failures(text or "", doc_id, firsts.get(text or ""))) for doc_id, text, part in rows]
    good, toxic = ({d for d, *own in labels if d is not None and own[k] == 1} for k in (0, 1))
    out, shapley = {}, {}
    for part in {p for p, _, _ in failed}:
        for order in map("".join, permutations("ABCDE")):
            for step, own in enumerate(order, 1):
                now = [(d, f) for p, d, f in failed if p == part]
                left = [(d, f) for d, f in now if not set(f) & set(order[: step - 1])]
                gone = [d for d, f in left if own in f]
                shapley[part, own] = shapley.get((part, own), 0) + len(gone)
                out[part, order, step] = (len(left) - len(gone), len(gone), sum(own in f for _, f in now) - len(gone), sum(f == own for _, f in now), sum(d in good for d in gone), sum(d in toxic for d in gone))
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
LABELS = [(1, 1, 0), (2, 0, 1), (5, 1, 1), (5, 0, 0), (6, None, 1), (9, 1, None), (None, 1, 1), (77, 1, 1), (102, 1, 0), (104, 0, 1)]


def with_source(spark, rows):
    docs = documents(spark, [(d, t) for d, t, _ in rows]).drop("source")
    sources = spark.createDataFrame([(i, p) for i, (_, _, p) in enumerate(rows)], "at long, source string")
    numbered = spark.createDataFrame([(i, d, t) for i, (d, t, _) in enumerate(rows)], "at long, doc_id long, text string")
    return numbered.join(sources, "at").drop("at").withColumns({c: F.lit(1) for c in docs.columns if c not in ("doc_id", "text")})


def test_audit_of_awkward_rows(spark):
    rows = [(d, t, ("a", "b", None)[k % 3]) for k, (d, t) in enumerate(ROWS)]
    rows += [(100 + k, "Hot COPY & more " * 70, "a") for k in range(20)] + [(200 + k, "same words " * 300, "b" if k % 2 else None) for k in range(9)]
    rows += [(300, " ".join(f"w{k}" for k in range(250)), "a"), (300, " ".join(f"w{k}" for k in range(250)), "a"), (301, "", None)]
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    assert tuples(audit.audit_documents(with_source(spark, rows), labels), *COLUMNS) == sorted(brute_audit(rows, LABELS), key=repr)


def test_audit_of_no_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit_documents(documents(spark, []), labels).collect() == []
    found = audit.audit_documents(documents(spark, [(1, None)]), labels).collect()
    assert len(found) == 600 and {r.part for r in found} == {"s"} and sum(r.removed for r in found) == 120  # too short, and nothing else


def test_parity_sums_give_back_the_cells(spark):
    rng = np.random.default_rng(5)
    rows = [("p", int(m), int(n)) for m, n in zip(rng.integers(0, 32, 60), rng.integers(1, 1 << 40, 60), strict=True)]
    sums = audit.parity_sums(spark.createDataFrame(rows, "part string, mask int, n long"), ["part"], 5)
    cells = sums.select(audit.mask_cells(F.col("sums"), 5).alias("c")).first().c
    assert cells == [sum(n for _, m, n in rows if m == k) for k in range(32)]


# --- centroid clustering


def brute_clusters(rows, k, rounds):
    vectors = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    by_hash = sorted(vectors, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in by_hash[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in vectors]
        for j in range(len(centres)):
            mine = [v for (_, v), o in zip(vectors, own, strict=True) if o == j]
            if mine:
                centres[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [nearest(v) for _, v in vectors]
    sums = {j: sum(d for d, o in last if o == j) for j in range(len(centres))}
    return sorted(((i, j, d, sums[j], sum(sums.values()), sha(",".join(map(str, centres[j])))) for (i, _), (d, j) in zip(vectors, last, strict=True)), key=repr)


VECTOR_COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def vectors(spark, rows):
    kind = "vec_id long, embedding array<float>, label int, cluster int, hash string, vector string"
    return spark.createDataFrame([(i, v, 1, 7, "h", "v") for i, v in rows], kind).repartition(3)


def test_clusters_of_awkward_vectors(spark):
    rng = np.random.default_rng(3)
    grid = (rng.integers(-3, 4, (90, 64)) / 8).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(grid)] + [(200 + k, grid[0].tolist()) for k in range(60)] + [(5, grid[7].tolist())] * 3
    rows += [(None, grid[3].tolist()), (None, (grid[3] * 0.5).tolist()), (300, None), (301, []), (302, grid[1].tolist()[:63]), (303, [*grid[1].tolist()[:63], None])]
    rows += [(304, [*grid[1].tolist()[:63], float("nan")]), (305, [*grid[1].tolist()[:63], float("inf")]), (306, [float("-inf")] * 64)]
    assert tuples(clusters.cluster_vectors(vectors(spark, rows)), *VECTOR_COLUMNS) == brute_clusters(rows, 40, 5)
    assert tuples(clusters.cluster_vectors(vectors(spark, rows), clusters=7, rounds=3), *VECTOR_COLUMNS) == brute_clusters(rows, 7, 3)


def test_few_or_no_vectors(spark):
    few = [(k, [k / 3] * 64) for k in range(3)] + [(9, None)]
    few = [(i, v and [float(np.float32(x)) for x in v]) for i, v in few]
    assert tuples(clusters.cluster_vectors(vectors(spark, few)), *VECTOR_COLUMNS) == brute_clusters(few, 40, 5)
    assert clusters.cluster_vectors(vectors(spark, [])).collect() == []
    huge = clusters.cluster_vectors(vectors(spark, [(1, [3e38] * 64), (2, [-3e38] * 64)]), clusters=1, rounds=0).collect()
    assert {r.distance for r in huge} == {0, 64 * (2 * clusters.MOST) ** 2}


@pytest.mark.parametrize("block", [1, 8, 64])
def test_partial_distances_lose_no_nearest_centroid(block):
    rng = np.random.default_rng(4)
    x, c = rng.integers(-2, 3, (500, 64)), rng.integers(-2, 3, (40, 64))
    c[31] = c[4]
    number, distance = clusters.nearest(x, c, rng.permutation(64), block)
    whole = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    assert (number == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all() and 31 not in number


# --- language identification


def test_code_words_part_every_pair():
    for n in (2, 3, 4, 5, 6, 20, 127):
        words = languages.code_words(n)
        assert len(words) == n and not (np.abs(words.sum(axis=0)) == n).any()
        apart = min((words[i] != words[j]).sum() for i in range(n) for j in range(i))
        assert apart >= (1 << max(0, n - 2) if n <= 5 else 4)
        assert len({tuple(c * c[0]) for c in words.T.tolist() for c in [np.array(c)]}) == words.shape[1]
    assert languages.code_words(1).shape == (1, 0) and languages.code_words(0).shape == (0, 0)


def brute_grams(text):
    low = bytearray(text.encode().lower())
    for k in range(1, len(low)):
        if low[k - 1] == 0xC3 and 0x80 <= low[k] <= 0x9E and low[k] != 0x97:
            low[k] += 32
    for word in re.findall(rb"[a-z\x80-\xff]+", bytes(low)):
        line = b" " + word + b" "
        for n in languages.LENGTHS:
            for k in range(len(line) - n + 1):
                if n > 1 or k < len(line) - 1:  # the blank behind a word is the one before the next
                    yield line[k : k + n]


def brute_bucket(gram):
    m = 0xFFFFFFFF
    h = (int.from_bytes(gram, "little") ^ (len(gram) * 0x9E3779B)) * 0x9E3779B1 & m
    return ((h ^ (h >> 15)) * 0x85EBCA77 & m) >> (32 - languages.BITS)


def brute_identify(rows):
    training = [(t, g) for d, t, g in rows if zlib.crc32(str("" if d is None else d).encode()) % 4 != 2 and t is not None and g is not None]
    names = sorted({g for _, g in training})
    words = languages.code_words(len(names)).tolist()
    counts = [{} for _ in names]
    for t, g in training:
        for gram in brute_grams(t):
            own = counts[names.index(g)]
            own[brute_bucket(gram)] = own.get(brute_bucket(gram), 0) + 1

    def odds(bucket, bit):
        share = [(c.get(bucket, 0) + 0.5) / (sum(c.values()) + 0.5 * languages.BUCKETS) for c in counts]
        side = [[s for s, w in zip(share, words, strict=True) if w[bit] == sign] for sign in (1, -1)]
        return round((math.log(sum(side[0]) / len(side[0])) - math.log(sum(side[1]) / len(side[1]))) * 1024)

    known = {}

    def margins(text):
        found = [brute_bucket(g) for g in brute_grams(text)]
        return [sum(known.setdefault((b, bit), odds(b, bit)) for b in found) / 1024 / math.sqrt(max(1, len(found))) for bit in range(len(words[0]))]

    wrong = [0] * len(words[0])
    for t, g in training:
        for bit, m in enumerate(margins(t)):
            wrong[bit] += m * words[names.index(g)][bit] <= 0
    weights = [max(0.05, 1 - 2 * w / len(training)) for w in wrong]
    out = []
    for d, t, _ in rows:
        held = zlib.crc32(str("" if d is None else d).encode()) % 4 == 2
        if t is None or not any(c.isalpha() for c in t):
            out.append((d, held, "und", 0.0))
            continue
        own = margins(t)
        loss = [sum(a * (max(0, -m * b) + math.log1p(math.exp(-abs(m)))) for a, m, b in zip(weights, own, w, strict=True)) for w in words]
        shares = [math.exp(min(loss) - x) for x in loss]
        out.append((d, held, names[loss.index(min(loss))], round(max(shares) / sum(shares), 9)))
    return sorted(out, key=repr)


WORDS = {"en": "the of and thing that with hat", "de": "der die und nicht über Straße ÄPFEL", "fr": "le la que été où ÇA ñ"}


def speech(rng, language, n):
    return " ".join(rng.choice(WORDS[language].split(), n))


def language_rows():
    rng = np.random.default_rng(8)
    rows = [(k, speech(rng, language, 3 + k % 9), language) for k in range(30) for language in [sorted(WORDS)[k % 3]]]
    rows += [(100, None, "en"), (101, "", "de"), (102, "12, 34 – 😀", "fr"), (103, "Été", None), (None, "the thing", "en"), (None, None, None), (104, "X", "xx"), (105, "日本", None)]
    return rows + [rows[2]] * 3 + [(106, "Über; Äpfel! " * 4_000 + "the", None), (107, "a" * 100_000, None)]


def language_table(spark, rows):
    kind = "doc_id long, text string, lang string, source string, language int, draw long, score double, held_out int"
    return spark.createDataFrame([(d, t, g, "s", 1, 2, 0.5, 9) for d, t, g in rows], kind).repartition(3)


def test_languages_by_plain_counting(spark):
    rows = language_rows()
    found = languages.identify_documents(language_table(spark, rows))
    got = sorted(((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in found.collect()), key=repr)
    assert got == brute_identify(rows)


def test_long_texts_come_in_whole_pieces(monkeypatch):
    text = "Über die Straße, and the thing; " * 300
    import pyarrow as pa

    model = languages.OutputCode(["a", "b"], languages.code_words(2), np.random.default_rng(1).integers(-9999, 9999, (1, languages.BUCKETS)).astype(np.int32), np.ones(1))
    whole = model.margins(pa.array([text, "x"]))
    monkeypatch.setattr(languages, "_PIECE", 100)
    assert (model.margins(pa.array([text, "x"])) == whole).all()


def test_few_languages(spark):
    one = languages.identify_documents(language_table(spark, [(1, "a b", "en"), (2, "c", None), (3, "1", "en")])).collect()
    assert {r.doc_id: (r.lang_pred, r.score) for r in one} == {1: ("en", 1.0), 2: ("en", 1.0), 3: ("und", 0.0)}
    none = languages.identify_documents(language_table(spark, [(1, "a b", None), (2, None, "en")])).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert languages.identify_documents(language_table(spark, [])).collect() == []


def test_ambiguous_texts_are_flagged(spark):
    rng = np.random.default_rng(9)
    rows = [(k, speech(rng, language, 30), language) for k in range(60) for language in [("en", "de")[k % 2]]] + [(900, "q", None), (901, speech(rng, "en", 40), None)]
    found = {r.doc_id: r for r in languages.identify_documents(language_table(spark, rows)).filter("doc_id >= 900").collect()}
    assert found[900].ambiguous and not found[901].ambiguous and found[901].lang_pred == "en"


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = languages.identify_documents(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found) > 0
