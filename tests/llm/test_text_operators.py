import math
import pkgutil
import random
import re
import textwrap
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.llm import decontam, licenses, lm, pii, quality, secrets, shared
from siftline.llm.bytesops import ALNUM, LOWER, NONSPACE, segment, span_hashes, text_chunks

from .helpers import PASSAGE, ROWS, documents, lower, spaced, tuples

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB1 \n.é😀 ", max_size=30)), max_size=8), st.integers(1, 40))
def test_words_of_bytes_are_words_of_code_points(texts, limit):
    for table, pattern in ((ALNUM, WORD), (NONSPACE, re.compile(r"[^\x20\x09-\x0D]+"))):
        found = []
        for lo, hi, buf, offsets in text_chunks(pa.array(texts, pa.string()), limit):
            buf = LOWER[buf]
            starts, ends, begins = segment(buf, offsets, table)
            hashes = span_hashes(buf, starts, ends)
            words = [buf[a:b].tobytes() for a, b in zip(starts, ends)]
            assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))
            found += [[w.decode() for w in words[begins[i] : begins[i + 1]]] for i in range(hi - lo)]
        assert found == [pattern.findall(lower(t)) for t in texts]


def brute_contamination(text, items):
    w, hit, named = WORD.findall(lower(text)), set(), set()
    for item_id, item in items:
        v = WORD.findall(lower(item))
        n = min(13, len(v))
        windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
        for k in range(len(w) - n + 1 if n else 0):
            if tuple(w[k : k + n]) in windows:
                hit.update(range(k, k + n))
                named.add("" if item_id is None else str(item_id))
    return len(w), len(hit), sorted(named)


@pytest.mark.parametrize("page_bytes", [1, 1 << 20])
def test_contamination(spark, page_bytes):
    items = [(1, PASSAGE), (2, "Hello, world!"), (10, "two"), (3, None), (4, "..."), (1, "iota kappa lambda mu nu xi omicron pi rho sigma tau and more words"), (5, "word " * 40)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = documents(spark).select("doc_id", "text", decontam.contamination("text", benchmark, page_bytes=page_bytes).alias("x")).collect()
    assert len(found) == len(ROWS)
    for r in found:
        assert (r.x.n_words, r.x.n_hit, r.x.item_ids) == brute_contamination(r.text, items)
        assert sum(s.end - s.first for s in r.x.spans) == r.x.n_hit


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.lists(st.lists(st.sampled_from("abc"), max_size=30), min_size=1, max_size=3))
def test_every_shared_span_is_found(doc, items):
    page = decontam.Page([(i, " ".join(x)) for i, x in enumerate(items)], 13, 5)
    _, _, buf, offsets = next(text_chunks(pa.array([" ".join(doc)])))
    found = {}
    docs = decontam.Words(buf, offsets)
    page.scan(docs, decontam.winnow(docs.hashes, docs.begins), found)
    spans, named = found.get(0, ([], set()))
    want = brute_contamination(" ".join(doc), [(i, " ".join(x)) for i, x in enumerate(items)])
    assert sum(b - a for a, b in decontam._union(spans)) == want[1] and sorted(named) == want[2]


def test_repeated_words_do_not_multiply():
    import tracemalloc

    page = decontam.Page([(k, "word " * 5000) for k in range(40)], 13, 5)
    _, _, buf, offsets = next(text_chunks(pa.array(["word " * 100_000, "other", "word " * 12]), 1 << 62))
    docs, found = decontam.Words(buf, offsets), {}
    tracemalloc.start()
    began = time.time()
    page.scan(docs, decontam.winnow(docs.hashes, docs.begins), found)
    assert time.time() - began < 20 and tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert set(found) == {0} and found[0][0] == [(0, 100_000)] and len(found[0][1]) == 40


def test_windows_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(decontam, "span_hashes", lambda buf, starts, ends: (ends - starts).astype(np.uint64))  # all words of a length collide
    items = [(1, "aa bbb cc"), (2, "dd eee ff"), (3, " ".join(["xx", "yyy"] * 9)), (4, " ".join(["pp", "qqq"] * 9))]
    page = decontam.Page(items, 13, 5)
    text = "dd eee ff gg " + " ".join(["pp", "qqq"] * 8) + " zz aa bbb cc"
    _, _, buf, offsets = next(text_chunks(pa.array([text])))
    docs, found = decontam.Words(buf, offsets), {}
    page.scan(docs, decontam.winnow(docs.hashes, docs.begins), found)
    spans, named = found[0]
    _, hit, want = brute_contamination(text, items)
    assert sum(b - a for a, b in decontam._union(spans)) == hit and sorted(named) == want == ["1", "2", "4"]


def test_empty_benchmark_and_empty_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.contaminated for r in decontam.find_contamination(documents(spark), none).collect()} == {False}
    assert decontam.drop_contaminated(documents(spark), none).count() == len(ROWS)
    assert decontam.find_contamination(documents(spark, []), none).collect() == []


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def runs_by_look_ahead(text):
    """Runs of digit groups as one pattern says it that looks ahead, too slow for long runs."""
    pattern = re.compile(r"(?<![\w@.+/-])\(?[0-9]{1,6}\)?(?:[ -]\(?[0-9]{1,6}\)?)++(?![\w@])")
    return {m.span() for m in pattern.finditer(text) if 7 <= len(re.sub("[^0-9]", "", m.group())) <= 19}


def test_runs_of_digit_groups_are_found_in_one_pass():
    rng = random.Random(6)
    pieces = ["1", "23", "456", "7890123", " ", "-", "(", ")", "a", "@", ".", "  ", "55 ", "0171 ", "12-"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14)))
        base = pii.base_spans(text)
        got = {(x["start"], x["end"]) for x in pii.instances(text, base) if x["seed"] < 0}
        apart = {(a, b) for a, b in runs_by_look_ahead(text) if not any(x < b and a < y for x, _, y in base)}
        assert apart <= got, text
        taken = sorted([(a, b) for a, _, b in base] + list(apart))
        tokens = set()
        for m in re.finditer(r"\S+", text):  # tokens with a digit or an at sign, without punctuation at their ends
            whole, own = m.group(), m.group().strip(pii._EDGE)
            at = m.start() + len(whole) - len(whole.lstrip(pii._EDGE))
            if re.search("[0-9@]", whole) and len(own) >= 5 and not any(x < at + len(own) and at < y for x, y in taken):
                tokens.add((at, at + len(own)))
        assert got == apart | tokens, text


def test_very_long_runs_of_digit_groups():
    began = time.time()
    for text in ("1 " * 500_000 + "1a", "1-" * 500_000 + "a", "(1) " * 250_000 + "1@", "12345678 " * 110_000, "1." * 500_000, "+1 " * 333_000, "1@" * 500_000):
        base = pii.base_spans(text)
        assert all(text[x["start"] : x["end"]].lower() == x["value"] for x in pii.instances(text, base)[:5])
    assert time.time() - began < 60


def brute_pii(text):
    out = []
    for rank, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            odd = sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(digits)))
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and odd % 10 == 0) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end()))
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a@.-+ 0159(2:_%é", max_size=60))
def test_base_spans_by_brute_force(text):
    assert pii.base_spans(text) == brute_pii(text)


def test_base_spans_of_very_long_runs():
    for text in ("a" * 200000, "1" * 200000, "1." * 100000, "@" * 100000, "+1 " * 60000, "1 " * 100000):
        assert isinstance(pii.base_spans(text), list)
    assert pii.base_spans("x@y.z" * 2) == brute_pii("x@y.z" * 2)


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"please dial my number +1 (415) 555-{1000 + i} thanks") for i in range(12)]
    rows += [(100, "please dial my number 555-0199 thanks"), (101, "part 555-0777 of the list"), (102, None), (103, "dial")]
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find_personal_data(documents(spark, rows)).collect()}
    text = rows[12][1]
    at = text.index("555")
    assert found[100] == [(at, 3, at + 8)] and found[101] == found[102] == found[103] == []
    assert all(len(found[i]) == 1 for i in range(12))


def brute_graph(edges):
    """Scores of patterns and unseen instances by dictionaries, round by round."""
    kinds = range(len(pii.KINDS))
    values = {}
    for p, v, seed in edges:
        values.setdefault(p, {})[v] = seed
    seeds = {p: [sum(s == k for s in own.values()) for k in kinds] for p, own in values.items()}
    seeds = {p: n for p, n in seeds.items() if max(n) >= pii.MIN_SEEDS}
    scores, rated = {}, {}
    for _ in range(pii.ROUNDS):
        rated = {}
        for p, n in seeds.items():
            gains = [sum(scores.get(v, [0] * 4)[k] for v, s in values[p].items() if s < 0) for k in kinds]
            rated[p] = [(n[k] + g) / (sum(n) + g + pii.UNSEEN_WEIGHT * max(0, len(values[p]) - sum(n) - g)) for k, g in enumerate(gains)]
        trusted = {p: [min(x[k], 0.95) if x[k] >= pii.PATTERN_SCORE and seeds[p][k] >= pii.MIN_SEEDS else 0 for k in kinds] for p, x in rated.items()}
        scores = {}
        for p, x in trusted.items():
            if max(x) > 0:
                for v, s in values[p].items():
                    if s < 0:
                        scores.setdefault(v, [1.0] * 4)
                        scores[v] = [m * (1 - q) for m, q in zip(scores[v], x)]
        scores = {v: [1 - m for m in x] for v, x in scores.items()}
    return rated, {v: max((x[k], k) for k in kinds) for v, x in scores.items() if max(x) >= pii.INSTANCE_SCORE}


def test_graph_scores_by_brute_force(spark):
    random.seed(21)
    edges = set()
    for v in range(120):
        seed = random.choice([-1, -1, 0, 1, 3])
        for _ in range(random.randint(1, 4)):
            edges.add((f"p{random.randint(0, 6) if seed == 3 or seed < 0 and v % 3 else random.randint(5, 25)}", f"v{v}", seed))
    edges |= {("hot _", f"v{v}", 3 if v % 9 else -1) for v in range(900, 1400)}
    rated, found = pii.score_graph(spark.createDataFrame(sorted(edges), "pattern string, value string, seed int"))
    want_rated, want = brute_graph(edges)
    got = {r.pattern: [r[f"score{k}"] for k in range(4)] for r in rated.collect()}
    assert set(got) == set(want_rated) and all(np.allclose(got[p], want_rated[p]) for p in got)
    assert {r.value: r.kind for r in found.collect()} == {v: k for v, (_, k) in want.items()} and len(want) > 20


#: Contexts of each kind; two thirds of the identifiers in them are seeds, a third can be found by context only.
CONTEXTS = {
    3: ["please dial my number {} thanks", "reach our desk under phone {} today", "the hotline {} is open"],
    0: ["send mail to address {} soon", "my inbox is {} for now"],
    2: ["pay with credit card {} online", "charge the card number {} now"],
}
CLEAN = ["part number {} of the list", "the year {} was cold", "see room {} upstairs", "version {} of the tool", "order {} has shipped", "a total of {} people", "line {} of the file"]


def labelled_texts():
    """(doc_id, text), and the spans that are personal data but no match of a fixed pattern."""
    random.seed(31)
    rows, hidden = [], {}

    def digits(n):
        return "".join(random.choice("0123456789") for _ in range(n))

    def luhn(n):
        body = random.choice("45") + digits(n - 2)
        return next(body + c for c in "0123456789" if pii._luhn(body + c))

    for d in range(900):
        kind = random.choice([*CONTEXTS, None, None])
        if kind is None:
            rows.append((d, "some text, " + random.choice(CLEAN).format(random.choice([digits(6), f"{digits(3)}-{digits(4)}", f"v{digits(2)}.{digits(3)}"])) + " and on."))
            continue
        hide = random.random() < 0.33
        value = {3: f"+1 415 {digits(3)} {digits(4)}", 0: f"user{digits(3)}@mail{digits(2)}.org", 2: luhn(16)}[kind]
        if hide:
            value = {3: random.choice([f"0{digits(3)} {digits(3)} {digits(4)}", f"{digits(3)}-{digits(4)}"]), 0: f"user{digits(3)}@localhost", 2: f"{digits(4)}-{digits(4)}-{digits(3)}"}[kind]
        text = "some text, " + random.choice(CONTEXTS[kind]).format(value) + " and on."
        if hide:
            a = text.index(value)
            hidden[d] = (a, kind, a + len(value))
        rows.append((d, text))
    return rows, hidden


def test_precision_and_recall_of_what_contexts_discover(spark):
    rows, hidden = labelled_texts()
    found = {(r.doc_id, tuple(x)) for r in pii.find_personal_data(documents(spark, rows)).collect() for x in r.spans if x not in r.base}
    want = set(hidden.items())
    precision, recall = len(found & want) / max(1, len(found)), len(found & want) / len(want)
    print(f"discovered {len(found)} of {len(want)}: precision {precision:.3f}, recall {recall:.3f}")
    assert precision >= 0.9 and recall >= 0.9, (sorted(found - want)[:10], sorted(want - found)[:10])


def test_a_hot_value_and_very_long_tokens(spark):
    rows = [(i, f"please dial my number +1 (415) 555-{1000 + i} thanks") for i in range(12)]
    rows += [(100 + i, "please dial my number 0171 555 0199 thanks") for i in range(200)]
    rows += [(500, "9" * 100_000), (501, "1 2 " * 50_000), (502, "@a" * 50_000)]
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find_personal_data(documents(spark, rows)).collect()}
    a = rows[12][1].index("0171")
    assert all(found[100 + i] == [(a, 3, a + 13)] for i in range(200)) and found[500] == found[501] == found[502] == []


def test_tables_of_rounds_have_few_files(spark, monkeypatch):
    rows, _ = labelled_texts()
    paths, write = [], shared.write_rows
    monkeypatch.setattr(shared, "write_rows", lambda df, path: (paths.append(path), write(df, path))[1])
    monkeypatch.setattr(shared, "ROWS_A_FILE", 1000, raising=False)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(held, ("40", "false"), strict=True):
            spark.conf.set(k, v)
        found = pii.find_personal_data(documents(spark, rows)).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sum(len(r.spans) > len(r.base) for r in found) > 100
    small = [p.removeprefix("file://") for p in paths if "-pii-" not in p]
    sizes = [(len(list(Path(p).glob("part-*"))), spark.read.parquet(p).count()) for p in small]
    assert len(sizes) >= 10 and all(files <= -(-n // 1000) or files == 1 for files, n in sizes) and max(files for files, _ in sizes) > 1, sizes


def test_personal_data_of_all_rows(spark):
    found = pii.find_personal_data(documents(spark)).collect()
    assert len(found) == len(ROWS)
    texts = {d: t for d, t in ROWS if d is not None}
    for r in found:
        if r.doc_id is not None:
            assert [tuple(s) for s in r.base] == brute_pii(texts[r.doc_id] or "")
    assert pii.find_personal_data(documents(spark, [])).collect() == []


def brute_secrets(text):
    out = []
    for rank, (pattern, good) in enumerate(((secrets.ASSIGN, lambda m: len(m[2]) >= 12), (secrets.ACCESS, lambda m: len(m[0]) >= 18), ("[0-9a-f]+", lambda m: len(m[0]) >= 16))):
        out += [(m.start(), rank, m.end()) for m in re.finditer(pattern, text) if good(m)]
    return sorted(out)


def test_secrets_by_brute_force(spark):
    tricky = ["secret=token=abcdefghijkl", 'token = "secret:xyzxyzxyzxyz"', "😀 api_key: 'AbC123+/_.=-x' apikey=zzzzzzzzzzzz", "AKIAAKIA AKIA1234567890ABCD", "abcdef0123456789" * 900 + " " + "g " * 50 + "0123456789abcdef", "x AKIAABCDEFGHIJKLMN" * 400]
    rows = ROWS + [(100 + i, t) for i, t in enumerate(tricky)]
    found = secrets.find_secrets(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    texts = {d: t for d, t in rows if d is not None}
    for r in found:
        if r.doc_id is not None:
            assert [tuple(s) for s in r.base] == brute_secrets(texts[r.doc_id] or "")
            assert set(map(tuple, r.base)) <= set(map(tuple, r.spans))
    assert secrets.find_secrets(documents(spark, [])).collect() == []


def test_window_entropy_by_brute_force(spark):
    values = ["aB3dE5gH7jK9mN1pQ2sT4", "0" * 25, "abcabcabcabcabcabcabcabc" * 3, "Zx8Qk2Lp0Vn4Rt6Ym1Ws3Ub"]

    def brute(v):
        best = 0.0
        for i in range(len(v) - secrets.WINDOW + 1):
            n = Counter(v[i : i + secrets.WINDOW])
            best = max(best, -sum(c / secrets.WINDOW * math.log2(c / secrets.WINDOW) for c in n.values()))
        return best

    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", secrets.window_entropy(F.col("v")).alias("e")).collect()
    assert all(abs(r.e - brute(r.v)) < 1e-9 for r in got)


def brute_entropy(v):
    """The best window's entropy by whole counts of each window."""
    out = 0.0
    for i in range(len(v) - secrets.WINDOW + 1):
        n = Counter(v[i : i + secrets.WINDOW])
        out = max(out, -sum(c / secrets.WINDOW * math.log2(c / secrets.WINDOW) for c in n.values()))
    return out


def brute_spans(text):
    base = brute_secrets(text)
    out = list(base)
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        v, (a, b) = m[0], m.span()
        digit, lower_case, upper = re.search("[0-9]", v), re.search("[a-z]", v), re.findall("[A-Z]", v)
        if re.fullmatch("[0-9A-Fa-f]+", v):
            least = 3.0 if digit or len(upper) > 3 else None
        elif digit and (lower_case or upper):
            least = 3.7
        elif lower_case and len(upper) > 3:
            least = 4.0
        else:
            least = None
        if least is None or any(re.search(p, v) for p in secrets.ALLOWED) or any(x < b and a < y for x, _, y in base):
            continue
        if brute_entropy(v) >= least:
            out.append((a, 3, b))
    return sorted(out)


def test_entropy_spans_by_brute_force(spark):
    random.seed(11)
    kinds = ["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPabcdefghijklmnop0123456789+/", "aaaaabbb01", "aAbB-_=/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    made = ["".join(random.choice(random.choice(kinds) if k % 3 else kinds[k % len(kinds)]) for _ in range(random.randint(15, 70))) for k in range(300)]
    rows = [(1, "key aGVsbG8gd29ybGQhIT9Zx8Qk2 end"), (2, "id 123e4567-e89b-12d3-a456-426614174000"), (3, "exampleA1b2C3d4E5f6G7h8I9"), (4, "keitkeitkeitkeitkeiteinein plain words"), (5, "g1g1g1g1g1g1g1g1g1g1g1g1g1"), (6, "key qWzRtYpLkJhGfDsXcVbN")]
    rows += [(10 + k, f"é {a} 😀 token: {b}, {c}.") for k, (a, b, c) in enumerate(zip(made, made[1:], made[2:]))]
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.find_secrets(documents(spark, rows)).collect()}
    assert found == {d: brute_spans(t) for d, t in rows}
    assert [len(found[k]) for k in range(1, 7)] == [1, 0, 0, 0, 0, 1]
    assert sum(r[1] == 3 for own in found.values() for r in own) > 100


def test_very_long_candidates(spark):
    random.seed(12)
    noise = "".join(random.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1000))
    rows = [(1, "aB1c" * 250_000), (2, "b " + noise * 300 + " c"), (3, "0a" * 200_000)]
    began = time.time()
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.find_secrets(documents(spark, rows)).collect()}
    assert found == {1: [], 2: [(2, 3, 300_002)], 3: [(0, 2, 400_000)]}
    assert time.time() - began < 60


def test_secrets_stay_in_the_jvm(spark):
    plan = secrets.find_secrets(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowConverters", "")


def test_large_benchmarks_are_joined(spark, monkeypatch):
    """Beyond one page fingerprints are shuffled; the result is that of the page, row for row."""
    rng = random.Random(7)
    vocabulary = ["alpha", "beta", "gamma", "delta", "été", "x1", "ünder", "9"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 6, 12, 13, 14, 25])))) for k in range(30)]
    items += [(3, "one two three"), (40, None), (41, ""), (42, items[0][1]), (None, "delta " * 15), (50, " ".join(PASSAGE.split()))]
    rows = [*ROWS, *[(200 + k, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 120)))) for k in range(40)], *[(300 + k, PASSAGE.title()) for k in range(50)], (400, " ".join(rng.choices(vocabulary, k=20_000)))]
    benchmark = spark.createDataFrame([(i, t, 1, "d") for i, t in items], "item_id long, text string, n_hit int, digest string").repartition(3)
    docs = documents(spark, rows)
    columns = ("doc_id", "n_words", "n_hit", "item_ids", "spans", "contaminated")
    want, kept = tuples(decontam.find_contamination(docs, benchmark), *columns), tuples(decontam.drop_contaminated(docs, benchmark), *docs.columns)
    monkeypatch.setattr(decontam, "PAGE_BYTES", 10)
    assert tuples(decontam.find_contamination(docs, benchmark), *columns) == want
    assert tuples(decontam.drop_contaminated(docs, benchmark), *docs.columns) == kept and 0 < len(kept) < len(rows)
    long_only = benchmark.filter("length(text) > 85")  # no item that is shorter than a window
    assert any(r.n_hit for r in decontam.find_contamination(docs, long_only).collect())
    assert decontam.find_contamination(documents(spark, []), benchmark).collect() == []
    assert decontam.drop_contaminated(documents(spark, []), benchmark).collect() == []


def test_licenses(spark):
    mit = licenses.TEXTS["MIT"]
    rows = [(1, mit), (2, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("SUBLICENSE", "Sub-\n   License").replace(",", " ;")), (3, mit + " more"), (4, None), (5, ""), (1, mit)]
    found = tuples(licenses.find_licenses(documents(spark, rows)), "doc_id", "license_id")
    assert found == sorted([(1, "MIT"), (2, "MIT"), (3, None), (4, None), (5, None), (1, "MIT")], key=repr)
    assert licenses.find_licenses(documents(spark, [])).collect() == []


def test_license_files_as_published(spark):
    def folded(body, mark=""):
        return "\n".join(f"{mark}{x}".rstrip() for line in body.split("\n") for x in [*textwrap.wrap(line, 76), ""])

    t = licenses.TEXTS
    bsd3 = t["BSD-2-Clause"].replace("\nTHIS SOFTWARE", "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE")
    apache = pkgutil.get_data("siftline.llm", "license_texts/Apache-2.0.txt").decode()
    rows = [
        ("MIT", "MIT License\n\nCopyright (c) 2020 X\n\n" + folded(t["MIT"])),
        ("MIT", "The MIT License (MIT)\r\n\r\nCopyright The X Authors\r\n\r\n" + folded(t["MIT"]).replace("\n", "\r\n")),
        ("MIT", "# MIT License\n#\n# Copyright (c) 2020 X\n#\n" + folded(t["MIT"], "# ")),
        ("MIT", "/*\n * Copyright 2020 X\n *\n" + folded(t["MIT"], " * ") + "\n */"),
        ("ISC", "ISC License\n\nCopyright X <x@x.org>\n\n" + folded(t["ISC"])),
        ("0BSD", "BSD Zero Clause License\n\nCopyright (C) 2006 by X\n\n" + folded(t["0BSD"])),
        ("BSD-2-Clause", "BSD 2-Clause License\n\nCopyright (c) 2020, X\nAll rights reserved.\n\n" + folded(t["BSD-2-Clause"])),
        ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2020, X\nAll rights reserved.\n\n" + folded(bsd3)),
        ("Zlib", "zlib License\n\n(C) 2020 X\n\n" + folded(t["Zlib"])),
        ("Apache-2.0", apache.replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2020 X").replace("http://www", "https://www")),
        ("Apache-2.0", apache.split("APPENDIX")[0]),
        *[(k, pkgutil.get_data("siftline.llm", f"license_texts/{name}.txt").decode()) for k, name in licenses.FILES.items()],
        (None, "MIT License\n\nCopyright (c) 2020 X\n\n" + folded(t["ISC"])),
        (None, "MIT License\n\nCopyright notice of X\n\n" + folded(t["MIT"])),
        (None, apache[:-400].replace("APPENDIX", "")),
    ]
    found = licenses.find_licenses(documents(spark, [(k, text) for k, (_, text) in enumerate(rows)])).collect()
    assert {r.doc_id: r.license_id for r in found} == {k: name for k, (name, _) in enumerate(rows)}


def test_planted_licenses_agree_with_sql(spark, tmp_path):
    """Texts of every known licence, as they are, with titles, behind marks, broken and mixed, in Spark and in SQL."""
    import duckdb

    texts = [r.text for r in licenses.known_licenses(spark).collect()]
    rng = random.Random(3)
    notices = ["Copyright (c) 2020 X", "Copyright The X Authors", "copyright notice of X", "(c) 2019 Y", "All rights reserved.", "Copyright: Z", "© W", "Copyright (the software) Q"]
    for text in texts[:]:
        mark = rng.choice(["", "# ", " * ", "// "])
        texts.append("\n".join(mark + x for x in [rng.choice(notices), "", *text.split("\n")]))
        texts.append(text[: len(text) // 2])
        texts.append(text.replace("license", "licence").upper())
    texts += [None, "", "x" * 300_000, texts[0], texts[0]]
    rows = [(k // 2, t, "en", "s", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = sorted(con.sql(licenses.sql()).fetchall(), key=repr)
    assert tuples(licenses.find_licenses(docs), "doc_id", "digest", "license_id") == want
    assert len({x for _, _, x in want if x}) == len(licenses.FILES) + len(licenses.TITLES)


def test_own_known_texts(spark):
    """A caller's texts: two of one digest, an empty one, and many copies of it among the documents."""
    known = spark.createDataFrame([("b", "Some Terms, v1"), ("a", "some terms v1"), ("none", ""), ("c", None), ("other", "Copyright Q\nother terms")], "license_id string, text string")
    rows = [(k, "") for k in range(300)] + [(400, "SOME TERMS: V1"), (401, None), (402, "# Copyright 2020 X\n# other terms"), (403, "other"), (404, "Copyright X\nOther\tterms")]
    found = {r.doc_id: r.license_id for r in licenses.find_licenses(documents(spark, rows), known).collect()}
    assert found == {**{k: "c" for k in range(300)}, 400: "a", 401: "c", 402: "other", 403: None, 404: "other"}
    assert licenses.find_licenses(documents(spark, []), known).collect() == []


def plain_statistics(text):
    """The twelve statistics by plain counting over characters in UTF-8."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    lines = re.findall(rb"[^\n]+", raw)
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    low_words, low_lines = re.findall(rb"[^\x20\x09-\x0D]+", low), re.findall(rb"[^\n]+", low)
    symbols = set(range(33, 44)) | {45, 47} | set(range(58, 65)) | set(range(91, 97)) | set(range(123, 127))

    def count(test):
        return sum(1 for c in raw if test(c))

    size, letters = len(raw) + 50, count(lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) + 40
    own_words, own_lines = len(words) + 8, len(lines) + 2
    # a pair across the end of the text counts once for it
    pairs = len({(a, b) for a, b in zip(low_words, low_words[1:])})
    return [
        math.log1p(len(words)),
        math.log(size / own_words),
        math.sqrt((count(lambda c: 65 <= c <= 90) + 1) / letters),
        math.sqrt(count(lambda c: 48 <= c <= 57) / size),
        math.sqrt(count(lambda c: c in symbols) / size),
        math.sqrt((count(lambda c: c in (44, 46)) + 1) / size),
        math.sqrt(sum(w[-1] in symbols for w in words) / own_words),
        math.log(len(set(low_words)) + 8) / math.log(own_words),
        (pairs, bool(words), own_words),
        (len(set(low_lines)) + 2) / own_lines,
        math.log1p(len(raw) / max(len(lines), 1)),
        math.sqrt(count(lambda c: c >= 128) / size),
    ]


def test_statistics_of_quality_by_plain_counting(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "A", "one", "a b a b a b", "Same line\nSAME LINE\nother", "Ünïcode, Ärger. ñ 12 34!", "x|y$ *z* (w)", "word " * 4000]
    texts += ["".join(rng.choice("abC1 .,\n$é") for _ in range(rng.randrange(1, 400))) for _ in range(60)]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").repartition(3)
    got = {r.k: r.x for r in table.select("k", quality.document_statistics("text").alias("x")).collect()}
    for k, text in enumerate(texts):
        want = plain_statistics(text)
        pairs, some, own = want[8]
        # the last word's pair with what follows in its batch is one more, or one that is there already
        either = [math.log(pairs + extra + 8) / math.log(own) for extra in ((0, 1) if some else (0,))]
        assert min(abs(got[k][8] - x) for x in either) < 1e-9, text
        assert np.allclose(got[k][:8] + got[k][9:], want[:8] + want[9:], atol=1e-9), text


def test_quality_of_no_documents(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality.score_documents(documents(spark, []), labels).collect() == [] and quality.keep_good(documents(spark, []), labels).collect() == []


def test_quality_learns_and_scores_all(spark):
    rng = np.random.default_rng(0)
    words = ["the", "of", "river", "green", "moves", "stone", "light", "over"]
    rows, labels = [], []
    for i in range(400):
        good = i % 3 != 0
        own = rng.choice(words, 60)
        rows.append((i, " ".join(own) + "." if good else " ".join(w.upper() + "!!" for w in own)))
        labels.append((i, int(good), 0))
    rows += [(1000, None), (1001, ""), (1001, ""), (None, "the river")]
    labels += [(5000, 1, 0), (None, 0, 0), (1, None, 0)]
    found = quality.score_documents(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found if r.doc_id is not None)
    assert all(r.predicted == (r.doc_id % 3 != 0) for r in found if r.doc_id is not None and r.doc_id < 400)


def plain_discriminant(x, y):
    """The same discriminant from class arrays, with inverse covariances and determinants."""
    means, spreads = [x[y == k].mean(axis=0) for k in (0, 1)], [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    share = np.array([(y == k).mean() for k in (0, 1)])
    pooled = share[0] * spreads[0] + share[1] * spreads[1]
    unit = np.diag(1 / np.sqrt(np.maximum(np.diag(pooled), 1e-8)))
    parts = []
    for k in (0, 1):
        c = unit @ ((1 - quality.TO_POOLED) * spreads[k] + quality.TO_POOLED * pooled) @ unit
        c = (1 - quality.TO_IDENTITY) * c + quality.TO_IDENTITY * np.trace(c) / len(c) * np.eye(len(c))
        parts.append((means[k], np.linalg.inv(c), np.log(share[k]) - 0.5 * np.linalg.slogdet(c)[1]))

    def score(row):
        logs = [w - 0.5 * (unit @ (row - m)) @ inverse @ (unit @ (row - m)) for m, inverse, w in parts]
        return 1 / (1 + math.exp(-min(35, max(-35, logs[1] - logs[0]))))

    return score


def test_scores_of_documents_by_a_plain_discriminant(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows += [(9001, None), (9002, ""), (9003, "same words"), (9004, "same words"), (9005, "long " * 60_000)]
    given = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    stats = {d: quality.statistics(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0] for d, t in rows}
    learnt = [d for d, _ in rows if d in given and zlib.crc32(str(d).encode()) % 4 != 2]
    score = plain_discriminant(np.array([stats[d] for d in learnt]), np.array([given[d] for d in learnt]))
    found = {r.doc_id: r for r in quality.score_documents(documents(spark, rows), labels).collect()}
    assert set(found) == set(stats) and found[9003].score == found[9004].score and found[9001].score == found[9002].score
    for d, x in stats.items():
        assert abs(found[d].score - score(x)) < 1e-6 and found[d].predicted == (found[d].score >= 0.7)


def test_labels_beyond_the_bound_are_not_learnt_from(spark):
    rows = [(i, "the river moves. " * 9 if i % 2 else "BUY!!! NOW!!! " * 9) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, label int")
    model = quality.fit(documents(spark, rows), labels, most_labels=50)
    least = [r.doc_id for r in labels.orderBy(F.xxhash64("doc_id")).limit(50).collect()]
    assert abs(model.share - np.mean([i % 2 for i in least])) < 1e-9


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score_documents(documents(spark), none).collect()} == {0.5}
    one = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score_documents(documents(spark), one).collect()} <= {0.5, 1.0}
    assert quality.keep_good(documents(spark, []), none).collect() == []


def training(rows):
    """Counts of words and of pairs in the rows that are learnt from; None is the end of a text, 0 its begin."""
    words, pairs, texts = Counter(), Counter(), 0
    for d, t in rows:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 10:
            own = [*spaced(t), None]
            texts += 1
            words.update(own)
            pairs.update(zip([0, *own], own))
    return words, pairs, texts


def smoothed(words, pairs, texts, h, w, mu=lm.MU):
    base = (words[w] + 0.1) / (sum(words.values()) + 0.1 * (len(words) + 1))
    together = 2 ** (pairs[h, w].bit_length() - 1) if pairs[h, w] else 0
    return (together + mu * base) / ((texts if h == 0 else words[h]) + mu)


LM_ROWS = ROWS + [(300 + i, " ".join(f"w{(i * k) % 17}" for k in range(40))) for i in range(60)]


@pytest.mark.parametrize("broadcast", [0, 1 << 24])
def test_scores_by_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 1 << 14)  # several blocks
    monkeypatch.setattr(lm, "PIECE_BYTES", 1 << 12)
    monkeypatch.setattr(lm, "BROADCAST_BYTES", broadcast)
    found = lm.score_documents(documents(spark, LM_ROWS)).collect()
    text = {d: t for d, t in LM_ROWS}
    words, pairs, texts = training(LM_ROWS)
    n, v = sum(words.values()), len(words)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == sorted((d is None, d or 0) for d, _ in LM_ROWS)
    exact = 0
    for r in found:
        assert math.isfinite(r.score) and r.score < 0 and r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 10 == 0)
        if r.doc_id is None:
            continue
        own = [*spaced(text[r.doc_id]), None]
        base = sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert abs(r.base_score - base) < 1e-6 * abs(base)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(words[w] > 0 for w in own), n)
        want = sum(math.log10(smoothed(words, pairs, texts, h, w)) for h, w in zip([0, *own], own))
        assert r.score >= want - 1e-6 * abs(want)  # a false positive of the filter can only raise it
        exact += abs(r.score - want) < 1e-6 * abs(want)
    assert exact > 0.9 * len(found)


def test_probabilities_add_up_to_one_at_most():
    words, pairs, texts = training(LM_ROWS)
    for h in [0, *list(words)[:40]]:
        if h is not None:
            assert sum(smoothed(words, pairs, texts, h, w) for w in [*words, "never seen"]) <= 1 + 1e-9


def test_more_is_scored_than_was_learnt(spark, monkeypatch):
    docs = documents(spark, LM_ROWS)
    few = documents(spark, LM_ROWS[17:19])
    held = tuples(lm.score(docs, lm.fit(few)), "doc_id", "n_tokens", "n_known", "base_score", "score")
    monkeypatch.setattr(lm, "BLOCK_BYTES", 1 << 14)
    monkeypatch.setattr(lm, "PIECE_BYTES", 1 << 12)
    monkeypatch.setattr(lm, "BROADCAST_BYTES", 0)
    model = lm.fit(few)
    assert not model.stores
    dealt = tuples(lm.score(docs, model), "doc_id", "n_tokens", "n_known", "base_score", "score")
    assert [r[:3] for r in held] == [r[:3] for r in dealt] and np.allclose([r[3:] for r in held], [r[3:] for r in dealt])


def test_scores_of_many_pieces_are_few_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 1 << 14)
    monkeypatch.setattr(lm, "PIECE_BYTES", 1 << 12)
    monkeypatch.setattr(lm, "BROADCAST_BYTES", 0)
    own = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16384", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16384"}
    held = {k: spark.conf.get(k, None) for k in own}
    rng = random.Random(7)
    rows = [(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(2000))) for i in range(60)]
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        lm.score_documents(documents(spark, rows)).write.parquet(str(tmp_path / "scores"))
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(list((tmp_path / "scores").glob("part-*"))) <= 2
    assert spark.read.parquet(str(tmp_path / "scores")).count() == len(rows)


def test_filter_has_all_pairs_and_few_others():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 1 << 48, 20000).astype(np.uint64))
    counts = rng.integers(1, 40, len(h))
    store = lm.Store(lm.PAIRS, lm.Sizes(0, 48), [(0, b"", lm.build_filter(h, counts).tobytes())])
    out = store.read(h)
    assert (out >= lm.levels_of(counts)).all() and (out == lm.levels_of(counts)).mean() > 0.99
    others = rng.integers(0, 1 << 48, 20000).astype(np.uint64)
    assert (store.read(others) > 0).mean() < 0.002


@given(st.lists(st.integers(0, (1 << 64) - 1), max_size=50))
def test_hashes_are_written_and_read(values):
    x = np.array(sorted(set(values)), np.uint64)
    assert lm._read_hashes(lm._write_hashes(x)).tolist() == x.tolist() and lm._read_numbers(lm._write_numbers(x)).tolist() == x.tolist()


def test_no_training_rows(spark):
    rows = [(k, "a b") for k in range(400) if zlib.crc32(str(k).encode()) % 10 == 0]
    assert all(math.isfinite(r.score) and r.train_tokens == 0 for r in lm.score_documents(documents(spark, rows)).collect())
    assert lm.score_documents(documents(spark, [])).collect() == []
