import json
import random
from itertools import groupby

import pytest

from siftline.operators import grounding, relink, verdicts

LONG = "This claim has quite a few words in it"


def gate(spark, files, sources=(("S1", "a text of 1,987 coins"),), **options):
    reports = spark.createDataFrame([(r, f, t) for r, own in files.items() for f, t in own.items()], "report_id string, file string, text string")
    own = spark.createDataFrame([(r, s, t, f"https://x.org/{s}", 0.5) for r in files for s, t in sources], "report_id string, source_id string, text string, url string, trust double")
    return {r.report_id: r for r in grounding.check(reports, own, **options).collect()}


def test_the_gate_fails_closed(spark):
    found = gate(
        spark,
        {
            "good": {"REPORT.md": f"{LONG} [S1].\n\n{LONG} too [M]."},
            "bare": {"REPORT.md": f"{LONG} [S1].\n\n{LONG} too."},
            "dangling": {"REPORT.md": f"{LONG} [S1][S7]."},
            "only dangling": {"REPORT.md": f"{LONG} [S7]."},
            "appendix": {"REPORT.md": f"{LONG} [M].\n\n## Sources\n- [S1]"},
            "appendix dangling": {"REPORT.md": f"{LONG} [S1].\n\n## References\n- [S8]"},
            "no report": {"SUMMARY.md": f"{LONG} [S1]."},
            "bare summary": {"REPORT.md": f"{LONG} [S1].", "SUMMARY.md": LONG, "notes.md": f"{LONG} [S9]"},
            "summary dangling": {"REPORT.md": f"{LONG} [S1].", "SUMMARY.md": "See [S5]"},
            "hint": {"REPORT.md": f"{LONG} [S1].\n\n> [model-hint] {LONG}"},
            "unknown": {"REPORT.md": f"{LONG} [S1] [todo] [todo]."},
            "empty": {"REPORT.md": ""},
            "null": {"REPORT.md": None},
        },
    )
    assert {k for k, r in found.items() if r.ok} == {"good", "bare summary", "hint", "unknown"}
    assert found["bare"].unsourced == 1 and found["bare summary"].unsourced == 0
    assert found["only dangling"].citations == 0 and found["only dangling"].dangling == 1
    assert found["unknown"].unknown_tokens == 1 and found["good"].model_hints == 1 and not found["no report"].has_report


def test_numerals_sources_and_walls(spark):
    files = {"has": {"REPORT.md": f"{LONG} for 1987 coins [S1]."}, "lacks": {"REPORT.md": f"{LONG} for 55 coins [S1][S2]."}, "unread": {"REPORT.md": f"{LONG} for 55 coins [S2]."}}
    sources = (("S1", "It cost 1,987"), ("S2", None), ("S3", "Checking your browser before accessing"))
    strict = gate(spark, files, sources, strict_numerals=True)
    assert {k for k, r in strict.items() if r.ok} == {"has", "unread"}  # a source without a text is unknown, not lacking
    assert all(r.ok and r.walls == 0 and r.sources == 3 for r in gate(spark, files, sources).values())
    assert not any(r.ok for r in gate(spark, files, sources, least_sources=4).values())
    walled = gate(spark, {"w": {"REPORT.md": f"{LONG} [S3]."}}, sources)["w"]
    assert walled.ok and walled.walls == 1 and walled.uncited == 2


def test_semantic_part_only_adds_failures(spark):
    reports = spark.createDataFrame([(r, "REPORT.md", f"{LONG} [S1].\n\n{LONG} again [S2].") for r in ("all", "some", "none", "refuted", "odd")] + [("bad", "REPORT.md", LONG)], "report_id string, file string, text string")
    sources = spark.createDataFrame([(r, s, "text", 0.5) for r in ("all", "some", "none", "refuted", "odd", "bad") for s in ("S1", "S2")], "report_id string, source_id string, text string, trust double")

    def rows(*own):
        return json.dumps([{"claimId": c, "sourceId": s, "verdict": v} for c, s, v in own])

    one, two = ("C1", "S1", "supported"), ("C2", "S2", "partial")
    files = [("all", 0, rows(one)), ("all", 1, rows(two)), ("some", 0, rows(one)), ("refuted", 0, rows(one, two)), ("refuted", 1, rows(("C2", "S2", "refuted"))), ("odd", 0, rows(one, ("C2", "S2", "perhaps"))), ("bad", 0, rows(one, two))]
    table = spark.createDataFrame(files, "report_id string, file_no int, payload string")

    def passed(**options):
        return {r.report_id for r in verdicts.check_semantic(reports, sources, table, **options).collect() if r.ok}

    assert passed() == {"all", "some", "odd"}
    assert passed(require_verify=True) == {"all"}


def test_worklists_are_capped_for_each_report(spark):
    pairs = spark.createDataFrame([(r, f"C{c}", "S1", c / 10) for r in (1, 2) for c in range(5)], "report_id int, claim_id string, source_id string, trust double")
    got = [(r.report_id, r.claim_id, r.pos) for r in grounding.worklists(pairs, 2).orderBy("report_id", "pos").collect()]
    assert got == [(r, c, p) for r in (1, 2) for c, p in (("C4", 1), ("C3", 2))]


# --- relinking


def one_by_one(sources):
    """Repairs the first source that can be, lists again, and so on."""
    repaired, by_run = {}, groupby(sorted(sources), key=lambda s: s[0])
    left = []
    for run, own in by_run:
        rows = sorted(([int(i[1:]), i, endpoint, held, aim] for _, i, endpoint, held, aim in own))
        tried = set()
        while True:
            free = [r for r in rows if r[2] and r[4] and r[1] not in tried and not any(o is not r and o[3] == r[4] for o in rows)]
            if not free:
                break
            r = free[0]
            tried.add(r[1])
            if r[3] != r[4]:
                r[2], r[3] = False, r[4]
                repaired[run, r[1]] = r[4]
        for r in rows:
            if r[2]:
                twin = next((o[1] for o in rows if o is not r and o[3] == r[4]), None) if r[4] and r[3] != r[4] else None
                left.append((run, r[1], "duplicate" if twin else "not-citable", r[4], twin))
    return repaired, sorted(left, key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_relinking_gives_what_one_by_one_gives(spark, seed):
    rng = random.Random(seed)
    page = [f"https://doi.org/10.1000/{k}" for k in range(9)]
    sources = []
    for run in range(6):
        for k in rng.sample(range(1, 40), 18):
            endpoint = rng.random() < 0.7
            sources.append((run, f"S{k}", endpoint, rng.choice(page) if rng.random() < 0.6 else f"https://x.org/{run}-{k}", rng.choice(page) if endpoint and rng.random() < 0.9 else None))
    rows = [(run, i, f"https://api.x.org/api/v1/{i}" if endpoint else f"https://x.org/{i}", held, "t", f"doi {aim[16:]} here" if aim else "nothing", "file") for run, i, endpoint, held, aim in sources]
    table = spark.createDataFrame(rows, "run int, id string, url string, canonical_url string, title string, text string, backend string").repartition(3)
    fixed, issues = relink.auto_relink(table)
    repaired, left = one_by_one(sources)
    assert {(r.run, r.id): r.canonical_url for r in fixed.filter("moved").collect()} == repaired
    assert sorted(((r.run, r.id, r.reason, r.derived, r.twin) for r in issues.collect()), key=repr) == left
    assert fixed.count() == len(sources)


def test_relinking_awkward_rows(spark):
    kind = "run int, id string, url string, canonical_url string, title string, text string, backend string"
    rows = [(1, "S1", None, None, None, None, None), (1, "x", "https://api.x.org/api/v1/1", None, None, "see 10.1000/a", None), (1, "S3", "https://x.org/", "https://x.org/", None, "Checking your browser", "file")]
    fixed, issues = relink.auto_relink(spark.createDataFrame(rows, kind))
    assert {r.id: r.url for r in fixed.collect()} == {"S1": None, "x": "https://doi.org/10.1000/a", "S3": "https://x.org/"}
    assert {r.id: r.reason for r in issues.collect()} == {"S1": "not-citable", "S3": "wall"}
    none = relink.auto_relink(spark.createDataFrame([], kind))
    assert none[0].collect() == [] and none[1].collect() == []
