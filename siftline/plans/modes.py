"""Modes, depths and lanes: the small dimension tables that steer a run, and the planning of its questions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions.text import identifiers, plan_variants, query_tokens
from siftline.operators.dedup import _cut as cut

from .facets import facet_queries, facet_question

# Limits by depth.
DEPTHS = {
    "summary": {"per_source": 4, "max_sources": 10, "floor": 3, "pages": 1, "breadth": 1, "overshoot": 5, "queries": 2, "sweep": 2},
    "standard": {"per_source": 6, "max_sources": 25, "floor": 6, "pages": 2, "breadth": 2, "overshoot": 10, "queries": 4, "sweep": 4},
    "deep": {"per_source": 10, "max_sources": 60, "floor": 12, "pages": 3, "breadth": 5, "overshoot": 20, "queries": 6, "sweep": 8},
}
MAX_SUB_QUESTIONS = 6
WEB_ENGINES = ["searxng", "duckduckgo", "ddglite", "mojeek", "marginalia", "firecrawl"]


@dataclass(frozen=True)
class Mode:
    backends: tuple[str, ...]
    deep_only: tuple[str, ...]
    extras: tuple[str, ...]
    headings: tuple[str, ...]


# What each mode searches and what its report has.
MODES = {
    "topic": Mode(("wikipedia", "searxng", "duckduckgo", "standards"), (), (), ("What it is", "How it works / key concepts", "History & evolution", "Current state (today)", "Notable variants / approaches", "Controversies & open debates", "Practical implications")),
    "bug": Mode(("stackexchange", "github", "duckduckgo", "hackernews", "standards"), ("searxng",), (), ("Symptom & reproduction", "Root cause analysis", "Candidate fixes (ranked)", "Related issues & versions affected", "Workarounds", "If still stuck (next diagnostics)")),
    "research": Mode(("arxiv", "openalex", "crossref", "semanticscholar", "europepmc"), ("pubmed", "dblp", "duckduckgo", "wikipedia"), ("bibtex",), ("Background & motivation", "Key papers (chronological)", "Methods & approaches compared", "Findings & consensus", "Gaps & open problems", "Future directions")),
    "learn": Mode(("wikipedia", "duckduckgo", "searxng"), ("standards",), ("glossary", "exercises"), ("Learning objectives", "Prerequisites", "Lesson", "Worked examples", "Exercises", "Further reading")),
    "startup": Mode(("duckduckgo", "searxng", "hackernews"), ("wikipedia",), (), ("Problem & customer", "Market sizing (TAM / SAM / SOM)", "Competitive landscape", "Pricing & business models observed", "Go-to-market channels", "Trends & timing", "Risks & moats")),
}


def modes(spark: SparkSession) -> DataFrame:
    rows = [(name, list(m.backends), list(m.deep_only), list(m.extras), list(m.headings)) for name, m in MODES.items()]
    return spark.createDataFrame(rows, "name string, backends array<string>, deep_only array<string>, extras array<string>, headings array<string>")


def run_lanes(runs: DataFrame) -> DataFrame:
    """backend and pos (from 0) of each run (mode, depth): the backends of its mode, and the deep ones behind them where it is deep; unknown modes have none."""
    known = F.broadcast(modes(runs.sparkSession).select(F.col("name").alias("mode"), "backends", "deep_only"))  # five rows
    lane = F.when(F.col("depth") == "deep", F.array_distinct(F.concat("backends", "deep_only"))).otherwise(F.col("backends"))
    return runs.join(known, "mode").select(*runs.columns, F.posexplode(lane).alias("pos", "backend"))


def resolve_backends(mode: str, depth: str, only: list[str] | None = None, engine: str | None = None, profile: str | None = None) -> list[str]:
    """The backends of a run: those named, or those of the mode (and its deep ones); ``engine`` replaces the web lanes; profiles narrow or widen."""
    m = MODES[mode]
    found = list(dict.fromkeys(only or [*m.backends, *(m.deep_only if depth == "deep" else ())]))
    if engine == "none":
        found = [b for b in found if b not in WEB_ENGINES]
    elif engine:
        found = [engine, *[b for b in found if b not in WEB_ENGINES]]
    if profile == "max":
        found = list(dict.fromkeys([*found, *m.deep_only, *WEB_ENGINES[:4]]))
    elif profile == "light":
        found = found[:3]
    return found


SCAFFOLD = r"(?i)^(what|how|why|when|where|who|which)\b.*?\b(is|are|was|were|do|does|did|can|should|would)\s+(an?\s+|the\s+)?"


def subject_of(question: Column) -> Column:
    """What a question is about: without interrogative scaffolding and question mark."""
    bare = F.trim(F.regexp_replace(F.trim(question), r"\?+$", ""))
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(bare, SCAFFOLD, "")), F.lit("")), bare)


def facet_candidates(questions: DataFrame) -> DataFrame:
    """question_id, ord, question, facet, queries: an identifier drill where a question has identifiers, and a sub-question for each heading of its mode's report.

    ``questions`` has question_id, question and mode; unknown modes have no headings.
    """
    asked = F.trim(F.coalesce("question", F.lit("")))
    rows = questions.select("question_id", asked.alias("whole"), "mode").withColumns({"ids": identifiers(F.col("whole")), "subject": subject_of(F.col("whole"))})
    rows = cut(rows)  # long expressions, used several times below
    drill = rows.filter(F.size("ids") > 0).select("question_id", F.lit(0).alias("ord"), F.concat_ws(" ", "whole", F.array_join("ids", " ")).alias("question"), F.lit("identifier").alias("facet"))
    drill = drill.withColumn("queries", plan_variants(F.col("question"), "deep"))
    headings = F.broadcast(modes(questions.sparkSession).select(F.col("name").alias("mode"), "headings"))  # five rows
    every = rows.filter("whole <> ''").join(headings, "mode").select("question_id", "whole", "subject", F.posexplode("headings").alias("ord", "facet"))
    every = cut(every.withColumn("x", facet_question(F.col("subject"), F.col("facet"), F.col("whole"))))
    every = every.select("question_id", (F.col("ord") + 1).alias("ord"), F.col("x.question").alias("question"), "facet", facet_queries(F.col("x.question"), F.col("subject"), F.col("x.terms")).alias("queries"))
    return drill.unionByName(every)


def settle_facets(candidates: DataFrame, most: int = MAX_SUB_QUESTIONS) -> DataFrame:
    """question_id, id (Q1 ..), question, facet, queries of the first ``most`` distinct sub-questions (by lower case) of each question.

    A query that an earlier sub-question of the question has, in whatever case, is not asked again; a sub-question that is left without
    any asks its first. Blank sub-questions go. First wins by two aggregations, over sub-questions and over queries; no row waits for another.
    """
    rows = candidates.filter(F.trim(F.coalesce("question", F.lit(""))) != "").withColumn("question", F.trim("question"))
    first = rows.groupBy("question_id", F.lower("question").alias("low")).agg(F.min_by(F.struct("ord", "question", "facet", "queries"), "ord").alias("r"))
    turn = F.row_number().over(Window.partitionBy("question_id").orderBy("r.ord"))
    kept = first.withColumn("n", turn).filter(F.col("n") <= max(1, most)).select("question_id", "n", "r.question", "r.facet", "r.queries")
    asked = kept.select("question_id", "n", F.posexplode("queries").alias("place", "query"))
    once = asked.groupBy("question_id", F.lower("query").alias("low")).agg(F.min(F.struct("n", "place", "query")).alias("q"))
    fresh = once.groupBy("question_id", F.col("q.n").alias("n")).agg(F.array_sort(F.collect_list(F.struct("q.place", "q.query"))).alias("fresh"))  # a sub-question has a few queries
    own = kept.join(fresh, ["question_id", "n"], "left")
    queries = F.coalesce(F.transform("fresh", lambda x: x["query"]), F.slice("queries", 1, 1))
    return own.select("question_id", F.concat(F.lit("Q"), F.col("n").cast("string")).alias("id"), "question", "facet", queries.alias("queries"))


def plan_questions(questions: DataFrame, most: int = MAX_SUB_QUESTIONS) -> DataFrame:
    """The sub-questions of every question of a table."""
    return settle_facets(facet_candidates(questions), most)


def plan(spark: SparkSession, question: str, mode: str, agent: list[str] | None = None, most: int = MAX_SUB_QUESTIONS) -> DataFrame:
    """The sub-questions of one question, or the given ones, each its own query."""
    if agent:
        given = spark.createDataFrame([(0, i, q.strip(), "agent", [q.strip()]) for i, q in enumerate(agent)], "question_id int, ord int, question string, facet string, queries array<string>")
        found = settle_facets(given, most)
    else:
        found = plan_questions(spark.createDataFrame([(0, question, mode)], "question_id int, question string, mode string"), most)
    return found.drop("question_id").orderBy(F.length("id"), "id")  # a handful of rows


def ambiguity(question: str, clusters: int) -> list[str]:
    """Why a question may be too vague to search."""
    words = len(query_tokens(question))
    asks = bool(re.match(r"\s*(what|how|why|when|where|who|which|is|are|do|does|can|should)\b", question, re.I))
    reasons = []
    if words <= 3:
        reasons.append(f"only {words} content words")
    if not asks and words <= 5:
        reasons.append("short and no question")
    if clusters >= 3 and words <= 4 and not asks:
        reasons.append(f"{clusters} unrelated clusters of titles")
    return reasons
