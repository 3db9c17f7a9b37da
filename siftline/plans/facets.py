"""Sub-questions of a question: what each heading of a report asks about its subject."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.text import first_of_each, keywords, plan_variants, ranked_keywords

# Fixed values, in order: what a heading is recognised by, the question about a subject, the clause that stands
# without one, and the terms that a query gets.
FACETS = (
    ("what it is|definition", "What is {s} and how is it defined?", "what are the key concepts and how are they defined", ("definition", "overview")),
    ("how it works|key concepts|mechanism", "How does {s} work under the hood?", "how do the underlying mechanisms work", ("how it works", "internals")),
    ("history|evolution|background|motivation", "What is the history and motivation behind {s}?", "what is the history and motivation", ("history", "origin")),
    ("current state|today", "What is the current state of {s} today?", "what is the current state today", ("current", "latest")),
    ("variants|approaches|alternatives|compar|methods", "What are the main variants and approaches to {s}, and how do they compare?", "what are the main approaches and how do they compare", ("comparison", "alternatives")),
    ("controvers|debate|gaps|open problem", "What are the open debates, gaps or limitations of {s}?", "what are the open debates, gaps or limitations", ("limitations", "criticism")),
    ("practical|implication|future direction", "What are the practical implications and future directions of {s}?", "what are the practical implications and future directions", ("best practices", "use cases")),
    ("key papers|literature", "What are the key papers and prior work on {s}?", "what are the key papers and prior work", ("paper", "prior work")),
    ("findings|consensus|results", "What are the main findings and consensus on {s}?", "what are the main findings and consensus", ("findings", "evidence")),
    ("symptom|reproduction", "What are the symptoms and how do you reproduce {s}?", "what are the symptoms and how is it reproduced", ("error", "reproduce")),
    ("root cause", "What is the root cause of {s}?", "what is the root cause", ("root cause", "why")),
    ("candidate fix|fixes|solution", "What are the candidate fixes for {s}?", "what are the candidate fixes", ("fix", "resolve")),
    ("related issues|versions affected", "What related issues or affected versions are known for {s}?", "what related issues or affected versions are known", ("issue", "version")),
    ("workaround", "What workarounds exist for {s}?", "what workarounds exist", ("workaround", "mitigation")),
    ("diagnostic", "What further diagnostics help when {s} persists?", "what further diagnostics help", ("debug", "diagnose")),
    ("learning objective|objectives", "What should someone learn first about {s}?", "what should someone learn first", ("basics", "introduction")),
    ("prerequisite", "What are the prerequisites for learning {s}?", "what are the prerequisites", ("prerequisite", "fundamentals")),
    ("lesson|glossary|concept", "What are the core concepts of {s}?", "what are the core concepts", ("concept", "explanation")),
    ("worked example|example", "What are good worked examples of {s}?", "what are good worked examples", ("example", "tutorial")),
    ("exercise", "What exercises help practise {s}?", "what exercises help build proficiency", ("exercise", "practice")),
    ("problem|customer", "What problem does {s} solve and for which customers?", "what problem is solved and for which customers", ("problem", "customer")),
    ("market siz", "How large is the market for {s} (TAM/SAM/SOM)?", "how large is the market (TAM/SAM/SOM)", ("market size", "TAM")),
    ("competit", "Who are the competitors in {s} and how are they positioned?", "who are the competitors and how are they positioned", ("competitor", "alternatives")),
    ("pricing|business model", "What pricing and business models are used in {s}?", "what pricing and business models are used", ("pricing", "business model")),
    ("go-to-market|channel", "What go-to-market channels work for {s}?", "what go-to-market channels work", ("go to market", "acquisition")),
    ("trends|timing", "What trends and timing favour {s} now?", "what trends and timing are favourable now", ("trend", "timing")),
    ("risks|moats", "What are the risks and moats for {s}?", "what are the risks and moats", ("risk", "moat")),
)
# Verbs that make a subject a clause, and how many words do.
CLAUSE_VERBS = (
    "is", "are", "was", "were", "be", "been", "being", "do", "does", "did", "has", "have", "had", "can", "could", "should", "would", "will", "shall",
    "may", "might", "must", "compares?", "compared", "works?", "worked", "deploys?", "deployed", "builds?", "creates?", "uses?", "implements?",
    "runs?", "configures?", "installs?", "handles?", "manages?", "scales?", "optimi[sz]es?", "chooses?", "migrates?", "fix(?:es)?", "debugs?",
    "prevents?", "avoids?", "improves?", "reduces?", "increases?", "affects?", "causes?", "differs?", "relates?", "applies", "integrates?",
    "connects?", "stores?", "processes?", "generates?", "renders?", "parses?", "validates?", "measures?", "monitors?",
)
CLAUSE_WORDS = 8


def is_clause(subject: Column) -> Column:
    """Whether a subject is a clause rather than a noun phrase."""
    return (F.size(F.filter(F.split(subject, r"\s+"), lambda w: w != "")) >= CLAUSE_WORDS) | subject.rlike(rf"(?i)\b({'|'.join(CLAUSE_VERBS)})\b")


def _first_match(heading: Column, value) -> Column:
    out = None
    for row in FACETS:
        own = heading.rlike("(?i)" + row[0])
        out = F.when(own, value(row)) if out is None else out.when(own, value(row))
    return out


def facet_question(subject: Column, heading: Column, question: Column) -> Column:
    """A struct: question, terms. A subject that is a clause is not put into a question but quoted before it."""
    clause = is_clause(subject)
    asked = F.coalesce(_first_match(heading, lambda r: F.replace(F.lit(r[1]), F.lit("{s}"), subject)), F.concat(F.lit("What does the evidence say about "), F.lower(heading), F.lit(" for "), subject, F.lit("?")))
    angle = F.coalesce(_first_match(heading, lambda r: F.lit(r[2])), F.concat(F.lit("what does the evidence say about "), F.lower(heading)))
    quoted = F.concat(F.lit('In the context of "'), F.regexp_replace(F.trim(question), r"\?+\s*$", ""), F.lit('", '), angle, F.lit("?"))
    terms = F.coalesce(_first_match(heading, lambda r: F.array(*[F.lit(t) for t in r[3]])), F.slice(keywords(heading), 1, 2))
    return F.struct(F.when(clause, quoted).otherwise(asked).alias("question"), terms.alias("terms"))


def facet_queries(asked: Column, subject: Column, terms: Column) -> Column:
    """Two variants of a sub-question, and the subject's words with the facet's terms; distinct."""
    own = F.trim(F.concat_ws(" ", F.array_join(F.slice(ranked_keywords(subject), 1, 3), " "), F.array_join(F.slice(terms, 1, 2), " ")))
    every = F.transform(F.concat(F.slice(plan_variants(asked, "deep"), 1, 2), F.array(own)), lambda q: F.trim(q))
    return first_of_each(F.filter(every, lambda q: q != ""))
