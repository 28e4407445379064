"""Response checks.  Responses come from a template with every kind of fault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import fixed_values as V
from ..functions import text as T
from ..operators import prompts, validate
from ..plans import ask
from . import sql as S
from .inputs import Inputs
from .registry import query
from .retrieval import investigated, with_research


def template_responses(evidence: ask.Evidence) -> DataFrame:
    """One response per query, its faults chosen by the item number."""
    titles = evidence.retrieved.groupBy("query_id").agg(F.min_by("document_title", "rank").alias("t"))
    rows = evidence.reasons.select("query_id", "overall").join(titles, "query_id", "left")
    title = F.concat(F.lit("["), F.coalesce("t", F.lit("none")), F.lit("]"))
    kind = F.col("query_id").cast("int") % 6
    text = (
        F.when(kind == 0, F.concat(F.lit("See "), title, F.lit(" for details; confidence is "), T.two_decimals(F.col("overall")), F.lit(".")))
        .when(kind == 1, "As [Unknown Report] shows, and [Unknown Report] again, this holds. Confidence: 0.95")
        .when(kind == 2, "There is no evidence and I am uncertain.")
        .when(kind == 3, "The evidence is limited, I'm not fully certain.")
        .when(kind == 4, F.concat(F.lit("However the sources differ; confidence 1 and CONFIDENCE of 0.2 are unclear. "), title, F.lit(" [X]")))
        .otherwise("Plain claim without hedge.")
    )
    return rows.select("query_id", text.alias("response_text"))


def _starved(i: Inputs) -> ask.Evidence:
    """Every fourth query finds nothing, so that the rules for missing evidence act."""
    hungry = F.col("item_id") % 4 == 0
    asked = i.asked.withColumn("min_score", F.when(hungry, 2.0).otherwise(V.MIN_SCORE)).withColumn(
        "use_web", F.col("use_web") & ~hungry
    )
    return ask.Evidence(asked, i.knowledge, i.history, i.web_results)


def starved(select: str) -> str:
    """``select`` over the fragments with every fourth query starved of evidence."""
    text = S.with_("verdicts", select)
    text = text.replace("FROM ascored WHERE score >= 0)", "FROM ascored WHERE score >= 0 AND CAST(query_id AS INT) % 4 <> 0)")
    return text.replace("WHERE q.use_web AND w.n <= 3", "WHERE q.use_web AND w.n <= 3 AND q.item_id % 4 <> 0")


def _checked(spark: SparkSession, sf: str) -> DataFrame:
    evidence = _starved(Inputs(spark, sf))
    return validate.verdicts(template_responses(evidence), evidence.reasons)


def _text(name: str):
    return F.array_join(name, "\n").alias(name)


_JOIN = "coalesce(array_to_string(%s, chr(10)), '') AS %s"


def _violations(name: str, covers: str, column: str, source: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _checked(spark, sf).select("query_id", _text(column))

    query(name, covers, starved("SELECT query_id, " + _JOIN % (source, column) + " FROM verdicts"))(run)


_violations("citation_check", "J1", "citation_violations", "v1")
_violations("confidence_claim_check", "J2", "consistency_violations", "v2")
_violations("hedging_check", "J3", "confidence_violations", "v3")
_violations("completeness_check", "J4", "completeness_violations", "v4")
_violations("reflection_flags", "J6", "failure_flags", "flags")


@query(
    "validation_verdicts",
    "J5",
    starved("SELECT query_id, valid AS validation_passed, reflected AS reflection_passed, delivered, " + _JOIN % ("all_v", "all_violations") + " FROM verdicts"),
)
def validation_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return _checked(spark, sf).select(
        "query_id", "validation_passed", "reflection_passed", "delivered", _text("all_violations")
    )


@query("chat_delivery", "J7", starved("SELECT query_id, delivered, CASE WHEN delivered THEN response_text END AS delivered_text FROM verdicts"))
def chat_delivery(spark: SparkSession, sf: str) -> DataFrame:
    return validate.delivered_chat(_checked(spark, sf)).select("query_id", "delivered", "delivered_text")


_KINDS = [("citation_violations", "v1"), ("consistency_violations", "v2"), ("confidence_violations", "v3"), ("completeness_violations", "v4"), ("failure_flags", "flags")]


@query(
    "violation_report",
    "J8",
    starved(" UNION ALL ".join(f"SELECT '{k}' AS kind, CAST(sum(len({c})) AS BIGINT) AS messages, count(*) FILTER (len({c}) > 0) AS responses FROM verdicts" for k, c in _KINDS)),
)
def violation_report(spark: SparkSession, sf: str) -> DataFrame:
    return validate.violation_report(_checked(spark, sf))


def _research_text(query_id: Column) -> Column:
    kind = query_id.cast("int") % 3
    return (
        F.when(kind == 0, "The answer is unclear.")
        .when(kind == 1, "All sources agree on it.")
        .otherwise("This may not hold [Made Up].")
    )


_RESEARCH = (
    "SELECT query_id, n, CASE CAST(query_id AS INT) % 3 WHEN 0 THEN 'The answer is unclear.' WHEN 1 THEN 'All sources agree on it.' ELSE 'This may not hold [Made Up].' END AS text, overall FROM "
    f"(SELECT a.query_id, count(f.rank) AS n, {S.six('coalesce(avg(f.score), 0.0)')} AS overall FROM asked a LEFT JOIN found f USING (query_id) GROUP BY 1)"
)
_RESEARCH_V = (
    f"SELECT query_id, n, text, CASE WHEN n = 0 THEN [] ELSE list_concat(CASE WHEN text LIKE '%[Made Up]%' THEN [{S.message(V.CITATION_VIOLATION, S.quoted('Made Up'))}] ELSE [] END, "
    f"CASE WHEN overall < 0.5 AND text LIKE 'All%' THEN [{S.message(V.HEDGE_VIOLATION, S.two('overall'))}] ELSE [] END) END AS v FROM ({_RESEARCH})"
)


@query(
    "research_delivery",
    "J7",
    with_research(
        f"SELECT query_id, len(v) = 0 AS delivered, CASE WHEN n = 0 THEN {S.quoted(V.RESEARCH_EMPTY_TEXT)} WHEN len(v) = 0 THEN text ELSE {S.quoted(V.RESEARCH_FALLBACK_TEXT)} END AS synthesized_answer, "
        f"coalesce(array_to_string(v, chr(10)), '') AS violations FROM ({_RESEARCH_V})"
    ),
)
def research_delivery(spark: SparkSession, sf: str) -> DataFrame:
    from ..plans import research

    done = investigated(Inputs(spark, sf))
    written = done.prompts.where("prompt is not null").select("query_id", _research_text(F.col("query_id")).alias("response_text"))
    return research.conclude(done, written).withColumn("violations", F.array_join("violations", "\n"))


def echo_writer():
    """A fixture generator: how long the prompt is; prompts with an even length fail."""

    def run(texts: list[str]) -> list[str]:
        if any(len(t) % 2 == 0 for t in texts):
            raise ValueError("refused")
        return [f"{len(t)} characters" for t in texts]

    return run


@query(
    "generate_with_function",
    "K1",
    "SELECT doc_id, CASE WHEN length(text) % 2 = 1 THEN length(text) || ' characters' END AS response_text, length(text) % 2 = 0 AS failed FROM documents",
)
def generate_with_function(spark: SparkSession, sf: str) -> DataFrame:
    made = prompts.generate(Inputs(spark, sf).documents_raw.select("doc_id", "text"), echo_writer, "text")
    return made.select("doc_id", "response_text", F.col("generate_error").isNotNull().alias("failed"))
