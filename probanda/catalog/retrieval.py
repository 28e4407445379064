"""Retrieval, web evidence, history and graph neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import graph, retrieve, sessions
from ..plans import ask
from . import sql as S
from .inputs import Inputs
from .registry import query


def _shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        "query_id",
        F.col("rank").cast("long").alias("rank"),
        "chunk_id",
        F.col("document_title").alias("title"),
        F.sha2("chunk_text", 256).alias("text_hash"),
        "score", "semantic_score", "keyword_score", "source_type",
        *more,
    )


_SHOWN = "query_id, rank, chunk_id, title, sha256(chunk_text) AS text_hash, score, semantic_score, keyword_score, source_type"


def run_hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    i = Inputs(spark, sf)
    return _shown(retrieve.retrieve(i.queries, i.chunks))


query(
    "hybrid_search",
    "E1 E3 H2",
    S.with_("ranked", f"SELECT {_SHOWN.replace('source_type', chr(39) + 'local' + chr(39) + ' AS source_type')} FROM ranked"),
)(run_hybrid_search)


@query(
    "hybrid_search_limits",
    "E1",
    S.with_(
        "queries scored",
        f"SELECT query_id, CAST(rn AS BIGINT) AS rank, chunk_id, {S.six('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index, chunk_id) AS rn "
        "FROM (SELECT s.*, q.item_id FROM scored s JOIN queries q USING (query_id) WHERE score >= (q.item_id % 4) / 10)) WHERE rn <= 1 + item_id % 7",
    ),
)
def hybrid_search_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Own top_k and min_score per query, in blocks far smaller than the query table."""
    i = Inputs(spark, sf)
    q = i.queries.withColumns({"top_k": F.col("item_id") % 7 + 1, "min_score": (F.col("item_id") % 4) / 10})
    found = retrieve.retrieve(q, i.chunks, block_queries=16)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "score")


@query(
    "search_in_document",
    "E2",
    S.with_(
        "queries docs scored",
        f"SELECT query_id, CAST(rn AS BIGINT) AS rank, chunk_id, {S.six('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index, chunk_id) AS rn "
        "FROM (SELECT s.* FROM scored s JOIN queries q USING (query_id) WHERE score >= 0 AND (q.item_id % 2 = 1 OR s.doc_id = q.item_id * 2 + 1))) WHERE rn <= 5",
    ),
)
def search_in_document(spark: SparkSession, sf: str) -> DataFrame:
    """Every second query looks into one document only."""
    i = Inputs(spark, sf)
    wanted = F.when(F.col("item_id") % 2 == 0, F.col("item_id") * 2 + 1)
    targets = i.table("documents").select(
        F.col("doc_id").alias("target"),
        T.stable_id(F.lit("document"), F.concat("source", F.lit("/"), "doc_id", F.lit(".txt"))).alias("document_id"),
    )
    q = i.queries.withColumn("target", wanted).join(targets, "target", "left")
    found = retrieve.retrieve(q, i.chunks)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "score")


@query(
    "title_lookup",
    "E3",
    S.with_("ranked", "SELECT query_id, rank, chunk_id, CASE WHEN doc_id % 3 <> 0 THEN title END AS title FROM ranked"),
)
def title_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the documents is unknown to the lookup: their titles stay null."""
    i = Inputs(spark, sf)
    known = i.documents.where("unix_seconds(created_at) % 3 <> 0")
    found = retrieve.retrieve(i.queries, i.chunks, known)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.col("document_title").alias("title"))


def _repeated(i: Inputs) -> DataFrame:
    again = i.queries.where("item_id % 2 = 0").withColumns(
        {
            "query_id": F.concat(F.lit("z"), "query_id"),
            "query": F.concat(F.lit(" \t"), F.replace("query", F.lit(" "), F.lit(" \n  "))),
        }
    )
    return i.queries.unionByName(again)


@query(
    "reuse_identical_queries",
    "E4",
    S.with_(
        "ranked",
        "SELECT query_id, rank, chunk_id, score, false AS reused FROM ranked UNION ALL "
        "SELECT 'z' || query_id, rank, chunk_id, score, true FROM ranked WHERE CAST(query_id AS INT) % 2 = 0",
    ),
)
def reuse_identical_queries(spark: SparkSession, sf: str) -> DataFrame:
    i = Inputs(spark, sf)
    found = retrieve.retrieve_reusing(_repeated(i), i.chunks)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "score", "reused")


@query(
    "retrieval_telemetry",
    "G10",
    S.with_(
        "ranked queries",
        "SELECT query_id, false AS cache_hit, count(rank) AS chunk_count, max(score) AS top_score FROM queries LEFT JOIN ranked USING (query_id) GROUP BY 1 UNION ALL "
        "SELECT 'z' || query_id, true, count(rank), max(score) FROM queries LEFT JOIN ranked USING (query_id) WHERE item_id % 2 = 0 GROUP BY 1 "
        "UNION ALL SELECT 'blank' || query_id, false, 0, NULL FROM queries WHERE item_id % 10 = 0",
    ),
)
def retrieval_telemetry(spark: SparkSession, sf: str) -> DataFrame:
    i = Inputs(spark, sf)
    blank = i.queries.where("item_id % 10 = 0").withColumns(
        {"query_id": F.concat(F.lit("blank"), "query_id"), "query": F.lit(" \n ")}
    )
    q = _repeated(i).unionByName(blank)
    return retrieve.retrieval_telemetry(q, retrieve.retrieve_reusing(q, i.chunks))


def gathered(i: Inputs, web: bool = True, max_tokens: int | None = None) -> ask.Evidence:
    limit = {} if max_tokens is None else {"max_tokens": max_tokens}
    return ask.Evidence(i.asked, i.knowledge, i.history, i.web_results if web else None, **limit)


@query("web_evidence", "E5", S.with_("retrieved", f"SELECT {_SHOWN}, url FROM retrieved"))
def web_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(gathered(Inputs(spark, sf)).retrieved, "url")


@query(
    "web_search_absent",
    "K3",
    S.with_("aranked", f"SELECT {_SHOWN.replace('source_type', chr(39) + 'local' + chr(39) + ' AS source_type')} FROM aranked"),
)
def web_search_absent(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(gathered(Inputs(spark, sf), web=False).retrieved)


# --- research ------------------------------------------------------------------------
_WS, _SP = S.WS, "(?i)" + S.WS + "+" + S.V.SUB_QUESTION_PATTERN + S.WS + "+"
PARTS = {
    "parts": "SELECT *, query_id || '#' || part AS part_id, " + S.tokens(S.norm("sub_question")) + " AS ptok FROM (SELECT query_id, item_id, use_web, embedding, "
    "n - 1 AS part, ps[n] AS sub_question FROM (SELECT *, unnest(generate_series(1, len(ps))) AS n FROM (SELECT *, CASE WHEN len(p) > 1 THEN p ELSE [message] END AS ps FROM "
    f"(SELECT *, list_filter(list_transform(regexp_split_to_array(message, '{_SP}'), lambda x: {S.strip('x')}), lambda x: x <> '') AS p FROM asked))))",
    "pq": "SELECT part_id AS query_id, embedding, ptok AS qtok FROM parts WHERE " + S.norm("sub_question") + " <> ''",
    "pscored": S.score("pq"),
    "pranked": S.rank("pscored"),
    "joined": "SELECT p.query_id AS question, p.part, r.* EXCLUDE (query_id) FROM pranked r JOIN parts p ON p.part_id = r.query_id",
    "bests": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question, chunk_id ORDER BY score DESC, part, rank) AS b, "
    "min(part * 1000 + rank) OVER (PARTITION BY question, chunk_id) AS first_seen FROM joined) WHERE b = 1",
    "rlocal": "SELECT question AS query_id, row_number() OVER (PARTITION BY question ORDER BY first_seen) AS rank, chunk_id, document_id, title, chunk_text, score, semantic_score, keyword_score, concept_id FROM bests",
    "rwebs": "SELECT p.query_id, p.part, w.n, w.title, w.url, w.content, w.score, sha256('web|' || p.part_id || '|' || w.position || '|' || w.url) AS chunk_id, "
    "row_number() OVER (PARTITION BY p.query_id ORDER BY p.part, w.n) AS r FROM parts p JOIN web w ON w.query_id = p.query_id WHERE p.use_web AND w.n <= 3 AND "
    + S.norm("sub_question") + " <> ''",
    "found": "SELECT query_id, rank, chunk_id, document_id, title, chunk_text, score, semantic_score, keyword_score, concept_id, CAST(NULL AS VARCHAR) AS url, 'local' AS source_type FROM rlocal UNION ALL "
    "SELECT w.query_id, w.r + coalesce(c, 0), w.chunk_id, NULL, w.title, w.content, w.score, w.score, 0.0, NULL, w.url, 'web' FROM rwebs w "
    "LEFT JOIN (SELECT query_id, count(*) AS c FROM rlocal GROUP BY 1) USING (query_id)",
}


def with_research(select: str, **more: str) -> str:
    return S.with_("asked vchunks web", select, {**PARTS, **more})


def investigated(i: Inputs):
    from ..plans import research

    parts = retrieve.explode_sub_questions(i.asked.select("query_id", "query", "item_id"))
    per_part = parts.select(F.col("question_id"), F.col("query_id").alias("part_id")).join(
        i.web_results.withColumnRenamed("query_id", "question_id"), "question_id"
    )
    web = per_part.drop("question_id").withColumnRenamed("part_id", "query_id")
    return research.investigate(i.asked, i.knowledge, web)


@query("sub_question_search", "E6 E7", with_research(f"SELECT {_SHOWN}, url FROM found"))
def sub_question_search(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(investigated(Inputs(spark, sf)).retrieved, "url")


# --- history and graph -------------------------------------------------------------------


@query(
    "conversation_history",
    "E8",
    "SELECT u.conv_id, 'q' || u.conv_id || '.' || u.turn AS question_id, sha256(u.text) AS question_hash, 'a' || a.conv_id || '.' || a.turn AS answer_id, "
    "sha256(a.text) AS answer_hash, a.turn / 10 AS confidence FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'",
)
def conversation_history(spark: SparkSession, sf: str) -> DataFrame:
    i = Inputs(spark, sf)
    rows = sessions.in_session_order(sessions.conversation_history(i.questions, i.answers))
    return rows.select(
        F.col("session_id").cast("long").alias("conv_id"), "question_id", F.sha2("question_text", 256).alias("question_hash"),
        "answer_id", F.sha2("answer_text", 256).alias("answer_hash"), "confidence",
    )


def _entities(i: Inputs) -> DataFrame:
    tables = (("concept", i.concepts), ("document", i.documents), ("project", i.projects))
    concepts, documents, projects = (t.select(F.lit(kind).alias("entity_type"), F.col("id").alias("entity_id")) for kind, t in tables)
    return concepts.unionByName(documents).unionByName(projects).distinct()


@query(
    "edges_of_entities",
    "E9",
    S.with_(
        "edges",
        "SELECT e.kind AS entity_type, e.entity_id, count(*) AS edges, count(DISTINCT g.rel) AS kinds, count(*) FILTER (g.entering) AS entering FROM ("
        "SELECT DISTINCT 'concept' AS kind, concept_id AS entity_id FROM docs UNION ALL SELECT DISTINCT 'document', document_id FROM docs UNION ALL SELECT DISTINCT 'project', source FROM documents) e "
        "JOIN (SELECT st AS kind, sid AS entity_id, rel, st = tt AND sid = tid AS entering FROM edges UNION ALL "
        "SELECT tt, tid, rel, true FROM edges WHERE NOT (st = tt AND sid = tid)) g USING (kind, entity_id) GROUP BY 1, 2",
    ),
)
def edges_of_entities(spark: SparkSession, sf: str) -> DataFrame:
    """How many edges each concept, document and project has, of how many kinds."""
    i = Inputs(spark, sf)
    found = graph.edges_of(_entities(i), i.edges)
    enters = (F.col("target_type") == F.col("entity_type")) & (F.col("target_id") == F.col("entity_id"))
    return found.groupBy("entity_type", "entity_id").agg(
        F.count("*").alias("edges"), F.count_distinct("relationship_type").alias("kinds"), F.count_if(enters).alias("entering")
    )


@query(
    "edges_of_every_entity",
    "E9",
    S.with_(
        "edges",
        "SELECT e.entity_type, e.entity_id, g.id, g.rel FROM (SELECT DISTINCT 'concept' AS entity_type, concept_id AS entity_id FROM docs UNION ALL "
        "SELECT DISTINCT 'document', document_id FROM docs UNION ALL SELECT DISTINCT 'project', source FROM documents) e "
        "JOIN (SELECT st AS entity_type, sid AS entity_id, id, rel FROM edges UNION ALL SELECT tt, tid, id, rel FROM edges WHERE NOT (st = tt AND sid = tid)) g USING (entity_type, entity_id)",
    ),
)
def edges_of_every_entity(spark: SparkSession, sf: str) -> DataFrame:
    i = Inputs(spark, sf)
    found = graph.edges_of(_entities(i), i.edges)
    return found.select("entity_type", "entity_id", "id", F.col("relationship_type").alias("rel"))


@query(
    "edges_of_retrieved_concepts",
    "E10",
    S.with_("qconcepts concept_ends", "SELECT query_id, concept_id, id, rel FROM qconcepts JOIN concept_ends USING (concept_id)"),
)
def edges_of_retrieved_concepts(spark: SparkSession, sf: str) -> DataFrame:
    i = Inputs(spark, sf)
    found = graph.concept_edges(gathered(i).retrieved, i.edges)
    return found.select("query_id", "concept_id", "id", F.col("relationship_type").alias("rel"))


@query(
    "definitions_of_retrieved_concepts",
    "E11",
    S.with_(
        "qconcepts docs",
        "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY concept_id) AS position, concept_id, title AS name FROM qconcepts JOIN docs USING (concept_id) WHERE doc_id % 4 <> 0",
    ),
)
def definitions_of_retrieved_concepts(spark: SparkSession, sf: str) -> DataFrame:
    i = Inputs(spark, sf)
    known = i.concepts.where("unix_seconds(created_at) % 4 <> 0")
    found = graph.definitions(gathered(i).retrieved, known)
    return found.select("query_id", F.col("position").cast("long").alias("position"), "concept_id", "name")


@query(
    "concept_graph",
    "G9",
    S.with_(
        "edges docs",
        "SELECT 'node' AS part, node_type AS kind, count(*) AS n, min(name) AS first_name, max(name) AS last_name FROM (SELECT 'concept' AS node_type, title AS name FROM docs UNION ALL "
        "SELECT 'document', title FROM docs WHERE document_id IN (SELECT tid FROM edges WHERE tt = 'document' AND st = 'concept' UNION SELECT sid FROM edges WHERE st = 'document' AND tt = 'concept')) GROUP BY 2 "
        "UNION ALL SELECT 'edge', rel, count(*), min(id), max(id) FROM edges WHERE st = 'concept' OR tt = 'concept' GROUP BY 2",
    ),
)
def concept_graph(spark: SparkSession, sf: str) -> DataFrame:
    i = Inputs(spark, sf)
    nodes, edges = graph.concept_graph(i.concepts, i.edges, i.documents)

    def summary(df: DataFrame, part: str, kind: str, name: str) -> DataFrame:
        return df.groupBy(F.lit(part).alias("part"), F.col(kind).alias("kind")).agg(
            F.count("*").alias("n"), F.min(name).alias("first_name"), F.max(name).alias("last_name")
        )

    return summary(nodes, "node", "node_type", "name").unionByName(summary(edges, "edge", "relationship_type", "id"))


@query(
    "retrieval_accuracy",
    "E13",
    S.with_(
        "queries scored vecs",
        "SELECT coalesce(CAST(label AS VARCHAR), 'all') AS label, count(*) AS queries, CAST(sum(hit) AS BIGINT) AS hits, " + S.six("avg(hit)") + " AS accuracy, avg(hit) >= 0.8 AS meets_floor FROM "
        "(SELECT q.label, CASE WHEN v.label = q.label THEN 1 ELSE 0 END AS hit FROM queries q LEFT JOIN (SELECT query_id, arg_min(doc_id, rn) AS doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index, chunk_id) AS rn "
        "FROM scored WHERE score >= 0 AND doc_id <> CAST(query_id AS BIGINT)) WHERE rn = 1 GROUP BY 1) t USING (query_id) LEFT JOIN vecs v ON v.vec_id = t.doc_id) GROUP BY ROLLUP (label)",
    ),
)
def retrieval_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Is the best other document of the query's topic?  (Its own vector is left out by
    asking for two documents' worth of ranks and skipping its own.)"""
    i = Inputs(spark, sf)
    own = T.stable_id(F.lit("document"), F.concat(F.lit("src"), F.col("item_id") % 20, F.lit("/"), "item_id", F.lit(".txt")))
    labelled = i.documents.select(
        F.col("id").alias("document_id"), F.unix_seconds("created_at").alias("vec_id")
    ).join(i.vectors.select("vec_id", F.col("label").alias("found_label")), "vec_id").select("document_id", "found_label")
    most = i.chunks.join(i.queries.select(own.alias("document_id")), "document_id", "left_semi").groupBy("document_id").count()
    # one more rank than the query's own document has chunks always reaches another one
    q = i.queries.withColumn("own", own).join(most.withColumnRenamed("document_id", "own"), "own", "left").withColumn(
        "top_k", (F.coalesce("count", F.lit(0)) + 1).cast("int")
    )
    found = retrieve.retrieve(q, i.chunks)
    others = found.join(q.select("query_id", "own"), "query_id").where("document_id <> own or document_id is null")
    best = others.groupBy("query_id").agg(F.min_by("document_id", "rank").alias("document_id"))
    top = best.join(labelled, "document_id").select("query_id", F.lit(1).alias("rank"), "found_label")
    expected = i.queries.select("query_id", F.col("label").alias("expected_label"))
    return retrieve.retrieval_accuracy(top, expected)
