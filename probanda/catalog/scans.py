"""Sources, sinks and entity tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import ingest
from ..session import shared_dir
from ..sources import entities, files
from . import sql as S
from .inputs import Inputs, spread
from .registry import query

_BAD_BYTES = bytes([0xF0, 0x28, 0x8C, 0x28, 0xC3])
_BAD_TEXT = "�(�(�"


@query(
    "decode_bytes",
    "A2",
    f"SELECT doc_id, length(t) AS n, sha256(t) AS text_hash FROM (SELECT doc_id, text || {S.quoted(_BAD_TEXT)} AS t FROM documents)",
)
def decode_bytes(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.encode("text", "utf-8"), F.lit(_BAD_BYTES))
    rows = Inputs(spark, sf).documents_raw.select("doc_id", T.decode_utf8(raw).alias("t"))
    return rows.select("doc_id", F.length("t").cast("long").alias("n"), F.sha2("t", 256).alias("text_hash"))


@query("content_hash", "A9", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return Inputs(spark, sf).documents_raw.select("doc_id", F.sha2(F.encode("text", "utf-8"), 256).alias("content_hash"))


def _odd_uploads(i: Inputs) -> DataFrame:
    """Every document as it is, and an odd upload of each under a negative id."""
    n = F.col("doc_id")
    extension = F.when(n % 7 == 1, ".pdf").when(n % 7 == 2, ".MD").when(n % 7 == 3, ".Txt").otherwise(".txt")
    content = F.when(n % 7 == 0, F.lit("")).when(n % 7 == 4, F.lit(" \t\r\n  ")).otherwise(F.col("text"))
    odd = i.documents_raw.select((-1 - n).alias("doc_id"), "source", extension.alias("extension"), content.alias("body"))
    given = i.documents_raw.select("doc_id", "source", F.lit(".txt").alias("extension"), F.col("text").alias("body"))
    name = F.concat("doc_id", "extension")
    return given.unionByName(odd).select(
        "doc_id",
        F.concat("source", F.lit("/"), name).alias("path"),
        name.alias("filename"),
        F.encode("body", "utf-8").alias("content"),
        F.timestamp_seconds("doc_id").alias("created_at"),
        F.col("doc_id").alias("ingest_order"),
    )


_ODD = (
    "SELECT doc_id, source, '.txt' AS ext, text AS body FROM documents UNION ALL "
    "SELECT -1 - doc_id, source, CASE doc_id % 7 WHEN 1 THEN '.pdf' WHEN 2 THEN '.MD' WHEN 3 THEN '.Txt' ELSE '.txt' END AS ext, "
    "CASE doc_id % 7 WHEN 0 THEN '' WHEN 4 THEN ' ' || chr(9) || chr(13) || chr(10) || ' ' || chr(8195) ELSE text END AS body FROM documents"
)


@query(
    "validate_uploads",
    "B1 B2",
    "SELECT doc_id, CASE WHEN body = '' THEN 'empty' WHEN strlen(body) > 2000 THEN 'too_large' WHEN ext = '.pdf' THEN 'unsupported_type' "
    f"WHEN {S.clean('body')} = '' THEN 'no_text' END AS reject_reason FROM ({_ODD})",
)
def validate_uploads(spark: SparkSession, sf: str) -> DataFrame:
    checked = ingest.validate_uploads(_odd_uploads(Inputs(spark, sf)), max_bytes=2000)
    return checked.select("doc_id", "reject_reason")


@query(
    "quarantined_uploads",
    "B1 B2 A1",
    "SELECT source_name, reject_reason, count(*) AS uploads FROM (SELECT split_part(path, '/', 1) AS source_name, CASE WHEN body = '' THEN 'empty' "
    "WHEN ext = '.pdf' THEN 'unsupported_type' ELSE 'no_text' END AS reject_reason FROM (SELECT *, source || '/' AS path "
    f"FROM ({_ODD})) WHERE body = '' OR ext = '.pdf' OR {S.clean('body')} = '') GROUP BY 1, 2",
)
def quarantined_uploads(spark: SparkSession, sf: str) -> DataFrame:
    rejected = ingest.ingest(_odd_uploads(Inputs(spark, sf))).rejected
    source = F.split("path", "/")[0].alias("source_name")
    return rejected.groupBy(source, "reject_reason").agg(F.count("*").alias("uploads"))


@query(
    "parser_registry",
    "K2",
    f"SELECT page_id, sha256({S.clean(chr(39) + chr(39) + ' || t')}) AS text_hash FROM (SELECT page_id, "
    "regexp_replace(html, '<[^>]*>', ' ', 'g') AS t FROM pages) "
    "UNION ALL SELECT -1 - doc_id, sha256(" + S.clean("text") + ") FROM documents",
)
def parser_registry(spark: SparkSession, sf: str) -> DataFrame:
    i = Inputs(spark, sf)

    def page_text(content):
        return F.regexp_replace(T.decode_utf8(content), "<[^>]*>", " ")

    pages = spread(i.table("pages"), "page_id").select(
        "page_id", F.lit("p.html").alias("filename"), F.encode("html", "utf-8").alias("content")
    )
    docs = i.documents_raw.select(
        (-1 - F.col("doc_id")).alias("page_id"), F.lit("d.md").alias("filename"), F.encode("text", "utf-8").alias("content")
    )
    parsers = {**ingest.PARSERS, ".html": page_text}
    checked = ingest.validate_uploads(pages.unionByName(docs), parsers)
    return checked.select("page_id", F.sha2("text", 256).alias("text_hash"))


@query(
    "ingest_tables",
    "A5 C1",
    S.with_(
        "docs chunks",
        "SELECT document_id, d.title, d.source AS project_id, concept_id, 'Concept derived from document ''' || d.title || '''' AS description, "
        "edge_id, n_chunks FROM docs d JOIN (SELECT document_id, count(*) AS n_chunks FROM chunks GROUP BY 1) USING (document_id)",
    ),
)
def ingest_tables(spark: SparkSession, sf: str) -> DataFrame:
    done = Inputs(spark, sf).ingested
    counts = done.chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"))
    edges = done.edges.select(F.col("id").alias("edge_id"), F.col("source_id").alias("concept_id"), F.col("target_id").alias("document_id"))
    documents = entities.conform(done.documents, "documents").select(F.col("id").alias("document_id"), "title", "project_id")
    concepts = entities.conform(done.concepts, "concepts").select(F.col("id").alias("concept_id"), "description")
    return documents.join(edges, "document_id").join(concepts, "concept_id").join(counts, "document_id")


@query(
    "required_columns",
    "A5",
    "SELECT 'answers' AS table_name, c AS \"column\", n AS nulls FROM (SELECT 'id' AS c, 0 AS n UNION ALL SELECT 'text', 0 UNION ALL SELECT 'created_at', 0) "
    "UNION ALL SELECT 'tasks', c, n FROM (SELECT 'id' AS c, 0 AS n UNION ALL SELECT 'description', count(*) FILTER (turn % 3 = 0) FROM conversations "
    "UNION ALL SELECT 'status', 0 UNION ALL SELECT 'created_at', count(*) FROM conversations)",
)
def required_columns(spark: SparkSession, sf: str) -> DataFrame:
    i = Inputs(spark, sf)
    turns = i.table("conversations")
    tasks = turns.select(
        F.concat("conv_id", F.lit("."), "turn").alias("id"),
        F.when(F.col("turn") % 3 != 0, F.col("text")).alias("description"),
    )
    answers = i.answers.drop("sources")
    reports = [entities.null_report(entities.conform(df, t), t) for df, t in ((answers, "answers"), (tasks, "tasks"))]
    return reports[0].unionByName(reports[1])


@query(
    "chunk_store_scan",
    "A3",
    S.with_(
        "vchunks",
        f"SELECT document_id, count(*) AS n, sum(char_end - char_start)::BIGINT AS chars, {S.six('sum(embedding[1])')} AS first, min(len(embedding)) AS dim FROM vchunks GROUP BY 1",
    ),
)
def chunk_store_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Append the embedded chunks to a stored table, then scan that table."""
    path = shared_dir(spark, "chunks")
    files.write_table(Inputs(spark, sf).chunks, path)
    return spark.read.parquet(path).groupBy("document_id").agg(
        F.count("*").alias("n"),
        F.sum(F.col("char_end") - F.col("char_start")).alias("chars"),
        T.six(F.sum(F.get("embedding", F.lit(0)))).alias("first"),
        F.min(F.size("embedding")).cast("long").alias("dim"),
    )


@query(
    "decode_json",
    "A4",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
)
def decode_json(spark: SparkSession, sf: str) -> DataFrame:
    rows = files.decode_json_columns(Inputs(spark, sf).events, {"props": "k long"})
    return rows.select("event_id", "props.k")


@query(
    "decode_chunk_rows",
    "A4",
    "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dimension, list_min(embedding) AS lowest, list_max(embedding) AS highest, label AS concept_id, vec_id % 9 AS chunk_index, NULL::VARCHAR AS problem "
    "FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding, CAST(label AS VARCHAR) AS label FROM embeddings) "
    "UNION ALL SELECT -1 - vec_id, NULL, NULL, NULL, NULL, NULL, CASE WHEN vec_id % 6 IN (4, 5) THEN 'metadata' ELSE 'embedding' END FROM embeddings",
)
def decode_chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector as a stored row of JSON texts, and once more with one of its texts broken."""
    n, none = F.col("vec_id"), F.lit(None).cast("string")
    fields = F.struct((n % 9).cast("int").alias("chunk_index"), F.col("label").cast("string").alias("concept_id"), F.lit("local").alias("source_type"))
    given = Inputs(spark, sf).vectors.select("vec_id", F.to_json("embedding").alias("embedding"), F.to_json(fields).alias("metadata"))
    text, kind = F.col("embedding"), n % 6
    broken = given.select(
        (-1 - n).alias("vec_id"),
        F.when(kind == 0, none).when(kind == 1, F.substring(text, 1, 20)).when(kind == 2, F.replace(text, F.lit("]"), F.lit(',"x"]')))
        .when(kind == 3, F.concat(text, F.lit(" more"))).otherwise(text).alias("embedding"),
        F.when(kind == 4, F.lit("{chunk")).when(kind == 5, F.lit('{"chunk_index": "first"}')).otherwise(F.col("metadata")).alias("metadata"),
    )
    decoded, malformed = files.decode_chunk_rows(given.unionByName(broken))
    read = decoded.select(
        "vec_id", F.size("embedding").cast("long").alias("dimension"), F.array_min("embedding").alias("lowest"), F.array_max("embedding").alias("highest"),
        "metadata.concept_id", F.col("metadata.chunk_index").cast("long").alias("chunk_index"), none.alias("problem"),
    )
    return read.unionByName(malformed.select("vec_id", "problem"), allowMissingColumns=True)


FILE_MAX_BYTES = 50_000
BUNDLE = 20  # consecutive doc_ids to a file
_FILES = (
    f"SELECT doc_id // {BUNDLE} AS bundle, string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id, text) AS body FROM documents GROUP BY 1"
)


@query(
    "upload_files",
    "A1 A9 B1",
    f"SELECT bundle, CAST(strlen(body) AS BIGINT) AS length, CASE WHEN strlen(body) <= {FILE_MAX_BYTES} THEN sha256(body) END AS content_hash, "
    f"CASE WHEN strlen(body) <= {FILE_MAX_BYTES} THEN sha256({S.clean('body')}) END AS text_hash, "
    f"CASE WHEN strlen(body) > {FILE_MAX_BYTES} THEN 'too_large' WHEN {S.clean('body')} = '' THEN 'no_text' END AS reject_reason FROM ({_FILES})",
)
def upload_files(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as text files of twenty consecutive ids each, read as uploads; files
    beyond the limit are refused by their length and not opened."""
    folder = shared_dir(spark, "uploads")
    docs = Inputs(spark, sf).documents_raw.select(F.floor(F.col("doc_id") / BUNDLE).alias("bundle"), "doc_id", "text")
    lines = docs.repartition("bundle").sortWithinPartitions("bundle", "doc_id", "text")
    lines.select("bundle", "text").write.partitionBy("bundle").text(folder)
    uploads = files.read_uploads(spark, folder, max_bytes=FILE_MAX_BYTES)
    checked = ingest.validate_uploads(uploads, max_bytes=FILE_MAX_BYTES)
    return checked.select(
        F.regexp_extract("path", "bundle=([0-9]+)/", 1).cast("long").alias("bundle"),
        "length", "content_hash", F.sha2("text", 256).alias("text_hash"), "reject_reason",
    )


@query(
    "integrity_report",
    "A6",
    " UNION ALL ".join(
        [
            f"SELECT '{t}' AS table_name, 'duplicate_key' AS problem, '{','.join(k)}' AS columns, count(*) AS bad_keys, CAST(coalesce(sum(n), 0) AS BIGINT) AS bad_rows "
            f"FROM (SELECT count(*) AS n FROM {t} GROUP BY {', '.join(k)} HAVING count(*) > 1)"
            for t, k in {"orders": ["o_orderkey"], "events": ["user_id", "event_type"], "conversations": ["conv_id", "turn"]}.items()
        ]
        + [
            f"SELECT '{c}', 'orphan', '{col}', count(*), CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT {col}, count(*) AS n FROM {c} "
            f"WHERE {col} IS NOT NULL AND {col} NOT IN (SELECT {pk} FROM {p}) GROUP BY 1)"
            for c, col, p, pk in [
                ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
                ("orders", "o_custkey", "customer", "c_custkey"), ("nation", "n_regionkey", "region", "r_regionkey"),
                ("labels", "doc_id", "embeddings", "vec_id"), ("documents", "doc_id", "labels", "doc_id"),
            ]
        ]
    ),
)
def integrity_report(spark: SparkSession, sf: str) -> DataFrame:
    i = Inputs(spark, sf)
    names = "orders events conversations lineitem part customer nation region labels embeddings documents".split()
    return entities.integrity_report(
        {n: i.table(n) for n in names},
        {"orders": ["o_orderkey"], "events": ["user_id", "event_type"], "conversations": ["conv_id", "turn"]},
        [
            ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
            ("orders", "o_custkey", "customer", "c_custkey"), ("nation", "n_regionkey", "region", "r_regionkey"),
            ("labels", "doc_id", "embeddings", "vec_id"), ("documents", "doc_id", "labels", "doc_id"),
        ],
    )


_ENTITIES = {
    "projects": "SELECT DISTINCT source AS id FROM documents WHERE source <> 'src3'",
    "documents": "SELECT CAST(doc_id AS VARCHAR) AS id, source AS project_id FROM documents",
    "sessions": "SELECT DISTINCT CAST(conv_id AS VARCHAR) AS id FROM conversations WHERE conv_id % 4 <> 1",
    "questions": "SELECT 'q' || conv_id || '.' || turn AS id, CAST(conv_id AS VARCHAR) AS session_id FROM conversations WHERE role = 'user'",
    "answers": "SELECT 'a' || conv_id || '.' || turn AS id, 'q' || conv_id || '.' || (turn - 1) AS question_id FROM conversations WHERE role = 'assistant'",
}


@query(
    "entity_integrity",
    "A6",
    " UNION ALL ".join(
        [
            f"SELECT '{t}' AS table_name, 'duplicate_key' AS problem, 'id' AS columns, count(*) AS bad_keys, CAST(coalesce(sum(n), 0) AS BIGINT) AS bad_rows "
            f"FROM (SELECT count(*) AS n FROM ({rows}) GROUP BY id HAVING count(*) > 1)"
            for t, rows in _ENTITIES.items()
        ]
        + [
            f"SELECT '{c}', 'orphan', '{col}', count(*), CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT {col}, count(*) AS n FROM ({_ENTITIES[c]}) "
            f"WHERE {col} IS NOT NULL AND {col} NOT IN (SELECT id FROM ({_ENTITIES[p]})) GROUP BY 1)"
            for c, col, p in [("documents", "project_id", "projects"), ("questions", "session_id", "sessions"), ("answers", "question_id", "questions")]
        ]
    ),
)
def entity_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """The declared references over tables in which some parents are missing."""
    i = Inputs(spark, sf)
    docs, talks = i.table("documents"), i.table("conversations")
    return entities.entity_integrity({
        "projects": docs.where("source <> 'src3'").select(F.col("source").alias("id")).distinct(),
        "documents": docs.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("project_id")),
        "sessions": talks.where("conv_id % 4 <> 1").select(F.col("conv_id").cast("string").alias("id")).distinct(),
        "questions": i.questions.select("id", "session_id"),
        "answers": i.answers.select("id", "question_id"),
    })


@query(
    "current_settings",
    "A7",
    "SELECT key, arg_max(value, CAST(moment AS HUGEINT) * 1000000000 + seq) AS value, max(moment) AS updated FROM (SELECT event_type || '.' || user_id % 5 AS key, props AS value, "
    "epoch_us(date_trunc('day', ts)) AS moment, event_id AS seq FROM events) GROUP BY 1",
)
def current_settings(spark: SparkSession, sf: str) -> DataFrame:
    log = Inputs(spark, sf).events.select(
        F.concat("event_type", F.lit("."), F.col("user_id") % 5).alias("key"),
        F.col("props").alias("value"),
        F.date_trunc("day", "ts").alias("updated_at"),
        F.col("event_id").alias("seq"),
    )
    return entities.current_settings(log).select("key", "value", F.unix_micros("updated_at").alias("updated"))


@query(
    "audit_log",
    "A8",
    "SELECT event_type, count(*) AS events, min(epoch_us(ts)) AS first_at, count(DISTINCT user_id) AS identities FROM events GROUP BY 1",
)
def audit_log(spark: SparkSession, sf: str) -> DataFrame:
    """Append audit events as JSON lines, then read the log back."""
    path = shared_dir(spark, "audit")
    events = Inputs(spark, sf).events.select(
        F.col("ts").alias("timestamp"), "event_type", F.struct(F.col("user_id").alias("identity")).alias("details")
    )
    files.write_audit(events, path)
    log = spark.read.schema("timestamp timestamp, event_type string, details struct<identity:long>").json(path)
    return log.groupBy("event_type").agg(
        F.count("*").alias("events"),
        F.min(F.unix_micros("timestamp")).alias("first_at"),
        F.count_distinct("details.identity").alias("identities"),
    )


@query(
    "lookup_by_id",
    "B17",
    "SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) "
    "UNION ALL SELECT -1 - c_custkey, c_name, 0 FROM customer WHERE c_custkey IN (1, 5, 7, 100000000)",
)
def lookup_by_id(spark: SparkSession, sf: str) -> DataFrame:
    i = Inputs(spark, sf)
    wanted = i.table("labels").where("toxic = 1").select("doc_id")
    docs = entities.lookup(i.table("documents"), wanted, "doc_id").select("doc_id", "source", "n_chars")
    people = entities.lookup(i.table("customer"), [1, 5, 7, 100000000], "c_custkey")
    return docs.unionByName(
        people.select((-1 - F.col("c_custkey")).alias("doc_id"), F.col("c_name").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    )


@query(
    "latest_documents",
    "E12",
    "SELECT * FROM (SELECT 'all' AS list, o_orderkey AS id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50) UNION ALL "
    "SELECT * FROM (SELECT 'src3', doc_id FROM documents WHERE source = 'src3' ORDER BY doc_id DESC LIMIT 50)",
)
def latest_documents(spark: SparkSession, sf: str) -> DataFrame:
    i = Inputs(spark, sf)
    orders = entities.latest(i.table("orders"), time="o_orderdate", key="o_orderkey")
    docs = i.table("documents").withColumn("project_id", F.col("source"))
    newest = entities.latest(docs, project_id="src3", time="doc_id", key="text")
    return orders.select(F.lit("all").alias("list"), F.col("o_orderkey").alias("id")).unionByName(
        newest.select(F.lit("src3").alias("list"), F.col("doc_id").alias("id"))
    )
