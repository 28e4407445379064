"""SQL building blocks of the oracles (DuckDB dialect)."""

from __future__ import annotations

from .. import fixed_values as V

WS_CHARS = (
    "\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
)
WS = f"[{WS_CHARS}]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def clean(x: str) -> str:
    nl = "chr(10)"
    x = f"regexp_replace(nfc_normalize({x}), '\\r\\n?', {nl}, 'g')"
    x = f"regexp_replace({x}, '[ \\t]+', ' ', 'g')"
    x = f"regexp_replace({x}, '\\n{{3,}}', {nl} || {nl}, 'g')"
    return strip(x)


def norm(x: str) -> str:
    return strip(f"regexp_replace(nfc_normalize({x}), '{WS}+', ' ', 'g')")


def tokens(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '{V.TOKEN_PATTERN}'))"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({strip(x)}), '{WS}+'), lambda w: w <> '')"


def six(x: str) -> str:
    return f"round({x}, 6)"


def two(x: str) -> str:
    return f"printf('%.2f', round({x}, 2))"


def in_list(items: list[str]) -> str:
    return "(" + ", ".join(quoted(i) for i in items) + ")"


def any_of(x: str, markers: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(m)})" for m in markers) + ")"


def message(pattern: str, *values: str) -> str:
    pieces = pattern.split("%s")
    out = [quoted(pieces[0])]
    for value, piece in zip(values, pieces[1:]):
        out += [value, quoted(piece)]
    return "(" + " || ".join(out) + ")"


def chunks_of(source: str, keys: str, text: str, size: int = V.CHUNK_SIZE, overlap: int = V.CHUNK_OVERLAP) -> str:
    """Window list of ``text`` by the closed form."""
    step = size - overlap
    count = f"CASE WHEN length({text}) <= {size} THEN 1 ELSE 1 + CAST(ceil((length({text}) - {size}) / {step}.0) AS BIGINT) END"
    return (
        f"SELECT {keys}, i AS chunk_index, substring({text}, CAST(i * {step} + 1 AS BIGINT), {size}) AS chunk_text, "
        f"i * {step} AS char_start, least(i * {step} + {size}, length({text})) AS char_end "
        f"FROM (SELECT *, unnest(generate_series(0, ({count}) - 1)) AS i FROM {source} WHERE length({text}) > 0)"
    )


_ASKED = (
    "CASE item_id % 8 WHEN 1 THEN text || '?' WHEN 2 THEN 'Why ' || text WHEN 3 THEN text || ' and ' || text "
    "WHEN 6 THEN 'create ' || text "
    "WHEN 7 THEN 'How ' || text || ' compared to  ' || text ELSE text END"
)

FRAGMENTS: dict[str, tuple[list[str], str]] = {
    "docs": (
        [],
        "SELECT doc_id, source, doc_id || '.txt' AS title, sha256('document|' || source || '/' || doc_id || '.txt') AS document_id, "
        "sha256('concept|' || source || '/' || doc_id || '.txt') AS concept_id, "
        f"sha256('edge|' || source || '/' || doc_id || '.txt') AS edge_id, {clean('text')} AS text FROM documents "
        f"WHERE regexp_matches(text, '[^{WS_CHARS}]')",
    ),
    "vecs": ([], "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings"),
    "chunks": (
        ["docs"],
        "SELECT *, sha256(document_id || '|' || chunk_index) AS chunk_id, " + tokens("chunk_text") + " AS tokens FROM ("
        + chunks_of("docs", "doc_id, document_id, concept_id, title", "text") + ")",
    ),
    "vchunks": (
        ["chunks", "vecs"],
        "SELECT c.* EXCLUDE (digest), coalesce(v.embedding, list_transform(range(1, 65), "
        "lambda i: CAST(instr('0123456789abcdef', substr(digest, i, 1)) AS DOUBLE) - 8.5)) AS embedding "
        "FROM (SELECT *, sha256(chunk_text) AS digest FROM chunks) c LEFT JOIN vecs v ON v.vec_id = c.doc_id",
    ),
    "queries": (
        ["vecs"],
        f"SELECT item_id, CAST(item_id AS VARCHAR) AS query_id, text AS query, v.embedding, v.label, {tokens(norm('text'))} AS qtok, "
        "item_id % 3 = 0 AS use_web, 'src' || (item_id % 20) AS project_id FROM benchmark b JOIN vecs v ON v.vec_id = b.item_id",
    ),
    "asked": (
        ["vecs"],
        f"SELECT *, {tokens(norm('query'))} AS qtok, {words('query')} AS ws, lower({strip('query')}) AS low, "
        f"{strip('query')} AS message FROM (SELECT item_id, CAST(item_id AS VARCHAR) AS query_id, query, v.embedding, "
        "item_id % 3 = 0 AS use_web, 'src' || (item_id % 20) AS project_id "
        f"FROM (SELECT item_id, item_id AS own, {_ASKED} AS query FROM benchmark UNION ALL "
        "SELECT -1 - item_id, item_id, CASE WHEN item_id % 2 = 0 THEN 'it' ELSE '   ' END FROM benchmark) b JOIN vecs v ON v.vec_id = b.own)",
    ),
    "web": (
        [],
        "SELECT CAST(page_id % 40 AS VARCHAR) AS query_id, page_id // 40 AS position, "
        "regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, url, regexp_replace(html, '<[^>]*>', ' ', 'g') AS content, "
        f"{six('1 / (page_id // 40 + 2)')} AS score, "
        "row_number() OVER (PARTITION BY page_id % 40 ORDER BY page_id // 40, url) AS n FROM pages",
    ),
    # every pair scored, for plain and for varied queries
    "scored": (["queries", "vchunks"], "{score:queries:query_id, label}"),
    "ranked": (["scored"], "{rank:scored}"),
    "clear": (["asked"], "SELECT * FROM asked WHERE NOT (len(ws) < 2 OR (ws[1] IN " + in_list(V.UNCLEAR_FIRST_WORDS) + " AND len(ws) < 5))"),
    "ascored": (["clear", "vchunks"], "{score:clear:query_id}"),
    "aranked": (["ascored"], "{rank:ascored}"),
    "aweb": (
        ["web", "clear"],
        "SELECT w.* FROM web w JOIN clear q USING (query_id) WHERE q.use_web AND w.n <= 3",
    ),
    # local rows then web rows of each varied query
    "retrieved": (
        ["aranked", "aweb"],
        "SELECT query_id, rank, chunk_id, document_id, title, chunk_text, score, semantic_score, keyword_score, concept_id, "
        "CAST(NULL AS VARCHAR) AS url, 'local' AS source_type FROM aranked UNION ALL "
        "SELECT w.query_id, w.n + coalesce(l.c, 0), sha256('web|' || w.query_id || '|' || w.position || '|' || w.url), NULL, w.title, w.content, "
        "w.score, w.score, 0.0, NULL, w.url, 'web' FROM aweb w LEFT JOIN (SELECT query_id, count(*) AS c FROM aranked GROUP BY 1) l USING (query_id)",
    ),
    "edges": (
        ["docs"],
        "SELECT edge_id AS id, 'concept' AS st, concept_id AS sid, 'document' AS tt, document_id AS tid, 'derived_from' AS rel, doc_id AS made FROM docs "
        "UNION ALL SELECT sha256('related_to|' || a.concept_id || '|' || b.concept_id), 'concept', a.concept_id, 'concept', b.concept_id, 'related_to', a.doc_id "
        "FROM alldocs a JOIN alldocs b ON b.doc_id = a.doc_id + 20 "
        "UNION ALL SELECT sha256('belongs_to|' || document_id || '|' || source), 'document', document_id, 'project', source, 'belongs_to', doc_id FROM alldocs "
        "UNION ALL SELECT sha256('references|' || a.document_id || '|' || h.concept_id), 'document', a.document_id, 'concept', h.concept_id, 'references', a.doc_id "
        "FROM alldocs a JOIN alldocs h ON h.doc_id = a.doc_id - a.doc_id % 1000 WHERE a.doc_id % 10 = 3",
    ),
    "alldocs": (
        [],
        "SELECT doc_id, source, sha256('document|' || source || '/' || doc_id || '.txt') AS document_id, "
        "sha256('concept|' || source || '/' || doc_id || '.txt') AS concept_id FROM documents",
    ),
    "concept_ends": (
        ["edges"],
        "SELECT sid AS concept_id, * FROM edges WHERE st = 'concept' UNION ALL "
        "SELECT tid AS concept_id, * FROM edges WHERE tt = 'concept' AND NOT (st = 'concept' AND sid = tid)",
    ),
    "qconcepts": (["retrieved"], "SELECT DISTINCT query_id, concept_id FROM retrieved WHERE concept_id <> ''"),
    "line_of": (
        ["concept_ends"],
        "SELECT concept_id, made, id, st || ':' || sid || ' --' || rel || '--> ' || tt || ':' || tid AS line FROM concept_ends",
    ),
    "skey": (
        ["retrieved"],
        "SELECT *, coalesce(nullif(document_id, ''), nullif(url, ''), chunk_id) AS source FROM retrieved",
    ),
    "pairs": (
        ["skey"],
        "SELECT a.query_id, a.p AS position_a, b.p AS position_b, a.source AS source_a, b.source AS source_b, "
        "CASE WHEN len(list_distinct(list_concat(a.t, b.t))) > 0 THEN len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) ELSE 0.0 END AS overlap "
        "FROM sources a JOIN sources b ON a.query_id = b.query_id AND a.p < b.p",
    ),
    "sources": (
        ["skey"],
        "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_rank) AS p FROM (SELECT query_id, source, min(rank) AS first_rank, "
        + tokens("string_agg(chunk_text, ' ')") + " AS t FROM skey GROUP BY 1, 2)",
    ),
    "history": (
        [],
        "SELECT CAST(conv_id AS VARCHAR) AS session_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM conversations GROUP BY 1",
    ),
    "sections": (
        ["clear", "retrieved", "history", "qconcepts", "line_of"],
        f"SELECT query_id, 0 AS position, 0 AS priority, 'system_policies' AS name, {quoted(chr(10).join(V.SYSTEM_POLICIES))} AS content FROM clear "
        "UNION ALL SELECT query_id, 1, 0, 'current_message', message FROM clear "
        "UNION ALL SELECT query_id, 2, 1, 'retrieved_knowledge', string_agg('[' || coalesce(nullif(title, ''), nullif(document_id, ''), 'unknown source') || '] ' || chunk_text, chr(10) || chr(10) ORDER BY rank) FROM retrieved GROUP BY query_id "
        "UNION ALL SELECT query_id, 3, 2, 'dialogue_history', history FROM clear JOIN history ON session_id = query_id "
        "UNION ALL SELECT query_id, 4, 3, 'concept_graph', string_agg(line, chr(10) ORDER BY concept_id, made, id) FROM qconcepts JOIN line_of USING (concept_id) GROUP BY query_id "
        "UNION ALL SELECT query_id, 5, 4, 'project_state', 'Project: Project ' || project_id || chr(10) || 'Documents from ' || project_id FROM clear WHERE project_id IN (SELECT source FROM documents)",
    ),
    # sequential rule spelled as a recursion over the sections of each query
    "numbered": (
        ["sections"],
        "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY priority, position) AS n, greatest(1, length(content) // 4) AS tokens FROM sections WHERE content <> ''",
    ),
    "packing": (
        ["numbered"],
        "SELECT query_id, n, name, priority, content, CAST(tokens AS BIGINT) AS used, CAST(tokens AS BIGINT) AS total, false AS stopped, false AS cut, true AS kept FROM numbered WHERE n = 1 "
        "UNION ALL SELECT s.query_id, s.n, s.name, s.priority, "
        "CASE WHEN {fit} OR NOT {room} THEN s.content ELSE left(s.content, CAST((BUDGET - p.total) * 4 AS BIGINT)) END, "
        "CASE WHEN {fit} THEN s.tokens WHEN {room} THEN BUDGET - p.total ELSE 0 END, "
        "CASE WHEN {fit} THEN p.total + s.tokens WHEN {room} THEN BUDGET ELSE p.total END, "
        "p.stopped OR NOT {fit}, NOT {fit} AND {room}, {fit} OR {room} "
        "FROM packing p JOIN numbered s ON s.query_id = p.query_id AND s.n = p.n + 1",
    ),
    "budgets": (
        ["packing"],
        "SELECT query_id, sum(used) AS total_tokens, BUDGET AS max_tokens FROM packing WHERE kept GROUP BY 1",
    ),
    "evidence": (
        ["retrieved"],
        "SELECT query_id, count(*) AS n_chunks, avg(score) AS mean_score, stddev_pop(score) AS spread, arg_min(score, rank) AS top_score, "
        "arg_min(title, rank) AS top_title, count(DISTINCT nullif(document_id, '')) AS n_documents, bool_or(source_type = 'web') AS has_web, "
        "list_distinct(list_concat(list(title) FILTER (title <> ''), coalesce(list(document_id) FILTER (document_id <> ''), []))) AS known, "
        "list(chunk_id ORDER BY rank) AS chunk_ids FROM retrieved GROUP BY 1",
    ),
    "neighbours": (
        ["qconcepts", "docs", "concept_ends"],
        "SELECT query_id, (SELECT count(*) FROM qconcepts q2 JOIN docs USING (concept_id) WHERE q2.query_id = q.query_id) AS n_definitions, "
        "(SELECT count(*) FROM qconcepts q3 JOIN concept_ends USING (concept_id) WHERE q3.query_id = q.query_id) AS n_relationships "
        "FROM (SELECT DISTINCT query_id FROM qconcepts) q",
    ),
    "subscores": (
        ["clear", "evidence", "neighbours", "budgets"],
        "SELECT *, least(1.0, n / 3) AS s1, CASE WHEN n = 0 THEN 0.0 WHEN n = 1 THEN 1.0 WHEN mean_score > 0 THEN greatest(0.0, 1 - least(1.0, spread / mean_score)) ELSE 0.0 END AS s2, "
        "(CAST(n_def > 0 AS INT) + CAST(n > 0 AS INT) + CAST(n_rel > 0 AS INT)) / 3 AS s3, "
        "CASE WHEN max_tokens > 0 THEN least(1.0, total_tokens / max_tokens) ELSE 0.0 END AS s4, "
        "CASE WHEN n > 0 THEN mean_score ELSE 0.0 END AS s5 FROM ("
        "SELECT q.query_id, q.item_id, q.query, q.message, q.project_id, e.* EXCLUDE (query_id, n_chunks), coalesce(e.n_chunks, 0) AS n, coalesce(x.n_definitions, 0) AS n_def, "
        "coalesce(x.n_relationships, 0) AS n_rel, b.total_tokens, b.max_tokens FROM clear q LEFT JOIN evidence e USING (query_id) "
        "LEFT JOIN neighbours x USING (query_id) LEFT JOIN budgets b USING (query_id))",
    ),
    "reasons": (["subscores"], f"SELECT *, {six('(s1 + s2 + s3 + s4 + s5) / 5')} AS overall, {six('s2')} AS agreement FROM subscores"),
    "responses": (
        ["reasons"],
        "SELECT *, CASE item_id % 6 "
        f"WHEN 0 THEN 'See [' || coalesce(top_title, 'none') || '] for details; confidence is ' || {two('overall')} || '.' "
        "WHEN 1 THEN 'As [Unknown Report] shows, and [Unknown Report] again, this holds. Confidence: 0.95' "
        "WHEN 2 THEN 'There is no evidence and I am uncertain.' "
        "WHEN 3 THEN 'The evidence is limited, I''m not fully certain.' "
        "WHEN 4 THEN 'However the sources differ; confidence 1 and CONFIDENCE of 0.2 are unclear. [' || coalesce(top_title, 'none') || '] [X]' "
        "ELSE 'Plain claim without hedge.' END AS response_text FROM reasons",
    ),
    "violations": (
        ["responses"],
        "SELECT *, lower(response_text) AS lowr, "
        f"list_transform(list_filter(regexp_extract_all(response_text, '{V.CITATION_PATTERN}', 1), lambda c: NOT list_contains(coalesce(known, []), c)), lambda c: {message(V.CITATION_VIOLATION, 'c')}) AS v1, "
        f"list_transform(list_filter(list_transform(regexp_extract_all(response_text, '(?i){V.CONFIDENCE_CLAIM_PATTERN}', 1), lambda x: CAST(x AS DOUBLE)), lambda c: abs(c - overall) > {V.CONFIDENCE_TOLERANCE}), "
        f"lambda c: {message(V.CLAIM_VIOLATION, two('c'), two('overall'))}) AS v2, "
        f"CASE WHEN overall < {V.LOW_CONFIDENCE} AND NOT {any_of('lower(response_text)', V.UNCERTAINTY_MARKERS)} THEN [{message(V.HEDGE_VIOLATION, two('overall'))}] ELSE [] END AS v3, "
        f"CASE WHEN n = 0 AND NOT {any_of('lower(response_text)', V.NO_EVIDENCE_MARKERS)} THEN [{quoted(V.COMPLETENESS_VIOLATION)}] ELSE [] END AS v4, "
        f"list_concat(list_concat(CASE WHEN n = 0 AND NOT {any_of('lower(response_text)', V.NO_EVIDENCE_MARKERS)} THEN ['insufficient_evidence_not_acknowledged'] ELSE [] END, "
        f"CASE WHEN n = 0 AND NOT {any_of('lower(response_text)', V.EXPOSED_UNCERTAINTY_MARKERS)} THEN ['uncertainty_not_exposed'] ELSE [] END), "
        f"CASE WHEN agreement < {V.LOW_AGREEMENT} AND n > 1 AND NOT {any_of('lower(response_text)', V.CONFLICT_MARKERS)} THEN ['forced_synthesis_risk'] ELSE [] END) AS flags "
        "FROM responses",
    ),
    "verdicts": (
        ["violations"],
        "SELECT *, len(v1) + len(v2) + len(v3) + len(v4) = 0 AS valid, len(flags) = 0 AS reflected, "
        "len(v1) + len(v2) + len(v3) + len(v4) + len(flags) = 0 AS delivered, list_concat(list_concat(v1, v2), list_concat(v3, v4)) AS all_v FROM violations",
    ),
}


def _score(source: str, keys: str) -> str:
    """Combined score of every query of ``source`` with every vector chunk."""
    names = ", ".join(f"q.{k.strip()}" for k in keys.split(","))
    kw = "CASE WHEN len(q.qtok) > 0 AND len(c.tokens) > 0 THEN len(list_intersect(q.qtok, c.tokens)) / len(q.qtok) ELSE 0.0 END"
    return (
        f"SELECT *, floor((0.7 * sem + 0.3 * kw) * 1e12 + 0.5) / 1e12 AS score FROM (SELECT {names}, c.doc_id, c.document_id, c.concept_id, c.title, c.chunk_index, "
        f"c.chunk_id, c.chunk_text, list_cosine_similarity(q.embedding, c.embedding) AS sem, {kw} AS kw FROM {source} q, vchunks c)"
    )


def _rank(source: str, top_k: int = V.TOP_K) -> str:
    return (
        f"SELECT * EXCLUDE (rn, score), {six('score')} AS score, CAST(rn AS BIGINT) AS rank, {six('sem')} AS semantic_score, {six('kw')} AS keyword_score FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index, chunk_id) AS rn FROM {source} WHERE score >= 0) WHERE rn <= {top_k}"
    )


def score(source: str, keys: str = "query_id") -> str:
    return _score(source, keys)


def rank(source: str, top_k: int = V.TOP_K) -> str:
    return _rank(source, top_k)


def _body(name: str, budget: int) -> str:
    text = FRAGMENTS[name][1]
    if text.startswith("{score:"):
        _, source, keys = text[1:-1].split(":")
        return _score(source, keys)
    if text.startswith("{rank:"):
        return _rank(text[6:-1])
    fit = "(s.priority = 0 OR (NOT p.stopped AND p.total + s.tokens <= BUDGET))"
    room = "(NOT p.stopped AND BUDGET - p.total > 20)"
    if name == "packing":
        text = text.replace("{fit}", fit).replace("{room}", room)
    return text.replace("BUDGET", f"CAST({budget} AS BIGINT)")


def with_(names: str, select: str, extra: dict[str, str] | None = None, budget: int = V.CONTEXT_TOKENS) -> str:
    """``select`` preceded by the named fragments and all they need."""
    order: list[str] = []
    needs = {"edges": ["docs", "alldocs"], "pairs": ["skey", "sources"]}

    def visit(name: str) -> None:
        if name in order:
            return
        for parent in needs.get(name, FRAGMENTS[name][0]):
            visit(parent)
        order.append(name)

    for name in names.split():
        visit(name)
    parts = [
        f"{n} AS ({_body(n, budget)})" if n == "packing" else f"{n} AS MATERIALIZED ({_body(n, budget)})" for n in order
    ]
    parts += [f"{n} AS ({body})" for n, body in (extra or {}).items()]
    head = "WITH RECURSIVE " if "packing" in order or any("UNION ALL" in b and f"FROM {n}" in b for n, b in (extra or {}).items()) else "WITH "
    return head + ",\n".join(parts) + "\n" + select
