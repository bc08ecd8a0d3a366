"""Queries of the estate operators over the given tables, each with the SQL that checks it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from estateloom.functions import inventory as I
from estateloom.functions.keys import host_slug, slug
from estateloom.functions.skew import salted_join
from estateloom.operators import chunking, evaluation, evidence, extraction, graph, questions, reconciliation, retrieval, rollups, tables
from estateloom.sources import sinks
from estateloom.streaming import incremental
from estateloom.session import read_table

Query = Callable[[SparkSession, str], DataFrame]


def over(name: str, f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda s, d: f(read_table(s, d, name))


def over2(a: str, b: str, f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda s, d: f(read_table(s, d, a), read_table(s, d, b))


def _headers(inventory: DataFrame) -> DataFrame:
    raw = inventory.select(F.explode(F.map_keys(F.from_json("payload", "map<string,string>"))).alias("raw"))
    n = raw.groupBy("raw").agg(F.count("*").alias("n"))
    return n.select("raw", "n", I.canonical_header("raw").alias("field"), F.coalesce(I.header_unit("raw"), F.lit("")).alias("unit"), I.canonical_attribute("raw").alias("attribute"))


def _measures(claims: DataFrame) -> DataFrame:
    c = claims.dropDuplicates(["claim_id"]).withColumn("field", I.canonical_attribute("attribute")).where(F.col("field").isin(*I.BOUNDS))
    x = I.to_canonical(F.col("field"), F.col("value"))
    return c.select("claim_id", "field", F.round(x, 4).alias("canonical"), I.is_plausible(F.col("field"), x).alias("plausible"))


def _host_keys(claims: DataFrame) -> DataFrame:
    servers = claims.where("entity_type = 'server'").select("claim_id", host_slug("entity_key").alias("host"))
    return servers.groupBy("host").agg(F.countDistinct("claim_id").alias("n_claims"))


def _column_variants(inventory: DataFrame) -> DataFrame:
    keys = inventory.select(F.explode(F.map_keys(F.from_json("payload", "map<string,string>"))).alias("raw")).groupBy(slug("raw").alias("key")).agg(F.count("*").alias("usage"))
    return reconciliation.merged_variants(keys.select(F.lit("column").alias("kind"), "key", "usage", F.lit(None).cast("string").alias("name")))


def _documents_of_kind(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """Facts whose document is an inventory, code or a questionnaire, per kind: an equi join with a filter that reaches the scan."""
    kinds = documents.where(F.col("doc_type").isin("inventory", "code_snapshot", "questionnaire")).select(F.col("document_id").alias("source_document_id"), "doc_type").distinct()
    return claims.select("claim_id", "source_document_id").distinct().join(kinds, "source_document_id").groupBy("doc_type").agg(F.count("*").alias("n_claims"), F.countDistinct("source_document_id").alias("n_documents"))


def _ranked_documents(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """The five most cited documents of each assessment in order, then their rows in that order."""
    per = claims.where("source_document_id is not null").groupBy("assessment_id", "source_document_id").agg(F.countDistinct("claim_id").alias("n"))
    place = F.row_number().over(Window.partitionBy("assessment_id").orderBy(F.desc("n"), F.desc("source_document_id")))
    top = per.withColumn("place", place).where("place <= 5").groupBy("assessment_id").agg(F.array_sort(F.collect_list(F.struct("place", "source_document_id"))).alias("top"))
    ids = top.select("assessment_id", F.col("top.source_document_id").alias("ids"))
    rows = documents.groupBy("document_id").agg(F.max("doc_type").alias("doc_type"))
    return ids.select("assessment_id", F.posexplode("ids").alias("place", "document_id")).join(rows, "document_id").select("assessment_id", "place", "document_id", "doc_type")


def _sets(documents: DataFrame, inventory: DataFrame) -> DataFrame:
    """Assessments by whether they have inventory feeds, documents, or both."""
    a, b = documents.select("assessment_id").distinct(), inventory.select("assessment_id").distinct()
    tag = lambda df, kind: df.select("assessment_id", F.lit(kind).alias("kind"))
    return tag(a.intersect(b), "both").unionByName(tag(a.exceptAll(b), "documents only")).unionByName(tag(b.exceptAll(a), "feeds only"))


def _classified(documents: DataFrame) -> DataFrame:
    """Documents by the file name ladder, the precedence that goes with the class, and whether it is the given one."""
    name = F.lower("filename")
    kind = (
        F.when(name.endswith(".zip"), "code_snapshot").when(name.rlike(r"\.(xlsx|xls|csv|json)$") | name.contains("inventory") | name.contains("cmdb"), "inventory")
        .when(name.rlike("requirement|nfr|brd|rfc|sla"), "requirements").when(name.contains("questionnaire"), "questionnaire").when(name.rlike("runbook|sop"), "runbook")
        .when(name.contains("architecture") | name.rlike(r"\.(pdf|docx|doc)$"), "architecture").otherwise("unknown")
    )
    # Precedence of each class.
    rank = {"inventory": "100", "code_snapshot": "90", "architecture": "80", "requirements": "70", "runbook": "60", "questionnaire": "40", "unknown": "50"}
    return documents.dropDuplicates(["document_id"]).select("document_id", kind.alias("kind"), I.lookup(rank, kind).cast("int").alias("rank"), (kind == F.col("doc_type")).alias("as_given"))


def _tables(f: Callable[[DataFrame], DataFrame]) -> Query:
    return over("documents", lambda docs: f(tables.pipe_tables(docs)))


def _every_hundredth(documents: DataFrame) -> DataFrame:
    return documents.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")


def _vectors(embeddings: DataFrame) -> DataFrame:
    return retrieval.nearest_vectors(embeddings, embeddings.where("vec_id % 100 = 0")).select("query_id", "vec_id", F.round("score", 4).alias("score"), "place")


def _label_agreement(embeddings: DataFrame) -> DataFrame:
    """How well the nearest vectors share the label of the query: ranking scores per query."""
    found = retrieval.nearest_vectors(embeddings, embeddings.where("vec_id % 100 = 0")).select("query_id", "vec_id", "place").where("query_id <> vec_id")
    labels = embeddings.select("vec_id", "label")
    others = labels.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    asked = salted_join(labels.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label"), others, ["label"], ["query_id"], "left")
    hits = found.join(labels.select("vec_id", F.col("label").alias("found")), "vec_id").join(asked.select("query_id", "label"), "query_id")
    right = F.col("found") == F.col("label")
    scores = hits.groupBy("query_id").agg(F.count("*").alias("n_top"), F.count_if(right).alias("n_hit"), F.min(F.when(right, F.col("place"))).alias("first"))
    n_hit, n_top, n = F.coalesce("n_hit", F.lit(0)), F.coalesce("n_top", F.lit(0)), F.coalesce("n_relevant", F.lit(0))
    rounded = lambda c, name: F.round(c, 4).alias(name)
    return asked.join(scores, "query_id", "left").select(
        "query_id", rounded(F.when(n == 0, 1.0).otherwise(n_hit / n), "recall_at_k"), rounded(F.when(n_top == 0, 0.0).otherwise(n_hit / n_top), "precision_at_k"), rounded(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), "reciprocal_rank")
    )


def _indexed(embeddings: DataFrame) -> DataFrame:
    """How many of the exact neighbours the index finds, over all queries."""
    asked = embeddings.where("vec_id % 100 = 0")
    exact = retrieval.nearest_vectors(embeddings, asked).select("query_id", "vec_id")
    found = retrieval.nearest_by_index(embeddings, asked).select("query_id", "vec_id").withColumn("hit", F.lit(1))
    both = exact.join(found, ["query_id", "vec_id"], "left").agg(F.count("*").alias("n_exact"), (F.count("hit") / F.count("*")).alias("recall"))
    return both.select("n_exact", (F.col("recall") >= 0.9).alias("recall_reached"))


def _supply(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))


def _rank(lineitem: DataFrame) -> DataFrame:
    return graph.pagerank(_supply(lineitem)).select("node", F.round(F.col("rank") * 1000, 4).alias("rank"))


def _reach(lineitem: DataFrame) -> DataFrame:
    edges = _supply(lineitem)
    centres = lineitem.where("l_partkey % 100 = 0").select(F.concat(F.lit("p"), "l_partkey").alias("node")).distinct()
    return graph.neighbourhoods(edges, centres, 2)


def _nodes(suppliers: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Suppliers and the parts they ship, parts being stubs here: nodes by kind and whether an own row exists."""
    edges = _supply(lineitem)
    nodes = graph.with_stubs(suppliers.select(F.concat(F.lit("s"), "s_suppkey").alias("node")), edges)
    return nodes.groupBy(F.left("node", F.lit(1)).alias("kind"), "stub").agg(F.count("*").alias("n"))


def _colocated(claims: DataFrame) -> DataFrame:
    """Servers that the latest selected claims put into one datacenter of an assessment, with the number of others there."""
    dc = claims.where("is_selected and entity_type = 'server' and lower(attribute) = 'datacenter' and value is not null")
    place = F.concat_ws("/", "assessment_id", F.lower(F.trim("value")))
    return graph.colocation(dc.select(place.alias("place"), host_slug("entity_key").alias("member")))


def _by_origin(documents: DataFrame, claims: DataFrame, files: DataFrame) -> DataFrame:
    part = lambda df, origin, c: df.select(F.lit(origin).alias("origin"), F.col(c).alias("text"))
    return part(documents, "documents", "text").unionByName(part(claims, "claims", "evidence_quote")).unionByName(part(files, "manifest_files", "text"))


def _keywords(documents: DataFrame, claims: DataFrame) -> DataFrame:
    """The names that entities have, as queries against all documents."""
    names = claims.where("lower(attribute) = 'name' and value is not null").select(F.lower(F.trim("value")).alias("query_id")).distinct()
    return retrieval.keyword_search(documents, names.withColumn("text", F.col("query_id"))).select("query_id", "doc_id", "score", "place")


def _host_coverage(lines: DataFrame, claims: DataFrame) -> DataFrame:
    """Hosts of inventory lines against hosts that claims speak of, per assessment."""
    first = F.lower(F.regexp_extract("raw_line", r"^\"?([A-Za-z0-9][A-Za-z0-9.-]*)\"?[,;\t]", 1))
    listed = lines.where("line_no > 1").select("assessment_id", host_slug(first).alias("host")).where("host <> 'unknown'")
    told = claims.where("entity_type = 'server'").select("assessment_id", host_slug("entity_key").alias("host"))
    return evaluation.coverage(listed, told, "assessment_id", "host")


def _fused_search(documents: DataFrame) -> DataFrame:
    q = _every_hundredth(documents)
    return retrieval.hybrid(documents, q)


def _conflict_members(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """The claims of each conflict beside the one selected: members by a join on the group, not by lists of ids."""
    found = reconciliation.conflicts(claims, documents).select(*reconciliation.GROUP, "selected_claim_id")
    members = reconciliation.canonical_claims(claims).select(*reconciliation.GROUP, "claim_id", "compared")
    return salted_join(members, found, reconciliation.GROUP, ["claim_id"], "inner").select("claim_id", "compared", "selected_claim_id", (F.col("claim_id") == F.col("selected_claim_id")).alias("selected"))


def _duplicate_texts(documents: DataFrame) -> DataFrame:
    """Classes of equal texts by content hash: the first document, copies, and characters saved by keeping one."""
    h = documents.where("text is not null").groupBy(F.sha2("text", 256).alias("hash"))
    return h.agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"), (F.sum(F.length("text")) - F.max(F.length("text"))).alias("saved_chars")).where("n > 1")


def _ingestion_lag(claims: DataFrame) -> DataFrame:
    """Per assessment and day of extraction: claims and the seconds from extraction to first delivery, never below 0."""
    first = claims.groupBy("claim_id").agg(F.min("ingested_at").alias("seen"), F.min("extracted_at").alias("made"), F.min("assessment_id").alias("assessment_id"))
    lag = F.greatest(F.lit(0), F.timestamp_diff("SECOND", F.col("made"), F.col("seen")))
    return first.groupBy("assessment_id", F.date_format("made", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.min(lag).alias("least"), F.max(lag).alias("most"), F.sum(lag).alias("total"))


def _sanitised(claims: DataFrame) -> DataFrame:
    """What a gate behind an extractor does to claims: types off the list dropped, texts cut to their limits, confidence clamped."""
    c = claims.dropDuplicates(["claim_id"])
    kind = I.canonical_entity_type("entity_type")
    conf = F.least(F.greatest(F.coalesce(F.nanvl("confidence", F.lit(None).cast("double")), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return c.where(kind.isNotNull()).select("claim_id", kind.alias("entity_type"), F.left("entity_key", F.lit(120)).alias("entity_key"), F.left("attribute", F.lit(80)).alias("attribute"), F.left("value", F.lit(500)).alias("value"), F.left("evidence_quote", F.lit(500)).alias("quote"), conf.alias("confidence"))


def _preferred_documents(documents: DataFrame, claims: DataFrame) -> DataFrame:
    """Documents by their own row, else by the claims that cite them: the first source wins."""
    own = documents.select("document_id", "assessment_id").distinct()
    cited = claims.where("source_document_id is not null").groupBy(F.col("source_document_id").alias("document_id")).agg(F.min("assessment_id").alias("assessment_id"))
    return questions.first_of_sources(own, cited, "document_id")


def _overflow(documents: DataFrame, most: int = 200) -> DataFrame:
    """The first ``most`` documents by size, and whether there were more: one row beyond the limit is read."""
    rows = documents.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(most + 1)
    n = F.count("*").over(Window.partitionBy())  # over the limited rows
    place = F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id"))
    return rows.withColumn("more", n > most).withColumn("place", place).where(F.col("place") <= most).select("doc_id", "place", "more")


QUERIES: dict[str, Query] = {
    "segments": over("documents", tables.segments),
    "stacked_headers": _tables(lambda t: tables.stacked_headers(t).select("doc_id", "table_no", "n_header_rows", F.array_join("header", "|").alias("header"))),
    "gap_signals": over("documents", extraction.gap_signals),
    "thin_documents": over("documents", extraction.thin_documents),
    "top_nodes": over("lineitem", lambda items: graph.pagerank(_supply(items)).select("node", F.round(F.col("rank") * 1000, 4).alias("rank")).orderBy(F.desc("rank"), "node").limit(5)),
    "keyword_search": over2("documents", "claims", _keywords),
    "labelled_rows": _tables(tables.labelled_rows),
    "table_chunks": _tables(tables.table_chunks),
    "attribute_answers": over("claims", rollups.attribute_answers),
    "host_coverage": over2("inventory_lines", "claims", _host_coverage),
    "conflict_members": over2("claims", "source_documents", _conflict_members),
    "duplicate_texts": over("documents", _duplicate_texts),
    "ingestion_lag": over("claims", _ingestion_lag),
    "sanitised_claims": over("claims", _sanitised),
    "preferred_documents": over2("source_documents", "claims", _preferred_documents),
    "overflow_probe": over("documents", _overflow),
    "recent_entries": over("events", questions.recent_entries),
    "named_entities": over2("documents", "claims", questions.named_entities),
    "answer_passages": over("documents", lambda docs: questions.passages(docs, _every_hundredth(docs))),
    "overlapped_chunks": over("documents", chunking.overlapped_chunks),
    "plain_documents": over("documents", lambda docs: docs.where("text is not null").select("doc_id", F.md5(chunking.plain_text("text")).alias("plain"), F.length(chunking.plain_text("text")).alias("n_chars"))),
    "cleaned_tables": _tables(lambda t: tables.cleaned_tables(t).select("doc_id", "table_no", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n").alias("rows"), "n_totals", "n_repeats", "n_notes")),
    "row_groups": _tables(tables.row_groups),
    "assessment_reports": over("claims", sinks.assessment_reports),
    "nearest_vectors": over("embeddings", _vectors),
    "label_agreement": over("embeddings", _label_agreement),
    "bm25_search": over("documents", lambda docs: retrieval.bm25(docs, _every_hundredth(docs)).select("query_id", "doc_id", F.round("score", 3).alias("score"), "place")),
    "bm25_any_script": over("documents", lambda docs: retrieval.bm25(docs, _every_hundredth(docs), words=retrieval.ANY_WORDS).select("query_id", "doc_id", F.round("score", 3).alias("score"), "place")),
    "index_recall": over("embeddings", _indexed),
    "hybrid_search": over("documents", _fused_search),
    "query_expansions": over("documents", retrieval.expansions),
    "pagerank": over("lineitem", _rank),
    "reach_of_parts": over("lineitem", _reach),
    "graph_nodes": over2("supplier", "lineitem", _nodes),
    "colocated_servers": over("claims", _colocated),
    "dependency_edges": over("documents", extraction.dependency_edges),
    "runtime_facts": over("documents", extraction.runtime_facts),
    "requirement_facts": over("documents", extraction.requirement_facts),
    "contact_counts": over("documents", extraction.contact_counts),
    "guarded_texts": lambda s, d: extraction.guarded(_by_origin(read_table(s, d, "documents"), read_table(s, d, "claims"), read_table(s, d, "manifest_files"))),
    "harmful_texts": lambda s, d: extraction.harmful(_by_origin(read_table(s, d, "documents"), read_table(s, d, "claims"), read_table(s, d, "manifest_files"))),
    "token_stats": over("documents", extraction.token_stats),
    "open_questions": over("documents", extraction.open_questions),
    "manifest_inventory": over("manifest_files", extraction.manifest_inventory),
    "language_scores": over("documents", lambda docs: evaluation.label_scores(evaluation.script_of(docs))),
    "event_windows_stream": incremental.event_windows,
    "latest_claims_stream": incremental.latest_claims,
    "canonical_headers": over("server_inventory", _headers),
    "measured_values": over("claims", _measures),
    "host_keys": over("claims", _host_keys),
    "column_variants": over("server_inventory", _column_variants),
    "claims_deduplicated": over("claims", reconciliation.deduplicated),
    "claim_conflicts": over2("claims", "source_documents", reconciliation.conflicts),
    "entities": over("claims", reconciliation.entities),
    "values_in_order": over("claims", rollups.ordered_distinct),
    "usage_rollup": over("events", rollups.usage_rollup),
    "usage_counters": over("events", rollups.usage_counters),
    "report_metrics": over("claims", rollups.report_metrics),
    "review_queue": over("claims", rollups.review_queue),
    "state_fingerprint": over("claims", rollups.state_fingerprint),
    "missing_attributes": over("claims", rollups.missing_attributes),
    "latest_decisions": over("events", rollups.latest_decisions),
    "user_sessions": over("events", rollups.sessions),
    "last_view_before_purchase": over("events", rollups.neighbours_in_time),
    "resolved_references": over2("claims", "source_documents", evidence.resolved_references),
    "source_of_claims": over2("claims", "source_documents", evidence.source_of_claims),
    "dangling_sources": over2("claims", "source_documents", evidence.dangling_sources),
    "grounded_values": over("claims", evidence.grounded_values),
    "evidence_spans": over("claims", evidence.evidence_spans),
    "facts_by_document_kind": over2("claims", "source_documents", _documents_of_kind),
    "ranked_documents": over2("claims", "source_documents", _ranked_documents),
    "assessment_sets": over2("source_documents", "server_inventory", _sets),
    "document_classes": over("source_documents", _classified),
    "paragraphs_in_context": over("documents", chunking.paragraphs),
    "paragraph_spans": over("documents", chunking.paragraph_spans),
    "char_windows": over("documents", chunking.char_windows),
    "packed_chunks": over("documents", chunking.packed_chunks),
    "sections": over("documents", chunking.sections),
    "table_shapes": _tables(tables.table_shapes),
    "table_summaries": _tables(tables.table_summaries),
    "table_claims": _tables(tables.rows_to_claims),
    "filled_headers": _tables(tables.filled_headers),
    "detected_headers": over("inventory_lines", tables.detected_headers),
}


def _case(table: dict[str, str], key: str, otherwise: str) -> str:
    return "case " + key + "".join(f" when '{k}' then '{v}'" for k, v in table.items()) + f" else {otherwise} end"


def _sql_snake(x: str) -> str:
    return rf"regexp_replace(regexp_replace(lower(trim({x})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


def _sql_slug(x: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def _sql_host(x: str) -> str:
    t = f"lower(trim({x}))"
    return rf"""case when regexp_full_match({t}, '[a-z0-9][a-z0-9-]*(\.[a-z0-9-]+)*\.[a-z]+') then split_part({t}, '.', 1)
        when regexp_full_match({t}, '\d{{1,3}}(\.\d{{1,3}}){{3}}') then {t} else {_sql_slug(t)} end"""


_FIELD = {a: f for a, f in I.inverted(I.COLUMN_ALIASES).items() if f != "server"}
_ATTRIBUTE = {**_FIELD, **I.ATTRIBUTE_SYNONYMS, **dict.fromkeys(I.NAME_ATTRIBUTES, "name")}
_SQL_ATTRIBUTE = _case(_ATTRIBUTE, _sql_snake("attribute"), _sql_snake("attribute"))
_MEASURED = ", ".join(f"'{f}'" for f in I.BOUNDS)
_SQL_CANONICAL = r"""
    case when field in ('memory_gb', 'disk_gb') then n * case unit when 'b' then 1.0/1073741824 when 'kb' then 1.0/1048576 when 'kib' then 1.0/1048576 when 'mb' then 1.0/1024 when 'mib' then 1.0/1024
              when 'tb' then 1024.0 when 'tib' then 1024.0 when 'pb' then 1048576.0 when 'pib' then 1048576.0 else 1.0 end
         when field like '%\_pct' escape '\' and not contains(t, '%') and n > 0 and n < 1 then n * 100 else n end"""
_KEYED = rf"""
d as (select distinct on (claim_id) * from claims),
k0 as (select *, {_SQL_ATTRIBUTE} as field, replace(lower(trim(value)), ',', '') as t,
         case when entity_type = 'server' then {_sql_host("entity_key")} else {_sql_slug("entity_key")} end as ekey from d),
k1 as (select *, try_cast(regexp_extract(t, '-?\d+(\.\d+)?', 0) as double) as n,
         regexp_extract(trim(regexp_extract(t, '-?\d+(?:\.\d+)?(.*)$', 1, 's')), '^[a-zµ/%]+', 0) as unit from k0),
k2 as (select *, {_SQL_CANONICAL} as x, case when confidence is null or isnan(confidence) then 0.0 else confidence end as conf from k1),
k as (select *, case when field in ({_MEASURED}) and x is not null then printf('%.5e', round(x, 3)) else lower(trim(value)) end as compared from k2)"""
_BOUND = " ".join(f"when '{f}' then x between {a} and {b}" for f, (a, b) in I.BOUNDS.items())
_TABLES_SQL = r"""
runs as (select doc_id, unnest(regexp_extract_all(text || chr(10), '((?:[ \t]*\|[^\n]*\n)+)', 1)) as run, generate_subscripts(regexp_extract_all(text || chr(10), '((?:[ \t]*\|[^\n]*\n)+)', 1), 1) - 1 as table_no from documents),
cells as (select doc_id, table_no, list_transform(list_filter(string_split(run, chr(10)), lambda x: trim(x) <> ''),
            lambda x: list_transform(string_split(regexp_replace(trim(x), '^\||\|$', '', 'g'), '|'), lambda c: trim(c))) as cells from runs),
tabs as (select doc_id, table_no, cells[1] as header, cells[3:] as rows from cells where len(cells) >= 2 and len(list_filter(cells[2], lambda c: not regexp_full_match(c, ':?-+:?'))) = 0)"""
_HEADER_FIELDS = f"list_transform(header, lambda h: {_case(I.inverted(I.COLUMN_ALIASES), _sql_snake('h'), _sql_snake('h'))})"
_CELLS_SQL = (
    _TABLES_SQL
    + rf""",
h as (select *, {_HEADER_FIELDS} as fields from tabs),
r as (select doc_id, table_no, header, fields, unnest(rows) as row, generate_subscripts(rows, 1) - 1 as row_no from h),
u as (select doc_id, table_no, row_no, row[list_position(fields, 'server')] as server, unnest(header[1:len(row)]) as raw_header, unnest(fields[1:len(row)]) as field, unnest(row) as value from r)"""
)

def _pagerank_sql(iterations: int) -> str:
    """Power iteration, one materialised step each; the error of the ranks falls by 0.85 a step."""
    steps = ["r0 as materialized (select distinct src as node, 1.0 / (select count(distinct src) from links) as rank from links)"]
    for i in range(1, iterations + 1):
        steps.append(f"r{i} as materialized (select dst as node, 0.15 / (select count(*) from r0) + 0.85 * sum(rank / degree) as rank from links join r{i - 1} on src = node group by dst)")
    return ", ".join(steps)


_SUPPLY = "e as (select distinct 'p' || l_partkey as src, 's' || l_suppkey as dst from lineitem), both_ways as materialized (select src, dst from e union select dst, src from e)"
_RE = lambda p: p.replace("'", "''").replace(r"(?<![A-Za-z0-9_])", r"\b").replace(r"(?![A-Za-z0-9_])", r"\b")
_KIND_SQL = r"""case when f = 'package.json' then 'npm' when f = 'package-lock.json' then 'npm-lock' when f like 'dockerfile%' then 'docker' when f like 'docker-compose%' then 'compose' when f like '.env%' then 'env'
  when regexp_matches(f, '\.(properties|ini|npmrc|tfvars)$') then 'settings' when regexp_matches(f, '^appsettings.*\.json$') then 'dotnet' when f = 'pom.xml' then 'maven' when f like '%.csproj' then 'csproj' when f like 'build.gradle%' then 'gradle' when f = 'pyproject.toml' then 'pyproject' when regexp_matches(f, '\.(xml|config)$') then 'xml' when regexp_matches(f, '\.ya?ml$') then 'yaml'
  when f like '%.sh' then 'shell' when f like '%.js' then 'code' when f = 'requirements.txt' then 'pip' else 'other' end"""
_COMPONENT_SQL = f"""coalesce(list_filter(string_split(relative_path, '/')[1:len(string_split(relative_path, '/')) - 1],
  lambda p: p not in ({", ".join(f"'{g}'" for g in extraction.GENERIC_DIRECTORIES)}) and regexp_matches(p, '^[a-z][a-z-]*$'))[1], 'root')"""
def _bm25_sql(words: str) -> str:
    return rf"""
with t as (select doc_id, unnest(regexp_extract_all(lower(text), '{words}')) as word from documents where text is not null), tf as (select doc_id, word, count(*) as tf from t group by 1, 2),
dl as (select doc_id, count(*) as dl from t group by 1), n as (select count(*) as n, (select count(*) from t) * 1.0 / count(*) as avgdl from documents),
i0 as (select word, ln((n - count(*) + 0.5) / (count(*) + 0.5)) as idf from tf, n group by word, n), m as (select avg(idf) as m from i0), i as (select word, case when idf < 0 then 0.25 * m else idf end as idf from i0, m),
q as (select distinct doc_id as query_id, word from t where doc_id % 100 = 0),
s as (select query_id, tf.doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 4) as score from q join i using (word) join tf using (word) join dl on dl.doc_id = tf.doc_id, n group by 1, 2),
r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as place from s where score > 0)
select query_id, doc_id, round(score, 3) as score, place from r where place <= 8"""


SEARCH_ORACLES: dict[str, str] = {
    "nearest_vectors": """
with q as (select vec_id as query_id, cast(embedding as double[64]) as a from embeddings where vec_id % 100 = 0),
s as (select query_id, vec_id, round(array_cosine_similarity(a, cast(embedding as double[64])), 6) as score from q cross join embeddings),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as place from s where score > 0.02)
select query_id, vec_id, round(score, 4) as score, place from r where place <= 8""",
    "bm25_search": _bm25_sql(retrieval.LATIN_WORDS),
    "bm25_any_script": _bm25_sql(retrieval.ANY_WORDS),
    "index_recall": """
with q as (select vec_id as query_id, cast(embedding as double[64]) as a from embeddings where vec_id % 100 = 0),
s as (select query_id, vec_id, round(array_cosine_similarity(a, cast(embedding as double[64])), 6) as score from q cross join embeddings),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as place from s where score > 0.02)
select count(*) as n_exact, true as recall_reached from r where place <= 8""",
    "label_agreement": """
with q as (select vec_id as query_id, label as wanted, cast(embedding as double[64]) as a from embeddings where vec_id % 100 = 0),
s as (select query_id, wanted, vec_id, label, round(array_cosine_similarity(a, cast(embedding as double[64])), 6) as score from q cross join embeddings),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as place from s where score > 0.02),
t as (select * from r where place <= 8 and vec_id <> query_id),
n as (select query_id, (select count(*) from embeddings e where e.label = q.wanted and e.vec_id <> q.query_id) as n_relevant from q),
h as (select query_id, count(*) as n_top, count(*) filter (label = wanted) as n_hit, min(place) filter (label = wanted) as first from t group by 1)
select n.query_id, round(case when n_relevant = 0 then 1.0 else coalesce(n_hit, 0) / n_relevant end, 4) as recall_at_k, round(case when coalesce(n_top, 0) = 0 then 0.0 else n_hit / n_top end, 4) as precision_at_k,
  round(coalesce(1.0 / first, 0.0), 4) as reciprocal_rank from n left join h using (query_id)""",
    "language_scores": r"""
with c as (select lower(lang) as lang, length(regexp_replace(text, '[^\x{0E00}-\x{0E7F}]', '', 'g')) as th, length(regexp_replace(text, '[^\x{0900}-\x{097F}]', '', 'g')) as hi, length(regexp_replace(text, '[^\x{0600}-\x{06FF}]', '', 'g')) as ar,
  length(regexp_replace(text, '[^\x{3040}-\x{30FF}]', '', 'g')) as ja, length(regexp_replace(text, '[^\x{4E00}-\x{9FFF}]', '', 'g')) as zh, length(regexp_replace(text, '[^\x{0400}-\x{04FF}]', '', 'g')) as ru from documents where text is not null and lang is not null),
m as (select *, greatest(th, hi, ar, ja, zh, ru) as most from c),
p as (select case when most = 0 then 'latin' when ja > 0.1 * zh then case when greatest(th, hi, ar, ru) > ja then 'other' else 'ja' end when th = most then 'th' when hi = most then 'hi' when ar = most then 'ar'
  when ru = most then 'ru' when zh = most then 'zh' else 'other' end as predicted, case when lang in ('th', 'hi', 'ar', 'ja', 'zh', 'ru') then lang else 'latin' end as expected from m),
u as (select predicted as label, 1 as p, 0 as e, (predicted = expected)::int as tp from p union all select expected, 0, 1, 0 from p),
s as (select label, sum(tp)::bigint as tp, sum(p)::bigint as predicted, sum(e)::bigint as expected from u group by 1),
f as (select *, case when predicted > 0 then tp / predicted else 0.0 end as pr, case when expected > 0 then tp / expected else 0.0 end as re from s)
select label, tp, predicted, expected, round(pr, 4) as precision, round(re, 4) as recall, round(case when pr + re > 0 then 2 * pr * re / (pr + re) else 0.0 end, 4) as f1 from f""",
    "query_expansions": rf"""
with w as (select doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' as w from documents where text is not null),
h as (select doc_id, list_filter([{", ".join(f"case when {' or '.join(f'contains(w, {chr(39)} {t} {chr(39)})' for t in trig)} then {{'name': '{n}', 'said': [{', '.join(f'{chr(39)}{x}{chr(39)}' for x in said)}]}} end" for n, (trig, said) in retrieval.CONCEPTS.items())}], lambda x: x is not null) as hit from w),
f as (select doc_id, hit, flatten(list_transform(range(1, 5), lambda d: list_filter(list_transform(hit, lambda c: c.said[d]), lambda x: x is not null))) as turns from h where len(hit) > 0),
u as (select doc_id, hit, list_filter(turns, lambda x, i: list_position(turns, x) = i) as turns from f)
select doc_id, array_to_string(list_transform(hit, lambda c: c.name), ',') as concepts, array_to_string(turns[1:4], '; ') as expansions from u""",
    "pagerank": f"with {_SUPPLY}, links as materialized (select src, dst, count(*) over (partition by src) as degree from both_ways), {_pagerank_sql(130)} select node, round(rank * 1000, 4) as rank from r130",
    "reach_of_parts": f"""
with {_SUPPLY}, c as (select distinct 'p' || l_partkey as centre from lineitem where l_partkey % 100 = 0),
a as (select distinct centre, dst as node from c join both_ways on centre = src),
b as (select distinct centre, dst as node from a join both_ways on node = src where dst <> centre)
select centre, 1 as depth, count(*) as n_nodes from a group by 1 union all
select centre, 2 as depth, count(*) as n_nodes from (select centre, node from b except select centre, node from a) group by 1""",
    "graph_nodes": f"""
with {_SUPPLY}, own as (select distinct 's' || s_suppkey as node from supplier), ends as (select src as node from e union select dst from e)
select left(node, 1) as kind, stub, count(*) as n from (select node, false as stub from own union all select node, true from (select node from ends except select node from own)) group by 1, 2""",
    "colocated_servers": f"""
with m as (select distinct assessment_id || '/' || lower(trim(value)) as place, {_sql_host("entity_key")} as member from claims where is_selected and entity_type = 'server' and lower(attribute) = 'datacenter' and value is not null),
c as (select *, count(*) over (partition by place) - 1 as n_links from m) select place, member, n_links from c where n_links > 0""",
    "dependency_edges": rf"""
with f as (select doc_id, unnest(regexp_extract_all(text, '{extraction.RELATION}', 1)) as a, unnest(regexp_extract_all(text, '{extraction.RELATION}', 2)) as r, unnest(regexp_extract_all(text, '{extraction.RELATION}', 3)) as b from documents)
select {_sql_slug("a")} as source, case when contains(r, 'depend') then 'depends_on' else 'calls' end as relation, {_sql_slug("b")} as target, count(distinct doc_id) as n_documents, count(*) as n_mentions from f group by 1, 2, 3""",
    "runtime_facts": rf"""
with f as (select doc_id, unnest(regexp_extract_all(text, '{extraction.RUNS}', 1)) as host, unnest(regexp_extract_all(text, '{extraction.RUNS}', 2)) as software, unnest(regexp_extract_all(text, '{extraction.RUNS}', 3)) as version,
  unnest(regexp_extract_all(text, '{extraction.RUNS}', 4)) as platform from documents)
select host, software, version, platform, count(*) as n, count(distinct doc_id) as n_documents from f group by 1, 2, 3, 4""",
    "requirement_facts": f"with d as (select doc_id, text, regexp_replace(text, '{_RE(extraction.BOTH_TARGETS)}', ' ', 'g') as rest from documents), f as ("
    + " union all ".join(f"select doc_id, '{a}' as requirement, trim(unnest(regexp_extract_all({t}, '{_RE(p)}', {g}))) as value from d" for a, t, p, g in [("rto", "text", extraction.BOTH_TARGETS, 1), ("rpo", "text", extraction.BOTH_TARGETS, 2), *((a, "rest", p, 1) for a, p in extraction.REQUIREMENTS)])
    + ") select requirement, value, count(*) as n, count(distinct doc_id) as n_documents from f where length(value) >= 2 group by 1, 2",
    "contact_counts": rf"""
select doc_id, len(regexp_extract_all(text, '{_RE(extraction.EMAIL)}')) as n_email, len(regexp_extract_all(text, '{_RE(extraction.IPV4)}')) as n_ipv4, len(regexp_extract_all(text, '{_RE(extraction.PHONE)}')) as n_phone,
  md5(regexp_replace(regexp_replace(regexp_replace(text, '{_RE(extraction.EMAIL)}', '[REDACTED_EMAIL]', 'g'), '{_RE(extraction.IPV4)}', '[REDACTED_IPV4]', 'g'), '{_RE(extraction.PHONE)}', '[REDACTED_PHONE]', 'g')) as redacted from documents where text is not null""",
    "guarded_texts": rf"""
with t as (select 'documents' as origin, text from documents union all select 'claims', evidence_quote from claims union all select 'manifest_files', text from manifest_files)
select origin, count(*) as n, count(*) filter (regexp_matches(text, '(?i){_RE("|".join(f"(?:{p})" for p in extraction.INJECTION))}')) as n_injection, count(*) filter (regexp_matches(text, '(?i){_RE(extraction.CREDENTIAL)}')) as n_credential from t where text is not null group by 1""",
    "harmful_texts": "with t as (select 'documents' as origin, text from documents union all select 'claims', evidence_quote from claims union all select 'manifest_files', text from manifest_files) "
    + " union all ".join(f"select origin, '{c}' as category, count(*) filter (regexp_matches(text, '(?i){_RE(p)}')) as n from t where text is not null group by 1" for c, p in extraction.HARM.items()),
    "token_stats": "with t as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as t from documents where text is not null) select doc_id, len(t) as n_tokens, len(list_distinct(t)) as n_distinct, coalesce(list_max(list_transform(t, lambda x: length(x))), 0) as longest from t",
    "open_questions": r"""
with q as (select doc_id, unnest(regexp_extract_all(text, '[^.!?
]*\?')) as question from documents), k as (select doc_id, left(trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g')), 240) as key from q)
select key, min(doc_id) as first_doc, count(*) as n from k where length(key) >= 8 group by 1""",
    "manifest_inventory": f"""
with m as (select *, lower(split_part(relative_path, '/', -1)) as f from manifest_files)
select {_KIND_SQL} as kind, {_COMPONENT_SQL} as component, count(*) as n_files, sum(n_bytes)::bigint as n_bytes from m group by 1, 2""",
    "cleaned_tables": rf"""
with {_TABLES_SQL}, n as (select *, list_transform(header, lambda c: regexp_replace(lower(c), '[^a-z0-9]+', '', 'g')) as nh from tabs),
m as (select *, list_transform(rows, lambda r: struct_pack(r := r, rep := list_transform(r, lambda c: regexp_replace(lower(c), '[^a-z0-9]+', '', 'g')) = nh, f := coalesce(list_filter(r, lambda c: c <> '')[1], ''), k := len(list_filter(r, lambda c: c <> '')))) as x from n),
t as (select *, list_transform(x, lambda y: struct_pack(r := y.r, rep := y.rep, tot := not y.rep and regexp_matches(y.f, '{_RE(tables._TOTAL)}'), note := y.k = 1 and len(regexp_split_to_array(y.f, '\s+')) >= 4 and try_cast(regexp_replace(replace(trim(y.f), ',', ''), '%$', '') as double) is null)) as z from m),
b as (select doc_id, table_no, z, list_filter(z, lambda y: not y.rep and not y.tot) as body from t),
l as (select *, coalesce(list_max(list_transform(range(1, len(body) + 1), lambda i: case when body[i].note then 0 else i end)), 0) as last from b)
select doc_id, table_no, array_to_string(list_transform(body[1:last], lambda y: array_to_string(y.r, '|')), chr(10)) as rows, len(list_filter(z, lambda y: y.tot)) as n_totals, len(list_filter(z, lambda y: y.rep)) as n_repeats, len(body) - last as n_notes from l""",
    "segments": r"""
with m as (select doc_id, 'P' || regexp_replace(chr(10) || text || chr(10), '\n((?:[ \t]*\|[^\n]*\n)+)', chr(10) || chr(1) || 'T\1' || chr(1) || 'P' || chr(10), 'g') as t from documents where text is not null),
s as (select doc_id, list_filter(list_transform(string_split(t, chr(1)), lambda p: struct_pack(kind := case when p[1] = 'T' then 'table' else 'prose' end, body := regexp_replace(p[2:], '^\s+|\s+$', '', 'g'))), lambda p: p.body <> '') as p from m)
select doc_id, generate_subscripts(p, 1) - 1 as segment_no, (unnest(p)).kind as kind, length((unnest(p)).body) as n_chars from s""",
    "gap_signals": "with f as ("
    + " union all ".join(f"select doc_id, '{a}' as signal from documents where regexp_matches(lower(text), '{p}')" for a, p in extraction.GAP_SIGNALS.items())
    + ") select signal, count(*) as n_documents, min(doc_id) as first_doc from f group by 1",
    "thin_documents": r"""
with d as (select assessment_id, length(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) as size from documents)
select assessment_id, count(*) as n, count(*) filter (size < 40) as n_thin, sum(size)::bigint as chars from d group by 1""",
    "top_nodes": f"with {_SUPPLY}, links as materialized (select src, dst, count(*) over (partition by src) as degree from both_ways), {_pagerank_sql(130)} select node, round(rank * 1000, 4) as rank from r130 order by 2 desc, 1 limit 5",
    "keyword_search": r"""
with n as (select distinct lower(trim(value)) as query_id from claims where lower(attribute) = 'name' and value is not null),
q as (select query_id, list_distinct(list_filter(regexp_split_to_array(query_id, '\s+'), lambda w: length(w) > 2)) as words from n),
s as (select query_id, doc_id, len(list_filter(words, lambda w: contains(lower(text), w))) as score from q, documents where text is not null),
r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as place from s where score > 0)
select query_id, doc_id, score, place from r where place <= 8""",
    "labelled_rows": rf"""
with {_TABLES_SQL}, r as (select doc_id, table_no, header, unnest(rows) as row, generate_subscripts(rows, 1) - 1 as row_no from tabs)
select doc_id, table_no, row_no, left(array_to_string(list_filter(list_transform(range(1, len(header) + 1), lambda i: case when row[i] <> '' then header[i] || ': ' || row[i] end), lambda x: x is not null), ' · '), 280) as said
from r where len(row) = len(header)""",
    "attribute_answers": """
with c as (select distinct on (claim_id) *, replace(replace(lower(attribute), ' ', '_'), '-', '_') as a, lower(trim(value)) as said, case when confidence is null or isnan(confidence) then 0.0 else confidence end as conf
  from claims where trim(coalesce(value, '')) <> ''),
v as (select assessment_id, a, said, count(*) as n from c group by 1, 2, 3)
select assessment_id, a as attribute, count(*) as n_claims, round(cast(sum(cast(conf as decimal(18,6))) as double) / count(*), 6) as confidence, bool_and(not unsupported) as supported, bool_or(needs_human_review) as review,
  sum(len(evidence_refs))::bigint as n_refs, (select arg_max(v.said, (v.n, v.said)) from v where v.assessment_id = c.assessment_id and v.a = c.a) as most_said from c group by 1, 2""",
    "host_coverage": rf"""
with x as (select assessment_id, lower(regexp_extract(raw_line, '^"?([A-Za-z0-9][A-Za-z0-9.-]*)"?[,;\t]', 1)) as h from inventory_lines where line_no > 1),
a as (select distinct assessment_id, {_sql_host("h")} as host, true as e from x where h <> ''), b as (select distinct assessment_id, {_sql_host("entity_key")} as host, true as f from claims where entity_type = 'server'),
c as (select assessment_id, count(*) filter (e and f) as n_both, count(*) filter (f is null) as n_missing, count(*) filter (e is null) as n_unexpected from a full join b using (assessment_id, host) group by 1)
select *, round(case when n_both + n_missing = 0 then 1.0 else n_both / (n_both + n_missing) end, 4) as recall from c""",
    "conflict_members": rf"""
with {_KEYED}, p as (select document_id, max(precedence) as precedence from source_documents group by 1),
j as (select k.*, coalesce(p.precedence, 50) as prec from k left join p on source_document_id = document_id where value is not null),
g as (select assessment_id, entity_type, ekey, field, arg_max(claim_id, (prec, conf, -ord)) as selected_claim_id from j group by 1, 2, 3, 4 having count(distinct compared) > 1)
select claim_id, compared, selected_claim_id, claim_id = selected_claim_id as selected from j join g using (assessment_id, entity_type, ekey, field)""",
    "duplicate_texts": "select sha256(text) as hash, min(doc_id) as first_doc, count(*) as n, (sum(length(text)) - max(length(text)))::bigint as saved_chars from documents where text is not null group by 1 having count(*) > 1",
    "ingestion_lag": """
with f as (select claim_id, min(ingested_at) as seen, min(extracted_at) as made, min(assessment_id) as assessment_id from claims group by 1),
l as (select *, greatest(0, trunc(epoch(seen - made))::bigint) as lag from f)
select assessment_id, strftime(made, '%Y-%m') as month, count(*) as n, min(lag) as least, max(lag) as most, sum(lag)::bigint as total from l group by 1, 2""",
    "sanitised_claims": """
select distinct on (claim_id) claim_id, entity_type, left(entity_key, 120) as entity_key, left(attribute, 80) as attribute, left(value, 500) as value, left(evidence_quote, 500) as quote,
  least(greatest(case when confidence is null or isnan(confidence) then 0.0 else confidence end, 0.0), 1.0) as confidence from claims""",
    "preferred_documents": """
with o as (select document_id, min(assessment_id) as assessment_id from source_documents group by 1), c as (select source_document_id as document_id, min(assessment_id) as assessment_id from claims where source_document_id is not null group by 1)
select document_id, 0 as source, assessment_id from o union all select document_id, 1, assessment_id from c where document_id not in (select document_id from o)""",
    "overflow_probe": "select doc_id, row_number() over (order by n_chars desc, doc_id) as place, (select count(*) from documents) > 200 as more from documents qualify place <= 200",
    "recent_entries": "select user_id, row_number() over (partition by user_id order by ts desc, event_id desc) as place, event_id, event_type from events qualify place <= 3",
    "named_entities": r"""
with q as (select doc_id, unnest(regexp_extract_all(text, '[^.!?\n]*\?')) as question from documents), k as (select left(trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g')), 240) as key from q),
o as (select key, count(*) as n from k where length(key) >= 8 group by 1),
m as (select trim(regexp_replace(lower(value), '[^a-z0-9]+', ' ', 'g')) as name, count(distinct claim_id) as n_claims from claims where lower(attribute) = 'name' and value is not null group by 1)
select name, count(*) as n_questions, sum(n)::bigint as n_asked, max(n_claims) as n_claims from o join m on contains(' ' || key || ' ', ' ' || name || ' ') where length(name) >= 4 group by 1""",
    "plain_documents": r"""
with p as (select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^```.*$', '', 'g'),
  '(?m)^\s*\|?[\s|:-]*-[\s|:-]*\|?\s*$', '', 'g'), '(?m)^#{1,6}\s+', '', 'g'), '(?m)^\s*[-*+]\s+', '', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '`([^`]*)`', '\1', 'g'), '\*\*([^*]+)\*\*', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) as t
  from documents where text is not null)
select doc_id, md5(t) as plain, length(t) as n_chars from p""",
    "event_windows_stream": "select time_bucket(interval 1 hour, ts) as started, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2",
    "latest_claims_stream": "select claim_id, arg_min(ord, ingested_at) as ord, arg_min(attribute, ingested_at) as attribute, arg_min(struct_pack(v := value), ingested_at).v as value from claims group by 1",
}


ORACLES: dict[str, str] = {
    "canonical_headers": rf"""
with r as (select unnest(json_keys(payload)) as raw from server_inventory), n as (select raw, count(*) as n from r group by 1)
select raw, n, {_case(I.inverted(I.COLUMN_ALIASES), _sql_snake("raw"), _sql_snake("raw"))} as field, coalesce(regexp_extract(lower(raw), '\b(mb|mib|gb|gib|tb|tib|kb|pb|pib)\b', 1), '') as unit,
       {_case(_ATTRIBUTE, _sql_snake("raw"), _sql_snake("raw"))} as attribute from n""",
    "measured_values": rf"with {_KEYED} select claim_id, field, round(x, 4) as canonical, coalesce(case field {_BOUND} end, true) as plausible from k where field in ({_MEASURED})",
    "host_keys": rf"select {_sql_host('entity_key')} as host, count(distinct claim_id) as n_claims from claims where entity_type = 'server' group by 1",
    "column_variants": rf"""
with r as (select {_sql_slug("raw")} as key, count(*) as usage from (select unnest(json_keys(payload)) as raw from server_inventory) group by 1),
g as (select *, replace(key, '-', '') as compact, first_value(key) over (partition by replace(key, '-', '') order by usage desc, length(key) desc, key desc) as canonical from r)
select 'column' as kind, key as variant, canonical, usage from g where key <> canonical""",
    "claims_deduplicated": rf"""
with {_KEYED}
select assessment_id, entity_type, ekey as entity_key, field as attribute, compared, arg_max(claim_id, (conf, -ord)) as claim_id, max(conf) as confidence, min(ord) as ord, count(*) as n_claims
from k where value is not null group by all""",
    "claim_conflicts": rf"""
with {_KEYED}, p as (select document_id, max(precedence) as precedence from source_documents group by 1),
j as (select k.*, coalesce(p.precedence, 50) as prec from k left join p on source_document_id = document_id where value is not null)
select assessment_id, entity_type, ekey as entity_key, field as attribute, count(distinct compared) as n_values, count(*) as n_claims, arg_max(claim_id, (prec, conf, -ord)) as selected_claim_id,
       arg_max(compared, (prec, conf, -ord)) as selected_value from j group by all having count(distinct compared) > 1""",
    "entities": rf"""
with {_KEYED}, s as (select *, case when trim(coalesce(override_value, '')) = '' then value else override_value end as said from k where is_selected and value is not null)
select assessment_id, entity_type, ekey as entity_key, coalesce(trim(arg_max(said, ord) filter (field = 'name')), ekey) as name, round(avg(conf), 6) as confidence, count(distinct field) as n_attributes, count(*) as n_claims
from s group by 1, 2, 3""",
    "values_in_order": "select replace(replace(lower(attribute), ' ', '_'), '-', '_') as attribute, trim(value) as value, min(ord) as first_ord, count(distinct claim_id) as n from claims where value is not null group by 1, 2",
    "usage_rollup": """
select strftime(ts, '%Y-%m-%d') as run, event_type as stage, count(*) as calls, cast(sum(cast(value as decimal(18,2))) as double) as total, bool_or(event_type = 'error') as has_error
from events group by grouping sets ((run), (stage), ())""",
    "usage_counters": "select strftime(ts, '%Y-%m') as run, event_type as stage, user_id, cast(json_extract_string(props, '$.k') as int) as k, count(*) as calls, round(sum(value), 2) as total from events group by all",
    "assessment_reports": """
with c as (select distinct on (claim_id) *, replace(replace(lower(attribute), ' ', '_'), '-', '_') as a from claims),
p as (select assessment_id, entity_type, a, count(*) as n, count(*) filter (is_selected) as s from c group by 1, 2, 3),
t as (select assessment_id, entity_type, sum(n)::bigint as n, list(struct_pack(attribute := a, n := n, selected := s) order by a) as attributes from p group by 1, 2)
select assessment_id, to_json(struct_pack(n_claims := sum(n)::bigint, types := list(struct_pack(entity_type := entity_type, n := n, attributes := attributes) order by entity_type)))::varchar as report from t group by 1""",
    "report_metrics": """
with c as (select distinct on (claim_id) * from claims), x as (select *, len(evidence_refs) > 0 and trim(coalesce(evidence_quote, '')) <> '' as cited from c)
select assessment_id, count(*) as n_claims, count(*) filter (cited) as n_cited, round(count(*) filter (cited) * 100.0 / count(*), 1) as cited_pct, count(*) filter (unsupported) as n_unsupported,
       count(distinct lower(entity_type || '|' || trim(entity_key))) as n_entities from x group by 1""",
    "review_queue": """
with c as (select distinct on (claim_id) * from claims), x as (select *, needs_human_review and review_status = 'pending' as open from c)
select assessment_id, count(*) filter (open) as n_open, count(*) filter (review_status in ('accepted', 'overridden')) as n_settled, count(*) filter (review_status = 'rejected') as n_rejected,
       count(*) filter (trim(coalesce(override_value, '')) <> '') as n_overrides, count(*) filter (open) = 0 as clear from x group by 1""",
    "state_fingerprint": "select assessment_id, concat_ws('|', count(*), max(ord), strftime(max(ingested_at), '%Y-%m-%d %H:%M:%S')) as fingerprint from claims group by 1",
    "missing_attributes": """
with h as (select distinct assessment_id, entity_type, replace(replace(lower(attribute), ' ', '_'), '-', '_') as attribute from claims)
select p.assessment_id, p.entity_type, u.attribute from (select distinct assessment_id, entity_type from h) p join (select distinct entity_type, attribute from h) u using (entity_type)
except select assessment_id, entity_type, attribute from h""",
    "latest_decisions": "select user_id, event_type, arg_max(event_id, (ts, event_id)) as event_id, arg_max(value, (ts, event_id)) as value, count(*) as n_entries from events group by 1, 2",
    "user_sessions": """
with m as (select *, case when ts - lag(ts) over w < interval 2 hours then 0 else 1 end as starts from events window w as (partition by user_id order by ts)),
s as (select *, sum(starts) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from m)
select user_id, min(ts) as started, max(ts) + interval 2 hours as ended, count(*) as n_events, round(sum(value), 2) as total from s group by user_id, session""",
    "last_view_before_purchase": """
select b.user_id, b.event_id, arg_max(v.event_id, (v.ts, v.event_id)) as view_id from events b join events v on b.user_id = v.user_id and v.event_type = 'view' and v.ts < b.ts
  where b.event_type = 'purchase' group by 1, 2""",
    "resolved_references": """
with c as (select distinct on (claim_id) * from claims), r as (select claim_id, unnest(evidence_refs) as chunk_id from c), d as (select distinct split_part(document_id, '-', 1) as ref, document_id, doc_type from source_documents)
select document_id, doc_type, count(*) as n_refs, count(distinct claim_id) as n_claims, count(distinct chunk_id) as n_chunks from r left join d on split_part(chunk_id, '-', 1) = ref group by 1, 2""",
    "source_of_claims": """
with c as (select distinct on (claim_id) * from claims), d as (select distinct split_part(document_id, '-', 1) as ref, document_id from source_documents),
x as (select claim_id, d.document_id, source_document_id, case when confidence is null or isnan(confidence) then 0.0 else confidence end as conf from c left join d on split_part(evidence_refs[1], '-', 1) = ref)
select claim_id, document_id, document_id is null as unsupported, case when document_id is null then least(conf, 0.4) else conf end as confidence, document_id = source_document_id as agrees from x""",
    "dangling_sources": "select distinct source_document_id as document_id, claim_id from claims where source_document_id is not null and source_document_id not in (select document_id from source_documents)",
    "grounded_values": r"""
with c as (select distinct on (claim_id) * from claims), x as (select replace(replace(lower(attribute), ' ', '_'), '-', '_') as attribute, regexp_replace(trim(lower(value)), '\s+', ' ', 'g') as raw,
  regexp_replace(trim(lower(regexp_replace(trim(value), '^\[[^\]]+\]\s*', ''))), '\s+', ' ', 'g') as bare, regexp_replace(trim(lower(evidence_quote)), '\s+', ' ', 'g') as hay from c where value is not null and evidence_quote is not null)
select attribute, count(*) as n, count(*) filter (len(list_filter([raw, raw[:40], right(raw, 40), bare, bare[:40], right(bare, 40)], lambda s: length(s) >= 6 and contains(hay, s))) > 0) as n_grounded from x group by 1""",
    "evidence_spans": r"""
with c as (select distinct on (claim_id) * from claims), r as (select claim_id, unnest(evidence_refs) as chunk_id from c)
select claim_id, min(try_cast(regexp_extract(chunk_id, '-c(\d+)$', 1) as int)) as first_chunk, max(try_cast(regexp_extract(chunk_id, '-c(\d+)$', 1) as int)) as last_chunk, count(distinct chunk_id) as n_chunks from r group by 1""",
    "facts_by_document_kind": """
select doc_type, count(distinct claim_id) as n_claims, count(distinct source_document_id) as n_documents from claims join source_documents on source_document_id = document_id where doc_type in ('inventory', 'code_snapshot', 'questionnaire') group by 1""",
    "ranked_documents": """
with p as (select assessment_id, source_document_id, count(distinct claim_id) as n from claims where source_document_id is not null group by 1, 2),
r as (select *, row_number() over (partition by assessment_id order by n desc, source_document_id desc) - 1 as place from p)
select r.assessment_id, place, document_id, doc_type from r join (select document_id, max(doc_type) as doc_type from source_documents group by 1) on document_id = source_document_id where place < 5""",
    "assessment_sets": """
with a as (select distinct assessment_id from source_documents), b as (select distinct assessment_id from server_inventory)
select assessment_id, 'both' as kind from (from a intersect from b) union all select assessment_id, 'documents only' from (from a except from b) union all select assessment_id, 'feeds only' from (from b except from a)""",
    "document_classes": r"""
with d as (select distinct document_id, doc_type, lower(filename) as f from source_documents),
k as (select document_id, doc_type, case when f like '%.zip' then 'code_snapshot' when regexp_matches(f, '\.(xlsx|xls|csv|json)$') or contains(f, 'inventory') or contains(f, 'cmdb') then 'inventory'
  when regexp_matches(f, 'requirement|nfr|brd|rfc|sla') then 'requirements' when contains(f, 'questionnaire') then 'questionnaire' when regexp_matches(f, 'runbook|sop') then 'runbook'
  when contains(f, 'architecture') or regexp_matches(f, '\.(pdf|docx|doc)$') then 'architecture' else 'unknown' end as kind from d)
select document_id, kind, case kind when 'inventory' then 100 when 'code_snapshot' then 90 when 'architecture' then 80 when 'requirements' then 70 when 'runbook' then 60 when 'questionnaire' then 40 else 50 end as rank, kind = doc_type as as_given from k""",
    "paragraphs_in_context": r"""
with p as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\n[ \t]*(?:\n[ \t]*)+', chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as p from documents where text is not null),
u as (select doc_id, p, len(p) as parts, unnest(p) as paragraph, generate_subscripts(p, 1) as part from p)
select doc_id, part, parts, paragraph, case when part > 1 then right(p[part - 1], 160) end as before, left(p[part + 1], 600) as after from u""",
    "char_windows": """
with w as (select doc_id, text, unnest(range(0, length(text), 1050)) as start_pos from documents where length(text) > 0)
select doc_id, start_pos // 1050 as window_no, start_pos, substring(text, start_pos + 1, 1200) as piece from w""",
    "sections": r"""
with s as (select doc_id, string_split(regexp_replace(text, '(^|\n)(#{1,6} )', '\1' || chr(1) || '\2', 'g'), chr(1)) as b from documents where text is not null),
u as (select doc_id, unnest(b) as body, generate_subscripts(b, 1) - 1 as i from s)
select doc_id, i - 1 as section_no, trim(regexp_extract(body, '^#{1,6} +([^\n]*)', 1)) as title, length(body) as body_chars from u where i > 0 or trim(body) <> ''""",
    "table_shapes": rf"""
with {_TABLES_SQL}, r as (select *, len(list_filter(rows, lambda r: len(r) <> len(header))) as n_ragged from tabs)
select doc_id, table_no, len(rows) as n_rows, len(header) as n_columns, n_ragged, n_ragged <= 0.1 * len(rows) as regular from r""",
    "table_summaries": rf"""
with {_CELLS_SQL}, x as (select *, try_cast(regexp_replace(replace(trim(value), ',', ''), '%$', '') as double) as x from u where field in ('vcpus', 'memory_gb', 'disk_gb', 'cpu_utilization_pct') and value <> '')
select doc_id, table_no, field, sum(x) as total, round(avg(x), 1) as mean, min(x) as least, max(x) as greatest, count(*) as n_values, any_value(len(tabs.rows)) as n_rows
from x join tabs using (doc_id, table_no) where x is not null group by 1, 2, 3""",
    "table_claims": rf"""
with {_CELLS_SQL}
select doc_id, table_no, row_no, {_sql_host("server")} as entity_key, field as attribute, value from u
where value <> '' and coalesce(server, '') <> '' and field in ({", ".join(f"'{f}'" for f in I.COLUMN_ALIASES if f != "server")})""",
    "filled_headers": rf"""
with {_TABLES_SQL}, u as (select doc_id, table_no, unnest(header) as h, generate_subscripts(header, 1) - 1 as col_no from tabs)
select doc_id, table_no, col_no, coalesce(last_value(nullif(h, '') ignore nulls) over (partition by doc_id, table_no order by col_no rows unbounded preceding), '') as label from u""",
    "detected_headers": r"""
with h as (select file_id, line_no, arg_min(raw_line, line_id) as raw from inventory_lines where line_no <= 11 group by 1, 2),
s as (select *, coalesce(nullif(regexp_extract(raw, '[,;\t]', 0), ''), ',') as sep from h),
c as (select file_id, line_no, list_transform(string_split(raw, sep), lambda x: trim(replace(replace(replace(x, '"', ''), chr(13), ''), chr(65279), ''))) as cells from s),
m as (select file_id, line_no, len(cells) as width, len(list_filter(cells, lambda x: x <> '')) as n_filled,
        len(list_filter(cells, lambda x: x <> '' and try_cast(regexp_replace(replace(x, ',', ''), '%$', '') as double) is not null)) as n_numbers from c)
select a.file_id, coalesce(min(a.line_no) filter (a.line_no <= 10 and a.n_filled >= 2 and a.n_numbers < 0.3 * a.n_filled and b.n_filled >= 2 and b.width = a.width), 1) as header_line
from m a left join m b on a.file_id = b.file_id and b.line_no = a.line_no + 1 group by 1""",
    **SEARCH_ORACLES,
}
