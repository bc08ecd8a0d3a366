"""Queries about facts, answers, manifests, small expressions and scans over the given tables, each with the SQL that checks it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from estateloom.functions import inventory as I
from estateloom.functions import snippets
from estateloom.functions.keys import attribute_key, host_slug
from estateloom.operators import answers, chunking, extraction, manifests, prose, questions, retrieval, tables
from estateloom.plans.estate_queries import _COMPONENT_SQL, _KEYED, _KIND_SQL, _RE, _every_hundredth, _sql_host, _sql_slug, _sql_snake, _case, over, over2
from estateloom.session import read_table, shared_folder
from estateloom.sources import files, sinks

Query = Callable[[SparkSession, str], DataFrame]


def _texts(s: SparkSession, d: str) -> DataFrame:
    """Documents that are no inventory, and what claims quote."""
    docs = read_table(s, d, "documents").where("coalesce(source, '') <> 'inventory_notes'").select(F.concat(F.lit("d"), "doc_id").alias("text_id"), "text")
    quotes = read_table(s, d, "claims").dropDuplicates(["claim_id"]).select(F.concat(F.lit("c"), "claim_id").alias("text_id"), F.col("evidence_quote").alias("text"))
    return docs.unionByName(quotes)


def _criticality(s: SparkSession, d: str) -> DataFrame:
    names = read_table(s, d, "claims").where("entity_type = 'application' and value is not null and lower(attribute) = 'name'").select(F.lower(F.trim("value")).alias("name"))
    keys = read_table(s, d, "claims").where("entity_type = 'application' and entity_key is not null").select(F.lower(F.trim("entity_key")).alias("name"))
    return prose.criticality(_texts(s, d), names.unionByName(keys).distinct())


def _positional(lines: DataFrame) -> DataFrame:
    return prose.positional_rows(prose.cells_of_lines(lines)).groupBy("kind", "subject", "attribute", "value").agg(F.count("*").alias("n"), F.round(F.min("confidence"), 2).alias("confidence"))


def _builds(manifest_files: DataFrame) -> DataFrame:
    return manifests.build_contexts(manifest_files).agg(F.count("*").alias("n_contexts"), F.count("component").alias("n_resolved"))


def _grounded_passages(documents: DataFrame) -> DataFrame:
    """Twelve candidates a question, questionnaires left out, the best six of the rest: a question is not its own evidence."""
    found = retrieval.bm25(documents, _every_hundredth(documents), 12).select("query_id", "doc_id", "place")
    kept = found.join(documents.where("source = 'questionnaire'").select("doc_id"), "doc_id", "left_anti")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    return kept.withColumn("place", place).where(F.col("place") <= 6).select("query_id", "doc_id", "place")


def _classes(documents: DataFrame) -> DataFrame:
    """How sure the class of a document is: by its name, by its text only, or not at all."""
    name = F.lower(F.coalesce("filename", F.lit("")))
    strong = name.rlike(r"\.(zip|xlsx|xls|csv|json|pdf|docx|doc)$|inventory|cmdb|requirement|nfr|brd|rfc|questionnaire|runbook|sop|architecture")
    said = F.lower(F.coalesce("text", F.lit(""))).rlike("rto|rpo|availability|latency|questionnaire|runbook|hostname|vcpu")
    return documents.groupBy(F.when(strong, 0.9).when(said, 0.6).otherwise(0.4).alias("confidence")).agg(F.count("*").alias("n"))


def _locators(claims: DataFrame) -> DataFrame:
    """Where quotes say that they stand: a path in brackets, a row, a sheet, else the number of the cited chunk as a page."""
    c = claims.dropDuplicates(["claim_id"])
    got = lambda p: F.nullif(F.regexp_extract("evidence_quote", p, 1), F.lit(""))
    row = got(r"\bRow ([0-9]+)\b")
    none = F.lit(None).cast("string")
    place = snippets.locator(got(r"^\[([^\]]+)\]"), F.lit(False), row, row, none, got(r"sheet ([A-Za-z0-9]+)"), none, F.lit("x"))
    return c.where(place.isNotNull()).select("claim_id", place.alias("place"))


def _complete(claims: DataFrame) -> DataFrame:
    c = claims.dropDuplicates(["claim_id"]).where("value is not null and evidence_quote is not null")
    return c.select("claim_id", snippets.complete_quote("evidence_quote", "value").alias("line"))


def _shown(documents: DataFrame) -> DataFrame:
    """Pieces as they are indexed and shown: a line of context, the text, fences kept whole."""
    p = chunking.paragraphs(documents)
    said = snippets.fenced(snippets.search_text(F.concat_ws(" ", F.lit("part"), "part", F.lit("of"), "parts"), F.col("paragraph")))
    return p.select("doc_id", "part", said.alias("said"))


def _question_terms(documents: DataFrame) -> DataFrame:
    q = extraction.open_questions(documents)
    return q.select("key", F.size(snippets.question_tokens("key")).alias("n_tokens"), F.size(questions.terms(F.col("key"))).alias("n_terms"))


def _payload(inventory: DataFrame) -> DataFrame:
    """Feeds as JSON: fields, rows that have a column of cores, and a nested value with its default."""
    keys = F.coalesce(F.json_object_keys("payload"), F.array().cast("array<string>"))
    cores = F.exists(keys, lambda k: F.lower(k).isin("vcpu", "cores", "cpus"))
    return inventory.groupBy("feed_id", "file_seq").agg(F.max(F.size(keys)).alias("most_fields"), F.count_if(cores).alias("n_with_cores"), F.count_if(F.coalesce(F.get_json_object("payload", "$.meta.source"), F.lit("feed")) == "feed").alias("n_default"))


def _payload_claims(inventory: DataFrame) -> DataFrame:
    """Records of a typed source to claims: supported fields of a record with a host, under their canonical names."""
    cells = F.transform(F.map_entries(F.from_json("payload", "map<string,string>")), lambda e: F.struct(I.canonical_header(e["key"]).alias("field"), e["value"].alias("value")))
    rows = inventory.select("record_id", cells.alias("cells")).withColumn("server", F.get(F.filter("cells", lambda c: c["field"] == "server"), F.lit(0))["value"])
    supported = [f for f in I.COLUMN_ALIASES if f != "server"]
    claims = rows.where("coalesce(server, '') <> ''").select("record_id", host_slug("server").alias("entity_key"), F.inline("cells")).where(F.col("field").isin(*supported) & (F.coalesce("value", F.lit("")) != ""))
    return claims.groupBy("entity_key", F.col("field").alias("attribute")).agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))


def _generic(claims: DataFrame) -> DataFrame:
    key = I.canonical_entity_key(F.col("entity_type"), F.col("entity_key"))
    return claims.dropDuplicates(["claim_id"]).groupBy("entity_type").agg(F.count("*").alias("n"), F.count_if(I.is_generic_key(F.col("entity_type"), key)).alias("n_generic"))


def _confidences(claims: DataFrame) -> DataFrame:
    """Confidences clamped to 0 and 1, rounded to two places, and in steps of a tenth rounded up."""
    x = F.least(F.greatest(F.coalesce(F.nanvl("confidence", F.lit(None).cast("double")), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return claims.dropDuplicates(["claim_id"]).groupBy(F.round(x, 2).alias("confidence")).agg(F.count("*").alias("n"), F.max(F.ceil(F.round(x * 100, 4) / 10)).cast("int").alias("tenths"))


def _harmless(claims: DataFrame) -> DataFrame:
    return claims.where("value is not null").select("value", sinks.harmless_cell("value").alias("cell")).distinct()


def _scratch(s: SparkSession) -> str:
    return f"{shared_folder(s)}/scan-{uuid.uuid4()}"


def _delimited(s: SparkSession, d: str) -> DataFrame:
    """Documents written as delimited text and read back with their types."""
    path, schema = _scratch(s), "document_id string, filename string, doc_type string, precedence int"
    read_table(s, d, "source_documents").select("document_id", "filename", "doc_type", "precedence").write.option("header", True).option("escape", '"').csv(path)
    return files.read_delimited(s, path, schema).groupBy("doc_type").agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("n_documents"), F.sum("precedence").alias("precedence"), F.count("_gap").alias("n_gaps"))


def _records(s: SparkSession, d: str) -> DataFrame:
    """Payloads of feeds written as lines of JSON, with lines that are none, and read back."""
    path = _scratch(s)
    rows = read_table(s, d, "server_inventory").select("payload").unionByName(read_table(s, d, "documents").where("text is not null").select(F.concat(F.lit("{no json: "), "doc_id").alias("payload")))
    rows.write.text(path)
    return files.read_records(s, path, "Hostname string, Cores string, vcpu string").agg(F.count("*").alias("n"), F.count("Hostname").alias("n_hostname"), F.count("Cores").alias("n_cores"), F.count("_gap").alias("n_gaps"))


def _text_files(s: SparkSession, d: str) -> DataFrame:
    """Files of each source joined to one text a folder, read whole, and cut into tables and headings again."""
    path = _scratch(s)
    docs = read_table(s, d, "documents").where("text is not null")
    docs.select(F.coalesce("source", F.lit("none")).alias("source"), F.regexp_replace("text", "\r", "").alias("value")).write.partitionBy("source").text(path)
    back = files.read_texts(s, path).select(F.regexp_extract("path", "source=([^/]+)", 1).alias("source"), "text")
    return back.groupBy("source").agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"(^|\n)#{1,6} "), F.lit(0)))).alias("n_headings"))


def _dispatch(s: SparkSession, d: str) -> DataFrame:
    """One file of each kind, written by Spark, and the reader that each is due to."""
    path = _scratch(s)
    docs = read_table(s, d, "source_documents").select("document_id", "doc_type").distinct()
    docs.coalesce(1).write.csv(f"{path}/a")
    docs.coalesce(1).write.json(f"{path}/b")
    docs.select("document_id").coalesce(1).write.text(f"{path}/c")
    return files.dispatched(s, path).where("n_bytes > 0 and path not like '%SUCCESS%'").groupBy("format").agg(F.count("*").alias("n"))


def _written_answers(s: SparkSession, d: str) -> DataFrame:
    """Answers written as delimited text that no spreadsheet runs, and read back."""
    path = _scratch(s)
    sinks.write_answers(answers.standard_answers(read_table(s, d, "claims")).select("assessment_id", "question", "n_facts"), path)
    return files.read_delimited(s, path, "assessment_id string, question string, n_facts bigint").select("assessment_id", "question", "n_facts")


def _replaced(s: SparkSession, d: str) -> DataFrame:
    """Facts per assessment written, then one assessment written anew: only its partition is replaced."""
    path = _scratch(s)
    counts = read_table(s, d, "claims").groupBy("assessment_id").agg(F.count("*").alias("n"))
    sinks.overwrite_partitions(counts, path, ["assessment_id"])
    least = counts.agg(F.min("assessment_id").alias("assessment_id"))  # one row
    sinks.overwrite_partitions(counts.join(F.broadcast(least), "assessment_id").withColumn("n", -F.col("n")), path, ["assessment_id"])
    return s.read.schema("n bigint, assessment_id string").parquet(path).select("assessment_id", "n")


def _gated(documents: DataFrame) -> DataFrame:
    """Extractors that have anything to read: assessments with a document of a kind the extractor is made for (a semi join)."""
    gates = [(k, t) for k, kinds in _GATES.items() for t in kinds]
    wanted = documents.sparkSession.createDataFrame(gates, "extractor string, doc_type string")
    at = documents.select("assessment_id").distinct().select("assessment_id", F.explode(F.array(*(F.lit(k) for k in _GATES))).alias("extractor"))
    have = documents.select("assessment_id", "doc_type").distinct().join(F.broadcast(wanted), "doc_type").select("assessment_id", "extractor")
    return at.join(have, ["assessment_id", "extractor"], "left_semi")


#: kinds of documents that each extractor reads
_GATES = {"servers": ["inventory"], "requirements": ["requirements", "architecture"], "questions": ["questionnaire"], "code": ["code_snapshot"]}


QUERIES: dict[str, Query] = {
    "labelled_statements": lambda s, d: prose.statements(_texts(s, d)),
    "named_criticality": _criticality,
    "positional_rows": over("inventory_lines", _positional),
    "empty_kinds": over("claims", prose.empty_kinds),
    "manifest_dependencies": over("manifest_files", manifests.dependencies),
    "file_owners": over("manifest_files", manifests.owners),
    "build_contexts": over("manifest_files", _builds),
    "quotes_in_files": over2("claims", "manifest_files", manifests.quotes_in_files),
    "standard_answers": over("claims", answers.standard_answers),
    "requirement_counts": over("claims", answers.requirement_counts),
    "matched_claims": over2("documents", "claims", answers.matched_claims),
    "matched_links": over("documents", answers.matched_links),
    "answer_evidence": over("claims", answers.answer_evidence),
    "planned_questions": over2("claims", "source_documents", answers.planned_questions),
    "questionnaire_items": over("documents", answers.questionnaire_items),
    "replayed_decisions": over("claims", answers.replayed_decisions),
    "blocked_inputs": over("documents", answers.blocked_inputs),
    "grounded_passages": over("documents", _grounded_passages),
    "class_confidence": over("documents", _classes),
    "evidence_locators": over("claims", _locators),
    "complete_quotes": over("claims", _complete),
    "shown_pieces": over("documents", _shown),
    "question_terms": over("documents", _question_terms),
    "payload_fields": over("server_inventory", _payload),
    "payload_claims": over("server_inventory", _payload_claims),
    "generic_keys": over("claims", _generic),
    "confidence_steps": over("claims", _confidences),
    "harmless_cells": over("claims", _harmless),
    "delimited_scan": _delimited,
    "record_scan": _records,
    "text_scan": _text_files,
    "dispatched_files": _dispatch,
    "rows_beyond_cap": over("inventory_lines", lambda x: files.gaps_beyond(x, "file_id", "line_no", 20)),
    "written_answers": _written_answers,
    "replaced_partitions": _replaced,
    "gated_extractors": over("source_documents", _gated),
    "question_chunks": over("documents", chunking.question_chunks),
    "manifest_chunks": over("manifest_files", chunking.manifest_chunks),
    "routed_chunks": over("documents", lambda docs: chunking.routed_chunks(docs, lambda x: tables.table_chunks(tables.pipe_tables(x)).select("doc_id", "part", "n_rows"))),
}

_SELECTED = r"""c as (select distinct on (claim_id) *, replace(replace(lower(attribute), ' ', '_'), '-', '_') as a, case when trim(coalesce(override_value, '')) = '' then value else override_value end as said,
  case when confidence is null or isnan(confidence) then 0.0 else confidence end as conf from claims where is_selected)"""
_Q_SQL = r"""q0 as (select unnest(regexp_extract_all(text, '[^.!?\n]*\?')) as question from documents),
q as (select distinct ' ' || key || ' ' as key from (select left(trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g')), 240) as key from q0) where length(key) >= 8)"""
_WORDS = lambda x: rf"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
_TEXTS_SQL = "t as (select 'd' || doc_id as text_id, text from documents where coalesce(source, '') <> 'inventory_notes' union all (select distinct on (claim_id) 'c' || claim_id, evidence_quote from claims))"


def _clean_sql(x: str) -> str:
    edge = lambda y: rf"regexp_replace({y}, '^[ .|:,;-]+|[ .|:,;-]+$', '', 'g')"
    cut = edge(rf"regexp_extract({edge(x)}, '^(.*?)(?:\s+[—–-]\s+|\s+for\s+|\s+and\s+|\s+that\s+|$)', 1, 's')")
    return rf"(case when length({cut}) >= 2 and len(regexp_split_to_array({cut}, '\s+')) <= 4 and lower({cut}) not in ({', '.join(f"'{w}'" for w in prose.STOPWORDS)}) then {cut} end)"


def _statements_sql() -> str:
    parts = []
    for kind, pattern in prose.STATEMENTS.items():
        p = _RE(("" if kind in ("depends_on", "calls", "integrates_with", "uses", "hosted_on") else "(?i)") + pattern)
        subject = _sql_host("a") if kind in ("server", "runs") else _sql_slug(_clean_sql("a"))
        said = _sql_slug(_clean_sql("b")) if kind in ("depends_on", "calls", "integrates_with", "uses") else _sql_host("b") if kind == "hosted_on" else "trim(coalesce(b, ''))"
        parts.append(f"select text_id, '{kind}' as kind, {subject} as subject, {said} as object from (select text_id, unnest(regexp_extract_all(text, '{p}', 1)) as a, unnest(regexp_extract_all(text, '{p}', 2)) as b from t)")
    return f"with {_TEXTS_SQL}, f as ({' union all '.join(parts)}) select kind, subject, object, count(distinct text_id) as n_texts, count(*) as n from f where subject <> '' and object is not null group by 1, 2, 3"


def _dependencies_sql() -> str:
    parts = [f"select file_id, component, kind, '{source}' as source, unnest(regexp_extract_all(text, '{_RE(p)}', 1)) as name, coalesce(unnest(regexp_extract_all(text, '{_RE(p)}', 2)), '') as version from m where kind = '{kind}'" for kind, source, p in manifests.FORMS]
    parts.append(
        rf"""select file_id, component, kind, 'system', regexp_extract(p, '^[a-z0-9.+:-]+', 0), regexp_extract(p, '=(.*)$', 1)
        from (select file_id, component, kind, unnest(regexp_split_to_array(trim(l), '[ \t]+')) as p from (select file_id, component, kind, unnest(regexp_extract_all(text, '{_RE(manifests.APT)}', 1)) as l from m where kind in ('docker', 'shell'))) where regexp_matches(p, '^[a-z0-9]')"""
    )
    inside = " ".join(f"when contains(lower(name), '{k}') then '{v}'" for k, v in manifests.INFRASTRUCTURE.items())
    return f"""with m as (select file_id, text, {_COMPONENT_SQL} as component, {_KIND_SQL} as kind from (select *, lower(split_part(relative_path, '/', -1)) as f from manifest_files) where text is not null), x as ({' union all '.join(parts)})
    select component, kind, source, name, version, count(distinct file_id) as n_files, case when source <> 'package' then '' else coalesce({_case(manifests.INFRASTRUCTURE, 'lower(name)', 'null')}, case {inside} end, '') end as infrastructure from x group by 1, 2, 3, 4, 5"""


_STANDARD_SQL = " union all ".join(
    f"select *, '{q}' as question from c where a in ({', '.join(f"'{x}'" for x in a)})" + (f" and entity_type in ({', '.join(f"'{x}'" for x in t)})" if t else "") for q, a, t in answers.STANDARD
)
_LINES_SQL = r"""x as (select line_id, file_kind, raw_line, case when regexp_extract(raw_line, '[,;\t]', 0) = '' then ',' else regexp_extract(raw_line, '[,;\t]', 0) end as sep from inventory_lines where line_no > 1 and raw_line is not null),
y as (select line_id, file_kind = 'fleet-inventory' as inventory, list_transform(string_split(raw_line, sep), lambda c: trim(regexp_replace(trim(c), '^"|["\r]+$', '', 'g'))) as cells from x)"""

ORACLES: dict[str, str] = {
    "labelled_statements": _statements_sql(),
    "named_criticality": rf"""
with {_TEXTS_SQL}, n as (select distinct name from (select lower(trim(value)) as name from claims where entity_type = 'application' and value is not null and lower(attribute) = 'name' union all select lower(trim(entity_key)) from claims where entity_type = 'application') where regexp_extract(name, '[a-z0-9]+', 0) <> ''),
p as (select text_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) as p from t where contains(lower(text), 'critical')),
u as (select text_id, lower(unnest(p)) as low, generate_subscripts(p, 1) - 1 as pos from p), h as (select name, text_id, pos, low from n join u on contains(low, 'critical') and contains(low, name) and list_contains(regexp_split_to_array(low, '[^a-z0-9]+'), regexp_extract(name, '[a-z0-9]+', 0))),
f as (select name, arg_min(low, (text_id, pos)) as low, arg_min(text_id, (text_id, pos)) as text_id from h group by 1)
select name, case when regexp_extract(low, '\b(high|medium|low)\b', 1) <> '' then regexp_extract(low, '\b(high|medium|low)\b', 1) else 'high' end as level, case when regexp_extract(low, '\b(high|medium|low)\b', 1) <> '' then 0.75::double else 0.6::double end as confidence, text_id from f""",
    "positional_rows": rf"""
with {_LINES_SQL}, z as (select *, regexp_matches(lower(cells[1]), '^[a-z][a-z0-9]*(-[a-z0-9]+)+(\.[a-z0-9-]+)*$') as host, contains(lower(array_to_string(cells, ' ')), 'legacy') as legacy from y),
f as (select 'server' as kind, {_sql_host("cells[1]")} as subject, 'os' as attribute, cells[2] as value, case when legacy then 0.55::double else 0.8::double end as confidence from z where host and regexp_matches(coalesce(cells[2], ''), '(?i){prose.OS_CELL}')
 union all select unnest(['application', 'application', 'application', 'application', 'server', 'database']), unnest([{_sql_slug("cells[1]")}, {_sql_slug("cells[1]")}, {_sql_slug("cells[1]")}, {_sql_slug("cells[1]")}, {_sql_host("cells[2]")}, {_sql_slug("cells[3]")}]),
   unnest(['name', 'hosted_on', 'uses', 'tier', 'os', 'name']), unnest([cells[1], {_sql_host("cells[2]")}, {_sql_slug("cells[3]")}, cells[4], cells[5], cells[3]]), case when inventory then 0.9::double else 0.75::double end from z where not host and len(cells) >= 5 and regexp_matches(cells[5], '(?i){prose.OS_CELL}'))
select kind, subject, attribute, value, count(*) as n, round(min(confidence), 2) as confidence from f where value <> '' and subject <> '' group by 1, 2, 3, 4""",
    "empty_kinds": "select assessment_id, kind from (select distinct assessment_id from claims), (select unnest(['application', 'server', 'database']) as kind) except select assessment_id, entity_type from claims",
    "manifest_dependencies": _dependencies_sql(),
    "file_owners": rf"""
with m as (select *, lower(split_part(relative_path, '/', -1)) as f, regexp_replace(relative_path, '/?[^/]*$', '') as dir from manifest_files where relative_path is not null),
k as (select *, {_KIND_SQL} as kind, {_COMPONENT_SQL} as fallback, case when dir = '' then [''] else string_split(dir, '/') end as parts from m),
n as (select assessment_id, dir, min(name) as name from (select assessment_id, dir, case kind when 'npm' then regexp_extract(text, '"name"\s*:\s*"([^"]+)"', 1) when 'maven' then regexp_extract(text, '<artifactId>\s*([^<\s]+)', 1) when 'csproj' then regexp_replace(split_part(relative_path, '/', -1), '(?i)\.csproj$', '') end as name from k where text is not null) where name <> '' group by 1, 2),
a as (select file_id, assessment_id, fallback, unnest(range(0, len(parts) + 1)) as depth, parts from k), j as (select a.file_id, a.fallback, a.depth, n.name from a left join n on a.assessment_id = n.assessment_id and array_to_string(parts[1:depth], '/') = n.dir)
select file_id, coalesce(arg_max(name, depth) filter (name is not null), min(fallback)) as owner, coalesce(max(depth) filter (name is not null), -1) as depth from j group by 1""",
    "build_contexts": rf"select count(*) as n_contexts, 0 as n_resolved from (select unnest(regexp_extract_all(text, '(?m)^[ \t]*(?:build|context):[ \t]*[\"'']?([A-Za-z0-9_./-]+)', 1)) as c from (select *, lower(split_part(relative_path, '/', -1)) as f from manifest_files) where {_KIND_SQL} = 'compose')",
    "quotes_in_files": r"""
with c as (select distinct on (claim_id) claim_id, assessment_id, replace(replace(lower(attribute), ' ', '_'), '-', '_') as attribute, regexp_extract(evidence_quote, '^\[([^\]]+)\]\s*', 1) as path, regexp_replace(trim(lower(regexp_replace(evidence_quote, '^\[[^\]]+\]\s*', ''))), '\s+', ' ', 'g') as quote from claims),
t as (select assessment_id, relative_path as path, arg_max(text, (length(text), file_id)) as text from manifest_files where text is not null group by 1, 2)
select attribute, count(*) as n, count(t.text) as n_with_file, count(*) filter (contains(regexp_replace(trim(lower(t.text)), '\s+', ' ', 'g'), quote)) as n_in_text from c left join t using (assessment_id, path) where path <> '' group by 1""",
    "standard_answers": f"""
with {_SELECTED}, f as ({_STANDARD_SQL}),
g as (select assessment_id, question, count(*) as n_facts, count(distinct (entity_type, entity_key)) as n_entities, round(cast(sum(cast(conf as decimal(18,6))) as double) / count(*), 2) as confidence, bool_and(len(evidence_refs) > 0 and not unsupported) as supported, bool_or(needs_human_review) as review from f group by 1, 2)
select assessment_id, question, coalesce(n_facts, 0) as n_facts, coalesce(n_entities, 0) as n_entities, coalesce(confidence, 0.0) as confidence, coalesce(supported, false) as supported, coalesce(review, false) as review
from (select distinct assessment_id from claims) cross join (select unnest([{", ".join(f"'{q}'" for q, _, _ in answers.STANDARD)}]) as question) left join g using (assessment_id, question)""",
    "requirement_counts": f"with {_SELECTED} select assessment_id, count(*) filter (a in ({', '.join(f"'{x}'" for x in answers.REQUIREMENT_ATTRIBUTES)}) or a like 'rto%' or entity_type = 'business') as n_requirements, count(*) as n_claims from c group by 1",
    "matched_claims": rf"""
with {_SELECTED}, {_Q_SQL}, nm as (select assessment_id, entity_type, entity_key, arg_max(said, (ord, said)) as name from c where a = 'name' and said is not null group by 1, 2, 3),
k as (select a, ' ' || {_WORDS("name")} || ' ' as name, count(*) as n from c left join nm using (assessment_id, entity_type, entity_key) group by 1, 2),
ba as (select distinct key, a from q, (select distinct a, ' ' || {_WORDS("replace(a, '_', ' ')")} || ' ' as spoken from k) where length(spoken) >= 4 and contains(key, spoken)),
bn as (select distinct key, name from q, (select distinct name from k where name is not null) where length(name) >= 4 and contains(key, name)),
t as (select key, 1 as tier, n from ba join bn using (key) join k using (a, name) union all select key, 2, n from ba join (select a, sum(n) as n from k group by 1) using (a) union all select key, 3, n from bn join (select name, sum(n) as n from k where name is not null group by 1) using (name)),
s as (select key, tier, sum(n)::bigint as n from t group by 1, 2)
select trim(key) as key, min(tier) as tier, arg_min(n, tier) as n_claims from s group by 1""",
    "matched_links": rf"""
with {_Q_SQL}, f as (select unnest(regexp_extract_all(text, '{extraction.RELATION}', 1)) as x, unnest(regexp_extract_all(text, '{extraction.RELATION}', 2)) as r, unnest(regexp_extract_all(text, '{extraction.RELATION}', 3)) as y from documents),
e as (select distinct {_sql_slug("x")} as source, case when contains(r, 'depend') then 'depends_on' else 'calls' end as relation, {_sql_slug("y")} as target from f)
select distinct trim(key) as key, source, relation, target from q join e on contains(key, ' ' || replace(source, '-', ' ') || ' ') or contains(key, ' ' || replace(target, '-', ' ') || ' ')
where len(list_filter([{", ".join(f"'{w}'" for w in answers.RELATION_WORDS)}], lambda w: contains(key, ' ' || w || ' '))) > 0""",
    "answer_evidence": rf"""
with {_SELECTED}, u as (select assessment_id, a as attribute, unnest(evidence_refs) as chunk_id, trim(evidence_quote, E' \t\n\r') as quote, ord from c where trim(coalesce(evidence_quote, ''), E' \t\n\r') <> ''),
o as (select assessment_id, attribute, chunk_id, quote, min(ord) as ord from u group by 1, 2, 3, 4)
select assessment_id, attribute, chunk_id, least(count(*), 4) as n_quotes, arg_min(quote, (ord, quote)) as first_quote from o group by 1, 2, 3""",
    "planned_questions": rf"""
with {_KEYED}, g as (select assessment_id from k where value is not null group by assessment_id, entity_type, ekey, field having count(distinct compared) > 1), {_SELECTED.replace("c as", "sel as")},
h as (select assessment_id, list_filter([{", ".join(f"'{x}'" for x in sorted(answers.REQUIREMENT_ATTRIBUTES))}], lambda x: not list_contains(list(distinct a), x)) as gaps from sel group by 1)
select assessment_id, 'conflicts' as kind, 'There are ' || count(*) || ' conflicting facts: who can confirm the right values?' as question from g group by 1
union all select assessment_id, 'gaps', 'Nothing was found on ' || array_to_string(gaps, ', ') || ': does it apply, and with which values?' from h where len(gaps) > 0""",
    "questionnaire_items": r"""
with d as (select doc_id, list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '^[\s#>*|-]*(?:[Qq]?[0-9]{1,3}[.):]\s*)?', ''))), lambda x: regexp_matches(x, '^[^?]{8,}\?')), lambda x: regexp_extract(x, '^[^?]+\?', 0)) as q from documents where source = 'questionnaire' and text is not null),
e as (select doc_id, list_filter(q, lambda x, i: list_position(q, x) = i) as q from d)
select doc_id, generate_subscripts(q, 1) - 1 as item_no, unnest(q) as question from e""",
    "replayed_decisions": """
with c as (select distinct on (claim_id) *, replace(replace(lower(attribute), ' ', '_'), '-', '_') as a, lower(trim(entity_key)) as k, lower(trim(value)) as said from claims where value is not null),
d as (select assessment_id, entity_type, k, a, said, arg_max(struct_pack(s := review_status, o := override_value), (extracted_at, claim_id)) as d from c where review_status in ('accepted', 'rejected', 'overridden') group by all)
select claim_id, d.s as status, d.o as override_value from c join d using (assessment_id, entity_type, k, a, said) where review_status = 'pending'""",
    "blocked_inputs": rf"""
with h as (select assessment_id, left(text, 2000) as t from documents qualify row_number() over (partition by assessment_id order by doc_id) <= 12),
s as (select assessment_id, count(*) filter (trim(coalesce(t, ''), E' \t\n\r') <> '') as n_read, count(*) filter (regexp_matches(t, '(?i){_RE("|".join(f"(?:{p})" for p in extraction.INJECTION))}')) as n_injected from h group by 1)
select *, n_read = 0 or n_injected > 0 as blocked from s""",
    "class_confidence": r"""
select case when regexp_matches(lower(coalesce(filename, '')), '\.(zip|xlsx|xls|csv|json|pdf|docx|doc)$|inventory|cmdb|requirement|nfr|brd|rfc|questionnaire|runbook|sop|architecture') then 0.9::double
  when regexp_matches(lower(coalesce(text, '')), 'rto|rpo|availability|latency|questionnaire|runbook|hostname|vcpu') then 0.6::double else 0.4::double end as confidence, count(*) as n from documents group by 1""",
    "evidence_locators": r"""
with c as (select distinct on (claim_id) claim_id, nullif(regexp_extract(evidence_quote, '^\[([^\]]+)\]', 1), '') as path, nullif(regexp_extract(evidence_quote, '\bRow ([0-9]+)\b', 1), '') as row, nullif(regexp_extract(evidence_quote, 'sheet ([A-Za-z0-9]+)', 1), '') as sheet from claims),
x as (select claim_id, coalesce(path, case when row is not null then coalesce('sheet "' || sheet || '", ', '') || 'row ' || row end, 'sheet "' || sheet || '"') as place from c) select * from x where place is not null""",
    "complete_quotes": r"""
with c as (select distinct on (claim_id) claim_id, value, evidence_quote from claims where value is not null and evidence_quote is not null),
l as (select claim_id, value, lower(trim(regexp_replace(value, '\s+', ' ', 'g'))) as needle, list_transform(string_split(evidence_quote, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) as lines from c)
select claim_id, case when needle = '' then value else coalesce(list_filter(lines, lambda x: contains(lower(x), needle) and length(x) <= 280 and not starts_with(x, '#'))[1], value) end as line from l""",
    "question_terms": rf"""
with q0 as (select unnest(regexp_extract_all(text, '[^.!?\n]*\?')) as question from documents), q as (select distinct key from (select left({_WORDS("question")}, 240) as key from q0) where length(key) >= 8)
select key, len(list_distinct(list_filter(regexp_extract_all(key, '[a-z0-9]+'), lambda w: length(w) > 2 and w not in ({", ".join(f"'{w}'" for w in snippets.STOP)})))) as n_tokens,
  len(list_distinct(list_filter(list_transform(regexp_extract_all(key, '[a-z0-9][a-z0-9.%-]*'), lambda w: regexp_replace(w, '[.-]+$', '')), lambda w: length(w) >= 2 and w not in ({", ".join(f"'{w}'" for w in questions.NOISE)})))) as n_terms from q""",
    "payload_fields": "select feed_id, file_seq, max(len(json_keys(payload))) as most_fields, count(*) filter (len(list_filter(json_keys(payload), lambda k: lower(k) in ('vcpu', 'cores', 'cpus'))) > 0) as n_with_cores, count(*) filter (coalesce(json_extract_string(payload, '$.meta.source'), 'feed') = 'feed') as n_default from server_inventory group by 1, 2",
    "payload_claims": rf"""
with r as (select record_id, payload, json_keys(payload) as ks from server_inventory), u as (select record_id, unnest(ks) as raw, generate_subscripts(ks, 1) as i, payload from r),
v as (select record_id, i, {_case(I.inverted(I.COLUMN_ALIASES), _sql_snake("raw"), _sql_snake("raw"))} as field, json_extract_string(payload, '$."' || raw || '"') as value from u),
s as (select record_id, arg_min(struct_pack(v := value), i).v as server from v where field = 'server' group by 1)
select {_sql_host("server")} as entity_key, field as attribute, count(*) as n, count(distinct value) as n_values from v join s using (record_id) where coalesce(server, '') <> '' and coalesce(value, '') <> '' and field in ({", ".join(f"'{f}'" for f in I.COLUMN_ALIASES if f != "server")}) group by 1, 2""",
    "generic_keys": rf"""
with {_KEYED} select entity_type, count(*) as n, count(*) filter (entity_type <> 'business' and (coalesce(ekey, '') in ('', {", ".join(f"'{g}'" for g in I.GENERIC_KEYS)}))) as n_generic from (select entity_type, case when entity_type <> 'server' and ekey = '' then 'unknown' when entity_type <> 'server' and ekey like 'the-_%' then ekey[5:] else ekey end as ekey from k0) group by 1""",
    "confidence_steps": "with c as (select distinct on (claim_id) least(greatest(case when confidence is null or isnan(confidence) then 0.0 else confidence end, 0.0), 1.0) as x from claims) select round(x, 2) as confidence, count(*) as n, max(ceil(round(x * 100, 4) / 10))::int as tenths from c group by 1",
    "harmless_cells": r"select distinct value, case when regexp_matches(value, '^[=+\-@\t\r]') then '''' || value else value end as cell from claims where value is not null",
    "delimited_scan": "select doc_type, count(*) as n, count(distinct document_id) as n_documents, sum(precedence)::bigint as precedence, 0 as n_gaps from source_documents group by 1",
    "record_scan": "select count(*) + (select count(*) from documents where text is not null) as n, count(json_extract_string(payload, '$.Hostname')) as n_hostname, count(json_extract_string(payload, '$.Cores')) as n_cores, (select count(*) from documents where text is not null) as n_gaps from server_inventory",
    "text_scan": r"select coalesce(source, 'none') as source, sum(len(regexp_extract_all(replace(text, chr(13), ''), '(^|\n)#{1,6} ')))::bigint as n_headings from documents where text is not null group by 1",
    "dispatched_files": "select unnest(['delimited', 'records', 'text']) as format, 1 as n from (select 1 from source_documents limit 1)",
    "rows_beyond_cap": "select file_id, count(*) as n_rows, count(*) filter (line_no > 20) as n_beyond from inventory_lines group by 1 having n_beyond > 0",
    "replaced_partitions": "select assessment_id, case when assessment_id = (select min(assessment_id) from claims) then -count(*) else count(*) end as n from claims group by 1",
    "gated_extractors": " union all ".join(f"select distinct assessment_id, '{k}' as extractor from source_documents where doc_type in ({', '.join(f"'{t}'" for t in kinds)})" for k, kinds in _GATES.items()),
    "question_chunks": r"""
with s as (select doc_id, string_split(regexp_replace(text, '(^|\n)([ \t]*[Qq][0-9]{0,3}[.:)])', '\1' || chr(1) || '\2', 'g'), chr(1)) as b from documents where text is not null), u as (select doc_id, unnest(b) as piece, generate_subscripts(b, 1) - 2 as qa_index from s)
select doc_id, qa_index, regexp_replace(piece, '^\s+|\s+$', '', 'g') as chunk from u where regexp_replace(piece, '^\s+|\s+$', '', 'g') <> ''""",
}
ORACLES["written_answers"] = f"select assessment_id, question, n_facts from ({ORACLES['standard_answers']})"
ORACLES["shown_pieces"] = r"""
with p as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\n[ \t]*(?:\n[ \t]*)+', chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as p from documents where text is not null),
u as (select doc_id, len(p) as parts, unnest(p) as x, generate_subscripts(p, 1) as part from p)
select doc_id, part, 'part ' || part || ' of ' || parts || chr(10) || chr(10) || regexp_replace(x, '(?i)<(/?\s*chunk)\b', '<' || chr(8203) || '\1', 'g') as said from u"""
