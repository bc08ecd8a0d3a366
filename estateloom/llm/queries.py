"""Queries of the training-data operators, by name, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from estateloom.llm import mixing, packing, pii, secrets, sentences, survivors
from estateloom.session import read_table

_P4 = ["assessment_id", "entity_type", "entity_key", "attribute", "value_claim_id", "quote_claim_id"]


def _survivors(s, d, **options):
    return survivors.survivors(read_table(s, d, "claims"), read_table(s, d, "source_documents"), **options)


def _personal_data(s, d):
    return pii.scanned(pii.texts_of(read_table(s, d, "claims"), read_table(s, d, "inventory_lines")), read_table(s, d, "name_lexicon"))


def _shares_of_all(s, d):
    """The mix at the size of the corpus, where small sources are clamped."""
    return mixing.shares(read_table(s, d, "documents"), read_table(s, d, "mix_targets"), of_all=True)


#: limits that bind: at most six texts a container, and half the attention cost of one full text
_BOUNDS = {"max_documents": 6, "max_attention": packing.CAPACITY**2 / 2}


def _bounded(s, d):
    return packing.packed(read_table(s, d, "documents"), rule="dot", weights=(1.0, 1.0, 1.0), **_BOUNDS)


def _repeats(s, d):
    """Per listed source: whether a text is used more often than allowed, and that each text comes once."""
    mix = mixing.mixed(read_table(s, d, "documents"), read_table(s, d, "mix_targets"), of_all=True)
    used = mix.groupBy("source").agg(F.max("repeats").alias("most"), (F.count("*") - F.countDistinct("doc_id")).alias("twice"))
    return read_table(s, d, "mix_targets").join(used, "source", "full").select("source", F.coalesce(F.col("most") > F.col("max_repeats"), F.lit(False)).alias("over_repeats"), F.coalesce("twice", F.lit(0)).alias("twice"), F.col("target_share").isNull().alias("unlisted"))


QUERIES = {
    "p3_found": lambda s, d: _personal_data(s, d).select("source_table", "row_key", F.explode("found").alias("f")).select("source_table", "row_key", "f.kind", "f.pii_text").distinct(),
    "p3_redacted": lambda s, d: _personal_data(s, d).select("source_table", "row_key", "redacted").distinct(),
    "p4_found": lambda s, d: _survivors(s, d, with_fields=False).select(*_P4),
    "p4_survivors": _survivors,
    "p4_untimed": lambda s, d: survivors.survivors(survivors.untimed(read_table(s, d, "claims")), read_table(s, d, "source_documents"), with_fields=False).select(*_P4),
    "p5_found": lambda s, d: secrets.find_credentials(read_table(s, d, "manifest_files")).select("file_id", "line_no").distinct(),
    "p7_pack": lambda s, d: packing.packed(read_table(s, d, "documents")),
    "p7_utilisation": lambda s, d: packing.utilisation(packing.packed(read_table(s, d, "documents"))),
    "p7_pack_bounded": _bounded,
    "p7_utilisation_bounded": lambda s, d: packing.utilisation(_bounded(s, d), **_BOUNDS),
    "p7_violations": lambda s, d: packing.violations(packing.packed(read_table(s, d, "documents")), read_table(s, d, "documents")),
    "p7_violations_bounded": lambda s, d: packing.violations(_bounded(s, d), read_table(s, d, "documents"), **_BOUNDS),
    "p8_violations": _repeats,
    "p8_mix": lambda s, d: mixing.mixed(read_table(s, d, "documents"), read_table(s, d, "mix_targets"), of_all=True),
    "p8_shares": _shares_of_all,
    "p8_shares_of_all": _shares_of_all,
    "p9_found": lambda s, d: sentences.sentence_units(read_table(s, d, "documents"), with_text=False).distinct(),
    "p9_sentences": lambda s, d: sentences.sentence_units(read_table(s, d, "documents")),
    "p5_redacted": lambda s, d: secrets.redacted_files(read_table(s, d, "manifest_files")),
}

_KEYS = r"""
    case when entity_type = 'server' and not regexp_matches(lower(trim(entity_key, E' \t\n\r')), '^\d{1,3}(\.\d{1,3}){3}$')
         then split_part(lower(trim(entity_key, E' \t\n\r')), '.', 1) else lower(trim(entity_key, E' \t\n\r')) end as entity_key,
    replace(replace(lower(attribute), ' ', '_'), '-', '_') as attribute"""
_P4_SQL = rf"""
with docs as (select document_id, max(precedence) as precedence from source_documents group by 1),
c as (select assessment_id, entity_type, {_KEYS}, claim_id, ord, value, evidence_quote, extracted_at,
             coalesce(precedence, 50) as prec, case when confidence is null or isnan(confidence) then -1 else confidence end as conf
      from claims left join docs on source_document_id = document_id),
g as (select assessment_id, entity_type, entity_key, attribute from c group by all having count(distinct claim_id) > 1),
v as (select * from c where lower(trim(coalesce(value, ''), E' \t\n\r')) not in ('', 'n/a', 'tbd', 'unknown', '-', '?')
      qualify row_number() over (partition by assessment_id, entity_type, entity_key, attribute order by prec desc, conf desc, extracted_at desc nulls last, ord) = 1),
q as (select * from c where trim(coalesce(evidence_quote, ''), E' \t\n\r') <> ''
      qualify row_number() over (partition by assessment_id, entity_type, entity_key, attribute order by prec desc, conf desc, extracted_at desc nulls last, ord) = 1)
"""
_P4_JOIN = """
from g left join v using (assessment_id, entity_type, entity_key, attribute)
left join q using (assessment_id, entity_type, entity_key, attribute)"""

# the same with every third time missing: learned steps, strongest chains, and what is overtaken
_P4_UNTIMED_SQL = rf"""
with recursive docs as (select document_id, max(precedence) as precedence from source_documents group by 1),
c as (select struct_pack(a := assessment_id, t := entity_type, k := {_KEYS.split(" as entity_key,")[0].strip()}, n := replace(replace(lower(attribute), ' ', '_'), '-', '_')) as g, claim_id, ord,
             case when lower(trim(coalesce(value, ''), E' 	

')) not in ('', 'n/a', 'tbd', 'unknown', '-', '?') then concat_ws('|', entity_type, replace(replace(lower(attribute), ' ', '_'), '-', '_'), lower(trim(value, E' 	

'))) end as fact,
             trim(coalesce(evidence_quote, ''), E' 	

') <> '' as quoted, case when ord % 3 <> 0 then extracted_at end as tm,
             coalesce(precedence, 50) as prec, case when confidence is null or isnan(confidence) then -1 else confidence end as conf
      from claims left join docs on source_document_id = document_id),
s as (select fact, lag(fact) over (partition by g order by tm, ord) as before from c where tm is not null and fact is not null),
p as (select least(before, fact) as a, greatest(before, fact) as b, sum(case when before < fact then 1 else -1 end) as way from s where before is not null and before <> fact group by 1, 2 having way <> 0),
l as (select case when way > 0 then a else b end as earlier, case when way > 0 then b else a end as later, abs(way) as votes from p),
u as (select 'v' as use, * from c where fact is not null union all select 'q' as use, * from c where quoted),
tops as (select use, g, max((prec, conf)) as top, max((prec, conf)) filter (tm is null) as untimed from u group by 1, 2 having top = untimed),
tied as (select u.* from u join tops on u.use = tops.use and u.g = tops.g and (prec, conf) = top),
m as (select distinct use, g, fact, false as timed from tied where tm is null and fact is not null
      union all select use, g, fact, true from (select * from tied where tm is not null qualify row_number() over (partition by use, g order by tm desc, ord, claim_id desc) = 1) where fact is not null),
w as (select earlier as start, later as fact, votes from l where earlier in (select fact from m)
      union select w.start, l.later, least(w.votes, l.votes) from w join l on w.fact = l.earlier where w.start <> l.later),
b as (select start, fact, max(votes) as votes from w group by 1, 2),
o as (select x.start as fact, x.fact as later from b x left join b y on x.start = y.fact and x.fact = y.start where y.votes is null or x.votes > y.votes),
out as (select distinct m.use, m.g, m.timed, case when not m.timed then m.fact end as fact from m join o using (fact) join m n on n.use = m.use and n.g = m.g and n.fact = o.later),
r as (select u.*, case when exists (select 1 from out where out.use = u.use and out.g = u.g and out.timed = (u.tm is not null) and (out.timed or out.fact = u.fact)) then 0 else 1 end as currency from u),
f as (select * from r qualify row_number() over (partition by use, g order by prec desc, conf desc, currency desc, tm desc nulls last, ord, claim_id desc) = 1)
select g.a as assessment_id, g.t as entity_type, g.k as entity_key, g.n as attribute, coalesce(max(f.claim_id) filter (use = 'v'), '') as value_claim_id, coalesce(max(f.claim_id) filter (use = 'q'), '') as quote_claim_id
from (select g from c group by 1 having count(distinct claim_id) > 1) left join f using (g) group by g"""

_NO_VIOLATIONS = "select count(*) as texts, 0 as not_whole, 0 as cut_without_need, 0 as over_tokens, 0 as over_documents, 0 as over_attention from documents"

ORACLES = {
    "p7_violations": _NO_VIOLATIONS,
    "p7_violations_bounded": _NO_VIOLATIONS,
    "p8_violations": "select source, false as over_repeats, 0 as twice, false as unlisted from mix_targets",
    "p4_untimed": _P4_UNTIMED_SQL,
    "p4_found": _P4_SQL + "select assessment_id, entity_type, entity_key, attribute, coalesce(v.claim_id, '') as value_claim_id, coalesce(q.claim_id, '') as quote_claim_id" + _P4_JOIN,
    "p4_survivors": _P4_SQL
    + r"select assessment_id, entity_type, entity_key, attribute, coalesce(v.claim_id, '') as value_claim_id, coalesce(q.claim_id, '') as quote_claim_id, trim(v.value, E' \t\n\r') as value, q.evidence_quote as evidence_quote"
    + _P4_JOIN,
}
