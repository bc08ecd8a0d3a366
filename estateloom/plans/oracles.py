"""SQL that computes the core queries' results on the same tables, for comparison."""

from __future__ import annotations

from estateloom.plans import estate_queries, fact_queries

_W = r"E' \t\n\r'"
_FIELD = {sep: rf'(?:"(?:[^"]|"")*"|[^"{sep}]*)' for sep in (",", ";", r"\t")}


def _p1(select: str) -> str:
    """Full-record regular expressions per separator, in place of the grammar."""
    by_sep = []
    for sep, f in _FIELD.items():
        s = sep
        by_sep.append(
            rf"""select line_id, sep, n_cols, vcpu_at,
                not regexp_full_match(t, '{f}(?:{s}{f})*', 's') as quoting,
                length(regexp_replace(t, '"(?:[^"]|"")*"', '', 'g')) - length(replace(regexp_replace(t, '"(?:[^"]|"")*"', '', 'g'), E'{s}', '')) + 1 as n,
                case vcpu_at when 3 then regexp_extract(t, '^(?:{f}{s}){{2}}({f})', 1, 's') else regexp_extract(t, '^(?:{f}{s}){{3}}({f})', 1, 's') end as cell
            from l where sep = E'{sep}'"""
        )
    return rf"""
with h as (select file_id, replace(replace(arg_min(raw_line, line_id), chr(65279), ''), chr(13), '') as head from inventory_lines where line_no = 1 group by 1),
hh as (select file_id, case when contains(head, chr(9)) then chr(9) when contains(head, ';') then ';' else ',' end as sep,
              length(head) - length(translate(head, E',;\t', '')) + 1 as n_cols, case when contains(head, 'role') then 4 else 3 end as vcpu_at from h),
l as (select line_id, regexp_replace(coalesce(raw_line, ''), '\r$', '') as t, sep, n_cols, vcpu_at from inventory_lines join hh using (file_id) where line_no > 1),
r as ({' union all '.join(by_sep)}),
x as (select *, trim(case when cell like '"%"' then replace(cell[2:length(cell)-1], '""', '"') else cell end, {_W}) as v from r),
y as (select line_id, case when quoting then 'quoting' when n <> n_cols then 'columns'
             when v <> '' and not (regexp_full_match(v, '0*[1-9][0-9]{{0,3}}(\.0+)?') and try_cast(v as double) <= 1024) then 'value' end as reason from x)
{select}"""


def _p1_loaded() -> str:
    """Cells of the lines that hold: what stands between separators, one regular expression a field."""
    by_sep = " union all ".join(rf"""select line_id, list_transform(regexp_extract_all(sep || t, E'{s}' || '({f})', 1),
        lambda x: case when x like '"%"' then replace(x[2:length(x)-1], '""', '"') else x end) as c from l where sep = E'{s}'""" for s, f in _FIELD.items())
    cell = lambda fleet, messy: f"nullif(trim(case when n_cols = 7 then {f'c[{fleet}]' if fleet else 'null'} else {f'c[{messy}]' if messy else 'null'} end, ' '), '')"
    return _p1(rf"""
, k as ({by_sep})
select line_id, i.assessment_id, i.file_id, i.file_kind, i.line_no, 0 as part, {cell(1, 1)} as hostname, {cell(2, 0)} as role, {cell(3, 2)} as os,
  cast(try_cast(nullif(v, '') as double) as int) as vcpu, try_cast({cell(5, 0)} as double) as memory_gb, try_cast({cell(6, 0)} as double) as disk_gb, {cell(7, 0)} as datacenter,
  case when n_cols = 4 then c[4] end as notes
from x join y using (line_id) join k using (line_id) join inventory_lines i using (line_id) where reason is null""")


_KEYS = rf"""
    case when entity_type = 'server' and not regexp_matches(lower(trim(entity_key, {_W})), '^\d{{1,3}}(\.\d{{1,3}}){{3}}$')
         then split_part(lower(trim(entity_key, {_W})), '.', 1) else lower(trim(entity_key, {_W})) end as entity_key,
    replace(replace(lower(attribute), ' ', '_'), '-', '_') as attribute"""
_MONTHS = "strptime(t, '{}')"
_P6 = rf"""
with c as (select assessment_id, entity_type, {_KEYS},
             arg_max(case when trim(coalesce(override_value, ''), {_W}) = '' then struct_pack(t := value) else struct_pack(t := override_value) end, ord).t as raw
      from claims where is_selected group by all),
t as (select * exclude raw, trim(raw, {_W}) as t, lower(trim(raw, {_W})) as l from c where lower(trim(coalesce(raw, ''), {_W})) not in ('', 'n/a', 'tbd', 'unknown', '-', '?')),
n as (select *, regexp_extract(l, '^([+-]?[0-9](?:[0-9.,]*[0-9])?)\s*([a-z%]*)$', 1) as num, regexp_extract(l, '^([+-]?[0-9](?:[0-9.,]*[0-9])?)\s*([a-z%]*)$', 2) as unit from t),
m as (select *, try_cast(replace(case when regexp_full_match(num, '[+-]?[0-9]{{1,3}}(,[0-9]{{3}})+(\.[0-9]+)?') then replace(num, ',', '') else num end, ',', '.') as double) as x from n),
k as (select *, case
    when attribute in ('vcpus', 'users_count') then case when x = floor(x) and unit in ('', 'vcpu', 'vcpus', 'core', 'cores', 'cpu', 'cpus', 'c', 'user', 'users') then x end
    when attribute in ('memory_gb', 'disk_gb', 'size_gb') then x * case replace(unit, 'i', '') when '' then 1 when 'gb' then 1 when 'mb' then 1.0/1024 when 'tb' then 1024 when 'kb' then 1.0/1048576 end
    when attribute = 'cpu_utilization_pct' then case when unit in ('', '%', 'percent') then x end
    when attribute = 'rto_hours' then x * case when unit in ('', 'h', 'hour', 'hours') then 1 when unit in ('min', 'minutes') then 1.0/60 when unit in ('day', 'days', 'd') then 24 end end as num_value,
    case when attribute in ('decommission_date', 'go_live_date', 'licence_end') then cast(coalesce(try_strptime(left(t, 10), '%Y-%m-%d'), try_strptime(t, '%Y/%m/%d'),
         try_strptime(t, '%d.%m.%Y'), try_strptime(t, '%d %b %Y'), try_strptime(t, '%b %d, %Y')) as date) end as d,
    case when attribute in ('pci_scope', 'internet_facing', 'encrypted') then case when l in ('yes', 'y', 'true', '1') then 'true' when l in ('no', 'n', 'false', '0') then 'false' end end as b
  from m),
out as (select assessment_id, entity_type, entity_key, attribute, case
    when attribute in ('vcpus', 'users_count', 'memory_gb', 'disk_gb', 'size_gb', 'cpu_utilization_pct', 'rto_hours')
      then regexp_replace(regexp_replace(cast(cast(round(num_value, 3) as decimal(30, 3)) as varchar), '0+$', ''), '\.$', '')
    when attribute in ('decommission_date', 'go_live_date', 'licence_end') then cast(d as varchar)
    when attribute in ('pci_scope', 'internet_facing', 'encrypted') then b else t end as cell from k)
select * from out where cell is not null"""

ORACLES: dict[str, str] = {
    "p1_found": _p1("select line_id, reason from y where reason is not null"),
    "p1_loaded": _p1_loaded(),
    "p6_found": _P6,
    "p2_branches": """
with r as (select feed_id, file_seq, row_no, arg_max(payload, record_id) as payload from server_inventory group by 1, 2, 3),
k as (select feed_id, file_seq, payload, unnest(json_keys(payload)) as col from r),
t as (select feed_id, file_seq, col, json_type(payload, '$."' || col || '"') as t from k),
n as (select feed_id, col as "column", case when t = 'BOOLEAN' then 'boolean' when t in ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') then 'number' else 'text' end as kind, min(file_seq) as first_seq, max(file_seq) as last_seq,
        count(*) as n_rows from t where t <> 'NULL' group by 1, 2, 3)
select *, first_seq > min(first_seq) over (partition by feed_id, "column") as appeared_later from n""",
    **estate_queries.ORACLES,
    **fact_queries.ORACLES,
}
