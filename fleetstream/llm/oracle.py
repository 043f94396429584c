"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL: dict[str, str] = {
    "op2_suffix_array_line_dedup": r"""
with l as (
  select doc_id, i, a[i] line
  from (select doc_id, a, unnest(range(1, len(a) + 1)) i
        from (select doc_id, string_split(text, chr(10)) a from documents))),
s as (
  select doc_id, i, line, row_number() over (partition by doc_id order by i) pos
  from l where regexp_matches(line, '[^\x20\x09-\x0D]')),
n as (
  select *, lead(line) over w next, lead(i) over w next_i from s window w as (partition by doc_id order by i)),
f as (
  select doc_id, i, next_i, row_number() over (partition by line, next order by doc_id, i) k from n where next is not null),
gone as (
  select doc_id, i from f where k > 1 union select doc_id, next_i from f where k > 1),
kept as (
  select doc_id, string_agg(line, chr(10) order by i) body from l anti join gone using (doc_id, i) group by 1)
select d.doc_id, coalesce(n_lines, 0) n_lines, coalesce(n_removed, 0) n_removed, sha256(coalesce(body, '')) kept_sha256
from documents d
left join (select doc_id, count(*) n_lines from s group by 1) using (doc_id)
left join (select doc_id, count(*) n_removed from gone group by 1) using (doc_id)
left join kept using (doc_id)""",
    "op3_winnowing_decontamination": f"""
with d as (select doc_id, {_ALNUM} w from documents),
i as (select item_id, {_ALNUM} w from benchmark),
iw as (
  select distinct item_id, n, array_to_string(w[p:p + n - 1], ' ') g
  from (select item_id, w, least(len(w), 10) n, unnest(range(1, len(w) - least(len(w), 10) + 2)) p
        from i where len(w) > 0)),
dw as (
  select doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') g
  from (select doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) p from d, (select distinct n from iw))),
hit as (select doc_id, p, n, item_id from dw join iw using (n, g)),
cov as (select doc_id, count(distinct q) n_hit from (select doc_id, unnest(range(p, p + n)) q from hit) group by 1),
its as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) items
        from (select distinct doc_id, cast(item_id as varchar) item from hit) group by 1)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit,
       cast(coalesce(n_items, 0) as bigint) n_items, sha256(coalesce(items, '')) items_sha256,
       coalesce(n_hit, 0) > 0 contaminated
from d left join cov using (doc_id) left join its using (doc_id)""",
    "op7_suffix_tree_substring_dedup": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
win as (select doc_id, p, array_to_string(w[p:p + 19], ' ') g
        from (select doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) p from d)),
late as (select doc_id, p from (select doc_id, p, row_number() over (partition by g order by doc_id, p) k from win) where k > 1),
gone as (select distinct doc_id, unnest(range(p, p + 20)) i from late),
kept as (
  select doc_id, string_agg(word, ' ' order by i) body
  from (select doc_id, i, w[i] word from (select doc_id, w, unnest(range(1, len(w) + 1)) i from d)) anti join gone using (doc_id, i)
  group by 1)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n, 0) n_removed, sha256(coalesce(body, '')) kept_sha256
from d left join (select doc_id, count(*) n from gone group by 1) using (doc_id) left join kept using (doc_id)""",
}
