"""SQL for the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

from veritab.functions.text import SPACE

LN = r"\p{L}\p{N}"
TAG = "(headline|place|desk|story)"
FILLED = f"coalesce(regexp_matches(text, '[^{SPACE}]'), false)"
#: The key of the fields of a tagged text: its distinct (tag, value) sorted.
FIELDS = f"""case when regexp_matches(text, '(?i)^[^{LN}]*{TAG}[{SPACE}]*:') then array_to_string(list_sort(list_distinct(list_transform(
    list_filter(string_split(regexp_replace(text, '(?i)\\b{TAG}[{SPACE}]*:', chr(1) || '\\1' || chr(2), 'g'), chr(1)), lambda x: contains(x, chr(2))),
    lambda x: lower(split_part(x, chr(2), 1)) || '=' || regexp_replace(lower(substr(x, strpos(x, chr(2)) + 1)), '[^{LN}]+', '', 'g')))), ';') end"""
KEYS = f"regexp_replace(lower(text), '[^{LN}]+', '', 'g') as k1, {FIELDS} as k2"
WORDS = f"regexp_extract_all(lower(text), '[{LN}]+')"
GRAMS = "list_distinct(list_transform(range(1, greatest(1, len(w) - 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))"

HELD = """held as (select config_id, arg_max(dataset_revision, created_at) as revision, 4 * (arg_max(train_per_class, created_at) + arg_max(validation_per_class, created_at)) as size
  from data_config group by config_id)"""

P1 = f"""with {HELD}, pool as (select distinct dataset_revision as revision, label, row_id from example where {FILLED} and label is not null and row_id is not null),
  supply as (select revision, label, count(*) as n from pool group by all),
  wanted as (select config_id, label, max(target_share) as share, max(min_rows) as min_rows from class_target group by all)
  select config_id, label from wanted join held using (config_id) left join supply using (revision, label)
  where greatest(coalesce(min_rows, 0)::double, coalesce(share, 0) * size) > coalesce(n, 0)"""

P1_NEEDS = f"""with {HELD}, pool as (select distinct dataset_revision as revision, label, row_id from example where {FILLED} and label is not null and row_id is not null),
  supply as (select revision, label, count(*) as n from pool group by all),
  wanted as (select config_id, label, max(target_share) as share, max(min_rows) as min_rows from class_target where label is not null group by all),
  needs as (select config_id, label, coalesce(n, 0) as supply, greatest(coalesce(min_rows, 0)::double, coalesce(share, 0) * size) as need from wanted join held using (config_id) left join supply using (revision, label))
  select config_id, label, supply, round(need, 6) as need, need > supply as unmet from needs"""

P2 = f"""with one as (select row_id, any_value(text) as text from example where text is not null and row_id is not null group by row_id),
  r as (select row_id, {KEYS}, {WORDS} as w from one), s as (select row_id, k1, k2, {GRAMS} as grams from r where len(w) >= 3),
  g as (select row_id, unnest(grams) as gram from s),
  shared as (select a.row_id as x, b.row_id as y, count(*) as n from g a join g b on a.gram = b.gram and a.row_id < b.row_id group by all)
  select x as row_id_a, y as row_id_b from shared join s a on a.row_id = x join s b on b.row_id = y
  where n * 5 >= 3 * (len(a.grams) + len(b.grams) - n) and a.k1 <> b.k1 and (a.k2 is null or b.k2 is null or a.k2 <> b.k2)"""

P2_GROUPS = f"""with recursive pairs as ({P2}), edges as (select row_id_a as a, row_id_b as b from pairs union all select row_id_b, row_id_a from pairs),
  reach(a, b) as (select distinct a, a from edges union select reach.a, edges.b from reach join edges on reach.b = edges.a)
  select a as row_id, min(b) as "group" from reach group by a"""

P2_CLASSES = f"""with pairs as ({P2}), one as (select row_id, any_value(text) as text from example where text is not null and row_id is not null group by row_id),
  r as (select row_id, {KEYS}, {WORDS} as w from one), c as (select row_id, array_to_string(w, ' ') || chr(1) || coalesce(k2, '') as class from r where len(w) >= 3),
  edges as (select row_id_a as a, row_id_b as b from pairs union all select row_id_b, row_id_a from pairs),
  links as (select x.class as class, count(distinct y.class) as n from edges join c x on x.row_id = a join c y on y.row_id = b group by x.class)
  select row_id, min(row_id) over (partition by class) as class_row_id, coalesce(n, 0)::bigint as n_links from c left join links using (class)"""

P3_SETS = f"""with one as (select distinct row_id, {KEYS} from example where {FILLED} and row_id is not null),
  a as (select *, coalesce(min(k1) over (partition by k2), k1) as l from one where k2 is not null union all select *, k1 as l from one where k2 is null),
  b as (select *, min(l) over (partition by k1) as m from a),
  c as (select *, case when k2 is null then m else min(m) over (partition by k2) end as o from b),
  d as (select *, min(o) over (partition by k1) as class from c)
  select distinct row_id, min(row_id) over (partition by class) as first_row_id from d"""
P3 = f"select first_row_id, row_id from ({P3_SETS}) where first_row_id <> row_id"
P3_COLLAPSED = f"select first_row_id as row_id, count(*) as n_records from ({P3_SETS}) group by first_row_id"

CLEAN = f"nullif(lower(regexp_replace(row_id, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')), '')"

P4 = f"""with m as (select config_id, seed, release_no, {CLEAN} as id, source_index from sample_member where config_id is not null and seed is not null and release_no is not null),
  known as (select distinct row_id, {CLEAN} as id, source_index from example where row_id is not null),
  drawn as (select distinct config_id, seed, release_no, known.row_id as row_id from m join known on m.id = known.id
    union select distinct config_id, seed, release_no, known.row_id from m join known on m.id is null and m.source_index = known.source_index),
  releases as (select distinct config_id, seed, release_no from m)
  select distinct r.config_id as config_id, r.release_no as release_no, d.row_id as row_id from releases r join drawn d on r.config_id = d.config_id and r.seed = d.seed and d.release_no < r.release_no
  where not exists (select 1 from drawn x where x.config_id = r.config_id and x.seed = r.seed and x.release_no = r.release_no and x.row_id = d.row_id)"""

P5_FLAGS = f"""m as (select lower(regexp_replace(split, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')) as split, row_id, text, source from split_member),
  k as (select distinct split, row_id, case when {FILLED} then text end as text from m where split in ('train', 'validation', 'test')),
  r as (select row_number() over () as i, split, row_id, case when text is not null then regexp_replace(lower(text), '[^{LN}]+', '', 'g') end as k1, {FIELDS} as k2, {WORDS} as w from k),
  s as (select i, split, {GRAMS} as grams from r where len(w) >= 3), g as (select i, split, unnest(grams) as gram from s),
  shared as (select b.i as i, count(*) as n, len(any_value(t.grams)) as nt, len(any_value(j.grams)) as nj from g a join g b on a.gram = b.gram and a.split = 'train' and b.split <> 'train'
    join s t on t.i = a.i join s j on j.i = b.i group by a.i, b.i),
  flags as (select split, row_id, bool_or(row_id in (select row_id from r where split = 'train' and row_id is not null)) as same_row,
    bool_or(coalesce(k1 in (select k1 from r where split = 'train' and k1 is not null), false) or coalesce(k2 in (select k2 from r where split = 'train' and k2 is not null), false)) as copy,
    bool_or(i in (select i from shared where n * 5 >= 3 * (nt + nj - n))) as near from r where split <> 'train' and row_id is not null group by all)"""
P5 = f"with {P5_FLAGS} select split, row_id from flags where same_row or copy or near"
P5_REPORT = f"""with {P5_FLAGS}, sources as (select distinct split, row_id, source from m)
  select split, source, count(*) as n_rows, count(*) filter (where same_row) as n_same_row, count(*) filter (where copy) as n_copy, count(*) filter (where near) as n_near,
    count(*) filter (where same_row or copy or near) as n_found from flags join sources using (split, row_id) group by split, source"""

P8 = """with d as (select doc_id, text from documents where doc_id is not null and length(text) >= 160),
  p as (select doc_id, text, unnest(range(length(text) - 159)) as s from d), q as (select doc_id, s, hash(substr(text, s + 1, 160)) as h from p),
  both_ as (select h from q group by h having min(doc_id) <> max(doc_id)), hit as (select distinct doc_id, s from q where h in (select h from both_)),
  run as (select *, sum(new) over (partition by doc_id order by s) as k from (select *, case when s <= lag(s) over (partition by doc_id order by s) + 160 then 0 else 1 end as new from hit))
  select doc_id, min(s)::int as span_start, (max(s) + 160)::int as span_end from run group by doc_id, k"""

P8_SHARED = f"select documents.doc_id as doc_id, coalesce(sum(span_end - span_start), 0)::bigint as n_shared from documents left join ({P8}) x on documents.doc_id = x.doc_id group by documents.doc_id"

SQL = {
    "p1_found": P1, "p1_needs": P1_NEEDS, "p2_classes": P2_CLASSES, "p2_found": P2, "p2_groups": P2_GROUPS, "p3_collapsed": P3_COLLAPSED, "p3_found": P3, "p4_found": P4, "p5_found": P5, "p5_report": P5_REPORT,
    "p8_found": P8, "p8_shared": P8_SHARED,
}
