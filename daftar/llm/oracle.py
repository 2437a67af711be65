"""DuckDB SQL for the queries that SQL can express, over whole tables."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP1 = f"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, {_SPACED}) as w from documents),
s as (select distinct doc_id, array_to_string(w[i + 1 : i + 5], ' ') as s from (select doc_id, w, unnest(range(greatest(len(w) - 4, 1))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
r(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) as component_id from r group by a),
g as (select doc_id, hash(list(s order by s)) as h from s group by 1), k as (select h, count(*) as n_copies from g group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, coalesce(k.n_copies, 1) as n_copies
from documents d left join n on n.doc_id = d.doc_id left join c on c.a = d.doc_id left join g on g.doc_id = d.doc_id left join k on k.h = g.h"""

OP6 = f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) as w from documents),
v as (select doc_id, i, array_to_string(w[i + 1 : i + 13], ' ') as s from (select doc_id, w, unnest(range(len(w) - 12)) as i from d where len(w) >= 13)),
m as (select s, min(doc_id) as least from v group by s),
h as (select distinct v.doc_id, unnest(range(v.i, v.i + 13)) as pos from v join m on m.s = v.s and m.least < v.doc_id),
g as (select doc_id, list(pos) as gone from h group by 1)
select d.doc_id, len(w) as n_words, coalesce(len(gone), 0) as n_removed,
sha256(array_to_string(case when gone is null then w else list_filter(w, lambda x, k: not list_contains(gone, k - 1)) end, ' ')) as kept_sha256
from d left join g on g.doc_id = d.doc_id"""

OP8 = f"""
with d as (select doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) as w from documents),
b as (select distinct item_id, regexp_extract_all({_LOWER}, {_ALNUM}) as w from benchmark),
bw as (select distinct item_id, n, array_to_string(w[i + 1 : i + n], ' ') as s from (select item_id, w, least(13, len(w)) as n, unnest(range(len(w) - least(13, len(w)) + 1)) as i from b where len(w) > 0)),
dw as (select doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') as s from (select doc_id, w, n, unnest(range(len(w) - n + 1)) as i from d, (select distinct n from bw) where len(w) >= n)),
h as (select dw.doc_id, dw.i, dw.n, bw.item_id from dw join bw on bw.n = dw.n and bw.s = dw.s),
p as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(i, i + n)) as pos from h) group by 1),
x as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from h group by 1)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join p on p.doc_id = d.doc_id left join x on x.doc_id = d.doc_id"""

_DIGITS = "list_transform([15, 10, 5, 0], lambda q: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, k * 5 + 1, 5))::int >> q) & 31) + 1, 1))"
OP10 = f"""
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as h, max(page_id) over (partition by coalesce(html, '')) as latest from pages)
select page_id, payload_bytes, array_to_string(list_transform(range(8), lambda k: array_to_string({_DIGITS}, '')), '') as payload_digest,
case when page_id = latest then 'response' else 'revisit' end as record_type, case when page_id <> latest then latest end as refers_to from p"""

OP12 = f"""
with t as (select doc_id, unnest(regexp_extract_all({_LOWER}, {_ALNUM})) as term from documents),
f as (select doc_id, term, count(*) as tf from t group by all),
n as (select doc_id, sum(tf)::bigint as n from f group by 1), s as (select count(*) as n_docs, sum(n)::bigint as n_terms from n),
m as (select doc_id, 100 - 75 + (75 * n * n_docs) // n_terms as m from n, s),
w as (select term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::bigint as w from f, s group by term, n_docs),
i as (select item_id, term, count(*) as c from (select item_id, unnest(regexp_extract_all({_LOWER}, {_ALNUM})) as term from benchmark) group by all),
r as (select item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score from i join w using (term) join f using (term) join m using (doc_id) group by all),
k as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from r where score > 0)
select item_id, rank, doc_id, score from k where rank <= 10"""

_CUTS = ", ".join(f"('0x' || substr(g, {8 * k + 1}, 8))::bigint as h{k + 1}" for k in range(4))
OP13 = f"""
with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(doc_id::varchar, '')) as g from documents),
h as (select *, {_CUTS} from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
p as (select *, substr(t, 1, a) as x, substr(t, a + 1, b - a) as y, substr(t, b + 1) as z from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
sha256(case form when 'plain' then t when 'psm' then '<P>' || x || '<S>' || z || '<M>' || y else '<S>' || z || '<P>' || x || '<M>' || y end) as output_sha256, sha256(t) as restored_sha256 from p"""

ORACLE_SQL = {"op1_ngram_join": OP1, "op6_substring_dedup": OP6, "op8_decontaminate": OP8, "op10_warc": OP10, "op12_lexical_search": OP12, "op13_fill_middle": OP13}
