"""DuckDB SQL for those queries that SQL can express.

The others are held against brute force in tests/llm: classifier and language model are
fitted numerically, packing and mixing are sequential schedules, quality rules and
licences use hashes and patterns that DuckDB does not have.
"""

from __future__ import annotations

from .revisit import PERMITTED, TRACKING

TOP_K = """
with v as (select vec_id as id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q from embeddings),
s as (select a.id as query_id, b.id as vec_id, cast(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) as bigint) as score
      from v a join v b on a.id <> b.id where a.id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5
"""

JACCARD = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
      else list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) end) as g from w),
n as (select w.doc_id, count(g) as n_shingles from w left join s using (doc_id) group by 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 90 * (x.n_shingles + y.n_shingles - i)),
r(a, b) as (select doc_id, doc_id from n union select r.a, l.b from r join l on l.a = r.b)
select n.doc_id, n.n_shingles, min(r.b) as component_id from n join r on r.a = n.doc_id group by 1, 2
"""

REPEATS = """
with d as (select row_number() over () as rid, doc_id, encode(coalesce(text, '')) as b from documents),
n as (select rid, doc_id, b, octet_length(b) as n from d),
w as (select rid, unnest(range(0, n - 199)) as i, b from n where n >= 200),
h as (select rid, i, count(*) over (partition by hash(array_slice(b, i + 1, i + 200))) as c from w),
p as (select rid, i, i > coalesce(lag(i) over (partition by rid order by i) + 200, -1) as fresh from h where c > 1),
g as (select rid, i, sum(cast(fresh as int)) over (partition by rid order by i) as k from p),
m as (select rid, min(i) as lo, max(i) + 200 as hi from g group by rid, k),
e as (select rid, lo, hi from m union all select rid, n, n from n),
x as (select rid, lo, hi, coalesce(lag(hi) over (partition by rid order by lo, hi), 0) as before from e),
k as (select x.rid, string_agg(case when x.lo > x.before then hex(array_slice(n.b, x.before + 1, x.lo)) else '' end, '' order by x.lo, x.hi) as kept from x join n using (rid) group by 1),
t as (select rid, sum(hi - lo) as removed, count(*) as spans from m group by 1)
select n.doc_id, n.n as n_bytes, cast(coalesce(t.removed, 0) as bigint) as n_removed, cast(coalesce(t.spans, 0) as bigint) as n_spans, sha256(unhex(k.kept)) as kept_sha256
from n join k using (rid) left join t using (rid)
"""

SHARED_LINES = """
with d as (select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
l as (select rid, doc_id, unnest(l) as line, unnest(range(len(l))) as pos from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key, max(doc_id) as last from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
m as (select k.*, f.last is not null and f.last <> k.doc_id as gone from k left join f using (key))
select doc_id, count(*) as n_lines, cast(sum(cast(gone as int)) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by rid, doc_id
"""


def _canonical(url: str) -> str:
    bare = f"regexp_replace(regexp_replace(trim({url}), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
    host = f"regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract({bare}, '^([^/?]*)', 1)), '^.*@', ''), ':(80|443)$', ''), '^(www|m)\\.', '')"
    path = f"regexp_replace(regexp_extract({bare}, '^[^/?]*([^?]*)', 1), '/+$', '')"
    dropped = ", ".join(f"'{t}'" for t in TRACKING)
    query = f"array_to_string(list_sort(list_filter(string_split(regexp_extract({bare}, '\\?(.*)$', 1), '&'), lambda p: p <> '' and split_part(p, '=', 1) not in ({dropped}))), '&')"
    return f"{host} || {path} || case when {query} <> '' then '?' || {query} else '' end"


def _revisits() -> str:
    assert {"etag", "date", "expires", "last-modified"} <= set(PERMITTED)
    return f"""
with g as (select page_id as p, {_canonical("url")} as u, md5(coalesce(html, '')) as b, 1600000000 + page_id * 7919 % 100000 as s from pages where page_id is not null),
k(k, late, v) as (values (0, 0, 0), (1, 20, 1), (2, 20, 2), (3, 40, 3), (4, 10, 0), (5, 20, 2), (6, 50, 3), (7, 60, 3)),
w as (select p, u, b, k, s + late as t, case when (k = 5 and p % 7 = 0) or (k = 6 and p % 5 = 1) then 1 else v end as v from g, k),
x as (select p, u, k, t, 8 * p + k as rid, case when v = 1 and p % 3 = 0 then 0 else v end as v, md5(b || cast(case when v = 1 and p % 3 = 0 then 0 else v end as varchar)) as d from w),
f as (select u, t, rid, d, '"' || substr(d, 1, 16) || '"' as etag, 'm' || v as lm, case when k in (0, 2) then 'max-age=60' end as cache
      from x where k < 4 and p % 4 <> 3 and not (k = 2 and p % 2 = 1) and not (k = 3 and p % 6 = 1)),
r as (select u, t, rid, case when k = 4 and p % 5 = 0 then '"stale"' when k in (4, 6) then 'W/"' || substr(d, 1, 16) || '"' end as etag,
        case when k = 5 and p % 7 <> 0 then 'm' || v end as lm, case when k = 6 then 'e' || t end as expires,
        case when (k = 5 and p % 7 = 0) or (k = 7 and p % 9 <> 0) then d end as d from x where k > 3),
o as (select r.*, f.rid as o_rid, f.d as o_d, f.etag as o_etag, f.lm as o_lm, f.cache as o_cache, row_number() over (partition by r.rid order by f.t desc nulls last, f.rid desc) as place
      from r left join f on f.u = r.u and (f.t < r.t or (f.t = r.t and f.rid < r.rid))),
c as (select *, case when o_rid is null then 'no_original' when etag is not null then case when replace(etag, 'W/', '') = o_etag then 'resolved' else 'mismatch' end
        when lm is not null then case when lm = o_lm then 'resolved' else 'mismatch' end
        when d is not null then case when d = o_d then 'resolved' else 'mismatch' end else 'unvalidated' end as outcome from o where place = 1)
select rid as record_id, u as url_key, o_rid as refers_to, outcome,
  case when outcome = 'resolved' then concat_ws(';', 'cache-control=' || o_cache, 'content-type=text/html', 'date=t' || t, 'etag=' || coalesce(etag, o_etag), 'expires=' || expires, 'last-modified=' || coalesce(lm, o_lm))
       else concat_ws(';', 'content-type=ignored', 'date=t' || t, 'etag=' || etag, 'expires=' || expires, 'last-modified=' || lm, 'server=edge') end as headers,
  case when outcome = 'resolved' then o_d else d end as digest
from c
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_suffix_dedup": REPEATS, "op5_jaccard_join": JACCARD, "op6_revisit_resolution": _revisits(), "op7_exact_top_k": TOP_K, "op11_line_dedup": SHARED_LINES}
