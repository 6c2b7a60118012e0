"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .licenses import TEMPLATES

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'"
_ALNUM = rf"list_filter(string_split_regex(translate(coalesce(text,''),{_AZ}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x<>'')"
_WORDS = rf"list_filter(string_split_regex(translate(coalesce(text,''),{_AZ}), '[\x20\x09-\x0D]+'), lambda x: x<>'')"

OP3 = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label=b.label AND a.vec_id<>b.vec_id
 WHERE list_dot_product(a.x,b.x)/(sqrt(list_dot_product(a.x,a.x))*sqrt(list_dot_product(b.x,b.x)))>=0.98),
r(vec_id,c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a=r.vec_id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT r.vec_id, coalesce(max(n.n),0) AS n_links, min(c) AS component_id, r.vec_id=min(c) AS kept FROM r LEFT JOIN n ON n.a=r.vec_id GROUP BY r.vec_id"""

_T = ",".join("('{}','{}')".format(i, t.replace("'", "''")) for i, t in TEMPLATES)
OP4 = f"""WITH t AS (SELECT id, {_ALNUM} AS w FROM (VALUES {_T}) v(id,text)), d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
ts AS (SELECT DISTINCT id, array_to_string(w[p:p+4],' ') AS g FROM (SELECT id, w, unnest(range(1,len(w)-3)) AS p FROM t WHERE len(w)>=5)),
tn AS (SELECT id, count(*) AS n FROM ts GROUP BY 1),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[p:p+4],' ') AS g FROM (SELECT doc_id, w, unnest(range(1,len(w)-3)) AS p FROM d WHERE len(w)>=5)),
m AS (SELECT doc_id, id, count(*)/max(n) AS s FROM ds JOIN ts USING (g) JOIN tn USING (id) GROUP BY 1,2),
k AS (SELECT doc_id, count(*) AS n, string_agg(id,',' ORDER BY id) AS ids, max(s) AS s FROM m WHERE s>=0.8 GROUP BY 1)
SELECT doc_id, coalesce(n,0) AS n_licenses, coalesce(ids,'') AS licenses, coalesce(s,0.0)::DOUBLE AS containment FROM d LEFT JOIN k USING (doc_id)"""

OP5 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT doc_id, n, i, w[i] AS x, CASE WHEN i>1 THEN w[i-1] END AS p, CASE WHEN i>2 THEN w[i-2] END AS q FROM (SELECT doc_id, w, len(w) AS n, unnest(range(1,len(w)+1)) AS i FROM d)),
o1 AS (SELECT doc_id, x, count(*) AS f FROM t GROUP BY 1,2), u AS (SELECT x, sum(f) AS f FROM o1 GROUP BY 1),
o2 AS (SELECT doc_id, p, x, count(*) AS f FROM t WHERE p IS NOT NULL GROUP BY 1,2,3), b AS (SELECT p, x, sum(f) AS f FROM o2 GROUP BY 1,2),
o3 AS (SELECT doc_id, q, p, x, count(*) AS f FROM t WHERE q IS NOT NULL GROUP BY 1,2,3,4), c AS (SELECT q, p, x, sum(f) AS f FROM o3 GROUP BY 1,2,3),
s AS (SELECT t.doc_id, t.p, t.q, u.f-o1.f AS f1, (SELECT count(*) FROM t)-t.n AS m, coalesce(b.f-o2.f,0) AS f2, cu.f-co.f AS fc, coalesce(c.f-o3.f,0) AS f3, cb.f-cd.f AS fcc
 FROM t JOIN u USING (x) JOIN o1 USING (doc_id,x) LEFT JOIN b ON b.p=t.p AND b.x=t.x LEFT JOIN o2 ON o2.doc_id=t.doc_id AND o2.p=t.p AND o2.x=t.x
 LEFT JOIN c ON c.q=t.q AND c.p=t.p AND c.x=t.x LEFT JOIN o3 ON o3.doc_id=t.doc_id AND o3.q=t.q AND o3.p=t.p AND o3.x=t.x
 LEFT JOIN u cu ON cu.x=t.p LEFT JOIN o1 co ON co.doc_id=t.doc_id AND co.x=t.p
 LEFT JOIN b cb ON cb.p=t.q AND cb.x=t.p LEFT JOIN o2 cd ON cd.doc_id=t.doc_id AND cd.p=t.q AND cd.x=t.p),
z AS (SELECT doc_id, count(*) AS n, count(CASE WHEN p IS NOT NULL AND f3=0 THEN 1 END) AS nb,
 sum(ln(CASE WHEN f3>0 THEN f3/fcc WHEN f2>0 THEN (CASE WHEN q IS NULL THEN 1.0 ELSE 0.4 END)::DOUBLE*f2/fc
  ELSE (CASE WHEN p IS NULL THEN 1.0::DOUBLE WHEN q IS NULL THEN 0.4::DOUBLE ELSE 0.4::DOUBLE*0.4::DOUBLE END)*(CASE WHEN f1>0 THEN f1/m ELSE 1.0/(m+1) END)::DOUBLE END)) AS s FROM s GROUP BY 1)
SELECT doc_id, coalesce(n,0) AS n_tokens, coalesce(nb,0) AS n_backoff, coalesce(s,0.0)::DOUBLE AS log_score, s/n AS mean_log_score FROM d LEFT JOIN z USING (doc_id)"""

OP6 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(w[p:p+2],' ') AS g FROM (SELECT doc_id, w, unnest(range(1,len(w)-1)) AS p FROM d WHERE len(w)>=3) UNION ALL SELECT doc_id, array_to_string(w,' ') FROM d WHERE len(w) IN (1,2))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g=b.g AND a.doc_id<>b.doc_id JOIN n na ON na.doc_id=a.doc_id JOIN n nb ON nb.doc_id=b.doc_id GROUP BY 1,2 HAVING 100*count(*)>=90*(max(na.n)+max(nb.n)-count(*))),
r(doc_id,c) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a=r.doc_id)
SELECT r.doc_id, coalesce(max(n.n),0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id=r.doc_id GROUP BY r.doc_id"""

OP9 = """WITH p AS (SELECT page_id, coalesce(html,'') AS t, sha1(coalesce(html,'')) AS h FROM pages), f AS (SELECT h, min(page_id) AS lead FROM p GROUP BY 1)
SELECT page_id, octet_length(encode(t)) AS payload_bytes,
 array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x'||substr(h, CAST(k//4*5+1 AS INT), 5) AS BIGINT) >> CAST(15-5*(k%4) AS INT)) & 31 AS INT)+1, 1)), '') AS payload_digest,
 CASE WHEN page_id=lead THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id<>lead THEN lead END AS refers_to FROM p JOIN f USING (h)"""

OP10 = f"""WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents), i AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p+n-1],' ') AS g FROM (SELECT item_id, w, least(8,len(w)) AS n, unnest(range(1, len(w)-least(8,len(w))+2)) AS p FROM i WHERE len(w)>0)),
dw AS (SELECT doc_id, p, n, array_to_string(w[p:p+n-1],' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w)-n+2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w)>=n)),
h AS (SELECT doc_id, p, n, item_id FROM dw JOIN iw USING (n,g)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p,p+n)) AS q FROM h) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n, string_agg(s,',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(hit.n,0) AS n_hit, coalesce(it.n,0) AS n_items, sha256(coalesce(ids,'')) AS items_sha256, coalesce(it.n,0)>=2 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""

ORACLES: dict[str, str] = {
    "op3_subspace_pigeonhole": OP3, "op4_license_minhash": OP4, "op5_stupid_backoff": OP5, "op6_count_vector_rtree": OP6, "op9_warc_segments": OP9, "op10_winnowing": OP10,
}
