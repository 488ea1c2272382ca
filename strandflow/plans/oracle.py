"""DuckDB SQL for the queries of ``queries.py``: common tables as named parts, put together by what each query uses."""

from __future__ import annotations

import re

_CODE = """(7*(s+o)*(s+o) + 3*(s+o)
  + CASE WHEN (s+o)%6=0 AND ((hap=1 AND (s+o)%12=0) OR (hap=2 AND (s+o)%12=6) OR (hap>=1 AND (s+o)%30=0)) THEN hap ELSE 0 END
  + CASE WHEN err=o THEN 2 ELSE 0 END) % 4"""
_BASE = f"substr('ACGT', CAST({_CODE} AS INT) + 1, 1)"
_RANK = "CASE base WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 3 WHEN 'T' THEN 4 WHEN '-' THEN 5 ELSE 6 END"
_CLUSTER_RANK = "CASE base WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'T' THEN 3 WHEN 'G' THEN 4 WHEN '-' THEN 5 ELSE 6 END"
_JOIN = "CAST(coalesce(list_aggregate(list_transform(list_sort(list({{'o': {o}, 'b': {b}}})), lambda x: x.b), 'string_agg', ''), '') AS VARCHAR)"


def _joined(o: str, b: str) -> str:
    return _JOIN.format(o=o, b=b)


PARTS = {
    "traits": "SELECT 1 + l_partkey % 81 AS s, CASE WHEN l_suppkey%10<6 THEN 0 WHEN l_suppkey%10<9 THEN 1 ELSE 2 END AS hap, CASE WHEN l_orderkey%50=0 THEN l_orderkey%40 ELSE -1 END AS err, l_linenumber%3=0 AS gap FROM lineitem",
    "raw": f"SELECT CAST(s AS INT) AS start_pos, array_to_string(list_transform(range(0,40), lambda o: CASE WHEN gap AND o BETWEEN 16 AND 23 THEN '.' ELSE {_BASE} END), '') AS seq FROM traits",
    "reads": "SELECT start_pos, seq, count(*) AS cnt FROM raw GROUP BY ALL",
    "numbered": "SELECT *, CAST(row_number() OVER (ORDER BY start_pos, seq) - 1 AS BIGINT) AS read_id FROM reads",
    "bases": "SELECT *, CAST(start_pos + off - 1 AS INT) AS pos, substr(seq, CAST(off AS INT) + 1, 1) AS base FROM (SELECT *, CAST(unnest(range(length(seq))) AS INT) AS off FROM reads)",
    "piled": "SELECT pos, " + ", ".join(f"CAST(sum(CASE WHEN base='{b}' THEN cnt ELSE 0 END) AS BIGINT) AS {n}" for b, n in (("A", "n_a"), ("C", "n_c"), ("G", "n_g"), ("T", "n_t"), ("-", "n_gap"))) + ", CAST(sum(CASE WHEN base IN ('A','C','G','T','-') THEN cnt ELSE 0 END) AS BIGINT) AS depth, CAST(sum(CASE WHEN base IN ('A','C','G','T','-') THEN 0 ELSE cnt END) AS BIGINT) AS n_dot FROM bases GROUP BY pos",
    "ent": "SELECT *, round(-(" + " + ".join(f"CASE WHEN depth>0 AND {n}>0 THEN ({n}/depth)*log2({n}/depth) ELSE 0 END" for n in ("n_a", "n_c", "n_g", "n_t", "n_gap")) + ")/2.32192809, 9) + 0.0 AS entropy, CASE greatest(n_a,n_c,n_g,n_t,n_gap) WHEN n_a THEN 'A' WHEN n_c THEN 'C' WHEN n_g THEN 'G' WHEN n_t THEN 'T' ELSE '-' END AS mode FROM piled",
    "variants": "SELECT CAST(row_number() OVER (ORDER BY pos) - 1 AS INT) AS vi, pos, entropy, mode FROM ent WHERE entropy >= 0.03445",
    "fixed": f"SELECT start_pos, seq, cnt, {_joined('off', 'nb')} AS corrected_seq FROM (SELECT b.*, CASE WHEN base='.' OR e.mode IS NULL THEN base ELSE e.mode END AS nb FROM bases b LEFT JOIN (SELECT pos, mode FROM ent WHERE entropy < 0.03445) e USING (pos)) GROUP BY start_pos, seq, cnt",
    "corrected": "SELECT start_pos, corrected_seq AS seq, CAST(sum(cnt) AS BIGINT) AS cnt FROM fixed GROUP BY ALL",
    "cbases": "SELECT *, CAST(start_pos + off - 1 AS INT) AS pos, substr(seq, off + 1, 1) AS base FROM (SELECT *, CAST(unnest(range(length(seq))) AS INT) AS off FROM corrected)",
    "post": "SELECT pos, count(DISTINCT base) AS n, max(base) AS b FROM cbases WHERE base<>'.' GROUP BY pos",
    "comp": f"SELECT start_pos, seq, cnt, min(vi) AS cstart, max(vi) AS cend, {_joined('vi', 'base')} AS cseq FROM cbases JOIN (SELECT vi, pos FROM variants) USING (pos) GROUP BY start_pos, seq, cnt",
    "compacted": "SELECT cstart, cend, cseq, CAST(sum(cnt) AS BIGINT) AS cnt FROM comp GROUP BY ALL",
    "haps": f"SELECT CAST(hap AS INT) AS hap_id, array_to_string(list_transform(range(0,120), lambda o: {_BASE}), '') AS seq FROM (SELECT unnest(range(3)) AS hap, 1 AS s, -1 AS err)",
    "hbases": "SELECT hap_id, CAST(pos AS INT) AS pos, substr(seq, CAST(pos AS INT)+1, 1) AS base FROM (SELECT hap_id, seq, unnest(range(120)) AS pos FROM haps)",
    "chaps": f"SELECT hap_id, {_joined('vi', 'base')} AS cseq FROM hbases JOIN variants USING (pos) GROUP BY hap_id",
    "edges": "SELECT vi, substr(mer,1,3) AS src, substr(mer,2) AS dst, CAST(sum(cnt) AS BIGINT) AS w FROM (SELECT CAST(cstart+i AS INT) AS vi, substr(cseq, CAST(i AS INT)+1, 4) AS mer, cnt FROM (SELECT *, unnest(range(0, length(cseq)-3)) AS i FROM compacted)) WHERE mer NOT LIKE '%.%' GROUP BY vi, mer",
    "roots": "SELECT e.vi, e.src AS node, CAST(sum(e.w) AS BIGINT) AS w FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges f WHERE f.vi+1=e.vi AND f.dst=e.src) GROUP BY e.vi, e.src",
    "pruned": "SELECT vi, src, dst, w FROM (SELECT *, max(w) OVER (PARTITION BY vi, src) AS top FROM edges WHERE w >= 2) WHERE w >= 0.01*top",
    "begun": "SELECT vi, node FROM roots WHERE w >= (SELECT round(0.2*avg(w), 9) FROM roots)",
    "matched": "SELECT c.cstart, c.cend, c.cseq, c.cnt, h.hap_id, CAST(len(list_filter(range(length(c.cseq)), lambda i: substr(c.cseq, i+1, 1)=substr(h.cseq, c.cstart+i+1, 1))) AS INT) AS n_match, CAST(len(list_filter(range(length(c.cseq)), lambda i: substr(c.cseq, i+1, 1)<>substr(h.cseq, c.cstart+i+1, 1) AND substr(c.cseq, i+1, 1)<>'.')) AS INT) AS n_mismatch FROM compacted c, chaps h",
    "matrix": "SELECT cstart, cend, cseq, cnt, hap_id FROM matched WHERE n_mismatch=0 AND length(cseq)>=2",
    "supp": "SELECT cstart, cseq, cnt, hap_id, p FROM (SELECT *, CAST(unnest(range(cstart+2, least(cend-2, 19)+1)) AS INT) AS p FROM matched WHERE n_mismatch=0 AND n_match>=4 AND length(cseq)>=5) WHERE substr(cseq, p-cstart+1, 1)<>'.' OR (replace(substr(cseq,1,p-cstart),'.','')<>'' AND replace(substr(cseq,p-cstart+2),'.','')<>'')",
    "full_m": "SELECT h.hap_id, s.p, CAST(coalesce(sum(cnt),0) AS BIGINT) AS support FROM (SELECT hap_id FROM chaps) h CROSS JOIN (SELECT CAST(unnest(range(2,18)) AS INT) AS p) s LEFT JOIN supp u ON u.hap_id=h.hap_id AND u.p=s.p GROUP BY ALL",
    "totals": "SELECT p, CAST(sum(cnt) AS BIGINT) AS total FROM (SELECT DISTINCT cstart, cseq, cnt, p FROM supp) GROUP BY p",
    "yvec": "SELECT cstart, cseq, round(cnt / sum(cnt) OVER (PARTITION BY cstart, cend), 9) AS y FROM (SELECT DISTINCT cstart, cend, cseq, cnt FROM matrix)",
    "shares": "SELECT * FROM (VALUES (0, 0.6::DOUBLE), (1, 0.3::DOUBLE), (2, 0.1::DOUBLE)) v(hap_id, h)",
    "dist": "SELECT r.start_pos, r.seq, r.cnt, h.hap_id, CAST(len(list_filter(range(length(r.seq)), lambda i: substr(r.seq,i+1,1)<>substr(h.seq, r.start_pos+i, 1) AND substr(r.seq,i+1,1)<>'.')) AS INT) AS dist FROM reads r, haps h",
    "nearest": "SELECT start_pos, seq, cnt, hap_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY start_pos, seq ORDER BY dist, hap_id) AS r FROM dist) WHERE r=1",
    "grid": "SELECT CAST((w-a)//20 AS INT) AS window_id, CAST(w AS INT) AS w_start, CAST(w+50 AS INT) AS w_end FROM (SELECT a, unnest(range(a, b+1, 20)) AS w FROM (SELECT min(start_pos) AS a, max(start_pos) AS b FROM reads))",
    "members": "SELECT window_id, r.* FROM numbered r JOIN grid g ON (length(seq) - greatest(0, w_start-start_pos) - greatest(0, start_pos+length(seq)-w_end)) / length(seq) > 0.75",
    "wsites": "SELECT window_id, w_start, w_end, min(vi) AS f_start, max(vi) AS f_end FROM grid JOIN variants ON pos+1>=w_start AND pos+1<w_end GROUP BY ALL",
    "mbases": "SELECT m.window_id, m.read_id, m.cnt, vi, base FROM members m JOIN bases b USING (start_pos, seq) JOIN variants v ON v.pos=b.pos JOIN wsites s ON s.window_id=m.window_id WHERE base<>'.' AND vi BETWEEN f_start AND f_end",
    "assigned": "SELECT window_id, read_id, CASE WHEN read_id%7=0 THEN 3 ELSE hap_id END AS class_id FROM members JOIN nearest USING (start_pos, seq)",
    "consensus": f"SELECT window_id, class_id, vi, base FROM (SELECT *, row_number() OVER (PARTITION BY window_id, class_id, vi ORDER BY n DESC, {_CLUSTER_RANK}) AS r FROM (SELECT window_id, class_id, vi, base, sum(cnt) AS n FROM mbases JOIN assigned USING (window_id, read_id) GROUP BY ALL)) WHERE r=1",
    "sizes": "SELECT window_id, class_id, sum(cnt) AS size FROM assigned JOIN members USING (window_id, read_id) GROUP BY ALL",
    "fits": "SELECT c_custkey AS fit_id, CAST(1+c_custkey%9 AS INT) AS k, round((c_custkey*7919%10007)/10007.0::DOUBLE/10 + 2.0::DOUBLE/(1+c_custkey%9), 9) AS cost FROM customer",
    "best": "SELECT fit_id, k, cost FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY cost, fit_id) AS r FROM fits) WHERE r=1",
    "diffs": "SELECT pos FROM ent WHERE entropy>=0.005 EXCEPT SELECT pos FROM post WHERE n>1",
    "frags": "SELECT start_pos, seq, count(*) AS cnt FROM (SELECT s1 AS start_pos, CASE WHEN s1%10=0 THEN replace(q1, 'N', '-') ELSE replace(q1 || repeat('.', CAST(greatest(s2-s1-length(q1),0) AS INT)) || CASE WHEN s1+length(q1)-s2>=length(q2) THEN '' ELSE substr(q2, greatest(s1+length(q1)-s2,0)+1) END, 'N', '-') END AS seq FROM mates) GROUP BY ALL",
    "fdist": "SELECT r.start_pos, r.seq, r.cnt, h.hap_id, CAST(len(list_filter(range(length(r.seq)), lambda i: substr(r.seq,i+1,1)<>substr(h.seq, r.start_pos+i, 1) AND substr(r.seq,i+1,1)<>'.')) AS INT) AS dist FROM frags r, haps h",
    "fnearest": "SELECT start_pos, seq, cnt, hap_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY start_pos, seq ORDER BY dist, hap_id) AS r FROM fdist) WHERE r=1",
    "profile": "SELECT pos, hap_id, CAST(sum(CASE WHEN b.base=h.base THEN 1 ELSE 0 END) AS BIGINT) AS n_match, CAST(sum(CASE WHEN b.base<>h.base THEN 1 ELSE 0 END) AS BIGINT) AS n_mismatch, CAST(sum(CASE WHEN b.base=h.base AND n.dist=0 THEN 1 ELSE 0 END) AS BIGINT) AS n_exact FROM nearest n JOIN bases b USING (start_pos, seq) JOIN hbases h USING (hap_id, pos) WHERE b.base<>'.' GROUP BY pos, hap_id",
    "mates": "SELECT start_pos AS s1, substr(seq,1,20) AS q1, start_pos+10+start_pos%21 AS s2, replace(substr(seq, 11+start_pos%21, 20),'.','N') AS q2, cnt FROM reads",
}

_SHARE = "round(({m} + (w_end-w_start-(f_end-f_start+1))*{n}) / ((w_end-w_start)*{n}), 9)"

QUERIES = {
    "read_scan": "SELECT * FROM raw",
    "read_dedup": "SELECT * FROM reads",
    "read_ids": "SELECT * FROM numbered",
    "read_bases": "SELECT * FROM bases",
    "read_length_range": "SELECT CAST(min(length(seq)) AS INT) AS min_len, CAST(max(length(seq)) AS INT) AS max_len FROM reads",
    "pileup": "SELECT * FROM piled",
    "site_entropy": "SELECT pos, depth, entropy FROM ent",
    "site_mode": "SELECT pos, mode, depth FROM ent",
    "variant_sites": "SELECT * FROM variants",
    "entropy_corrected_reads": "SELECT * FROM fixed",
    "correction_flags": "SELECT start_pos, seq, corrected_seq<>seq AS changed FROM fixed",
    "variant_sites_post": "SELECT CAST(row_number() OVER (ORDER BY pos)-1 AS INT) AS vi, pos, n AS n_bases FROM post WHERE n>1",
    "shared_bases": "SELECT CAST(i AS INT) AS pos, CASE WHEN n>1 THEN '_' ELSE b END AS base FROM (SELECT unnest(range(120)) AS i) LEFT JOIN post ON pos=i",
    "position_diff": "SELECT * FROM diffs",
    "raw_read_filter": "SELECT * FROM reads r WHERE NOT EXISTS (SELECT 1 FROM bases x JOIN diffs USING (pos) JOIN post p USING (pos) WHERE p.n=1 AND x.base<>'.' AND x.base<>p.b AND x.start_pos=r.start_pos AND x.seq=r.seq)",
    "mate_merge": "SELECT start_pos, seq, CAST(sum(cnt) AS BIGINT) AS cnt FROM (SELECT s1 AS start_pos, replace(q1 || repeat('.', CAST(greatest(s2-s1-length(q1),0) AS INT)) || CASE WHEN s1+length(q1)-s2>=length(q2) THEN '' ELSE substr(q2, greatest(s1+length(q1)-s2,0)+1) END, 'N', '-') AS seq, cnt FROM mates UNION ALL SELECT s1, q1, cnt FROM mates WHERE s1%10=0) GROUP BY ALL",
    "gap_bounds": "SELECT start_pos, seq, CAST(instr(seq,'.')-1 AS INT) AS dot_start, CAST(CASE WHEN instr(seq,'.')>0 THEN length(seq)-instr(reverse(seq),'.') ELSE -1 END AS INT) AS dot_end FROM reads",
    "compact_reads": "SELECT * FROM comp",
    "compact_range": "SELECT start_pos, seq, min(vi) AS cstart, max(vi) AS cend FROM bases LEFT JOIN variants USING (pos) GROUP BY start_pos, seq",
    "compact_dedup": "SELECT * FROM compacted",
    "split_reads": """SELECT cstart, CAST(cstart+length(cseq)-1 AS INT) AS cend, cseq, CAST(sum(cnt) AS BIGINT) AS cnt FROM (
      SELECT s AS cstart, regexp_extract(body, '^[^.]+') AS cseq, cnt FROM b
      UNION ALL SELECT CAST(s+length(body)-length(regexp_extract(body, '^[^.]+\\.+(.*)$', 1)) AS INT), regexp_extract(body, '^[^.]+\\.+(.*)$', 1), cnt FROM b) WHERE cseq<>'' GROUP BY cstart, cseq""",
    "region_reads": "SELECT cstart, cend, cseq, cnt, CAST(10-greatest(0,cstart-5)-greatest(0,15-(cstart+length(cseq))) AS INT) AS overlap FROM compacted WHERE 10-greatest(0,cstart-5)-greatest(0,15-(cstart+length(cseq)))>=4",
    "compact_haplotypes": "SELECT * FROM chaps",
    "asof_variant": "SELECT CAST(x AS INT) AS x, coalesce((SELECT min(vi) FROM variants WHERE pos>=x), (SELECT max(vi) FROM variants)) AS vi FROM (SELECT unnest(range(125)) AS x)",
    "raw_lineage": f"SELECT cstart, cseq, start_pos, seq FROM (SELECT start_pos, seq, min(vi) AS cstart, {_joined('vi', 'base')} AS cseq FROM bases JOIN (SELECT vi, pos FROM variants) USING (pos) GROUP BY start_pos, seq) JOIN (SELECT start_pos, seq FROM fixed WHERE corrected_seq=seq) USING (start_pos, seq)",
    "kmer_edges": "SELECT * FROM edges",
    "graph_roots": "SELECT * FROM roots",
    "root_threshold": "SELECT count(*) AS n_roots, round(avg(w),9) AS mean_w, round(0.2*avg(w),9) AS border FROM roots",
    "edge_prune": "SELECT * FROM pruned",
    "branch_positions": "SELECT DISTINCT CAST(p.vi+3 AS INT) AS vi FROM (SELECT vi, src FROM pruned GROUP BY vi, src HAVING count(*)>1) p JOIN (SELECT DISTINCT vi, node FROM walk) w ON w.vi=p.vi AND w.node=p.src",
    "branch_positions_all_ways": "SELECT DISTINCT CAST(p.vi+3 AS INT) AS vi FROM (SELECT vi, src FROM edges GROUP BY vi, src HAVING count(*)>1) p JOIN (SELECT DISTINCT vi, node FROM walk) w ON w.vi=p.vi AND w.node=p.src",
    "path_counts": "SELECT CAST(vi AS INT) AS vi, node, count(*) AS n_paths FROM walk GROUP BY vi, node",
    "path_ends": "SELECT CAST(vi AS INT) AS vi, node, count(*) AS n_paths FROM walk GROUP BY vi, node",
    "region_split": """SELECT CAST(a AS INT) AS first_site, CAST(b AS INT) AS last_site, n_paths FROM counted c WHERE (n_paths<=2 OR b-a+1<8)
      AND NOT EXISTS (SELECT 1 FROM counted o WHERE o.a<=c.a AND o.b>=c.b AND (o.a<c.a OR o.b>c.b) AND (o.n_paths<=2 OR o.b-o.a+1<8))""",
    "local_haplotypes": "SELECT seq, CAST(length(seq) AS INT) AS n_sites FROM walk WHERE vi+2=19 AND length(seq)=20",
    "global_haplotypes": "SELECT a.s || b.s AS seq FROM (SELECT DISTINCT substr(cseq,1,10) AS s FROM chaps) a, (SELECT DISTINCT substr(cseq,11,10) AS s FROM chaps) b",
    "haplotype_product": "SELECT CAST(2 AS BIGINT) AS n_regions, CAST(count(DISTINCT substr(cseq,1,10))*count(DISTINCT substr(cseq,11,10)) AS BIGINT) AS product FROM chaps",
    "compact_match": "SELECT cstart, cseq, cnt, hap_id, n_match, n_mismatch FROM matched",
    "match_matrix": "SELECT cstart, cseq, hap_id FROM matrix",
    "support_matrix": "SELECT hap_id, p, CAST(sum(cnt) AS BIGINT) AS support FROM supp GROUP BY hap_id, p",
    "total_extension": "SELECT * FROM totals",
    "local_consistency": "SELECT DISTINCT hap_id FROM full_m WHERE hap_id NOT IN (SELECT hap_id FROM (SELECT *, avg(support) OVER (PARTITION BY p) AS mean FROM full_m) WHERE support < 0.01*mean)",
    "flow_consistency": """SELECT DISTINCT hap_id FROM full_m WHERE hap_id NOT IN (SELECT hap_id FROM (
      SELECT *, lag(support) OVER (PARTITION BY hap_id ORDER BY p) AS b, lead(support) OVER (PARTITION BY hap_id ORDER BY p) AS a, max(support) OVER (PARTITION BY p) AS t FROM full_m)
      WHERE support<2 OR coalesce((support-b)/nullif(b,0) < -0.99, false) OR (b IS NOT NULL AND (coalesce((support-t)/nullif(t,0) < -0.99, false) OR coalesce((support-a)/nullif(a,0) < -0.99, false))))""",
    "read_fraction": "SELECT * FROM yvec",
    "fit_cost": "SELECT round(sum((y-coalesce(f,0))*(y-coalesce(f,0))), 6) AS cost FROM yvec LEFT JOIN (SELECT cstart, cseq, sum(h) AS f FROM matrix JOIN shares USING (hap_id) GROUP BY cstart, cseq) USING (cstart, cseq)",
    "credibility_score": "SELECT f.hap_id, round(least(1.0, min(CASE WHEN support < h*coalesce(total,0) THEN 1+(support-h*coalesce(total,0))/nullif(h*coalesce(total,0),0) ELSE 1.0 END)), 9) AS score FROM full_m f LEFT JOIN totals USING (p) JOIN shares s ON s.hap_id=f.hap_id GROUP BY f.hap_id",
    "haplotype_sets": "SELECT haps, count(*) AS n, round(sum(y), 9) AS sy, round(sum(y*y), 9) AS syy FROM (SELECT cstart, cseq, string_agg(hap_id, ',' ORDER BY hap_id) AS haps FROM matrix GROUP BY cstart, cseq) JOIN yvec USING (cstart, cseq) GROUP BY haps",
    "gram_matrix": "SELECT p.hap_id AS a, q.hap_id AS b, count(*) AS g FROM matrix p JOIN matrix q USING (cstart, cseq) GROUP BY ALL",
    "bucket_best": "SELECT * FROM best",
    "elbow_pick": "SELECT k, fit_id, cost FROM best WHERE k = (SELECT coalesce(min(CASE WHEN cost > 0.9*b THEN k END), max(k)) FROM (SELECT *, lag(cost) OVER (ORDER BY k) AS b FROM best))",
    "read_hap_distance": "SELECT * FROM dist",
    "nearest_haplotype": "SELECT * FROM nearest",
    "distance_histogram": "SELECT dist, hap_id, CAST(sum(cnt) AS BIGINT) AS cnt FROM nearest GROUP BY dist, hap_id",
    "nearest_confusion": """SELECT hap_before, hap_after, CAST(sum(cnt) AS BIGINT) AS cnt, CAST(sum(CASE WHEN hap_before<>hap_after THEN cnt ELSE 0 END) AS BIGINT) AS n_changed FROM (
      SELECT n.cnt, n.hap_id AS hap_before, (SELECT h.hap_id FROM haps h ORDER BY len(list_filter(range(length(f.corrected_seq)), lambda i: substr(f.corrected_seq,i+1,1)<>substr(h.seq, f.start_pos+i, 1) AND substr(f.corrected_seq,i+1,1)<>'.')), h.hap_id LIMIT 1) AS hap_after
      FROM nearest n JOIN fixed f USING (start_pos, seq)) GROUP BY ALL""",
    "mismatch_profile": "SELECT pos, hap_id, CAST(sum(CASE WHEN b.base=h.base THEN 1 ELSE 0 END) AS BIGINT) AS n_match, CAST(sum(CASE WHEN b.base<>h.base THEN 1 ELSE 0 END) AS BIGINT) AS n_mismatch FROM nearest n JOIN bases b USING (start_pos, seq) JOIN hbases h USING (hap_id, pos) WHERE b.base<>'.' GROUP BY pos, hap_id",
    "length_buckets": "SELECT CASE WHEN length(replace(seq,'.',''))<33 THEN 33 WHEN length(replace(seq,'.',''))<37 THEN 37 ELSE 41 END AS bucket, CAST(sum(cnt) AS BIGINT) AS cnt, CAST(sum(CASE WHEN dist=0 THEN cnt ELSE 0 END) AS BIGINT) AS n_exact FROM nearest GROUP BY 1",
    "diversity": "SELECT round(avg(d),9)+0.0 AS mean_dist, round(avg(d/20),9)+0.0 AS per_base FROM (SELECT len(list_filter(range(20), lambda i: substr(a.seq,i+1,1)<>substr(b.seq,i+1,1))) AS d FROM walk a, walk b WHERE a.vi+2=19 AND b.vi+2=19 AND a.seq<b.seq)",
    "fragment_length_buckets": "SELECT CASE WHEN length(seq)<25 THEN 25 WHEN length(seq)<35 THEN 35 ELSE 45 END AS bucket, CAST(sum(cnt) AS BIGINT) AS cnt, CAST(sum(CASE WHEN dist=0 THEN cnt ELSE 0 END) AS BIGINT) AS n_exact FROM fnearest WHERE start_pos>=20 AND start_pos+length(seq)<=100 GROUP BY 1",
    "distance_histogram_region": "SELECT dist, hap_id, CAST(sum(cnt) AS BIGINT) AS cnt FROM nearest WHERE start_pos>=20 AND start_pos+length(seq)<=100 AND dist<100 GROUP BY dist, hap_id",
    "mismatch_profile_exact": "SELECT pos, hap_id, n_exact AS n_match, n_mismatch FROM profile",
    "odd_sites": "SELECT pos, hap_id, n_match, n_mismatch FROM profile WHERE pos BETWEEN 20 AND 99 AND pos IN (SELECT pos FROM profile WHERE n_mismatch>n_match OR n_mismatch>3)",
    "sam_fragments": "SELECT * FROM frags",
    "window_votes": "SELECT m.window_id, m.start_pos, m.seq, b.off, c.base FROM members m JOIN bases b USING (start_pos, seq) JOIN variants v ON v.pos=b.pos JOIN assigned a ON a.window_id=m.window_id AND a.read_id=m.read_id JOIN consensus c ON c.window_id=m.window_id AND c.class_id=a.class_id AND c.vi=v.vi WHERE b.base<>'.'",
    "site_report": "SELECT e.pos, entropy, n_dot, " + ", ".join(f"CAST(sum(CASE WHEN hap_id={h} THEN n.cnt ELSE 0 END) AS BIGINT) AS n_h{h}" for h in range(3)) + ", CAST(sum(CASE WHEN dist>0 THEN n.cnt ELSE 0 END) AS BIGINT) AS n_far FROM ent e JOIN bases b USING (pos) JOIN nearest n USING (start_pos, seq) GROUP BY e.pos, entropy, n_dot",
    "window_grid": "SELECT * FROM grid",
    "window_membership": "SELECT window_id, start_pos, seq, cnt FROM members",
    "class_consensus": "SELECT * FROM consensus",
    "class_merge": f"SELECT window_id, haplotype, min(class_id) AS class_id, CAST(sum(size) AS BIGINT) AS cnt FROM (SELECT window_id, class_id, {_joined('vi', 'b')} AS haplotype FROM (SELECT s.window_id, c.class_id, s.vi, coalesce(k.base,'*') AS b FROM (SELECT window_id, CAST(unnest(range(f_start, f_end+1)) AS INT) AS vi FROM wsites) s JOIN (SELECT DISTINCT window_id, class_id FROM consensus) c USING (window_id) LEFT JOIN consensus k ON k.window_id=s.window_id AND k.class_id=c.class_id AND k.vi=s.vi) GROUP BY window_id, class_id) JOIN sizes USING (window_id, class_id) GROUP BY window_id, haplotype",
    "class_mode": "SELECT window_id, read_id, class_id FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY n DESC, f) AS r FROM (SELECT 0 AS window_id, read_id, CAST((read_id*7+t*(read_id%3))%4 AS INT) AS class_id, count(*) AS n, min(t) AS f FROM (SELECT read_id, unnest(range(5)) AS t FROM numbered) GROUP BY ALL)) WHERE r=1",
    "theta_update": "SELECT window_id, " + _SHARE.format(m="sum(m)", n="count(*)") + " AS theta FROM (SELECT b.window_id, b.read_id, sum(CASE WHEN b.base=c.base THEN 1 ELSE 0 END) AS m FROM mbases b JOIN assigned a USING (window_id, read_id) JOIN consensus c ON c.window_id=b.window_id AND c.class_id=a.class_id AND c.vi=b.vi GROUP BY ALL) JOIN wsites USING (window_id) GROUP BY window_id, w_start, w_end, f_start, f_end",
    "gamma_update": "SELECT window_id, " + _SHARE.format(m="sum(CASE WHEN c.base=h.base THEN 1 ELSE 0 END)", n="count(DISTINCT class_id)") + " AS gamma FROM consensus c JOIN variants v USING (vi) JOIN hbases h ON h.hap_id=0 AND h.pos=v.pos JOIN wsites USING (window_id) GROUP BY window_id, w_start, w_end, f_start, f_end",
    "class_logweight": "SELECT window_id, read_id, class_id, round(ln(l) + coalesce(m,0)*ln(0.98::DOUBLE) + coalesce(d,0)*ln(0.02::DOUBLE/4), 9) AS logweight FROM (SELECT m.window_id, m.read_id, s.class_id, s.size - CASE WHEN a.class_id=s.class_id THEN m.cnt ELSE 0 END AS l FROM members m JOIN assigned a USING (window_id, read_id) JOIN sizes s USING (window_id)) LEFT JOIN (SELECT b.window_id, b.read_id, c.class_id, sum(CASE WHEN b.base=c.base THEN 1 ELSE 0 END) AS m, sum(CASE WHEN b.base<>c.base THEN 1 ELSE 0 END) AS d FROM mbases b JOIN consensus c USING (window_id, vi) GROUP BY ALL) USING (window_id, read_id, class_id) WHERE l>0",
    "majority_vote": f"SELECT start_pos, seq, cnt, {_joined('off', 'nb')} AS voted_seq FROM (SELECT b.*, coalesce(v.base, b.base) AS nb FROM bases b LEFT JOIN (SELECT start_pos, seq, off, base FROM (SELECT *, row_number() OVER (PARTITION BY start_pos, seq, off ORDER BY n DESC, {_CLUSTER_RANK}) AS r FROM (SELECT m.start_pos, m.seq, b.off, c.base, count(*) AS n FROM members m JOIN bases b USING (start_pos, seq) JOIN variants v ON v.pos=b.pos JOIN assigned a ON a.window_id=m.window_id AND a.read_id=m.read_id JOIN consensus c ON c.window_id=m.window_id AND c.class_id=a.class_id AND c.vi=v.vi WHERE b.base<>'.' GROUP BY ALL)) WHERE r=1) v USING (start_pos, seq, off)) GROUP BY start_pos, seq, cnt",
}

#: Parts that only one query uses.
LOCAL = {
    "split_reads": {"b": "SELECT CAST(cstart+length(cseq)-length(ltrim(cseq,'.')) AS INT) AS s, trim(cseq,'.') AS body, cnt FROM compacted WHERE trim(cseq,'.')<>''"},
    "branch_positions": {"walk": "SELECT vi, node, node AS seq FROM begun UNION ALL SELECT e.vi+1, e.dst, w.seq || right(e.dst,1) FROM walk w JOIN pruned e ON e.vi=w.vi AND e.src=w.node"},
}
LOCAL["branch_positions_all_ways"] = {"walk": LOCAL["branch_positions"]["walk"].replace("FROM begun", "FROM roots", 1)}
LOCAL["path_counts"] = LOCAL["branch_positions_all_ways"]
LOCAL["path_ends"] = {"walk": "SELECT DISTINCT vi+1 AS vi, dst AS node FROM pruned WHERE vi+3=19 UNION ALL SELECT e.vi, e.src FROM walk w JOIN pruned e ON e.vi+1=w.vi AND e.dst=w.node"}
LOCAL["region_split"] = {
    "walk": "SELECT 0 AS a, 19 AS b UNION ALL SELECT CASE WHEN s=0 THEN a ELSE (a+b)//2+1 END, CASE WHEN s=0 THEN (a+b)//2 ELSE b END FROM walk, (SELECT unnest([0, 1]) AS s) WHERE b-a+1>=8",
    "ownroots": "SELECT a, b, e.vi, e.src AS node, sum(e.w) AS w FROM walk JOIN edges e ON e.vi BETWEEN a AND b-3 WHERE e.vi=a OR NOT EXISTS (SELECT 1 FROM edges f WHERE f.vi+1=e.vi AND f.dst=e.src) GROUP BY ALL",
    "stepped": "SELECT a, b, vi, node FROM ownroots o WHERE vi=a AND w>=(SELECT round(0.2*avg(w), 9) FROM ownroots i WHERE i.a=o.a AND i.b=o.b) UNION ALL SELECT s.a, s.b, e.vi+1, e.dst FROM stepped s JOIN pruned e ON e.vi=s.vi AND e.src=s.node WHERE e.vi<=s.b-3",
    "counted": "SELECT w.a, w.b, count(s.node) AS n_paths FROM walk w LEFT JOIN stepped s ON s.a=w.a AND s.b=w.b AND s.vi=w.b-2 GROUP BY w.a, w.b",
}
LOCAL["local_haplotypes"] = LOCAL["diversity"] = {"walk": LOCAL["branch_positions"]["walk"].replace("FROM begun", "FROM begun WHERE vi=0", 1)}


def _sql(name: str) -> str:
    parts = PARTS | LOCAL.get(name, {})
    order: list[str] = []

    def need(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN|,)\s+(\w+)", text)):
            if word in parts and word not in order and word not in going:
                going.add(word)
                need(parts[word])
                order.append(word)

    going: set[str] = set()
    need(QUERIES[name])
    return "WITH RECURSIVE " + ",\n".join(f"{x} AS {'' if x in ('walk', 'stepped') else 'MATERIALIZED '}({parts[x]})" for x in order) + "\n" + QUERIES[name] if order else QUERIES[name]


SQL = {name: _sql(name) for name in QUERIES}
