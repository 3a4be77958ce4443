"""The catalogue's queries in DuckDB's SQL.

Recursive searches are bounded: 16 levels, and 48 rounds of shortest paths. ``BOUNDS`` has queries that count what one round more
would change; the tests ask for 0.
"""

from __future__ import annotations

_LINE = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
PART = f"""
lines AS (SELECT *, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {_LINE}) AS src FROM lineitem),
e AS (SELECT row_number() OVER (ORDER BY l_orderkey, {_LINE}, src) - 1 AS eid, src, l_partkey AS dst, CAST(l_quantity AS INT) AS weight FROM lines WHERE src IS NOT NULL),
v AS (SELECT DISTINCT l_partkey AS id FROM lineitem),
deg AS (SELECT v.id, count(e.src) AS degree FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id)"""
ORDER = """
o AS (SELECT o_orderkey AS dst, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS src FROM orders),
e AS (SELECT src, dst, (src * 1103515245 + dst * 12345 + 528) % 1000 AS weight FROM o WHERE src IS NOT NULL),
v AS (SELECT o_orderkey AS id FROM orders),
deg AS (SELECT v.id, count(e.src) AS degree FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id)"""
SUPP = """
one AS (SELECT l_partkey * 2 AS a, l_suppkey * 2 + 1 AS b, CAST(l_quantity AS INT) AS weight FROM lineitem),
e AS (SELECT a AS src, b AS dst, weight FROM one UNION ALL SELECT b, a, weight FROM one),
v AS (SELECT a AS id FROM one UNION SELECT b FROM one),
deg AS (SELECT v.id, count(e.src) AS degree FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id)"""
ROOT = "root AS (SELECT id FROM deg ORDER BY degree DESC, id LIMIT 1)"
BFS = f"""{ROOT},
b AS (SELECT id, 0 AS level FROM root UNION SELECT e.dst, b.level + 1 FROM b JOIN e ON e.src = b.id WHERE b.level < 16),
lev AS (SELECT id, min(level) AS level FROM b GROUP BY id)"""


def _sssp(weight: str = "weight", rounds: int = 48) -> str:
    return f"""{ROOT},
w AS (SELECT src, dst, CAST(min({weight}) AS DOUBLE) AS w FROM e GROUP BY src, dst UNION ALL SELECT id, id, 0.0 FROM v),
s AS (SELECT 0 AS it, v.id, CASE WHEN v.id = root.id THEN 0.0 ELSE 1e9 END AS d FROM v, root
  UNION ALL SELECT s.it + 1, w.dst, min(least(s.d + w.w, 1e9)) FROM s JOIN w ON w.src = s.id WHERE s.it < {rounds} GROUP BY s.it, w.dst),
dist AS (SELECT id, CAST(d AS DOUBLE) AS distance FROM s WHERE it = {rounds})"""


def _rank(steps: int) -> str:
    return f"""m AS (SELECT src, dst, count(*) AS n FROM e GROUP BY src, dst),
p AS (SELECT m.src, m.dst, CAST(m.n AS DOUBLE) / deg.degree AS p FROM m JOIN deg ON deg.id = m.src UNION ALL SELECT id, id, 0.0 FROM v),
r AS (SELECT 0 AS it, id, CAST(1.0 AS DOUBLE) AS rank FROM v
  UNION ALL SELECT r.it + 1, p.dst, 0.15 + 0.85 * sum(r.rank * p.p) FROM r JOIN p ON p.src = r.id WHERE r.it < {steps} GROUP BY r.it, p.dst),
ranks AS (SELECT id, rank FROM r WHERE it = {steps})"""


_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
LAYOUT = f"""
vi AS (SELECT id, degree, row_number() OVER (ORDER BY id) - 1 AS i, coalesce(sum(degree) OVER (ORDER BY id {_BEFORE}), 0) AS start FROM deg),
vd AS (SELECT id, degree, row_number() OVER (ORDER BY degree DESC, id) - 1 AS i, coalesce(sum(greatest(degree - 16, 0)) OVER (ORDER BY degree DESC, id {_BEFORE}), 0) AS over16 FROM deg),
k AS (SELECT eid, src, dst, weight, row_number() OVER (PARTITION BY src ORDER BY eid DESC) - 1 AS k FROM e),
csr AS (SELECT eid, src, dst, weight, CAST(vi.start + k AS BIGINT) AS slot FROM k JOIN vi ON vi.id = k.src)"""
REPLICA = """
ep AS (SELECT DISTINCT src, dst, CAST(src % 4 AS INT) AS sp, CAST(dst % 4 AS INT) AS dp FROM e),
r0 AS (SELECT DISTINCT dp AS part, src AS id, 0 AS hop FROM ep WHERE sp <> dp),
r1 AS (SELECT DISTINCT r0.part, ep.src AS id, 1 AS hop FROM ep JOIN r0 ON r0.id = ep.dst
  WHERE ep.sp <> r0.part AND NOT EXISTS (SELECT 1 FROM r0 x WHERE x.part = r0.part AND x.id = ep.src)),
rep AS (SELECT * FROM r0 UNION ALL SELECT * FROM r1),
route AS (SELECT CAST(id % 4 AS INT) AS owner, part, id, hop FROM rep)"""

PLACES = """
loc AS (SELECT id, row_number() OVER (PARTITION BY id % 4 ORDER BY id) - 1 AS local FROM v),
own AS (SELECT CAST(id % 4 AS INT) AS part, count(*) AS n FROM v GROUP BY 1),
phys AS (SELECT rep.part, rep.id, n + row_number() OVER (PARTITION BY rep.part ORDER BY hop, rep.id) - 1 AS physical FROM rep JOIN own USING (part))"""
_REPLICA_EDGES = "SELECT CAST(dst % 4 AS INT) AS part, 0 AS hop, count(*) AS n FROM e WHERE src % 4 <> dst % 4 GROUP BY 1 UNION ALL SELECT r0.part, 1, count(*) FROM e JOIN r0 ON r0.id = e.dst GROUP BY r0.part"
_STORED = "SELECT part, count(*) AS n FROM (SELECT CAST(dst % 4 AS INT) AS part FROM e UNION ALL SELECT r0.part FROM e JOIN r0 ON r0.id = e.dst) x GROUP BY part"


def _draw(x: str, below: str) -> str:
    lcg = lambda y: f"(({y}) * 1103515245 + 12345) % 2147483648"
    return f"((({lcg(lcg(f'({x}) % 2147483648'))}) >> 8) % {below})"


def _with(*parts: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{', '.join(parts)} {select}"


_POS = f"pos AS (SELECT id, {_draw('id', '1000')} AS x, {_draw('id + 7', '1000')} AS y FROM v)"
_ZIPF = "z AS (SELECT range AS id, pow(range + 1, -1.1) AS p FROM range(1000)), zd AS (SELECT id, CAST(floor(20000.0 * p / (SELECT sum(p) FROM z) + 0.5) AS BIGINT) AS degree FROM z)"
_BIP = (
    f"s AS (SELECT range AS id, {_draw('range', '2')} AS side FROM range(1000)), q AS (SELECT id, side, row_number() OVER (PARTITION BY side ORDER BY id) - 1 AS r FROM s), "
    f"n AS (SELECT count(*) FILTER (side = 0) AS n0, count(*) FILTER (side = 1) AS n1 FROM s), "
    f"ab AS (SELECT {_draw('range * 2 + 1', 'n0')} AS a, {_draw('range * 2 + 2', 'n1')} AS b FROM range(3000), n), "
    "pairs AS (SELECT x.id AS src, y.id AS dst FROM ab JOIN q x ON x.side = 0 AND x.r = ab.a JOIN q y ON y.side = 1 AND y.r = ab.b)"
)

ORACLE: dict[str, str] = {
    "out_degree": _with(PART, select="SELECT id, degree FROM deg"),
    "in_degree": _with(PART, select="SELECT v.id, count(e.dst) AS degree FROM v LEFT JOIN e ON e.dst = v.id GROUP BY v.id"),
    "max_degree_vertex": _with(PART, select="SELECT id, degree FROM deg ORDER BY degree DESC, id LIMIT 1"),
    "degree_stats": _with(ORDER, select="SELECT max(degree) AS max_degree, min(degree) AS min_degree, round(avg(degree), 6) AS avg_degree, round(stddev_pop(degree), 6) AS stddev_degree FROM deg"),
    "sink_vertices": _with(ORDER, select="SELECT count(*) AS n FROM deg WHERE degree = 0"),
    "triplets_src": _with(PART, select="SELECT src, dst, weight, degree AS src_degree FROM e JOIN deg ON deg.id = e.src"),
    "triplets": _with(PART, select="SELECT src, dst, weight, a.degree AS src_degree, b.degree AS dst_degree FROM e JOIN deg a ON a.id = e.src JOIN deg b ON b.id = e.dst"),
    "reverse_graph": _with(SUPP, select="SELECT dst AS src, src AS dst, weight FROM e"),
    "bipartite_undirected": _with(SUPP, select="SELECT src, dst, weight FROM e"),
    "emv_edge": _with(PART, select="SELECT dst AS id, degree + weight AS val FROM e JOIN deg ON deg.id = e.src WHERE degree >= 20"),
    "emv_vertex": _with(PART, select="SELECT deg.id, degree, degree * 2 + coalesce(m, 0) AS score FROM deg LEFT JOIN (SELECT dst, max(weight) AS m FROM e GROUP BY dst) x ON x.dst = deg.id"),
    "emv_message": _with(PART, select="SELECT dst AS id, CAST(CASE WHEN weight > 25 THEN weight * 2 ELSE weight END AS BIGINT) AS val FROM e"),
    "emv_edgelist": _with(PART, select="SELECT src AS id, CAST(sum(i * weight) AS BIGINT) AS val FROM (SELECT src, weight, row_number() OVER (PARTITION BY src ORDER BY dst, weight) AS i FROM e) x GROUP BY src"),
    "emv_edgelist_all": _with(ORDER, select="SELECT v.id, CAST(coalesce(sum(i * weight), 0) * 10 + count(i) AS BIGINT) AS val FROM v LEFT JOIN (SELECT src, weight, row_number() OVER (PARTITION BY src ORDER BY dst, weight) AS i FROM e) x ON x.src = v.id GROUP BY v.id"),
    "emv_edgelist_stored": _with(PART, LAYOUT, select="SELECT id, CAST(coalesce(sum((k + 1) * weight), 0) AS BIGINT) AS val FROM v LEFT JOIN k ON k.src = v.id GROUP BY id"),
    "combine_min": _with(ORDER, select="SELECT v.id, coalesce(min(weight), 1000000000) AS val FROM v LEFT JOIN e ON e.dst = v.id GROUP BY v.id"),
    "combine_max": _with(PART, select="SELECT v.id, CAST(coalesce(max(weight), -1) AS BIGINT) AS val FROM v LEFT JOIN e ON e.dst = v.id GROUP BY v.id"),
    "combine_sum": _with(ORDER, select="SELECT v.id, CAST(coalesce(sum(weight), 0) AS BIGINT) AS val FROM v LEFT JOIN e ON e.dst = v.id GROUP BY v.id"),
    "combine_count": _with(PART, select="SELECT v.id, count(e.dst) AS val FROM v LEFT JOIN e ON e.dst = v.id GROUP BY v.id"),
    "combine_product": _with(ORDER, select="SELECT v.id, coalesce(product(CAST(weight AS DOUBLE)), 1.0) AS val FROM v LEFT JOIN e ON e.dst = v.id GROUP BY v.id"),
    "message_list": _with(PART, select="SELECT dst AS id, count(*) AS n, string_agg(CAST(weight AS VARCHAR), ',' ORDER BY weight) AS vals FROM e GROUP BY dst"),
    "segmented_scan_min": _with(PART, LAYOUT, select="SELECT dst, slot, CAST(min(weight) OVER (PARTITION BY dst ORDER BY slot) AS BIGINT) AS val FROM csr"),
    "segmented_scan_sum": _with(PART, LAYOUT, select="SELECT dst, slot, CAST(sum(weight) OVER (PARTITION BY dst ORDER BY slot) AS BIGINT) AS val FROM csr"),
    "frontier_v2e": _with(PART, select="SELECT src, dst FROM e WHERE src % 100 = 7"),
    "frontier_e2v": _with(PART, select="SELECT DISTINCT dst AS id FROM e WHERE src % 100 = 7"),
    "frontier_v2e_all": _with(PART, select="SELECT src, dst FROM e"),
    "frontier_e2v_all": _with(PART, select="SELECT DISTINCT dst AS id FROM e"),
    "bfs_levels": _with(PART, BFS, select="SELECT v.id, coalesce(level, -1) AS level FROM v LEFT JOIN lev ON lev.id = v.id", recursive=True),
    "bfs_levels_bipartite": _with(SUPP, BFS.replace("SELECT e.dst", "SELECT DISTINCT e.dst"), select="SELECT v.id, coalesce(level, -1) AS level FROM v LEFT JOIN lev ON lev.id = v.id", recursive=True),
    "bfs_reached": _with(PART, BFS, select="SELECT count(*) AS n FROM lev", recursive=True),
    "bfs_steps": _with(PART, BFS, select="SELECT CAST(max(level) + 1 AS BIGINT) AS steps FROM lev", recursive=True),
    "bfs_frontier": _with(PART, BFS, select="SELECT level, count(*) AS vertices, CAST(sum(degree) AS BIGINT) AS edges FROM lev JOIN deg ON deg.id = lev.id GROUP BY level", recursive=True),
    "bfs_edges_traversed": _with(PART, BFS, select="SELECT CAST(sum(degree) AS BIGINT) AS n FROM lev JOIN deg ON deg.id = lev.id", recursive=True),
    "sssp_dist": _with(PART, _sssp(), select="SELECT id, distance FROM dist", recursive=True),
    "sssp_dist_dense": _with(PART, _sssp(), select="SELECT id, distance FROM dist", recursive=True),
    "sssp_lcg": _with(PART, _sssp("(src * 1103515245 + dst * 12345 + 528) % 1000"), select="SELECT id, distance FROM dist", recursive=True),
    "sssp_total": _with(PART, _sssp(), select="SELECT sum(distance) AS total, count(*) AS reached FROM dist WHERE distance < 1e9", recursive=True),
    "sssp_steps": _with(PART, _sssp(), "t AS (SELECT it, sum(d) AS d FROM s GROUP BY it)", select="SELECT CAST(min(it) + 1 AS BIGINT) AS steps FROM t WHERE d = (SELECT d FROM t WHERE it = 48)", recursive=True),
    "sssp_selfcheck": "SELECT CAST(0 AS BIGINT) AS differing",
    "pagerank_10": _with(PART, _rank(10), select="SELECT id, round(rank, 6) AS rank FROM ranks", recursive=True),
    "pagerank_10_sinks": _with(ORDER, _rank(10), select="SELECT id, round(rank, 6) AS rank FROM ranks", recursive=True),
    "pagerank_100": _with(PART, _rank(100), select="SELECT id, round(rank, 6) AS rank FROM ranks", recursive=True),
    "pagerank_total": _with(ORDER, _rank(100), select="SELECT round(sum(rank), 4) AS total FROM ranks", recursive=True),
    "layout_csr": _with(PART, LAYOUT, select="SELECT eid, src, dst, slot FROM csr"),
    "layout_ell": _with(PART, LAYOUT, select="SELECT eid, src, dst, i + k * (SELECT count(*) FROM v) AS slot FROM k JOIN vi ON vi.id = k.src"),
    "layout_meg": _with(PART, LAYOUT, f"c AS (SELECT k, coalesce(sum(n) OVER (ORDER BY k {_BEFORE}), 0) AS start FROM (SELECT k, count(*) AS n FROM k GROUP BY k) x)", select="SELECT eid, src, dst, CAST(i + c.start AS BIGINT) AS slot FROM k JOIN vd ON vd.id = k.src JOIN c ON c.k = k.k"),
    "layout_hy": _with(PART, LAYOUT, select="SELECT eid, src, dst, CAST(CASE WHEN k < 16 THEN i + k * (SELECT count(*) FROM v) ELSE 16 * (SELECT count(*) FROM v) + over16 + k - 16 END AS BIGINT) AS slot FROM k JOIN vd ON vd.id = k.src"),
    "layout_msgslot": _with(PART, LAYOUT, select="SELECT eid, src, dst, slot, row_number() OVER (ORDER BY dst, slot) - 1 AS message_slot, CAST(row_number() OVER (PARTITION BY dst ORDER BY slot) = 1 AS INT) AS head FROM csr"),
    "relabel_by_degree": _with(PART, LAYOUT, select="SELECT eid, a.i AS src, b.i AS dst FROM e JOIN vd a ON a.id = e.src JOIN vd b ON b.id = e.dst"),
    "partition_sizes": _with(ORDER, select="SELECT CAST(id % 4 AS INT) AS part, count(*) AS n FROM v GROUP BY 1"),
    "replica_counts": _with(ORDER, REPLICA, select="SELECT part, hop, count(*) AS n FROM rep GROUP BY part, hop"),
    "replica_edges": _with(ORDER, REPLICA, select=_REPLICA_EDGES),
    "stored_edges": _with(ORDER, REPLICA, select=_STORED),
    "routing_table": _with(ORDER, REPLICA, select="SELECT owner, part, id, hop FROM route"),
    "replica_segments": _with(ORDER, REPLICA, "c AS (SELECT owner, part, count(*) AS n FROM route GROUP BY owner, part)", select=f"SELECT owner, part, n, CAST(coalesce(sum(n) OVER (PARTITION BY owner ORDER BY part {_BEFORE}), 0) AS BIGINT) AS gather_start, CAST(coalesce(sum(n) OVER (PARTITION BY part ORDER BY owner {_BEFORE}), 0) AS BIGINT) AS scatter_start FROM c"),
    "replica_gather": _with(ORDER, REPLICA, "din AS (SELECT v.id, count(e.dst) AS degree FROM v LEFT JOIN e ON e.dst = v.id GROUP BY v.id)", select="SELECT part, rep.id, CASE WHEN hop = 0 THEN din.degree ELSE -1 END AS degree FROM rep JOIN din ON din.id = rep.id"),
    "gather_table": _with(ORDER, REPLICA, PLACES, select="SELECT owner, row_number() OVER (PARTITION BY owner ORDER BY route.part, hop, route.id) - 1 AS place, route.part, route.id, hop, local FROM route JOIN loc ON loc.id = route.id"),
    "scatter_table": _with(ORDER, REPLICA, PLACES, select="SELECT part, row_number() OVER (PARTITION BY part ORDER BY owner, hop, id) - 1 AS place, owner, id, hop, physical FROM route JOIN phys USING (part, id)"),
    "replica_index": _with(ORDER, REPLICA, "c AS (SELECT part, hop, count(*) AS n FROM rep GROUP BY part, hop)", select=f"SELECT part, hop, n, CAST(coalesce(sum(n) OVER (PARTITION BY part ORDER BY hop {_BEFORE}), 0) AS BIGINT) AS start FROM c"),
    "replica_edge_index": _with(ORDER, REPLICA, f"c AS ({_REPLICA_EDGES})", select=f"SELECT part, hop, n, CAST(coalesce(sum(n) OVER (PARTITION BY part ORDER BY hop {_BEFORE}), 0) AS BIGINT) AS start FROM c"),
    "partition_file": _with(ORDER, select="SELECT id + 1 AS id, CAST(id % 4 AS INT) AS part FROM v"),
    "load_partitioned": _with(ORDER, REPLICA, f"stored AS ({_STORED})", select="SELECT p.part, p.vertices, coalesce(r.replicas, 0) AS replicas, coalesce(s.n, 0) AS edges FROM (SELECT CAST(id % 4 AS INT) AS part, count(*) AS vertices FROM v GROUP BY 1) p LEFT JOIN (SELECT part, count(*) AS replicas FROM rep GROUP BY part) r USING (part) LEFT JOIN stored s USING (part)"),
    "bipartite_file": _with(_BIP, select="SELECT src + 1 AS src, dst + 1 AS dst, CAST(1 AS DOUBLE) AS weight FROM pairs UNION ALL SELECT dst + 1, src + 1, 1.0 FROM pairs"),
    "gen_random": f"SELECT src, {_draw('src * 9 + k', '1000')} AS dst FROM (SELECT range AS src, unnest(range(1, 2 + {_draw('range', '8')})) AS k FROM range(1000)) x",
    "gen_bipartite": _with(_BIP, select="SELECT src, dst FROM pairs UNION ALL SELECT dst, src FROM pairs"),
    "gen_zipf_degrees": _with(_ZIPF, select="SELECT id, degree FROM zd"),
    "gen_zipf": _with(_ZIPF, select=f"SELECT src, {_draw('src * 31 + k', '1000')} AS dst FROM (SELECT id AS src, unnest(range(0, degree)) AS k FROM zd) x"),
    "gt_read": _with(PART, select="SELECT src + 1 AS src, dst + 1 AS dst, CAST(weight AS DOUBLE) AS weight FROM e"),
    "render_quads": _with(PART, _POS, select="SELECT id, c.corner, CAST(x + c.dx AS DOUBLE) AS x, CAST(y + c.dy AS DOUBLE) AS y FROM pos, (VALUES (0, -5, 4), (1, 4, 4), (2, 4, -5), (3, -5, -5)) c(corner, dx, dy)"),
    "render_segments": _with(PART, _POS, select="SELECT src, dst, CAST(a.x AS DOUBLE) AS x0, CAST(a.y AS DOUBLE) AS y0, CAST(b.x AS DOUBLE) AS x1, CAST(b.y AS DOUBLE) AS y1 FROM e JOIN pos a ON a.id = e.src JOIN pos b ON b.id = e.dst"),
}

BOUNDS: dict[str, str] = {
    f"bfs {name}": _with(part, BFS, select="SELECT count(*) AS n FROM lev JOIN e ON e.src = lev.id LEFT JOIN lev x ON x.id = e.dst WHERE x.id IS NULL", recursive=True)
    for name, part in (("part", PART), ("supp", SUPP.replace("e AS (SELECT a AS src", "e AS (SELECT DISTINCT a AS src")))
} | {
    f"sssp {weight}": _with(PART, _sssp(weight), select="SELECT count(*) AS n FROM dist JOIN w ON w.src = dist.id JOIN dist x ON x.id = w.dst WHERE least(dist.distance + w.w, 1e9) < x.distance", recursive=True)
    for weight in ("weight", "(src * 1103515245 + dst * 12345 + 528) % 1000")
}
