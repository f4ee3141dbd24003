"""DuckDB equivalents of the queries, by name."""

from __future__ import annotations

from accessgeo.functions.roads import SPEEDS

PIXELS = """
px0 AS (SELECT p_partkey AS id, p_size, coalesce(q, 0) AS q, coalesce(n, 0) AS n, coalesce(s, 0) AS s FROM part LEFT JOIN
  (SELECT l_partkey, sum(l_quantity)::BIGINT AS q, count(*) AS n, sum(l_linenumber)::BIGINT AS s FROM lineitem GROUP BY 1) ON l_partkey = p_partkey),
px AS (SELECT id, (id // 50)::INT AS row, (id % 50)::INT AS col, (q % 101) / 100.0::DOUBLE AS p_post, ((n * 7 + p_size) % 101) / 100.0::DOUBLE AS p_pre, (p_size % 25)::DOUBLE AS hand, (s % 30)::DOUBLE AS slope,
  (q % 13 - 8)::DOUBLE AS dvv, (s % 11 - 6)::DOUBLE AS dvh, id % 17 = 0 AS stream, id % 23 <> 0 AS valid FROM px0),
cl AS (SELECT *, valid AND p_post >= 0.6 AS water_post, valid AND p_pre >= 0.6 AS water_pre, hand <= 15 AND slope <= 20 AS plausible, valid AND (dvv <= -3 OR dvh <= -3) AS support FROM px),
cm AS (SELECT *, water_post AND water_pre AS preexisting, water_post AND NOT water_pre AS new_water, water_post AND NOT water_pre AND NOT plausible AS excluded FROM cl),
cells AS (SELECT *, CASE WHEN new_water AND plausible AND support AND p_post >= 0.8 AND p_pre < 0.2 THEN 3 WHEN new_water AND plausible AND (support OR p_post >= 0.8) THEN 2 WHEN new_water AND plausible THEN 1 ELSE 0 END AS tier FROM cm)
"""
FILLED = """
zn AS (SELECT a.row, a.col, count(*) AS n FROM px a JOIN px b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY 1, 2),
zz AS (SELECT row, col, (row::BIGINT * 4294967296 + col) AS node, hand AS z, n < 9 AS border, max(hand) OVER () AS top FROM px JOIN zn USING (row, col)),
ne AS (SELECT a.node AS u, b.node AS v, b.z, b.border FROM zz a JOIN zz b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND a.node <> b.node),
ff(n, f) USING KEY (n) AS (SELECT node, CASE WHEN border THEN z ELSE top END FROM zz UNION SELECT e.v, min(greatest(e.z, ff.f)) FROM ff JOIN ne e ON e.u = ff.n JOIN recurring.ff r ON r.n = e.v WHERE NOT e.border AND greatest(e.z, ff.f) < r.f GROUP BY e.v)
"""
COMPONENTS = """
wet AS (SELECT row, col, tier, (row::BIGINT * 4294967296 + col) AS node FROM cells WHERE tier > 0),
we AS (SELECT a.node AS u, b.node AS v FROM wet a JOIN wet b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND a.node <> b.node),
cc(n, l) USING KEY (n) AS (SELECT node, node FROM wet UNION SELECT e.v, min(cc.l) FROM cc JOIN we e ON e.u = cc.n JOIN recurring.cc r ON r.n = e.v WHERE cc.l < r.l GROUP BY e.v),
lab AS (SELECT w.row, w.col, w.tier, cc.l AS comp FROM wet w JOIN cc ON cc.n = w.node)
"""
ROADS = f"""
mem AS (SELECT o_custkey * 10 + o_orderkey % 10 AS u, o_custkey * 10 + o_orderkey % 10 + 1 + o_orderkey % 7 AS v, o_orderkey AS k, t.twin FROM orders, (VALUES (0), (1)) t(twin) WHERE t.twin = 0 OR o_orderkey % 4 = 0),
members AS (SELECT least(u, v) AS a, greatest(u, v) AS b, k * 2 + twin AS member_id, (100 + k % 900 + 50 * twin) AS length_m, {list(SPEEDS)}[k % 15 + 1] AS highway, ((100 + k % 900 + 50 * twin) * 3600 // {list(SPEEDS.values())}[k % 15 + 1])::BIGINT AS travel_ms,
  ((k + twin) // 7) % 9 = 0 AS hit, (1 + (k // 11) % 3)::INT AS tier, k % 5 = 0 AS is_bridge FROM mem),
links AS (SELECT a || '-' || b AS link_id, a, b, min(travel_ms) AS travel_ms, arg_min(member_id, (travel_ms, member_id)) AS fastest, arg_min(length_m, (travel_ms, member_id)) AS length_m, arg_min(hit, (travel_ms, member_id)) AS fastest_hit, count(*) AS members,
  string_agg(DISTINCT member_id, ',' ORDER BY member_id) AS member_ids, bool_or(is_bridge) AS is_bridge, max(tier) AS tier_max, bool_and(hit) AS all_hit, bool_or(hit) AS any_hit, coalesce(min(tier) FILTER (hit), 0) AS evidence_tier,
  bool_and(hit AND tier >= 2) AS lost_likely, bool_and(hit AND tier >= 1) AS lost_possible FROM members GROUP BY a, b),
surv AS (SELECT s.name AS scenario, a, b, min(travel_ms) AS travel_ms, arg_min(member_id, (travel_ms, member_id)) AS fastest, count(*) AS members FROM members, (VALUES ('likely', 2), ('possible', 1), ('baseline', 9)) s(name, t) WHERE NOT (hit AND tier >= s.t) GROUP BY 1, 2, 3),
nodes AS (SELECT a AS node FROM links UNION SELECT b FROM links)
"""
PLACES = """
subjects AS (SELECT 's' || c_custkey AS osm_id, c_custkey * 10 AS loc, (c_custkey % 100) * 100 AS x, (c_custkey // 100) * 100 AS y, CASE WHEN c_custkey % 3 = 0 AND c_mktsegment = 'BUILDING' THEN 'town' WHEN c_custkey % 2 = 0 THEN 'village' ELSE 'hamlet' END AS place FROM customer),
dest AS (SELECT 'h' || s_suppkey AS osm_id, s_suppkey * 30 + s_suppkey % 4 AS loc, CASE WHEN s_suppkey % 4 < 2 THEN 'hospital' ELSE 'clinic' END AS class FROM supplier
  UNION ALL SELECT osm_id, loc, 'town' FROM subjects WHERE place = 'town')
"""
ACCESS = """
se AS (SELECT scenario, a AS u, b AS v FROM surv UNION ALL SELECT scenario, b, a FROM surv),
sn AS (SELECT s.name AS scenario, node FROM nodes, (VALUES ('baseline'), ('likely'), ('possible')) s(name)),
sc(s, n, l) USING KEY (s, n) AS (SELECT scenario, node, node FROM sn UNION SELECT e.scenario, e.v, min(sc.l) FROM sc JOIN se e ON e.u = sc.n AND e.scenario = sc.s JOIN recurring.sc r ON r.n = e.v AND r.s = e.scenario WHERE sc.l < r.l GROUP BY 1, 2),
comp AS (SELECT s AS scenario, n AS node, l AS comp FROM sc),
reach AS (SELECT c.scenario, s.osm_id, count(*) FILTER (d.class = 'hospital' AND d.osm_id <> s.osm_id) > 0 AS hospital, count(*) FILTER (d.class = 'town' AND d.osm_id <> s.osm_id) > 0 AS town, count(*) FILTER (d.class = 'clinic' AND d.osm_id <> s.osm_id) > 0 AS clinic
  FROM subjects s JOIN comp c ON c.node = s.loc JOIN comp c2 ON c2.scenario = c.scenario AND c2.comp = c.comp JOIN dest d ON d.loc = c2.node GROUP BY 1, 2),
wide AS (SELECT s.osm_id, s.loc, s.place, n.node IS NOT NULL AS snapped, """ + ", ".join(f"coalesce({x}.{k}, false) AS {x}_{k}" for x in ("baseline", "likely", "possible") for k in ("hospital", "town", "clinic")) + """
  FROM subjects s LEFT JOIN nodes n ON n.node = s.loc """ + " ".join(f"LEFT JOIN reach {x} ON {x}.osm_id = s.osm_id AND {x}.scenario = '{x}'" for x in ("baseline", "likely", "possible")) + """),
isolated AS (SELECT *, baseline_hospital AND NOT likely_hospital AS lost_h, baseline_town AND NOT likely_town AS lost_t, CASE WHEN NOT snapped THEN 'UNCERTAIN' WHEN (baseline_hospital AND NOT likely_hospital) OR (baseline_town AND NOT likely_town) THEN 'CUT OFF'
  WHEN (baseline_hospital AND NOT possible_hospital) OR (baseline_town AND NOT possible_town) THEN 'UNCERTAIN' WHEN NOT baseline_hospital OR NOT baseline_town THEN 'UNCERTAIN' ELSE 'CONNECTED' END AS status FROM wide)
"""
BUILDINGS = """
near_house AS (SELECT o_orderkey, arg_min(s.loc, ((o_custkey % 100) * 100 + o_orderkey % 90 - s.x) ** 2 + ((o_custkey // 100) * 100 + o_orderkey % 70 - s.y) ** 2 + s.loc / 1e9) AS loc FROM orders JOIN subjects s
  ON s.x BETWEEN (o_custkey % 100) * 100 + o_orderkey % 90 - 150 AND (o_custkey % 100) * 100 + o_orderkey % 90 + 150 AND s.y BETWEEN (o_custkey // 100) * 100 + o_orderkey % 70 - 150 AND (o_custkey // 100) * 100 + o_orderkey % 70 + 150
  WHERE ((o_custkey % 100) * 100 + o_orderkey % 90 - s.x) ** 2 + ((o_custkey // 100) * 100 + o_orderkey % 70 - s.y) ** 2 <= 22500 GROUP BY 1),
buildings AS (SELECT s.osm_id, count(h.loc) AS buildings FROM subjects s LEFT JOIN near_house h ON h.loc = s.loc GROUP BY 1)
"""
LABELS = """
lab AS (SELECT d.doc_id, lang AS region, CASE WHEN d.doc_id % 13 = 0 THEN NULL ELSE quality END AS label, (n_chars % 101) / 100.0::DOUBLE AS prob, n_chars % 101 AS prob_pct FROM documents d JOIN labels USING (doc_id)),
known AS (SELECT * FROM lab WHERE label IS NOT NULL)
"""
SCENES = """
sc AS (SELECT 'i' || o_orderkey AS id, o_orderdate::DATE AS day, (1 + o_custkey % 12)::INT AS relative_orbit, CASE WHEN o_custkey % 2 = 0 THEN 'ascending' ELSE 'descending' END AS orbit_state, (o_orderkey % 5 - 1)::INT AS w, (o_orderkey % 3 - 1)::INT AS s, (5 + o_orderkey % 8)::INT AS e, (6 + o_orderkey % 7)::INT AS n FROM orders),
grid AS (SELECT x, y FROM range(10) a(x), range(10) b(y)),
cov AS (SELECT orbit_state, relative_orbit, day, count(DISTINCT x * 10 + y) / 100.0::DOUBLE AS coverage FROM sc JOIN grid ON x >= w AND x < e AND y >= s AND y < n GROUP BY 1, 2, 3),
passes AS (SELECT orbit_state, relative_orbit, day, string_agg(DISTINCT id, ',' ORDER BY id) AS ids, count(*) AS scenes, coalesce(any_value(coverage), 0) AS coverage FROM sc LEFT JOIN cov USING (orbit_state, relative_orbit, day) GROUP BY 1, 2, 3)
"""
RATIOS = "CASE WHEN tp+fp+fn+tn > 0 THEN coalesce(tp / nullif(tp+fp+fn, 0), 0) END AS iou, CASE WHEN tp+fp+fn+tn > 0 THEN coalesce(2*tp / nullif(2*tp+fp+fn, 0), 0) END AS f1, CASE WHEN tp+fp+fn+tn > 0 THEN coalesce(tp / nullif(tp+fp, 0), 0) END AS precision, CASE WHEN tp+fp+fn+tn > 0 THEN coalesce(tp / nullif(tp+fn, 0), 0) END AS recall, CASE WHEN tp+fp+fn+tn > 0 THEN (tp+tn) / (tp+fp+fn+tn) END AS accuracy"
COUNTS = "count(*) FILTER (label = 1 AND prob >= {t}) AS tp, count(*) FILTER (label = 0 AND prob >= {t}) AS fp, count(*) FILTER (label = 1 AND prob < {t}) AS fn, count(*) FILTER (label = 0 AND prob < {t}) AS tn"
STATS = """
st AS (SELECT *, tier1_px + tier2_px + tier3_px AS flood_px FROM (SELECT """ + ", ".join(f"sum({c}::INT)::BIGINT AS {c}_px" for c in ("water_post", "water_pre", "preexisting", "new_water", "excluded", "valid")) + ", count(*) AS cells, " + ", ".join(f"sum((tier = {k})::INT)::BIGINT AS tier{k}_px" for k in (1, 2, 3)) + """, sum((hand IS NULL)::INT)::BIGINT AS hand_missing_px FROM cells)),
flags AS (SELECT code, severity FROM st, (VALUES ('mountain_valley_hand_caution', 'caution'), ('low_valid_fraction', 'caution'), ('low_valid_fraction_limiting', 'limiting'), ('no_valid_pixels', 'limiting'), ('pre_post_water_overlap_high', 'caution'), ('no_flood_detected', 'info'), ('debris_is_candidate_only', 'info'), ('domain_gap', 'caution')) f(code, severity)
  WHERE CASE code WHEN 'mountain_valley_hand_caution' THEN excluded_px / nullif(new_water_px, 0) > 0.3 WHEN 'low_valid_fraction' THEN valid_px / cells < 0.9 WHEN 'low_valid_fraction_limiting' THEN valid_px / cells < 0.6 WHEN 'no_valid_pixels' THEN valid_px = 0 WHEN 'pre_post_water_overlap_high' THEN preexisting_px / nullif(water_post_px, 0) > 0.5 WHEN 'no_flood_detected' THEN flood_px = 0 ELSE true END)
"""
SEGMENTS = """
sg0 AS (SELECT id AS seg_id, (col * 10 + 5)::DOUBLE AS x0, (row * 10 + 5)::DOUBLE AS y0, id % 13 * 10 + 15 AS n FROM px),
sg AS (SELECT seg_id, x0, y0, CASE WHEN seg_id % 3 <> 1 THEN x0 + n ELSE x0 END AS x1, CASE WHEN seg_id % 3 <> 0 THEN y0 + n ELSE y0 END AS y1 FROM sg0)
"""
EIGHT = "(VALUES (0, -1, 0), (1, -1, 1), (2, 0, 1), (3, 1, 1), (4, 1, 0), (5, 1, -1), (6, 0, -1), (7, -1, -1)) o(k, a, b)"
FLOW = f"""
z AS (SELECT row, col, hand AS z FROM px),
drops AS (SELECT z.row, z.col, m.row AS to_row, m.col AS to_col, (z.z - m.z) / CASE WHEN k % 2 = 1 THEN sqrt(2) ELSE 1 END AS d, k FROM z, {EIGHT}, z m WHERE m.row = z.row + a AND m.col = z.col + b AND m.z < z.z),
best AS (SELECT row, col, arg_max(to_row, (d, -k)) AS to_row, arg_max(to_col, (d, -k)) AS to_col FROM drops GROUP BY 1, 2),
recv AS (SELECT z.row, z.col, z.z, b.to_row, b.to_col FROM z LEFT JOIN best b USING (row, col))
"""
SP = """
re AS (SELECT scenario, a AS u, b AS v, travel_ms AS w FROM surv WHERE scenario <> 'possible' UNION ALL SELECT scenario, b, a, travel_ms FROM surv WHERE scenario <> 'possible'),
rn AS (SELECT DISTINCT scenario, u AS node FROM re),
rc AS (SELECT scenario, class, node, 0::BIGINT AS cost FROM dest JOIN rn ON rn.node = dest.loc),
seed AS (SELECT rn.scenario, c.class, rn.node, CASE WHEN EXISTS (SELECT 1 FROM rc WHERE rc.scenario = rn.scenario AND rc.class = c.class AND rc.node = rn.node) THEN 0 ELSE 1000000000000 END::BIGINT AS cost FROM rn, (VALUES ('hospital'), ('town'), ('clinic')) c(class)),
sp(s, c, n, d) USING KEY (s, c, n) AS (SELECT scenario, class, node, cost FROM seed UNION SELECT e.scenario, sp.c, e.v, min(sp.d + e.w) FROM sp JOIN re e ON e.u = sp.n AND e.scenario = sp.s JOIN recurring.sp r ON r.n = e.v AND r.s = sp.s AND r.c = sp.c WHERE sp.d + e.w < r.d GROUP BY 1, 2, 3),
cost AS MATERIALIZED (SELECT s AS scenario, c AS class, n AS node, d AS cost FROM sp WHERE d < 1000000000000)
"""


def _q(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes} {select}"


def oracle_sql() -> dict[str, str]:
    return {
        "flood_tiers": _q(PIXELS, "SELECT tier, count(*) AS pixels, count(*) * 100 / 1e6 AS km2 FROM cells GROUP BY tier"),
        "flood_statistics": _q(PIXELS + "," + STATS, "SELECT *, flood_px * 0.0001::DOUBLE AS flood_km2, preexisting_px * 0.0001::DOUBLE AS preexisting_km2, valid_px / cells AS valid_fraction, flood_px / nullif(valid_px, 0) AS flood_fraction_of_valid FROM st"),
        "flood_pixels": _q(PIXELS, "SELECT row, col, water_post, water_pre, preexisting, new_water, plausible, excluded, support, tier FROM cells"),
        "flood_components": _q(PIXELS + "," + COMPONENTS, "SELECT row, col, comp, count(*) OVER (PARTITION BY comp) AS size, count(*) OVER (PARTITION BY comp) >= 2 AS kept FROM lab", True),
        "component_statistics": _q(PIXELS + "," + COMPONENTS, "SELECT comp, count(*) AS size, max(tier) AS max_tier, quantile_cont(tier, 0.5)::DOUBLE AS median_tier FROM lab GROUP BY comp", True),
        "hole_filling": _q(PIXELS + """, dry AS (SELECT row, col, (row::BIGINT * 4294967296 + col) AS node, valid AND plausible AND NOT water_pre AS eligible FROM cells WHERE NOT p_post >= 0.3),
          de AS (SELECT a.node AS u, b.node AS v FROM dry a JOIN dry b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND a.node <> b.node),
          dc(n, l) USING KEY (n) AS (SELECT node, node FROM dry UNION SELECT e.v, min(dc.l) FROM dc JOIN de e ON e.u = dc.n JOIN recurring.dc r ON r.n = e.v WHERE dc.l < r.l GROUP BY e.v),
          ed AS (SELECT min(row) r0, max(row) r1, min(col) c0, max(col) c1 FROM cells),
          holes AS (SELECT dc.l, bool_and(eligible) AS filled FROM dry JOIN dc ON dc.n = node, ed GROUP BY dc.l HAVING count(*) < 4 AND NOT bool_or(row = r0 OR row = r1 OR col = c0 OR col = c1))""", "SELECT row, col, filled FROM dry JOIN dc ON dc.n = node JOIN holes h ON h.l = dc.l", True),
        "debris_candidates": _q(PIXELS, "SELECT row, col, dvv, dvh FROM cells c WHERE valid AND NOT water_post AND tier = 0 AND (abs(dvv) >= 3 OR abs(dvh) >= 3) AND slope BETWEEN 0 AND 15 AND EXISTS (SELECT 1 FROM cells s WHERE s.stream AND (s.row - c.row) ** 2 + (s.col - c.col) ** 2 <= 4)"),
        "lee_filtered": _q(PIXELS + """, pw AS (SELECT row, col, CASE WHEN valid THEN p_post + 0.01 END AS x FROM px), ed AS (SELECT min(row) r0, max(row) r1, min(col) c0, max(col) c1 FROM px),
          ask AS (SELECT p.row AS ar, p.col AS ac, CASE WHEN p.row + i < r0 THEN 2 * r0 - p.row - i - 1 WHEN p.row + i > r1 THEN 2 * r1 - p.row - i + 1 ELSE p.row + i END AS row, CASE WHEN p.col + j < c0 THEN 2 * c0 - p.col - j - 1 WHEN p.col + j > c1 THEN 2 * c1 - p.col - j + 1 ELSE p.col + j END AS col FROM pw p, ed, range(-2, 3) a(i), range(-2, 3) b(j)),
          bs AS (SELECT ar, ac, avg(x) AS m, greatest(avg(x * x) - avg(x) * avg(x), 0) AS v FROM ask JOIN pw USING (row, col) GROUP BY 1, 2),
          st AS (SELECT pw.row, pw.col, m, v, x FROM bs JOIN pw ON pw.row = ar AND pw.col = ac), nz AS (SELECT quantile_cont(v / (m * m), 0.25) AS c FROM st WHERE m <> 0 AND x IS NOT NULL),
          fi AS (SELECT *, greatest((v - c * m * m) / (1 + c), 0) AS sig, c * m * m AS spread FROM st, nz)""", "SELECT row, col, round(CASE WHEN x IS NOT NULL THEN m + CASE WHEN sig + spread > 0 THEN sig / (sig + spread) ELSE 0 END * (x - m) END, 6) AS power FROM fi"),
        "terrain_slope": _q(PIXELS + """, ed AS (SELECT min(row) r0, max(row) r1, min(col) c0, max(col) c1 FROM px),
          g AS (SELECT p.row, p.col, p.hand AS z, w.hand AS w, e.hand AS e, n.hand AS n, s.hand AS s FROM px p LEFT JOIN px w ON w.row = p.row AND w.col = p.col - 1 LEFT JOIN px e ON e.row = p.row AND e.col = p.col + 1 LEFT JOIN px n ON n.col = p.col AND n.row = p.row - 1 LEFT JOIN px s ON s.col = p.col AND s.row = p.row + 1),
          h AS (SELECT row, col, CASE WHEN z IS NULL THEN NULL WHEN col = c0 THEN e - z WHEN col = c1 THEN z - w ELSE (e - w) / 2 END / 10 AS gx, CASE WHEN row = r0 THEN s - z WHEN row = r1 THEN z - n ELSE (s - n) / 2 END / 10 AS gy FROM g, ed)""", "SELECT row, col, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) AS slope FROM h"),
        "flow_receivers": _q(PIXELS + "," + FLOW, "SELECT row, col, to_row, to_col FROM recv"),
        "filled_pits": _q(PIXELS + "," + FILLED, "SELECT row, col, z, f AS fill FROM zz JOIN ff ON ff.n = node", True),
        "drainage_height": _q(PIXELS + "," + FLOW + """, walk(row, col, r, c, steps) AS (SELECT row, col, row, col, 0 FROM recv UNION ALL SELECT w.row, w.col, t.to_row, t.to_col, steps + 1 FROM walk w JOIN recv t ON t.row = w.r AND t.col = w.c WHERE t.to_row IS NOT NULL),
          acc AS (SELECT r AS row, c AS col, count(*) AS cells FROM walk GROUP BY 1, 2),
          goal AS (SELECT w.row, w.col, arg_min(z.z, steps) AS z0 FROM walk w JOIN acc a ON a.row = w.r AND a.col = w.c AND a.cells >= 5 JOIN z ON z.row = w.r AND z.col = w.c GROUP BY 1, 2)""", "SELECT recv.row, recv.col, cells, cells >= 5 AS stream, CASE WHEN z0 IS NOT NULL THEN greatest(z - z0, 0) ELSE NULL END AS hand FROM recv JOIN acc USING (row, col) LEFT JOIN goal USING (row, col)", True),
        "backscatter_db": _q(PIXELS + ", db AS (SELECT row, col, CASE WHEN dvv + 6 > 0 THEN greatest(least(10 * log10((dvv + 6) / 4), 5), -35) END AS d FROM px)", "SELECT row, col, round(d, 6) AS db, round((d + 15) / 5, 6) AS scaled FROM db"),
        "quality_flags": _q(PIXELS + "," + STATS, "SELECT code, severity FROM flags"),
        "trust": _q(PIXELS + "," + STATS, "SELECT count(*) FILTER (severity = 'limiting') AS limiting, count(*) FILTER (severity = 'caution') AS caution, CASE WHEN count(*) FILTER (severity = 'limiting') > 0 THEN 'uncertain' WHEN count(*) FILTER (severity = 'caution') >= 2 THEN 'uncertain' WHEN count(*) FILTER (severity = 'caution') = 1 THEN 'probable' ELSE 'strong' END AS trust FROM flags"),
        "scene_passes": _q(SCENES, "SELECT * REPLACE (day::VARCHAR AS day) FROM passes"),
        "scene_pairs": _q(SCENES, """SELECT row_number() OVER (ORDER BY least(a.coverage, b.coverage) < 0.95, b.day - DATE '1998-06-01', DATE '1998-06-01' - a.day, orbit_state, relative_orbit, a.ids, b.ids) AS rank, orbit_state, relative_orbit, DATE '1998-06-01' - a.day AS days_before, b.day - DATE '1998-06-01' AS days_after, least(a.coverage, b.coverage) AS coverage, a.ids AS pre_ids, b.ids AS post_ids
          FROM passes a JOIN passes b USING (orbit_state, relative_orbit) WHERE a.coverage >= 0.5 AND b.coverage >= 0.5 AND a.day BETWEEN DATE '1998-04-02' AND DATE '1998-05-31' AND b.day BETWEEN DATE '1998-06-01' AND DATE '1998-06-13' QUALIFY rank <= 4"""),
        "element_duplicates": "SELECT CASE WHEN event_id % 3 = 0 THEN 'node' ELSE 'way' END AS type, event_id % 400 AS id, max(ts) AS ts, arg_max(event_id % 7, (ts, event_id % 7, event_id)) AS version, arg_max(event_id, (ts, event_id % 7, event_id)) AS event_id, count(*) AS copies, count(DISTINCT (ts, event_id % 7)) > 1 AS conflict FROM events GROUP BY 1, 2",
        "snapshot_audit": "SELECT count(*) AS elements, count(*) FILTER (ts IS NULL) AS missing, count(*) FILTER (ts > TIMESTAMP '2024-01-20') AS newer, count(ts) AS known, min(ts) AS oldest, max(ts) AS newest, count(ts) > 0 AND count(*) FILTER (ts IS NULL) = 0 AND count(*) FILTER (ts > TIMESTAMP '2024-01-20') = 0 AS verified FROM events",
        "element_tags": "SELECT event_id, coalesce(lower(CASE WHEN event_id % 400 % 5 = 0 THEN 'no' WHEN event_id % 400 % 5 < 3 THEN 'yes' END) <> 'no', false) AS bridge, TRY_CAST(CASE WHEN event_id % 400 % 7 = 0 THEN 'unknown' ELSE '1' || (props::JSON ->> 'k') END AS BIGINT) AS population FROM events",
        "polygon_exposure": _q(PIXELS + ", bx AS (SELECT id, (col * 10 + id % 9) AS x0, (row * 10 + id % 7) AS y0, col * 10 + id % 9 + 3 + id % 11 AS x1, row * 10 + id % 7 + 2 + id % 5 AS y1 FROM cells)", "SELECT bx.id AS box_id, coalesce(max(c.tier), 0) AS tier FROM bx LEFT JOIN cells c ON c.tier > 0 AND c.col BETWEEN x0 // 10 AND x1 // 10 AND c.row BETWEEN y0 // 10 AND y1 // 10 GROUP BY 1"),
        "line_exposure": _q(PIXELS + "," + SEGMENTS + """, m AS (SELECT seg_id, tier, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS len, greatest(0, CASE WHEN x1 = x0 THEN 0 ELSE least((col * 10 - x0) / (x1 - x0), (col * 10 + 10 - x0) / (x1 - x0)) END, CASE WHEN y1 = y0 THEN 0 ELSE least((row * 10 - y0) / (y1 - y0), (row * 10 + 10 - y0) / (y1 - y0)) END) AS lo,
            least(1, CASE WHEN x1 = x0 THEN 1 ELSE greatest((col * 10 - x0) / (x1 - x0), (col * 10 + 10 - x0) / (x1 - x0)) END, CASE WHEN y1 = y0 THEN 1 ELSE greatest((row * 10 - y0) / (y1 - y0), (row * 10 + 10 - y0) / (y1 - y0)) END) AS hi
            FROM sg JOIN cells ON tier > 0 AND col BETWEEN floor(least(x0, x1) / 10) AND floor(greatest(x0, x1) / 10) AND row BETWEEN floor(least(y0, y1) / 10) AND floor(greatest(y0, y1) / 10)),
          f AS (SELECT seg_id, sum((hi - lo) * len) AS flooded, max(tier) AS tier FROM m WHERE hi > lo GROUP BY 1),
          o AS (SELECT sg.seg_id, round(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2), 6) AS length, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS len, round(coalesce(flooded, 0), 6) AS flooded, coalesce(tier, 0) AS tier FROM sg LEFT JOIN f USING (seg_id))""", "SELECT seg_id, length, flooded, tier, flooded > 0 AND (flooded >= 20 OR flooded / len >= 0.1) AS hit FROM o"),
        "line_samples": _q(PIXELS + "," + SEGMENTS + """, k AS (SELECT *, greatest(ceil(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) / 5), 1)::INT AS n FROM sg), p AS (SELECT seg_id, floor((y0 + i / n * (y1 - y0)) / 10)::INT AS row, floor((x0 + i / n * (x1 - x0)) / 10)::INT AS col FROM k, LATERAL (SELECT unnest(range(n + 1)) AS i))""", "SELECT seg_id, count(*) AS samples, count(c.tier) AS wet, coalesce(quantile_cont(c.tier, 0.5), 0)::DOUBLE AS median_tier FROM p LEFT JOIN cells c ON c.tier > 0 AND c.row = p.row AND c.col = p.col GROUP BY 1"),
        "road_links": _q(ROADS, "SELECT * FROM links"),
        "scenario_links": _q(ROADS, "SELECT a, b, travel_ms, fastest, members, scenario FROM surv WHERE scenario <> 'baseline'"),
        "road_components": _q(ROADS + "," + PLACES + "," + ACCESS, "SELECT node, comp FROM comp WHERE scenario = 'baseline'", True),
        "road_summary": _q(ROADS + "," + PLACES + "," + ACCESS, "SELECT count(*) AS nodes, count(DISTINCT comp) AS components, (SELECT count(*) FROM links) AS links, (SELECT count(*) FILTER (members > 1) FROM links) AS parallel_links, (SELECT max(m) / sum(m) FROM (SELECT sum(length_m) AS m FROM links JOIN comp ON node = a AND scenario = 'baseline' GROUP BY comp)) AS largest_share FROM comp WHERE scenario = 'baseline'", True),
        "settlement_status": _q(ROADS + "," + PLACES + "," + ACCESS, "SELECT osm_id, snapped, " + ", ".join(f"{s}_{k}" for s in ("baseline", "likely", "possible") for k in ("hospital", "town", "clinic")) + ", status AS status_by_access FROM isolated", True),
        "isolated_clusters": _q(ROADS + "," + PLACES + "," + ACCESS + """, cut AS (SELECT c.comp, count(*) AS n_subjects, bool_or(lost_h) AS hospital, bool_or(lost_t) AS town, string_agg(osm_id, ',' ORDER BY osm_id) AS subjects FROM isolated i JOIN comp c ON c.scenario = 'likely' AND c.node = i.loc WHERE status = 'CUT OFF' GROUP BY 1),
          bd AS (SELECT k.comp, string_agg(DISTINCT link_id, ',' ORDER BY link_id) AS boundary FROM (SELECT link_id, x.comp AS ca, y.comp AS cb FROM links JOIN comp x ON x.scenario = 'likely' AND x.node = a JOIN comp y ON y.scenario = 'likely' AND y.node = b WHERE lost_likely AND x.comp <> y.comp) e, LATERAL (SELECT unnest([ca, cb]) AS comp) k GROUP BY 1)""", "SELECT comp, n_subjects, hospital, town, subjects, coalesce(boundary, '') AS boundary FROM cut LEFT JOIN bd USING (comp)", True),
        "damaged_links": _q(ROADS + "," + PLACES + "," + ACCESS + """, gone AS (SELECT link_id, evidence_tier, x.comp AS ca, y.comp AS cb FROM links JOIN comp x ON x.scenario = 'likely' AND x.node = a JOIN comp y ON y.scenario = 'likely' AND y.node = b WHERE lost_likely),
          back AS (SELECT g.link_id, i.osm_id, lost_h AND EXISTS (SELECT 1 FROM dest d JOIN comp z ON z.scenario = 'likely' AND z.node = d.loc WHERE d.class = 'hospital' AND d.osm_id <> i.osm_id AND z.comp IN (g.ca, g.cb)) AS h, lost_t AND EXISTS (SELECT 1 FROM dest d JOIN comp z ON z.scenario = 'likely' AND z.node = d.loc WHERE d.class = 'town' AND d.osm_id <> i.osm_id AND z.comp IN (g.ca, g.cb)) AS t
            FROM gone g JOIN comp c ON c.scenario = 'likely' AND c.comp IN (g.ca, g.cb) JOIN isolated i ON i.loc = c.node)""", "SELECT g.link_id, g.evidence_tier, count(*) FILTER (h) AS hospital, count(*) FILTER (t) AS town, count(*) FILTER (h OR t) AS count FROM gone g LEFT JOIN back USING (link_id) GROUP BY 1, 2", True),
        "nearest_routes": _q(ROADS + "," + PLACES + "," + SP + """, tight AS MATERIALIZED (SELECT e.scenario, a.class, e.u, e.v FROM re e JOIN cost a ON a.scenario = e.scenario AND a.node = e.u JOIN cost b ON b.scenario = e.scenario AND b.class = a.class AND b.node = e.v AND b.cost = a.cost + e.w),
          near_dest AS (SELECT loc, class, min(osm_id) AS osm_id FROM dest GROUP BY 1, 2),
          tgt(s, c, n, t) USING KEY (s, c, n) AS (SELECT k.scenario, k.class, k.node, coalesce(d.osm_id, '~') FROM cost k LEFT JOIN near_dest d ON d.loc = k.node AND d.class = k.class AND k.cost = 0 UNION
            SELECT e.scenario, tgt.c, e.v, min(tgt.t) FROM tgt JOIN tight e ON e.u = tgt.n AND e.scenario = tgt.s AND e.class = tgt.c JOIN recurring.tgt r ON r.s = tgt.s AND r.c = tgt.c AND r.n = e.v WHERE tgt.t < r.t GROUP BY 1, 2, 3)""", "SELECT scenario, class, node, cost, t AS target FROM cost JOIN tgt ON s = scenario AND c = class AND n = node", True),
        "detours": _q(ROADS + "," + PLACES + "," + SP + ", w AS (SELECT node, min(cost) FILTER (scenario = 'baseline') AS before, min(cost) FILTER (scenario = 'likely') AS after FROM cost WHERE class = 'hospital' GROUP BY 1), r AS (SELECT *, CASE WHEN before IS NULL OR after IS NULL THEN NULL WHEN before = 0 THEN 1.0::DOUBLE ELSE after / before END AS x FROM w)", "SELECT node, before, after, round(x, 9) AS ratio, CASE WHEN before IS NULL THEN 'unmapped' WHEN after IS NULL THEN 'none' WHEN x > 1.5 THEN 'degraded' ELSE 'full' END AS detail FROM r", True),
        "snapped_settlements": _q(ROADS + "," + PLACES + ", nd AS (SELECT node, (node % 100) * 100 AS x, (node // 100) * 100 AS y FROM nodes), pr AS (SELECT s.osm_id, (s.x + 37 - nd.x) ** 2 + (s.y - 21 - nd.y) ** 2 AS d2, node FROM subjects s JOIN nd ON abs(s.x + 37 - nd.x) <= 120 AND abs(s.y - 21 - nd.y) <= 120), bs AS (SELECT osm_id, arg_min(node, (d2, node)) AS node, min(d2) AS d2 FROM pr WHERE d2 <= 14400 GROUP BY 1)", "SELECT s.osm_id, node, round(sqrt(d2), 6) AS distance FROM subjects s LEFT JOIN bs USING (osm_id)"),
        "buildings_near": _q(PLACES + "," + BUILDINGS, "SELECT osm_id, buildings FROM buildings"),
        "confusion_by_region": _q(LABELS + ", c AS (SELECT region, " + COUNTS.format(t=0.5) + " FROM known GROUP BY ROLLUP (region))", f"SELECT *, {RATIOS} FROM c"),
        "threshold_sweep": _q(LABELS + ", c AS (SELECT k / 20.0::DOUBLE AS threshold, " + COUNTS.format(t="k / 20.0::DOUBLE") + " FROM known, range(1, 20) t(k) GROUP BY k)", f"SELECT *, {RATIOS} FROM c"),
        "best_threshold": _q(LABELS + ", c AS (SELECT k / 20.0::DOUBLE AS threshold, " + COUNTS.format(t="k / 20.0::DOUBLE") + f" FROM known, range(1, 20) t(k) GROUP BY k), r AS (SELECT *, {RATIOS} FROM c)", "SELECT arg_max(threshold, (f1, -abs(threshold - 0.5), -threshold)) AS threshold, max(f1) AS f1 FROM r"),
        "reliability_bins": _q(LABELS, "SELECT least(floor(prob * 10 + 1e-9), 9)::INT AS bin, count(*) AS n, sum(prob_pct)::BIGINT AS prob_pct, sum(label)::BIGINT AS ones FROM known GROUP BY 1"),
        "calibration_error": _q(LABELS + ", b AS (SELECT least(floor(prob * 10 + 1e-9), 9)::INT AS bin, count(*) AS n, sum(prob_pct) AS p, sum(label) AS y FROM known GROUP BY 1)", "SELECT sum(abs(p / 100 - y)) / sum(n) AS ece, sum(n)::BIGINT AS n FROM b"),
        "class_balance": _q(LABELS + ", c AS (SELECT region, count(*) FILTER (label = 1) AS water, count(*) FILTER (label = 0) AS dry, count(*) FILTER (label IS NULL) AS ignored FROM lab GROUP BY ROLLUP (region))", "SELECT *, dry / nullif(water, 0) AS pos_weight, (water + dry) / nullif(2 * dry, 0) AS weight_dry, (water + dry) / nullif(2 * water, 0) AS weight_water FROM c"),
        "channel_statistics": _q(PIXELS + ", b AS (SELECT col % 4 AS band, greatest(least(dvv * 5 - 10, 5), -35) AS x FROM px WHERE valid)", "SELECT band, round(avg(x), 6) AS mean, round(CASE WHEN stddev_pop(x) < 1e-6 THEN 1.0 ELSE stddev_pop(x) END, 6) AS std FROM b GROUP BY 1"),
        "training_loss": _q(LABELS + ", k AS (SELECT label AS y, prob AS q, greatest(least(prob, 1 - 1e-6), 1e-6) AS p FROM known)", "SELECT round(avg(CASE WHEN y = 1 THEN -1.5 * ln(p) ELSE -ln(1 - p) END), 6) AS bce, round(1 - (2 * sum(q * y) + 1e-6) / (sum(q) + sum(y) + 1e-6), 6) AS dice FROM k"),
        "extent_agreement": _q(PIXELS + ", v AS (SELECT tier > 0 AS p, new_water AND id % 3 > 0 AS r FROM cells WHERE valid), c AS (SELECT count(*) FILTER (p AND r) AS tp, count(*) FILTER (p AND NOT r) AS fp, count(*) FILTER (NOT p AND r) AS fn, count(*) FILTER (NOT p AND NOT r) AS tn FROM v)", "SELECT *, coalesce(tp / nullif(tp + fp + fn, 0), 0) AS iou, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM c"),
        "tolerant_agreement": _q(PIXELS + ", v AS (SELECT row, col, tier > 0 AS p, new_water AND id % 3 > 0 AS r FROM cells WHERE valid), c AS (SELECT count(*) FILTER (p) AS pred, count(*) FILTER (r) AS ref, count(*) FILTER (p AND EXISTS (SELECT 1 FROM v w WHERE w.r AND (w.row - v.row) ** 2 + (w.col - v.col) ** 2 <= 2.25)) AS pred_near, count(*) FILTER (r AND EXISTS (SELECT 1 FROM v w WHERE w.p AND (w.row - v.row) ** 2 + (w.col - v.col) ** 2 <= 2.25)) AS ref_near FROM v)", "SELECT *, coalesce(pred_near / nullif(pred, 0), 0) AS precision, coalesce(ref_near / nullif(ref, 0), 0) AS recall FROM c"),
        "area_windows": "SELECT o_orderkey, (o_orderdate::DATE - 60)::VARCHAR AS pre_start, (o_orderdate::DATE - 1)::VARCHAR AS pre_end, least(o_orderdate::DATE + 12, DATE '1998-06-01')::VARCHAR AS post_end, least(60, floor((o_orderkey % 360) / 6) + 1)::INT AS utm_zone FROM orders",
        "area_tiles": "WITH n AS (SELECT n_nationkey, n_nationkey * 5 % 60 AS lat, 0.1::DOUBLE + n_nationkey % 4 * 0.1::DOUBLE AS side FROM nation), k AS (SELECT n_nationkey, greatest(ceil(side * 111.32 * cos(radians(lat)) / 10), 1)::INT AS nx, greatest(ceil(side * 111.32 / 10), 1)::INT AS ny FROM n) SELECT n_nationkey, nx, ny, tile, tile // nx AS iy, tile % nx AS ix FROM k, LATERAL (SELECT unnest(range(nx * ny)) AS tile)",
        "number_trace": r"WITH s AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\b[0-9]{1,6}\b')) AS number FROM documents) SELECT doc_id, number FROM s WHERE number NOT IN (SELECT n_chars::VARCHAR FROM documents)",
        "content_keys": "SELECT n_nationkey, sha256(n_nationkey || '|' || n_name || '|' || n_regionkey) AS key FROM nation",
    }
