"""DuckDB SQL for the registered queries, written on its own: windows and recursion where the operators aggregate or iterate."""

from __future__ import annotations

from perilgrid.plans import fixtures as fx

_NUM = "try_cast(regexp_replace(trim({0}), '[,\"]', '', 'g') AS DOUBLE)"
_BLANK = "coalesce(regexp_replace(trim({0}), '[,\"]', '', 'g'), '') = ''"
_DAY = "strftime(coalesce(try_strptime(regexp_replace({0}, '[./]', '-', 'g'), '%Y-%m-%d'), try_strptime({0}, '%Y%m%d')), '%Y-%m-%d')"


def _classified(name: str, source: str) -> str:
    lat, lon = _NUM.format("lat"), _NUM.format("lon")
    return f"""{name} AS (SELECT * EXCLUDE (lat, lon), {lat} AS lat, {lon} AS lon, CASE
  WHEN {_BLANK.format("lat")} THEN '위도 값 없음' WHEN {lat} IS NULL THEN '위도 값이 숫자가 아님'
  WHEN {_BLANK.format("lon")} THEN '경도 값 없음' WHEN {lon} IS NULL THEN '경도 값이 숫자가 아님'
  WHEN {lat} NOT BETWEEN 37.34 AND 37.46 OR {lon} NOT BETWEEN 126.87 AND 127.00 THEN '안양시 좌표 범위를 벗어남' END AS reason FROM ({source}) raw)"""


def _first(by: str, source: str) -> str:
    return f"SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY _row_id) AS k FROM {source}) WHERE k = 1"


_TIDY = f"""SELECT _row_id, trim(category_no) AS category_no, trim(hazard_type) AS hazard_type, {_DAY.format("collected_at")} AS collected_at, lat, lon,
  node_link, trim(road_address) AS road_address, {_DAY.format("base_date")} AS base_date, source FROM dc WHERE reason IS NULL"""
_D = f"{_classified('dc', fx.DAMAGE)}, dt AS ({_TIDY}), damage AS MATERIALIZED ({_first('source, category_no', 'dt')})"
_Z = f"{_classified('zc', fx.ZONES)}, zk AS (SELECT * EXCLUDE (reason) FROM zc WHERE reason IS NULL), zones AS MATERIALIZED ({_first('lat, lon', 'zk')})"
_P = f"points AS (SELECT event_id AS _row_id, * EXCLUDE (event_id) FROM ({fx.POINTS}) g)"


def hav(a: str, b: str) -> str:
    la, lo, lb, lp = f"{a}.lat", f"{a}.lon", f"{b}.lat", f"{b}.lon"
    inner = f"pow(sin(radians({lb} - {la}) / 2), 2) + cos(radians({la})) * cos(radians({lb})) * pow(sin(radians({lp} - {lo}) / 2), 2)"
    return f"12742000e0 * asin(least(1e0, sqrt({inner})))"


_CENTRE = "(SELECT 0::BIGINT AS target_id, 37.3943e0 AS lat, 126.9568e0 AS lon)"
_ALLZ = "(SELECT _row_id AS target_id, lat, lon FROM zones)"


def _pairs(targets: str) -> str:
    return f"pr AS MATERIALIZED (SELECT t.target_id, d.* FROM {targets} t, damage d WHERE {hav('t', 'd')} <= 300)"


_COUNTS = "SELECT t.target_id, count(d._row_id) AS n FROM {0} t LEFT JOIN pr d ON d.target_id = t.target_id GROUP BY t.target_id"
_ROADS = "SELECT target_id, node_link AS road_key FROM (SELECT target_id, node_link, row_number() OVER (PARTITION BY target_id ORDER BY count(*) DESC, node_link) AS k FROM pr WHERE node_link IS NOT NULL GROUP BY target_id, node_link) WHERE k = 1"
_IMPORTANCE = "SELECT trim(node_link) AS key, count(*) AS count FROM damage WHERE trim(node_link) <> '' GROUP BY 1"


def _clusters(points: str) -> str:
    """CTEs up to ``labelled``: the cluster of each point, by recursion over core cells."""
    return f"""pts AS MATERIALIZED (SELECT p.*, CAST(floor(6371000e0*radians(lon)*c/37.5e0) AS BIGINT) AS cx, CAST(floor(6371000e0*radians(lat)/37.5e0) AS BIGINT) AS cy
  FROM {points} p CROSS JOIN (SELECT cos(radians(avg(lat))) AS c FROM {points}) m),
cells AS MATERIALIZED (SELECT cx, cy, count(*) AS w FROM pts GROUP BY ALL),
o AS (SELECT i.x AS dx, j.x AS dy FROM range(-4, 5) i(x), range(-4, 5) j(x) WHERE i.x * i.x + j.x * j.x <= 16),
nb AS MATERIALIZED (SELECT c.cx, c.cy, n.cx AS nx, n.cy AS ny, n.w AS nw FROM cells c, o, cells n WHERE n.cx = c.cx + o.dx AND n.cy = c.cy + o.dy),
core AS MATERIALIZED (SELECT cx, cy FROM nb GROUP BY ALL HAVING sum(nw) >= 5),
toc AS MATERIALIZED (SELECT nb.cx, nb.cy, nx, ny FROM nb JOIN core k ON k.cx = nx AND k.cy = ny),
e AS MATERIALIZED (SELECT toc.* FROM toc SEMI JOIN core USING (cx, cy)),
r(cx, cy, rx, ry) AS (SELECT cx, cy, cx, cy FROM core UNION
  SELECT e.nx, e.ny, r.rx, r.ry FROM r JOIN e ON e.cx = r.cx AND e.cy = r.cy WHERE r.rx < e.nx OR (r.rx = e.nx AND r.ry <= e.ny)),
root AS (SELECT cx, cy, min(struct_pack(x := rx, y := ry)) AS m FROM r GROUP BY cx, cy),
cl AS MATERIALIZED (SELECT cx, cy, dense_rank() OVER (ORDER BY m) - 1 AS cluster FROM root),
bd AS (SELECT toc.cx, toc.cy, min(cl.cluster) AS cluster FROM toc ANTI JOIN core USING (cx, cy) JOIN cl ON cl.cx = toc.nx AND cl.cy = toc.ny GROUP BY ALL),
labelled AS MATERIALIZED (SELECT pts.*, CAST(coalesce(x.cluster, -1) AS BIGINT) AS cluster FROM pts LEFT JOIN (SELECT * FROM cl UNION ALL SELECT * FROM bd) x USING (cx, cy))"""


_SUMMARY = """base AS (SELECT cluster, count(*) AS count, avg(lat) AS lat, avg(lon) AS lon FROM labelled WHERE cluster >= 0 GROUP BY cluster),
rd AS (SELECT cluster, road_address FROM (SELECT cluster, road_address, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, road_address) AS k
  FROM labelled WHERE cluster >= 0 AND road_address IS NOT NULL GROUP BY cluster, road_address) WHERE k = 1),
ty AS (SELECT cluster, string_agg(hazard_type, ', ' ORDER BY f) AS hazard_types FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY f) AS k
  FROM (SELECT cluster, hazard_type, min(_row_id) AS f FROM labelled WHERE cluster >= 0 AND hazard_type IS NOT NULL GROUP BY ALL)) WHERE k <= 5 GROUP BY cluster),
summary AS MATERIALIZED (SELECT cluster, count, lat, lon, coalesce(road_address, '') AS road_address, coalesce(hazard_types, '') AS hazard_types
  FROM base LEFT JOIN rd USING (cluster) LEFT JOIN ty USING (cluster))"""


def _ranked(targets: str, before: str = "") -> str:
    near = f"SELECT t.target_id, min({hav('t', 'z')}) AS m FROM tg t, zones z GROUP BY ALL"
    return f"""WITH RECURSIVE {_D}, {_Z}{before}, tg AS MATERIALIZED (SELECT * FROM {targets} x), {_pairs("tg")}, im AS MATERIALIZED ({_IMPORTANCE}),
n AS ({_COUNTS.format("tg")}), rk AS ({_ROADS}), nz AS ({near}),
s AS (SELECT tg.target_id, tg.lat, tg.lon, n.n AS n_hist, nz.m AS nearest_m, rk.road_key,
  least(100e0, n.n / 20e0 * 100) AS hd, CASE WHEN nz.m IS NULL THEN NULL WHEN nz.m >= 500 THEN 0e0 ELSE greatest(0e0, least(100e0, (1 - nz.m / 500e0) * 100)) END AS sz,
  CASE WHEN rk.road_key IS NULL OR rk.road_key = '' THEN NULL ELSE coalesce(least(100e0, im.count / (SELECT max(count) FROM im) * 100e0), 0e0) END AS ri, 0e0 AS rf
  FROM tg JOIN n USING (target_id) LEFT JOIN nz USING (target_id) LEFT JOIN rk USING (target_id) LEFT JOIN im ON im.key = trim(rk.road_key))
SELECT target_id, round(lat, 6) AS lat, round(lon, 6) AS lon, n_hist, round(nearest_m, 4) AS nearest_m, road_key, round(hd, 4) AS history_density, round(sz, 4) AS school_zone,
  round(ri, 4) AS road_importance, round(rf, 4) AS rainfall,
  round((0.30e0 * hd + coalesce(0.20e0 * sz, 0) + coalesce(0.15e0 * ri, 0) + 0.10e0 * rf) / (0.40e0 + CASE WHEN sz IS NULL THEN 0e0 ELSE 0.20e0 END + CASE WHEN ri IS NULL THEN 0e0 ELSE 0.15e0 END), 4) AS total FROM s"""


_W = {"history_density": 0.30, "photo_severity": 0.25, "school_zone": 0.20, "road_importance": 0.15, "rainfall": 0.10}
_SUMW = " + ".join(f"CASE WHEN {k} IS NULL THEN 0e0 ELSE {v}e0 END" for k, v in _W.items())
_SC = f"sc AS (SELECT *, {_SUMW} AS sw FROM ({fx.SCORES}) q)"


def _clamp(x: str) -> str:
    return f"least(100e0, greatest(0e0, {x}))"


_TOTAL = _clamp(" + ".join(f"CASE WHEN {k} IS NULL THEN 0e0 ELSE {_clamp(k)} * ({v}e0 / sw) END" for k, v in _W.items()))
_USED = "concat_ws(',', " + ", ".join(f"CASE WHEN {k} IS NOT NULL THEN '{k}' END" for k in _W) + ")"
_LEFT = "concat_ws(',', " + ", ".join(f"CASE WHEN {k} IS NULL THEN '{k}' END" for k in _W) + ")"
_COMPONENTS = " UNION ALL ".join(
    f"SELECT id, '{k}' AS component, round({_clamp(k)}, 2) * CASE WHEN {k} IS NULL THEN NULL ELSE 1 END AS score, {v}e0 AS base_weight, "
    f"CASE WHEN {k} IS NULL THEN 0e0 ELSE round({v}e0 / sw, 4) END AS effective_weight, {k} IS NOT NULL AS available FROM sc"
    for k, v in _W.items()
)

_DET = f"dets AS MATERIALIZED ({fx.DETECTIONS})"


def _iou(a: str, b: str) -> str:
    inter = f"(greatest(0e0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0e0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))"
    area = "(({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1))"
    return f"({inter} / ({area.format(a)} + {area.format(b)} - {inter}))"


def _greedy(where: str, order: str, clash: str, dets: str = _DET, columns: str = "det.det_id") -> str:
    return f"""WITH RECURSIVE {dets}, det AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {order}, det_id) AS rk FROM dets WHERE {where}),
ol AS MATERIALIZED (SELECT b.image_id, b.rk AS lo, list(a.rk) AS his FROM det a JOIN det b ON a.image_id = b.image_id AND a.rk < b.rk WHERE {_iou("a", "b")} {clash} GROUP BY ALL),
r(image_id, rk, kept) AS (SELECT image_id, 1::BIGINT, [1::BIGINT] FROM det WHERE rk = 1 UNION ALL
  SELECT d.image_id, d.rk, CASE WHEN ol.his IS NOT NULL AND list_has_any(r.kept, ol.his) THEN r.kept ELSE list_append(r.kept, d.rk) END
  FROM r JOIN det d ON d.image_id = r.image_id AND d.rk = r.rk + 1 LEFT JOIN ol ON ol.image_id = d.image_id AND ol.lo = d.rk),
l AS (SELECT image_id, unnest(kept) AS rk FROM (SELECT image_id, kept, row_number() OVER (PARTITION BY image_id ORDER BY rk DESC) AS k FROM r) WHERE k = 1)
SELECT image_id, {columns} FROM l JOIN det USING (image_id, rk)"""


_RATIO = """px AS (SELECT DISTINCT image_id, x, y FROM (SELECT image_id, unnest(range(greatest(0, CAST(round_even(x1, 0) AS BIGINT)), least(64, CAST(round_even(x2, 0) AS BIGINT)))) AS x, y1, y2 FROM dets) a,
  LATERAL (SELECT unnest(range(greatest(0, CAST(round_even(a.y1, 0) AS BIGINT)), least(64, CAST(round_even(a.y2, 0) AS BIGINT)))) AS y) b),
ratio AS (SELECT image_id, count(px.x) / 4096e0 AS ratio FROM (SELECT DISTINCT image_id FROM dets) i LEFT JOIN px USING (image_id) GROUP BY image_id)"""
_CW = "CASE class_name WHEN 'D40' THEN 1.0e0 WHEN 'D20' THEN 0.8e0 WHEN 'D10' THEN 0.6e0 WHEN 'D00' THEN 0.6e0 ELSE 0.5e0 END"
_LAST = f"last AS (SELECT inspection_id, to_status AS status FROM (SELECT *, row_number() OVER (PARTITION BY inspection_id ORDER BY changed_at DESC, id DESC) AS k FROM ({fx.EVENTS}) v) WHERE k = 1)"
_DOMAIN = "(VALUES ('접수'), ('수동검토'), ('점검예정'), ('현장확인'), ('보수필요'), ('처리완료')) dm(status)"
_RAIN = "CASE WHEN trim(fcstValue) IN ('', '강수없음', '-', 'null', 'None') THEN 0e0 WHEN fcstValue LIKE '%미만%' THEN 0.5e0 ELSE coalesce(try_cast(regexp_extract(fcstValue, '(\\d+(\\.\\d+)?)', 1) AS DOUBLE), 0e0) END"

_UNBOXED = f"""cd AS (SELECT *, count(*) OVER (PARTITION BY image_id) AS n FROM ({fx.CANDIDATES}) q),
dets AS MATERIALIZED (SELECT image_id, det_id, class_name, confidence, greatest(0e0, least(1279e0, (cx - w / 2) / 0.5e0)) AS x1, greatest(0e0, least(719e0, (cy - h / 2 - 140) / 0.5e0)) AS y1,
  greatest(0e0, least(1279e0, (cx + w / 2) / 0.5e0)) AS x2, greatest(0e0, least(719e0, (cy + h / 2 - 140) / 0.5e0)) AS y2 FROM cd WHERE n > 8 AND confidence >= 0.25)"""
_HEADERS = ("category_no", "hazard_type", "collected_at", "lat", "lon", "node_link", "road_address", "base_date")
_NULLED = ", ".join(f"CASE WHEN {c} = '' THEN NULL ELSE {c} END AS {c}" for c in _HEADERS)


def _formula() -> str:
    labels = {"history_density": "과거 파손 이력 밀도", "photo_severity": "사진상 파손 정도", "school_zone": "어린이보호구역 인접도", "road_importance": "도로구간 중요도", "rainfall": "강수 영향"}
    parts = ", ".join(f"CASE WHEN {k} IS NOT NULL THEN format('{{:.3f}} × {labels[k]}({{:.1f}})', round({v}e0 / sw, 4), round({_clamp(k)}, 2)) END" for k, v in _W.items())
    return f"CASE WHEN sw > 0 THEN concat_ws(' + ', {parts}) || format(' = {{:.2f}}', round({_TOTAL}, 2)) ELSE '사용 가능한 입력 항목이 없어 총점을 계산할 수 없습니다.' END"


def _routes(closed: bool, stops: str = fx.STOPS) -> str:
    """CTEs up to ``best`` (route_id, n, m, o): nearest neighbour, then 2-opt, one pair of places after the other."""
    last = f"{'true' if closed else 'false'} OR k < n - 1"
    change = f"m[o[i] + 1][o[k + 1] + 1] - m[o[i] + 1][o[i + 1] + 1] + CASE WHEN {last} THEN m[o[i + 1] + 1][o[(k + 1) % n + 1] + 1] - m[o[k + 1] + 1][o[(k + 1) % n + 1] + 1] ELSE 0e0 END < -1e-9"
    return f"""st AS MATERIALIZED ({stops}),
ds AS (SELECT a.route_id, a.pos AS i, b.pos AS j, CASE WHEN a.pos = b.pos THEN 0e0 ELSE {hav("a", "b")} END AS m FROM st a JOIN st b USING (route_id)),
mx AS MATERIALIZED (SELECT route_id, list(r ORDER BY i) AS m, count(*) AS n FROM (SELECT route_id, i, list(m ORDER BY j) AS r FROM ds GROUP BY ALL) q GROUP BY route_id),
nn(route_id, o) AS (SELECT route_id, [0::BIGINT] FROM mx UNION ALL
  SELECT nn.route_id, list_append(o, list_min(list_transform(list_filter(range(n), lambda x: NOT list_contains(o, x)), lambda x: {{'d': m[o[-1] + 1][x + 1], 'j': x}})).j)
  FROM nn JOIN mx USING (route_id) WHERE len(o) < n),
tw(route_id, o, i, k, moved) AS (SELECT nn.route_id, o, CASE WHEN n > 2 THEN 1 ELSE -1 END, 2::BIGINT, false FROM nn JOIN mx USING (route_id) WHERE len(o) = n UNION ALL
  SELECT route_id, CASE WHEN hit THEN o[1:i] || list_reverse(o[i + 1:k + 1]) || o[k + 2:] ELSE o END,
    CASE WHEN k < n - 1 THEN i WHEN i < n - 2 THEN i + 1 WHEN moved OR hit THEN 1 ELSE -1 END,
    CASE WHEN k < n - 1 THEN k + 1 WHEN i < n - 2 THEN i + 2 ELSE 2 END,
    CASE WHEN k < n - 1 OR i < n - 2 THEN moved OR hit ELSE false END
  FROM (SELECT tw.*, n, {change} AS hit FROM tw JOIN mx USING (route_id) WHERE i > 0) x),
best AS MATERIALIZED (SELECT tw.route_id, n, m, o FROM tw JOIN mx USING (route_id) WHERE i = -1)"""


def _shortest(closed: bool) -> str:
    """The shortest of all orders of stops, by listing them."""
    home = " + h.m" if closed else ""
    return f"""WITH RECURSIVE st AS MATERIALIZED ({fx.SOME_STOPS}),
ds AS MATERIALIZED (SELECT a.route_id, a.pos AS i, b.pos AS j, CASE WHEN a.pos = b.pos THEN 0 ELSE CAST(round_even({hav("a", "b")}, 0) AS BIGINT) END AS m FROM st a JOIN st b USING (route_id)),
p(route_id, last, seen, n, cost) AS (SELECT route_id, 0, 1, 1, 0::BIGINT FROM st WHERE pos = 0 UNION ALL
  SELECT p.route_id, ds.j, p.seen | (1 << ds.j), n + 1, cost + m FROM p JOIN ds ON ds.route_id = p.route_id AND ds.i = p.last WHERE (p.seen >> ds.j) & 1 = 0)
SELECT route_id, CAST(p.n AS INT) AS n_stops, min(cost{home}) AS total_m FROM p JOIN (SELECT route_id, count(*) AS n FROM st GROUP BY 1) c USING (route_id)
  JOIN ds h USING (route_id) WHERE p.n = c.n AND h.i = p.last AND h.j = 0 GROUP BY 1, 2"""


_SOLVER = "CASE n WHEN 1 THEN 'none' WHEN 2 THEN 'trivial' ELSE 'nearest-neighbor+2opt' END"
_FOUND = f"""fd AS (SELECT image_id AS seq, list({{'class_name': class_name, 'confidence': round(confidence, 3)}} ORDER BY det_id) AS found FROM ({fx.DETECTIONS}) q GROUP BY 1),
rq AS (SELECT row_number() OVER (ORDER BY c.id) AS k, c.ai_available AS ran, found FROM ({fx.CASES}) c LEFT JOIN fd ON fd.seq = c.id)"""

SQL: dict[str, str] = {
    "clean_damage": f"WITH {_D} SELECT * REPLACE (round(lat, 6) AS lat, round(lon, 6) AS lon) FROM damage",
    "exclusion_counts": f"WITH {_D} SELECT reason, count(*) AS n FROM dc WHERE reason IS NOT NULL GROUP BY reason",
    "clean_report": f"WITH {_D} SELECT a AS rows_in, a - b AS excluded_total, b AS rows_before_dedup, c AS rows_after_dedup, b - c AS duplicates_removed, c AS rows_out "
    "FROM (SELECT (SELECT count(*) FROM dc) AS a, (SELECT count(*) FROM dt) AS b, (SELECT count(*) FROM damage) AS c)",
    "dedup_by_coords": f"WITH {_D}, x AS ({_first('lat, lon, hazard_type, collected_at', 'dt')}) SELECT _row_id, round(lat, 6) AS lat FROM x",
    "dedup_all_columns": f"WITH v AS (SELECT id AS _row_id, to_status, inspection_id % 7 AS k2 FROM ({fx.EVENTS}) e) SELECT min(_row_id) AS _row_id, to_status, k2 AS k FROM v GROUP BY ALL",
    "parse_dates": f"SELECT _row_id, {_DAY.format('collected_at')} AS day FROM ({fx.DAMAGE}) d",
    "clean_zones": f"WITH {_Z} SELECT * REPLACE (round(lat, 6) AS lat, round(lon, 6) AS lon) FROM zones",
    "region_filter": f"SELECT _row_id, sigungu FROM ({fx.ZONES}) z WHERE regexp_matches(concat_ws('|', sigungu, address, sido), 'ASIA|1')",
    "region_filter_fallback": f"SELECT _row_id, sigungu FROM ({fx.ZONES}) z",
    "base_date": f"WITH {_D} SELECT max(base_date) AS base_date FROM damage",
    "intro_summary": f"WITH {_D}, {_Z} SELECT (SELECT count(*) FROM damage) AS n_damage, (SELECT max(base_date) FROM damage) AS base_date, (SELECT count(*) FROM zones) AS n_zones",
    "haversine_to_centre": f"WITH {_P}, x AS (SELECT _row_id, {hav('c', 'p')} AS m FROM points p, {_CENTRE} c) SELECT _row_id, round(m, 4) AS dist_m, "
    "CASE WHEN m < 1000 THEN format('{:.0f} m', round_even(m, 0)) ELSE format('{:.2f} km', m / 1000) END AS text FROM x",
    "radius_count": f"WITH {_D}, {_Z}, {_pairs(_ALLZ)} {_COUNTS.format(_ALLZ)}",
    "nearest_zone": f"WITH {_Z}, {_P} SELECT t._row_id AS target_id, round(min({hav('t', 'z')}), 4) AS nearest_m FROM points t, zones z GROUP BY 1",
    **{f"globe_{name}": f"WITH t AS ({fx.GLOBE_TARGETS}), p AS ({fx.GLOBE_POINTS}) SELECT t.target_id, count(p._row_id) AS n FROM t LEFT JOIN p ON {hav('t', 'p')} <= {m} GROUP BY 1" for name, m in (("radius_count", 40), ("far_count", 250_000))},
    "globe_nearest": f"WITH t AS ({fx.GLOBE_TARGETS}), p AS ({fx.GLOBE_POINTS}) SELECT t.target_id, round(min({hav('t', 'p')}), 3) AS nearest_m FROM t, p WHERE p._row_id % 5 = 0 GROUP BY 1",
    "school_score": f"WITH {_Z}, {_P}, x AS (SELECT t._row_id AS target_id, min({hav('t', 'z')}) AS m FROM points t, zones z GROUP BY 1) "
    "SELECT target_id, round(CASE WHEN m >= 500 THEN 0e0 ELSE (1 - m / 500e0) * 100 END, 4) AS score FROM x",
    "density_score": f"WITH {_D}, {_Z}, {_pairs(_ALLZ)}, n AS ({_COUNTS.format(_ALLZ)}) SELECT target_id, round(least(100e0, n / 20e0 * 100), 4) AS score FROM n",
    "rain_score": f"SELECT id, round({_clamp('(rainfall - 40) / 30e0 * 100')} * CASE WHEN rainfall IS NULL THEN NULL ELSE 1 END, 4) AS score FROM ({fx.SCORES}) q",
    "road_importance": f"WITH {_D} {_IMPORTANCE}",
    "representative_road": f"WITH {_D}, {_Z}, {_pairs(_ALLZ)} {_ROADS}",
    "risk_score": f"WITH {_SC} SELECT id, round(CASE WHEN sw > 0 THEN {_TOTAL} ELSE 0e0 END + 1e-9, 6) AS total_raw, {_USED} AS used, {_LEFT} AS excluded FROM sc",
    "risk_components": f"WITH {_SC} {_COMPONENTS}",
    "risk_formula": f"WITH {_SC} SELECT id, CAST({' + '.join(f'CASE WHEN {k} IS NULL THEN 0 ELSE 1 END' for k in _W)} AS INT) AS n_terms, sw = 0 AS none FROM sc",
    "priority_manual": _ranked(_CENTRE),
    "priority_zones": _ranked(_ALLZ),
    "priority_top": _ranked("(SELECT cluster AS target_id, lat, lon FROM summary ORDER BY count DESC, cluster LIMIT 10)", f", {_clusters('damage')}, {_SUMMARY}"),
    "grid_cells": f"WITH RECURSIVE {_P}, {_clusters('points')} SELECT cx, cy, w FROM cells",
    "core_cells": f"WITH RECURSIVE {_P}, {_clusters('points')} SELECT cx, cy FROM core",
    "cluster_points": f"WITH RECURSIVE {_P}, {_clusters('points')} SELECT _row_id, cluster FROM labelled",
    "cluster_info": f"WITH RECURSIVE {_P}, {_clusters('points')} SELECT count(DISTINCT cluster) FILTER (WHERE cluster >= 0) AS n_clusters, count(*) FILTER (WHERE cluster = -1) AS n_noise FROM labelled",
    "cluster_summary": f"WITH RECURSIVE {_D}, {_clusters('damage')}, {_SUMMARY} SELECT * REPLACE (round(lat, 6) AS lat, round(lon, 6) AS lon) FROM summary",
    "cluster_markers": f"WITH RECURSIVE {_D}, {_clusters('damage')}, {_SUMMARY} SELECT cluster, count, round(8 + 22 * count / (SELECT max(count) FROM summary)::DOUBLE, 4) AS radius FROM summary",
    "filter_hazard": f"WITH {_D} SELECT _row_id, hazard_type FROM damage WHERE hazard_type IN ('click', 'error')",
    "filter_dates": f"WITH {_D} SELECT _row_id, collected_at AS day FROM damage WHERE collected_at IS NULL OR collected_at BETWEEN '2024-01-10' AND '2024-01-20'",
    "filter_road": f"WITH {_D} SELECT _row_id, road_address FROM damage WHERE road_address LIKE '%road 1%'",
    "hazard_options": f"WITH {_D} SELECT DISTINCT hazard_type FROM damage WHERE hazard_type <> ''",
    "date_bounds": f"WITH {_D} SELECT min(collected_at) AS min_date, max(collected_at) AS max_date FROM damage",
    "marker_limit": f"WITH {_D} SELECT _row_id FROM damage ORDER BY _row_id LIMIT 5000",
    "heatmap_points": f"WITH {_D} SELECT round(lat, 6) AS lat, round(lon, 6) AS lon FROM damage",
    "map_center": f"WITH {_D} SELECT round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM damage",
    "history_map": f"WITH {_D} SELECT hazard_type, road_address, count(*) AS n FROM damage WHERE hazard_type IN ('view', 'click', 'purchase') AND road_address LIKE '%road%' "
    "AND (collected_at IS NULL OR collected_at BETWEEN '2024-01-02' AND '2024-12-30') GROUP BY ALL",
    "conf_filter": f"WITH {_DET} SELECT image_id, det_id FROM dets WHERE confidence >= 0.25",
    "nms": _greedy("confidence >= 0.25", "confidence DESC", "> 0.45"),
    "box_suppress": _greedy("true", "(x2 - x1) * (y2 - y1) DESC", ">= 0.3"),
    "nms_crowded": _greedy("true", "confidence DESC", "> 0.45", f"dets AS MATERIALIZED ({fx.CROWDED})"),
    "area_ratio": f"WITH {_DET}, {_RATIO} SELECT image_id, round(ratio, 6) AS ratio FROM ratio",
    "photo_severity": f"WITH {_DET}, {_RATIO}, s AS (SELECT image_id, max({_CW} * confidence) AS peak, count(*) AS n FROM dets GROUP BY image_id) "
    f"SELECT image_id, round({_clamp('greatest(0e0, peak) * 60 + least(n, 5) / 5e0 * 20 + least(greatest(ratio, 0e0), 0.3e0) / 0.3e0 * 20')} + 1e-9, 4) AS severity FROM s JOIN ratio USING (image_id)",
    "top_detection": f"WITH {_DET} SELECT image_id, class_name AS top_class, round(confidence, 6) AS top_confidence, n AS n_detections FROM (SELECT *, "
    "row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, det_id) AS k, count(*) OVER (PARTITION BY image_id) AS n FROM dets) WHERE k = 1",
    "yolo_boxes": f"WITH {_DET} SELECT image_id, det_id, round(greatest(0e0, least(1279e0, (x1 * 10 - x2 / 2 - 0) / 0.5e0)), 4) AS x1, round(greatest(0e0, least(719e0, (y1 * 10 - y2 / 2 - 140) / 0.5e0)), 4) AS y1, "
    "round(greatest(0e0, least(1279e0, (x1 * 10 + x2 / 2 - 0) / 0.5e0)), 4) AS x2, round(greatest(0e0, least(719e0, (y1 * 10 + y2 / 2 - 140) / 0.5e0)), 4) AS y2 FROM dets",
    "status_counts": f"SELECT status, count(c.id) AS n FROM {_DOMAIN} LEFT JOIN ({fx.CASES}) c USING (status) GROUP BY status",
    "list_cases": f"SELECT id, round(ai_risk_score, 4) AS score FROM ({fx.CASES}) c WHERE status = '보수필요' ORDER BY id DESC LIMIT 500",
    "status_history": f"SELECT id, inspection_id, lag(to_status) OVER (PARTITION BY inspection_id ORDER BY changed_at, id) AS from_status, to_status FROM ({fx.EVENTS}) v",
    "latest_status": f"WITH {_LAST} SELECT inspection_id, status FROM last",
    "current_cases": f"WITH {_LAST} SELECT c.id, coalesce(l.status, c.status) AS status FROM ({fx.CASES}) c LEFT JOIN last l ON l.inspection_id = c.id",
    "reviewer_merge": f"WITH {_LAST} SELECT c.id, c.status, l.status AS reviewer_judgement FROM ({fx.CASES}) c LEFT JOIN last l ON l.inspection_id = c.id",
    "delete_cases": f"SELECT id FROM ({fx.CASES}) c WHERE id NOT IN (SELECT inspection_id FROM ({fx.EVENTS}) v WHERE to_status = '처리완료')",
    "case_flags": f"SELECT id, CASE WHEN ai_available THEN '예' ELSE '아니오' END AS ai_available FROM ({fx.CASES}) c",
    "records_view": f"WITH {_LAST}, c AS (SELECT c.id, coalesce(l.status, c.status) AS status FROM ({fx.CASES}) c LEFT JOIN last l ON l.inspection_id = c.id) "
    f"SELECT status, count(c.id) AS n FROM {_DOMAIN} LEFT JOIN c USING (status) GROUP BY status",
    "route_matrix": f"WITH s AS ({fx.STOPS}) SELECT a.route_id, a.pos AS i, b.pos AS j, CASE WHEN a.pos = b.pos THEN 0e0 ELSE round({hav('a', 'b')}, 3) END AS dist_m FROM s a JOIN s b USING (route_id)",
    "route_two_stops": f"WITH s AS ({fx.SHORT_STOPS}), n AS (SELECT route_id, count(*) AS n FROM s GROUP BY 1), l AS (SELECT a.route_id, 2 * {hav('a', 'b')} AS m FROM s a JOIN s b ON a.route_id = b.route_id AND a.pos = 0 AND b.pos = 1) "
    "SELECT route_id, CASE n WHEN 2 THEN '0,1' ELSE '0' END AS stops, round(coalesce(m, 0e0), 2) AS total_m, CASE n WHEN 2 THEN 'trivial' ELSE 'none' END AS solver FROM n LEFT JOIN l USING (route_id)",
    "route_search": _shortest(False),
    "route_search_closed": _shortest(True),
    "weather_parse": f"""WITH i AS ({fx.RAIN_ITEMS}), f AS (SELECT request_id, min(row(fcstDate, fcstTime)) AS s FROM i GROUP BY 1),
k AS (SELECT i.*, row_number() OVER (PARTITION BY request_id, category ORDER BY pos DESC) AS k FROM i JOIN f USING (request_id) WHERE row(fcstDate, fcstTime) = s),
x AS (SELECT request_id, max(CASE WHEN category = 'PCP' THEN {_RAIN} END) AS rain, max(CASE WHEN category = 'POP' THEN try_cast(fcstValue AS DOUBLE) END) AS pop, min(concat(fcstDate, ' ', fcstTime)) AS fcst FROM k WHERE k = 1 GROUP BY 1)
SELECT request_id, rain IS NOT NULL OR pop IS NOT NULL AS available, round(CASE WHEN rain IS NOT NULL OR pop IS NOT NULL THEN coalesce(rain, 0e0) END, 2) AS rain_mm, round(pop, 2) AS pop,
  CASE WHEN rain IS NOT NULL OR pop IS NOT NULL THEN fcst END AS fcst FROM x""",
    "forecast_grid": f"""WITH i AS (SELECT *, row(base_time, nx, ny) AS q FROM ({fx.FORECASTS}) x WHERE NOT (nx = 57 AND ny = 122)), f AS (SELECT q, min(row(fcstDate, fcstTime)) AS s FROM i GROUP BY 1),
k AS (SELECT i.*, row_number() OVER (PARTITION BY q, category ORDER BY pos DESC) AS k FROM i JOIN f USING (q) WHERE row(fcstDate, fcstTime) = s),
x AS (SELECT base_time, nx, ny, max(CASE WHEN category = 'PCP' THEN {_RAIN} END) AS rain, max(CASE WHEN category = 'POP' THEN try_cast(fcstValue AS DOUBLE) END) AS pop, min(concat(fcstDate, ' ', fcstTime)) AS fcst FROM k WHERE k = 1 GROUP BY ALL),
a AS (SELECT DISTINCT base_time, nx, ny, true AS stored FROM ({fx.FORECASTS}) y),
g AS (SELECT base_time, nx::INT AS nx, ny::INT AS ny, coalesce(rain, pop) IS NOT NULL AS ok, rain, pop, fcst, stored FROM (SELECT * FROM (VALUES ('0200'), ('0500')) t(base_time), range(55, 61) u(nx), range(120, 125) v(ny)) p LEFT JOIN x USING (base_time, nx, ny) LEFT JOIN a USING (base_time, nx, ny))
SELECT '20240501' AS base_date, base_time, nx, ny, ok AS available, CASE WHEN ok THEN round(coalesce(rain, 0e0), 2) END AS rain_mm, round(pop, 2) AS pop, CASE WHEN ok THEN fcst END AS fcst,
  CASE WHEN ok THEN NULL WHEN stored IS NULL THEN 'no answer is stored' WHEN nx = 57 AND ny = 122 THEN '기상청 응답 형식이 예상과 다릅니다: 03 NO DATA' ELSE 'no precipitation in the answer' END AS reason FROM g""",
    "pcp_parse": f"SELECT pos, round({_RAIN}, 2) AS mm FROM ({fx.RAIN_ITEMS}) i",
    "base_slot": f"""WITH x AS (SELECT id, changed_at - INTERVAL 45 MINUTE AS t FROM ({fx.EVENTS}) v)
SELECT id, strftime(CASE WHEN hour(t) >= 2 THEN t ELSE t - INTERVAL 1 DAY END, '%Y%m%d') AS base_date,
  CASE WHEN hour(t) < 2 THEN '2300' ELSE lpad(CAST((hour(t) - 2) // 3 * 3 + 2 AS VARCHAR), 2, '0') || '00' END AS base_time FROM x""",
    "weather_problems": f"SELECT request_id, '기상청 응답 형식이 예상과 다릅니다: ' || CASE request_id % 4 WHEN 1 THEN (request_id % 33) || ' NO DATA' ELSE '? ' END AS reason FROM ({fx.ANSWERS}) a WHERE request_id % 4 <> 0",
    "load_damage": f"SELECT source, {_NULLED}, CAST(NULL AS VARCHAR) AS start_node FROM ({fx.DAMAGE}) d",
    "load_cp949": f"SELECT CAST(category_no AS VARCHAR) AS category_no, hazard_type, lat, lon, road_address, CASE WHEN category_no % 10 <> 3 THEN base_date END AS base_date, CASE WHEN category_no % 10 <> 3 THEN node_link END AS node_link FROM ({fx.KOREAN}) k",
    "load_multiline": f"SELECT * FROM ({fx.NOTES}) n",
    "load_zones": f"SELECT * EXCLUDE (_row_id) FROM ({fx.ZONES}) z WHERE sido LIKE '%ASIA%' OR sigungu LIKE '%ASIA%' OR address LIKE '%ASIA%'",
    "dms_degrees": f"WITH x AS (SELECT id, (d + m / 60 + s / 3600) * CASE WHEN negative THEN -1e0 ELSE 1e0 END AS v FROM ({fx.DMS}) q) SELECT id, CASE WHEN v BETWEEN -90 AND 90 THEN round(v, 6) + 0e0 END AS degrees FROM x",
    "exif_places": f"WITH x AS (SELECT id, (d + m / 60 + s / 3600) * CASE WHEN negative THEN -1e0 ELSE 1e0 END AS v FROM ({fx.DMS}) q), y AS (SELECT id, CASE WHEN v BETWEEN -90 AND 90 THEN round(v, 6) + 0e0 END AS v FROM x) SELECT id, v AS lat, v AS lon FROM y",
    "png_pixels": f"""WITH c AS (SELECT id, 1 + id % 4 AS n, id % 11 <> 0 AS read FROM ({fx.CASES}) q),
p AS (SELECT id, sum((id * 7 + y * 17 + x * 31 + k * 101) % 256 * ((y * 8 + x) * n + k + 1)) AS total FROM c, range(6) a(y), range(8) b(x), range(4) e(k) WHERE k < n GROUP BY id)
SELECT id, CASE WHEN read THEN 6 END::INT AS height, CASE WHEN read THEN 8 END::INT AS width, CASE WHEN read THEN n END::INT AS channels, CASE WHEN read THEN total END::BIGINT AS total, read FROM c JOIN p USING (id)""",
    "saved_images": f"WITH x AS (SELECT id AS image_id, CASE WHEN id % 5 < 2 THEN 1000 ELSE id END % 16777216 AS value FROM ({fx.CASES}) c) "
    "SELECT image_id, value::BIGINT AS value, 96::BIGINT AS n_bytes, count(*) OVER (PARTITION BY value) AS n_images FROM x",
    "risk_formula_text": f"WITH {_SC} SELECT id, {_formula()} AS formula FROM sc",
    "checked_events": f"SELECT id, to_status FROM ({fx.EVENTS}) v WHERE to_status IN (SELECT status FROM {_DOMAIN})",
    "case_history": f"SELECT id, to_status FROM ({fx.EVENTS}) v WHERE inspection_id = 7 ORDER BY id",
    "updated_cases": f"""WITH l AS (SELECT inspection_id, arg_max(struct_pack(s := to_status, t := changed_at), row(changed_at, id)) AS x FROM ({fx.EVENTS}) v GROUP BY 1)
SELECT c.id, coalesce(x.s, c.status) AS status, strftime(coalesce(x.t, c.created_at), '%Y-%m-%d %H:%M:%S') AS updated_at FROM ({fx.CASES}) c LEFT JOIN l ON l.inspection_id = c.id""",
    "labelled_cases": f"""SELECT id AS "번호", status AS "처리상태", CASE WHEN ai_available THEN '예' ELSE '아니오' END AS "AI 분석 수행", round(ai_risk_score + 1e-9, 4) AS "우선순위 점수" FROM ({fx.CASES}) c""",
    "new_cases": f"""WITH {_FOUND}, t AS (SELECT k, ran, found, list_max(list_transform(found, lambda x: x.confidence)) AS top FROM rq)
SELECT k + 99 AS id, '접수' AS status, list_filter(found, lambda x: x.confidence = top)[1].class_name AS ai_top_class, top AS ai_top_confidence, CAST(CASE WHEN ran THEN coalesce(len(found), 0) END AS INT) AS ai_detection_count,
  CASE WHEN len(found) > 0 THEN '[' || array_to_string(list_transform(found, lambda x: '{{"class_name":"' || x.class_name || '","confidence":' || x.confidence || '}}'), ',') || ']' END AS ai_detections_json FROM t""",
    "first_history": f"WITH {_FOUND} SELECT k AS inspection_id, CAST(NULL AS VARCHAR) AS from_status, '접수' AS to_status, '신규 접수' AS note FROM rq",
    "case_store": f"""WITH {_FOUND}, v AS (SELECT * FROM ({fx.EVENTS}) e), l AS (SELECT inspection_id, arg_max(to_status, row(t, id)) AS status FROM
  (SELECT inspection_id, changed_at AS t, id + 1 AS id, to_status FROM v UNION ALL SELECT row_number() OVER (ORDER BY id), created_at, 0, '접수' FROM ({fx.CASES}) c) u GROUP BY 1)
SELECT k AS id, l.status FROM rq JOIN l ON l.inspection_id = k WHERE k NOT IN (SELECT inspection_id FROM v WHERE to_status = '처리완료' AND (id + 1) % 5 = 0)""",
    "registered_stops": f"""WITH RECURSIVE {_routes(False)}, u AS (SELECT route_id, unnest(o) AS pos, generate_subscripts(o, 1) AS seq FROM best)
SELECT row_number() OVER (ORDER BY route_id, seq) AS id, '점검예정' AS status, pos * 1.5e0 AS score, 'road ' || pos AS road_address FROM u""",
    "photo_target": f"""WITH {_Z} SELECT _row_id AS target_id, round(lat, 6) AS lat, round(lon, 6) AS lon, address AS road_address, false AS is_photo FROM zones
UNION ALL SELECT (SELECT max(_row_id) FROM zones) + 1, 37.3943e0, 126.9568e0, 'here', true""",
    "route_candidates": f"WITH {_Z} SELECT _row_id AS target_id, round(lat, 6) AS lat FROM zones ORDER BY 1 LIMIT 5",
    "decode_output": f"WITH c AS (SELECT *, count(*) OVER (PARTITION BY image_id) AS n FROM ({fx.CANDIDATES}) q) SELECT * EXCLUDE (n) FROM c WHERE n > 8 AND confidence >= 0.25",
    "detect_boxes": _greedy("true", "confidence DESC", "> 0.45", _UNBOXED, "det.det_id, class_name, round(x1, 4) AS x1, round(y1, 4) AS y1, round(x2, 4) AS x2, round(y2, 4) AS y2"),
    "route_plan": f"""WITH RECURSIVE {_routes(False)} SELECT route_id, array_to_string(o, ',') AS stops,
  round(coalesce(list_sum(list_transform(range(1, n), lambda x: m[o[x] + 1][o[x + 1] + 1])), 0e0), 2) AS total_m, {_SOLVER} AS solver FROM best""",
    "route_legs": f"""WITH RECURSIVE {_routes(True)}, l AS (SELECT route_id, n, m, o, unnest(range(n)) AS step FROM best WHERE n > 1)
SELECT route_id, CAST(step AS INT) AS step, CAST(o[step + 1] AS INT) AS from_pos, CAST(o[(step + 1) % n + 1] AS INT) AS to_pos, round(m[o[step + 1] + 1][o[(step + 1) % n + 1] + 1], 2) AS dist_m FROM l""",
}
