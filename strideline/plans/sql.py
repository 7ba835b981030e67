"""The SQL that the catalog's queries are held against: common table expressions and one statement for each query."""

from __future__ import annotations

POINTS = """
ev AS (
  SELECT CAST(user_id AS VARCHAR) AS trajectory, event_id, event_type, epoch_us(ts) AS us,
         CAST(round(value * 100) AS BIGINT) AS c, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k
  FROM events
), pts AS (
  SELECT trajectory, CAST(row_number() OVER w - 1 AS INTEGER) AS idx, c, k,
         CAST(sum(CASE event_type WHEN 'click' THEN c WHEN 'view' THEN -c ELSE 0 END) OVER w AS DOUBLE) / 100 AS x,
         CAST(sum(CASE event_type WHEN 'purchase' THEN c WHEN 'signup' THEN -c ELSE 0 END) OVER w AS DOUBLE) / 100 AS z,
         CAST(us - min(us) OVER (PARTITION BY trajectory) AS DOUBLE) / 3.6e10 AS t,
         CASE WHEN k % 11 <> 0 THEN CAST(k % 7 - 3 AS DOUBLE) END AS fx,
         CASE WHEN k % 11 <> 0 THEN CAST(k % 5 - 2 AS DOUBLE) END AS fz,
         CAST(60 + k % 40 AS DOUBLE) AS hr,
         CASE WHEN k % 13 <> 0 THEN (2 + (c % 300) / 100.0 + 2 + ((c + 50) % 300) / 100.0) / 2 END AS pupil
  FROM ev WINDOW w AS (PARTITION BY trajectory ORDER BY us, event_id)
), st AS (
  SELECT *, x - lag(x) OVER w AS dx, z - lag(z) OVER w AS dz,
         sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (z - lag(z) OVER w) * (z - lag(z) OVER w)) AS seg,
         count(*) OVER (PARTITION BY trajectory) AS n
  FROM pts WINDOW w AS (PARTITION BY trajectory ORDER BY idx)
)"""

#: Points some of whose trajectories lack some signals, and which have all of a kind.
SPARSE = """
sp AS (
  SELECT trajectory, t, fx, CASE WHEN trajectory::BIGINT % 3 <> 0 THEN fz END AS fz, k % 10 AS gx, CASE WHEN trajectory::BIGINT % 4 <> 1 THEN k % 9 END AS gy,
         CASE WHEN k % 13 <> 0 AND trajectory::BIGINT % 5 <> 2 THEN c END AS pl, CASE WHEN k % 13 <> 0 AND trajectory::BIGINT % 7 <> 3 THEN c END AS pr, CASE WHEN trajectory::BIGINT % 11 <> 4 THEN hr END AS hr
  FROM pts
), si AS (
  SELECT trajectory, count(fx) > 0 AND count(fz) > 0 AND count(gx) > 0 AND count(gy) > 0 AS gaze, count(pl) > 0 AND count(pr) > 0 AND count(hr) > 0 AS physio FROM sp GROUP BY trajectory
)"""

JUNCTIONS = """
jn(junction, cx, cz, r, ro) AS (
  VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE, 60.0::DOUBLE, 120.0::DOUBLE), (1, 100.0, 0.0, 60.0, 100.0), (2, 0.0, 150.0, 60.0, 100.0), (3, -150.0, -50.0, 60.0, 120.0)
)"""

FRAME = """
f0 AS (
  SELECT st.*, jn.*, sqrt((x - cx) * (x - cx) + (z - cz) * (z - cz)) AS dist FROM st, jn
), en AS (
  SELECT trajectory, junction, min(idx) FILTER (WHERE dist <= r) AS first_in, max(idx) FILTER (WHERE dist <= r) AS last_in,
         (min((dist, idx)))[2] AS nearest
  FROM f0 GROUP BY trajectory, junction
), f1 AS (
  SELECT f0.*, first_in, last_in, nearest, coalesce(first_in, nearest) AS start, first_in IS NOT NULL AS entered
  FROM f0 JOIN en USING (trajectory, junction)
), f2 AS (
  SELECT *, sum(CASE WHEN idx > start THEN seg END) OVER w AS path, lag(dist) OVER w AS prev_dist,
         CASE WHEN idx - 5 >= start + 1 THEN lag(dist, 5) OVER w
              ELSE max(CASE WHEN idx = start + 1 THEN dist END) OVER (PARTITION BY trajectory, junction) END AS base
  FROM f1 WINDOW w AS (PARTITION BY trajectory, junction ORDER BY idx)
), de AS (
  SELECT trajectory, junction,
         min(idx) FILTER (WHERE idx > start AND dist >= ro AND dist >= base) AS radial_idx,
         min(idx) FILTER (WHERE idx > start + 1 AND dist >= ro AND dist >= base) AS trend_idx,
         min(idx) FILTER (WHERE idx > start AND path >= 100.005) AS pathlen_idx
  FROM f2 GROUP BY trajectory, junction
), fr AS (
  SELECT f2.*, radial_idx, trend_idx, pathlen_idx FROM f2 JOIN de USING (trajectory, junction)
)"""

VECTORS = """
ag AS (
  SELECT trajectory, junction, any_value(r) AS r, bool_or(entered) AS entered,
         sum(dx) FILTER (WHERE idx > greatest(start, radial_idx - 5) AND idx <= radial_idx AND seg >= 0.05) AS rx,
         sum(dz) FILTER (WHERE idx > greatest(start, radial_idx - 5) AND idx <= radial_idx AND seg >= 0.05) AS rz,
         max((seg, -idx, dx, dz)) FILTER (WHERE idx > greatest(start, radial_idx - 5) AND idx <= radial_idx) AS near,
         min((idx, dx, dz)) FILTER (WHERE idx >= pathlen_idx AND seg >= 0.05 AND prev_dist >= r + 5) AS t1,
         max((seg, -idx, dx, dz, prev_dist)) FILTER (WHERE idx > start) AS t2,
         sum(dx) FILTER (WHERE idx > start AND idx > n - 11) AS lx, sum(dz) FILTER (WHERE idx > start AND idx > n - 11) AS lz,
         max(prev_dist) FILTER (WHERE idx = n - 1 AND idx > start) AS end_dist
  FROM fr GROUP BY trajectory, junction
), cand AS (
  SELECT *, coalesce(rx, near[3]) AS ax, CASE WHEN rx IS NULL THEN near[4] ELSE rz END AS az,
         CASE WHEN t1 IS NOT NULL THEN t1[2] WHEN t2[1] > 0 AND t2[5] >= r + 5 THEN t2[3] WHEN end_dist >= r + 5 AND (lx <> 0 OR lz <> 0) THEN lx END AS bx,
         CASE WHEN t1 IS NOT NULL THEN t1[3] WHEN t2[1] > 0 AND t2[5] >= r + 5 THEN t2[4] WHEN end_dist >= r + 5 AND (lx <> 0 OR lz <> 0) THEN lz END AS bz
  FROM ag
), pick AS (
  SELECT trajectory, junction, entered, CASE WHEN ax <> 0 OR az <> 0 THEN 'radial' ELSE 'pathlen' END AS used,
         CASE WHEN ax <> 0 OR az <> 0 THEN ax ELSE bx END AS ux, CASE WHEN ax <> 0 OR az <> 0 THEN az ELSE bz END AS uz
  FROM cand
), ve AS (
  SELECT trajectory, junction, entered, entered AND ux IS NOT NULL AS usable,
         CASE WHEN entered THEN ux / sqrt(ux * ux + uz * uz) END AS vx, CASE WHEN entered THEN uz / sqrt(ux * ux + uz * uz) END AS vz,
         CASE WHEN entered AND ux IS NOT NULL THEN used END AS mode_used
  FROM pick
)"""

ASSIGNED = """
ce(branch, wx, wz) AS (VALUES (0, 1.0::DOUBLE, 0.0::DOUBLE), (1, 0.0, 1.0), (2, -1.0, 0.0), (3, 0.0, -1.0)),
dots AS (
  SELECT trajectory, junction, branch, round(vx * wx + vz * wz, 9) AS dot,
         row_number() OVER (PARTITION BY trajectory, junction ORDER BY vx * wx + vz * wz DESC, branch) AS turn
  FROM ve, ce WHERE vx IS NOT NULL
), asg AS (
  SELECT ve.trajectory, ve.junction,
         CAST(CASE WHEN NOT entered THEN -2 WHEN a.dot >= cos(radians(40)) THEN a.branch ELSE -1 END AS INTEGER) AS branch,
         a.dot AS best_dot, CAST(coalesce(b.branch, -1) AS INTEGER) AS second_branch, b.dot AS second_dot
  FROM ve
  LEFT JOIN dots a ON a.trajectory = ve.trajectory AND a.junction = ve.junction AND a.turn = 1
  LEFT JOIN dots b ON b.trajectory = ve.trajectory AND b.junction = ve.junction AND b.turn = 2
)"""

VISITS = """
nd AS (
  SELECT trajectory, idx, (SELECT min(junction) FROM jn WHERE sqrt((pts.x - cx) * (pts.x - cx) + (pts.z - cz) * (pts.z - cz)) <= ro) AS junction FROM pts
), ch AS (
  SELECT *, lag(junction) OVER (PARTITION BY trajectory ORDER BY idx) AS prior FROM nd
), vi AS (
  SELECT trajectory, CAST(row_number() OVER (PARTITION BY trajectory ORDER BY idx) - 1 AS INTEGER) AS visit, junction, idx
  FROM ch WHERE junction IS NOT NULL AND junction IS DISTINCT FROM prior
), mv AS (
  SELECT * FROM (SELECT trajectory, visit, junction AS origin, lead(junction) OVER (PARTITION BY trajectory ORDER BY visit) AS dest FROM vi)
  WHERE dest IS NOT NULL AND origin <> dest
), fl AS (SELECT origin, dest, count(*) AS n FROM mv GROUP BY origin, dest)"""

SHARES = """
sh0 AS (SELECT junction, branch, count(*) AS n FROM asg WHERE branch >= 0 GROUP BY junction, branch),
sh AS (SELECT *, n / sum(n) OVER (PARTITION BY junction) AS share, CAST(sum(n) OVER (PARTITION BY junction) AS BIGINT) AS total FROM sh0),
pr AS (
  SELECT j.junction, coalesce(max(total), 0) AS total, count(branch) AS routes, max(share) AS top_share,
         CASE WHEN count(branch) > 1 THEN sum(-share * log2(share)) ELSE 0 END AS entropy,
         CASE WHEN count(branch) > 1 THEN sum(-share * log2(share)) / log2(count(branch)) ELSE 0 END AS evenness
  FROM (SELECT DISTINCT junction FROM asg) j LEFT JOIN sh ON sh.junction = j.junction GROUP BY j.junction
), rk0 AS (
  SELECT *, CASE WHEN top_share > 0.7 THEN (top_share - 0.7) / 0.3 ELSE 0 END AS concentration,
         CASE WHEN routes < 2 THEN 1.0 WHEN routes = 2 THEN 0.3 ELSE 0.0 END::DOUBLE AS diversity,
         CASE WHEN total <= 50 THEN 0 WHEN total <= 100 THEN (total - 50) / 50 ELSE 1 END::DOUBLE AS crowding
  FROM pr
), rk AS (SELECT *, least((concentration + diversity + crowding) / 3, 1) AS risk FROM rk0)"""

YAWS = """
mv AS (SELECT *, lead(x) OVER w - lag(x) OVER w AS mx, lead(z) OVER w - lag(z) OVER w AS mz FROM fr WINDOW w AS (PARTITION BY trajectory, junction ORDER BY idx)),
di AS (SELECT mv.*, coalesce(radial_idx, pathlen_idx) AS d FROM mv),
yg AS (SELECT trajectory, junction, any_value(d) AS d, min((abs(idx - d), idx, fx, fz, hr, coalesce(pupil, -1))) FILTER (WHERE fx IS NOT NULL AND abs(idx - d) <= 200) AS s, max((mx, mz)) FILTER (WHERE idx = d AND mx * mx + mz * mz > 1e-12) AS m FROM di WHERE d IS NOT NULL GROUP BY trajectory, junction),
yw0 AS (SELECT trajectory, junction, branch, d, s[2] AS v, degrees(atan2(s[3], s[4])) AS h, degrees(atan2(m[1], m[2])) AS w, s[5] AS hr, nullif(s[6], -1) AS pupil FROM yg JOIN asg USING (trajectory, junction) WHERE branch >= 0),
yw AS (SELECT *, h - w + 180 - 360 * floor((h - w + 180) / 360) - 180 AS diff FROM yw0)"""

CLUSTERS = """
us AS (SELECT trajectory, junction, vx, vz FROM ve WHERE usable),
nb AS (SELECT a.junction, a.trajectory AS a, b.trajectory AS b FROM us a JOIN us b USING (junction) WHERE acos(greatest(-1, least(1, a.vx * b.vx + a.vz * b.vz))) <= radians(15) + 1e-9),
core AS (SELECT junction, a FROM nb GROUP BY junction, a HAVING count(*) >= 5),
near AS (SELECT nb.* FROM nb JOIN core c USING (junction, a) JOIN core d ON d.junction = nb.junction AND d.a = nb.b),
reach(junction, a, b) AS (
  SELECT junction, a, a FROM core UNION SELECT reach.junction, reach.a, near.b FROM reach JOIN near ON near.junction = reach.junction AND near.a = reach.b
), first AS (SELECT junction, a, min(b) AS f FROM reach GROUP BY junction, a),
num AS (SELECT *, dense_rank() OVER (PARTITION BY junction ORDER BY f) - 1 AS k FROM first),
lab AS (SELECT us.*, (SELECT min(k) FROM nb JOIN num ON num.junction = nb.junction AND num.a = nb.b WHERE nb.junction = us.junction AND nb.a = us.trajectory) AS any_k, num.k FROM us LEFT JOIN num ON num.junction = us.junction AND num.a = us.trajectory),
cl AS (SELECT junction, trajectory, vx, vz, coalesce(k, any_k) AS k FROM lab),
cc AS (SELECT junction, k, avg(vx) AS mx, avg(vz) AS mz FROM cl WHERE k IS NOT NULL GROUP BY junction, k),
ck AS (SELECT *, CAST(row_number() OVER (PARTITION BY junction ORDER BY atan2(mz, mx), k) - 1 AS INTEGER) AS branch FROM cc)"""


def _with(body: str, *parts: str) -> str:
    """A statement over common tables; a body that starts with a comma goes on with more of them."""
    return "WITH " + ("RECURSIVE " if CLUSTERS in parts else "") + ",\n".join(p.strip() for p in parts) + "\n" + body.strip()


GEO = (POINTS, JUNCTIONS, FRAME)
DIR = (*GEO, VECTORS)
ASG = (*DIR, ASSIGNED)
SEQ = (POINTS, JUNCTIONS, VISITS)

QUERIES = {
    "scan_filter_scale": _with("SELECT trajectory, idx, x * 0.5 AS x, z * 0.5 AS z FROM pts WHERE x IS NOT NULL AND z IS NOT NULL", POINTS),
    "trim_static_prefix": _with(
        """
        , nx AS (SELECT *, sqrt((lead(x) OVER w - x) * (lead(x) OVER w - x) + (lead(z) OVER w - z) * (lead(z) OVER w - z)) AS step FROM pts WINDOW w AS (PARTITION BY trajectory ORDER BY idx)),
        bg AS (SELECT trajectory, coalesce(min(idx) FILTER (WHERE step > 20), 0) AS b FROM nx GROUP BY trajectory)
        SELECT nx.trajectory, nx.idx - b AS idx, x, z, round(t - min(t) OVER (PARTITION BY nx.trajectory), 9) AS t
        FROM nx JOIN bg USING (trajectory) WHERE nx.idx >= b
        """,
        POINTS,
    ),
    "capabilities": _with("SELECT trajectory, count(t) > 0 AS has_time, bool_or(gaze) AS has_gaze, bool_or(physio) AS has_physio, bool_or(gaze AND physio) AS has_headset FROM sp JOIN si USING (trajectory) GROUP BY trajectory", POINTS, SPARSE),
    "overview": _with("SELECT count(DISTINCT trajectory) AS trajectories, count(*) AS points, min(x) AS x_min, max(x) AS x_max, min(z) AS z_min, max(z) AS z_max FROM pts", POINTS),
    "step_and_path_length": _with("SELECT trajectory, round(coalesce(sum(seg), 0), 6) AS distance, round(max(t) - min(t), 6) AS duration, round(CASE WHEN coalesce(sum(seg), 0) > 0 AND max(t) > min(t) THEN sum(seg) / (max(t) - min(t)) ELSE 0 END, 6) AS speed FROM st GROUP BY trajectory", POINTS),
    "junction_entry": _with("SELECT trajectory, junction, bool_or(entered) AS entered, max(start) AS start_idx FROM f1 GROUP BY trajectory, junction", *GEO),
    "circle_rect_membership": _with("SELECT count(*) FILTER (WHERE x * x + z * z <= 3600) AS in_circle, count(*) FILTER (WHERE x BETWEEN -50 AND 80 AND z BETWEEN 0 AND 120) AS in_rectangle FROM pts", POINTS),
    "zone_membership_tilted": _with("SELECT count(*) AS n FROM pts WHERE abs((x - 20) * cos(radians(30)) + (z - 40) * sin(radians(30))) <= 60.001 AND abs((z - 40) * cos(radians(30)) - (x - 20) * sin(radians(30))) <= 30.001", POINTS),
    "radial_decision_index": _with("SELECT trajectory, junction, radial_idx AS decision_idx FROM de", *GEO),
    "pathlen_decision_index": _with("SELECT trajectory, junction, pathlen_idx AS decision_idx FROM de", *GEO),
    "hybrid_decision": _with("SELECT trajectory, junction, radial_idx, pathlen_idx, coalesce(radial_idx, pathlen_idx) AS decision_idx FROM de", *GEO),
    "direction_vectors": _with("SELECT trajectory, junction, entered, usable, round(vx, 6) AS vx, round(vz, 6) AS vz, mode_used FROM ve", *DIR),
    "decision_points": _with(
        """
        , md AS (SELECT trajectory, junction, quantile_cont(seg, 0.5) AS median, any_value(ro) AS ring,
                 max((idx, x, z, dist)) FILTER (WHERE idx = radial_idx) AS ra, max((idx, x, z, dist)) FILTER (WHERE idx = pathlen_idx) AS pa FROM fr GROUP BY trajectory, junction),
        b AS (SELECT ve.*, median, ring, CASE mode_used WHEN 'radial' THEN ra WHEN 'pathlen' THEN pa END AS at FROM ve JOIN md USING (trajectory, junction)),
        c AS (SELECT *, coalesce(at[4] <= ring + greatest(2 * coalesce(median, 0), 1), false) AS ok FROM b)
        SELECT trajectory, junction, CASE WHEN ok THEN at[1] END AS decision_idx, CASE WHEN ok THEN at[2] END AS intercept_x, CASE WHEN ok THEN at[3] END AS intercept_z, mode_used,
               CASE WHEN NOT entered THEN 'no_junction_entry' WHEN NOT usable THEN 'no_vector' WHEN ok THEN mode_used ELSE 'no_decision_point' END AS reason FROM c
        """.replace(" at,", " spot,").replace("AS at ", "AS spot ").replace("at[", "spot["),
        *DIR,
    ),
    "first_within_ring": _with("SELECT trajectory, junction, coalesce(min(idx) FILTER (WHERE dist <= ro), any_value(nearest)) AS decision_idx, count(*) FILTER (WHERE dist <= ro) > 0 AS reached FROM f1 GROUP BY trajectory, junction", *GEO),
    "near_ring_intercepts": _with("SELECT trajectory, junction, m[1] AS decision_idx, m[2] AS intercept_x, m[3] AS intercept_z FROM (SELECT trajectory, junction, any_value(cx) AS cx, any_value(cz) AS cz, min((idx, x, z)) FILTER (WHERE abs(dist - ro) < 5) AS m FROM f1 GROUP BY trajectory, junction) WHERE m[2] BETWEEN cx - 110 AND cx + 110 AND m[3] BETWEEN cz - 110 AND cz + 110", *GEO),
    "clip_to_area": _with("SELECT trajectory, junction, count(*) AS n FROM (SELECT *, min(dist) OVER (PARTITION BY trajectory, junction) <= ro AS came FROM f1) WHERE NOT came OR dist <= 1.5 * ro GROUP BY trajectory, junction", *GEO),
    "clip_to_ring": _with("SELECT trajectory, junction, count(*) AS n FROM f1 WHERE dist <= ro GROUP BY trajectory, junction", *GEO),
    "assign_fixed_centers": _with("SELECT trajectory, junction, branch, round(best_dot, 6) AS best_dot, second_branch, round(second_dot, 6) AS second_dot FROM asg", *ASG),
    "branch_summary": _with("SELECT junction, branch, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY junction), 6) AS percent FROM asg WHERE branch >= 0 GROUP BY junction, branch", *ASG),
    "branch_entropy": _with("SELECT junction, round(-sum(share * ln(share)), 6) AS entropy FROM sh GROUP BY junction", *ASG, SHARES),
    "split_small_branches": _with(
        """
        , s AS (SELECT *, branch >= 0 AND count(*) OVER (PARTITION BY junction, branch) < greatest(1, ceil(0.2 * count(*) FILTER (WHERE branch >= 0) OVER (PARTITION BY junction))) AS is_small FROM asg)
        SELECT trajectory, junction, branch, is_small,
               CAST(CASE WHEN branch < 0 THEN branch WHEN NOT is_small THEN (SELECT count(DISTINCT o.branch) FROM s o WHERE o.junction = s.junction AND o.branch >= 0 AND NOT o.is_small AND o.branch < s.branch) END AS INTEGER) AS main_branch
        FROM s
        """,
        *ASG,
    ),
    "status_counts": _with("SELECT junction, CASE WHEN branch >= 0 THEN 'branch ' || branch WHEN branch = -1 THEN 'no decision' ELSE 'no entry' END AS status, count(*) AS n FROM asg GROUP BY 1, 2", *ASG),
    "chain_wide": _with("SELECT trajectory, max(branch) FILTER (WHERE junction = 0) AS branch_j0, max(branch) FILTER (WHERE junction = 1) AS branch_j1, max(branch) FILTER (WHERE junction = 2) AS branch_j2, max(branch) FILTER (WHERE junction = 3) AS branch_j3 FROM asg GROUP BY trajectory", *ASG),
    "branch_silhouette": _with(
        """
        , v AS (SELECT asg.trajectory, asg.junction, branch, vx, vz FROM asg JOIN ve USING (trajectory, junction) WHERE branch >= 0),
        pd AS (SELECT a.trajectory, a.junction, a.branch AS own, b.branch AS other, sum(1 - (a.vx * b.vx + a.vz * b.vz)) AS d, count(*) AS n FROM v a JOIN v b USING (junction) GROUP BY ALL),
        ab AS (SELECT trajectory, junction, max(CASE WHEN own = other THEN CASE WHEN n > 1 THEN d / (n - 1) ELSE 0 END END) AS a, min(CASE WHEN own <> other THEN d / n END) AS b FROM pd GROUP BY trajectory, junction)
        SELECT junction, round(avg(CASE WHEN b IS NULL OR greatest(a, b) <= 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab GROUP BY junction
        """,
        *ASG,
    ),
    "timing_modes": _with("SELECT trajectory, junction, round(coalesce(max(t) FILTER (WHERE idx = radial_idx), max(t) FILTER (WHERE idx = pathlen_idx - 1)) - max(t) FILTER (WHERE idx = start), 6) AS seconds, CASE WHEN any_value(radial_idx) IS NOT NULL THEN 'radial' ELSE 'pathlen' END AS mode_used FROM fr GROUP BY trajectory, junction", *GEO),
    "regions_dt": _with("SELECT trajectory, round(a[2], 6) AS t_a, round(b[2], 6) AS t_b, round(CASE WHEN b[1] > a[1] THEN b[2] - a[2] END, 6) AS dt_ab FROM (SELECT trajectory, min((idx, t)) FILTER (WHERE x * x + z * z <= 3600) AS a, min((idx, t)) FILTER (WHERE x BETWEEN 80 AND 300 AND z BETWEEN -200 AND 200) AS b FROM pts GROUP BY trajectory)", POINTS),
    "speed_through_junction": _with(
        """
        , g AS (SELECT trajectory, junction, any_value(trend_idx) AS tr, any_value(start) AS s, any_value(n) AS n, any_value(coalesce(trend_idx, pathlen_idx)) AS e,
                sum(seg) FILTER (WHERE idx > start AND idx <= coalesce(trend_idx, pathlen_idx)) AS path,
                max(t) FILTER (WHERE idx = coalesce(trend_idx, pathlen_idx)) - max(t) FILTER (WHERE idx = start) AS time FROM fr GROUP BY trajectory, junction)
        SELECT trajectory, junction, round(CASE WHEN time > 0 THEN path / time END, 6) AS speed,
               CASE WHEN e IS NULL THEN CASE WHEN s = n - 1 THEN 'hybrid_no_movement' ELSE 'hybrid_not_reached' END
                    WHEN time > 0 THEN CASE WHEN tr IS NULL THEN 'pathlen' ELSE 'radial' END ELSE CASE WHEN tr IS NULL THEN 'pathlen' ELSE 'radial' END || '_zero_time' END AS status
        FROM g
        """,
        *GEO,
    ),
    "transit_speed": _with(
        """
        , tt AS (SELECT f1.*, max(CASE WHEN idx = first_in THEN t END) OVER w AS ti, max(CASE WHEN idx = last_in THEN t END) OVER w AS tx FROM f1 WINDOW w AS (PARTITION BY trajectory, junction)),
        wi AS (SELECT *, lag(t) OVER (PARTITION BY trajectory, junction ORDER BY idx) AS tp FROM tt),
        g AS (SELECT trajectory, junction, any_value(first_in) AS a, any_value(last_in) AS b, any_value(n) AS n,
              sum(seg) FILTER (WHERE t BETWEEN ti - 5 AND ti - 2 AND tp BETWEEN ti - 5 AND ti - 2) AS ep, max(t) FILTER (WHERE t BETWEEN ti - 5 AND ti - 2) - min(t) FILTER (WHERE t BETWEEN ti - 5 AND ti - 2) AS et,
              sum(seg) FILTER (WHERE t BETWEEN tx + 2 AND tx + 5 AND tp BETWEEN tx + 2 AND tx + 5) AS xp, max(t) FILTER (WHERE t BETWEEN tx + 2 AND tx + 5) - min(t) FILTER (WHERE t BETWEEN tx + 2 AND tx + 5) AS xt,
              sum(seg) FILTER (WHERE idx > first_in AND idx <= last_in) AS ap, max(tx - ti) AS at_ FROM wi GROUP BY trajectory, junction)
        SELECT trajectory, junction, round(CASE WHEN n >= 3 AND b > a AND et > 0 THEN ep / et END, 6) AS entry_speed, round(CASE WHEN n >= 3 AND b > a AND xt > 0 THEN xp / xt END, 6) AS exit_speed, round(CASE WHEN n >= 3 AND b > a AND at_ > 0 THEN ap / at_ END, 6) AS average_speed FROM g
        """,
        *GEO,
    ),
    "junction_estimate": _with(
        ", c AS (SELECT quantile_cont(x, 0.5) AS cx, quantile_cont(z, 0.5) AS cz FROM pts) SELECT round(cx, 6) AS cx, round(cz, 6) AS cz, round(greatest(quantile_cont(sqrt((x - cx) * (x - cx) + (z - cz) * (z - cz)), 0.75), 20), 6) AS r, round(3 * greatest(quantile_cont(sqrt((x - cx) * (x - cx) + (z - cz) * (z - cz)), 0.75), 20), 6) AS r_outer FROM pts, c GROUP BY cx, cz", POINTS),
    "metric_summaries": _with(
        ", m AS (SELECT junction, coalesce(max(t) FILTER (WHERE idx = radial_idx), max(t) FILTER (WHERE idx = pathlen_idx - 1)) - max(t) FILTER (WHERE idx = start) AS s FROM fr GROUP BY trajectory, junction) SELECT junction, round(avg(s), 6) AS mean, round(median(s), 6) AS median, round(min(s), 6) AS min, round(max(s), 6) AS max, round(stddev_samp(s), 6) AS std, count(s) AS valid, count(*) - count(s) AS missing FROM m GROUP BY junction", *GEO),
    "step_histogram": _with(
        ", e AS (SELECT min(seg) AS lo, max(seg) AS hi, count(seg) AS a FROM st) SELECT CAST(least(floor((seg - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, count(*) AS n FROM st, e WHERE seg IS NOT NULL GROUP BY 1", POINTS),
    "fit_sums": _with("SELECT count(seg) AS n, round(avg(seg), 6) AS mean, round(var_pop(seg), 4) AS var, count(seg) FILTER (WHERE seg > 0) AS n_pos, round(avg(ln(seg)) FILTER (WHERE seg > 0), 6) AS mean_log, round(var_pop(ln(seg)) FILTER (WHERE seg > 0), 6) AS var_log FROM (SELECT CASE WHEN seg > 0 THEN seg END AS seg FROM st) WHERE seg IS NOT NULL", POINTS),
    "visit_sequence": _with("SELECT trajectory, visit, junction FROM vi", *SEQ),
    "transition_counts": _with("SELECT origin, dest, n FROM fl", *SEQ),
    "flow_conditional": _with("SELECT origin, dest, n, round(100.0 * n / sum(n) OVER (PARTITION BY origin), 6) AS percent FROM fl", *SEQ),
    "flow_overall": _with("SELECT origin, dest, n, round(n / (SELECT count(DISTINCT trajectory) FROM pts), 9) AS share FROM fl", *SEQ),
    "flow_fan_out": _with("SELECT CASE k WHEN 1 THEN 'Single Route' WHEN 2 THEN 'Two Routes' ELSE 'Multiple Routes' END AS pattern, count(*) AS origins FROM (SELECT origin, count(*) AS k FROM fl GROUP BY origin) GROUP BY 1", *SEQ),
    "flow_strength": _with(", p AS (SELECT *, 100.0 * n / sum(n) OVER (PARTITION BY origin) AS pc FROM fl) SELECT origin, dest, n, round(pc, 6) AS percent, CASE WHEN pc >= 70 THEN 'preferred' WHEN pc >= 50 THEN 'learned' WHEN pc >= 30 THEN 'direct' ELSE 'weak' END AS strength FROM p", *SEQ),
    "flow_predictions": _with(", p AS (SELECT *, 100.0 * n / sum(n) OVER (PARTITION BY origin) AS pc FROM fl), q AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY pc DESC, dest) AS k FROM p) SELECT origin, dest, round(least(pc / 100, 0.9), 9) AS confidence FROM q WHERE k = 1 ORDER BY origin LIMIT 20", *SEQ),
    "flow_threshold": _with(", s AS (SELECT origin, dest, n, n / (SELECT count(DISTINCT trajectory) FROM pts) AS share FROM fl) SELECT origin, dest, n, round(share, 9) AS share, round(share / max(share) OVER (), 9) AS intensity FROM s WHERE share >= 0.1", *SEQ),
    "direct_flows": _with(
        """
        , g AS (SELECT trajectory, junction, max(idx) FILTER (WHERE dist <= 2 * r) AS l, min(idx) FILTER (WHERE dist <= 2 * r) AS f FROM f1 GROUP BY trajectory, junction),
        h AS (SELECT g.* FROM g JOIN asg USING (trajectory, junction) WHERE branch >= 0),
        p AS (SELECT a.trajectory, a.junction AS origin, b.junction AS dest, a.l, b.f FROM h a JOIN h b USING (trajectory) WHERE a.junction <> b.junction AND a.l < b.f),
        q AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM f1 WHERE f1.trajectory = p.trajectory AND f1.junction NOT IN (p.origin, p.dest) AND f1.dist <= f1.r AND f1.idx >= p.l AND f1.idx < p.f))
        SELECT origin, dest, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM q GROUP BY origin, dest
        """,
        *ASG,
    ),
    "second_order_after": _with(
        """
        , h AS (SELECT trajectory, visit, lag(junction) OVER w AS origin, junction AS via, lead(junction) OVER w AS dest FROM vi WINDOW w AS (PARTITION BY trajectory ORDER BY visit)),
        k AS (SELECT *, row_number() OVER (PARTITION BY trajectory, origin, via ORDER BY visit) AS turn FROM h WHERE origin IS NOT NULL)
        SELECT origin, via, dest, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY origin, via), 6) AS percent FROM k WHERE turn = 1 AND dest IS NOT NULL AND dest <> via GROUP BY origin, via, dest
        """,
        *SEQ,
    ),
    "second_order_before": _with(
        """
        , h AS (SELECT trajectory, visit, junction AS via, lead(junction) OVER (PARTITION BY trajectory ORDER BY visit) AS dest FROM vi),
        k AS (SELECT trajectory, via, dest, min(visit) AS visit FROM h WHERE dest IS NOT NULL GROUP BY trajectory, via, dest),
        o AS (SELECT k.*, (SELECT max((v.visit, v.junction)) FROM vi v WHERE v.trajectory = k.trajectory AND v.visit < k.visit AND v.junction <> k.via)[2] AS origin FROM k)
        SELECT via, dest, origin, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY via, dest), 6) AS percent FROM o WHERE origin IS NOT NULL GROUP BY via, dest, origin
        """,
        *SEQ,
    ),
    "route_patterns": _with(
        """
        , c AS (SELECT trajectory, string_agg(branch, '-' ORDER BY junction) AS route, count(*) AS k FROM asg WHERE branch >= 0 GROUP BY trajectory),
        p AS (SELECT trajectory, junction, branch FROM asg WHERE branch >= 0),
        q AS (SELECT p.* FROM p WHERE (SELECT count(*) FROM p o WHERE o.trajectory = p.trajectory AND o.junction <= p.junction) = p.junction + 1),
        s AS (SELECT trajectory, string_agg(CAST(branch AS VARCHAR), '-' ORDER BY junction) AS route FROM q GROUP BY trajectory HAVING count(*) > 1)
        SELECT route, count(*) AS n, round(count(*) / (SELECT count(*) FROM s), 9) AS share FROM s GROUP BY route HAVING count(*) > 1 ORDER BY n DESC, route LIMIT 10
        """,
        *ASG,
    ),
    "head_yaw": _with("SELECT trajectory, junction, branch, d AS decision_idx, v AS valid_idx, round(h, 6) AS head_yaw, round(w, 6) AS movement_yaw, round(diff, 6) AS yaw_difference, hr AS heart_rate, round(pupil, 6) AS pupil FROM yw", *ASG, YAWS),
    "physiology_windows": _with(
        """
        , q AS (SELECT *, max(CASE WHEN idx = start THEN t END) OVER w AS ti, max(CASE WHEN idx = coalesce(radial_idx, pathlen_idx) THEN t END) OVER w AS td FROM fr WINDOW w AS (PARTITION BY trajectory, junction)),
        g AS (SELECT trajectory, junction, avg(hr) FILTER (WHERE t BETWEEN ti - 5 AND ti - 2) AS hb, avg(hr) FILTER (WHERE t BETWEEN ti AND td) AS hd, avg(pupil) FILTER (WHERE t BETWEEN ti - 5 AND ti - 2) AS pb, avg(pupil) FILTER (WHERE t BETWEEN ti AND td) AS pd FROM q WHERE td IS NOT NULL GROUP BY trajectory, junction)
        SELECT trajectory, junction, round(hb, 6) AS heart_rate_baseline, round(hd, 6) AS heart_rate_decision, round(pb, 6) AS pupil_baseline, round(pd, 6) AS pupil_decision, round(hd - hb, 6) AS heart_rate_change, round(pd - pb, 6) AS pupil_change FROM g
        """,
        *GEO,
    ),
    "pupil_windows": _with(
        """
        , q AS (SELECT *, max(CASE WHEN idx = coalesce(radial_idx, pathlen_idx) THEN t END) OVER (PARTITION BY trajectory, junction) AS td FROM fr),
        k AS (SELECT *, row_number() OVER (PARTITION BY trajectory, junction, pupil IS NOT NULL AND t < td - 3 ORDER BY idx DESC) AS turn FROM q WHERE td IS NOT NULL),
        g AS (SELECT trajectory, junction, avg(pupil) FILTER (WHERE t < td - 3 AND turn <= 10) AS b, avg(pupil) FILTER (WHERE t BETWEEN td - 3 AND td + 3) AS d FROM k GROUP BY trajectory, junction)
        SELECT trajectory, junction, round(b, 6) AS pupil_baseline, round(d, 6) AS pupil_decision, round(d - b, 6) AS pupil_change FROM g
        """,
        *GEO,
    ),
    "bottlenecks": _with("SELECT junction, branch, n, round(share, 9) AS share, CASE WHEN share > 0.3 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM sh WHERE share > 0.2", *ASG, SHARES),
    "balanced_routes": _with("SELECT junction, round(evenness, 9) AS evenness, round(entropy, 9) AS entropy, routes FROM pr WHERE evenness > 0.7 AND routes > 1", *ASG, SHARES),
    "flow_analysis": _with("SELECT pr.junction, pr.total, round(entropy, 9) AS entropy, '{' || coalesce(string_agg('\"' || branch || '\":' || n, ',' ORDER BY branch), '') || '}' AS flow FROM pr LEFT JOIN sh ON sh.junction = pr.junction GROUP BY pr.junction, pr.total, entropy", *ASG, SHARES),
    "risk": _with("SELECT junction, round(risk, 9) AS risk, CASE WHEN risk >= 0.7 THEN 'HIGH' WHEN risk >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS level, round(concentration, 9) AS concentration, diversity, round(crowding, 9) AS crowding, round(top_share, 9) AS top_share, routes, total FROM rk", *ASG, SHARES),
    "overall_risk": _with("SELECT round(avg(risk), 9) AS risk FROM rk", *ASG, SHARES),
    "efficiency": _with("SELECT junction, round(evenness, 9) AS route_efficiency, round(least(total / 100, 1), 9) AS capacity FROM pr", *ASG, SHARES),
    "overall_efficiency": _with("SELECT round(avg(evenness), 9) AS efficiency FROM pr", *ASG, SHARES),
    "recommendations": _with(
        """
        , hi AS (SELECT * FROM sh WHERE share > 0.3)
        SELECT 'Signage' AS type, 'HIGH' AS priority, CAST(junction AS VARCHAR) AS junction, printf('Add directional signage at Junction %d to distribute traffic away from Branch %d (currently %.1f%% of traffic)', junction, branch, 100 * share) AS message FROM hi
        UNION ALL SELECT 'Route Modification', 'HIGH', CAST(junction AS VARCHAR), printf('Consider widening or adding alternative routes at Junction %d to reduce bottleneck risk', junction) FROM hi
        UNION ALL SELECT 'Maintenance', 'LOW', CAST(junction AS VARCHAR), printf('Junction %d shows good traffic distribution (balance ratio: %.2f) - maintain current design', junction, evenness) FROM pr WHERE evenness > 0.7 AND routes > 1
        UNION ALL SELECT 'System-wide', 'MEDIUM', 'ALL', 'High number of bottlenecks detected - consider system-wide evacuation route optimization' WHERE (SELECT count(*) FROM sh WHERE share > 0.2) > 0.5 * (SELECT count(*) FROM pr)
        """,
        *ASG, SHARES,
    ),
    "enhanced_overview": _with("SELECT round((SELECT avg(risk) FROM rk), 9) AS overall_risk, (SELECT count(*) FROM sh WHERE share > 0.6) AS bottlenecks, (SELECT count(*) FROM pr WHERE evenness > 0.7 AND routes > 1) AS balanced, 2 * (SELECT count(*) FROM sh WHERE share > 0.8) + (SELECT count(*) FROM pr WHERE evenness > 0.7 AND routes > 1) + CAST((SELECT count(*) FROM sh WHERE share > 0.6) > 0.5 * (SELECT count(*) FROM pr) AS BIGINT) AS recommendations, (SELECT count(*) FROM rk WHERE risk >= 0.4) AS at_risk", *ASG, SHARES),
    "directions_radial": _with("SELECT trajectory, junction, entered, entered AND (ax <> 0 OR az <> 0) IS TRUE AS usable, round(CASE WHEN entered AND (ax <> 0 OR az <> 0) THEN ax / sqrt(ax * ax + az * az) END, 6) AS vx, round(CASE WHEN entered AND (ax <> 0 OR az <> 0) THEN az / sqrt(ax * ax + az * az) END, 6) AS vz, CASE WHEN entered AND (ax <> 0 OR az <> 0) THEN 'radial' END AS mode_used FROM cand", *DIR),
    "directions_pathlen": _with("SELECT trajectory, junction, entered, entered AND bx IS NOT NULL AS usable, round(CASE WHEN entered THEN bx / sqrt(bx * bx + bz * bz) END, 6) AS vx, round(CASE WHEN entered THEN bz / sqrt(bx * bx + bz * bz) END, 6) AS vz, CASE WHEN entered AND bx IS NOT NULL THEN 'pathlen' END AS mode_used FROM cand".replace("FROM cand", "FROM (SELECT * EXCLUDE (bx, bz), CASE WHEN bx <> 0 OR bz <> 0 THEN bx END AS bx, CASE WHEN bx <> 0 OR bz <> 0 THEN bz END AS bz FROM cand)"), *DIR),
    "clip_to_window": _with("SELECT trajectory, junction, count(*) AS n FROM f0 WHERE abs(x - cx) <= 70 AND abs(z - cz) <= 70 GROUP BY trajectory, junction", *GEO),
    "nearest_points": _with("SELECT trajectory, junction, nearest AS decision_idx FROM en", *GEO),
    "searched_decisions": _with("SELECT trajectory, junction, coalesce(min(idx) FILTER (WHERE abs(2 * (idx - nearest) + 1) <= 2 * least(100, n // 10, 50) AND dist <= r + 0.05), any_value(nearest)) AS decision_idx FROM f1 GROUP BY trajectory, junction", *GEO),
    "first_decisions": _with("SELECT trajectory, junction, coalesce(min(idx) FILTER (WHERE abs(2 * (idx - nearest) + 1) <= 2 * least(100, n // 10, 50) AND dist <= 50.05), any_value(nearest)) AS decision_idx FROM f1 GROUP BY trajectory, junction", *GEO),
    "first_decisions_hybrid": _with("SELECT trajectory, junction, CASE WHEN any_value(ro) > 110 THEN min(idx) FILTER (WHERE dist <= ro) ELSE coalesce(min(idx) FILTER (WHERE abs(2 * (idx - nearest) + 1) <= 2 * least(100, n // 10, 50) AND dist <= 50.05), any_value(nearest)) END AS decision_idx FROM f1 GROUP BY trajectory, junction", *GEO),
    "thinned": _with("SELECT trajectory, idx, x, z FROM (SELECT *, count(*) OVER (PARTITION BY trajectory) AS m FROM pts) WHERE idx % greatest(1, m // 20) = 0", POINTS),
    "with_signals": _with("SELECT trajectory, count(*) AS n FROM sp JOIN si USING (trajectory) WHERE gaze OR physio GROUP BY trajectory", POINTS, SPARSE),
    "timing_pathlen": _with("SELECT trajectory, junction, round(max(t) FILTER (WHERE idx = pathlen_idx - 1) - max(t) FILTER (WHERE idx = start), 6) AS seconds, 'pathlen' AS mode_used FROM fr GROUP BY trajectory, junction", *GEO),
    "timing_radial": _with("SELECT trajectory, junction, round(max(t) FILTER (WHERE idx = radial_idx) - max(t) FILTER (WHERE idx = start), 6) AS seconds, 'radial' AS mode_used FROM fr GROUP BY trajectory, junction", *GEO),
    "best_fit": _with(
        """
        , f AS (SELECT count(*) AS n, avg(seg) AS m, var_pop(seg) AS v, avg(ln(seg)) AS ml, var_pop(ln(seg)) AS vl FROM st WHERE seg > 0),
        g AS (SELECT n, 4 + n * (ln(2 * pi() * v) + 1) AS normal, 4 + n * (ln(2 * pi() * vl) + 1) + 2 * n * ml AS lognormal,
              4 - 2 * n * ((m * m / v - 1) * ml - m / (v / m) - m * m / v * ln(v / m) - lgamma(m * m / v)) AS gamma FROM f)
        SELECT n, round(normal, 1) AS normal, round(lognormal, 1) AS lognormal, round(gamma, 1) AS gamma,
               CASE least(normal, lognormal, gamma) WHEN normal THEN 'normal' WHEN lognormal THEN 'lognormal' ELSE 'gamma' END AS best FROM g
        """,
        POINTS,
    ),
    "yaw_consistency": _with("SELECT junction, count(*) AS n, round(avg(abs(diff)), 6) AS mean_abs_difference, round(100 * avg(CASE WHEN abs(diff) < 30 THEN 1 ELSE 0 END), 6) AS percent_aligned FROM yw WHERE diff IS NOT NULL GROUP BY junction", *ASG, YAWS),
    "head_yaw_histogram": _with(", e AS (SELECT min(h) AS lo, max(h) AS hi FROM yw) SELECT CAST(least(floor((h - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n FROM yw, e WHERE h IS NOT NULL GROUP BY 1", *ASG, YAWS),
    "heart_rate_quartiles": _with("SELECT junction, branch, round(quantile_cont(hr, 0.25), 6) AS q1, round(quantile_cont(hr, 0.5), 6) AS median, round(quantile_cont(hr, 0.75), 6) AS q3 FROM yw WHERE hr IS NOT NULL GROUP BY junction, branch", *ASG, YAWS),
    "label_summary": _with("SELECT junction, branch, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY junction), 6) AS percent FROM asg GROUP BY junction, branch", *ASG),
    "summary_with_entropy": _with("SELECT junction, CAST(branch AS VARCHAR) AS branch, n AS count, round(100 * share, 6) AS percent FROM sh UNION ALL SELECT junction, 'entropy', NULL, round(-sum(share * ln(share)), 6) FROM sh GROUP BY junction", *ASG, SHARES),
    "repeated_assignments": _with("SELECT trajectory, junction, CAST(2 AS BIGINT) AS n FROM asg WHERE junction = 1", *ASG),
    "assignment_coverage": _with("SELECT count(*) AS input_rows, count(*) FILTER (WHERE CAST(trajectory AS INTEGER) % 2 = 0) AS kept, count(*) FILTER (WHERE CAST(trajectory AS INTEGER) % 2 <> 0) AS dropped, false AS has_decisions FROM (SELECT DISTINCT trajectory FROM asg)", *ASG),
    "numbered_trajectories": _with("SELECT trajectory, row_number() OVER (ORDER BY CAST(trajectory AS BIGINT)) - 1 AS number FROM (SELECT DISTINCT trajectory FROM asg)", *ASG),
    "movement_patterns": _with(
        """
        , w AS (SELECT f1.*, x - lag(x) OVER v AS ax, z - lag(z) OVER v AS az, lead(x) OVER v - x AS ex, lead(z) OVER v - z AS ez, lead(x) OVER v - lag(x) OVER v AS mx, lead(z) OVER v - lag(z) OVER v AS mz FROM f1 WINDOW v AS (PARTITION BY trajectory, junction ORDER BY idx)),
        d AS (SELECT trajectory, junction, coalesce(min(idx) FILTER (WHERE dist <= ro), any_value(nearest)) AS d FROM f1 GROUP BY trajectory, junction)
        SELECT trajectory, junction, d AS decision_idx, round(CASE WHEN sqrt(mx * mx + mz * mz) > 1e-3 THEN degrees(atan2(mx, mz)) END, 6) AS movement_yaw, round(CASE WHEN sqrt(ax * ax + az * az) > 1e-3 THEN degrees(atan2(ax, az)) END, 6) AS approach_yaw,
               round(CASE WHEN sqrt(ex * ex + ez * ez) > 1e-3 THEN degrees(atan2(ex, ez)) END, 6) AS exit_yaw, round(dist, 6) AS distance, round(idx / n, 6) AS progress, round(t, 6) AS t
        FROM w JOIN d USING (trajectory, junction) WHERE idx = d
        """,
        *GEO,
    ),
    "visit_movement": _with(
        """
        , w AS (SELECT f1.*, x - lag(x) OVER v AS ax, z - lag(z) OVER v AS az, lead(x) OVER v - x AS ex, lead(z) OVER v - z AS ez, lead(x) OVER v - lag(x) OVER v AS mx, lead(z) OVER v - lag(z) OVER v AS mz FROM f1 WINDOW v AS (PARTITION BY trajectory, junction ORDER BY idx)),
        d AS (SELECT trajectory, junction, min(idx) FILTER (WHERE dist <= ro) AS d FROM f1 GROUP BY trajectory, junction)
        SELECT vi.trajectory, vi.junction, vi.visit, d AS decision_idx, n, round(w.idx / n, 6) AS progress, round(CASE WHEN sqrt(mx * mx + mz * mz) > 1e-3 THEN degrees(atan2(mx, mz)) END, 6) AS movement_yaw, round(CASE WHEN sqrt(ax * ax + az * az) > 1e-3 THEN degrees(atan2(ax, az)) END, 6) AS approach_yaw,
               round(CASE WHEN sqrt(ex * ex + ez * ez) > 1e-3 THEN degrees(atan2(ex, ez)) END, 6) AS exit_yaw, round(dist, 6) AS distance, x, z, round(t, 6) AS t
        FROM vi JOIN d USING (trajectory, junction) JOIN w ON w.trajectory = vi.trajectory AND w.junction = vi.junction AND w.idx = d.d
        """,
        *GEO, VISITS,
    ),
    "sample_timing": _with(
        """
        , q AS (SELECT *, max(CASE WHEN idx = coalesce(radial_idx, pathlen_idx) THEN t END) OVER (PARTITION BY trajectory, junction) AS td FROM fr WHERE coalesce(radial_idx, pathlen_idx) IS NOT NULL),
        g AS (SELECT trajectory, junction, count(*) FILTER (WHERE t - td >= -3 AND t - td < 0) AS before, count(*) FILTER (WHERE t - td > 0 AND t - td <= 3) AS after FROM q GROUP BY trajectory, junction)
        SELECT trajectory, junction, before, after, after - before AS difference FROM g
        """,
        *GEO,
    ),
    "values_at_decisions": _with("SELECT trajectory, junction, idx AS decision_idx, (k % 10) / 10.0::DOUBLE AS gaze_x, (k % 9) / 10.0::DOUBLE AS gaze_y, hr AS heart_rate FROM fr WHERE idx = coalesce(radial_idx, pathlen_idx)", *GEO),
    "zone_points": _with("SELECT count(*) FILTER (WHERE x * x + z * z <= 3600) AS start_points, count(*) FILTER (WHERE x BETWEEN 80 AND 300 AND z BETWEEN -200 AND 200) AS end_points FROM pts", POINTS),
    "flow_results": _with("SELECT (SELECT count(DISTINCT trajectory) FROM vi) AS trajectories, count(DISTINCT origin) AS origins, count(*) AS transitions FROM fl", *SEQ),
    "zone_flows": _with(
        """
        , no AS (SELECT trajectory, idx, CASE WHEN junction IS NOT NULL THEN 'J' || junction WHEN x * x + z * z <= 3600 THEN 'A' WHEN x BETWEEN 80 AND 300 AND z BETWEEN -200 AND 200 THEN 'B' END AS node,
                 x * x + z * z <= 3600 AS in_a, x BETWEEN 80 AND 300 AND z BETWEEN -200 AND 200 AS in_b, max(idx) OVER (PARTITION BY trajectory) AS m FROM nd JOIN pts USING (trajectory, idx)),
        pv AS (SELECT *, lag(node) OVER (PARTITION BY trajectory ORDER BY idx) AS prior FROM no),
        sn AS (SELECT trajectory, CAST(idx AS DOUBLE) AS place, node FROM pv WHERE node IS NOT NULL AND node IS DISTINCT FROM prior),
        en2 AS (SELECT trajectory, arg_min(node, place) AS a, arg_max(node, place) AS b FROM sn GROUP BY trajectory),
        al AS (SELECT * FROM sn
               UNION ALL SELECT trajectory, -0.5, 'A' FROM no LEFT JOIN en2 USING (trajectory) WHERE idx = 0 AND in_a AND a IS DISTINCT FROM 'A'
               UNION ALL SELECT trajectory, idx + 0.5, 'B' FROM no LEFT JOIN en2 USING (trajectory) WHERE idx = m AND in_b AND b IS DISTINCT FROM 'B'),
        tr AS (SELECT trajectory, node AS origin, lead(node) OVER (PARTITION BY trajectory ORDER BY place) AS dest FROM al),
        ct AS (SELECT origin, dest, count(DISTINCT trajectory) AS n FROM tr WHERE dest IS NOT NULL GROUP BY origin, dest)
        SELECT origin, dest, n, round(n / (SELECT count(DISTINCT trajectory) FROM al), 9) AS share, round(n / sum(n) OVER (PARTITION BY origin), 9) AS exit_share FROM ct
        """,
        *SEQ,
    ),
    "route_statistics": _with(
        """
        , p AS (SELECT trajectory, junction, branch FROM asg WHERE branch >= 0),
        q AS (SELECT p.* FROM p WHERE (SELECT count(*) FROM p o WHERE o.trajectory = p.trajectory AND o.junction <= p.junction) = p.junction + 1),
        s AS (SELECT trajectory, string_agg(CAST(branch AS VARCHAR), '-' ORDER BY junction) AS route, count(*) AS k FROM q GROUP BY trajectory HAVING count(*) > 1),
        l AS (SELECT k, count(*) AS n FROM s GROUP BY k)
        SELECT (SELECT count(*) FROM s) AS sequences, (SELECT count(DISTINCT route) FROM s) AS different, round(coalesce((SELECT avg(k) FROM s), 0), 9) AS mean_length, '{' || (SELECT coalesce(string_agg('"' || k || '":' || n, ',' ORDER BY k), '') FROM l) || '}' AS lengths
        """,
        *ASG,
    ),
    "junction_heatmaps": _with(
        """
        , b AS (SELECT *, avg(pupil) OVER w AS mean, count(pupil) OVER w AS valid FROM f0 WHERE pupil IS NOT NULL AND dist <= ro WINDOW w AS (PARTITION BY trajectory, junction)),
        v AS (SELECT junction, (x - (cx - 1.2 * ro)) / ((cx + 1.2 * ro) - (cx - 1.2 * ro)) * 10 AS u, (z - (cz - 1.2 * ro)) / ((cz + 1.2 * ro) - (cz - 1.2 * ro)) * 10 AS w, (pupil - mean) / mean * 100 AS value FROM b WHERE valid >= 2)
        SELECT junction, CAST(floor(u) AS INTEGER) AS ix, CAST(floor(w) AS INTEGER) AS iz, round((max((abs(value), value)))[2], 6) AS value, count(*) AS n FROM v GROUP BY ALL
        """.replace("GROUP BY ALL", "GROUP BY 1, 2, 3"),
        POINTS, JUNCTIONS, FRAME,
    ),
    "step_density": _with(
        """
        , v AS (SELECT seg AS v FROM st WHERE seg IS NOT NULL),
        s AS (SELECT count(*) AS n, 1.06 * stddev_samp(v) * count(*) ** -0.2 AS h, quantile_cont(v, 0.01) AS a, quantile_cont(v, 0.99) AS b FROM v),
        gr AS (SELECT a + g * ((b - a) / 199) AS at_, h, n FROM s, range(200) r(g))
        SELECT round(at_, 6) AS "at", round(sum(exp(-0.5 * ((at_ - v.v) / h) ** 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 9) AS density FROM gr, v GROUP BY at_
        """,
        POINTS,
    ),
    "intent_features": _with(
        """
        , an0 AS (SELECT trajectory, junction, (min((abs(dist - (r + 50)), idx)))[2] AS anchor FROM f1 WHERE entered AND first_in >= 10 AND idx < first_in GROUP BY trajectory, junction),
        an AS (SELECT * FROM an0 WHERE anchor >= 5),
        n0 AS (SELECT f1.*, anchor, anchor - idx AS l, row_number() OVER w - 1 AS i, t - lag(t) OVER w AS dt, atan2(fx, fz) AS head, lag(atan2(fx, fz)) OVER w AS head0, (f1.k % 9) / 10.0::DOUBLE AS gy, (f1.k % 10) / 10.0::DOUBLE AS gx
               FROM f1 JOIN an USING (trajectory, junction) WHERE idx BETWEEN anchor - 10 AND anchor WINDOW w AS (PARTITION BY trajectory, junction ORDER BY idx)),
        n1 AS (SELECT *, CASE WHEN i > 0 THEN seg / CASE WHEN dt > 0 THEN dt ELSE 1 END END AS v, CASE WHEN i > 0 THEN atan2(dz, dx) END AS course FROM n0),
        n2 AS (SELECT *, CASE WHEN i > 1 AND l < 4 THEN v - lag(v) OVER w END AS dv, CASE WHEN i > 1 THEN course - lag(course) OVER w END AS bend FROM n1 WINDOW w AS (PARTITION BY trajectory, junction ORDER BY idx)),
        g AS (SELECT trajectory, junction, max(dist) FILTER (WHERE l = 0) AS distance, any_value(cx) AS cx, any_value(cz) AS cz, max(x) FILTER (WHERE l = 0) AS x1, max(z) FILTER (WHERE l = 0) AS z1, (min((idx, x, z)))[2] AS x0, (min((idx, x, z)))[3] AS z0,
              sum(seg) FILTER (WHERE i > 0) AS path, max(i) AS steps, avg(v) FILTER (WHERE l < 3) AS speed, avg(dv) AS dv, avg(abs(atan2(sin(bend), cos(bend)))) AS bend, max(atan2(gy, gx)) FILTER (WHERE l = 0) AS gaze,
              stddev_pop(head - head0) AS hv, max(hr) FILTER (WHERE l = 0) AS hr, arg_max(hr, idx) - arg_min(hr, idx) AS hrt, max(pupil) FILTER (WHERE l = 0) AS pu,
              arg_max(pupil, idx) FILTER (WHERE pupil IS NOT NULL) - arg_min(pupil, idx) FILTER (WHERE pupil IS NOT NULL) AS put FROM n2 GROUP BY trajectory, junction),
        q AS (SELECT *, x1 - x0 AS mx, z1 - z0 AS mz, cx - x1 AS jx, cz - z1 AS jz, sqrt((x1 - x0) ** 2 + (z1 - z0) ** 2) AS chord FROM g)
        SELECT trajectory, junction, round(distance, 5) AS distance, round(abs(atan2(sin(atan2(mz, mx) - atan2(jz, jx)), cos(atan2(mz, mx) - atan2(jz, jx)))), 5) AS approach_angle, round(abs(mx * jz - mz * jx) / (chord + 1e-6), 5) AS lateral_offset,
               round(speed, 5) AS speed, round(CASE WHEN steps >= 5 THEN dv ELSE 0 END, 5) AS acceleration, round(CASE WHEN steps >= 3 THEN bend ELSE 0 END, 5) AS curvature, round(path / (chord + 1e-6), 5) AS sinuosity,
               round(CASE WHEN speed > 0 THEN distance / speed END, 5) AS time_to_junction, round(gaze, 5) AS gaze_angle, round(cos(gaze - atan2(jz, jx)), 5) AS gaze_alignment, round(hv, 5) AS head_variability,
               hr AS heart_rate, hrt AS heart_rate_trend, round(pu, 5) AS pupil, round(put, 5) AS pupil_trend, -1.0::DOUBLE AS previous_choice FROM q
        """,
        *GEO,
    ),
    "dbscan_branches": _with("SELECT ve.trajectory, ve.junction, CAST(CASE WHEN NOT entered THEN -2 ELSE coalesce(branch, -1) END AS INTEGER) AS branch FROM ve LEFT JOIN cl ON cl.trajectory = ve.trajectory AND cl.junction = ve.junction LEFT JOIN ck ON ck.junction = cl.junction AND ck.k = cl.k", *DIR, CLUSTERS),
    "dbscan_centers": _with("SELECT junction, branch, round(mx / sqrt(mx * mx + mz * mz), 6) AS ux, round(mz / sqrt(mx * mx + mz * mz), 6) AS uz FROM ck", *DIR, CLUSTERS),
}
QUERIES["discovered_chain"] = QUERIES["dbscan_branches"].replace("SELECT ve.trajectory, ve.junction, CAST(", ", db AS (SELECT ve.trajectory, ve.junction, CAST(") + ") SELECT trajectory, " + ", ".join(f"max(branch) FILTER (WHERE junction = {j}) AS branch_j{j}" for j in range(4)) + " FROM db GROUP BY trajectory"
QUERIES["pupil_heatmap"] = _with(
    """
    , b AS (SELECT *, avg(pupil) OVER w AS mean, count(pupil) OVER w AS valid FROM pts WHERE pupil IS NOT NULL WINDOW w AS (PARTITION BY trajectory)),
    v AS (SELECT x, z, (pupil - mean) / mean * 100 AS value FROM b WHERE valid >= 2),
    e AS (SELECT min(x) - 0.05 * (max(x) - min(x)) AS x0, max(x) + 0.05 * (max(x) - min(x)) AS x1, min(z) - 0.05 * (max(z) - min(z)) AS z0, max(z) + 0.05 * (max(z) - min(z)) AS z1 FROM v)
    SELECT CAST(least(floor((x - x0) / (x1 - x0) * 10), 9) AS INTEGER) AS ix, CAST(least(floor((z - z0) / (z1 - z0) * 10), 9) AS INTEGER) AS iz, round(avg(value), 6) AS value, count(*) AS n FROM v, e GROUP BY 1, 2
    """,
    POINTS,
)

QUERIES["pupil_heatmap_max"] = _with(
    """
    , b AS (SELECT *, avg(pupil) OVER w AS mean, stddev_pop(pupil) OVER w AS sd, count(pupil) OVER w AS valid FROM pts WHERE pupil IS NOT NULL WINDOW w AS (PARTITION BY trajectory)),
    v AS (SELECT x, z, (pupil - mean) / sd AS value FROM b WHERE valid >= 2 AND sd <> 0),
    e AS (SELECT min(x) - 0.05 * (max(x) - min(x)) AS x0, max(x) + 0.05 * (max(x) - min(x)) AS x1, min(z) - 0.05 * (max(z) - min(z)) AS z0, max(z) + 0.05 * (max(z) - min(z)) AS z1 FROM v)
    SELECT CAST(floor((x - x0) / (x1 - x0) * 10) AS INTEGER) AS ix, CAST(floor((z - z0) / (z1 - z0) * 10) AS INTEGER) AS iz, round((max((abs(value), value)))[2], 6) AS value, count(*) AS n FROM v, e GROUP BY 1, 2
    """,
    POINTS,
)
QUERIES["mean_headings"] = _with("SELECT trajectory, round(atan2(avg(sin(atan2(dz, dx))), avg(cos(atan2(dz, dx)))), 6) AS heading FROM st WHERE seg > 0 GROUP BY trajectory", POINTS)
QUERIES["sharpest_turns"] = _with(", c AS (SELECT trajectory, idx, atan2(dz, dx) AS a FROM st WHERE seg > 0), d AS (SELECT trajectory, a - lag(a) OVER (PARTITION BY trajectory ORDER BY idx) AS b FROM c) SELECT trajectory, round(max(abs(atan2(sin(b), cos(b)))), 6) AS sharpest FROM d GROUP BY trajectory", POINTS)
QUERIES["split_outliers"] = _with(
    """
    , c AS (SELECT junction, branch, n, n < ceil(0.2 * total) AS a, total FROM sh),
    s AS (SELECT *, a OR (bool_or(a) OVER (PARTITION BY junction) AND n < 200) AS is_small FROM c)
    SELECT junction, branch, is_small, CAST(CASE WHEN NOT is_small THEN count(CASE WHEN NOT is_small THEN 1 END) OVER (PARTITION BY junction ORDER BY branch) - 1 END AS INTEGER) AS main_branch FROM s
    """,
    *ASG, SHARES,
)


def _of(name: str) -> str:
    """A query's statement as a table."""
    return f"({QUERIES[name]})"


QUERIES["heatmap_scale"] = f"SELECT -s AS low, s AS high FROM (SELECT CASE WHEN max(abs(value)) <= 5 THEN 5.0 WHEN max(abs(value)) <= 10 THEN 10.0 WHEN max(abs(value)) <= 25 THEN 25.0 WHEN max(abs(value)) <= 50 THEN 50.0 ELSE 60.0 END::DOUBLE AS s FROM {_of('pupil_heatmap')})"
QUERIES["heatmap_statistics"] = f"SELECT round(avg(value), 6) AS mean, max(abs(value)) AS max_abs, max(value) AS max, min(value) AS min, count(*) AS cells FROM {_of('pupil_heatmap')}"
QUERIES["diagnostics"] = f"SELECT trajectory, junction, reason IN ('radial', 'pathlen') AS used, reason FROM (SELECT trajectory, junction, reason FROM {_of('decision_points')} UNION ALL SELECT trajectory, junction, mode_used FROM {_of('decision_points')} WHERE reason = 'no_decision_point')"
QUERIES["metrics_table"] = f"SELECT * FROM {_of('timing_modes')} JOIN {_of('speed_through_junction')} USING (trajectory, junction) JOIN {_of('transit_speed')} USING (trajectory, junction) JOIN {_of('step_and_path_length')} AS whole USING (trajectory) LEFT JOIN {_of('regions_dt')} USING (trajectory)".replace("SELECT * FROM", "SELECT a.*, b.speed AS speed_through, b.status, c.entry_speed, c.exit_speed, c.average_speed, whole.distance, whole.duration, whole.speed, t_a, t_b, dt_ab FROM", 1).replace(") JOIN (WITH", ") AS a JOIN (WITH", 1).replace(") USING (trajectory, junction) JOIN", ") AS b USING (trajectory, junction) JOIN", 1).replace(") USING (trajectory, junction) JOIN (WITH", ") AS c USING (trajectory, junction) JOIN (WITH", 1)
QUERIES["normalized_assignments"] = f"SELECT trajectory, branch AS branch_j1, decision_idx, intercept_x, intercept_z FROM {_of('assign_fixed_centers')} LEFT JOIN {_of('decision_points')} USING (trajectory, junction) WHERE junction = 1 AND branch >= 0"
QUERIES["branch_directions"] = f"""
WITH {JUNCTIONS},
b AS (SELECT junction, branch, intercept_x - cx AS dx, intercept_z - cz AS dz FROM {_of('assign_fixed_centers')} JOIN {_of('decision_points')} USING (trajectory, junction) JOIN jn USING (junction) WHERE branch >= 0 AND decision_idx IS NOT NULL),
g AS (SELECT junction, branch, avg(dx) AS mx, avg(dz) AS mz, atan2(avg(sin(atan2(dx, dz))), avg(cos(atan2(dx, dz)))) AS y FROM b GROUP BY junction, branch)
SELECT junction, branch, round(mx / sqrt(mx * mx + mz * mz), 6) AS ux, round(mz / sqrt(mx * mx + mz * mz), 6) AS uz, CAST(row_number() OVER (PARTITION BY junction ORDER BY y, branch) - 1 AS INTEGER) AS turn FROM g
"""
QUERIES["center_mismatches"] = f"""
WITH {JUNCTIONS},
ce(center, ux, uz) AS (VALUES (0, 1.0::DOUBLE, 0.0::DOUBLE), (1, 0.0, 1.0), (2, -1.0, 0.0), (3, 0.0, -1.0)),
b AS (SELECT trajectory, junction, branch, arg_min(center, (-((intercept_x - cx) * ux + (intercept_z - cz) * uz), center)) AS center FROM {_of('assign_fixed_centers')} JOIN {_of('decision_points')} USING (trajectory, junction) JOIN jn USING (junction), ce WHERE branch >= 0 AND intercept_x IS NOT NULL GROUP BY trajectory, junction, branch)
SELECT junction, count(*) AS n, round(avg(CASE WHEN center <> branch THEN 1 ELSE 0 END), 6) AS mismatch_rate FROM b GROUP BY junction
"""
QUERIES["gaze_headlines"] = f"SELECT round((SELECT avg(heart_rate_change) FROM {_of('physiology_windows')}), 6) AS heart_rate_change, (SELECT count(*) FROM {_of('physiology_windows')}) AS measurements, round(p.b, 6) AS pupil_baseline, round(p.d, 6) AS pupil_decision, round(p.c, 6) AS pupil_change, round(y.h, 6) AS head_yaw, round(y.f, 6) AS yaw_difference FROM (SELECT avg(pupil_baseline) AS b, avg(pupil_decision) AS d, avg(pupil_change) AS c FROM {_of('pupil_windows')}) p, (SELECT avg(head_yaw) AS h, avg(yaw_difference) AS f FROM {_of('head_yaw')}) y"


def _adaptive(path: str, ring: str, parts: tuple[str, ...]) -> tuple[str, ...]:
    """The frame with another path length or ring of each trajectory's length (total)."""
    points = parts[0].replace("count(*) OVER (PARTITION BY trajectory) AS n", "count(*) OVER (PARTITION BY trajectory) AS n, 0.0 AS total")
    points += ", st2 AS (SELECT * REPLACE (coalesce(sum(seg) OVER (PARTITION BY trajectory), 0) AS total) FROM st)"
    made = parts[2].replace("SELECT st.*, jn.*,", f"SELECT st.*, jn.* REPLACE (CASE WHEN {ring} > r THEN {ring} ELSE r + 10 END AS ro),").replace("FROM st, jn", "FROM st2 st, jn").replace("path >= 100.005", f"path >= {path}")
    return points, parts[1], made


def _adaptive_query(mode: str, first: tuple[str, ...], again: tuple[str, ...]) -> str:
    end = {"radial": "trend_idx", "pathlen": "pathlen_idx"}[mode]
    seconds = "max(t) FILTER (WHERE idx = radial_idx)" if mode == "radial" else "max(t) FILTER (WHERE idx = pathlen_idx - 1)"
    time = f"SELECT trajectory, junction, {seconds} - max(t) FILTER (WHERE idx = start) AS s FROM fr GROUP BY trajectory, junction"
    speed = f"""
    , g AS (SELECT trajectory, junction, any_value(entered) AS entered, any_value({end}) AS e, any_value(start) AS s, any_value(n) AS n, sum(seg) FILTER (WHERE idx > start AND idx <= {end}) AS path, max(t) FILTER (WHERE idx = {end}) - max(t) FILTER (WHERE idx = start) AS time FROM fr GROUP BY trajectory, junction)
    SELECT trajectory, junction, entered, round(CASE WHEN time > 0 THEN path / time END, 6) AS speed, CASE WHEN e IS NULL THEN CASE WHEN s = n - 1 AND '{mode}' = 'pathlen' THEN 'no_movement' ELSE '{mode}_not_reached' END WHEN time > 0 THEN '{mode}' ELSE '{mode}_zero_time' END AS speed_mode FROM g
    """
    return f"""
    SELECT trajectory, junction, CASE WHEN entered THEN round(coalesce(a.s, b.s), 6) END AS seconds, CASE WHEN entered THEN '{mode}' ELSE 'no_entry' END AS mode_used, CASE WHEN entered THEN speed END AS speed, CASE WHEN entered THEN speed_mode ELSE 'no_entry' END AS speed_mode,
           CASE WHEN entered THEN entry_speed END AS entry_speed, CASE WHEN entered THEN exit_speed END AS exit_speed, CASE WHEN entered THEN average_speed END AS average_speed
    FROM ({_with(time, *first)}) a JOIN ({_with(time, *again)}) b USING (trajectory, junction) JOIN ({_with(speed, *first)}) c USING (trajectory, junction) JOIN {_of('transit_speed')} d USING (trajectory, junction)
    """


QUERIES["adaptive_pathlen"] = _adaptive_query("pathlen", _adaptive("least(greatest(0.05 * total, 0.1), 10)", "ro", GEO), _adaptive("greatest(0.01 * total, 0.01)", "ro", GEO))
QUERIES["adaptive_radial"] = _adaptive_query("radial", _adaptive("100", "least(greatest(0.1 * total, 5), 50)", GEO), _adaptive("100", "greatest(0.05 * total, 2)", GEO))
QUERIES["junction_means"] = f"""
SELECT junction, round(avg(seconds) FILTER (WHERE average_speed IS NOT NULL), 4) AS time, round(avg(average_speed) FILTER (WHERE seconds IS NOT NULL), 4) AS speed,
       round(CASE WHEN count(exit_speed) > 0 THEN avg(entry_speed) END, 4) AS entry_speed, round(CASE WHEN count(entry_speed) > 0 THEN avg(exit_speed) END, 4) AS exit_speed, round(avg(seconds), 4) AS seconds
FROM {_of('adaptive_radial')} GROUP BY junction
"""
