"""DuckDB SQL with the same columns and rounding as the queries.

Written independently of the Spark operators: brute-force distances, plain
windows and recursive CTEs over the whole tables.
"""

from geoaffinity import fixtures as fx

RATE, WIDTH, NEAR, RANK, FOLDS, SEED = 0.9, 500.0, 1000.0, 8, 10, 42
LP = LQ = 0.01


def bits(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


def uniform(*parts: str) -> str:
    return f"({bits(*parts)} / 4294967296.0::DOUBLE)"


def hav(lat1, lng1, lat2, lng2, radius="6372800.0"):
    dlat = f"sin((radians({lat2}) - radians({lat1})) / 2.0::DOUBLE)"
    dlng = f"sin((radians({lng2}) - radians({lng1})) / 2.0::DOUBLE)"
    return (f"(2.0::DOUBLE * {radius}::DOUBLE * asin(sqrt(least(1.0::DOUBLE, {dlat} * {dlat} + "
            f"cos(radians({lat1})) * cos(radians({lat2})) * ({dlng} * {dlng})))))")


def softplus(z):
    return f"(greatest({z}, 0.0::DOUBLE) + ln(1.0::DOUBLE + exp(-abs({z}))))"


CTE: dict[str, tuple[str, list[str]]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTE[name] = (body, list(needs))


def sql(final: str, *needs: str) -> str:
    order: list[str] = []

    def visit(name):
        for n in CTE[name][1]:
            visit(n)
        if name not in order:
            order.append(name)

    for n in needs:
        visit(n)
    head = ",\n".join(f"{n} AS ({CTE[n][0]})" for n in order)
    return f"WITH RECURSIVE {head}\n{final}" if order else final


# ---- sighting log -----------------------------------------------------------

cte("sightings", """
SELECT CAST(floor(epoch(ts)) AS BIGINT) AS second, user_id AS "user",
  concat(lpad(CAST((user_id * 31 + CASE WHEN k < 88 THEN CAST(floor((day(ts) - 1) / 15) AS BIGINT)
         ELSE 2 END) % 200 AS VARCHAR), 8, '0'), lpad(CAST(event_id AS VARCHAR), 7, '0')) AS imei,
  concat('C', lpad(CAST((user_id * 13 + CASE WHEN hour(ts) < 8 OR hour(ts) >= 20 THEN 0
         WHEN isodow(ts) - 1 < 5 AND hour(ts) BETWEEN 9 AND 16 THEN 140 ELSE 60 END + k % 4) % 400
         AS VARCHAR), 6, '0')) AS cell
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""")
cte("cells_raw", """
SELECT concat(CASE WHEN c_custkey % 40 = 39 THEN 'X' ELSE 'C' END,
              lpad(CAST(c_custkey AS VARCHAR), 6, '0')) AS cell,
  CASE WHEN c_custkey % 40 = 38 THEN 33.0::DOUBLE
       ELSE 30.5::DOUBLE + (c_custkey % 20) * 0.002::DOUBLE - 0.0::DOUBLE END AS lat,
  120.5::DOUBLE + (c_custkey // 20) * 0.002::DOUBLE AS lng FROM customer
UNION ALL
SELECT concat(CASE WHEN s_suppkey % 40 = 39 THEN 'X' ELSE 'C' END,
              lpad(CAST(s_suppkey AS VARCHAR), 6, '0')),
  CASE WHEN s_suppkey % 40 = 38 THEN 33.0::DOUBLE
       ELSE 30.5::DOUBLE + (s_suppkey % 20) * 0.002::DOUBLE - 0.001::DOUBLE END,
  120.5::DOUBLE + (s_suppkey // 20) * 0.002::DOUBLE FROM supplier""")
cte("cells", """
SELECT cell, lat, lng FROM (SELECT *, row_number() OVER
  (PARTITION BY cell ORDER BY lat DESC, lng DESC) AS r FROM cells_raw) WHERE r = 1""", "cells_raw")
cte("devices", """
SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS tac, max(concat_ws('#', p_brand, p_name)) AS device
FROM part WHERE lower(CASE WHEN p_partkey % 10 = 9 THEN 'FeaturePhone' ELSE 'SmartPhone' END)
  = 'smartphone' GROUP BY 1""")
cte("valid", f"""
SELECT second, "user", substr(imei, 1, 8) AS tac, cell,
  strftime(make_timestamp(second * 1000000), '%Y%m%d') AS day FROM sightings
WHERE strftime(make_timestamp(second * 1000000), '%Y%m%d') BETWEEN '{fx.DAYS[0]}' AND '{fx.DAYS[1]}'
  AND cell IN (SELECT cell FROM cells) AND substr(imei, 1, 8) IN (SELECT tac FROM devices)""",
    "sightings", "cells", "devices")
cte("context", """
SELECT second, "user", tac, hour(make_timestamp(second * 1000000))::BIGINT AS hour,
  (isodow(make_timestamp(second * 1000000)) - 1)::BIGINT AS wday, lat, lng
FROM valid JOIN cells USING (cell)""", "valid", "cells")
cte("named", """SELECT second, "user", device, cell, day FROM valid JOIN devices USING (tac)""",
    "valid", "devices")
cte("days", """
SELECT "user", day, btime, device, n FROM (
  SELECT *, row_number() OVER (PARTITION BY "user", day ORDER BY n DESC, btime, device) AS r FROM (
    SELECT "user", day, device, count(*) AS n, min(second) AS btime FROM named GROUP BY ALL))
WHERE r = 1""", "named")
cte("ordered", """SELECT "user", btime, device,
  row_number() OVER (PARTITION BY "user" ORDER BY btime, device) AS pos FROM days""", "days")
# The fold as a walk: (a, b) are the last two kept entries. A blip replaces b and
# keeps a; anything else keeps b and moves on, growing the kept list by one.
cte("walk", """
SELECT "user", pos, 1 AS size, NULL::VARCHAR AS a, device AS b, btime AS tb FROM ordered WHERE pos = 1
UNION ALL
SELECT o."user", o.pos,
  CASE WHEN w.a = o.device AND w.b <> o.device THEN w.size ELSE w.size + 1 END,
  CASE WHEN w.a = o.device AND w.b <> o.device THEN w.a ELSE w.b END, o.device, o.btime
FROM walk w JOIN ordered o ON o."user" = w."user" AND o.pos = w.pos + 1""", "ordered")
cte("kept", """
SELECT "user", size, b AS device, tb AS btime FROM (SELECT *, row_number() OVER
  (PARTITION BY "user", size ORDER BY pos DESC) AS r FROM walk) WHERE r = 1""", "walk")
cte("history", """
SELECT "user", row_number() OVER (PARTITION BY "user" ORDER BY size) - 1 AS seq, btime, device,
  count(*) OVER (PARTITION BY "user") AS runs FROM (
  SELECT *, lag(device) OVER (PARTITION BY "user" ORDER BY size) AS prev FROM kept)
WHERE prev IS NULL OR prev <> device""", "kept")
cte("normal", "SELECT * FROM history WHERE runs < 5", "history")
cte("coverage", f"""
SELECT device, cnt, prefix, d FROM (SELECT *,
  sum(cnt) OVER (ORDER BY cnt DESC, device ROWS UNBOUNDED PRECEDING)::BIGINT AS prefix,
  row_number() OVER (ORDER BY cnt DESC, device) - 1 AS d, sum(cnt) OVER () AS total
  FROM (SELECT device, count(*) AS cnt FROM normal GROUP BY 1))
WHERE prefix <= {RATE}::DOUBLE * total""", "normal")
cte("covered", "SELECT * FROM normal WHERE device IN (SELECT device FROM coverage)",
    "normal", "coverage")
cte("users", """SELECT "user", row_number() OVER (ORDER BY "user") - 1 AS u
FROM (SELECT DISTINCT "user" FROM covered)""", "covered")

# ---- places -----------------------------------------------------------------

cte("counts", """
SELECT place_type, "user", round(lat, 6) AS lat, round(lng, 6) AS lng, count(*) AS cnt FROM (
  SELECT *, CASE WHEN hour < 8 OR hour >= 20 THEN 'home'
    WHEN wday < 5 AND hour BETWEEN 9 AND 16 THEN 'work' END AS place_type FROM context)
WHERE place_type IS NOT NULL GROUP BY ALL""", "context")
cte("area", "SELECT * FROM counts WHERE lat BETWEEN 30 AND 32 AND lng BETWEEN 120 AND 123", "counts")
BIAS = f"ln({WIDTH}::DOUBLE) + 0.5 * ln(2 * pi())"
KERNEL = f"exp(-0.5::DOUBLE * pow(dist / {WIDTH}::DOUBLE, 2) - ({BIAS}))"
cte("density", f"""
SELECT place_type, "user", lat, lng, cnt, sum(other * {KERNEL}) AS density FROM (
  SELECT a.*, b.cnt AS other, {hav('a.lat', 'a.lng', 'b.lat', 'b.lng')} AS dist
  FROM area a JOIN area b ON a.place_type = b.place_type AND a."user" = b."user")
GROUP BY place_type, "user", lat, lng, cnt""", "area")
cte("starts", """
SELECT place_type, "user", lat, lng FROM (SELECT *, row_number() OVER
  (PARTITION BY place_type, "user" ORDER BY round(density, 12) DESC, lat, lng) AS r FROM density)
WHERE r = 1""", "density")
cte("shift", f"""
SELECT place_type, "user", lat, lng, false AS done, 0 AS steps FROM starts
UNION ALL
SELECT place_type, "user", nlat, nlng,
  nlat IS NULL OR sqrt(pow(nlat - lat, 2) + pow(nlng - lng, 2)) < 1e-5 AS done, steps + 1 FROM (
  SELECT place_type, "user", lat, lng, steps, sum(w * plat) / nullif(sum(w), 0) AS nlat,
    sum(w * plng) / nullif(sum(w), 0) AS nlng FROM (
    SELECT *, CASE WHEN dist <= {WIDTH} THEN cnt * {KERNEL} ELSE 0 END AS w FROM (
      SELECT s.place_type, s."user", s.lat, s.lng, s.steps, p.lat AS plat, p.lng AS plng, p.cnt,
        {hav('s.lat', 's.lng', 'p.lat', 'p.lng')} AS dist
      FROM shift s JOIN area p ON s.place_type = p.place_type AND s."user" = p."user"
      WHERE NOT s.done AND s.steps < 100))
  GROUP BY place_type, "user", lat, lng, steps)""", "starts", "area")
cte("semantic", """
SELECT place_type, "user", lat, lng, steps FROM (SELECT *, row_number() OVER
  (PARTITION BY place_type, "user" ORDER BY steps DESC) AS r FROM shift) WHERE r = 1""", "shift")
cte("wide", """
SELECT "user", max(lat) FILTER (place_type = 'home') AS hlat, max(lng) FILTER (place_type = 'home') AS hlng,
  max(lat) FILTER (place_type = 'work') AS wlat, max(lng) FILTER (place_type = 'work') AS wlng
FROM semantic GROUP BY 1""", "semantic")
cte("named_places", """SELECT u, hlat, hlng, wlat, wlng FROM wide JOIN users USING ("user")
WHERE hlat IS NOT NULL AND wlat IS NOT NULL""", "wide", "users")

# ---- user graph -------------------------------------------------------------


def _deg(base, factor, modulus, name):
    return f"{base}::DOUBLE + ((c_custkey * {factor}) % {modulus}) * 0.0001::DOUBLE AS {name}"


cte("places", f"""SELECT c_custkey AS u, {_deg(30.5, 7919, 997, 'hlat')},
  {_deg(120.5, 104729, 1009, 'hlng')}, {_deg(30.5, 1299709, 1013, 'wlat')},
  {_deg(120.5, 15485863, 1019, 'wlng')} FROM customer""")
cte("sites", "SELECT hlat, hlng, wlat, wlng, count(*) AS n FROM places GROUP BY ALL", "places")


def _legs(radius="6372800.0"):
    home = hav("a.hlat", "a.hlng", "b.hlat", "b.hlng", radius)
    work = hav("a.wlat", "a.wlng", "b.wlat", "b.wlng", radius)
    return home, work


def _brute(source: str, meters: float) -> str:
    """All ordered user pairs with their squared distance."""
    home, work = _legs()
    return f"""SELECT src, dst, dh * dh + dw * dw AS d2 FROM (
  SELECT a.u AS src, b.u AS dst, {home} AS dh, {work} AS dw FROM {source} a JOIN {source} b ON a.u <> b.u)
WHERE dh * dh + dw * dw <= 2.0::DOUBLE * {meters}::DOUBLE * {meters}::DOUBLE"""


def _knn(source: str, meters: float) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS rank
FROM ({_brute(source, meters)})) WHERE rank <= 10"""


cte("knn", _knn("places", NEAR), "places")
cte("knn2000", _knn("places", 2000.0), "places")
cte("graph", "SELECT src, dst, sqrt(d2 / 2.0) / 1000.0 AS dist_km, rank FROM knn2000", "knn2000")
cte("friends", """SELECT src, dst, exp(-dist_km) / sum(exp(-dist_km)) OVER (PARTITION BY src) AS score
FROM graph""", "graph")
cte("steps", """
SELECT CAST(k AS BIGINT) AS k, CAST(s AS BIGINT) AS d_step, s * 0.1::DOUBLE AS d
FROM range(1, 11) a(k), range(1, 21) b(s)""")

# ---- interactions -----------------------------------------------------------

cte("item_usage", """
SELECT strftime(o_orderdate, '%Y%m%d') AS date, o_custkey AS u, concat_ws('#', p_brand, p_type) AS item
FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey""")
cte("catalog", """SELECT item, row_number() OVER (ORDER BY count(*) DESC, item) - 1 AS d
FROM item_usage GROUP BY item""", "item_usage")
cte("numbered", "SELECT date, u, d FROM item_usage JOIN catalog USING (item)", "item_usage", "catalog")
cte("pairs", "SELECT DISTINCT u, d FROM numbered", "numbered")
cte("inter", "SELECT 0::BIGINT AS fold, u, d FROM pairs", "pairs")
cte("inter2", f"SELECT fold, u, d FROM pairs, range({FOLDS}) t(fold)", "pairs")
cte("inter10", "SELECT fold, u, d FROM pairs, range(10) t(fold)", "pairs")
cte("tsplit", f"""
SELECT * FROM (SELECT *, CASE WHEN date BETWEEN '{fx.TRAIN[0]}' AND '{fx.TRAIN[1]}' THEN 'train'
  WHEN date BETWEEN '{fx.TEST[0]}' AND '{fx.TEST[1]}' THEN 'test' END AS part FROM numbered)
WHERE part IS NOT NULL""", "numbered")


def _split(source: str) -> str:
    draw = uniform(f"fold + {SEED}", "u", "d")
    return f"""SELECT fold, u, d, CASE WHEN c > 1 AND {draw} < least(1.0::DOUBLE,
    count(*) OVER (PARTITION BY fold) * (1.0 - 0.8)::DOUBLE
    / sum(CASE WHEN c > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY fold)) THEN 'valid' ELSE 'train' END AS part
  FROM (SELECT *, count(*) OVER (PARTITION BY fold, u) AS c FROM {source})"""


for _name, _from in (("split", "inter"), ("split2", "inter2"), ("split10", "inter10")):
    cte(_name, _split(_from), _from)

cte("prime", """
SELECT n, (SELECT min(p) FROM range(n, 2 * n + 2) t(p)
  WHERE p > 1 AND NOT EXISTS (SELECT 1 FROM range(2, n + 1000) f(x) WHERE x * x <= p AND p % x = 0)) AS prime
FROM (SELECT count(DISTINCT d) AS n FROM pairs)""", "pairs")


def _negatives(steps: str, order: str | None, times: int, inter: str = "inter") -> str:
    pick = f"WHERE r <= c * {times}" if order else ""
    rank = f"row_number() OVER (PARTITION BY fold, u ORDER BY {order})" if order else "0"
    return f"""
SELECT fold, u, d, 1::BIGINT AS x FROM {inter} UNION ALL
SELECT fold, u, d, 0::BIGINT FROM (SELECT *, {rank} AS r FROM (
  SELECT w.fold, w.u, w.c, w.j, (a * j + b) % prime AS d FROM (
    SELECT *, unnest(range(least(prime, {steps})::BIGINT)) AS j FROM (
      SELECT fold, u, count(*) AS c, any_value(n) AS n, any_value(prime) AS prime,
        any_value(1 + floor({uniform(f'fold + {SEED}', 'u', "'a'")} * (prime - 1))::BIGINT) AS a,
        any_value(floor({uniform(f'fold + {SEED}', 'u', "'b'")} * prime)::BIGINT) AS b
      FROM {inter}, prime GROUP BY fold, u)) w
  WHERE (a * j + b) % prime < n) q
  WHERE NOT EXISTS (SELECT 1 FROM {inter} i WHERE i.fold = q.fold AND i.u = q.u AND i.d = q.d)) {pick}"""


cte("samples", _negatives("c + c + prime - n", "j", 1), "inter", "prime")
cte("samples_x2", _negatives("2 * c + c + prime - n", "j", 2), "inter", "prime")


def _bernoulli(inter: str) -> str:
    """Each unused item with probability c / (unused items): every gap between two draws is looked up, far beyond the last
    one, and added up."""
    u = uniform(f"fold + {SEED}", "u", "'gap'", "k")
    return f"""
SELECT fold, u, d, 1::BIGINT AS x FROM {inter} UNION ALL
SELECT fold, u, d, 0::BIGINT FROM (SELECT *, row_number() OVER (PARTITION BY fold, u ORDER BY d) AS r FROM (
  SELECT fold, u, c, n, (sum(CASE WHEN p >= 1 THEN 0 ELSE floor(ln(1.0::DOUBLE - {u}) / ln(1.0::DOUBLE - p)) END + 1)
    OVER (PARTITION BY fold, u ORDER BY k) - 1)::BIGINT AS d FROM (
    SELECT *, unnest(range(least(n, ceil(n * p + 12 * sqrt(n * p) + 40)::BIGINT))) AS k FROM (
      SELECT *, c::DOUBLE / greatest(1, n - c)::DOUBLE AS p FROM (
        SELECT fold, u, count(*) AS c, any_value(n) AS n FROM {inter}, prime GROUP BY fold, u)))) q
  WHERE d < n AND NOT EXISTS (SELECT 1 FROM {inter} i WHERE i.fold = q.fold AND i.u = q.u AND i.d = q.d)) WHERE r <= c"""


cte("samples_b", _bernoulli("inter"), "inter", "prime")
cte("samples_all", _negatives("prime", None, -1), "inter", "prime")
cte("popular", """SELECT *, row_number() OVER (PARTITION BY fold ORDER BY cnt DESC, d) AS rank
FROM (SELECT fold, d, count(*) AS cnt FROM inter GROUP BY ALL)""", "inter")

# ---- item-item --------------------------------------------------------------


def _itemcf(prefix: str, train: str, *needs: str) -> None:
    cte(f"{prefix}w", f"""SELECT fold, d, 1.0::DOUBLE / (1.0::DOUBLE + sqrt(count(*))) AS w
FROM {train} GROUP BY ALL""", *needs)
    cte(f"{prefix}uw", f"""SELECT fold, u, 1.0::DOUBLE / (1.0::DOUBLE + ln(count(*))) AS w
FROM {train} GROUP BY ALL""", *needs)
    cte(f"{prefix}sim", f"""
SELECT a.fold, a.d AS i, b.d AS j, sum(x.w * y.w * z.w) AS sim FROM {train} a
JOIN {train} b ON a.fold = b.fold AND a.u = b.u AND a.d <> b.d
JOIN {prefix}w x ON x.fold = a.fold AND x.d = a.d JOIN {prefix}w y ON y.fold = b.fold AND y.d = b.d
JOIN {prefix}uw z ON z.fold = a.fold AND z.u = a.u GROUP BY ALL""", f"{prefix}w", f"{prefix}uw", *needs)
    cte(f"{prefix}top", f"""SELECT * FROM (SELECT *, row_number() OVER
  (PARTITION BY fold, i ORDER BY sim DESC, j) AS rank FROM {prefix}sim) WHERE rank <= 10""",
        f"{prefix}sim")
    cte(f"{prefix}score", f"""SELECT t.fold, t.u, s.j AS d, sum(s.sim) AS score FROM {train} t
JOIN {prefix}top s ON s.fold = t.fold AND s.i = t.d GROUP BY ALL""", f"{prefix}top", *needs)
    cte(f"{prefix}own", f"""
SELECT fold, u, d, rank FROM (SELECT *, row_number() OVER (PARTITION BY fold, u ORDER BY score DESC, d) AS rank
  FROM {prefix}score s WHERE NOT EXISTS (SELECT 1 FROM {train} t
    WHERE t.fold = s.fold AND t.u = s.u AND t.d = s.d)) WHERE rank <= 10""", f"{prefix}score", *needs)
    cte(f"{prefix}list", f"""
SELECT fold, u, d, row_number() OVER (PARTITION BY fold, u ORDER BY tier, rank) AS rank FROM (
  SELECT fold, u, d, 0 AS tier, rank FROM {prefix}own UNION ALL
  SELECT u.fold, u.u, p.d, 1, p.rank FROM (SELECT DISTINCT fold, u FROM {train}) u
  JOIN (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY cnt DESC, d) AS rank FROM (
    SELECT fold, d, count(*) AS cnt FROM {train} GROUP BY ALL)) p ON p.fold = u.fold
  WHERE NOT EXISTS (SELECT 1 FROM {train} t WHERE t.fold = u.fold AND t.u = u.u AND t.d = p.d)
    AND NOT EXISTS (SELECT 1 FROM {prefix}own o WHERE o.fold = u.fold AND o.u = u.u AND o.d = p.d))
QUALIFY row_number() OVER (PARTITION BY fold, u ORDER BY tier, rank) <= 10""", f"{prefix}own", *needs)


cte("train1", "SELECT fold, u, d FROM split WHERE part = 'train'", "split")
cte("train2", "SELECT fold, u, d FROM split2 WHERE part = 'train'", "split2")
_itemcf("all_", "inter", "inter")
_itemcf("one_", "train1", "train1")
_itemcf("two_", "train2", "train2")


def _metrics(split: str, lists: str) -> str:
    """Precision and recall by the plain per-user definition."""
    return f"""
SELECT fold, k, count(*) AS users, avg(hits / k) AS precision, avg(hits / t::DOUBLE) AS recall FROM (
  SELECT s.fold, s.u, s.t, k, (SELECT 0)::DOUBLE + count(h.d) AS hits
  FROM (SELECT fold, u, count(*) AS t FROM truth_{split} GROUP BY ALL) s
  CROSS JOIN range(1, 11) r(k)
  LEFT JOIN (SELECT l.fold, l.u, l.d, l.rank FROM {lists} l JOIN truth_{split} t
    ON t.fold = l.fold AND t.u = l.u AND t.d = l.d) h ON h.fold = s.fold AND h.u = s.u AND h.rank <= k
  WHERE (s.fold, s.u) IN (SELECT (fold, u) FROM {lists})
  GROUP BY ALL) GROUP BY ALL"""


for _name in ("split2", "split10"):
    cte(f"truth_{_name}", f"""
SELECT fold, u, d FROM {_name} v WHERE part = 'valid' AND EXISTS (SELECT 1 FROM {_name} t
  WHERE t.part = 'train' AND t.fold = v.fold AND t.u = v.u)""", _name)
    cte(f"pop_{_name}", f"""
SELECT u.fold, u.u, p.d, p.rank FROM (SELECT DISTINCT fold, u FROM truth_{_name}) u JOIN (
  SELECT *, row_number() OVER (PARTITION BY fold ORDER BY cnt DESC, d) AS rank FROM (
    SELECT fold, d, count(*) AS cnt FROM {_name} WHERE part = 'train' GROUP BY ALL)) p
ON p.fold = u.fold AND p.rank <= 10""", _name, f"truth_{_name}")
    cte(f"popm_{_name}", _metrics(_name, f"pop_{_name}"), f"pop_{_name}", f"truth_{_name}")
cte("itemm", _metrics("split2", "two_list"), "two_list", "truth_split2")
F1 = "CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END"


def _fold_metrics(source):
    return sql(f"""SELECT fold::BIGINT AS fold, k::BIGINT AS k, users, round(precision, 6) AS precision,
round(recall, 6) AS recall, round({F1}, 6) AS f1 FROM {source}""", source)


# ---- factors ----------------------------------------------------------------


def _init(key: str, source: str, rank: int = RANK) -> str:
    v = uniform(f"fold + {SEED}", f"'{key}'", key, "i")
    return f"""SELECT fold, {key}, i, v / sqrt(sum(v * v) OVER (PARTITION BY fold, {key})) AS v FROM (
  SELECT fold, {key}, i, {v} AS v FROM (SELECT DISTINCT fold, {key} FROM {source}), range({rank}) r(i))"""


cte("p", _init("u", "inter"), "inter")
cte("q", _init("d", "inter"), "inter")
cte("z", """SELECT s.fold, s.u, s.d, s.x, sum(p.v * q.v) AS z, 1.0::DOUBLE / (1.0::DOUBLE + exp(-sum(p.v * q.v))) AS y
FROM samples s JOIN p ON p.fold = s.fold AND p.u = s.u JOIN q ON q.fold = s.fold AND q.d = s.d AND q.i = p.i
GROUP BY s.fold, s.u, s.d, s.x""", "samples", "p", "q")
cte("weights", """SELECT fold, d, n, pow(n, 0.5::DOUBLE) / pow(sum(n) OVER (PARTITION BY fold), 0.5::DOUBLE) AS w
FROM (SELECT fold, d, count(DISTINCT u) AS n FROM inter GROUP BY ALL)""", "inter")
cte("gu", f"""
SELECT g.fold, g.u, g.i, s + n * {LP}::DOUBLE * p.v AS g, p.v FROM (
  SELECT z.fold, z.u, q.i, sum((y - x) * q.v) AS s, count(*) AS n FROM z JOIN q
  ON q.fold = z.fold AND q.d = z.d GROUP BY z.fold, z.u, q.i) g
JOIN p ON p.fold = g.fold AND p.u = g.u AND p.i = g.i""", "z", "p", "q")
cte("gd", f"""
SELECT g.fold, g.d, g.i, s + n * {LQ}::DOUBLE * q.v AS h, q.v FROM (
  SELECT z.fold, z.d, p.i, sum((y - x) * p.v) AS s, count(*) AS n FROM z JOIN p
  ON p.fold = z.fold AND p.u = z.u GROUP BY z.fold, z.d, p.i) g
JOIN q ON q.fold = g.fold AND q.d = g.d AND q.i = g.i""", "z", "p", "q")
cte("norms", """SELECT fold, mp, mq FROM (SELECT fold, sqrt(sum(g * g)) AS mp FROM gu GROUP BY 1)
JOIN (SELECT fold, sqrt(sum(h * h)) AS mq FROM gd GROUP BY 1) USING (fold)""", "gu", "gd")
cte("moved", """
SELECT s.x, s.fold, w.e, sum((gu.v - w.width * gu.g / m.mp) * (gd.v - w.width * gd.h / m.mq)) AS z
FROM samples s JOIN gu ON gu.fold = s.fold AND gu.u = s.u
JOIN gd ON gd.fold = s.fold AND gd.d = s.d AND gd.i = gu.i JOIN norms m ON m.fold = s.fold,
(SELECT e, CASE WHEN e < 0 THEN 0.0 ELSE pow(0.5::DOUBLE, e) END AS width FROM range(-1, 20) r(e)) w
GROUP BY s.fold, s.u, s.d, s.x, w.e""", "samples", "gu", "gd", "norms")
cte("losses", f"""SELECT fold, e, avg({softplus('z')} - x * z) AS loss, count(*) AS n FROM moved GROUP BY ALL""",
    "moved")
cte("width", """
SELECT l.fold, coalesce(max(pow(0.5::DOUBLE, l.e)) FILTER (l.loss <= o.loss
  - pow(0.5::DOUBLE, l.e) * 0.5 * (mp + mq) / o.n), 0) AS width
FROM losses l JOIN losses o ON o.fold = l.fold AND o.e = -1 JOIN norms m ON m.fold = l.fold
WHERE l.e >= 0 GROUP BY l.fold""", "losses", "norms")

ORACLES: dict[str, str] = {}


def oracle(name: str, final: str, *needs: str) -> None:
    ORACLES[name] = sql(final, *needs)


CTX = 'second, "user", tac, hour, wday, round(lat, 6) AS lat, round(lng, 6) AS lng'
oracle("scan_sightings", "SELECT * FROM sightings", "sightings")
oracle("dim_cells", "SELECT cell, round(lat, 6) AS lat, round(lng, 6) AS lng FROM cells", "cells")
oracle("dim_devices", "SELECT * FROM devices", "devices")
oracle("valid_sightings", "SELECT * FROM valid", "valid")
oracle("context_sightings", f"SELECT {CTX} FROM context", "context")
oracle("file_valid_sightings", "SELECT * FROM valid", "valid")
oracle("file_valid_sightings_pruned", "SELECT * FROM valid WHERE day BETWEEN '20240108' AND '20240114'", "valid")
oracle("records_by_shard", """SELECT part, count(*) AS records, count(*) FILTER (ok) AS kept FROM (
SELECT second % 4 AS part, (second, "user", substr(imei, 1, 8), cell) IN (SELECT (second, "user", tac, cell) FROM valid)
AS ok FROM sightings) GROUP BY part""", "sightings", "valid")
oracle("file_position_counts", "SELECT * FROM counts", "counts")
oracle("file_device_history", 'SELECT "user", btime, device FROM history', "history")
for _name, _kind in (("file_visits_hist", "home"), ("file_work_visits_hist", "work")):
    oracle(_name, f"""SELECT value, count(*) AS cnt FROM (SELECT "user",
sum(cnt)::BIGINT AS value FROM counts WHERE place_type = '{_kind}' GROUP BY ALL) GROUP BY ALL""", "counts")
oracle("file_numbered_devices", "SELECT device, d FROM coverage", "coverage")
oracle("file_numbered_users", 'SELECT "user", u FROM users', "users")
oracle("file_numbered_usage", f"""SELECT strftime(make_timestamp(btime * 1000000), '%Y%m%d') AS date, u, d FROM covered
JOIN users USING ("user") JOIN coverage USING (device)""", "covered", "users", "coverage")
oracle("file_train_test", "SELECT date, u, d, part FROM tsplit", "tsplit")
for _name, _kind in (("file_semantic_places", "home"), ("file_work_places", "work")):
    oracle(_name, f"""SELECT "user", round(lat, 6) AS lat, round(lng, 6) AS lng FROM semantic
WHERE place_type = '{_kind}'""", "semantic")
oracle("file_numbered_places", f"""SELECT u, {", ".join(f"round({c}, 6) AS {c}" for c in ("hlat", "hlng", "wlat", "wlng"))}
FROM named_places""", "named_places")
oracle("home_sightings", f"SELECT {CTX} FROM context WHERE hour < 8 OR hour >= 20", "context")
oracle("work_sightings", f"SELECT {CTX} FROM context WHERE wday < 5 AND hour BETWEEN 9 AND 16", "context")
oracle("log_profile", """SELECT count(DISTINCT day) AS days, count(DISTINCT "user") AS users,
count(DISTINCT device) AS devices, count(DISTINCT cell) AS cells FROM named""", "named")
oracle("valid_by_day", "SELECT day, count(*) AS cnt FROM valid GROUP BY 1 ORDER BY 1", "valid")
oracle("device_days", "SELECT * FROM days", "days")
oracle("device_history", "SELECT * FROM history", "history")
oracle("usage_runs", """SELECT "user", btime, device FROM (SELECT *, lag(device) OVER
(PARTITION BY "user" ORDER BY btime, device) AS prev FROM days) WHERE prev IS NULL OR prev <> device""", "days")
DAY = "strftime(make_timestamp(btime * 1000000), '%Y%m%d')"
oracle("usage_profile", f"""SELECT count(DISTINCT {DAY}) AS days, min({DAY}) AS first_day, max({DAY}) AS last_day,
count(DISTINCT "user") AS users, count(DISTINCT device) AS devices,
count(DISTINCT ("user", device)) AS pairs FROM history""", "history")
oracle("usage_days", f"SELECT DISTINCT {DAY} AS day FROM history", "history")
oracle("distinct_devices", 'SELECT DISTINCT "user", device FROM history', "history")
oracle("devices_per_user_hist", """SELECT value, count(*) AS cnt FROM (SELECT count(DISTINCT device) AS value
FROM history GROUP BY "user") GROUP BY 1""", "history")
oracle("users_per_device", """SELECT device, count(DISTINCT "user") AS users FROM history GROUP BY 1""", "history")
oracle("abnormal_users", """SELECT "user", count(*) AS runs FROM history GROUP BY 1 HAVING count(*) >= 5
ORDER BY runs DESC, "user" LIMIT 20""", "history")
oracle("normal_usage", "SELECT * FROM normal", "normal")
oracle("device_popularity", "SELECT device, count(*) AS cnt FROM normal GROUP BY 1", "normal")
oracle("coverage_devices", "SELECT * FROM coverage", "coverage")
oracle("records_per_user_hist", """SELECT value, count(*) AS cnt FROM (SELECT count(*) AS value
FROM covered GROUP BY "user") GROUP BY 1""", "covered")
oracle("numbered_users", "SELECT * FROM users", "users")
oracle("numbered_usage", f"""SELECT {DAY} AS date, u, d FROM covered JOIN users USING ("user")
JOIN coverage USING (device)""", "covered", "users", "coverage")

oracle("position_counts", "SELECT * FROM counts", "counts")
oracle("position_counts_bbox", "SELECT * FROM area", "area")
oracle("visits_hist", """SELECT place_type, value, count(*) AS cnt FROM (SELECT place_type, "user",
sum(cnt)::BIGINT AS value FROM counts GROUP BY ALL) GROUP BY ALL""", "counts")
oracle("places_hist", """SELECT place_type, value, count(*) AS cnt FROM (SELECT place_type, "user",
count(*) AS value FROM counts GROUP BY ALL) GROUP BY ALL""", "counts")
oracle("place_density", """SELECT place_type, "user", lat, lng, cnt, round(density, 9) AS density
FROM density""", "density")
oracle("place_neighbors", f"""SELECT place_type, "user", lat, lng, cnt, round(dist, 3) AS dist_m FROM (
SELECT p.*, {hav('c.lat', 'c.lng', 'p.lat', 'p.lng')} AS dist FROM area p JOIN (SELECT *, row_number() OVER
(PARTITION BY place_type, "user" ORDER BY cnt DESC, lat, lng) AS r FROM area) c
ON c.r = 1 AND c.place_type = p.place_type AND c."user" = p."user") WHERE dist <= {WIDTH}""", "area")
oracle("semantic_place", """SELECT place_type, "user", round(lat, 6) AS lat, round(lng, 6) AS lng,
steps::BIGINT AS steps FROM semantic""", "semantic")
XY = ", ".join(f"round({c}, 6) AS {c}" for c in ("hlat", "hlng", "wlat", "wlng"))
oracle("user_places", f"SELECT u, {XY} FROM named_places", "named_places")
cte("named_knn", _knn("named_places", 2000.0), "named_places")
oracle("place_graph", """SELECT src, dst, round(sqrt(d2 / 2.0) / 1000.0, 6) AS dist_km, rank
FROM named_knn""", "named_knn")

oracle("haversine_pairs", f"""SELECT u, round({hav('hlat', 'hlng', 'wlat', 'wlng')}, 3) AS dist_m,
round({hav('hlat', 'hlng', 'wlat', 'wlng', '6372.8')}, 6) AS dist_km FROM places""", "places")
CELLW = f"(sqrt(2.0::DOUBLE) * {NEAR}::DOUBLE / 6372800.0::DOUBLE)"


def _cell(c):
    return f"CAST(floor(radians({c}) / {CELLW}) AS BIGINT)"


oracle("grid_cells", f"""SELECT u, {_cell('hlat')} AS hc_lat, {_cell('hlng')} AS hc_lng,
{_cell('wlat')} AS wc_lat, {_cell('wlng')} AS wc_lng FROM places""", "places")
oracle("grid_expand", f"""SELECT u, {_cell('hlat')} + dx AS hc_lat, {_cell('hlng')} + dy AS hc_lng
FROM places, range(-1, 2) a(dx), range(-1, 2) b(dy)""", "places")
PAIR = ", ".join([f"round(a.{c}, 6) AS {c}" for c in ("hlat", "hlng", "wlat", "wlng")] + ["a.n AS n"]
                 + [f"round(b.{c}, 6) AS o_{c}" for c in ("hlat", "hlng", "wlat", "wlng")] + ["b.n AS o_n"])
_home, _work = _legs()
oracle("geo_pairs", f"""SELECT * EXCLUDE (dh, dw), round(dh * dh + dw * dw, 2) AS d2 FROM (
SELECT {PAIR}, {_home} AS dh, {_work} AS dw FROM sites a, sites b)
WHERE dh * dh + dw * dw <= 2.0::DOUBLE * {NEAR}::DOUBLE * {NEAR}::DOUBLE""", "sites")
_hkm, _wkm = _legs("6372.8")
oracle("geo_pairs_rms", f"""SELECT * EXCLUDE (dh, dw), round(sqrt((dh * dh + dw * dw) / 2.0::DOUBLE), 6) AS dist_km
FROM (SELECT {PAIR}, {_hkm} AS dh, {_wkm} AS dw FROM sites a, sites b)
WHERE sqrt((dh * dh + dw * dw) / 2.0::DOUBLE) <= {NEAR / 1000.0}""", "sites")
oracle("geo_knn", "SELECT src, dst, round(d2, 2) AS d2, rank FROM knn", "knn")
SOFT = f"exp(-sqrt(d2) / {NEAR}::DOUBLE)"
for _name in ("geo_edges", "softmax_edges"):
    oracle(_name, f"""SELECT src, dst, round({SOFT} / sum({SOFT}) OVER (PARTITION BY src), 6) AS score
FROM knn""", "knn")
oracle("distance_graph", "SELECT src, dst, round(dist_km, 6) AS dist_km, rank FROM graph", "graph")
oracle("friend_weights", "SELECT src, dst, round(score, 6) AS score FROM friends", "friends")
oracle("graph_sweep", """SELECT k, d_step, count(*) AS edges, count(DISTINCT src) AS users,
round(avg(dist_km), 6) AS mean_km FROM steps JOIN graph ON rank <= k AND dist_km <= d GROUP BY ALL""",
       "steps", "graph")
oracle("neighbor_coverage", """SELECT k, d_step, count(*) AS users,
round(count(*) / (SELECT count(*) FROM places)::DOUBLE, 6) AS share FROM (
SELECT k, d_step, src FROM steps JOIN graph ON dist_km <= d GROUP BY k, d_step, src HAVING count(*) >= k)
GROUP BY k, d_step""", "steps", "graph", "places")
for _name, _cover in (("neighbor_overlap", "least(count(*), 1)"),
                      ("neighbor_overlap_ratio",
                       "count(*) / (SELECT count(*) FROM pairs n WHERE n.u = s.u)::DOUBLE")):
    oracle(_name, f"""SELECT k, d_step, round(avg(m), 6) AS overlap, count(*) AS users FROM (
SELECT k, d_step, src, avg(coalesce(cover, 0)) AS m FROM steps JOIN (SELECT g.*, c.cover FROM graph g LEFT JOIN (
  SELECT g.src, g.dst, {_cover} AS cover FROM graph g JOIN pairs s ON s.u = g.src
  JOIN pairs t ON t.u = g.dst AND t.d = s.d GROUP BY g.src, g.dst, s.u) c USING (src, dst)
  WHERE g.src IN (SELECT u FROM pairs) AND g.dst IN (SELECT u FROM pairs)) e ON rank <= k AND dist_km <= d
GROUP BY k, d_step, src) GROUP BY k, d_step""", "steps", "graph", "pairs")
for _name, _order in (("popular_overlap", "users DESC, d"),
                      ("random_overlap", f"{uniform(str(SEED), 'd')}, d")):
    oracle(_name, f"""SELECT k, round(sum(users) OVER (ORDER BY k) * 0.1
  / (SELECT count(DISTINCT u) FROM pairs), 6) AS overlap FROM (
SELECT *, row_number() OVER (ORDER BY {_order}) AS k FROM (SELECT d, count(*) AS users FROM pairs GROUP BY 1))
WHERE k <= 10""", "pairs")

oracle("train_interactions", "SELECT u, d, 1::BIGINT AS x FROM pairs", "pairs")
oracle("time_split", "SELECT date, u, d, part FROM tsplit", "tsplit")
oracle("split_profile", """SELECT part, count(*) AS records, count(DISTINCT u) AS users, count(DISTINCT d) AS items,
count(DISTINCT date) AS days FROM tsplit GROUP BY 1""", "tsplit")
oracle("changed_users", """SELECT DISTINCT u, d FROM tsplit t WHERE part = 'test'
AND u IN (SELECT u FROM tsplit WHERE part = 'train')
AND (u, d) NOT IN (SELECT (u, d) FROM tsplit WHERE part = 'train')""", "tsplit")
oracle("stratified_split", "SELECT fold, u, d, part FROM split2", "split2")
_draw = uniform(f"fold + {SEED}", "x", "u", "d")
oracle("stratified_split_labels", f"""
SELECT fold, u, d, x, CASE WHEN c > 1 AND {_draw} < least(1.0::DOUBLE,
  count(*) OVER (PARTITION BY fold, x) * (1.0 - 0.8)::DOUBLE
  / sum(CASE WHEN c > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY fold, x)) THEN 'valid' ELSE 'train' END AS part
FROM (SELECT *, count(*) OVER (PARTITION BY fold, x, u) AS c FROM samples)""", "samples")
oracle("negatives_sampled", "SELECT fold, u, d, x FROM samples_x2", "samples_x2")
oracle("negatives_bernoulli", "SELECT fold, u, d, x FROM samples_b", "samples_b")
oracle("negatives_all", """SELECT 0::BIGINT AS fold, u, count(d) AS unused, coalesce(sum(d), 0)::BIGINT AS unused_sum
FROM (SELECT DISTINCT u FROM pairs) a LEFT JOIN LATERAL (SELECT d FROM (SELECT DISTINCT d FROM pairs)
WHERE (a.u, d) NOT IN (SELECT (u, d) FROM pairs)) b ON true GROUP BY u""", "pairs")
oracle("sample_profile", """SELECT count(*) AS records, count(DISTINCT u) AS users, count(DISTINCT d) AS items,
count(*) FILTER (x = 1) AS positives, count(*) FILTER (x = 0) AS negatives FROM samples""", "samples")
oracle("rank_triples", """SELECT a.u, a.d AS i, count(*) AS unused, sum(b.d)::BIGINT AS unused_sum
FROM samples a JOIN samples b ON a.u = b.u WHERE a.x = 1 AND b.x = 0 GROUP BY a.u, a.d""", "samples")
oracle("popularity_weight", "SELECT d, n, round(w, 9) AS w FROM weights", "weights")
oracle("activity_scores", """SELECT 'item' AS kind, d AS id, count(*) AS cnt,
round(1.0::DOUBLE / (1.0::DOUBLE + sqrt(count(*))), 9) AS w FROM inter GROUP BY d UNION ALL
SELECT 'user', u, count(*), round(1.0::DOUBLE / (1.0::DOUBLE + ln(count(*))), 9) FROM inter GROUP BY u""", "inter")

oracle("popular_items", "SELECT d, cnt, rank FROM popular WHERE rank <= 20", "popular")
oracle("item_pair_sim", "SELECT i, j, round(sim, 6) AS sim FROM all_sim", "all_sim")
oracle("item_top10", "SELECT i, j, round(sim, 6) AS sim, rank FROM all_top", "all_top")
oracle("itemcf_scores", "SELECT u, d, round(score, 6) AS score FROM one_score", "one_score")
oracle("itemcf_topn", "SELECT u, d, rank FROM one_list", "one_list")
ORACLES["precision_recall_at_k"] = _fold_metrics("itemm")
ORACLES["popular_metrics"] = _fold_metrics("popm_split2")
oracle("cv_metrics", f"""SELECT k::BIGINT AS k, round(precision, 6) AS precision, round(recall, 6) AS recall,
round({F1}, 6) AS f1 FROM (SELECT k, avg(precision) AS precision, avg(recall) AS recall
FROM popm_split10 GROUP BY k)""", "popm_split10")

V = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS f FROM embeddings"
cte("vec", f"SELECT id, unnest(range(len(f))) AS i, unnest(f) AS v FROM ({V})")
oracle("vector_dot", """SELECT a.id, round(sum(a.v * b.v), 6) AS dot FROM vec a JOIN vec b
ON b.id = a.id + 1 AND b.i = a.i GROUP BY 1""", "vec")
oracle("vector_axpy", """SELECT a.id, a.i, round(a.v * 2.0 + b.v * -0.5, 6) AS v FROM vec a JOIN vec b
ON b.id = a.id + 1 AND b.i = a.i""", "vec")
oracle("vector_norm", """SELECT id, round(sqrt(sum(v * v)), 6) AS norm, round(sum(v * v), 6) AS norm2,
CASE WHEN sum(v * v) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS unit, count(*) AS rank FROM vec GROUP BY 1""", "vec")
oracle("factor_init", "SELECT u, i, round(v, 6) AS v FROM p", "p")
oracle("predict_scores", "SELECT u, d, x, round(z, 6) AS z, round(y, 6) AS y FROM z", "z")
oracle("logloss", f"""SELECT fold, round(avg({softplus('z')} - x * z), 6) AS loss, count(*) AS samples
FROM z GROUP BY 1""", "z")
oracle("weighted_logloss", f"""SELECT fold, round(avg(CASE WHEN x = 1 THEN 1.0 ELSE w END
* ({softplus('z')} - x * z)), 6) AS loss, count(*) AS samples FROM z JOIN weights USING (fold, d)
GROUP BY 1""", "z", "weights")
oracle("rank_loss", f"""SELECT fold, round(avg({softplus('zj - zi')}), 6) AS loss, count(*) AS pairs FROM (
SELECT a.fold, a.z AS zi, b.z AS zj FROM z a JOIN z b ON a.fold = b.fold AND a.u = b.u WHERE a.x = 1 AND b.x = 0)
GROUP BY 1""", "z")
oracle("user_gradient", "SELECT u, i, round(g, 6) AS g FROM gu", "gu")
oracle("item_gradient", "SELECT d, i, round(h, 6) AS g FROM gd", "gd")
oracle("gradient_norm", "SELECT fold, round(mp, 6) AS mp, round(mq, 6) AS mq FROM norms", "norms")
cte("cmp", """SELECT a.fold, a.u, a.d AS i, b.d AS j, 1.0::DOUBLE / (1.0::DOUBLE + exp(b.z - a.z)) - 1.0 AS e
FROM z a JOIN z b ON a.fold = b.fold AND a.u = b.u WHERE a.x = 1 AND b.x = 0""", "z")
cte("cmp_sum", """SELECT fold, u, d, sum(e) AS e, sum(n) AS n FROM (
SELECT fold, u, i AS d, sum(e) AS e, count(*) AS n FROM cmp GROUP BY ALL UNION ALL
SELECT fold, u, j, -sum(e), 0 FROM cmp GROUP BY ALL) GROUP BY ALL""", "cmp")
oracle("rank_gradient", f"""SELECT s.u, p.i, round(g + n * {LP}::DOUBLE * p.v, 6) AS g FROM (
SELECT c.fold, c.u, q.i, sum(e * q.v) AS g, sum(n) AS n FROM cmp_sum c JOIN q ON q.fold = c.fold AND q.d = c.d
GROUP BY ALL) s JOIN p ON p.fold = s.fold AND p.u = s.u AND p.i = s.i""", "cmp_sum", "p", "q")
cte("pull", """SELECT src, dst, score - sum(a.v * b.v) AS pull FROM friends JOIN p a ON a.u = src
JOIN p b ON b.u = dst AND b.i = a.i GROUP BY src, dst, score""", "friends", "p")
oracle("graph_term", """SELECT src AS u, i, round(sum(pull * v), 6) AS m FROM pull JOIN p ON p.u = dst
GROUP BY ALL""", "pull", "p")
oracle("mf_one_step", """SELECT u, i, round(v - width * g / mp, 6) AS v FROM gu JOIN norms USING (fold)
JOIN width USING (fold)""", "gu", "norms", "width")
oracle("topn_by_factor", """SELECT u, d, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER
(PARTITION BY u ORDER BY score DESC, d) AS rank FROM (SELECT p.u, q.d, sum(p.v * q.v) AS score FROM p JOIN q
ON q.i = p.i WHERE NOT EXISTS (SELECT 1 FROM pairs x WHERE x.u = p.u AND x.d = q.d) GROUP BY ALL))
WHERE rank <= 10""", "p", "q", "pairs")


# ---- facts about trained models -----------------------------------------------


def _label_split(samples: str) -> str:
    draw = uniform(f"fold + {SEED}", "x", "u", "d")
    return f"""SELECT fold, u, d, x, CASE WHEN c > 1 AND {draw} < least(1.0::DOUBLE,
  count(*) OVER (PARTITION BY fold, x) * (1.0 - 0.8)::DOUBLE
  / sum(CASE WHEN c > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY fold, x)) THEN 'valid' ELSE 'train' END AS part
FROM (SELECT *, count(*) OVER (PARTITION BY fold, x, u) AS c FROM {samples})"""


cte("pos10", "SELECT fold, u, d, 1::BIGINT AS x FROM inter10", "inter10")
cte("samples10", _negatives("c + c + prime - n", "j", 1, "inter10"), "inter10", "prime")
cte("samples10b", _bernoulli("inter10"), "inter10", "prime")
for _from in ("pos10", "samples10", "samples10b", "samples"):
    cte(f"parts_{_from}", _label_split(_from), _from)
cte("parts_both", """SELECT * FROM parts_samples10 p WHERE (SELECT count(DISTINCT x) FROM parts_samples10 o
  WHERE o.fold = p.fold AND o.u = p.u AND o.part = p.part) = 2""", "parts_samples10")


def _facts(parts: str) -> str:
    return sql(f"""SELECT a.*, truth_users, 0::BIGINT AS broken FROM (
  SELECT fold, count(*) FILTER (part = 'train') AS train_rows, count(*) FILTER (part = 'valid') AS valid_rows,
    count(DISTINCT u) FILTER (part = 'train') AS users, count(DISTINCT d) FILTER (part = 'train') AS items
  FROM {parts} GROUP BY fold) a JOIN (
  SELECT fold, count(DISTINCT u) AS truth_users FROM {parts} v WHERE part = 'valid' AND x = 1
    AND EXISTS (SELECT 1 FROM {parts} t WHERE t.part = 'train' AND t.x = 1 AND t.fold = v.fold AND t.u = v.u)
  GROUP BY fold) b USING (fold)""", parts)


for _name, _parts_of in (("train_logistic_mf", "parts_pos10"), ("train_logistic_mf_neg", "parts_samples10b"),
                         ("train_weighted_mf", "parts_samples10"), ("train_graph_mf", "parts_samples10"),
                         ("train_bpr", "parts_both"), ("als_facts", "parts_samples10")):
    ORACLES[_name] = _facts(_parts_of)
oracle("als_fits", """SELECT fold, part, count(*) AS rows, true AS fits FROM parts_samples10 p
WHERE (fold, u) IN (SELECT (fold, u) FROM parts_samples10 WHERE part = 'train')
  AND (fold, d) IN (SELECT (fold, d) FROM parts_samples10 WHERE part = 'train') GROUP BY fold, part""", "parts_samples10")
oracle("als_topn", """SELECT fold, u, least(10, items - used_items) AS listed, 0::BIGINT AS used FROM (
  SELECT fold, u, count(*) FILTER (x = 1) AS used_items FROM parts_samples10 WHERE part = 'train' GROUP BY fold, u) JOIN (
  SELECT fold, count(DISTINCT d) AS items FROM parts_samples10 WHERE part = 'train' GROUP BY fold) USING (fold)""",
       "parts_samples10")
oracle("train_als", """SELECT fold, u, count(*) AS rows, true AS solved FROM parts_samples10 WHERE part = 'train'
GROUP BY fold, u""", "parts_samples10")


# ---- trained models, a few steps unrolled ---------------------------------------

STEPS, LG = 2, 0.01
WIDTHS = "(SELECT e, CASE WHEN e < 0 THEN 0.0 ELSE pow(0.5::DOUBLE, e) END::DOUBLE AS width FROM range(-1, 20) r(e))"


def _lists(table: str, key: str) -> str:
    return f"SELECT fold, {key}, list(v ORDER BY i) AS f FROM {table} GROUP BY fold, {key}"


def _ranked(name: str, parts: str, train: str, p: str, q: str) -> str:
    """The ten best unused items of each user with new ones, and their precision and recall, from lists of factors."""
    cte(f"truth_{name}", f"""SELECT DISTINCT fold, u, d FROM {parts} v WHERE part = 'valid' AND x = 1
AND (fold, u) IN (SELECT (fold, u) FROM {parts} WHERE part = 'train' AND x = 1)
AND (fold, u, d) NOT IN (SELECT (fold, u, d) FROM {parts} WHERE part = 'train' AND x = 1)""", parts)
    cte(f"best_{name}", f"""SELECT fold, u, d, row_number() OVER (PARTITION BY fold, u ORDER BY score DESC, d) AS rank FROM (
SELECT p.fold, p.u, q.d, list_dot_product(p.f, q.f) AS score FROM {p} p JOIN {q} q ON q.fold = p.fold
WHERE (p.fold, p.u) IN (SELECT (fold, u) FROM truth_{name}))
WHERE (fold, u, d) NOT IN (SELECT (fold, u, d) FROM {train} WHERE x = 1) QUALIFY rank <= 10""",
        p, q, f"truth_{name}", train)
    cte(f"pr_{name}", _metrics(name, f"best_{name}"), f"best_{name}", f"truth_{name}")
    return f"pr_{name}"


def _model(name: str, parts: str, weigh: bool = False, graph: bool = False, pairwise: bool = False) -> str:
    """CTEs of a model after ``STEPS`` steps of gradient descent with line search; its ten best unused items
    of each user with new ones; the name of its precision and recall."""
    def at(base: str, step: int = 0) -> str:
        return f"{base}_{name}{step}"

    w = "CASE WHEN x = 1 THEN 1.0 ELSE coalesce(w10.w, 0.0) END::DOUBLE" if weigh else "1.0::DOUBLE"
    more = "LEFT JOIN weights10 w10 ON w10.fold = t.fold AND w10.d = t.d" if weigh else ""
    train, needs = at("train"), ["weights10"] if weigh else []
    cte(train, f"SELECT t.fold, t.u, t.d, t.x, {w} AS w FROM {parts} t {more} WHERE part = 'train'", parts, *needs)
    cte(at("p"), _init("u", train), train)
    cte(at("q"), _init("d", train), train)
    for k in range(STEPS):
        p, q, z, e, gu, gd, norms, moved, losses, width = (
            at(c, k) for c in ("p", "q", "z", "e", "gu", "gd", "norms", "moved", "losses", "width"))
        cte(f"l{p}", _lists(p, "u"), p)
        cte(f"l{q}", _lists(q, "d"), q)
        cte(z, f"""SELECT s.*, list_dot_product(p.f, q.f) AS z FROM {train} s JOIN l{p} p ON p.fold = s.fold AND p.u = s.u
JOIN l{q} q ON q.fold = s.fold AND q.d = s.d""", train, f"l{p}", f"l{q}")
        if pairwise:
            cte(f"c{e}", f"""SELECT a.fold, a.u, a.d AS i, b.d AS j, 1.0::DOUBLE / (1.0::DOUBLE + exp(b.z - a.z)) - 1.0 AS e
FROM {z} a JOIN {z} b ON a.fold = b.fold AND a.u = b.u WHERE a.x = 1 AND b.x = 0""", z)
            cte(e, f"""SELECT fold, u, d, sum(e) AS e, sum(n) AS n, sum(np) AS np FROM (
SELECT fold, u, i AS d, sum(e) AS e, count(*) AS n, count(*) AS np FROM c{e} GROUP BY ALL UNION ALL
SELECT fold, u, j, -sum(e), count(*), 0 FROM c{e} GROUP BY ALL) GROUP BY ALL""", f"c{e}")
        else:
            cte(e, f"SELECT fold, u, d, w * (1.0::DOUBLE / (1.0::DOUBLE + exp(-z)) - x) AS e, 1 AS n, 1 AS np FROM {z}", z)
        pull, near = "0.0::DOUBLE", ""
        if graph:
            cte(f"m{gu}", f"""SELECT a.fold, src AS u, i, sum((score - list_dot_product(a.f, b.f)) * v) AS m FROM friends
JOIN l{p} a ON a.u = src JOIN l{p} b ON b.u = dst AND b.fold = a.fold JOIN {p} v ON v.u = dst AND v.fold = a.fold
GROUP BY ALL""", "friends", p, f"l{p}")
            pull = f"n * {LG}::DOUBLE * (p.v - coalesce(m, 0.0))"
            near = f"LEFT JOIN m{gu} m ON m.fold = p.fold AND m.u = p.u AND m.i = p.i"
        cte(gu, f"""SELECT p.fold, p.u, p.i, p.v, s + n * {LP}::DOUBLE * p.v + {pull} AS g FROM (
SELECT e.fold, e.u, q.i, sum(e * q.v) AS s, sum(np) AS n FROM {e} e JOIN {q} q ON q.fold = e.fold AND q.d = e.d GROUP BY ALL) g
JOIN {p} p ON p.fold = g.fold AND p.u = g.u AND p.i = g.i {near}""", e, p, q, *([f"m{gu}"] if graph else []))
        cte(gd, f"""SELECT q.fold, q.d, q.i, q.v, s + n * {LQ}::DOUBLE * q.v AS g FROM (
SELECT e.fold, e.d, p.i, sum(e * p.v) AS s, sum(n) AS n FROM {e} e JOIN {p} p ON p.fold = e.fold AND p.u = e.u GROUP BY ALL) g
JOIN {q} q ON q.fold = g.fold AND q.d = g.d AND q.i = g.i""", e, p, q)
        cte(norms, f"""SELECT fold, mp, mq FROM (SELECT fold, sqrt(sum(g * g)) AS mp FROM {gu} GROUP BY 1)
JOIN (SELECT fold, sqrt(sum(g * g)) AS mq FROM {gd} GROUP BY 1) USING (fold)""", gu, gd)
        for side, key in ((gu, "u"), (gd, "d")):
            cte(f"l{side}", f"SELECT fold, {key}, list(g ORDER BY i) AS g FROM {side} GROUP BY fold, {key}", side)
        cte(moved, f"""SELECT z.*, (list_dot_product(p.f, h.g) / mq + list_dot_product(g.g, q.f) / mp) AS z1,
list_dot_product(g.g, h.g) / mp / mq AS z2 FROM {z} z JOIN {norms} m USING (fold)
JOIN l{p} p ON p.fold = z.fold AND p.u = z.u JOIN l{q} q ON q.fold = z.fold AND q.d = z.d
JOIN l{gu} g ON g.fold = z.fold AND g.u = z.u JOIN l{gd} h ON h.fold = z.fold AND h.d = z.d""",
            z, norms, f"l{p}", f"l{q}", f"l{gu}", f"l{gd}")
        there = "(z - width * z1 + width * width * z2)"
        if pairwise:
            cte(losses, f"""SELECT fold, e, width, avg({softplus("dz - width * d1 + width * width * d2")}) AS loss, count(*) AS n FROM (
SELECT a.fold, b.z - a.z AS dz, b.z1 - a.z1 AS d1, b.z2 - a.z2 AS d2 FROM {moved} a
JOIN {moved} b ON a.fold = b.fold AND a.u = b.u WHERE a.x = 1 AND b.x = 0), {WIDTHS} GROUP BY ALL""", moved)
        else:
            cte(losses, f"""SELECT fold, e, width, avg(w * ({softplus(there)} - x * {there})) AS loss, count(*) AS n
FROM {moved}, {WIDTHS} GROUP BY ALL""", moved)
        cte(width, f"""SELECT l.fold, coalesce(max(l.width) FILTER (l.loss <= o.loss - l.width * 0.5 * (mp + mq) / o.n), 0) AS width
FROM {losses} l JOIN {losses} o ON o.fold = l.fold AND o.e = -1 JOIN {norms} m ON m.fold = l.fold
WHERE l.e >= 0 GROUP BY l.fold""", losses, norms)
        for old, grad, key, norm in ((at("p", k + 1), gu, "u", "mp"), (at("q", k + 1), gd, "d", "mq")):
            cte(old, f"SELECT fold, {key}, i, v - width * g / {norm} AS v FROM {grad} JOIN {norms} USING (fold) JOIN {width} USING (fold)",
                grad, norms, width)
    p, q = at("p", STEPS), at("q", STEPS)
    cte(f"l{p}", _lists(p, "u"), p)
    cte(f"l{q}", _lists(q, "d"), q)
    return _ranked(name, parts, train, f"l{p}", f"l{q}")


RANK_ALL, STEPS_ALL, TOL = 20, 100, 1e-6  # of the models trained to the end


def _trained(name: str, parts: str, pairwise: bool = False) -> str:
    """As ``_model`` without weights, but trained to the end: a recursion step is a training step, and the rows of a
    fold stay as they are once it is below ``TOL``."""
    train, p0, q0, t = (f"{c}_{name}" for c in ("train", "p0", "q0", "t"))
    cte(train, f"SELECT fold, u, d, x FROM {parts} WHERE part = 'train'", parts)
    cte(p0, _lists(f"({_init('u', train, RANK_ALL)})", "u"), train)
    cte(q0, _lists(f"({_init('d', train, RANK_ALL)})", "d"), train)
    at = range(1, RANK_ALL + 1)
    widths = [0.5 ** i for i in range(20)]

    def total(e: str, f: str) -> str:
        return "[" + ", ".join(f"sum({e} * {f}[{i}])" for i in at) + "]"

    def plus(a: str, by: str, b: str) -> str:
        return "[" + ", ".join(f"{a}[{i}] + {by} * {b}[{i}]" for i in at) + "]"

    if pairwise:
        errors = """c AS (SELECT a.fold, a.u, a.d AS i, b.d AS j, 1.0::DOUBLE / (1.0::DOUBLE + exp(b.z - a.z)) - 1.0 AS e
FROM z a JOIN z b ON a.fold = b.fold AND a.u = b.u WHERE a.x = 1 AND b.x = 0),
e AS (SELECT fold, u, d, sum(e) AS e, sum(n) AS n, sum(np) AS np FROM (
SELECT fold, u, i AS d, sum(e) AS e, count(*) AS n, count(*) AS np FROM c GROUP BY ALL UNION ALL
SELECT fold, u, j, -sum(e), count(*), 0 FROM c GROUP BY ALL) GROUP BY ALL)"""
        compared = """(SELECT a.fold, b.z - a.z AS z, b.z1 - a.z1 AS z1, b.z2 - a.z2 AS z2 FROM moved a
JOIN moved b ON a.fold = b.fold AND a.u = b.u WHERE a.x = 1 AND b.x = 0)"""
    else:
        errors = "e AS (SELECT fold, u, d, 1.0::DOUBLE / (1.0::DOUBLE + exp(-z)) - x AS e, 1 AS n, 1 AS np FROM z)"
        compared = "moved"

    def loss(width: float) -> str:
        z = f"(z - {width!r}::DOUBLE * z1 + {width * width!r}::DOUBLE * z2)"
        return f"avg({softplus(z)}" + ("" if pairwise else f" - x * {z}") + ")"

    passes = ", ".join(f"CASE WHEN ls[{i + 1}] <= l - {w!r}::DOUBLE * slope THEN {w!r}::DOUBLE END" for i, w in enumerate(widths))
    cte(t, f"""SELECT 0 AS step, true AS goes_on, fold, 'u' AS kind, u AS id, f FROM {p0}
UNION ALL SELECT 0, true, fold, 'd', d, f FROM {q0}
UNION ALL (WITH p AS (SELECT step, fold, id AS u, f FROM {t} WHERE kind = 'u' AND goes_on AND step < {STEPS_ALL}),
q AS (SELECT step, fold, id AS d, f FROM {t} WHERE kind = 'd' AND goes_on AND step < {STEPS_ALL}),
z AS (SELECT s.*, list_dot_product(p.f, q.f) AS z FROM {train} s JOIN p ON p.fold = s.fold AND p.u = s.u
JOIN q ON q.fold = s.fold AND q.d = s.d),
{errors},
gu AS (SELECT p.step, p.fold, p.u, p.f, {plus("s", f"n * {LP}::DOUBLE", "p.f")} AS g FROM (
SELECT e.fold, e.u, {total("e", "q.f")} AS s, sum(np) AS n FROM e JOIN q ON q.fold = e.fold AND q.d = e.d GROUP BY ALL) s
JOIN p ON p.fold = s.fold AND p.u = s.u),
gd AS (SELECT q.step, q.fold, q.d, q.f, {plus("s", f"n * {LQ}::DOUBLE", "q.f")} AS g FROM (
SELECT e.fold, e.d, {total("e", "p.f")} AS s, sum(n) AS n FROM e JOIN p ON p.fold = e.fold AND p.u = e.u GROUP BY ALL) s
JOIN q ON q.fold = s.fold AND q.d = s.d),
norms AS (SELECT fold, mp, mq FROM (SELECT fold, sqrt(sum(list_dot_product(g, g))) AS mp FROM gu GROUP BY 1)
JOIN (SELECT fold, sqrt(sum(list_dot_product(g, g))) AS mq FROM gd GROUP BY 1) USING (fold)),
moved AS (SELECT z.*, list_dot_product(gu.f, gd.g) / mq + list_dot_product(gu.g, gd.f) / mp AS z1,
list_dot_product(gu.g, gd.g) / mp / mq AS z2 FROM z JOIN norms m USING (fold)
JOIN gu ON gu.fold = z.fold AND gu.u = z.u JOIN gd ON gd.fold = z.fold AND gd.d = z.d),
losses AS (SELECT fold, count(*) AS n, {loss(0.0)} AS l, [{", ".join(map(loss, widths))}] AS ls FROM {compared} GROUP BY fold),
width AS (SELECT fold, mp, mq, slope, coalesce(list_max([{passes}]), 0.0)::DOUBLE AS width FROM (
SELECT *, 0.5 * (mp + mq) / n AS slope FROM losses JOIN norms USING (fold)))
SELECT step + 1, width * slope >= {TOL}::DOUBLE, fold, 'u', u, {plus("f", "-width / mp", "g")} FROM gu JOIN width USING (fold)
UNION ALL SELECT step + 1, width * slope >= {TOL}::DOUBLE, fold, 'd', d, {plus("f", "-width / mq", "g")} FROM gd JOIN width USING (fold))""",
        train, p0, q0)
    last = f"SELECT fold, id AS {{}}, f FROM {t} WHERE kind = '{{}}' AND (fold, step) IN (SELECT (fold, max(step)) FROM {t} GROUP BY fold)"
    for key in "ud":
        cte(f"{key}_{name}", last.format(key, key), t)
    return _ranked(name, parts, train, f"u_{name}", f"d_{name}")


cte("weights10", """SELECT fold, d, pow(n, 0.5::DOUBLE) / pow(sum(n) OVER (PARTITION BY fold), 0.5::DOUBLE) AS w
FROM (SELECT fold, d, count(DISTINCT u) AS n FROM inter10 GROUP BY ALL)""", "inter10")
for _name, _parts_of, _build, _kind in (
        ("logistic_mf", "parts_pos10", _trained, {}), ("logistic_mf_neg", "parts_samples10b", _trained, {}),
        ("weighted_mf", "parts_samples10", _model, {"weigh": True}),
        ("graph_mf", "parts_samples10", _model, {"weigh": True, "graph": True}),
        ("bpr", "parts_both", _trained, {"pairwise": True})):
    _scores = _build(_name, _parts_of, **_kind)
    oracle(f"metrics_{_name}", f"""SELECT k::BIGINT AS k, round(precision, 6) AS precision, round(recall, 6) AS recall,
round({F1}, 6) AS f1 FROM (SELECT k, avg(precision) AS precision, avg(recall) AS recall FROM {_scores} GROUP BY k)""", _scores)


# ---- alternating least squares of rank 2, three iterations ------------------------

cte("als_train", "SELECT * FROM parts_samples10 WHERE part = 'train'", "parts_samples10")
cte("als_u0", _lists(f"({_init('u', 'als_train', 2)})", "u"), "als_train")
for _k in range(3):
    for _key, _other, _from, _to in (("d", "u", f"als_u{_k}", f"als_d{_k + 1}"), ("u", "d", f"als_d{_k + 1}", f"als_u{_k + 1}")):
        cte(_to, f"""SELECT fold, {_key}, [(c * r - b * s) / (a * c - b * b), (a * s - b * r) / (a * c - b * b)] AS f FROM (
SELECT t.fold, t.{_key}, sum(f[1] * f[1]) + 0.01::DOUBLE * count(*) AS a, sum(f[1] * f[2]) AS b,
  sum(f[2] * f[2]) + 0.01::DOUBLE * count(*) AS c, sum(x * f[1]) AS r, sum(x * f[2]) AS s
FROM als_train t JOIN {_from} o ON o.fold = t.fold AND o.{_other} = t.{_other} GROUP BY t.fold, t.{_key})""", "als_train", _from)
_scores = _ranked("als", "parts_samples10", "als_train", "als_u3", "als_d3")
oracle("als_short_metrics", f"""SELECT k::BIGINT AS k, round(precision, 6) AS precision, round(recall, 6) AS recall,
round({F1}, 6) AS f1 FROM (SELECT k, avg(precision) AS precision, avg(recall) AS recall FROM {_scores} GROUP BY k)""", _scores)
oracle("als_short_topn", "SELECT fold, u, d, rank FROM best_als", "best_als")
oracle("als_short_mse", """SELECT part, round(avg(mse), 6) AS mse, sum(rows)::BIGINT AS rows FROM (
SELECT s.fold, part, avg((x - list_dot_product(p.f, q.f)) ** 2) AS mse, count(*) AS rows FROM parts_samples10 s
JOIN als_u3 p ON p.fold = s.fold AND p.u = s.u JOIN als_d3 q ON q.fold = s.fold AND q.d = s.d GROUP BY s.fold, part)
GROUP BY part""", "parts_samples10", "als_u3", "als_d3")
