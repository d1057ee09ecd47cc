"""DuckDB statements that state each catalog query a second time.

They share with the Spark side only the column texts of the derived trips, zones
and schedule. Tail probabilities are integrated numerically from the density.
"""

from __future__ import annotations

from ..functions import projection as proj
from ..operators import demand, normality
from . import fixture

AIRPORT = (
    "(coalesce(PULocationID IN (132, 138), false) OR coalesce(DOLocationID IN (132, 138), false))"
)
MINUTES = "date_diff('microsecond', pickup_datetime, dropoff_datetime) / 60000000.0"
HOURS = "date_diff('microsecond', pickup_datetime, dropoff_datetime) / 3600000000.0"
HOUR = "CAST(hour(pickup_datetime) AS INTEGER)"
THIS_YEAR = "pickup_datetime >= TIMESTAMP '2024-01-01' AND pickup_datetime < TIMESTAMP '2025-01-01'"
FILE = "cab_type, file_year, file_month"
STADIUM, DROPOFF = fixture.STADIUM, fixture.DROPOFF


def _select(columns: dict[str, str]) -> str:
    return ",\n".join(
        f'{text.format(ntz="TIMESTAMP", text="VARCHAR")} AS "{name}"' for name, text in columns.items()
    )


def _corner_rows() -> str:
    return ", ".join(
        f"({ring}, {seq}, CAST({dx} AS DOUBLE), CAST({dy} AS DOUBLE))"
        for ring, shape in fixture.RING_CORNERS.items()
        for seq, (dx, dy) in enumerate(shape)
    )


# name -> (query, names it builds on)
CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "derived": (f"SELECT {_select(fixture.TRIP_COLUMNS)} FROM events", ()),
    "trips": (f"SELECT *, {_select(fixture.FILE_COLUMNS)} FROM derived", ("derived",)),
    "zones": (
        f"SELECT {_select(fixture.ZONE_COLUMNS)} FROM nation JOIN region ON n_regionkey = r_regionkey",
        (),
    ),
    "vertices": (
        f"""SELECT LocationID, part, ring, seq, ox + dx * w AS x, oy + dy * w AS y
        FROM (SELECT {_select(fixture.PART_COLUMNS)} FROM customer) p
        JOIN (VALUES {_corner_rows()}) c(ring, seq, dx, dy) ON ring <= hole""",
        (),
    ),
    # Coordinates relative to a fixed corner; Spark uses one per zone.
    "centroids": (
        """SELECT LocationID, 980000 + SUM((x0 + x1) * c) / (3 * SUM(c)) AS x_ft,
          180000 + SUM((y0 + y1) * c) / (3 * SUM(c)) AS y_ft
        FROM (SELECT *, x0 * y1 - x1 * y0 AS c FROM (
          SELECT LocationID, x - 980000 AS x0, y - 180000 AS y0,
            lead(x - 980000) OVER w AS x1, lead(y - 180000) OVER w AS y1
          FROM vertices WINDOW w AS (PARTITION BY LocationID, part, ring ORDER BY seq)) WHERE x1 IS NOT NULL)
        GROUP BY LocationID""",
        ("vertices",),
    ),
    "schedule": (
        f"""SELECT {_select(fixture.GAME_COLUMNS)} FROM (
          SELECT CAST(pickup_datetime AS DATE) AS d, COUNT(*) AS n, MAX(trip_id) AS top
          FROM trips WHERE pickup_datetime IS NOT NULL GROUP BY 1 HAVING COUNT(*) % 3 = 0)""",
        ("trips",),
    ),
    "games": (
        "SELECT *, strptime(Date || ' ' || start_time, '%Y-%m-%d %I:%M %p') AS game_datetime FROM schedule",
        ("schedule",),
    ),
    "windows": (
        "SELECT *, game_datetime - INTERVAL 2 HOUR AS window_start,"
        " game_datetime + INTERVAL 2 HOUR AS window_end FROM games",
        ("games",),
    ),
    "near": (
        f"SELECT trip_id, pickup_datetime, dropoff_datetime, PULocationID, DOLocationID FROM trips"
        f" WHERE (PULocationID = {STADIUM} OR DOLocationID = {STADIUM}) AND pickup_datetime IS NOT NULL",
        ("trips",),
    ),
    "matched": (
        """SELECT near.*, window_start, game_datetime, window_end FROM near
        ASOF LEFT JOIN windows ON near.pickup_datetime >= windows.window_start""",
        ("near", "windows"),
    ),
    "flagged": (
        """SELECT *, coalesce(pickup_datetime BETWEEN window_start AND window_end, false) AS during_game,
          CAST(pickup_datetime AS DATE) IN (SELECT CAST(game_datetime AS DATE) FROM games) AS is_game_day
        FROM matched""",
        ("matched", "games"),
    ),
    "valid": (
        f"""SELECT *, distance_miles / duration_hours AS speed_mph,
          CAST(PULocationID AS VARCHAR) || '-' || CAST(DOLocationID AS VARCHAR) AS route,
          CASE WHEN DOLocationID = {STADIUM} THEN 'To_Stadium' ELSE 'From_Stadium' END AS direction
        FROM (SELECT f.*, {HOURS} AS duration_hours,
            sqrt(pow(a.x_ft - b.x_ft, 2) + pow(a.y_ft - b.y_ft, 2)) / 5280 AS distance_miles
          FROM flagged f JOIN listed_centroids a ON a.LocationID = PULocationID
          JOIN listed_centroids b ON b.LocationID = DOLocationID)
        WHERE duration_hours > 0 AND distance_miles > 0""",
        ("flagged", "listed_centroids"),
    ),
    "listed_centroids": (
        "SELECT * FROM centroids WHERE LocationID IN (SELECT LocationID FROM zones)",
        ("centroids", "zones"),
    ),
    "sides": (
        """SELECT *, 'game' AS side FROM valid WHERE during_game AND route IN (SELECT route FROM common)
        UNION ALL
        SELECT *, 'non_game' AS side FROM valid WHERE NOT is_game_day AND route IN (SELECT route FROM common)""",
        ("valid", "common"),
    ),
    "common": (
        "SELECT route FROM valid WHERE during_game INTERSECT SELECT route FROM valid WHERE NOT is_game_day",
        ("valid",),
    ),
    "route_pivot": (
        """SELECT route, coalesce(AVG(duration_hours) FILTER (NOT during_game), 0) * 60 AS non_game_time,
          coalesce(AVG(duration_hours) FILTER (during_game), 0) * 60 AS game_time
        FROM valid GROUP BY route""",
        ("valid",),
    ),
    "journeys": (
        f"SELECT * FROM (SELECT *, {MINUTES} AS journey_time, {HOUR} AS hour FROM trips) WHERE journey_time > 0",
        ("trips",),
    ),
    "durations": (
        f"""SELECT * FROM (SELECT *, {HOURS} AS duration_hours FROM trips)
        WHERE duration_hours > 0 AND duration_hours < 24
          AND PULocationID IN (SELECT LocationID FROM zones)
          AND DOLocationID IN (SELECT LocationID FROM zones)""",
        ("trips", "zones"),
    ),
    "zone_counts": (
        """SELECT LocationID, CAST(SUM(up) AS BIGINT) AS Pickup_Count, CAST(SUM(off) AS BIGINT) AS Dropoff_Count,
          CAST(SUM(up + off) AS BIGINT) AS Total_Trips
        FROM (SELECT PULocationID AS LocationID, 1 AS up, 0 AS off FROM trips
          UNION ALL SELECT DOLocationID, 0, 1 FROM trips)
        WHERE LocationID IS NOT NULL GROUP BY LocationID""",
        ("trips",),
    ),
    "totals": (
        """SELECT z.*, Pickup_Count, Dropoff_Count, coalesce(Total_Trips, 0) AS Total_Trips
        FROM zones z LEFT JOIN zone_counts USING (LocationID)""",
        ("zones", "zone_counts"),
    ),
    "sized": (
        f"""SELECT *, SUM(file_rows) OVER (PARTITION BY cab_type) AS type_rows,
          SUM(file_rows) OVER () AS overall_rows
        FROM (SELECT {FILE}, COUNT(*) AS file_rows FROM trips GROUP BY {FILE})""",
        ("trips",),
    ),
}


def _pairs(source: str, duration: bool = False) -> str:
    extra = (
        ", AVG(duration_hours) FILTER (PULocationID <= DOLocationID) AS up_time"
        ", AVG(duration_hours) FILTER (PULocationID > DOLocationID) AS down_time"
        if duration else ""
    )
    return f"""SELECT LEAST(PULocationID, DOLocationID) AS lo, GREATEST(PULocationID, DOLocationID) AS hi,
      COUNT(*) FILTER (PULocationID <= DOLocationID) AS up,
      COUNT(*) FILTER (PULocationID > DOLocationID) AS down{extra}
    FROM {source} WHERE PULocationID IS NOT NULL AND DOLocationID IS NOT NULL GROUP BY 1, 2"""


CTES["pairs"] = (_pairs("trips"), ("trips",))
CTES["timed_pairs"] = (_pairs("durations", True), ("durations",))


def _ranked(pairs: str, n: int, compat: bool = False, extra: str = "") -> str:
    """Directed totals of the top pairs."""
    both = "(lo = hi OR (up > 0 AND down > 0))"
    if compat:
        lead, total, forward = "up > 0", f"CASE WHEN {both} THEN 2 * (up + down) ELSE up + down END", "up + down"
        reverse = f"CASE WHEN {both} THEN up + down ELSE 0 END"
    else:
        lead, total, forward = "up >= down", "up + down", "GREATEST(up, down)"
        reverse = "CASE WHEN lo = hi THEN up ELSE LEAST(up, down) END"
    return f"""SELECT CASE WHEN {lead} THEN lo ELSE hi END AS PULocationID,
      CASE WHEN {lead} THEN hi ELSE lo END AS DOLocationID, CAST({total} AS BIGINT) AS Total_Trips,
      CAST({forward} AS BIGINT) AS Forward_Count, CAST({reverse} AS BIGINT) AS Reverse_Count,
      lo, hi{extra.replace('$lead', lead)}
    FROM {pairs} ORDER BY Total_Trips DESC, lo, hi LIMIT {n}"""


CTES["top50"] = (_ranked("pairs", 50), ("pairs",))
CTES["top5"] = (_ranked("pairs", 5), ("pairs",))
CTES["top50_compat"] = (_ranked("pairs", 50, True), ("pairs",))
_LEAD_TIME = ", CASE WHEN $lead THEN up_time ELSE down_time END AS lead_time"
CTES["timed100"] = (_ranked("timed_pairs", 100, False, _LEAD_TIME), ("timed_pairs",))
CTES["timed100_compat"] = (_ranked("timed_pairs", 100, True, _LEAD_TIME), ("timed_pairs",))
for _suffix in ("", "_compat"):
    CTES[f"metrics{_suffix}"] = (
        f"""SELECT t.*, sqrt(pow(a.x_ft - b.x_ft, 2) + pow(a.y_ft - b.y_ft, 2)) / 5280 / lead_time AS speed,
          lead_time AS time, CAST(Total_Trips AS DOUBLE) AS frequency
        FROM timed100{_suffix} t JOIN listed_centroids a ON a.LocationID = PULocationID
        JOIN listed_centroids b ON b.LocationID = DOLocationID""",
        (f"timed100{_suffix}", "listed_centroids"),
    )


# ---- cleaning chains ----------------------------------------------------------

_MONTH = "CAST(month({c}) AS INTEGER) = file_month AND year({y}) = 2024"


def _in_month(column: str, year_of: str | None = None) -> str:
    return _MONTH.format(c=column, y=year_of or column)


_LENGTH = "pickup_datetime IS DISTINCT FROM dropoff_datetime"
_FEE = "Airport_fee IN (0, 1.25, 1.75)"
_PASSENGERS = "passenger_count BETWEEN 1 AND 6"
_RATE = "RatecodeID BETWEEN 1 AND 6"


def _money(minimums: bool) -> list[tuple[str, str]]:
    steps = []
    for column, least in (("trip_distance", 0.1), ("fare_amount", 3.0), ("tip_amount", None)):
        if minimums and least is not None:
            steps.append((f"minimum {column}", f"{column} >= {least}"))
        steps.append((f"fence {column}", f"#{column}"))
    return steps


def _steps(cab: str, minimums: bool = False) -> list[tuple[str, str]]:
    month = ("file month", _in_month("pickup_datetime"))
    length, total = ("nonzero length", _LENGTH), ("fence total_amount", "#total_amount")
    present = [
        (f"{c} present", f"{c} IS NOT NULL")
        for c in ("hvfhs_license_num", "Affiliated_base_number", "dispatching_base_num")
    ]
    counts = [("passenger count", _PASSENGERS), ("rate code", _RATE)]
    return {
        "yellow": [month, length, *_money(minimums), ("airport fee", _FEE), total, *counts],
        "green": [
            month, length, *_money(minimums), total, *counts, ("trip type", "trip_type IN (1, 2)"),
        ],
        "fhv": [("file month", _in_month("pickup_datetime", "dropoff_datetime")), length, *present[1:]],
        "hvfhv": [
            *present, month, length, ("airport fee", _FEE), *_money(minimums), total,
            ("request month", _in_month("request_datetime")),
            ("scene month", _in_month("on_scene_datetime")),
        ],
    }[cab]


_ABS = ", ".join(
    f"abs({c}) AS {c}" for c in ("trip_distance", "fare_amount", "tip_amount", "total_amount", "Airport_fee")
)


def _chain(cab: str, minimums: bool = False) -> tuple[str, int]:
    """CTE text ``<cab>_0 .. <cab>_n`` and n."""
    parts = [f"{cab}_0 AS (SELECT * REPLACE ({_ABS}) FROM trips WHERE cab_type = '{cab}')"]
    steps = _steps(cab, minimums)
    for i, (_, keep) in enumerate(steps, start=1):
        before = f"{cab}_{i - 1}"
        if keep.startswith("#"):
            column = keep[1:]
            parts.append(
                f"{cab}_f{i} AS (SELECT file_year, file_month, quantile_cont({column}, 0.25) AS q1,"
                f" quantile_cont({column}, 0.75) AS q3 FROM {before} WHERE NOT {AIRPORT} GROUP BY 1, 2)"
            )
            parts.append(
                f"{cab}_{i} AS (SELECT s.* FROM {before} s LEFT JOIN {cab}_f{i} USING (file_year, file_month)"
                f" WHERE {AIRPORT} OR ({column} >= q1 - 1.5 * (q3 - q1) AND {column} <= q3 + 1.5 * (q3 - q1)))"
            )
        else:
            parts.append(f"{cab}_{i} AS (SELECT * FROM {before} WHERE {keep})")
    return ",\n".join(parts), len(steps)


def _with(body: str, *needs: str, extra: str = "") -> str:
    """``body`` under the CTEs it needs, in order of dependence."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dependency in CTES[name][1]:
            visit(dependency)
        order.append(name)

    for name in needs:
        visit(name)
    parts = [f"{name} AS ({CTES[name][0]})" for name in order]
    if extra:
        parts.append(extra)
    return f"WITH {', '.join(parts)}\n{body}"


def _r(*columns: str) -> str:
    """Rounded columns; ``name`` or ``expression AS name``. The nudge is the catalog's."""
    out = []
    for column in columns:
        text, _, name = column.rpartition(" AS ")
        out.append(f"ROUND(({text or column}) + 1e-9, 6) AS {name if text else column}")
    return ", ".join(out)


# ---- tail probabilities -------------------------------------------------------

_DENSITY = {
    "normal": "exp(-x * x / 2) / sqrt(2 * pi())",
    "t": (
        "exp(lgamma((d1 + 1) / 2) - lgamma(d1 / 2)) / sqrt(d1 * pi())"
        " * exp(-(d1 + 1) / 2 * ln(1 + x * x / d1))"
    ),
    "chi2": "CASE WHEN x <= 0 THEN 0 ELSE exp((d1 / 2 - 1) * ln(x) - x / 2 - d1 / 2 * ln(2) - lgamma(d1 / 2)) END",
    "f": (
        "CASE WHEN x <= 0 THEN 0 ELSE exp(lgamma((d1 + d2) / 2) - lgamma(d1 / 2) - lgamma(d2 / 2)"
        " + d1 / 2 * ln(d1 / d2) + (d1 / 2 - 1) * ln(x) - (d1 + d2) / 2 * ln(1 + d1 * x / d2)) END"
    ),
}
_PANELS = 4000


def _area(kind: str, source: str, key: str, stat: str, d1: str = "1", d2: str = "1") -> str:
    """Simpson integral of the density from 0 to ``stat`` per row: columns ``key``, ``area``."""
    return f"""SELECT {key} AS area_key, SUM(weight * ({_DENSITY[kind]})) * h / 3 AS area FROM (
      SELECT {key}, CAST({d1} AS DOUBLE) AS d1, CAST({d2} AS DOUBLE) AS d2, {stat} / {_PANELS}.0 AS h,
        {stat} * i / {_PANELS}.0 AS x,
        CASE WHEN i = 0 OR i = {_PANELS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS weight
      FROM {source}, range(0, {_PANELS + 1}) panel(i)) GROUP BY {key}, h"""


# Rational approximation of the normal distribution (Hart 1968, as given by West 2005).
_NORMAL_TOP = (
    3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931,
    220.206867912376,
)
_NORMAL_BOTTOM = (
    8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831,
    793.826512519948, 440.413735824752,
)


def _horner(factors: tuple[float, ...], x: str) -> str:
    text = repr(factors[0])
    for factor in factors[1:]:
        text = f"({text} * {x} + {factor!r})"
    return text


def _normal_cdf(x: str) -> str:
    """Lower tail of the normal distribution at a column, beyond 7 deviations 0 or 1."""
    size = f"abs({x})"
    tail = f"exp(-{x} * {x} / 2) * {_horner(_NORMAL_TOP, size)} / {_horner(_NORMAL_BOTTOM, size)}"
    tail = f"CASE WHEN {size} < 7 THEN {tail} ELSE 0 END"
    return f"CASE WHEN {x} > 0 THEN 1 - ({tail}) ELSE {tail} END"


def _range_tail(source: str, q: str, k: str, df: str) -> str:
    """Rows of ``source`` with ``p_adjusted``: the upper tail of the studentised range at ``q``.

    Trapezoids over the scale (in its own deviations, 10 either side of 1) and over the
    smallest of ``k`` normals; both integrands vanish smoothly at their ends.
    """
    return f"""scales AS (
      SELECT u, 1 + u / sqrt(2 * {df}) AS s,
        exp(({df} - 1) * ln(1 + u / sqrt(2 * {df})) - {df} * (u / sqrt(2 * {df}) + u * u / (4 * {df}))) AS weight
      FROM (SELECT i / 4.0 AS u FROM range(-40, 41) t(i)), (SELECT {df} FROM {source} LIMIT 1)
      WHERE 1 + u / sqrt(2 * {df}) > 0
    ), normals AS (
      SELECT z, exp(-z * z / 2) / sqrt(2 * pi()) / 8 AS weight, {_normal_cdf('z')} AS below
      FROM (SELECT i / 8.0 AS z FROM range(-64, 65) t(i))
    ), widths AS (
      SELECT group1, group2, {k} AS k, s.u AS place, s.weight AS scale_weight, n.weight, below, z - {q} * s AS x
      FROM {source}, scales s, normals n
    ), tails AS (
      SELECT group1, group2, 1 - sum(scale_weight * share) / sum(scale_weight) AS p_adjusted
      FROM (SELECT group1, group2, place, scale_weight, k * sum(weight * pow(greatest(below - cdf, 0), k - 1)) AS share
        FROM (SELECT *, {_normal_cdf('x')} AS cdf FROM widths) GROUP BY group1, group2, place, scale_weight, k)
      GROUP BY group1, group2)"""


def _t_points(source: str, df: str) -> str:
    """CTE ``points``: per ``d1`` the point with 5 % outside, from a running Simpson integral of the density."""
    width = 0.0005

    def density(at: str) -> str:
        return _DENSITY["t"].replace("x", at).replace(f"e{at}p", "exp")

    return f"""points AS (
      SELECT d1, x0 + (0.475 - upto + area) / ({density('(x0 + (0.475 - upto + area) / f0 / 2)')}) AS point FROM (
        SELECT *, sum(area) OVER (PARTITION BY d1 ORDER BY x0) AS upto FROM (
          SELECT d1, x0, {density('x0')} AS f0,
            ({density('x0')} + 4 * ({density(f'(x0 + {width / 2})')}) + ({density(f'(x0 + {width})')})) * {width} / 6 AS area
          FROM (SELECT DISTINCT CAST({df} AS DOUBLE) AS d1 FROM {source} WHERE {df} > 0),
            (SELECT i * {width} AS x0 FROM range(26000) t(i))))
      WHERE upto - area <= 0.475 AND 0.475 < upto)"""


_ROUTE = "CAST(PULocationID AS VARCHAR) || '-' || CAST(DOLocationID AS VARCHAR)"
_LEVEL = ("{0}", "date_trunc('minute', {0})", "date_trunc('hour', {0})")
CTES["timed"] = (f"SELECT trip_id, {FILE}, {_select(fixture.TIMED_COLUMNS)} FROM trips", ("trips",))
_VERDICT = "CASE WHEN p_value < 0.05 THEN 'Significant' ELSE 'Not significant' END AS verdict"

CTES["groups"] = (
    "SELECT hour, COUNT(journey_time) AS n, AVG(journey_time) AS mean,"
    " VAR_POP(journey_time) * COUNT(journey_time) AS ss FROM journeys GROUP BY hour",
    ("journeys",),
)
CTES["spreads"] = (
    """SELECT hour, COUNT(d) AS n, AVG(d) AS mean, VAR_POP(d) * COUNT(d) AS ss FROM (
      SELECT j.hour, abs(journey_time - med) AS d FROM journeys j
      JOIN (SELECT hour, median(journey_time) AS med FROM journeys GROUP BY hour) USING (hour))
    GROUP BY hour""",
    ("journeys",),
)
for _name, _source in (("anova", "groups"), ("levene", "spreads")):
    CTES[f"{_name}_row"] = (
        f"""SELECT 1 AS id, COUNT(*) - 1 AS df_between, CAST(SUM(n) AS BIGINT) - COUNT(*) AS df_within,
          SUM(ss) / (SUM(n) - COUNT(*)) AS mse,
          SUM(n * (mean - grand) * (mean - grand)) / (COUNT(*) - 1)
            / (SUM(ss) / (SUM(n) - COUNT(*))) AS statistic
        FROM {_source}, (SELECT SUM(n * mean) / SUM(n) AS grand FROM {_source})""",
        (_source,),
    )
    CTES[f"{_name}_full"] = (
        f"SELECT *, 1 - area AS p_value FROM {_name}_row JOIN"
        f" ({_area('f', f'{_name}_row', 'id', 'statistic', 'df_between', 'df_within')}) ON area_key = id",
        (f"{_name}_row",),
    )
CTES["pairs_of_hours"] = (
    """SELECT a.hour AS group1, b.hour AS group2, b.mean - a.mean AS mean_difference, df_between + 1 AS k,
      CAST(df_within AS DOUBLE) AS df_within,
      abs(b.mean - a.mean) / sqrt(mse / 2 * (1.0 / a.n + 1.0 / b.n)) AS q
    FROM groups a JOIN groups b ON a.hour < b.hour, anova_row""",
    ("groups", "anova_row"),
)
CTES["rank_by_hour"] = (
    """SELECT hour, rank() OVER (ORDER BY journey_time) + (COUNT(*) OVER (PARTITION BY journey_time) - 1) / 2.0 AS r,
      COUNT(*) OVER (PARTITION BY journey_time) AS t FROM journeys""",
    ("journeys",),
)
CTES["kruskal_row"] = (
    """SELECT 1 AS id, (12.0 / (n * (n + 1)) * rr - 3 * (n + 1)) / (1 - tie / (n * n * n - n)) AS statistic,
      k - 1 AS df, CAST(n AS BIGINT) AS n
    FROM (SELECT COUNT(*) AS k, CAST(SUM(c) AS DOUBLE) AS n, SUM(s * s / c) AS rr, SUM(tie) AS tie
      FROM (SELECT hour, COUNT(*) AS c, SUM(r) AS s, SUM(CAST(t AS DOUBLE) * t - 1) AS tie
        FROM rank_by_hour GROUP BY hour))""",
    ("rank_by_hour",),
)
CTES["kruskal_full"] = (
    f"SELECT *, 1 - area AS p_value FROM kruskal_row JOIN"
    f" ({_area('chi2', 'kruskal_row', 'id', 'statistic', 'df')}) ON area_key = id",
    ("kruskal_row",),
)


def _mann_whitney(source: str, value: str, side: str, first: str, second: str) -> str:
    """Row with statistic, n1, n2 and z."""
    return f"""SELECT 1 AS id, u AS statistic, n1, n2,
      (GREATEST(u, CAST(n1 AS DOUBLE) * n2 - u) - CAST(n1 AS DOUBLE) * n2 / 2 - 0.5)
        / sqrt(CAST(n1 AS DOUBLE) * n2 / 12 * ((n1 + n2 + 1) - tie / (CAST(n1 + n2 AS DOUBLE) * (n1 + n2 - 1)))) AS z
    FROM (SELECT COUNT(*) FILTER (g = 1) AS n1, COUNT(*) FILTER (g = 2) AS n2,
        SUM(r) FILTER (g = 1) - COUNT(*) FILTER (g = 1) * (COUNT(*) FILTER (g = 1) + 1) / 2.0 AS u,
        SUM(CAST(t AS DOUBLE) * t - 1) AS tie
      FROM (SELECT g, rank() OVER (ORDER BY v) + (COUNT(*) OVER (PARTITION BY v) - 1) / 2.0 AS r,
          COUNT(*) OVER (PARTITION BY v) AS t
        FROM (SELECT {value} AS v, CASE WHEN {side} = {first} THEN 1 WHEN {side} = {second} THEN 2 END AS g
          FROM {source}) WHERE g IS NOT NULL))"""


def _welch(source: str, value: str, side: str, first: str, second: str) -> str:
    return f"""SELECT *, 1 AS id, (mean1 - mean2) / sqrt(e1 + e2) AS statistic,
      (e1 + e2) * (e1 + e2) / (e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1)) AS df
    FROM (SELECT *, v1 / n1 AS e1, v2 / n2 AS e2 FROM (
      SELECT COUNT({value}) FILTER ({side} = {first}) AS n1, AVG({value}) FILTER ({side} = {first}) AS mean1,
        VAR_SAMP({value}) FILTER ({side} = {first}) AS v1, COUNT({value}) FILTER ({side} = {second}) AS n2,
        AVG({value}) FILTER ({side} = {second}) AS mean2, VAR_SAMP({value}) FILTER ({side} = {second}) AS v2
      FROM {source}))"""


for _name, _args, _need in (
    ("hours", ("journeys", "journey_time", "hour", "8", "3"), "journeys"),
    ("games", ("sides", "duration_hours", "side", "'game'", "'non_game'"), "sides"),
):
    CTES[f"mw_{_name}_row"] = (_mann_whitney(*_args), (_need,))
    CTES[f"mw_{_name}"] = (
        f"SELECT *, LEAST(1, 1 - 2 * area) AS p_value FROM mw_{_name}_row JOIN"
        f" ({_area('normal', f'mw_{_name}_row', 'id', 'z')}) ON area_key = id",
        (f"mw_{_name}_row",),
    )
    CTES[f"welch_{_name}_row"] = (_welch(*_args), (_need,))
    CTES[f"welch_{_name}"] = (
        f"SELECT *, 1 - 2 * area AS p_value FROM welch_{_name}_row JOIN"
        f" ({_area('t', f'welch_{_name}_row', 'id', 'abs(statistic)', 'df')}) ON area_key = id",
        (f"welch_{_name}_row",),
    )
CTES["spearman_row"] = (
    """SELECT 1 AS id, rho, n, rho * sqrt((n - 2) / ((1 + rho) * (1 - rho))) AS statistic, n - 2 AS df
    FROM (SELECT corr(rx, ry) AS rho, COUNT(*) AS n FROM (
      SELECT rank() OVER (ORDER BY journey_time) + (COUNT(*) OVER (PARTITION BY journey_time) - 1) / 2.0 AS rx,
        rank() OVER (ORDER BY trip_distance) + (COUNT(*) OVER (PARTITION BY trip_distance) - 1) / 2.0 AS ry
      FROM journeys WHERE trip_distance IS NOT NULL))""",
    ("journeys",),
)
CTES["spearman_full"] = (
    f"SELECT *, 1 - 2 * area AS p_value FROM spearman_row JOIN"
    f" ({_area('t', 'spearman_row', 'id', 'abs(statistic)', 'df')}) ON area_key = id",
    ("spearman_row",),
)
_LABELS = (
    "CASE WHEN abs(rho) > 0.7 THEN 'Strong' WHEN abs(rho) > 0.3 THEN 'Moderate' ELSE 'Weak' END AS strength,"
    " CASE WHEN rho > 0 THEN 'positive' ELSE 'negative' END AS sign"
)
CTES["fits"] = (
    """SELECT *, slope / sqrt((syy - slope * sxy) / ((n - 2) * sxx)) AS t_value FROM (
      SELECT hour, CAST(regr_count(journey_time, trip_distance) AS BIGINT) AS n, regr_slope(journey_time, trip_distance) AS slope,
        regr_r2(journey_time, trip_distance) AS r_squared, regr_sxx(journey_time, trip_distance) AS sxx,
        regr_syy(journey_time, trip_distance) AS syy, regr_sxy(journey_time, trip_distance) AS sxy
      FROM journeys GROUP BY hour) WHERE n > 1""",
    ("journeys",),
)


def _horner(coefficients, x: str) -> str:
    text = repr(coefficients[0])
    for value in coefficients[1:]:
        text = f"({text} * {x} + {value!r})"
    return text


def _probit(p: str) -> str:
    """Normal quantile of ``p`` by the same published approximation."""
    q, s = f"({p} - 0.5)", f"sqrt(-ln(LEAST({p}, 1 - {p})))"

    def ratio(table, x):
        return f"{_horner(table[0], x)} / {_horner(table[1], x)}"

    return (
        f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {ratio(normality._CENTRE, f'(0.180625 - {q} * {q})')}"
        f" WHEN {s} <= 5 THEN sign({q}) * {ratio(normality._NEAR, f'({s} - 1.6)')}"
        f" ELSE sign({q}) * {ratio(normality._FAR, f'({s} - 5)')} END"
    )


def _shapiro(source: str) -> str:
    """W by its definition, one weight per sorted row, and its normal deviate."""
    large = f"(ln(1 - statistic) - {_horner(normality._LARGE_MEAN, 'ln(n)')}) / exp({_horner(normality._LARGE_LOG_SD, 'ln(n)')})"
    small = (
        f"(-ln({_horner(normality._SMALL_GAMMA, 'n')} - ln(1 - statistic)) - {_horner(normality._SMALL_MEAN, 'n')})"
        f" / exp({_horner(normality._SMALL_LOG_SD, 'n')})"
    )
    return f"""WITH o AS (SELECT journey_time AS v, row_number() OVER (ORDER BY journey_time) AS i,
        COUNT(*) OVER () AS n, AVG(journey_time) OVER () AS mean FROM {source}),
      p AS (SELECT *, (i - 0.375) / (n + 0.25) AS p FROM o),
      m AS (SELECT *, {_probit('p')} AS m FROM p),
      c AS (SELECT MAX(n) AS n, SUM(m * m) AS mm, MAX(m) AS m1, MAX(m) FILTER (i = n - 1) AS m2,
        1 / sqrt(MAX(n)) AS u FROM m),
      a AS (SELECT *, m1 / sqrt(mm) + {_horner(normality._LAST, 'u')} AS a1,
        m2 / sqrt(mm) + {_horner(normality._SECOND, 'u')} AS a2 FROM c),
      f AS (SELECT *, CASE WHEN n > 5 THEN (mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)
          ELSE (mm - 2 * m1 * m1) / (1 - 2 * a1 * a1) END AS phi FROM a),
      w AS (SELECT 1 AS id, pow(SUM((v - mean) * CASE WHEN i = m.n THEN a1 WHEN i = 1 THEN -a1
          WHEN m.n > 5 AND i = m.n - 1 THEN a2 WHEN m.n > 5 AND i = 2 THEN -a2 ELSE m / sqrt(phi) END), 2)
          / SUM((v - mean) * (v - mean)) AS statistic, MAX(m.n) AS n FROM m, f)
      SELECT *, CASE WHEN n > 11 THEN {large} ELSE {small} END AS z FROM w"""


for _name, _source in (
    ("all", "journeys"),
    ("route", "(SELECT * FROM journeys WHERE PULocationID = 133 AND DOLocationID = 130)"),
):
    CTES[f"shapiro_{_name}_row"] = (_shapiro(_source), ("journeys",))
    # The deviate is large and positive, so the tail is cut at 40.
    CTES[f"shapiro_{_name}"] = (
        f"SELECT *, 0.5 - area AS p_value FROM shapiro_{_name}_row JOIN"
        f" ({_area('normal', f'shapiro_{_name}_row', 'id', 'LEAST(GREATEST(z, -40), 40)')}) ON area_key = id",
        (f"shapiro_{_name}_row",),
    )

# ---- anonymity ----------------------------------------------------------------

CTES["coarse"] = (
    "SELECT trip_id, cab_type, file_year, file_month, date_trunc('hour', pickup_datetime) AS pickup_datetime,"
    " date_trunc('hour', dropoff_datetime) AS dropoff_datetime, PULocationID, DOLocationID FROM trips",
    ("trips",),
)
CTES["dense"] = (
    f"SELECT trip_id, {FILE}, "
    + ", ".join(
        f"date_trunc('hour', {text.format(ntz='TIMESTAMP')}) AS {name}" if name.endswith("datetime")
        else f"{text} AS {name}"
        for name, text in fixture.DENSE_COLUMNS.items()
    )
    + " FROM trips",
    ("trips",),
)
_QI = "pickup_datetime, dropoff_datetime, PULocationID, DOLocationID"
_QI_SMALL = "pickup_datetime, DOLocationID"


def _released(k: int, limit: float, qi: str, by: str = "") -> str:
    """CTE text ``kept``: coarse trips with class size, and share lost of their part."""
    keys = f"{by}, {qi}" if by else qi
    over = f"PARTITION BY {by}" if by else ""
    return f"""kept AS (SELECT * FROM (SELECT *,
        100.0 * SUM(CASE WHEN class_size < {k} THEN 1 ELSE 0 END) OVER ({over}) / COUNT(*) OVER ({over}) AS lost
      FROM (SELECT *, COUNT(*) OVER (PARTITION BY {keys}) AS class_size FROM coarse))
      WHERE class_size >= {k} AND lost <= {limit})"""


def _report(k: int, limit: float, qi: str, by: str = "") -> str:
    part, grouped = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return f"""SELECT {part}k_before, rows_before, ROUND(lost + 1e-9, 6) AS dropped_pct,
      CASE WHEN lost <= {limit} THEN k_kept END AS k_after, CASE WHEN lost <= {limit} THEN kept ELSE 0 END AS rows_after
    FROM (SELECT {part}MIN(n) AS k_before, CAST(SUM(n) AS BIGINT) AS rows_before, MIN(n) FILTER (n >= {k}) AS k_kept,
        CAST(coalesce(SUM(n) FILTER (n >= {k}), 0) AS BIGINT) AS kept,
        100.0 * coalesce(SUM(n) FILTER (n < {k}), 0) / SUM(n) AS lost
      FROM (SELECT {part}COUNT(*) AS n FROM coarse GROUP BY {part}{qi}){grouped})"""


# ---- sampling -----------------------------------------------------------------

_TEXT = "CAST(length(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR)"
_DRAW = f"md5(concat_ws('|', '42', {_TEXT.format('trip_id')}))"


def _allocation(total: int, source: str = "sized") -> str:
    return f"""SELECT {FILE}, file_rows, CAST(type_rows AS BIGINT) AS type_rows, type_take,
      LEAST(CAST(floor(CAST(file_rows AS DOUBLE) / type_rows * CAST(type_take AS DOUBLE)) AS BIGINT), file_rows) AS take
    FROM (SELECT *, GREATEST(CAST(floor(CAST(type_rows AS DOUBLE) / overall_rows * {total}.0) AS BIGINT), 1) AS type_take
      FROM {source})"""


def _drawn(total: int, source: str = "sized", trips: str = "trips") -> str:
    return f"""allocated AS ({_allocation(total, source)}), drawn AS (
      SELECT * FROM (SELECT t.*, take, row_number() OVER (PARTITION BY {FILE} ORDER BY {_DRAW}) AS turn
        FROM {trips} t JOIN allocated USING ({FILE})) WHERE turn <= take)"""


_LITTLE = "trip_id, cab_type, file_month"


def _grid() -> str:
    cells = ", ".join(
        f"CAST(COUNT(VendorID) FILTER (hour(pickup_datetime) = {h}) AS BIGINT) AS h{h:02d}" for h in range(24)
    )
    filled = ", ".join(f"coalesce(h{h:02d}, 0) AS h{h:02d}" for h in range(24))
    return f"""SELECT weekday_no, weekday, {filled} FROM days LEFT JOIN (
      SELECT CAST(isodow(pickup_datetime) - 1 AS INTEGER) AS weekday_no, {cells}
      FROM trips WHERE {THIS_YEAR} AND DOLocationID = {DROPOFF} GROUP BY 1) USING (weekday_no)"""


_DAYS = (
    "(0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'), (4, 'Friday'), (5, 'Saturday'), (6, 'Sunday')"
)
CTES["days"] = (
    f"SELECT CAST(n AS INTEGER) AS weekday_no, d AS weekday FROM (VALUES {_DAYS}) v(n, d)", ()
)


def _norm(metric: str) -> str:
    x = "ln(1 + Metric_Value)" if metric == "frequency" else "Metric_Value"

    def part(a, b, start, width, flat):
        return f"CASE WHEN {b} > {a} THEN {start} + {width} * (x - {a}) / ({b} - {a}) ELSE {flat} END"

    norm = (
        f"CASE WHEN x <= q1 THEN {part('q0', 'q1', 0, 0.25, 0.25)} WHEN x <= q2 THEN"
        f" {part('q1', 'q2', 0.25, 0.5, 0.5)} ELSE {part('q2', 'q3', 0.75, 0.25, 1.0)} END"
    )
    norm = f"GREATEST(0, LEAST(1, {norm}))"
    if metric == "time":
        norm = f"1 - {norm}"
    return f"""SELECT PULocationID, DOLocationID, Total_Trips, Forward_Count, Reverse_Count,
      {_r('Metric_Value', f'{norm} AS norm')}
    FROM (SELECT *, {metric} AS Metric_Value, {x.replace('Metric_Value', metric)} AS x FROM metrics),
      (SELECT quantile_cont(x, 0.0) AS q0, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q2,
        quantile_cont(x, 1.0) AS q3 FROM (SELECT {x.replace('Metric_Value', metric)} AS x FROM metrics))"""


def _lonlat(x: str, y: str) -> tuple[str, str]:
    ecc, cone, radius, rho0 = proj._constants()
    east = f"(({x} - {proj.FALSE_EASTING_FT}) * {proj.FOOT_M!r})"
    north = f"({rho0!r} - ({y} - {proj.FALSE_NORTHING_FT}) * {proj.FOOT_M!r})"
    t = f"pow(sqrt({east} * {east} + {north} * {north}) / {radius!r}, {1 / cone!r})"
    lon = f"degrees(atan2({east}, {north})) / {cone!r} + ({proj.CENTRAL_MERIDIAN})"
    return lon, t


def _lonlat_query(source: str, keep: str, x: str, y: str) -> str:
    ecc = proj._constants()[0]
    lon, t = _lonlat(x, y)
    inner = f"SELECT *, {lon} AS lon, {t} AS t, pi() / 2 - 2 * atan({t}) AS phi0 FROM {source}"
    for i in range(proj.LATITUDE_STEPS):
        s = f"({ecc!r} * sin(phi{i}))"
        inner = (
            f"SELECT *, pi() / 2 - 2 * atan(t * pow((1 - {s}) / (1 + {s}), {ecc / 2!r})) AS phi{i + 1}"
            f" FROM ({inner})"
        )
    return f"SELECT {keep}, {_r('lon', f'degrees(phi{proj.LATITUDE_STEPS}) AS lat')} FROM ({inner})"


def statements() -> dict[str, str]:
    """One statement per catalog key that SQL can express."""
    q: dict[str, str] = {}
    metered = {c: f"CASE WHEN cab_type <> 'fhv' THEN {c} END" for c in ("trip_distance", "fare_amount", "total_amount")}
    q["scan_trips"] = _with(
        f"SELECT {_LITTLE}, file_year, pickup_datetime, dropoff_datetime, PULocationID, DOLocationID, "
        + _r(*[f"{text} AS {name}" for name, text in metered.items()]) + " FROM trips", "trips")
    q["scan_pruned"] = _with(
        f"SELECT {FILE}, pickup_datetime, DOLocationID, "
        + _r(f"{metered['total_amount']} AS total_amount") + " FROM trips", "trips")
    spoilt = ", ".join(
        f"('{cab}', {month}, '{'damaged' if how in ('damaged', 'flipped') else 'unreadable'}')" for cab, month, how in fixture.SPOILT
    )
    bad = f"(VALUES {spoilt}) b(cab_type, file_month, error)"
    q["bad_files"] = _with(
        f'SELECT {FILE}, CAST(0 AS BIGINT) AS "rows", error FROM sized JOIN {bad} USING (cab_type, file_month)', "sized")
    q["file_row_counts"] = _with(
        f"""SELECT {FILE}, file_rows, type_rows, overall_rows,
          {_r('CAST(type_rows AS DOUBLE) / overall_rows AS type_share')}
        FROM (SELECT {FILE}, file_rows, CAST(SUM(file_rows) OVER (PARTITION BY cab_type) AS BIGINT) AS type_rows,
            CAST(SUM(file_rows) OVER () AS BIGINT) AS overall_rows
          FROM (SELECT {FILE}, CASE WHEN error IS NULL THEN file_rows ELSE 0 END AS file_rows
            FROM sized LEFT JOIN {bad} USING (cab_type, file_month)))""", "sized")
    q["file_row_counts_of_trips"] = _with(
        f"""SELECT {FILE}, file_rows, CAST(type_rows AS BIGINT) AS type_rows,
        CAST(overall_rows AS BIGINT) AS overall_rows, {_r('CAST(type_rows AS DOUBLE) / overall_rows AS type_share')}
        FROM sized""", "sized")
    q["write_monthly"] = _with(f"SELECT {_LITTLE}, file_year, {_r('fare_amount')} FROM trips", "trips")
    fares = f"""SELECT PULocationID, {HOUR} AS hour, {_r('AVG(fare_amount) AS fare_amount')} FROM trips
        WHERE PULocationID IS NOT NULL AND pickup_datetime IS NOT NULL GROUP BY 1, 2"""
    q["precomputed_fares"] = q["stored_fares_reused"] = q["avg_fare_by_zone_hour"] = _with(fares, "trips")
    q["fares_of_hour"] = _with(f"SELECT * FROM ({fares}) WHERE hour = 12", "trips")
    q["game_schedule"] = _with("SELECT Date, start_time, Visitor, game_datetime FROM games", "games")
    q["zone_dim"] = _with("SELECT * FROM zones", "zones")

    # cleaning
    cabs = ("yellow", "green", "fhv", "hvfhv")

    def only(column: str, *kinds: str) -> str:
        listed = ", ".join(f"'{k}'" for k in kinds)
        return f"CASE WHEN cab_type IN ({listed}) THEN {column} END"

    q["normalise_schema"] = _with(
        f"""SELECT trip_id, cab_type, file_month, pickup_datetime, dropoff_datetime, PULocationID, DOLocationID,
        {_r(*[f"{only(c, 'yellow', 'green', 'hvfhv')} AS {c}" for c in
              ('trip_distance', 'fare_amount', 'tip_amount', 'total_amount')],
            f"{only('Airport_fee', 'yellow', 'hvfhv')} AS Airport_fee")},
        {', '.join(f"{only(c, 'yellow', 'green')} AS {c}" for c in ('passenger_count', 'RatecodeID', 'payment_type'))},
        {only('trip_type', 'green')} AS trip_type, {only('SR_Flag', 'fhv')} AS SR_Flag,
        {only('trip_time', 'hvfhv')} AS trip_time,
        {', '.join(f"{only(c, 'fhv', 'hvfhv')} AS {c}" for c in ('dispatching_base_num', 'Affiliated_base_number'))},
        {', '.join(f"{only(c, 'hvfhv')} AS {c}" for c in
                   ('hvfhs_license_num', 'request_datetime', 'on_scene_datetime'))} FROM trips""", "trips")

    def kept(name: str, where: str, columns: str = "") -> None:
        extra = f", {columns}" if columns else ""
        q[name] = _with(f"SELECT {_LITTLE}{extra} FROM trips WHERE {where}", "trips")

    kept("filter_file_month",
         f"CASE WHEN cab_type = 'fhv' THEN {_in_month('pickup_datetime', 'dropoff_datetime')}"
         f" ELSE {_in_month('pickup_datetime')} END")
    kept("filter_request_scene_month",
         f"cab_type = 'hvfhv' AND {_in_month('request_datetime')} AND {_in_month('on_scene_datetime')}")
    kept("filter_nonzero_length", _LENGTH)
    kept("filter_required", "Affiliated_base_number IS NOT NULL AND dispatching_base_num IS NOT NULL"
         " AND (cab_type <> 'hvfhv' OR hvfhs_license_num IS NOT NULL)")
    amounts = ("trip_distance", "fare_amount", "tip_amount", "total_amount", "Airport_fee")
    q["abs_amounts"] = _with(
        f"SELECT {_LITTLE}, {_r(*[f'abs({c}) AS {c}' for c in amounts])} FROM trips", "trips")
    for name, column, normal in (
        ("iqr_fence", "fare_amount", "true"),
        ("iqr_fence_airport_exempt", "total_amount", f"NOT {AIRPORT}"),
    ):
        q[name] = _with(
            f"""SELECT {_LITTLE}, {_r(column)} FROM trips LEFT JOIN (
              SELECT {FILE}, quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3
              FROM trips WHERE {normal} GROUP BY {FILE}) USING ({FILE})
            WHERE NOT ({normal}) OR ({column} >= q1 - 1.5 * (q3 - q1) AND {column} <= q3 + 1.5 * (q3 - q1))""",
            "trips")
    kept("filter_allowed_values", f"{_FEE} AND trip_type IN (1, 2)", f"{_r('Airport_fee')}, trip_type")
    kept("filter_ranges", f"{_PASSENGERS} AND {_RATE}", "passenger_count, RatecodeID")
    kept("filter_minimums", "abs(trip_distance) >= 0.1 AND abs(fare_amount) >= 3.0",
         _r("abs(trip_distance) AS trip_distance", "abs(fare_amount) AS fare_amount"))
    cleaned = f"{_LITTLE}, pickup_datetime, dropoff_datetime, PULocationID, DOLocationID, " + _r(*amounts[:4])
    lines = []
    chains = []
    for cab in cabs:
        chain, last = _chain(cab)
        q[f"clean_{cab}"] = _with(f"SELECT {cleaned} FROM {cab}_{last}", "trips", extra=chain)
        chains.append(chain)
        files = f"(SELECT DISTINCT {FILE} FROM {cab}_0) f"

        def size(i, cab=cab):
            return (f"(SELECT COUNT(*) FROM {cab}_{i} s WHERE s.file_year = f.file_year"
                    " AND s.file_month = f.file_month)")

        names = ["input", *[name for name, _ in _steps(cab)], "final"]
        for i, name in enumerate(names):
            count = size(0) if i == 0 else size(last) if i > last else f"{size(i - 1)} - {size(i)}"
            lines.append(f"SELECT {FILE}, CAST({i} AS INTEGER) AS step_no, '{name}' AS step, {count} AS row_count FROM {files}")
    q["cleaning_audit"] = _with("\nUNION ALL ".join(lines), "trips", extra=",\n".join(chains))
    chain, last = _chain("yellow", True)
    q["clean_yellow_minimums"] = _with(f"SELECT {cleaned} FROM yellow_{last}", "trips", extra=chain)
    kept("filter_year", THIS_YEAR, "pickup_datetime")
    kept("filter_dropoff_zone", f"{THIS_YEAR} AND DOLocationID = {DROPOFF}", "DOLocationID")
    q["filter_hour"] = _with(
        f"SELECT PULocationID, {_r('fare_amount')} FROM trips WHERE hour(pickup_datetime) = 12", "trips")
    q["filter_valid_duration"] = _with(
        f"SELECT trip_id, PULocationID, DOLocationID, {_r('duration_hours')} FROM durations", "durations")
    q["filter_positive_journey"] = _with(f"SELECT trip_id, {_r('journey_time')}, hour FROM journeys", "journeys")

    # derived columns
    q["journey_minutes"] = _with(f"SELECT trip_id, {_r(f'{MINUTES} AS journey_time')} FROM trips", "trips")
    q["duration_hours"] = _with(f"SELECT trip_id, {_r(f'{HOURS} AS duration_hours')} FROM trips", "trips")
    q["time_parts"] = _with(
        f"""SELECT trip_id, {HOUR} AS hour, dayname(pickup_datetime) AS weekday, CAST(pickup_datetime AS DATE) AS date,
        CAST(month(pickup_datetime) AS INTEGER) AS month, CAST(year(pickup_datetime) AS INTEGER) AS year FROM trips""",
        "trips")
    q["route_key"] = _with(
        "SELECT trip_id, CAST(PULocationID AS VARCHAR) || '-' || CAST(DOLocationID AS VARCHAR) AS route FROM trips", "trips")
    at_stadium = f"(PULocationID = {STADIUM} OR DOLocationID = {STADIUM})"
    q["stadium_direction"] = _with(
        f"SELECT trip_id, CASE WHEN DOLocationID = {STADIUM} THEN 'To_Stadium' ELSE 'From_Stadium' END AS direction"
        f" FROM trips WHERE {at_stadium}", "trips")
    q["speed_mph"] = _with(
        f"SELECT trip_id, {_r(f'coalesce(CASE WHEN {HOURS} > 0 THEN trip_distance / ({HOURS}) END, 0) AS speed_mph')} FROM trips",
        "trips")
    q["time_generalise"] = _with(
        "SELECT trip_id, pickup_datetime AS at_full, date_trunc('minute', pickup_datetime) AS at_minute,"
        " date_trunc('hour', pickup_datetime) AS at_hour FROM trips", "trips")

    # sampling
    q["sample_allocation"] = _with(_allocation(2000), "sized")
    q["sample_stratified_exact"] = _with(
        f"SELECT {_LITTLE}, {_r('fare_amount')} FROM drawn", "sized", extra=_drawn(2000))
    q["sample_all_cabs"] = _with(
        f"SELECT {_LITTLE}, {_r('fare_amount')} FROM (SELECT * FROM drawn ORDER BY {_DRAW} LIMIT 1000)",
        "sized", extra=_drawn(1000))
    q["sample_n"] = _with(
        f"""SELECT {_LITTLE}, {_r('fare_amount')} FROM (SELECT t.* FROM trips t JOIN (
          SELECT {FILE} FROM sized ORDER BY md5(concat_ws('|', '42', {_TEXT.format('cab_type')},
            {_TEXT.format('file_year')}, {_TEXT.format('file_month')})) LIMIT 1) USING ({FILE}) ORDER BY {_DRAW} LIMIT 100)""", "sized")
    yellow = (
        "yellow_sized AS (SELECT * REPLACE (type_rows AS overall_rows) FROM sized WHERE cab_type = 'yellow')"
    )
    q["sample_year"] = _with(
        f"SELECT {_LITTLE}, {_r('fare_amount')} FROM drawn", "sized",
        extra=f"{yellow}, {_drawn(500, 'yellow_sized')}")

    # demand
    def per(name: str, key: str, where: str = THIS_YEAR) -> str:
        return f"SELECT {key} AS {name}, COUNT(VendorID) AS trips FROM trips WHERE {where} GROUP BY 1 ORDER BY 1"

    q["daily_trips"] = _with(per("date", "CAST(pickup_datetime AS DATE)"), "trips")
    q["trips_by_hour"] = _with(per("hour", HOUR), "trips")
    q["trips_by_weekday"] = _with(
        f"""SELECT weekday_no, weekday, coalesce(trips, 0) AS trips FROM days LEFT JOIN (
        {per('weekday_no', 'CAST(isodow(pickup_datetime) - 1 AS INTEGER)')}) USING (weekday_no) ORDER BY 1""",
        "trips", "days")
    q["hourly_demand_at_dropoff"] = _with(per("hour", HOUR, f"{THIS_YEAR} AND DOLocationID = {DROPOFF}"), "trips")
    q["avg_fare_by_hour_at_dropoff"] = _with(
        f"SELECT {HOUR} AS hour, {_r('coalesce(SUM(total_amount) / nullif(COUNT(total_amount), 0), 0) AS avg_fare')}"
        f" FROM trips WHERE {THIS_YEAR} AND DOLocationID = {DROPOFF} GROUP BY 1 ORDER BY 1", "trips")
    q["weekday_hour_grid"] = _with(_grid(), "trips", "days")
    ends = "PULocationID IS NOT NULL AND DOLocationID IS NOT NULL"
    q["avg_journey_by_od"] = _with(
        f"SELECT PULocationID, DOLocationID, {_r(f'AVG({MINUTES}) AS journey_time')} FROM trips WHERE {ends} GROUP BY 1, 2",
        "trips")
    q["avg_journey_by_distance"] = _with(
        f"SELECT trip_distance, {_r(f'AVG({MINUTES}) AS journey_time')} FROM trips"
        " WHERE cab_type IN ('yellow', 'green') AND trip_distance IS NOT NULL GROUP BY 1", "trips")
    q["od_trip_count"] = _with(
        f"SELECT PULocationID, DOLocationID, COUNT(*) AS Trip_Count FROM trips WHERE {ends} GROUP BY 1, 2", "trips")
    for name, value in (("journey", MINUTES), ("fare", "fare_amount")):
        label = "journey_time" if name == "journey" else "fare_amount"
        q[f"avg_{name}_by_hour"] = _with(
            f"SELECT {HOUR} AS hour, {_r(f'AVG({value}) AS {label}')} FROM trips WHERE pickup_datetime IS NOT NULL GROUP BY 1",
            "trips")
    q["zone_trip_counts"] = _with("SELECT * FROM zone_counts", "zone_counts")
    q["zone_totals"] = _with(
        "SELECT LocationID, Zone, Pickup_Count, Dropoff_Count, Total_Trips FROM totals", "totals")
    shares = (0.05, 0.1, 0.2, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
    points = [f"quantile_cont(v, {s}) AS p{round(s * 100):02d}" for s in shares]
    q["zone_total_distribution"] = _with(
        f"""SELECT scope, COUNT(*) AS zones, {_r('AVG(v) AS mean', 'STDDEV_SAMP(v) AS std', 'MIN(v) AS min',
        'MAX(v) AS max', *points)} FROM (SELECT 'all' AS scope, CAST(Total_Trips AS DOUBLE) AS v FROM totals
        UNION ALL SELECT 'non_zero', Total_Trips FROM totals WHERE Total_Trips > 0) GROUP BY scope""", "totals")
    # quantile_cont wants a constant share, so the breaks are listed one by one.
    q["zone_class_breaks"] = _with(
        " UNION ALL ".join(
            f"""SELECT CAST({i} AS INTEGER) AS position, ROUND(quantile_cont(CAST(Total_Trips AS DOUBLE), {s}) + 1e-9, 6) AS "limit"
            FROM totals WHERE Total_Trips > 0""" for i, s in enumerate((0.0, 0.05, 0.2, 0.5, 0.75, 0.95, 1.0))), "totals")
    q["zone_equal_bins"] = _with(
        """SELECT LocationID, Total_Trips, CASE WHEN Total_Trips > 0 THEN
          CAST(LEAST(floor((CAST(Total_Trips AS DOUBLE) - lo) * 32 / (hi - lo)) + 1, 32) AS INTEGER) END AS bin
        FROM totals, (SELECT CAST(MIN(Total_Trips) AS DOUBLE) AS lo, CAST(MAX(Total_Trips) AS DOUBLE) AS hi
          FROM totals WHERE Total_Trips > 0)""", "totals")
    q["incremental_hourly"] = _with(
        f"""SELECT {HOUR} AS hour, COUNT(VendorID) AS trips, {_r('SUM(total_amount) AS amount_sum')},
        COUNT(total_amount) AS amount_n, {_r('AVG(total_amount) AS avg_amount')}
        FROM trips WHERE {THIS_YEAR} GROUP BY 1""", "trips")
    q["incremental_daily"] = _with(per("date", "CAST(pickup_datetime AS DATE)"), "trips")
    q["incremental_weekday_hour"] = _with(
        f"""SELECT CAST(isodow(pickup_datetime) - 1 AS INTEGER) AS weekday_no, {HOUR} AS hour, COUNT(VendorID) AS trips
        FROM trips WHERE {THIS_YEAR} GROUP BY 1, 2""", "trips")
    q["incremental_fares_at_dropoff"] = q["avg_fare_by_hour_at_dropoff"]
    q["incremental_grid_at_dropoff"] = q["weekday_hour_grid"]
    q["group_summary"] = _with(
        f"SELECT hour, {_r('AVG(journey_time) AS mean', 'median(journey_time) AS median', 'STDDEV_SAMP(journey_time) AS std')}"
        " FROM journeys GROUP BY hour", "journeys")
    q["box_stats_by_hour"] = _with(
        f"""SELECT hour, {_r('q1', 'median', 'q3')},
        {_r(*[f'{f}(journey_time) FILTER (journey_time BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS {n}'
              for f, n in (('MIN', 'whisker_low'), ('MAX', 'whisker_high'))])}, COUNT(journey_time) AS n
        FROM journeys JOIN (SELECT hour, quantile_cont(journey_time, 0.25) AS q1, median(journey_time) AS median,
          quantile_cont(journey_time, 0.75) AS q3 FROM journeys GROUP BY hour) USING (hour)
        GROUP BY hour, q1, median, q3""", "journeys")
    for name, group in (("hour", "hour"), ("route", _ROUTE)):
        q[f"mean_ci_by_{name}"] = _with(
            f"""SELECT {name}, n, {_r('mean', 'std', 'mean - point * std / sqrt(n) AS ci_low', 'mean + point * std / sqrt(n) AS ci_high')}
            FROM sums LEFT JOIN points ON d1 = n - 1""", "journeys",
            extra=f"""sums AS (SELECT {group} AS {name}, COUNT(journey_time) AS n, AVG(journey_time) AS mean,
              STDDEV_SAMP(journey_time) AS std FROM journeys WHERE {group} IS NOT NULL GROUP BY 1),
            {_t_points('sums', 'n - 1')}""")
    weight = demand._poisson_weight("d")
    q["mean_bootstrap_by_hour"] = _with(
        f"""SELECT hour, n, {_r('mean', 'boot_low', 'boot_high')} FROM (
          SELECT hour, quantile_cont(s / w, 0.025) AS boot_low, quantile_cont(s / w, 0.975) AS boot_high FROM (
            SELECT hour, b, sum(w) AS w, sum(w * v) AS s FROM (
              SELECT hour, b, v, {weight} AS w FROM (
                SELECT hour, b, v, {demand.bootstrap_draw('k', 'b')} AS d FROM (
                  SELECT hour, journey_time AS v, CAST('0x' || substr({_DRAW}, 1, 12) AS BIGINT) % {demand._PRIME} AS k FROM journeys),
                  range(200) t(b)))
            GROUP BY hour, b) WHERE w > 0 GROUP BY hour)
        JOIN (SELECT hour, COUNT(journey_time) AS n, AVG(journey_time) AS mean FROM journeys GROUP BY hour) USING (hour)""",
        "journeys")

    # routes
    shown = "PULocationID, DOLocationID, Total_Trips, Forward_Count, Reverse_Count"
    q["top_routes_bidirectional"] = _with(f"SELECT {shown} FROM top50", "top50")
    for suffix in ("", "_compat"):
        q[f"route_share{suffix}"] = _with(
            f"SELECT {shown}, {_r('100.0 * Total_Trips / (SELECT COUNT(*) FROM trips) AS Percentage')} FROM top50{suffix}",
            f"top50{suffix}", "trips")
    q["route_names"] = _with(
        f"""SELECT {shown}, coalesce(a.Zone, 'Zone ' || CAST(PULocationID AS VARCHAR)) AS start_name,
        coalesce(b.Zone, 'Zone ' || CAST(DOLocationID AS VARCHAR)) AS end_name FROM top50
        LEFT JOIN zones a ON a.LocationID = PULocationID LEFT JOIN zones b ON b.LocationID = DOLocationID""",
        "top50", "zones")
    for metric in ("speed", "time", "frequency"):
        q[f"route_metric_{metric}"] = _with(
            f"SELECT {shown}, {_r(f'{metric} AS Metric_Value')} FROM metrics", "metrics")
        q[f"percentile_norm_{metric}"] = _with(_norm(metric), "metrics")
    q["route_metric_compat"] = _with(
        f"SELECT {shown}, {_r('speed AS Metric_Value')} FROM metrics_compat", "metrics_compat")
    q["scaled_weights"] = _with(
        f"SELECT {shown}, {_r('Total_Trips / CAST((SELECT MAX(Total_Trips) FROM top50) AS DOUBLE) * 10 + 2 AS weight')} FROM top50",
        "top50")
    nodes = "nodes AS (SELECT * FROM totals WHERE Total_Trips >= 0.049 * (SELECT SUM(Total_Trips) FROM totals))"
    weight = "CAST({0} AS DOUBLE) / (SELECT MAX({0}) FROM {1}) * 10.5 + 0.5 AS weight"
    q["zone_graph_nodes"] = _with(
        f"SELECT LocationID, Zone, Total_Trips, {_r(weight.format('Total_Trips', 'nodes'))} FROM nodes", "totals", extra=nodes)
    q["zone_graph_edges"] = _with(
        f"SELECT PULocationID, DOLocationID, Trip_Count, {_r(weight.format('Trip_Count', 'edges'))} FROM edges",
        "totals", "trips", extra=nodes + """, edges AS (SELECT PULocationID, DOLocationID, COUNT(*) AS Trip_Count FROM trips
          WHERE PULocationID IN (SELECT LocationID FROM nodes) AND DOLocationID IN (SELECT LocationID FROM nodes) GROUP BY 1, 2)""")
    q["zones_in_top_routes"] = _with(
        """SELECT LocationID, Zone, Total_Trips FROM totals WHERE LocationID IN
        (SELECT PULocationID FROM top5 UNION SELECT DOLocationID FROM top5)""", "totals", "top5")

    # geometry
    q["zone_centroids"] = q["zone_centroids_any_order"] = _with(f"SELECT LocationID, {_r('x_ft', 'y_ft')} FROM centroids", "centroids")
    q["zone_lonlat"] = _with(
        _lonlat_query("listed_centroids", f"LocationID, {_r('x_ft', 'y_ft')}", "x_ft", "y_ft"), "listed_centroids")
    q["zone_outline_lonlat"] = _with(
        _lonlat_query("vertices", f"LocationID, part, ring, seq, {_r('x', 'y')}", "x", "y"), "vertices")
    q["centroid_distance"] = _with(
        f"""SELECT trip_id, PULocationID, DOLocationID,
        {_r('coalesce(sqrt(pow(a.x_ft - b.x_ft, 2) + pow(a.y_ft - b.y_ft, 2)), 0) / 5280 AS distance_miles')}
        FROM trips LEFT JOIN listed_centroids a ON a.LocationID = PULocationID
        LEFT JOIN listed_centroids b ON b.LocationID = DOLocationID""", "trips", "listed_centroids")

    # scheduled events
    q["game_windows"] = _with(
        "SELECT Date, start_time, Visitor, game_datetime, window_start, window_end FROM windows", "windows")
    q["stadium_trips"] = _with(
        f"SELECT trip_id, PULocationID, DOLocationID FROM trips WHERE {at_stadium}", "trips")
    q["asof_game"] = q["asof_game_bucketed"] = _with("SELECT * FROM matched", "matched")
    q["asof_game_by_zone"] = _with(
        """SELECT trip_id, pickup_datetime, t.DOLocationID, window_start, game_datetime, window_end
        FROM trips t ASOF LEFT JOIN zone_windows w
          ON t.DOLocationID = w.DOLocationID AND t.pickup_datetime >= w.window_start""", "trips",
        extra=f"""zone_windows AS (
          SELECT *, game_datetime - INTERVAL 2 HOUR AS window_start, game_datetime + INTERVAL 2 HOUR AS window_end FROM (
            SELECT DOLocationID, {fixture.ZONE_GAME.format(ntz='TIMESTAMP')} AS game_datetime FROM (
              SELECT DOLocationID, CAST(pickup_datetime AS DATE) AS d, COUNT(*) AS n FROM trips
              WHERE pickup_datetime IS NOT NULL AND DOLocationID IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) % 3 = 0)))""")
    q["game_flags"] = _with("SELECT trip_id, game_datetime, during_game, is_game_day FROM flagged", "flagged")
    q["valid_stadium_trips"] = _with(
        f"SELECT trip_id, {_r('duration_hours', 'distance_miles', 'speed_mph')}, route, direction FROM valid", "valid")
    q["game_vs_nongame"] = _with(f"SELECT trip_id, side, route, {_r('duration_hours')} FROM sides", "sides")
    tests = """ROUND(w.statistic, 4) AS t_statistic, ROUND(w.p_value, 4) AS p_value_t,
        ROUND(m.statistic, 4) AS mw_statistic, ROUND(m.p_value, 4) AS p_value_mw"""
    q["duration_tests"] = _with(f"SELECT {tests} FROM welch_games w, mw_games m", "welch_games", "mw_games")
    q["route_game_pivot"] = _with(
        f"SELECT route, {_r('non_game_time', 'game_time', 'game_time - non_game_time AS time_difference')} FROM route_pivot", "route_pivot")
    q["game_top_routes"] = _with(
        f"""SELECT route, trips, {_r('non_game_time', 'game_time', 'game_time - non_game_time AS time_difference')}
        FROM route_pivot JOIN (SELECT route, COUNT(*) AS trips FROM valid GROUP BY route ORDER BY trips DESC, route LIMIT 5)
        USING (route)""", "route_pivot", "valid")
    q["game_impact"] = _with(
        f"""SELECT ROUND(g, 2) AS game_time_mean_minutes, ROUND(o, 2) AS non_game_time_mean_minutes,
        ROUND(g - o, 2) AS time_difference_minutes,
        CASE WHEN o > 0 THEN ROUND((g - o) / o * 100, 2) ELSE 0 END AS percent_time_change,
        game_trip_count, non_game_trip_count, {tests}
        FROM (SELECT AVG(duration_hours) FILTER (side = 'game') * 60 AS g,
          AVG(duration_hours) FILTER (side = 'non_game') * 60 AS o, COUNT(*) FILTER (side = 'game') AS game_trip_count,
          COUNT(*) FILTER (side = 'non_game') AS non_game_trip_count FROM sides), welch_games w, mw_games m""",
        "sides", "welch_games", "mw_games")

    # hypothesis tests
    for name in ("anova", "levene"):
        q[f"{name}_by_hour"] = _with(
            f"SELECT {_r('statistic')}, df_between, df_within, {_r('p_value')}, {_VERDICT} FROM {name}_full", f"{name}_full")
    q["kruskal_by_hour"] = _with(
        f"SELECT {_r('statistic')}, df, n, {_r('p_value')}, {_VERDICT} FROM kruskal_full", "kruskal_full")
    q["mann_whitney_hours"] = _with(
        f"SELECT {_r('statistic')}, n1, n2, {_r('p_value')}, {_VERDICT}, 'asymptotic' AS method FROM mw_hours", "mw_hours")
    q["spearman_time_distance"] = _with(
        f"SELECT {_r('rho')}, n, {_r('statistic', 'p_value')}, {_VERDICT}, {_LABELS} FROM spearman_full", "spearman_full")
    q["tukey_q_by_hour"] = _with(
        f"""SELECT a.hour AS group1, b.hour AS group2, {_r('b.mean - a.mean AS mean_difference',
        'abs(b.mean - a.mean) / sqrt(mse / 2 * (1.0 / a.n + 1.0 / b.n)) AS q')}
        FROM groups a JOIN groups b ON a.hour < b.hour, anova_row""", "groups", "anova_row")
    # All ways to pick eight of sixteen ranks, as the set bits of a number.
    q["mann_whitney_small"] = _with(
        f"""SELECT {_r('statistic')}, n1, n2, {_r('p_value')}, {_VERDICT}, method FROM (
          SELECT statistic, n1, n2, CASE WHEN tied = 0 THEN 'exact' ELSE 'asymptotic' END AS method,
            LEAST(1, CASE WHEN tied = 0 THEN 2 * (SELECT COUNT(*) FILTER (u <= LEAST(statistic, 64 - statistic)) / 12870.0
              FROM (SELECT list_sum([((n >> i) & 1) * (i + 1) for i in range(16)]) - 36 AS u
                FROM range(65536) t(n) WHERE bit_count(n) = 8)) ELSE 1 - 2 * area END) AS p_value
          FROM few_row JOIN ({_area('normal', 'few_row', 'id', 'z')}) ON area_key = id,
            (SELECT 16 - COUNT(DISTINCT journey_time) AS tied FROM few))""", "journeys",
        extra=f"""few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY {_DRAW}) AS place
            FROM journeys WHERE hour IN (3, 8)) WHERE place <= 8),
          few_row AS ({_mann_whitney('few', 'journey_time', 'hour', '8', '3')})""")
    q["tukey_hsd_by_hour"] = _with(
        f"""SELECT group1, group2, {_r('mean_difference', 'q', 'greatest(p_adjusted, 0) AS p_adjusted')}, p_adjusted < 0.05 AS reject
        FROM pairs_of_hours JOIN tails USING (group1, group2)""",
        "pairs_of_hours", extra=_range_tail("pairs_of_hours", "q", "k", "df_within"))
    q["ols_by_hour"] = _with(
        f"SELECT hour, n, {_r('slope', 'r_squared', 't_value', '1 - 2 * area AS p_value')} FROM fits"
        f" LEFT JOIN ({_area('t', 'fits', 'hour', 'abs(t_value)', 'n - 2')}) ON area_key = hour", "fits")
    q["welch_t"] = _with(
        f"SELECT {_r('statistic', 'df')}, n1, n2, {_r('mean1', 'mean2', 'p_value')}, {_VERDICT} FROM welch_hours", "welch_hours")
    for name in ("all", "route"):
        q[f"shapiro_{name}"] = _with(
            f"SELECT {_r('statistic')}, n, {_r('p_value')}, {_VERDICT} FROM shapiro_{name}", f"shapiro_{name}")
    q["verdict_labels"] = _with(
        f"""SELECT 'spearman' AS test, {_VERDICT}, {_LABELS} FROM spearman_full
        UNION ALL SELECT 'anova', {_VERDICT}, NULL, NULL FROM anova_full
        UNION ALL SELECT 'kruskal', {_VERDICT}, NULL, NULL FROM kruskal_full""",
        "spearman_full", "anova_full", "kruskal_full")

    # anonymity
    q["k_of"] = _with(f"SELECT MIN(n) AS k FROM (SELECT COUNT(*) AS n FROM coarse GROUP BY {_QI})", "coarse")
    q["k_anonymise"] = _with(f"SELECT trip_id, {_QI_SMALL} FROM kept", "coarse", extra=_released(2, 99, _QI_SMALL))
    q["k_report"] = _with(_report(2, 99, _QI_SMALL), "coarse")
    q["k_report_strict"] = _with(_report(2, 1, _QI).replace("coarse", "dense"), "dense")
    q["k_report_full_qi"] = _with(_report(2, 99, _QI, FILE).replace("coarse", "dense"), "dense")
    q["k_anonymise_monthly"] = _with(
        f"SELECT trip_id, {FILE}, {_QI_SMALL} FROM kept", "coarse", extra=_released(2, 99, _QI_SMALL, FILE))
    q["k_anonymise_full_qi"] = _with(
        f"SELECT trip_id, {_QI} FROM kept", "dense", extra=_released(3, 99, _QI, FILE).replace("coarse", "dense"))
    tried = " UNION ALL ".join(
        f"""SELECT {FILE}, {p + d} AS total, {p} AS p, {d} AS d, SUM(n) AS all_rows,
          100.0 * COALESCE(SUM(n) FILTER (n < 2), 0) / SUM(n) AS dropped FROM (
            SELECT {FILE}, COUNT(*) AS n FROM timed GROUP BY {FILE}, PULocationID, DOLocationID,
              {_LEVEL[p].format('pickup_datetime')}, {_LEVEL[d].format('dropoff_datetime')}) GROUP BY {FILE}"""
        for p in range(3) for d in range(3)
    )
    q["k_finest_levels"] = _with(
        f"""SELECT {FILE}, ['full', 'minute', 'hour'][p + 1] AS pickup_level, ['full', 'minute', 'hour'][d + 1] AS dropoff_level,
          "rows", {_r('dropped AS dropped_pct')}
        FROM (SELECT {FILE}, COUNT(*) AS "rows" FROM timed GROUP BY {FILE}) LEFT JOIN (
          SELECT * FROM ({tried}) WHERE dropped <= 5
          QUALIFY row_number() OVER (PARTITION BY {FILE} ORDER BY total, p) = 1) USING ({FILE})""", "timed")
    q["k_release_files"] = _with(
        f"SELECT {FILE}, trip_id, {_QI} FROM kept", "dense",
        extra=_released(3, 99, _QI, FILE).replace("coarse", "dense"))
    q["equivalence_class_sizes"] = _with(
        f"""SELECT n AS class_size, COUNT(*) AS classes FROM (SELECT COUNT(*) AS n FROM coarse GROUP BY {_QI_SMALL})
        GROUP BY n""", "coarse")
    return q
