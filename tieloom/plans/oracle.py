"""The queries as plain SQL over the same tables, in their textbook form.

Where the Spark query avoids writing out pairs or paths, the SQL here writes them out, so the
two reach the same numbers by different ways.
"""

from __future__ import annotations

from tieloom.plans import catalogue as c
from tieloom.plans import model_suite, part_network as pn
from tieloom.operators.predictions import CORNERS, ONE_AT_A_TIME, Z_95


def r(expression: str, places: int = 8) -> str:
    """Round in decimal, away from zero at ties, and return a double."""
    return f"CAST(round(CAST({expression} AS DECIMAL(28,10)), {places}) AS DOUBLE)"


def sig(expression: str, digits: int = 6) -> str:
    """Round to significant digits."""
    return f"CAST(printf('%.{digits - 1}e', {expression}) AS DOUBLE)"


def p_value(z: str) -> str:
    """Two-sided normal tail, by Simpson's rule on the density from 0 to |z|."""
    n, step = 400, f"(least(abs({z}), 10e0) / 400)"
    weights = f"CASE WHEN k IN (0, {n}) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    area = f"list_sum(list_transform(range({n + 1}), lambda k: ({weights}) * exp(-(k * {step}) * (k * {step}) / 2)))"
    return f"greatest(1 - 2 / sqrt(2 * pi()) * {step} / 3 * {area}, 0)"


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _subject(word: str) -> str:
    cases = " ".join(f"WHEN {word} IN {_in(w)} THEN '{s}'" for s, w in pn.SUBJECT_WORDS.items())
    return f"CASE {cases} END"


YEARS = pn.BASELINE + pn.OUTCOME

NETWORK = f"""
ln AS MATERIALIZED (
  SELECT l_partkey AS id, l_orderkey AS ok, l_quantity AS q, year(o_orderdate) AS y
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
pub AS MATERIALIZED (SELECT DISTINCT id, ok, y FROM ln),
edges AS MATERIALIZED (
  SELECT a.id AS src, b.id AS dst, count(*) AS weight
  FROM pub a JOIN pub b ON a.ok = b.ok AND a.id < b.id
  WHERE a.y <= {pn.END_YEAR} GROUP BY 1, 2),
bi AS MATERIALIZED (
  SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges),
deg AS MATERIALIZED (SELECT src AS id, count(*) AS degree, sum(weight) AS strength FROM bi GROUP BY 1),
reg AS (SELECT n_nationkey AS k, r_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey),
parts AS (
  SELECT p_partkey AS id, p_size, p_type, ra.name AS ca, rb.name AS cb,
    {_subject("split_part(p_name, ' ', 1)")} AS sa, {_subject("split_part(p_name, ' ', 2)")} AS sb
  FROM part JOIN reg ra ON ra.k = p_partkey % 25 JOIN reg rb ON rb.k = p_size % 25),
vertices AS MATERIALIZED (
  SELECT id, p_size <= 5 AS is_focal,
    CASE WHEN p_type IN {_in(pn.FEMALE_TYPES)} THEN 'female' WHEN p_type IN {_in(pn.MALE_TYPES)} THEN 'male'
         WHEN p_type IN {_in(pn.UNKNOWN_TYPES)} THEN 'unknown' END AS category,
    CASE WHEN id % 13 = 0 THEN NULL ELSE 1940 + p_size + id % 7 END AS first_pub_year,
    coalesce(n, 0) AS pub_count,
    CASE WHEN sa = sb THEN [sa] ELSE [sa, sb] END AS subject_areas,
    CASE WHEN p_size = 49 THEN NULL WHEN p_size = 50 THEN CAST([] AS VARCHAR[])
         WHEN ca = cb THEN [ca] ELSE [ca, cb] END AS countries,
    list_filter(CASE WHEN p_size = 49 THEN NULL WHEN p_size = 50 THEN CAST([] AS VARCHAR[])
         WHEN ca = cb THEN [ca] ELSE [ca, cb] END, lambda v: v <> 'EUROPE') AS countries_wo_eu
  FROM parts LEFT JOIN (SELECT id AS pid, count(*) AS n FROM pub WHERE y <= {pn.END_YEAR} GROUP BY 1) ON pid = id),
focals AS MATERIALIZED (SELECT * FROM vertices WHERE is_focal),
ft AS MATERIALIZED (
  SELECT b.src AS id, b.dst AS q, b.weight, f.category AS own, v.category, v.first_pub_year, v.pub_count
  FROM bi b JOIN focals f ON f.id = b.src JOIN vertices v ON v.id = b.dst)"""

MIX = """
mix AS MATERIALIZED (
  SELECT id, any_value(own) AS category, count(*) FILTER (category = 'male') AS n_male,
    count(*) FILTER (category = 'female') AS n_female, count(*) FILTER (category = 'unknown') AS n_unknown,
    count(*) FILTER (category IS NULL) AS n_missing, count(*) AS total_collabs
  FROM ft GROUP BY id)"""

SHARES = f"""
{r("n_male / total_collabs", 3)} * 100 AS pct_male_first_order,
{r("n_female / total_collabs", 3)} * 100 AS pct_female_first_order"""

HOMOPHILY = "CASE mix.category WHEN 'male' THEN n_male / total_collabs WHEN 'female' THEN n_female / total_collabs END"

MEANS = f"""
means AS (
  SELECT id, {r(f"avg({pn.END_YEAR} - first_pub_year)", 2)} AS mean_collab_tenure,
    {r("avg(pub_count)", 2)} AS mean_collab_pub_count
  FROM ft GROUP BY id)"""

SECOND = """
second AS MATERIALIZED (
  SELECT p.id, avg(d.degree) AS m FROM (
    SELECT DISTINCT e.src AS id, n.dst AS b
    FROM bi e JOIN focals f ON f.id = e.src JOIN bi n ON n.src = e.dst AND n.dst <> e.src) p
  JOIN deg d ON d.id = p.b GROUP BY p.id)"""


def _reach(column: str, mode: str) -> str:
    same = f"list_has_any(a.{column}, b.{column})" if mode == "overlap" else f"a.{column} = b.{column}"
    return f"""SELECT e.src AS id, 1 - sum(CASE WHEN {same} THEN 1 ELSE 0 END) / count(*) AS reach
      FROM bi e JOIN vertices a ON a.id = e.src JOIN vertices b ON b.id = e.dst
      WHERE len(a.{column}) > 0 AND len(b.{column}) > 0 GROUP BY 1"""


def _as_list(column: str, table: str) -> str:
    """The values of an attribute as a list of text, empty where there are none."""
    text = f"CAST({table}.{column} AS VARCHAR{'[]' if column == 'countries' else ''})"
    return f"coalesce({text if column == 'countries' else f'CASE WHEN {text} IS NULL THEN [] ELSE [{text}] END'}, CAST([] AS VARCHAR[]))"


OPEN_MIX = (
    "known AS (SELECT id, count(*) AS total FROM ft GROUP BY 1),\ncounted AS ("
    + " UNION ALL ".join(
        f"""SELECT e.src AS id, '{x}' AS attribute, value, count(*) AS n
      FROM bi e JOIN focals f ON f.id = e.src
      JOIN (SELECT v.id, unnest(CASE WHEN len({_as_list(x, "v")}) = 0 THEN [NULL] ELSE {_as_list(x, "v")} END) AS value FROM vertices v) u ON u.id = e.dst
      GROUP BY 1, 2, 3"""
        for x in c.OPEN_ATTRIBUTES
    )
    + ")"
)


# Open pairs in the textbook form: all neighbour pairs less those with an edge.
TRIADS = f"""
pairs AS (
  SELECT a.src AS id, a.dst AS x, b.dst AS y FROM bi a JOIN focals f ON f.id = a.src
  JOIN bi b ON b.src = a.src AND a.dst < b.dst),
opened AS MATERIALIZED (
  SELECT id, count(*) AS n_open FROM pairs p
  WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = p.x AND e.dst = p.y) GROUP BY 1),
brok AS MATERIALIZED (
  SELECT f.id, coalesce(n_open, 0) AS open_triads_count,
    CASE WHEN n_open IS NULL THEN 0.0 ELSE {r("2 * n_open / (degree * (degree - 1))", 2)} END AS open_triads_per_neighbor
  FROM focals f LEFT JOIN deg d ON d.id = f.id LEFT JOIN opened o ON o.id = f.id),
p AS MATERIALIZED (SELECT b.src, b.dst, weight / strength AS p FROM bi b JOIN deg d ON d.id = b.src),
reached AS (
  SELECT src AS ego, dst AS alter, p FROM p WHERE src IN (SELECT id FROM focals)
  UNION ALL
  SELECT e1.src, e2.dst, e1.p * e2.p FROM p e1 JOIN p e2 ON e2.src = e1.dst AND e2.dst <> e1.src
  WHERE e1.src IN (SELECT id FROM focals)),
cons AS MATERIALIZED (
  SELECT ego AS id, {r("sum(t * t)", 4)} AS overall_constraint FROM (
    SELECT ego, alter, sum(r.p) AS t FROM reached r JOIN p ON p.src = r.ego AND p.dst = r.alter GROUP BY 1, 2)
  GROUP BY 1)"""

YEARLY = f"""
yearly AS MATERIALIZED (
  SELECT id, {", ".join(f'CAST(sum(CASE WHEN y = {y} THEN 1 END) AS BIGINT) AS "{y}"' for y in YEARS)}
  FROM pub GROUP BY id)"""

_base = " + ".join(f'coalesce("{y}", 0)' for y in pn.BASELINE)
_weighted = " + ".join(f'coalesce("{y}", 0) * {y}' for y in pn.BASELINE)
_outcome = " + ".join(f'coalesce("{y}", 0)' for y in pn.OUTCOME)

YEAR_COLUMNS = f"""
{_outcome} AS outcome_output, {_base} AS baseline_output,
CASE WHEN {_base} > 0 THEN ({_weighted}) / ({_base}) - {pn.BASELINE[0]} END AS avg_year_diff"""

STATS = f"""
stats AS MATERIALIZED (
  SELECT d.id, degree, {SHARES}, mix.category, {HOMOPHILY} AS pct_homophilic_collabs,
    mean_collab_tenure, mean_collab_pub_count, second.m AS second_order_collab_mean_degree,
    ri.reach AS interdisciplinary_reach, rc.reach AS international_reach_with_eu,
    rn.reach AS international_reach_no_eu, {", ".join(f'"{y}"' for y in YEARS)}
  FROM deg d JOIN focals f ON f.id = d.id
  LEFT JOIN mix ON mix.id = d.id LEFT JOIN means ON means.id = d.id LEFT JOIN second ON second.id = d.id
  LEFT JOIN ({_reach("subject_areas", "overlap")}) ri ON ri.id = d.id
  LEFT JOIN ({_reach("countries", "exact")}) rc ON rc.id = d.id
  LEFT JOIN ({_reach("countries_wo_eu", "exact")}) rn ON rn.id = d.id
  LEFT JOIN yearly ON yearly.id = d.id)"""

ANALYSIS = f"""
rate AS (SELECT id, avg(q) AS rate_outcome FROM ln WHERE y IN ({", ".join(map(str, pn.OUTCOME))}) GROUP BY 1),
analysis AS MATERIALIZED (
  SELECT * FROM (
    SELECT s.id, degree, s.category, {pn.END_YEAR} - first_pub_year AS years_from_first_pub, interdisciplinary_reach,
      rate_outcome, {YEAR_COLUMNS}, open_triads_count AS brokerage,
      open_triads_per_neighbor AS normalized_brokerage, overall_constraint AS "constraint",
      pct_homophilic_collabs AS homophily, pct_homophilic_collabs AS normalized_homophily,
      f.countries AS countries_focal, f.subject_areas AS subjects_focal
    FROM stats s JOIN focals f ON f.id = s.id JOIN rate ON rate.id = s.id
    JOIN brok ON brok.id = s.id JOIN cons ON cons.id = s.id))"""

ALL = ",".join([NETWORK, MIX, MEANS, SECOND, TRIADS, YEARLY, STATS, ANALYSIS])

WOMEN = "CASE WHEN category = 'female' THEN 1 ELSE 0 END AS women"
_places = [(v, "country", "countries_focal", "country") for v in pn.REGIONS if v != pn.REFERENCE_REGION] + [
    (v, "subject", "subjects_focal", "subject") for v in pn.SUBJECTS if v != pn.REFERENCE_SUBJECT
]
MULTIHOT = f"""
design AS MATERIALIZED (
  SELECT *, {WOMEN},
    {", ".join(f"CAST(list_contains({a}, '{v}') AS INTEGER) AS " + f'"{p}_{v}"' for v, p, a, _ in _places)}
  FROM analysis)"""
EXPLODED = f"""
units AS (SELECT *, unnest(countries_focal) AS country FROM analysis),
crossed AS (SELECT *, unnest(subjects_focal) AS subject FROM units),
design AS MATERIALIZED (
  SELECT *, {WOMEN},
    {", ".join(f"CASE WHEN {x} = '{v}' THEN 1 ELSE 0 END AS " + f'"{p}_{v}"' for v, p, _, x in _places)}
  FROM crossed)"""

INTEGERS = {"women", "degree", "years_from_first_pub", "baseline_output", "brokerage", "outcome_output"} | {
    f"{p}_{v}" for v, p, _, _ in _places
}


def q(column: str) -> str:
    return f'"{column}"'


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes.lstrip()}\n{body}"


def _value(column: str, places: int = 8) -> str:
    """A design column as the queries report it: integers as they are, doubles rounded."""
    return f"CAST({q(column)} AS BIGINT) AS {q(column)}" if column in INTEGERS else f"{r(q(column), places)} AS {q(column)}"


def _text(column: str) -> str:
    return f"array_to_string({column}, '|')"


STATISTIC = {"mean": "avg", "min": "min", "max": "max", "stddev": "stddev_samp"}


def _long_stats(table: str, columns: list[str], key: str | None = None, places: int = 6) -> str:
    group = f"GROUP BY {key}" if key else ""
    lead = f"{key}, " if key else ""
    return " UNION ALL ".join(
        f"SELECT {lead}'{x}' AS metric, "
        + ", ".join(f"{r(f'{f}(CAST({q(x)} AS DOUBLE))', places)} AS {s}" for s, f in STATISTIC.items())
        + f", {r(f'quantile_cont(CAST({q(x)} AS DOUBLE), 0.5)', places)} AS median FROM {table} {group}"
        for x in columns
    )


# --- two-parameter fit, unrolled -----------------------------------------------------------

IRLS_STEPS = 20


def _two_param() -> str:
    """Chained common tables: reweighted least squares for the outcome on the degree."""
    ctes = [
        "d AS MATERIALIZED (SELECT CAST(outcome_output AS DOUBLE) AS y, CAST(degree AS DOUBLE) AS x FROM design)"
    ]
    mean = "(y + (SELECT avg(y) FROM d)) / 2"
    for k in range(IRLS_STEPS):
        source = "d" if k == 0 else f"d, b{k - 1}"
        if k > 0:
            mean = "exp(b0 + b1 * x)"
        ctes.append(
            f"""b{k} AS MATERIALIZED (
  SELECT (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) AS b0, (s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1) AS b1 FROM (
    SELECT sum(w) AS s0, sum(w * x) AS s1, sum(w * x * x) AS s2, sum(w * z) AS t0, sum(w * x * z) AS t1 FROM (
      SELECT x, mu / (1 + mu) AS w, ln(mu) + (y - mu) / mu AS z FROM (SELECT x, y, {mean} AS mu FROM {source}))))"""
        )
    ctes.append(
        f"""fit AS MATERIALIZED (
  SELECT b0, b1, ll, (i11 * i11 * m00 - 2 * i01 * i11 * m01 + i01 * i01 * m11) / (det * det) AS v00,
    (i01 * i01 * m00 - 2 * i00 * i01 * m01 + i00 * i00 * m11) / (det * det) AS v11,
    (-i11 * i01 * m00 + (i00 * i11 + i01 * i01) * m01 - i01 * i00 * m11) / (det * det) AS v01
  FROM (SELECT *, i00 * i11 - i01 * i01 AS det FROM (
    SELECT b0, b1, sum(a) AS i00, sum(a * x) AS i01, sum(a * x * x) AS i11, sum(s * s) AS m00,
      sum(s * s * x) AS m01, sum(s * s * x * x) AS m11, sum(y * ln(mu / (1 + mu)) - ln(1 + mu)) AS ll
    FROM (SELECT x, y, mu, b0, b1, mu * (1 + y) / ((1 + mu) * (1 + mu)) AS a, (y - mu) / (1 + mu) AS s
          FROM (SELECT x, y, b0, b1, exp(b0 + b1 * x) AS mu FROM d, b{IRLS_STEPS - 1}))
    GROUP BY b0, b1)))"""
    )
    return ",\n".join(ctes)


def _coefficient_rows(source: str) -> str:
    def row(position: int, name: str, b: str, v: str) -> str:
        return (
            f"SELECT {position} AS position, '{name}' AS variable, {r(b, 6)} AS coefficient, {sig(f'exp({b})')} AS irr, "
            f"{r(f'sqrt({v})', 6)} AS std_error, {r(f'({b}) / sqrt({v})', 6)} AS z, "
            f"{r(p_value(f'({b}) / sqrt({v})'), 6)} AS p_value FROM {source}"
        )

    first = (
        f"SELECT 0 AS position, 'Log-Likelihood' AS variable, {r('ll', 6)} AS coefficient, "
        f"NULL AS irr, NULL AS std_error, NULL AS z, NULL AS p_value FROM {source}"
    )
    return " UNION ALL ".join([first, row(1, "Intercept", "b0", "v00"), row(2, "{slope}", "b1", "v11")])


# --- any number of models, with the matrices as tables --------------------------------------

NEWTON_STEPS = 9
RIGHT = 1000  # column of the right-hand side; the identity columns follow it


def _eliminate(start: str, size: int, name: str) -> list[str]:
    """Gauss-Jordan elimination of all models' matrices, one common table per pivot."""
    ctes, source = [], start
    for k in range(size):
        ctes.append(
            f"""{name}{k} AS MATERIALIZED (
  SELECT m.model, m.i, m.j, CASE WHEN d.v IS NULL THEN m.v WHEN m.i = {k} THEN m.v / d.v
    ELSE m.v - coalesce(c.v, 0) * coalesce(p.v, 0) / d.v END AS v
  FROM {source} m LEFT JOIN {source} d ON d.model = m.model AND d.i = {k} AND d.j = {k}
  LEFT JOIN {source} c ON c.model = m.model AND c.i = m.i AND c.j = {k}
  LEFT JOIN {source} p ON p.model = m.model AND p.i = {k} AND p.j = m.j)"""
        )
        source = f"{name}{k}"
    return ctes


def _newton(models, expected: bool = False) -> str:
    """Newton's method for several models at once, unrolled into common tables.

    ``est`` holds the estimates, ``ll`` the log-likelihoods and ``se`` the robust standard errors;
    with ``expected``, ``plain`` holds the estimates with those of the expected information alone.
    """
    terms = []
    for model in models:
        for j, t in enumerate(["one", *model.terms]):
            a, b = (t, "one") if isinstance(t, str) else t
            terms.append(f"('{model.name}', {j}, '{a}', '{b}')")
    columns = list(dict.fromkeys(x for model in models for x in model.columns[1:]))
    size = max(len(m.parameters) for m in models)
    ctes = [
        f"""u AS MATERIALIZED (SELECT row_number() OVER () AS rid, CAST({models[0].outcome} AS DOUBLE) AS y, 1e0 AS one,
    {", ".join(f"CAST({q(x)} AS DOUBLE) AS {q(x)}" for x in columns)} FROM design)""",
        f"base AS MATERIALIZED (UNPIVOT u ON one, {', '.join(q(x) for x in columns)} INTO NAME c VALUE x)",
        f"terms(model, j, a, b) AS (VALUES {', '.join(terms)})",
        """x0 AS MATERIALIZED (SELECT model, t.j, p.rid, p.x * o.x AS x
    FROM terms t JOIN base p ON p.c = t.a JOIN base o ON o.c = t.b AND o.rid = p.rid)""",
        """rows_ok AS (SELECT model, rid FROM x0 GROUP BY model, rid
    HAVING count(*) = (SELECT count(*) FROM terms t WHERE t.model = x0.model))""",
        "xs AS MATERIALIZED (SELECT x0.* FROM x0 JOIN rows_ok USING (model, rid))",
        """nb0 AS MATERIALIZED (SELECT t.model, t.j, CASE WHEN t.j = 0 THEN ln(m) ELSE 0e0 END AS b FROM terms t JOIN (
    SELECT model, avg(y) AS m FROM rows_ok JOIN u USING (rid) GROUP BY model) USING (model))""",
    ]

    def at(k: int) -> str:
        return f"""e{k} AS MATERIALIZED (SELECT model, rid, y, mu, (y - mu) / (1 + mu) AS s, mu * (1 + y) / ((1 + mu) * (1 + mu)) AS a
    FROM (SELECT xs.model, xs.rid, any_value(u.y) AS y, exp(sum(xs.x * nb{k}.b)) AS mu FROM xs
      JOIN nb{k} ON nb{k}.model = xs.model AND nb{k}.j = xs.j JOIN u ON u.rid = xs.rid GROUP BY xs.model, xs.rid)),
  h{k} AS MATERIALIZED (SELECT l.model, l.j AS i, r.j AS j, sum(e.a * l.x * r.x) AS v
    FROM xs l JOIN xs r ON r.model = l.model AND r.rid = l.rid JOIN e{k} e ON e.model = l.model AND e.rid = l.rid
    GROUP BY l.model, l.j, r.j)"""

    for k in range(NEWTON_STEPS):
        ctes.append(at(k))
        ctes.append(
            f"""m{k}_ AS MATERIALIZED (SELECT * FROM h{k} UNION ALL SELECT l.model, l.j, {RIGHT}, sum(e.s * l.x)
    FROM xs l JOIN e{k} e ON e.model = l.model AND e.rid = l.rid GROUP BY l.model, l.j)"""
        )
        ctes += _eliminate(f"m{k}_", size, f"m{k}_")
        ctes.append(
            f"""nb{k + 1} AS MATERIALIZED (SELECT o.model, o.j, o.b + s.v AS b FROM nb{k} o
    JOIN m{k}_{size - 1} s ON s.model = o.model AND s.i = o.j AND s.j = {RIGHT})"""
        )
    last = NEWTON_STEPS
    ctes.append(at(last))
    ctes.append(
        f"""hx AS MATERIALIZED (SELECT l.model, l.j AS i, r.j AS j, sum(e.mu / (1 + e.mu) * l.x * r.x) AS v
    FROM xs l JOIN xs r ON r.model = l.model AND r.rid = l.rid JOIN e{last} e ON e.model = l.model AND e.rid = l.rid
    GROUP BY l.model, l.j, r.j),
  inv_ AS MATERIALIZED (SELECT * FROM {"hx" if expected else f"h{last}"} UNION ALL
    SELECT l.model, l.j, {RIGHT} + o.j, CASE WHEN l.j = o.j THEN 1e0 ELSE 0e0 END FROM terms l JOIN terms o ON o.model = l.model)"""
    )
    ctes += _eliminate("inv_", size, "inv_")
    ctes.append(
        f"""inverse AS MATERIALIZED (SELECT model, i, j - {RIGHT} AS j, v FROM inv_{size - 1} WHERE j >= {RIGHT}),
  meat AS MATERIALIZED (SELECT l.model, l.j AS i, r.j AS j, sum(e.s * e.s * l.x * r.x) AS v
    FROM xs l JOIN xs r ON r.model = l.model AND r.rid = l.rid JOIN e{last} e ON e.model = l.model AND e.rid = l.rid
    GROUP BY l.model, l.j, r.j),
  half AS MATERIALIZED (SELECT a.model, a.i, m.j, sum(a.v * m.v) AS v FROM inverse a
    JOIN meat m ON m.model = a.model AND m.i = a.j GROUP BY a.model, a.i, m.j),
  se AS MATERIALIZED (SELECT h.model, h.i AS j, sqrt(sum(h.v * a.v)) AS se FROM half h
    JOIN inverse a ON a.model = h.model AND a.i = h.j AND a.j = h.i GROUP BY h.model, h.i),
  ll AS (SELECT model, sum(y * ln(mu / (1 + mu)) - ln(1 + mu)) AS ll FROM e{last} GROUP BY model),
  plain AS (SELECT n.model, n.j, n.b, sqrt(a.v) AS se, n.b / sqrt(a.v) AS z FROM nb{last} n
    JOIN inverse a ON a.model = n.model AND a.i = n.j AND a.j = n.j),
  est AS MATERIALIZED (SELECT n.model, n.j, n.b, se.se, n.b / se.se AS z FROM nb{last} n JOIN se ON se.model = n.model AND se.j = n.j)"""
    )
    return ",\n".join(ctes)


def _full_model(outcome: str) -> str:
    model = model_suite.main_model(outcome, c.PLACES)
    names = ", ".join(f"({j}, '{name}')" for j, name in enumerate(model.parameters))
    return _with(
        _exploded + ",\n" + _newton([model]),
        f"""SELECT CAST(0 AS BIGINT) AS position, 'Log-Likelihood' AS variable, {r("ll", 4)} AS coefficient, NULL AS irr,
          NULL AS std_error, NULL AS z, NULL AS p_value FROM ll
        UNION ALL SELECT CAST(j + 1 AS BIGINT), name, {r("b", 4)}, {sig("exp(b)")}, {r("se", 4)}, {r("z", 4)}, {r(p_value("z"), 4)}
        FROM est JOIN (VALUES {names}) n(k, name) ON k = j""",
    )


def _all_products() -> str:
    model = model_suite.constraint_model("outcome_output", c.PLACES, "all")
    names = ", ".join(f"({j}, '{v}')" for j, v in enumerate(model.parameters))
    return _with(
        _multihot + ",\n" + _newton([model], expected=True),
        f"""SELECT CAST(0 AS BIGINT) AS position, 'Log-Likelihood' AS variable, {r("ll", 4)} AS coefficient, NULL AS irr,
          NULL AS std_error, NULL AS z, NULL AS p_value FROM ll
        UNION ALL SELECT CAST(j + 1 AS BIGINT), name, {r("b", 4)}, {sig("exp(b)")}, {r("se", 4)}, {r("z", 4)}, {r(p_value("z"), 4)}
        FROM plain JOIN (VALUES {names}) n(k, name) ON k = j""",
    )


def _interval_full() -> str:
    """Each grid row as one row per parameter; the variance is their quadratic form with the robust covariance."""
    model = model_suite.main_model("outcome_output", c.PLACES)
    values = ["1e0", *[q(t) if isinstance(t, str) else f"{q(t[0])} * {q(t[1])}" for t in model.terms]]
    grid = _unrounded({"women": "w.women", "normalized_brokerage": "k * 0.1e0"})
    cells = " UNION ALL ".join(f"SELECT women, normalized_brokerage, {j} AS j, {v} AS x FROM pg" for j, v in enumerate(values))
    ctes = [
        _multihot, _newton([model]), MOMENTS.lstrip(),
        f"pg AS (SELECT {grid} FROM m, range(10) t(k), (VALUES (1), (0)) w(women))",
        f"cells AS MATERIALIZED ({cells})",
        "cov AS MATERIALIZED (SELECT h.i, a.j, sum(h.v * a.v) AS v FROM half h JOIN inverse a ON a.i = h.j GROUP BY 1, 2)",
        "line AS (SELECT women, normalized_brokerage, sum(x * b) AS eta FROM cells JOIN est USING (j) GROUP BY 1, 2)",
        """spread AS (SELECT l.women, l.normalized_brokerage, sqrt(sum(l.x * r.x * cov.v)) AS se FROM cells l
          JOIN cells r ON r.women = l.women AND r.normalized_brokerage = l.normalized_brokerage
          JOIN cov ON cov.i = l.j AND cov.j = r.j GROUP BY 1, 2)""",
    ]
    bounds = {
        "link": (f"exp(eta - {Z_95}e0 * se)", f"exp(eta + {Z_95}e0 * se)"),
        "response": ("exp(eta) - 10e0 * exp(eta) * se", "exp(eta) + 10e0 * exp(eta) * se"),
    }
    return _with(
        ",\n".join(ctes),
        " UNION ALL ".join(
            f"""SELECT '{scale}' AS scale, CAST(women AS BIGINT) AS women, {r("normalized_brokerage", 4)} AS normalized_brokerage,
            {r("exp(eta)", 4)} AS predicted, {r("exp(eta) * se", 4)} AS std_error, {r(low, 4)} AS lower_bound, {r(high, 4)} AS upper_bound
            FROM line JOIN spread USING (women, normalized_brokerage)"""
            for scale, (low, high) in bounds.items()
        ),
    )


def _model_cov() -> str:
    models = [model_suite.constraint_model("outcome_output", c.PLACES, crossed) for crossed in ("none", "key")]
    names = ", ".join(f"('{m.name}', {j}, '{v}')" for m in models for j, v in enumerate(m.parameters))
    return _with(
        _multihot + ",\n" + _newton(models, expected=True),
        f"""SELECT CAST(0 AS BIGINT) AS position, 'Log-Likelihood' AS variable, {r("ll", 4)} AS coefficient, NULL AS irr,
          NULL AS std_error, NULL AS z, NULL AS p_value, model FROM ll
        UNION ALL SELECT CAST(p.j + 1 AS BIGINT), name, {r("b", 4)}, {sig("exp(b)")}, {r("se", 4)}, {r("z", 4)}, {r(p_value("z"), 4)}, p.model
        FROM plain p JOIN (VALUES {names}) n(model, k, name) ON n.model = p.model AND k = p.j""",
    )


def _full_predictions(grid: str, select: str) -> str:
    """The full model over a grid with all predictors: ``eta``, and ``main`` and ``product`` of the
    swept predictor."""
    model = model_suite.main_model("outcome_output", c.PLACES)
    values = ["1e0", *[q(t) if isinstance(t, str) else f"{q(t[0])} * {q(t[1])}" for t in model.terms]]
    b = ", ".join(f"max(b) FILTER (j = {j}) AS b{j}" for j in range(len(values)))
    main = model.parameters.index("normalized_brokerage")
    product = model.parameters.index("women:normalized_brokerage")
    return _with(
        ",\n".join([_multihot, _newton([model]), MOMENTS.lstrip(), f"coef AS (SELECT {b} FROM est)", f"pg AS ({grid})"]),
        f"SELECT {select} FROM (SELECT pg.*, b{main} AS main, b{product} AS product, "
        + " + ".join(f"b{j} * {v}" for j, v in enumerate(values)) + " AS eta FROM pg, coef)",
    )


def _unrounded(fixed: dict[str, str]) -> str:
    return ", ".join(f"{fixed.get(x, f'm.{q(x)}')} AS {q(x)}" for x in c.PREDICTORS)


def _scenario_predictions() -> str:
    values = ", ".join(f"({i + 1}, {a}, {b})" for i, (a, b) in enumerate(CORNERS))
    columns = _unrounded(
        {"women": "w.women", "normalized_brokerage": "m.normalized_brokerage + t.a * sd.nb", "constraint": 'm."constraint" + t.b * sd.co'}
    )
    return _full_predictions(
        f"SELECT t.s AS scenario, {columns} FROM m, sd, (VALUES {values}) t(s, a, b), (VALUES (1), (0)) w(women)",
        f"CAST(scenario AS BIGINT) AS scenario, CAST(women AS BIGINT) AS women, {r('exp(eta)', 4)} AS predicted",
    )


def _profile_predictions() -> str:
    return _full_predictions(
        f"SELECT {_unrounded({'women': 'w.women', 'normalized_brokerage': 'k * 0.1e0'})} FROM m, range(10) t(k), (VALUES (1), (0)) w(women)",
        f"""CAST(women AS BIGINT) AS women, {r("normalized_brokerage", 4)} AS normalized_brokerage, {r("eta", 4)} AS predicted_log,
        {r("exp(eta)", 4)} AS expected_value, {r("main * exp(eta)", 4)} AS marginal_effect,
        {r("(main + product * women) * exp(eta)", 4)} AS marginal_effect_total""",
    )


def _suite() -> str:
    models = model_suite.nested_models("outcome_output", c.PLACES)
    variables = list(dict.fromkeys(v for m in models for v in m.parameters))
    names = ", ".join(
        f"('{m.name}', {j}, '{v}', {variables.index(v)})" for m in models for j, v in enumerate(m.parameters)
    )
    cells = " UNION ALL ".join(
        f"SELECT 1 + 3 * k + {n} AS position, '{statistic}' AS statistic, variable, model, {value} AS v FROM named"
        for n, (statistic, value) in enumerate(
            [("Coefficient", r("b", 4)), ("IRR", sig("exp(b)")), ("P-value", r(p_value("z"), 4))]
        )
    )
    wide = ", ".join(f"max(v) FILTER (model = '{m.name}') AS {q(m.name)}" for m in models)
    return _with(
        _exploded + ",\n" + _newton(models)
        + f""",\nnamed AS MATERIALIZED (SELECT est.*, n.variable, n.k FROM est JOIN (VALUES {names}) n(model, j, variable, k)
          ON n.model = est.model AND n.j = est.j),
        cells AS (SELECT 0 AS position, 'Log-Likelihood' AS statistic, '' AS variable, model, {r("ll", 4)} AS v FROM ll UNION ALL {cells}
          UNION ALL SELECT {1 + 3 * len(variables)}, 'Converged', '', model, 1.0e0 FROM ll)""",
        f"SELECT CAST(position AS BIGINT) AS position, statistic, variable, {wide} FROM cells GROUP BY position, statistic, variable",
    )


DEGREE_GRID = """
ends AS (SELECT min(degree) AS lo, max(degree) AS hi FROM design),
grid AS (SELECT w.women, CAST(lo AS DOUBLE) + (CAST(hi AS DOUBLE) - CAST(lo AS DOUBLE)) * k / 99.0e0 AS degree
  FROM ends, range(100) t(k), (VALUES (1), (0)) w(women))"""

GROUP_MODEL = """
g AS (SELECT women, count(*) AS n, avg(CAST(outcome_output AS DOUBLE)) AS m FROM design GROUP BY 1),
s AS (SELECT d.women, sum((outcome_output - m) * (outcome_output - m)) AS ss,
    sum(outcome_output * ln(m / (1 + m)) - ln(1 + m)) AS ll
  FROM design d JOIN g ON g.women = d.women GROUP BY 1),
fits AS (SELECT ln(g0.m) AS b0, ln(g1.m / g0.m) AS b1, s0.ll + s1.ll AS ll,
    s0.ss / ((g0.n * g0.m) * (g0.n * g0.m)) AS r0, s1.ss / ((g1.n * g1.m) * (g1.n * g1.m)) AS r1,
    (1 + g0.m) / (g0.n * g0.m) AS e0, (1 + g1.m) / (g1.n * g1.m) AS e1
  FROM g g0, g g1, s s0, s s1 WHERE g0.women = 0 AND s0.women = 0 AND g1.women = 1 AND s1.women = 1),
robust AS (SELECT b0, b1, ll, r0 AS v00, r0 + r1 AS v11 FROM fits),
model AS (SELECT b0, b1, ll, e0 AS v00, e0 + e1 AS v11 FROM fits)"""


def _wide_mean(columns: list[str]) -> str:
    return ", ".join(f"avg(CAST({q(x)} AS DOUBLE)) AS {q(x)}" for x in columns)


def _held(columns: list[str], fixed: dict[str, str]) -> str:
    """Grid columns: the fixed ones by their expression, the others at their mean."""
    return ", ".join(
        (f"CAST({fixed[x]} AS BIGINT)" if x == "women" else r(fixed.get(x, f"m.{q(x)}"), 6)) + f" AS {q(x)}"
        for x in columns
    )


MOMENTS = f"""
m AS (SELECT {_wide_mean(c.PREDICTORS)} FROM design),
sd AS (SELECT stddev_samp(normalized_brokerage) AS nb, stddev_samp("constraint") AS co,
  min("constraint") AS co_lo, max("constraint") AS co_hi FROM design)"""


def _scenarios() -> str:
    parts = []
    for name, steps in (("corners", CORNERS), ("one_at_a_time", ONE_AT_A_TIME)):
        values = ", ".join(f"({i + 1}, {a}, {b})" for i, (a, b) in enumerate(steps))
        fixed = {
            "women": "w.women",
            "normalized_brokerage": "m.normalized_brokerage + t.a * sd.nb",
            "constraint": 'm."constraint" + t.b * sd.co',
        }
        parts.append(
            f"SELECT CAST(t.s AS BIGINT) AS scenario, '{name}' AS scenario_set, {_held(c.PREDICTORS, fixed)} "
            f"FROM m, sd, (VALUES {values}) t(s, a, b), (VALUES (1), (0)) w(women)"
        )
    return " UNION ALL ".join(parts)


def _histogram(column: str, stop: int, width: int) -> str:
    return f"""SELECT CAST(women AS BIGINT) AS women, '{column}' AS series, CAST(bin AS BIGINT) AS bin,
      CASE WHEN bin BETWEEN 0 AND {stop // width - 1} THEN CAST(bin * {width} AS DOUBLE) END AS bin_start, count(*) AS rows,
      CASE WHEN bin BETWEEN 0 AND {stop // width - 1} THEN
        {r(f"count(*) / (sum(CASE WHEN bin BETWEEN 0 AND {stop // width - 1} THEN count(*) END) OVER (PARTITION BY women) * {width})")} END AS density
    FROM (SELECT women, CASE WHEN {column} < 0 THEN -1 WHEN {column} > {stop} THEN {stop // width}
          ELSE least(floor({column} / {width}), {stop // width - 1}) END AS bin FROM design) GROUP BY women, bin"""


def _curve(column: str, x: str) -> str:
    return f"""SELECT CAST(women AS BIGINT) AS women, '{column}' AS series, k AS point, {r("pt", 6)} AS x,
      {r("sum(exp(-((pt - x) / h) * ((pt - x) / h) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi()))", 6)} AS density
    FROM (SELECT v.women, v.x, n, h, k, lo - 3 * h + k * (hi - lo + 6 * h) / 199 AS pt
      FROM (SELECT women, {x} AS x FROM design) v
      JOIN (SELECT women, count(*) AS n, stddev_samp({x}) * pow(count(*), -0.2) AS h, min({x}) AS lo, max({x}) AS hi
            FROM design GROUP BY women) b ON b.women = v.women, range(200) t(k))
    GROUP BY women, k, pt"""


def _grids() -> str:
    lo, hi = "CAST(lo AS DOUBLE)", "CAST(hi AS DOUBLE)"
    return f"""
SELECT 'arange' AS grid, k AS point, {r("k * 0.1e0", 6)} AS value FROM range(10) t(k)
UNION ALL SELECT 'linspace', k, {r(f"{lo} + ({hi} - {lo}) * k / 99.0e0", 6)} FROM ends, range(100) t(k)
UNION ALL SELECT 'logspace', k,
  {r(f"pow(10.0e0, log10({lo} + 1) + (log10({hi} + 1) - log10({lo} + 1)) * k / 99.0e0) - 1", 6)} FROM ends, range(100) t(k)"""


def _null_audit() -> str:
    columns = [
        "degree", "pct_male_first_order", "pct_female_first_order", "category", "pct_homophilic_collabs",
        "mean_collab_tenure", "mean_collab_pub_count", "second_order_collab_mean_degree",
        "interdisciplinary_reach", "international_reach_with_eu", "international_reach_no_eu",
        *map(str, YEARS),
    ]
    return " UNION ALL ".join(
        f"SELECT '{x}' AS \"column\", count(*) FILTER ({q(x)} IS NULL) AS missing FROM stats" for x in columns
    )


def _describe() -> str:
    order = ["mean", "median", "stddev", "min", "max"]
    long = _long_stats("stats", c.STATS_COLUMNS)
    picks = ", ".join(f"max({{s}}) FILTER (metric = '{x}') AS {q(x)}" for x in c.STATS_COLUMNS)
    return f"SELECT * FROM (WITH l AS ({long}) " + " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS position, '{s}' AS statistic, {picks.format(s=s)} FROM l" for i, s in enumerate(order)
    ) + ")"


def _transposed() -> str:
    long = _long_stats("analysis", c.SUMMARY_COLUMNS, "category")
    return f"SELECT * FROM (WITH l AS ({long}) " + " UNION ALL ".join(
        f"SELECT metric || '_{s}' AS metric, max({s}) FILTER (category = 'female') AS female, "
        f"max({s}) FILTER (category = 'male') AS male FROM l GROUP BY metric"
        for s in [*STATISTIC, "median"]
    ) + ")"


def _cohorts() -> str:
    parts = []
    for x in ("open_triads_count", "open_triads_per_neighbor"):
        v = f"CAST({x} AS DOUBLE)"
        parts.append(
            f"SELECT category, country, subject, '{x}' AS metric, {r(f'avg({v})', 6)} AS mean, {r(f'max({v})', 6)} AS max, "
            f"{r(f'min({v})', 6)} AS min, {r(f'stddev_samp({v})', 6)} AS std_dev, {r(f'quantile_cont({v}, 0.5)', 6)} AS median "
            "FROM placed GROUP BY 1, 2, 3"
        )
    return " UNION ALL ".join(parts)


PLACED = """
by_country AS (SELECT id, category, subject_areas, unnest(countries) AS country FROM focals WHERE category IN ('female', 'male')),
placed AS MATERIALIZED (
  SELECT p.*, brok.open_triads_count, brok.open_triads_per_neighbor
  FROM (SELECT id, category, country, unnest(subject_areas) AS subject FROM by_country) p JOIN brok ON brok.id = p.id)"""

GROUP_SUMMARY = ", ".join(
    f"{r(f'{f}(CAST({q(x)} AS DOUBLE))', 6)} AS {q(f'{x}_{s}')}" for s, f in STATISTIC.items() for x in c.SUMMARY_COLUMNS
)
ZERO_SHARE = (
    ", ".join(f"{r(f'avg({q(x)})', 6)} AS {q(f'avg_{x}')}" for x in ("normalized_brokerage", "brokerage", "constraint"))
    + f", {r('avg(CASE WHEN normalized_brokerage = 0 THEN 1 ELSE 0 END) * 100', 6)} AS pct_zero_normalized_brokerage"
)

_net_mix = NETWORK + "," + MIX
_net_triads = NETWORK + "," + TRIADS
# The network without its last year, and what that year adds.
UPDATED = f"""
new AS MATERIALIZED (
  SELECT DISTINCT a.id AS src, b.id AS dst FROM pub a JOIN pub b ON a.ok = b.ok AND a.id <> b.id WHERE a.y = {pn.END_YEAR}),
bi0 AS MATERIALIZED (
  SELECT DISTINCT a.id AS src, b.id AS dst FROM pub a JOIN pub b ON a.ok = b.ok AND a.id <> b.id WHERE a.y < {pn.END_YEAR}),
tri AS (
  SELECT a.src AS id, count(*) AS closed FROM bi a JOIN bi b ON b.src = a.src AND a.dst < b.dst
  JOIN bi e ON e.src = a.dst AND e.dst = b.dst GROUP BY 1),
tri0 AS (
  SELECT a.src AS id, count(*) AS closed FROM bi0 a JOIN bi0 b ON b.src = a.src AND a.dst < b.dst
  JOIN bi0 e ON e.src = a.dst AND e.dst = b.dst GROUP BY 1),
deg0 AS (SELECT src AS id, count(*) AS degree FROM bi0 GROUP BY 1)"""
_stats = ",".join([NETWORK, MIX, MEANS, SECOND, YEARLY, STATS])
_multihot = ALL + "," + MULTIHOT
_exploded = ALL + "," + EXPLODED
_two = _multihot + ",\n" + _two_param()
_grid = _two + "," + DEGREE_GRID

STATS_SELECT = f"""SELECT id, degree, {r("pct_male_first_order")} AS pct_male_first_order,
  {r("pct_female_first_order")} AS pct_female_first_order, category, {r("pct_homophilic_collabs")} AS pct_homophilic_collabs,
  mean_collab_tenure, mean_collab_pub_count, {r("second_order_collab_mean_degree")} AS second_order_collab_mean_degree,
  {r("interdisciplinary_reach")} AS interdisciplinary_reach, {r("international_reach_with_eu")} AS international_reach_with_eu,
  {r("international_reach_no_eu")} AS international_reach_no_eu, {", ".join(f'"{y}"' for y in YEARS)} FROM stats"""

ANALYSIS_SELECT = f"""SELECT id, degree, category, CAST(years_from_first_pub AS BIGINT) AS years_from_first_pub,
  {r("interdisciplinary_reach")} AS interdisciplinary_reach, {r("rate_outcome")} AS rate_outcome, baseline_output, outcome_output,
  brokerage, {r("normalized_brokerage")} AS normalized_brokerage, {r('"constraint"')} AS "constraint", {r("homophily")} AS homophily,
  {r("normalized_homophily")} AS normalized_homophily, {r("avg_year_diff")} AS avg_year_diff,
  {_text("countries_focal")} AS countries_focal, {_text("subjects_focal")} AS subjects_focal FROM analysis"""

ORACLE: dict[str, str] = {
    "cooccurrence_edges": _with(NETWORK, "SELECT src, dst, weight FROM edges"),
    "bidirectional": _with(NETWORK, "SELECT src, dst, weight FROM bi"),
    "focals": _with(
        NETWORK,
        f"SELECT id, category, CAST(first_pub_year AS BIGINT) AS first_pub_year, pub_count, {_text('subject_areas')} AS subject_areas, "
        f"{_text('countries')} AS countries, {_text('countries_wo_eu')} AS countries_wo_eu FROM focals",
    ),
    "degree": _with(NETWORK, "SELECT d.id, degree FROM deg d JOIN focals f ON f.id = d.id"),
    "degree_ranked": _with(
        NETWORK,
        f"SELECT d.id, degree FROM deg d JOIN focals f ON f.id = d.id WHERE degree > 0 ORDER BY degree, d.id",
    ),
    "attribute_mix": _with(
        _net_mix,
        f"SELECT id, n_male, n_female, n_unknown, n_missing, total_collabs, {r('pct_male_first_order')} AS pct_male_first_order, "
        f"{r('pct_female_first_order')} AS pct_female_first_order FROM (SELECT *, {SHARES} FROM mix)",
    ),
    "homophily": _with(_net_mix, f"SELECT id, category, {r(HOMOPHILY)} AS pct_homophilic_collabs FROM mix"),
    "value_mix": _with(NETWORK + "," + OPEN_MIX, f"SELECT id, attribute, value, n, {r('n / total')} AS share FROM counted JOIN known USING (id)"),
    "own_share": _with(
        NETWORK,
        " UNION ALL ".join(
            f"""SELECT id, '{x}' AS attribute, n_neighbours, n_same, {r("n_same / n_neighbours")} AS share FROM (
              SELECT e.src AS id, count(*) AS n_neighbours, CAST(sum(CASE WHEN len({a}) > 0 THEN CAST(list_has_any({a}, {b}) AS INTEGER) END) AS BIGINT) AS n_same
              FROM bi e JOIN focals f ON f.id = e.src JOIN vertices v ON v.id = e.dst GROUP BY 1)"""
            for x, a, b in ((x, _as_list(x, "f"), _as_list(x, "v")) for x in c.OPEN_ATTRIBUTES)
        ),
    ),
    "neighbor_means": _with(NETWORK + "," + MEANS, "SELECT * FROM means"),
    **{
        f"reach_{mode}": _with(
            NETWORK,
            " UNION ALL ".join(
                f"SELECT id, '{x}' AS attribute, {r('reach')} AS reach FROM ({_reach(x, mode)})"
                for x in ("subject_areas", "countries", "countries_wo_eu")
            ),
        )
        for mode in ("overlap", "exact")
    },
    "window_totals": _with(
        NETWORK,
        """SELECT DISTINCT src AS id, count(dst) OVER w AS total_collabs, CAST(sum(same) OVER w AS BIGINT) AS total_same_collabs
        FROM (SELECT e.src, e.dst, CASE WHEN list_has_any(a.countries, b.countries) THEN 1 ELSE 0 END AS same
          FROM bi e JOIN vertices a ON a.id = e.src JOIN vertices b ON b.id = e.dst WHERE len(a.countries) > 0 AND len(b.countries) > 0) WINDOW w AS (PARTITION BY src)""",
    ),
    "exploded_attributes": _with(
        NETWORK,
        " UNION ALL ".join(
            f"SELECT id, '{x}' AS attribute, unnest({x}) AS value FROM vertices"
            for x in ("subject_areas", "countries", "countries_wo_eu")
        ),
    ),
    "second_order_degree": _with(NETWORK + "," + SECOND, f"SELECT id, {r('m')} AS second_order_collab_mean_degree FROM second"),
    "second_order_paths": _with(
        NETWORK,
        "SELECT e.src AS id, count(*) AS paths FROM bi e JOIN focals f ON f.id = e.src JOIN bi n ON n.src = e.dst AND n.dst <> e.src GROUP BY 1",
    ),
    "two_paths": _with(
        _net_triads,
        f"""SELECT e1.src AS id, count(*) AS paths, {r("sum(e1.p * e2.p)")} AS indirect_strength
        FROM p e1 JOIN focals f ON f.id = e1.src JOIN p e2 ON e2.src = e1.dst AND e2.dst <> e1.src GROUP BY 1""",
    ),
    "neighbor_sets": _with(
        NETWORK,
        """SELECT id, len(s) AS n_neighbours
        FROM (SELECT src AS id, list(DISTINCT dst) AS s FROM bi JOIN focals f ON f.id = src GROUP BY 1)""",
    ),
    "neighbor_pairs": _with(_net_triads, "SELECT id, count(*) AS pairs FROM pairs GROUP BY 1"),
    "open_pairs": _with(_net_triads, "SELECT id, n_open AS open_pairs FROM opened"),
    "brokerage": _with(_net_triads, "SELECT * FROM brok"),
    "constraint": _with(_net_triads, "SELECT * FROM cons"),
    "triad_measures": _with(_net_triads, "SELECT brok.*, overall_constraint FROM brok LEFT JOIN cons ON cons.id = brok.id"),
    "ego_subgraph": _with(
        NETWORK,
        """, members AS (SELECT id FROM focals UNION SELECT q FROM ft),
        kept AS (SELECT DISTINCT src, dst, weight FROM (
          SELECT e.* FROM edges e JOIN members m ON m.id = e.src UNION ALL SELECT e.* FROM edges e JOIN members m ON m.id = e.dst))
        SELECT src, dst, weight FROM kept UNION ALL SELECT dst, src, weight FROM kept""",
    ),
    "focal_stats": _with(_stats, STATS_SELECT),
    "sink_roundtrip": _with(NETWORK, "SELECT d.id, degree FROM deg d JOIN focals f ON f.id = d.id"),
    "dedupe_by_key": _with(
        NETWORK,
        f"""SELECT id, ok AS context, y AS year FROM (
          SELECT *, row_number() OVER (PARTITION BY id ORDER BY ok) AS n FROM pub) WHERE n = 1""",
    ),
    "batch_assign": _with(
        NETWORK,
        f"""SELECT id, i AS "index", CAST(CASE WHEN size = 0 THEN {c.BROKERAGE_BATCHES - 1} ELSE least(i // size, {c.BROKERAGE_BATCHES - 1}) END AS BIGINT) AS batch
        FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () // {c.BROKERAGE_BATCHES} AS size FROM focals)""",
    ),
    "append_resume": _with(
        _net_triads,
        f"SELECT cons.* FROM cons JOIN deg ON deg.id = cons.id WHERE degree > 0",
    ),
    "brokerage_update": _with(
        _net_triads + "," + UPDATED,
        """SELECT brok.*, CAST(coalesce(deg.degree, 0) <> coalesce(deg0.degree, 0) OR coalesce(tri.closed, 0) <> coalesce(tri0.closed, 0) AS BIGINT) AS changed
        FROM brok LEFT JOIN deg USING (id) LEFT JOIN deg0 USING (id) LEFT JOIN tri USING (id) LEFT JOIN tri0 USING (id)""",
    ),
    "constraint_update": _with(
        _net_triads + "," + UPDATED,
        """SELECT cons.*, CAST(id IN (SELECT src FROM new) OR id IN (SELECT bi.dst FROM bi JOIN new ON new.src = bi.src) AS BIGINT) AS touched FROM cons""",
    ),
    "csv_roundtrip": _with(ALL, f"SELECT category, {ZERO_SHARE} FROM analysis GROUP BY category"),
    "cohort_filter": _with(
        NETWORK,
        "SELECT id, category FROM focals WHERE category = 'female' AND list_contains(countries, 'EUROPE') AND list_contains(subject_areas, 'S2')",
    ),
    "cohort_stats": _with(_net_triads + "," + PLACED, _cohorts()),
    "year_features": _with(
        NETWORK + "," + YEARLY,
        f"""SELECT id, outcome_output, baseline_output, {r("avg_year_diff")} AS avg_year_diff, CAST({pn.END_YEAR} - first_pub_year AS BIGINT) AS years_from_first_pub
        FROM (SELECT id, {YEAR_COLUMNS} FROM yearly) JOIN vertices USING (id)""",
    ),
    "analysis_table": _with(ALL, ANALYSIS_SELECT),
    "analysis_required": _with(
        ALL, ANALYSIS_SELECT + f" WHERE id IN (SELECT id FROM ({_reach('countries_wo_eu', 'exact')}))"
    ),
    "range_filter": _with(
        ALL,
        f"""SELECT id, degree, baseline_output, (SELECT count(*) FROM analysis WHERE degree > {c.MOST_DEGREE}) AS above_degree,
        (SELECT count(*) FROM analysis WHERE baseline_output <= {c.MORE_THAN}) AS below_output
        FROM analysis WHERE degree <= {c.MOST_DEGREE} AND baseline_output > {c.MORE_THAN}""",
    ),
    "null_audit": _with(_stats, _null_audit()),
    "multi_affiliation": _with(
        ALL,
        "SELECT id, len(countries_focal) AS n_countries, len(subjects_focal) AS n_subjects FROM analysis WHERE len(countries_focal) > 1 OR len(subjects_focal) > 1",
    ),
    "quadrant_share": _with(
        ALL,
        f"""SELECT {r(f'count(*) FILTER (normalized_brokerage <= {c.LOW_QUADRANT[0]}e0 AND "constraint" <= {c.LOW_QUADRANT[1]}e0) / count(*)')} AS low_low,
        {r(f'count(*) FILTER (normalized_brokerage >= {c.HIGH_QUADRANT[0]}e0 AND "constraint" >= {c.HIGH_QUADRANT[1]}e0) / count(*)')} AS high_high FROM analysis""",
    ),
    "group_summary": _with(ALL, f"SELECT category, {GROUP_SUMMARY} FROM analysis GROUP BY category"),
    "group_median": _with(
        ALL,
        " UNION ALL ".join(
            f"SELECT category, '{x}' AS metric, {r(f'quantile_cont(CAST({q(x)} AS DOUBLE), 0.5)', 6)} AS median FROM analysis GROUP BY category"
            for x in ("normalized_brokerage", "brokerage", "constraint")
        ),
    ),
    # sketches keep groups of up to their size whole, so the answer is exact here
    "approx_median": _with(
        ALL,
        " UNION ALL ".join(
            f"SELECT category, '{x}' AS metric, count({q(x)}) AS n, {r(f'quantile_disc(CAST({q(x)} AS DOUBLE), 0.5)', 6)} AS median, CAST(1 AS BIGINT) AS within"
            f" FROM analysis GROUP BY category HAVING count({q(x)}) > 0"
            for x in ("normalized_brokerage", "brokerage", "constraint")
        ),
    ),
    "zero_share": _with(ALL, f"SELECT category, {ZERO_SHARE} FROM analysis GROUP BY category"),
    "describe_table": _with(_stats, _describe()),
    "summary_transposed": _with(ALL, _transposed()),
    "design_moments": _with(
        _multihot,
        "SELECT metric, mean, min, max, stddev FROM (" + _long_stats("design", c.PREDICTORS + ["rate_outcome", "outcome_output"]) + ")",
    ),
    "cross_affiliation": _with(_exploded, "SELECT id, country, subject FROM crossed"),
    "design_multihot": _with(_multihot, f"SELECT id, {', '.join(_value(x) for x in c.PREDICTORS)} FROM design"),
    "design_exploded": _with(_exploded, f"SELECT id, country, subject, {', '.join(_value(x) for x in c.PREDICTORS)} FROM design"),
    "design_interactions": _with(
        _multihot,
        "SELECT id, "
        + ", ".join(
            (f"CAST(women * {q(k)} AS BIGINT)" if k in INTEGERS else r(f"women * {q(k)}")) + f" AS {q(f'women_x_{k}')}"
            for k in model_suite.KEY_PREDICTORS
        )
        + ", CAST(CASE WHEN normalized_brokerage > 0 THEN 1 ELSE 0 END AS BIGINT) AS any_brokerage"
        + ", CAST(CASE WHEN baseline_output = 1 THEN 1 ELSE 0 END AS BIGINT) AS single_output FROM design",
    ),
    "nb_by_group": _with(
        _multihot + "," + GROUP_MODEL,
        " UNION ALL ".join(
            f"SELECT CAST(position AS BIGINT) AS position, variable, coefficient, irr, std_error, z, p_value, '{k}' AS covariance FROM ({_coefficient_rows(k).format(slope='women')})"
            for k in ("robust", "model")
        ),
    ),
    "nb_two_param": _with(
        _two,
        f"SELECT CAST(position AS BIGINT) AS position, variable, coefficient, irr, std_error, z, p_value FROM ({_coefficient_rows('fit').format(slope='degree')})",
    ),
    "nb_full": _full_model("outcome_output"),
    "nb_full_sparse": _full_model("outcome_output"),
    "nb_rate_full": _full_model("rate_outcome"),
    "nb_model_suite": _suite(),
    "nb_multihot_model_cov": _model_cov(),
    "nb_all_products": _all_products(),
    "predict_interval_full": _interval_full(),
    "predict_profile": _profile_predictions(),
    "scenario_predictions": _scenario_predictions(),
    "grid_points": _with(_multihot + "," + DEGREE_GRID, _grids()),
    "profile_grid": _with(
        _multihot + "," + MOMENTS,
        "SELECT "
        + _held(c.PREDICTORS, {"women": "w.women", "normalized_brokerage": "k * 0.1e0"})
        + " FROM m, range(10) t(k), (VALUES (1), (0)) w(women)",
    ),
    "profile_grid_exploded": _with(
        _exploded + "," + MOMENTS,
        "SELECT "
        + _held(c.PREDICTORS, {"women": "w.women", "normalized_brokerage": "k * 0.1e0"})
        + " FROM m, range(10) t(k), (VALUES (1), (0)) w(women)",
    ),
    "profile_grid_held": _with(
        _multihot + "," + MOMENTS,
        " UNION ALL ".join(
            f"SELECT CAST({sign} AS BIGINT) AS deviations, "
            + _held(
                c.PREDICTORS,
                {
                    "women": "w.women",
                    "constraint": "co_lo + (co_hi - co_lo) * k / 99.0e0",
                    "normalized_brokerage": f"m.normalized_brokerage + {sign} * nb",
                },
            )
            + " FROM m, sd, range(100) t(k), (VALUES (1), (0)) w(women)"
            for sign in (1, -1)
        ),
    ),
    "scenario_grid": _with(_multihot + "," + MOMENTS, _scenarios()),
    "predict_grid": _with(
        _grid,
        f"SELECT CAST(women AS BIGINT) AS women, {r('degree', 5)} AS degree, {r('b0 + b1 * degree', 5)} AS predicted_log, {r('exp(b0 + b1 * degree)', 5)} AS predicted FROM grid, fit",
    ),
    "predict_interval": _with(
        _grid,
        f"""SELECT CAST(women AS BIGINT) AS women, {r("degree", 5)} AS degree, {r("exp(eta)", 5)} AS predicted, {r("exp(eta) * se", 5)} AS std_error,
        {r(f"exp(eta - {Z_95}e0 * se)", 5)} AS lower_bound, {r(f"exp(eta + {Z_95}e0 * se)", 5)} AS upper_bound
        FROM (SELECT women, degree, b0 + b1 * degree AS eta, sqrt(v00 + 2 * v01 * degree + v11 * degree * degree) AS se FROM grid, fit)""",
    ),
    "predict_interval_response": _with(
        _grid,
        f"""SELECT CAST(women AS BIGINT) AS women, {r("degree", 4)} AS degree, {r("exp(eta)", 4)} AS predicted, {r("exp(eta) * se", 4)} AS std_error,
        {r("exp(eta) - 10e0 * exp(eta) * se", 4)} AS lower_bound, {r("exp(eta) + 10e0 * exp(eta) * se", 4)} AS upper_bound
        FROM (SELECT women, degree, b0 + b1 * degree AS eta, sqrt(v00 + 2 * v01 * degree + v11 * degree * degree) AS se FROM grid, fit)""",
    ),
    "marginal_effects": _with(
        _grid,
        f"""SELECT CAST(women AS BIGINT) AS women, {r("degree", 5)} AS degree, {r("exp(b0 + b1 * degree)", 5)} AS expected_value,
        {r("b1 * exp(b0 + b1 * degree)", 5)} AS marginal_effect, {r("b1 * exp(b0 + b1 * degree)", 5)} AS marginal_effect_total FROM grid, fit""",
    ),
    "log_outcomes": _with(
        ALL,
        f"SELECT id, {r('ln(rate_outcome + 1)')} AS log_rate, {r('ln(outcome_output + 1)')} AS log_outcome, {r('log10(degree + 1)')} AS log10_degree FROM analysis",
    ),
    "seeded_sample": _with(
        _multihot,
        f"""SELECT id, CAST(women AS BIGINT) AS women, {r("normalized_brokerage")} AS normalized_brokerage, {r("ln(rate_outcome + 1)")} AS log_rate
        FROM design ORDER BY md5('{c.SAMPLE_SEED}:' || CAST(id AS VARCHAR)), id LIMIT {c.SAMPLE_ROWS}""",
    ),
    "density_histogram": _with(_multihot, _histogram("rate_outcome", 40, 2) + " UNION ALL " + _histogram("outcome_output", 18, 1)),
    "density_curve": _with(
        _multihot, _curve("constraint", 'CAST("constraint" AS DOUBLE)') + " UNION ALL " + _curve("degree", "ln(CAST(degree AS DOUBLE) + 1)")
    ),
}
