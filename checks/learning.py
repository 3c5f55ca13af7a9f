"""DuckDB texts of the fitted models: the same whole-number k-means, and Jacobi rotations, as recursive queries."""

from __future__ import annotations

from math import isqrt

F4 = ["f1", "f2", "f3", "f4"]
Q4 = ["q1", "q2", "q3", "q4"]
LIMIT = isqrt((1 << 62) // 4) // 2
STEPS, ROUNDS = 100, 2


def gap(a: str, b: str) -> str:
    return " + ".join(f"({a}.{q} - {b}.{q}) * ({a}.{q} - {b}.{q})" for q in Q4)


def scaled(source: str = "v_training") -> str:
    """z-scores with means and deviations rounded to nine digits."""
    fitted = ", ".join(f"round(avg({f}), 9) AS m{i + 1}, round(stddev_pop({f}), 9) AS s{i + 1}" for i, f in enumerate(F4))
    z = ", ".join(f"({f} - m{i + 1}) / CASE WHEN s{i + 1} = 0 THEN 1e0 ELSE s{i + 1} END AS z{i + 1}" for i, f in enumerate(F4))
    return f"SELECT row_id, {z} FROM {source}, (SELECT {fitted} FROM {source}) fitted"


def fitted(ks: list[int]) -> str:
    """Tables up to `means`: k, j, q1 to q4 of every centre after the last step; `p` holds the rows on the lattice."""
    most, qs = max(ks), ", ".join(Q4)
    lattice = ", ".join(f"CAST(least(greatest(floor(z{i + 1} * 1048576 + 0.5), -{LIMIT}), {LIMIT}) AS BIGINT) + {LIMIT} AS q{i + 1}" for i in range(4))
    hashes = ", ".join(f"CAST('0x' || substr(md5(concat_ws(',', row_id, {qs}, '{r}')), 1, 13) AS BIGINT) AS h{r}" for r in range(ROUNDS + 1))
    parts = [f"z AS MATERIALIZED ({scaled()})", f"l AS MATERIALIZED (SELECT row_id, {lattice} FROM z)", f"p AS MATERIALIZED (SELECT *, {hashes} FROM l)",
             f"c0 AS MATERIALIZED (SELECT {qs} FROM p ORDER BY h0, {qs} LIMIT 1)"]
    for r in range(1, ROUNDS + 1):
        parts.append(f"e{r} AS MATERIALIZED (SELECT p.row_id, {', '.join('p.' + q for q in Q4)}, p.h{r}, min({gap('p', 'c')}) AS d FROM p, c{r - 1} c GROUP BY ALL)")
        parts.append(f"c{r} AS MATERIALIZED (SELECT * FROM c{r - 1} UNION SELECT {qs} FROM e{r}"
                     f" WHERE h{r} < CAST(d AS DOUBLE) * {2 * most}e0 / (SELECT CAST(sum(d) AS DOUBLE) FROM e{r}) * 4503599627370496e0)")
    order = ", ".join("c." + q for q in Q4)
    parts.append(f"near AS (SELECT {order}, row_number() OVER (PARTITION BY p.row_id ORDER BY {gap('p', 'c')}, {order}) AS rn FROM p, c{ROUNDS} c)")
    parts.append(f"w AS MATERIALIZED (SELECT {order}, coalesce(n, 0) AS n FROM c{ROUNDS} c LEFT JOIN (SELECT {qs}, count(*) AS n FROM near WHERE rn = 1 GROUP BY ALL) m USING ({qs}))")
    parts.append(f"s1 AS MATERIALIZED (SELECT 0 AS j, {qs} FROM w ORDER BY n DESC, {qs} LIMIT 1)")
    for j in range(1, most):
        scores = f"SELECT {', '.join('w.' + q for q in Q4)}, w.n * CAST(min({gap('w', 's')}) AS HUGEINT) AS score FROM w, s{j} s GROUP BY {', '.join('w.' + q for q in Q4)}, w.n"
        parts.append(f"s{j + 1} AS MATERIALIZED (SELECT * FROM s{j} UNION ALL (SELECT {j} AS j, {qs} FROM ({scores}) x ORDER BY score DESC, {qs} LIMIT 1))")
    moved = ", ".join(f"coalesce((2 * m.t{i + 1} + m.n) // (2 * m.n), it.q{i + 1})::BIGINT AS q{i + 1}" for i in range(4))
    sums = ", ".join(f"sum(p.q{i + 1}) AS t{i + 1}" for i in range(4))
    parts.append(f"""it AS (SELECT 0 AS i, k, j, {qs} FROM s{most} JOIN (SELECT unnest({ks}) AS k) ks ON j < k
UNION ALL SELECT it.i + 1, it.k, it.j, {moved} FROM it LEFT JOIN (
  SELECT k, j, count(*) AS n, {sums} FROM (SELECT it.k, p.row_id, arg_min(it.j, {{'d': {gap('p', 'it')}, 'j': it.j}}) AS j FROM it, p GROUP BY it.k, p.row_id) a
  JOIN p USING (row_id) GROUP BY k, j) m ON it.k = m.k AND it.j = m.j WHERE it.i < {STEPS})""")
    parts.append(f"means AS MATERIALIZED (SELECT k, j, {qs} FROM it WHERE i = {STEPS})")
    return ", ".join(parts)


def _lattice_row(alias: str) -> str:
    return ", ".join(f"({alias}.q{i + 1} - {LIMIT}) / 1048576e0 AS c{i + 1}" for i in range(4))


def kmeans() -> str:
    """Labels of the training rows, in the order of the five centres."""
    d = " + ".join(f"(z.z{i + 1} - c.c{i + 1}) * (z.z{i + 1} - c.c{i + 1})" for i in range(4))
    return f"""WITH RECURSIVE {fitted([5])},
c AS (SELECT {_lattice_row('means')}, CAST(row_number() OVER (ORDER BY {', '.join(Q4)}) - 1 AS INT) AS label FROM means)
SELECT row_id, arg_min(label, {{'d': 0e0 + {d}, 'k': label}}) AS k_cluster FROM z, c GROUP BY row_id"""


def fixpoint() -> str:
    """Centres, the rounded means of their rows, and whether these are the same."""
    sums = ", ".join(f"((2 * sum(p.q{i + 1}) + count(*)) // (2 * count(*)))::BIGINT AS m{i + 1}" for i in range(4))
    same = " AND ".join(f"q{i + 1} = m{i + 1}" for i in range(4))
    return f"""WITH RECURSIVE {fitted([5])},
a AS (SELECT p.row_id, arg_min(c.j, {{'d': {gap('p', 'c')}, 'j': c.j}}) AS j FROM p, means c GROUP BY p.row_id),
m AS (SELECT j, count(*) AS n, {sums} FROM a JOIN p USING (row_id) GROUP BY j)
SELECT CAST(row_number() OVER (ORDER BY {', '.join(Q4)}) - 1 AS INT) AS k_cluster, n, {', '.join(f'round((m{i + 1} - {LIMIT}) / 1048576e0, 8) AS z{i + 1}' for i in range(4))},
 {same} AS fixed FROM means JOIN m USING (j)"""


def elbow() -> str:
    return f"""WITH RECURSIVE {fitted(list(range(1, 11)))},
d AS (SELECT c.k, p.row_id, min({gap('p', 'c')}) AS d FROM p, means c GROUP BY c.k, p.row_id)
SELECT CAST(k AS INT) AS k, round(CAST(sum(d) AS DOUBLE) / 1099511627776e0, 8) AS inertia FROM d GROUP BY k"""


def axes() -> str:
    """Table `x`: i, eigenvalue, vector of the covariance of the z-scores, by Jacobi's rotations; `cov` is the matrix, row by row."""
    cov = ", ".join(f"covar_pop(z{i + 1}, z{j + 1})" for i in range(4) for j in range(4))
    pairs = [(p, q) for p in range(4) for q in range(p + 1, 4)]
    place = "CASE i % 6 " + " ".join(f"WHEN {n} THEN {{0}}[{4 * p + q + 1}]" for n, (p, q) in enumerate(pairs)) + " END"
    at = lambda which: "CASE i % 6 " + " ".join(f"WHEN {n} THEN a[{5 * pair[which] + 1}]" for n, pair in enumerate(pairs)) + " END"
    first = "CASE i % 6 " + " ".join(f"WHEN {n} THEN {p}" for n, (p, _) in enumerate(pairs)) + " END"
    second = "CASE i % 6 " + " ".join(f"WHEN {n} THEN {q}" for n, (_, q) in enumerate(pairs)) + " END"
    cell = ("CASE WHEN {r} = p AND {k} = p OR {r} = q AND {k} = q THEN c WHEN {r} = p AND {k} = q THEN s"
            " WHEN {r} = q AND {k} = p THEN -s WHEN {r} = {k} THEN 1e0 ELSE 0e0 END")
    rotation = "[" + ", ".join(cell.format(r=n // 4, k=n % 4) for n in range(16)) + "]"
    times = lambda a, b: "[" + ", ".join(" + ".join(f"{a}[{4 * r + m + 1}] * {b}[{4 * m + k + 1}]" for m in range(4)) for r in range(4) for k in range(4)) + "]"
    turned = lambda a, b: "[" + ", ".join(" + ".join(f"{a}[{4 * m + r + 1}] * {b}[{4 * m + k + 1}]" for m in range(4)) for r in range(4) for k in range(4)) + "]"
    one = "[" + ", ".join("1e0" if n % 5 == 0 else "0e0" for n in range(16)) + "]"
    vectors = " UNION ALL ".join(f"SELECT a[{5 * n + 1}] AS eigenvalue, [v[{n + 1}], v[{n + 5}], v[{n + 9}], v[{n + 13}]] AS w FROM jac WHERE i = 72" for n in range(4))
    return f"""z AS MATERIALIZED ({scaled()}), cov AS MATERIALIZED (SELECT [{cov}] AS m FROM z),
jac AS (SELECT 0 AS i, m AS a, {one} AS v FROM cov
UNION ALL SELECT i + 1, {turned('j', 'aj')} AS a, {times('v', 'j')} AS v FROM (
  SELECT i, a, v, j, {times('a', 'j')} AS aj FROM (
   SELECT i, a, v, {rotation} AS j FROM (
    SELECT *, t / sqrt(1 + t * t) AS s, 1 / sqrt(1 + t * t) AS c FROM (
     SELECT *, CASE WHEN apq = 0 THEN 0e0 ELSE (CASE WHEN tau < 0 THEN -1e0 ELSE 1e0 END) / (abs(tau) + sqrt(1 + tau * tau)) END AS t FROM (
      SELECT *, CASE WHEN apq = 0 THEN 0e0 ELSE (aqq - app) / (2 * apq) END AS tau FROM (
       SELECT i, a, v, {first} AS p, {second} AS q, {place.format('a')} AS apq, {at(0)} AS app, {at(1)} AS aqq FROM jac WHERE i < 72) y0) y1) y2) y3) y4) y5),
x AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY eigenvalue DESC) AS INT) AS component, eigenvalue, w FROM ({vectors}) v0)"""


def pca() -> str:
    upright = "CASE WHEN abs(list_min(w)) > list_max(w) THEN -1 ELSE 1 END"
    return f"""WITH RECURSIVE {axes()}
SELECT component, f AS feature, round(w[n] * {upright}, 8) AS loading FROM x, (SELECT unnest({F4}) AS f, unnest([1, 2, 3, 4]) AS n) names WHERE component <= 2"""


def residual() -> str:
    rows = ", ".join("abs(" + " + ".join(f"m[{4 * r + k + 1}] * w[{k + 1}]" for k in range(4)) + f" - eigenvalue * w[{r + 1}])" for r in range(4))
    return f"""WITH RECURSIVE {axes()}
SELECT component, round(eigenvalue, 8) AS eigenvalue, round(greatest({rows}), 8) AS residual FROM x, cov"""
