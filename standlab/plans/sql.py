"""SQL text that several twins share: cross-product matrices and sweeps, as lists of lists."""


def sweep(name: str, source: str, size: int, pivots: int, keys: str = "") -> str:
    """A recursive CTE that sweeps the first ``pivots`` rows of the matrix ``m`` of ``source``.

    Cross-products of (terms, response) turn into the terms' inverse, the coefficients in the last
    column and the residual square in the corner; ``ld`` is the log determinant of the terms.
    """
    d = "m[k + 1][k + 1]"
    cell = (f"CASE WHEN i = k + 1 AND j = k + 1 THEN 1 / {d} WHEN i = k + 1 THEN m[i][j] / {d} "
            f"WHEN j = k + 1 THEN -m[i][j] / {d} ELSE m[i][j] - m[i][k + 1] * m[k + 1][j] / {d} END")
    each = f"list_transform(range(1, {size + 1}), lambda i: list_transform(range(1, {size + 1}), lambda j: {cell}))"
    return (f"{name}_steps AS (SELECT {keys}0 AS k, 0.0::DOUBLE AS ld, m FROM {source} UNION ALL "
            f"SELECT {keys}k + 1, ld + ln({d}), {each} FROM {name}_steps WHERE k < {pivots}),\n"
            f"{name} AS (SELECT {keys}ld, m FROM {name}_steps WHERE k = {pivots})")


def matrix(name: str, source: str, keys: str = "") -> str:
    """A CTE of the matrix ``m`` from rows (i, j, v)."""
    group = f" GROUP BY {keys.rstrip(', ')}" if keys else ""
    inner = f"SELECT {keys}i, list(v ORDER BY j) AS r FROM {source} GROUP BY {keys}i"
    return f"{name} AS (SELECT {keys}list(r ORDER BY i) AS m FROM ({inner}){group})"


def crossproducts(name: str, source: str, size: int, keys: str = "", weight: str = "1") -> str:
    """A CTE of rows (i, j, v): sums of products of the entries of the list ``z``."""
    group = f"{keys}i, j"
    return (f"{name} AS (SELECT {group}, sum({weight} * z[i] * z[j]) AS v FROM {source}, "
            f"range(1, {size + 1}) a(i), range(1, {size + 1}) b(j) GROUP BY {group})")


def f_tail(f: str, df1: str, df2: str, steps: int = 20_000) -> str:
    """P(F > f) as an expression: Simpson's rule over the angle whose squared sine is the beta variable."""
    end = f"asin(sqrt({df2} / ({df2} + {df1} * {f})))"
    weight = f"CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    each = f"{weight} * pow(sin(i * {end} / {steps}), {df2} - 1) * pow(cos(i * {end} / {steps}), {df1} - 1)"
    front = f"exp(lgamma(({df1} + {df2}) / 2) - lgamma({df1} / 2) - lgamma({df2} / 2))"
    return f"list_sum(list_transform(range({steps + 1}), lambda i: {each})) * {end} / {steps} / 3 * 2 * {front}"


def weibull(name: str, source: str, by: str, col: str, steps: int = 60) -> str:
    """CTEs that end in ``name``: ``by``, n, shape and scale by Newton steps on the lists of each group."""
    total = lambda k, what: f"list_sum(list_transform(l, lambda e: e.c * exp({k} * (e.z - top)){what}))"
    return f"""{name}_v AS (SELECT {by}, ln({col}) AS z, CAST(count(*) AS DOUBLE) AS c FROM {source} WHERE {col} > 0 GROUP BY {by}, {col}),
{name}_g AS (SELECT {by}, sum(c) AS n, sum(c * z) / sum(c) AS m, sum(c * z * z) / sum(c) - pow(sum(c * z) / sum(c), 2) AS spread,
 max(z) AS top, list({{'c': c, 'z': z}} ORDER BY z) AS l FROM {name}_v GROUP BY {by}),
{name}_k AS (SELECT {by}, 0 AS i, n, m, top, l, 1.2825::DOUBLE / sqrt(spread) AS k FROM {name}_g WHERE n > 1 AND spread > 1e-12 UNION ALL
 SELECT {by}, i + 1, n, m, top, l, greatest(k / 3, k - (s1 / s0 - (m - top) - 1 / k) / (s2 / s0 - pow(s1 / s0, 2) + 1 / (k * k))) FROM
 (SELECT *, {total("k", "")} AS s0, {total("k", " * (e.z - top)")} AS s1, {total("k", " * pow(e.z - top, 2)")} AS s2 FROM {name}_k WHERE i < {steps})),
{name} AS (SELECT {by}, CAST(n AS BIGINT) AS n, k AS shape, exp(top) * pow({total("k", "")} / n, 1 / k) AS scale FROM {name}_k WHERE i = {steps})"""
