"""SQL text of ordinary least squares by group: sums of products, then Gauss-Jordan elimination, one step per term."""

from __future__ import annotations

from collections.abc import Mapping, Sequence


def least_squares(source: str, keys: Sequence[str], terms: Mapping[str, str], target: str, name: str = "ols", least: int = 1, ridge: float = 0.0) -> str:
    """Common table expressions ending in `name`: keys, n, b0 … bp (intercept first), ssr, sst.

    `ridge` adds that multiple of its centred sum of squares to the diagonal cell of each term but the intercept.
    """
    p = len(terms) + 1
    key_list = "".join(f"{k}, " for k in keys)
    names = [f"x{i}" for i in range(p)]
    columns = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in zip(names[1:], terms.values()))
    known = " AND ".join([f"{n} IS NOT NULL" for n in names[1:]] + ["y IS NOT NULL"])
    products = ", ".join(f"sum(x{i} * x{j}) AS a_{i}_{j}" for i in range(p) for j in range(i, p))
    sides = ", ".join(f"sum(x{i} * y) AS r{i}" for i in range(p))
    keep = key_list + "n, yy, " + ", ".join(f"r{i}" for i in range(p))
    group = f" GROUP BY {', '.join(keys)}" if keys else ""

    def cell(i: int, j: int) -> str:
        plain = f"a_{min(i, j)}_{max(i, j)}"
        return f"{plain} + {ridge}::DOUBLE * ({plain} - a_0_{j} * a_0_{j} / n)" if ridge and i == j > 0 else plain

    ctes = [
        f"{name}_rows AS MATERIALIZED (SELECT * FROM (SELECT {key_list}CAST(1 AS DOUBLE) AS x0, {columns}, "
        f"CAST({target} AS DOUBLE) AS y FROM {source}) t WHERE {known})",
        f"{name}_sums AS MATERIALIZED (SELECT {key_list}count(*) AS n, sum(y * y) AS yy, {products}, {sides} FROM {name}_rows{group} "
        f"HAVING count(*) >= {least})",
        f"{name}_0 AS MATERIALIZED (SELECT {keep}, "
        + ", ".join(f"{cell(i, j)} AS m_{i}_{j}" for i in range(p) for j in range(p))
        + ", "
        + ", ".join(f"r{i} AS m_{i}_{p}" for i in range(p))
        + f" FROM {name}_sums)",
    ]
    for k in range(p):
        cells = []
        for i in range(p):
            for j in range(k + 1, p + 1):
                change = f"m_{k}_{j} / m_{k}_{k}" if i == k else f"m_{i}_{j} - m_{i}_{k} * m_{k}_{j} / m_{k}_{k}"
                cells.append(f"{change} AS m_{i}_{j}")
        ctes.append(f"{name}_{k + 1} AS MATERIALIZED (SELECT {keep}, {', '.join(cells)} FROM {name}_{k})")
    coefs = ", ".join(f"m_{i}_{p} AS b{i}" for i in range(p))
    explained = " - ".join(f"m_{i}_{p} * r{i}" for i in range(p))
    ctes.append(f"{name} AS (SELECT {key_list}n, {coefs}, yy - {explained} AS ssr, yy - r0 * r0 / n AS sst FROM {name}_{p})")
    return ",\n".join(ctes)


def dot_sql(terms: Mapping[str, str], prefix: str = "") -> str:
    return " + ".join([f"{prefix}b0"] + [f"{prefix}b{i} * {e}" for i, e in enumerate(terms.values(), 1)])


def seasonal_sql(date: str = "date", yearly: int = 3) -> dict[str, str]:
    """The seasonal terms as SQL."""
    years = f"(({date} - DATE '1995-01-01') / 365.25::DOUBLE)"
    terms = {"trend": years}
    terms |= {f"weekday_{k}": f"CAST(isodow({date}) - 1 = {k} AS DOUBLE)" for k in range(1, 7)}
    for k in range(1, yearly + 1):
        terms |= {f"sin_{k}": f"sin({years} * (2 * pi() * {k}))", f"cos_{k}": f"cos({years} * (2 * pi() * {k}))"}
    return terms
