"""SQL text for iterative models: elimination, coordinate descent and Lloyd rounds as CTE chains."""

from __future__ import annotations


def moments_cte(name: str, src: str, xs: list[str], y: str, keys: str, weight: str | None = None) -> str:
    """Means and population covariances of features and target per key."""
    cols = [*xs, y]
    d = len(xs)
    if weight is None:
        mean = ", ".join(f"avg({c}) AS m_{i}" for i, c in enumerate(cols))
        cov = ", ".join(f"covar_pop({cols[i]}, {cols[j]}) AS c{i}_{j}" for i in range(d) for j in range(d + 1))
        return f"{name} AS (SELECT {keys}, count(*) AS n, {mean}, {cov} FROM {src} GROUP BY ALL)"
    w = weight
    e = lambda x: f"sum({w} * {x}) / sum({w})"
    mean = ", ".join(f"{e(c)} AS m_{i}" for i, c in enumerate(cols))
    cov = ", ".join(f"{e(f'{cols[i]} * {cols[j]}')} - {e(cols[i])} * {e(cols[j])} AS c{i}_{j}" for i in range(d) for j in range(d + 1))
    return f"{name} AS (SELECT {keys}, sum({w}) AS n, {mean}, {cov} FROM {src} GROUP BY ALL)"


def gauss_ctes(xs: list[str], ridge: float | str = 0.0, src: str = "feats", y: str = "y", keys: str = "end_hour", weight: str | None = None, moments: str | None = None, name: str = "fit") -> str:
    """Normal equations per key by elimination over scalar columns, one CTE per pivot; ends in `name` with w0.. and wi.

    `ridge` is a number or a column of the moments; `moments` names a CTE that has them already.
    """
    d = len(xs)
    means = ", ".join(f"m_{i}" for i in range(d + 1))
    penalty = ridge if isinstance(ridge, str) else f"{ridge}::DOUBLE"
    diag = lambda i, j: f" + {penalty} / n" if i == j and ridge else ""
    g = moments or f"{name}_g"
    steps = [] if moments else [moments_cte(g, src, xs, y, keys, weight)]
    steps.append(f"{name}_0 AS (SELECT {keys}, n, {means}, " + ", ".join(f"c{i}_{j}{diag(i, j)} AS a{i}_{j}" for i in range(d) for j in range(d + 1)) + f" FROM {g})")
    for p in range(d):
        cells = [f"a{p}_{j} / a{p}_{p} AS a{i}_{j}" if i == p else f"a{i}_{j} - a{i}_{p} * a{p}_{j} / a{p}_{p} AS a{i}_{j}"
                 for i in range(d) for j in range(d + 1)]
        steps.append(f"{name}_{p + 1} AS (SELECT {keys}, n, {means}, {', '.join(cells)} FROM {name}_{p})")
    w = ", ".join(f"a{i}_{d} AS w{i}" for i in range(d))
    icept = f"m_{d} - (" + " + ".join(f"a{i}_{d} * m_{i}" for i in range(d)) + ")"
    steps.append(f"{name} AS (SELECT {keys}, n, {w}, {icept} AS wi FROM {name}_{d})")
    return ", ".join(steps)


def resample_ctes(name: str, src: str, keys: str, row_id: str, uniform, n: int, ties: list[str] = []) -> str:
    """`name`: every row of src with each replicate and the number `w` of its draws; as many draws as the group has rows."""
    return f"""{name}_p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {", ".join([row_id, *ties])}) AS place_, count(*) OVER (PARTITION BY {keys}) AS size_ FROM {src}),
    {name}_d AS MATERIALIZED (SELECT {keys}, replicate, place_, count(*) AS w FROM (
        SELECT {keys}, g.r AS replicate, CAST(floor({uniform(row_id, 'g.r')} * size_) AS BIGINT) + 1 AS place_ FROM {name}_p, generate_series(0, {n - 1}) AS g(r)) GROUP BY ALL),
    {name} AS MATERIALIZED (SELECT p.*, p.r AS replicate, coalesce(d.w, 0) AS w FROM (SELECT * FROM {name}_p, generate_series(0, {n - 1}) AS g(r)) p
        LEFT JOIN {name}_d d ON {" AND ".join(f"d.{k.strip()} = p.{k.strip()}" for k in keys.split(","))} AND d.replicate = p.r AND d.place_ = p.place_)"""


def lasso_ctes(xs: list[str], alphas: list[float], rounds: int, keys: str = "end_hour", moments: str = "g0") -> str:
    """Cyclic coordinate descent from zero; ends in `las` with w0.. and the intercept wi."""
    d = len(xs)
    zero = ", ".join(f"CAST(0 AS DOUBLE) AS w{i}" for i in range(d))
    steps = [f"l0 AS MATERIALIZED (SELECT *, {zero} FROM {moments}, (SELECT unnest({alphas!r}::DOUBLE[]) AS alpha))"]
    for s in range(rounds * d):
        j = s % d
        rest = f"(c{j}_{d} - (" + " + ".join(f"c{min(j, k)}_{max(j, k)} * w{k}" for k in range(d) if k != j) + "))"
        steps.append(f"l{s + 1} AS MATERIALIZED (SELECT * REPLACE (sign({rest}) * greatest(abs({rest}) - alpha, 0) / c{j}_{j} AS w{j}) FROM l{s})")
    icept = f"m_{d} - (" + " + ".join(f"w{i} * m_{i}" for i in range(d)) + ")"
    steps.append(f"las AS (SELECT *, {icept} AS wi FROM l{rounds * d})")
    return ", ".join(steps)


def lloyd_ctes(src: str, value: str, keys: str, max_k: int, rows_per_k: int) -> str:
    """Lloyd rounds from quantile centres until none moves; ends in `ctr` (keys, k, i, v) and `asg` (row, cluster)."""
    names = [k.strip() for k in keys.split(",")]
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in names)
    pk, lk = ", ".join(f"p.{k}" for k in names), ", ".join(f"l.{k}" for k in names)
    near = lambda cs: f"list_position(list_transform({cs}, lambda c: abs(c - p.v)), list_min(list_transform({cs}, lambda c: abs(c - p.v)))) - 1"
    return ", ".join([
        f"""pts AS MATERIALIZED (SELECT * FROM (SELECT {keys}, {value} AS v, row_number() OVER (PARTITION BY {keys} ORDER BY {value}) - 1 AS rn,
            count(*) OVER (PARTITION BY {keys}) AS n FROM {src} WHERE {value} IS NOT NULL) WHERE n >= {rows_per_k * max_k})""",
        f"""k0 AS MATERIALIZED (SELECT {pk}, g.k, list(p.v ORDER BY g.i) AS cs FROM (SELECT k, unnest(generate_series(0, k - 1)) AS i FROM (SELECT unnest(generate_series(2, {max_k})) AS k)) g
            JOIN pts p ON p.rn = CAST(floor((p.n - 1) * ((g.i + 0.5::DOUBLE) / g.k)) AS BIGINT) GROUP BY {pk}, g.k)""",
        f"""lloyd AS (SELECT {keys}, k, cs, TRUE AS moves, 0 AS turn FROM k0 UNION ALL
            SELECT {keys}, k, new, list_max(list_transform(new, lambda x, j: abs(x - cs[j]))) > 1e-9, turn + 1 FROM (
                SELECT {keys}, k, turn, cs, list_transform(cs, lambda x, j: coalesce(m[j - 1][1], x)) AS new FROM (
                    SELECT {keys}, k, turn, cs, map(list(i), list([mean])) AS m FROM (
                        SELECT {lk}, l.k, l.turn, l.cs, {near('l.cs')} AS i, avg(p.v) AS mean FROM lloyd l JOIN pts p ON {on('p', 'l')} WHERE l.moves GROUP BY {lk}, l.k, l.turn, l.cs, {near('l.cs')})
                    GROUP BY {keys}, k, turn, cs)))""",
        f"fin AS MATERIALIZED (SELECT {keys}, k, arg_max(cs, turn) AS cs FROM lloyd GROUP BY {keys}, k UNION ALL SELECT {keys}, 1, [avg(v)] FROM pts GROUP BY {keys})",
        f"ctr AS MATERIALIZED (SELECT {keys}, k, unnest(generate_series(0, len(cs) - 1)) AS i, unnest(cs) AS v FROM fin)",
        f"asg AS MATERIALIZED (SELECT {pk}, p.rn, p.v, l.k, {near('l.cs')} AS i FROM pts p JOIN fin l ON {on('p', 'l')})",
    ])
