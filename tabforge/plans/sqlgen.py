"""Helpers that write the DuckDB oracle text for generic column lists."""

from __future__ import annotations


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def union_all(selects: list[str]) -> str:
    return "\nUNION ALL\n".join(selects)


def missing_sql(src: str, cols: list[str]) -> str:
    """Long table (ordinal, column_name, n_missing, n_rows) from one aggregation."""
    aggs = ", ".join(f"CAST(count_if({q(c)} IS NULL) AS BIGINT) AS m{i}" for i, c in enumerate(cols))
    body = union_all([f"SELECT {i} AS ordinal, {lit(c)} AS column_name, m{i} AS n_missing, n AS n_rows FROM a"
                      for i, c in enumerate(cols)])
    return f"(WITH a AS (SELECT count(*) AS n, {aggs} FROM {src}) {body})"


def missing_findings_sql(src: str, cols: list[str]) -> str:
    pct = "round_even(n_missing / n_rows * 100, 2)"
    return f"""(SELECT ordinal, column_name, n_missing, n_missing / n_rows * 100 AS missing_raw,
        {pct} AS missing_pct,
        CAST(CASE WHEN {pct} > 40 THEN 15 WHEN {pct} > 20 THEN 8 WHEN {pct} > 0 THEN 3 ELSE 0 END AS INTEGER) AS penalty,
        CASE WHEN {pct} > 40 THEN 'CRITICAL' WHEN {pct} > 20 THEN 'WARNING' WHEN {pct} > 0 THEN 'INFO' END AS severity,
        CASE WHEN {pct} > 40 THEN 'CRITICAL: ''' || column_name || ''' has ' || CAST({pct} AS VARCHAR) || '% missing values. Consider dropping.'
             WHEN {pct} > 20 THEN 'WARNING: ''' || column_name || ''' has ' || CAST({pct} AS VARCHAR) || '% missing values.'
             WHEN {pct} > 0 THEN 'INFO: ''' || column_name || ''' has ' || CAST({pct} AS VARCHAR) || '% missing values.' END AS message
      FROM {missing_sql(src, cols)} WHERE n_missing / n_rows * 100 > 0)"""


def imbalance_sql(src: str, target: str) -> str:
    t = q(target)
    pct = "minority_pct"
    return f"""(SELECT {pct}, n_classes,
        CAST(CASE WHEN {pct} < 10 THEN 20 WHEN {pct} < 20 THEN 10 ELSE 0 END AS INTEGER) AS penalty,
        CASE WHEN {pct} < 10 THEN 'CRITICAL' WHEN {pct} < 20 THEN 'WARNING' ELSE 'INFO' END AS severity,
        CASE WHEN {pct} < 10 THEN 'CRITICAL: Severe class imbalance. Minority class is only ' || printf('%.1f', {pct}) || '% of data. SMOTE will be applied.'
             WHEN {pct} < 20 THEN 'WARNING: Class imbalance detected. Minority class is ' || printf('%.1f', {pct}) || '% of data.'
             ELSE 'INFO: Class distribution is acceptable. Minority class is ' || printf('%.1f', {pct}) || '% of data.' END AS message
      FROM (SELECT min(c) FILTER (WHERE v IS NOT NULL) / sum(c) * 100 AS {pct},
                   CAST(count(v) AS BIGINT) AS n_classes
            FROM (SELECT {t} AS v, count(*) AS c FROM {src} GROUP BY {t})))"""


def duplicates_sql(src: str, cols: list[str]) -> str:
    g = ", ".join(q(c) for c in cols)
    pct = "duplicate_pct"
    d = "CAST(duplicate_rows AS VARCHAR)"
    return f"""(SELECT n_rows, duplicate_rows, {pct},
        CAST(CASE WHEN {pct} > 10 THEN 10 WHEN {pct} > 5 THEN 5 ELSE 0 END AS INTEGER) AS penalty,
        CASE WHEN {pct} > 10 THEN 'CRITICAL' WHEN {pct} > 5 THEN 'WARNING' ELSE 'INFO' END AS severity,
        CASE WHEN {pct} > 10 THEN 'CRITICAL: ' || {d} || ' duplicate rows (' || printf('%.1f', {pct}) || '%). Remove before training.'
             WHEN {pct} > 5 THEN 'WARNING: ' || {d} || ' duplicate rows (' || printf('%.1f', {pct}) || '%) found.'
             ELSE 'INFO: ' || {d} || ' duplicate rows found. Acceptable.' END AS message
      FROM (SELECT CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(c - 1) AS BIGINT) AS duplicate_rows,
                   sum(c - 1) / sum(c) * 100 AS {pct}
            FROM (SELECT count(*) AS c FROM {src} GROUP BY ALL_COLS)))""".replace("GROUP BY ALL_COLS", f"GROUP BY {g}")


def outliers_sql(src: str, cols: list[str]) -> str:
    stats = ", ".join(f"count({q(c)}) AS n{i}, avg({q(c)}) AS m{i}, stddev_samp({q(c)}) AS s{i}"
                      for i, c in enumerate(cols))
    cnts = ", ".join(
        f"count_if(s.s{i} > 0 AND abs(({q(c)} - s.m{i}) / s.s{i}) > 3) AS o{i}" for i, c in enumerate(cols))
    body = union_all([f"SELECT {i} AS ordinal, {lit(c)} AS column_name, CAST(n{i} AS BIGINT) AS n_nonnull, "
                      f"CAST(o{i} AS BIGINT) AS outliers FROM s, o" for i, c in enumerate(cols)])
    pct = "outliers / n_nonnull * 100"
    o = "CAST(outliers AS VARCHAR)"
    return f"""(WITH s AS (SELECT {stats} FROM {src}),
      o AS (SELECT {cnts} FROM {src}, s),
      l AS ({body})
      SELECT ordinal, column_name, n_nonnull, outliers, {pct} AS outlier_pct,
        CAST(CASE WHEN {pct} > 10 THEN 5 ELSE 0 END AS INTEGER) AS penalty,
        CASE WHEN {pct} > 10 THEN 'WARNING' WHEN outliers > 0 THEN 'INFO' END AS severity,
        CASE WHEN {pct} > 10 THEN 'WARNING: ''' || column_name || ''' has ' || {o} || ' outliers (' || printf('%.1f', {pct}) || '%).'
             WHEN outliers > 0 THEN 'INFO: ''' || column_name || ''' has ' || {o} || ' outliers.' END AS message
      FROM l)"""


def least_squares_sql(src: str, features: list[str], target: str) -> str:
    """CTEs ``centre`` (m0.., my) and ``coef`` (c0..): the normal equations of the centred columns, solved by elimination.

    The prediction is my + sum c_i * (x_i - m_i)."""
    k = len(features)
    cols = [*features, target]
    name = [*[f"m{i}" for i in range(k)], "my"]
    out = [f"centre AS (SELECT {', '.join(f'avg({c}) AS {n}' for c, n in zip(cols, name))} FROM {src})"]
    sums = ", ".join(f"sum(({cols[i]} - {name[i]}) * ({cols[j]} - {name[j]})) AS a{i}_{j}" for i in range(k) for j in range(i, k + 1))
    out.append(f"e0 AS (SELECT {sums} FROM {src}, centre)")
    for p in range(1, k):  # row p - 1 leaves the rows below it, which stay symmetric
        rows = [f"a{i}_{j} - a{p - 1}_{i} * a{p - 1}_{j} / a{p - 1}_{p - 1} AS a{i}_{j}" for i in range(p, k) for j in range(i, k + 1)]
        kept = [f"a{i}_{j}" for i in range(p) for j in range(i, k + 1)]
        out.append(f"e{p} AS (SELECT {', '.join(kept + rows)} FROM e{p - 1})")
    last = f"e{k - 1}"
    for i in range(k - 1, -1, -1):
        known = "".join(f" - a{i}_{j} * c{j}" for j in range(i + 1, k))
        out.append(f"s{i} AS (SELECT *, (a{i}_{k}{known}) / a{i}_{i} AS c{i} FROM {last})")
        last = f"s{i}"
    out.append(f"coef AS (SELECT {', '.join(f'c{i}' for i in range(k))} FROM {last})")
    return ",\n".join(out)


def level_tree_sql(src: str, features: list[str], key: list[str], n_classes: int, depth: int, n_trees: int = 1, m: int | None = None) -> str:
    """CTEs r0.., st0.., b0.. and ``nodes`` of trees with Gini scores on ``src`` (features, key, label); weights are drawn for two trees or more."""
    from ..functions.hashing import hash_hex_sql, hash_unit_sql
    from ..operators.trees import poisson_steps
    k = range(n_classes)
    u = hash_unit_sql(hash_hex_sql([*key, "tree"], 42, "bootstrap"))
    w = " + ".join(f"CASE WHEN u >= {p!r} THEN 1 ELSE 0 END" for p in poisson_steps()) if n_trees > 1 else "1"
    cols = ", ".join(features)
    sums = ", ".join(f"sum(CASE WHEN label = {c} THEN w ELSE 0 END) AS s{c}" for c in k)

    def score(names):
        d = [f"CAST({x} AS DOUBLE)" for x in names]
        return "((" + " + ".join(f"{x} * {x}" for x in d) + ") / (" + " + ".join(d) + "))"

    ctes = [f"""r0 AS (SELECT * FROM (SELECT *, {w} AS w FROM (SELECT tree, '' AS node, {cols}, label, {u} AS u
  FROM {src}, range({n_trees}) t(tree))) WHERE w > 0)"""]
    for d in range(depth + 1):
        ctes.append(f"st{d} AS (SELECT tree, node, count(*) AS n_rows, {sums} FROM r{d} GROUP BY tree, node)")
        if d == depth:
            break
        long = " UNION ALL ".join(f"SELECT tree, node, label, w, {i} AS f, CAST({c} AS DOUBLE) AS v FROM r{d}" for i, c in enumerate(features))
        drawn = f"row_number() OVER (PARTITION BY tree, node ORDER BY {hash_hex_sql(['tree', 'node', 'f'], 42, 'features')}) <= {m or len(features)}"
        run = "OVER (PARTITION BY tree, node, f ORDER BY v ROWS UNBOUNDED PRECEDING)"
        impure = " + ".join(f"CASE WHEN st{d}.s{c} > 0 THEN 1 ELSE 0 END" for c in k)
        both = score([f"l{c}" for c in k]) + " + " + score([f"(st{d}.s{c} - l{c})" for c in k])
        ctes += [f"u{d} AS ({long})",
                 f"d{d} AS (SELECT tree, node, f FROM (SELECT tree, node, f FROM u{d} GROUP BY tree, node, f HAVING min(v) < max(v)) QUALIFY {drawn})",
                 f"h{d} AS (SELECT tree, node, f, v, {sums} FROM u{d} JOIN d{d} USING (tree, node, f) GROUP BY tree, node, f, v)",
                 f"c{d} AS (SELECT tree, node, f, v, {', '.join(f'sum(s{c}) {run} AS l{c}' for c in k)}, "
                 f"lead(v) OVER (PARTITION BY tree, node, f ORDER BY v) AS nx FROM h{d})",
                 f"""b{d} AS (SELECT tree, node, f, CASE WHEN v / 2 + nx / 2 < nx THEN v / 2 + nx / 2 ELSE v END AS th, {both} AS score
  FROM c{d} JOIN st{d} USING (tree, node) WHERE nx IS NOT NULL AND {impure} > 1
  QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY score DESC, f, th) = 1)""",
                 f"r{d + 1} AS (SELECT tree, node || CASE WHEN {walk_value(features)} <= th THEN '0' ELSE '1' END AS node, {cols}, label, w "
                 f"FROM r{d} JOIN b{d} USING (tree, node))"]
    own = score([f"s{c}" for c in k])
    per = [f"SELECT tree, node, n_rows, {', '.join(f's{c}' for c in k)}, {'f' if d < depth else 'NULL'} AS f, {'th' if d < depth else 'NULL'} AS th, "
           f"{f'score - {own}' if d < depth else 'NULL'} AS gain FROM st{d}" + (f" LEFT JOIN b{d} USING (tree, node)" if d < depth else "") for d in range(depth + 1)]
    ctes.append("nodes AS (" + " UNION ALL ".join(per) + ")")
    return ",\n".join(ctes)


def walk_value(features: list[str]) -> str:
    """The value of the feature numbered f."""
    return "CASE f " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(features)) + " END"
