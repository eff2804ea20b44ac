"""SQL oracle generator for drift (PSI numeric / categorical, KS, report)."""

from __future__ import annotations

from churnlens import config as C
from churnlens.operators.drift import KS_TERMS, LEVELS
from churnlens.plans.oracle import dbl, fx

_LEVELS = "[" + ", ".join(repr(v) for v in LEVELS) + "]::DOUBLE[]"


def drift_ctes(tag: str, ref_sql: str, cur_sql: str, numeric: list[str], categorical: list[str]):
    """CTEs ``{tag}r``, ``{tag}c`` and per-feature ``{tag}num`` / ``{tag}cat`` tables
    ``(feature, psi[, n_ref, n_cur, ks_d, ks_pvalue])``."""
    r, c = f"{tag}r", f"{tag}c"
    ctes = [(r, ref_sql), (c, cur_sql)]
    nums, cats = [], []
    for i, f in enumerate(numeric):
        e, b = f"{tag}e{i}", f"{tag}b{i}"
        x = f"CAST({f} AS DOUBLE)"
        ctes += [
            (e, f"SELECT list_sort(list_distinct(quantile_cont({x}, {_LEVELS}))) AS e FROM {r} WHERE {f} IS NOT NULL"),
            (b, f"""
SELECT side, x, len(list_filter(e[2:len(e) - 1], lambda v: v <= x)) AS b
FROM (SELECT 'e' AS side, {x} AS x FROM {r} WHERE {f} IS NOT NULL
      UNION ALL SELECT 'a', {x} FROM {c} WHERE {f} IS NOT NULL) CROSS JOIN {e}"""),
        ]
        psi = f"""
SELECT '{f}' AS feature,
       CASE WHEN (SELECT len(e) FROM {e}) - 2 < 1 THEN {dbl(0.0)} ELSE sum((a_s - e_s) * ln(a_s / e_s)) END AS psi
FROM (SELECT g.b, greatest(coalesce(k.ne, 0) / t.te, {dbl(C.SHARE_FLOOR)}) AS e_s,
             greatest(coalesce(k.na, 0) / t.ta, {dbl(C.SHARE_FLOOR)}) AS a_s
      FROM (SELECT unnest(range(0, greatest((SELECT len(e) FROM {e}) - 2, 0) + 1)) AS b) g
      LEFT JOIN (SELECT b, count(*) FILTER (WHERE side = 'e') AS ne, count(*) FILTER (WHERE side = 'a') AS na
                 FROM {b} GROUP BY b) k ON k.b = g.b
      CROSS JOIN (SELECT count(*) FILTER (WHERE side = 'e') AS te, count(*) FILTER (WHERE side = 'a') AS ta
                  FROM {b}) t)"""
        ks = f"""
SELECT max(abs(cr / nr - cc / nc)) AS d, max(nr) AS nr, max(nc) AS nc FROM (
  SELECT x, sum(kr) OVER w AS cr, sum(kc) OVER w AS cc,
         (SELECT count(*) FILTER (WHERE side = 'e') FROM {b}) AS nr,
         (SELECT count(*) FILTER (WHERE side = 'a') FROM {b}) AS nc
  FROM (SELECT x, count(*) FILTER (WHERE side = 'e') AS kr, count(*) FILTER (WHERE side = 'a') AS kc
        FROM {b} GROUP BY x)
  WINDOW w AS (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
        z = "(sqrt(CAST(nr AS DOUBLE) * nc / (nr + nc)) * d)"
        series = (f"(SELECT sum(CASE WHEN k % 2 = 1 THEN {dbl(1.0)} ELSE {dbl(-1.0)} END "
                  f"* exp({dbl(-2.0)} * k * k * {z} * {z})) FROM (SELECT unnest(range(1, {KS_TERMS + 1})) AS k))")
        ctes += [(f"{tag}ks{i}", ks), (f"{tag}ps{i}", psi)]
        nums.append(f"""
SELECT p.feature, p.psi, CAST(s.nr AS BIGINT) AS n_ref, CAST(s.nc AS BIGINT) AS n_cur, s.d AS ks_d,
       CASE WHEN {z} < {dbl(0.2)} THEN {dbl(1.0)}
            ELSE least({dbl(1.0)}, greatest({dbl(0.0)}, {dbl(2.0)} * {series})) END AS ks_pvalue
FROM {tag}ps{i} p CROSS JOIN {tag}ks{i} s""")
    for f in categorical:
        def share(src):
            return (f"SELECT CAST({f} AS VARCHAR) AS x, count(*) / (SELECT count(*) FROM {src} WHERE {f} IS NOT NULL) AS s "
                    f"FROM {src} WHERE {f} IS NOT NULL GROUP BY 1")
        cats.append(f"""
SELECT '{f}' AS feature, sum((a - e) * ln(a / e)) AS psi FROM (
  SELECT greatest(coalesce(e.s, {dbl(0.0)}), {dbl(C.SHARE_FLOOR)}) AS e,
         greatest(coalesce(a.s, {dbl(0.0)}), {dbl(C.SHARE_FLOOR)}) AS a
  FROM ({share(r)}) e FULL OUTER JOIN ({share(c)}) a ON a.x = e.x)""")
    if nums:
        ctes.append((f"{tag}num", " UNION ALL ".join(nums)))
    if cats:
        ctes.append((f"{tag}cat", " UNION ALL ".join(cats)))
    return ctes


def report_sql(tag: str, has_num: bool, has_cat: bool) -> str:
    parts = []
    if has_num:
        parts.append(f"""
SELECT feature, 'numeric' AS type, {fx('psi', 3)} AS psi, {fx('ks_pvalue', 4)} AS ks_pvalue,
       (psi > {dbl(C.PSI_THRESHOLD)} OR ks_pvalue < {dbl(C.KS_PVALUE_THRESHOLD)}) AS drift FROM {tag}num""")
    if has_cat:
        parts.append(f"""
SELECT feature, 'categorical' AS type, {fx('psi', 3)} AS psi, CAST(NULL AS DOUBLE) AS ks_pvalue,
       (psi > {dbl(C.PSI_THRESHOLD)}) AS drift FROM {tag}cat""")
    return " UNION ALL ".join(parts)
