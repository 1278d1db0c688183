"""Oracle-side SQL snippets shared by several catalogue entries (DuckDB dialect)."""

from __future__ import annotations

from tally.plans.registry import dsql


def held_out_quota_ctes(prefix: str, src: str, grp: list[str], cls: str, cnt: str, frac: float, out: str) -> str:
    """CTEs ending in ``{prefix}_q``: ``src`` columns plus ``out`` = held-out class quota.

    keep = largest-remainder allocation of n - ceil(frac * n) over classes.
    """
    part = f"PARTITION BY {', '.join(grp)}" if grp else ""
    tot = f"SUM({cnt}) OVER ({part})"
    draws = f"({tot} - CEIL({dsql(frac)} * CAST({tot} AS DOUBLE)))"
    return f"""{prefix}_a AS (
  SELECT *, CAST({cnt} AS DOUBLE) / CAST({tot} AS DOUBLE) * CAST({draws} AS DOUBLE) AS {prefix}_cont,
         {draws} AS {prefix}_draws FROM {src}),
{prefix}_b AS (
  SELECT *, {prefix}_draws - SUM(FLOOR({prefix}_cont)) OVER ({part}) AS {prefix}_need,
         ROW_NUMBER() OVER ({part} ORDER BY {prefix}_cont - FLOOR({prefix}_cont) DESC, {cls}) AS {prefix}_rk
  FROM {prefix}_a),
{prefix}_q AS (
  SELECT * EXCLUDE ({prefix}_cont, {prefix}_draws, {prefix}_need, {prefix}_rk),
         {cnt} - (CAST(FLOOR({prefix}_cont) AS BIGINT) + CASE WHEN {prefix}_rk <= {prefix}_need THEN 1 ELSE 0 END)
           AS {out}
  FROM {prefix}_b)"""


def md5_key(seed, id_col: str = "id") -> str:
    return f"md5('{seed}|' || CAST({id_col} AS VARCHAR))"


def stratified_split_ctes(src: str, label: str = "y", id_col: str = "id", test: float = 0.2, val: float = 0.1,
                          seed: int = 42, val_of_rest: bool = False, name: str = "splitted") -> str:
    """CTEs ending in ``name``: ``src`` plus a ``split`` column (R1 semantics)."""
    v = val if val_of_rest else val / (1 - test)
    return f"""ss_c AS (SELECT {label}, COUNT(*) AS ss_n FROM {src} GROUP BY {label}),
{held_out_quota_ctes('s1', 'ss_c', [], label, 'ss_n', test, 'q_test')},
s1_r AS (SELECT *, ss_n - q_test AS ss_rest FROM s1_q),
{held_out_quota_ctes('s2', 's1_r', [], label, 'ss_rest', v, 'q_val')},
ss_rank AS (SELECT s.*, ROW_NUMBER() OVER (PARTITION BY s.{label} ORDER BY {md5_key(seed, 's.' + id_col)}, s.{id_col}) AS ss_rk
            FROM {src} s),
{name} AS (
  SELECT r.* EXCLUDE (ss_rk),
         CASE WHEN ss_rk <= q.q_test THEN 'test' WHEN ss_rk <= q.q_test + q.q_val THEN 'val' ELSE 'train' END AS split
  FROM ss_rank r JOIN s2_q q ON r.{label} = q.{label})"""
