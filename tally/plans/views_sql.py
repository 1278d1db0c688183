"""SQL text of the fixture views, portable between Spark SQL and DuckDB.

Used to build oracle queries: ``with_views(sql, 'scored')`` prefixes the needed
views (and their dependencies) as CTEs, so the oracle reads only the raw tables.
"""

from __future__ import annotations

VIEW_SQL = {
    "risk_raw": """
SELECT o_orderkey AS id, c_mktsegment AS segment,
       CASE WHEN o_orderkey % 997 = 0 THEN 'Other' ELSE o_orderpriority END AS priority,
       o_orderstatus AS status, CAST(o_orderkey % 2 AS INT) AS flag_a, o_totalprice AS amount,
       CASE WHEN o_orderkey % 25 = 0 THEN NULL WHEN o_orderkey % 40 = 1 THEN 'N/A'
            ELSE CAST(CAST(ROUND(c_acctbal * 100) AS BIGINT) AS VARCHAR) END AS balance_txt,
       CASE WHEN (o_orderkey * 37) % 100 < (CASE WHEN o_totalprice > 375000 THEN 28 ELSE 9 END) THEN 1 ELSE 0 END AS y
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "scored": """
SELECT id, m.model AS model, r.rep AS repeat, CAST(FLOOR(id / CAST(100 AS DOUBLE)) AS INT) % 10 AS fold,
       CASE WHEN CAST(FLOOR(id / CAST(100 AS DOUBLE)) AS INT) % 10 < 7 THEN 'train'
            WHEN CAST(FLOOR(id / CAST(100 AS DOUBLE)) AS INT) % 10 = 7 THEN 'val' ELSE 'test' END AS split, y,
       CAST((id * 37 + m.k * 13 + r.rep * 7) % 71 + y * m.boost AS DOUBLE) / CAST(100 AS DOUBLE) AS score
FROM risk_raw
CROSS JOIN (SELECT 'm1' AS model, 1 AS k, 29 AS boost UNION ALL SELECT 'm2', 2, 20 UNION ALL SELECT 'm3', 3, 8) m
CROSS JOIN (SELECT 1 AS rep UNION ALL SELECT 2 UNION ALL SELECT 3) r""",
    "history": """
SELECT event_type AS run, CAST(EXTRACT(DAY FROM ts) AS INT) AS epoch, ROUND(AVG(value), 6) AS val_loss,
       ROUND(AVG(CASE WHEN value > 50 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS val_auc,
       COUNT(*) AS n
FROM events GROUP BY event_type, CAST(EXTRACT(DAY FROM ts) AS INT)""",
    "slices": """
SELECT user_id AS study_id, event_id AS slice_id, ts AS z_pos, CASE WHEN value > 245 THEN 1 ELSE 0 END AS label,
       CASE WHEN value > 490 THEN CAST(1 AS DOUBLE) ELSE value / 490 END AS slice_score, event_id % (SELECT COUNT(*) FROM embeddings) AS vec_id
FROM events""",
    "trials": """
SELECT p_brand AS model, CAST(p_partkey AS INT) AS run,
       CAST(FLOOR(p_partkey / CAST(10 AS DOUBLE)) AS INT) % 3 + 1 AS repeat,
       p_type AS param_a, CAST(p_size % 3 AS VARCHAR) AS param_b
FROM part""",
    "fits": """
SELECT 'm' || CAST(l_linenumber % 2 + 1 AS VARCHAR) AS model, l_orderkey AS fit, l_quantity AS seconds FROM lineitem""",
    "doc_risk": """
SELECT d.doc_id AS id, lang, source, n_chars, toxic AS y, quality
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "tiles": """
SELECT vec_id AS id, embedding AS px, CASE WHEN label = 0 THEN 1 ELSE 0 END AS y FROM embeddings""",
    "image_paths": """
SELECT doc_id AS id, 'images' || chr(92) || source || chr(92) || CAST(doc_id AS VARCHAR) || '.png' AS image_path
FROM documents""",
}

VIEW_DEPS = {"scored": ("risk_raw",)}


def with_views(sql: str, *views: str) -> str:
    """Prefix ``sql`` with the named fixture views (and their dependencies) as CTEs."""
    ordered: list[str] = []

    def add(v: str) -> None:
        for d in VIEW_DEPS.get(v, ()):
            add(d)
        if v not in ordered:
            ordered.append(v)

    for v in views:
        add(v)
    body = sql.strip()
    ctes = ",\n".join(f"{v} AS ({VIEW_SQL[v].strip()})" for v in ordered)
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
