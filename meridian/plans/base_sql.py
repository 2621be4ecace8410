"""Common table expressions for the SQL twins of registered queries, over the driver's views."""

from __future__ import annotations

EARLY = "1995-06-01"

CTES = {
    "cust": "SELECT c_custkey AS key, r_name || '/' || n_name || '/' || c_name || '.md' AS path, c_name AS basename, c_mktsegment AS tag FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "supp": "SELECT s_suppkey AS key, r_name || '/' || n_name || '/' || s_name || '.md' AS path, s_name AS basename FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "notes": "SELECT path AS id, basename, tag FROM cust UNION ALL SELECT path, basename, NULL FROM supp",
    "lines": "SELECT cust.path AS c, supp.path AS s, l_returnflag AS flag, l_shipdate AS shipped FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN cust ON o_custkey = cust.key JOIN supp ON l_suppkey = supp.key",
    "links": "SELECT CASE WHEN flag = 'R' THEN s ELSE c END AS src, CASE WHEN flag = 'R' THEN c ELSE s END AS dst, count(*)::DOUBLE AS w FROM lines GROUP BY 1, 2",
    "early_links": f"SELECT CASE WHEN flag = 'R' THEN s ELSE c END AS src, CASE WHEN flag = 'R' THEN c ELSE s END AS dst, count(*)::DOUBLE AS w FROM lines WHERE shipped < TIMESTAMP '{EARLY}' GROUP BY 1, 2",
    "edges": "SELECT *, fwd + bwd AS weight FROM (SELECT least(src, dst) AS src_id, greatest(src, dst) AS dst_id, sum(CASE WHEN src < dst THEN w ELSE 0 END)::DOUBLE AS fwd, sum(CASE WHEN src > dst THEN w ELSE 0 END)::DOUBLE AS bwd FROM links GROUP BY 1, 2)",
    "early": "SELECT *, fwd + bwd AS weight FROM (SELECT least(src, dst) AS src_id, greatest(src, dst) AS dst_id, sum(CASE WHEN src < dst THEN w ELSE 0 END)::DOUBLE AS fwd, sum(CASE WHEN src > dst THEN w ELSE 0 END)::DOUBLE AS bwd FROM early_links GROUP BY 1, 2)",
    "deg": "SELECT id, count(*) AS degree, sum(weight) AS weighted_degree FROM (SELECT src_id AS id, weight FROM edges UNION ALL SELECT dst_id, weight FROM edges) GROUP BY id",
    "nodes": "SELECT n.id, basename, tag, coalesce(degree, 0) AS degree, coalesce(weighted_degree, 0) AS weighted_degree FROM notes n LEFT JOIN deg d ON n.id = d.id",
    "files": "SELECT 'parts/' || p_partkey || '.pdf' AS id, p_name AS basename FROM part",
    "file_edges": "SELECT supp.path AS src_id, 'parts/' || l_partkey || '.pdf' AS dst_id, count(*)::DOUBLE AS weight FROM lineitem JOIN supp ON l_suppkey = supp.key GROUP BY 1, 2",
    "page_paths": "SELECT regexp_extract(url, '://[^/]*/([^?#]*)', 1) AS src, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS dst FROM pages",
    "hrefs": "SELECT src, dst, count(*)::DOUBLE AS w FROM page_paths GROUP BY 1, 2",
    "pos0": "SELECT vec_id AS idx, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label AS owner, (vec_id % 7 + 1)::DOUBLE AS w FROM embeddings",
    "pos": "SELECT idx::INT AS idx, x / n AS x, y / n AS y, z / n AS z, owner, w FROM (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM pos0) WHERE n > 1e-12",
    "ev": "SELECT user_id AS key, ts, event_type AS reason FROM events",
}

NEEDS = {
    "notes": ("cust", "supp"), "lines": ("cust", "supp"), "links": ("lines",), "early_links": ("lines",), "edges": ("links",), "early": ("early_links",), "deg": ("edges",),
    "nodes": ("notes", "deg"), "file_edges": ("supp",), "hrefs": ("page_paths",), "pos": ("pos0",),
}


def with_(*names: str, recursive: bool = False, **more: str) -> str:
    """WITH name AS (...), ...: the named expressions and those that they need, then further ones."""
    out: list[str] = []

    def need(n: str) -> None:
        for m in NEEDS.get(n, ()):
            need(m)
        if n not in out:
            out.append(n)

    for n in names:
        need(n)
    parts = [f"{n} AS ({CTES[n]})" for n in out] + [f"{n} AS ({s})" for n, s in more.items()]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(parts) + " "
