"""The warehouse graph in DuckDB SQL, for the oracles."""

EDGES = """
    edges AS (
        SELECT 'nation/' || n_nationkey AS src, 'inRegion' AS rel, 'region/' || n_regionkey AS dst FROM nation
        UNION ALL SELECT 'customer/' || c_custkey, 'inNation', 'nation/' || c_nationkey FROM customer
        UNION ALL SELECT 'supplier/' || s_suppkey, 'inNation', 'nation/' || s_nationkey FROM supplier
        UNION ALL SELECT 'order/' || o_orderkey, 'placedBy', 'customer/' || o_custkey FROM orders
        UNION ALL SELECT DISTINCT 'order/' || l_orderkey, 'hasPart', 'part/' || l_partkey FROM lineitem
        UNION ALL SELECT DISTINCT 'part/' || l_partkey, 'suppliedBy', 'supplier/' || l_suppkey FROM lineitem
    )"""

NODES = """
    nodes AS (
        SELECT 'region/' || r_regionkey AS id, 'Region' AS type, r_name AS label FROM region
        UNION ALL SELECT 'nation/' || n_nationkey, 'Nation', n_name FROM nation
        UNION ALL SELECT 'customer/' || c_custkey, 'Customer', c_name FROM customer
        UNION ALL SELECT 'supplier/' || s_suppkey, 'Supplier', s_name FROM supplier
        UNION ALL SELECT 'part/' || p_partkey, 'Part', p_name FROM part
        UNION ALL SELECT 'order/' || o_orderkey, 'Order', 'order/' || o_orderkey FROM orders
    )"""

LITERALS = """
    literals AS (
        SELECT 'customer/' || c_custkey AS subj, 'segment' AS pred, c_mktsegment AS value FROM customer
        UNION ALL SELECT 'part/' || p_partkey, 'brand', p_brand FROM part
        UNION ALL SELECT 'part/' || p_partkey, 'partType', p_type FROM part
        UNION ALL SELECT 'part/' || p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part
        UNION ALL SELECT 'order/' || o_orderkey, 'status', o_orderstatus FROM orders
        UNION ALL SELECT 'order/' || o_orderkey, 'priority', o_orderpriority FROM orders
    )"""

#: events as a ledger: each user's events in order are revisions; an error removes the fact that its property names.
LEDGER = """
    ledger AS (
        SELECT CAST(user_id AS VARCHAR) AS scope, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS revision, ts AS stamp,
            ts + to_days(CAST(event_id % 5 AS INTEGER)) AS effective, json_extract_string(props, '$.k') AS fact,
            CASE WHEN event_type = 'error' THEN 'removed' WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 THEN 'baseline' ELSE 'changed' END AS kind,
            CAST(event_id AS VARCHAR) AS value
        FROM events
    )"""


def replayed(name: str, condition: str) -> str:
    """Common table expression for the facts that hold among the ledger's rows that meet a condition."""
    return f"""
    {name} AS (
        SELECT l.scope, fact, value, revision FROM (
            SELECT *, row_number() OVER (PARTITION BY scope, fact ORDER BY revision DESC) AS k FROM ledger WHERE {condition}
        ) l LEFT JOIN (SELECT scope, max(revision) AS reset FROM ledger WHERE kind = 'baseline' AND {condition} GROUP BY ALL) b USING (scope)
        WHERE k = 1 AND kind <> 'removed' AND (reset IS NULL OR revision >= reset)
    )"""


def within(start: str, depth: int, direction: str, rel: str | None = None) -> str:
    """Query for the edges within some steps of a node, with the step that meets each first."""
    chosen = f"WHERE rel = '{rel}'" if rel else ""
    parts = []
    if direction != "in":
        parts.append(f"SELECT src AS here, dst AS there, src, rel, dst FROM edges {chosen}")
    if direction != "out":
        parts.append(f"SELECT dst AS here, src AS there, src, rel, dst FROM edges {chosen}")
    ctes = [EDGES, f"step AS ({' UNION ALL '.join(parts)})", f"f1 AS (SELECT '{start}' AS here)"]
    for k in range(1, depth + 1):
        ctes.append(f"m{k} AS (SELECT s.* FROM step s JOIN f{k} USING (here))")
        seen = " UNION ".join(f"SELECT here FROM f{j}" for j in range(1, k + 1))
        ctes.append(f"f{k + 1} AS (SELECT DISTINCT there AS here FROM m{k} WHERE there NOT IN ({seen}))")
    union = " UNION ALL ".join(f"SELECT src, rel, dst, {k} AS hop FROM m{k}" for k in range(1, depth + 1))
    return f"WITH {', '.join(ctes)} SELECT src, rel, dst, CAST(min(hop) AS INTEGER) AS hop FROM ({union}) GROUP BY ALL"
