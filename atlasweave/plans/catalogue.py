"""The registered queries over the warehouse tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.text import after, digest, joined, normalised
from ..operators import atlas, contract, ledger, lookup, projection, questions, recursion, rules, shapes, validation, walk
from ..operators.patterns import Edge, Either, Label, Maybe, Node, NotEdge, Value, Where, match
from ..operators.running import in_order
from ..sources import adjacency, documents, export, postings
from ..sources.lift import Graph, lift
from . import stores
from .graph_sql import EDGES, LEDGER, LITERALS, NODES, replayed, within

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- patterns ---------------------------------------------------------------------------------------------------------


@query(f"WITH {NODES} SELECT type, count(*) AS n FROM nodes GROUP BY ALL")
def nodes_by_class(spark, sf_dir):
    return atlas.by_class(lift(spark, sf_dir))


@query(f"WITH {EDGES}, {LITERALS} SELECT rel AS property, count(*) AS n FROM edges GROUP BY ALL UNION ALL SELECT pred, count(*) FROM literals GROUP BY ALL")
def edges_by_property(spark, sf_dir):
    return atlas.by_property(lift(spark, sf_dir))


@query("""SELECT 'customer/' || c_custkey AS c, c_name AS customer, n_name AS nation, r_name AS region
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def bgp_customer_region(spark, sf_dir):
    found = match(lift(spark, sf_dir), [Node("c", "Customer"), Edge("c", "inNation", "n"), Edge("n", "inRegion", "r"), Label("n", "nation", "Nation"), Label("r", "region", "Region"), Label("c", "customer", "Customer")])
    return found.select("c", "customer", "nation", "region")


@query("""SELECT 'customer/' || c_custkey AS c, 'nation/' || c_nationkey AS n, 'order/' || o_orderkey AS o, o_orderstatus AS status
    FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') ON o_custkey = c_custkey""")
def bgp_optional_order(spark, sf_dir):
    urgent = Maybe((Edge("o", "placedBy", "c"), Value("o", "priority", "p"), Where(F.col("p") == "1-URGENT"), Value("o", "status", "status")))
    return match(lift(spark, sf_dir), [Node("c", "Customer"), Edge("c", "inNation", "n"), urgent]).select("c", "n", "o", "status")


@query("""SELECT 'customer/' || c_custkey AS c, count(DISTINCT o_orderkey) AS orders, count(p) AS parts FROM customer LEFT JOIN orders ON o_custkey = c_custkey
    LEFT JOIN (SELECT DISTINCT l_orderkey, l_partkey AS p FROM lineitem) ON l_orderkey = o_orderkey GROUP BY ALL""")
def nested_optional(spark, sf_dir):
    found = match(lift(spark, sf_dir), [Node("c", "Customer"), Maybe((Edge("o", "placedBy", "c"), Maybe((Edge("o", "hasPart", "p"),))))])
    return found.groupBy("c").agg(F.countDistinct("o").alias("orders"), F.count("p").alias("parts"))


@query("""SELECT 'nation/' || k AS n, role, count(*) AS members FROM (SELECT c_nationkey AS k, 'customer' AS role FROM customer
    UNION ALL SELECT s_nationkey, 'supplier' FROM supplier) GROUP BY ALL""")
def union_roles(spark, sf_dir):
    roles = Either("role", {"customer": (Node("m", "Customer"), Edge("m", "inNation", "n")), "supplier": (Node("m", "Supplier"), Edge("m", "inNation", "n"))})
    return match(lift(spark, sf_dir), [roles]).groupBy("n", "role").agg(F.count("*").alias("members"))


@query("SELECT 'order/' || o_orderkey AS o FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def gap_orders_without_lines(spark, sf_dir):
    return match(lift(spark, sf_dir), [Node("o", "Order"), NotEdge("o", "hasPart", "*")])


@query(f"""WITH {EDGES} SELECT 'supplier/' || s_suppkey AS s FROM supplier WHERE 'supplier/' || s_suppkey NOT IN (SELECT dst FROM edges WHERE rel = 'suppliedBy')
    UNION ALL SELECT 'part/' || p_partkey FROM part WHERE 'part/' || p_partkey NOT IN (SELECT src FROM edges WHERE rel = 'suppliedBy') AND 'part/' || p_partkey NOT IN (SELECT dst FROM edges WHERE rel = 'hasPart')
    UNION ALL SELECT 'customer/' || c_custkey FROM customer WHERE 'customer/' || c_custkey NOT IN (SELECT dst FROM edges WHERE rel = 'placedBy')""")
def chained_not_exists(spark, sf_dir):
    g = lift(spark, sf_dir)
    parts = match(g, [Node("s", "Part"), NotEdge("s", "suppliedBy", "*"), NotEdge("*", "hasPart", "s")])
    return match(g, [Node("s", "Supplier"), NotEdge("*", "suppliedBy", "s")]).unionByName(parts).unionByName(match(g, [Node("s", "Customer"), NotEdge("*", "placedBy", "s")]))


@query("""SELECT 'customer/' || c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')
    OR NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def not_exists_or(spark, sf_dir):
    g = lift(spark, sf_dir)
    placed = lambda pred, value: match(g, [Value("o", pred, "v"), Where(F.col("v") == value), Edge("o", "placedBy", "c")]).select("c").distinct().withColumn(pred, F.lit(True))
    every = match(g, [Node("c", "Customer")]).join(placed("status", "F"), "c", "left").join(placed("priority", "1-URGENT"), "c", "left")
    return every.where("status IS NULL OR priority IS NULL").select("c")


@query("""SELECT 'order/' || o_orderkey AS o, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'soon' ELSE 'later' END AS pace,
    CASE WHEN contains(o_orderpriority, '-') THEN substring(o_orderpriority, instr(o_orderpriority, '-') + 1) ELSE '' END AS word, coalesce(nullif(o_orderstatus, 'P'), 'pending') AS status FROM orders""")
def bind_if_in(spark, sf_dir):
    found = match(lift(spark, sf_dir), [Value("o", "priority", "p"), Value("o", "status", "s")])
    return found.select("o", F.when(F.col("p").isin("1-URGENT", "2-HIGH"), "soon").otherwise("later").alias("pace"), after(F.col("p"), "-").alias("word"), F.coalesce(F.nullif("s", F.lit("P")), F.lit("pending")).alias("status"))


@query("SELECT r_name AS region, coalesce(string_agg(n_name, ', ' ORDER BY n_name), '') AS nations FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL")
def group_concat_nations(spark, sf_dir):
    found = match(lift(spark, sf_dir), [Node("r", "Region"), Label("r", "region", "Region"), Maybe((Edge("n", "inRegion", "r"), Label("n", "nation", "Nation")))])
    return found.groupBy("region").agg(joined(F.col("nation")).alias("nations"))


@query("""WITH s AS (SELECT DISTINCT c_nationkey AS k, c_mktsegment AS v FROM customer) SELECT 'nation/' || a.k AS n, 'nation/' || b.k AS other, count(DISTINCT a.v) AS shared,
    string_agg(DISTINCT a.v, ', ' ORDER BY a.v) AS segments FROM s a JOIN s b ON a.v = b.v AND a.k <> b.k GROUP BY ALL""")
def shared_values_segments(spark, sf_dir):
    held = match(lift(spark, sf_dir), [Value("c", "segment", "v"), Edge("c", "inNation", "n")]).select("n", "v").distinct()
    pairs = held.join(held.withColumnRenamed("n", "other"), "v").where("n <> other")
    return pairs.groupBy("n", "other").agg(F.countDistinct("v").alias("shared"), joined(F.col("v")).alias("segments"))


@query("""WITH s AS (SELECT l_partkey AS k, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ALL) SELECT p_brand AS brand, count(DISTINCT p_partkey) AS parts, min(p_name) AS sample,
    CAST(sum(coalesce(suppliers, 0)) AS BIGINT) AS suppliers FROM part LEFT JOIN s ON k = p_partkey GROUP BY ALL""")
def registry_sample(spark, sf_dir):
    g = lift(spark, sf_dir)
    suppliers = match(g, [Edge("p", "suppliedBy", "s")]).groupBy("p").agg(F.countDistinct("s").alias("k"))
    found = match(g, [Value("p", "brand", "brand"), Label("p", "name", "Part")]).join(suppliers, "p", "left")
    return found.groupBy("brand").agg(F.countDistinct("p").alias("parts"), F.min("name").alias("sample"), F.sum(F.coalesce("k", F.lit(0))).alias("suppliers"))


@query("""SELECT event_id, user_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 THEN 'yes' END AS latest FROM events""")
def latest_flag_events(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    last = events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("last")).select("user_id", "last.event_id", F.lit("yes").alias("latest"))
    return events.join(last, ["user_id", "event_id"], "left").select("event_id", "user_id", "latest")


# -- questions and briefs ---------------------------------------------------------------------------------------------

DELIVERED = questions.Question(
    "delivered",
    lambda g: match(g, [Edge("o", "placedBy", "param"), Edge("o", "hasPart", "p")]).select("param", "o").distinct(),
    lambda g: match(g, [Edge("o", "placedBy", "param"), NotEdge("o", "hasPart", "*")]),
)
URGENT = questions.Question("urgent", lambda g: match(g, [Edge("o", "placedBy", "param"), Value("o", "priority", "v"), Where(F.col("v") == "1-URGENT")]))
FAILED = questions.Question("failed", lambda g: match(g, [Edge("o", "placedBy", "param"), Value("o", "status", "v"), Where(F.col("v") == "P")]), gate="empty")
BRIEFS = [questions.Brief("bill", ("delivered",)), questions.Brief("rush", ("delivered", "urgent"), ("failed",)), questions.Brief("close", ("delivered", "failed"))]

STATUS_SQL = """
    per AS (
        SELECT 'customer/' || c_custkey AS param, count(DISTINCT CASE WHEN k IS NOT NULL THEN o_orderkey END) AS delivered, count(CASE WHEN o_orderkey IS NOT NULL AND k IS NULL THEN 1 END) AS undelivered,
            count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS urgent, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS failed
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) ON k = o_orderkey GROUP BY ALL
    ), statuses AS (
        SELECT param, 'delivered' AS question, delivered AS answers, undelivered AS gaps, CASE WHEN undelivered > 0 THEN 'gap' WHEN delivered = 0 THEN 'empty' ELSE 'answered' END AS status FROM per
        UNION ALL SELECT param, 'urgent', urgent, 0, CASE WHEN urgent = 0 THEN 'empty' ELSE 'answered' END FROM per
        UNION ALL SELECT param, 'failed', failed, 0, CASE WHEN failed > 0 THEN 'violated' ELSE 'clean' END FROM per
    ), tasks(task, question) AS (VALUES ('bill', 'delivered'), ('rush', 'delivered'), ('rush', 'urgent'), ('close', 'delivered'), ('close', 'failed')
    ), verdicts AS (
        SELECT param, task, coalesce(string_agg(CASE WHEN status NOT IN ('answered', 'clean') THEN question END, ', ' ORDER BY question), '') AS blockers FROM statuses JOIN tasks USING (question) GROUP BY ALL
    )"""


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = lift(spark, sf_dir)
    return questions.statuses([DELIVERED, URGENT, FAILED], g, match(g, [Node("param", "Customer")]))


@query(f"WITH {STATUS_SQL} SELECT * FROM statuses")
def status_question(spark, sf_dir):
    return _statuses(spark, sf_dir)


@query(f"WITH {STATUS_SQL} SELECT param, task, CASE WHEN blockers = '' THEN 'READY' ELSE 'BLOCKED' END AS verdict, blockers FROM verdicts")
def briefs(spark, sf_dir):
    return questions.readiness(_statuses(spark, sf_dir), BRIEFS)


@query(f"""WITH {STATUS_SQL} SELECT param, {", ".join(f"max(CASE WHEN task = '{t}' THEN CASE WHEN blockers = '' THEN 'READY' ELSE 'BLOCKED' END END) AS {t}" for t in ("bill", "rush", "close"))}
    FROM verdicts GROUP BY ALL""")
def readiness_matrix(spark, sf_dir):
    return questions.readiness_matrix(_statuses(spark, sf_dir), BRIEFS)


# -- constraints ------------------------------------------------------------------------------------------------------

SHAPES = [
    shapes.Shape("Order", (shapes.Count("hasPart", least=1, severity="Warning"), shapes.Count("hasPart", most=6), shapes.one_of("priority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"], "Warning"), shapes.Count("placedBy", 1, 1))),
    shapes.Shape("Part", (shapes.pattern("brand", r"^Brand#\d$"), shapes.between("size", 1, 45), shapes.length("partType", 6, "Warning"), shapes.HasValue("brand", "Brand#13", wanted=False))),
    shapes.Shape("Customer", (shapes.HasValue("segment", "BUILDING", severity="Warning"), shapes.ExactlyOne(("segment", "brand")))),
]
SHAPE_SQL = f"""
    {NODES}, {EDGES}, {LITERALS}, parts AS (SELECT id, count(dst) AS n FROM nodes LEFT JOIN edges ON src = id AND rel = 'hasPart' WHERE type = 'Order' GROUP BY ALL),
    found AS (
        SELECT 'Warning' AS severity, 'Order' AS type, id AS focus, 'hasPart' AS path, 'fewer than 1 values' AS message FROM parts WHERE n < 1
        UNION ALL SELECT 'Violation', 'Order', id, 'hasPart', 'more than 6 values' FROM parts WHERE n > 6
        UNION ALL SELECT 'Warning', 'Order', subj, 'priority', 'value not in the list' FROM literals WHERE pred = 'priority' AND value NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')
        UNION ALL SELECT 'Violation', 'Part', subj, 'brand', 'value without ^Brand#\\d$' FROM literals WHERE pred = 'brand' AND NOT regexp_matches(value, '^Brand#[0-9]$')
        UNION ALL SELECT 'Violation', 'Part', subj, 'size', 'not within 1..45' FROM literals WHERE pred = 'size' AND NOT coalesce(TRY_CAST(value AS DOUBLE) BETWEEN 1 AND 45, false)
        UNION ALL SELECT 'Warning', 'Part', subj, 'partType', 'shorter than 6' FROM literals WHERE pred = 'partType' AND length(value) < 6
        UNION ALL SELECT 'Violation', 'Part', subj, 'brand', 'has Brand#13' FROM literals WHERE pred = 'brand' AND value = 'Brand#13'
        UNION ALL SELECT 'Warning', 'Customer', subj, 'segment', 'lacks BUILDING' FROM literals WHERE pred = 'segment' AND value <> 'BUILDING'
    )"""


@query(f"WITH {SHAPE_SQL} SELECT * FROM found")
def shape_findings(spark, sf_dir):
    return shapes.check(lift(spark, sf_dir), SHAPES)


@query(f"""WITH {SHAPE_SQL}, numbered AS (SELECT *, row_number() OVER (PARTITION BY severity, type, path, message ORDER BY focus) AS k, count(*) OVER (PARTITION BY severity, type, path, message) AS n FROM found)
    SELECT severity, type, path, message, n, string_agg(focus, ',' ORDER BY focus) AS subjects FROM numbered WHERE k <= 5 GROUP BY ALL""")
def shape_report(spark, sf_dir):
    return shapes.grouped(shapes.check(lift(spark, sf_dir), SHAPES))


@query(f"""WITH {SHAPE_SQL} SELECT count(*) FILTER (severity = 'Violation') AS violations, count(*) FILTER (severity <> 'Violation') AS warnings,
    CASE WHEN count(*) FILTER (severity = 'Violation') > 0 THEN 'blocked' WHEN count(*) > 0 THEN 'incomplete' ELSE 'complete' END AS status FROM found""")
def shape_conforms(spark, sf_dir):
    return shapes.conforms(shapes.check(lift(spark, sf_dir), SHAPES))


@query(f"""WITH {EDGES}, {LITERALS} SELECT 'order/' || o_orderkey AS focus FROM orders
    WHERE CAST(EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS INT) + CAST(o_orderstatus = 'P' AS INT) <> 1""")
def shape_xone(spark, sf_dir):
    g = lift(spark, sf_dir)
    pending = g.literals.where("pred <> 'status' OR value = 'P'").withColumn("pred", F.when(F.col("pred") == "status", "pending").otherwise(F.col("pred")))
    return shapes.check(Graph(g.nodes, g.edges, pending), [shapes.Shape("Order", (shapes.ExactlyOne(("hasPart", "pending")),))]).select("focus")


@query("""WITH n AS (SELECT CAST(l_orderkey AS VARCHAR) || '/' || l_linenumber AS k FROM lineitem) SELECT k AS line, count(*) AS n FROM n GROUP BY ALL HAVING count(*) > 1""")
def shape_unique_lines(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").select(F.concat(F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string")).alias("line"))
    return lines.groupBy("line").agg(F.count("*").alias("n")).where("n > 1")


ORDER_SCHEMA = {
    "type": "object",
    "properties": {
        "status": {"enum": ["O", "F"]}, "priority": {"type": "string", "pattern": "^[1-4]-"}, "price": {"type": "number", "maximum": 250000}, "buyer": {"$ref": "#/$defs/buyer"}, "note": {"type": "string", "minLength": 12},
    },
    "required": ["status", "note"], "additionalProperties": False,
    "if": {"properties": {"status": {"const": "F"}}}, "then": {"required": ["price"]},
    "$defs": {"buyer": {"type": "object", "properties": {"id": {"type": "integer"}}, "required": ["id", "name"]}},
}


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents: a note stands for high priorities only, a price for cheap ones, and a flag that no schema knows for late ones."""
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    fact = lambda path, value: F.struct(F.lit(path).alias("fact"), value.alias("value"))
    orders = _table(spark, sf_dir, "orders")
    found = F.array(
        fact("status", text(F.col("o_orderstatus"))), fact("priority", text(F.col("o_orderpriority"))), fact("buyer.id", F.col("o_custkey").cast("string")), fact("price", F.when(F.col("o_totalprice") < 400000, F.floor("o_totalprice").cast("string"))),
        fact("note", F.when(F.col("o_orderpriority") < "3", F.concat(F.lit('"about '), F.col("o_orderkey").cast("string"), F.lit('"')))), fact("late", F.when(F.year("o_orderdate") >= 1998, F.lit("true"))),
    )
    rows = orders.select(F.concat(F.lit("order/"), F.col("o_orderkey").cast("string")).alias("scope"), F.lit("order.json").alias("file"), F.explode(found).alias("x"))
    return rows.select("scope", "file", "x.*").where("value IS NOT NULL")


@query("""WITH o AS (SELECT 'order/' || o_orderkey AS scope, o_orderstatus AS status, o_orderpriority AS priority, floor(o_totalprice) AS price, o_totalprice < 400000 AS priced, o_orderpriority < '3' AS noted, year(o_orderdate) >= 1998 AS late, length('about ' || o_orderkey) AS n FROM orders),
    f AS (SELECT scope, 'status' AS path, 'is not one of the options' AS message FROM o WHERE status NOT IN ('O', 'F') UNION ALL SELECT scope, 'priority', 'doesn''t match ^[1-4]-' FROM o WHERE priority >= '5'
    UNION ALL SELECT scope, 'price', 'is above the range' FROM o WHERE priced AND price > 250000 UNION ALL SELECT scope, 'note', 'is missing' FROM o WHERE NOT noted UNION ALL SELECT scope, 'note', 'is shorter than 12' FROM o WHERE noted AND n < 12
    UNION ALL SELECT scope, 'late', 'late isn''t declared' FROM o WHERE late UNION ALL SELECT scope, 'price', 'is missing with this status' FROM o WHERE status = 'F' AND NOT priced UNION ALL SELECT scope, 'buyer.name', 'is missing' FROM o)
    SELECT scope, 'error' AS severity, 'order.json' AS file, path, message FROM f""")
def schema_validation(spark, sf_dir):
    """Every order against a schema with types, options, ranges, a reference, a condition and undeclared keys."""
    return validation.validate(order_facts(spark, sf_dir), {"order": ORDER_SCHEMA})


LINE_CLAIMS = (
    validation.Claim("line", "defines", "lines", r"lines\.([^.]+)", "{1}"),
    validation.Claim("line", "uses", "orders", r"orders\.([^.]+)", "{1}", "the order has no line", "warn"),
    validation.Claim("rich", "defines", "buyers", r"buyers\.([^.]+)", "{1}", values=("rich",)),
    validation.Claim("rich", "uses", "orders", r"orders\.([^.]+)", "{v}", "an order of a buyer who isn't rich"),
)


@query("""WITH s AS (SELECT 'orders.json' AS file, 'warn' AS severity, 'orders.' || o_orderkey AS path, 'the order has no line: ' || o_orderkey AS message FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT 'orders.json', 'error', min('orders.' || o_orderkey), 'an order of a buyer who isn''t rich: ' || o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey) SELECT 'all' AS scope, severity, file, path, message FROM s""")
def reference_checks(spark, sf_dir):
    """Orders without lines, and buyers by their means: two roles of keys in one aggregation."""
    fact = lambda table, file, key, value: _table(spark, sf_dir, table).select(F.lit("all").alias("scope"), F.lit(f"{file}.json").alias("file"), F.concat(F.lit(f"{file}."), F.col(key).cast("string")).alias("fact"), value.alias("value"))
    rows = fact("orders", "orders", "o_orderkey", F.col("o_custkey").cast("string")).unionByName(fact("lineitem", "lines", "l_orderkey", F.lit("1")))
    return validation.unmet(rows.unionByName(fact("customer", "buyers", "c_custkey", F.when(F.col("c_acctbal") > 0, F.lit('"rich"')).otherwise(F.lit('"poor"')))), LINE_CLAIMS)


# -- time -------------------------------------------------------------------------------------------------------------


def event_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = in_order(_table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], place="revision")
    kind = F.when(F.col("event_type") == "error", "removed").when(F.col("revision") == 1, "baseline").otherwise("changed")
    return rows.select(
        F.col("user_id").cast("string").alias("scope"), "revision", F.col("ts").alias("at"), (F.col("ts") + F.make_dt_interval(F.col("event_id").cast("int") % 5)).alias("effective"),
        F.get_json_object("props", "$.k").alias("fact"), kind.alias("kind"), F.col("event_id").cast("string").alias("value"),
    )


@query(f"WITH {LEDGER}, {replayed('r', "effective <= TIMESTAMP '2024-01-15'")} SELECT * FROM r")
def replay_as_of(spark, sf_dir):
    return ledger.replay(event_ledger(spark, sf_dir), as_of="2024-01-15")


@query(f"WITH {LEDGER}, {replayed('r', "stamp <= TIMESTAMP '2024-01-20'")} SELECT * FROM r")
def replay_known_on(spark, sf_dir):
    return ledger.replay(event_ledger(spark, sf_dir), known_on="2024-01-20")


@query(f"WITH {LEDGER}, {replayed('r', "effective <= TIMESTAMP '2024-01-20' AND stamp <= TIMESTAMP '2024-01-18'")} SELECT * FROM r")
def replay_bitemporal(spark, sf_dir):
    return ledger.replay(event_ledger(spark, sf_dir), as_of="2024-01-20", known_on="2024-01-18")


@query(f"""WITH {LEDGER}, {replayed('a', "stamp <= TIMESTAMP '2024-01-10'")}, {replayed('b', "stamp <= TIMESTAMP '2024-01-20'")}, d AS (
    SELECT coalesce(a.scope, b.scope) AS scope, coalesce(a.fact, b.fact) AS fact, CASE WHEN a.scope IS NULL THEN 'added' WHEN b.scope IS NULL THEN 'removed' WHEN a.value IS DISTINCT FROM b.value THEN 'changed' END AS kind, a.value AS old, b.value AS new
    FROM a FULL JOIN b ON a.scope = b.scope AND a.fact = b.fact) SELECT * FROM d WHERE kind IS NOT NULL""")
def diff_snapshots(spark, sf_dir):
    changes = event_ledger(spark, sf_dir)
    return ledger.diff(ledger.replay(changes, known_on="2024-01-10"), ledger.replay(changes, known_on="2024-01-20"))


@query(f"""WITH {LEDGER}, k AS (SELECT *, row_number() OVER (PARTITION BY scope, fact ORDER BY revision DESC) AS k FROM ledger) SELECT scope, fact, value, stamp AS since FROM k WHERE k = 1 AND kind <> 'removed'""")
def last_set_since(spark, sf_dir):
    return ledger.last_set(event_ledger(spark, sf_dir))


@query(f"""WITH {LEDGER}, r AS (SELECT scope, revision + CAST(scope AS BIGINT) % 2 AS revision, stamp - to_days(CAST(revision % 7 = 0 AS INTEGER) * 9) AS stamp, fact, kind, value, CASE WHEN revision % 3 = 0 THEN value END AS previous FROM ledger),
    n AS (SELECT scope, revision, min(stamp) AS stamp, bool_or(kind = 'baseline') AS baseline FROM r GROUP BY ALL), m AS (SELECT *, row_number() OVER w AS place, max(stamp) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM n WINDOW w AS (PARTITION BY scope ORDER BY revision)),
    h AS (SELECT *, CASE WHEN lag(kind) OVER w <> 'removed' THEN lag(value) OVER w END AS held FROM r WINDOW w AS (PARTITION BY scope, fact ORDER BY revision))
    SELECT scope, revision, NULL AS fact, 'number' AS problem FROM m WHERE revision <> place UNION ALL SELECT scope, revision, NULL, 'time goes back' FROM m WHERE stamp < latest
    UNION ALL SELECT scope, revision, NULL, 'late baseline' FROM m WHERE baseline AND place > 1 UNION ALL SELECT scope, revision, fact, 'doesn''t start from the held value' FROM h WHERE kind <> 'baseline' AND previous IS DISTINCT FROM held""")
def ledger_integrity(spark, sf_dir):
    """Over a ledger with planted faults: shifted numbers, times that go back, and wrong previous values."""
    rows = event_ledger(spark, sf_dir).withColumn("previous", F.when(F.col("revision") % 3 == 0, F.col("value")))
    rows = rows.withColumn("at", F.col("at") - F.make_dt_interval(F.when(F.col("revision") % 7 == 0, 9).otherwise(0))).withColumn("revision", F.col("revision") + F.col("scope").cast("long") % 2)
    return ledger.integrity(rows)


LOG_SQL = "log AS (SELECT CAST(user_id AS VARCHAR) AS scope, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ts AS stamp, event_type AS status FROM events)"
STAGES = ["view", "click", "signup", "purchase"]


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = in_order(_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], place="seq")
    return rows.select(F.col("user_id").cast("string").alias("scope"), "seq", F.col("ts").alias("at"), F.col("event_type").alias("status"))


@query(f"""WITH {LOG_SQL}, r AS (SELECT *, coalesce(list_position(['view', 'click', 'signup', 'purchase'], status), 0) AS rank FROM log), b AS (SELECT *, lag(rank) OVER (PARTITION BY scope ORDER BY seq) AS before FROM r),
    p AS (SELECT scope, seq, status, CASE WHEN rank = 0 THEN 'unknown status' WHEN before IS NULL AND rank <> 1 THEN 'first status' WHEN rank > before + 1 THEN 'skips a status' END AS problem FROM b) SELECT * FROM p WHERE problem IS NOT NULL""")
def lifecycle_violations(spark, sf_dir):
    return ledger.lifecycle(event_log(spark, sf_dir), STAGES)


@query(f"WITH {LOG_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY seq DESC) AS k FROM log) SELECT scope, status, seq FROM k WHERE k = 1")
def lifecycle_current(spark, sf_dir):
    return ledger.current_status(event_log(spark, sf_dir))


@query("SELECT event_id, key AS fact, CAST(json_extract_string(props, '$.' || key) AS VARCHAR) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def flatten_props(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return events.select("event_id", F.explode("m").alias("fact", "value"))


STALE_SQL = "SELECT '{0}' AS kind, {1} AS subject, CAST(datediff('day', CAST({2} AS DATE), DATE '{3}') AS INTEGER) AS age FROM {4} WHERE datediff('day', CAST({2} AS DATE), DATE '{3}') > {5}"


@query(
    " UNION ALL ".join(
        (
            STALE_SQL.format("open order", "'order/' || o_orderkey", "o_orderdate", "1998-08-02", "orders WHERE o_orderstatus = 'O'", 900).replace("'O' WHERE", "'O' AND"),
            STALE_SQL.format("idle user", "subject", "stamp", "1998-08-02", "(SELECT 'user/' || user_id AS subject, max(ts) AS stamp FROM events GROUP BY ALL)", 900),
            STALE_SQL.format("late line", "subject", "stamp", "1998-08-02", "(SELECT 'part/' || l_partkey AS subject, max(l_shipdate) AS stamp FROM lineitem GROUP BY ALL)", 900),
        )
    )
)
def stale_findings(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.concat(F.lit("order/"), F.col("o_orderkey").cast("string")).alias("subject"), F.col("o_orderdate").alias("at"))
    users = _table(spark, sf_dir, "events").groupBy(F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("subject")).agg(F.max("ts").alias("at"))
    parts = _table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("subject")).agg(F.max("l_shipdate").alias("at"))
    return atlas.stale({"open order": orders, "idle user": users, "late line": parts}, "1998-08-02", 900)


# -- navigation -------------------------------------------------------------------------------------------------------


def _start(spark: SparkSession, node: str) -> DataFrame:
    return spark.createDataFrame([(node,)], "id string")


@query(within("customer/1", 1, "out"))
def neighbors_out(spark, sf_dir):
    return walk.hops(lift(spark, sf_dir), _start(spark, "customer/1"), 1, "out")


@query(within("supplier/1", 2, "both"))
def neighbors_both_d2(spark, sf_dir):
    """From the edges stored by node; the others read the tables."""
    return adjacency.hops(stores.graph_links(spark, sf_dir), _start(spark, "supplier/1"), 2, "both")


@query(within("customer/1", 3, "both"))
def neighbors_both_d3(spark, sf_dir):
    return adjacency.hops(stores.graph_links(spark, sf_dir), _start(spark, "customer/1"), 3, "both")


@query(within("nation/1", 3, "in", "inNation"))
def neighbors_by_property(spark, sf_dir):
    return walk.hops(lift(spark, sf_dir), _start(spark, "nation/1"), 3, "in", "inNation")


@query(f"SELECT *, count(*) OVER () > 500 AS truncated FROM ({within('nation/1', 2, 'both')}) ORDER BY src, rel, dst LIMIT 500")
def neighbors_capped(spark, sf_dir):
    return walk.neighbors(lift(spark, sf_dir), _start(spark, "nation/1"), 2, "both")


@query(f"""WITH {NODES}, {EDGES}, {LITERALS}, l AS (SELECT src AS id, 'out' AS kind, rel AS name, dst AS other FROM edges WHERE src = 'part/1' UNION ALL SELECT dst, 'in', rel, src FROM edges WHERE dst = 'part/1')
    SELECT l.id, kind, name, other, label AS other_label, type AS other_type FROM l LEFT JOIN nodes n ON n.id = other UNION ALL SELECT subj, 'value', pred, value, NULL, NULL FROM literals WHERE subj = 'part/1'""")
def entity_card(spark, sf_dir):
    return adjacency.entity_card(stores.graph_links(spark, sf_dir), ["part/1"])


@query(f"""WITH {NODES}, {EDGES} SELECT node AS id, side AS kind, count(*) AS n, count(type) AS known FROM (SELECT src AS node, 'out' AS side, dst AS other FROM edges UNION ALL SELECT dst, 'in', src FROM edges)
    LEFT JOIN nodes ON id = other GROUP BY ALL""")
def stored_degrees(spark, sf_dir):
    """How many edges every node has at each side, and how many of their other ends are nodes."""
    return adjacency.degrees(stores.graph_links(spark, sf_dir))


def _names(g: Graph) -> DataFrame:
    return g.nodes.select("id", "type", F.col("label").alias("name"))


RESOLVE_SQL = """WITH {nodes}, s AS (SELECT id, type, label AS name, CASE WHEN lower(id) = '{q}' OR lower(regexp_extract(id, '[^/]*$')) = '{q}' THEN 3
    WHEN lower(trim(regexp_replace(label, '[\\s_\\-]+', ' ', 'g'))) = '{q}' THEN 2 WHEN regexp_matches(lower(trim(regexp_replace(label, '[\\s_\\-]+', ' ', 'g'))), '\\b{q}') THEN 1 ELSE 0 END AS score FROM nodes)
    SELECT id, type, name, CAST(score AS INTEGER) AS score, greatest(count(*) OVER () - {n}, 0) AS more FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT {n}"""


@query(RESOLVE_SQL.format(nodes=NODES, q="blue bolt", n=20))
def resolve_name(spark, sf_dir):
    return lookup.resolve(_names(lift(spark, sf_dir)), "Blue_bolt", limit=20)


@query(RESOLVE_SQL.format(nodes=NODES, q="wid", n=10))
def resolve_prefix(spark, sf_dir):
    return lookup.resolve(_names(lift(spark, sf_dir)), "wid")


@query(RESOLVE_SQL.format(nodes=NODES, q="blue bolt", n=20))
def indexed_resolve(spark, sf_dir):
    return postings.resolve(stores.graph_names(spark, sf_dir), "Blue_bolt", limit=20)


@query(RESOLVE_SQL.format(nodes=NODES, q="wid", n=10).replace("FROM nodes)", "FROM nodes WHERE type = 'Part')"))
def indexed_resolve_prefix(spark, sf_dir):
    return postings.resolve(stores.graph_names(spark, sf_dir), "wid", types=["Part"])


@query(f"""WITH {NODES}, names AS (SELECT id, type, label AS name FROM nodes UNION ALL SELECT id, type, CASE type WHEN 'Customer' THEN 'buyer ' ELSE 'vendor ' END || label FROM nodes WHERE type IN ('Customer', 'Supplier')),
    s AS (SELECT id, type, name, CASE WHEN regexp_matches(lower(name), '\\bvendor') THEN 1 ELSE 0 END AS score FROM names) SELECT id, type, name, score, greatest(count(*) OVER () - 10, 0) AS more FROM s WHERE score > 0 ORDER BY id LIMIT 10""")
def resolve_lexicon(spark, sf_dir):
    """A lexicon's other terms are further names of the nodes of a class."""
    names = _names(lift(spark, sf_dir))
    lexicon = spark.createDataFrame([("Customer", "buyer"), ("Supplier", "vendor")], "type string, term string")
    return lookup.resolve(names.unionByName(names.join(lexicon, "type").select("id", "type", F.concat_ws(" ", "term", "name").alias("name"))), "vendor")


@query()
def did_you_mean(spark, sf_dir):
    return lookup.did_you_mean(lift(spark, sf_dir).nodes_of(["Part"]).select(F.col("label").alias("name")), "bleu widgt")


def _search_sql(table: str, key: str, name: str, text: str, words: list[str], limit: int) -> str:
    hit = lambda c, w: f"regexp_matches({c}, '\\b{w}')"
    score = " + ".join(f"CASE WHEN {hit('n', w)} THEN 3 ELSE 1 END" for w in words)
    where = " AND ".join(f"({hit('n', w)} OR {hit('t', w)})" for w in words)
    phrase, first = " ".join(words), words[0]
    return f"""WITH r AS (SELECT {key} AS id, lower(coalesce({name}, '')) AS n, lower(coalesce({text}, '')) AS t, coalesce({text}, '') AS o FROM {table})
        SELECT id, CAST({score} + CASE WHEN contains(t, '{phrase}') THEN 5 ELSE 0 END AS INTEGER) AS score,
        substring(o, CAST(greatest((CASE WHEN contains(t, '{phrase}') THEN instr(t, '{phrase}') ELSE greatest(instr(t, '{first}'), 1) END) - 40, 1) AS BIGINT), 160) AS snippet FROM r WHERE {where} ORDER BY score DESC, id LIMIT {limit}"""


@query(_search_sql("documents", "doc_id", "source", "text", ["the", "and"], 50))
def search_documents(spark, sf_dir):
    return lookup.search(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("name"), "text"), "The and", limit=50)


@query(_search_sql("pages", "page_id", "url", "html", ["example", "com"], 20))
def search_pages(spark, sf_dir):
    return lookup.search(_table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("name"), F.col("html").alias("text")), "example com", limit=20)


WORDS_SQL = """(SELECT 'document/' || doc_id AS id, 'document' AS type, lang AS scope, source AS name, text FROM documents
    UNION ALL SELECT 'page/' || page_id, 'page', CAST(page_id AS VARCHAR), url, html FROM pages)"""


def _indexed_sql(words: list[str], limit: int, where: str = "true") -> str:
    found = _search_sql(f"(SELECT * FROM {WORDS_SQL} WHERE {where})", "id", "name", "text", words, limit)
    return f"SELECT id, split_part(id, '/', 1) AS type, score, snippet FROM ({found})"


@query(_indexed_sql(["the", "and"], 50))
def indexed_search(spark, sf_dir):
    """Words of documents and pages, from the postings."""
    return postings.search(stores.document_words(spark, sf_dir), "The and", limit=50)


@query(_indexed_sql(["example", "com"], 20, "type = 'page'"))
def indexed_search_of_type(spark, sf_dir):
    return postings.search(stores.document_words(spark, sf_dir), "example com", types=["page"])


@query(_indexed_sql(["de", "la"], 30, "type = 'document' AND scope = 'fr'"))
def indexed_search_of_scope(spark, sf_dir):
    return postings.search(stores.document_words(spark, sf_dir), "de la", limit=30, types=["document"], scope="fr")


@query(r"""WITH w AS (SELECT DISTINCT 'document/' || doc_id AS id, 'document' AS type, unnest(regexp_extract_all(lower(coalesce(source, '') || ' ' || coalesce(text, '')), '[\p{L}\p{Nd}_]+')) AS word FROM documents
    UNION SELECT DISTINCT 'page/' || page_id, 'page', unnest(regexp_extract_all(lower(coalesce(url, '') || ' ' || coalesce(html, '')), '[\p{L}\p{Nd}_]+')) FROM pages) SELECT substring(word, 1, 64) AS word, type, count(DISTINCT id) AS n FROM w GROUP BY ALL""")
def indexed_words(spark, sf_dir):
    """How many documents and pages hold each word."""
    return stores.document_words(spark, sf_dir).read("words").groupBy("word", "type").agg(F.count("*").alias("n"))


# -- rules ------------------------------------------------------------------------------------------------------------

SUPPLIES = rules.Derive("supplies-region", "suppliesRegion", lambda g: match(g, [Edge("src", "inNation", "n"), Node("src", "Supplier"), Edge("n", "inRegion", "dst")]))


@query("SELECT DISTINCT 'supplier/' || s_suppkey AS src, 'suppliesRegion' AS rel, 'region/' || n_regionkey AS dst FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def derive_supplies_region(spark, sf_dir):
    return rules.derived(lift(spark, sf_dir), [SUPPLIES])


@query("""WITH RECURSIVE p AS (SELECT 'nation/' || n_nationkey AS src, 'region/' || n_regionkey AS dst FROM nation UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey FROM customer
    UNION ALL SELECT 'order/' || o_orderkey, 'customer/' || o_custkey FROM orders), c AS (SELECT * FROM p UNION SELECT c.src, p.dst FROM c JOIN p ON c.dst = p.src) SELECT * FROM c""")
def closure_within(spark, sf_dir):
    g = lift(spark, sf_dir)
    return rules.closure(match(g, [Edge("src", "placedBy|inRegion", "dst")]).unionByName(match(g, [Node("src", "Customer"), Edge("src", "inNation", "dst")])))


@query("""WITH w AS (SELECT 'order/' || o_orderkey AS src, 'customer/' || o_custkey AS c, 'nation/' || c_nationkey AS n, 'region/' || n_regionkey AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    d AS (SELECT src, c AS dst FROM w UNION SELECT src, n FROM w UNION SELECT src, r FROM w UNION SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey FROM customer UNION SELECT 'customer/' || c_custkey, 'region/' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey FROM nation UNION SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey FROM supplier UNION SELECT 'supplier/' || s_suppkey, 'region/' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT split_part(dst, '/', 1) AS kind, count(*) AS n FROM d GROUP BY ALL""")
def derive_fixpoint(spark, sf_dir):
    base = recursion.Rule("within", "within", (Edge("src", "placedBy|inNation|inRegion", "dst"),))
    step = recursion.Rule("within-within", "within", (Edge("src", "within", "mid"), Edge("mid", "within", "dst")))
    found = recursion.evaluate(lift(spark, sf_dir), [base, step]).edges_of("within")
    return found.groupBy(F.substring_index("dst", "/", 1).alias("kind")).agg(F.count("*").alias("n"))


MARKET = [
    recursion.Rule("wanted-in-nation", "wantedIn", (Edge("o", "hasPart", "src"), Edge("o", "placedBy", "c"), Edge("c", "inNation", "dst"))),
    recursion.Rule("wanted-above", "wantedIn", (Edge("src", "wantedIn", "place"), Edge("place", "inRegion", "dst"))),
    recursion.Rule("offered-in-nation", "offeredIn", (Edge("src", "suppliedBy", "s"), Edge("s", "inNation", "dst"))),
    recursion.Rule("offered-above", "offeredIn", (Edge("src", "offeredIn", "place"), Edge("place", "inRegion", "dst"))),
    recursion.Rule("unwanted", "unwantedIn", (Edge("src", "offeredIn", "dst"), NotEdge("src", "wantedIn", "dst"))),
]


@query("""WITH RECURSIVE up AS (SELECT 'nation/' || n_nationkey AS place, 'region/' || n_regionkey AS above FROM nation),
    wanted AS (SELECT DISTINCT 'part/' || l_partkey AS part, 'nation/' || c_nationkey AS place FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey UNION SELECT part, above FROM wanted JOIN up USING (place)),
    offered AS (SELECT DISTINCT 'part/' || l_partkey AS part, 'nation/' || s_nationkey AS place FROM lineitem JOIN supplier ON s_suppkey = l_suppkey UNION SELECT part, above FROM offered JOIN up USING (place))
    SELECT part AS src, 'unwantedIn' AS rel, place AS dst FROM offered WHERE NOT EXISTS (SELECT 1 FROM wanted w WHERE w.part = offered.part AND w.place = offered.place)""")
def derive_unwanted(spark, sf_dir):
    """Two recursive relations and one that negates one of them."""
    return recursion.evaluate(lift(spark, sf_dir), MARKET).edges_of("unwantedIn")


POLICIES = [
    rules.Policy("order-has-lines", "blocking", lambda g: match(g, [Node("subject", "Order"), NotEdge("subject", "hasPart", "*")]).withColumn("message", F.lit("no line"))),
    rules.Policy("pending-urgent", "warn", lambda g: match(g, [Value("subject", "priority", "p"), Where(F.col("p") == "1-URGENT"), Value("subject", "status", "s"), Where(F.col("s") == "P")]).withColumn("message", F.concat(F.lit("urgent, but "), "s"))),
]


@query("""SELECT 'order-has-lines' AS policy, 'blocking' AS severity, 'order/' || o_orderkey AS subject, 'no line' AS message FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT 'pending-urgent', 'warn', 'order/' || o_orderkey, 'urgent, but P' FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'""")
def policy_findings(spark, sf_dir):
    return rules.findings(lift(spark, sf_dir), POLICIES)


@query("""WITH w AS (SELECT DISTINCT l_partkey AS p, l_shipdate AS d, l_suppkey AS s FROM lineitem) SELECT 'part/' || a.p AS part, 'supplier/' || a.s AS one, 'supplier/' || b.s AS other, strftime(a.d, '%Y-%m-%d') AS day FROM w a JOIN w b ON a.p = b.p AND a.d = b.d AND a.s < b.s""")
def parallel_conflict(spark, sf_dir):
    """Two suppliers that ship one part on one day: an equi-join with itself on (part, day)."""
    lines = _table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_suppkey").distinct()
    both = lines.join(lines.withColumnRenamed("l_suppkey", "o"), ["l_partkey", "l_shipdate"]).where("l_suppkey < o")
    named = lambda kind, c: F.concat(F.lit(f"{kind}/"), F.col(c).cast("string"))
    return both.select(named("part", "l_partkey").alias("part"), named("supplier", "l_suppkey").alias("one"), named("supplier", "o").alias("other"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))


@query("""SELECT 'order/' || o_orderkey || '/test/' || v AS id, 'covers' AS rel, 'order/' || o_orderkey AS dst, CASE v WHEN 'pass' THEN 'accepts ' ELSE 'refuses ' END || o_orderpriority AS text FROM orders, (VALUES ('pass'), ('fail')) t(v)""")
def construct_tests(spark, sf_dir):
    """Two new nodes for each order, with ids minted from its own."""
    found = match(lift(spark, sf_dir), [Value("dst", "priority", "p")])
    minted = F.explode(F.array(*[F.struct(F.concat("dst", F.lit(f"/test/{v}")).alias("id"), F.concat(F.lit(f"{verb} "), "p").alias("text")) for v, verb in (("pass", "accepts"), ("fail", "refuses"))]))
    return found.select("dst", minted.alias("t")).select("t.id", F.lit("covers").alias("rel"), "dst", "t.text")


# -- projections and export -------------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT n_regionkey AS k, list({'label': n_name, 'id': 'nation/' || n_nationkey} ORDER BY n_name) AS nations FROM nation GROUP BY ALL)
    SELECT 'region/' || r_regionkey AS id, CAST(to_json({'id': 'region/' || r_regionkey, 'label': r_name, 'nations': coalesce(nations, [])}) AS VARCHAR) AS document FROM region LEFT JOIN n ON k = r_regionkey""")
def projection_region_nations(spark, sf_dir):
    return projection.as_json(projection.project(lift(spark, sf_dir), "Region", (projection.Follow("nations", "inRegion", "in"),)))


@query("""WITH s AS (SELECT s_nationkey AS k, list({'label': s_name, 'id': 'supplier/' || s_suppkey} ORDER BY s_name) AS suppliers FROM supplier GROUP BY ALL),
    n AS (SELECT n_regionkey AS k, list({'label': n_name, 'id': 'nation/' || n_nationkey, 'suppliers': coalesce(suppliers, [])} ORDER BY n_name) AS nations FROM nation LEFT JOIN s ON s.k = n_nationkey GROUP BY ALL)
    SELECT 'region/' || r_regionkey AS id, CAST(to_json({'id': 'region/' || r_regionkey, 'label': r_name, 'nations': coalesce(nations, [])}) AS VARCHAR) AS document FROM region LEFT JOIN n ON k = r_regionkey""")
def projection_nested(spark, sf_dir):
    follow = projection.Follow("nations", "inRegion", "in", (projection.Follow("suppliers", "inNation", "in", type="Supplier"),))
    return projection.as_json(projection.project(lift(spark, sf_dir), "Region", (follow,)))


@query(f"""WITH {NODES}, {LITERALS}, p AS (SELECT subj, '{{' || string_agg('"' || pred || '":["' || value || '"]', ',' ORDER BY pred) || '}}' AS properties FROM literals GROUP BY ALL)
    SELECT id, type, label, coalesce(properties, '{{}}') AS properties FROM nodes LEFT JOIN p ON subj = id""")
def export_nodes(spark, sf_dir):
    return export.node_rows(lift(spark, sf_dir))


@query(f"WITH {EDGES} SELECT DISTINCT src AS source, rel AS property, dst AS target FROM edges")
def export_edges(spark, sf_dir):
    return export.edge_rows(lift(spark, sf_dir))


@query(f"WITH {NODES}, {EDGES} SELECT src, rel, dst, 'source' AS \"end\" FROM edges WHERE src NOT IN (SELECT id FROM nodes) UNION ALL SELECT src, rel, dst, 'target' FROM edges WHERE dst NOT IN (SELECT id FROM nodes)")
def export_dangling(spark, sf_dir):
    return export.dangling(lift(spark, sf_dir))


# -- change control ---------------------------------------------------------------------------------------------------

TERM_SQL = """
    {name} AS (
        SELECT p_brand || '/' || p_name AS term, CASE WHEN min(p_size) <= 12 THEN 'data' ELSE 'object' END AS kind, list_sort(list_distinct(list(p_type))) AS domain, list_sort(list_distinct(list('size ' || p_size // 10))) AS range,
            CASE WHEN count(*) > 3 THEN min(p_type) END AS inverse, max(p_type) AS label, CAST(max(p_size) AS VARCHAR) AS definition FROM part WHERE {which} GROUP BY p_brand, p_name
    )"""
CHANGE_SQL = f"""
    {TERM_SQL.format(name="old", which="p_size <= 40")}, {TERM_SQL.format(name="new", which="p_size > 10")},
    b AS (SELECT coalesce(o.term, n.term) AS term, o, n FROM old o FULL JOIN new n ON o.term = n.term),
    changes AS (
        SELECT term, 'removed' AS change, 'breaking' AS severity FROM b WHERE n.term IS NULL
        UNION ALL SELECT term, 'added', 'additive' FROM b WHERE o.term IS NULL
        UNION ALL SELECT term, 'kind', 'breaking' FROM b WHERE o.kind <> n.kind
        {" ".join(f"UNION ALL SELECT term, '{x} narrowed', 'breaking' FROM b WHERE n.term IS NOT NULL AND o.term IS NOT NULL AND NOT list_has_all(n.{x}, o.{x}) UNION ALL SELECT term, '{x} widened', 'additive' FROM b WHERE n.term IS NOT NULL AND o.term IS NOT NULL AND list_has_all(n.{x}, o.{x}) AND len(n.{x}) > len(o.{x})" for x in ("domain", "range"))}
        {" ".join(f"UNION ALL SELECT term, '{x}', '{severity}' FROM b WHERE n.term IS NOT NULL AND o.term IS NOT NULL AND n.{x} IS DISTINCT FROM o.{x}" for x, severity in (("inverse", "additive"), ("label", "cosmetic"), ("definition", "cosmetic")))}
    )"""


def part_terms(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """A vocabulary of parts' names by brand: types as domains, sizes as ranges; two editions of it hold smaller and larger parts."""
    parts = _table(spark, sf_dir, "part").where(which)
    sizes = F.concat(F.lit("size "), F.floor(F.col("p_size") / 10).cast("string"))
    return parts.groupBy(F.concat("p_brand", F.lit("/"), "p_name").alias("term")).agg(
        F.when(F.min("p_size") <= 12, "data").otherwise("object").alias("kind"), F.array_sort(F.collect_set("p_type")).alias("domain"), F.array_sort(F.collect_set(sizes)).alias("range"),
        F.when(F.count("*") > 3, F.min("p_type")).alias("inverse"), F.max("p_type").alias("label"), F.max("p_size").cast("string").alias("definition"),
    )


def _term_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract.term_changes(part_terms(spark, sf_dir, "p_size <= 40"), part_terms(spark, sf_dir, "p_size > 10"))


@query(f"WITH {CHANGE_SQL} SELECT * FROM changes")
def contract_diff(spark, sf_dir):
    """All changes between the two editions of the vocabulary of parts."""
    return _term_changes(spark, sf_dir)


@query(f"""WITH {CHANGE_SQL}, v AS (SELECT p_brand AS vocabulary, count(DISTINCT p_type) - 4 AS a, min(p_size) % 3 AS b, max(p_size) % 2 AS c FROM part GROUP BY ALL),
    w AS (SELECT split_part(term, '/', 1) AS vocabulary, min(CASE severity WHEN 'breaking' THEN 0 WHEN 'additive' THEN 1 ELSE 2 END) AS rank FROM changes GROUP BY ALL),
    p AS (SELECT *, CASE WHEN rank IS NULL THEN 3 ELSE least(rank + CAST(a = 0 AS INTEGER), 2) END AS place FROM v LEFT JOIN w USING (vocabulary))
    SELECT vocabulary, a || '.' || b || '.' || c AS old, (a + c) || '.' || (b + 1) || '.0' AS new, CASE rank WHEN 0 THEN 'breaking' WHEN 1 THEN 'additive' WHEN 2 THEN 'cosmetic' ELSE 'none' END AS worst,
        CASE place WHEN 0 THEN (a + 1) || '.0.0' WHEN 1 THEN a || '.' || (b + 1) || '.0' WHEN 2 THEN a || '.' || b || '.' || (c + 1) ELSE a || '.' || b || '.' || c END AS required, CASE place WHEN 0 THEN a + c >= a + 1 ELSE true END AS ok FROM p""")
def semver_gate(spark, sf_dir):
    """Each brand's vocabulary, whose version numbers come from its parts, against its worst change."""
    changes = _term_changes(spark, sf_dir).select(F.substring_index("term", "/", 1).alias("vocabulary"), "severity")
    parts = _table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("vocabulary")).agg((F.countDistinct("p_type") - 4).alias("a"), (F.min("p_size") % 3).alias("b"), (F.max("p_size") % 2).alias("c"))
    dotted = lambda *steps: F.concat_ws(".", *[s.cast("string") for s in steps])
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return contract.version_gate(changes, parts.select("vocabulary", dotted(a, b, c).alias("old"), dotted(a + c, b + 1, F.lit(0)).alias("new")))


@query(f"WITH {CHANGE_SQL} SELECT term, change, count(p_partkey) AS n FROM changes LEFT JOIN part ON p_brand || '/' || p_name = term WHERE severity = 'breaking' GROUP BY ALL")
def impact_parts(spark, sf_dir):
    """How many parts each breaking change affects."""
    return contract.impact(_term_changes(spark, sf_dir), _table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("/"), "p_name").alias("term")))


TERMS = "term string, kind string, domain array<string>, range array<string>, inverse string, label string, definition string"
OLD_TERMS = [
    ("placedBy", "object", ["Order"], ["Customer", "Supplier"], None, "placed by", "who ordered"),
    ("segment", "data", ["Customer"], ["string"], None, "segment", "market segment"),
    ("brand", "data", ["Part"], ["string"], None, "brand", "brand of a part"),
]
NEW_TERMS = [
    ("inNation", "object", ["Customer", "Supplier"], ["Nation"], None, "in nation", "where it is"),
    ("placedBy", "object", ["Order"], ["Customer"], "placed", "placed by", "who ordered"),
    ("segment", "object", ["Customer"], ["string"], None, "market segment", "market segment"),
    ("hasPart", "object", ["Order"], ["Part"], None, "has part", "what an order holds"),
    ("suppliedBy", "object", ["Part"], ["Supplier"], None, "supplied by", "who supplies"),
]
BREAKING = [("placedBy", "range narrowed"), ("segment", "kind"), ("brand", "removed")]


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in r) + ")" for r in rows)


@query(f"WITH {EDGES}, {LITERALS}, u AS (SELECT rel AS term FROM edges UNION ALL SELECT pred FROM literals) SELECT term, change, count(u.term) AS n FROM (VALUES {_values(BREAKING)}) t(term, change) LEFT JOIN u USING (term) GROUP BY ALL")
def impact_counts(spark, sf_dir):
    g = lift(spark, sf_dir)
    changes = contract.term_changes(spark.createDataFrame(OLD_TERMS, TERMS), spark.createDataFrame(NEW_TERMS, TERMS))
    return contract.impact(changes, g.edges.select(F.col("rel").alias("term")).unionByName(g.literals.select(F.col("pred").alias("term"))))


@query("SELECT p_brand AS \"group\", count(*) AS total, count(*) FILTER (p_size > 20) AS reasoned, count(*) FILTER (p_type <> 'SMALL') AS validated, round(count(*) FILTER (p_size > 20) / count(*), 4) AS share FROM part GROUP BY ALL")
def rationale_coverage(spark, sf_dir):
    parts = _table(spark, sf_dir, "part")
    return contract.coverage(parts.select(F.col("p_brand").alias("group"), F.when(F.col("p_size") > 20, F.col("p_name")).otherwise(F.lit(" ")).alias("rationale"), F.when(F.col("p_type") != "SMALL", F.col("p_type")).alias("validated_by")))


@query(f"WITH {EDGES}, {LITERALS} SELECT DISTINCT rel AS term FROM (SELECT rel FROM edges UNION ALL SELECT pred FROM literals) WHERE rel NOT IN ({', '.join(repr(t[0]) for t in NEW_TERMS)})")
def undeclared_terms(spark, sf_dir):
    g = lift(spark, sf_dir)
    return contract.undeclared(g.edges.select(F.col("rel").alias("term")).unionByName(g.literals.select(F.col("pred").alias("term"))), spark.createDataFrame(NEW_TERMS, TERMS))


@query("SELECT p_name AS term, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS units, CASE WHEN count(DISTINCT p_type) > 1 THEN 'clash' ELSE 'shared' END AS kind FROM part GROUP BY ALL HAVING count(DISTINCT p_brand) > 1")
def composition_clashes(spark, sf_dir):
    return contract.clashes(_table(spark, sf_dir, "part").select(F.col("p_brand").alias("unit"), F.col("p_name").alias("term"), F.col("p_type").alias("definition")))


# -- text and overview ------------------------------------------------------------------------------------------------


@query("SELECT 'part/' || p_partkey AS id, lower(trim(regexp_replace(p_name || '__' || p_type || ' - ' || p_brand, '[\\s_\\-]+', ' ', 'g'))) AS name FROM part")
def name_normalise(spark, sf_dir):
    return _table(spark, sf_dir, "part").select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("id"), normalised(F.concat("p_name", F.lit("__"), "p_type", F.lit(" - "), "p_brand")).alias("name"))


@query("SELECT conv_id, turn, sha1(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS digest FROM conversations")
def query_digest(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", digest(F.col("text")).alias("digest"))


@query("SELECT p_name, count(*) AS n FROM part GROUP BY ALL ORDER BY n DESC, p_name LIMIT 10")
def overview_topk(spark, sf_dir):
    return atlas.top(_table(spark, sf_dir, "part"), "p_name", 10)


@query("SELECT p_brand AS value, count(DISTINCT p_partkey) AS n FROM part GROUP BY ALL HAVING count(DISTINCT p_partkey) > 1")
def overview_shared(spark, sf_dir):
    return atlas.shared_values(lift(spark, sf_dir), "brand")


@query("""WITH n AS (SELECT DISTINCT replace(split_part(split_part(split_part(url, '#', 1), '?', 1), '://', 2), '/', '.') AS name FROM pages), k AS (SELECT name, string_split(name, '.') AS p FROM n),
    known AS (SELECT DISTINCT array_to_string(p[1:3], '.') AS prefix FROM k WHERE len(p) % 2 = 0 UNION SELECT DISTINCT array_to_string(p[1:2], '.') FROM k)
    SELECT name, max_by(prefix, length(prefix)) AS prefix FROM k JOIN known ON name = prefix OR starts_with(name, prefix || '.') GROUP BY ALL""")
def param_longest_prefix(spark, sf_dir):
    path = F.element_at(F.split(F.split(F.split("url", "#")[0], r"\?")[0], "://"), 2)
    names = _table(spark, sf_dir, "pages").select(F.replace(path, F.lit("/"), F.lit(".")).alias("name")).distinct()
    parts = F.split("name", r"\.")
    known = names.where(F.size(parts) % 2 == 0).select(F.array_join(F.slice(parts, 1, 3), ".").alias("prefix")).unionByName(names.select(F.array_join(F.slice(parts, 1, 2), ".").alias("prefix")))
    return atlas.longest_prefix(names, known)


@query("SELECT page_id AS id, unnest(list_distinct(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >]', 1))) AS found FROM pages")
def mentions_tags(spark, sf_dir):
    return atlas.mentions(_table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text")), "<([a-z][a-z0-9]*)[ >]")


@query("""WITH v AS (SELECT 'type' AS field, event_type AS value FROM events UNION ALL SELECT 'value', CAST(value AS VARCHAR) FROM events UNION ALL SELECT 'day', strftime(ts, '%Y-%m-%d') FROM events),
    t AS (SELECT field, CASE WHEN regexp_matches(value, '^-?[0-9]+([.][0-9]+)?$') THEN 'number' WHEN regexp_matches(value, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN 'date' ELSE 'text' END AS type FROM v WHERE value IS NOT NULL)
    SELECT field, CASE WHEN count(DISTINCT type) = 1 THEN max(type) ELSE 'text' END AS type, count(*) AS n FROM t GROUP BY ALL""")
def skeleton_types(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), c.alias("value")) for n, c in (("type", F.col("event_type")), ("value", F.col("value").cast("string")), ("day", F.date_format("ts", "yyyy-MM-dd")))]))
    return documents.skeleton(events.select(each.alias("x")).select("x.field", "x.value"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's status for each question, and what blocks each task."""
    found = cut(_statuses(spark, sf_dir))
    return found.join(questions.readiness(found, BRIEFS), "param")
