"""Flow documents made from the warehouse tables and lifted by the flow source, as registered queries with DuckDB SQL.

A nation is a flow, its customers are steps with a check each, their orders are transitions.  Texts name parameters deeper than the configuration
knows them, so every reference is resolved by its longest known prefix or reported.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..sources import flows
from ..sources.lift import Graph
from ..sources.reports import graph_of
from .question_bank import ask


def _quoted(*parts: str | Column) -> Column:
    """A text as JSON; the tables' names and words need no escapes."""
    return F.concat(F.lit('"'), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit('"'))


def _facts(rows: DataFrame, entry: Column, **values: Column) -> DataFrame:
    """scope, file, fact and value for each value of an entry that isn't null; __ in a name stands for a point."""
    each = [F.struct(F.concat(entry, F.lit(name.replace("__", "."))).alias("fact"), value.alias("value")) for name, value in values.items()]
    found = rows.select(F.col("n_name").alias("scope"), F.explode(F.array(*each)).alias("x"))
    return found.where("x.value IS NOT NULL").select("scope", F.lit("flow.json").alias("file"), "x.fact", "x.value")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flows' facts(scope, file, fact, value)."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    nation, segment, key = table("nation"), F.lower("c_mktsegment"), F.col("c_custkey")
    customer = table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table("orders").join(customer, F.col("o_custkey") == key)
    step, none = F.concat(F.lit("c"), key.cast("string")), F.lit("")
    parts = [
        _facts(nation, none, id=_quoted(F.col("n_name")), title=_quoted("The flow of ", F.col("n_name")), config__seg=F.when(F.col("n_nationkey") % 2 == 0, F.lit("0")), config__rush=F.when(F.col("n_nationkey") % 3 == 0, F.lit("5"))),
        _facts(customer.where("c_acctbal > 9000").select("n_name", segment.alias("s")).distinct(), F.concat(F.lit("config.seg."), "s"), **{"": F.lit("1")}),
        _facts(
            customer, F.concat(F.lit("nodes."), step, F.lit(".")), type=_quoted(F.when(key % 3 == 0, "human").otherwise("deterministic")), name=_quoted(F.col("c_name")), outcomes__bad=_quoted("refused"), metrics=F.when(key % 4 != 0, F.lit('["balance"]')),
            action__kind=_quoted(F.when(key % 5 == 0, "command").otherwise("human_review")), action__command=_quoted("python run.py config.seg.", segment), validations__v__kind=_quoted("metric"), validations__v__check=_quoted("metrics.balance <= config.seg.", segment, ".limit"), validations__v__on_fail=_quoted("bad"),
        ),
        _facts(orders, F.concat(F.lit("edges.e"), F.col("o_orderkey").cast("string"), F.lit(".")), **{"from": _quoted(step), "on": _quoted("bad"), "to": F.when(F.col("o_orderstatus") == "F", _quoted("$retry")).otherwise(_quoted(step)), "guard": F.when(F.col("o_orderpriority") == "1-URGENT", _quoted("state.total > 1 and config.rush.", F.lower("o_orderstatus"), " > 2"))}),
    ]
    return reduce(DataFrame.unionByName, parts)


def _stated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return flows.statements(cut(documents(spark, sf_dir)))


def flow_graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes of each class and edges of each relation the flows give."""
    return _stated(spark, sf_dir)[0].where("kind <> 'literal'").groupBy("kind", "name").agg(F.count("*").alias("n"))


def flow_parameter_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parameters that every step depends on, and through what (FL06) over the lifted flows."""
    graph: Graph = graph_of(_stated(spark, sf_dir)[0])
    return ask(graph, "FL06")["answer"]


def flow_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to parameters that no configuration has."""
    return _stated(spark, sf_dir)[1]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (flow_graph_counts, flow_parameter_uses, flow_unresolved)}

_WITH = """WITH c AS (SELECT n_name AS flow, n_nationkey, c_custkey AS k, lower(c_mktsegment) AS seg, c_acctbal, 'flow/' || n_name || '/step/c' || c_custkey AS step FROM customer JOIN nation ON c_nationkey = n_nationkey),
    o AS (SELECT *, 'flow/' || flow || '/edge/e' || o_orderkey AS edge FROM orders JOIN c ON o_custkey = k),
    known AS (SELECT DISTINCT flow, 'seg.' || seg AS prefix, '1' AS value FROM c WHERE c_acctbal > 9000 UNION SELECT n_name, 'seg', '0' FROM nation WHERE n_nationkey % 2 = 0 UNION SELECT n_name, 'rush', '5' FROM nation WHERE n_nationkey % 3 = 0),
    refs AS (SELECT flow, step, step || '/check/v' AS subject, 'comparedTo' AS rel, 'check' AS via, 'seg.' || seg || '.limit' AS name FROM c
        UNION ALL SELECT flow, step, step, 'usesParameter', 'command/action', 'seg.' || seg FROM c WHERE k % 5 = 0
        UNION ALL SELECT flow, step, edge, 'usesParameter', 'transition guard', 'rush.' || lower(o_orderstatus) FROM o WHERE o_orderpriority = '1-URGENT'),
    hits AS (SELECT flow, name, max_by(prefix, length(prefix)) AS prefix FROM (SELECT DISTINCT flow, name FROM refs) JOIN known USING (flow) WHERE name = prefix OR starts_with(name, prefix || '.') GROUP BY ALL),
    used AS (SELECT refs.*, prefix, value FROM refs LEFT JOIN hits USING (flow, name) LEFT JOIN known USING (flow, prefix))"""

ORACLES: dict[str, str] = {
    "flow_graph_counts": f"""{_WITH}, found AS (
        SELECT 'node' AS kind, 'Flow' AS name, n_name AS a, '' AS b FROM nation
        UNION ALL SELECT 'node', CASE WHEN k % 3 = 0 THEN 'HumanStep' ELSE 'DeterministicStep' END, step, '' FROM c
        UNION ALL SELECT 'node', unnest(['Outcome', 'Check', 'Metric']), step, '' FROM c
        UNION ALL SELECT 'node', 'Transition', edge, '' FROM o
        UNION ALL SELECT 'node', 'Implementation', flow, '' FROM c WHERE k % 5 = 0
        UNION ALL SELECT 'node', 'Parameter', flow, prefix FROM known
        UNION ALL SELECT 'node', 'Parameter', flow, coalesce(prefix, name) FROM used
        UNION ALL SELECT 'edge', unnest(['hasStep', 'hasOutcome', 'hasCheck', 'onFail', 'measures']), step, '' FROM c
        UNION ALL SELECT 'edge', 'records', step, '' FROM c WHERE k % 4 <> 0
        UNION ALL SELECT 'edge', 'implementedBy', step, '' FROM c WHERE k % 5 = 0
        UNION ALL SELECT 'edge', unnest(['from', 'onOutcome']), edge, '' FROM o
        UNION ALL SELECT 'edge', 'to', edge, '' FROM o WHERE o_orderstatus <> 'F'
        UNION ALL SELECT 'edge', rel, subject, coalesce(prefix, name) FROM used)
        SELECT kind, name, count(DISTINCT a || '|' || b) AS n FROM found GROUP BY ALL""",
    "flow_parameter_uses": f"""{_WITH} SELECT DISTINCT step AS param, prefix AS parameter, value, via FROM used WHERE prefix IS NOT NULL""",
    "flow_unresolved": f"""{_WITH} SELECT DISTINCT flow, subject, rel, name FROM used WHERE prefix IS NULL""",
}
