"""Lifting tables to a property graph: nodes(id, type, label), edges(src, rel, dst), literals(subj, pred, value).

A specification names, for each table, how rows become nodes, and which columns become edges and literals.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache, partial, reduce
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Lift:
    """One node for each row: its class, id prefix and key; the label's column, literal columns, and edges to (prefix, column)."""

    table: str
    type: str
    key: str
    label: str | None = None
    literals: dict[str, str] = field(default_factory=dict)
    edges: dict[str, tuple[str, str]] = field(default_factory=dict)


@dataclass(frozen=True)
class Link:
    """Distinct edges between two key columns of a table whose rows are no nodes."""

    table: str
    rel: str
    source: tuple[str, str]
    target: tuple[str, str]


NODES, EDGES, LITERALS = "id string, type string, label string", "src string, rel string, dst string", "subj string, pred string, value string"
SCHEMAS = {"nodes": NODES, "edges": EDGES, "literals": LITERALS}


class Graph:
    """The tables nodes, edges and literals, whole or as parts by type, relation or property.

    A part is a function that gives a DataFrame, so a pattern opens and scans only what it names.  `more` are rows that the tables or parts have besides.
    """

    def __init__(self, nodes: DataFrame | None = None, edges: DataFrame | None = None, literals: DataFrame | None = None, parts: dict[str, dict[str, Callable[..., DataFrame]]] | None = None, spark: SparkSession | None = None, more: dict[str, dict[str, list[DataFrame]]] | None = None) -> None:
        self._whole, self.more = {"nodes": nodes, "edges": edges, "literals": literals}, more or {}
        self.parts, self.spark = parts or {}, spark or next(t for t in self._whole.values() if t is not None).sparkSession

    def _empty(self, table: str) -> DataFrame:
        return self.spark.createDataFrame([], SCHEMAS[table])

    def _table(self, table: str) -> DataFrame:
        if self._whole[table] is None:
            parts = [part() for part in self.parts.get(table, {}).values()]
            self._whole[table] = reduce(DataFrame.unionByName, parts) if parts else self._empty(table)
        return reduce(DataFrame.unionByName, chain(*self.more.get(table, {}).values()), self._whole[table])

    def _of(self, table: str, column: str, names: list[str]) -> DataFrame:
        parts, more = self.parts.get(table), self.more.get(table, {})
        found = [self._whole[table].where(F.col(column).isin(names))] if parts is None and self._whole[table] is not None else [parts[n]() for n in names if n in (parts or {})]
        found += [rows for n in names for rows in more.get(n, ())]
        return reduce(DataFrame.unionByName, found) if found else self._empty(table)

    @property
    def nodes(self) -> DataFrame:
        return self._table("nodes")

    @property
    def edges(self) -> DataFrame:
        return self._table("edges")

    @property
    def edges_repeated(self) -> DataFrame:
        """All edges, some more than once if that saves work: for readers that make them distinct themselves."""
        if not (parts := self.parts.get("repeated")):
            return self.edges
        return reduce(DataFrame.unionByName, [*(part() for part in parts.values()), *chain(*self.more.get("edges", {}).values())])

    @property
    def literals(self) -> DataFrame:
        return self._table("literals")

    def nodes_of(self, types: list[str]) -> DataFrame:
        return self._of("nodes", "type", types)

    def edges_of(self, rels: list[str]) -> DataFrame:
        return self._of("edges", "rel", rels)

    def literals_of(self, preds: list[str]) -> DataFrame:
        return self._of("literals", "pred", preds)

    def statements_of(self, type_: str, names: list[str]) -> DataFrame:
        """focus, name and value about the nodes of a class: a row without a name for each node, and one for each value and edge of the names.

        Rows about other nodes may be among them.  What a lifted table says about its rows comes from one scan of it.
        """
        if make := self.parts.get("statements", {}).get(type_):
            return make(names)
        nothing = F.lit(None).cast("string")
        nodes = self.nodes_of([type_]).select(F.col("id").alias("focus"), nothing.alias("name"), nothing.alias("value"))
        literals = self.literals_of(names).select(F.col("subj").alias("focus"), F.col("pred").alias("name"), "value")
        return nodes.unionByName(literals).unionByName(self.edges_of(names).select(F.col("src").alias("focus"), F.col("rel").alias("name"), F.col("dst").alias("value")))

    def with_edges(self, edges: DataFrame) -> Graph:
        """The same nodes and literals with other edges."""
        return Graph(self._whole["nodes"], edges, self._whole["literals"], {k: v for k, v in self.parts.items() if k not in ("edges", "repeated", "statements")}, self.spark, {k: v for k, v in self.more.items() if k != "edges"})

    def with_more(self, **rows: dict[str, DataFrame]) -> Graph:
        """The graph with further nodes, edges and literals, by their type, relation or property; nothing else of it is opened for them."""
        more = {t: {n: [*self.more.get(t, {}).get(n, ()), *([rows[t][n]] if n in rows.get(t, {}) else [])] for n in {**self.more.get(t, {}), **rows.get(t, {})}} for t in SCHEMAS}
        return Graph(*(self._whole[t] for t in SCHEMAS), {k: v for k, v in self.parts.items() if k != "statements"}, self.spark, more)


def node_id(prefix: str, key: str | Column) -> Column:
    return F.concat(F.lit(f"{prefix}/"), (F.col(key) if isinstance(key, str) else key).cast("string"))


#: How the warehouse tables become a graph.
WAREHOUSE: tuple[Lift | Link, ...] = (
    Lift("region", "Region", "r_regionkey", "r_name"),
    Lift("nation", "Nation", "n_nationkey", "n_name", edges={"inRegion": ("region", "n_regionkey")}),
    Lift("customer", "Customer", "c_custkey", "c_name", {"segment": "c_mktsegment"}, {"inNation": ("nation", "c_nationkey")}),
    Lift("supplier", "Supplier", "s_suppkey", "s_name", edges={"inNation": ("nation", "s_nationkey")}),
    Lift("part", "Part", "p_partkey", "p_name", {"brand": "p_brand", "partType": "p_type", "size": "p_size"}),
    Lift("orders", "Order", "o_orderkey", None, {"status": "o_orderstatus", "priority": "o_orderpriority"}, {"placedBy": ("customer", "o_custkey")}),
    Link("lineitem", "hasPart", ("order", "l_orderkey"), ("part", "l_partkey")),
    Link("lineitem", "suppliedBy", ("part", "l_partkey"), ("supplier", "l_suppkey")),
)


def lift(spark: SparkSession, sf_dir: str, spec: tuple[Lift | Link, ...] = WAREHOUSE) -> Graph:
    """The graph of all tables that the specification names; edges and literals without a value are left out.

    Every part is a projection of one table with only the columns that it needs.
    """
    table = cache(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    found: dict[str, dict[str, list[Callable[[], DataFrame]]]] = {name: {} for name in (*SCHEMAS, "repeated")}

    def linked(s: Link, repeated: bool = False) -> DataFrame:
        (a, b), (c, d) = s.source, s.target
        pairs = table(s.table).select(b, d).where(F.col(b).isNotNull() & F.col(d).isNotNull())
        return (pairs if repeated else pairs.distinct()).select(node_id(a, b).alias("src"), F.lit(s.rel).alias("rel"), node_id(c, d).alias("dst"))

    def nodes(s: Lift) -> DataFrame:
        me = node_id(s.type.lower(), s.key)
        return table(s.table).select(me.alias("id"), F.lit(s.type).alias("type"), (F.col(s.label) if s.label else me).alias("label"))

    def edges(s: Lift, rel: str) -> DataFrame:
        prefix, column = s.edges[rel]
        return table(s.table).where(F.col(column).isNotNull()).select(node_id(s.type.lower(), s.key).alias("src"), F.lit(rel).alias("rel"), node_id(prefix, column).alias("dst"))

    def literals(s: Lift, pred: str) -> DataFrame:
        column = s.literals[pred]
        return table(s.table).where(F.col(column).isNotNull()).select(node_id(s.type.lower(), s.key).alias("subj"), F.lit(pred).alias("pred"), F.col(column).cast("string").alias("value"))

    def statements(type_: str, names: list[str]) -> DataFrame:
        said = []
        for s in spec:
            if isinstance(s, Link):
                if s.source[0] == type_.lower() and s.rel in names:
                    said.append(linked(s).select(F.col("src").alias("focus"), F.col("rel").alias("name"), F.col("dst").alias("value")))
            elif s.type == type_:
                pair = lambda name, value: F.struct(F.lit(name).cast("string").alias("name"), value.cast("string").alias("value"))
                pairs = [pair(None, F.lit(None)), *[pair(n, F.col(c)) for n, c in s.literals.items() if n in names], *[pair(n, node_id(*e)) for n, e in s.edges.items() if n in names]]
                rows = table(s.table).select(node_id(s.type.lower(), s.key).alias("focus"), F.explode(F.array(*pairs)).alias("x")).select("focus", "x.name", "x.value")
                said.append(rows.where("name IS NULL OR value IS NOT NULL"))
        return reduce(DataFrame.unionByName, said)

    for s in spec:
        if isinstance(s, Link):
            found["edges"].setdefault(s.rel, []).append(partial(linked, s))
            found["repeated"].setdefault(s.rel, []).append(partial(linked, s, True))
            continue
        found["nodes"].setdefault(s.type, []).append(partial(nodes, s))
        for rel in s.edges:
            for table_ in ("edges", "repeated"):
                found[table_].setdefault(rel, []).append(partial(edges, s, rel))
        for pred in s.literals:
            found["literals"].setdefault(pred, []).append(partial(literals, s, pred))
    union = lambda makers: reduce(DataFrame.unionByName, [make() for make in makers])
    parts = {name: {k: partial(union, v) for k, v in parts.items()} for name, parts in found.items()}
    return Graph(parts=parts | {"statements": {t: partial(statements, t) for t in found["nodes"]}}, spark=spark)
