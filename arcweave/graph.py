"""The property graph: two DataFrames and a direction."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import EdgeNotFound, InvalidArgument, NodeNotFound
from .plans.tables import indexed

Expr = Column | str

VERTICES = "id long, attr long"
EDGES = "eid long, src long, dst long, weight double"


def column(e: Expr) -> Column:
    """A column, or an SQL expression as one."""
    return F.expr(e) if isinstance(e, str) else e


class Graph:
    """An immutable property graph.

    ``vertices``: id (long, unique), attr, any other columns.  ``edges``: eid (long,
    unique; gives insertion order), src, dst, weight, any other columns.  Parallel
    edges and self-loops are allowed.  Every method that changes something returns a
    new graph; nothing runs before a result is asked for.
    """

    def __init__(self, vertices: DataFrame, edges: DataFrame, directed: bool = False):
        self.vertices, self.edges, self.directed = vertices, edges, directed

    # ------------------------------------------------------------------ construction

    @classmethod
    def empty(cls, spark: SparkSession, directed: bool = False, capacity: tuple[int, int] | None = None) -> Graph:
        """No vertices, no edges. ``capacity`` is a hint of no effect."""
        return cls(spark.createDataFrame([], VERTICES), spark.createDataFrame([], EDGES), directed)

    @classmethod
    def from_lists(cls, spark: SparkSession, nodes: Iterable, edges: Iterable[tuple], directed: bool = False) -> Graph:
        """From node ids (or (id, attr) pairs) and (src, dst[, weight]) tuples."""
        v = [(n[0], n[1]) if isinstance(n, tuple) else (n, n) for n in nodes]
        e = [(i, x[0], x[1], float(x[2]) if len(x) > 2 else 1.0) for i, x in enumerate(edges)]
        return cls(spark.createDataFrame(v, VERTICES), spark.createDataFrame(e, EDGES), directed)

    @classmethod
    def from_edges(cls, edges: DataFrame, directed: bool = False, src: str = "src", dst: str = "dst", weight: Expr | None = None, vertices: DataFrame | None = None) -> Graph:
        """From any edge table. Edge ids follow (src, dst) unless ``eid`` is a column; vertices are the endpoints unless given."""
        w = F.lit(1.0) if weight is None else column(weight).cast("double")
        rest = [c for c in edges.columns if c not in (src, dst, "eid", "weight")]
        rows = edges.select(*(["eid"] if "eid" in edges.columns else []), F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), w.alias("weight"), *rest)
        if "eid" not in rows.columns:
            rows = indexed(rows, ["src", "dst", "weight"], "eid").select("eid", "src", "dst", "weight", *rest)
        if vertices is None:
            vertices = rows.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("attr", F.col("id"))
        return cls(vertices, rows, directed)

    @property
    def spark(self) -> SparkSession:
        return self.vertices.sparkSession

    def with_parts(self, vertices: DataFrame | None = None, edges: DataFrame | None = None) -> Graph:
        """The same graph with one or both tables replaced."""
        return Graph(self.vertices if vertices is None else vertices, self.edges if edges is None else edges, self.directed)

    def persist(self) -> Graph:
        """Keeps both tables in memory or on disk for repeated use."""
        return self.with_parts(self.vertices.persist(), self.edges.persist())

    def unpersist(self) -> None:
        self.vertices.unpersist()
        self.edges.unpersist()

    def register(self, prefix: str = "") -> None:
        """Temporary views ``vertices``, ``edges`` and ``arcs`` for Spark SQL."""
        self.vertices.createOrReplaceTempView(f"{prefix}vertices")
        self.edges.createOrReplaceTempView(f"{prefix}edges")
        self.arcs().createOrReplaceTempView(f"{prefix}arcs")

    # ------------------------------------------------------------------ arc views

    def arcs(self, view: str = "out") -> DataFrame:
        """(eid, src, dst, weight) by traversal direction.

        ``out``: stored direction; undirected both ways, self-loops once.  ``in``: the
        reverse.  ``flow``: as out, but undirected self-loops twice.  ``sym``: both ways
        whatever the direction, self-loops once.
        """
        e = self.edges.select("eid", "src", "dst", "weight")
        turned = e.select("eid", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        if self.directed and view in ("out", "flow"):
            return e
        if self.directed and view == "in":
            return turned
        if view == "in":
            return turned.unionByName(e.filter("src <> dst"))
        return e.unionByName(turned if view == "flow" else turned.filter("src <> dst"))

    def neighbour_pairs(self, view: str = "out", loops: bool = True) -> DataFrame:
        """Distinct (src, dst) of a view."""
        a = self.arcs(view).select("src", "dst")
        return (a if loops else a.filter("src <> dst")).distinct()

    # ------------------------------------------------------------------ sizes and lookups

    def node_count(self) -> int:
        return self.vertices.count()

    def edge_count(self) -> int:
        return self.edges.count()

    def size_upto(self, limit: int) -> int:
        """Vertices plus edges, counted no further than just above ``limit``."""
        n = self.vertices.select("id").limit(limit + 1).count()
        return n if n > limit else n + self.edges.select("eid").limit(limit + 1).count()

    def is_directed(self) -> bool:
        return self.directed

    def is_empty(self) -> bool:
        return self.vertices.isEmpty()

    def density_frame(self) -> DataFrame:
        """One row: nodes, edges, density (0 under two nodes; above 1 for multigraphs)."""
        n = self.vertices.agg(F.count("*").alias("nodes"))
        m = self.edges.agg(F.count("*").alias("edges"))
        pairs = F.col("nodes").cast("double") * (F.col("nodes") - 1)
        return n.join(m).select("nodes", "edges", F.when(F.col("nodes") < 2, 0.0).otherwise((1 if self.directed else 2) * F.col("edges") / F.when(pairs > 0, pairs)).alias("density"))

    def density(self) -> float:
        return self.density_frame().first()["density"]

    def contains_node(self, node: int) -> bool:
        return not self.vertices.filter(F.col("id") == node).isEmpty()

    def contains_edge(self, u: int, v: int) -> bool:
        return not self._between(u, v).isEmpty()

    def _between(self, u: int, v: int) -> DataFrame:
        there = (F.col("src") == u) & (F.col("dst") == v)
        if not self.directed:
            there |= (F.col("src") == v) & (F.col("dst") == u)
        return self.edges.filter(there)

    def find_edge(self, u: int, v: int) -> int | None:
        """Least edge id between two nodes."""
        return self._between(u, v).agg(F.min("eid")).first()[0]

    def contains_edges(self, pairs: DataFrame) -> DataFrame:
        """Adds ``present`` to a table of (u, v) pairs."""
        known = self.neighbour_pairs().select(F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(True).alias("present"))
        return pairs.join(known, ["u", "v"], "left").withColumn("present", F.coalesce("present", F.lit(False)))

    def _per_node(self, counts: DataFrame, name: str) -> DataFrame:
        return self.vertices.select("id").join(counts, "id", "left").select("id", F.coalesce(name, F.lit(0)).cast("long").alias(name))

    def degrees(self) -> DataFrame:
        """(id, degree): directed in plus out; an undirected self-loop counts once."""
        ends = self.arcs("out").select(F.col("src").alias("id"))
        if self.directed:
            ends = ends.unionByName(self.edges.select(F.col("dst").alias("id")))
        return self._per_node(ends.groupBy("id").agg(F.count("*").alias("degree")), "degree")

    def in_degrees(self) -> DataFrame:
        return self._per_node(self.arcs("in").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("in_degree")), "in_degree")

    def out_degrees(self) -> DataFrame:
        return self._per_node(self.arcs("out").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree")), "out_degree")

    def _one(self, df: DataFrame, node: int) -> int | None:
        row = df.filter(F.col("id") == node).first()
        return None if row is None else row[1]

    def degree(self, node: int) -> int | None:
        return self._one(self.degrees(), node)

    def in_degree(self, node: int) -> int | None:
        return self._one(self.in_degrees(), node)

    def out_degree(self, node: int) -> int | None:
        return self._one(self.out_degrees(), node)

    def neighbors(self, node: int) -> DataFrame:
        """Bag of (id): successors, or all neighbours of an undirected node."""
        return self.arcs("out").filter(F.col("src") == node).select(F.col("dst").alias("id"))

    outgoing_neighbors = out_neighbors = neighbors

    def incoming_neighbors(self, node: int) -> DataFrame:
        return self.arcs("in").filter(F.col("src") == node).select(F.col("dst").alias("id"))

    in_neighbors = incoming_neighbors

    def outgoing_edges(self, node: int) -> DataFrame:
        return self.arcs("out").filter(F.col("src") == node).select(F.col("dst").alias("target"), "weight")

    def node_attr(self, node: int, default=None):
        row = self.vertices.filter(F.col("id") == node).select("attr").first()
        return default if row is None else row[0]

    def edge_weight(self, eid: int, default=None):
        row = self.edges.filter(F.col("eid") == eid).select("weight").first()
        return default if row is None else row[0]

    def get_edge_weight(self, u: int, v: int) -> float | None:
        """Weight of the first edge between two nodes."""
        return self._between(u, v).agg(F.min_by("weight", "eid")).first()[0]

    def __getitem__(self, node: int):
        row = self.vertices.filter(F.col("id") == node).select("attr").first()
        if row is None:
            raise NodeNotFound(node)
        return row[0]

    def __len__(self) -> int:
        return self.node_count()

    def __contains__(self, node: int) -> bool:
        return self.contains_node(node)

    def __iter__(self):
        return (r["id"] for r in self.vertices.select("id").orderBy("id").toLocalIterator())

    def __repr__(self) -> str:
        return f"Graph(directed={self.directed}, vertices={self.vertices.columns}, edges={self.edges.columns})"

    def nodes_with_attrs(self, default=None) -> DataFrame:
        """(id, attr) by id, null attributes replaced by ``default``."""
        attr = F.col("attr") if default is None else F.coalesce("attr", F.lit(default))
        return self.vertices.select("id", attr.alias("attr")).orderBy("id")

    def edges_with_weights(self, default=None) -> DataFrame:
        w = F.col("weight") if default is None else F.coalesce("weight", F.lit(default))
        return self.edges.select("eid", "src", "dst", w.alias("weight")).orderBy("eid")

    def weight_stats(self) -> DataFrame:
        """One row: min_weight, max_weight, total_weight."""
        return self.edges.agg(F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total_weight"))

    def require_nodes(self, *nodes: int) -> None:
        """Raises unless the graph has all of these nodes."""
        found = {r["id"] for r in self.vertices.filter(F.col("id").isin(*nodes)).select("id").collect()}
        for n in nodes:
            if n not in found:
                raise NodeNotFound(n)

    # ------------------------------------------------------------------ changes

    def _next(self, df: DataFrame, col: str) -> int:
        top = df.agg(F.max(col)).first()[0]
        return 0 if top is None else top + 1

    def _fill(self, rows: DataFrame, like: DataFrame) -> DataFrame:
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema])

    def add_nodes(self, attrs: Iterable) -> tuple[Graph, list[int]]:
        """New nodes with the next free ids; returns the graph and the ids."""
        attrs, first = list(attrs), self._next(self.vertices, "id")
        kind = self.vertices.schema["attr"].dataType
        rows = self.spark.createDataFrame([(first + i, a) for i, a in enumerate(attrs)], T.StructType([T.StructField("id", T.LongType()), T.StructField("attr", kind)]))
        return self.with_parts(vertices=self.vertices.unionByName(self._fill(rows, self.vertices))), [first + i for i in range(len(attrs))]

    def add_node(self, attr) -> tuple[Graph, int]:
        g, ids = self.add_nodes([attr])
        return g, ids[0]

    def add_edges(self, edges: Iterable[tuple] | DataFrame) -> Graph:
        """More edges: (src, dst[, weight]) tuples or a table; weights must be finite, endpoints must exist."""
        first = self._next(self.edges, "eid")
        if isinstance(edges, DataFrame):
            rows = edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0))
            rows = indexed(rows, ["src", "dst"], "eid").withColumn("eid", F.col("eid") + first)
        else:
            rows = self.spark.createDataFrame([(first + i, e[0], e[1], float(e[2]) if len(e) > 2 else 1.0) for i, e in enumerate(edges)], EDGES)
        if not rows.filter("weight is null or isnan(weight) or abs(weight) = double('Infinity')").isEmpty():
            raise InvalidArgument("weights must be finite")
        ends = rows.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        lost = ends.join(self.vertices, "id", "left_anti").first()
        if lost is not None:
            raise NodeNotFound(lost[0])
        return self.with_parts(edges=self.edges.unionByName(self._fill(rows, self.edges)))

    def add_edge(self, u: int, v: int, weight: float = 1.0) -> Graph:
        return self.add_edges([(u, v, weight)])

    add_nodes_bulk = extend_nodes = add_nodes_from = add_nodes
    add_edges_bulk = extend_edges = add_edges_from = add_edges

    def add_edges_if_absent(self, edges: DataFrame) -> Graph:
        """Those edges that aren't there yet (in either direction if undirected); of equal new ones the first."""
        key = ["src", "dst"] if self.directed else [F.least("src", "dst"), F.greatest("src", "dst")]
        a = lambda df: df.select("*", *[(F.col(k) if isinstance(k, str) else k).alias(n) for k, n in zip(key, ("__a", "__b"))])
        new = a(edges).join(a(self.edges).select("__a", "__b"), ["__a", "__b"], "left_anti").dropDuplicates(["__a", "__b"]).drop("__a", "__b")
        return self.add_edges(new)

    def add_edge_if_absent(self, u: int, v: int, weight: float = 1.0) -> tuple[Graph, int, bool]:
        """(graph, edge id, whether it is new)."""
        found = self.find_edge(u, v)
        if found is not None:
            return self, found, False
        g = self.add_edge(u, v, weight)
        return g, g.find_edge(u, v), True

    def update_nodes(self, updates: DataFrame) -> Graph:
        """New attributes from (id, attr); unknown ids are of no effect."""
        new = updates.select("id", F.col("attr").alias("__attr"), F.lit(True).alias("__new"))
        v = self.vertices.join(new, "id", "left").withColumn("attr", F.when(F.col("__new"), F.col("__attr")).otherwise(F.col("attr"))).select(*self.vertices.columns)
        return self.with_parts(vertices=v)

    def update_node(self, node: int, attr) -> Graph:
        """Raises for an unknown node."""
        self.require_nodes(node)
        return self.with_parts(vertices=self.vertices.withColumn("attr", F.when(F.col("id") == node, F.lit(attr)).otherwise(F.col("attr"))))

    def update_edge_weight(self, u: int, v: int, weight: float) -> Graph:
        """Sets the weight of the first edge between two nodes."""
        e = self.find_edge(u, v)
        if e is None:
            raise EdgeNotFound((u, v))
        return self.with_parts(edges=self.edges.withColumn("weight", F.when(F.col("eid") == e, F.lit(float(weight))).otherwise(F.col("weight"))))

    def remove_nodes(self, nodes: DataFrame) -> Graph:
        """Without these nodes (id) and their edges; other ids stay as they are."""
        gone = nodes.select("id").distinct()
        e = self.edges.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti").select(*self.edges.columns)
        return Graph(self.vertices.join(gone, "id", "left_anti"), e, self.directed)

    def remove_node(self, node: int) -> Graph:
        self.require_nodes(node)
        return Graph(self.vertices.filter(F.col("id") != node), self.edges.filter((F.col("src") != node) & (F.col("dst") != node)), self.directed)

    def remove_edge(self, eid: int) -> Graph:
        if self.edges.filter(F.col("eid") == eid).isEmpty():
            raise EdgeNotFound(eid)
        return self.with_parts(edges=self.edges.filter(F.col("eid") != eid))

    def remove_edge_between(self, u: int, v: int) -> Graph:
        """Without the first edge between two nodes."""
        e = self.find_edge(u, v)
        if e is None:
            raise EdgeNotFound((u, v))
        return self.with_parts(edges=self.edges.filter(F.col("eid") != e))

    def clear(self) -> Graph:
        return Graph(self.vertices.limit(0), self.edges.limit(0), self.directed)

    def retain_nodes(self, keep: Expr) -> Graph:
        """Nodes where the condition holds, and edges between them."""
        return self.induced(self.vertices.filter(column(keep)))

    def retain_edges(self, keep: Expr) -> Graph:
        return self.with_parts(edges=self.edges.filter(column(keep)))

    def induced(self, vertices: DataFrame) -> Graph:
        """On these vertices (a part of the vertex table), with the edges between them."""
        ids = vertices.select("id")
        e = self.edges.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi").select(*self.edges.columns)
        return Graph(vertices, e, self.directed)

    # ------------------------------------------------------------------ mapping and matrices

    def map_node_attrs(self, f: Expr | Callable[[Column, Column], Column]) -> Graph:
        """New attributes: a column, an SQL expression, or a function of (id, attr) columns."""
        c = f(F.col("id"), F.col("attr")) if callable(f) and not isinstance(f, Column) else column(f)
        return self.with_parts(vertices=self.vertices.withColumn("attr", c))

    def map_edge_weights(self, f: Expr | Callable[[Column], Column]) -> Graph:
        c = f(F.col("weight")) if callable(f) and not isinstance(f, Column) else column(f)
        return self.with_parts(edges=self.edges.withColumn("weight", c))

    def convert(self, kind: str) -> Graph:
        """Weights cast to another type, ids packed anew as 0 to n - 1."""
        return self.map_edge_weights(F.col("weight").cast(kind)).relabel()

    def to_nodemap(self, value: Expr) -> DataFrame:
        return self.vertices.select("id", column(value).alias("value"))

    def adjacency_matrix(self) -> DataFrame:
        """(row, col, weight): of parallel edges the last one; symmetric if undirected."""
        return self.arcs("out").groupBy(F.col("src").alias("row"), F.col("dst").alias("col")).agg(F.max_by("weight", "eid").alias("weight"))

    def sparse_adjacency_matrix(self) -> DataFrame:
        """(row, col, weight): parallel edges summed."""
        return self.arcs("out").groupBy(F.col("src").alias("row"), F.col("dst").alias("col")).agg(F.sum("weight").alias("weight"))

    @classmethod
    def from_matrix(cls, cells: DataFrame, directed: bool = False, n: int | None = None) -> Graph:
        """From (row, col, weight); undirected reads row <= col only. ``n`` adds isolated nodes up to n - 1."""
        e = (cells if directed else cells.filter(F.col("row") <= F.col("col"))).filter("weight is not null")
        e = indexed(e.select(F.col("row").cast("long").alias("src"), F.col("col").cast("long").alias("dst"), "weight"), ["src", "dst"], "eid").select("eid", "src", "dst", "weight")
        v = cells.select(F.explode(F.array(F.col("row").cast("long"), F.col("col").cast("long"))).alias("id"))
        if n is not None:
            v = v.unionByName(cells.sparkSession.range(n))
        return cls(v.distinct().withColumn("attr", F.col("id")), e, directed)

    def relabel(self) -> Graph:
        """Ids 0 to n - 1 in ascending order of the old ones."""
        ids = indexed(self.vertices.select("id"), ["id"], "new")
        v = self.vertices.join(ids, "id").withColumn("id", F.col("new")).select(*self.vertices.columns)
        e = self.edges.join(ids.toDF("src", "s"), "src").join(ids.toDF("dst", "d"), "dst").withColumns({"src": F.col("s"), "dst": F.col("d")}).select(*self.edges.columns)
        return Graph(v, e, self.directed)


def first_between(edges: DataFrame) -> DataFrame:
    """Of parallel edges the one with the least id."""
    w = Window.partitionBy("src", "dst").orderBy("eid")
    return edges.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")
