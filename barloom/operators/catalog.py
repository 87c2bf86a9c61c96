"""Factor catalogue and dependency graph as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.session import materialize, shared_dir

FIELDS = ["display_name", "category", "expression", "description", "tags", "owner"]

# -- metadata -------------------------------------------------------------------------------------


def upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming entries replace existing ones of the same upper-cased name; the creation time stays."""
    key = F.upper(F.col("name")).alias("name")
    old = existing.select(key, *(F.col(c).alias(f"_o_{c}") for c in existing.columns if c != "name"), F.lit(True).alias("_old"))
    new = incoming.select(key, *(c for c in incoming.columns if c != "name"), F.lit(True).alias("_new"))
    both = old.join(new, "name", "full")
    fields = [c for c in existing.columns if c not in ("name", "created_at")]
    return both.select(
        "name", *(F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"_o_{c}")).alias(c) for c in fields),
        F.coalesce("_o_created_at", "created_at").alias("created_at"))


def find_by_category(entries: DataFrame, category: str) -> DataFrame:
    return entries.where(F.lower("category") == category.lower())


def has_tag(tag: str) -> Column:
    return F.exists("tags", lambda t: F.lower(t) == tag.lower())


def find_by_tag(entries: DataFrame, tag: str) -> DataFrame:
    return entries.where(has_tag(tag))


def search(entries: DataFrame, word: str) -> DataFrame:
    """Entries with the word in the name, display name, description, expression or a tag, in any case."""
    w = word.lower()
    inside = lambda c: F.coalesce(F.lower(c).contains(w), F.lit(False))
    hit = inside(F.col("name"))
    for c in ("display_name", "description", "expression"):
        hit = hit | inside(F.col(c))
    return entries.where(hit | F.coalesce(F.exists("tags", lambda t: F.lower(t).contains(w)), F.lit(False)))


def facets(entries: DataFrame) -> DataFrame:
    """(facet, value, n): entries per category and per tag."""
    categories = entries.groupBy(F.col("category").alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("facet", F.lit("category"))
    tags = entries.select(F.explode("tags").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n")).withColumn("facet", F.lit("tag"))
    return categories.unionByName(tags)


class Computations:
    """Named computations bound to catalogue entries: each takes and returns a DataFrame."""

    def __init__(self) -> None:
        self._bound: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def bind(self, name: str, func: Callable[[DataFrame], DataFrame]) -> None:
        self._bound[name.upper()] = func

    def compute(self, name: str, df: DataFrame) -> DataFrame:
        if name.upper() not in self._bound:
            raise KeyError(f"no computation bound to {name}")
        return self._bound[name.upper()](df)


# -- dependency graph: edges (factor, depends_on) --------------------------------------------------


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("factor").alias("node")).union(edges.select("depends_on")).distinct()


def direct_counts(edges: DataFrame) -> DataFrame:
    """(node, n_deps, n_dependents)."""
    e = edges.distinct()
    ends = e.select(F.col("factor").alias("node"), F.lit(1).alias("d"), F.lit(0).alias("r")).unionByName(
        e.select(F.col("depends_on").alias("node"), F.lit(0).alias("d"), F.lit(1).alias("r")))
    return ends.groupBy("node").agg(F.sum("d").alias("n_deps"), F.sum("r").alias("n_dependents"))


def graph_size(edges: DataFrame) -> DataFrame:
    """One row: node and edge counts."""
    n = nodes(edges).agg(F.count(F.lit(1))).scalar()
    return edges.distinct().agg(F.count(F.lit(1)).alias("n_edges")).withColumn("n_nodes", n)


def dependencies(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("factor") == node).select("depends_on").distinct()


def dependents(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("depends_on") == node).select("factor").distinct()


def reachable(edges: DataFrame, seeds: DataFrame, up: bool = False) -> DataFrame:
    """(seed, node): everything that each node of the column ``node`` of ``seeds`` rests on; with ``up`` everything that rests on it.

    A search from the given nodes: each round joins the newest pairs with the edges and keeps what is new, so the work grows with the answer,
    not with the graph's closure. A seed on a cycle reaches itself. The rounds, as many as the longest way has edges, are written to the shared
    folder, so a lost executor costs one round.
    """
    ends = ("depends_on", "factor") if up else ("factor", "depends_on")
    step = materialize(edges.select(F.col(ends[0]).alias("node"), F.col(ends[1]).alias("_next")).distinct(), "steps")
    newest, known = seeds.select(F.col("node").alias("seed"), "node").distinct(), None
    while True:
        found = newest.join(step, "node").select("seed", F.col("_next").alias("node")).distinct()
        newest = materialize(found if known is None else found.join(known, ["seed", "node"], "left_anti"), "reached")
        if newest.isEmpty():
            return newest if known is None else known
        known = newest if known is None else known.unionByName(newest)


def closure(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """All (factor, depends_on) pairs along paths, self pairs (on cycles) included; with ``seeds`` only those from its nodes.

    Without seeds the pairs are what the caller asked for; the rounds hold no more than those.
    """
    start = edges.select(F.col("factor").alias("node")) if seeds is None else seeds
    return reachable(edges, start).select(F.col("seed").alias("factor"), F.col("node").alias("depends_on"))


def _named(edges: DataFrame, node: str) -> DataFrame:
    return edges.sparkSession.createDataFrame([(node,)], "node string")


def all_dependencies(edges: DataFrame, node: str) -> DataFrame:
    """(depends_on): everything the node rests on, itself excluded."""
    return reachable(edges, _named(edges, node)).where(F.col("node") != node).select(F.col("node").alias("depends_on"))


def all_dependents(edges: DataFrame, node: str) -> DataFrame:
    """(factor): everything that rests on the node, itself excluded."""
    return reachable(edges, _named(edges, node), up=True).where(F.col("node") != node).select(F.col("node").alias("factor"))


def topological_levels(edges: DataFrame) -> DataFrame:
    """(node, level): level 0 depends on nothing, else one above the highest dependency. Ordered by
    (level, node) every node follows what it depends on. Raises on a cycle.

    Peels finished nodes round by round: a node is due when all its edges lead to peeled nodes.
    """
    shared_dir(edges.sparkSession)
    left = edges.select("factor", "depends_on").distinct().checkpoint()
    pending = nodes(left).checkpoint()
    done, level = None, 0
    while not pending.isEmpty():
        free = pending.join(left.select(F.col("factor").alias("node")).distinct(), "node", "left_anti")
        free = free.withColumn("level", F.lit(level)).checkpoint()
        if free.isEmpty():
            raise ValueError("the dependency graph has a cycle: " + " -> ".join(cycle_path(left)))
        done = free if done is None else done.unionByName(free)
        pending = pending.join(free, "node", "left_anti").checkpoint()
        left = left.join(free.select(F.col("node").alias("depends_on")), "depends_on", "left_anti").checkpoint()
        level += 1
    return done


def _lowest(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label): the smallest label among a node's own and those of all nodes with a way to it along (source, target) edges."""
    while True:
        met = edges.join(labels.withColumnRenamed("node", "source"), "source").groupBy(F.col("target").alias("node")).agg(F.min("label").alias("_met"))
        both = labels.join(met, "node", "left").withColumn("_low", F.least("label", F.coalesce("_met", "label")))
        after = materialize(both.select("node", F.col("_low").alias("label"), (F.col("_low") < F.col("label")).alias("changed")), "labels")
        labels = after.drop("changed")
        if after.where("changed").isEmpty():
            return labels


def cyclic_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node on a cycle, self-loops included: nodes that reach each other share a component, named after its smallest node.

    Trimming leaves the edges that can lie on a cycle. Then every node takes the smallest node with a way to it as its colour, and inside a colour
    those that have a way back to that node are its component; edges of components found go, and the rest is trimmed and coloured anew. State is one
    label per node, never a pair of nodes; a round of colouring finds at least one component per colour.
    """
    left, found = cyclic_core(edges), None
    while not left.isEmpty():
        ends = nodes(left).withColumn("label", F.col("node"))
        ahead = left.select(F.col("factor").alias("source"), F.col("depends_on").alias("target"))
        colour = _lowest(ahead, materialize(ends, "labels")).withColumnRenamed("label", "colour")
        inside = ahead.join(colour.withColumnsRenamed({"node": "source", "colour": "_a"}), "source").join(
            colour.withColumnsRenamed({"node": "target", "colour": "_b"}), "target").where("_a = _b")
        back = materialize(inside.select(F.col("target").alias("source"), F.col("source").alias("target")), "inside")
        # only the root has the colour's own name among the labels that travel backwards
        marks = colour.select("node", F.when(F.col("node") == F.col("colour"), 0).otherwise(1).alias("label"))
        home = _lowest(back, materialize(marks, "labels")).where("label = 0").select("node")
        component = materialize(colour.join(home, "node").select("node", F.col("colour").alias("component")), "component")
        # a root that no cycle goes through is alone in its colour
        loops = left.where(F.col("factor") == F.col("depends_on")).select(F.col("factor").alias("node")).distinct()
        sizes = component.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
        cyclic = component.join(sizes, "component").join(loops.withColumn("_loop", F.lit(True)), "node", "left").where("_n > 1 or _loop").select("node", "component")
        found = cyclic if found is None else found.unionByName(cyclic)
        gone = component.select("node")
        left = cyclic_core(left.join(gone.withColumnRenamed("node", "factor"), "factor", "left_anti").join(gone.withColumnRenamed("node", "depends_on"), "depends_on", "left_anti"))
    if found is None:
        return nodes(left).withColumn("component", F.col("node"))
    return found


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """(node) for every node on a cycle, self-loops included."""
    return cyclic_components(edges).select("node")


def cycle_path(edges: DataFrame) -> list[str]:
    """A shortest cycle through the smallest node that lies on one, that node first and last; empty without a cycle.

    A search by levels inside the node's component; the driver then reads one edge per step of the way.
    """
    components = materialize(cyclic_components(edges), "components")
    start = components.agg(F.min("node").alias("node")).first()["node"]
    if start is None:
        return []
    members = components.join(components.where(F.col("node") == start).select("component"), "component").select("node")
    inner = materialize(edges.select("factor", "depends_on").distinct().join(members.withColumnRenamed("node", "factor"), "factor").join(
        members.withColumnRenamed("node", "depends_on"), "depends_on"), "component-edges")
    levels = [_named(edges, start)]
    seen = levels[0].limit(0)
    while True:
        newest = inner.join(levels[-1].withColumnRenamed("node", "factor"), "factor").select(F.col("depends_on").alias("node")).distinct()
        newest = materialize(newest.join(seen, "node", "left_anti"), "level")
        levels.append(newest)
        if not newest.where(F.col("node") == start).isEmpty():
            break
        seen = seen.unionByName(newest)
    path = [start]
    for level in reversed(levels[:-1]):
        before = inner.where(F.col("depends_on") == path[0]).select(F.col("factor").alias("node")).join(level, "node", "left_semi")
        path.insert(0, before.agg(F.min("node")).first()[0])
    return path


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges left after peeling nodes without incoming or without outgoing edges: empty for a graph
    without cycles, so the closure behind it only sees what can be cyclic."""
    shared_dir(edges.sparkSession)
    left = edges.select("factor", "depends_on").distinct().checkpoint()
    size = left.count()
    while size:
        used = left.select(F.col("depends_on").alias("factor")).distinct()
        uses = left.select(F.col("factor").alias("depends_on")).distinct()
        left = left.join(used, "factor", "left_semi").join(uses, "depends_on", "left_semi").select("factor", "depends_on").checkpoint()
        now = left.count()
        if now == size:
            break
        size = now
    return left


def has_cycle(edges: DataFrame) -> bool:
    return not cyclic_core(edges).isEmpty()


def remove_node(edges: DataFrame, node: str) -> DataFrame:
    return edges.where((F.col("factor") != node) & (F.col("depends_on") != node))


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("factor", "depends_on"), ["factor", "depends_on"], "left_anti")
