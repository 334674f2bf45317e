"""Traversals: strongest paths with decay, least hops, ancestors, waves, cycles and bounded paths.

Each is a loop of joins between the edges and a frontier that is written every round, so a plan stays one
round long and survives lost executors. What is tested on the driver is one count a round.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Graph
from .shared import Rounds

DECAY, LEAST = 0.75, 0.01
#: An id is of one of so many kinds, by what it has before its first colon, or of a last one without a colon. Ids of different kinds differ,
#: so a round reads only the steps that leave the kinds of its frontier, and compares what they reach only with what has been seen of the same kinds.
KINDS = 64
#: From so many roots at most, a node holds what reaches it as bits.
FEW = 63


def _kind(col: str) -> Column:
    return F.when(F.instr(col, ":") > 0, F.pmod(F.hash(F.substring_index(col, ":", 1)), F.lit(KINDS))).otherwise(F.lit(KINDS))


def _by_kinds(rounds: Rounds, step: DataFrame) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """Steps (at, to, ...) with a number for their kinds at both ends, held by it, and the kinds by number."""
    held, numbers = rounds.split(step.withColumn("kinds", _kind("at") * (KINDS + 1) + _kind("to")), "kinds")
    return held, {n: divmod(n, KINDS + 1) for n in numbers}


def _seen(levels: list[tuple[DataFrame, set[int]]], kinds: set[int], *columns: str) -> DataFrame | None:
    """Of what has been reached, the rows of some kinds."""
    parts = [df.select(*columns).filter(_kind("id").isin(*(k & kinds))) for df, k in levels if k & kinds]
    return reduce(DataFrame.unionByName, parts) if parts else None


def _weights(weights: dict[str, float], default: float) -> Column:
    out = None
    for kind, w in weights.items():
        out = F.when(F.col("type") == kind, F.lit(w)) if out is None else out.when(F.col("type") == kind, F.lit(w))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def steps(graph: Graph, direction: str, weights: dict[str, float], excluded: set[str] = frozenset(), included: set[str] | None = None, default: float = 0.5) -> DataFrame:
    """Edges as steps (at, to, weight, type, way, ordinal); up is against the edge, to what depends on a node."""
    e = graph.edges.filter("src <> dst")
    if excluded:
        e = e.filter(~F.col("type").isin(*excluded))
    if included is not None:
        e = e.filter(F.col("type").isin(*included))
    e = e.withColumn("weight", _weights(weights, default))
    up = e.select(F.col("dst").alias("at"), F.col("src").alias("to"), "weight", "type", F.lit(0).alias("way"), "ordinal")
    down = e.select(F.col("src").alias("at"), F.col("dst").alias("to"), "weight", "type", F.lit(1).alias("way"), "ordinal")
    return {"up": up, "down": down}.get(direction) if direction != "both" else up.unionByName(down)


def blast_radius(graph: Graph, targets: list[str], direction: str = "up", depth: int = 6, weights: dict[str, float] | None = None, excluded: set[str] = frozenset(), included: set[str] | None = None, default: float = 0.5) -> DataFrame:
    """id, weight, hops, parent and via (type) of every node that a change of the targets reaches.

    Best first: a step multiplies by its edge's weight and the decay, weights under the least are dropped, each
    node keeps its strongest path, and a node whose strongest path has depth hops isn't expanded. A step loses
    a quarter at least, so in a round all nodes are settled that are stronger than what the strongest open one can
    give; a node is expanded once, when it is settled, and 17 rounds are enough whatever the graph.
    """
    spark = graph.nodes.sparkSession
    loss = DECAY * max(1.0, default, *(weights or {}).values())
    if loss >= 1:
        raise ValueError("a weight by which a step loses nothing")
    rounds = Rounds(spark)
    edge, kinds_of = _by_kinds(rounds, steps(graph, direction, weights or {}, excluded, included, default))
    front = spark.createDataFrame([(t, 1.0, 0, None, None) for t in dict.fromkeys(targets)], "id string, weight double, hops int, parent string, via string")
    kinds = {r.k for r in front.select(_kind("id").alias("k")).distinct().collect()}
    levels, pool = [(front, kinds)], None
    # the open labels: for each node its strongest, and others that are as strong within 1e-9, one for each weight (minus is the weight below
    # zero, by which they are sorted); of these the one from the strongest node, with fewest hops, is the node's own
    node, columns = Window.partitionBy("id"), ["id", "minus", "key"]
    while True:
        used = {n: to for n, (at, to) in kinds_of.items() if at in kinds}
        if used:
            cand = (
                front.filter(F.col("hops") < depth).select(F.col("id").alias("from"), F.col("weight").alias("pw"), "hops").join(edge.filter(F.col("kinds").isin(*used)), F.col("from") == F.col("at"))
                .withColumn("x", F.col("pw") * F.col("weight") * DECAY).filter((F.col("x") >= LEAST) & ~F.col("to").isin(*targets))
                .select(F.col("to").alias("id"), (-F.col("x")).alias("minus"), F.struct((-F.col("pw")).alias("minus"), "hops", F.col("from").alias("id"), "way", "ordinal", "type").alias("key"))
            )
            every = cand if pool is None else cand.unionByName(pool.select(*columns))
            if (done := _seen(levels, set(used.values()), "id")) is not None:
                every = every.join(done, "id", "left_anti")
            near = every.withColumn("top", -F.first("minus").over(node.orderBy("minus"))).filter(-F.col("minus") >= F.col("top") - 1e-9)
            near = near.groupBy("id", "minus").agg(F.min("key").alias("key"), F.first("top").alias("top"))
            pool = rounds.hold(near.withColumn("own", F.col("key") == F.min("key").over(node)))
        if pool is None:
            break
        tops = {r.k: r.top for r in pool.groupBy(_kind("id").alias("k")).agg(F.max("top").alias("top")).collect()}
        if not tops:
            break
        floor = max(tops.values()) * loss + 2e-9
        kinds = {k for k, top in tops.items() if top > floor}
        front = pool.filter((F.col("top") > floor) & F.col("own")).select("id", (-F.col("minus")).alias("weight"), (F.col("key.hops") + 1).cast("int").alias("hops"), F.col("key.id").alias("parent"), F.col("key.type").alias("via"))
        levels.append((front, kinds))
        pool = pool.filter(F.col("top") <= floor)
    return reduce(DataFrame.unionByName, [df for df, _ in levels])


def impact_rows(graph: Graph, reached: DataFrame, ranked: bool = True) -> DataFrame:
    """Reached nodes other than targets with label and name, strongest first if they are to be ranked."""
    out = reached.filter("hops > 0").join(graph.nodes.select("id", "label", "name"), "id")
    out = out.select("id", "label", "name", "hops", F.round("weight", 4).alias("weight"), "parent", "via")
    return out.orderBy(F.desc("weight"), "hops", "label", "name") if ranked else out


def risk_summary(graph: Graph, reached: DataFrame, multipliers: dict[str, float], entry: Column) -> DataFrame:
    """affected, entry_points, score and band: the weights by label multiplier, and six for each entry point."""
    rows = reached.filter("hops > 0").join(graph.nodes, "id")
    many = F.lit(1.0)
    for label, m in multipliers.items():
        many = F.when(F.col("label") == label, F.lit(m)).otherwise(many)
    out = rows.agg(F.count(F.lit(1)).alias("affected"), F.count_if(entry).alias("entry_points"), F.coalesce(F.sum(F.col("weight") * many), F.lit(0.0)).alias("s"))
    score = F.col("s") + 6 * F.col("entry_points")
    band = F.when(score > 60, "CRITICAL").when(score > 30, "HIGH").when(score > 12, "MEDIUM").otherwise("LOW")
    return out.select("affected", "entry_points", F.round(score, 2).alias("score"), band.alias("band"))


def min_hops(edges: DataFrame, roots: DataFrame, depth: int = 8, reverse: bool = False) -> DataFrame:
    """root, id and least hops, over edges (src, dst) from many roots (id) at once; a root itself has 0."""
    rounds = Rounds(edges.sparkSession)
    at, to = ("dst", "src") if reverse else ("src", "dst")
    step, kinds_of = _by_kinds(rounds, edges.select(F.col(at).alias("at"), F.col(to).alias("to")).filter("at <> to"))
    roots = rounds.hold(roots.select("id").distinct())
    names = [r.id for r in roots.limit(FEW + 1).collect()]
    few = len(names) <= FEW
    if few:
        frontier = rounds.hold(edges.sparkSession.createDataFrame([(n, 1 << k, 0) for k, n in enumerate(names)], "id string, bits long, hops int"))
    else:
        frontier = rounds.hold(roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("hops")))
    kinds = {r.k for r in roots.select(_kind("id").alias("k")).distinct().collect()}
    levels = [(frontier, kinds)]
    for hop in range(1, depth + 1):
        used = {n: to for n, (at, to) in kinds_of.items() if at in kinds}
        if not used:
            break
        leaving, kinds = {at for at, _ in (kinds_of[n] for n in used)}, set(used.values())
        met = frontier.filter(_kind("id").isin(*leaving)).withColumnRenamed("id", "from").join(step.filter(F.col("kinds").isin(*used)), F.col("from") == F.col("at"))
        if few:
            new, seen = met.groupBy(F.col("to").alias("id")).agg(F.bit_or("bits").alias("bits")), _seen(levels, kinds, "id", "bits")
            if seen is not None:
                new = new.join(seen.groupBy("id").agg(F.bit_or("bits").alias("had")), "id", "left").select("id", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long")))).alias("bits")).filter("bits <> 0")
        else:
            new, seen = met.select("root", F.col("to").alias("id")).distinct(), _seen(levels, kinds, "root", "id")
            if seen is not None:
                new = new.join(seen, ["root", "id"], "left_anti")
        frontier = rounds.hold(new.withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        levels.append((frontier, kinds))
    out = reduce(DataFrame.unionByName, [df for df, _ in levels])
    if not few:
        return out
    every = F.array(*[F.lit(n).cast("string") for n in names]) if names else F.array().cast("array<string>")
    reaching = F.filter(every, lambda _, k: F.call_function("shiftright", F.col("bits"), k).bitwiseAND(F.lit(1).cast("long")) == 1)
    return out.select(F.explode(reaching).alias("root"), "id", "hops")


def descend(graph: Graph, roots: DataFrame, types: list[str], depth: int = 8) -> DataFrame:
    return min_hops(graph.of_type(*types), roots, depth)


def ascend(graph: Graph, roots: DataFrame, types: list[str], depth: int = 8) -> DataFrame:
    return min_hops(graph.of_type(*types), roots, depth, reverse=True)


def owner(graph: Graph, starts: DataFrame, types: list[str], label: str, depth: int = 6, reverse: bool = True) -> DataFrame:
    """id and owner: the nearest node of a label on the way up, the first of those equally near."""
    found = min_hops(graph.of_type(*types), starts, depth, reverse).join(graph.by_label(label).select("id", "ordinal"), "id")
    return found.groupBy("root").agg(F.min_by("id", F.struct("hops", "ordinal")).alias("owner")).withColumnRenamed("root", "id")


def paths(edges: DataFrame, least: int, most: int, closed: bool = False) -> DataFrame:
    """path (array of ids) of every walk of least to most edges that repeats no node, or with closed, of
    those that come back to their start, each once from its least node."""
    rounds = Rounds(edges.sparkSession)
    step = rounds.hold(edges.select(F.col("src").alias("at"), F.col("dst").alias("to")).distinct())
    now = step.filter("at <> to" if not closed else "at <= to").select(F.array("at", "to").alias("path"))
    done = []
    for n in range(1, most + 1):
        now = rounds.hold(now)
        if n >= least:
            done.append(now.filter(F.col("path")[0] == F.element_at("path", -1)) if closed else now)
        if n == most:
            break
        open_ = now.filter(F.col("path")[0] != F.element_at("path", -1))
        more = open_.join(step, F.element_at("path", -1) == F.col("at"))
        again = F.array_contains("path", F.col("to"))
        ok = (~again & (F.col("to") > F.col("path")[0])) | (F.col("to") == F.col("path")[0]) if closed else ~again
        now = more.filter(ok).select(F.concat("path", F.array("to")).alias("path"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def waves(nodes: DataFrame, depends: DataFrame) -> DataFrame:
    """id and wave of every node, in as many waves as it takes: a node's wave comes when all that it depends on (src on dst) have gone. Where none can
    go, the one with the fewest left, the first of those, goes alone."""
    rounds = Rounds(nodes.sparkSession)
    left = nodes.select("id", "ordinal")
    need = depends.filter("src <> dst").select("src", "dst").distinct()
    need = rounds.hold(need.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi"))
    out = None
    for n in count(1):
        unmet = need.groupBy("src").agg(F.count(F.lit(1)).alias("unmet"))
        state = rounds.hold(left.join(unmet, F.col("id") == F.col("src"), "left").select("id", "ordinal", F.coalesce("unmet", F.lit(0)).alias("unmet")))
        free, blocked = state.agg(F.count_if(F.col("unmet") == 0), F.count_if(F.col("unmet") > 0)).first()
        go = (state.filter("unmet = 0") if free else state.orderBy("unmet", "ordinal").limit(1)).select("id")
        part = go.withColumn("wave", F.lit(n))
        out = part if out is None else out.unionByName(part)
        if not blocked:
            break
        left = state.select("id", "ordinal").join(go, "id", "left_anti")
        need = rounds.hold(need.join(go.withColumnRenamed("id", "dst"), "dst", "left_anti").join(go.withColumnRenamed("id", "src"), "src", "left_anti"))
    return out


def cycle_members(edges: DataFrame) -> DataFrame:
    """id and component: strongly connected components of two nodes or more, named by their least node.

    Nodes that nothing enters or leaves are trimmed away; then the greatest ids that reach each node and that it
    reaches are spread until they stand still, nodes where both agree are a component, and the rest goes on.
    """
    rounds = Rounds(edges.sparkSession)
    left = rounds.hold(edges.filter("src <> dst").select("src", "dst").distinct())
    out = None
    while True:
        while True:  # trim
            kept = rounds.hold(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
            same = kept.count() == left.count()
            left = kept
            if same:
                break
        if left.isEmpty():
            break
        ids = left.select(F.col("src").alias("id")).unionByName(left.select(F.col("dst").alias("id"))).distinct()
        ahead, back = (_spread(rounds, ids, left.selectExpr(*e)) for e in (("src as a", "dst as b"), ("dst as a", "src as b")))
        both = rounds.hold(ahead.join(back.withColumnRenamed("mark", "other"), "id").filter("mark = other"))
        names = both.groupBy("mark").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        part = rounds.hold(both.join(names, "mark").select("id", "component"))
        out = part if out is None else out.unionByName(part)
        gone = both.select("id")
        left = rounds.hold(left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"))
    return out if out is not None else edges.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)


def _spread(rounds: Rounds, ids: DataFrame, edges: DataFrame) -> DataFrame:
    now = rounds.hold(ids.withColumn("mark", F.col("id")))
    while True:
        sent = edges.join(now, F.col("a") == F.col("id")).select(F.col("b").alias("id"), "mark")
        new = rounds.hold(now.unionByName(sent).groupBy("id").agg(F.max("mark").alias("mark")))
        if new.join(now, ["id", "mark"], "left_anti").isEmpty():
            return new
        now = new
