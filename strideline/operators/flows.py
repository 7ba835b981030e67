"""Junction sequences, transitions and what is predicted from them.

A point's node is one case expression over a few junctions and zones, or for many an equality join on the cells of a grid,
so visits need a single shuffle by trajectory and no row for each point and junction; counts after that are partial
aggregations over (origin, dest).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideline.functions.geometry import distance
from strideline.operators import grid
from strideline.operators.metrics import in_zone
from strideline.plans.params import Junction, Zone


def node_of(at: Sequence[Junction]) -> Column:
    """The first listed junction whose reach holds the point; null for none."""
    return F.coalesce(*[F.when(distance(F.col("x"), F.col("z"), float(j.cx), float(j.cz)) <= float(j.reach), j.junction) for j in at], F.lit(None).cast("int"))


#: Junctions or zones that one expression tests; more are found through a grid.
FEW = 32


def with_node(points: DataFrame, at: Sequence[Junction]) -> DataFrame:
    """points with junction: node_of() for any number of junctions."""
    if len(at) <= FEW:
        return points.withColumn("junction", node_of(at))
    return grid.holding(points, grid.of_junctions(at)).withColumn("junction", F.get("_held", F.lit(0))["junction"]).drop("_held")


def with_zone(points: DataFrame, zones: Sequence[Zone], as_: str) -> DataFrame:
    """points with the name of the first listed zone that holds each; null for none."""
    if len(zones) <= FEW:
        return points.withColumn(as_, F.coalesce(*[F.when(in_zone(z), z.name) for z in zones], F.lit(None).cast("string")))
    return grid.holding(points, grid.of_zones(zones), zones).withColumn(as_, F.get("_held", F.lit(0))["name"]).drop("_held")


def _changes(nodes: DataFrame) -> DataFrame:
    """trajectory, visit, junction, idx: points whose node is another than the point's before, none being a node too."""
    w = Window.partitionBy("trajectory").orderBy("idx")
    new = nodes.withColumn("_before", F.lag("junction").over(w)).where(F.col("junction").isNotNull() & ~F.col("junction").eqNullSafe(F.col("_before")))
    return new.select("trajectory", (F.row_number().over(w) - 1).alias("visit"), "junction", "idx")


def visits(points: DataFrame, at: Sequence[Junction]) -> DataFrame:
    """trajectory, visit, junction, idx: the junctions in the order of their visits; one left and entered again is visited twice."""
    return _changes(with_node(points, at).select("trajectory", "idx", "junction"))


def visits_with_zones(points: DataFrame, at: Sequence[Junction], starts: Sequence[Zone] = (), ends: Sequence[Zone] = ()) -> DataFrame:
    """visits() over junctions, start zones and end zones (in this order) as text nodes, begun by the start zone of the first point and ended by the end zone of the last, where there is one and the sequence does not have it there."""
    rows = with_zone(with_zone(with_node(points.select("trajectory", "idx", "x", "z"), at), starts, "start"), ends, "end")
    rows = rows.select("trajectory", "idx", F.coalesce(F.concat(F.lit("J"), F.col("junction").cast("string")), "start", "end").alias("junction"), "start", "end")
    seen = _changes(rows).select("trajectory", F.col("idx").cast("double").alias("place"), "junction")
    edge = rows.groupBy("trajectory").agg(F.min(F.struct("idx", "start")).alias("a"), F.max(F.struct("idx", "end")).alias("b"))
    ends_of = seen.groupBy("trajectory").agg(F.min(F.struct("place", "junction"))["junction"].alias("first"), F.max(F.struct("place", "junction"))["junction"].alias("last"))
    edge = edge.join(ends_of, "trajectory", "left")
    begun = edge.where(F.col("a.start").isNotNull() & ~F.col("a.start").eqNullSafe(F.col("first"))).select("trajectory", F.lit(-0.5).alias("place"), F.col("a.start").alias("junction"))
    ended = edge.where(F.col("b.end").isNotNull() & ~F.col("b.end").eqNullSafe(F.col("last"))).select("trajectory", (F.col("b.idx") + 0.5).alias("place"), F.col("b.end").alias("junction"))
    every = seen.unionByName(begun).unionByName(ended)
    return every.withColumn("visit", F.row_number().over(Window.partitionBy("trajectory").orderBy("place")) - 1).select("trajectory", "visit", "junction")


def transitions(seen: DataFrame, *, loops: bool = False) -> DataFrame:
    """trajectory, visit, origin, dest: consecutive visits; those to the same junction only with loops."""
    w = Window.partitionBy("trajectory").orderBy("visit")
    pairs = seen.select("trajectory", "visit", F.col("junction").alias("origin"), F.lead("junction").over(w).alias("dest")).where("dest is not null")
    return pairs if loops else pairs.where("origin <> dest")


def counts(moves: DataFrame) -> DataFrame:
    """origin, dest, n."""
    return moves.groupBy("origin", "dest").agg(F.count("*").alias("n"))


def conditional(flow: DataFrame) -> DataFrame:
    """origin, dest, n, percent of the origin's departures."""
    return flow.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("origin")))


def overall(flow: DataFrame, points: DataFrame) -> DataFrame:
    """origin, dest, n, share of all trajectories of the input (also those that visit nothing)."""
    total = points.agg(F.countDistinct("trajectory").alias("total"))
    return flow.crossJoin(F.broadcast(total)).select("origin", "dest", "n", (F.col("n") / F.col("total")).alias("share"))


def zone_flows(seen: DataFrame) -> DataFrame:
    """origin, dest, n, share, exit_share: transitions (loops too) counted once a trajectory, over all and over the origin's."""
    flow = counts(transitions(seen, loops=True).select("trajectory", "origin", "dest").distinct())
    total = seen.agg(F.countDistinct("trajectory").alias("total"))
    return flow.crossJoin(F.broadcast(total)).select("origin", "dest", "n", (F.col("n") / F.col("total")).alias("share"), (F.col("n") / F.sum("n").over(Window.partitionBy("origin"))).alias("exit_share"))


def zone_points(points: DataFrame, starts: Sequence[Zone], ends: Sequence[Zone]) -> DataFrame:
    """start_points and end_points: points inside any start or end zone."""
    rows = with_zone(with_zone(points.select("x", "z"), starts, "start"), ends, "end")
    return rows.agg(F.count("start").alias("start_points"), F.count("end").alias("end_points"))


def strong(flow: DataFrame, least: float, share: str = "share") -> DataFrame:
    """Flows between different nodes with a share of least or more, with their intensity relative to the greatest."""
    kept = flow.where((F.col(share) >= least) & (F.col("origin") != F.col("dest")))
    top = kept.agg(F.max(share).alias("_top"))
    return kept.crossJoin(F.broadcast(top)).withColumn("intensity", F.col(share) / F.col("_top")).drop("_top")


def direct(points: DataFrame, at: Sequence[Junction], assigned: DataFrame) -> DataFrame:
    """origin, dest, n, share: trajectories that leave one junction's double radius before they first come into another's, touching no third in between.

    assigned (trajectory, junction, branch) says which junctions count for a trajectory; all are touched alike.

    A sweep over the points near junctions, which a grid finds: touches cut a trajectory into stretches, and a pair has no
    touch between leaving and coming just when both lie in one stretch. A touch as the origin is left rules it out
    unless it is the origin's own; a destination's own touches come later than its first point.
    """
    wide = grid.near(points.select("trajectory", "idx", "x", "z"), [grid.disc(k, j.junction, None, j.cx, j.cz, 2 * j.r) for k, j in enumerate(at)])
    rows = wide.select("trajectory", "idx", "junction", (F.col("dist") <= F.col("radius") / 2).cast("int").alias("touch"))
    each, here, run = Window.partitionBy("trajectory", "junction"), Window.partitionBy("trajectory", "idx"), Window.partitionBy("trajectory").orderBy("idx")
    rows = rows.withColumns({"leave": F.max("idx").over(each), "come": F.min("idx").over(each), "touches": F.sum("touch").over(here), "turn": F.row_number().over(here.orderBy("junction"))})
    upto = F.sum(((F.col("touches") > 0) & (F.col("turn") == 1)).cast("int")).over(run)  # rows of one point share it
    rows = rows.withColumn("upto", upto)
    origin = (F.col("idx") == F.col("leave")) & (F.col("touches") == F.col("touch"))
    before = F.col("upto") - (F.col("touches") > 0).cast("int")
    event = lambda when, stretch, kind: F.when(when, F.struct(stretch.alias("stretch"), F.lit(kind).alias("origin")))
    events = rows.select("trajectory", "junction", "idx", F.explode(F.array(event(origin, F.col("upto"), True), event(F.col("idx") == F.col("come"), before, False))).alias("e")).where("e is not null")
    counted = events.join(assigned.where("branch >= 0").select("trajectory", "junction"), ["trajectory", "junction"], "left_semi")
    side = lambda kind: F.collect_list(F.when(F.col("e.origin") == kind, F.struct("junction", "idx")))  # noqa: E731  a trajectory has few junctions
    both = counted.groupBy("trajectory", "e.stretch").agg(side(True).alias("from"), side(False).alias("to"))
    pairs = both.select("to", F.explode("from").alias("o")).select("o", F.explode("to").alias("d")).where("o.junction <> d.junction and o.idx < d.idx")
    kept = counts(pairs.select(F.col("o.junction").alias("origin"), F.col("d.junction").alias("dest")))
    total = kept.agg(F.sum("n").alias("_all"))
    return kept.crossJoin(F.broadcast(total)).select("origin", "dest", "n", (F.col("n") / F.col("_all")).alias("share"))  # one row


def fan_out(flow: DataFrame) -> DataFrame:
    """pattern, origins: origins by their number of destinations."""
    kinds = F.when(F.col("k") == 1, "Single Route").when(F.col("k") == 2, "Two Routes").otherwise("Multiple Routes")
    return flow.groupBy("origin").agg(F.count("*").alias("k")).groupBy(kinds.alias("pattern")).agg(F.count("*").alias("origins"))


def strength(probabilities: DataFrame) -> DataFrame:
    """conditional() with strength: preferred from 70 percent, learned from 50, direct from 30, else weak."""
    p = F.col("percent")
    return probabilities.withColumn("strength", F.when(p >= 70, "preferred").when(p >= 50, "learned").when(p >= 30, "direct").otherwise("weak"))


def predictions(probabilities: DataFrame, most: int = 20) -> DataFrame:
    """origin, dest, confidence: each origin's likeliest destination, up to `most` origins."""
    best = F.row_number().over(Window.partitionBy("origin").orderBy(F.desc("percent"), "dest"))
    top = probabilities.withColumn("_k", best).where("_k = 1")
    return top.select("origin", "dest", F.least(F.col("percent") / 100.0, F.lit(0.9)).alias("confidence")).orderBy("origin").limit(most)


def results(flow: DataFrame, seen: DataFrame) -> DataFrame:
    """trajectories, origins and transitions (different pairs)."""
    return seen.agg(F.countDistinct("trajectory").alias("trajectories")).crossJoin(flow.agg(F.countDistinct("origin").alias("origins"), F.count("*").alias("transitions")))


def after(seen: DataFrame) -> DataFrame:
    """origin, via, dest, n, percent: where trajectories go from via when they came from origin (first time each), unless they stay."""
    w = Window.partitionBy("trajectory").orderBy("visit")
    three = seen.select("trajectory", "visit", F.lag("junction").over(w).alias("origin"), F.col("junction").alias("via"), F.lead("junction").over(w).alias("dest")).where("origin is not null")
    first = three.groupBy("trajectory", "origin", "via").agg(F.min(F.struct("visit", "dest"))["dest"].alias("dest"))
    flow = first.where("dest is not null and dest <> via").groupBy("origin", "via", "dest").agg(F.count("*").alias("n"))
    return flow.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("origin", "via")))


def before(seen: DataFrame) -> DataFrame:
    """via, dest, origin, n, percent: where trajectories that go from via to dest (first time each) came from: the last junction before that is not via."""
    w = Window.partitionBy("trajectory").orderBy("visit")
    runs = seen.withColumns({"_change": F.when(F.lag("junction").over(w).eqNullSafe(F.col("junction")), 0).otherwise(1)})
    changed = runs.where("_change = 1").select("trajectory", "visit", F.lag("junction").over(w).alias("origin"))
    held = runs.withColumn("dest", F.lead("junction").over(w)).where("dest is not null").select("trajectory", "visit", F.col("junction").alias("via"), "dest")
    first = held.groupBy("trajectory", "via", "dest").agg(F.min("visit").alias("visit"))
    both = first.join(changed.withColumnRenamed("visit", "_at"), "trajectory").where("_at <= visit").groupBy("trajectory", "via", "dest").agg(F.max(F.struct("_at", "origin"))["origin"].alias("origin"))
    flow = both.where("origin is not null").groupBy("via", "dest", "origin").agg(F.count("*").alias("n"))
    return flow.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("via", "dest")))


def next_choice(second: DataFrame, origin: int, via: int) -> tuple[str, float]:
    """The likeliest destination after origin and via from after(), and its share; ("Unknown", 0.0) without any."""
    top = second.where((F.col("origin") == origin) & (F.col("via") == via)).orderBy(F.desc("percent"), "dest").first()
    return (f"J{top['dest']}", top["percent"] / 100.0) if top else ("Unknown", 0.0)


def _prefixes(chains: DataFrame) -> DataFrame:
    """route: the branches of each row of a chain table before the first null, where there are two or more."""
    columns = [c for c in chains.columns if c.startswith("branch_j")]
    cells = F.array(*[F.col(c).cast("int") for c in columns])
    prefix = F.slice(cells, 1, F.coalesce(F.nullif(F.array_position(F.transform(cells, lambda b: b.isNull()), True), F.lit(0)) - 1, F.size(cells)).cast("int"))
    return chains.select(prefix.alias("route")).where(F.size("route") > 1)


def routes(chains: DataFrame, most: int = 10) -> DataFrame:
    """route, n, share: the branches of a chain table before the first null, of two or more, that several trajectories share; the most frequent."""
    some = _prefixes(chains)
    grouped = some.groupBy("route").agg(F.count("*").alias("n"))
    total = some.agg(F.count("*").alias("total"))
    return grouped.where("n > 1").crossJoin(F.broadcast(total)).select(F.array_join("route", "-").alias("route"), "n", (F.col("n") / F.col("total")).alias("share")).orderBy(F.desc("n"), "route").limit(most)


def route_statistics(chains: DataFrame) -> DataFrame:
    """sequences, different (routes), mean_length (0 without any), lengths (length to count, as JSON) of routes."""
    g = _prefixes(chains).groupBy("route").agg(F.count("*").alias("n")).groupBy(F.size("route").alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("different"))
    out = g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("sequences"), F.coalesce(F.sum("different"), F.lit(0)).alias("different"), F.coalesce(F.sum(F.col("k") * F.col("n")) / F.sum("n"), F.lit(0.0)).alias("mean_length"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias("lengths"))
    return out.withColumn("lengths", F.to_json("lengths"))
