"""Loops over an edge table.  Every round is one declarative plan over tables of edges; its
result is checkpointed to the cluster's shared folder, so that the lineage stays short and a
lost executor costs a read.  Only row counts come to the driver.
"""

from __future__ import annotations

import tempfile
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgertide.functions.expressions import is_burn, is_placeholder
from ledgertide.llm.shared import join_small
from ledgertide.operators.joins import point_in_time_labels, split_legs, value_matches


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.  Where that is unset, local mode takes a temporary
    folder; a cluster must name one that all machines share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ledgertide-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """df, checkpointed under ``shared_root``."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int | None, closed: DataFrame | None = None) -> DataFrame:
    """node, depth (int) of what the seeds (column node) reach over edges (src, dst) in max_depth steps
    (None: in any number, until a step reaches nothing new).
    Nodes in closed (node) are reached but not followed."""
    frontier = settle(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    found = [frontier]  # each step is written once; many are joined to one now and then
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        going = frontier.join(closed.select("node"), "node", "left_anti") if closed is not None else frontier
        reached = edges.join(going.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        visited = reduce(DataFrame.unionByName, found)
        frontier = settle(reached.join(visited.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        found.append(frontier)
        if len(found) > 16:
            found = [settle(reduce(DataFrame.unionByName, found))]
    return reduce(DataFrame.unionByName, found)


STOPS = ("burn", "placeholder", "service label", "contract")


def policy_trace(transfers: DataFrame, seeds: DataFrame, labels: DataFrame, contracts: DataFrame, max_depth: int, dust: float = 10, unpriced_dust: float = 0.001, service_outflows: int = 200) -> DataFrame:
    """node, depth, followed, stopped (why not, null where it is followed) of what the seeds (node) reach by transfers (src,
    dst, address, block_time, usd, amt), under the rules of tracing.

    A transfer counts from ``dust`` on, or without a price from unpriced_dust of the token on.  Its receiver is
    followed unless the address is a burn or a placeholder, its label at that time is a
    service's, it is a contract (column node), or max_depth is reached; a node with more outflows
    than service_outflows is reached, not expanded, unless it is a seed.  A node that one transfer doesn't lead
    into may be followed by another.  The rules are judged once a transfer, the loop walks
    over two tables of edges.
    """
    kept = transfers.where((F.col("usd") >= dust) | (F.col("usd").isNull() & (F.col("amt").isNull() | (F.col("amt") >= unpriced_dust))))
    known = point_in_time_labels(kept, labels).join(contracts.select(F.col("node").alias("dst"), F.lit(True).alias("contract")).distinct(), "dst", "left")
    service = F.col("category").isin("exchange", "exchange_deposit", "exchange_hot_wallet", "mixer", "bridge")
    stop = F.when(is_burn(F.col("address")), 0).when(is_placeholder(F.col("address")), 1).when(F.coalesce(service, F.lit(False)), 2).when(F.coalesce("contract", F.lit(False)), 3)
    edges = settle(known.select("src", "dst", stop.alias("stop")).distinct())
    busy = kept.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > service_outflows).select("node").join(seeds, "node", "left_anti")
    walked = settle(bfs(edges.where("stop IS NULL").select("src", "dst").distinct(), seeds, max_depth - 1, closed=busy))
    open_ = walked.join(busy, "node", "left_anti").where(F.col("depth") < max_depth)
    reached = edges.join(open_.select(F.col("node").alias("src"), "depth"), "src").groupBy(F.col("dst").alias("node")).agg(F.min(F.col("depth") + 1).alias("reached"), F.min("stop").alias("stop"))
    both = reached.join(walked, "node", "full").join(busy.withColumn("busy", F.lit(True)), "node", "left")
    followed = F.col("depth").isNotNull() & F.col("busy").isNull()
    why = F.when(~followed, F.when(F.col("depth").isNotNull(), "service wallet").when(F.col("stop").isNotNull(), F.element_at(F.array(*map(F.lit, STOPS)), F.col("stop") + 1)).otherwise("depth"))
    return both.select("node", F.least("reached", "depth").alias("depth"), followed.alias("followed"), why.alias("stopped"))


def grown_clusters(membership: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """membership (address, chain, cluster_id) and new groups (group_id, address, chain) of two members or more ->
    the new membership, and the forwarding table (merged_id, cluster_id).

    Only clusters that a group touches are looked at: groups that share a member, or a cluster
    through one, become one cluster.  It takes the smallest id of those it touches, and the
    others forward to it; one that touches none gets an id from its smallest member.
    """
    large = groups.groupBy("group_id").agg(F.count_distinct("chain", "address").alias("n")).where("n > 1").select("group_id")
    members = settle(groups.join(large, "group_id", "left_semi").select("group_id", "address", "chain").distinct().join(membership, ["address", "chain"], "left"))
    name = lambda kind, *c: F.concat_ws("|", F.lit(kind), *c)
    group, member = name("g", F.col("group_id").cast("string")), name("m", "chain", "address")
    links = members.select(group.alias("a"), member.alias("b")).unionByName(members.where("cluster_id IS NOT NULL").select(group.alias("a"), name("c", "cluster_id").alias("b")))
    roots = settle(components(links))
    placed = members.withColumn("node", member).join(roots, "node")
    named = placed.groupBy("component").agg(F.min("cluster_id").alias("old"), F.min(F.concat_ws("|", "chain", "address")).alias("least"))
    named = settle(named.select("component", F.coalesce("old", F.concat(F.lit("cluster_"), F.substring(F.sha2(F.col("least").cast("binary"), 256), 1, 12))).alias("canonical")))
    forward = settle(placed.where("cluster_id IS NOT NULL").select(F.col("cluster_id").alias("merged_id"), "component").distinct().join(named, "component").where("merged_id <> canonical").select("merged_id", F.col("canonical").alias("cluster_id")))
    fresh = placed.where("cluster_id IS NULL").select("address", "chain", "component").distinct().join(named, "component").select("address", "chain", F.col("canonical").alias("cluster_id"))
    kept = membership.join(forward.select(F.col("merged_id").alias("cluster_id"), F.col("cluster_id").alias("to")), "cluster_id", "left").select("address", "chain", F.coalesce("to", "cluster_id").alias("cluster_id"))
    return settle(kept.unionByName(fresh)), forward


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of an undirected edge table (a, b), by alternating large
    and small stars: every round is two aggregations, rounds grow with the logarithm of the size."""
    stars = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = settle(large.where("a <> b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        small = settle(small)
        if small.count() == stars.count() and small.exceptAll(stars).isEmpty():
            break
        stars = small
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component of the strongly connected components with two nodes or more.

    Nodes without an edge in or out go; the largest id spreads forward as a colour; from each
    colour's root its own colour is walked backward: what is met is one component.  It goes,
    and the rest starts again.
    """
    rest = settle(edges.where("src <> dst").select("src", "dst").distinct())
    found = None
    while True:
        while True:  # trim
            alive = rest.select(F.col("src").alias("node")).intersect(rest.select(F.col("dst").alias("node")))
            fewer = settle(rest.join(alive.withColumnRenamed("node", "src"), "src", "left_semi").join(alive.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))
            if fewer.count() == rest.count():
                break
            rest = fewer
        if rest.isEmpty():
            break
        colour = settle(rest.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:
            spread = rest.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("new"))
            moved = settle(colour.join(spread, "node", "left").select("node", F.greatest("colour", "new").alias("colour"), (F.col("new") > F.col("colour")).alias("changed")))
            changed = moved.where("changed").isEmpty()
            colour = moved.select("node", "colour")
            if changed:
                break
        inside = rest.join(colour.toDF("src", "ca"), "src").join(colour.toDF("dst", "cb"), "dst").where("ca = cb").select("src", "dst", F.col("ca").alias("colour"))
        inside = settle(inside)
        met = front = settle(colour.where("node = colour"))
        while not front.isEmpty():
            back = inside.join(front.select(F.col("node").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
            front = settle(back.join(met, ["node", "colour"], "left_anti"))
            met = settle(met.unionByName(front))
        found = met if found is None else settle(found.unionByName(met))
        gone = met.select("node")
        rest = settle(rest.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    sizes = found.groupBy("colour").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.join(sizes, "colour").select("node", "component")


def decayed_exposure(edges: DataFrame, sources: DataFrame, decay: float, hops: int, least: float) -> DataFrame:
    """source, node, hop, weight: value that comes from risky sources (column node), times decay a hop
    and shared by the onward edges' parts of all outflow; the best path counts, none visits a node
    twice, and what is below ``least`` is dropped.  edges: src, dst, usd."""
    totals = edges.groupBy("src").agg(F.sum("usd").cast("double").alias("out_total"))
    shared = settle(edges.join(totals, "src").select("src", "dst", F.col("usd").cast("double").alias("usd"), "out_total"))
    mark = lambda c: F.concat(F.lit("|"), F.col(c).cast("string"), F.lit("|"))
    first = shared.join(sources.select(F.col("node").alias("src")), "src", "left_semi").where("src <> dst")
    first = first.select(F.col("src").alias("source"), F.col("dst").alias("node"), F.lit(1).alias("hop"), (F.col("usd") * decay).alias("weight"), F.concat(mark("src"), mark("dst")).alias("path")).where(F.col("weight") >= least)
    best = frontier = settle(first)
    for hop in range(2, hops + 1):
        step = frontier.withColumnRenamed("node", "src").join(shared, "src").where(~F.contains("path", mark("dst")))
        weight = F.col("weight") * (F.col("usd") / F.col("out_total")) * decay
        step = step.select("source", F.col("dst").alias("node"), F.lit(hop).alias("hop"), weight.alias("weight"), F.concat("path", mark("dst")).alias("path")).where(F.col("weight") >= least)
        step = step.groupBy("source", "node").agg(F.max(F.struct("weight", "path")).alias("b")).select("source", "node", F.lit(hop).alias("hop"), "b.weight", "b.path")
        known = best.select("source", "node", F.col("weight").alias("known"))
        frontier = settle(step.join(known, ["source", "node"], "left").where("known IS NULL OR weight > known").drop("known"))
        if frontier.isEmpty():
            break
        best = settle(best.join(frontier.select("source", "node"), ["source", "node"], "left_anti").unionByName(frontier))
    return best.drop("path")


def _side(legs: DataFrame, side: str, node: str, other: str) -> DataFrame:
    """legs as seen from their node, the other columns prefixed."""
    return legs.select(F.col(node).alias("node"), F.col(other).alias(f"{side}_{other}"), *(F.col(c).alias(f"{side}_{c}") for c in ("tx", "log", "token", "time", "symbol", "amt", "usd")))


def value_frontier(legs: DataFrame, seeds: DataFrame, service: DataFrame, rounds: int, days: int, percent: int, split_percent: int, most: int) -> DataFrame:
    """node, depth (int), way: where the money of the seeds (node) goes over distinct legs (src, dst, tx,
    log, token, time, symbol, amt, usd).

    Seeds, and nodes that aren't in service (node), pass on all their outflows.  From a
    service node only the outflows go on that match an inflow by which it was reached, and
    where none does, the legs of that inflow's split.  A node is entered once, by all legs
    of its round; way is seed, or the first of all, match and split that led to it.  Nodes and legs of a
    round are counted, and while they are few the legs of all aren't shuffled to meet them.
    """
    keys, onward = ["node", "i_tx", "i_log", "i_token", "i_src"], ["node", "o_tx", "o_log", "o_token", "o_dst"]
    found = settle(seeds.select("node").distinct().select("node", F.lit(0).alias("depth"), F.lit("seed").alias("way")))
    open_nodes, arrived = found.select("node"), None
    for depth in range(1, rounds + 1):
        going = join_small(legs, open_nodes.select(F.col("node").alias("src")), "src", "left_semi").withColumn("way", F.lit("all"))
        if arrived is not None:
            inbound = settle(_side(arrived.drop("way").distinct(), "i", "dst", "src").join(service.select("node"), "node", "left_semi"))
            outbound = join_small(_side(legs, "o", "src", "dst"), settle(inbound.select("node").distinct()), "node", "left_semi")
            matches = settle(value_matches(inbound, outbound, days, percent))
            splits = split_legs(inbound.join(matches, keys, "left_anti"), outbound, days, split_percent, most)
            chosen = matches.select(*onward, F.lit("match").alias("way")).unionByName(splits.select(*onward, F.lit("split").alias("way"))).distinct()
            chosen = settle(chosen.toDF("src", "tx", "log", "token", "dst", "way"))
            going = going.unionByName(join_small(legs, chosen, ["src", "tx", "log", "token", "dst"], "inner").select(*going.columns))
        arrived = settle(going.join(found.select(F.col("node").alias("dst")), "dst", "left_anti").select(*going.columns))
        if arrived.isEmpty():
            break
        reached = arrived.groupBy(F.col("dst").alias("node")).agg(F.lit(depth).alias("depth"), F.min("way").alias("way"))
        found = settle(found.unionByName(reached.select("node", "depth", "way")))
        open_nodes = settle(arrived.select(F.col("dst").alias("node")).distinct().join(service.select("node"), "node", "left_anti"))
    return found


def label_exposure(edges: DataFrame, victims: DataFrame, risky: DataFrame, hop_weights: list[float]) -> DataFrame:
    """victim, exposure: over the steps from each victim (node), the hop's weight times the value of
    edges into risky nodes, of the victim's own outflow.  A node is visited once a hop.

    A victim is a bit, and a node's row holds 64 of them, so the victims that have come to a node
    are joined and merged as sets and no victim's edges are listed; what a node sends to risky
    ones is summed once.  A step goes only to nodes from which the rest of the hops can
    meet a risky one.
    """
    outflow = edges.join(victims.select(F.col("node").alias("src")), "src", "left_semi").groupBy(F.col("src").alias("victim")).agg(F.sum("usd").alias("drained"))
    numbered = settle(settle(victims.select("node").distinct()).withColumn("id", F.monotonically_increasing_id()))
    risk = settle(edges.join(risky.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi").groupBy(F.col("src").alias("node")).agg(F.sum("usd").alias("risk")))
    ahead = [risk.select("node")]  # whence a risky node is met in so many steps and one
    for _ in hop_weights[2:]:
        before = edges.join(ahead[-1].withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node"))
        ahead.append(settle(before.unionByName(ahead[0]).distinct()))
    front = numbered.select("node", F.shiftright("id", 6).alias("word"), F.expr("shiftleft(1L, CAST(id & 63 AS INT))").alias("bits"))
    parts = []
    for k, weight in enumerate(hop_weights):
        if k:
            step = edges.join(ahead[len(hop_weights) - 1 - k].withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node"), "dst")
            front = settle(front.join(step, "node").groupBy(F.col("dst").alias("node"), "word").agg(F.bit_or("bits").alias("bits")))
            if front.isEmpty():
                break
        held = front.join(risk, "node").select("word", "bits", "risk", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).where("(shiftright(bits, i) & 1) = 1")
        value = held.groupBy((F.shiftleft("word", 6) + F.col("i")).alias("id")).agg(F.sum("risk").alias("value"))
        parts.append(value.select("id", (F.col("value").cast("double") * weight).alias("value")))
    total = reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("value").alias("value")).join(numbered.withColumnRenamed("node", "victim"), "id")
    return total.join(outflow, "victim").select("victim", F.round(F.col("value") / F.col("drained").cast("double"), 6).alias("exposure"))


def peel_links(edges: DataFrame, percent: int) -> DataFrame:
    """src, dst: the remainder link of each node that pays two or more others and percent of it to one
    (the smaller id where two are equal).  edges: src, dst, usd."""
    pairs = edges.groupBy("src", "dst").agg(F.sum("usd").alias("usd"))
    nodes = pairs.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum("usd").alias("total"), F.max("usd").alias("top"), F.max_by("dst", F.struct("usd", -F.col("dst"))).alias("dst"))
    return nodes.where((F.col("n") >= 2) & (F.col("top") * 100 >= F.col("total") * percent)).select("src", "dst")


def follow(links: DataFrame, rounds: int) -> DataFrame:
    """src, dst, hops: where links (src, dst; one of each src) lead from each src, up to 2**rounds of
    them one after another; every round doubles the steps."""
    ahead = settle(links.select("src", "dst", F.lit(1).cast("long").alias("hops")))
    for _ in range(rounds):
        if ahead.join(links.select(F.col("src").alias("dst")), "dst", "left_semi").isEmpty():
            break
        after = ahead.select(F.col("src").alias("dst"), F.col("dst").alias("next"), F.col("hops").alias("more"))
        ahead = settle(ahead.join(after, "dst", "left").select("src", F.coalesce("next", "dst").alias("dst"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")))
    return ahead


def peel_chains(links: DataFrame, least: int, sure: int) -> DataFrame:
    """head, hops, tail, confidence of the chains of links (one of each src) that begin where no link
    ends; a walk stops before a node that it has met.

    After more steps than there are links only cycles are left.  Chains end where they enter
    one, and then go round it once, to the node before the entry.
    """
    links = settle(links)
    rounds = links.count().bit_length()
    ends = follow(links, rounds)
    round_about = settle(ends.join(links.select(F.col("src").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("node")).distinct())
    if not round_about.isEmpty():
        on_cycle = round_about.withColumnRenamed("node", "src")
        ring = settle(links.join(on_cycle, "src", "left_semi"))
        named = components(ring.toDF("a", "b"))
        sizes = named.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
        entries = ring.select(F.col("dst"), F.col("src").alias("before")).join(named.join(sizes, "component").select(F.col("node").alias("dst"), "size"), "dst", "left")
        ends = follow(settle(links.join(on_cycle, "src", "left_anti")), rounds).join(entries, "dst", "left")
        ends = ends.select("src", F.coalesce("before", "dst").alias("dst"), (F.col("hops") + F.coalesce("size", F.lit(1)) - 1).alias("hops"))
    chains = ends.join(links.select(F.col("dst").alias("src")), "src", "left_anti").where(F.col("hops") >= least)
    return chains.select(F.col("src").alias("head"), F.col("dst").alias("tail"), F.col("hops").cast("int").alias("hops"), F.when(F.col("hops") >= sure, "medium").otherwise("low").alias("confidence"))


def top_edges(edges: DataFrame, n: int, order: list) -> DataFrame:
    """The n first edges of each src."""
    place = F.row_number().over(Window.partitionBy("src").orderBy(*order))
    return edges.withColumn("place", place).where(F.col("place") <= n).drop("place")


def group_links(legs: DataFrame, keys: list[str], node: str, time: str, days: int, most: int) -> DataFrame:
    """a, b: nodes that use the same key within days of each other, each linked to the one before it in
    time (which gives the same components as all pairs of a gap that small).  Keys with more than
    ``most`` distinct nodes are shared infrastructure and link nothing."""
    few = legs.groupBy(*keys).agg(F.count_distinct(node).alias("n")).where(F.col("n").between(2, most)).select(*keys)
    used = legs.join(few, keys, "left_semi").groupBy(*keys, node, time).agg(F.count(F.lit(1)).alias("uses"))
    by = Window.partitionBy(*keys).orderBy(time, node)
    gap = F.datediff(time, F.lag(time).over(by))
    return used.select(F.lag(node).over(by).alias("a"), F.col(node).alias("b"), gap.alias("gap")).where(F.col("gap") <= days).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
