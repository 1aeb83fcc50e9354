"""Graph measures and paths on edge tables (graph, src, dst, weight).

`graph` names independent graphs, so a corpus of small graphs is one job. PageRank, components, neighbourhoods
and eigenvector centrality are loops of joins with checkpointed steps and scale to one large graph.
Betweenness, closeness, communities and weighted paths run per graph in an Arrow group function, whose graph must
fit one worker: they are meant for graphs of documents and questions, of up to some ten thousand edges each.
"""

from __future__ import annotations

import heapq
from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.storage import cut


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select("graph", F.col("src").alias("node")).union(edges.select("graph", F.col("dst").alias("node"))).distinct()


def degree(edges: DataFrame) -> DataFrame:
    """In plus out degree; a self-loop counts twice."""
    ends = edges.select("graph", F.col("src").alias("node")).union(edges.select("graph", F.col("dst").alias("node")))
    return ends.groupBy("graph", "node").agg(F.count(F.lit(1)).alias("degree"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    d = degree(edges)
    n = d.groupBy("graph").agg(F.count(F.lit(1)).alias("n"))
    return d.join(n, "graph").select("graph", "node", F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(1.0).alias("centrality"))


def density(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Nodes, edges and e / (n (n - 1)) to six places of each graph."""
    counts = (nodes if nodes is not None else nodes_of(edges)).groupBy("graph").agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.groupBy("graph").agg(F.count(F.lit(1)).alias("edges"))
    ratio = F.when(F.col("nodes") > 1, F.round(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 6)).otherwise(0.0)
    return counts.join(e, "graph", "left").na.fill(0, ["edges"]).select("graph", "nodes", "edges", ratio.alias("density"))


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 100, nodes: DataFrame | None = None, tolerance: float | None = None, every: int = 2) -> DataFrame:
    """Weighted PageRank with uniform redistribution of dangling mass, for all graphs together.

    A fixed number of iterations, or fewer once every graph's L1 change is below nodes * tolerance (tested each
    `every` steps, when the ranks are written to shared storage and their lineage ends; a step reads the ranks
    twice, so plans between checkpoints are kept short).
    """
    node = cut((nodes if nodes is not None else nodes_of(edges)).select("graph", "node").distinct())
    out = edges.groupBy("graph", "src").agg(F.sum("weight").alias("total"))
    share = cut(edges.join(out, ["graph", "src"]).filter("total > 0").select("graph", "src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    size = node.groupBy("graph").agg(F.count(F.lit(1)).cast("double").alias("n"))
    sinks = node.join(share.select("graph", F.col("src").alias("node")).distinct(), ["graph", "node"], "left_anti").withColumn("sink", F.lit(True))
    state = cut(node.join(size, "graph").join(sinks, ["graph", "node"], "left").select("graph", "node", "n", F.coalesce("sink", F.lit(False)).alias("sink"), (1 / F.col("n")).alias("rank")))
    before, leaks = state, not state.filter("sink").isEmpty()
    for step in range(1, iterations + 1):
        sent = share.join(state.select("graph", F.col("node").alias("src"), "rank"), ["graph", "src"]).groupBy("graph", F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        mass = F.coalesce("got", F.lit(0.0))
        if leaks:  # one row a graph, joined back: no task meets a whole graph
            lost = state.filter("sink").groupBy("graph").agg(F.sum("rank").alias("lost"))
            state, mass = state.join(lost, "graph", "left"), mass + F.coalesce("lost", F.lit(0.0)) / F.col("n")
        state = state.join(sent, ["graph", "node"], "left")
        rank = (1 - damping) / F.col("n") + damping * mass
        state = state.select("graph", "node", "n", "sink", rank.alias("rank"))
        if step % every == 0 or step == iterations:
            state = cut(state)
            if tolerance is not None:
                change = state.join(before.select("graph", "node", F.col("rank").alias("old")), ["graph", "node"]).groupBy("graph").agg(F.sum(F.abs(F.col("rank") - F.col("old"))).alias("c"), F.max("n").alias("n"))
                if change.filter(F.col("c") >= F.col("n") * tolerance).isEmpty():
                    break
                before = state
    return state.select("graph", "node", F.col("rank").alias("pagerank"))


def eigenvector(edges: DataFrame, iterations: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """Eigenvector centrality by power iteration of (A + I), normalised each step; the start is uniform.

    Ends once every graph's L1 change in a step is below nodes * tolerance, or after `iterations` steps.
    """
    node = nodes_of(edges)
    size = node.groupBy("graph").agg(F.count(F.lit(1)).alias("n"))
    links = cut(edges.select("graph", "src", "dst").distinct())
    state = cut(node.join(size, "graph").select("graph", "node", (1.0 / F.sqrt("n")).alias("x")))
    for step in range(1, iterations + 1):
        got = links.join(state.select("graph", F.col("node").alias("src"), "x"), ["graph", "src"]).groupBy("graph", F.col("dst").alias("node")).agg(F.sum("x").alias("got"))
        raw = state.join(got, ["graph", "node"], "left").select("graph", "node", (F.col("x") + F.coalesce("got", F.lit(0.0))).alias("x"))
        raw = cut(raw)
        length = raw.groupBy("graph").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
        before, state = state, raw.join(length, "graph").select("graph", "node", (F.col("x") / F.col("length")).alias("x"))
        if tolerance is not None and step % 4 == 0:
            change = state.join(before.select("graph", "node", F.col("x").alias("old")), ["graph", "node"]).groupBy("graph").agg(F.sum(F.abs(F.col("x") - F.col("old"))).alias("c"), F.count(F.lit(1)).alias("n"))
            if change.filter(F.col("c") >= F.col("n") * tolerance).isEmpty():
                break
    return state.select("graph", "node", F.col("x").alias("eigenvector"))


def eigenvector_or_pagerank(edges: DataFrame, iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """graph, node, centrality: eigenvector centrality, or PageRank for graphs in which it hasn't settled after `iterations` steps."""
    last, more = eigenvector(edges, iterations, tolerance), eigenvector(edges, iterations + 1, None)
    both = cut(last.join(more.withColumnRenamed("eigenvector", "next"), ["graph", "node"]))
    settled = both.groupBy("graph").agg((F.sum(F.abs(F.col("next") - F.col("eigenvector"))) < F.count(F.lit(1)) * tolerance * 10).alias("settled"))
    rank = pagerank(edges, iterations=iterations, tolerance=tolerance)
    return both.join(settled, "graph").join(rank, ["graph", "node"]).select("graph", "node", F.when(F.col("settled"), F.col("eigenvector")).otherwise(F.col("pagerank")).alias("centrality"))


def connected_components(edges: DataFrame) -> DataFrame:
    """graph, node, component: the smallest node reached over undirected edges, by min-label steps with pointer jumping."""
    both = cut(edges.select("graph", "src", "dst").union(edges.select("graph", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = cut(both.groupBy("graph", F.col("src").alias("node")).agg(F.least(F.first("src"), F.min("dst")).alias("component")))
    while True:
        near = both.join(labels.select("graph", F.col("node").alias("dst"), F.col("component").alias("c")), ["graph", "dst"]).groupBy("graph", F.col("src").alias("node")).agg(F.min("c").alias("c"))
        step = labels.join(near, ["graph", "node"]).select("graph", "node", F.col("component").alias("old"), F.least("component", "c").alias("component"))
        step = cut(step)
        # only labels that have moved on themselves are looked up
        heads = step.filter("component < node").select("graph", F.col("node").alias("component"), F.col("component").alias("next"))
        jump = step.select("graph", "component").distinct().join(heads, ["graph", "component"])
        moved = cut(step.join(jump, ["graph", "component"], "left").select("graph", "node", "old", F.coalesce("next", "component").alias("component")))
        labels = moved.select("graph", "node", "component")
        if moved.filter("old <> component").isEmpty():
            return labels


def neighbourhood(edges: DataFrame, starts: DataFrame, hops: int | None, directed: bool = True) -> DataFrame:
    """start, node, distance for nodes within `hops` of each start, or all that it reaches: breadth first, the visited removed by anti-join."""
    links = edges.select("graph", "src", "dst")
    if not directed:
        links = links.union(edges.select("graph", F.col("dst"), F.col("src")))
    links = cut(links.distinct())
    seen = frontier = cut(starts.select("graph", F.col("node").alias("start"), "node", F.lit(0).alias("distance")).distinct())
    d = 0
    while hops is None or d < hops:
        d += 1
        reached = frontier.join(links, (links.graph == frontier.graph) & (links.src == frontier.node)).select(frontier.graph, "start", F.col("dst").alias("node")).distinct()
        frontier = cut(reached.join(seen.select("graph", "start", "node"), ["graph", "start", "node"], "left_anti").withColumn("distance", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def hop_distance(edges: DataFrame, pairs: DataFrame, most: int | None = None, directed: bool = False) -> DataFrame:
    """graph, a, b, length of the shortest path (of at most `most` steps, if that is given); null if there is none."""
    starts = pairs.select("graph", F.col("a").alias("node")).distinct()
    reach = neighbourhood(edges, starts, most, directed).select("graph", F.col("start").alias("a"), F.col("node").alias("b"), F.col("distance").alias("length"))
    return pairs.select("graph", "a", "b").join(reach, ["graph", "a", "b"], "left")


def traverse(edges: DataFrame, seeds: DataFrame, centrality: DataFrame, types: list[str], depth: int = 2, width: int = 5) -> DataFrame:
    """Nodes reached from the seeds: each step looks at a node's `width` most central successors and, of these, follows edges of the types.

    The cut to `width` comes before the tests of type and of visited nodes. seeds: graph, node.
    """
    ranked = edges.join(centrality.select("graph", F.col("node").alias("dst"), "centrality"), ["graph", "dst"], "left")
    w = Window.partitionBy("graph", "src").orderBy(F.desc(F.coalesce("centrality", F.lit(0.0))), "dst")
    steps = cut(ranked.withColumn("n", F.row_number().over(w)).filter((F.col("n") <= width) & F.col("type").isin(types)).select("graph", "src", "dst"))
    seen = frontier = cut(seeds.select("graph", "node").distinct().withColumn("depth", F.lit(0)))
    for d in range(1, depth + 1):
        reached = frontier.select("graph", F.col("node").alias("src")).join(steps, ["graph", "src"]).select("graph", F.col("dst").alias("node")).distinct()
        frontier = cut(reached.join(seen.select("graph", "node"), ["graph", "node"], "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(frontier)
    return seen.filter("depth > 0")


def _adjacency(pdf: pd.DataFrame, directed: bool) -> tuple[list, dict]:
    near: dict = defaultdict(dict)
    for s, d, w in zip(pdf["src"], pdf["dst"], pdf["weight"], strict=True):
        near[s][d] = w
        near[d]
        if not directed:
            near[d][s] = w
    return sorted(near), near


def betweenness(edges: DataFrame, directed: bool = True) -> DataFrame:
    """Unweighted normalised betweenness (Brandes 2001) of each graph, in one group a graph."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names, near = _adjacency(pdf, directed)
        score = dict.fromkeys(names, 0.0)
        for s in names:
            order, back, paths, dist, queue = [], defaultdict(list), defaultdict(float, {s: 1.0}), {s: 0}, deque([s])
            while queue:
                v = queue.popleft()
                order.append(v)
                for t in near[v]:
                    if t not in dist:
                        dist[t] = dist[v] + 1
                        queue.append(t)
                    if dist[t] == dist[v] + 1:
                        paths[t] += paths[v]
                        back[t].append(v)
            gain = defaultdict(float)
            for t in reversed(order):
                for v in back[t]:
                    gain[v] += paths[v] / paths[t] * (1 + gain[t])
                if t != s:
                    score[t] += gain[t]
        n = len(names)
        scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
        return pd.DataFrame({"graph": key[0], "node": names, "betweenness": [score[v] * scale for v in names]})

    kinds = dict(edges.dtypes)
    return edges.select("graph", "src", "dst", "weight").groupBy("graph").applyInPandas(run, f"graph {kinds['graph']}, node {kinds['src']}, betweenness double")


def closeness(edges: DataFrame) -> DataFrame:
    """Closeness over incoming paths, scaled by the reached share."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names, near = _adjacency(pdf, True)
        into = defaultdict(list)
        for s in names:
            for t in near[s]:
                into[t].append(s)
        out, n = [], len(names)
        for s in names:
            dist, queue = {s: 0}, deque([s])
            while queue:
                v = queue.popleft()
                for t in into[v]:
                    if t not in dist:
                        dist[t] = dist[v] + 1
                        queue.append(t)
            total = sum(dist.values())
            out.append((len(dist) - 1) / total * (len(dist) - 1) / (n - 1) if total and n > 1 else 0.0)
        return pd.DataFrame({"graph": key[0], "node": names, "closeness": out})

    kinds = dict(edges.dtypes)
    return edges.select("graph", "src", "dst", "weight").groupBy("graph").applyInPandas(run, f"graph {kinds['graph']}, node {kinds['src']}, closeness double")


def communities(edges: DataFrame) -> DataFrame:
    """Greedy modularity communities (Clauset, Newman, Moore 2004) of each undirected graph, numbered by falling size and smallest node."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names, near = _adjacency(pdf.assign(weight=1.0), False)
        total = sum(len(near[v]) + (v in near[v]) for v in names) / 2
        groups = {v: {v} for v in names}
        links = {v: {t: 1.0 for t in near[v] if t != v} for v in names}
        share = {v: (len(near[v]) + (v in near[v])) / (2 * total) for v in names}
        heap = [(-(1 / total - 2 * share[a] * share[b]), a, b) for a in names for b in links[a] if a < b]
        heapq.heapify(heap)
        while heap:
            gain, a, b = heapq.heappop(heap)
            if a not in links or b not in links[a] or -gain != links[a][b] / total - 2 * share[a] * share[b]:
                continue
            if gain >= 0:
                break
            groups[a] |= groups.pop(b)
            for t, w in links.pop(b).items():
                links[t].pop(b)
                if t != a:
                    links[a][t] = links[t][a] = links[a].get(t, 0.0) + w
            share[a] += share.pop(b)
            for t in links[a]:
                x, y = min(a, t), max(a, t)
                heapq.heappush(heap, (-(links[a][t] / total - 2 * share[a] * share[t]), x, y))
        ordered = sorted(groups.values(), key=lambda g: (-len(g), min(g)))
        rows = [(key[0], v, k) for k, g in enumerate(ordered) for v in sorted(g)]
        return pd.DataFrame(rows, columns=["graph", "node", "community"])

    kinds = dict(edges.dtypes)
    return edges.select("graph", "src", "dst", "weight").groupBy("graph").applyInPandas(run, f"graph {kinds['graph']}, node {kinds['src']}, community int")


def weighted_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """graph, a, b, nodes, length of the path with the least summed weight along directed edges; no row if there is none."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        _, near = _adjacency(left, True)
        rows = []
        for a, targets in right.groupby("a")["b"]:
            best, via, heap, done = {a: 0.0}, {}, [(0.0, a)], set()
            while heap:
                d, v = heapq.heappop(heap)
                if v in done:
                    continue
                done.add(v)
                for t, w in near.get(v, {}).items():
                    if d + w < best.get(t, float("inf")):
                        best[t], via[t] = d + w, v
                        heapq.heappush(heap, (d + w, t))
            for b in sorted(set(targets)):
                if b in best:
                    path = [b]
                    while path[-1] != a:
                        path.append(via[path[-1]])
                    rows.append((key[0], a, b, path[::-1], best[b]))
        return pd.DataFrame(rows, columns=["graph", "a", "b", "nodes", "length"])

    kinds = dict(edges.dtypes)
    g, n = kinds["graph"], kinds["src"]
    left = edges.select(*(F.col(c).alias(c) for c in ("graph", "src", "dst", "weight")))
    right = pairs.select(*(F.col(c).alias(c) for c in ("graph", "a", "b")))
    return left.groupBy("graph").cogroup(right.groupBy("graph")).applyInPandas(run, f"graph {g}, a {n}, b {n}, nodes array<{n}>, length double")


def span_centrality(edges: DataFrame, iterations: int = 100) -> DataFrame:
    """The mean of PageRank and betweenness."""
    both = pagerank(edges, iterations=iterations, tolerance=1e-6).join(betweenness(edges), ["graph", "node"])
    return both.select("graph", "node", ((F.col("pagerank") + F.col("betweenness")) / 2).alias("centrality"))


def metric_bundle(edges: DataFrame, iterations: int = 100) -> DataFrame:
    """PageRank and degree of each node."""
    return pagerank(edges, iterations=iterations, tolerance=1e-6).join(degree(edges), ["graph", "node"])
