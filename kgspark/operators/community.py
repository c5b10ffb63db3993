"""Communities of a graph: detection, membership tables, reports."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions.ids import community_id
from kgspark.operators.components import connected_components
from kgspark.operators.neighbourhood import shared_communities
from kgspark.storage import cut

#: Edges of a component that one task divides; larger ones are divided by label spreading over the cluster first.
COMPONENT_EDGES = 2_000_000


def build_communities(memberships: DataFrame, relations: DataFrame, least: int = 1) -> DataFrame:
    """Entity and relation ids of every ``memberships(id, level, cluster_id)`` group of at least ``least`` entities.

    A relation belongs to every community that holds both of its ends.
    """
    inside = shared_communities(relations, memberships).groupBy("level", "cluster_id").agg(F.array_sort(F.collect_set("relation_id")).alias("relation_ids"))
    members = memberships.groupBy("level", "cluster_id").agg(F.array_sort(F.collect_set("id")).alias("entity_ids")).where(F.size("entity_ids") >= least)
    out = members.join(inside, ["level", "cluster_id"], "left")
    empty = F.array().cast("array<string>")
    return out.select(community_id(F.col("level"), F.col("cluster_id")).alias("id"), "level", "cluster_id", "entity_ids", F.coalesce("relation_ids", empty).alias("relation_ids"))


def keep_memberships(entities: DataFrame, communities: DataFrame) -> DataFrame:
    """Entities whose clusters are only those that have a community row."""
    m = entities.select("id", F.explode("clusters").alias("c"))
    alive = m.join(communities.select("level", "cluster_id"), (F.col("c.level") == F.col("level")) & (F.col("c.cluster_id") == F.col("cluster_id")), "left_semi")
    lists = alive.groupBy("id").agg(F.array_sort(F.collect_set("c")).alias("clusters"))
    return entities.drop("clusters").join(lists, "id", "left")


def _move(nodes: list, links: dict, degree: dict, total: float, resolution: float) -> dict:
    """One pass of greedy modularity moves over a weighted graph, in sorted order; labels of communities."""
    label = {n: n for n in nodes}
    weight = dict(degree)
    moved = True
    rounds = 0
    while moved and rounds < 20:
        moved, rounds = False, rounds + 1
        for n in nodes:
            here, near = label[n], defaultdict(float)
            for m, w in links[n].items():
                if m != n:
                    near[label[m]] += w
            weight[here] -= degree[n]
            gain = lambda c: near[c] - resolution * weight.get(c, 0.0) * degree[n] / total
            best = max(sorted(near), key=lambda c: (gain(c), c == here), default=here)
            if gain(best) <= gain(here) + 1e-12:
                best = here
            weight[best] = weight.get(best, 0.0) + degree[n]
            if best != here:
                label[n], moved = best, True
    return label


def louvain(edges: list[tuple], resolution: float = 1.0) -> dict:
    """Communities of an undirected graph by repeated greedy moves; the same for any order of edges."""
    links: dict = defaultdict(lambda: defaultdict(float))
    for a, b, w in edges:
        if a != b:
            links[a][b] += w
            links[b][a] += w
        else:
            links[a][a] += w
    home = {n: n for n in links}
    total = sum(sum(x.values()) for x in links.values()) or 1.0
    while True:
        nodes = sorted(links)
        degree = {n: sum(links[n].values()) + links[n].get(n, 0.0) for n in nodes}
        label = _move(nodes, links, degree, total, resolution)
        if len(set(label.values())) == len(nodes):
            return home
        home = {n: label[c] for n, c in home.items()}
        merged: dict = defaultdict(lambda: defaultdict(float))
        for a in nodes:
            for b, w in links[a].items():
                merged[label[a]][label[b]] += w / 2 if label[a] == label[b] and a != b else w
        links = merged


def _hierarchy(max_size: int, resolution: float):
    def divide(pdf: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        work = [(0, list(pdf[["a", "b", "w"]].itertuples(index=False, name=None)))]
        while work:
            level, edges = work.pop()
            home = louvain(sorted(edges), resolution)
            groups = defaultdict(list)
            for n, c in home.items():
                groups[c].append(n)
            for members in groups.values():
                head = min(members)
                rows += [(n, level, head) for n in members]
                if len(members) > max_size and len(groups) > 1:
                    inside = set(members)
                    work.append((level + 1, [e for e in edges if e[0] in inside and e[1] in inside]))
        return pd.DataFrame(rows, columns=["id", "level", "head"])

    return divide


def spread_labels(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """``(node, label)`` by label spreading: each node takes the label most of its neighbours have, ties to the smaller.

    The own label counts as much as the heaviest edge. Nodes that then share their
    label with no neighbour are joined to one by ``_settled``. Counts are partial
    before the shuffle, so a hub's neighbours are never gathered.
    """
    both = cut(edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    kept = cut(both.groupBy(F.col("a").alias("node")).agg(F.max("w").alias("w")))
    labels = kept.select("node", F.col("node").alias("label"))
    for _ in range(rounds):
        own = kept.join(labels, "node").select(F.col("node").alias("a"), "label", "w")
        votes = both.join(labels, F.col("b") == F.col("node")).select("a", "label", "w").unionByName(own).groupBy("a", "label").agg(F.sum("w").alias("w"))
        labels = cut(_most_votes(votes).withColumnRenamed("a", "node"))
    return _settled(both, labels)


def _most_votes(votes: DataFrame) -> DataFrame:
    return votes.groupBy("a").agg(F.min_by("label", F.struct((-F.col("w")).alias("w"), "label")).alias("label"))


def _settled(both: DataFrame, labels: DataFrame, rounds: int = 10) -> DataFrame:
    """Labels after nodes that share theirs with no neighbour took one from neighbours that do share theirs.

    Only these nodes change, so what is shared stays so. Where no neighbour shares its
    label either, the smallest id among the node and its neighbours becomes the label.
    """
    for _ in range(rounds):
        seen = both.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
        shared = cut(seen.where("la = lb").select(F.col("a").alias("node")).distinct())
        alone = cut(labels.join(shared, "node", "left_anti").select(F.col("node").alias("a")))
        if not alone.limit(1).count():
            break
        near = cut(both.join(alone, "a", "left_semi"))
        votes = near.join(labels.join(shared, "node", "left_semi"), F.col("b") == F.col("node")).groupBy("a", "label").agg(F.sum("w").alias("w"))
        least = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
        taken = least.join(_most_votes(votes), "a", "left").select(F.col("a").alias("node"), F.coalesce("label", "least").alias("taken"))
        labels = cut(labels.join(taken, "node", "left").select("node", F.coalesce("taken", "label").alias("label")))
    return labels


def detect_communities(relations: DataFrame, max_cluster_size: int = 128, resolution: float = 1.0, weighted: bool = False, component_edges: int = COMPONENT_EDGES) -> DataFrame:
    """``(id, level, cluster_id)`` of a hierarchical modularity clustering of the undirected simple graph.

    Parallel edges count once (``weighted``: by the sum of strengths), loops not. Each
    connected component is divided by itself in one task; communities above
    ``max_cluster_size`` are divided again on the next level. A component of more than
    ``component_edges`` edges is first cut by label spreading into parts, which are
    divided like components; a node without an edge in its part is a cluster of its
    own. Isolated nodes get no cluster; cluster ids count from 0
    on each level, in order of the communities' smallest ids.
    """
    e = relations.where("subject_id IS NOT NULL AND object_id IS NOT NULL AND subject_id <> object_id").select(
        F.least("subject_id", "object_id").alias("a"), F.greatest("subject_id", "object_id").alias("b"), F.coalesce("relation_strength", F.lit(1.0)).alias("s")
    )
    e = cut(e.groupBy("a", "b").agg((F.sum("s") if weighted else F.lit(1.0)).cast("double").alias("w")))
    part = connected_components(e)
    e = e.join(part, F.col("a") == F.col("node")).drop("node")
    large = e.groupBy("component").count().where(F.col("count") > component_edges).select("component")
    if large.limit(1).count():
        big = cut(e.join(large, "component", "left_semi"))
        labels = spread_labels(big)
        cuts = big.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
        inside = cuts.where("la = lb").select(F.col("la").alias("component"), "a", "b", "w")
        each = labels.select(F.col("label").alias("component"), F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("w"))  # weightless loops, so that no node is lost
        e = e.join(large, "component", "left_anti").unionByName(inside).unionByName(each)
    found = e.groupBy("component").applyInPandas(_hierarchy(max_cluster_size, resolution), "id string, level int, head string")
    found = cut(found)
    # Heads are numbered by range-sorted order with a running count a partition, not in one window.
    heads = found.select("level", "head").distinct()
    ordered = heads.orderBy("level", "head").withColumn("n", F.monotonically_increasing_id())
    ordered = cut(ordered)
    blocks = ordered.groupBy(F.shiftright("n", 33).alias("p"), "level").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("first"))
    offsets = {}
    run: dict = defaultdict(int)
    for r in sorted(blocks.collect(), key=lambda r: (r["level"], r["p"])):  # one row a partition and level
        offsets[r["p"], r["level"]] = run[r["level"]] - r["first"]
        run[r["level"]] += r["c"]
    shift = spark_map(ordered, offsets)
    numbered = shift.select("level", "head", (F.col("n") + F.col("shift")).cast("int").alias("cluster_id"))
    return found.join(numbered, ["level", "head"]).select("id", "level", "cluster_id")


def spark_map(ordered: DataFrame, offsets: dict) -> DataFrame:
    rows = [(p, level, s) for (p, level), s in offsets.items()]
    table = ordered.sparkSession.createDataFrame(rows, "p long, level int, shift long")
    return ordered.withColumn("p", F.shiftright("n", 33)).join(F.broadcast(table), ["p", "level"])


def report_text(report):
    """A community report as text, from a column of its struct."""
    findings = F.transform(report["findings"], lambda f: F.concat(F.lit("## "), f["summary"], F.lit("\n"), f["explanation"]))
    return F.concat_ws("\n\n", F.concat(F.lit("# "), report["title"]), report["summary"], F.array_join(findings, "\n\n"))


def summarise_communities(communities: DataFrame, entities: DataFrame, relations: DataFrame, summariser) -> DataFrame:
    """``(id, summary)`` by a batch function over each community's member texts, sorted by id; null summaries are dropped."""
    e = communities.select("id", F.explode("entity_ids").alias("m")).join(entities.select(F.col("id").alias("m"), F.concat_ws(" - ", "entity_name", "description").alias("text")), "m")
    r = communities.select("id", F.explode("relation_ids").alias("m")).join(relations.select(F.col("id").alias("m"), F.col("description").alias("text")), "m")
    texts = e.unionByName(r).where("text IS NOT NULL").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "text"))), lambda x: x["text"]).alias("texts"))
    return texts.select("id", F.pandas_udf(summariser, "string")("texts").alias("summary")).where("summary IS NOT NULL")
