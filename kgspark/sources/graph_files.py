"""Stores of other formats: JSON key-value files, GML graphs, vector files with base64 matrices."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(r'"([^"]*)"|([\[\]])|([^\s\[\]]+)')


def read_kv(spark: SparkSession, path: str, value: str) -> DataFrame:
    """``(key, ...)`` of a JSON object of objects; ``value`` is the schema of an entry."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, struct<{value}>>").alias("d"))
    return doc.select(F.explode("d").alias("key", "v")).select("key", "v.*")


def parse_gml(text: str) -> tuple[list[dict], list[dict], bool]:
    """Nodes, edges and whether the graph is a multigraph, of a GML text."""
    tokens = [(m.group(1), "s") if m.group(1) is not None else (m.group(2) or m.group(3), "b" if m.group(2) else "w") for m in _TOKEN.finditer(re.sub(r"^\s*#.*$", "", text, flags=re.M))]

    def block(i: int) -> tuple[list[tuple], int]:
        out = []
        while i < len(tokens) and tokens[i] != ("]", "b"):
            key, (v, kind) = tokens[i][0], tokens[i + 1]
            if (v, kind) == ("[", "b"):
                inner, i = block(i + 2)
                out.append((key, inner))
            else:
                out.append((key, v.replace("&quot;", '"').replace("&#38;", "&").replace("&amp;", "&") if kind == "s" else v))
                i += 2
        return out, i + 1

    graph = dict(block(0)[0]).get("graph", [])
    nodes, edges = [dict(v) for k, v in graph if k == "node"], [dict(v) for k, v in graph if k == "edge"]
    multi = dict((k, v) for k, v in graph if not isinstance(v, list)).get("multigraph") == "1"
    names = {n.get("id"): n.get("label", n.get("id")) for n in nodes}
    for e in edges:
        e["source"], e["target"] = names.get(e.get("source"), e.get("source")), names.get(e.get("target"), e.get("target"))
    return nodes, edges, multi


def read_gml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(id, properties)`` of nodes and ``(id, subject_id, object_id, properties)`` of edges of GML files.

    Edges of graphs that are no multigraphs are named by their own ``id``, else ``edge-<number>``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for text in f["value"]:
                nodes, edges, multi = parse_gml(text)
                rows += [("node", n.get("label", n.get("id")), None, None, {k: str(v) for k, v in n.items()}) for n in nodes]
                for i, e in enumerate(edges):
                    key = e.get("key") if multi and "key" in e else e.get("id", f"edge-{i}")
                    rows.append(("edge", key, e["source"], e["target"], {k: str(v) for k, v in e.items()}))
            yield pd.DataFrame(rows, columns=["kind", "id", "subject_id", "object_id", "properties"])

    found = spark.read.text(path, wholetext=True).mapInPandas(run, "kind string, id string, subject_id string, object_id string, properties map<string, string>")
    return found.where("kind = 'node'").select("id", "properties"), found.where("kind = 'edge'").select("id", "subject_id", "object_id", "properties")


def write_gml(nodes: DataFrame, edges: DataFrame, path: str, most: int = 1_000_000) -> None:
    """A GML file of a graph of at most ``most`` rows, for exchange; larger graphs stay tables."""
    import os

    if nodes.count() + edges.count() > most:
        raise ValueError("the graph is too large for one file")
    place = {}
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        f.write("graph [\n  directed 1\n  multigraph 1\n")
        q = lambda s: '"' + str(s).replace("&", "&amp;").replace('"', "&quot;") + '"'
        for i, r in enumerate(nodes.orderBy("id").toLocalIterator()):
            place[r["id"]] = i
            f.write(f"  node [ id {i} label {q(r['id'])} ]\n")
        for r in edges.orderBy("id").toLocalIterator():
            f.write(f"  edge [ source {place[r['subject_id']]} target {place[r['object_id']]} key {q(r['id'])} ]\n")
        f.write("]\n")
    os.replace(path + ".tmp", path)


def read_vectors(spark: SparkSession, path: str, dim: int | None = None, metric: str | None = None) -> DataFrame:
    """``(id, vector)`` of a JSON file ``{embedding_dim, metric?, data: [{id}], matrix: base64 float32}``; wrong shapes are errors.

    A file without metric is cosine.
    """
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    found, rows = raw["embedding_dim"], raw["data"]
    if dim is not None and found != dim:
        raise ValueError(f"vectors of length {found} stored, {dim} expected")
    if metric is not None and raw.get("metric", "cosine") != metric:
        raise ValueError(f"stored for metric {raw.get('metric', 'cosine')}, {metric} expected")
    matrix = np.frombuffer(base64.b64decode(raw["matrix"]), "<f4")
    if matrix.size != found * len(rows):
        raise ValueError("the matrix does not fit the number of rows")
    ids = [r.get("id", r.get("__id__")) for r in rows]
    return spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, matrix.reshape(-1, found))], "id string, vector array<float>")


def write_vectors(points: DataFrame, path: str, dim: int, metric: str = "cosine", most: int = 1_000_000) -> None:
    """The same format, for exchange of at most ``most`` vectors."""
    import os

    rows = points.orderBy("id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many vectors for one file")
    matrix = np.array([r["vector"] for r in rows], "<f4").reshape(len(rows), dim)
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        json.dump({"embedding_dim": dim, "metric": metric, "data": [{"id": r["id"]} for r in rows], "matrix": base64.b64encode(matrix.tobytes()).decode()}, f)
    os.replace(path + ".tmp", path)
