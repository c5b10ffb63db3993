"""The build pipeline: documents to a stored graph."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions import ids
from kgspark.functions.text import clean_type
from kgspark.operators import chunking, community, lookup, merge, models, mutate, neighbourhood
from kgspark.operators import ontology as vocabulary
from kgspark.storage import cut


@dataclass(frozen=True)
class BuildOptions:
    chunk_size: int = 1_000
    chunk_overlap: int = 0
    remove_isolated: bool = True
    summarise_above: int = 7
    max_cluster_size: int = 128
    min_cluster_size: int = 1
    only_vector_context: bool = False
    communities: bool = True


@dataclass
class Graph:
    chunks: DataFrame
    entities: DataFrame | None = None
    relations: DataFrame | None = None
    communities: DataFrame | None = None
    summaries: DataFrame | None = None
    chunk_vectors: DataFrame | None = None
    entity_vectors: DataFrame | None = None
    relation_vectors: DataFrame | None = None


def join_texts(lists):
    """The offline summariser: all texts of a list, joined."""
    return lists.map(lambda t: " ".join(x for x in t if x))


def _vectors(rows: DataFrame, text, embedder: Callable | None) -> DataFrame | None:
    return None if embedder is None else cut(models.embed(rows.select("id", text.alias("text")), "text", embedder).select("id", "embedding"))


def _valid(e: DataFrame, r: DataFrame, ontology: vocabulary.Ontology, policies: vocabulary.Policies) -> tuple[DataFrame, DataFrame]:
    """The mentions that the vocabulary and the policies leave, with their resolved types and ends."""
    left = "action IS NULL OR action <> 'dropped'"
    known = cut(vocabulary.validate_entities(e, ontology, policies).where(left))
    links = r.withColumns({c: F.trim(c) for c in ("source_entity", "target_entity")})
    links = vocabulary.validate_relations(links, known.select("chunk_id", "entity_name", "resolved_type"), ontology, policies).where(left)
    resolved = {"source_entity": F.col("subject"), "target_entity": F.col("object"), "relation_type": F.coalesce("resolved_relation", "relation_type")}
    return known.withColumn("entity_type", F.col("resolved_type")).select(*e.columns), cut(links.withColumns(resolved).select(*r.columns))


def build(
    documents: DataFrame, extractor: Callable, options: BuildOptions = BuildOptions(), modules: list[Callable] = (), summariser: Callable = join_texts, stored: Graph | None = None,
    ontology: vocabulary.Ontology | None = None, policies: vocabulary.Policies = vocabulary.Policies(), reporter: Callable | None = None, embedder: Callable | None = None,
) -> Graph:
    """A graph of ``documents(text)``, merged with a stored one.

    ``modules`` are functions ``(entities, relations) -> (entities, relations)``.
    Chunks that are already stored are not extracted again, so a repeated build changes nothing.
    With an ``ontology``, new mentions are validated by the ``policies`` before they are grouped.
    ``reporter`` makes ``summaries(id, summary)`` of the communities, ``embedder`` the tables of
    vectors ``(id, embedding)``, both for the whole graph.
    """
    made = chunking.simple_chunks(documents, options.chunk_size, options.chunk_overlap).withColumn("pos", F.monotonically_increasing_id())
    once = cut(made)
    fresh = once.groupBy(F.col("id").alias("_k")).agg(F.min_by(F.struct(*once.columns), F.struct("doc_id", "chunk_order_idx")).alias("r")).select("r.*").drop("pos")
    if stored is not None:
        fresh = fresh.join(stored.chunks.select("id"), "id", "left_anti")
    fresh = cut(fresh)
    chunks = fresh if stored is None else stored.chunks.unionByName(fresh)
    if options.only_vector_context:
        return Graph(chunks, chunk_vectors=_vectors(chunks, F.col("content"), embedder))
    e, r = models.extract(fresh, extractor)
    e = e.withColumn("entity_name", F.trim("entity_name")).withColumn("entity_type", clean_type(F.col("entity_type"))).where("entity_name <> ''")
    if ontology is not None:
        e, r = _valid(e, r, ontology, policies)
    e = cut(e.withColumn("id", ids.entity_id(F.col("entity_name"), F.col("entity_type"))).withColumn("source_chunk_id", F.array("chunk_id")).withColumn("pos", F.monotonically_increasing_id()))
    entities = merge.summarise(merge.group_entities(e), summariser, options.summarise_above)
    docs = fresh.select(F.col("id").alias("chunk_id"), "doc_id")
    from_docs = e.select("id", "chunk_id").join(docs, "chunk_id").groupBy("id").agg(F.array_sort(F.collect_set("doc_id")).alias("documents_id"))
    no_clusters = F.array().cast("array<struct<level:int,cluster_id:int>>")
    entities = entities.join(from_docs, "id", "left").select("id", "entity_name", "entity_type", "description", "source_chunk_id", "documents_id", no_clusters.alias("clusters"))
    named = neighbourhood.resolve_names(r, e.select("chunk_id", "entity_name", "id", "pos"))
    named = named.withColumns({"subject_name": F.col("source_entity"), "object_name": F.col("target_entity"), "relation_strength": F.col("relationship_strength").cast("double"), "source_chunk_id": F.array("chunk_id"), "pos": F.monotonically_increasing_id()})
    named = cut(named)
    grouped = merge.group_relations(named)
    columns = ["id", "subject_id", "object_id", "subject_name", "object_name", "relation_type", "description", "relation_strength", "source_chunk_id"]
    relations = grouped.select(*columns)
    if options.remove_isolated:
        entities, relations = lookup.without_isolated(entities, relations)
    for module in modules:
        out = module(entities, relations)
        if not isinstance(out, tuple) or len(out) != 2:
            raise TypeError("a build module returns entities and relations")
        entities, relations = out
    entities, relations = cut(entities), cut(relations)
    if stored is not None and stored.entities is not None:
        entities = cut(mutate.merge_upsert_entities(stored.entities, entities))
        relations = cut(mutate.merge_upsert_relations(stored.relations, relations, entities))
    groups = None
    if options.communities:
        m = cut(community.detect_communities(relations, options.max_cluster_size))
        groups = community.build_communities(m, relations, options.min_cluster_size)
        lists = m.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("level", "cluster_id"))).alias("clusters"))
        entities = entities.drop("clusters").join(lists, "id", "left").withColumn("clusters", F.coalesce("clusters", no_clusters))
        entities = community.keep_memberships(entities, groups)
    summaries = None
    if reporter is not None and groups is not None:
        groups = cut(groups)
        summaries = cut(community.summarise_communities(groups, entities, relations, reporter))
    return Graph(
        chunks, entities, relations, groups, summaries, _vectors(chunks, F.col("content"), embedder),
        _vectors(entities, F.concat_ws(" - ", "entity_name", "description"), embedder), _vectors(relations, F.col("description"), embedder),
    )
