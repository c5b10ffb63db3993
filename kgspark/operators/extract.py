"""Mentions from texts by models in one, two or four stages, with what failed as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.operators import ontology as vocabulary
from kgspark.operators.lookup import stated_relations
from kgspark.operators.neighbourhood import ordered_pairs
from kgspark.storage import cut

_ENTITY = "struct<entity_name: string, entity_type: string, description: string>"
_RELATION = "struct<source_entity: string, target_entity: string, relation_type: string, description: string, relationship_strength: int>"


@dataclass(frozen=True)
class Extraction:
    """``entities(chunk_id, entity_name, entity_type, description)``, ``relations(chunk_id, source_entity, ...)``, ``failures(chunk_id, stage, error)``."""

    entities: DataFrame
    relations: DataFrame
    failures: DataFrame


def call_rows(rows: DataFrame, arguments: list[str], model: Callable, result: str, strict: bool = False) -> DataFrame:
    """``rows`` with ``result`` of ``model(*arguments)`` of each row, and ``error``: null, or why it has none.

    Structs and lists come as dicts and lists. ``strict`` lets the first error stop the job.
    """
    schema = rows.select("*", F.lit(None).cast(result).alias("result"), F.lit(None).cast("string").alias("error")).schema

    def plain(x):
        if hasattr(x, "asDict"):
            return {k: plain(v) for k, v in x.asDict().items()}
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, (list, tuple)) or hasattr(x, "tolist") and getattr(x, "ndim", 0) else x

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found, errors = [], []
            for values in zip(*(f[a] for a in arguments)):
                try:
                    found.append(model(*map(plain, values)))
                    errors.append(None)
                except Exception as e:  # a model is foreign code: whatever it raises becomes a row
                    if strict:
                        raise
                    found.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:500])
            yield f.assign(result=pd.Series(found, index=f.index, dtype=object), error=pd.Series(errors, index=f.index, dtype=object))

    return cut(rows.mapInPandas(run, schema))


def _failures(called: DataFrame, stage: str) -> DataFrame:
    return called.where("error IS NOT NULL").select("chunk_id", F.lit(stage).alias("stage"), "error")


def _texts(chunks: DataFrame) -> DataFrame:
    return chunks.where("content IS NOT NULL").select(F.col("id").alias("chunk_id"), "content")


def _rows(found: DataFrame, column: str) -> DataFrame:
    return found.select("chunk_id", F.explode(column).alias("x")).select("chunk_id", "x.*")


def single_stage(chunks: DataFrame, extract: Callable, check: Callable | None = None, strict: bool = False) -> Extraction:
    """``extract(text) -> {"entities": [...], "relations": [...]}``; ``check(text, found)`` gives the same, corrected.

    A chunk whose extraction fails has nothing, one whose check fails keeps what was found before it.
    """
    both = f"struct<entities: array<{_ENTITY}>, relations: array<{_RELATION}>>"
    called = call_rows(_texts(chunks), ["content"], extract, both, strict)
    failures = _failures(called, "extract")
    found = called.select("chunk_id", "content", F.col("result").alias("found"))
    if check is not None:
        checked = call_rows(found.where("found IS NOT NULL"), ["content", "found"], check, both, strict)
        failures = failures.unionByName(_failures(checked, "check"))
        found = checked.select("chunk_id", F.coalesce("result", "found").alias("found"))
    return Extraction(_rows(found, "found.entities"), _rows(found, "found.relations"), failures)


def two_stage(
    chunks: DataFrame, find: Callable, relate: Callable, check_entities: Callable | None = None, check_relations: Callable | None = None,
    ontology: vocabulary.Ontology | None = None, policies: vocabulary.Policies = vocabulary.Policies(), strict: bool = False,
) -> Extraction:
    """Entities first, then relations between those that the vocabulary leaves.

    ``find(text)`` and ``check_entities(text, entities)`` give entities, ``relate(text, entities)`` and
    ``check_relations(text, entities, relations)`` relations. A chunk whose check of entities fails has none;
    entities stay if relations fail; relations whose check fails stay as they were.
    """
    entity_list, relation_list = f"array<{_ENTITY}>", f"array<{_RELATION}>"
    texts = _texts(chunks)
    called = call_rows(texts, ["content"], find, entity_list, strict)
    failures = _failures(called, "entities")
    found = called.select("chunk_id", "content", F.col("result").alias("entities"))
    if check_entities is not None:
        checked = call_rows(found.where("entities IS NOT NULL"), ["content", "entities"], check_entities, entity_list, strict)
        failures = failures.unionByName(_failures(checked, "check entities"))
        found = checked.select("chunk_id", "content", F.col("result").alias("entities"))
    entities = _rows(found, "entities")
    left = "action IS NULL OR action <> 'dropped'"
    if ontology is not None:
        known = vocabulary.validate_entities(entities, ontology, policies).where(left)
        entities = cut(known.withColumn("entity_type", F.col("resolved_type")).select("chunk_id", "entity_name", "entity_type", "description"))
    lists = entities.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("entity_name", "entity_type", "description"))).alias("entities"))
    related = call_rows(texts.join(lists, "chunk_id"), ["content", "entities"], relate, relation_list, strict)
    failures = failures.unionByName(_failures(related, "relations"))
    pairs = related.select("chunk_id", "content", "entities", F.col("result").alias("relations"))
    if check_relations is not None:
        checked = call_rows(pairs.where("relations IS NOT NULL"), ["content", "entities", "relations"], check_relations, relation_list, strict)
        failures = failures.unionByName(_failures(checked, "check relations"))
        pairs = checked.select("chunk_id", F.coalesce("result", "relations").alias("relations"))
    relations = _rows(pairs, "relations")
    if ontology is not None:
        names = entities.select("chunk_id", "entity_name", F.col("entity_type").alias("resolved_type"))
        valid = vocabulary.validate_relations(relations, names, ontology, policies).where(left)
        relations = valid.select("chunk_id", F.col("subject").alias("source_entity"), F.col("object").alias("target_entity"), F.coalesce("resolved_relation", "relation_type").alias("relation_type"), "description", "relationship_strength")
    return Extraction(entities, relations, failures)


def four_stage(chunks: DataFrame, find: Callable, normalise: Callable, describe: Callable, relate: Callable, strict: bool = False) -> Extraction:
    """Names, their normal forms, descriptions, and a sentence for each ordered pair of a chunk's entities.

    ``find(text) -> names``, ``normalise(text, name) -> name``, ``describe(text, name)`` and ``relate(text, a, b)`` give
    texts. Types are UNKNOWN; pairs whose text says that there is no relation are left out, and names whose normal form is empty.
    """
    texts = _texts(chunks)
    named = call_rows(texts, ["content"], find, "array<string>", strict)
    failures = _failures(named, "names")
    names = named.select("chunk_id", "content", F.explode(F.array_distinct("result")).alias("raw")).where("raw IS NOT NULL")
    normal = call_rows(names, ["content", "raw"], normalise, "string", strict)
    failures = failures.unionByName(_failures(normal, "normal forms"))
    one = normal.select("chunk_id", "content", F.trim("result").alias("entity_name")).where("entity_name <> ''").distinct()
    described = call_rows(one, ["content", "entity_name"], describe, "string", strict)
    failures = failures.unionByName(_failures(described, "descriptions"))
    entities = described.select("chunk_id", "entity_name", F.lit("UNKNOWN").alias("entity_type"), F.col("result").alias("description"))
    pairs = ordered_pairs(entities.select("chunk_id", "entity_name", F.col("entity_name").alias("pos"))).join(texts, "chunk_id")
    related = call_rows(pairs, ["content", "source_entity", "target_entity"], relate, "string", strict)
    failures = failures.unionByName(_failures(related, "relations"))
    said = stated_relations(related.where("result IS NOT NULL").withColumnRenamed("result", "description"))
    relations = said.select("chunk_id", "source_entity", "target_entity", F.lit("UNKNOWN").alias("relation_type"), "description", F.lit(None).cast("int").alias("relationship_strength"))
    return Extraction(entities, relations, failures)
