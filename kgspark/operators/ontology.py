"""Vocabulary of entity and relation types: resolution, hierarchy, constraints, validation.

The vocabulary is small (tens to thousands of types) and lives on the driver; what
runs over mentions are joins with tables made from it.
"""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions.text import close_match, type_key

#: Types a vocabulary may have, which bounds every table made from it.
MAX_TYPES = 50_000


def key_of(name: str) -> str:
    """The key by which type names are compared."""
    bare = re.sub(r"(?s) \(.*", "", name)
    return re.sub(r"[\s_-]+", "_", bare).strip("_").upper()


@dataclass(frozen=True)
class EntityType:
    name: str
    description: str = ""
    aliases: tuple[str, ...] = ()
    parent: str | None = None


@dataclass(frozen=True)
class Retype:
    """Another relation type for triples of certain types, with its ends swapped if asked."""

    to: str
    subject: str | None = None
    object: str | None = None
    swap: bool = False


@dataclass(frozen=True)
class RelationType:
    name: str
    description: str = ""
    aliases: tuple[str, ...] = ()
    inverse_aliases: tuple[str, ...] = ()
    domain: tuple[str, ...] = ()
    range: tuple[str, ...] = ()
    symmetric: bool = False
    inverse_of: str | None = None
    retype_when: tuple[Retype, ...] = ()


@dataclass
class Ontology:
    entities: dict[str, EntityType] = field(default_factory=dict)
    relations: dict[str, RelationType] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if len(self.entities) + len(self.relations) > MAX_TYPES:
            raise ValueError(f"a vocabulary has at most {MAX_TYPES} types")
        problems = self._problems()
        if problems:
            raise ValueError("; ".join(problems))

    def _problems(self) -> list[str]:
        """Everything that is wrong, not just the first thing."""
        out: list[str] = []

        def known(name: str | None, table: dict, what: str) -> None:
            if name is not None and name not in table:
                near = difflib.get_close_matches(name, list(table), 1)
                out.append(f"{what} refers to unknown type {name}" + (f", did you mean {near[0]}?" if near else ""))

        for table in (self.entities, self.relations):
            owner: dict[str, str] = {}
            for t in table.values():
                for spelling in (t.name, *t.aliases, *getattr(t, "inverse_aliases", ())):
                    other = owner.setdefault(key_of(spelling), t.name)
                    if other != t.name:
                        out.append(f"{spelling} stands for both {other} and {t.name}")
        for e in self.entities.values():
            known(e.parent, self.entities, f"parent of {e.name}")
            seen, at = {e.name}, e.parent
            while at in self.entities:
                if at in seen:
                    out.append(f"{e.name} is its own ancestor")
                    break
                seen.add(at)
                at = self.entities[at].parent
        for r in self.relations.values():
            for end in (*r.domain, *r.range):
                known(end, self.entities, f"constraint of {r.name}")
            known(r.inverse_of, self.relations, f"inverse of {r.name}")
            if r.symmetric and (r.inverse_of or r.inverse_aliases):
                out.append(f"{r.name} is symmetric and has an inverse")
            for rule in r.retype_when:
                known(rule.to, self.relations, f"rule of {r.name}")
                if rule.to == r.name:
                    out.append(f"a rule of {r.name} leads to itself")
                known(rule.subject, self.entities, f"rule of {r.name}")
                known(rule.object, self.entities, f"rule of {r.name}")
        return out

    def ancestors(self, name: str) -> list[str]:
        out, at = [], self.entities[name].parent
        while at is not None:
            out.append(at)
            at = self.entities[at].parent
        return out

    def is_a(self, name: str, other: str) -> bool:
        return name == other or other in self.ancestors(name)

    def allows(self, relation: str, subject: str, object_: str) -> bool:
        r = self.relations[relation]
        fits = lambda t, ends: not ends or any(self.is_a(t, e) for e in ends)
        return fits(subject, r.domain) and fits(object_, r.range) or r.symmetric and fits(object_, r.domain) and fits(subject, r.range)

    def retype(self, relation: str, subject: str, object_: str) -> tuple[str, bool] | None:
        for rule in self.relations[relation].retype_when:
            if (rule.subject is None or self.is_a(subject, rule.subject)) and (rule.object is None or self.is_a(object_, rule.object)):
                ends = (object_, subject) if rule.swap else (subject, object_)
                if self.allows(rule.to, *ends):
                    return rule.to, rule.swap
        return None

    def allowed_relations(self, types: list[str]) -> dict[str, list[tuple[str, str]]]:
        """Relations that can hold between some two of these types, with the pairs; unconstrained ones with no pairs."""
        pairs = [(s, o) for s in sorted(set(types)) for o in sorted(set(types)) if s in self.entities and o in self.entities]
        out = {}
        for r in self.relations.values():
            if not r.domain and not r.range:
                out[r.name] = []
            elif fitting := [p for p in pairs if self.allows(r.name, *p)]:
                out[r.name] = fitting
        return out

    def describe(self, types: list[str] | None = None) -> str:
        """The vocabulary as text, with only the relations that fit the given types."""
        lines = [f"{e.name}: {e.description}".rstrip(": ") for e in self.entities.values() if types is None or e.name in types]
        fitting = self.relations if types is None else self.allowed_relations(types)
        for name in fitting:
            r = self.relations[name]
            ends = f" ({' | '.join(r.domain) or 'any'} -> {' | '.join(r.range) or 'any'})"
            lines.append(f"{name}{ends}: {r.description}".rstrip(": "))
        return "\n".join(lines)

    # Tables

    def spellings(self, spark: SparkSession, kind: str = "entity") -> DataFrame:
        """``(type_key, name, inverse)``: every name and alias."""
        table = self.entities if kind == "entity" else self.relations
        rows = {}
        for t in table.values():
            for s in (t.name, *t.aliases):
                rows[key_of(s)] = (t.name, False)
            for s in getattr(t, "inverse_aliases", ()):
                rows[key_of(s)] = (t.name, True)
        return spark.createDataFrame([(k, *v) for k, v in rows.items()], "type_key string, name string, inverse boolean")

    def triples(self, spark: SparkSession) -> DataFrame:
        """``(relation_type, subject_type, object_type, outcome, new_type, swap)`` for every constrained relation and pair of types.

        outcome: ``ok``, ``retype`` or ``swap``; pairs that no rule saves are not listed.
        """
        rows = []
        for r in self.relations.values():
            if not r.domain and not r.range:
                continue
            for s in self.entities:
                for o in self.entities:
                    if self.allows(r.name, s, o):
                        rows.append((r.name, s, o, "ok", r.name, False))
                    elif (new := self.retype(r.name, s, o)) is not None:
                        rows.append((r.name, s, o, "retype", *new))
                    elif self.allows(r.name, o, s):
                        rows.append((r.name, s, o, "swap", r.name, True))
        return spark.createDataFrame(rows, "relation_type string, subject_type string, object_type string, outcome string, new_type string, swap boolean")

    def closure(self, spark: SparkSession) -> DataFrame:
        """``(name, ancestor, distance)``."""
        rows = [(n, a, i) for n in self.entities for i, a in enumerate(self.ancestors(n), 1)]
        return spark.createDataFrame(rows, "name string, ancestor string, distance int")

    # Mappings

    @classmethod
    def from_mapping(cls, spec: dict, base: "Ontology | None" = None) -> "Ontology":
        """From plain lists and dicts; ``exclude`` removes types of the base, unknown fields are errors."""
        unknown = set(spec) - {"entities", "relations", "exclude", "extends"}
        if unknown:
            raise ValueError(f"unknown fields {sorted(unknown)}")
        gone = set(spec.get("exclude", ()))
        entities = {k: v for k, v in (base.entities if base else {}).items() if k not in gone}
        relations = {k: v for k, v in (base.relations if base else {}).items() if k not in gone}

        def made(kind, x):
            x = {"name": x} if isinstance(x, str) else dict(x)
            bad = set(x) - set(kind.__dataclass_fields__)
            if bad:
                raise ValueError(f"unknown fields {sorted(bad)} of {x.get('name')}")
            if "retype_when" in x:
                x["retype_when"] = tuple(Retype(**r) for r in x["retype_when"])
            return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in x.items()})

        for x in spec.get("entities", ()):
            e = made(EntityType, x)
            entities[e.name] = e
        for x in spec.get("relations", ()):
            r = made(RelationType, x)
            relations[r.name] = r
        return cls(entities, relations)

    @classmethod
    def load(cls, path: str, _seen: tuple[str, ...] = ()) -> "Ontology":
        """From a YAML or JSON file; ``extends`` names another file beside it."""
        import os

        import yaml

        path = os.path.abspath(path)
        if path in _seen:
            raise ValueError(f"{path} extends itself")
        with open(path, encoding="utf-8") as f:
            spec = yaml.safe_load(f) or {}
        base = cls.load(os.path.join(os.path.dirname(path), spec["extends"]), (*_seen, path)) if "extends" in spec else None
        return cls.from_mapping(spec, base)

    def to_mapping(self) -> dict:
        from dataclasses import asdict

        slim = lambda t: {k: ([dict(x) if isinstance(x, dict) else x for x in v] if isinstance(v, (tuple, list)) else v) for k, v in asdict(t).items() if v}
        return {"entities": [slim(e) for e in self.entities.values()], "relations": [slim(r) for r in self.relations.values()]}

    @classmethod
    def from_lists(cls, entity_types: DataFrame, relation_types: DataFrame) -> "Ontology":
        """From reference tables ``(name, parent, aliases, description)`` and ``(name, aliases)``."""
        e = {r["name"]: EntityType(r["name"], r["description"] or "", tuple(r["aliases"] or ()), r["parent"]) for r in entity_types.limit(MAX_TYPES + 1).collect()}
        r = {r["name"]: RelationType(r["name"], aliases=tuple(r["aliases"] or ())) for r in relation_types.limit(MAX_TYPES + 1).collect()}
        return cls(e, r)


@dataclass(frozen=True)
class Policies:
    """What happens to what is not valid: drop, keep, coerce or raise."""

    unknown_entity: str = "coerce"
    unknown_relation: str = "coerce"
    dangling: str = "drop"
    self_loop: str = "drop"
    constraint: str = "coerce"
    cutoff: float = 0.85

    @classmethod
    def permissive(cls) -> "Policies":
        return cls("keep", "keep", "keep", "keep", "keep")

    @classmethod
    def strict(cls) -> "Policies":
        return cls("drop", "drop", "drop", "drop", "drop")

    @classmethod
    def failing(cls) -> "Policies":
        return cls("raise", "raise", "raise", "raise", "raise")


def _judged(df: DataFrame, policy: str, bad, what: str, violation) -> DataFrame:
    if policy == "raise" and df.where(bad).limit(1).count():
        raise ValueError(f"a row fails the check {what}")
    return df.withColumn("violation", F.when(F.col("violation").isNull() & bad, F.lit(what)).otherwise(F.col("violation"))).withColumn(
        "action", F.when(F.col("violation").isNotNull() & F.col("action").isNull(), F.lit({"coerce": "dropped", "drop": "dropped", "keep": "kept", "raise": "dropped"}[policy])).otherwise(F.col("action"))
    )


def validate_entities(mentions: DataFrame, ontology: Ontology, policies: Policies = Policies()) -> DataFrame:
    """Mentions with ``resolved_type, violation, action``: null action is valid, else coerced, dropped or kept.

    Fuzzy matches are looked for only among distinct unknown types.
    """
    spark = mentions.sparkSession
    sp = F.broadcast(ontology.spellings(spark).select("type_key", F.col("name").alias("resolved_type")))
    out = mentions.withColumn("type_key", type_key(F.col("entity_type"))).join(sp, "type_key", "left")
    out = out.withColumn("violation", F.lit(None).cast("string")).withColumn("action", F.lit(None).cast("string"))
    unknown = F.col("resolved_type").isNull()
    if policies.unknown_entity == "coerce":
        keys = out.where(unknown & F.col("type_key").isNotNull()).select("type_key").distinct()
        names = {key_of(n): n for n in ontology.entities}
        near = keys.withColumn("_key", close_match(list(names), policies.cutoff)("type_key")).where("_key IS NOT NULL")
        near = near.join(F.broadcast(ontology.spellings(spark).select(F.col("type_key").alias("_key"), F.col("name").alias("_near"))), "_key").drop("_key")
        out = out.join(near, "type_key", "left")
        hit = unknown & F.col("_near").isNotNull()
        out = out.withColumn("violation", F.when(hit, F.lit("unknown_entity_type"))).withColumn("action", F.when(hit, F.lit("coerced"))).withColumn("resolved_type", F.coalesce("resolved_type", "_near")).drop("_near")
    out = _judged(out, policies.unknown_entity, F.col("resolved_type").isNull(), "unknown_entity_type", "resolved_type")
    keep = F.col("action") == "kept"
    return out.withColumn("resolved_type", F.when(keep & F.col("resolved_type").isNull(), F.col("entity_type")).otherwise(F.col("resolved_type"))).drop("type_key")


def validate_relations(relations: DataFrame, entities: DataFrame, ontology: Ontology, policies: Policies = Policies()) -> DataFrame:
    """Relation mentions through the checks in order: ends, loops, type, constraint.

    ``entities(chunk_id, entity_name, resolved_type)`` are the surviving ones; ends are
    looked up by name inside their chunk, of repeated names the last by ``pos`` if there is such a column, else the greatest type. Inverse aliases
    swap the ends only where unknown types are coerced; else they are unknown. Result has ``resolved_relation, subject, object, violation, action``.
    """
    spark = relations.sparkSession
    last = F.max_by("resolved_type", "pos") if "pos" in entities.columns else F.max("resolved_type")
    names = entities.groupBy("chunk_id", "entity_name").agg(last.alias("t"))
    s = names.select("chunk_id", F.col("entity_name").alias("source_entity"), F.col("t").alias("subject_type"), F.lit(True).alias("_s"))
    o = names.select("chunk_id", F.col("entity_name").alias("target_entity"), F.col("t").alias("object_type"), F.lit(True).alias("_o"))
    out = relations.join(s, ["chunk_id", "source_entity"], "left").join(o, ["chunk_id", "target_entity"], "left")
    out = out.withColumn("violation", F.lit(None).cast("string")).withColumn("action", F.lit(None).cast("string"))
    out = _judged(out, policies.dangling, F.col("_s").isNull() | F.col("_o").isNull(), "dangling_endpoint", None)
    out = _judged(out, policies.self_loop, F.coalesce(F.col("source_entity") == F.col("target_entity"), F.lit(False)), "self_loop", None)
    spellings = ontology.spellings(spark, "relation")
    if policies.unknown_relation != "coerce":
        spellings = spellings.where("NOT inverse")
    sp = F.broadcast(spellings.select("type_key", F.col("name").alias("resolved_relation"), "inverse"))
    out = out.withColumn("type_key", type_key(F.col("relation_type"))).join(sp, "type_key", "left").drop("type_key")
    if policies.unknown_relation == "coerce":
        out = out.withColumn("_near", close_match(sorted(ontology.relations), policies.cutoff)(type_key(F.col("relation_type"))))
        hit = F.col("resolved_relation").isNull() & F.col("_near").isNotNull()
        live = F.col("violation").isNull()
        out = out.withColumn("action", F.when(hit & live, F.lit("coerced")).otherwise(F.col("action"))).withColumn("violation", F.when(hit & live, F.lit("unknown_relation_type")).otherwise(F.col("violation")))
        out = out.withColumn("resolved_relation", F.coalesce("resolved_relation", "_near")).drop("_near")
    out = _judged(out, policies.unknown_relation, F.col("resolved_relation").isNull(), "unknown_relation_type", None)
    turned = F.coalesce("inverse", F.lit(False))
    for a, x, y in (("subject", "source_entity", "target_entity"), ("object", "target_entity", "source_entity")):
        out = out.withColumn(a, F.when(turned, F.col(y)).otherwise(F.col(x)))
    ts, to = F.when(turned, F.col("object_type")).otherwise(F.col("subject_type")), F.when(turned, F.col("subject_type")).otherwise(F.col("object_type"))
    constrained = [r.name for r in ontology.relations.values() if r.domain or r.range]
    if constrained:
        table = F.broadcast(ontology.triples(spark).toDF("_r", "_st", "_ot", "_outcome", "_new", "_swap"))
        out = out.withColumn("_ts", ts).withColumn("_to", to)
        out = out.join(table, (F.col("resolved_relation") == F.col("_r")) & (F.col("_ts") == F.col("_st")) & (F.col("_to") == F.col("_ot")), "left")
        known = F.col("_ts").isin(*ontology.entities) & F.col("_to").isin(*ontology.entities)
        checked = F.col("resolved_relation").isin(*constrained) & known
        bad = checked & (F.col("_outcome").isNull() | (F.col("_outcome") != "ok"))
        live = F.col("violation").isNull() & bad
        if policies.constraint == "coerce":
            saved = live & F.col("_outcome").isin("retype", "swap")
            out = out.withColumn("resolved_relation", F.when(saved, F.col("_new")).otherwise(F.col("resolved_relation")))
            out = out.withColumn("_x", F.col("subject")).withColumn("subject", F.when(saved & F.col("_swap"), F.col("object")).otherwise(F.col("subject"))).withColumn("object", F.when(saved & F.col("_swap"), F.col("_x")).otherwise(F.col("object"))).drop("_x")
            out = out.withColumn("_saved", saved)
            out = out.withColumn("action", F.when(F.col("_saved"), F.lit("coerced")).otherwise(F.col("action"))).withColumn("violation", F.when(F.col("_saved"), F.lit("constraint")).otherwise(F.col("violation"))).drop("_saved")
        out = _judged(out, policies.constraint, bad & F.col("violation").isNull(), "constraint", None)
        out = out.drop("_r", "_st", "_ot", "_outcome", "_new", "_swap", "_ts", "_to")
    return out.drop("_s", "_o", "inverse")


def report(validated: DataFrame, kind_column: str) -> DataFrame:
    """Rows by violation, action and type, the counters of a validation."""
    return validated.where("violation IS NOT NULL").groupBy("violation", "action", F.col(kind_column).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def type_pairs(entities: DataFrame, ontology: Ontology) -> DataFrame:
    """``(chunk_id, subject_type, object_type, relation_type)``: constrained relations that two types of a chunk may have.

    ``entities(chunk_id, entity_type)``; the pairs are those of a chunk's different types, bounded by the vocabulary.
    """
    ok = ontology.triples(entities.sparkSession).where("outcome = 'ok'").select("subject_type", "object_type", "relation_type")
    types = entities.select("chunk_id", F.col("entity_type").alias("subject_type")).distinct()
    first = types.join(F.broadcast(ok), "subject_type")
    return first.join(types.withColumnRenamed("subject_type", "object_type"), ["chunk_id", "object_type"]).select("chunk_id", "subject_type", "object_type", "relation_type")
