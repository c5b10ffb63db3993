"""Best representative of each group of rows with one id, chosen field by field.

Each field has its own composite (priority..., row) struct; one grouped ``max``
over these structs picks every field's winner, with partial aggregation before
the shuffle. A cut-off copy of a longer value is recognised from its successor in
sort order, within groups that share the value's first characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What is typed where there is no description.
PLACEHOLDERS = (
    "tbd", "todo", "n/a", "na", "none", "null", "nil", "unknown", "unspecified", "empty",
    "no description", "not available", "missing", "see above", "?", "-", "...", "…", "",
)
_CUT_MARK = r"(?:\s*(?:\[cut\]|\[\.\.\.\]|\[…\]|\.\.\.|…))\s*$"
_TIERS = (1, 8, 40)


def is_placeholder(text: Column) -> Column:
    """True for null, blank, or text that says only that there is none."""
    bare = F.lower(F.trim(F.regexp_replace(text, r"^[\s(\[<{\"']+|[\s)\]>}\"']+$", "")))
    bare = F.when(F.length(bare) > 1, F.regexp_replace(bare, r"[.!]$", "")).otherwise(bare)
    return text.isNull() | bare.isin(*PLACEHOLDERS) | ~text.rlike(r"[\p{L}\p{N}]")


def cut_off_values(values: DataFrame) -> DataFrame:
    """Of ``values(grp, text)``, distinct rows that are cut-off beginnings of others.

    A value is cut off if, without a mark of omission at its end, it is a proper
    beginning of another value of its group, or if it has such a mark and equals
    another value without one. Sorted neighbours decide: whatever begins with a
    value directly follows it. Groups are split by the first 1, 8 and 40
    characters, by the value's length, so that a huge group is not one task.
    """
    v = values.select("grp", "text", F.rtrim(F.regexp_replace("text", _CUT_MARK, "")).alias("stem"))
    v = v.withColumn("marked", F.col("stem") != F.rtrim("text")).where(F.length("stem") > 0)
    size = F.length("stem")
    entries = []
    for low, high in zip(_TIERS, (*_TIERS[1:], None)):
        piece = F.left("stem", F.lit(high)) if high else F.col("stem")
        whole = (size < high) if high else F.lit(True)
        entries.append(
            F.when(
                size >= low,
                F.struct(F.lit(low).alias("tier"), F.left("stem", F.lit(low)).alias("head"), piece.alias("piece"), whole.alias("whole")),
            )
        )
    pool = (
        v.select("grp", "marked", F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e"))
        .groupBy("grp", "e.tier", "e.head", "e.piece")
        .agg(F.max(F.col("e.whole")).alias("whole"), F.max(F.col("e.whole") & ~F.col("marked")).alias("plain"))
    )
    order = Window.partitionBy("grp", "tier", "head").orderBy("piece")
    stems = (
        pool.withColumn("longer", F.coalesce(F.lead("piece").over(order).startswith(F.col("piece")), F.lit(False)))
        .where("whole AND (longer OR plain)")
        .select("grp", F.col("piece").alias("stem"), "longer")
    )
    return (
        v.join(stems, ["grp", "stem"]).where(F.col("longer") | F.col("marked")).select("grp", "text").distinct()
    )


def survivors(rows: DataFrame) -> DataFrame:
    """For each (record_kind, id) of two or more rows, the surviving row of each field.

    ``rows(record_kind, id, row_id, description, chunks, trust_level, updated_at)``,
    ``chunks`` null where the kind has no such field. Result:
    ``(record_kind, id, field_name, row_id, description, source_chunk_id)``, the
    value in the column of the field. ``description``: the usable value of highest trust_level, then latest
    updated_at, then smallest row_id; nulls rank lowest. Null, blank and
    placeholder values and cut-off beginnings of another value of the id are not
    usable. ``source_chunk_id``: the list of most different non-null chunks, then
    smallest row_id; empty and null lists never survive. A null id is no group.
    A field without a usable value gives no row; empty tables give none. Equal
    rows count as several. Other columns are ignored.
    """
    grp = F.concat_ws("\0", "record_kind", "id")
    r = rows.where(F.col("id").isNotNull() & F.col("record_kind").isNotNull())
    ids = F.array_distinct(F.filter("chunks", lambda c: c.isNotNull()))
    per_value = r.groupBy("record_kind", "id", grp.alias("grp"), F.col("description").alias("text")).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.struct("trust_level", "updated_at", (-F.col("row_id")).alias("neg"))).alias("top"),
        F.max(F.when(F.size(ids) > 0, F.struct(F.size(ids).alias("most"), (-F.col("row_id")).alias("neg"), F.col("chunks").alias("value")))).alias("chunks"),
    )
    per_value = per_value.withColumn("usable", ~is_placeholder(F.col("text")))
    cut = cut_off_values(per_value.where("usable").select("grp", "text")).withColumn("cut", F.lit(True))
    ranked = per_value.join(cut, ["grp", "text"], "left").groupBy("record_kind", "id").agg(
        F.sum("n").alias("n"),
        F.max(
            F.when(F.col("usable") & F.col("cut").isNull(), F.struct(F.lit(1).alias("has"), F.col("top.trust_level"), F.col("top.updated_at"), F.col("top.neg"), F.col("text").alias("value")))
        ).alias("d"),
        F.max("chunks").alias("c"),
    )
    field = F.explode(
        F.array(
            F.struct(F.lit("description").alias("field_name"), F.col("d.neg").alias("neg"), F.col("d.value").alias("description"), F.lit(None).cast("array<string>").alias("source_chunk_id")),
            F.struct(F.lit("source_chunk_id").alias("field_name"), F.col("c.neg").alias("neg"), F.lit(None).cast("string").alias("description"), F.col("c.value").alias("source_chunk_id")),
        )
    )
    return (
        ranked.where("n > 1")
        .select("record_kind", "id", field.alias("f"))
        .where("f.description IS NOT NULL OR f.source_chunk_id IS NOT NULL")
        .select("record_kind", "id", "f.field_name", (-F.col("f.neg")).alias("row_id"), "f.description", "f.source_chunk_id")
    )
