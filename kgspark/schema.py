"""Tables of the engine as Spark schemas."""

from __future__ import annotations

CHUNKS = "id string, content string, chunk_order_idx int, doc_id string, num_tokens int"
ENTITIES = (
    "id string, entity_name string, entity_type string, description string, source_chunk_id array<string>, "
    "documents_id array<string>, clusters array<struct<level: int, cluster_id: int>>"
)
RELATIONS = (
    "id string, subject_id string, object_id string, subject_name string, object_name string, relation_type string, "
    "description string, relation_strength double, source_chunk_id array<string>"
)
COMMUNITIES = "id string, level int, cluster_id int, entity_ids array<string>, relation_ids array<string>"
SUMMARIES = "id string, summary string"
POINTS = "id string, dense array<float>, sparse struct<indices: array<int>, values: array<double>>, metadata map<string, string>"
ENTITY_MENTIONS = "chunk_id string, entity_name string, entity_type string, description string"
RELATION_MENTIONS = "chunk_id string, source_entity string, target_entity string, relation_type string, description string, relationship_strength int"
EXAMPLES = "id string, task string, input_text string, output string, language string, quality_rating int"
SUBQUERIES = "plan_id string, id string, query string, depends_on array<string>, intent string"
COMMUNITY_REPORT = (
    "title string, summary string, rating double, rating_explanation string, findings array<struct<summary: string, explanation: string>>"
)
