"""Row types of the catalogue: parsed schema elements, nodes, edges and the published snapshot."""

from __future__ import annotations

#: One row per parsed element. kind: meta, prefix, class, class_slot, slot, enum, value or error.
ELEMENT = (
    "kind string, source_label string, owner string, pos int, name string, iri string, definition string, value string,"
    " is_abstract boolean, multivalued boolean, required boolean, pattern string, aliases array<string>, path string"
)

#: Node tables, the primary key first.
NODES = {
    "class": "hash_id string, name string, description string, aliases array<string>, concept_uri string, parent_class string, is_abstract boolean",
    "property": "hash_id string, name string, description string, aliases array<string>, concept_uri string, property_range string, ucum_code string,"
    " has_quantity_kind string, symbol string, abbreviation string, descriptive_name string",
    "value_set": "hash_id string, name string, description string, aliases array<string>, concept_uri string",
    "permissible_value": "hash_id string, name string, description string, aliases array<string>, concept_uri string, meaning string",
    "provenance": "id string, label string, hash_id string, had_primary_source string, source_version string, registry_version string,"
    " generated_at_time string, was_attributed_to string, was_generated_by string, was_derived_from array<string>",
    "source": "id string, label string, title string, publisher string, contact string, homepage string, is_hub boolean, source_iri string,"
    " source_version string, mime_type string, created_at string, registry_version string",
    "schema_version": "id string, schema_label string, source_version string, yml_path string, class_count long, property_count long,"
    " changes_summary string, created_at string, registry_version string",
    "changelog": "registry_version string, previous_version string, timestamp string, bump string, trigger string, issue_number string, agent string,"
    " schema_ingested string, stats struct<classes_total:long,sources_total:long>, archive_path string",
}

#: Edge tables: ends first.
EDGES = {
    "has_property": "src string, dst string",
    "subclass_of": "src string, dst string",
    "has_permissible_value": "src string, dst string",
    "aligned_to": "src string, dst string, distance double, method string, skos_relation string, score_iri double, score_name double,"
    " score_desc double, score_slot double, registry_version string",
}

SNAPSHOT = (
    "registry_version string, generated_at string, sources array<struct<label:string,version:string,class_count:long>>,"
    " classes array<struct<hash_id:string,iri:string,name:string,definition:string,is_abstract:boolean,sources:array<string>,"
    "properties:array<struct<hash_id:string,iri:string,name:string,definition:string,value_range:string,units:string,sources:array<string>>>,"
    "subclass_of:array<string>,"
    "alignments:array<struct<target_hash_id:string,target_name:string,target_iri:string,distance:double,method:string,"
    "scores:struct<iri:double,name:double,desc:double,slot:double>>>>>"
)
