"""Schemas of the stored tables, as DDL, and the values that their columns may take."""

from __future__ import annotations

# Node types, edge types and other closed lists of the data model.
NODE_TYPES = ("IR", "AMC", "GM", "CS", "GROUP")
RELATIONS = ("IMPLEMENTS", "ACCEPTABLE_MEANS", "GUIDANCE_FOR", "REFERENCES", "REQUIRES", "EQUIVALENT_TO", "SUPERSEDES", "IF_MINOR", "IF_MAJOR", "LEADS_TO", "CONTAINS")
CHANGE_TYPES = ("added", "modified", "deleted", "unchanged")
SOURCE_FORMATS = ("HTML", "PDF", "MIXED")
FREQUENCIES = ("daily", "weekly", "monthly", "manual")

TABLES = {
    "source_files": "source_id string, external_id string, name string, base_url string, format string, frequency string, urls map<string,string>, use_smart_parser boolean, enabled boolean, last_sync_at timestamp, created_at timestamp",
    "harvest_documents": "doc_id string, source_id string, external_id string, title string, url string, content_hash string, raw_path string, version_label string, pub_date date, amended_by string, is_latest boolean, fetched_at timestamp",
    "harvest_document_versions": "version_id string, doc_id string, version_num int, content_hash string, captured_at timestamp",
    "regulatory_nodes": "node_id string, node_type string, reference_code string, title string, content_text string, content_html string, content_hash string, hierarchy_path string, source_doc_id string, regulatory_source string, applicability_date string, entry_into_force_date string, confidence decimal(3,2), created_at timestamp, updated_at timestamp",
    "regulatory_edges": "edge_id string, source_node_id string, target_node_id string, relation string, confidence decimal(3,2), notes string, created_at timestamp",
    "regulatory_changes": "change_id string, node_id string, change_type string, old_hash string, new_hash string, diff_text string, detected_at timestamp, is_significant boolean",
    "regulatory_node_versions": "version_id string, node_id string, version_label string, content_text string, content_html string, content_hash string, change_type string, diff_prev array<struct<op:string,text:string>>, fetched_at timestamp",
    "document_harvest_runs": "run_id string, doc_id string, version_label string, fetched_at timestamp, nodes_added int, nodes_modified int, nodes_deleted int, nodes_unchanged int, nodes_total int",
    "regulatory_document_versions": "version_id string, source_key string, source_label string, version_label string, pub_date date, url string, file_path string, content_hash string, doc_type string, is_indexed boolean, is_latest_pdf boolean, xml_doc_id string, fetched_at timestamp",
    "node_embeddings": "chunk_id string, parent_node_id string, chunk_index int, document string, embedding array<float>, node_type string, reference_code string, title string, hierarchy_path string, content_hash string, source_root string, applicability_date string, regulatory_source string",
    "doc_categories": "id string, label string, sort_order int",
    "doc_domains": "id string, label string, sort_order int",
    "regulations": "id string, name string, short string, category_id string, domain_id string, description string, page_url string, harvest_key string, doc_title_pattern string, ref_code_pattern string, is_active boolean, sort_order int, created_at timestamp, updated_at timestamp",
}
