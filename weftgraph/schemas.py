"""Schemas of the graph tables."""

from __future__ import annotations

NODES = (
    "id string, label string, file_type string, source_file string, source_line int, docstring string, community int, degree_centrality double"
)
EDGES = "id long, source string, target string, relation string, confidence string, confidence_score double, source_file string"
MANIFEST = "file_path string, content_hash string, file_type string, language string, last_seen_at string, size_bytes long"
HISTORY = "id long, question string, answer string, path_taken string, queried_at string"
RUNS = "id long, started_at string, finished_at string, status string, files_processed int, nodes_added int, edges_added int"
#: One extracted file: its nodes and edges as nested arrays.
EXTRACTION = (
    "file_path string, language string, "
    "nodes array<struct<id:string,label:string,source_file:string,source_line:int,docstring:string,node_type:string>>, "
    "edges array<struct<source:string,target:string,relation:string,confidence:string,confidence_score:double,source_file:string,source_line:int>>"
)
SEMANTIC = (
    "struct<nodes:array<struct<id:string,label:string,summary:string,node_type:string>>,"
    "edges:array<struct<source:string,target:string,relation:string>>>"
)
