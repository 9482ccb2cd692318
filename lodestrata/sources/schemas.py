"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

PROVENANCE = "struct<repository:string,commit:string,path:string>"
CHUNK = f"struct<section_title:string,text:string,source_kind:string,content_type:string,provenance:{PROVENANCE},trust_tier:string,evidence_refs:array<string>,validation:struct<verdict:string,detail:string>>"
CHUNK_FILE = f"chunks array<{CHUNK}>"
STUB = "deprecated:boolean,deprecated_reason:string,stub:boolean,stub_reason:string"
PARAM = "struct<name:string,type:string,kind:string,default:string,optional:boolean>"
SIGNATURE = f"params:array<{PARAM}>,return_type:string,receiver:string,throws:array<string>,generics:string,`where`:string"
METHOD = f"struct<name:string,doc:string,file:string,line:int,{SIGNATURE},{STUB},is_constructor:boolean,modifiers:array<string>,mixin:string,inherited_from:string,promoted_from:string>"
PROPERTY = f"struct<name:string,type:string,writable:boolean,access_mode:string,doc:string,file:string,line:int,value:string,modifiers:array<string>,{STUB},inherited_from:string,promoted_from:string>"
MEMBER = "struct<name:string,value:string,payload:string,stub:boolean,stub_reason:string>"
TYPE = (
    f"struct<name:string,kind:string,file:string,line:int,doc:string,visibility:string,{STUB},class_import:string,class_package:string,canonical_namespace:string,receiver_type:string,package:string,import_path:string,"
    f"bases:array<string>,derives:array<string>,underlying:string,type:string,value:string,{SIGNATURE},methods:array<{METHOD}>,properties:array<{PROPERTY}>,enum_members:array<{MEMBER}>,"
    "reexport_of:string,shadows:string,shadowed_by:string,alias_of:string>"
)
API_SURFACE = f"source_repository string, source_commit string, language string, type_count int, types array<{TYPE}>"
RELEASE = "tag_name string, body string, richness string, published_at string, url string, target_commitish string, created_at string, source string, drift struct<indexed_commit:string,tag:string,tag_commit:string,ahead_by:int,behind_by:int,status:string,error:string>"
PUBLISH_LOG = "ts string, event string, scope string, generation_id string, previous_active string, reason string, stats struct<symbols:bigint,docs:bigint,examples:bigint,total:bigint>, overrides array<string>"
USAGE_EVENT = "event_id string, request_correlation_id string, deployment_id string, generation_id string, tool_name string, outcome string, latency_ms double, result_count int, citation_count int, cache_status string, query_shape_category string"
VERDICT = "provenance string, code_sha256 string, library_commit string, platform string, toolchain string, compiled boolean, ran boolean, exit_code int"
EMBEDDING_CACHE = "dimension int, entries map<string,array<double>>"
