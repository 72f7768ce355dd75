"""Tables, nested types and fixed enumerations."""

from __future__ import annotations

FILES = "project string, file_path string, mtime_ms double, size long, content_hash string, updated_at string, line_count int"
SYMBOLS = (
    "id long, project string, file_path string, kind string, name string, start_line int, start_column int, end_line int, end_column int, "
    "is_exported boolean, signature string, fingerprint string, detail_json string, content_hash string, indexed_at string, "
    "resolved_type string, structural_fingerprint string"
)
RELATIONS = (
    "id long, project string, type string, src_file_path string, src_symbol_name string, dst_project string, dst_file_path string, "
    "dst_symbol_name string, meta_json string, specifier string, is_external boolean"
)
ANNOTATIONS = (
    "id long, project string, file_path string, tag string, value string, source string, symbol_name string, "
    "start_line int, start_column int, end_line int, end_column int, indexed_at string"
)
CHANGELOG = (
    "id long, project string, change_type string, symbol_name string, symbol_kind string, file_path string, old_name string, "
    "old_file_path string, fingerprint string, changed_at string, is_full_index boolean, index_run_id string"
)
_TYPE_USE = "struct<name:string,type:string,typeImportSource:string,isOptional:boolean,defaultValue:string>"
DETAIL = (
    f"struct<parameters:array<{_TYPE_USE}>,returnType:string,heritage:array<struct<kind:string,name:string>>,"
    "decorators:array<struct<name:string>>,typeParameters:array<string>,modifiers:array<string>,initializer:string,"
    "members:array<struct<name:string,kind:string,type:string>>,jsDoc:string,key:string>"
)
META = (
    "struct<isType:boolean,isExternal:boolean,isUnresolved:boolean,isDynamic:boolean,isRequire:boolean,isReExport:boolean,"
    "specifiers:array<struct<local:string,exported:string>>,namespaceAlias:string,importKind:string,isNew:boolean,scope:string,isLocal:boolean>"
)

# The kinds that stored rows may have.
SYMBOL_KINDS = ("function", "method", "class", "variable", "type", "interface", "enum", "namespace", "property")
RELATION_TYPES = ("imports", "type-references", "re-exports", "calls", "extends", "implements")
EDGE_TYPES = ("imports", "type-references", "re-exports")
CHANGE_TYPES = ("added", "modified", "removed", "renamed", "moved")
