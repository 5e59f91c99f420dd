"""Reader schemas and the schemas of nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Order of first appearance: input file, declared or mentioned, position, caller or callee.
ORD = "struct<file:int,phase:int,pos:int,side:int>"

#: (DDL) One document per file, of either kind: a module graph (functions, edges by address) or a unified graph (nodes, edges by id).
GRAPH_DOCUMENT = (
    "schema_version string, program string, graph string, windows map<string,string>, node_count long, edge_count long, layers map<string,long>, "
    "programs array<string>, sources array<string>, "
    "dlls array<struct<program:string,path:string,sha256:string,file_version:string,pdb_guid:string,pdb_age:long>>, "
    "functions array<struct<entry_point:string,address_space:string,name:string,qualified_name:string,namespace:string,signature:string,is_external:string,calling_convention:string,source:string>>, "
    "nodes array<struct<id:string,node_id:string,name:string,program:string,address:string,is_external:string,layer:string,calling_convention:string,source:string,qualified_name:string,namespace:string,signature:string,address_space:string>>, "
    "edges array<struct<caller:string,callee:string,source:string,target:string,kind:string>>"
)

#: (DDL) Metadata of one binary.
METADATA_DOCUMENT = (
    "path string, debug array<struct<codeview:struct<signature:string,guid:string,age:long,pdb_path:string,symbol_server_path:string>>>, "
    "imports array<struct<module:string,functions:array<struct<name:string>>>>, exports array<struct<name:string>>"
)

NODES = {
    "node_id": "string", "program": "string", "address": "string", "name": "string", "qualified_name": "string", "namespace": "string", "signature": "string",
    "address_space": "string", "calling_convention": "string", "source": "string", "is_external": "boolean", "layer": "string", "attrs": "map<string,string>", "ord": ORD,
}

EDGES = {"src": "string", "dst": "string", "kind": "string", "ord": ORD}

UNKNOWN = "unknown"
LIBRARY, SYSCALL = "library", "syscall"


def conform(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """The columns of ``schema`` in its order; those that are missing are null."""
    return df.select(*[(F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name) for name, kind in schema.items()])
