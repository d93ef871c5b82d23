"""Manifests, source trees and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOC = "struct<file:string,line:int,column:int>"
FRONTEND = (
    f"repo string, files array<struct<path:string,exports:array<string>,imports:array<struct<source:string,resolvedFile:string,specifiers:array<string>,location:{_LOC}>>>>, "
    f"functions array<struct<id:string,name:string,file:string,params:array<struct<name:string,type:string>>,returnType:string,calls:array<string>,location:{_LOC},containingComponent:string>>, "
    f"apiCalls array<struct<id:string,endpointPattern:string,method:string,calleeExpression:string,resolution:string,wrapperFunctionId:string,callerFunctionId:string,file:string,location:{_LOC},arguments:array<string>,request:struct<queryKeys:array<string>,bodyKeys:array<string>>,code:string>>, "
    f"propertyAccesses array<struct<id:string,apiCallId:string,object:string,path:array<string>,flow:string,file:string,location:{_LOC},containingFunctionId:string,containingComponent:string,code:string>>"
)
BACKEND = (
    f"repo string, endpoints array<struct<id:string,method:string,path:string,handler:string,requestParams:array<struct<name:string,type:string,required:boolean,source:string>>,requestBody:struct<type:string,required:boolean>,response:string,location:{_LOC}>>, "
    f"dtos array<struct<id:string,name:string,typeParameters:array<string>,fields:array<struct<name:string,type:string,nullable:boolean>>,location:{_LOC}>>, enums array<struct<id:string,name:string,values:array<string>>>"
)


def read_manifests(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per manifest file; a missing repo is ``default``. Recursive types stay JSON texts."""
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("repo", F.coalesce("repo", F.lit("default")))


def frontend_tables(m: DataFrame) -> dict[str, DataFrame]:
    each = lambda c: m.select("repo", F.inline(c))
    files = each("files")
    return {
        "files": files.select("repo", "path", "exports"),
        "imports": files.select("repo", F.col("path").alias("file"), F.inline("imports")).select("repo", "file", "source", F.col("resolvedFile").alias("resolved_file"), "specifiers", "location.line", F.col("location.column").alias("col")),
        "functions": each("functions").select("repo", "id", "name", "file", "params", F.col("returnType").alias("return_type"), "calls", "location.line", F.col("location.column").alias("col"), F.col("containingComponent").alias("containing_component")),
        "api_calls": each("apiCalls").select("repo", "id", F.col("endpointPattern").alias("endpoint_pattern"), "method", F.col("calleeExpression").alias("callee"), "resolution", F.col("wrapperFunctionId").alias("wrapper_function_id"), F.col("callerFunctionId").alias("caller_function_id"), "file", "location.line", F.col("location.column").alias("col"), "arguments", F.col("request.queryKeys").alias("query_keys"), F.col("request.bodyKeys").alias("body_keys"), "code"),
        "property_accesses": each("propertyAccesses").select("repo", "id", F.col("apiCallId").alias("api_call_id"), "object", "path", "flow", "file", "location.line", F.col("location.column").alias("col"), F.col("containingFunctionId").alias("containing_function_id"), F.col("containingComponent").alias("containing_component"), "code"),
    }


def backend_tables(m: DataFrame) -> dict[str, DataFrame]:
    e = m.select("repo", F.posexplode("endpoints").alias("pos", "e")).select("repo", "pos", "e.*")
    d = m.select("repo", F.inline("dtos"))
    v = m.select("repo", F.inline("enums"))
    return {
        "endpoints": e.select("repo", "id", "method", "path", "handler", F.col("requestBody.type").alias("body_type_json"), F.col("requestBody.required").alias("body_required"), F.col("response").alias("response_type_json"), F.col("location.file").alias("file"), F.col("location.line").alias("line"), "pos"),
        "params": e.select("repo", F.col("id").alias("endpoint_id"), F.posexplode("requestParams").alias("pos", "p")).select("repo", "endpoint_id", "p.name", F.col("p.type").alias("type_json"), "p.required", "p.source", "pos"),
        "dtos": d.select("repo", "id", "name", F.col("typeParameters").alias("type_parameters")),
        "dto_fields": d.select("repo", F.col("id").alias("dto_id"), F.posexplode("fields").alias("pos", "f")).select("repo", "dto_id", "pos", "f.name", F.col("f.type").alias("type_json"), "f.nullable"),
        "enum_values": v.select("repo", F.col("id").alias("enum_id"), F.posexplode("values").alias("pos", "value")),
    }


def read_config(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(client map, linking bases) of a config file: apiClientMap and frontendBasePath / backendBasePath."""
    schema = "apiClientMap map<string,struct<method:string,path:string>>, linking struct<frontendBasePath:string,backendBasePath:string>"
    c = spark.read.schema(schema).json(path, multiLine=True)
    clients = c.select(F.explode("apiClientMap").alias("callee", "v")).select(F.lit("default").alias("repo"), "callee", "v.method", "v.path")
    return clients, c.select(F.col("linking.frontendBasePath").alias("frontend_base"), F.col("linking.backendBasePath").alias("backend_base"))


def is_source(path: Column) -> Column:
    """Analysable files: TypeScript but no declarations or packages; Java but no tests or build output."""
    ts = path.rlike(r"\.(ts|tsx|mts|cts)$") & ~path.rlike(r"\.d\.[mc]?ts$") & ~path.rlike(r"(^|/)node_modules/")
    java = path.rlike(r"\.java$") & ~path.rlike(r"(^|/)(src/test|build|target|out|\.gradle|\.git|\.idea|node_modules)/")
    return ts | java


def read_sources(spark: SparkSession, root: str, repo: str = "default") -> DataFrame:
    """(repo, file, text) of the analysable files below ``root``, with paths relative to it."""
    whole = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("uri"), F.col("value").alias("text"))
    # listed as URIs, in which a plus sign stands for itself
    listed = F.url_decode(F.replace("uri", F.lit("+"), F.lit("%2B")))
    file = F.substring_index(listed, root.rstrip("/") + "/", -1)
    return whole.select(F.lit(repo).alias("repo"), file.alias("file"), "text").where(is_source(F.col("file")))


def changed_files(tracked: DataFrame, untracked: DataFrame) -> DataFrame:
    """The union of two listings (repo, file), source files only."""
    return tracked.select("repo", "file").union(untracked.select("repo", "file")).where(is_source(F.col("file"))).distinct()


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)
