"""Contracts, database schemas and settings in source files, read by their formats' own marks.

Every function takes sources (path, content) and returns rows; a file is read within its own row, and JSON is parsed by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _all(expression: str, group: int = 1, column: str = "content") -> Column:
    return F.regexp_extract_all(column, F.lit(expression), F.lit(group))


def _keys(column: str, path: str) -> Column:
    return F.coalesce(F.json_object_keys(F.get_json_object(column, path)), F.array().cast("array<string>"))


def contracts(sources: DataFrame) -> DataFrame:
    """(path, kind, name, member): what OpenAPI, GraphQL, Protobuf and JSON-Schema files declare.

    OpenAPI: paths with their methods. GraphQL: types with fields. Protobuf: messages with fields and services with calls.
    JSON-Schema: titles with properties.
    """
    json_ = sources.where(F.col("path").endswith(".json"))
    paths = json_.where(F.get_json_object("content", "$.openapi").isNotNull() | F.get_json_object("content", "$.swagger").isNotNull())
    paths = paths.select("path", F.explode(F.from_json(F.get_json_object("content", "$.paths"), "map<string,map<string,string>>")).alias("name", "m"))
    openapi = paths.select("path", F.lit("openapi").alias("kind"), "name", F.explode(F.filter(F.map_keys("m"), lambda k: k.isin("get", "put", "post", "delete", "patch", "head", "options"))).alias("member"))
    schema = json_.where(F.get_json_object("content", "$.properties").isNotNull() & (F.get_json_object("content", "$.$schema").isNotNull() | F.get_json_object("content", "$.type").isin("object")))
    schema = schema.select("path", F.lit("json-schema").alias("kind"), F.coalesce(F.get_json_object("content", "$.title"), F.regexp_extract("path", r"([^/]+)\.json$", 1)).alias("name"), F.explode(_keys("content", "$.properties")).alias("member"))

    def blocks(df: DataFrame, kind: str, opens: str, member: str) -> DataFrame:
        whole = rf"(?m)^\s*(?:{opens})\s+\w+[^{{\n]*\{{[^}}]*\}}"
        x = df.select("path", F.explode(_all(whole, 0)).alias("b"))
        return x.select("path", F.lit(kind).alias("kind"), F.regexp_extract("b", rf"(?:{opens})\s+(\w+)", 1).alias("name"), F.explode(_all(member, 1, "b")).alias("member"))

    graphql = blocks(sources.where(F.col("path").rlike(r"\.(graphql|gql)$")), "graphql", "type|input|interface|enum", r"(?m)^\s+(\w+)\s*(?:\([^)]*\))?\s*(?::|$)")
    proto = sources.where(F.col("path").endswith(".proto"))
    messages = blocks(proto, "protobuf", "message", r"(?m)^\s*(?:repeated\s+|optional\s+)?[\w.<>, ]+\s+(\w+)\s*=\s*\d+")
    services = blocks(proto, "protobuf-service", "service", r"\brpc\s+(\w+)")
    return openapi.unionByName(schema).unionByName(graphql).unionByName(messages).unionByName(services)


def database_schemas(sources: DataFrame) -> DataFrame:
    """(path, tool, model, field, type): models of Prisma, TypeORM, Sequelize and Mongoose with their fields."""
    prisma = sources.where(F.col("path").endswith(".prisma")).select("path", F.explode(_all(r"(?m)^model\s+\w+\s*\{[^}]*\}", 0)).alias("b"))
    prisma = prisma.select("path", F.lit("prisma").alias("tool"), F.regexp_extract("b", r"model\s+(\w+)", 1).alias("model"), F.explode(_all(r"(?m)^\s+([A-Za-z]\w*\s+\w+(?:\[\])?\??)", 1, "b")).alias("f"))
    prisma = prisma.select("path", "tool", "model", F.regexp_extract("f", r"^(\w+)", 1).alias("field"), F.regexp_extract("f", r"^\w+\s+(\S+)", 1).alias("type"))
    code = sources.where(F.col("path").rlike(r"\.[jt]s$"))
    typeorm = code.where(F.col("content").contains("@Entity")).select("path", F.regexp_extract("content", r"@Entity\([^)]*\)\s*(?:export\s+)?class\s+(\w+)", 1).alias("model"), F.explode(_all(r"@(?:PrimaryGeneratedColumn|PrimaryColumn|Column)\([^)]*\)\s*((?:\w+\s+)*\w+\s*[!?]?\s*:\s*[\w<>\[\]]+)")).alias("f"))
    typeorm = typeorm.select("path", F.lit("typeorm").alias("tool"), "model", F.regexp_extract("f", r"(\w+)\s*[!?]?\s*:", 1).alias("field"), F.regexp_extract("f", r":\s*(\S+)$", 1).alias("type"))

    def calls(tool: str, opens: str, name: str) -> DataFrame:
        x = code.select("path", F.explode(_all(opens, 0)).alias("b"))
        x = x.select("path", F.lit(tool).alias("tool"), F.regexp_extract("b", name, 1).alias("model"), F.explode(_all(r"(?m)^\s+(\w+\s*:\s*(?:\{[^}]*\}|[\w.]+))", 1, "b")).alias("f"))
        kind = F.coalesce(F.nullif(F.regexp_extract("f", r"type\s*:\s*([\w.]+)", 1), F.lit("")), F.regexp_extract("f", r":\s*([\w.]+)", 1))
        return x.select("path", "tool", "model", F.regexp_extract("f", r"^(\w+)", 1).alias("field"), kind.alias("type"))

    body = r"\{(?:[^{}]|\{[^{}]*\})*\}"
    sequelize = calls("sequelize", rf"\.define\(\s*['\"]\w+['\"]\s*,\s*{body}", r"define\(\s*['\"](\w+)")
    mongoose = calls("mongoose", rf"\b\w+\s*=\s*new\s+(?:mongoose\.)?Schema(?:<[^>]*>)?\(\s*{body}", r"^(\w+)")
    return prisma.unionByName(typeorm).unionByName(sequelize).unionByName(mongoose)


def settings(sources: DataFrame) -> DataFrame:
    """(path, kind, key, value): package.json scripts and dependencies, tsconfig options, Dockerfile instructions, compose services, workflow
    jobs and the names (never the values) of environment files."""
    name = F.substring_index("path", "/", -1)
    json_ = "map<string,string>"

    def entries(df: DataFrame, kind: str, path: str) -> DataFrame:
        return df.select("path", F.lit(kind).alias("kind"), F.explode(F.from_json(F.get_json_object("content", path), json_)).alias("key", "value"))

    package, tsconfig = sources.where(name == "package.json"), sources.where(name.rlike(r"^tsconfig.*\.json$"))
    out = [entries(package, k, f"$.{p}") for k, p in (("script", "scripts"), ("dependency", "dependencies"), ("dev-dependency", "devDependencies"), ("engine", "engines"))]
    out.append(entries(tsconfig, "compiler-option", "$.compilerOptions"))
    docker = sources.where(name.rlike(r"^Dockerfile(\..*)?$")).select("path", F.lit("docker").alias("kind"), F.explode(_all(r"(?m)^((?:FROM|EXPOSE|ENV|CMD|ENTRYPOINT|RUN|COPY|WORKDIR)\s+[^\n]+)")).alias("l"))
    out.append(docker.select("path", "kind", F.regexp_extract("l", r"^(\w+)", 1).alias("key"), F.regexp_extract("l", r"^\w+\s+(.*)$", 1).alias("value")))
    # a block of a yaml file: the more indented lines below its name
    block = lambda b: rf"(?m)^{b}:[ \t]*\n((?:[ \t]+[^\n]*\n?|[ \t]*\n)*)"
    for kind, where, b in (("service", name.rlike(r"^(docker-)?compose.*\.ya?ml$"), "services"), ("job", F.col("path").rlike(r"\.github/workflows/[^/]+\.ya?ml$"), "jobs")):
        x = sources.where(where).select("path", F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all(F.regexp_extract("content", block(b), 1), F.lit(r"(?m)^  ([\w-]+):"), F.lit(1))).alias("key"))
        out.append(x.withColumn("value", F.lit(None).cast("string")))
    env = sources.where(name.rlike(r"^\.env(\..+)?$")).select("path", F.lit("variable").alias("kind"), F.explode(_all(r"(?m)^(?:export\s+)?([A-Za-z_]\w*)\s*=")).alias("key"))
    out.append(env.withColumn("value", F.lit(None).cast("string")))
    all_ = out[0]
    for x in out[1:]:
        all_ = all_.unionByName(x)
    return all_
