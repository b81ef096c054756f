"""Feeds of issue trackers, wikis and drives, landed as JSON: documents, metadata and access lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ISSUES = "id string, key string, fields struct<summary:string,description:string,status:struct<name:string>,issuetype:struct<name:string>,priority:struct<name:string>,project:struct<key:string,name:string>,labels:array<string>,assignee:struct<displayName:string>,reporter:struct<displayName:string>,created:string,updated:string,comment:struct<comments:array<struct<author:struct<displayName:string>,body:string>>>>"
DRIVE = "id string, name string, driveId string, size bigint, webUrl string, folder struct<childCount:bigint>, package struct<type:string>, parentReference struct<path:string,driveId:string>, lastModifiedDateTime string"
PERSON = "struct<id:string,email:string,displayName:string>"
GRANT = f"struct<user:{PERSON},group:{PERSON},siteGroup:{PERSON}>"
PERMISSIONS = f"document_id string, roles array<string>, grantedTo {GRANT}, grantedToV2 {GRANT}, grantedToIdentities array<{GRANT}>, grantedToIdentitiesV2 array<{GRANT}>"
# How a page's blocks are written.
BLOCK_MARKS = {"heading_1": "# ", "heading_2": "## ", "heading_3": "### ", "bulleted_list_item": "- ", "numbered_list_item": "1. ", "quote": "> ", "callout": "> "}


def issues_to_documents(issues: DataFrame, comments: int = 10) -> DataFrame:
    """(source_object_id, title, path, text, metadata) of issue records; the last ten comments are part of the text."""
    f = F.col("fields")
    all_ = F.coalesce(f["comment"]["comments"], F.array().cast("array<struct<author:struct<displayName:string>,body:string>>"))
    last = F.slice(all_, F.greatest(F.size(all_) - comments + 1, F.lit(1)), F.lit(comments))
    said = F.transform(last, lambda c: F.concat(F.coalesce(c["author"]["displayName"], F.lit("Unknown")), F.lit(": "), F.coalesce(c["body"], F.lit(""))))
    heading = F.concat(F.lit("# "), F.col("key"), F.lit(": "), F.coalesce(f["summary"], F.lit("")))
    text = F.concat_ws("\n\n", heading, f["description"], F.when(F.size(said) > 0, F.concat(F.lit("## Comments\n"), F.array_join(said, "\n"))))
    meta = F.map_filter(
        F.create_map(*[x for k, c in (("project", f["project"]["key"]), ("status", f["status"]["name"]), ("issue_type", f["issuetype"]["name"]), ("priority", f["priority"]["name"]), ("labels", F.array_join(f["labels"], ",")), ("assignee", f["assignee"]["displayName"]), ("reporter", f["reporter"]["displayName"]), ("updated", f["updated"]), ("source_path", F.concat_ws("/", f["project"]["key"], F.col("key"))), ("folder_path", f["project"]["key"])) for x in (F.lit(k), c)]),
        lambda _, x: x.isNotNull() & (x != ""),
    )
    return issues.select(F.col("key").alias("source_object_id"), f["summary"].alias("title"), F.concat_ws("/", f["project"]["key"], F.col("key")).alias("path"), text.alias("text"), meta.alias("metadata"))


def flatten_tree(df: DataFrame, key: str, tree: str) -> DataFrame:
    """(key, text, too_deep) of rich-text trees given as JSON strings: texts in order, a line break for hardBreak and behind each block.

    Levels are unrolled until none has a node, so no text is too deep: too_deep, kept for callers that look at it, is 0. Places are kept as
    arrays, so that order survives the joins.
    """
    level = df.select(key, F.try_parse_json(F.col(tree)).alias("node"), F.array(F.lit(0)).alias("place"))
    parts = None
    while parts is None or not level.isEmpty():
        kind = F.try_variant_get("node", "$.type", "string")
        text = F.when(kind == "text", F.try_variant_get("node", "$.text", "string")).when(kind == "hardBreak", "\n")
        own = level.select(key, "place", text.alias("t"), F.lit(0).alias("deep"))
        end = level.filter(kind.isin("paragraph", "heading", "listItem", "codeBlock", "blockquote", "tableRow")).select(key, F.concat("place", F.array(F.lit(1 << 30))).alias("place"), F.lit("\n").alias("t"), F.lit(0).alias("deep"))
        parts = own.unionByName(end) if parts is None else parts.unionByName(own).unionByName(end)
        children = F.try_variant_get("node", "$.content", "array<variant>")
        level = level.select(key, "place", F.posexplode(children).alias("pos", "child")).select(key, F.col("child").alias("node"), F.concat("place", F.array(F.col("pos"))).alias("place"))
    return parts.groupBy(key).agg(F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("place", "t")))), lambda x: x["t"]), ""), r"^\s+|\s+$", "").alias("text"), F.sum("deep").alias("too_deep"))


def page_metadata(properties: DataFrame) -> DataFrame:
    """(page_id, metadata) from (page_id, name, type, value struct): the property kinds that filters use.

    value: select string, multi array<string>, people array<string>, date string, url string, text string, status string.
    """
    v = F.col("value")
    shown = F.when(F.col("type") == "select", v["select"]).when(F.col("type") == "status", v["status"]).when(F.col("type") == "multi_select", F.array_join(v["multi"], ",")).when(F.col("type") == "people", F.array_join(v["people"], ",")).when(F.col("type") == "date", v["date"]).when(F.col("type") == "url", v["url"]).when((F.col("type") == "rich_text") & (F.length(v["text"]) <= 200), v["text"])
    key = F.regexp_replace(F.lower(F.trim("name")), r"\s+", "_")
    rows = properties.select("page_id", key.alias("k"), shown.alias("x")).filter("coalesce(x, '') <> ''")
    return rows.groupBy("page_id", "k").agg(F.max("x").alias("x")).groupBy("page_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "x")))).alias("metadata"))


def blocks_to_text(blocks: DataFrame) -> DataFrame:
    """(page_id, text) from (page_id, pos, type, text, checked, language): blocks in order as markdown; empty blocks are left out."""
    mark = F.create_map(*[F.lit(x) for kv in BLOCK_MARKS.items() for x in kv])
    line = F.when(F.col("type") == "to_do", F.concat(F.when(F.col("checked"), "[x] ").otherwise("[ ] "), "text")).when(F.col("type") == "code", F.concat(F.lit("```"), F.coalesce("language", F.lit("")), F.lit("\n"), F.col("text"), F.lit("\n```"))).otherwise(F.concat(F.coalesce(F.element_at(mark, F.col("type")), F.lit("")), F.col("text")))
    rows = blocks.filter("coalesce(text, '') <> ''").select("page_id", F.struct("pos", line.alias("line")).alias("b"))
    return rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: x["line"]), "\n").alias("text"))


def drive_items_to_documents(items: DataFrame) -> DataFrame:
    """(source_object_id, title, path, folder) of drive items that are files; the path stands behind 'root:' in the parent reference."""
    drive = F.coalesce(F.col("parentReference")["driveId"], F.col("driveId"))
    folder = F.regexp_replace(F.regexp_extract(F.coalesce(F.col("parentReference")["path"], F.lit("")), r"root:(.*)$", 1), "^/+", "")
    files = items.filter("folder IS NULL AND package IS NULL")
    return files.select(F.concat_ws(":", F.lit("sharepoint"), drive, "id").alias("source_object_id"), F.col("name").alias("title"), F.concat_ws("/", F.nullif(folder, F.lit("")), "name").alias("path"), folder.alias("folder"), "size", F.col("webUrl").alias("url"))


def permissions_to_acl(permissions: DataFrame) -> DataFrame:
    """(document_id, principal_type, principal_id, permission): write if some role is write or owner, else read; one row a principal."""
    grants = F.concat(*[F.coalesce(F.array_compact(F.array(g)) if not many else F.col(g), F.array().cast(f"array<{GRANT}>")) for g, many in (("grantedTo", False), ("grantedToV2", False), ("grantedToIdentities", True), ("grantedToIdentitiesV2", True))])
    rows = permissions.select("document_id", "roles", F.explode(grants).alias("g"))
    who = lambda kind, name: F.struct(F.lit(name).alias("type"), F.coalesce(F.col("g")[kind]["email"], F.col("g")[kind]["id"], F.col("g")[kind]["displayName"]).alias("id"))
    named = rows.select("document_id", "roles", F.explode(F.array(who("user", "user"), who("group", "group"), who("siteGroup", "group"))).alias("p")).filter("p.id IS NOT NULL")
    write = F.max(F.array_contains("roles", "write") | F.array_contains("roles", "owner"))
    return named.groupBy("document_id", F.col("p.type").alias("principal_type"), F.col("p.id").alias("principal_id")).agg(F.when(write, "write").otherwise("read").alias("permission"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """(query, id, level) of a gold set in JSON: chunk ids if a query has any, else document ids; queries with neither are left out."""
    rows = spark.read.schema("query string, relevant_doc_ids array<string>, relevant_chunk_ids array<string>, expected_answerable boolean, notes string").json(path, multiLine=True)
    return gold_rows(rows)


def gold_rows(rows: DataFrame) -> DataFrame:
    chunks = F.size(F.coalesce("relevant_chunk_ids", F.array().cast("array<string>"))) > 0
    return rows.select("query", F.explode(F.when(chunks, F.col("relevant_chunk_ids")).otherwise(F.col("relevant_doc_ids"))).alias("id"), F.when(chunks, "chunk").otherwise("document").alias("level"))


def export_tenants(tables: dict[str, DataFrame], path: str) -> None:
    """Every table that has tenant_id, as JSON in one folder a table and tenant."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy("tenant_id").json(f"{path}/{name}")


