"""Text, markdown and HTML: frontmatter, titles, plain text, tables; directory ingest and routing by suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Suffixes that are read, by format.
SUFFIXES = {"txt": "text", "md": "text", "markdown": "text", "html": "html", "htm": "html", "csv": "csv", "tsv": "csv", "json": "json", "pdf": "unsupported", "docx": "unsupported", "xlsx": "unsupported", "pptx": "unsupported"}
# Words of a block's values that are booleans, in lower case.
TRUE, FALSE = ("true", "yes"), ("false", "no")
# Entities that HTML text may hold.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def route_by_suffix(df: DataFrame, path: str = "path") -> DataFrame:
    """df with format: text, html, csv, json, unsupported (known, but not decoded here) or unknown."""
    known = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    return df.withColumn("format", F.coalesce(F.element_at(known, suffix(F.col(path))), F.lit("unknown")))


def ingest_directory(spark: SparkSession, path: str, max_mb: float = 50) -> tuple[DataFrame, DataFrame]:
    """Files of a directory tree as (path, format, text), and (outcome, n); see ingest_files. Spark's file sources don't list empty files."""
    return ingest_files(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path), max_mb)


def ingest_files(files: DataFrame, max_mb: float = 50) -> tuple[DataFrame, DataFrame]:
    """Files (path, length, content) as (path, format, text), and (outcome, n): success, skipped (empty, too large or unknown) or failed
    (known, but not decoded here)."""
    files = route_by_suffix(files)
    outcome = F.when((F.col("length") == 0) | (F.col("length") > max_mb * 1024 * 1024) | (F.col("format") == "unknown"), "skipped").when(F.col("format") == "unsupported", "failed").otherwise("success")
    files = files.withColumn("outcome", outcome)
    good = files.filter("outcome = 'success'").select("path", "format", F.decode("content", "UTF-8").alias("text"))
    return good, files.groupBy("outcome").agg(F.count("*").alias("n"))


def frontmatter(text: Column) -> tuple[Column, Column]:
    """(map of key to value, body) of a text that may begin with a block between --- lines; keys in lower case with _ for blanks, quotes off.
    Keys without a value are left out."""
    block = F.regexp_extract(text, r"(?s)^---\s*\n(.*?)\n---\s*(?:\n|$)", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^\s*[^:#\s][^:]*:"))
    key = lambda x: F.regexp_replace(F.lower(F.trim(F.regexp_extract(x, r"^([^:]*):", 1))), r"[\s-]+", "_")
    value = lambda x: F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)), "^[\"'](.*)[\"']$", "$1")
    # of repeated keys the last counts
    pairs = F.filter(F.transform(lines, lambda x: F.struct(key(x).alias("key"), value(x).alias("value"))), lambda p: p["value"] != "")
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["key"] == p["key"]))
    has = text.rlike(r"(?s)^---\s*\n(.*?)\n---\s*(?:\n|$)")
    return F.when(has, F.map_from_entries(last)).otherwise(F.create_map().cast("map<string,string>")), F.when(has, F.regexp_replace(text, r"(?s)^---\s*\n(.*?)\n---\s*(?:\n|$)", "")).otherwise(text)


def as_boolean(c: Column) -> Column:
    """What true, yes, false or no in any case stand for; null for anything else."""
    return F.when(F.lower(c).isin(*TRUE), True).when(F.lower(c).isin(*FALSE), False)


def value_type(c: Column) -> Column:
    """boolean (true, false, yes, no), integer, number or string."""
    return F.when(as_boolean(c).isNotNull(), "boolean").when(c.try_cast("bigint").isNotNull() & c.rlike(r"^-?\d+$"), "integer").when(c.try_cast("double").isNotNull() & c.rlike(r"^-?(\d+\.\d*|\.\d+)$"), "number").otherwise("string")


def parse_text(df: DataFrame) -> DataFrame:
    """df (text, ...) with frontmatter, body and title: the frontmatter's title or name, else the body's first line without '# '."""
    meta, body = frontmatter(F.col("text"))
    out = df.withColumns({"frontmatter": meta, "body": F.trim(body)})
    first = F.regexp_replace(F.element_at(F.split(F.regexp_replace("body", r"^\s+", ""), "\n"), 1), r"^#+\s*", "")
    return out.withColumn("title", F.coalesce(F.col("frontmatter")["title"], F.col("frontmatter")["name"], first))


def html_to_text(html: Column) -> Column:
    """Line breaks for <br> and ends of blocks, tags off, five entities, at most one blank line."""
    c = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    c = F.regexp_replace(c, r"(?i)</(p|div|h[1-6]|li|tr)>", "\n")
    c = F.regexp_replace(c, r"<[^>]+>", "")
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def table_to_markdown(headers: Column, rows: Column) -> Column:
    """A pipe table; rows are padded or cut to the header's width, absent headers are Col1, Col2, ...; empty for no header and no row."""
    widest = F.aggregate(rows, F.lit(0), lambda n, r: F.greatest(n, F.size(r)))
    head = F.when(F.size(headers) > 0, headers).otherwise(F.when(widest > 0, F.transform(F.sequence(F.lit(1), F.greatest(widest, F.lit(1))), lambda i: F.concat(F.lit("Col"), i.cast("string")))).otherwise(F.array().cast("array<string>")))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | ", ""), F.lit(" |"))
    fit = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), F.size(head))), F.lit(1), F.size(head))
    body = F.concat(F.array(line(head), line(F.transform(head, lambda _: F.lit("---")))), F.transform(rows, lambda r: line(fit(r))))
    return F.when(F.size(head) > 0, F.array_join(body, "\n")).otherwise("")


def csv_to_documents(lines: DataFrame, table_rows: int = 200, detail_rows: int = 500) -> DataFrame:
    """(path, text, rows, columns, headers) from (path, line, cells): a markdown table of the first rows and 'header: value; ...' lines.

    `cells` is the split line, `line` its number from 0, which is the header. Blank values are left out of the details. The caps are the
    format's; `rows` counts all.
    """
    head = lines.filter("line = 0").select("path", F.col("cells").alias("headers"))
    place = Window.partitionBy("path").orderBy("line")
    rows = lines.filter("line > 0").withColumn("n", F.row_number().over(place))
    kept = rows.filter(F.col("n") <= detail_rows).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("n", "cells"))).alias("r"))
    total = rows.groupBy("path").agg(F.count("*").alias("rows"))
    out = head.join(kept, "path", "left").join(total, "path", "left").fillna(0, ["rows"])
    body = F.coalesce(F.transform("r", lambda x: x["cells"]), F.array().cast("array<array<string>>"))
    details = F.transform(body, lambda c: F.array_join(F.filter(F.zip_with(F.col("headers"), F.slice(c, F.lit(1), F.size("headers")), lambda h, x: F.when(F.trim(x) != "", F.concat(h, F.lit(": "), x))), lambda x: x.isNotNull()), "; "))
    text = F.concat(table_to_markdown(F.col("headers"), F.slice(body, 1, table_rows)), F.lit("\n\n"), F.array_join(details, "\n"))
    return out.select("path", text.alias("text"), "rows", F.size("headers").cast("long").alias("columns"), "headers")
