"""Bridge views: the given tables in the shape of the knowledge-governance tables, the same in Spark and in the checking SQL.

Each view is one SQL text; braces name the views or tables it reads. Where the two dialects differ, a short macro stands for the difference.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: The moment that "now" is, in every query.
NOW = "stamp('2024-01-31 00:00:00')"

VIEWS: dict[str, str | tuple[str, str]] = {
    "tenants": """SELECT CAST(r_regionkey AS BIGINT) AS tenant_id, r_name AS name,
        CASE r_regionkey % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'pro' ELSE 'enterprise' END AS plan,
        CASE r_regionkey % 3 WHEN 0 THEN 100 WHEN 1 THEN 10000 ELSE 1000000 END AS max_documents,
        CASE r_regionkey % 3 WHEN 0 THEN 1000 WHEN 1 THEN 50000 ELSE 1000000 END AS max_queries_per_month,
        CASE r_regionkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 10 ELSE 100 END AS max_sources,
        CASE r_regionkey % 3 WHEN 0 THEN 30 WHEN 1 THEN 90 END AS retention_days, r_regionkey <> 3 AS hard_delete_enabled FROM {region}""",
    "sources": """SELECT source_id, number % 5 AS tenant_id, concat('Source ', number) AS name,
        CASE number % 4 WHEN 0 THEN 'sharepoint' WHEN 1 THEN 'jira' WHEN 2 THEN 'notion' ELSE 'file_upload' END AS source_type, number % 3 = 0 AS auto_sync, 15 * (1 + number % 4) AS interval_minutes
        FROM (SELECT DISTINCT source AS source_id, CAST(substr(source, 4) AS BIGINT) AS number FROM {documents} WHERE source IS NOT NULL) AS s""",
    "docs": """SELECT doc_id AS document_id, doc_id % 5 AS tenant_id, source AS source_id, text, lang, substr(split_part(text, chr(10), 1), 1, 80) AS title,
        sha256hex(text) AS content_hash, lang AS doc_type, length(text) - length(replace(text, chr(10), '')) + 1 AS chunk_count, 1 + doc_id % 3 AS version,
        CASE WHEN doc_id % 29 = 0 THEN 'deleted' WHEN doc_id % 23 = 0 THEN 'quarantined' ELSE 'indexed' END AS status,
        CASE doc_id % 13 WHEN 0 THEN 'rejected' WHEN 1 THEN 'superseded' WHEN 2 THEN 'quarantined' WHEN 3 THEN 'needs_review' ELSE 'published' END AS review_status,
        CASE WHEN doc_id % 17 = 0 THEN NULL ELSE CAST((doc_id * 37) % 101 AS DOUBLE) / 100 END AS quality_score,
        CASE doc_id % 5 WHEN 0 THEN 'warm' WHEN 1 THEN 'cold' ELSE 'hot' END AS index_tier, doc_id % 9 AS access_count,
        CASE WHEN doc_id % 10 = 0 THEN NULL ELSE plus_minutes(stamp('2024-01-31 00:00:00'), -1440 * (doc_id % 120)) END AS last_accessed_at,
        plus_minutes(stamp('2024-01-01 00:00:00'), CASE WHEN doc_id % 19 = 0 THEN doc_id - 600000 ELSE doc_id END) AS created_at, concat('/', lang, '/', doc_id % 7, '/doc', doc_id, '.md') AS source_path FROM {documents}""",
    "chunks": (
        """SELECT document_id * 1000000 + pos AS chunk_id, document_id, tenant_id, CAST(pos AS BIGINT) AS chunk_index, chunk_text, sha2(chunk_text, 256) AS chunk_hash
        FROM (SELECT document_id, tenant_id, posexplode(split(text, '\\n')) AS (pos, chunk_text) FROM {docs}) WHERE length(chunk_text) >= 10""",
        """SELECT document_id * 1000000 + pos AS chunk_id, document_id, tenant_id, CAST(pos AS BIGINT) AS chunk_index, chunk_text, sha256(chunk_text) AS chunk_hash
        FROM (SELECT document_id, tenant_id, unnest(string_split(text, chr(10))) AS chunk_text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM {docs}) WHERE length(chunk_text) >= 10""",
    ),
    "vectors": """SELECT vec_id AS document_id, CAST(embedding AS DOUBLE_ARRAY) AS embedding, CAST(label AS BIGINT) AS label FROM {embeddings}""",
    "queries": """SELECT item_id AS query_id, text AS query_text, item_id % 5 AS tenant_id FROM {benchmark}""",
    "claims": """SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS claim_id, l_orderkey AS document_id, l_orderkey % 5 AS tenant_id,
        concat('Part#', l_partkey) AS subject, concat('Return flag of the part ', l_partkey) AS predicate, l_returnflag AS object_value, round(1 - l_discount, 2) AS confidence,
        CASE l_linestatus WHEN 'O' THEN 'active' ELSE 'superseded' END AS status, CAST(l_shipdate AS DATE) AS valid_from FROM {lineitem}""",
    "claim_docs": """SELECT o_orderkey AS document_id, o_orderkey % 5 AS tenant_id, o_orderpriority AS source_id, o_orderdate AS created_at,
        CASE o_orderstatus WHEN 'F' THEN 'deleted' ELSE 'indexed' END AS status, c_name AS title FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "conflicts": """SELECT doc_id AS conflict_id, doc_id AS document_a_id, (doc_id * 7 + 3) % (SELECT count(*) FROM {documents}) AS document_b_id, doc_id % 5 AS tenant_id,
        CASE doc_id % 8 WHEN 0 THEN 'duplicate' WHEN 2 THEN 'overlap' WHEN 4 THEN 'supersession' ELSE 'contradiction' END AS conflict_type,
        CAST((doc_id * 13) % 100 AS DOUBLE) / 100 AS confidence, CASE WHEN doc_id % 3 = 0 THEN 'resolved' ELSE 'new' END AS status FROM {documents} WHERE doc_id % 2 = 0""",
    "findings": """SELECT doc_id * 10 + doc_id % 4 AS finding_id, CASE WHEN doc_id % 31 = 0 THEN doc_id + 100000000 ELSE doc_id END AS document_id, doc_id % 5 AS tenant_id,
        CASE doc_id % 4 WHEN 0 THEN 'short_content' WHEN 1 THEN 'no_title' WHEN 2 THEN 'high_boilerplate' ELSE 'empty_content' END AS finding_type,
        CASE WHEN doc_id % 4 = 3 THEN 'critical' WHEN doc_id % 7 = 0 THEN 'info' ELSE 'warning' END AS severity, CAST(doc_id % 4 + 1 AS DOUBLE) / 10 AS penalty FROM {documents}""",
    "reviews": """SELECT doc_id AS task_id, doc_id AS document_id, doc_id % 5 AS tenant_id, CASE WHEN doc_id % 2 = 0 THEN 'quality' ELSE 'conflict' END AS task_type,
        CASE doc_id % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'approved' ELSE 'rejected' END AS status, plus_minutes(stamp('2024-01-02 00:00:00'), doc_id) AS created_at FROM {documents}""",
    "usage": """SELECT event_id, user_id % 5 AS tenant_id, event_type, CAST(1 + event_id % 3 AS BIGINT) AS quantity, value AS latency_ms, ts AS created_at FROM {events}""",
    "audit": """SELECT event_id, user_id AS actor, event_type AS action, CASE user_id % 3 WHEN 0 THEN 'document' WHEN 1 THEN 'source' ELSE 'claim' END AS resource_type, event_id % 100 AS resource_id, ts AS created_at FROM {events}""",
    "feedback": """SELECT event_id AS feedback_id, event_id % (SELECT greatest(CAST(floor(count(*) / 2) AS BIGINT), 1) FROM {documents}) AS document_id, event_id % (SELECT greatest(CAST(floor(count(*) / 2) AS BIGINT), 1) FROM {documents}) * 1000000 + event_id % 3 AS chunk_id, CAST(event_id % 3 - 1 AS BIGINT) AS rating, CASE event_id % 4 WHEN 0 THEN 'resolved' ELSE NULL END AS outcome, ts AS created_at FROM {events}""",
    "acl": """SELECT doc_id AS document_id, 'user' AS principal_type, doc_id % 6 AS principal_id, CASE doc_id % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'write' WHEN 2 THEN 'admin' ELSE 'none' END AS permission FROM {documents} WHERE doc_id % 3 = 0""",
    "cursors": """SELECT source_id, source_type, CASE WHEN tenant_id = 0 THEN NULL ELSE plus_minutes(stamp('2024-01-31 00:00:00'), -10 * (1 + tenant_id)) END AS last_sync_at, CASE WHEN tenant_id = 4 THEN 'running' ELSE 'idle' END AS sync_status FROM {sources}""",
    "versions": (
        """SELECT document_id, version, CASE WHEN version = top THEN text ELSE concat(split_part(text, chr(10), 1), chr(10), 'revision ', version) END AS content_snapshot
        FROM (SELECT document_id, explode(sequence(1L, version)) AS version, text, version AS top FROM {docs})""",
        """SELECT document_id, version, CASE WHEN version = top THEN text ELSE concat(split_part(text, chr(10), 1), chr(10), 'revision ', version) END AS content_snapshot
        FROM (SELECT document_id, unnest(range(1, version + 1)) AS version, text, version AS top FROM {docs})""",
    ),
    "postings": (
        """SELECT chunk_id, document_id, tenant_id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT chunk_id, document_id, tenant_id, explode(split(lower(chunk_text), '[^\\\\p{{L}}\\\\p{{N}}]+')) AS term FROM {chunks}) WHERE term <> '' GROUP BY ALL""",
        """SELECT chunk_id, document_id, tenant_id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT chunk_id, document_id, tenant_id, unnest(string_split_regex(lower(chunk_text), '[^\\p{L}\\p{N}]+')) AS term FROM {chunks}) WHERE term <> '' GROUP BY ALL""",
    ),
}


def _spark(sql: str) -> str:
    sql = re.sub(r"sha256hex\(([^()]*)\)", r"sha2(\1, 256)", sql)
    sql = re.sub(r"stamp\(('[^']*')\)", r"TIMESTAMP_NTZ \1", sql)
    sql = re.sub(r"plus_minutes\(([^,()]*(?:\([^()]*\))?), ((?:[^()]|\([^()]*\))*)\)", r"(\1 + make_interval(0, 0, 0, 0, 0, CAST(\2 AS INT)))", sql)
    return sql.replace("DOUBLE_ARRAY", "ARRAY<DOUBLE>")


def duck(sql: str) -> str:
    sql = re.sub(r"sha256hex\(([^()]*)\)", r"sha256(\1)", sql)
    sql = re.sub(r"stamp\(('[^']*')\)", r"TIMESTAMP \1", sql)
    sql = re.sub(r"plus_minutes\(([^,()]*(?:\([^()]*\))?), ((?:[^()]|\([^()]*\))*)\)", r"(\1 + to_minutes(\2))", sql)
    return sql.replace("DOUBLE_ARRAY", "DOUBLE[]")


def _reads(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{([a-z_]+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """A bridge view or a given table, as a DataFrame. Views that are `given` by name stand in place of those that it reads."""
    if name in given:
        return given[name]
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name] if isinstance(VIEWS[name], str) else VIEWS[name][0]
    return spark.sql(_spark(text), **{x: view(spark, sf_dir, x, **given) for x in _reads(text)})


def oracle(body: str) -> str:
    """Checking SQL: `body` with the bridge views it names in braces as common tables before it."""
    done: dict[str, str] = {}

    def need(name: str) -> None:
        if name in TABLES or name in done:
            return
        text = VIEWS[name] if isinstance(VIEWS[name], str) else VIEWS[name][1]
        for x in _reads(text):
            need(x)
        done[name] = duck(re.sub(r"\{([a-z_]+)\}", r"\1", text))

    for x in _reads(body):
        need(x)
    body = duck(re.sub(r"\{([a-z_]+)\}", r"\1", body)).strip()
    if not done:
        return body
    lead = ",\n".join(f"{k} AS ({v})" for k, v in done.items())
    return f"WITH {lead},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {lead}\n{body}"
