"""Golden values of scalar functions, filters and sources."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from verimill.functions import extension, text
from verimill.operators import chunking, filters, retrieval
from verimill.sources import feeds
from verimill.sources import text as st


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column).first()[0]


@pytest.mark.parametrize("given,want", [("Power BI", "power bi"), ("What is the price of a car", "what price car"), ("Der Preis für das Auto", "preis auto"), ("BI-Tool (primary)", "bi tool primary"), ("the of and", "")])
def test_normalize(spark, given, want):
    assert one(spark, text.normalize_text(F.col("x")), x=given) == want


def test_trigrams(spark):
    assert set(one(spark, text.trigrams(F.col("x")), x="cat")) == {"  c", " ca", "cat", "at "}
    assert one(spark, text.trigram_similarity(F.lit("cat"), F.lit("cat")), x=1) == 1.0
    assert one(spark, text.trigram_similarity(F.lit(""), F.lit("")), x=1) == 0.0


def test_cosine(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, text.cosine_similarity(v(1, 0), v(1, 0)), x=1) == pytest.approx(1)
    assert one(spark, text.cosine_similarity(v(1, 0), v(0, 2)), x=1) == 0
    assert one(spark, text.cosine_similarity(v(0, 0), v(1, 1)), x=1) == 0
    assert one(spark, text.is_zero_vector(v(0, 0)), x=1)


@pytest.mark.parametrize("given,want", [("Score: 0.8 of 1", 0.8), ("7", 1.0), ("none", 0.5), (None, 0.5)])
def test_first_score(spark, given, want):
    assert spark.createDataFrame([(given,)], "x string").select(text.first_score(F.col("x"))).first()[0] == want


def test_clean_reply(spark):
    assert one(spark, text.clean_reply(F.col("x")), x='<think>[1]</think>so\n```json\n[{"a": 1}]\n```') == '[{"a": 1}]'
    assert one(spark, text.clean_reply(F.col("x")), x="no list") is None


def test_sql_functions_agree_with_columns(spark):
    text.register(spark)
    df = spark.createDataFrame([("Der BI-Tool (primary) report", "report tools")], "a string, b string")
    row = df.select(F.expr("normalize_text(a)"), text.normalize_text(F.col("a")), F.expr("trigram_similarity(a, b)"), text.trigram_similarity(F.col("a"), F.col("b")), F.expr("cosine_similarity(array(1D, 2D), array(2D, 1D))")).first()
    assert row[0] == row[1]
    assert row[2] == pytest.approx(row[3])
    assert row[4] == pytest.approx(0.8)


@pytest.mark.parametrize(
    "given,kind,sure",
    [("How does it work?", "rag", 0.9), ("What is a token", "rag", 0.9), ("Explain the policy", "rag", 0.9), ("How many documents are there", "structured", 0.8), ("list all skills", "structured", 0.8), ("quality score of A", "structured", 0.8), ("conflicts between A and B", "structured", 0.8), ("latest documents", "structured", 0.8), ("pricing", "rag", 0.5)],
)
def test_route(spark, given, kind, sure):
    r = retrieval.route(spark.createDataFrame([(1, given)], "query_id long, query_text string")).first()
    assert (r.query_type, r.confidence) == (kind, sure)


@pytest.mark.parametrize("content,reason", [("x" * 60, None), ("", "Empty content"), (None, "Empty content"), ("Hi", "Content too short (2 < 50 chars)"), ("Lorem ipsum " * 10, "Content matches blocklist pattern"), ("This page is auto-generated " * 5, "Content matches blocklist pattern")])
def test_validation(spark, content, reason):
    df = spark.createDataFrame([("s", content, {})], "source string, content string, metadata map<string,string>")
    r = filters.validate_events(df).first()
    assert (r.valid, r.reason) == (reason is None, reason)


def test_frontmatter(spark):
    raw = "---\nname: My Skill\nversion: 1.0\nampel: grün\nactive: true\npriority: 5\nDoc Type: 'x y'\n---\n\n# Content\nmore"
    r = st.parse_text(spark.createDataFrame([(raw,), ("# Only a title\nbody",)], "text string")).collect()
    assert r[0].frontmatter == {"name": "My Skill", "version": "1.0", "ampel": "grün", "active": "true", "priority": "5", "doc_type": "x y"}
    assert r[0].title == "My Skill" and r[0].body.strip() == "# Content\nmore"
    assert r[1].frontmatter == {} and r[1].title == "Only a title"
    kinds = spark.createDataFrame([("1.0",), ("true",), ("5",), ("x",)], "v string").select(st.value_type(F.col("v"))).collect()
    assert [k[0] for k in kinds] == ["number", "boolean", "integer", "string"]


def test_frontmatter_values(spark):
    rows = spark.createDataFrame([("Yes", "boolean", True), ("NO", "boolean", False), ("False", "boolean", False), ("yess", "string", None), ("5.", "number", None), (".5", "number", None), ("-3", "integer", None), ("", "string", None), (None, "string", None)], "v string, kind string, truth boolean")
    assert all(r.got == r.kind and r.is_true == r.truth for r in rows.withColumns({"got": st.value_type(F.col("v")), "is_true": st.as_boolean(F.col("v"))}).collect())
    r = st.parse_text(spark.createDataFrame([("---\ntags:\n- a\nquoted: ''\nname: x\n---\nbody",)], "text string")).first()
    assert r.frontmatter == {"name": "x"}


def test_html(spark):
    assert one(spark, st.html_to_text(F.col("x")), x="<h1>Title</h1><p>Hello <b>world</b> &amp; you</p>") == "Title\nHello world & you"


def test_markdown_table(spark):
    df = spark.createDataFrame([(["a", "b"], [["1", "2"], ["3"]]), ([], []), ([], [["x", "y"]])], "h array<string>, r array<array<string>>")
    got = [r[0] for r in df.select(st.table_to_markdown(F.col("h"), F.col("r"))).collect()]
    assert got[0] == "| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 |  |"
    assert got[1] == ""
    assert got[2].startswith("| Col1 | Col2 |")


def test_directory(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\n" + "x" * 80)
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "c.txt").write_text("")
    (tmp_path / "d.bin").write_bytes(b"1")
    good, counts = st.ingest_directory(spark, str(tmp_path))
    assert good.count() == 1
    assert {r.outcome: r.n for r in counts.collect()} == {"success": 1, "failed": 1, "skipped": 1}


def test_drive_item(spark):
    df = spark.createDataFrame([("item-1", "Policy.pdf", None, 5, "u", None, None, ("/drives/drive-1/root:/Policies/HR", "drive-1"))], fields_of(feeds.DRIVE))
    r = feeds.drive_items_to_documents(df).first()
    assert (r.source_object_id, r.path, r.folder) == ("sharepoint:drive-1:item-1", "Policies/HR/Policy.pdf", "Policies/HR")


def fields_of(sql):
    from pyspark.sql.types import StructType

    s = StructType.fromDDL(sql)
    return StructType([f for f in s.fields if f.name != "lastModifiedDateTime"])


def test_gold(spark, tmp_path):
    (tmp_path / "g.json").write_text('[{"query": "a", "relevant_doc_ids": ["d1"], "relevant_chunk_ids": ["c1", "c2"]}, {"query": "b", "relevant_doc_ids": ["d2"], "relevant_chunk_ids": []}, {"query": "c", "relevant_doc_ids": [], "relevant_chunk_ids": []}]')
    got = {(r.query, r.id, r.level) for r in feeds.read_gold(spark, str(tmp_path / "g.json")).collect()}
    assert got == {("a", "c1", "chunk"), ("a", "c2", "chunk"), ("b", "d2", "document")}


def test_chunks_cover_the_text(spark):
    text_ = ". ".join(f"Sentence number {i} has some words" for i in range(200)) + "\n\n" + "\n\n".join(f"Paragraph {i}" for i in range(20))
    docs = spark.createDataFrame([(1, text_), (2, ""), (3, None)], "document_id long, text string")
    for size, overlap in ((50, 10), (30, 0)):
        got = chunking.chunk_documents(docs, size, overlap).orderBy("chunk_index").collect()
        assert {r.document_id for r in got} == {1}
        assert len(got) > 5
        assert all(r.tokens <= size for r in got)
        assert all(r.chunk_text in text_ for r in got)
        places = [text_.index(r.chunk_text) for r in got]
        ends = [p + len(r.chunk_text) for p, r in zip(places, got, strict=True)]
        assert all(text_[e:p].strip() == "" for e, p in zip(ends, places[1:], strict=False) if p > e)
        assert (places[1] < ends[0]) == (overlap > 0)


def test_embed_reuses_known_texts(spark):
    rows = spark.createDataFrame([("a b",), ("a b",), ("c",)], "chunk_text string")
    first, cache = extension.embed(rows)
    assert cache.count() == 2 and first.count() == 3
    more = spark.createDataFrame([("a b",), ("new",)], "chunk_text string")
    both, known = extension.embed(more, cache=cache)
    assert known.count() == 3 and both.count() == 2


def test_pandas_model_plugs_in(spark):
    import pandas as pd

    @F.pandas_udf("array<double>")
    def model(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [float(len(t))])

    got, _ = extension.embed(spark.createDataFrame([("abc",)], "chunk_text string"), model)
    assert got.first().embedding == [3.0]
