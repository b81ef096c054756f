"""Claim extractors as table functions of SQL: SELECT * FROM name(TABLE(chunks))."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import regex
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

#: What a text claims: (subject, predicate, object_value, confidence).
Extract = Callable[[str], list[tuple[str, str, str, float]]]
_SAYS = regex.compile(r"(\p{L}+) (is|was|est|ist|es) (\p{L}+)")


def sentences(text: str) -> list[tuple[str, str, str, float]]:
    """The stand-in of claims.pattern_extractor."""
    return [(*m.groups(), 0.5) for m in _SAYS.finditer(text)]


def register(spark: SparkSession, name: str, extract: Extract = sentences, least: int = 30, most: int = 50) -> None:
    """Makes `extract` a table function over a table with document_id, chunk_id, chunk_index and chunk_text.

    It asks for its input by document in the order of chunk_index, so the call needs no PARTITION BY. A document's first `most` chunks of
    `least` characters or more are read, and each claim is given once, where it stands first; letters of either case are the same. Rows come
    to Python one by one, as table functions have it; claims.extract_claims with an Arrow extractor is the fast way. Null texts have no claims.
    """

    class Claims:
        def __init__(self) -> None:
            self.seen, self.read = set(), 0

        @staticmethod
        def analyze(chunks: AnalyzeArgument) -> AnalyzeResult:
            if not chunks.isTable:
                raise ValueError(f"{name} takes a table: {name}(TABLE(chunks))")
            missing = {"document_id", "chunk_id", "chunk_index", "chunk_text"} - set(chunks.dataType.names)
            if missing:
                raise ValueError(f"{name} needs the columns {', '.join(sorted(missing))}")
            shape = StructType().add("document_id", LongType()).add("chunk_id", LongType()).add("subject", StringType()).add("predicate", StringType())
            shape = shape.add("object_value", StringType()).add("confidence", DoubleType()).add("evidence", StringType())
            return AnalyzeResult(shape, partitionBy=[PartitioningColumn("document_id")], orderBy=[OrderingColumn("chunk_index")])

        def eval(self, row) -> Iterator[tuple]:
            text = row["chunk_text"]
            if text is None or len(text.strip(" ")) < least or self.read >= most:
                return
            self.read += 1
            for claim in sorted(extract(text)):
                key = tuple(x.strip(" ").lower() for x in claim[:3])
                if key not in self.seen:
                    self.seen.add(key)
                    yield (row["document_id"], row["chunk_id"], *claim, text[:500])

    spark.udtf.register(name, udtf(Claims))
