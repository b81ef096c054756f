"""The index after any sequence of changes is the index built anew."""

import random

from verimill.operators import claims as cl
from verimill.operators import incremental as inc
from verimill.operators.conflicts import checkpointed

CLAIM = "claim_id string, tenant_id long, document_id long, subject string, predicate string, object_value string, confidence double, status string"
DOC = "document_id long, status string"


def claim(rng, i, status=("active", "active", "superseded")):
    return (f"c{i}", rng.choice([1, 2, None]), rng.randrange(6), rng.choice(["A", "the A", "B", None]), rng.choice(["p", "P!", "q"]), rng.choice("xyz"), rng.choice([0.5, 0.7, 0.9]), rng.choice(status))


def index(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_any_sequence_is_a_rebuild(spark):
    rng = random.Random(1)
    claims = spark.createDataFrame([claim(rng, i) for i in range(40)], CLAIM)
    docs = spark.createDataFrame([(i, rng.choice(["indexed", "deleted"])) for i in range(5)], DOC)
    rows = cl.usable_claims(claims, docs)
    entries, support = inc.entries_of(rows), inc.support_of(rows)
    assert index(inc.shown(entries)) == index(cl.build_index(claims, docs))
    for step in range(3):
        named = rng.sample(range(50), [6, 40, 12][step])
        changes = spark.createDataFrame([claim(rng, i, ("active", "active", "superseded", None)) for i in named], CLAIM)
        states = spark.createDataFrame([(i, rng.choice(["indexed", "deleted", "quarantined", None])) for i in rng.sample(range(7), step + 1)], DOC)
        claims, docs, gone, came = inc.claim_delta(claims, docs, changes, states)
        claims, docs = checkpointed(claims), checkpointed(docs)
        at, of = inc.apply_changes(entries, support, gone, came, claims, docs)
        at, of = checkpointed(at), checkpointed(of)
        assert at.count() <= gone.union(came).select(*inc.ENTRY).distinct().count()
        entries = checkpointed(inc.merged(entries, at))
        support = checkpointed(inc.merged(support, of, [*inc.ENTRY, "document_id"], "n"))
        assert index(inc.shown(entries)) == index(cl.build_index(claims, docs))
        assert index(support) == index(inc.support_of(cl.usable_claims(claims, docs)))


def test_the_best_claim_withdrawn(spark):
    rows = [("a", 1, 1, "S", "p", "x", 0.9, "active"), ("b", 1, 1, "S", "p", "y", 0.9, "active"), ("c", 1, 2, "S", "p", "z", 0.9, "active")]
    claims, docs = spark.createDataFrame(rows, CLAIM), spark.createDataFrame([(1, "indexed"), (2, "indexed")], DOC)
    before = cl.usable_claims(claims, docs)
    for gone, value in [("a", "y"), ("c", "x")]:
        change = spark.createDataFrame([(gone, *[None] * 7)], CLAIM)
        c1, d1, out, came = inc.claim_delta(claims, docs, change, spark.createDataFrame([], DOC))
        at, _ = inc.apply_changes(inc.entries_of(before), inc.support_of(before), out, came, c1, d1)
        (r,) = inc.shown(at).collect()
        assert (r.value, r.claim_count) == (value, 2)


def test_no_change_touches_nothing(spark):
    claims, docs = spark.createDataFrame([("a", 1, 1, "S", "p", "x", 0.9, "active")], CLAIM), spark.createDataFrame([(1, "indexed")], DOC)
    *_, out, came = inc.claim_delta(claims, docs, claims, docs)
    assert out.count() == came.count() == 0
