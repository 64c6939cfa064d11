"""Queries with SQL against that SQL, and the pipeline against its stages by brute force."""

import os

import check
import corpus_pipeline
import odd_documents as odd
import pytest
from conftest import rows

import __spark_entry__ as entry
from pairloom.llm import oracles, queries, secret_scan
from pairloom.storage import checkpoint_dir

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_sql(spark, name):
    assert check.compare(spark, check.connect(SMALL), SMALL, name).startswith("ok")


def test_queries_are_registered():
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_stages_act_on_all_that_came_before(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id: r.text for r in docs.collect()})
    toxic, near, clean, redacted = seen
    assert set(redacted) == set(clean) <= set(near) <= set(toxic)
    assert all(redacted[i] == secret_scan.redact(clean[i]) for i in clean)
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    from test_decontaminate import brute as hits

    found = hits([(i, t) for i, t in near.items()], [(r.item_id, r.text) for r in items])
    assert set(clean) == {r[0] for r in found if not r[5]}
    from test_simhash import brute_fingerprint

    ids = sorted(toxic)
    prints = [brute_fingerprint(toxic[i]) for i in ids]
    root = odd.components(len(ids), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert set(near) == {ids[r] for r in set(root)}
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(redacted)
    tables = os.path.join(checkpoint_dir(spark), "tables")
    there = set(os.listdir(tables)) if os.path.isdir(tables) else set()
    assert rows(corpus_pipeline.run(spark, SMALL)) == rows(mixed)
    left = {t.rsplit("-", 1)[0] for t in set(os.listdir(tables)) - there}
    assert {t for t in left if t.startswith("pipeline-")} == {"pipeline-mix"}


def test_stages_take_odd_documents(spark):
    docs = odd.documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns
        assert stage(spark, odd.empty(spark), SMALL).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()
