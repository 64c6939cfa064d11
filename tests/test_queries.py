"""Every query against its SQL on the driver's smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import check
from bindings import oracles, queries
from bindings import queries as bound
from conftest import plan

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return check.connect(SMALL)


def test_every_query_has_sql():
    assert set(bound.ALL) == set(oracles.SQL)
    assert set(bound.ALL) <= set(entry.queries()) and set(oracles.SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(bound.ALL))
def test_query_equals_sql(spark, con, name):
    assert check.compare(spark, con, SMALL, name).startswith("ok")


def test_entry(spark):
    assert entry.entry(spark).count() == 3


@pytest.mark.parametrize("name", ["compute_metrics", "bleu", "ngram_counts", "extract_function", "fill_skipped"])
def test_scoring_stays_in_the_jvm(spark, name):
    text = plan(entry.queries()[name](spark, SMALL))
    assert "Python" not in text and "CartesianProduct" not in text


def test_run_store_scores_once_and_puts_twice(spark, monkeypatch):
    calls = {"score": 0, "put": 0}

    def counted(name, run):
        def call(*args):
            calls[name] += 1
            return run(*args)

        return call

    monkeypatch.setattr(queries, "score_generations", counted("score", queries.score_generations))
    monkeypatch.setattr(queries.result_files, "append_run_metrics", counted("put", queries.result_files.append_run_metrics))
    entry.queries()["run_store"](spark, SMALL)
    assert calls == {"score": 1, "put": 2}
