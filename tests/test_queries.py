"""Every query of the library against its SQL on the smallest tables, and streaming by steps."""

import os

import compare
import pytest
from pyspark.sql import functions as F

from corpusmill import plans, registry  # noqa: F401
from corpusmill.streaming import jobs

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


#: Without rows on the smallest tables only.
FEW = {"lsh_candidate_pairs"}


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, name):
    found = compare.difference(spark, SF, name, registry.QUERIES[name], registry.ORACLE.get(name))
    assert found == "" or name in FEW and found.startswith("no rows")


def test_requeue(spark):
    f = spark.createDataFrame([("a", "claimed"), ("b", "done")], "url string, status string")
    assert sorted(tuple(r) for r in jobs.requeued(f).collect()) == [("a", "pending"), ("b", "done")]
