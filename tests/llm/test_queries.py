from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quantspark.llm import queries

from .helpers import awkward


def test_registered_under_the_numbers():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_urls_and_vectors_take_awkward_tables(spark, tmp_path):
    pages = [(1, "https://a.net/x", None), (1, "https://a.net/x", "h"), (None, "https://b.org/es/", "h"), (2, None, None), (3, "", "h"), (4, "https://c.net/" + "long/" * 20_000, "h")]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("row", F.lit(1)).withColumn("tokens", F.lit("x")).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, 0, None), (1, None, 1), (None, None, None), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = queries.queries()["op3_url_rules"](spark, str(tmp_path)).collect()
    assert len(rows) == len(pages) and {r.verdict for r in rows} <= {"allow", "block"}
    vectors = [(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (None, [1.0, 0.0], "a"), (2, None, "a"), (3, [], "a"), (4, [None, 1.0], "a"), (5, [0.0, 0.0], None), (6, [1.0] * 5000, "a")]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label string").withColumn("cell", F.lit("x")).withColumn("class", F.lit(1)).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.queries()["op4_pivot_dedup"](spark, str(tmp_path)).collect()
    assert len(got) == len(vectors) and sorted(r.n_links for r in got) == [0, 0, 0, 0, 0, 2, 2, 2]


@pytest.mark.parametrize("name", [n for n in queries.queries() if n not in ("op3_url_rules", "op4_pivot_dedup", "op11_elkan_clusters", "op13_conversation_repair")])
def test_queries_take_awkward_tables(spark, tmp_path, name):
    docs = awkward(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = queries.queries()[name](spark, str(tmp_path)).collect()
    assert name == "op9_license_scan" or len(rows) >= docs.count()
