"""The registry, and a share of the queries against their oracles at the smallest scale.

``python tests/check_oracles.py /root/testdata/sf0.01`` checks all of them.
"""

import os

import pytest
from check_oracles import compare, duck

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")

CHECKED = ["scan_sightings", "dim_cells", "valid_sightings", "context_sightings", "device_history",
           "numbered_usage", "semantic_place", "geo_pairs", "geo_knn", "geo_edges",
           "neighbor_overlap", "stratified_split_labels", "negatives_sampled", "itemcf_topn",
           "precision_recall_at_k", "rank_gradient", "mf_one_step", "topn_by_factor", "als_topn",
           "train_als", "als_short_topn", "als_short_mse", "metrics_weighted_mf", "metrics_bpr", "records_by_shard", "file_numbered_usage"]


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    rest = set(queries()) - set(oracle_sql())  # the corpus queries are checked beside their tests
    assert {q for q in rest if q != "pipeline" and not q.startswith("op")} == {"als_metrics", "als_mse"}  # thirty iterations


def test_entry(spark):
    assert entry(spark).columns == ["device", "cnt", "prefix", "d"]


@pytest.mark.parametrize("name", CHECKED)
def test_matches_oracle(spark, name):
    assert compare(queries()[name](spark, SF), duck(SF), oracle_sql()[name]) is None


def test_result_does_not_depend_on_partitions(spark):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        return sorted(queries()["negatives_sampled"](spark, SF).collect())

    try:
        assert run(3) == run(11)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
