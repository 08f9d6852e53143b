import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import dense as D, graph_index as G


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (6000, 24))
    v = spark.createDataFrame([(i * 3, [float(a) for a in r]) for i, r in enumerate(x)], "chunk_id long, embedding array<float>")
    path = str(tmp_path_factory.mktemp("graph") / "g")
    G.build_graph(v, path, part_rows=3000)
    q = v.where("chunk_id % 300 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    return v, G.load_graph(spark, path), q


def recall(found, exact):
    return D.recall_at_k(found, exact).agg(F.avg("recall")).first()[0]


def test_graph_table(made):
    v, g, _ = made
    assert g.count() == v.count() and g.select("part").distinct().count() == 2
    assert g.where("size(links) > 1").count() > 100  # upper layers
    assert g.where(F.exists("links", lambda layer: F.exists(layer, lambda j: (j < 0) | (j == F.col("node"))))).count() == 0
    assert g.select(F.max(F.size(F.col("links")[0]))).first()[0] <= 2 * G.M


def test_recall_and_fewer_distances_than_lists(spark, made):
    v, g, q = made
    exact = D.cosine_exact(v, q, 50)
    found = G.graph_search(g, q, 50)
    assert found.groupBy("query_id").count().where("count = 50").count() == q.count()
    assert recall(found, exact) >= 0.95
    cost = G.graph_search(g, q, 50, counts=True).agg(F.avg("distances")).first()[0]
    # Lists need so many probes for that recall that they compute more distances.
    lists = 64
    centres = D.ivf_build(v, lists)
    assert recall(D.ann_search(v, q, 50, centres, 24), exact) < 0.95
    assert cost < lists + v.count() * 24 / lists
    assert cost < v.count() / 2


def test_filter_of_one_percent(made):
    v, g, q = made
    few = v.where("chunk_id % 1000 < 11").select("chunk_id")  # about one in a hundred
    exact = D.cosine_exact(v.join(few, "chunk_id"), q, 50)
    found = G.graph_search(g, q, 50, allowed=few)
    assert found.join(few, "chunk_id", "left_anti").count() == 0
    assert found.groupBy("query_id").count().where("count = 50").count() == q.count() and recall(found, exact) >= 0.95
    none = G.graph_search(g, q, 5, allowed=few.limit(0))
    assert none.count() == 0


def test_small_parts(spark, tmp_path):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "chunk_id long, embedding array<float>")
    G.build_graph(v, str(tmp_path / "g"))
    q = v.select(F.col("chunk_id").alias("query_id"), "embedding")
    found = G.graph_search(G.load_graph(spark, str(tmp_path / "g")), q, 5)
    assert found.count() == 9 and found.where("rank = 1 and chunk_id = query_id").count() == 3


def test_filter_widens_the_beam(made):
    v, g, q = made
    part = v.where("chunk_id % 5 = 0").select("chunk_id")
    exact = D.cosine_exact(v.join(part, "chunk_id"), q, 20)
    found = G.graph_search(g, q, 20, ef=32, allowed=part)
    assert found.groupBy("query_id").count().where("count = 20").count() == q.count() and recall(found, exact) >= 0.95
    one, two = (G.graph_search(g, q, 20, ef=32, allowed=a, counts=True).agg(F.avg("distances")).first()[0] for a in (None, part))
    assert one < two < v.count()
