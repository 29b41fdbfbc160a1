"""What queries move, compute and hold grows with their tables and no faster."""

import re

import numpy as np
from pyspark.sql import functions as F

from quillspark.functions import images
from quillspark.operators import dedup
from quillspark.plans import catalogue
from test_whole_tables import SF_DIR, assert_equal


def rows_moved(spark, df) -> int:
    """Rows that the stages of one run write for a shuffle."""
    context = spark.sparkContext
    context.setJobGroup(name := f"moved-{id(df)}", name)
    df.write.format("noop").mode("overwrite").save()
    context.setLocalProperty("spark.jobGroup.id", None)
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = {k for job in context.statusTracker().getJobIdsForGroup(name) for k in context.statusTracker().getJobInfo(job).stageIds}
    store = context._jsc.sc().statusStore()
    return sum(store.lastStageAttempt(k).shuffleWriteRecords() for k in stages)


def test_similar_vectors_move_by_their_number_and_not_by_their_pairs(spark):
    r = np.random.default_rng(5)
    x = r.standard_normal(32) + 0.15 * r.standard_normal((700, 32))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -1)
    assert (s >= 0.92).sum() > 400000
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id int, vector array<double>")
    nearest = dedup.nearest_vector(df)
    assert {r.id: r.match_id for r in nearest.collect()} == dict(enumerate(s.argmax(axis=1).tolist()))
    assert rows_moved(spark, nearest) < 700 * 120


def test_vectors_with_ids_of_any_kind_and_equal_similarities(spark):
    x = [[1.0, 0.0, 0.0], [2.0, 0.0, 0.0], [4.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 0.0], [4.0, 0.0, 0.0]]
    df = spark.createDataFrame([(f"v{k}", v) for k, v in enumerate(x)], "id string, vector array<double>").repartition(3)
    found = {r.id: (r.match_id, r.similarity) for r in dedup.nearest_vector(df).collect() if r.id != "v4"}
    assert found == {"v0": ("v1", 1.0), "v1": ("v0", 1.0), "v2": ("v0", 1.0), "v5": ("v0", 1.0)}


def test_recall_of_pieces_at_the_threshold():
    """Pairs at the threshold share a piece as often as promised, and more vectors of a usual number need no more pieces."""
    r, n, count = np.random.default_rng(6), 4000, dedup.piece_count(14, 0.92)
    a = r.standard_normal((n, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.standard_normal((n, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.92 * a + np.sqrt(1 - 0.92**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    met = np.zeros(n, bool)
    for _ in range(count):
        planes = [r.standard_normal((64, c)) for c in dedup.cells(14)]
        met |= np.all([dedup._strongest(a @ p) == dedup._strongest(b @ p) for p in planes], axis=0)
    assert met.mean() >= 0.9975
    assert dedup.piece_bits(20_000) == dedup.piece_bits(1_000_000) == 14


def test_a_role_reads_a_url_once_and_not_for_each_marker(spark):
    df = spark.createDataFrame([("https://x.com/a-96x96.jpg?w=1", None, None, None)], "u string, a string, w int, h int").select(images.role(F.col("u"), F.col("a"), F.col("w"), F.col("h")).alias("r"))
    plan = df._jdf.queryExecution().analyzed().toString().lower()
    # what stands in a lambda over markers runs for each of them: there, only bound values
    assert plan.count("contains(") == plan.count("contains(lambda") > 0


def test_roles_by_each_sign(spark):
    rows = {
        ("https://secure.gravatar.com/x", None, None, None): "avatar", ("https://a.com/p.jpg", " Headshot ", 900, 600): "avatar", ("https://a.com/p.jpg", None, 300, 310): "avatar", ("https://a.com/p-100x100.jpg", None, 0, 5): "avatar",
        ("https://a.com/p.jpg?x=BANNER", None, 900, 600): "promo", ("https://a.com/p.jpg", "the icon", 900, 600): "chrome", ("https://a.com/p.jpg", None, 900, 2): "pixel",
        ("https://a.com/p.jpg", None, None, None): "content", (None, None, None, None): "content", ("not a url^ logo", None, None, None): "chrome",
    }
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, u string, a string, w int, h int")
    found = df.select("k", images.role(F.col("u"), F.col("a"), F.col("w"), F.col("h")).alias("r")).orderBy("k").collect()
    assert [r.r for r in found] == list(rows.values())


def test_articles_are_dealt_once_into_partitions_whose_size_does_not_grow(spark):
    least = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        plan = catalogue.queries()["rendition_groups"](spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", least)
    # 10.8 MB of line items, 4 MB a partition
    assert re.findall(r"Exchange (\w+)\(\w+#\d+L?, (\d+)\)", plan) == [("hashpartitioning", "2")]
    held = re.search(r"MapInArrow fold\(([^)]*)\)", plan)[1]
    assert re.findall(r"(\w+)#", held) == ["news_id", "asset_id", "rank", "keys"]


def test_rendition_groups_equal_their_sql(spark):
    assert_equal(catalogue.queries()["rendition_groups"](spark, SF_DIR), catalogue.oracle_sql()["rendition_groups"])
