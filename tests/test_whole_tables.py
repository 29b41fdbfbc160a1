"""Registered queries take whole tables."""

import hashlib
import os
import random

import pytest

from quillspark.operators import dedup
from quillspark.plans import catalogue

SF_DIR = "/root/testdata/sf0.001"


def by_sql(sql: str, sf_dir: str = SF_DIR) -> tuple[list[str], list[tuple]]:
    import glob

    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    found = con.sql(sql)
    return found.columns, found.fetchall()


def assert_equal(df, sql: str) -> None:
    columns, rows = by_sql(sql)
    order = [columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=str) == sorted((tuple(r[k] for k in order) for r in rows), key=str)


def test_nearest_hash_against_all_pairs(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(4)]
    rows = [(k % 70, rng.choice(["image", "gif"]), f"{rng.choice(base) ^ sum(1 << rng.randrange(64) for _ in range(rng.choice([0, 0, 1, 5, 9]))) & (2**64 - 1):016x}") for k in range(90)]
    best: dict = {}
    for i, kind, a in rows:
        for j, other, b in rows:
            distance = (int(a, 16) ^ int(b, 16)).bit_count()
            if i != j and kind == other and distance <= 8:
                best[i] = min(best.get(i, (99, 0)), (distance, j))
    df = spark.createDataFrame(rows, "id int, kind string, hash string")
    assert {r.id: (r.distance, r.match_id) for r in dedup.nearest_hash(df, df).collect()} == best


def test_equal_hashes_do_not_pair(spark):
    """10000 equal hashes are one representative: the row that has two ids to choose from is the one that changes."""
    df = spark.range(10000).selectExpr("id", "'image' as kind", "'30525656c4cc0e1e' as hash")
    found = dedup.nearest_hash(df, df)
    assert found.where("match_id = 0 and distance = 0").count() == 9999 and found.where("id = 0 and match_id = 1").count() == 1


def test_hamming_dedup_searches_all_rows(spark):
    found = {r.id: (r.distance, r.match_id) for r in catalogue.queries()["hamming_dedup_l3"](spark, SF_DIR).collect()}
    sha = lambda x: hashlib.sha256(str(x).encode()).hexdigest()
    rows = [(r.vec_id, r.label, int(sha(r.label)[:14] + sha(r.vec_id)[:2], 16)) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "label").collect()]
    best: dict = {}
    for i, kind, a in rows:
        for j, other, b in rows:
            if i != j and kind == other and (a ^ b).bit_count() <= 8:
                best[i] = min(best.get(i, (99, 0)), ((a ^ b).bit_count(), j))
    assert found == best and max(found) >= 400


def test_media_pool_takes_all_line_items(spark):
    sql = """select news_id, asset_id, min(origin) as origin from (select l_orderkey as news_id, l_partkey as asset_id, 0 as origin from lineitem
        union all select l_orderkey, l_suppkey, 1 from lineitem) group by 1, 2"""
    assert_equal(catalogue.queries()["media_pool"](spark, SF_DIR), sql)


def test_rendition_groups_take_all_articles(spark, tmp_path):
    some = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").where("l_orderkey < 40")
    some.unionByName(some.withColumn("l_orderkey", some.l_orderkey + 5000)).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = catalogue.queries()["rendition_groups"](spark, str(tmp_path)).collect()
    lines = spark.read.parquet(f"{tmp_path}/lineitem.parquet").select("l_orderkey", "l_partkey").distinct().collect()
    assert sorted((r.news_id, r.asset_id) for r in found) == sorted(map(tuple, lines))
    numbers: dict = {}
    for r in sorted(found, key=lambda r: (r.news_id, r.rank)):
        own = numbers.setdefault(r.news_id, {})
        assert r.picture == own.setdefault(r.asset_id % 4, len(own))


def test_token_overlap_takes_all_items(spark, tmp_path):
    spark.createDataFrame([(k, f"word{k} some text") for k in range(400)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, f"word{k} of item") for k in (*range(45), 77, 1000)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = catalogue.queries()["token_overlap"](spark, str(tmp_path)).collect()
    ids = [*range(45), 77, 1000]
    assert sorted((r.doc_id, r.item_id) for r in found) == [(k, ids[k % 47]) for k in range(400)]


def test_token_overlap_equals_its_sql_on_forty_items(spark):
    assert_equal(catalogue.queries()["token_overlap"](spark, SF_DIR), catalogue.oracle_sql()["token_overlap"])


def test_hashtags_and_escapes_take_whole_texts(spark, tmp_path):
    tags = "a b, c d -- e f g One one Two three four five"
    html = "<!DOCTYPE html><html><p>Salt & pepper > <b>none</b></p>"
    spark.createDataFrame([(1, tags)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, html), (3, html)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [r.hashtags for r in catalogue.queries()["hashtag"](spark, str(tmp_path)).collect()] == ["#one #two #three #four"]
    escaped = html.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    assert {r.page_id: r["head"] for r in catalogue.queries()["storage_keys"](spark, str(tmp_path)).collect()} == {1: escaped, 3: html}
