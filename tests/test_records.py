"""JSON records and extension points."""

from pyspark.sql import functions as F

from quillspark.functions import records
from quillspark.operators import extensions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_rules(spark):
    rules = F.lit('{"max_images": 2, "prefer_video": false, "max_publish_interval_minutes": 120}')
    assert [one(spark, records.rule(rules, n)) for n in ("max_images", "prefer_video", "min_quality_score")] == [2, False, 0.35]
    assert '"max_publish_interval_minutes": 30}' in one(spark, records.with_rule(rules, "max_publish_interval_minutes", 120, 30))
    assert one(spark, records.rule(F.lit(None).cast("string"), "max_images")) == 4


def test_replies(spark):
    assert tuple(one(spark, records.analysis(F.lit('{"is_ai_related": true, "title": " T ", "score": 140}')))) == (True, "T", None, 100)
    assert tuple(one(spark, records.analysis(F.lit("broken")))) == (False, None, None, 0)
    assert tuple(one(spark, records.ranking(F.lit('{"ranked": [1, 0], "redundant": [[0, 1]]}'), F.lit(2)))) == ([1, 0], [[0, 1]])
    for bad in ('{"ranked": [2]}', '{"ranked": [0, 0]}', '{"ranked": [0], "redundant": [[1]]}', "x"):
        assert one(spark, records.ranking(F.lit(bad), F.lit(2))) is None
    assert one(spark, records.ranking(F.lit('{"ranked": []}'), F.lit(2))).ranked == []


def test_payload(spark):
    payload = '{"images": ["https://a.com/1.jpg", {"url": "https://a.com/2.jpg"}], "image": "https://a.com/3.jpg", "media": "no list"}'
    assert [tuple(m) for m in one(spark, records.payload_media(F.lit(payload)))] == [("https://a.com/1.jpg", False), ("https://a.com/2.jpg", False), ("https://a.com/3.jpg", True)]


def test_registry_and_fallback(spark):
    known = extensions.Registry()
    known.add("even", lambda x: x % 2 == 0, lambda x: x // 2)
    known.add("broken", lambda x: True, lambda x: 1 // 0)
    known.add("all", lambda x: True, lambda x: -x)
    assert known.first(4)(4) == 2 and known.all(3) == [("all", -3)]
    assert extensions.with_fallback(lambda x: 1 // 0, lambda x: x)(5) == 5
    assert extensions.with_fallback(lambda x: x + 1, lambda x: x, enabled=lambda: False)(5) == 5
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, prompt string")
    assert {(r.id, r.reply) for r in extensions.ask(rows, lambda p: p.upper() if p == "a" else 1 // 0).collect()} == {(1, "A"), (2, None)}
