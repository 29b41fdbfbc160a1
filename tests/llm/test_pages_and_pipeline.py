"""Page extraction and the pipeline."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import decontaminate, neardup, pagetext, secrets
from quillspark.llm.shared import Workspace


@pytest.fixture(scope="module")
def field():
    return pagetext.default_field()


def test_held_out_pages(field):
    pages = pagetext.labelled_pages(150, seed=12345)
    assert sum(pagetext.main_text(p, field) == t for p, t in pages) >= 0.85 * len(pages)


def test_pages_of_the_table(spark, field):
    import html
    import re

    for page in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        inside = page.html.split("<article>", 1)[1].split("</article>")[0]
        expected = " ".join(html.unescape(re.sub(r"<(?!/?b>)[^>]*>", " ", inside).replace("<b>", "").replace("</b>", "")).split())
        assert pagetext.main_text(page.html, field) == expected


def test_edge_pages(spark, field):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<p"), (4, "u", "<nav>a</nav>"), (5, "u", "<article><p>One &amp; two <b>th</b>ree.<br>Four five six.<p>Seven eight nine ten.</article><script>x</p></script>"), (5, "u", "<!-- a")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    found = pagetext.extract(pages, field).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    texts = {r.text for r in found if r.page_id == 5}
    assert texts == {"One & two three. Four five six. Seven eight nine ten.", ""}
    assert {r.text for r in found if r.page_id < 5} == {""}
    assert pagetext.extract(pages.limit(0), field).count() == 0


FIRST, LAST = "The first paragraph of this article is long enough to be text.", "The last paragraph of this article must not get lost either."


@pytest.mark.parametrize(
    "inner",
    [
        "<style-guide>{x}</style-guide>",
        "<title-bar>{x}</title-bar>",
        "<object-view>{x}</object-view>",
        "<select-menu>{x}</select-menu>",
        "<template-card>{x}</template-card>",
        "<svg/>{x}",
        '<iframe src="/a"/>{x}',
        "<textarea>{x}",
        '<svg aria-label="a > b" />{x}',
        "<SELECT><option>one</option></SELECT >{x}",
        "<script src='a.js'/>{x}<script>var x = 1;</script>",
        "<style>p > a {{}}</style>{x}",
        "<object data='a'><param name='b'></object>{x}",
    ],
)
def test_no_element_takes_the_rest_of_a_page(field, inner):
    paragraph = "<p>A paragraph in the middle, which says a little more than the others do.</p>"
    page = f"<html><head><title>T</title></head><body><nav><a href='/'>Home</a></nav><article><p>{FIRST}</p>{inner.format(x=paragraph)}<p>{LAST}</p></article></body></html>"
    assert pagetext.main_text(page, field) == f"{FIRST} {paragraph[3:-4]} {LAST}"


def test_unclosed_scripts_run_to_the_end(field):
    assert pagetext.main_text(f"<article><p>{FIRST}</p><p>{LAST}</p></article><script>var a = '<p>{FIRST}</p>'", field) == f"{FIRST} {LAST}"


def test_long_and_repeated_pages(spark, field):
    page = "<article>" + f"<p>{FIRST} {LAST}</p>" * 4000 + "</article>" + "<select>" * 2000
    rows = [(1, "u", page), (1, "u", page)]
    found = pagetext.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), field).collect()
    assert [r.text for r in found] == [" ".join([FIRST, LAST] * 4000)] * 2


def test_viterbi_is_the_best_labelling(field):
    import itertools

    page = pagetext.features(pagetext.blocks(pagetext.labelled_pages(1, seed=5)[0][0]))[:9]
    gains = [sum(field.gain.get(x, 0.0) for x in f) for f in page]

    def score(labels):
        return sum(g * y for g, y in zip(gains, labels, strict=True)) + sum(field.transitions[a][b] for a, b in itertools.pairwise(labels))

    assert score(field.decode(page)) == pytest.approx(max(map(score, itertools.product((0, 1), repeat=len(page)))))


def test_pipeline_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(-1, None, "en", "s", 0), (-2, "12 34", "en", "s", 5), (-3, "", None, None, None), (None, "a text without an id", None, None, 1)]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    space, now = Workspace(spark, "test"), docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = space.save(stage(spark, now, sf_dir), f"s{k}")
        if k < 4:
            assert out.columns == docs.columns
        if k == 0:
            assert {r.doc_id for r in now.join(out, "doc_id", "left_anti").collect()} >= {-1, -2, -3}
        if k == 1:
            kept = {r.doc_id for r in neardup.groups(now).where("kept").collect()}
            assert {r.doc_id for r in out.collect()} == kept
        if k == 2:
            bad = {r.doc_id for r in decontaminate.scan(now, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_items > 0").collect()}
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in now.collect()} - bad
        if k == 3:
            assert out.count() == now.count() and secrets.scan(out).where("secret").count() == 0
        if k == 4:
            assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in now.collect()}
        now = out
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_one_passage_of_one_item_is_enough(spark, tmp_path):
    """Counted by hand: an eight-word passage goes, seven words stay, one short item stays, two go."""
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa"
    spark.createDataFrame([(1, item), (2, "rare phrase"), (3, "other phrase"), (4, None), (None, "plain words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = {
        1: "before ALPHA, beta gamma delta epsilon zeta eta theta after",
        2: "beta gamma delta epsilon zeta eta theta",
        3: "a rare phrase alone",
        4: "a rare phrase and an other phrase",
        5: None,
        6: "",
        7: "plain words",
        8: "x " * 50000 + item + " y" * 50000,
    }
    rows = [(k, t, "en", "s", 1) for k, t in texts.items()]
    docs = spark.createDataFrame([*rows, rows[0], rows[1]], "doc_id long, text string, lang string, source string, n_chars long").withColumn("items0", F.lit(1))
    out = corpus_pipeline.drop_benchmark_passages(spark, docs, str(tmp_path))
    assert out.columns == docs.columns[:-1]
    assert sorted(r.doc_id for r in out.collect()) == [2, 2, 3, 5, 6, 7]
    for block in (10**6, 12):
        kept = decontaminate.leave_out(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet"), block)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 2, 3, 5, 6, 7]
    assert decontaminate.leave_out(docs.limit(0), spark.read.parquet(f"{tmp_path}/benchmark.parquet")).count() == 0


def test_one_of_each_group_stays(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(7, a, "x"), (7, a + " z", "x"), (7, b, "x"), (8, b, "x"), (9, b + " y", "x"), (7, b, "w"), (10, None, "x"), (10, None, "x"), (11, "", "x"), (None, a, "x"), (12, "alone and apart from all others", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string").withColumn("first", F.lit(0)).withColumn("n", F.lit(1))
    for order in (docs, docs.orderBy(F.desc("text"), "found")):
        kept = neardup.keep_one(order)
        assert kept.columns == docs.columns
        found = sorted(((r.doc_id, r.text, r.found) for r in kept.collect()), key=str)
        mine = [x for x in found if x[0] == 7 and x[1] != b]
        assert len(mine) == 1 and sorted([x for x in found if x not in mine], key=str) == sorted([(7, b, "w"), (10, None, "x"), (10, None, "x"), (11, "", "x"), (None, a, "x"), (12, rows[-1][1], "x")], key=str)
    assert neardup.keep_one(docs.limit(0)).count() == 0


def written_to_shuffles(spark, run) -> int:
    """Bytes that the jobs of a call write to shuffles."""
    sc = spark.sparkContext
    sc.setJobGroup("measured", "measured")
    run()
    sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = {s for j in sc.statusTracker().getJobIdsForGroup("measured") for s in sc.statusTracker().getJobInfo(j).stageIds}
    return sum(sc._jsc.sc().statusStore().lastStageAttempt(s).shuffleWriteBytes() for s in stages)


def test_texts_that_stay_do_not_move(spark, monkeypatch):
    """300 texts of random words of which 20 have a near copy: no join may move them all, however many go."""
    import random

    rng = random.Random(3)
    texts = [" ".join(f"{rng.getrandbits(48):x}" for _ in range(200)) for _ in range(300)]
    rows = [*enumerate(texts), *((1000 + k, f"{texts[k]} more") for k in range(20)), (2000, None), (None, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = neardup.keep_one(docs)
        assert written_to_shuffles(spark, lambda: kept.write.format("noop").mode("overwrite").save()) < 0.3 * sum(map(len, texts))
        expected = sorted([*enumerate(texts), (2000, None), (None, texts[0])], key=str)
        assert sorted(map(tuple, kept.collect()), key=str) == expected
        for most in (1, 64):  # a map that is too small, where most rows may be marked
            monkeypatch.setattr(neardup, "MOST_BITS", most)
            twice = docs.unionByName(docs.where("doc_id in (0, 5, 1005)"))
            assert sorted(map(tuple, neardup.keep_one(twice).collect()), key=str) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_pipeline_on_edge_tables(spark, tmp_path):
    """Nulls, repeated rows, a very long text, columns with the stages' own names; and no rows at all."""
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).withColumn("lang_pred", F.lit("x")).withColumn("secret", F.lit(1)).write.parquet(f"{tmp_path}/some")
    some = spark.read.parquet(f"{tmp_path}/some")
    first = some.first()
    long = some.limit(1).withColumn("doc_id", F.lit(-5)).withColumn("text", F.repeat(F.lit("some words of prose, "), 50_000))
    rows = some.unionByName(some.where(F.col("doc_id") == first.doc_id)).unionByName(long).unionByName(some.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(-6)))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len({r.doc_id for r in packed}) > 10 and -5 in {r.doc_id for r in packed} and -6 not in {r.doc_id for r in packed}
    assert all(sum(r.length for r in packed if r.doc_id == d) == next(r.doc_tokens for r in packed if r.doc_id == d) for d in {r.doc_id for r in packed})
    rows.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
