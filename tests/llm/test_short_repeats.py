"""op5_substring takes out each repeated run of sentences; phrases of fewer sentences stay."""

from quillspark.llm import catalogue


def test_short_repeated_runs_go_and_phrases_stay(spark, tmp_path):
    shared = "One two. Three four, five; six: seven eight nine."
    rows = [
        (1, f"First text alone here. {shared} Its own end."),
        (2, f"Another beginning of it. {shared} Some other end."),
        (3, "Oh yes. Of course. It is new here. And it goes on, as it may."),
        (4, "Oh yes. Of course. And this is other. So are these, which differ."),
    ]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: (r.n_removed, r.text) for r in catalogue.op5_substring(spark, str(tmp_path)).collect()}
    assert found == {1: (0, rows[0][1]), 2: (5, "Another beginning of it. Some other end."), 3: (0, rows[2][1]), 4: (0, rows[3][1])}
