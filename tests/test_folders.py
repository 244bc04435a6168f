"""Streams over tables that are folders of files."""

import __spark_entry__ as entry


def folder_tables(spark, tmp_path, texts):
    rows = [(i, text, "en") for i, text in enumerate(texts)]
    (spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
     .write.parquet(str(tmp_path / "documents.parquet")))
    return str(tmp_path)


def test_ingest_of_a_folder(spark, tmp_path):
    path = folder_tables(spark, tmp_path, ["one two three", "four five", "one two three"])
    got = entry.queries()["j01_stream_ingest"](spark, path).collect()
    assert sorted((r["doc_id"], r["status"]) for r in got) == [(0, "failed"), (1, "failed")]


def test_candidates_of_a_folder_are_ngrams_alone(spark, tmp_path):
    path = folder_tables(spark, tmp_path, ["gate gate gate", "release aka freeze"])
    got = entry.queries()["j06_stream_candidates"](spark, path).collect()
    assert [(r["document_id"], r["term_normalized"]) for r in got] == [(0, "gate")]
