from datetime import datetime

import pytest

from passagelake.operators.prompts import (
    FALLBACK_ANSWER,
    NO_ANSWER,
    build_prompts,
    clean_queries,
    generate_answers,
    with_fallback,
)
from passagelake.operators.reports import (
    chunk_counts,
    embedding_preview,
    RunRecord,
    run_report,
)
from passagelake.session import recommended_settings


def test_prompts_answers_and_fallback(spark):
    queries = spark.createDataFrame(
        [(1, "  what? "), (2, " \n\t"), (3, "and?"), (4, "x"), (5, "y")], "query_id int, text string"
    )
    kept = clean_queries(queries)
    assert {r.query_id: r.text for r in kept.collect()} == {1: "what?", 3: "and?", 4: "x", 5: "y"}
    results = spark.createDataFrame(
        [(1, 2, "second"), (1, 1, "first"), (4, 1, "only"), (1, 10, "tenth")],
        "query_id int, rank int, text string",
    )
    prompts = {r.query_id: r for r in build_prompts(kept, results).collect()}
    assert "\nContext:\nSource 1: first\n\nSource 2: second\n\nSource 3: tenth\n\nQuery:\nwhat?\n\n\n" in prompts[1].prompt
    assert prompts[1].sources == ["first", "second", "tenth"]
    assert "\nContext:\n\n\nQuery:\nand?" in prompts[3].prompt and prompts[3].sources == []
    assert prompts[1].prompt.startswith("\nYou are given a context passage")
    asked = build_prompts(kept.where("query_id <> 5"), results)
    answers = generate_answers(asked, lambda batch: [None if "x\n" in p else p[-6:].strip() for p in batch])
    found = {r.query_id: r for r in with_fallback(kept, answers).collect()}
    assert found[5].final_answer == FALLBACK_ANSWER and len(found[5].results) == 1
    assert found[4].final_answer == NO_ANSWER and found[4].results == ["only"]
    assert found[3].final_answer == "nd?" and found[3].results == []


def test_reports(spark):
    chunks = spark.createDataFrame([("f",), ("f",), ("g",)], "source_file string")
    assert {r.source_file: r.chunks for r in chunk_counts(chunks).collect()} == {"f": 2, "g": 1, None: 3}
    start, end = datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 9)
    row = run_report(spark, "completed", start, end, chunks).first()
    assert (row.is_running, row.total_chunks, row.duration_seconds) == (False, 3, 9.0)
    running = run_report(spark, "failed", start, error_message="why").first()
    assert running.is_running and running.duration_seconds is None and running.error_message == "why"


def test_settings_grow_with_the_input():
    small, large = recommended_settings(10**9, 8), recommended_settings(10**14, 4000)
    assert small["spark.sql.shuffle.partitions"] == "16"
    assert int(large["spark.sql.shuffle.partitions"]) == 200_000


def test_embedding_preview(spark):
    rows = spark.createDataFrame(
        [(f"c{i:02d}", "d", [1.0] * 4) for i in range(60)], "chunk_id string, doc_id string, embedding array<float>"
    )
    shown = embedding_preview(rows).collect()
    assert len(shown) == 50 and tuple(shown[0]) == ("c00", "d", 4)


def test_runs_are_recorded(spark, tmp_path):
    folder = str(tmp_path / "runs")
    with RunRecord(spark, folder, "chunking") as run:
        assert RunRecord.report(spark, folder).first().is_running
        run.chunks = 7
    with pytest.raises(ZeroDivisionError):
        with RunRecord(spark, folder, "embedding"):
            1 / 0
    rows = {r.job: r for r in RunRecord.report(spark, folder).collect()}
    assert (rows["chunking"].status, rows["chunking"].total_chunks) == ("completed", 7)
    assert rows["chunking"].duration_seconds >= 0 and not rows["chunking"].is_running
    assert (rows["embedding"].status, rows["embedding"].error_message) == (
        "failed",
        "ZeroDivisionError: division by zero",
    )
