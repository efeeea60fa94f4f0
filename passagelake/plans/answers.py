"""Queries from search results to prompts, answers and reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from passagelake.operators.prompts import (
    CONTEXT_HEADING,
    ENDING,
    FALLBACK_ANSWER,
    FALLBACK_RESULT,
    INSTRUCTIONS,
    QUERY_HEADING,
    build_prompts,
    clean_queries as clean,
    generate_answers,
    with_fallback,
)
from passagelake.operators.reports import RunRecord
from passagelake.operators.search import search_responses as respond
from passagelake.plans.catalog import query, table
from passagelake.plans.passages import DOCUMENTS_SQL, LINES, chunk_sql, document_chunks
from passagelake.plans.stored import SEARCH_SQL, benchmark_queries, search_benchmark
from passagelake.session import scratch_folder


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


CONTEXT_SQL = """context AS (SELECT query_id, string_agg('Source ' || rank || ': ' || text,
      chr(10) || chr(10) ORDER BY rank) AS context, CAST(count(*) AS BIGINT) AS sources,
      max(score) AS top FROM results GROUP BY query_id)"""


@query(f"""{SEARCH_SQL}, {CONTEXT_SQL}
    SELECT item_id AS query_id, {_literal(INSTRUCTIONS + CONTEXT_HEADING)} || coalesce(context, '')
      || {_literal(QUERY_HEADING)} || b.text || {_literal(ENDING)} AS prompt,
      coalesce(sources, 0) AS sources
    FROM benchmark b LEFT JOIN context ON item_id = query_id""")
def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = clean(benchmark_queries(spark, sf_dir))
    prompts = build_prompts(asked, search_benchmark(spark, sf_dir))
    return prompts.select(
        "query_id", "prompt", F.size("sources").cast("bigint").alias("sources")
    )


def _first_source(prompts: list[str]) -> list[str]:
    """Stands for a language model: answers with the first words of the first source."""
    return [p.split("Source 1: ", 1)[1][:40] if "Source 1: " in p else "I don't know." for p in prompts]


@query(f"""{SEARCH_SQL}, {CONTEXT_SQL}
    SELECT item_id AS query_id, CASE WHEN top >= 0.8 THEN substring(context, 11, 40)
        ELSE {_literal(FALLBACK_ANSWER)} END AS final_answer,
      CAST(CASE WHEN top >= 0.8 THEN sources ELSE 1 END AS BIGINT) AS results
    FROM benchmark LEFT JOIN context ON item_id = query_id""")
def answers_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries whose best score is under 0.8 stand for those the generator never saw."""
    asked = benchmark_queries(spark, sf_dir)
    results = search_benchmark(spark, sf_dir)
    reached = results.where((F.col("rank") == 1) & (F.round("score", 9) >= 0.8)).select("query_id")
    prompts = build_prompts(asked, results).join(reached, "query_id", "left_semi")
    answers = with_fallback(asked, generate_answers(prompts, _first_source))
    return answers.select(
        "query_id", "final_answer", F.size("results").cast("bigint").alias("results")
    )


@query(f"""{SEARCH_SQL} SELECT query_id, CAST(count(*) AS BIGINT) AS total_candidates,
      string_agg(chunk_id, ',' ORDER BY rank) AS chunk_ids FROM results GROUP BY query_id""")
def search_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = respond(benchmark_queries(spark, sf_dir), search_benchmark(spark, sf_dir))
    return responses.select(
        "query_id",
        F.col("total_candidates").cast("bigint").alias("total_candidates"),
        F.array_join(F.transform("results", lambda r: r["chunk_id"]), ",").alias("chunk_ids"),
    )


# Turns of users are queries; assistants' turns stand for blank input.
@query("""SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM conversations
    WHERE role <> 'assistant' AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def clean_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    typed = F.concat(F.lit(" \t"), F.col("text"), F.lit("\n "))
    text = F.when(F.col("role") == "assistant", " \n ").otherwise(typed)
    return clean(turns.select("conv_id", "turn", text.alias("text")))


@query(f"""WITH {chunk_sql(DOCUMENTS_SQL, LINES)} SELECT false AS is_running, 'completed' AS status,
      CAST(count(*) AS BIGINT) AS total_chunks, CAST(90.0 AS DOUBLE) AS duration_seconds,
      CAST(NULL AS VARCHAR) AS error_message FROM chunks""")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recorded run that chunks the documents, by a clock that stops at 90 seconds."""
    folder = scratch_folder(spark, "runs")
    clock = iter([datetime(2024, 1, 1, 12, 0, 0), datetime(2024, 1, 1, 12, 1, 30)])
    with RunRecord(spark, folder, "chunking", clock=lambda: next(clock)) as run:
        run.chunks = document_chunks(spark, sf_dir).count()
    return RunRecord.report(spark, folder).select(
        "is_running", "status", "total_chunks", "duration_seconds", "error_message"
    )
