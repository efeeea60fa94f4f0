"""From ranked passages to prompts and answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from passagelake.functions.text import WHITESPACE, is_blank

# The prompt's wording and the answer given when generation fails.
INSTRUCTIONS = """
You are given a context passage and a user query. Your task is to answer the query
**strictly and exclusively** using information found in the provided context.

Compliance Requirements:
- Only answer the user’s question **directly**. No introductions, no explanations, no extra sentences.
- If the context contains the answer, provide a concise, precise response drawn solely from the context.
- If the answer is not fully supported by the context, reply exactly with: "I don't know."
- Do NOT infer, assume, or use any outside knowledge.
- Do NOT restate or reference the context, the query, or these rules in the answer.
- Do NOT add formatting, bullet points, reasoning, or commentary.
- Output only the final answer.
"""
CONTEXT_HEADING = "\nContext:\n"
QUERY_HEADING = "\n\nQuery:\n"
ENDING = "\n\n\n"
FALLBACK_ANSWER = (
    "I apologize, but I'm currently unable to connect to the AI service. "
    "Please ensure the backend services are running."
)
NO_ANSWER = "No answer generated."
FALLBACK_RESULT = "Error connecting to LLM service"


def clean_queries(queries: DataFrame, text_col: str = "text") -> DataFrame:
    """Trim the query texts and leave out blank ones."""
    return queries.where(~is_blank(F.col(text_col))).withColumn(
        text_col, F.btrim(text_col, F.lit(WHITESPACE))
    )


def build_prompts(queries: DataFrame, results: DataFrame) -> DataFrame:
    """One prompt per query: query_id, prompt, sources (the texts in rank order).

    A query's results are its top k, so at most k rows are gathered per query. A
    query without results gets an empty context.
    """
    ranked = results.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("_ranked")
    )
    asked = queries.join(ranked, "query_id", "left").withColumn(
        "_ranked", F.coalesce("_ranked", F.array())
    )
    numbered = F.transform(
        "_ranked",
        lambda item, i: F.concat(
            F.lit("Source "), (i + 1).cast("string"), F.lit(": "), item["text"]
        ),
    )
    return asked.select(
        "query_id",
        F.concat(
            F.lit(INSTRUCTIONS + CONTEXT_HEADING),
            F.array_join(numbered, "\n\n"),
            F.lit(QUERY_HEADING),
            F.col("text"),
            F.lit(ENDING),
        ).alias("prompt"),
        F.transform("_ranked", lambda item: item["text"]).alias("sources"),
    )


def generate_answers(
    prompts: DataFrame, generate: Callable[[list[str]], list[str | None]]
) -> DataFrame:
    """Run a caller's text generator over batches of prompts: query_id, final_answer, results."""

    id_type = prompts.schema["query_id"].dataType.simpleString()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = generate(batch.column("prompt").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id"), pa.array(answers, pa.string()), batch.column("sources")],
                names=["query_id", "final_answer", "results"],
            )

    return prompts.select("query_id", "prompt", "sources").mapInArrow(
        answer, f"query_id {id_type}, final_answer string, results array<string>"
    )


def with_fallback(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """Every query with its answer, or the fixed apology where there is none.

    An answer row without text means the generator replied with nothing; no row at
    all means it could not be reached.
    """
    given = answers.select("query_id", "final_answer", "results", F.lit(True).alias("_reached"))
    joined = queries.select("query_id").join(given, "query_id", "left")
    failed = F.col("_reached").isNull()
    return joined.select(
        "query_id",
        F.when(failed, FALLBACK_ANSWER)
        .otherwise(F.coalesce("final_answer", F.lit(NO_ANSWER)))
        .alias("final_answer"),
        F.when(failed, F.array(F.lit(FALLBACK_RESULT)))
        .otherwise(F.coalesce("results", F.array()))
        .alias("results"),
    )
