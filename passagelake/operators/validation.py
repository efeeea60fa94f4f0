"""Message bodies to typed rows: defaults, normalisation and schema checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from passagelake.functions.ids import normalize_doc_id
from passagelake.functions.text import strip

# The reasons written on dead letters.
INVALID_JSON = "Invalid JSON"
SCHEMA_FAILED = "Schema validation failed"


def _body(value: Column) -> Column:
    """Parsed message; an empty body counts as an empty object, bad JSON is null."""
    return F.try_parse_json(F.when(value == "", "{}").otherwise(value))


def _fields(messages: DataFrame, names: list[str]) -> DataFrame:
    """Per named field a struct (kind, text); ``_body`` stays for the rest.

    kind is the JSON type: STRING, BIGINT, DOUBLE, DECIMAL(..), VOID for null, and
    so on; both are null where the field is absent.
    """
    parsed = messages.select("value", _body(F.col("value")).alias("_body"))
    item = parsed.select(
        "*", *[F.try_variant_get("_body", f"$.{n}", "variant").alias(f"_{n}") for n in names]
    )
    return item.select(
        "value",
        "_body",
        *[
            F.struct(
                F.schema_of_variant(F.col(f"_{n}")).alias("kind"),
                F.try_variant_get(F.col(f"_{n}"), "$", "string").alias("text"),
            ).alias(f"_{n}")
            for n in names
        ],
    )


def _is_number(field: Column) -> Column:
    kind = field["kind"]
    return kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")


def _integer_text(field: Column, whole: bool) -> Column:
    """Digits of a number's integer part, toward zero, however large; with ``whole`` only if it has no fraction.

    Numbers too large even for 38 digits give null: they cannot be told apart.
    """
    text = field["text"]
    plain = F.when(text.rlike(r"^-?[0-9]+$"), text)
    exact = F.coalesce(
        text.try_cast("decimal(38,10)").cast("string"), text.try_cast("double").try_cast("decimal(38,0)").cast("string")
    )
    part = F.regexp_extract(exact, r"^-?[0-9]+", 0)
    if whole:
        part = F.when(~exact.rlike(r"\.0*[1-9]"), part)
    return F.coalesce(plain, F.when(part == "-0", "0").otherwise(part))


def _truncated(field: Column) -> Column:
    """Integer part of a number as text."""
    return _integer_text(field, whole=False)


def _whole(field: Column) -> Column:
    """Text of the integer of a field given as a whole number or as digits, else null."""
    digits = strip(field["text"])
    return F.when(_is_number(field), _integer_text(field, whole=True)).when(
        (field["kind"] == "STRING") & digits.rlike(r"^[+-]?[0-9]+$"), digits
    )


def _identifier(field: Column) -> Column:
    """Text of an id given as a string or a whole number, else null."""
    return F.when(field["kind"] == "STRING", field["text"]).when(_is_number(field), _whole(field))


REQUIRED = ["chunk", "chunk_id", "doc_id", "chunk_len", "embedding"]


def validate_embedded(messages: DataFrame) -> DataFrame:
    """Check embedded chunks: the five fields, ``value`` and ``reason``.

    ``reason`` is null for good rows. All five fields are required; chunk must be
    text, the ids text or whole numbers, chunk_len a whole number, embedding a
    list of numbers. The counts are observed as ``index_run``.
    """
    parsed = _fields(messages, ["chunk", "chunk_id", "doc_id", "chunk_len"])
    body, chunk = F.col("_body"), F.col("_chunk")
    vector = F.try_variant_get(body, "$.embedding", "array<double>")
    typed = parsed.select(
        "value",
        (body.isNull() | F.is_variant_null(body)).alias("_broken"),
        F.when(chunk["kind"] == "STRING", chunk["text"]).alias("chunk"),
        _identifier(F.col("_chunk_id")).alias("chunk_id"),
        _identifier(F.col("_doc_id")).alias("doc_id"),
        _whole(F.col("_chunk_len")).try_cast("int").alias("chunk_len"),
        vector.cast("array<float>").alias("embedding"),
    )
    # A number may be finite as read and infinite as a 32-bit float.
    incomplete = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    for name in REQUIRED:
        incomplete = incomplete | F.col(name).isNull()
    reason = F.when(F.col("_broken"), INVALID_JSON).when(incomplete, SCHEMA_FAILED)
    checked = typed.select("value", *REQUIRED, reason.alias("reason"))
    # Besides counting, observing keeps a later filter on ``reason`` from being
    # pushed below, where every message would be parsed twice.
    return checked.observe(
        "index_run",
        F.count_if(F.col("reason").isNull()).alias("accepted"),
        F.count("reason").alias("dead_lettered"),
    )


def prepare_for_embedding(messages: DataFrame, normalize_numeric_ids: bool = True) -> DataFrame:
    """Apply the embed stage's defaults: chunk, chunk_id, doc_id, chunk_len, flags, reason.

    Text is the first non-empty of chunk and text; the id is chunk_id or else id;
    chunk_len defaults to the text's length. ``has_text`` and ``has_ids`` tell
    which rows are embedded and published; the others are dropped, not rejected.
    Rejected are a length that is no 32-bit integer, and a chunk_id or id that is a
    number with a fraction: cutting it would make one id of two. The counts are observed as ``embed_run``.
    """
    names = ["chunk", "text", "chunk_id", "id", "doc_id", "chunk_len"]
    parsed = _fields(messages, names)
    body = F.col("_body")

    def text(field):
        return F.when((field["kind"] == "STRING") & (field["text"] != ""), field["text"])

    def id_text(field):
        return F.when(field["kind"] == "STRING", field["text"]).when(
            _is_number(field), _truncated(field).cast("string")
        )

    def fractional(field):
        return F.coalesce(_is_number(field) & _whole(field).isNull(), F.lit(False))

    first_id, size = F.col("_chunk_id"), F.col("_chunk_len")
    empty_id = (first_id["text"] == "") | (
        _is_number(first_id) & (first_id["text"].try_cast("double") == 0)
    )
    doc_id = id_text(F.col("_doc_id"))
    typed = parsed.select(
        "value",
        (body.isNull() | F.is_variant_null(body)).alias("_broken"),
        F.try_variant_get(body, "$", "map<string,variant>").isNotNull().alias("_object"),
        F.coalesce(text(F.col("_chunk")), text(F.col("_text"))).alias("chunk"),
        F.coalesce(F.when(~empty_id, _identifier(first_id)), _identifier(F.col("_id"))).alias("chunk_id"),
        (fractional(first_id) | fractional(F.col("_id"))).alias("_bad_id"),
        (normalize_doc_id(doc_id) if normalize_numeric_ids else doc_id).alias("doc_id"),
        F.when(_is_number(size), _truncated(size))
        .when(size["kind"] == "STRING", strip(size["text"]))
        .try_cast("int")
        .alias("_size"),
        ((size["kind"] != "VOID") & (size["text"] != "")).alias("_sized"),
    )
    bad_size = F.coalesce(F.col("_sized"), F.lit(False)) & F.col("_size").isNull()
    reason = F.when(F.col("_broken"), INVALID_JSON).when(
        ~F.col("_object") | bad_size | F.col("_bad_id"), SCHEMA_FAILED
    )
    judged = typed.withColumn("reason", reason).withColumn(
        "has_text", F.col("reason").isNull() & F.col("chunk").isNotNull()
    )
    prepared = judged.select(
        "value",
        "chunk",
        "chunk_id",
        "doc_id",
        F.coalesce(F.nullif("_size", F.lit(0)), F.length("chunk")).alias("chunk_len"),
        "has_text",
        (F.col("has_text") & F.col("chunk_id").isNotNull() & F.col("doc_id").isNotNull()).alias(
            "has_ids"
        ),
        "reason",
    )
    return prepared.observe(
        "embed_run",
        F.count_if("has_text").alias("processed"),
        F.count_if("has_ids").alias("chunks_count"),
        F.count("reason").alias("dead_lettered"),
    )


def dead_letters(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reason").isNotNull()).select("value", "reason")


def embed_run_counters(prepared: DataFrame) -> DataFrame:
    """processed counts messages with text; chunks_count those that also had ids."""
    return prepared.agg(
        F.lit("completed").alias("status"),
        F.count_if("has_text").alias("processed"),
        F.count_if("has_ids").alias("chunks_count"),
        F.count_if(F.col("reason").isNotNull()).alias("dead_lettered"),
    )
