import json

import pytest
from pyspark.sql import functions as F

from passagelake.functions.ids import normalize_doc_id, object_path, preview, shard_name
from passagelake.operators.validation import (
    dead_letters,
    embed_run_counters,
    prepare_for_embedding,
    validate_embedded,
)
from passagelake.sources.topics import (
    CHUNK_FIELDS,
    publish,
    receive,
    to_messages,
    topic_statistics,
    watch,
)

GOOD = {"chunk": "text", "chunk_id": "c", "doc_id": "d", "chunk_len": 4, "embedding": [1, 0.5, 1e-8]}


def messages(spark, bodies):
    texts = [b if isinstance(b, str) else json.dumps(b) for b in bodies]
    return spark.createDataFrame([(t,) for t in texts], "value string")


def without(*names, **changes):
    return {**{k: v for k, v in GOOD.items() if k not in names}, **changes}


BAD = "Schema validation failed"
CASES = [
    (GOOD, None),
    (without(chunk_id=7, doc_id=12), None),
    (without(chunk_len="4"), None),
    (without(chunk_len=4.0), None),
    (without(embedding=["1.5", 2]), None),
    (without(extra={"x": [1]}), None),
    (without("chunk"), BAD),
    (without(chunk=5), BAD),
    (without(chunk=None), BAD),
    (without(chunk_id=None), BAD),
    (without(doc_id=[1]), BAD),
    (without(doc_id=1.5), BAD),
    (without("chunk_len"), BAD),
    (without(chunk_len="many"), BAD),
    (without(chunk_len=4.5), BAD),
    (without(embedding=[1, None]), BAD),
    (without(embedding=["x"]), BAD),
    (without(embedding=None), BAD),
    (without(embedding="1,2"), BAD),
    (without(embedding=[1, 1e300]), BAD),
    (without(chunk_len=3_000_000_000), BAD),
    (without(chunk_id=1.7), BAD),
    (without(chunk_id=12345678901234567890123), None),
    ("", BAD),
    ("{}", BAD),
    ("[1, 2]", BAD),
    ('"text"', BAD),
    ("null", "Invalid JSON"),
    ("{bad", "Invalid JSON"),
    ("not json", "Invalid JSON"),
]


def test_embedded_chunk_rules(spark):
    checked = validate_embedded(messages(spark, [body for body, _ in CASES])).collect()
    by_value = {r.value: r for r in checked}
    for body, reason in CASES:
        text = body if isinstance(body, str) else json.dumps(body)
        assert by_value[text].reason == reason, text
    first = by_value[json.dumps(GOOD)]
    assert (first.chunk, first.chunk_id, first.doc_id, first.chunk_len) == ("text", "c", "d", 4)
    assert [round(x, 9) for x in first.embedding] == [1.0, 0.5, 1e-8]
    numeric = by_value[json.dumps(without(chunk_id=7, doc_id=12))]
    assert (numeric.chunk_id, numeric.doc_id) == ("7", "12")


def prepared(spark, body, **options):
    return prepare_for_embedding(messages(spark, [body]), **options).first()


def test_embed_stage_defaults(spark):
    cases = [
        ({"chunk": "ab", "chunk_id": "c", "doc_id": "007"}, ("ab", "c", "7", 2)),
        ({"chunk": "", "text": "abc", "id": "i", "doc_id": 5}, ("abc", "i", "5", 3)),
        ({"chunk": "ab", "chunk_id": "", "id": "i", "doc_id": "x"}, ("ab", "i", "x", 2)),
        ({"chunk": "ab", "chunk_id": 0, "id": "", "doc_id": 3.7}, ("ab", "", "3", 2)),
        ({"chunk": "\u00e9\u20ac", "chunk_id": 9, "doc_id": "1_000", "chunk_len": 0}, ("\u00e9\u20ac", "9", "1000", 2)),
        ({"chunk": "ab", "chunk_id": "c", "doc_id": "d", "chunk_len": " 9 "}, ("ab", "c", "d", 9)),
        ({"chunk": "ab", "chunk_id": "c", "doc_id": "d", "chunk_len": 7.9}, ("ab", "c", "d", 7)),
    ]
    for body, wanted in cases:
        r = prepared(spark, body)
        assert (r.chunk, r.chunk_id, r.doc_id, r.chunk_len) == wanted, body
        assert r.has_text and r.has_ids and r.reason is None
    kept = prepared(spark, {"chunk": "a", "chunk_id": "c", "doc_id": "007"}, normalize_numeric_ids=False)
    assert kept.doc_id == "007"


def test_embed_stage_drops_and_rejects(spark):
    bodies = [
        {"chunk": "a", "chunk_id": "c", "doc_id": "d"},
        {"chunk": "a", "doc_id": "d"},
        {"chunk": "a", "chunk_id": "c"},
        {"chunk_id": "c", "doc_id": "d"},
        "",
        "{bad",
        "null",
        "[1]",
        {"chunk": "a", "chunk_id": "c", "doc_id": "d", "chunk_len": "many"},
    ]
    frame = prepare_for_embedding(messages(spark, bodies))
    assert tuple(embed_run_counters(frame).first()) == ("completed", 3, 1, 4)
    reasons = sorted((r.reason, r.value[:5]) for r in dead_letters(frame).collect())
    assert [r[0] for r in reasons] == ["Invalid JSON"] * 2 + ["Schema validation failed"] * 2


def test_a_filter_does_not_parse_twice(spark):
    good = validate_embedded(messages(spark, [GOOD])).where("reason is null")
    assert good._jdf.queryExecution().executedPlan().toString().count("parse_json") <= 2


def test_doc_ids(spark):
    ids = ["007", " 12 ", "-05", "+3", "-0", "x", "1_000", "1__0", "", "12.0", "9" * 30]
    rows = spark.createDataFrame([(i,) for i in ids], "i string")
    for r in rows.select("i", normalize_doc_id(F.col("i")).alias("n")).collect():
        try:
            wanted = str(int(r.i))
        except ValueError:
            wanted = r.i
        assert r.n == wanted, r.i


def test_names_and_previews(spark):
    row = spark.range(1).select(
        shard_name(F.lit(7)).alias("a"),
        object_path(F.lit("client/"), F.lit("/shards/"), F.lit(""), F.lit("x.bin")).alias("b"),
        object_path(F.lit("client/")).alias("c"),
        preview(F.lit("abcdef"), 3).alias("d"),
        preview(F.lit("abc"), 3).alias("e"),
    ).first()
    assert tuple(row) == ("shard_007", "client/shards/x.bin", "client", "abc...", "abc")


def test_topics(spark, tmp_path):
    topic = str(tmp_path / "ingestion")
    rows = spark.createDataFrame(
        [("a\nb", "d", 3, f"c{i}", "f", None) for i in range(20)],
        "chunk string, doc_id string, chunk_len int, chunk_id string, source_file string, created_at timestamp",
    )
    assert publish(to_messages(rows, CHUNK_FIELDS), None) is False
    assert publish(to_messages(rows, CHUNK_FIELDS), topic) is True
    assert receive(spark, topic).count() == 20
    assert receive(spark, topic, 5).count() == 5
    assert receive(spark, topic, 0).count() == 0
    body = json.loads(receive(spark, topic).first().value)
    assert body["chunk"] == "a\nb" and body["created_at"] is None
    query = watch(spark, topic, str(tmp_path / "cp"), pause="0 seconds").start()
    query.processAllAvailable()
    assert sum(p["numInputRows"] for p in query.recentProgress) == 20
    query.stop()


def test_topic_statistics(spark):
    rows = [("s", "active"), ("s", "dead-lettered"), ("t", "transfer-dead-lettered"), ("t", "completed")]
    found = {r.subscription: tuple(r)[1:] for r in topic_statistics(
        spark.createDataFrame(rows, "subscription string, status string")).collect()}
    assert found == {"s": (1, 1, 0, 2), "t": (0, 0, 1, 2), None: (1, 1, 1, 4)}
