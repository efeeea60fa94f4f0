import zlib

import numpy as np
import pytest
from odd_rows import ODD

from passagelake.llm import token_files
from passagelake.llm.queries import op9_token_files, tokenizer_path
from passagelake.llm.token_files import PieceEncoder, byte_characters, read_token_files, shard_bases, write_token_files

SF = "/root/testdata/sf0.001"
PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def expected(library, rows):
    """(doc_id, start, n_tokens, crc) in ascending order, nulls first, equal ids by text."""
    out, start = [], 0
    for at, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array(library(text), "<u4")
        out.append((at, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("kept", [250_000, 3])
def test_pieces_join_and_encode_apart(library, monkeypatch, kept):
    monkeypatch.setattr(token_files, "CACHED_WORDS", kept)
    encode = PieceEncoder(PATH)
    odd = ["a  b", " lead", "trail ", "x \n y", "it's we'll", "　wide 　 gap", "…, x…, 5, 5%, a.), (b] \"q\"", "don't, 's. n't!"]
    texts = [t for _, t in ODD] + odd + ["word, " + "long" * 40 + ", word,"]
    for text in filter(None, texts):
        assert "".join(PieceEncoder.pieces(text)) == text
    for _ in range(4):
        for text, ids in zip(texts, encode.encode_batch(texts)):
            assert ids.tolist() == library(text)


def test_byte_characters_are_the_vocabularys():
    import json

    with open(PATH) as file:
        vocabulary = json.load(file)["model"]["vocab"]
    assert len(set(byte_characters())) == 256 and all(c in vocabulary for c in byte_characters())


def test_query_equals_encoding_whole_texts(spark, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in op9_token_files(spark, SF).orderBy("start").collect()]
    assert got == expected(library, rows)


def test_odd_rows_round_trip(spark, library, make_docs):
    folder = write_token_files(make_docs(ODD), PATH)
    rows = read_token_files(spark, folder, with_ids=True).orderBy("start").collect()
    assert [tuple(r)[:4] for r in rows] == expected(library, ODD)
    for row in rows:
        assert zlib.crc32(np.array(row["token_ids"], "<u4").tobytes()) == row["ids_crc32"]
    bases = shard_bases(spark, folder).orderBy("shard").collect()
    assert [r["base"] for r in bases] == list(np.cumsum([0, *[r["tokens"] for r in bases]])[:-1])


def test_large_end_ids_take_four_bytes(spark, make_docs):
    folder = write_token_files(make_docs(["a b", "c"]), PATH, end_id=70_000)
    rows = read_token_files(spark, folder, with_ids=True).orderBy("start").collect()
    assert [r["token_ids"][-1] for r in rows] == [70_000] * 2


def test_empty_table(spark, make_docs):
    assert read_token_files(spark, write_token_files(make_docs([]), PATH)).count() == 0


def test_writing_again_replaces_the_files(spark, library, make_docs):
    folder = write_token_files(make_docs(["first text", "second"]), PATH)
    write_token_files(make_docs(["other"]), PATH, folder=folder)
    assert [tuple(r) for r in read_token_files(spark, folder).collect()] == expected(library, [(0, "other")])


def test_query_keeps_added_tokens_as_the_library_does(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)

    def library(text):
        return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]

    odd = ["a b<|endoftext|>c d", "<|endoftext|>", "one <|endoftext|> two, three.", "x  <|endoftext|>\n y", "<|endoftext |>"]
    rows = ODD + [(100 + i, text) for i, text in enumerate(odd)]
    assert 50256 in library(odd[0])
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op9_token_files(spark, str(tmp_path)).orderBy("start").collect()]
    wanted = expected(library, rows)
    least = -(1 << 63)
    assert [(least if r[0] is None else r[0], *r[1:]) for r in got] == [(least if r[0] is None else r[0], *r[1:]) for r in wanted]
    encode = PieceEncoder(PATH, added_tokens=True)
    assert [i.tolist() for i in encode.encode_batch(odd)] == [library(t) for t in odd]


@pytest.mark.parametrize("shards", [1, 5, 8])
def test_equal_ids_are_ordered_by_text_however_they_are_dealt(spark, make_docs, library, shards):
    rows = [(7 if i % 2 else i, f"{'same start ' * (i % 3)}text {i * 37 % 101}") for i in range(200)]
    spark.conf.set("spark.sql.shuffle.partitions", str(shards))
    try:
        folder = write_token_files(make_docs(rows).repartition(4), PATH)
        got = [tuple(r) for r in read_token_files(spark, folder).orderBy("start").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == expected(library, rows)
