import zlib

import numpy as np
import pytest
from odd_rows import ODD

from passagelake.llm.queries import op1_sentence_pieces, tokenizer_path
from passagelake.llm.sentence_pieces import Transducer, decode_documents, encode_documents

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def transducer():
    return Transducer(tokenizer_path("piece_bpe_32k.model"))


TEXTS = [t for _, t in ODD if t] + [
    "Hello world", "  two  spaces", "trailing ", "internationalization of tokenizers",
    "1234567890.5 + x_y-z/[]{}", "            sixteen", "mixed 漢字 and ascii", "ﬁ ligature é",
]


@pytest.mark.parametrize("text", TEXTS)
def test_paths_are_the_librarys_pieces(transducer, library, text):
    assert transducer.encode(text).tolist() == library.encode(text)


def test_arcs_are_those_that_merging_gives(transducer):
    rng = np.random.default_rng(3)
    numbers = list(transducer.names)
    short = [n for n in numbers if len(transducer.names[n]) < 4]
    for _ in range(4000):
        left, right = (int(rng.choice(short if rng.random() < 0.5 else numbers)) for _ in range(2))
        names = [transducer.names[left], transducer.names[right]]
        merged = [part[0] for part in transducer.merged("".join(names))]
        assert transducer.allowed(left, right) == (merged == names)


def test_decoding_as_the_library_does(transducer, library):
    for text in TEXTS:
        assert transducer.decode(transducer.encode(text).tolist()) == library.decode(library.encode(text))


def test_unigram_models_take_the_path_of_least_weight(tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.remove_extra_whitespaces = False
    kinds = pb.ModelProto.SentencePiece
    pieces = [("<unk>", 0, kinds.UNKNOWN), ("<s>", 0, kinds.CONTROL), ("</s>", 0, kinds.CONTROL)]
    pieces += [(t, s, kinds.NORMAL) for t, s in [
        ("▁", -3.0), ("a", -2.5), ("b", -2.6), ("c", -2.7), ("ab", -3.1), ("bc", -2.9), ("abc", -6.5), ("▁a", -3.3), ("▁ab", -5.95)]]
    for text, score, kind in pieces:
        model.pieces.add(piece=text, score=score, type=kind)
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    ours = Transducer(str(path))
    theirs = sentencepiece.SentencePieceProcessor(model_file=str(path))
    rng = np.random.default_rng(1)
    for _ in range(200):
        text = "".join(rng.choice(list("abcab "), size=rng.integers(1, 30)))
        assert ours.encode(text).tolist() == theirs.encode(text)


def test_query_equals_the_library(spark, library):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = op1_sentence_pieces(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for row in rows:
        ids = np.array(library.encode(texts[row["doc_id"]]), "<i4")
        assert (row["n_tokens"], row["ids_crc32"], row["round_trip"]) == (len(ids), zlib.crc32(ids.tobytes()), True)


def test_odd_rows_and_clashing_columns(spark, make_docs):
    docs = make_docs(ODD).withColumnRenamed("source", "n_tokens")
    rows = encode_documents(docs, tokenizer_path("piece_bpe_32k.model")).collect()
    assert len(rows) == len(ODD)
    by_text = {r["text"]: r for r in rows}
    assert by_text[None]["n_tokens"] == by_text[""]["n_tokens"] == 0
    assert by_text[None]["round_trip"] is None and by_text[""]["round_trip"]
    assert len(by_text["a" * 200_000]["token_ids"]) == by_text["a" * 200_000]["n_tokens"] > 10_000
    assert encode_documents(make_docs([]), tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_query_gives_ids_and_the_text_that_they_decode_to(spark, library):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = op1_sentence_pieces(spark, SF).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode(texts[row["doc_id"]])
        assert (row["token_ids"], row["decoded"]) == (ids, library.decode(ids))


def test_a_column_of_ids_is_decoded(spark, make_docs, library):
    encoded = encode_documents(make_docs(ODD), tokenizer_path("piece_bpe_32k.model"))
    for row in decode_documents(encoded, tokenizer_path("piece_bpe_32k.model")).collect():
        assert row["decoded"] == library.decode(row["token_ids"])
    broken = spark.createDataFrame([(1, None), (2, []), (3, library.encode("é漢")[:-1])], "i int, ids array<int>")
    got = dict(decode_documents(broken, tokenizer_path("piece_bpe_32k.model"), "ids").select("i", "decoded").collect())
    assert got == {1: None, 2: "", 3: library.decode(library.encode("é漢")[:-1])}


SAMPLE = ["The quick brown fox jumps over the lazy dog", "pack my box with five dozen liquor jugs", "ＡＢＣ ﬁne text 12 ½ Ⅷ",
          "a <sep> b<sep><sep>c", "naïve café № 5 ｶﾞ ™", "wide　space and​none\ttab"] * 20


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_models_with_a_map_of_characters_and_defined_pieces(tmp_path, kind, squeeze, rule):
    import io

    import sentencepiece

    trained = io.BytesIO()
    sentencepiece.SentencePieceTrainer.train(
        sentence_iterator=iter(SAMPLE), model_writer=trained, vocab_size=120, model_type=kind, hard_vocab_limit=False,
        normalization_rule_name=rule, remove_extra_whitespaces=squeeze, user_defined_symbols=["<sep>", "<s", "½½"],
        byte_fallback=False, character_coverage=1.0, minloglevel=2,
    )
    path = tmp_path / "m.model"
    path.write_bytes(trained.getvalue())
    ours, theirs = Transducer(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = SAMPLE + TEXTS + ["​", " ", "　", "½½½", "<s<sep> <s ep>", "ﬁ" * 9, "é", "が ｶﾞ", "Ａ<sep>Ａ  ½½"]
    rng = np.random.default_rng(2)
    texts += ["".join(rng.choice(list("ab Ａﬁ½<sepｶﾞ　́é"), size=rng.integers(1, 25))) for _ in range(200)]
    for text in texts:
        assert ours.encode(text).tolist() == theirs.encode(text), text
