"""SentencePiece encoding and decoding against the library, and whole-text agendas against stretches."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_llm import FOLDER, documents, empty, odd  # noqa: F401

from casebook.llm import pieces
from casebook.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.model_of(MODEL))


def ids(codec, text):
    return np.frombuffer(codec.encode(text), "<u4").tolist()


def strange_texts():
    r = random.Random(5)
    texts = ["", " ", "   ", "a", "<s>", "</s><unk>", "<0x41>", "▁", "a▁ b", "\x00", "\n\n\r\t", "🤦‍♂️ 🤦", "�", "͸", "word" * 4000, " " * 3000, "x\n" * 2000]
    return texts + ["".join(r.choice("ab ét▁\n日<s>🤦,") for _ in range(r.randint(1, 50))) for _ in range(500)]


def test_ids_and_decoded_texts_are_the_librarys(codec, library):
    for text in strange_texts():
        mine = ids(codec, text)
        assert mine == library.encode(text)
        assert codec.decode(mine) == library.decode(mine)


def test_one_agenda_for_the_whole_text_gives_the_same(codec):
    whole = pieces.Codec(pieces.model_of(MODEL))
    whole.alone = False
    for text in strange_texts():
        assert ids(whole, text) == ids(codec, text)


def test_decoding_any_ids_is_the_librarys(codec, library):
    r = random.Random(3)
    for _ in range(3000):
        some = [r.choice([0, 1, 2, r.randint(3, 258), 229, 153, 132, 29871, r.randint(259, 31999)]) for _ in range(r.randint(0, 8))]
        assert codec.decode(some) == library.decode(some)


def test_the_memory_of_stretches_is_bounded_and_changes_nothing(codec, library, monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY", 5)
    small = pieces.Codec(pieces.model_of(MODEL))
    for text in strange_texts():
        assert ids(small, text) == library.encode(text)
        assert len(small.young) <= 5 and len(small.old) <= 5


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.Codec(b"")


def test_rows_equal_the_library_for_odd_rows(spark, odd, empty, library):  # noqa: F811
    found = pieces.checked(odd, MODEL).join(odd.select("doc_id", "text"), "doc_id").where("doc_id IS NOT NULL").collect()
    assert found and all(r.agrees for r in found)
    for r in found:
        true = library.encode(r.text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(true), hashlib.sha256(",".join(map(str, true)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert pieces.checked(odd, MODEL).count() == odd.count()
    assert pieces.checked(empty, MODEL).collect() == [] and pieces.encode(empty, MODEL).collect() == []


def test_whole_texts_are_checked_by_choice_or_where_stretches_disagree(spark, odd, monkeypatch):  # noqa: F811
    texts = sorted(tuple(r) for r in pieces.checked(odd, MODEL).where("doc_id IS NOT NULL").collect())
    assert sorted(tuple(r) for r in pieces.checked(odd, MODEL, whole=True).where("doc_id IS NOT NULL").collect()) == texts
    codec = pieces.Codec(pieces.model_of(MODEL))
    codec.encode("some words, and more")
    assert codec.confirmed() and codec.fresh == []
    codec.four["▁new"] = codec.four["▁old"]
    codec.encode("a new word")
    assert not codec.confirmed()


def test_encode_and_decode_are_inverse(spark):
    docs = documents(spark)
    back = pieces.decode(pieces.encode(docs, MODEL), MODEL).join(docs, "doc_id")
    assert back.where(~F.col("decoded").eqNullSafe(F.col("text"))).count() == 0 and back.count() == docs.count()


def test_query_agrees_on_every_row(spark):
    found = QUERIES["op11_pieces"](spark, FOLDER)
    assert found.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert found.where("NOT agrees").count() == 0 and found.count() == documents(spark).count()
