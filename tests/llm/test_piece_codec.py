import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from tapeworks.llm import piece_codec

from .cases import frame, odd_documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_rows_match_the_library(spark):
    docs = odd_documents()
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t in docs:
        ids = library.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(map(tuple, piece_codec.encode_documents(frame(spark, docs), MODEL).collect())) == sorted(want)
    assert piece_codec.encode_documents(frame(spark).limit(0), MODEL).count() == 0


def test_chunks_equal_the_library_on_odd_texts(monkeypatch):
    rng = random.Random(4)
    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), piece_codec.Codec(MODEL)
    monkeypatch.setattr(piece_codec, "LIMIT", 200)
    parts = [" ", "  ", "\n", "\n\n", "a", "the", "é", "中", "🙂", "▁", "\t", "<0x0A>", "</s>", ",", "ing", "\x00"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 16))) for _ in range(4000)]
    assert [ids for at in range(0, 4000, 500) for ids in own.encode(texts[at : at + 500])] == library.encode(texts)


def test_agenda_takes_the_best_score_then_the_leftmost():
    agenda = piece_codec.Agenda([("<unk>", 0, 2), ("a", 0, 1), ("b", 0, 1), ("aa", -2, 1), ("ab", -1, 1), ("aab", -3, 1)])
    assert agenda.encode("aab") == [5] and agenda.encode("aaa") == [3, 1] and agenda.encode("aaaz") == [3, 1, 0]
    with pytest.raises(ValueError):
        piece_codec.Agenda([("a▁b", 0, 1)])


def test_text_with_a_chunk_on_which_the_two_differ_goes_to_the_library():
    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), piece_codec.Codec(MODEL)
    real = own.agenda.encode
    own.agenda.encode = lambda chunk: [1] if chunk.endswith("thing") else real(chunk)
    texts = ["a thing, or two", "nothing odd", "plain words", "thing"]
    assert own.encode(texts) == own.encode(texts) == library.encode(texts)


def test_long_chunks_are_not_kept():
    own = piece_codec.Codec(MODEL)
    own.encode(["x" * 5000 + " short", "y" * 5000])
    assert own.known and max(map(len, own.known)) <= piece_codec.LONG
