import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tapeworks.llm import token_files, tokens
from tapeworks.llm.elias_fano import EliasFano, IdFile
from tapeworks.llm.shared import shared_dir

from .cases import frame, odd_documents

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**63), max_size=700))
def test_elias_fano_round_trip(values):
    values = sorted(values)
    coded, end = EliasFano.from_bytes(data := EliasFano.encode(np.array(values, np.uint64)).to_bytes())
    assert end == len(data)
    assert coded.values().tolist() == values == [coded.select(i) for i in range(len(values))]


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(0, 3000, 20_000))
    assert len(EliasFano.encode(ends).to_bytes()) * 8 < 20_000 * (2 + np.log2(ends[-1] / 20_000) + 1)
    with pytest.raises(IndexError):
        EliasFano.encode(ends).select(20_000)


def test_id_file():
    rows = [(None, [5]), (-(2**63), []), (3, [1, 2, 65535]), (3, [9]), (2**63 - 1, [])]
    file = IdFile(IdFile.build([k for k, _ in rows], [np.array(x, "<u2") for _, x in rows], 2))
    assert [(file.key(i), file.document(i).tolist()) for i in range(len(file))] == rows
    assert len(IdFile(IdFile.build([], [], 2))) == 0
    with pytest.raises(ValueError):
        IdFile(b"something else")


def test_rows_read_back_match_the_library(spark):
    docs = odd_documents()
    library, start, want = Tokenizer.from_file(VOCABULARY), 0, []
    for i, t in sorted(docs, key=lambda d: d[0]):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_files.token_file_rows(frame(spark, docs), VOCABULARY)
    assert sorted(map(tuple, got.collect())) == want
    for name, bound in (("small", {"file_bytes": 2000}), ("few", {"file_docs": 3})):
        manifest = token_files.write_token_files(frame(spark, docs), f"{shared_dir(spark)}/{name}-files", VOCABULARY, **bound)
        assert manifest.count() > 1 and (name == "small" or manifest.where("n_docs > 3").count() == 0)
        assert sorted(map(tuple, token_files.read_token_files(manifest).collect())) == want
    assert token_files.token_file_rows(frame(spark).limit(0), VOCABULARY).count() == 0


@pytest.mark.parametrize(("kind", "name"), [(tokens.ByteLevel, "byte_bpe_50k.json"), (tokens.WordLevel, "word_bpe_49k.json")])
def test_pieces_equal_the_library(kind, name, monkeypatch):
    own, texts = kind(public_tokenizers.path(name)), [t or "" for _, t in odd_documents(800, 9)]
    monkeypatch.setattr(tokens, "LIMIT", 300)
    for at in range(0, len(texts), 50):
        assert own.encode(texts[at : at + 50]) == own.whole(texts[at : at + 50])


def test_coding_sparse_keys_takes_little_memory():
    import tracemalloc

    keys = np.sort(np.random.default_rng(1).integers(0, 2**62, 200_000)).astype(np.uint64)
    tracemalloc.start()
    coded = EliasFano.encode(keys)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert coded.select(777) == int(keys[777]) and peak < 100 * len(keys)  # bytes a key
