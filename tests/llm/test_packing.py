import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tapeworks.llm import packing

from .cases import frame, odd_documents

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def test_every_id_lies_in_one_piece_and_little_is_padded(spark):
    docs = odd_documents()
    rows = packing.pack_documents(frame(spark, docs).coalesce(1), VOCABULARY, with_ids=True).collect()
    library = Tokenizer.from_file(VOCABULARY)
    want = sorted((i, library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in docs)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert 0 < r.length <= 2048 and r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    seen = []
    for doc, pieces in by_doc.items():
        copies = sum(i == doc for i, _ in docs)
        for start in sorted({p.start for p in pieces}):
            assert sum(p.start == start for p in pieces) == copies
        whole = np.frombuffer(b"".join(p.ids for p in sorted({p.start: p for p in pieces}.values(), key=lambda p: p.start)), "<u4").tolist()
        assert all(p.doc_tokens == len(whole) for p in pieces)
        seen += [(doc, whole)] * copies
    assert sorted(seen) == want
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        padding += 2048 - at
    assert padding < 2048 + 0.01 * sum(r.length for r in rows)


def test_differencing_keeps_all_items_and_levels_windows():
    rng = random.Random(2)
    for n, k in ((0, 1), (1, 1), (1, 4), (7, 3), (200, 13), (400, 60)):
        sizes = [rng.randrange(1, 513) for _ in range(n)]
        found = packing.differencing(sizes, k)
        assert sorted(i for w in found for i in w) == list(range(n))
        loads = [sum(sizes[i] for i in w) for w in found]
        if n >= 10 * k:
            assert max(loads) - min(loads) < 16
    assert packing.windows([2048, 2048, 1], 2048) in ([[0], [1], [2]], [[2], [0], [1]], [[1], [0], [2]], [[0], [2], [1]], [[1], [2], [0]], [[2], [1], [0]])
    assert len(packing.windows([1500] * 4, 2048)) == 4  # three would hold the sum, but not the pieces


def test_empty_table(spark):
    assert packing.pack_documents(frame(spark).limit(0), VOCABULARY).count() == 0
