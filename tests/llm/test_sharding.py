import zlib

from tapeworks.llm.sharding import shard_by_bytes

from .cases import frame, odd_documents


def test_shards_are_contiguous_whole_and_near_equal(spark):
    docs = [(i, t) for i, t in odd_documents() if not t or len(t) < 9000]
    for shards in (1, 3, 8):
        got = sorted(shard_by_bytes(frame(spark, docs), shards).collect(), key=lambda r: (r.doc_id, r.shard, r.slot))
        want = sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
        assert [(r.doc_id, r.size, r.text_crc32) for r in got] == want
        assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
        total, largest, before = sum(r.size for r in got), max(r.size for r in got), 0
        for r in got:
            assert r.shard == min(shards - 1, (2 * before + r.size) * shards // (2 * total))
            before += r.size
        for s in range(shards):
            own = [r for r in got if r.shard == s]
            assert [r.slot for r in own] == list(range(len(own)))
            assert abs(sum(r.size for r in own) - total / shards) <= largest


def test_edges(spark):
    assert shard_by_bytes(frame(spark).limit(0)).count() == 0
    got = shard_by_bytes(frame(spark, [(None, "a"), (None, None), (5, "x" * 10_000), (5, "x")]), 4).collect()
    assert sorted(r.size for r in got) == [1, 2, 2, 10_001]
    assert [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))] == [None, None, 5, 5]
