"""op 7: equal bytes, gapless slots, hot and repeated keys."""
import collections
import random
import zlib

from webloom.llm import sharding as S


def check(out, rows, shards):
    size = lambda t: len((t or "").encode()) + 16
    crc = lambda t: None if t is None else zlib.crc32(t.encode())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in out) == \
        collections.Counter((i, size(t), crc(t)) for i, t in rows)
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    assert all(0 <= s < shards for s in by)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    total, largest = sum(size(t) for _, t in rows), max(size(t) for _, t in rows)
    for s in range(shards):
        assert abs(sum(r.size for r in by[s]) - total / shards) <= largest


def test_equal_bytes(docs_of):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(0, 300) + str(i)) for i in range(500)]
    check(S.shard(docs_of(rows), shards=7, ranges=50).collect(), rows, 7)


def test_hot_text_hot_row_nulls(docs_of):
    rows = ([(i, "same text") for i in range(300)] + [(7, "one row")] * 300 + [(None, None)] * 5 + [(-3, ""), (8, None)]
            + [(i, f"text {i}") for i in range(1000, 1300)])
    out = S.shard(docs_of(rows), shards=10, ranges=30).collect()
    check(out, rows, 10)
    # Equal texts are neighbours: they fill a run of shards, sharing only its ends with others.
    same = sorted({r.shard for r in out if r.text_crc32 == zlib.crc32(b"same text")})
    assert same == list(range(same[0], same[-1] + 1))


def test_small_tables(docs_of):
    assert S.shard(docs_of([])).count() == 0
    assert [tuple(r) for r in S.shard(docs_of([(5, "abc")]), shards=4).collect()] == [(5, 19, zlib.crc32(b"abc"), 2, 0)]
    rows = [(1, "x" * 5000), (2, "y")]
    check(S.shard(docs_of(rows), shards=3).collect(), rows, 3)


def test_overfull_ranges_are_subdivided(docs_of, spark):
    from webloom.llm.common import written
    rows = [(i, "hot") for i in range(400)] + [(i, f"t{i}") for i in range(400, 500)]
    units = written(S._units(docs_of(rows), "doc_id", "text", 16), "t")
    ranges = S.range_partition(units, 20).groupBy("range").agg({"size": "sum"}).collect()
    total = sum(r["sum(size)"] for r in ranges)
    assert max(r["sum(size)"] for r in ranges) <= 3 * total / 20
