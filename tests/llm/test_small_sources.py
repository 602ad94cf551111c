"""Mixing with a long tail of small sources, and the slots of shards."""

import collections

from fleetpulse.llm import mixing

DDL = "doc_id long, text string, source string"


def taken(spark, sizes, **parameters):
    docs = spark.createDataFrame([(i, "w " * n, f"s{i:03}") for i, n in enumerate(sizes)], DDL)
    return {r.doc_id: r for r in mixing.taken_words(*mixing.mix(docs, **parameters)).collect()}


def test_small_sources_are_filled(spark):
    sizes = [5, 10, 65, 100, 200, 1000, 1, 64, 0]
    got = taken(spark, sizes, share=2.0)
    assert [got[i].taken for i in range(len(sizes))] == [2 * n for n in sizes]


def test_no_source_of_a_long_tail_vanishes(spark):
    sizes = [1 + i * 7 % 90 for i in range(150)] + [20_000, 9000]
    got = taken(spark, sizes)
    assert all(r.taken > 0 and abs(r.taken - r.target) <= 96 for r in got.values())
    assert abs(sum(r.taken for r in got.values()) / sum(r.target for r in got.values()) - 1) < 0.05


def test_slots_of_shards(spark):
    rows = [(0, 640, 1280.0), (1, 64_000, 30_000.0), (2, 0, 0.0), (3, 5, 7.5), (4, 64_000, 3.0)]
    targets = spark.createDataFrame(rows, "s long, source_size long, target double")
    got = mixing.slots(targets, 64, 50, 1).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.s].append(r)
    assert {s: sorted(r.t for r in v) for s, v in by.items()} == {s: list(range(n)) for s, n in ((0, 20), (1, 469), (3, 2), (4, 1))}
    assert sorted((r.turn, r.block) for r in by[0]) == [(k, b) for k in (0, 1) for b in range(10)]
    shards = collections.Counter(r.shard for r in got)
    assert len(shards) == 10 and max(shards.values()) - min(shards.values()) <= 1
    counts = collections.Counter(r.shard for r in by[1])
    assert 1 < max(counts.values()) - min(counts.values()) < 25, "counts vary from shard to shard, as draws do"
