"""Flows of many sources, and rows without doc_id."""

import random
import time

from graphloom.llm import mixing


def test_many_sources_take_time_in_proportion():
    took = []
    for n in (5_000, 20_000):
        r = random.Random(n)
        members = [[s] for s in range(n)] + [sorted(r.sample(range(n), 3)) for _ in range(n // 4)]
        sizes = [r.randrange(1, 1000) for _ in members]
        quotas = [r.randrange(1, 2500) for _ in range(n)]
        began = time.perf_counter()
        got = mixing.flow(sizes, members, quotas, 2)
        took.append(time.perf_counter() - began)
        assert all(-1e-6 <= g <= 2 * s + 1e-6 for g, s in zip(got, sizes, strict=True)) and sum(got) <= sum(quotas) + 1e-3
    assert took[1] < 12 * took[0] + 1


def test_first_readings_come_before_second_ones():
    # one shared pattern could be read twice, but the other's first reading is free
    assert mixing.flow([10, 10], [[0, 1], [0]], [10, 10], 2) == [10, 10]
    # the shared pattern makes way: source 1 has no other giver
    assert mixing.flow([10, 10, 10], [[0, 1], [0, 2], [2]], [10, 10, 10], 1) == [10, 10, 10]


def test_rows_without_id_are_chosen_one_by_one(spark):
    rows = [(None, f"w {i} w", "a") for i in range(400)] + [(i, "w w w", "b") for i in range(400)] + [(None, None, "a")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for size, target in {(g.source_size, g.target) for g in got}:
        assert abs(sum(g.taken for g in got if g.target == target and g.source_size == size) - target) <= 3 or size == 1200
    taken = sorted({g.taken for g in got if g.doc_id is None})
    assert len(got) == 801 and len(taken) >= 2
