import random

import pytest

from skein.functions.ids import integer_id
from skein.llm.components import group_links


def brute(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


CASES = {
    "chain": [(i, i + 1) for i in range(130)],
    "chain in any order": [(a * 37 % 101, (a + 1) * 37 % 101) for a in range(90)],
    "star with a large hub": [(500, i) for i in range(60)],
    "loops, repeats and nulls": [(1, 1), (2, 3), (3, 2), (2, 3), (None, 4), (5, None), (7, 7)],
    "nothing": [],
}


@pytest.mark.parametrize("name", CASES)
def test_groups(spark, name):
    frame = spark.createDataFrame([(*x, "extra") for x in CASES[name]], "a long, b long, group_id string")
    assert {r.id: r.group_id for r in group_links(frame, "a", "b").collect()} == brute(CASES[name])


def test_random_links(spark):
    rnd = random.Random(4)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)]
    rows = group_links(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert len(rows) == len({r.id for r in rows}) and {r.id: r.group_id for r in rows} == brute(links)


def test_ids_are_read_digit_by_digit(spark):
    texts = {" 200041998458135987 ": 200041998458135987, "200269447976863903.0": 200269447976863903, "200314285354274178.000": 200314285354274178, "\t7\n": 7, "": None, "  ": None, "x1": None, "1.5": None, None: None, "　8​": 8}
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in frame.select(integer_id(frame.t)).collect()] == list(texts.values())
