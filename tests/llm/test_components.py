import random
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from mailweir.llm import components as C


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            parent[find(a)] = find(b)
    groups = defaultdict(list)
    for x in list(parent):
        groups[find(x)].append(x)
    return {(min(v), x, len(v)) for v in groups.values() for x in v}


def run(spark, edges, **kw):
    return {tuple(r) for r in C.components(spark.createDataFrame(edges, "u string, v string"), **kw).collect()}


RNG = random.Random(3)
GRAPHS = {
    "empty": [],
    "loop": [("a", "a")],
    "nulls": [(None, "a"), ("b", None)],
    "pair twice": [("b", "a"), ("a", "b"), ("a", "b")],
    "path": [(f"{i:02}", f"{i + 1:02}") for i in range(40)],
    "ring": [(f"{i:02}", f"{(i + 1) % 30:02}") for i in range(30)],
    "star": [("m", f"{i:03}") for i in range(100)],
    "dense": [(str(RNG.randint(0, 20)), str(RNG.randint(0, 20))) for _ in range(120)],
    "sparse": [(str(RNG.randint(0, 99)), str(RNG.randint(0, 99))) for _ in range(70)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    assert run(spark, GRAPHS[name]) == brute(GRAPHS[name])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 15).map(str), st.integers(0, 15).map(str)), max_size=25))
def test_random_graphs(spark, edges):
    assert run(spark, edges) == brute(edges)


MESSAGES = "id string, group_id string, content_hash string, parent_id string, u string, k string"


def test_message_ties(spark):
    rows = [
        ("a:1", " g1 ", "AB", None, "x", "y"),
        ("a:2", "g1", None, "a:2", "x", "y"),
        ("a:3", "none", "ab ", "gone:9", None, None),
        ("a:4", "N/A", "", " a:3 ", None, None),
        ("a:5", "NaN", "empty", "", None, None),
        ("a:6", None, None, None, None, None),
        ("a:7", None, "zz", None, None, None),
    ]
    overlap = [("a:5", "a:6", "Rejected "), ("a:6", "a:7", None), ("a:5", "none", "confirmed")]
    o = spark.createDataFrame(overlap, "english_id string, vietnamese_id string, review_status string")
    got = {(r["component_id"], r["id"]) for r in C.message_components(spark.createDataFrame(rows, MESSAGES), o).collect()}
    assert got == {("a:1", x) for x in ("a:1", "a:2", "a:3", "a:4")} | {("a:6", "a:6"), ("a:6", "a:7")}


def test_no_messages(spark):
    assert C.message_components(spark.createDataFrame([], MESSAGES)).count() == 0
