import json

import pytest

from gaugeworks.operators.nesting import all_nodes, contained, gathered_list_keys, list_keys, node_table, nodes, rebuilt

MAPS = ("per_subtype",)
RECORDS = [
    {"tokens": {"calls": [{"id": 1, "attempts": [{"n": 1}, None, {"n": 2}]}, None, {"id": 2, "attempts": []}]}},
    {"tokens": {"calls": {"id": 3, "attempts": {"n": 1}}}, "scores": {"per_subtype": {"a": {"x": 1}, "b": 5}}},
    {"tokens": {"calls": json.dumps([{"id": 4}])}, "scores": {"per_subtype": [{"subtype": "a"}]}, "deep": [[{"z": 1}]]},
]


def found(spark, rows):
    df = spark.createDataFrame(rows, "rec_id bigint, raw string")
    return sorted((r.rec_id, r.node, r.parent) for r in nodes(df, "rec_id", "raw", MAPS).collect())


def test_nodes_and_parents(spark):
    got = found(spark, [(i, json.dumps(r)) for i, r in enumerate(RECORDS)])
    assert got == [
        (0, "tokens.calls[0]", ""), (0, "tokens.calls[0].attempts[0]", "tokens.calls[0]"), (0, "tokens.calls[0].attempts[2]", "tokens.calls[0]"), (0, "tokens.calls[2]", ""),
        (1, "scores.per_subtype[a]", ""), (1, "tokens.calls[0]", ""), (1, "tokens.calls[0].attempts[0]", "tokens.calls[0]"),
        (2, "deep[0][0]", ""), (2, "scores.per_subtype[0]", ""), (2, "tokens.calls[0]", ""),
    ]


def test_dirty_lines(spark):
    one = json.dumps(RECORDS[0])
    rows = [(1, None), (2, ""), (3, one[:-5]), (4, one + one), (5, "[1]"), (6, one), (6, one), (None, one), (7, '{"a": "' + "x" * 200_000 + '"}')]
    got = found(spark, [r for r in rows if r[0] is not None])
    assert {r for r, _, _ in got} == {6} and len(got) == 8
    assert nodes(spark.createDataFrame(rows, "rec_id bigint, raw string"), "rec_id", "raw", MAPS).where("rec_id is null").count() == 4
    assert found(spark, []) == []


def test_containment_join(spark):
    df = spark.createDataFrame([(i, json.dumps(r), "x") for i, r in enumerate(RECORDS)], "rec_id bigint, raw string, node string")
    all_nodes = nodes(df, "rec_id", "raw", MAPS)
    joined = contained(node_table(all_nodes, "tokens.calls.attempts"), node_table(all_nodes, "tokens.calls"), "rec_id").collect()
    assert len(joined) == 3 and all(r.outer_node == r.parent for r in joined)


WHOLE = [
    *RECORDS[:2],
    {"task": "t", "parameters": {"temperature": 0.5, "top": None}, "scores": {"a": 1, "b": {}}, "tokens": {"calls": [{"id": 1}], "n": 3}, "tags": ["x", None, 2, True, [], [1, [{}]]], "ok": False},
    {}, {"": {"": [""]}, "a.b": {"c[0]": [{"d": "1"}, 1]}}, {"per_subtype": {"a": [{"x": 1}], "b": "t", "c": None}},
]


def test_every_record_can_be_rebuilt_from_its_rows(spark):
    df = spark.createDataFrame([(i, json.dumps(r), "x", "y") for i, r in enumerate(WHOLE)], "rec_id bigint, raw string, pre string, fields string")
    rows = all_nodes(df, "rec_id", "raw", MAPS).collect()
    for i, record in enumerate(WHOLE):
        own = [r.asDict(recursive=True) for r in rows if r.rec_id == i]
        assert rebuilt(own) == record
        spans = [(r["pre"], r["post"]) for r in own]
        assert all(a < c and d < b or c < a and b < d or b < c or d < a for k, (a, b) in enumerate(spans) for c, d in spans[:k])
        assert [r["up"] for r in own if r["kind"] == "record"] == [0]
    assert {r.node for r in rows if r.rec_id == 2 and r.kind == "entry"} == {"tokens.calls[0]", "tags[5][1][0]"}


def test_lists_as_text_and_single_objects_are_told_apart(spark):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(RECORDS)], "rec_id bigint, raw string")
    kinds = {(r.rec_id, r.node): r.kind for r in all_nodes(df, "rec_id", "raw", MAPS).collect()}
    assert kinds[1, "tokens.calls[0]"] == "only" and kinds[2, "tokens.calls"] == "list_text" and kinds[1, "scores.per_subtype"] == "map"


@pytest.mark.parametrize("depth", [400, 5000])
def test_deep_lines(spark, depth):
    """Depth is bounded by the JSON parser alone."""
    lists, objects = '{"a":' + "[" * depth + "]" * depth + "}", '{"o":' * depth + "1" + "}" * depth
    df = spark.createDataFrame([(1, lists), (2, objects), (3, '{"a": [{"b": 1}]}')], "rec_id bigint, raw string")
    counts = {r.rec_id: r["count"] for r in all_nodes(df, "rec_id", "raw").groupBy("rec_id").count().collect()}
    assert counts == {1: depth + 1, 2: depth, 3: 3}
    assert [r.node for r in nodes(df, "rec_id", "raw").collect()] == ["a[0]"]


def test_list_keys_found_without_parsing_every_line(spark):
    """Against a parse of every line, with keys and values that look like one another."""
    import random

    rng = random.Random(5)
    keys = ["a", "b: [", 'q"', "\\", "é", "", "[{", ", ", "tags"]

    def value(depth):
        kind = rng.randrange(8)
        if kind == 0 and depth:
            return {rng.choice(keys): value(depth - 1) for _ in range(rng.randrange(3))}
        if kind in (1, 2) and depth:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        if kind == 3:
            return json.dumps([value(0), {"k": 1}] if rng.random() < 0.5 else [1])
        return rng.choice([None, True, 1.5e-3, "x", '": [{', "[{", '"a": [{"b"', "]"])

    records = [{rng.choice(keys): value(4) for _ in range(3)} for _ in range(800)]
    want = set().union(*map(list_keys, records))
    df = spark.createDataFrame([(json.dumps(r, ensure_ascii=i % 2 == 0),) for i, r in enumerate(records)], "raw string").repartition(3)
    assert gathered_list_keys(df, "raw") == want and len(want) > 5
