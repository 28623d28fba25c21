import json
import os

import pytest

from tidemark.operators import nested
from tidemark.plans.corpus_core import p2_found

ROOT = os.environ.get("TIDEMARK_TEST_DATA", "/root/testdata/sf0.001")

DOCS = {
    "plain": [{"text": "a", "evidence": [{"id": "x", "quotes": [{"s": 0}, {"s": None}]}, {"id": "y"}], "counter": {"points": [{"t": 1}], "open": []}}],
    "object": {"version": 2, "reasons": [{"a": 1}, 5, None, "s", [], {}]},
    "arrays": {"gates": [[{"n": 1}], [], [{"n": 2}, {"m": {"deep": [{"k": 1}]}}]]},
    "recursive": {"filters": [{"all_of": [{"any_of": [{"all_of": [{"v": 1}]}]}], "v": 2}], "v": 3},
    "scalar": 7,
    "empty": {},
    "dots": {"a.b": [{"c]": [{}]}]},
}


def brute(value):
    out = []

    def walk(v, path, parent, in_array):
        if isinstance(v, dict):
            if in_array:
                out.append((path, parent))
                parent = path
            for k, x in v.items():
                walk(x, f"{path}.{k}" if path else k, parent, False)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{path}[{i}]", parent, True)

    walk(value, "", "", False)
    return set(out)


def found(spark, docs):
    df = spark.createDataFrame(list(docs.items()), "key string, doc string")
    df = df.withColumnsRenamed({}).selectExpr("key", "doc", "'x' AS path", "1 AS root_key")
    out = {}
    for r in nested.nested_objects(df, "t", "key", "doc").collect():
        out.setdefault(r.root_key, set()).add((r.path, r.parent_path))
    return out


def test_objects_and_parents(spark):
    docs = {k: json.dumps(v) for k, v in DOCS.items()}
    docs |= {"wrapped": json.dumps(json.dumps(DOCS["plain"])), "pretty": json.dumps(DOCS["arrays"], indent=1)}
    docs |= {"cut": docs["plain"][:-3], "na": "n/a", "blank": "", "null": None, "wrapped bad": json.dumps("[{"), "text null": "null"}
    docs["surrogate"] = '{"a\\ud800": [{"b": "\\udc00"}]}'
    docs["inner string"] = json.dumps({"raw": json.dumps([{"a": 1}]), "list": [{"raw": "[{}]"}]})
    got = found(spark, docs)
    want = {k: brute(v) for k, v in DOCS.items()} | {"wrapped": brute(DOCS["plain"]), "pretty": brute(DOCS["arrays"]), "inner string": {("list[0]", "")}, "surrogate": {("a\ufffd[0]", "")}}
    assert got == {k: v for k, v in want.items() if v}


def test_repeated_rows_count_once_and_keys_may_be_null(spark):
    df = spark.createDataFrame([("k", '[{"a":1}]'), ("k", '[{"a":1}]'), ("k", '[{"a":1},{}]'), (None, "[{}]")], "key string, doc string")
    assert sorted((r.root_key, r.path) for r in nested.nested_objects(df, "t", "key", "doc").collect()) == [("", "[0]"), ("k", "[0]"), ("k", "[1]")]
    assert nested.nested_objects(df.limit(0), "t", "key", "doc").count() == 0


def test_deep_documents(spark):
    deep = 30_000
    text = '{"a":[' * deep + "1" + "]}" * deep
    value = nested.read_document(text)
    assert value is not None
    n = sum(1 for _ in nested.shred_document(value, nested.Inlining(frozenset({"$", "a"}))))
    assert n == deep + 1
    assert nested.read_document(text[:-1]) is None


def test_deep_parser_agrees_with_the_library():
    for v in DOCS.values():
        for t in (json.dumps(v), json.dumps(v, indent=2), " " + json.dumps(v) + "\n"):
            assert nested._deep(t) == json.loads(t)
    for bad in ('{"a"}', "[1,]", "[1 2]", '{"a":1', "[1]]", "{,}", ""):
        try:
            nested._deep(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_inlining_decides_by_the_schema_graph():
    edges = [("$", "a", "1"), ("a", "b", "1"), ("b", "x", "="), ("$", "list", "*"), ("list", "list", "*{"), ("list", "c", "1"), ("a", "c", "1"), ("c", "y", "="), ("a", "r", "1"), ("r", "q", "1"), ("q", "r", "1")]
    plan = nested.Inlining.of(edges)
    assert plan.reasons == {"$": "root", "list": "repeated", "c": "shared", "r": "shared", "q": "recursive"}


def test_tables_keep_links_and_lose_nothing(spark):
    docs = {k: json.dumps(v) for k, v in DOCS.items()}
    rows = nested.shred(spark.createDataFrame(list(docs.items()), "key string, doc string"), "t", "key", "doc").collect()
    keys = {(r.doc_id, r.path) for r in rows}
    assert len(keys) == len(rows) and all((r.doc_id, r.parent_path) in keys for r in rows)
    scalars = sum(len(r.columns) for r in rows)

    def leaves(v):
        return sum(map(leaves, v.values())) if isinstance(v, dict) else sum(map(leaves, v)) if isinstance(v, list) else 1

    assert scalars == sum(leaves(v) for v in DOCS.values())


def test_keys_with_several_documents_keep_their_links(spark):
    docs = [("k", '{"a":[{"b":[{}]}]}'), ("k", '{"a":[{"b":[{}],"c":1}]}'), ("k", '{"a":[{"b":[{}]}]}'), (None, '{"a":[{}]}'), (None, '{"a":[{"c":2}]}')]
    rows = nested.shred(spark.createDataFrame(docs, "key string, doc string"), "t", "key", "doc").collect()
    keys = {(r.doc_id, r.path) for r in rows}
    assert len(keys) == len(rows) == 3 + 3 + 2 + 2
    assert all((r.doc_id, r.parent_path) in keys and r.root_key in ("k", "") for r in rows)


def test_members_that_are_data_become_a_map(spark, monkeypatch):
    monkeypatch.setattr(nested, "MAX_EDGES", 60)
    monkeypatch.setattr(nested, "MAX_MEMBERS", 20)
    docs = [(f"d{k}", json.dumps({"by_id": {f"m{k}_{j}": {"v": j, "xs": [{"y": j}]} for j in range(10)}, "n": k})) for k in range(20)]
    df = spark.createDataFrame(docs, "key string, doc string")
    plan = nested.analyse(df, "doc")
    assert plan.maps == {"by_id"} and plan.reasons["by_id.*"] == "repeated"
    rows = nested.shred(df, "t", "key", "doc", plan).collect()
    keys = {(r.doc_id, r.path) for r in rows}
    assert all((r.doc_id, r.parent_path) in keys for r in rows)
    count = {}
    for r in rows:
        count[r.table_name] = count.get(r.table_name, 0) + 1
    assert count == {"$": 20, "by_id.*": 200, "xs": 200}
    assert {r.columns["v"] for r in rows if r.table_name == "by_id.*"} == {str(j) for j in range(10)}


def test_found_objects_are_rows_of_the_related_tables(spark, monkeypatch):
    graphs = []
    analyse = nested.analyse
    monkeypatch.setattr(nested, "analyse", lambda df, column: graphs.append(column) or analyse(df, column))
    docs = DOCS | {"shared": {"list": [{"one": {"part": {"n": [{"x": 1}]}, "two": {"part": {"n": [5, [{}]]}}}}]}, "long": [{"a": {"b": k}} for k in range(60_001)]}
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()], "key string, doc string")
    rows = {(r.doc_id, r.path): r for r in nested.shred(df, "t", "key", "doc").collect()}
    assert graphs == ["doc"] and {"part", "$"} <= {r.parent_table for r in rows.values()}

    def case(r):
        return r.is_object and r.in_array

    def up(r):
        above = rows[r.doc_id, r.parent_path]
        return above.path if case(above) or not above.path else up(above)

    want = sorted(("t", r.root_key, r.path, up(r)) for r in rows.values() if case(r))
    assert sorted(map(tuple, nested.nested_objects(df, "t", "key", "doc").collect())) == want
    assert graphs == ["doc"] * 2
    assert [(k, *x) for k, v in sorted(docs.items()) for x in sorted(brute(v))] == [x[1:] for x in want]


@pytest.mark.skipif(not os.path.exists(ROOT), reason="no test tables")
def test_p2_found_goes_through_three_graphs(spark, monkeypatch):
    graphs = []
    analyse = nested.analyse
    monkeypatch.setattr(nested, "analyse", lambda df, column: graphs.append(column) or analyse(df, column))
    assert p2_found(spark, ROOT).columns == ["root_table", "root_key", "path", "parent_path"]
    assert graphs == ["reasons_json", "metadata_json", "sections_json"]


@pytest.mark.parametrize("passes", [2, 12])
def test_no_graph_is_refused(spark, monkeypatch, passes):
    monkeypatch.setattr(nested, "MAX_EDGES", 30)
    monkeypatch.setattr(nested, "MAX_PASSES", passes)
    docs = {f"d{k}": {f"a{k}": {f"b{k}_{j}": {"xs": [{"n": j, f"c{k}": [{}]}, [{f"e{j}": {f"f{k}": 1}}]]} for j in range(3)}, "v": k} for k in range(20)}
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()], "key string, doc string")
    plan = nested.analyse(df, "doc")
    assert isinstance(plan.maps, nested._Every) if passes == 2 else plan.maps
    rows = nested.shred(df, "t", "key", "doc", plan).collect()
    keys = {(r.doc_id, r.path) for r in rows}
    assert len(keys) == len(rows) and all((r.doc_id, r.parent_path) in keys and r.table_name in plan.tables for r in rows)
    assert sum(len(r.columns) for r in rows) == 20 * (1 + 3 * 2)
    assert found(spark, docs={k: json.dumps(v) for k, v in docs.items()}) == {k: brute(v) for k, v in docs.items()}
