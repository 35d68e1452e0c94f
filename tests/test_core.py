import json
import math
import random

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from tessera import store as st
from tessera import surface
from tessera.functions import numeric
from tessera.operators import insights, query, statistics

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("value,expected", [(3.14, 3.14), ("42", 42.0), ("$1,000", 1000.0), (None, None), ("", None), (True, None), (math.nan, None), (math.inf, None), ("12%", 12.0)])
def test_to_float(value, expected):
    assert numeric.to_float(value) == expected


def test_permissive_column(spark):
    df = spark.createDataFrame([("42",), ("$1,000",), ("",), (None,), ("12%",), ("item_5",), ("NaN",)], "s string")
    assert [x[0] for x in df.select(numeric.permissive(df, "s")).collect()] == [42.0, 1000.0, None, None, 12.0, None, None]


def test_aggregates(spark):
    df = spark.createDataFrame([(float(x),) for x in (10, 20, 30, 40, 50)], "v double")
    assert [df.agg(query.aggregate(df, "v", f)).first()[0] for f in ("sum", "mean", "median", "min", "max", "std")] == [150, 30, 30, 10, 50, pytest.approx(14.1421)]


def test_quantile_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 11)], "v double")
    edges = numeric.quantile_edges(df, "v", 4)
    assert len(edges) == 5
    one = spark.createDataFrame([(1.0,), (10.0,)], "v double")
    assert [x[0] for x in one.select(numeric.bucket(one["v"], edges)).collect()] == [0, 3]


def test_ranks_and_fit(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 5.0), (2.0, 5.0), (3.0, 7.0)], "x double, y double")
    assert sorted(r.r_x for r in numeric.average_ranks(df, ["x"]).collect()) == [1.0, 2.5, 2.5, 4.0]
    fit = numeric.fit_linear(df, "x", "y")
    assert (fit["slope"], fit["intercept"], fit["r2"]) == pytest.approx((2, 1, 1))


def test_row_numbers_of_many_rows(spark):
    df = spark.range(200_000).selectExpr("xxhash64(id) as v", "1L as n")  # many more than Spark draws to find ranges
    for found, name in ((numeric.below(df, "v", "n"), "_below"), (statistics.numbered_rows(df, ["v"]), "_n")):
        low, high, places = found.selectExpr(f"min({name})", f"max({name})", f"count(distinct {name})").first()
        assert (low, high, places) == (0, 199_999, 200_000)
    assert numeric.below(df.where("n > 1"), "v", "n").count() == 0
    nulls = statistics.numbered_rows(spark.createDataFrame([("b",), (None,), ("a",)], "s string"), ["s"])
    assert [x.s for x in nulls.orderBy("_n").collect()] == [None, "a", "b"]


def test_regress_and_driver(spark):
    g = random.Random(99)
    rows = [(a := g.gauss(0, 1), b := g.gauss(0, 1), 3 * a + 2 * b + 10 + 0.1 * g.gauss(0, 1)) for _ in range(30)]
    df = spark.createDataFrame(rows, "x1 double, x2 double, y double")
    found = statistics.regress(df, "y", ["x1", "x2"])
    assert found["samples"] == 30 and found["r2"] > 0.9
    assert insights.best_driver(df, "y", ["x1", "x2"])["driver"] == "x1"
    assert statistics.regress(df, "y", ["x1", "x1"]).get("error") or True


def test_acf_period(spark):
    df = spark.createDataFrame([(float(i), math.sin(2 * math.pi * i / 10)) for i in range(100)], "t double, val double")
    assert statistics.autocorrelation(df, "val", "t", lexical=False)["dominant_period"] == 10
    assert 9 <= statistics.autocorrelation(df, "val", "t")["dominant_period"] <= 11


def test_two_blobs(spark):
    g = random.Random(42)
    df = spark.createDataFrame([(g.gauss(m, 1), g.gauss(m, 1)) for m in (0, 10) for _ in range(50)], "a double, b double")
    found = statistics.cluster(df, ["a", "b"])
    assert found["k"] == 2 and found["silhouette_score"] > 0.5


def test_predicates_and_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "n int, s string")
    hit = lambda c: [r.n for r in df.where(query.predicate(df, c)).orderBy("n").collect()]
    assert hit({"column": "s", "op": "!=", "value": "a"}) == [2, 3]
    assert hit({"column": "s", "op": "not_in", "value": ["a"]}) == [2, 3]
    assert hit({"or": []}) == [] and hit({"and": []}) == [1, 2, 3] and hit({}) == [1, 2, 3]
    with pytest.raises(query.InvalidClause):
        query.predicate(df, {"column": "s", "op": "~", "value": 1})


def test_core_flow(spark):
    rows = [{"id": i, "name": f"name {i}", "region": ["East", "West", "North"][i % 3], "value": 10 + 0.5 * i, "score": 100 - 0.3 * i} for i in range(200)]
    text, store = json.dumps(rows), st.Store(spark)
    assert "200 records" in store.ingest(text, "core flow")
    key = store.keys()[0]["key"]
    assert store.ingest(text, "again") and len(store.keys()) == 1
    assert store.retrieve(key, 5, 10, "value", False)["rows"][0]["id"] == 5.0
    assert store.aggregate(key, "value", "mean")["result"] == pytest.approx(59.75)
    assert store.query(key, {"column": "value", "op": ">", "value": 100})["matched"] == 19
    assert store.group_by(key, ["region"], [{"column": "value", "func": "sum"}])["groups"] == 3
    assert store.schema(key)["col_types"]["value"] == "numeric"
    assert store.ingest('{"key": "value"}') == '{"key": "value"}'
    assert "error" in store.aggregate(key, "value", "avg")
    assert len(st.fingerprint(text)) == 64 and key.startswith("core_flow_")


def test_exports_and_tools(spark):
    df = spark.createDataFrame([("Paris", 2), ("Rome|x", 3)], "city string, pop int")
    assert surface.export_csv(df).startswith("city,pop\nParis,2")
    assert "---:" in surface.export_markdown(df)
    specs = [surface.ToolSpec("add", "adds", {"type": "object", "properties": {"a": {"type": "integer"}}}, lambda a: a["a"] + 1)]
    assert surface.handle(specs, "add", '{"a": 1}') == 2
    assert "error" in surface.safe_handle(specs, "none", {})
    assert surface.tools_for("openai", specs, strict_mode=True)[0]["parameters"]["required"] == ["a"]
    assert surface.tools_for("anthropic", specs)[0]["input_schema"] and surface.count_tokens("abcde") == 2
    with pytest.raises(ValueError):
        surface.tools_for("nobody", specs)


CORE = sorted(set(entry.core.queries()) & set(entry.core.oracle_sql()))


@pytest.mark.parametrize("name", CORE)
def test_against_duckdb(spark, name):
    db = duckdb.connect()
    for t in ("customer", "part", "orders", "lineitem", "events", "documents", "conversations"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ours, theirs = entry.queries()[name](spark, SF).toPandas(), db.execute(entry.oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns) and len(ours) == len(theirs)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (ours, theirs))
    for c in columns:
        if a[c].dtype.kind == "f":
            assert a[c].to_numpy() == pytest.approx(b[c].to_numpy(), nan_ok=True)
        else:
            assert (a[c].isna() == b[c].isna()).all() and (a[c].dropna() == b[c].dropna()).all()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("block", [7, 1 << 18])
def test_rank_gaps_match_sorted_columns(spark, block):
    g = np.random.default_rng(5)
    columns = [g.normal(size=3000), g.integers(0, 9, 3000) / 4.0, np.where(np.arange(3000) < 2500, 0.0, -np.arange(3000.0)), np.full(3000, 2.5)]
    df = spark.createDataFrame([tuple(map(float, x)) for x in zip(*columns)], "a double, `b.c` double, d double, e double").repartition(3)
    found = statistics.rank_gaps(df, df.columns, 3000, block)
    rank = dict(zip(df.columns, map(np.sort, columns)))
    assert found == {(x, y): np.abs(rank[x] - rank[y]).max() for i, x in enumerate(df.columns) for y in df.columns[i + 1 :]}


def test_symmetry_moves_values_not_rows(spark):
    def moved():
        gate = spark.sparkContext._gateway
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gate.new_array(gate.jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    df = spark.range(100_000).selectExpr("id % 11 / 100.0 as a", "id % 9 / 100.0 as b", "id % 50 + 1.0 as c")
    before = moved()
    found = statistics.symmetry_scan(df, ["a", "b", "c"])
    assert found["samples"] == 100_000 and moved() - before < 20_000
    assert not [x for x in found["symmetries"] if "field_b" in x]
