"""Flattening, analysers, orders, the simplifier, and random queries against an evaluator of sets."""

import json
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.config import FieldConfig, Flag, IndexConfig
from foliant.functions import analyzers as an
from foliant.functions.flatten import flatten, open_fields, paths
from foliant.operators import query as q
from foliant.operators.collection import Collection
from foliant.operators.fields import OpenFields
from foliant.operators import aggregate as a
from foliant.plans.sorting import asc, desc


def test_flatten():
    doc = {
        "key": "k", "stamp": 1585561328882.001, "none": None, "deep": {"n": 5, "flag": True, "list": ["one"], "empty": []},
        "links": [{"to": "a", "deps": {"x": "1"}}, {"to": "b", "size": 0}, {"to": "c", "deps": {"x": "2"}}, ["d", "e"]],
        "mixed": [1.5, "s", {"z": 0}], "huge": 1e300, "nan": math.nan,
    }
    assert flatten(doc) == {
        "key": "k", "stamp": 1585561328882, "deep.n": 5, "deep.flag": True, "deep.list": ["one"], "deep.empty": [],
        "links.to": ["a", "b", "c"], "links.deps.x": ["1", "2"], "links.size": 0, "links.0": "d", "links.1": "e",
        "mixed": [1, "s"], "mixed.z": 0,
    }
    assert flatten({}) == {}


def test_typed_paths(spark):
    df = spark.createDataFrame([(1, {"b": [{"c": "x", "d": 1}, {"c": None, "d": 2}], "e": 2.9}, bytearray(b"z"))], "id long, a struct<b:array<struct<c:string,d:int>>,e:double>, raw binary")
    p = paths(df.schema)
    assert set(p) == {"id", "a.b.c", "a.b.d", "a.e"}
    r = df.select(p["a.b.c"].column.alias("c"), p["a.b.d"].column.alias("d")).first()
    assert r.c == ["x"] and r.d == [1, 2]
    c = Collection.of(df, "id", IndexConfig(default=FieldConfig()))
    assert c.query(q.number(2, "a.e")).count() == 1 and c.query(q.number(2, "a.b.d") & q.token("x", "a.b.c")).count() == 1
    assert c.query(q.present("raw")).count() == 0


def test_analyzers(spark):
    df = spark.createDataFrame([("  Hello, the\tWORLD-wide web. ",), ("",), (None,), ("THE end.",)], "t string")

    def terms(f):
        return [r[0] for r in df.select(f(F.col("t"))).collect()]

    assert terms(an.standard) == [["hello", "the", "world", "wide", "web", ""], [""], None, ["the", "end", ""]]
    assert terms(an.stopped(an.standard)) == [["hello", "world", "wide", "web"], [], None, ["end"]]
    assert terms(an.lowered(an.keyword))[3] == ["the end."]
    lex = an.lexer([("SPACE", r"\s+"), ("NUMBER", r"[0-9]+"), ("TOKEN", r"[A-Za-z]+"), ("MARK", r"[,.-]")])
    assert terms(lex)[0] == ["Hello", "the", "WORLD", "wide", "web"]
    assert len(an.STOP_WORDS) == 120 and "constructor" not in an.STOP_WORDS
    with pytest.raises(ValueError):
        an.lexer([("TOKEN", "(a)")])


def test_simplify():
    x, y = q.token("x"), q.token("y")
    assert q.simplify(q.not_(q.not_(x))) == x
    assert q.simplify(q.and_(x, q.and_(x, q.all_()))) == x
    assert q.simplify(q.and_(x, q.not_(x))) == q.Nothing() and q.simplify(q.or_(x, q.not_(x))) == q.All()
    assert q.simplify(q.or_(x, q.or_(y, q.Nothing()))) == q.Or((x, y))
    assert q.number_range("f", 5, 5) == q.Nothing() and q.number_range("f", 2.5, 4.5) == q.InRange("f", 3, 4)
    assert q.number_range("f", 64, 70) == q.InRange("f", 64, 69) and q.number_range("f", 0, None) == q.InRange("f", 0, None)
    with pytest.raises(ValueError):
        q.number_range("f")


@pytest.mark.parametrize("edge", [(1 << 53) - 1, -((1 << 53) - 1), 0, 1, -1, 1 << 6, 1 << 12, 1 << 18, 1 << 24, 1 << 30, 1 << 36, 1 << 42])
def test_number_edges(spark, edge):
    df = spark.createDataFrame([(i, v, float(v)) for i, v in enumerate([edge - 1, edge, edge + 1])], "id long, n long, f double")
    c = Collection.of(df, "id", IndexConfig(default=FieldConfig()))
    safe = [i for i, v in enumerate([edge - 1, edge, edge + 1]) if abs(v) < 1 << 53]
    assert [r._id for r in c.query(q.number(edge, "n")).collect()] == [1]
    assert sorted(r._id for r in c.query(q.number_range("n", edge, None)).collect()) == [i for i in safe if i >= 1]
    assert sorted(r._id for r in c.query(q.number_range("n", None, edge)).collect()) == [i for i in safe if i < 1]


def test_floats_floor_and_drop_what_is_no_number(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([2.9, -0.1, math.nan, math.inf, None, 3.0, 1e300])], "id long, f double")
    c = Collection.of(df, "id", IndexConfig(default=FieldConfig()))
    got = lambda x: sorted(r._id for r in c.query(x).collect())
    assert got(q.number(2, "f")) == [0] and got(q.number(-1, "f")) == [1]
    assert got(q.number_range("f", 0, None)) == [0, 5] and got(q.number_range("f", None, 3)) == [0, 1]
    assert got(q.not_(q.number(2, "f"))) == [1, 2, 3, 4, 5, 6]


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).select(F.col("id"), (F.col("id") % 7).alias("n"), F.lit("big").alias("body"), F.col("id").cast("string").alias("s")).write.parquet(str(tmp_path / "t"))
    c = Collection.of(spark.read.parquet(str(tmp_path / "t")), "id", IndexConfig(default=FieldConfig()))
    plan = c.query(q.and_(q.number_range("n", 3, 5), q.token("17", "s")), projection=["n"])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(n,3)" in plan and "EqualTo(s,17)" in plan and "body" not in plan


def test_order_of_kinds_and_collation(spark):
    docs = [{"v": "b"}, {"v": 2}, {"v": False}, {}, {"v": True}, {"v": "A"}, {"v": "É"}, {"v": -1}, {"v": ["z", 1]}, {"v": "a"}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "_id long, _source string")
    c = Collection(open_fields(df), OpenFields(["v"], IndexConfig(default=FieldConfig(Flag.STORED))))
    assert [r._id for r in c.query(q.all_(), [asc("v")]).collect()] == [3, 4, 2, 7, 8, 1, 5, 9, 0, 6]  # of ["z", 1] the number counts
    strings = spark.createDataFrame([(0, "b"), (1, "a"), (2, "B"), (3, "Ä"), (4, None), (5, "A")], "id long, s string")
    t = Collection.of(strings, "id", IndexConfig(default=FieldConfig(Flag.STORED)))
    assert [r._id for r in t.query(q.all_(), ["s"]).collect()] == [4, 1, 3, 5, 0, 2]
    assert [r._id for r in t.query(q.all_(), [desc("s")]).collect()] == [0, 2, 1, 3, 5, 4]
    flags = spark.createDataFrame([(0, False), (1, True), (2, None)], "id long, b boolean")
    assert [r._id for r in Collection.of(flags, "id").query(q.all_(), ["b"]).collect()] == [2, 1, 0]


def test_first_and_last_ties_nulls_and_mixed_order(spark):
    df = spark.createDataFrame([(0, "g", 1, "x"), (1, "g", 1, "y"), (2, "g", None, "z"), (3, "h", 2, "w"), (4, None, 5, "v")], "id long, g string, k int, s string")
    c = Collection.of(df, "id", IndexConfig(default=FieldConfig(Flag.STORED)))
    parts = [a.first(["k"], [], "lo"), a.last(["k"], [], "hi"), a.first([desc("k")], [], "top"), a.last([desc("k")], [], "end"), a.first(["k", desc("s")], [], "mix"), a.last(["k", desc("s")], [], "xim")]
    rows = {r.g: [r[n]._id for n in ("lo", "hi", "top", "end", "mix", "xim")] for r in c.aggregate(q.all_(), [a.group_by("g", parts)])[0].collect()}
    assert rows == {"g": [2, 0, 0, 2, 2, 0], "h": [3] * 6, None: [4] * 6}
    flat = c.aggregate(q.all_(), [a.group_by("g", [a.count("n"), a.group_by("k", [a.count("m")])])])
    assert [d.columns for d in flat] == [["g", "n"], ["g", "k", "m"]]
    assert a.nested(flat[1], ["g"]).count() == 3
    with pytest.raises(ValueError):
        Collection.of(spark.createDataFrame([(0, [1])], "id long, v array<int>"), "id").aggregate(q.all_(), [a.group_by("v", [a.count()])])


def test_named_filters_kept(spark, tmp_path):
    df = spark.createDataFrame([(i, "en" if i % 2 else "de", i) for i in range(10)], "id long, lang string, n int")
    c = Collection.of(df, "id", IndexConfig(default=FieldConfig(Flag.SEARCHABLE | Flag.STORED)))
    en = c.register("english", q.token("en", "lang"))
    assert c.query(en & q.number_range("n", 5, None)).count() == 3
    kept = c.kept("english", str(tmp_path / "kept"))
    assert kept.size() == 5 and kept.query(q.number_range("n", 5, None)).count() == 3


WORD = st.sampled_from(["a", "b", "c", "d"])
DOC = st.fixed_dictionaries({}, optional={"t": st.lists(WORD, max_size=3), "n": st.lists(st.integers(-3, 70), min_size=1, max_size=2), "f": st.booleans()})
LEAF = st.one_of(
    st.builds(lambda w: q.token(w, "t"), st.lists(WORD, min_size=1, max_size=2)), st.builds(lambda n: q.number(n, "n"), st.integers(-3, 70)), st.builds(lambda f: q.token(f, "f"), st.booleans()),
    st.builds(lambda f: q.present(f), st.sampled_from(["t", "n", "f"])), st.builds(lambda x, y: q.number_range("n", x, y), st.integers(-3, 70), st.integers(-3, 70)), st.just(q.all_()),
)
TREE = st.recursive(LEAF, lambda x: st.one_of(st.builds(q.not_, x), st.builds(lambda p: q.and_(*p), st.lists(x, max_size=3)), st.builds(lambda p: q.or_(*p), st.lists(x, max_size=3))), max_leaves=6)


def holds(x, doc):
    if isinstance(x, q.All):
        return True
    if isinstance(x, q.Nothing):
        return False
    if isinstance(x, q.HasToken):
        have = doc.get(x.field)
        return any(v in have if isinstance(have, list) else have is v for v in x.values) if have is not None else False
    if isinstance(x, q.HasNumber):
        return x.value in doc.get("n", [])
    if isinstance(x, q.InRange):
        return any(x.low <= v <= x.high for v in doc.get("n", []))
    if isinstance(x, q.Present):
        return x.field in doc and doc[x.field] != []
    if isinstance(x, q.Not):
        return not holds(x.part, doc)
    return (all if isinstance(x, q.And) else any)(holds(p, doc) for p in x.parts)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(DOC, min_size=1, max_size=8), st.lists(TREE, min_size=1, max_size=4))
def test_random_queries(spark, docs, trees):
    config = IndexConfig(default=FieldConfig())
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "_id long, _source string")
    loose = Collection(open_fields(rows), OpenFields(["t", "n", "f"], config))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("t", T.ArrayType(T.StringType())), T.StructField("n", T.ArrayType(T.LongType())), T.StructField("f", T.BooleanType())])
    tight = Collection.of(spark.createDataFrame([(i, d.get("t"), d.get("n"), d.get("f")) for i, d in enumerate(docs)], schema), "id", config)
    tight.fields.paths.pop("id")
    index = tight.postings()
    for tree in trees:
        want = [i for i, d in enumerate(docs) if holds(tree, d)]
        assert sorted(r._id for r in loose.query(tree).collect()) == want
        assert sorted(r._id for r in tight.query(tree).collect()) == want
        assert sorted(r._id for r in tight.query_postings(tree, index, []).collect()) == want


def test_matches_equal_terms(spark):
    texts = ["the end", "The-end", "bathe", "a.the", "the", "\nthe\n", "x the. y", "", None, "re:the;b", "the\x0bz", "it's the\\E", "THE", " the", "th e", "a\\Eb c"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    for make in (an.standard, an.stopped(an.standard)):
        for term in ["the", "end", "", "THE", "x the", "it's", "the\\e", "a\\eb", "c", "z", " the"]:
            quick = make.matches(F.col("t"), term)
            if quick is not None:
                both = df.select(F.coalesce(quick, F.lit(False)), F.coalesce(F.array_contains(make(F.col("t")), term), F.lit(False))).collect()
                assert [r[0] for r in both] == [r[1] for r in both], term


def test_numbers_among_tokens(spark):
    df = spark.createDataFrame([(0, True, 1), (1, False, 0), (2, None, 5)], "id long, b boolean, n int")
    c = Collection.of(df, "id", IndexConfig(default=FieldConfig()))
    got = lambda x: sorted(r._id for r in c.query(x).collect())
    assert got(q.token([5, 1.5], "n")) == [0, 2] and got(q.token(True, "b")) == [0] and got(q.token([True, 1], "b")) == [0]
    assert got(q.and_(q.token(True, "b"), q.token(1, "n"))) == [0] and got(q.token([], "b")) == []
