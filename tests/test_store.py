"""The index on storage: commits of several writers, crashes, streams, postings against scans; first and last by any kind of _id."""

import json

import pytest
from pyspark.sql import functions as F

from foliant.config import FieldConfig, Flag, IndexConfig
from foliant.functions.analyzers import standard
from foliant.functions.flatten import flatten, mapped
from foliant.operators import aggregate as a
from foliant.operators import query as q
from foliant.operators.collection import Collection
from foliant.plans.postings import leading, unpacked, write
from foliant.plans.sorting import desc
from foliant.sources.store import Index
from foliant.streaming import live

CONFIG = IndexConfig({"t": FieldConfig(Flag.SEARCHABLE, analyzer=standard), "hid": FieldConfig(Flag.STORED, in_all=False)}, default=FieldConfig(Flag.SEARCHABLE | Flag.STORED))


def found(rows):
    return sorted(r._id for r in rows.collect())


def test_a_losing_writer_touches_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "i")
    first, stale = Index(spark, path, CONFIG), Index(spark, path, CONFIG)
    monkeypatch.setattr(stale, "commits", lambda: [])  # it looked before the first had written
    assert first.add({"a": "first"}) == 1
    with pytest.raises(RuntimeError):
        stale.add([{"a": "second"}, {"a": "third"}])
    with pytest.raises(RuntimeError):
        stale.delete([0])
    rows = Index(spark, path, CONFIG).query(q.all_()).collect()
    assert [(r._id, json.loads(r._source)) for r in rows] == [(0, {"a": "first"})]
    assert not list((tmp_path / "i" / "staged").iterdir())


def test_crashes_around_the_log_entry(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "i")
    index = Index(spark, path, CONFIG)
    index.add({"a": "one"})

    def lost(*_, **__):
        raise KeyboardInterrupt

    broken = Index(spark, path, CONFIG)
    monkeypatch.setattr(broken, "_enter", lost)
    with pytest.raises(KeyboardInterrupt):
        broken.add({"a": "orphan"})
    moving = Index(spark, path, CONFIG)
    monkeypatch.setattr(moving, "_publish", lost)
    with pytest.raises(KeyboardInterrupt):
        moving.add({"a": "two"})  # committed, though not moved
    again = Index(spark, path, CONFIG)
    assert found(again.query(q.all_())) == [0, 1] and found(again.query(q.token("orphan", "a"))) == [] and found(again.query(q.token("two", "a"))) == [1]
    stream = live.query(again, q.all_(), projection=["a"], mode=live.Mode.BOTH).future
    stream.writeStream.format("memory").queryName("both").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r._id, r.a) for r in spark.table("both").collect()) == [(0, '"one"'), (1, '"two"')]


def test_batches_and_streams_of_documents(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"), CONFIG)
    assert index.add(({"n": k} for k in range(7)), batch=3) == 7 and [c["n"] for c in index.commits()] == [3, 3, 1]
    assert index.add(({"n": k} for k in range(7)), batch=3, label="x") == 7 and index.add(({"n": k} for k in range(8)), batch=3, label="x") == 0
    assert index.add([]) == 0 and index.size() == 14
    assert [json.loads(r._source)["n"] for r in index.query(q.all_()).orderBy("_id").collect()] == [*range(7), *range(7)]
    spark.range(5).select((F.col("id") + 100).alias("n")).write.json(str(tmp_path / "in"))
    for _ in range(2):
        index.follow(spark.readStream.schema("n long").json(str(tmp_path / "in")), str(tmp_path / "check")).awaitTermination()
    assert index.size() == 19 and len(found(index.query(q.number_range("n", 100, None)))) == 5
    with pytest.raises(ValueError):
        index.add([], batch=0)


DOCS = [
    {"t": "the red fox", "n": 1, "f": True, "k": "A"}, {"t": "the dog", "n": [2, 9], "hid": "x"}, {"t": "", "k": ["A", "B"]}, {}, {"t": "Red-dog", "n": 0, "f": False}, {"deep": [{"w": "one"}, {"w": "the"}]}, {"hid": 7, "n": 2.9}, {"t": ["the the", "fox"]},
]
QUERIES = [
    q.token("the", "t"), q.token("red", "t") & q.token("dog", "t"), q.token(["fox", "dog"], "t") & q.not_(q.token("the", "t")), q.number(2, "n"), q.number_range("n", 0, 3) & q.present("f"), q.present("t"), q.present("hid"), q.present("k"),
    q.token("x", "hid"), q.token(True, "f"), q.token("one"), q.token(9) | q.token("fox"), q.token("A", "k") & q.token("red"), q.token("a"), q.not_(q.present("n")), q.token_range("t", "d", "g"), q.Nothing(), q.all_(), q.token("x"), q.present("deep.w") & q.token("the", "deep.w"),
]


def test_stored_postings_equal_scans(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"), CONFIG)
    index.add(DOCS[:5])
    index.add(DOCS[5:])
    index.delete([1])
    now = index.snapshot()
    scan = Collection(now.df, now.fields, True)
    answered = 0
    for x in QUERIES:
        ids = leading(x, now.index, now.df, 1000)
        answered += ids is not None
        want = found(scan.query(x, projection=[]))
        assert ids is None or found(now.df.join(ids, "_id", "left_semi")) == want, x
        assert found(now.query(x, projection=[])) == want, x
    assert answered >= 15
    other = Index(spark, str(tmp_path / "i"), IndexConfig(default=FieldConfig(Flag.STORED)))
    assert other.snapshot().index is None  # these postings were made under another configuration
    small = index.compact(str(tmp_path / "j"), 2)
    assert found(small.query(q.token("the", "t"))) == [0, 7] and small.size() == 7 and small.add({"t": "the"}) == 1 and found(small.query(q.token("the", "t"))) == [0, 7, 8]


def test_terms_of_each_kind(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"), CONFIG)
    index.add(DOCS)
    now = index.snapshot()
    assert [r.term for r in now.terms("n", "n").collect()] == [0, 1, 2, 9] and [r.term for r in now.terms("f", "b").collect()] == [False, True] and [r.term for r in now.terms("k").collect()] == ["A", "B"]


@pytest.mark.parametrize(
    "kind, ids",
    [("string", ["a", "ab", "b"]), ("struct<x:int,y:string>", [(1, "z"), (2, None), (2, "a")]), ("array<int>", [[1], [1, 0], [2]]), ("date", None), ("timestamp", None), ("boolean", [None, False, True]), ("bigint", [-(1 << 63), 0, (1 << 63) - 1]), ("double", [-1.5, 0.0, 2.0]), ("binary", [b"", b"\x01", b"\xff"])],
)
def test_first_and_last_by_any_id(spark, kind, ids):
    if ids is None:
        rows = spark.range(3).select((F.lit("2020-01-01").cast("date") + F.col("id").cast("int")).cast(kind).alias("id"), F.lit(1).alias("k"))
        ids = [r.id for r in rows.orderBy("id").collect()]
    else:
        rows = spark.createDataFrame([(i, 1) for i in ids], f"id {kind}, k int")
    c = Collection.of(rows, "id", IndexConfig(default=FieldConfig(Flag.STORED)))
    r = c.aggregate(q.all_(), [a.first(["k"], [], "w"), a.last(["k"], [], "x"), a.first([desc("k")], [], "y"), a.last([desc("k")], [], "z")])[0].first()
    got = [r[n]._id for n in "wxyz"]
    as_plain = lambda v: tuple(v) if kind.startswith("struct") else bytes(v) if kind == "binary" and v is not None else v
    assert [as_plain(v) for v in got] == [ids[0]] * 4


def test_held_filters_are_read_not_computed(spark, tmp_path):
    df = spark.createDataFrame([(i, "en" if i % 2 else "de", i) for i in range(10)], "id long, lang string, n int")
    c = Collection.of(df, "id", IndexConfig(default=FieldConfig(Flag.SEARCHABLE | Flag.STORED)))
    en = c.register("english", q.token("en", "lang"))
    c.hold("english", str(tmp_path / "held"))
    rows = c.query(en & q.number_range("n", 5, None))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "lang#" in plan and "= en" not in plan and found(rows) == [5, 7, 9]
    assert found(c.query(q.not_(en) & q.number_range("n", 5, None))) == [6, 8] and found(c.query(en | q.number(0, "n"))) == [0, 1, 3, 5, 7, 9]


def test_postings_are_written_packed(spark, tmp_path, monkeypatch):
    """A row for a value and not for each of its documents, made in one pass; what a lookup asks reaches the files."""
    df = spark.createDataFrame([(k, ["the fox", "the the", None, "", "of The fox", f"w{k}"][k % 6], k % 3 or None) for k in range(60)], "id long, t string, n int").coalesce(1)
    c = Collection.of(df, "id", CONFIG)
    write(c.values(), str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    rows = lambda x: sorted(map(tuple, x.collect()), key=repr)
    index = unpacked(stored)
    assert rows(index) == rows(c.postings()) and stored.count() == index.drop("_id").distinct().count() < index.count() / 3
    asked = leading(q.token("the", "t") & q.not_(q.token("of", "t")), index, c.df)
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert found(asked) == [k for k in range(60) if k % 6 < 2] and "EqualTo(term,the)" in plan and "EqualTo(term,of)" in plan
    for block in (1, 7):  # of few values
        small = list(_small_blocks(monkeypatch, c.values(), block))
        assert sorted({(*r[:4], i) for r in small for i in r[4]}, key=repr) == rows(index)


def _small_blocks(monkeypatch, values, block):
    from foliant.plans import postings as p

    monkeypatch.setattr(p, "BLOCK", block)
    for b in p._pack(iter(values.toArrow().to_batches())):
        yield from zip(*b.to_pydict().values())


def test_an_index_packs_its_postings(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"), CONFIG)
    index.add([{"t": "the fox", "n": k % 2, "f": True} for k in range(50)] + ["no object"])
    stored = spark.read.parquet(str(tmp_path / "i" / "terms"))
    assert stored.count() < 20 and index.snapshot().index.count() > 400
    assert found(index.query(q.number(1, "n") & q.token("fox"))) == list(range(1, 50, 2))


def test_fields_are_mapped_by_columns():
    """Whole batches of flattened documents at once, with what each document has kept apart."""
    docs = [{"a": 1.5, "b": "x", "c": True}, {}, {"a": [], "b": None}, {"a": [1, True, "x", {"b": 2}, [3]]}, {"a": {"b": [{"c": "d"}, {"c": 5}]}, "": 1e300}, {"n": float("inf"), "m": -0.5}]
    e = {"s": [], "n": [], "b": []}
    want = [[("a", e | {"n": [1]}), ("b", e | {"s": ["x"]}), ("c", e | {"b": [True]})], [], [("a", e)], [("a", {"s": ["x"], "n": [1], "b": [True]}), ("a.b", e | {"n": [2]}), ("a.0", e | {"n": [3]})], [("a.b.c", {"s": ["d"], "n": [5], "b": []})], [("m", e | {"n": [-1]})]]
    assert mapped([flatten(d) for d in docs]).to_pylist() == want and mapped([]).to_pylist() == []


def test_space_before_a_last_line_mark(spark):
    """As in the SQL, only white space at the very ends is trimmed."""
    assert spark.range(1).select(standard(F.lit(" \t\x0bAbc \u0085")).alias("t")).first().t == ["abc", "\u0085"]
