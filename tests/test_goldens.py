"""The small corpus of the design document (F1, F2), end to end, by scan and by postings."""

import pytest
from pyspark.sql import functions as F

from foliant.config import FieldConfig, Flag, IndexConfig
from foliant.operators import aggregate as a
from foliant.operators.query import all_, and_, not_, number, number_range, or_, present, token
from foliant.plans.sorting import desc
from foliant.sources.store import Index
from foliant.streaming import live

def made(key, text, tokens, n, **more):
    return {"id": key, "text": text, T: tokens, N: n, S: n, **more}


T, N, S = "token_data", "number_data", "number_data_opt_sort"
CORPUS = [made("12", "lorem ipsum", "abc", 20, unknown_data="ufg about test"), made("13", "dolor", "efg", 30), made("14", "this is a demo", ["abc", "bcd"], 25), made("15", "and it is working", "hij", 10**7)]
CONFIG = IndexConfig({"id": FieldConfig(Flag.STORED), "text": FieldConfig(in_all=False), "token_data": FieldConfig(), "number_data": FieldConfig(), "number_data_opt_sort": FieldConfig(Flag.SORTED)})
ABC, EFG, BCD = token("abc", T), token("efg", T), token("bcd", T)
TOP = (1 << 53) - 1


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    made = Index(spark, str(tmp_path_factory.mktemp("index")), CONFIG)
    assert made.add(CORPUS) == 4
    return made


@pytest.fixture(scope="module")
def postings(index):
    return index.snapshot().postings().cache()


CASES = [
    (ABC, "12 14"), (or_(ABC, EFG), "12 13 14"), (or_(ABC, BCD), "12 14"), (and_(ABC, EFG), ""), (and_(ABC, BCD), "14"),
    (number(2000, N), ""), (number(20, N), "12"), (number(10000000, N), "15"), (number(30.9, N), "13"), (number(25, N), "14"),
    (number_range(N, 20, 30, False, True), "13 14"), (number_range(N, 20, 30, True, True), "12 13 14"), (number_range(N, 20, 30), "12 14"), (number_range(N, 20, 26), "12 14"),
    (number_range(N, 30, 10000000, True, True), "13 15"), (number_range(N, 30, TOP, True, True), "13 15"), (number_range(N, -TOP, 30), "12 14"), (number_range(N, None, 30), "12 14"),
    (number_range(N, 30, float("inf"), True, True), "13 15"), (number_range(N, 0, None), "12 13 14 15"), (and_(or_(ABC, EFG)), "12 13 14"), (and_(or_(ABC, EFG), ABC), "12 14"),
    (not_(ABC), "13 15"), (and_(ABC, not_(BCD)), "12"), (present("unknown_data"), "12"), (not_(present("unknown_data")), "13 14 15"),
    (token("test", "unknown_data"), "12"), (token("lorem"), ""), (token("about"), ""), (token("ufg"), "12"), (token(["ufg", "hij"], "_all"), "12 15"), (number(30), "13"), (and_(), "12 13 14 15"), (or_(), "12 13 14 15"),
]


@pytest.mark.parametrize("query, expected", CASES, ids=lambda x: None)
def test_queries(index, postings, query, expected):
    want = expected.split()
    got = [r.id.strip('"') for r in index.query(query, projection=["id"]).collect()]
    assert sorted(got) == want
    now = index.snapshot()
    assert sorted(r.id.strip('"') for r in now.query_postings(query, postings, ["id"]).collect()) == want


@pytest.mark.parametrize("sort, limit, expected", [(["id"], 2, "12 13"), ([desc("id")], None, "15 14 13 12"), ([S], 2, "12 14"), ([desc(S)], 0, "15 13 14 12"), (["id"], 1, "12"), ([desc("id")], 1, "15")])
def test_order(index, sort, limit, expected):
    assert [r.id.strip('"') for r in index.query(all_(), sort, limit, ["id"]).collect()] == expected.split()


def test_source_fields_and_sort_checks(index):
    import json

    rows = index.query(all_()).orderBy("_id").collect()
    assert [json.loads(r._source) for r in rows] == CORPUS
    assert [r._id for r in rows] == [0, 1, 2, 3]
    assert "unknown_data" in index.names()
    with pytest.raises(ValueError):
        index.query(all_(), [N])
    assert index.query(all_(), projection=[N]).first()[N] is None  # not stored


def test_aggregates(index):
    level, groups = index.aggregate(all_(), [a.count(), a.first([S], ["id"]), a.last([S], ["id"]), a.group_by(T, [a.count("n")])])
    r = level.first()
    assert (r["count"], r["first"]._id, r["last"]._id) == (4, 0, 3)
    assert {x[T]: x.n for x in groups.collect()} == {"abc": 2, "efg": 1, "hij": 1}
    none = index.aggregate(token("zzz", T), [a.count(), a.first([S])])[0].first()
    assert none["count"] == 0 and none["first"] is None
    terms = index.aggregate(all_(), [a.bucket_term(T, [a.count("n")])])[0]
    assert {x[T]: x.n for x in terms.collect()} == {"abc": 2, "bcd": 1, "efg": 1, "hij": 1}


def test_terms(index):
    assert [r.term for r in index.snapshot().terms(T).collect()] == ["abc", "bcd", "efg", "hij"]


def test_forms_of_adding_deleting_compacting_reopening(spark, tmp_path):
    path = str(tmp_path / "i")
    ix = Index(spark, path)
    assert ix.size() == 0 and ix.names() == []
    assert ix.add({"id": "1", "flag": "true"}) == 1
    assert ix.add(x for x in [{"id": "2", "flag": 7}]) == 1
    assert ix.add(spark.createDataFrame([("3", 1), ("4", 2)], "id string, flag long")) == 2
    assert ix.add(["no json", '{"id": "5"}', "[1]", '{"a": '.ljust(5) + "[" * 3000]) == 4
    assert ix.size() == 8
    assert sorted(r._id for r in ix.query(all_()).collect()) == list(range(8))
    assert ix.query(token("true", "flag")).count() == 1 and ix.query(number(7, "flag")).count() == 1
    ix.delete([0, 2])
    assert ix.size() == 6 and ix.snapshot(3).size() == 8
    again = Index(spark, path)
    assert again.size() == 6
    small = again.compact(str(tmp_path / "j"), files=1)
    assert sorted(r._id for r in small.query(all_()).collect()) == [1, 3, 4, 5, 6, 7]
    assert small.add({"id": "9"}) == 1 and small.query(present("id")).agg(F.max("_id")).first()[0] == 8


def test_two_writers_of_one_commit(spark, tmp_path):
    ix = Index(spark, str(tmp_path / "i"))
    ix.add({"a": 1})
    with pytest.raises(RuntimeError):
        ix._enter({"commit_id": 0, "start": 0, "n": 0, "names": []})


def test_generators_override(spark, tmp_path):
    config = IndexConfig({"shout": FieldConfig(Flag.SEARCHABLE, generator=lambda: F.upper(F.get_json_object("_source", "$.a")))})
    ix = Index(spark, str(tmp_path / "i"), config)
    ix.add([{"a": "x", "shout": "old"}, {"a": "y"}])
    assert ix.query(token("X", "shout")).count() == 1 and ix.query(token("old", "shout")).count() == 0


def run(stream, name, spark):
    stream.writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_modes(spark, tmp_path):
    ix = Index(spark, str(tmp_path / "i"), CONFIG)
    ix.add(CORPUS)
    with pytest.raises(ValueError):
        live.query(ix, all_(), sort=["id"], mode=live.Mode.FUTURE)
    future = live.query(ix, ABC, projection=["id"], mode=live.Mode.FUTURE)
    both = live.query(ix, ABC, projection=["id"], mode=live.Mode.BOTH)
    split = live.query(ix, ABC, ["id"], 1, ["id"], live.Mode.BOTH)
    now = live.query(ix, ABC, projection=["id"])
    ix.add([{"id": "16", "token_data": "abc"}, {"id": "17", "token_data": "zzz"}])
    assert [r._id for r in run(future.future, "future", spark).collect()] == [4]
    assert sorted(r._id for r in run(both.future, "both", spark).collect()) == [0, 2, 4]
    assert [r._id for r in split.current.collect()] == [0]
    assert [r._id for r in run(split.future, "split", spark).collect()] == [4]
    assert sorted(r._id for r in now.current.collect()) == [0, 2]
    bounded = live.query(ix, ABC, limit=2, mode=live.Mode.BOTH)
    assert run(bounded.future, "bounded", spark).count() == 2


def test_running_counts(spark, tmp_path):
    ix = Index(spark, str(tmp_path / "i"), CONFIG)
    ix.add(CORPUS)
    live.counts(ix, all_(), T).writeStream.format("memory").outputMode("complete").queryName("running").trigger(availableNow=True).start().awaitTermination()
    assert {r[T]: r["count"] for r in spark.table("running").collect()} == {"abc": 2, "efg": 1, "hij": 1}
