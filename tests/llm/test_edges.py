"""Nulls, empty and very long texts, repeated rows, empty tables and clashing names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import ann, decontam, langid, mixing, neardup, pii, sharding, tokencount, toxicity, warc
from foliant.llm.shared import Scratch, hashed_words, shared_folder
from tests.llm import nasty

FIT = toxicity.Fit(per_class=20, own_threshold=2)


def bench(spark, rows=((0, None), (None, "x y z u v w"), (1, ""), (2, "a b"), (3, nasty.prose(2, 60)), (3, nasty.prose(2, 60)))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


OPERATORS = {
    "pii": lambda spark, d: pii.identifiers(d),
    "token_counts": lambda spark, d: tokencount.token_counts(d, "doc_id"),
    "langid": lambda spark, d: langid.identify(d, langid.train(*langid.training_rows(d, langid.Fit(per_language=5)), langid.Fit())),
    "toxicity": lambda spark, d: toxicity.score(d, nasty.labels(spark), FIT),
    "reject_toxic": lambda spark, d: toxicity.reject_toxic(d, nasty.labels(spark), FIT),
    "shuffle": lambda spark, d: sharding.shuffle(d, bucket_bytes=1 << 20),
    "mix": lambda spark, d: mixing.mix(d, 0.5),
    "leaks": lambda spark, d: decontam.leaks(d, bench(spark)),
    "drop_leaks": lambda spark, d: decontam.drop_leaks(d, bench(spark)),
    "near_duplicates": lambda spark, d: neardup.near_duplicates(d),
    "drop_near_duplicates": lambda spark, d: neardup.drop_near_duplicates(d),
}


def key(r):
    return repr(tuple(r))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], nasty.SCHEMA)).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_change_nothing(spark, name):
    plain = OPERATORS[name](spark, nasty.documents(spark))
    wide = OPERATORS[name](spark, nasty.clashing(nasty.documents(spark)))
    if name in ("reject_toxic", "mix", "drop_leaks", "drop_near_duplicates"):
        assert wide.columns == nasty.clashing(nasty.documents(spark)).columns
        assert all(r["gone"] == "kept gone" for r in wide.collect())
    if name == "shuffle":  # another record hash, hence other shards
        wide, plain = wide.drop("shard", "position"), plain.drop("shard", "position")
    assert sorted(map(key, wide.select(plain.columns).collect())) == sorted(map(key, plain.collect()))


def test_hashed_words_in_pieces(monkeypatch):
    import foliant.llm.shared as shared

    texts = [r[1] for r in nasty.rows()]
    whole, at = hashed_words(texts)
    monkeypatch.setattr(shared, "PIECE", 1000)
    parts, also = hashed_words(texts)
    assert (whole == parts).all() and (at == also).all()
    assert at[1] == 0 and at[2] == 0


def test_token_counts(spark):
    got = {(r.doc_id, r.bytes): r.tokens for r in tokencount.token_counts(nasty.documents(spark), "doc_id").collect()}
    assert got[1, None] is None and got[2, 0] == 0 and got[4, len(nasty.LONG)] > 250_000
    assert len([k for k in got if k[0] == 6]) == 1 and tokencount.token_counts(nasty.documents(spark), "doc_id").count() == len(nasty.rows())


def test_langid_without_letters(spark):
    got = {r.doc_id: r for r in OPERATORS["langid"](spark, nasty.documents(spark)).filter("doc_id is not null").collect()}
    for i in (1, 2, 3, 9):
        assert got[i].language is None and got[i].ambiguous
    assert got[4].language is not None


def test_toxicity_of_wordless_texts(spark):
    got = {r.doc_id: r for r in OPERATORS["toxicity"](spark, nasty.documents(spark)).filter("doc_id is not null").collect()}
    for i in (1, 2, 3, 9):
        assert got[i].score is None and got[i].toxic is False
    assert got[4].score is not None


def test_toxicity_without_labels_of_both_kinds(spark):
    docs = nasty.documents(spark)
    for lab in (nasty.labels(spark).filter("toxic = 0"), nasty.labels(spark).limit(0)):
        assert toxicity.score(docs, lab, FIT).filter("toxic").count() == 0


def test_near_duplicates_of_odd_texts(spark):
    got = {r.doc_id: r.group_id for r in neardup.near_duplicates(nasty.documents(spark)).collect()}
    assert got == {6: 6, 7: 6, 8: 6, 11: 11, 12: 11}
    kept = neardup.drop_near_duplicates(nasty.documents(spark)).collect()
    assert sorted([r.doc_id for r in kept if r.doc_id is not None]) == [-13, 1, 2, 3, 4, 5, 6, 9, 10, 11]
    assert len([r for r in kept if r.doc_id is None]) == 2


def test_leaks_of_odd_texts(spark):
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(nasty.documents(spark), bench(spark)).collect()} == {(-13, 3)}
    assert decontam.leaks(nasty.documents(spark), bench(spark, [(1, None)])).collect() == []
    assert decontam.drop_leaks(nasty.documents(spark), bench(spark)).count() == len(nasty.rows()) - 1


def test_mixing_odd_sources(spark):
    docs = nasty.documents(spark)
    everything = mixing.mix(docs, 1.0, {"a": 1.0, "b": 0.0})
    kept = {r.source for r in everything.collect()}
    assert "a" in kept
    with pytest.raises(ValueError):
        mixing.mix(docs, 1.0, {"a": -1.0})
    assert mixing.mix(docs, 100.0).count() == docs.count()
    assert mixing.mix(docs, 0.0).filter(F.length(F.trim("text")) > 3).count() == 0


def test_sharding_keeps_every_row(spark):
    docs = nasty.documents(spark)
    out = sharding.shuffle(docs, 1 << 20)
    assert sorted(map(key, out.select(docs.columns).collect())) == sorted(map(key, docs.collect()))
    at = [(r.shard, r.position) for r in out.collect()]
    assert len(set(at)) == len(at) and {s for s, _ in at} <= set(range(20))


def test_warc_of_odd_pages(spark):
    pages = [(1, "http://a/", "<p>x</p>"), (2, None, "<p>y</p>"), (None, "u\r\nX: 1", "<p>z</p>"), (4, " http://é ", ""), (5, "http://n/", None), (6, "", "<p>x</p>"), (7, "big", nasty.LONG), (7, "big", nasty.LONG), (8, "nul", "a\x00\r\n\r\nb")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("file", F.lit("clash"))
    scratch, folder = Scratch(spark), shared_folder(spark)
    index = warc.index(warc.write(df, folder, scratch), folder, scratch)
    assert sorted(map(key, warc.read(index, folder).select("page_id", "url", "html").collect())) == sorted(map(repr, pages))
    got = warc.read(warc.distinct_payloads(index), folder).collect()
    assert sorted(map(repr, [(r.page_id, r.url) for r in got])) == sorted(map(repr, [(1, "http://a/"), (2, None), (None, "u\r\nX: 1"), (4, " http://é "), (7, "big"), (8, "nul")]))
    empty = df.limit(0)
    assert warc.read(warc.index(warc.write(empty, folder + "e", scratch), folder + "e", scratch), folder + "e").collect() == []


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [1.0]), (7, [nan, 0.0]), (8, [inf, 0.0]), (9, [None, 1.0]), (None, [0.0, 0.0]), (3, [1.0, 0.0]), (10, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("v", F.lit("clash"))
    got = {r.vec_id: (r.neighbours, r.distances) for r in ann.neighbours(df, k=2).collect()}
    assert got.pop(6) == ([], [])  # alone in its dimension
    assert set(got) == {1, 2, 3, 10} and got[1] == ([2, 3], [0.0, 1.0]) and got[3] == ([1, 2], [1.0, 1.0])
    assert {len(n) for n, _ in got.values()} == {2}
    assert [len(r.neighbours) for r in ann.neighbours(df.filter("vec_id in (1, 2)"), k=5).collect()] == [1, 1]
    assert ann.neighbours(df.limit(0)).collect() == []
    assert ann.neighbours(df.filter("vec_id = 10")).first().neighbours == []


def test_pii_of_odd_texts(spark):
    docs = nasty.documents(spark)
    assert pii.identifiers(docs).collect() == []
    one = spark.createDataFrame([(1, nasty.LONG + " ana.b@mail.example.com"), (2, "x@y"), (3, "ana.b@mail.example.com,"), (3, "ana.b@mail.example.com,")], "doc_id long, text string")
    got = sorted((r.doc_id, r.value, r.type) for r in pii.identifiers(one).collect())
    assert got == [(i, "ana.b@mail.example.com", "email") for i in (1, 3, 3)]


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
@pytest.mark.parametrize("wide", [False, True])
def test_stages(spark, tmp_path, stage, wide):
    nasty.labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    bench(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    run = dict(corpus_pipeline.STAGES)[stage]
    for docs in (nasty.documents(spark), nasty.documents(spark).limit(0)):
        docs = nasty.clashing(docs) if wide else docs
        out = run(spark, docs, str(tmp_path))
        assert out.columns[: len(docs.columns)] == docs.columns or stage == "sharding"
        out.write.mode("overwrite").parquet(str(tmp_path / "out"))
