"""The registered queries over the shared tables and the SQL each is held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FieldConfig, Flag, IndexConfig
from ..functions.analyzers import STOP_WORDS, lexer, lowered, standard, stopped
from ..functions.flatten import open_fields
from ..operators import aggregate as a
from ..operators.collection import Collection
from ..operators.fields import OpenFields
from ..operators.query import Groups, Query, all_, and_, contains, not_, number, number_range, or_, present, token, token_range
from ..sources.folder import own_folder
from ..sources.store import Index
from ..streaming import live
from .postings import unpacked, write
from .sorting import desc

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}
TEXT = FieldConfig(Flag.SEARCHABLE | Flag.STORED, analyzer=standard)
PLAIN = FieldConfig(Flag.SEARCHABLE | Flag.STORED)


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str, **fields: FieldConfig) -> Collection:
    return Collection.of(table(spark, d, "documents"), "doc_id", IndexConfig({"text": TEXT, "lang": PLAIN, "source": PLAIN, **fields}, default=PLAIN))


def plain(spark: SparkSession, d: str, name: str, key: str) -> Collection:
    return Collection.of(table(spark, d, name), key, IndexConfig(default=PLAIN))


def lines(spark: SparkSession, d: str) -> Collection:
    t = table(spark, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("_id"), "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_partkey", "l_discount")
    return Collection.of(t, "_id", IndexConfig(default=PLAIN))


def ids(found: DataFrame, name: str) -> DataFrame:
    return found.select(F.col("_id").alias(name))


WORDS = r"regexp_split_to_array(regexp_replace(lower(text), '^[\s\x0B]+|[\s\x0B]+$', '', 'g'), '[\s\x0B\-,;:.]+')"
STOPS = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))
D = f"(SELECT *, {WORDS} AS t FROM documents)"


def has(word: str) -> str:
    return f"list_contains(t, '{word}')"


# ---- predicates


@query("min_slice", f"SELECT doc_id, lang, n_chars FROM {D} WHERE {has('the')} AND {has('of')} AND lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 10")
def min_slice(spark: SparkSession, d: str) -> DataFrame:
    q = and_(token("the", "text"), token("of", "text"), token("en", "lang"))
    return documents(spark, d).query(q, [desc("n_chars")], 10, ["lang", "n_chars"]).withColumnRenamed("_id", "doc_id")


def on_documents(name: str, where: str, q: Query) -> None:
    query(name, f"SELECT doc_id FROM {D} WHERE {where}")(lambda spark, d: ids(documents(spark, d).query(q, projection=[]), "doc_id"))


on_documents("match_all", "TRUE", all_())
on_documents("token_text", has("the"), token("the", "text"))
on_documents("token_case", "FALSE", token("THE", "text"))
on_documents("token_any", "list_has_any(t, ['the', 'und'])", token(["the", "und"], "text"))
on_documents("and_or", f"({has('the')} OR {has('der')}) AND ({has('of')} OR {has('und')})", and_(or_(token("the", "text"), token("der", "text")), or_(token("of", "text"), token("und", "text"))))
on_documents("and_not", f"{has('the')} AND NOT {has('of')}", and_(token("the", "text"), not_(token("of", "text"))))
on_documents("not_token", f"NOT {has('the')}", not_(token("the", "text")))
on_documents("token_range", "len(list_filter(t, lambda x: x >= 'wa' AND x < 'wh')) > 0", token_range("text", "wa", "wh"))
on_documents("text_contains", "contains(lower(text), 'apache license')", contains("Apache License", "text"))
_ALL = f"list_filter(list_concat(list_concat(t, regexp_split_to_array(lower(lang), '[\\s\\x0B\\-,;:.]+')), regexp_split_to_array(lower(source), '[\\s\\x0B\\-,;:.]+')), lambda x: x NOT IN ({STOPS}))"
on_documents("token_all_field", f"list_contains({_ALL}, 'src7') OR list_contains({_ALL}, 'the')", or_(token("src7"), token("the")))


@query("clause_groups", f"SELECT doc_id FROM {D} WHERE {has('the')} AND NOT {has('of')} AND (lang = 'en' OR source = 'src3')")
def clause_groups(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.query import Groups

    q = Groups(should=(token("en", "lang"), token("src3", "source")), must=(token("the", "text"),), must_not=(token("of", "text"),))
    return ids(documents(spark, d).query(q, projection=[]), "doc_id")


@query("keyword_token", "SELECT event_id FROM events WHERE event_type = 'error'")
def keyword_token(spark: SparkSession, d: str) -> DataFrame:
    return ids(plain(spark, d, "events", "event_id").query(token("error", "event_type"), projection=[]), "event_id")


@query("token_boolean", "SELECT doc_id FROM labels WHERE toxic = 1 AND NOT quality = 1")
def token_boolean(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("bad"), (F.col("quality") == 1).alias("good"))
    rows = Collection.of(t, "doc_id", IndexConfig(default=PLAIN)).query(and_(token(True, "bad"), token(False, "good")), projection=[])
    return ids(rows, "doc_id")


@query("number_eq", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE floor(l_quantity) = 17")
def number_eq(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).query(number(17.9, "l_quantity"), projection=["l_orderkey", "l_linenumber", "l_quantity"]).drop("_id")


@query("number_range", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE floor(l_partkey) >= 64 AND floor(l_partkey) < 70")
def number_range_(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).query(number_range("l_partkey", 64, 70), projection=["l_orderkey", "l_linenumber"]).drop("_id")


@query("range_open", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE floor(l_extendedprice) > 90000")
def range_open(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).query(number_range("l_extendedprice", 90000, None, low_included=False), projection=["l_orderkey", "l_linenumber"]).drop("_id")


@query("range_zero", "SELECT event_id FROM events WHERE floor(value) >= 0 AND floor(value) <= 10")
def range_zero(spark: SparkSession, d: str) -> DataFrame:
    return ids(plain(spark, d, "events", "event_id").query(number_range("value", 0, 10, high_included=True), projection=[]), "event_id")


@query("range_multivalued", "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: floor(x) >= 0)) > 0 AND NOT len(list_filter(embedding, lambda x: floor(x) = -1)) = 0")
def range_multivalued(spark: SparkSession, d: str) -> DataFrame:
    q = and_(number_range("embedding", 0), number(-1, "embedding"))
    return ids(plain(spark, d, "embeddings", "vec_id").query(q, projection=[]), "vec_id")


@query("present_json", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def present_json(spark: SparkSession, d: str) -> DataFrame:
    c = Collection.of(table(spark, d, "events"), "event_id", IndexConfig({"k": FieldConfig(generator=lambda: F.get_json_object("props", "$.k"))}, default=PLAIN))
    return ids(c.query(present("k"), projection=[]), "event_id")


@query("present_missing", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL")
def present_missing(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return ids(Collection.of(t, "doc_id", IndexConfig(default=PLAIN)).query(not_(present("quality")), projection=[]), "doc_id")


@query("floor_index", "SELECT event_id, CAST(floor(value) AS BIGINT) AS whole FROM events WHERE value IS NOT NULL")
def floor_index(spark: SparkSession, d: str) -> DataFrame:
    c = plain(spark, d, "events", "event_id")
    return c.df.select("event_id", F.explode(c.fields.values("value", "n")).alias("whole"))


# ---- analysis


@query("lexer_tokens", "SELECT page_id, w AS term, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(url, '[a-z]{3,}|[0-9]+')) AS w FROM pages) GROUP BY ALL")
def lexer_tokens(spark: SparkSession, d: str) -> DataFrame:
    rules = lexer([("TOKEN", "[a-z]{3,}|[0-9]+")])
    return table(spark, d, "pages").select("page_id", F.explode(rules(F.col("url"))).alias("term")).groupBy("page_id", "term").agg(F.count(F.lit(1)).alias("n"))


@query("vocab_df", f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(t) AS term FROM {D}) GROUP BY term")
def vocab_df(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).vocabulary("text")


@query("stopword_vocab", f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(t) AS term FROM {D}) WHERE term NOT IN ({STOPS}) GROUP BY term")
def stopword_vocab(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d, text=FieldConfig(analyzer=stopped(lowered(standard)))).vocabulary("text")


# ---- order and limits


@query("topk_desc", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk_desc(spark: SparkSession, d: str) -> DataFrame:
    return plain(spark, d, "orders", "o_orderkey").query(all_(), [desc("o_totalprice")], 25, ["o_totalprice"]).withColumnRenamed("_id", "o_orderkey")


@query("topk_one", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1")
def topk_one(spark: SparkSession, d: str) -> DataFrame:
    return plain(spark, d, "orders", "o_orderkey").query(all_(), ["o_totalprice"], 1, ["o_totalprice"]).withColumnRenamed("_id", "o_orderkey")


@query("implicit_limit", "SELECT event_id FROM events ORDER BY event_type, event_id LIMIT 1000")
def implicit_limit(spark: SparkSession, d: str) -> DataFrame:
    return ids(plain(spark, d, "events", "event_id").query(all_(), ["event_type"], None, []), "event_id")


@query("sort_multi", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 40")
def sort_multi(spark: SparkSession, d: str) -> DataFrame:
    return plain(spark, d, "customer", "c_custkey").query(all_(), ["c_mktsegment", desc("c_acctbal")], 40, ["c_mktsegment", "c_acctbal"]).withColumnRenamed("_id", "c_custkey")


@query("sort_collated", "SELECT p_partkey, p_name FROM part ORDER BY p_name COLLATE NOCASE.NOACCENT, p_partkey LIMIT 50")
def sort_collated(spark: SparkSession, d: str) -> DataFrame:
    return plain(spark, d, "part", "p_partkey").query(all_(), ["p_name"], 50, ["p_name"]).withColumnRenamed("_id", "p_partkey")


@query("sort_missing_first", "SELECT d.doc_id, CAST(l.quality AS VARCHAR) AS quality FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id) ORDER BY l.quality NULLS FIRST, d.doc_id DESC LIMIT 700")
def sort_missing_first(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", "left")
    return Collection.of(t, "doc_id", IndexConfig(default=PLAIN)).query(all_(), ["quality", desc("doc_id")], 700, ["quality"]).select(F.col("_id").alias("doc_id"), F.col("quality").cast("string"))


@query("source_rows", "SELECT conv_id, turn, role, text FROM conversations WHERE role = 'user'")
def source_rows(spark: SparkSession, d: str) -> DataFrame:
    c = Collection.of(table(spark, d, "conversations"), F.struct("conv_id", "turn"), IndexConfig(default=PLAIN))
    return c.query(token("user", "role")).select("_source.*")


# ---- aggregation


@query("agg_count", f"SELECT count(*) AS n FROM {D} WHERE {has('the')}")
def agg_count(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).aggregate(token("the", "text"), [a.count("n")])[0]


@query("agg_count_first_last", "SELECT count(*) AS n, min(event_id) FILTER (WHERE r = 1) AS oldest, min(event_id) FILTER (WHERE s = 1) AS newest FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS r, row_number() OVER (ORDER BY ts DESC, event_id) AS s FROM events WHERE event_type = 'error' AND floor(value) >= 10)")
def agg_count_first_last(spark: SparkSession, d: str) -> DataFrame:
    q = and_(token("error", "event_type"), number_range("value", 10))
    out = plain(spark, d, "events", "event_id").aggregate(q, [a.count("n"), a.first(["ts"], [], "oldest"), a.last(["ts"], [], "newest")])[0]
    return out.select("n", F.col("oldest._id").alias("oldest"), F.col("newest._id").alias("newest"))


_RANKED = "SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS hi, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS lo FROM events"


@query("group_count_first_last", f"SELECT event_type, count(*) AS n, min(event_id) FILTER (WHERE hi = 1) AS top_id, min(event_id) FILTER (WHERE lo = 1) AS first_id FROM ({_RANKED}) GROUP BY event_type")
def group_count_first_last(spark: SparkSession, d: str) -> DataFrame:
    g = a.group_by("event_type", [a.count("n"), a.first([desc("value")], [], "top"), a.first(["ts"], [], "oldest")])
    out = plain(spark, d, "events", "event_id").aggregate(all_(), [g])[0]
    return out.select("event_type", "n", F.col("top._id").alias("top_id"), F.col("oldest._id").alias("first_id"))


@query("group_nested", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def group_nested(spark: SparkSession, d: str) -> DataFrame:
    return plain(spark, d, "events", "event_id").aggregate(all_(), [a.group_by("user_id", [a.group_by("event_type", [a.count("n")])])])[0]


@query("group_mixed_order", "SELECT c_mktsegment, c_custkey AS chosen FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey, c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r = 1")
def group_mixed_order(spark: SparkSession, d: str) -> DataFrame:
    g = a.group_by("c_mktsegment", [a.first(["c_nationkey", desc("c_acctbal")], [], "f")])
    return plain(spark, d, "customer", "c_custkey").aggregate(all_(), [g])[0].select("c_mktsegment", F.col("f._id").alias("chosen"))


@query("group_missing_key", "SELECT CAST(quality AS VARCHAR) AS quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality")
def group_missing_key(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return Collection.of(t, "doc_id", IndexConfig(default=PLAIN)).aggregate(all_(), [a.group_by("quality", [a.count("n")])])[0].withColumn("quality", F.col("quality").cast("string"))


@query("bucket_term", f"SELECT term, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(t) AS term FROM {D} WHERE lang = 'en') GROUP BY term")
def bucket_term(spark: SparkSession, d: str) -> DataFrame:
    """Each document counts in the bucket of every term that it holds."""
    return documents(spark, d).aggregate(token("en", "lang"), [a.bucket_term("text", [a.count("n")], "term")])[0].filter("term is not null")


@query("bucket_numeric", "SELECT CAST(floor(value / 10) * 10 AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY 1")
def bucket_numeric(spark: SparkSession, d: str) -> DataFrame:
    return plain(spark, d, "events", "event_id").aggregate(all_(), [a.bucket_number("value", 10, [a.count("n")], "bucket")])[0].withColumn("bucket", F.col("bucket").cast("long"))


# ---- postings, filters, deletions


_WRITTEN: dict[tuple[str, str], str] = {}


def written_postings(spark: SparkSession, d: str) -> DataFrame:
    """Postings of the documents, written sorted by the first query of an application that asks for them."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _WRITTEN:
        path = own_folder(spark)
        write(documents(spark, d).values(["text", "lang"], with_all=False), path)
        _WRITTEN[key] = path
    return unpacked(spark.read.parquet(_WRITTEN[key]))


def by_postings(name: str, where: str, q: Query) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return ids(documents(spark, d).query_postings(q, written_postings(spark, d), []), "doc_id")

    query(name, f"SELECT doc_id FROM {D} WHERE {where}")(run)


by_postings("postings_and", f"{has('the')} AND {has('of')}", and_(token("the", "text"), token("of", "text")))
by_postings("postings_or", f"{has('und')} OR lang = 'fr'", or_(token("und", "text"), token("fr", "lang")))
by_postings("postings_not", f"{has('the')} AND NOT {has('of')}", and_(token("the", "text"), not_(token("of", "text"))))


@query("cached_filter", f"SELECT doc_id FROM {D} WHERE lang = 'en' AND {has('the')} AND NOT {has('with')}")
def cached_filter(spark: SparkSession, d: str) -> DataFrame:
    c = documents(spark, d)
    english = c.register("english", and_(token("en", "lang"), token("the", "text")))
    c.hold("english", own_folder(spark))
    return ids(c.query(and_(english, not_(token("with", "text"))), projection=[]), "doc_id")


@query("delete_tombstone", "SELECT doc_id FROM documents WHERE lang = 'de' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)")
def delete_tombstone(spark: SparkSession, d: str) -> DataFrame:
    """Documents of an index on storage, without those that were deleted from it by what another table says."""
    index = Index(spark, own_folder(spark), IndexConfig(default=PLAIN))
    index.add(table(spark, d, "documents").select("doc_id", "lang"))
    gone = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("gone"))
    index.delete(index.query(all_(), projection=["doc_id"]).join(gone, F.col("doc_id") == F.col("gone"), "left_semi"))
    return index.query(token("de", "lang"), projection=["doc_id"]).select(F.col("doc_id").cast("long"))


@query("last_name_join", "SELECT c.c_custkey, c.c_name, o.o_orderkey AS last_order FROM customer c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) o ON o.o_custkey = c.c_custkey AND o.r = 1")
def last_name_join(spark: SparkSession, d: str) -> DataFrame:
    latest = plain(spark, d, "orders", "o_orderkey").aggregate(all_(), [a.group_by("o_custkey", [a.last(["o_orderdate"], [], "l")])])[0]
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return c.join(latest, c.c_custkey == latest.o_custkey, "left").select("c_custkey", "c_name", F.col("l._id").alias("last_order"))


@query("open_documents", "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events WHERE floor(value) >= 5 AND floor(value) < 9 GROUP BY 1")
def open_documents(spark: SparkSession, d: str) -> DataFrame:
    """Events as JSON documents without a schema, flattened, queried and grouped."""
    rows = table(spark, d, "events").select(F.col("event_id").alias("_id"), F.concat(F.lit('{"value":'), F.col("value").cast("string"), F.lit(',"props":'), F.col("props"), F.lit("}")).alias("_source"))
    c = Collection(open_fields(rows), OpenFields(["value", "props.k"], IndexConfig(default=PLAIN)))
    return c.aggregate(number_range("value", 5, 9), [a.group_by("props.k", [a.count("n")], "k")])[0]


def _streamed(name: str, mode: live.Mode, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        """Events of two commits, the second made after the query was asked; what the stream gives is read from its sink."""
        index = Index(spark, own_folder(spark), IndexConfig(default=PLAIN))
        events = table(spark, d, "events").select("event_id", "event_type", "value")
        late = F.coalesce(F.col("value") >= 10, F.lit(False))
        index.add(events.filter(~late))
        asked = live.query(index, token("error", "event_type"), projection=["event_id"], mode=mode)
        index.add(events.filter(late))
        sink = own_folder(spark)
        rows = asked.future.select(F.col("event_id").cast("long"))
        rows.writeStream.format("parquet").option("checkpointLocation", f"{sink}/checkpoint").trigger(availableNow=True).start(f"{sink}/rows").awaitTermination()
        return spark.read.schema("event_id long").parquet(f"{sink}/rows")

    query(name, sql)(run)


_streamed("stream_current_future", live.Mode.BOTH, "SELECT event_id FROM events WHERE event_type = 'error'")
_streamed("stream_future", live.Mode.FUTURE, "SELECT event_id FROM events WHERE event_type = 'error' AND value >= 10")


@query("stream_ingest", "SELECT event_type, count(*) AS n FROM events WHERE value >= 10 GROUP BY event_type")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Events that come as a stream of files become commits of an index."""
    folder = own_folder(spark)
    index = Index(spark, f"{folder}/index", IndexConfig(default=PLAIN))
    stream = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    index.follow(stream.select("event_id", "event_type", "value"), f"{folder}/checkpoint").awaitTermination()
    return index.aggregate(number_range("value", 10), [a.group_by("event_type", [a.count("n")])])[0]


@query("stream_counts", "SELECT role, count(*) AS n FROM conversations GROUP BY role")
def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """Running counts of an index's documents, as they stand after all commits."""
    index = Index(spark, own_folder(spark), IndexConfig(default=PLAIN))
    index.add(table(spark, d, "conversations").select("role"))
    sink = f"foliant_counts_{uuid.uuid4().hex}"  # a row for each role
    live.counts(index, all_(), "role").writeStream.format("memory").queryName(sink).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(sink).select("role", F.col("count").alias("n"))


@query("compacted", "SELECT conv_id, turn FROM conversations WHERE turn > 1")
def compacted(spark: SparkSession, d: str) -> DataFrame:
    """An index of two commits and deletions, made into one commit elsewhere."""
    index = Index(spark, own_folder(spark), IndexConfig(default=PLAIN))
    turns = table(spark, d, "conversations").select("conv_id", "turn")
    index.add(turns.filter("turn <= 2"))
    index.add(turns.filter("turn > 2"))
    index.delete(index.query(number_range("turn", None, 2), projection=[]))
    found = index.compact(own_folder(spark), 4).query(present("turn"), projection=["conv_id", "turn"])
    return found.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"))


@query("match_none", "SELECT doc_id FROM documents WHERE FALSE")
def match_none(spark: SparkSession, d: str) -> DataFrame:
    return ids(documents(spark, d).query(and_(token("en", "lang"), not_(token("en", "lang"))), projection=[]), "doc_id")


@query("limit_only", "SELECT least(count(*), 25) AS n FROM orders")
def limit_only(spark: SparkSession, d: str) -> DataFrame:
    return plain(spark, d, "orders", "o_orderkey").query(all_(), None, 25, []).agg(F.count(F.lit(1)).alias("n"))


@query("group_source", "SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def group_source(spark: SparkSession, d: str) -> DataFrame:
    """The whole row of each customer's largest order."""
    out = plain(spark, d, "orders", "o_orderkey").aggregate(all_(), [a.group_by("o_custkey", [a.first([desc("o_totalprice")])])])[0]
    return out.select("first.o_custkey", "first.o_orderkey", "first.o_totalprice", "first.o_orderstatus")


@query("last_struct_id", "SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def last_struct_id(spark: SparkSession, d: str) -> DataFrame:
    """Ties go to the least of the structs that are the rows' _id."""
    out = lines(spark, d).aggregate(all_(), [a.group_by("l_partkey", [a.last(["l_quantity"], [])])])[0]
    return out.select("l_partkey", "last._id.l_orderkey", "last._id.l_linenumber")


# ---- the workload of the baseline that no query above covers


@query("present_all_group", f"SELECT lang, count(*) AS n FROM {D} WHERE source IS NOT NULL AND list_contains({_ALL}, 'licensed') GROUP BY lang")
def present_all_group(spark: SparkSession, d: str) -> DataFrame:
    q = and_(present("source"), token("licensed"))
    return documents(spark, d).aggregate(q, [a.group_by("lang", [a.count("n")])])[0]


@query("latest_state", "SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS state FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events WHERE event_type IN ('error', 'click') AND floor(value) >= 1) WHERE r = 1")
def latest_state(spark: SparkSession, d: str) -> DataFrame:
    q = and_(token(["error", "click"], "event_type"), number_range("value", 1))
    g = a.group_by("user_id", [a.last(["ts"], ["value"], "l")])
    out = plain(spark, d, "events", "event_id").aggregate(q, [g])[0]
    return out.select("user_id", F.col("l._id").alias("event_id"), F.floor("l.value").alias("state"))


@query("group_key_view", "SELECT user_id, count(*) AS kinds, CAST(sum(n) AS BIGINT) AS n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def group_key_view(spark: SparkSession, d: str) -> DataFrame:
    """Groups in groups, the inner ones gathered for each outer key."""
    flat = plain(spark, d, "events", "event_id").aggregate(all_(), [a.group_by("user_id", [a.group_by("event_type", [a.count("n")])])])[0]
    view = a.nested(flat, ["user_id"])
    n = F.aggregate("groups", F.lit(0).cast("long"), lambda s, g: s + g["n"])
    return view.select("user_id", F.size("groups").cast("long").alias("kinds"), n.alias("n"))


# ---- nested documents, single rows, storage


@query("nested_paths", "SELECT conv_id FROM conversations GROUP BY conv_id HAVING bool_or(role = 'user') AND bool_or(turn >= 3)")
def nested_paths(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as documents with an array of turns, found by what any of the turns holds."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("turns"))
    c = Collection.of(turns, "conv_id", IndexConfig(default=PLAIN))
    return ids(c.query(and_(token("user", "turns.role"), number_range("turns.turn", 3)), projection=[]), "conv_id")


@query("single_document", "SELECT doc_id, lang, source FROM documents WHERE doc_id = 7")
def single_document(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).document(7, ["lang", "source"]).withColumnRenamed("_id", "doc_id")


@query("sort_first_element", "SELECT vec_id FROM embeddings ORDER BY embedding[1] DESC, vec_id LIMIT 20")
def sort_first_element(spark: SparkSession, d: str) -> DataFrame:
    return ids(plain(spark, d, "embeddings", "vec_id").query(all_(), [desc("embedding")], 20, []), "vec_id")


@query("agg_nothing", "SELECT 0::BIGINT AS n, TRUE AS none")
def agg_nothing(spark: SparkSession, d: str) -> DataFrame:
    out = documents(spark, d).aggregate(token("no such term", "lang"), [a.count("n"), a.first(["n_chars"], [], "f")])[0]
    return out.select("n", F.col("f").isNull().alias("none"))


@query("lexer_rules", "SELECT w AS term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(url, '[0-9]+|[a-z]+')) AS w FROM pages) WHERE NOT regexp_full_match(w, '[0-9]+') GROUP BY w")
def lexer_rules(spark: SparkSession, d: str) -> DataFrame:
    lex = lexer([("NUMBER", "[0-9]+"), ("TOKEN", "[a-z]+")])
    return table(spark, d, "pages").select(F.explode(lex(F.col("url"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("sum_of_groups", "SELECT sum(n)::BIGINT AS n, count(*) AS groups FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders WHERE floor(o_totalprice) BETWEEN 1000 AND 99999 GROUP BY ALL)")
def sum_of_groups(spark: SparkSession, d: str) -> DataFrame:
    g = a.group_by("o_orderstatus", [a.group_by("o_orderpriority", [a.count("n")])])
    flat = plain(spark, d, "orders", "o_orderkey").aggregate(number_range("o_totalprice", 1000, 99999, high_included=True), [g])[0]
    return flat.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"))


@query("store_snapshot", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND turn <> 0")
def store_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """An index on storage: rows added as JSON documents, some deleted, the rest queried from a snapshot."""
    index = Index(spark, own_folder(spark), IndexConfig(default=PLAIN))
    index.add(table(spark, d, "conversations"))
    index.delete(index.query(number(0, "turn"), projection=[]))
    found = index.query(token("user", "role"))
    return found.select(*[F.get_json_object("_source", f"$.{n}").cast("long").alias(n) for n in ("conv_id", "turn")])
