"""Queries through versioned tables: each makes a table, applies an operation and returns its rows."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import bucket
from tidemark.operators import indexes, search
from tidemark.operators.joins import fragment_join, shard_join, table_join
from tidemark.plans.dialect import Dialect
from tidemark.sources.catalog import Catalog
from tidemark.sources.scratch import scratch
from tidemark.sources.table import Table, input_bytes, tasks_for

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _register(sql: str | None = None):
    def mark(f):
        name = f.__name__.strip("_")

        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return mark


def _table(spark, df: DataFrame, parts: int = 4, key: str | None = None, **kw) -> Table:
    """A table of several fragments, of more if the rows need more tasks; with a key, each fragment holds a range of it."""
    parts = max(parts, tasks_for(input_bytes(df)))
    df = df.repartitionByRange(parts, key).sortWithinPartitions(key) if key else df.repartition(parts)
    return Table.create_as(spark, scratch(spark, "table"), df, **kw)


def _pruned(table: Table, condition: str) -> bool:
    """Whether a condition leaves fewer fragments than there are, or than the 8 that were asked for."""
    report = table.scan_report(condition)
    return report["scanned_fragments"] < max(8, report["fragments"])


def _in_order(spark, df: DataFrame, key: str) -> Table:
    """A table whose addresses follow the key's order from 0: one fragment, of as many files as the rows need."""
    order = F.asc_nulls_last(key)
    rows = df.repartitionByRange(tasks_for(input_bytes(df)), order).sortWithinPartitions(order)
    return Table.create_as(spark, scratch(spark, "table"), rows, fragment_count=1)


Q1 = """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
 CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS sum_disc_price, CAST(sum(CAST(l_extendedprice * (1 - l_discount) * (1 + l_tax) AS DECIMAL(18, 6))) AS DOUBLE) AS sum_charge,
 round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM {lineitem} WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus"""


@_register(Q1.format(lineitem="lineitem"))
def tpch_q1(spark, t):
    return spark.sql(Q1, lineitem=_table(spark, t("lineitem")).read())


@_register("SELECT c_custkey, c_acctbal FROM customer")
def time_travel_version(spark, t):
    table = _table(spark, t("customer").filter("c_custkey % 2 = 0"))
    m = table.append(t("customer").filter("c_custkey % 2 <> 0"))
    table.delete("c_acctbal < 0")
    return table.read(version=m.version).select("c_custkey", "c_acctbal")


@_register("SELECT c_custkey, c_acctbal FROM customer")
def time_travel_timestamp(spark, t):
    table = _table(spark, t("customer").filter("c_custkey % 2 = 0"))
    m = table.append(t("customer").filter("c_custkey % 2 <> 0"))
    table.delete("c_acctbal < 0")
    return table.read(timestamp=m.timestamp).select("c_custkey", "c_acctbal")


@_register("SELECT o_orderkey, o_totalprice FROM orders")
def insert_append(spark, t):
    table = _table(spark, t("orders").filter("o_orderkey % 2 = 0"))
    table.append(t("orders").filter("o_orderkey % 2 <> 0"), max_row_per_file=5000)
    return table.read().select("o_orderkey", "o_totalprice")


@_register("SELECT n_nationkey, upper(n_name) AS n_name FROM nation")
def insert_overwrite(spark, t):
    table = _table(spark, t("customer"))
    table.overwrite(t("nation").select("n_nationkey", F.upper("n_name").alias("n_name")))
    return table.read()


@_register("SELECT r_regionkey, r_name FROM region")
def replace_table_as_select(spark, t):
    table = _table(spark, t("nation"))
    return Table.create_as(spark, table.path, t("region"), replace_table=True).read()


@_register("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'P' OR o_totalprice > 250000)")
def delete_rows(spark, t):
    table = _table(spark, t("orders"))
    table.delete("o_orderstatus = 'P'")
    table.delete("o_totalprice > 250000")
    return table.read().select("o_orderkey", "o_orderstatus")


@_register("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN 'B' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_rows(spark, t):
    table = _table(spark, t("customer"), properties={"enable_stable_row_ids": "true"})
    table.update({"c_acctbal": "c_acctbal + 100", "c_mktsegment": "'B'"}, "c_mktsegment = 'BUILDING'")
    return table.read().select("c_custkey", "c_acctbal", "c_mktsegment")


@_register("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 3 <> 0
UNION ALL SELECT c_custkey, -1.0::DOUBLE FROM customer WHERE c_custkey % 5 = 0""")
def merge_into(spark, t):
    c = t("customer").select("c_custkey", "c_acctbal")
    table = _table(spark, c.filter("c_custkey % 5 <> 0"))
    table.merge(
        c.filter("c_custkey % 3 <> 2 or c_custkey % 5 = 0"), "t.c_custkey = s.c_custkey",
        matched=[("s.c_custkey % 3 = 0", None), (None, {"c_acctbal": "t.c_acctbal + 1"})],
        not_matched=[(None, {"c_custkey": "s.c_custkey", "c_acctbal": "-1.0D"})],
    )
    return table.read()


@_register("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' END AS size_class FROM orders")
def add_columns_from(spark, t):
    table = _table(spark, t("orders").select("o_orderkey", "o_totalprice"))
    rows = table.read(hidden=("_rowaddr", "_fragid"))
    table.add_columns_from(rows.filter("o_totalprice > 100000").select("_rowaddr", "_fragid", F.lit("big").alias("size_class")))
    return table.read().select("o_orderkey", "size_class")


@_register("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders")
def update_columns_from(spark, t):
    table = _table(spark, t("orders").select("o_orderkey", "o_totalprice"))
    rows = table.read(hidden=("_rowaddr", "_fragid"))
    table.update_columns_from(rows.filter("o_totalprice > 100000").select("_rowaddr", "_fragid", F.lit(0.0).alias("o_totalprice")))
    return table.read()


@_register("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 5 <> 0")
def optimize_table(spark, t):
    table = _table(spark, t("orders"), parts=6)
    table.delete("o_orderkey % 5 = 0")
    table.optimize(target_rows_per_fragment=1_000_000)
    table.vacuum()
    return table.read().select("o_orderkey", "o_custkey")


@_register("""
SELECT c_custkey, CASE WHEN c_custkey > 1000 THEN 'insert' ELSE 'update' END AS change, CASE WHEN c_custkey > 1000 THEN 2 ELSE 1 END::BIGINT AS created, CASE WHEN c_custkey > 1000 THEN 2 ELSE 3 END::BIGINT AS updated
FROM customer WHERE c_custkey > 1000 OR c_custkey <= 100""")
def change_feed(spark, t):
    c = t("customer").select("c_custkey", "c_acctbal")
    table = _table(spark, c.filter("c_custkey <= 1000"), properties={"enable_stable_row_ids": "true"})
    table.append(c.filter("c_custkey > 1000"))
    table.update({"c_acctbal": "0"}, "c_custkey <= 100")
    return table.changes(since=1).select("c_custkey", "change", F.col("_row_created_at_version").alias("created"), F.col("_row_last_updated_at_version").alias("updated"))


@_register("SELECT o_orderkey, CAST(0 AS INTEGER) AS _fragid, row_number() OVER (ORDER BY o_orderkey) - 1 AS _rowaddr, row_number() OVER (ORDER BY o_orderkey) - 1 AS _rowid FROM orders")
def row_addresses(spark, t):
    return _in_order(spark, t("orders").select("o_orderkey"), "o_orderkey").read(hidden=("_fragid", "_rowaddr", "_rowid"))


@_register("SELECT count(*) AS n FROM orders WHERE o_orderkey % 7 <> 0")
def count_star(spark, t):
    table = _table(spark, t("orders"))
    table.delete("o_orderkey % 7 = 0")
    return spark.createDataFrame([(table.count(),)], "n long")


@_register("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey BETWEEN 100 AND 900 AND l_quantity > 10")
def zonemap_pruning(spark, t):
    table = _table(spark, t("lineitem"), parts=8, key="l_orderkey")
    indexes.create_index(table, "zones", "zonemap", ["l_orderkey"], rows_per_zone=4096)
    condition = "l_orderkey BETWEEN 100 AND 900 AND l_quantity > 10"
    assert _pruned(table, condition)
    return table.read(where=condition).select("l_orderkey", "l_linenumber", "l_quantity")


@_register("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS a FROM orders) t WHERE a IN (3, 5, 70)")
def row_address_pruning(spark, t):
    table = _in_order(spark, t("orders").select("o_orderkey"), "o_orderkey")
    return table.read(where="_rowaddr IN (3, 5, 70, 4294967296)")


@_register("SELECT 40::BIGINT AS n, 1::BIGINT AS scanned")
def limit_pruning(spark, t):
    table = _table(spark, t("lineitem"), parts=4)
    df = table.read(limit=40)
    files = len(df.inputFiles())
    return df.agg(F.count("*").alias("n"), F.lit(files).cast("long").alias("scanned"))


@_register("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def top_n_offset(spark, t):
    return _table(spark, t("orders")).read().select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(20)


@_register("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'X'")
def branch_and_tag(spark, t):
    table = _table(spark, t("region"), parts=1)
    table.create_tag("first")
    branch = table.create_branch("work", tag="first")
    branch.append(spark.createDataFrame([(99, "X")], "r_regionkey int, r_name string"))
    table.delete("r_regionkey > 2")
    return branch.read()


@_register("SELECT count(*) AS n, round(sum(a.o_totalprice), 2) AS total FROM orders a WHERE o_totalprice > 1000")
def fragment_aware_join(spark, t):
    table = _table(spark, t("orders"))
    rows = table.read(hidden=("_rowaddr",))
    right = rows.filter("o_totalprice > 1000").select(F.col("_rowaddr").alias("addr"))
    return fragment_join(rows, right, "_rowaddr", "addr").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@_register("SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority")
def bucketed_join(spark, t):
    a = _table(spark, t("orders").withColumnRenamed("o_orderkey", "k"), sharding=["bucket", 4, "k"])
    b = _table(spark, t("lineitem").withColumnRenamed("l_orderkey", "k"), sharding=["bucket", 4, "k"])
    return shard_join(a, b, "k").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@_register("SELECT count(*) AS n, count(DISTINCT o_orderpriority) AS kinds, true AS one_bucket_each FROM orders")
def bucket_function(spark, t):
    rows = t("orders").withColumn("b", bucket(8, F.col("o_orderpriority")))
    per = rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.countDistinct("b").alias("bs"))
    return per.agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), (F.max("bs") == 1).alias("one_bucket_each"))


def _indexed(spark, rows: DataFrame, method: str, column: str, values: list, condition: str, **options) -> DataFrame:
    """Index all but the last fragment, append more rows, read through the index."""
    table = _table(spark, rows)
    indexes.create_index(table, "i", method, [column], **options)
    return indexes.indexed_read(table, "i", values, condition)


@_register("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (7, 22, 100)")
def index_btree(spark, t):
    return _indexed(spark, t("orders"), "btree", "o_custkey", [7, 22, 100], "o_custkey IN (7, 22, 100)", build_mode="range").select("o_orderkey", "o_custkey")


@_register("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def index_bitmap(spark, t):
    return _indexed(spark, t("orders"), "bitmap", "o_orderpriority", ["1-URGENT", "5-LOW"], "o_orderpriority IN ('1-URGENT', '5-LOW')").select("o_orderkey")


@_register("SELECT p_partkey FROM part WHERE p_brand = 'Brand#12' OR p_type = 'Brand#12'")
def index_label_list(spark, t):
    rows = t("part").select("p_partkey", F.array("p_brand", "p_type").alias("labels"))
    return _indexed(spark, rows, "label_list", "labels", ["Brand#12"], "array_contains(labels, 'Brand#12')").select("p_partkey")


@_register("SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE '%0012%'")
def index_ngram(spark, t):
    return _indexed(spark, t("customer"), "ngram", "c_name", ["0012"], "lower(c_name) LIKE '%0012%'").select("c_custkey", "c_name")


@_register("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = 77")
def index_bloomfilter(spark, t):
    return _indexed(spark, t("lineitem"), "bloomfilter", "l_partkey", [77], "l_partkey = 77", number_of_items=1024).select("l_orderkey", "l_linenumber")


@_register("SELECT c_custkey FROM customer WHERE c_custkey BETWEEN 100 AND 300 AND c_acctbal BETWEEN 0 AND 5000")
def index_rtree(spark, t):
    rows = t("customer").select("c_custkey", F.struct(F.col("c_custkey").cast("double").alias("x"), F.col("c_acctbal").alias("y")).alias("p"))
    table = _table(spark, rows, key="c_custkey")
    indexes.create_index(table, "r", "rtree", ["p"], page_size=128)
    return indexes.box_read(table, "r", 100.0, 0.0, 300.0, 5000.0).select("c_custkey")


WORDS = "list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda w: length(w) <= 40)"


@_register(f"SELECT doc_id FROM documents WHERE list_contains({WORDS}, 'license') OR list_contains({WORDS}, 'rights')")
def index_fts(spark, t):
    rows = t("documents").select("doc_id", "text")
    table = _table(spark, rows)
    indexes.create_index(table, "f", "inverted", ["text"])
    hits = indexes.candidates(table, "f", ["license", "rights"])
    at = table.read(hidden=("_rowaddr",))
    return at.join(hits, F.col("_rowaddr") == F.col("rowaddr"), "left_semi").filter(search.match("text", "license rights")).select("doc_id")


VECTOR = [0.1 * ((i * 7) % 11 - 5) for i in range(64)]
DUCK_VECTOR = "[" + ", ".join(f"{x!r}::DOUBLE" for x in VECTOR) + "]"


def _vectors(spark, t) -> DataFrame:
    return _table(spark, t("embeddings").select(F.col("vec_id"), F.col("embedding").alias("vector"), "label")).read()


def _nearest(metric: str, extra: str = "", cond: str = "", off: str = "") -> str:
    d = {"l2": f"list_sum(list_transform(list_zip(embedding, {DUCK_VECTOR}), lambda p: (p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2])))", "cosine": f"1 - list_cosine_similarity(embedding::DOUBLE[], {DUCK_VECTOR})", "dot": f"1 - list_inner_product(embedding::DOUBLE[], {DUCK_VECTOR})"}[metric]
    return f"SELECT vec_id, round(d, 4) AS distance FROM (SELECT vec_id, {d} AS d FROM embeddings {extra}) t {cond} ORDER BY d, vec_id LIMIT 20 {off}"


def _vector_query(spark, t, **kw):
    out = search.vector_search(_vectors(spark, t), VECTOR, 20, row_id="vec_id", with_row_id=True, columns=["vec_id"], **kw)
    return out.select("vec_id", F.round(F.col("_distance").cast("double"), 4).alias("distance"))


@_register("SELECT vec_id FROM (" + _nearest("l2") + ")")
def vector_search_l2(spark, t):
    return _vector_query(spark, t).select("vec_id")


@_register("SELECT vec_id FROM (" + _nearest("cosine", "WHERE label < 5") + ")")
def vector_search_cosine_filter(spark, t):
    return _vector_query(spark, t, distance_type="cosine", filter="label < 5").select("vec_id")


@_register("SELECT vec_id FROM (" + _nearest("dot", "", "", "OFFSET 7") + ")")
def vector_search_dot_offset(spark, t):
    return _vector_query(spark, t, distance_type="dot", offset=7).select("vec_id")


def _docs(spark, t) -> DataFrame:
    return _table(spark, t("documents").select("doc_id", "text", "source")).read()


@_register(f"SELECT doc_id FROM documents WHERE list_contains({WORDS}, 'license') AND list_contains({WORDS}, 'apache')")
def match_and(spark, t):
    return _docs(spark, t).filter(search.match("text", "License Apache", "operator=AND")).select("doc_id")


@_register("SELECT doc_id FROM documents WHERE regexp_matches(' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ') || ' ', ' all rights reserved ')")
def match_phrase(spark, t):
    return _docs(spark, t).filter(search.match_phrase("text", "all rights reserved")).select("doc_id")


@_register(f"SELECT doc_id FROM documents WHERE list_contains({WORDS}, 'apache') OR source = 'src3'")
def multi_match(spark, t):
    return _docs(spark, t).filter(search.multi_match("apache src3", ["text", "source"])).select("doc_id")


BM25 = f"""
WITH w AS (SELECT doc_id, {WORDS} AS words FROM documents),
s AS (SELECT count(*) AS n, avg(len(words)) AS avgdl, count(*) FILTER (list_contains(words, 'license')) AS d1, count(*) FILTER (list_contains(words, 'mit')) AS d2 FROM w),
tf AS (SELECT doc_id, len(words) AS dl, len(list_filter(words, lambda x: x = 'license')) AS t1, len(list_filter(words, lambda x: x = 'mit')) AS t2 FROM w)
SELECT doc_id, ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * dl / avgdl)) + ln(1 + (n - d2 + 0.5) / (d2 + 0.5)) * t2 * 2.2 / (t2 + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score
FROM tf, s WHERE t1 > 0 OR t2 > 0"""


@_register(f"SELECT doc_id, round(score, 6) AS score FROM ({BM25}) ORDER BY score DESC, doc_id LIMIT 15")
def search_bm25(spark, t):
    scored = search.bm25(_docs(spark, t), ["text"], "MIT license", key="doc_id")
    return scored.orderBy(F.desc("_score"), "doc_id").limit(15).select("doc_id", F.round("_score", 6).alias("score"))


@_register(f"""
WITH j AS (SELECT doc_id AS id, embedding FROM documents JOIN embeddings ON doc_id = vec_id),
v AS (SELECT id, row_number() OVER (ORDER BY d, id) - 1 AS rv FROM (SELECT id, list_sum(list_transform(list_zip(embedding, {DUCK_VECTOR}), lambda p: (p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2])))::FLOAT AS d FROM j) ORDER BY rv LIMIT 30),
b AS ({BM25.replace("FROM documents)", "FROM documents WHERE doc_id IN (SELECT id FROM j))")}),
x AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rt FROM b ORDER BY rt LIMIT 30)
SELECT id, round(r, 9) AS relevance FROM (
  SELECT coalesce(v.id, x.id) AS id, coalesce(1.0::DOUBLE / (rv + 60), 0) + coalesce(1.0::DOUBLE / (rt + 60), 0) AS r, least(coalesce(rv, 2147483647), coalesce(rt, 2147483647)) AS best
  FROM v FULL JOIN x ON v.id = x.id) ORDER BY r DESC, best, id LIMIT 10""")
def hybrid_search(spark, t):
    rows = t("documents").join(t("embeddings"), F.col("doc_id") == F.col("vec_id")).select(F.col("doc_id").alias("id"), "text", F.col("embedding").alias("vector"))
    found = search.hybrid_search(_table(spark, rows).read(), VECTOR, "MIT license", 10, search_columns=["text"], candidates=30, row_id="id")
    return found.select("id", F.round("_relevance_score", 9).alias("relevance"))


@_register("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 0 GROUP BY n_name")
def dialect_session(spark, t):
    sql = Dialect(spark, Catalog(spark, scratch(spark, "warehouse"))).run
    t("customer").createOrReplaceTempView("tidemark_customer")
    t("nation").createOrReplaceTempView("tidemark_nation")
    sql("CREATE TABLE cust AS SELECT c_custkey, c_nationkey, c_acctbal FROM tidemark_customer")
    sql("CREATE TABLE nat PARTITIONED BY (bucket(2, n_nationkey)) AS SELECT * FROM tidemark_nation")
    sql("ALTER TABLE cust CREATE INDEX zones USING zonemap (c_acctbal) WITH (rows_per_zone = 512)")
    sql("DELETE FROM cust WHERE c_acctbal < 0")
    sql("ALTER TABLE cust CREATE TAG clean")
    sql("UPDATE cust SET c_acctbal = c_acctbal + 1 WHERE c_custkey < 10")
    sql("OPTIMIZE cust WITH (target_rows_per_fragment = 1000000)")
    return sql("SELECT n_name, count(*) AS n FROM cust c JOIN nat ON c.c_nationkey = nat.n_nationkey GROUP BY n_name")


@_register("SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, event_type || ',x' AS tags, CAST(2 AS BIGINT) AS n_tags FROM events")
def r32_json_arrays(spark, t):
    tags = F.array("event_type", F.lit("x"))
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.array_join(tags, ",").alias("tags"), F.size(tags).cast("long").alias("n_tags"))


# -- statements of the dialect and what tables tell of themselves


def _session(spark, t, *tables: str):
    """A dialect over a new warehouse that holds these tables."""
    run = Dialect(spark, Catalog(spark, scratch(spark, "warehouse"))).run
    for name in tables:
        t(name).createOrReplaceTempView(f"tidemark_{name}")
        run(f"CREATE TABLE {name} AS SELECT * FROM tidemark_{name}")
    return run


@_register("SELECT count(*) AS n FROM orders WHERE o_totalprice > 150000")
def count_filtered(spark, t):
    return spark.createDataFrame([(_table(spark, t("orders")).count("o_totalprice > 150000"),)], "n long")


@_register("SELECT count(*) AS n FROM lineitem")
def count_star_sql(spark, t):
    return _session(spark, t, "lineitem")("SELECT count(*) AS n FROM lineitem")


@_register("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def create_table_and_insert(spark, t):
    run = _session(spark, t)
    t("customer").createOrReplaceTempView("tidemark_customer")
    run("CREATE TABLE rich (c_custkey BIGINT NOT NULL, c_acctbal DOUBLE) TBLPROPERTIES ('owner' = 'me')")
    run("INSERT INTO rich SELECT c_custkey, c_acctbal FROM tidemark_customer WHERE c_acctbal > 0")
    return run("SELECT * FROM rich")


@_register("""
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt, FROM then' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 4 <> 1
UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 4 = 0""".replace("c_custkey % 4 <> 1\n", "c_custkey % 4 NOT IN (0, 1)\n"))
def merge_into_sql(spark, t):
    run = _session(spark, t, "customer")
    run("DELETE FROM customer WHERE c_custkey % 4 = 0")
    run("""MERGE INTO customer c USING (SELECT * FROM tidemark_customer) s ON c.c_custkey = s.c_custkey
           WHEN MATCHED AND s.c_custkey % 4 = 1 THEN DELETE
           WHEN MATCHED AND c.c_acctbal < 0 THEN UPDATE SET c_mktsegment = 'debt, FROM then'
           WHEN NOT MATCHED THEN INSERT (c_custkey, c_mktsegment) VALUES (s.c_custkey, 'new')""")
    return run("SELECT c_custkey, c_mktsegment FROM customer")


Q5 = """
SELECT n_name, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue
FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey
 AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= DATE '1994-01-01' AND o_orderdate < DATE '1995-01-01'
GROUP BY n_name"""


@_register(Q5)
def tpch_q5_sql(spark, t):
    return _session(spark, t, "customer", "orders", "lineitem", "supplier", "nation", "region")(Q5)


@_register("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (5, 11)")
def index_btree_fragments(spark, t):
    return _indexed(spark, t("orders"), "btree", "o_custkey", [5, 11], "o_custkey IN (5, 11)", build_mode="fragment").select("o_orderkey", "o_custkey")


@_register("SELECT o_orderkey FROM orders WHERE o_custkey = 7")
def index_after_optimize(spark, t):
    """Fragments that were rewritten since are scanned, the others are found through the index."""
    table = _table(spark, t("orders"), parts=6)
    indexes.create_index(table, "i", "btree", ["o_custkey"])
    table.delete("o_orderkey % 9 = 0 AND o_custkey <> 7")
    table.optimize(target_rows_per_fragment=1_000_000)
    return indexes.indexed_read(table, "i", [7], "o_custkey = 7").select("o_orderkey")


@_register("SELECT 'late' AS name, 'btree' AS index_type, 0::BIGINT AS num_indexed_rows, count(*) AS num_unindexed_rows FROM orders UNION ALL SELECT 'whole', 'bitmap', count(*), 0 FROM orders")
def show_indexes(spark, t):
    run = _session(spark, t, "orders")
    run("ALTER TABLE orders CREATE INDEX late USING btree (o_custkey) WITH (train = false)")
    run("ALTER TABLE orders CREATE INDEX whole USING bitmap (o_orderstatus)")
    run("ALTER TABLE orders CREATE INDEX gone USING zonemap (o_custkey)")
    run("ALTER TABLE orders DROP INDEX gone")
    return run("SHOW INDEXES IN orders").select("name", "index_type", "num_indexed_rows", "num_unindexed_rows")


SHIPPED = "{0} >= {1} '1998-11-01{2}' AND {0} < {1} '1998-11-20{2}'"


@_register("SELECT l_orderkey, l_linenumber FROM lineitem WHERE " + SHIPPED.format("l_shipdate", "TIMESTAMP", " 00:00:00"))
def zonemap_dates(spark, t):
    """The same rows by a zone map of dates and by one of timestamps."""
    rows = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp").alias("at"), F.col("l_shipdate").cast("date").alias("day"))
    table = _table(spark, rows, parts=8, key="at")
    for column in ("at", "day"):
        indexes.create_index(table, f"zones_{column}", "zonemap", [column], rows_per_zone=4096)
    both = [SHIPPED.format("at", "TIMESTAMP", " 00:00:00"), SHIPPED.format("day", "DATE", "")]
    assert all(_pruned(table, c) for c in both)
    a, b = (table.read(where=c).select("l_orderkey", "l_linenumber") for c in both)
    return a.intersectAll(b)


@_register("SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12, 2)) AS price FROM orders WHERE CAST(o_totalprice AS DECIMAL(12, 2)) BETWEEN 900.00 AND 2000.50")
def zonemap_decimals(spark, t):
    rows = t("orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(12, 2)").alias("price"))
    table = _table(spark, rows, parts=8, key="price")
    indexes.create_index(table, "zones", "zonemap", ["price"], rows_per_zone=4096)
    condition = "price BETWEEN 900.00 AND 2000.50"
    assert _pruned(table, condition)
    return table.read(where=condition)


@_register("SELECT 'old' AS name, 1::BIGINT AS version, 'tag' AS kind UNION ALL SELECT 'work', 2, 'branch'")
def show_branches_and_tags(spark, t):
    run = _session(spark, t, "region")
    run("DELETE FROM region WHERE r_regionkey = 0")
    run("ALTER TABLE region CREATE TAG old AS OF VERSION 1")
    run("ALTER TABLE region CREATE TAG gone")
    run("ALTER TABLE region CREATE BRANCH work")
    run("ALTER TABLE region CREATE BRANCH spare")
    run("ALTER TABLE region DROP TAG gone")
    run("ALTER TABLE region DROP BRANCH spare")
    tags = run("SHOW TAGS IN region").select("name", "version", F.lit("tag").alias("kind"))
    return tags.union(run("SHOW BRANCHES IN region").select("name", F.col("parent_version").alias("version"), F.lit("branch").alias("kind")))


@_register("SELECT 'nations' AS tableName, 'owner' AS key, 'me' AS value, 'n_nationkey' AS primary_key, count(*) AS n FROM nation")
def catalog_statements(spark, t):
    """Namespaces, properties, a primary key, a rename and a dropped table."""
    run = _session(spark, t, "nation", "region")
    run("CREATE NAMESPACE extra")
    run("CREATE TABLE extra.nation (n_nationkey BIGINT NOT NULL, n_name STRING)")
    run("INSERT INTO extra.nation SELECT n_nationkey, n_name FROM nation")
    run("ALTER TABLE extra.nation SET TBLPROPERTIES ('owner' = 'me', 'other' = 'x')")
    run("ALTER TABLE extra.nation UNSET TBLPROPERTIES ('other')")
    key = run("ALTER TABLE extra.nation SET UNENFORCED PRIMARY KEY (n_nationkey)").first()[1]
    run("ALTER TABLE extra.nation RENAME TO extra.nations")
    run("DROP TABLE region PURGE")
    names = run("SHOW TABLES IN extra").crossJoin(run("SHOW TBLPROPERTIES extra.nations"))  # a row each
    return names.withColumn("primary_key", F.lit(key)).withColumn("n", F.lit(run("SELECT count(*) AS n FROM extra.nations").first()[0]))


@_register("SELECT n_nationkey FROM nation")
def create_at_location(spark, t):
    """A table is registered where it lies."""
    table = _table(spark, t("nation").select("n_nationkey"))
    run = _session(spark, t)
    run(f"CREATE TABLE there (n_nationkey BIGINT) LOCATION '{table.path}'")
    return run("SELECT n_nationkey FROM there")


@_register("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'update' ELSE 'insert' END AS change FROM customer WHERE c_acctbal < 0 OR c_custkey % 2 = 1")
def concurrent_commits(spark, t):
    """An append goes on top of an update that it didn't see; both are among the changes."""
    c = t("customer").select("c_custkey", "c_acctbal")
    even = c.filter("c_custkey % 2 = 0 OR c_acctbal < 0")
    table = _table(spark, even, properties={"enable_stable_row_ids": "true"})
    base = table.manifest()
    added = table._write(c.filter("c_custkey % 2 = 1 AND c_acctbal >= 0"), base)
    table.update({"c_acctbal": "0"}, "c_acctbal < 0")
    table._commit_rows(base, "append", added)
    return table.changes(since=1).select("c_custkey", "change")


@_register("SELECT 6 AS n_all, count(*) AS rows, true AS fewer FROM lineitem")
def scan_metrics(spark, t):
    table = _table(spark, t("lineitem"), parts=6, key="l_orderkey", fragment_count=6)
    indexes.create_index(table, "z", "zonemap", ["l_orderkey"])
    report = table.scan_report("l_orderkey < 100")
    return spark.createDataFrame([(report["fragments"], report["rows"], report["scanned_fragments"] < 6)], "n_all int, rows long, fewer boolean")


REFUSED = {
    "search: k": "SELECT * FROM SEARCH('docs', 'mit', k => 5)", "match: not a literal": "SELECT * FROM docs WHERE match(text, source)", "match: under OR": "SELECT * FROM docs WHERE match(text, 'mit') OR doc_id = 1",
    "match: option": "SELECT * FROM docs WHERE match(text, 'mit', 'colour=red')", "vector: metric": "SELECT * FROM VECTOR_SEARCH(table => 'docs', query_vector => array(1.0), distance_type => 'hamming')",
    "index statement": "CREATE INDEX i ON docs (doc_id)", "index method": "ALTER TABLE docs CREATE INDEX i USING hash (doc_id)", "unknown version": "SELECT * FROM docs VERSION AS OF 99",
}


@_register("SELECT unnest([" + ", ".join(f"'{x}'" for x in REFUSED) + "]) AS refused")
def refused_statements(spark, t):
    """Statements that must be refused with an error, not run in another sense."""
    run = _session(spark, t)
    t("documents").select("doc_id", "text", "source").createOrReplaceTempView("tidemark_docs")
    run("CREATE TABLE docs AS SELECT * FROM tidemark_docs")
    found = []
    for name, text in REFUSED.items():
        try:
            run(text)
        except ValueError:
            found.append((name,))
    return spark.createDataFrame(found, "refused string")


@_register("SELECT o_orderkey, o_orderstatus || '!' AS status FROM orders")
def backfill_sql(spark, t):
    run = _session(spark, t, "orders")
    run("SELECT _rowaddr, _fragid, o_orderstatus || '!' AS status FROM orders").createOrReplaceTempView("tidemark_status")
    run("ALTER TABLE orders ADD COLUMNS status FROM tidemark_status")
    return run("SELECT o_orderkey, status FROM orders")


# -- search through an index, sized joins, adopted files


@_register(f"SELECT doc_id, round(score, 6) AS score FROM ({BM25.replace('FROM documents)', "FROM documents WHERE source <> 'src2' OR source IS NULL)")}) ORDER BY score DESC, doc_id LIMIT 15")
def search_through_index(spark, t):
    """Half of the documents are in the index, the others are appended, and some of both are deleted."""
    rows = t("documents").select("doc_id", "text", "source")
    cut = rows.agg(F.percentile_approx("doc_id", 0.5)).first()[0]  # in bounded memory; where they part changes no score
    table = _table(spark, rows.filter(F.col("doc_id") <= cut), key="doc_id")
    indexes.create_index(table, "words", "fts", ["text"])
    table.append(rows.filter(F.col("doc_id") > cut))
    table.delete("source = 'src2'")
    m = table.manifest()
    scored = indexes.index_scores(table, m, "words", "MIT license")
    found = table.read(version=m.version, hidden=("_rowaddr",)).join(scored, F.col("_rowaddr") == F.col("rowaddr"))
    return found.orderBy(F.desc("_score"), "doc_id").limit(15).select("doc_id", F.round("_score", 6).alias("score"))


@_register("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000 GROUP BY n_name")
def sized_join(spark, t):
    nations = _table(spark, t("nation").withColumnRenamed("n_nationkey", "k"))
    customers = _table(spark, t("customer").withColumnRenamed("c_nationkey", "k"))
    return table_join(customers, nations, ["k"], left_where="c_acctbal > 5000").groupBy("n_name").agg(F.count("*").alias("n"))


@_register("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def join_hint(spark, t):
    sql = _session(spark, t, "orders")
    return sql("SELECT /*+ FRAGMENT_AWARE_JOIN(b) */ a.o_orderpriority, count(*) AS n FROM orders a JOIN orders b ON a._rowaddr = b._rowaddr GROUP BY a.o_orderpriority")


@_register("SELECT l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE l_quantity <= 40 GROUP BY l_linestatus")
def format_read(spark, t):
    """The data source's short name, over a table with several fragments and deleted rows."""
    from tidemark.sources.format import register

    register(spark)
    table = _table(spark, t("lineitem"))
    table.delete("l_quantity > 40")
    rows = spark.read.format("tidemark").load(table.path)
    return rows.groupBy("l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
