import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalar import bucket, fragment_or_rand
from tidemark.operators import indexes, prune, search
from tidemark.operators.joins import table_join
from tidemark.plans.dialect import Dialect
from tidemark.sources.catalog import Catalog
from tidemark.sources import table
from tidemark.sources.format import register
from tidemark.sources.scratch import scratch
from tidemark.sources.store import Conflict
from tidemark.sources.table import Table


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture
def people(spark):
    """Version 1 empty, version 2 three rows; stable ids."""
    schema = T.StructType().add("id", "integer", False).add("name", "string").add("value", "integer")
    t = Table.create(spark, scratch(spark, "people"), schema, {"enable_stable_row_ids": "true"})
    t.append(spark.createDataFrame([(1, "Alice", 100), (2, "Bob", 200), (3, "Charlie", 300)], schema))
    return t


def numbers(spark, n=40, parts=4):
    df = spark.range(n).select(F.col("id").alias("x"), (F.col("id") % 7).cast("string").alias("s"), F.when(F.col("id") % 5 != 0, F.col("id") * 2).alias("y"))
    return Table.create_as(spark, scratch(spark, "numbers"), df.repartitionByRange(parts, "x").sortWithinPartitions("x"))


def test_versions_and_time_travel(spark, people):
    assert people.versions() == [1, 2]
    assert people.read(version=1).count() == 0 and people.count() == 3
    with pytest.raises(ValueError):
        people.read(version=9)
    with pytest.raises(ValueError):
        people.read(timestamp=1.0)
    with pytest.raises(ValueError):
        people.read(timestamp=-1)
    assert people.read(timestamp=time.time() + 60).count() == 3


def test_update_keeps_ids_and_creation(people):
    cdf = ("_rowid", "_row_created_at_version", "_row_last_updated_at_version")
    before = dict((r[0], r[1]) for r in values(people.read(hidden=cdf), "id", "_rowid"))
    people.update({"value": "value + 1"}, "id = 2")
    after = values(people.read(hidden=cdf), "id", "value", *cdf)
    assert [(i, v, c, u) for i, v, _, c, u in after] == [(1, 100, 2, 2), (2, 201, 2, 3), (3, 300, 2, 2)]
    assert {i: r for i, _, r, _, _ in after} == before


def test_merge_makes_new_rows(spark, people):
    source = spark.createDataFrame([(1, 110), (2, None), (5, 50)], "id int, value int")
    people.merge(
        source, "t.id = s.id", matched=[("s.value IS NULL", None), (None, {"value": "s.value"})],
        not_matched=[(None, {"id": "s.id", "name": "'new'", "value": "s.value"})],
    )
    cdf = ("_row_created_at_version", "_row_last_updated_at_version")
    assert values(people.read(hidden=cdf), "id", "value", *cdf) == [(1, 110, 3, 3), (3, 300, 2, 2), (5, 50, 3, 3)]
    twice = spark.createDataFrame([(1, 1), (1, 2)], "id int, value int")
    with pytest.raises(ValueError):
        people.merge(twice, "t.id = s.id", matched=[(None, {"value": "s.value"})])


def test_delete_removes_empty_fragments(spark):
    t = numbers(spark)
    assert len(t.manifest().fragments) == 4
    t.delete("x < 15")
    assert t.count() == 25 and len(t.manifest().fragments) == 3
    assert t.read(version=1).count() == 40
    t.delete()
    assert t.count() == 0 and t.read().count() == 0


def test_overwrite_resets_versions(spark, people):
    people.overwrite(spark.createDataFrame([(9, "Z", 1)], people.schema))
    assert values(people.read(hidden=("_row_created_at_version",)), "id", "_row_created_at_version") == [(9, 3)]


def test_backfill(spark):
    t = numbers(spark)
    at = t.read(hidden=("_rowaddr", "_fragid"))
    before = values(t.read(hidden=("_rowaddr",)), "x", "_rowaddr")
    t.add_columns_from(at.filter("x < 5").select("_rowaddr", "_fragid", (F.col("x") * 10).alias("z")))
    assert [z for _, z in values(t.read(), "x", "z")][:6] == [0, 10, 20, 30, 40, None]
    assert values(t.read(hidden=("_rowaddr",)), "x", "_rowaddr") == before
    with pytest.raises(ValueError):
        t.add_columns_from(at.select("_rowaddr", "_fragid", F.lit(1).alias("z")))
    with pytest.raises(ValueError):
        t.update_columns_from(at.select("_rowaddr", F.lit(1).alias("y")))
    with pytest.raises(ValueError):
        t.update_columns_from(at.select("_rowaddr", "_fragid", F.lit(1).alias("nope")))
    t.update_columns_from(at.filter("x = 3").select("_rowaddr", "_fragid", F.lit(-1).cast("long").alias("y")))
    assert dict(values(t.read(), "x", "y"))[3] == -1 and dict(values(t.read(), "x", "y"))[4] == 8


CONDITIONS = st.recursive(
    st.sampled_from(["x = 7", "x < 12", "x >= 30", "x IN (1, 25)", "y IS NULL", "y IS NOT NULL", "s = '3'", "_fragid = 1", "_rowaddr IN (0, 4294967297)", "x BETWEEN 5 AND 9", "x % 2 = 0", "-1 < x", "x = 'a'"]),
    lambda c: st.one_of(st.tuples(c, st.sampled_from([" AND ", " OR "]), c).map(lambda t: f"({t[0]}{t[1]}{t[2]})"), c.map(lambda x: f"NOT ({x})")),
    max_leaves=4,
)


@pytest.fixture(scope="module")
def zoned(spark):
    t = numbers(spark)
    for c in ("x", "y", "s"):
        indexes.create_index(t, c, "zonemap", [c], rows_per_zone=4)
    t.append(spark.range(40, 45).select(F.col("id").alias("x"), F.lit("z").alias("s"), F.lit(1).cast("long").alias("y")).coalesce(1))
    return t


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(condition=CONDITIONS)
def test_pruned_scan_is_full_scan(zoned, condition):
    condition = condition.replace("x = 'a'", "s = 'a'")
    full = zoned._scan(zoned.manifest(), {"_rowaddr", "_fragid"}).filter(condition)
    assert values(zoned.read(where=condition), "x") == values(full, "x")


def test_pruning_keeps_unindexed_fragments(zoned):
    assert zoned.scan_report("x = 7")["scanned_fragments"] == 2  # its own, and the one that came later
    assert prune.address_fragments(prune.tree(zoned.spark, "_rowaddr = 4294967297 AND x > 1")) == {1}
    assert prune.address_fragments(prune.tree(zoned.spark, "_rowaddr = 1 OR x > 1")) is None
    assert prune.address_fragments(prune.tree(zoned.spark, "NOT (_rowaddr = 1)")) is None


def test_commits_conflict(spark):
    a = numbers(spark)
    b = Table(spark, a.path)
    base = a.manifest()
    b.delete("x = 1")
    stale = a._commit_rows
    with pytest.raises(Conflict):
        stale(base, "update", [], {0: 1}, [], {0})
    a._commit_rows(base, "append", [])  # appends go on top of the latest version
    assert a.count() == 39


def test_optimize_and_vacuum(spark):
    t = numbers(spark)
    t.delete("x % 2 = 0")
    made = t.optimize(target_rows_per_fragment=1000)
    assert made["fragments_removed"] == 4 and made["fragments_added"] == 1
    assert t.optimize(target_rows_per_fragment=1000) == dict.fromkeys(made, 0)
    t.create_tag("old", version=1)
    with pytest.raises(ValueError):
        t.vacuum()
    found = t.vacuum(error_if_tagged_old_versions=False)
    assert found["old_versions"] == 1 and found["bytes_removed"] > 0
    assert t.versions() == [1, 3] and t.count() == 20 and t.read(version=1).count() == 40


def test_branches_and_tags(spark):
    t = numbers(spark)
    b = t.create_branch("b")
    with pytest.raises(ValueError):
        t.create_branch("b")
    t.create_branch("b", exist_ok=True)
    b.delete("x > 3")
    assert b.count() == 4 and t.count() == 40
    t.create_tag("g", branch="b")
    assert t.create_branch("c", tag="g").count() == 4
    assert [r.name for r in t.show_branches().collect()] == ["b", "c"] and t.show_tags().first().branch == "b"
    t.drop_ref("tags", "g")
    t.drop_ref("tags", "g", missing_ok=True)
    with pytest.raises(ValueError):
        t.drop_ref("tags", "g")


def test_properties_and_schema_checks(spark, people):
    with pytest.raises(ValueError):
        people.set_properties(enable_stable_row_ids="false")
    people.set_properties(a="1")
    people.unset_properties("a", "not there")
    assert "a" not in people.manifest().properties
    vectors = T.StructType().add("v", T.ArrayType(T.FloatType()))
    with pytest.raises(ValueError):
        Table.create(spark, scratch(spark, "t"), T.StructType().add("v", T.ArrayType(T.StringType())), {"v.arrow.fixed-size-list.size": "2"})
    t = Table.create(spark, scratch(spark, "t"), vectors, {"v.arrow.fixed-size-list.size": "2"})
    t.append(spark.createDataFrame([([1.0, 2.0],), (None,)], vectors))
    with pytest.raises(Exception, match="not 2 values"):
        t.append(spark.createDataFrame([([1.0],)], vectors))
    with pytest.raises(ValueError):
        people.append(spark.range(3).toDF("id"))
    with pytest.raises(ValueError):
        Table.create(spark, scratch(spark, "t"), T.StructType().add("n", T.NullType()))


def test_primary_key(people):
    for bad in (("id", "id"), ("nope",), ("name",)):
        with pytest.raises(ValueError):
            people.set_primary_key(*bad)
    assert people.set_primary_key("id") == ["id"]
    with pytest.raises(ValueError):
        people.set_primary_key("id")


def test_index_rules(spark):
    t = numbers(spark)
    for bad in (("i", "nope", ["x"], {}), ("i", "btree", ["x", "y"], {}), ("i", "btree", ["q"], {}), ("i", "btree", ["x"], {"zone": 1}), ("i", "btree", ["x"], {"num_segments": 0}), ("i", "btree", ["x"], {"num_segments": 2, "build_mode": "range"})):
        with pytest.raises(ValueError):
            indexes.create_index(t, bad[0], bad[1], bad[2], **bad[3])
    assert indexes.create_index(t, "Late", "btree", ["x"], train=False) == (0, "late")
    assert indexes.create_index(t, "late", "btree", ["x"]) == (4, "late")
    t.append(spark.range(100, 103).select(F.col("id").alias("x"), F.lit("q").alias("s"), F.lit(None).cast("long").alias("y")))
    shown = indexes.show_indexes(t).first()
    assert (shown.num_indexed_fragments, shown.num_indexed_rows, shown.num_unindexed_rows) == (4, 40, 3)
    assert values(indexes.indexed_read(t, "late", [5, 101], "x IN (5, 101)"), "x") == [(5,), (101,)]
    assert indexes.drop_index(t, "late") == ("late", "dropped")


def test_bucket_function(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (None,), (3.5,)], "d double").select("d", bucket(8, F.col("d")).alias("b"))
    got = [r.b for r in df.collect()]
    assert got[0] == got[1] and got[2] == 0 and all(0 <= b < 8 for b in got)
    assert spark.createDataFrame([(4,), (None,)], "f int").select(fragment_or_rand(F.col("f")).alias("x")).filter("x is null").count() == 0


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, f"hello world doc_{i}", "greeting") for i in range(10)] + [(i, f"foo bar doc_{i}", "hello welcome") for i in range(10, 15)] + [(i, f"hello spark doc_{i}", "jell test") for i in range(15, 20)]
    return spark.createDataFrame(rows, "id long, body string, title string").cache()


def test_full_text(texts):
    ids = lambda c: {r.id for r in texts.filter(c).collect()}
    either, both = ids(search.match("body", "hello spark")), ids(search.match("body", "hello spark", "operator=AND"))
    assert both == set(range(15, 20)) and both < either == set(range(10)) | both
    assert ids(search.match("body", "helo")) == set() and ids(search.match("body", "helo", "fuzziness=1")) == either
    assert ids(search.match("body", "zello", "fuzziness=1,prefix_length=1")) == set()
    exact, loose = ids(search.match_phrase("body", "hello doc")), ids(search.match_phrase("body", "hello doc", 1))
    assert exact == set() and loose == either
    assert ids(search.multi_match("hello", ["body", "title"])) == set(range(20))
    assert ids(search.multi_match("hello spark", ["body", "title"], "operator=AND")) <= ids(search.multi_match("hello spark", ["body", "title"]))
    for bad in ("fuzziness", "nope=1", "operator=XOR", "max_expansions=0", "prefix_length=-1"):
        with pytest.raises(ValueError):
            search.match("body", "x", bad)
    with pytest.raises(ValueError):
        search.match_phrase("body", "x", -1)
    with pytest.raises(ValueError):
        search.multi_match("x", ["body"])
    with pytest.raises(ValueError):
        search.search(texts, "hello", row_id="id")


def test_vector_and_hybrid(spark):
    rows = [(i, t, [v] * 4) for i, t, v in ((1, "vector search", 0.0), (2, "connector function", 1.0), (3, "full text search", 10.0))]
    df = spark.createDataFrame(rows, "id int, body string, vector array<float>").withColumn("_rowid", F.col("id").cast("long"))
    near = search.vector_search(df, [0.0] * 4, 2).collect()
    assert [(r.id, r._distance) for r in near] == [(1, 0.0), (2, 4.0)]
    assert [r.id for r in search.vector_search(df, [0.0] * 4, 5, lower_bound=0.5, upper_bound=400.0).collect()] == [2]
    assert search.vector_search(df, [0.0] * 4, 1, filter="id > 1", prefilter=False).count() == 0
    found = search.hybrid_search(df, [0.0] * 4, "search text", 3, search_columns=["body"]).orderBy(F.desc("_relevance_score")).collect()
    assert {r.id for r in found} == {1, 2, 3} and found[0].id == 1
    assert found[0]._relevance_score == pytest.approx(1 / 60 + 1 / 61)
    for bad in ({"k": 0}, {"offset": -1}, {"distance_type": "x"}, {"columns": ["nope"]}, {"vector_column": "nope"}):
        with pytest.raises(ValueError):
            search.vector_search(df, [0.0] * 4, **({"k": 1} | bad))
    with pytest.raises(ValueError):
        search.vector_search(df, [])


def test_dialect(spark):
    d = Dialect(spark, Catalog(spark, scratch(spark, "warehouse")))
    d.run("CREATE NAMESPACE ns")
    d.run("CREATE TABLE ns.t (id INT NOT NULL, body STRING) TBLPROPERTIES ('enable_stable_row_ids' = 'true')")
    d.run("INSERT INTO ns.t VALUES (1, 'spark one'), (2, 'two'), (3, 'spark three')")
    assert d.run("SELECT count(*) AS n FROM ns.t").first().n == 3
    assert d.run("SELECT count(*) AS n FROM ns.t VERSION AS OF 1").first().n == 0
    d.run("UPDATE ns.t SET body = concat(body, '!') WHERE id = 2")
    d.run("DELETE FROM ns.t WHERE id = 3")
    assert values(d.run("SELECT id, body FROM ns.t"), "id", "body") == [(1, "spark one"), (2, "two!")]
    assert [r.id for r in d.run("SELECT id FROM ns.t WHERE match(body, 'spark') AND id < 9").collect()] == [1]
    for bad in ("SELECT id FROM ns.t WHERE match(body, 'spark') OR id = 2", "SELECT id FROM ns.t WHERE NOT match(body, 'a')", "CREATE INDEX i ON ns.t (id)"):
        with pytest.raises(ValueError):
            d.run(bad)
    assert d.run("ALTER TABLE ns.t CREATE INDEX I USING btree (id)").first().index_name == "i"
    assert d.run("SHOW INDEXES FROM ns.t").count() == 1
    assert d.run("ALTER TABLE ns.t DROP INDEX i").first().status == "dropped"
    assert d.run("ALTER TABLE ns.t SET UNENFORCED PRIMARY KEY (id)").first().primary_key_columns == "id"
    d.run("ALTER TABLE ns.t CREATE BRANCH b AS OF VERSION 2")
    d.run("ALTER TABLE ns.t CREATE TAG IF NOT EXISTS g AS OF BRANCH b")
    assert d.run("SHOW BRANCHES FROM ns.t").count() == 1 and d.run("SHOW TAGS IN ns.t").count() == 1
    d.run("ALTER TABLE ns.t DROP TAG g")
    d.run("ALTER TABLE ns.t DROP BRANCH IF EXISTS nope")
    d.run("ALTER TABLE ns.t SET TBLPROPERTIES ('a' = 'b')")
    assert ("a", "b") in values(d.run("SHOW TBLPROPERTIES ns.t"), "key", "value")
    assert d.run("OPTIMIZE ns.t").columns == ["fragments_removed", "fragments_added", "files_removed", "files_added"]
    assert d.run("VACUUM ns.t").columns == ["bytes_removed", "old_versions"]
    d.run("CREATE TABLE ns.v AS SELECT CAST(id AS BIGINT) AS id, array(CAST(id AS FLOAT), CAST(0 AS FLOAT)) AS vec, CAST('hello' AS STRING) AS txt FROM range(5)")
    near = d.run("SELECT id FROM VECTOR_SEARCH(table => 'ns.v', query_vector => array(3.0, 0.0), k => 2, vector_column => 'vec')")
    assert [r.id for r in near.collect()] == [3, 2]
    assert d.run("SELECT * FROM SEARCH(table => 'ns.v', query => 'hello', k => 3, search_columns => 'txt')").count() == 3
    with pytest.raises(ValueError):
        d.run("SELECT * FROM VECTOR_SEARCH('ns.v', array(1.0), k => 2)")
    assert {r.tableName for r in d.run("SHOW TABLES IN ns").collect()} == {"t", "v"}
    d.run("ALTER TABLE ns.v RENAME TO ns.w")
    d.run("DROP TABLE ns.w PURGE")
    d.run("DROP TABLE IF EXISTS ns.w")
    assert d.run("DESCRIBE ns.t").count() == 5 and d.run("SHOW FUNCTIONS").count() == 5


def test_fts_refuses_what_it_does_not_do(spark, tmp_path):
    t = Table.create_as(spark, str(tmp_path / "t"), spark.createDataFrame([("walking the dogs",)], "body string"))
    for option in ("stem", "remove_stop_words"):
        with pytest.raises(ValueError, match=option):
            indexes.create_index(t, "f", "fts", ["body"], **{option: "true"})
    indexes.create_index(t, "f", "fts", ["body"], stem="false", with_position=True)


# -- conditions by type, commits that meet, files that are being written


def test_zones_of_every_type(spark):
    """A pruned read equals a plain one, for every type, operator and kind of literal."""
    df = spark.sql("""
        SELECT cast(id AS int) i, id l, cast(id AS decimal(10,2)) - 50 d, if(id = 55, double('NaN'), id - 50.5D) f, date_add(date'2020-01-01', cast(id AS int)) day,
               timestamp_seconds(1577836800 + id * 3600) ts, concat('k', lpad(string(id), 3, '0')) s, cast(id % 2 = 0 AS boolean) b, nullif(id, 7) n FROM range(200)""")
    t = Table.create_as(spark, scratch(spark, "zones"), df.repartitionByRange(8, "l").sortWithinPartitions("l"))
    for c in df.columns:
        indexes.create_index(t, f"z_{c}", "zonemap", [c], rows_per_zone=10)
    cases = ["d = 50.00", "d = 9", "d < -40.5", "d > 1e2", "f = 50", "f > 100", "f = double('NaN')", "f >= -3.5", "i = '12'", "i = 12.0", "i > 180.5", "l BETWEEN 20 AND 30.5", "day = DATE '2020-02-01'",
             "day < '2020-01-10'", "day = '2020-2-1'", "ts >= TIMESTAMP '2020-01-08 00:00:00'", "ts = '2020-01-02 03:00:00'", "s = 'k050'", "s > 'k19'", "b = true", "n IS NULL", "n = 7", "d IN (1, 2.5, 149)", "-3 = d", "NOT i = 3", "d = null"]
    for where in cases:
        plain = sorted(r[0] for r in df.filter(where).select("l").collect())
        assert sorted(r[0] for r in t.read(where=where).select("l").collect()) == plain, where
    kept = lambda where: t.scan_report(where)["scanned_fragments"]
    assert all(kept(w) < 8 for w in ("d = 50.00", "f = 50", "day = DATE '2020-02-01'", "ts >= TIMESTAMP '2020-01-08 00:00:00'", "day < '2020-01-10'", "s > 'k19'"))


def test_changes_after_a_rebase(spark, people, monkeypatch):
    """An update that another commit overtakes counts from the version that it got."""
    write = Table._write

    def overtaken(self, df, m, **options):
        out = write(self, df, m, **options)
        monkeypatch.setattr(Table, "_write", write)
        Table(spark, people.path).append(spark.createDataFrame([(9, "Zoe", 9)], people.schema))
        return out

    monkeypatch.setattr(Table, "_write", overtaken)
    people.update({"value": "value + 1"})
    assert people.versions() == [1, 2, 3, 4]
    assert values(people.changes(since=3), "id", "change") == [(1, "update"), (2, "update"), (3, "update")]
    assert values(people.changes(since=2), "id", "change") == [(1, "update"), (2, "update"), (3, "update"), (9, "insert")]


def test_backfill_refuses_repeated_addresses(spark, people):
    rows = people.read(hidden=("_rowaddr", "_fragid")).select("_rowaddr", "_fragid", F.lit(1).alias("extra"))
    with pytest.raises(ValueError):
        people.add_columns_from(rows.union(rows.limit(1)))
    assert people.count() == people.read().count() == 3


def test_vacuum_keeps_what_is_being_written(spark, people):
    people.update({"value": "0"}, "id = 1")
    added = people._write(spark.createDataFrame([(7, "New", 7)], people.schema), people.manifest())
    assert people.vacuum(before_version=4)["old_versions"] == 2
    people._commit_rows(people.manifest(), "append", added)
    assert values(people.read(), "id") == [(1,), (2,), (3,), (7,)]
    left = people._write(spark.createDataFrame([(8, "Lost", 8)], people.schema), people.manifest())
    people.vacuum(delete_unverified=True)
    assert not people.store.exists(left[0]["file"]) and people.read().count() == 4


def test_optimize_keeps_indexes_and_shards(spark):
    df = spark.range(100).select(F.col("id").alias("x"), (F.col("id") % 10).alias("y"))
    t = Table.create_as(spark, scratch(spark, "shards"), df, sharding=["bucket", 4, "x"])
    t.append(df)
    indexes.create_index(t, "i", "btree", ["y"])
    t.optimize(target_rows_per_fragment=1000)
    m = t.manifest()
    assert m.indexes["i"]["fragments"] == [] and {f["shard"] for f in m.fragments} <= {"0", "1", "2", "3"}
    assert indexes.indexed_read(t, "i", [3], "y = 3").count() == 20


def test_store_writes_once(spark):
    t = Table.create(spark, scratch(spark, "once"), T.StructType().add("x", "long"))
    t.store.write("a/1.json", "one", new=True)
    with pytest.raises(Conflict):
        t.store.write("a/1.json", "two", new=True)
    t.store.write("a/1.json", "three")
    assert t.store.read("a/1.json") == "three" and list(t.store.list("a")) == ["1.json"]


def test_shard_join_has_no_exchange(spark):
    df = spark.range(200).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    a, b = (Table.create_as(spark, scratch(spark, "spj"), d, sharding=["bucket", 4, "k"]) for d in (df, df.filter("k % 3 = 0").withColumnRenamed("v", "w")))
    from tidemark.operators.joins import shard_join

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = shard_join(a, b, "k")
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        assert values(out, "k", "v", "w") == [(i, 2 * i, 2 * i) for i in range(0, 200, 3)]
        assert shard_join(a, b, "k", "left").count() == 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_match_folds_the_query_as_the_text(spark):
    df = spark.createDataFrame([("Café au lait",), ("cafe",), ("coffee",)], "t string")
    assert df.filter(search.match("t", "café", ascii_folding=True)).count() == 2
    assert df.filter(search.match_phrase("t", "CAFÉ AU", ascii_folding=True)).count() == 1


def test_dialect_strings_commas_and_merge(spark):
    sql = Dialect(spark, Catalog(spark, scratch(spark, "merge"))).run
    sql("CREATE TABLE a AS SELECT id, concat('n', id) AS n FROM range(5)")
    sql("CREATE TABLE b AS SELECT id AS bid, id * 10 AS w FROM range(3, 8)")
    sql("UPDATE a SET n = 'u, WHERE v' WHERE id = 1 -- a comment, FROM b")
    assert sql("SELECT n FROM a WHERE id = 1").first()[0] == "u, WHERE v"
    assert sql("SELECT 'FROM a, b' AS x, count(*) AS c FROM a, b x WHERE a.id = x.bid").first() == ("FROM a, b", 2)
    assert sql("SELECT count(*) AS c FROM a JOIN (SELECT bid FROM b WHERE w > 30) q ON q.bid = a.id, b WHERE b.bid = 7").first()[0] == 1
    assert sql("WITH q AS (SELECT * FROM a) SELECT q.id FROM q WHERE EXISTS (SELECT 1 FROM b WHERE b.bid = q.id) ORDER BY 1").collect() == [(3,), (4,)]
    plan = sql("SELECT count(*) FROM a")._jdf.queryExecution().toString()
    assert sql("SELECT count(*) AS c FROM a").first()[0] == 5 and "parquet" not in plan.lower()
    sql("MERGE INTO a AS x USING (SELECT bid, w FROM b) y ON x.id = y.bid WHEN MATCHED AND y.w = 30 THEN DELETE WHEN MATCHED THEN UPDATE SET n = concat('it''s ', x.n, ',', y.w) WHEN NOT MATCHED AND y.bid > 5 THEN INSERT (id, n) VALUES (y.bid, 'new')")
    assert values(sql("SELECT * FROM a"), "id", "n") == [(0, "n0"), (1, "u, WHERE v"), (2, "n2"), (4, "it's n4,40"), (6, "new"), (7, "new")]
    sql("MERGE INTO a USING a2 ON a.id = a2.id WHEN MATCHED THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *") if sql("CREATE TABLE a2 AS SELECT 0L AS id, 'z' AS n") else None
    assert values(sql("SELECT * FROM a WHERE id = 0"), "n") == [("z",)]
    with pytest.raises(ValueError):
        sql("MERGE INTO a USING a2 ON a.id = a2.id WHEN NOT MATCHED BY SOURCE THEN DELETE")
    assert sql("SELECT id FROM a VERSION AS OF 1 AS o WHERE o.id < 2 ORDER BY id").collect() == [(0,), (1,)]


def texts_table(spark, path):
    rows = [(i, f"alpha {'beta ' * (i % 4)}the gamma{i % 3} word" if i % 9 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, body string").repartitionByRange(3, "id")
    return Table.create_as(spark, path, df)


@pytest.mark.parametrize("options", [{}, {"lower_case": "false"}, {"base_tokenizer": "ngram"}])
def test_index_scores_equal_those_of_a_scan(spark, tmp_path, options):
    """After appends, deletes and compaction too; a term in all rows, several terms, fuzzy ones."""
    t = texts_table(spark, str(tmp_path / "t"))
    indexes.create_index(t, "f", "fts", ["body"], **options)
    analysis = indexes._analysis(options)

    def same(query, opts=None):
        m = t.manifest()
        got = {r[0]: round(r[1], 9) for r in indexes.index_scores(t, m, "f", query, opts).collect()}
        want = {r[0]: round(r[1], 9) for r in search.bm25(t.read(hidden=("_rowaddr",)), ["body"], query, "_rowaddr", opts, **analysis).collect()}
        assert got == want
        return len(got)

    assert same("beta gamma1") > 0 and same("alpha") > 0 and same("nothing") == 0
    same("beta gamma2", "operator=AND,boost=2")
    t.append(spark.createDataFrame([(100, "beta beta new"), (101, None)], "id long, body string"))
    t.delete("id < 10 or id = 100")
    same("beta gamma0")
    t.optimize(target_rows_per_fragment=1000)
    same("beta gamma0")
    if not options:
        same("betta gamm1", "fuzziness=1")
    with pytest.raises(ValueError):
        indexes.index_scores(t, t.manifest(), "f", "--")


def test_search_reads_fragments_of_its_hits(spark, tmp_path):
    d = Dialect(spark, Catalog(spark, str(tmp_path / "w")))
    t = texts_table(spark, str(tmp_path / "other"))
    d.run("CREATE TABLE docs (id bigint, body string)")
    d.catalog.table("docs").append(t.read())
    query = "SELECT * FROM SEARCH(table => 'docs', query => 'beta', k => 5, search_columns => 'body'{})"
    plain = [[tuple(r) for r in d.run(query.format(x)).collect()] for x in ("", ", filter => 'id > 20'")]
    d.run("ALTER TABLE docs CREATE INDEX words USING fts (body)")
    assert [[tuple(r) for r in d.run(query.format(x)).collect()] for x in ("", ", filter => 'id > 20'")] == plain


def test_manifests_are_cached_until_the_table_is_made_again(spark, tmp_path):
    path = str(tmp_path / "t")
    t = Table.create_as(spark, path, spark.range(5).toDF("a"))
    first = t.manifest()
    reads = []
    t.store.read = lambda name, real=t.store.read: reads.append(name) or real(name)
    assert t.manifest() == first and not reads
    first.properties["x"] = "y"  # a caller's copy is its own
    assert t.manifest().properties == {}
    t.store.delete("")
    assert Table.create_as(spark, path, spark.range(7).toDF("b")).manifest().rows == 7
    assert Table(spark, path).schema.names == ["b"]


def test_statistics_size_a_join(spark, tmp_path):
    small, big = numbers(spark, 40), Table.create_as(spark, str(tmp_path / "b"), spark.range(1000).select(F.col("id").alias("x"), F.lit("w" * 50).alias("w")))
    indexes.create_index(small, "z", "zonemap", ["x"])
    whole, part = small.statistics(), small.statistics("x < 10")
    assert whole["rows"] == 40 and part["rows"] == 10 and 1 <= part["bytes"] < whole["bytes"]
    assert 1 <= small.statistics(columns=["x"])["bytes"] < whole["bytes"]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    joined = table_join(big, small, ["x"])
    assert joined.count() == 40 and "rightHint=(strategy=broadcast)" in plan(joined)
    assert "broadcast" not in plan(table_join(big, small, ["x"], limit=1)) and "broadcast" not in plan(table_join(small, big, ["x"], "full"))
    assert table_join(small, big, ["x"], "left").count() == 40 and table_join(big, small, ["x"], "left_anti").count() == 960


def test_adopted_files_stay_where_they_are(spark, tmp_path):
    source = tmp_path / "in"
    spark.range(30).select("id", (F.col("id") % 3).alias("g")).repartition(3).write.parquet(str(source))
    t = Table.adopt(spark, str(tmp_path / "t"), str(source))
    assert t.count() == 30 and len(t.manifest().fragments) == 3
    assert t.read(hidden=("_rowaddr",)).select("_rowaddr").distinct().count() == 30
    t.delete("g = 0")
    t.update({"g": "7"}, "id = 1")
    t.optimize()
    t.vacuum(delete_unverified=True)
    assert sorted(map(tuple, t.read().collect())) == sorted((i, 7 if i == 1 else i % 3) for i in range(30) if i % 3)
    assert spark.read.parquet(str(source)).count() == 30
    with pytest.raises(ValueError):
        Table.adopt(spark, str(tmp_path / "t"), str(source))
    spark.range(4).selectExpr("id", "id % 2 AS p").write.partitionBy("p").parquet(str(tmp_path / "parts"))
    with pytest.raises(ValueError):
        Table.adopt(spark, str(tmp_path / "u"), str(tmp_path / "parts"))
    spark.createDataFrame([], "a long").write.parquet(str(tmp_path / "empty"))
    assert Table.adopt(spark, str(tmp_path / "e"), str(tmp_path / "empty")).read().count() == 0


def test_format_reads_versions_types_and_null_columns(spark, tmp_path):
    from tidemark.sources.format import register

    register(spark)
    path = str(tmp_path / "t")
    df = spark.sql("SELECT id, CAST(id AS DECIMAL(9, 2)) AS d, DATE '2024-01-02' AS day, TIMESTAMP '2024-01-02 03:04:05.000006' AS at, array(id, NULL) AS l, IF(id % 2 = 0, 's', NULL) AS s, struct(id AS x) AS st FROM range(20)")
    t = Table.create_as(spark, path, df.repartition(2))
    t.delete("id IN (3, 4)")
    read = lambda **o: sorted(map(tuple, spark.read.format("tidemark").options(**o).load(path).collect()))
    assert read() == sorted(map(tuple, t.read().collect())) and len(read(version=1, batch_size=3)) == 20
    t.append(spark.sql("SELECT * FROM (SELECT 99L AS id, CAST(1 AS DECIMAL(9, 2)) AS d, DATE '2024-01-02' AS day, TIMESTAMP '2024-01-02 03:04:05' AS at, array(1L) AS l, 'x' AS s, struct(1L AS x) AS st)"))
    assert len(read()) == 19
    for bad in ({"version": 77}, {"nonsense": 1}):
        with pytest.raises(Exception, match="version 77|unknown options"):
            read(**bad)


# -- tables that are larger than a task


def test_addresses_and_fragments_do_not_depend_on_the_size(spark, monkeypatch):
    """Files of few rows and bytes stand for a large table: addresses still follow the key in one fragment, and six fragments stay six."""
    import duckdb

    from tidemark.plans import tables

    monkeypatch.setattr(table, "TASK_BYTES", 4 << 10)
    monkeypatch.setattr(table.WriteOptions.__init__, "__defaults__", tuple(100 if x == 1_000_000 else x for x in table.WriteOptions.__init__.__defaults__))  # rows of a file
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for name in ("orders", "lineitem"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name in ("row_addresses", "row_address_pruning", "scan_metrics"):
        want = con.sql(tables.SQL[name])
        assert values(tables.QUERIES[name](spark, sf), *want.columns) == sorted(want.fetchall()), name


def in_files(spark, rows=30, files=5):
    """x in order as two fragments of several files."""
    df = spark.range(rows).select(F.col("id").alias("x"), (F.col("id") * 2).alias("y"))
    t = Table.create_as(spark, scratch(spark, "pieces"), df.repartitionByRange(files, "x").sortWithinPartitions("x"), fragment_count=2)
    assert [len(f.get("files", [1])) for f in t.manifest().fragments] == [2, 3] and t.count() == rows
    return t


def test_fragments_of_several_files(spark):
    t = in_files(spark)
    half = t.manifest().fragments[0]["rows"]
    address = lambda x: x if x < half else (1 << 32) + x - half
    assert values(t.read(hidden=("_rowaddr",)), "x", "_rowaddr") == [(x, address(x)) for x in range(30)]
    assert values(t.read(where=f"_rowaddr IN (3, {address(29)})"), "x") == [(3,), (29,)]
    view = t.read(hidden=("_rowaddr", "_fragid")).filter("x >= 5").select("_rowaddr", "_fragid", (F.col("x") + 1).alias("z"))
    t.add_columns_from(view)
    assert values(t.read(hidden=("_rowaddr",)), "x", "_rowaddr", F.coalesce("z", F.lit(0))) == [(x, address(x), x + 1 if x >= 5 else 0) for x in range(30)]
    t.delete("x % 3 = 0 OR x < 8")
    rest = [x for x in range(8, 30) if x % 3]
    assert values(t.read(), "x") == [(x,) for x in rest] and t.count() == len(rest)
    register(spark)
    assert values(spark.read.format("tidemark").load(t.path), "x", "y") == [(x, 2 * x) for x in rest]
    t.update_columns_from(t.read(hidden=("_rowaddr", "_fragid")).select("_rowaddr", "_fragid", F.lit(-1).alias("y")))
    found = values(t.read(hidden=("_rowaddr",)), "_rowaddr", "x", "y")
    assert [(x, y) for _, x, y in found] == [(x, -1) for x in rest]
    for f in t.manifest().fragments:  # the addresses of a fragment go on without a gap
        assert [a - (f["id"] << 32) for a, *_ in found if a >> 32 == f["id"]] == list(range(f["rows"]))
    t.vacuum(delete_unverified=True)
    assert values(t.read(), "x") == [(x,) for x in rest]
    t.optimize(target_rows_per_fragment=1000)
    assert values(t.read(), "x") == [(x,) for x in rest] and len(t.manifest().fragments) == 1


def test_text_index_is_built_by_tasks_of_bounded_size(spark, monkeypatch):
    """One fragment of texts is indexed by as many tasks as its bytes need, without grouping postings; each term has all its places."""
    texts = [(i, " ".join(f"w{(i * j) % 97}" for j in range(i % 50))) for i in range(300)] + [(300, ""), (301, None)]
    t = Table.create_as(spark, scratch(spark, "posts"), spark.createDataFrame(texts, "id long, txt string").coalesce(1))
    monkeypatch.setattr(table, "TASK_BYTES", 1 << 10)
    indexes.create_index(t, "f", "fts", ["txt"])
    place = t.store.path(t.manifest().indexes["f"]["place"])
    posts = spark.read.parquet(place)
    assert len(t.manifest().fragments) == 1 and len(posts.inputFiles()) >= 8
    want = {}
    for a, (_, text) in enumerate(texts):
        for i, w in enumerate((text or "").split()):
            want.setdefault((w, t.manifest().fragments[0]["id"] * 2**32 + a, len(text.split())), []).append(i)
    assert {(r.term, r.rowaddr, r.length): r.places for r in posts.collect()} == want
    plan = indexes._posts(t.read().select(F.col("txt").alias("v"), F.col("id").alias("rowaddr")), {})._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan


#: Queries whose table was written by four or eight tasks whatever its size.
DEALT = "search_through_index format_read index_bloomfilter limit_pruning tpch_q1 zonemap_pruning match_and search_bm25 match_phrase multi_match".split()


@pytest.mark.parametrize("name", DEALT)
def test_tables_of_queries_are_dealt_by_their_bytes(spark, monkeypatch, name):
    """Tasks of few bytes stand for a large table: it is written by more than eight, and the rows are those of the SQL."""
    import duckdb

    from tidemark.plans import tables

    monkeypatch.setattr(table, "TASK_BYTES", 8 << 10)
    made, write = [], Table._write
    monkeypatch.setattr(Table, "_write", lambda *a, **b: made.append(write(*a, **b)) or made[-1])
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for x in ("lineitem", "documents"):
        con.sql(f"CREATE VIEW {x} AS SELECT * FROM '{sf}/{x}.parquet'")
    want = con.sql(tables.SQL[name])
    got = values(tables.QUERIES[name](spark, sf), *want.columns)
    assert got == sorted(want.fetchall()) and len(made[0]) > 8


def test_large_shards_are_written_and_joined_by_several_tasks(spark, monkeypatch):
    """A shard's rows go to several files, and its join isn't one task; a small shard is still joined as it lies."""
    from tidemark.operators import joins

    rows = spark.range(4000).select((F.col("id") % 900).alias("k"), F.col("id").alias("v"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("s"))
    rows.write.parquet(f := scratch(spark, "rows"))
    monkeypatch.setattr(table, "TASK_BYTES", 1 << 10)
    make = lambda df: Table.create_as(spark, scratch(spark, "shards"), df, sharding=["bucket", 2, "k"])
    a, b = make(spark.read.parquet(f)), make(spark.read.parquet(f).filter("k < 600 AND v < 1800").select("k", F.col("v").alias("w")))
    files = [[x["shard"] for x in t.manifest().fragments] for t in (a, b)]
    assert all({*x} == {"0", "1"} and len(x) > 8 for x in files)
    assert a.read().exceptAll(spark.read.parquet(f)).count() == 0 and a.count() == 4000
    sizes = sorted(sum(x["bytes"] for t in (a, b) for x in t.manifest().fragments if x["shard"] == s) for s in "01")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for limit, exchanges in ((sizes[0] - 1, 2), (sizes[0], 2), (sizes[1], 0)):  # both large, one, none
            monkeypatch.setattr(joins, "SHARD_BYTES", limit)
            for how in ("inner", "left", "full"):
                out = joins.shard_join(a, b, "k", how)
                assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == exchanges, (limit, how)
                want = a.read().join(b.read(), "k", how)
                assert out.exceptAll(want).count() == 0 and out.count() == want.count() > 4000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
