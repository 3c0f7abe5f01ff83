import pytest

from tests.test_tables import values
from tidemark.sources.scratch import scratch
from tidemark.sources.table import Table
from tidemark.streaming.incremental import Consumer


def test_consumer_sees_each_change_once(spark):
    rows = lambda *ids: spark.createDataFrame([(i, i * 10) for i in ids], "id long, v long")
    table = Table.create_as(spark, scratch(spark, "t"), rows(1, 2), {"enable_stable_row_ids": "true"})
    consumer, seen = Consumer(table, scratch(spark, "state")), []
    keep = lambda df, version: seen.append((version, values(df, "id", "change")))
    assert consumer.poll(keep) == 1 and consumer.poll(keep) == 1
    table.append(rows(3))
    table.update({"v": "0"}, "id = 1")
    consumer.poll(keep)
    assert seen == [(1, [(1, "insert"), (2, "insert")]), (3, [(1, "update"), (3, "insert")])]
    table.append(rows(4))

    def fail(df, version):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        consumer.poll(fail)
    assert consumer.version == 3 and consumer.poll(keep) == 4
