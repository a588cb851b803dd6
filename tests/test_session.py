"""Stored tables and their release."""

import os

from undertone.session import durable, release


def test_only_stored_tables_are_released(spark):
    one, two = durable(spark.range(5), "one"), durable(spark.range(0), "two")
    folders = [os.path.dirname(t.inputFiles()[0]).removeprefix("file://") for t in (one, two)]
    derived = two.filter("id > 1")
    release(derived, spark.range(3))
    assert all(os.path.isdir(f) for f in folders) and derived.count() == 0
    release(one, one)
    assert [os.path.isdir(f) for f in folders] == [False, True]
