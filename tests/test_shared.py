"""Tables that a computation writes for itself go with it, and only those."""

from __future__ import annotations

import threading
from pathlib import Path

import pytest

from loomwatch import shared


def there(df) -> bool:
    return all(Path(f.removeprefix("file:")).exists() for f in df.inputFiles())


def test_settled_removes_its_own_tables_only(spark):
    held = shared.written(spark.range(3), "held")
    inner, nested = [], []

    def make():
        inner.append(shared.written(spark.range(5), "inner"))
        nested.append(shared.settled(lambda: shared.written(held.unionByName(inner[0]), "deep"), "nested"))
        return nested[0].selectExpr("id + 1 AS id")

    out = shared.settled(make, "out")
    assert sorted(r.id for r in out.collect()) == [1, 1, 2, 2, 3, 3, 4, 5]
    assert there(held) and there(out)
    assert not there(inner[0]) and not there(nested[0])
    shared.remove(held)
    assert not there(held)


def test_two_at_once(spark):
    begun, other, kept = threading.Event(), threading.Event(), []

    def elsewhere():
        begun.wait(60)
        kept.append(shared.written(spark.range(7), "other"))
        other.set()

    t = threading.Thread(target=elsewhere)
    t.start()

    def make():
        begun.set()
        other.wait(60)
        return spark.range(2)

    assert shared.settled(make, "mine").count() == 2
    t.join()
    assert there(kept[0]) and kept[0].count() == 7


def test_a_failure_leaves_the_outer_list_as_it_was(spark):
    def make():
        with pytest.raises(ZeroDivisionError):
            shared.settled(lambda: 1 / 0, "fails")
        return shared.written(spark.range(1), "inner")

    assert shared.settled(make, "out").count() == 1
