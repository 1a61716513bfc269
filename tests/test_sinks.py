"""Tables published together, totals over ranges, and answers read by mappers."""

import random

import pytest
from pyspark.sql import functions as F

from civilake.operators import ordering
from civilake.session import work_path
from civilake.sinks import versions
from civilake.sources import mapped


def test_versions(spark):
    root = work_path(spark, "versions")
    table = lambda n: spark.range(n)
    with pytest.raises(FileNotFoundError):
        versions.read(spark, root, "a")
    assert versions.publish(spark, root, {"a": table(3), "b": table(4)}) == 1
    assert versions.publish(spark, root, {"a": table(5), "b": table(6)}) == 2
    assert [versions.read(spark, root, t).count() for t in "ab"] == [5, 6]
    assert [versions.read(spark, root, t, 1).count() for t in "ab"] == [3, 4]
    broken = table(2).withColumn("id", F.when(F.col("id") >= 0, F.raise_error(F.lit("broken"))).cast("long"))
    with pytest.raises(Exception, match="broken"):
        versions.publish(spark, root, {"a": table(9), "b": broken})
    assert versions.current(spark, root) == 2 and versions.read(spark, root, "a").count() == 5
    with pytest.raises(versions.Conflict):
        versions.publish(spark, root, {"a": table(7)}, base=1)
    assert versions.publish(spark, root, {"a": table(8), "b": table(1)}, base=2) == 3
    versions.drop_old(spark, root, 2)
    assert versions.read(spark, root, "a", 2).count() == 5 and versions.read(spark, root, "b").count() == 1
    with pytest.raises(FileNotFoundError):
        versions.read(spark, root, "a", 1)


def test_of_two_writers_one_publishes(spark, monkeypatch):
    """Both see the same newest version until the rename itself."""
    root = work_path(spark, "versions")
    versions.publish(spark, root, {"a": spark.range(1)})
    real = versions.current
    monkeypatch.setattr(versions, "current", lambda s, r: 1)
    assert versions.publish(spark, root, {"a": spark.range(2)}, base=1) == 2
    calls = iter([1, 2])
    monkeypatch.setattr(versions, "current", lambda s, r: next(calls))
    with pytest.raises(versions.Conflict):
        versions.publish(spark, root, {"a": spark.range(3)}, base=1)
    monkeypatch.setattr(versions, "current", real)
    assert versions.current(spark, root) == 2 and versions.read(spark, root, "a").count() == 2


def test_running_totals(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(20), i, rng.choice([None, *range(-3, 9)])) for i in range(400)]
    found = ordering.running_totals(spark.createDataFrame(rows, "day int, id int, n long").repartition(7), ["day", "id"], "n", work_path(spark, "totals")).collect()
    total, wanted = 0, {}
    for day, i, n in sorted(rows, key=lambda r: (r[0], r[1])):
        total += n or 0
        wanted[i] = total
    assert {r.id: r.running for r in found} == wanted
    empty = ordering.running_totals(spark.createDataFrame([], "day int, n long"), ["day"], "n", work_path(spark, "totals"))
    assert empty.count() == 0


def test_mapped_answers(spark):
    pages = [
        ("j", '{"r":{"code":"00","total":"3","list":[{"id":1},{"id":null},7]}}'), ("j", '{"r":{"code":"00","list":{"id":2}}}'), ("j", '{"r":{"code":"03"}}'), ("j", '{"r":{"code":"99","list":[{"id":9}]}}'),
        ("j", "{broken"), ("j", None), ("j", '{"r":{"list":[{"id":8}]}}'), ("x", "<a><n>007</n><item k='1'><id>4</id></item><item><id>05</id></item></a>"), ("x", "<a><item><id>6</id></item></a>"), ("x", "<a/>"),
        ("f", '{"one":{"rows":[{"id":"p"}]},"two":{"rows":[{"id":"q"}]}}'), ("none", "{}"),
    ]
    ids = {"id": "$.id"}
    mappers = [("j", "$.r.list", "$.r.total", "$.r.code", ["00"], ["03"], False, False, None, ids), ("x", "$.item", "$.n", None, [], [], True, False, None, ids), ("f", "$.nothing", None, None, [], [], False, True, ".rows", ids)]
    table, known = spark.createDataFrame(pages, "endpoint string, body string"), spark.createDataFrame(mappers, mapped.MAPPER)
    rows = sorted(((r.endpoint, r.id) for r in mapped.rows(table, known, ["id", "more"]).collect()), key=str)
    assert rows == sorted([("f", "p"), ("j", "1"), ("j", "2"), ("j", None), ("j", None), ("x", "05"), ("x", "4"), ("x", "6")], key=str)
    totals = {r.endpoint: (r.pages, r.failed, r.rows, r.total, r.complete) for r in mapped.totals(table, known).collect()}
    assert totals == {"j": (7, 4, 4, 3, True), "x": (3, 0, 3, 7, False), "f": (1, 0, 1, 0, True)}
