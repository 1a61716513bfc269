"""Queries against their SQL, or plain versions, on small inputs with the traits of large tables."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from civilake import session
from civilake.operators import ordering, substrings, vectors
from civilake.plans import catalogue
from civilake.session import work_path
from civilake.sources import html
from civilake.streaming import state
from tests.test_queries import DATA, rows_of


@pytest.fixture
def same_as_sql(spark, tmp_path):
    """Runs a query and its SQL on the smallest tables, some of them given anew."""

    def check(name, **tables):
        duck = duckdb.connect()
        for file in os.listdir(DATA):
            table = file.removesuffix(".parquet")
            if table in tables:
                tables[table].coalesce(1).write.parquet(f"{tmp_path}/{file}")
            else:
                os.symlink(f"{DATA}/{file}", f"{tmp_path}/{file}")
            duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{file}{'/*.parquet' if table in tables else ''}'")
        found, wanted = catalogue.QUERIES[name](spark, str(tmp_path)), duck.sql(catalogue.ORACLES[name])
        rows = rows_of(found.columns, found.collect())
        assert rows and rows == rows_of(wanted.columns, wanted.fetchall())
        return rows

    return check


@pytest.mark.parametrize("name", ["list_records", "resumed_collection"])
def test_numbers_of_five_digits(spark, same_as_sql, name):
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet")
    near = F.col("l_partkey") % 3  # places so near that values reach over them
    same_as_sql(name, lineitem=lines.withColumns({"l_suppkey": 9_000 + F.xxhash64("l_orderkey", "l_partkey", "l_suppkey") % 9_000 + F.col("l_linenumber"), "l_linenumber": F.lit(1), "l_partkey": near}).distinct())


def test_monitor_of_more_rows_than_a_chunk(spark):
    """One service's rows of a batch reach the processor in several chunks, none of which holds the last numbers alone."""
    numbers = list(range(25_000))
    random.Random(8).shuffle(numbers)
    landed, out, checkpoint = (work_path(spark, f"chunks-{x}") for x in ("landed", "out", "checkpoint"))
    spark.createDataFrame([("a", n, float(n), n % 3 == 0) for n in numbers], "service string, number bigint, millis double, ok boolean").write.json(landed)
    stream = spark.readStream.schema("service string, number bigint, millis double, ok boolean").json(landed)
    row = state.run_available(state.monitored(stream, 50, 1e9), out, checkpoint).first()
    assert (row.total_calls, row.success, row["mean"]) == (25_000, sum(n % 3 == 0 for n in numbers if n >= 24_950), 24_974.5)


def test_searches_of_many_queries(spark):
    """More queries times cells than one broadcast takes, and a cell of more vectors than a block."""
    rng = np.random.default_rng(4)
    data = rng.normal(size=(3000, 8)).astype(np.float32)
    data[500:900] = data[5]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id bigint, v array<float>")
    index = vectors.build(table, "id", "v", work_path(spark, "many"), 40)
    queries = vectors.usable(table.where("id < 2600"), "id", "v")
    unit = data.astype(float) / np.linalg.norm(data.astype(float), axis=1, keepdims=True)
    score = np.round(unit[:2600] @ unit.T, 6)
    wanted = {(q, n + 1, int(i)) for q in range(2600) for n, i in enumerate(np.lexsort((np.arange(3000), -score[q]))[:3])}
    found = {(r.query, r["rank"], r.id) for r in vectors.search(index, queries, 3).collect()}
    assert len(found) == 7800 and len(found ^ wanted) <= 4  # half a last digit

def test_keywords_of_a_common_form(spark, capsys):
    """Texts and keywords that share all short grams: a keyword meets those few texts alone that have a long one."""
    names = spark.range(20_000).select(F.concat(F.lit("review of bill "), 10_000_000 + F.col("id"), F.lit(" of 2001-01-01 as amended")).alias("t"))
    keywords = spark.range(20_000).select(F.concat(F.lit("bill "), 10_000_000 + F.col("id") * 2, F.lit(" of 2001-01-01")).alias("k"))
    met = substrings.contained(names, keywords, "t", "k")
    assert met.count() == 10_000
    met.explain()
    assert "Broadcast" not in capsys.readouterr().out


def parts(rows):
    return rows.rdd.getNumPartitions()


def test_words_of_pages_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 100)
    rows = spark.range(10_000).select((F.col("id") % 500).alias("p"), F.col("id").cast("double").alias("x"), "id")
    assert parts(ordering.gap_clusters(rows, ["p"], "x", "id", 3, 10.0)) == 101


def test_pages_of_one_file_are_read_by_many_tasks(spark):
    pages = spark.range(0, 100, 1, 1).select("id", F.lit("<table><tr><td>1</td></tr></table>").alias("html"))
    rows = html.table_rows(pages, "id", "html")
    assert parts(rows) >= 4 and rows.count() == 100


@pytest.mark.parametrize("name", ["similar_self_join", "alternative_bills", "mapped_answers"])
def test_work_is_dealt_evenly_whatever_its_bytes(spark, same_as_sql, name):
    same_as_sql(name)
    assert parts(catalogue.QUERIES[name](spark, DATA)) >= 4


@pytest.mark.parametrize("name", ["poll_pages"])
def test_reports_are_made_once(spark, capsys, name):
    """One pass over orders and lines, dealt out by report."""
    catalogue.QUERIES[name](spark, DATA).explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan") == 2 and "REPARTITION_BY_NUM" in plan


def test_words_are_shuffled_once(spark, capsys):
    """Words are dealt out by page, and nothing after that shuffles them again."""
    catalogue.QUERIES["word_layout"](spark, DATA).explain()
    plan = capsys.readouterr().out
    assert plan.count("+- Exchange") == plan.count("REPARTITION_BY_NUM") > 0


def test_profiled_reports_are_dealt_out(spark, capsys):
    catalogue.QUERIES["document_profile"](spark, DATA).explain()
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out


@pytest.mark.parametrize("name", ["document_profile", "table_shapes"])
def test_profiled_reports_are_made_once(spark, same_as_sql, capsys, name):
    """One pass over orders and lines, and of its reports only texts or tables, whichever is read."""
    same_as_sql(name)
    catalogue.QUERIES[name](spark, DATA).explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan") == 2 and ("format_string([표 %d] about" in plan) == (name == "document_profile") and ("구분" in plan) == (name == "table_shapes")


def test_cells_are_dealt_out(spark, capsys):
    catalogue.QUERIES["unmerged_cells"](spark, DATA).explain()
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out


@pytest.mark.parametrize("name", ["page_screening", "document_profile"])
def test_reports_of_a_thousand_questions(spark, same_as_sql, name):
    """One customer has all orders, so that questions' numbers have four figures."""
    same_as_sql(name, orders=spark.read.parquet(f"{DATA}/orders.parquet").withColumn("o_custkey", F.lit(7)))
