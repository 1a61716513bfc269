"""HTML pages as rows: the cells of every table, read by the standard library's parser inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civilake.session import spread

ROWS = "table_no int, row_no int, cells array<struct<header:boolean,text:string>>"


class TableCells(HTMLParser):
    """Collects (table, row, is header, text) of each cell; tables count in the order they open, nested ones too."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int, int, list[tuple[bool, str]]]] = []
        self.open: list[list[int]] = []
        self.tables = 0
        self.cell: list[str] | None = None
        self.header = False

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append([self.tables, 0])
            self.tables += 1
        elif tag == "tr" and self.open:
            table = self.open[-1]
            self.rows.append((table[0], table[1], []))
            table[1] += 1
        elif tag in ("td", "th") and self.open and self.rows:
            self._finish()
            self.cell, self.header = [], tag == "th"

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self._finish()
        if tag == "table" and self.open:
            self.open.pop()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def _finish(self):
        if self.cell is not None:
            self.rows[-1][2].append((self.header, " ".join("".join(self.cell).split())))
            self.cell = None


def table_rows(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``id_col, table_no, row_no, cells``: one row per table row of each page, numbered from 0; null pages give none."""
    cell = pa.struct([("header", pa.bool_()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids, found = [], []
                for i, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    reader = TableCells()
                    reader.feed(page or "")
                    reader.close()
                    ids += [i] * len(reader.rows)
                    found += reader.rows
                cells = [[{"header": h, "text": t} for h, t in row] for _, _, row in found]
                yield pa.record_batch(
                    [pa.array(ids, part.column(0).type), pa.array([r[0] for r in found], pa.int32()), pa.array([r[1] for r in found], pa.int32()), pa.array(cells, pa.list_(cell))],
                    names=[id_col, "table_no", "row_no", "cells"],
                )

    wanted = spread(pages.select(F.col(id_col), F.col(html_col)), id_col)  # a small file may hold very many pages, and reading them is all the work
    return wanted.mapInArrow(run, f"{id_col} {wanted.schema[id_col].dataType.simpleString()}, {ROWS}")


def header_pairs(rows: DataFrame, id_col: str) -> DataFrame:
    """``id_col, label, value`` of each header cell that a data cell follows in its row."""
    following = F.transform(F.sequence(F.lit(0), F.size("cells") - 2), lambda i: F.struct(F.get("cells", i).alias("a"), F.get("cells", i + 1).alias("b")))
    pairs = rows.where("size(cells) > 1").select(id_col, F.explode(following).alias("p")).where("p.a.header AND NOT p.b.header")
    return pairs.select(id_col, F.col("p.a.text").alias("label"), F.col("p.b.text").alias("value"))


def fields_of(rows: DataFrame, id_col: str) -> DataFrame:
    """``id_col, fields``: a map from each header text of a page to the data cells that follow it, in the order of tables and rows."""
    pairs = rows.where("size(cells) > 1").select(id_col, "table_no", "row_no", F.posexplode(F.arrays_zip(F.slice("cells", 1, F.size("cells") - 1), F.slice("cells", 2, F.size("cells") - 1))).alias("n", "p"))
    named = pairs.where("p.`0`.header AND NOT p.`1`.header").select(id_col, F.col("p.0.text").alias("label"), F.struct("table_no", "row_no", "n", F.col("p.1.text").alias("text")).alias("x"))
    listed = named.groupBy(id_col, "label").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]).alias("values"))
    return listed.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("label", "values"))).alias("fields"))


class ListAnchors(HTMLParser):
    """Collects (address, column texts) of each list entry: an anchor of a row that leads to a detail page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.entries: list[tuple[str, list[str]]] = []
        self.inside = self.column = False

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        classes = (found.get("class") or "").split()
        address = found.get("href") or ""
        if tag == "a":
            self.inside = {"row", "tr"} <= set(classes) and "view.do" in address and "nttId=" in address
            if self.inside:
                self.entries.append((address, []))
        elif tag == "span" and self.inside and "col" in classes:
            self.column = True
            self.entries[-1][1].append("")

    def handle_endtag(self, tag):
        self.column = self.column and tag != "span"
        self.inside = self.inside and tag != "a"

    def handle_data(self, data):
        if self.column:
            self.entries[-1][1][-1] += data


def list_entries(pages: DataFrame, id_col: str, html_col: str, base: str, least: int = 8) -> DataFrame:
    """``id_col, columns, detail_url``: each list entry with at least ``least`` columns, its address made absolute."""
    from urllib.parse import urljoin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids, columns, urls = [], [], []
                for i, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    reader = ListAnchors()
                    reader.feed(page or "")
                    reader.close()
                    for address, texts in reader.entries:
                        if len(texts) >= least:
                            ids.append(i)
                            columns.append([" ".join(t.split()) for t in texts])
                            urls.append(urljoin(base, address))
                yield pa.record_batch([pa.array(ids, part.column(0).type), pa.array(columns, pa.list_(pa.string())), pa.array(urls, pa.string())], names=[id_col, "columns", "detail_url"])

    wanted = pages.select(F.col(id_col), F.col(html_col))
    return wanted.mapInArrow(run, f"{id_col} {wanted.schema[id_col].dataType.simpleString()}, columns array<string>, detail_url string")


def plain(c: Column, most: int) -> Column:
    """A title without tags and with its character references resolved, at most ``most`` characters."""
    bare = F.regexp_replace(c, "<[^>]*>", "")
    for name, character in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(character))
    return F.left(bare, F.lit(most))
