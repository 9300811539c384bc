"""Main text of web pages by comparing each with its nearest page.

Pages of one host are put in the order of their paths; the nearer neighbour in
this order shares the longest start of the path. The lines of both are aligned by
a longest common subsequence, and lines that both have are furniture of the site.
Pages of a host with the same lines are copies, which say nothing about furniture:
one of them stands in the order for all, so both neighbours of a page differ from it.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions.ranking import number_rows
from recordloom.llm.html_lines import candidates, common_lines
from recordloom.llm.shared import column, slices, small_batches, spread_join
from recordloom.session import materialise

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def _line_mapper(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in slices(batch):
            found = [candidates(x or "") for x in some.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *(some.column(c) for c in ("page_id", "url", "_key")),
                    pa.array([[t for t, _ in x] for x in found], pa.list_(pa.string())),
                    pa.array([[d for _, d in x] for x in found], pa.list_(pa.bool_())),
                ],
                ["page_id", "url", "_key", "lines", "loose"],
            )


def _hash_mapper(batches) -> Iterator[pa.RecordBatch]:
    """Only what the alignment needs: hashes of the lines."""
    for batch in batches:
        for some in slices(batch):
            found = [candidates(x or "") for x in some.column("_html").to_pylist()]
            hashes = [[xxhash.xxh3_64_intdigest(t) >> 1 for t, _ in x] for x in found]
            content = [xxhash.xxh3_128_digest(np.array(h, np.int64).tobytes()) for h in hashes]
            yield pa.RecordBatch.from_arrays(
                [
                    *(some.column(c) for c in ("_key", "host", "path")),
                    pa.array(hashes, pa.list_(pa.int64())),
                    pa.array(content, pa.binary()),
                ],
                ["_key", "host", "path", "hashes", "content"],
            )


def nearness(path: str, other: str) -> tuple[int, int]:
    """Leading path segments in common, then leading characters."""
    one, two = path.split("/"), other.split("/")
    return len(commonprefix([one, two])), len(commonprefix([path, other]))


def shared_places(
    lines: list[int], path: str, neighbours: list[tuple[str, list[int]]]
) -> list[int]:
    """Places of the lines that the nearer of the (path, lines) before and after has, too."""
    if not neighbours:
        return []
    return common_lines(lines, max(neighbours, key=lambda x: nearness(path, x[0]))[1])


def _aligner(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, contents, shared = [], [], []
        for row in batch.to_pylist():
            neighbours = [
                (row[f"{side}_path"], row[f"{side}_hashes"])
                for side in ("before", "after")
                if row[f"{side}_path"] is not None
            ]
            places = shared_places(row["hashes"], row["path"], neighbours)
            if places:
                hosts.append(row["host"])
                contents.append(row["content"])
                shared.append(places)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(hosts, pa.string()),
                pa.array(contents, pa.binary()),
                pa.array(shared, pa.list_(pa.int32())),
            ],
            ["host", "content", "shared"],
        )


def main_text(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    A null html is empty. A page without a neighbour on its host (or without a
    host) keeps all its lines but those its markup excludes. Rows that repeat
    others stay as often as they came. Other columns are not read. Only hashes of
    lines are sorted and paired; the lines move once, to meet what is deleted.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(
        column(page_id).alias("page_id"), column(url).alias("url"), column(html).alias("_html")
    ).withColumn("_key", F.xxhash64("page_id", "url", "_html"))
    located = rows.select(
        "_key",
        F.lower(F.regexp_extract("url", HOST, 1)).alias("host"),
        F.regexp_extract("url", PATH, 1).alias("path"),
        "_html",
    ).filter("host <> ''")
    hashed = located.mapInArrow(
        _hash_mapper,
        "_key bigint, host string, path string, hashes array<bigint>, content binary",
    )
    hashed = materialise(hashed.dropDuplicates(["_key"]), "page-lines")
    # Copies, and pages without lines, are no neighbours.
    one_each = (
        hashed.filter("size(hashes) > 0")
        .groupBy("host", "content")
        .agg(F.min(F.struct("path", "_key")).alias("_first"))
        .select("_first._key")
    )
    different = hashed.join(one_each, "_key", "left_semi")
    placed = number_rows(different, ["host", "path", "_key"], "row_no")
    placed = materialise(placed, "pages-in-order")

    def neighbour(side: str, step: int) -> DataFrame:
        return placed.select(
            (F.col("row_no") + step).alias("row_no"), "host",
            F.col("path").alias(f"{side}_path"), F.col("hashes").alias(f"{side}_hashes"),
        )

    found = (
        placed.join(neighbour("before", 1), ["row_no", "host"], "left")
        .join(neighbour("after", -1), ["row_no", "host"], "left")
        .select(
            "host", "content", "path", "hashes",
            "before_path", "before_hashes", "after_path", "after_hashes",
        )
        .mapInArrow(_aligner, "host string, content binary, shared array<int>")
    )
    copies = hashed.select("_key", "host", "content")
    shared = spread_join(copies, found, ["host", "content"], ["_key"], "inner", salts=8).select(
        "_key", "shared"
    )
    schema_id, schema_url = (rows.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    lines = rows.mapInArrow(
        _line_mapper,
        f"page_id {schema_id}, url {schema_url}, _key bigint,"
        " lines array<string>, loose array<boolean>",
    )
    kept = F.expr(
        "filter(lines, (line, at) ->"
        " shared is null or not loose[at] or not array_contains(shared, at))"
    )
    return lines.join(shared, "_key", "left").select(
        "page_id", "url", F.array_join(kept, "\n").alias("text")
    ).withColumn("n_chars", F.length("text").cast("bigint"))
