"""Inputs derived from the driver tables by SQL that Spark and DuckDB read the same way."""

from __future__ import annotations

import re
from collections.abc import Iterable

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

PAGE_WIDTH, PAGE_HEIGHT = 320, 480

INPUTS: dict[str, str] = {
    # text regions: one page per order, boxes numbered with every column as tie-break
    "boxes": """
        SELECT concat('b', page % 16) AS book_id, page, cast(boxno AS bigint) AS boxno, l, t,
               least(l + w, 320) AS r, least(t + h, 480) AS b, score, text
        FROM (SELECT l_orderkey AS page,
                row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                  l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 AS boxno,
                (l_partkey * 7) % 240 AS l, (l_suppkey * 13 + l_linenumber * 29) % 400 AS t,
                12 + (cast(l_quantity AS bigint) * 3) % 90 AS w, 16 + (l_partkey % 70) AS h,
                1 - l_discount * 4 AS score, concat('w', l_partkey % 5) AS text
              FROM lineitem) x""",
    # jobs and chapters of a series (one series per customer)
    "jobs": """
        SELECT concat('c', o_custkey % 40) AS category, concat('j', o_orderkey) AS job_id,
               CASE WHEN o_orderkey % 23 = 0 THEN '' WHEN o_orderstatus = 'F' THEN 'complete'
                    WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'running' ELSE 'queued' END
                    WHEN o_orderkey % 3 = 0 THEN 'failed' WHEN o_orderkey % 3 = 1 THEN 'paused'
                    ELSE 'cancelled' END AS status,
               o_orderkey AS n, o_custkey AS custkey, o_orderdate AS created, o_totalprice AS price,
               o_orderpriority AS priority
        FROM orders""",
    "chapters": """
        SELECT concat('s', o_custkey) AS series, concat('j', o_orderkey) AS job_id,
               CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE cast(1 + seq % 3 AS varchar(10)) END AS volume,
               cast(seq AS varchar(10)) AS chapter, seq,
               CASE WHEN o_orderkey % 7 = 0 THEN 'failed' WHEN o_orderkey % 11 = 0 THEN 'queued' ELSE 'complete' END AS status,
               o_orderkey % 13 = 0 AS has_context, 5 + o_orderkey % 4 AS page_count,
               CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN 'No reusable translation notes were generated.'
                    ELSE concat('notes ', o_orderkey) END AS note
        FROM (SELECT o_custkey, o_orderkey,
                row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq FROM orders) x""",
}


def needed(names: Iterable[str]) -> list[str]:
    """The derived inputs that `names` rest on, each after what it reads."""
    out: list[str] = []

    def visit(name: str) -> None:
        if name not in INPUTS or name in out:
            return
        for word in set(re.findall(r"\b[a-z_]+\b", INPUTS[name])):
            if word != name and word in INPUTS and re.search(rf"\b(FROM|JOIN)\s+{word}\b", INPUTS[name]):
                visit(word)
        out.append(name)

    for name in names:
        visit(name)
    return out
