"""Queries over the driver tables, each with the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.plans.inputs import INPUTS, TABLES, needed
from boxloom.session import stored, stored_in_turn

SHARE_ROWS = 1 << 24  # rows of lineitem that the steps of one turn take


class Source:
    """The base tables of one folder and the inputs derived from them, as attributes."""

    def __init__(self, spark: SparkSession, folder: str, share: tuple[int, int] | None = None):
        self.spark, self.folder, self.share = spark, folder, share

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            if name == "lineitem" and self.share is not None:
                number, of = self.share
                return table.where(F.pmod(F.xxhash64("l_orderkey"), F.lit(of)) == number)
            return table
        if name not in INPUTS:
            raise AttributeError(name)
        body = ",\n".join(f"{c} AS ({INPUTS[c]})" for c in needed([name]))
        used: set[str] = set()

        def table(match: re.Match) -> str:
            used.add(match[2])
            return f"{match[1]} {{{match[2]}}}"

        body = re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(TABLES)})\b", table, body)
        made = self.spark.sql(f"WITH {body}\nSELECT * FROM {name}", **{t: getattr(self, t) for t in used})
        self.__dict__[name] = made
        return made

    def _shares(self) -> int:
        """Into how many shares the pages are cut: 1 for a share itself, or where derived inputs were given or used."""
        if self.share or any(name in self.__dict__ for name in INPUTS):
            return 1
        return max(1, -(-self.lineitem.count() // SHARE_ROWS))

    def in_turns(self, build: Callable[[Source], DataFrame]) -> DataFrame:
        """`build` of all pages; of many pages share by share, so that its shuffles and tables take the disk of one share.

        Only for what is made page by page from `boxes`: every page is in one share, with all its rows.
        """
        shares = self._shares()
        if shares == 1:
            return build(self)
        return stored_in_turn(self.spark, (build(Source(self.spark, self.folder, (i, shares))) for i in range(shares)))

    def kept(self, name: str) -> DataFrame:
        """A derived input written once, for queries that read it several times."""
        if f"kept {name}" not in self.__dict__:
            turns = name == "boxes" and self._shares() > 1
            self.__dict__[f"kept {name}"] = self.in_turns(lambda s: s.boxes) if turns else stored(getattr(self, name))
        return self.__dict__[f"kept {name}"]


@dataclass(frozen=True)
class Entry:
    build: Callable[[Source], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Source(spark, folder))


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None, inputs: tuple[str, ...] = ()):
    """Register a query. `sql` is a SELECT, or CTE definitions followed by one, over `inputs`."""
    def wrap(build):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        full = None
        if sql is not None:
            text = sql.strip()
            ctes = [f"{c} AS ({INPUTS[c]})" for c in needed(inputs)]
            if text.upper().startswith("SELECT"):
                full = (f"WITH RECURSIVE {', '.join(ctes)} " if ctes else "") + text
            else:
                full = "WITH RECURSIVE " + ", ".join([*ctes, text])
        REGISTRY[name] = Entry(build, full)
        return build
    return wrap
