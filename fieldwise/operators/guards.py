"""Guards: conditions on whole tables, observed while the rows pass and checked after the action that reads them."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from fieldwise.operators.scan import durable


class Guards:
    """What must hold of tables that one action reads.

    ``expect`` gives a table back with a condition, an aggregate over its rows, observed on the way, so nothing is read twice for it. After the
    action, ``check`` raises the first condition that failed; ``settled`` is an action that writes the rows to the shared folder and then checks. Conditions
    must be such that rows counted again (a lost task, a sample for ranges) change nothing: greatest values, or counts of which only zero matters.
    Where a join meets no row at all, Spark may leave the observed side out while it runs; ``unread`` says whether the condition holds then.
    """

    def __init__(self):
        self.expected: list[tuple[Observation, str, bool]] = []

    def expect(self, df: DataFrame, holds: Column, message: str, unread: bool = False) -> DataFrame:
        seen = Observation()
        self.expected.append((seen, message, unread))
        return df.observe(seen, holds.alias("holds"))

    def check(self) -> None:
        for seen, message, unread in self.expected:
            try:
                holds = seen.get["holds"]
            except Py4JJavaError:  # the action ended without this table
                holds = unread
            if not holds:
                raise ValueError(message)

    def settled(self, df: DataFrame) -> DataFrame:
        """The rows, written once; an error where a condition failed."""
        written = durable(df)
        self.check()
        return written


def expected(guards: Guards | None, df: DataFrame, holds: Column, message: str, unread: bool = False) -> DataFrame:
    """``df`` under the caller's guards, who checks them after the action; without guards the rows are written and checked here."""
    own = guards or Guards()
    watched = own.expect(df, holds, message, unread)
    return watched if guards else own.settled(watched)
