"""Table functions for lines that patterns do not cover: an extension point, called in lateral joins."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from millwright.functions.columns import SESSION_LINES

_FIELDS = T.StructType().add("kind", "string").add("task", "string").add("node", "string").add("seconds", "double").add("reason", "string")


class ParseLog:
    """No row or one for a line of a session's log; lines that say nothing of note give none."""

    def __init__(self) -> None:
        self.forms = [(kind, re.compile(form)) for kind, form in SESSION_LINES]

    @staticmethod
    def analyze(line: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(line.dataType, (T.StringType, T.NullType)):
            raise ValueError("parse_log takes a line of text")
        return AnalyzeResult(schema=_FIELDS)

    def eval(self, line: str | None) -> Iterator[tuple]:
        for kind, form in self.forms:
            m = form.search(line or "")
            if m is None:
                continue
            task = m[1] if kind in ("scheduled", "started", "failed") else None
            node = m[1] if kind == "assigned" else m[2] if kind == "started" else None
            reason = m[2].strip(" ") or None if kind == "failed" else None
            yield kind, task, node, float(m[1]) if kind == "completed" else None, reason
            return


def parse_log(lines: DataFrame, *, column: str = "line") -> DataFrame:
    """``lines`` with the fields of each that says something, by a lateral join with the table function ``parse_log_udtf``."""
    register(lines.sparkSession)
    return lines.sparkSession.sql(f"select l.*, e.* from {{lines}} l, lateral parse_log_udtf(l.{column}) e", lines=lines)


def register(spark: SparkSession) -> None:
    """Makes ``parse_log_udtf`` known to SQL."""
    spark.udtf.register("parse_log_udtf", F.udtf(ParseLog))
