"""Table functions for SQL: a row for each part of a text."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .marking import CORE, cutter, pieces


@F.udtf(returnType="line_no int, line string")
class HtmlLines:
    """The lines of a page's body."""

    def eval(self, html: str):
        from ..sources.readers import lines_of_page

        yield from enumerate(lines_of_page(html))


@F.udtf(returnType="token string, `start` int, `end` int")
class BoundarySpans:
    """The pieces of a text between the boundaries of the core rules and changes of white space."""

    def __init__(self):
        self.cuts = cutter(CORE)

    def eval(self, text: str):
        yield from pieces(text or "", self.cuts(text or ""))


def register(spark: SparkSession) -> None:
    spark.udtf.register("html_lines", HtmlLines)
    spark.udtf.register("boundary_spans", BoundarySpans)
