"""The element table as a table function for SQL: ``SELECT p.page_id, e.* FROM pages p, LATERAL html_elements(p.html, 'tag,attrs') e``.

The second argument, a constant, names the columns that the query reads (all without it); the others are neither built nor sent. A null or
empty page has no rows. Rows are those of :func:`leadforge.sources.html.elements`, in order.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from leadforge.sources.html import elements

NAME = "html_elements"
#: The columns of leadforge.sources.html.ELEMENTS; tasks have no session that could parse them.
COLUMNS = T.StructType([
    T.StructField("pos", T.IntegerType()), T.StructField("tag", T.StringType()), T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("text", T.StringType()), T.StructField("parent_year", T.StringType()), T.StructField("landmarks", T.ArrayType(T.StringType())),
])


def wanted(columns: str | None) -> list[int]:
    """Places of the columns that a query names; all without names."""
    names = [c.strip() for c in (columns or "").split(",") if c.strip()] or COLUMNS.names
    if unknown := [c for c in names if c not in COLUMNS.names]:
        raise ValueError(f"unknown columns {', '.join(unknown)}; there are {', '.join(COLUMNS.names)}")
    return [COLUMNS.names.index(c) for c in names]


class HtmlElements:
    @staticmethod
    def analyze(html: AnalyzeArgument, columns: AnalyzeArgument | None = None) -> AnalyzeResult:
        if columns is not None and not columns.isConstantExpression:
            raise ValueError("the columns of html_elements are a constant")
        return AnalyzeResult(T.StructType([COLUMNS[i] for i in wanted(columns and columns.value)]))

    def eval(self, html: str | None, columns: str | None = None):
        places = wanted(columns)
        for row in elements(html):
            yield tuple(row[i] for i in places)


def register(spark: SparkSession) -> None:
    """Makes the function known to SQL of this session."""
    spark.udtf.register(NAME, F.udtf(HtmlElements, useArrow=True))
