"""Extraction in SQL: a table function whose columns are those of the plan it is given.

    register(spark)
    spark.sql("select * from extract_html(table(pages), '{\\"container\\": \\"li\\", \\"title\\": \\"b\\", \\"link\\": \\"a@href\\"}', 'page_id')")

pages: a table with html and, where addresses are to be absolute, url. The plan: JSON of selectors by field. The last
argument: columns that are kept, by commas. Rows are those of extract_pages().
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from gleaner.sources.extract import ParseError, Plan, extract


def _names(keep: str | None) -> list[str]:
    return [k.strip() for k in (keep or "").split(",") if k.strip()]


@udtf
class ExtractHtml:
    @staticmethod
    def analyze(pages: AnalyzeArgument, plan: AnalyzeArgument, keep: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not pages.isTable or "html" not in pages.dataType.names:
            raise ValueError("the first argument is a table with a column html")
        if not plan.isConstantExpression or not isinstance(plan.value, str):
            raise ValueError("the plan is a constant: JSON of selectors by field")
        selectors = json.loads(plan.value)
        if not isinstance(selectors, dict) or not all(isinstance(v, str) for v in selectors.values()):
            raise ValueError("the plan is a JSON object of selectors")
        kept = _names(keep.value if keep else None)
        if unknown := [k for k in kept if k not in pages.dataType.names]:
            raise ValueError(f"no such columns: {', '.join(unknown)}")
        fields = [StructField(name, StringType()) for name, *_ in Plan.of(selectors).fields]
        return AnalyzeResult(StructType([*(pages.dataType[k] for k in kept), StructField("_row", IntegerType()), *fields]))

    def __init__(self) -> None:
        self.known: dict[str, Plan] = {}

    def eval(self, page: Row, plan: str, keep: str | None = None) -> Iterator[tuple]:
        if plan not in self.known:
            self.known[plan] = Plan.of(json.loads(plan))
        try:
            rows, _, _ = extract(page["html"] or "", self.known[plan], (page["url"] or "") if "url" in page.__fields__ else "")
        except ParseError:
            return
        for i, row in enumerate(rows):
            yield (*(page[k] for k in _names(keep)), i, *(row[name] for name, *_ in self.known[plan].fields))


def register(spark: SparkSession) -> None:
    """Makes the function known to the session's SQL as extract_html."""
    spark.udtf.register("extract_html", ExtractHtml)
