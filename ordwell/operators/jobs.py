"""Detectors as table functions: a job gives any number of rows for a row that it is called on.

Jobs are registered under one name. A call names its job by a literal, from which the
function's schema follows when the query is analysed; LATERAL calls over one scan give
each job's rows beside the columns of the row they come from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


@dataclass(frozen=True)
class RowJob:
    """A job's name, the schema of its rows, and process(*arguments) -> rows (tuples); nulls among the arguments are its own affair."""

    name: str
    schema: str
    process: Callable[..., Iterator[tuple]]


def register(spark: SparkSession, name: str, *jobs: RowJob) -> None:
    """Make name(job, arguments...) a table function of the session, for these jobs."""
    known = {j.name: (T.StructType.fromDDL(j.schema), j.process) for j in jobs}
    if len(known) < len(jobs):
        raise ValueError("two jobs of one name")

    class Call:
        @staticmethod
        def analyze(job: AnalyzeArgument, *arguments: AnalyzeArgument) -> AnalyzeResult:
            if not job.isConstantExpression or job.value not in known:
                raise ValueError(f"the first argument names a job: one of {', '.join(sorted(known))}")
            return AnalyzeResult(known[job.value][0])

        def eval(self, job, *arguments):
            yield from known[job][1](*arguments)

    spark.udtf.register(name, F.udtf(Call, useArrow=True))
