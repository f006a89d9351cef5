"""Faults as rows: what a fault is called, steps that turn faults into rows, and batches that lose only the cases at fault."""

from __future__ import annotations

import builtins
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Error codes of the engine.
ERRORS = (
    "INVALID_CONFIG", "INVALID_QUERY", "INVALID_SOURCE", "INVALID_REQUEST", "DOCUMENT_LOAD_FAILED", "DOCUMENT_PARSE_FAILED", "INDEX_FAILED", "INDEX_NOT_FOUND",
    "INDEX_INCOMPATIBLE", "RETRIEVAL_FAILED", "EVIDENCE_TRANSFORM_FAILED", "GENERATION_FAILED", "CITATION_VALIDATION_FAILED",
)
FAILURE = "struct<failure_type:string,error_code:string,message:string>"
_CODE = re.compile(rf"\b({'|'.join(ERRORS)}): ([^\n]*)")
_RAISED = re.compile(r"^(?:pyspark\.errors\.exceptions\.\w+\.)?(\w+)(?:: (.*))?$")


def failure_of(error: BaseException) -> dict:
    """{failure_type, error_code, message}: the code, where the message has one; else what kind of Python error it
    is. Errors that Spark brings from a worker are told by the last line of their traceback."""
    text = str(error)
    if found := _CODE.search(text):
        return {"failure_type": found[1].lower(), "error_code": found[1], "message": f"{found[1]}: {found[2]}"[:500]}
    kind, message = type(error), text
    for line in reversed(text.splitlines()):
        said = _RAISED.match(line.strip())
        own = getattr(builtins, said[1], None) if said else None
        if isinstance(own, type) and issubclass(own, Exception):
            kind, message = own, said[2] or said[1]
            break
    named = "infrastructure" if issubclass(kind, OSError) else "contract" if issubclass(kind, TypeError) else "validation" if issubclass(kind, ValueError) else "runtime"
    return {"failure_type": named, "error_code": None, "message": message[:500]}


def failure(code: str, message: Column) -> Column:
    """A failure with a code, as a column."""
    return F.struct(F.lit(code.lower()).alias("failure_type"), F.lit(code).alias("error_code"), F.concat(F.lit(f"{code}: "), message).alias("message"))


def guarded(udf: Callable, kind: str) -> Callable:
    """A pandas UDF of one column as one of (value, failure): rows on which it raises carry the fault, the
    others their value. A batch is taken at once, and row by row only if that fails."""
    inner = udf.func

    @F.pandas_udf(f"value {kind}, failure {FAILURE}")
    def run(values: pd.Series) -> pd.DataFrame:
        try:
            return pd.DataFrame({"value": list(inner(values)), "failure": [None] * len(values)})
        except Exception:
            got, faults = [], []
            for v in values:
                try:
                    got.append(next(iter(inner(pd.Series([v])))))
                    faults.append(None)
                except Exception as e:  # of any kind: one row's fault must not end the others
                    got.append(None)
                    faults.append(failure_of(e))
            return pd.DataFrame({"value": got, "failure": faults})

    return run


class Faults:
    """The error channel of a batch: steps report rows (query_id, failure) and go on with those that are
    left. Of several faults of a query the first reported counts."""

    def __init__(self):
        self._found: list[DataFrame] = []

    def report(self, rows: DataFrame) -> None:
        """Rows (query_id, failure) of a table that is stored: they are read whenever the channel is."""
        self._found.append(rows.select("query_id", F.lit(len(self._found)).alias("step"), "failure"))

    def rows(self) -> DataFrame | None:
        """(query_id, failure), one for each query at fault."""
        if not self._found:
            return None
        every = self._found[0]
        for more in self._found[1:]:
            every = every.unionByName(more)
        return every.groupBy("query_id").agg(F.min(F.struct("step", "failure")).alias("x")).select("query_id", F.col("x.failure").alias("failure"))

    def without(self, rows: DataFrame) -> DataFrame:
        """Rows of the queries that are not at fault."""
        found = self.rows()
        return rows if found is None else rows.join(found.select("query_id"), "query_id", "left_anti")


def each_case(cases: DataFrame, run: Callable[[DataFrame], DataFrame], failed: Callable[[DataFrame, dict], DataFrame], probes: int = 64) -> list[DataFrame]:
    """Results of `run` over all cases (query_id, ...), which it must have computed when it returns. Where it raises,
    the batch is halved by hash until the case at fault stands alone, and `failed` makes its row. After
    `probes` runs that raised, what is left of a failing part fails together."""
    parts, out, spent = [(cases, 0)], [], 0
    while parts:
        part, depth = parts.pop()
        try:
            out.append(run(part))
        except Exception as e:  # of any kind: a case's fault must not end the others
            spent += 1
            said = failure_of(e)
            ids = part.select("query_id").distinct()
            if spent >= probes or depth > 60 or ids.limit(2).count() < 2:
                out.append(failed(part, said))
                continue
            half = F.pmod(F.xxhash64("query_id", F.lit(depth)), F.lit(2))
            parts += [(x, depth + 1) for x in (part.where(half == 0), part.where(half == 1)) if not x.isEmpty()]
    return out
