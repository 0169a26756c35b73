"""A closed query surface: one SELECT over one registered table, nothing else.

The text is parsed to an unresolved logical plan, which is walked against an
allow-list before anything is analysed or run: only relational nodes, only the
table's own name (and names the statement itself defines), only listed functions.
Execution is tagged, cancelled at a deadline, and its rows are capped.
"""

from __future__ import annotations

import re
import threading
import uuid
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

MAX_CHARS, MAX_ROWS, SECONDS = 6000, 200, 10.0

# Logical nodes and functions that a statement may hold.
NODES = {"Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Limit", "Offset", "Distinct", "Join", "Union", "Except", "Intersect", "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "WithCTE", "UnresolvedWith", "UnresolvedRelation", "UnresolvedHaving", "WithWindowDefinition", "Window", "OneRowRelation", "UnresolvedInlineTable", "Pivot", "Unpivot", "UnresolvedOrdinal"}
FUNCTIONS = set(
    "abs acos any array_agg asin atan avg bool_and bool_or bround cast ceil ceiling char_length coalesce concat concat_ws contains corr count count_if covar_samp date_add date_format date_trunc datediff day dayofweek dense_rank endswith every exp first first_value floor greatest hour if ifnull initcap isnan isnotnull isnull lag last last_day last_value lead least left length like ln log log10 lower lpad ltrim max max_by mean median min min_by minute mod month nanvl ntile nullif nvl percent_rank percentile pmod position pow power quarter rank regexp_extract regexp_like regexp_replace replace right rint round row_number rpad rtrim second sign skewness some split sqrt startswith std stddev stddev_pop stddev_samp substr substring sum to_date to_timestamp translate trim try_cast try_divide try_to_date try_to_timestamp upper var_pop var_samp variance weekday when width_bucket year".split()
)


_NAMING = threading.Lock()


@dataclass
class Result:
    ok: bool
    rows: DataFrame | None = None
    collected: list = field(default_factory=list)
    truncated: bool = False
    error: str | None = None


def _sanitise(message: str) -> str:
    text = re.sub(r"(?:[A-Za-z]:\\|/)(?:[\w.-]+[\\/])+[\w.-]*", "<path>", message)
    return text.split("\n", 1)[0][:500]


def problems(spark: SparkSession, sql: str, table: str) -> list[str]:
    """All that speaks against a statement; none if it may run."""
    if len(sql) > MAX_CHARS:
        return [f"the statement is longer than {MAX_CHARS} characters"]
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:  # what the parser raises comes through the gateway in several classes
        return [_sanitise(f"does not parse: {getattr(getattr(e, 'java_exception', None), 'getMessage', lambda: str(e))()}")]
    found: list[str] = []
    names: set[str] = {table.lower()}

    def defined(node) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedWith":
            relations = node.cteRelations()
            for i in range(relations.size()):
                names.add(relations.apply(i)._1().lower())

    def items(seq):
        return [seq.apply(i) for i in range(seq.size())]

    def expression(e) -> None:
        kind = e.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            name = ".".join(items(e.nameParts())).lower()
            if name not in FUNCTIONS:
                found.append(f"function {name} is not allowed")
        if kind in ("ScalarSubquery", "Exists", "InSubquery", "ListQuery", "LateralSubquery") and kind != "InSubquery":
            plan_node(e.plan())
        for c in items(e.children()):
            expression(c)

    def plan_node(node) -> None:
        kind = node.getClass().getSimpleName().rstrip("$")
        if kind not in NODES:
            found.append(f"{kind} is not allowed")
            return
        defined(node)
        if kind == "UnresolvedRelation":
            name = ".".join(items(node.multipartIdentifier())).lower()
            if name not in names:
                found.append(f"table {name} is not available")
        if kind == "UnresolvedWith":
            relations = node.cteRelations()
            for i in range(relations.size()):
                plan_node(relations.apply(i)._2())
        for e in items(node.expressions()):
            expression(e)
        for c in items(node.children()):
            plan_node(c)

    plan_node(plan)
    return list(dict.fromkeys(found))


def run(df: DataFrame, sql: str, table: str = "df", rows: int = MAX_ROWS, seconds: float = SECONDS) -> Result:
    """Run a checked statement over ``df`` under the name ``table``; errors come back as text, never raised."""
    spark = df.sparkSession
    bad = problems(spark, sql, table)
    if bad:
        return Result(False, error="; ".join(bad))
    tag = f"quillspark-{uuid.uuid4().hex}"
    done: list[Result] = []

    def work() -> None:
        spark.addTag(tag)
        try:
            with _NAMING:  # the name is bound while the statement is resolved; concurrent calls don't see each other's table
                df.createOrReplaceTempView(table)
                out = spark.sql(sql)
                spark.catalog.dropTempView(table)
            got = out.limit(rows + 1).collect()
            # what was collected under tag and deadline is the result; nothing runs again
            done.append(Result(True, spark.createDataFrame(got[:rows], out.schema), got[:rows], len(got) > rows))
        except PySparkException as e:
            done.append(Result(False, error=_sanitise(f"{e.getCondition() or type(e).__name__}: {e}")))
        except Exception as e:  # an interrupted job may surface as a gateway error
            done.append(Result(False, error=_sanitise(f"{type(e).__name__}: {e}")))
        finally:
            spark.removeTag(tag)

    worker = InheritableThread(target=work, daemon=True)
    worker.start()
    worker.join(seconds)
    if done:
        return done[0]
    spark.interruptTag(tag)  # its tasks end as soon as they notice; the answer doesn't wait for them
    return Result(False, error="the time limit was reached")


CHARTS = ("bar", "barh", "line", "pie", "scatter")


def valid_chart(spec: dict, df: DataFrame) -> bool:
    """A chart of a known kind whose columns exist and whose measure is a number."""
    kinds = dict(df.dtypes)
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint")
    return spec.get("kind") in CHARTS and spec.get("x") in kinds and spec.get("y") in kinds and (kinds[spec["y"]] in numeric or kinds[spec["y"]].startswith("decimal"))
