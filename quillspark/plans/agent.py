"""Question to answer: history, one plan, at most one repair, a bounded result as text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.providers import Planner
from . import safe_sql

TURNS, ANSWER_CHARS, SHOWN_ROWS = 5, 600, 60


def history(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Each row with the last five exchanges before it (ten rows), answers cut; null turns come first."""
    w = Window.partitionBy(conv).orderBy(turn).rowsBetween(-2 * TURNS, -1)
    line = F.concat("role", F.lit(": "), F.when(F.col("role") == "assistant", F.substring("text", 1, ANSWER_CHARS)).otherwise(F.col("text")))
    return turns.withColumn("history", F.array_join(F.collect_list(line).over(w), "\n"))


def result_text(df: DataFrame, rows: int = SHOWN_ROWS) -> str:
    """A table as text: at most sixty rows and how many there are; says so if there is none."""
    got = df.limit(rows + 1).collect()
    if not got:
        return "(no rows)"
    lines = ["\t".join(df.columns)] + ["\t".join("" if v is None else str(v) for v in r) for r in got[:rows]]
    if len(got) > rows:
        lines.append(f"... ({df.count()} rows total)")
    return "\n".join(lines)


@dataclass
class Turn:
    question: str
    intent: str
    text: str
    sql: str | None = None
    error: str | None = None


class TableAgent:
    """Answers questions on one table through a planner; keeps the turns."""

    def __init__(self, df: DataFrame, planner: Planner):
        self.df, self.planner, self.turns = df, planner, []

    def _history(self) -> str:
        return "\n".join(f"user: {t.question}\nassistant: {t.text[:ANSWER_CHARS]}" for t in self.turns[-TURNS:])

    def ask(self, question: str) -> Turn:
        if not question.strip():
            return Turn(question, "error", "Please ask a question.", error="blank question")
        schema = self.df._jdf.schema().toDDL()
        plan = self.planner.plan(question, self._history(), schema)
        intent = plan.get("intent", "clarify")
        if intent not in ("data", "data_and_search"):
            turn = Turn(question, intent, plan.get("message", ""))
        else:
            done = safe_sql.run(self.df, plan.get("code", ""))
            if not done.ok:
                plan = self.planner.plan(f"{question}\nThe last statement failed: {done.error}", self._history(), schema)
                done = safe_sql.run(self.df, plan.get("code", ""))
            turn = Turn(question, intent, result_text(done.rows) if done.ok else f"The question could not be answered: {done.error}", plan.get("code"), done.error)
        self.turns.append(turn)
        return turn


def product_filter(column: str, needle: str) -> Column:
    """Literal, case-insensitive containment."""
    return F.contains(F.lower(F.col(column)), F.lit(needle.lower()))
