"""How results are shown: formats, classes, evidence order, age of carried results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: evidence from best to worst.
EVIDENCE = ["strong", "moderate", "weak", "none", "insufficient", "error"]


def score_class(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 40, "mid").otherwise("low")


def floored(value: Column) -> Column:
    """The whole number at or below, as a double: a negative zero keeps its sign, which floor() drops."""
    near = F.rint(value)
    return F.when(near > value, near - 1.0).otherwise(near)


def shown_number(value: Column, digits: int = 1, unit: str = "") -> Column:
    """Fixed decimals and a unit; a dash for what isn't there."""
    ok = value.isNotNull() & ~F.isnan(value)
    return F.when(ok, F.concat(F.format_string(f"%.{digits}f", value), F.lit(unit))).otherwise("–")


def escaped_html(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def evidence_order(rows: DataFrame) -> DataFrame:
    """Indicators from best evidence to none, then by name."""
    rank = F.coalesce(*[F.when(F.col("weight") == w, F.lit(i)) for i, w in enumerate(EVIDENCE)], F.lit(len(EVIDENCE)))
    return rows.withColumn("rank", rank).orderBy("rank", "indicator")


def carried(made: Column, today: Column, redraw: int = 5, oldest: int = 10) -> Column:
    """What to do with a weekly result: redraw on a Saturday, refuse when too old, else carry it on."""
    return F.when(F.weekday(today) == redraw, "redraw").when(F.datediff(today, made) > oldest, "stale").otherwise("carry")
