"""Scalar expressions: orders, guarded arithmetic, rates, keys and names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import EFFORTS, LABEL_POINTS, LABELS, WHITE


def effort_order(effort: Column) -> Column:
    """0.. in the order of the tiers; unknown ones last."""
    at = F.array_position(F.array(*map(F.lit, EFFORTS)), effort)
    return F.when(at > 0, at - 1).otherwise(F.lit(99)).cast("int")


def effort_name(effort: Column) -> Column:
    """Repairs names that were written as 'EffortName.LOW'."""
    return F.when(effort.startswith("EffortName."), F.lower(F.substring_index(effort, ".", -1))).otherwise(effort)


def label_order(label: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, LABELS)), label)
    return F.when(at > 0, at - 1).cast("int")


def label_points(label: Column) -> Column:
    return reduce(lambda c, kv: c.when(label == kv[0], F.lit(kv[1])), list(LABEL_POINTS.items())[1:], F.when(label == "A", F.lit(LABEL_POINTS["A"])))


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a.cast("double") / b)


def rate(condition: Column) -> Column:
    """Aggregate: the share of rows on which the condition holds; null counts as no."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def finite(*cols: Column) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in cols])


def stopped_at_limit(reason: Column) -> Column:
    return F.lower(F.coalesce(reason, F.lit(""))).isin("max_tokens", "maxtokens")


def visible_tokens(total: Column, input_: Column, reasoning: Column) -> Column:
    return total - input_ - reasoning


def total_tokens(total: Column, input_: Column, output: Column) -> Column:
    """The total as given, or input + output where it is missing or not a number."""
    return F.coalesce(total.try_cast("double"), input_.try_cast("double") + output.try_cast("double"))


def reasoning_by_subtraction(has_block: Column, output: Column, visible: Column, overhead: Column) -> Column:
    """A text without a reasoning block has none; one with a block what the billed output exceeds the visible text by, negative or not."""
    return F.when(has_block, output - visible + overhead).otherwise(F.lit(0))


def json_long(raw: Column, path: str, missing: int | None = None) -> Column:
    value = F.get_json_object(raw, path).cast("long")
    return value if missing is None else F.coalesce(value, F.lit(missing))


def group_field(category: Column, subject: Column) -> Column:
    return F.coalesce(F.nullif(category, F.lit("")), F.nullif(subject, F.lit("")))


def stripped(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def is_blank(c: Column) -> Column:
    return stripped(F.coalesce(c, F.lit(""))) == ""


def hyphen_slug(c: Column) -> Column:
    kept = F.regexp_replace(F.regexp_replace(F.lower(c), "[ _-]", "-"), "[^\\p{L}\\p{N}-]", "")
    return F.coalesce(F.nullif(F.regexp_replace(kept, "^-+|-+$", ""), F.lit("")), F.lit("keyword"))


def underscore_slug(c: Column) -> Column:
    kept = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit("judge"))


def text_key(c: Column) -> Column:
    return F.substring(F.sha1(stripped(c)), 1, 16)


def template_key(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 12)


def filled(template: str, values: dict[str, Column]) -> Column:
    """Placeholders replaced one after the other, so later ones also meet what earlier ones put in."""
    return reduce(lambda c, kv: F.replace(c, F.lit("{" + kv[0] + "}"), kv[1]), values.items(), F.lit(template))


def guarded_corr(x: str, y: str) -> Column:
    """Aggregate: Pearson's r; null for fewer than two rows or a constant column."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    n = F.count(a)
    cov = F.covar_pop(a, b)
    scale = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when((n > 1) & (scale > 1e-12), cov / F.when(scale > 1e-12, scale))


def distinct_in_order(values: Column) -> Column:
    """Each value of a list once, where it stands first."""
    return F.array_distinct(values)
