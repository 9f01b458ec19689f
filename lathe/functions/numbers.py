"""Numbers in text: literals, canonical text, tolerant equality, arithmetic."""

from __future__ import annotations

import ast
import operator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: a number literal; thousands with commas first, then sign, decimals, exponent.
NUMBER = r"-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"


def number_literals(text: Column) -> Column:
    """All number literals of a text, in order (null text: null)."""
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def number_list(text: Column) -> Column:
    """The literals as doubles, thousands commas removed."""
    return F.transform(number_literals(text), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))


def grounded_set(text: Column) -> Column:
    return F.array_distinct(number_list(text))


def first_number(value: Column) -> Column:
    """The first blank-separated token as a double, or null."""
    return F.replace(F.element_at(F.split(strip(value), r"\s+"), 1), F.lit(","), F.lit("")).try_cast("double")


def leads_with_quantity(value: Column) -> Column:
    """The value begins with one number literal, and a blank or nothing follows it."""
    return strip(value).rlike(rf"^(?:{NUMBER})(?:\s|$)")


def close_to(a: Column, b: Column, tolerance: float = 1e-6, floor: float = 1e-12) -> Column:
    """Relative equality with a floor under the scale; infinity and NaN are close to nothing."""
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(floor)) <= tolerance


def answers_match(got: Column, want: Column, kind: Column) -> Column:
    """date: non-empty with a digit or a dash; numeric: within 1e-3, else equal text; exact: equal text."""
    text = F.lower(strip(got)) == F.lower(strip(want))
    a, b = strip(got).try_cast("double"), strip(want).try_cast("double")
    return F.when(kind == "date", got.rlike(r"[\d-]")).when((kind == "numeric") & a.isNotNull() & b.isNotNull(), F.abs(a - b) < 1e-3).otherwise(text)


def strip(s: Column) -> Column:
    """All Unicode white space off both ends (Spark's trim takes spaces only)."""
    return F.regexp_replace(s, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def wilson_interval(hits: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    p, zz = hits / total, z * z
    mid = (p + zz / (2 * total)) / (1 + zz / total)
    half = z * F.sqrt(p * (1 - p) / total + zz / (4 * total * total)) / (1 + zz / total)
    return mid - half, mid + half


@F.pandas_udf(T.StringType())
def _ten_digits(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if pd.isna(v) else f"{v:.10g}")


def number_text(value: Column | str) -> Column:
    """An integer's digits where a value is integral and below 1e15, else ten significant digits (null for NaN)."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.when(whole, v.cast("bigint").cast("string")).otherwise(_ten_digits(F.when(~whole, v)))


_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod}


def _value(node):
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
        return node.value
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        v = _value(node.operand)
        return -v if isinstance(node.op, ast.USub) else v
    if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
        return _BINARY[type(node.op)](_value(node.left), _value(node.right))
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Pow):
        base, power = _value(node.left), _value(node.right)
        if abs(power) > 4096:
            raise ValueError("exponent out of range")
        return base**power
    raise SyntaxError


def calculate(expression: str | None) -> str | None:
    """Arithmetic over + - * / // % ** ^ and parentheses; ``ERROR: ...`` on anything else.

    Exponents are bounded, so no expression can occupy an executor for long.
    """
    if expression is None:
        return None
    text = expression.replace("^", "**").strip()
    if set(text) - set("0123456789+-*/().% \t\n"):
        return "ERROR: invalid expression"
    try:
        return str(_value(ast.parse(text, mode="eval").body))
    except SyntaxError:
        return "ERROR: invalid expression"
    except Exception as e:  # the message is the result
        return f"ERROR: {e}"


@F.pandas_udf(T.StringType())
def calc(expressions: pd.Series) -> pd.Series:
    known = {x: calculate(x) for x in expressions.unique()}
    return expressions.map(known)


def round_text(value: Column) -> Column:
    """An integer's digits where a value is integral, else the value rounded to four places."""
    rounded = F.round(value, 4)
    return F.when(value == F.floor(value), F.floor(value).cast("bigint").cast("string")).otherwise(rounded.cast("string"))


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(value.cast("int"), F.lit(high)))


def gumbel(u: Column, eps: float = 1e-10) -> Column:
    return -F.log(-F.log(u + F.lit(eps)) + F.lit(eps))


def swiglu_width(d_ff: Column) -> Column:
    """Two thirds of the width, up to a multiple of 64, 64 at least."""
    part = F.floor(2 * d_ff / 3)
    return F.greatest(F.lit(64), (F.floor((part + 63) / 64) * 64)).cast("bigint")


def attention_costs(seq: Column, window: Column, width: Column, latent: Column, batch: Column, state: Column) -> Column:
    """Cells that windowed attention compares, a latent cache holds and a scan keeps."""
    return F.struct((seq * window * width).alias("window"), (seq * latent).alias("latent"), (batch * state).alias("state"))


def plain_answer(text: Column) -> Column:
    """Runs of white space as one blank, ends stripped, full stops at the end dropped."""
    return F.regexp_replace(F.regexp_replace(strip(text), r"(?U)\s+", " "), r"\.+\z", "")


def partition(text: Column, mark: str = ":") -> Column:
    """struct(head, tail): before and after the first mark; without one all is head."""
    at = F.locate(mark, text)
    whole = F.struct(text.alias("head"), F.lit("").alias("tail"))
    return F.when(at == 0, whole).otherwise(F.struct(F.substring(text, F.lit(1), at - 1).alias("head"), F.substring(text, at + len(mark), F.length(text)).alias("tail")))


def minutes(seconds: Column) -> Column:
    return F.format_string("%.1fm", seconds.cast("double") / 60)


def utc_text(moment: Column) -> Column:
    """A UTC timestamp as ISO text that ends in Z."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def file_stamp(moment: Column) -> Column:
    return F.date_format(moment, "yyyyMMdd_HHmmss")
