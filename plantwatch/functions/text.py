"""Text helpers shared by reports."""

import re

from pyspark.sql import functions as F


def title_words(column):
    """``welding_unit`` -> ``Welding Unit``."""
    return F.initcap(F.replace(column, F.lit("_"), F.lit(" ")))


def missing_text(column):
    """True for null, empty text and the word NULL that text exports leave behind."""
    return column.isNull() | column.isin("", "NULL")


def split_list(column):
    """Comma-joined text to an array without blanks; null gives an empty array."""
    parts = F.transform(F.split(F.coalesce(column, F.lit("")), ","), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def quoted(text):
    """A string literal for a SQL expression."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_array(values):
    """An array literal; numbers stay numbers."""
    return "array(" + ", ".join(quoted(v) if isinstance(v, str) else repr(v) for v in values) + ")"


def first_match(column, cases, otherwise):
    """SQL for the first case whose words occur in the column; ``cases`` is a list of (words, SQL value)."""
    branches = " ".join(
        "WHEN " + " OR ".join(f"contains({column}, {quoted(w)})" for w in words) + f" THEN {value}" for words, value in cases)
    return f"CASE {branches} ELSE {otherwise} END"


def sql_map(mapping):
    """A map literal from names to texts, numbers or SQL values given as tuples of one."""
    return "map(" + ", ".join(
        f"{quoted(k)}, {v[0] if isinstance(v, tuple) else quoted(v) if isinstance(v, str) else repr(v)}"
        for k, v in mapping.items()) + ")"


def lookup(mapping, key):
    """Value of a literal map of strings; null for a missing or null key."""
    return F.element_at(F.expr(sql_map(mapping)), key)


def filled(template, **columns):
    """Text with ``{name}`` replaced by the columns of these names; null if one of them is."""
    parts = re.split(r"\{(\w+)\}", template)
    pieces = [columns[part] if k % 2 else F.lit(part) for k, part in enumerate(parts) if part]
    return F.concat(*pieces) if len(pieces) > 1 else pieces[0]
