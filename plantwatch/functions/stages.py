"""Columns that are computed once although many later columns use them."""

from pyspark.sql import functions as F


def staged(df, **columns):
    """Add columns in a step of their own.

    Adjacent projections are merged by the optimizer, which copies an expression into every place that uses it. A
    one-element ``inline`` keeps them apart: the value is computed once per row, without a shuffle.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def opened(df, struct):
    """Add the fields of a struct as columns, in a step of their own; a null struct gives nulls."""
    return df.select("*", F.inline_outer(F.array(struct)))
