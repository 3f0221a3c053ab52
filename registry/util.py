from __future__ import annotations

from pyspark.sql import functions as F


def rnd(c, digits=6):
    """Rounded double without negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def rounded(df, digits=6, skip=()):
    """Round every double column."""
    return df.select(
        *[
            rnd(f.name, digits).alias(f.name)
            if f.dataType.typeName() in ("double", "float") and f.name not in skip
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def sql_rounded(cols, digits=6):
    return ", ".join(f"round({c}, {digits}) + 0.0::double AS {c}" for c in cols)
