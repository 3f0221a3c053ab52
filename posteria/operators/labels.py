"""Class labels: one-hots, codes, predicted class, class pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_dictionary(df: DataFrame, col: str) -> list[str]:
    """The class names in alphabetical order (one value per class)."""
    rows = df.select(col).filter(F.col(col).isNotNull()).distinct().collect()
    return sorted(r[0] for r in rows)


def encode_labels(df: DataFrame, col: str, classes: Sequence[str] | None = None) -> DataFrame:
    """Add one-hots ``<col>_<value>`` and the integer code ``<col>_num``."""
    classes = list(classes) if classes is not None else label_dictionary(df, col)
    hot = [F.coalesce((F.col(col) == c).cast("int"), F.lit(0)).alias(f"{col}_{c}") for c in classes]
    code = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(col)) - 1
    return df.select("*", *hot, F.when(code >= 0, code.cast("int")).alias(f"{col}_num"))


def argmax_name(cols: Sequence[str], names: Sequence[str]):
    """Name belonging to the largest column; the first wins a tie."""
    values = F.array(*[F.col(c) for c in cols])
    place = F.array_position(values, F.array_max(values)).cast("int")
    return F.when(place > 0, F.get(F.array(*[F.lit(n) for n in names]), place - 1))


def predicted_class(df: DataFrame, cols: Sequence[str], names: Sequence[str] | None = None, out: str = "CLASS") -> DataFrame:
    """Add the most probable class by the given (median) columns."""
    if names is None:
        names = [c.removesuffix("_pc50").replace("CLASS_", "").replace("class_", "") for c in cols]
    return df.withColumn(out, argmax_name(cols, names))


def class_pairs(df: DataFrame, col: str) -> DataFrame:
    """All ordered pairs of distinct classes (one_class, other_class).

    The pairs come from the class dictionary, never from data rows.
    """
    classes = F.sort_array(F.collect_set(col))
    pairs = F.flatten(
        F.transform(
            "c", lambda a: F.transform(
                F.filter("c", lambda b: b != a),
                lambda b: F.struct(a.alias("one_class"), b.alias("other_class")),
            )
        )
    )
    return df.select(col).distinct().agg(classes.alias("c")).select(F.inline(pairs))
