"""Documents to training sequences: five stages, each a written table that the next one reads."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posteria.llm import decontaminate, language, minhash, packing, repeats
from posteria.llm.tables import sealed, table, unsealed
from posteria.session import ship_package, stage

LEAST_SCORE = 0.25  # below this a text fits no learned language
LENGTH = 1024


def shipped(step):
    """The stage with this package sent to the executors first."""

    @functools.wraps(step)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return step(spark, docs, sf_dir)

    return run_stage


@shipped
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned from the labelled ones; the rest (null, no letters, no fit) goes.

    Each row is judged by its whole text, so repeated rows share their fate.
    Without rows, or without labels, nothing is left. Extra columns, whatever
    they are called, stay as they are.
    """
    at = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    rows = sealed(docs)
    known = language.learn(rows, id_col=at["doc_id"], text_col=at["text"], lang_col=at["lang"])
    judged = language.identify(rows, known, id_col=at["doc_id"], text_col=at["text"])
    return unsealed(judged.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)), docs.columns)


@shipped
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, 0.8): the least id, nulls last, one row among equals.

    Rows are judged one by one, whatever their ids: a repeated row and a row
    without an id belong to the group of their text. A row without words is a
    group of its own. Without rows nothing is left. Extra columns, whatever
    they are called, stay as they are.
    """
    at = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    rows = stage(sealed(docs).withColumn("row", F.monotonically_increasing_id()), "rows")
    found = minhash.near_duplicates(rows, words=5, percent=80, id_col="row", text_col=at["text"])
    named = found.join(rows.select("row", F.col(at["doc_id"]).alias("doc_id")), "row")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("best")
    kept = named.groupBy("component_id").agg(best).select("best.row")
    # staged: where it is small it is broadcast, and the texts are not shuffled
    return unsealed(rows.join(stage(kept, "kept"), "row", "left_semi"), docs.columns)


@shipped
def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 200-byte strings that occur elsewhere; a document with nothing left goes.

    Rows with the same text are two documents and lose what they share (the
    stage before leaves one). Rows without a repeat, null texts among them,
    stay as they are; without rows nothing is left. Of a row that is cut only
    ``text`` and ``n_chars`` change, whatever the extra columns are called.
    """
    at = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    cut = repeats.remove_repeats(sealed(docs), width=200, text_col=at["text"], as_text=True)
    touched = F.size("removed") > 0
    made = {at["text"]: F.when(touched, F.col("kept")).otherwise(F.col(at["text"]))}
    if "n_chars" in at:
        made[at["n_chars"]] = F.when(touched, F.char_length("kept").cast("long")).otherwise(F.col(at["n_chars"]))
    return unsealed(cut.filter(~touched | (F.trim("kept") != "")), docs.columns, **made)


@shipped
def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Rows are judged one by one; null texts hold none and stay. Without rows
    nothing is left; extra columns, whatever they are called, stay as they are.
    """
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"), short=True)


@shipped
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of binary lengths up to 1024, of every row; null texts hold the closing id alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), most=LENGTH)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("repeats", no_repeats),
    ("benchmark", no_benchmark),
    ("packing", packed),
]
#: Edit distances, fingerprints and tokenizers are beyond SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, name)
    return docs


Q = {"pipeline": run}
SQL: dict[str, str] = {}
