"""Url filtering: path rules first, then a list of urls behind a blocked Bloom filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posteria.llm.tables import quoted
from posteria.session import stage

LANES = 4  # one bit in each of four 64-bit words: a block is 256 bits
BITS_PER_KEY = 16
MAX_BLOCKS = 1 << 17  # 4 MB of filter; what is broadcast never exceeds this
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _after(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    found = F.regexp_extract(_after(F.coalesce(url, F.lit(""))), r"(?s)\A([^/?#]*)", 1)
    return F.translate(found, UPPER, UPPER.lower())


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after(F.coalesce(url, F.lit(""))), r"(?s)\A[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without a closing slash, query without tracking fields.

    Scheme and fragment do not count. Null for a url without host.
    """
    query = F.regexp_extract(_after(F.coalesce(url, F.lit(""))), r"(?s)\A[^?#]*\?([^#]*)", 1)
    fields = F.array_sort(F.filter(F.split(query, "&"), lambda f: (f != "") & ~f.rlike(r"\A(utm_[a-z]+|ref|fbclid|gclid)(=|\z)")))
    name = F.regexp_replace(host(url), r"\Awww\.", "")
    place = F.regexp_replace(path(url), r"/\z", "")
    whole = F.concat(name, place, F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise(F.lit("")))
    return F.when(name != "", whole)


def rule_of(host_col: Column, path_col: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none does.

    ``rules``: (verdict, host, path), a short list given by the caller. A rule
    fits its host and all subdomains if the path starts with its own.
    """
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host_col == name) | host_col.endswith("." + name)) & path_col.startswith(start)
        chosen = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("long"))


def _bit(key: Column, lane: int) -> Column:
    """The bit that a key sets in one lane, as a word."""
    place = F.pmod(F.xxhash64(F.lit(lane + 1), key), F.lit(64).cast("long")).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def bloom_filter(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """Rows (block, w0 .. w3) of the blocks that hold a key: at most ``blocks`` rows."""
    key = quoted(column)
    bits = keys.filter(key.isNotNull()).select(
        _block(key, blocks).alias("block"), *[_bit(key, i).alias(f"w{i}") for i in range(LANES)]
    )
    return bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(LANES)])


def blocks_for(keys: int) -> int:
    """A power of two for about 16 bits a key, never above ``MAX_BLOCKS``."""
    wanted = max(1, keys * BITS_PER_KEY // (64 * LANES))
    return min(MAX_BLOCKS, 1 << (wanted - 1).bit_length())


def listed_rows(df: DataFrame, column: str, listed: DataFrame, listed_column: str) -> DataFrame:
    """All rows of ``df`` plus ``listed`` (boolean): is ``column`` in the list?

    The filter is small by construction and broadcast; only rows that pass it
    are shuffled for the exact join, which removes its false positives. Null
    keys are never listed; repeated list entries count once. A list that
    outgrows the filter passes more rows, never wrong ones. An input column
    called ``listed`` is replaced.
    """
    keys = listed.select(quoted(listed_column).alias("_k")).filter(F.col("_k").isNotNull()).distinct()
    keys = stage(keys, "listed")  # so that a url of many rows can be split in the join
    blocks = blocks_for(keys.count())
    small = F.broadcast(bloom_filter(keys, "_k", blocks))
    names = [c for c in df.columns if c != "listed"]
    held = {c: f"_c{i}" for i, c in enumerate(names)}
    key = F.col("_key")
    rows = df.select(*[quoted(c).alias(v) for c, v in held.items()], quoted(column).alias("_key"))
    probed = rows.select("*", _block(key, blocks).alias("block")).join(small, "block", "left")
    passed = F.lit(True)
    for i in range(LANES):
        passed = passed & (F.col(f"w{i}").bitwiseAND(_bit(key, i)) != 0)
    probed = probed.select(*held.values(), "_key", F.coalesce(passed & key.isNotNull(), F.lit(False)).alias("_maybe"))
    out = [quoted(v).alias(c) for c, v in held.items()]
    sure = probed.filter(~F.col("_maybe")).select(*out, F.lit(False).alias("listed"))
    # left join of plain shuffles: the planner splits a url that holds many rows
    checked = (
        probed.filter("_maybe")
        .join(keys.withColumn("_in", F.lit(True)), F.col("_key") == F.col("_k"), "left")
        .select(*out, F.coalesce("_in", F.lit(False)).alias("listed"))
    )
    return sure.unionByName(checked)


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    listed: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    listed_col: str = "url",
) -> DataFrame:
    """id, host, path, rule, verdict ('allow' or 'block') and canonical url of every page.

    The longest fitting rule decides; without one a url is blocked if its
    canonical form is that of a listed url. Null or odd urls have an empty
    host and path and are allowed. One output row per input row, repeated ids
    included; extra columns are left out.
    """
    url = F.col("_u")
    rows = pages.select(quoted(id_col).alias("_id"), quoted(url_col).alias("_u"))
    rows = rows.select("_id", host(url).alias("_h"), path(url).alias("_p"), canonical(url).alias("_canon"))
    rows = rows.select("*", rule_of(F.col("_h"), F.col("_p"), rules).alias("_r"))
    # a url with a rule needs no look-up: its key is null
    rows = rows.withColumn("_look", F.when(F.col("_r").isNull(), F.col("_canon")))
    names = listed.select(canonical(quoted(listed_col)).alias("_listed_url"))
    judged = listed_rows(rows, "_look", names, "_listed_url")
    method = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        F.col("_id").alias(id_col),
        F.col("_h").alias("host"),
        F.col("_p").alias("path"),
        F.col("_r.rule").alias("rule"),
        F.coalesce(F.col("_r.verdict"), method).alias("verdict"),
        F.col("_canon").alias("canonical"),
    )
