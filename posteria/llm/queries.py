"""Registered queries of this subpackage, with SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posteria.llm import bpe, conversations, decontaminate, html_main, idfiles, kmeans_tree, language, lexical, minhash, oracles, packing, repeats, sharding, urls
from posteria.llm.tables import table

SHARDS = 16
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of equal row counts."""
    docs = table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + F.lit(1).cast("long")
    narrow = docs.select(
        "doc_id", size.alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32")
    )
    sharded = sharding.shard_rows(narrow, ["doc_id", "text_crc32", "size"], SHARDS, seed=1)
    return sharded.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def learned_languages(spark: SparkSession, docs: DataFrame) -> language.Profiles:
    """Profiles from the documents that are not held out."""
    return language.learn(docs.filter(~language.held_out(F.col("doc_id"))))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    judged = language.identify(docs, learned_languages(spark, docs), keep=["doc_id"])
    return judged.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, up to the edit budget, with the item and its place."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short=True)


def toxic_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls of the pages whose document (the number in the url) is labelled toxic."""
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").cast("long").alias("number")).distinct()
    number = F.expr("try_cast(regexp_extract(url, '/([0-9]+)', 1) AS bigint)")
    pages = table(spark, sf_dir, "pages").select("url", number.alias("number"))
    return pages.join(toxic, "number", "left_semi").select("url")


def op4_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page: the contract's rules, then the list of toxic pages."""
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, toxic_urls(spark, sf_dir))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose two-word shingles overlap by 0.8 or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return kmeans_tree.nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)


def op7_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether the tokens exceed 1024."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.count_tokens(table(spark, sf_dir, "documents"), path, limit=1024)


def op8_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 200-byte strings found elsewhere."""
    cut = repeats.remove_repeats(table(spark, sf_dir, "documents"), width=200, keep=["doc_id"])
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return cut.select(
        "doc_id",
        "n_bytes",
        n_removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by weights from pages whose document is known."""
    pages = table(spark, sf_dir, "pages")
    weights = html_main.fit(html_main.labelled_sample(pages, table(spark, sf_dir, "documents")))
    return html_main.extract(pages, weights)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of binary length of every document, with checksums made while the pieces are cut."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op11_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and repaired text of every conversation, after the contract's damage."""
    hurt = conversations.damage(table(spark, sf_dir, "conversations"))
    return conversations.summary(conversations.repair(hurt, copies_col="copies"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written to binary files and read back from them."""
    folder = idfiles.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return idfiles.read_ids(spark, folder, with_ids=False)


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents of every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


Q = {
    "op1_shard": op1_shard,
    "op2_language": op2_language,
    "op3_decontaminate": op3_decontaminate,
    "op4_filter_urls": op4_filter_urls,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_nearest": op6_nearest,
    "op7_count_tokens": op7_count_tokens,
    "op8_remove_repeats": op8_remove_repeats,
    "op9_extract_html": op9_extract_html,
    "op10_pack": op10_pack,
    "op11_repair_conversations": op11_repair_conversations,
    "op12_token_files": op12_token_files,
    "op13_search": op13_search,
}
# the others rest on tokenizers, learned models or edit distances; tests hold them against brute force
SQL = {
    "op1_shard": oracles.shard_sql(SHARDS, seed=1),
    "op4_filter_urls": oracles.url_sql(URL_RULES),
    "op5_near_duplicates": oracles.near_duplicate_sql(2, 80),
    "op8_remove_repeats": oracles.repeats_sql(200),
    "op11_repair_conversations": oracles.conversation_sql(),
    "op13_search": oracles.search_sql(10),
}
