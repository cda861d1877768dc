"""The registered queries of the training-data operators: thin digests over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.oracles import ORACLES  # noqa: F401  read by the registry
from termloom.session import stage, table


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termloom.llm.mixing import mix_sources, word_count

    # measured first and once, so that the texts themselves are neither shuffled nor read again
    text = F.col("text")
    docs = stage(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(text).alias("words"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc")))
    mixed = mix_sources(docs, size=F.col("words"), tie=F.col("crc"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op2_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termloom.llm.sharding import shard_rows

    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    # measured first, so that the text itself is not shuffled
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(raw).cast("long") + 16).alias("size"), F.crc32(raw).alias("text_crc32"))
    return shard_rows(docs, tie=F.col("text_crc32")).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op3_byte_index_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termloom.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), 3, 2)


def op4_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from termloom.llm.tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)


def op5_fm_index_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termloom.llm.substring import drop_repeats

    found = drop_repeats(table(spark, sf_dir, "documents"), 20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_guess_cost_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termloom.llm.secret_scan import scan_secrets

    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.expr("filter(spans, s -> s.kind <> 'guess')")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op7_random_index_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termloom.llm.quality import fit, held_out, labelled_sample, score_quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(*labelled_sample(docs, table(spark, sf_dir, "labels")))
    return score_quality(docs, model, 0.3).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op8_min_cut_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termloom.llm.html_extract import extract_pages

    return extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_ivf_pq_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termloom.llm.ann import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op10_suffix_array_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termloom.llm.decontam import mark_contaminated, n_hit

    marked = mark_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10, ["doc_id"])
    marked = marked.withColumn("n_hit", n_hit())
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed, (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {f.__name__: f for f in (op1_source_mix, op2_rendezvous_shards, op3_byte_index_simhash, op4_prefix_token_counts, op5_fm_index_repeats, op6_guess_cost_secrets, op7_random_index_quality, op8_min_cut_text, op9_ivf_pq_neighbours, op10_suffix_array_decontam)}
