"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from lakeloom.llm import clusters, codes, lengths, mixing, near, packing, pieces, quality, repeats, rules, surrogates, telephony, toxicity
from lakeloom.llm.common import documents


def remainder(n: int):
    """crc32 of the document id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_quality_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    machine = quality.fit(docs, labels(spark, sf_dir), remainder(4) != 2, metadata=("n_chars",))
    return quality.score(docs, machine, metadata=("n_chars",)).withColumn("held_out", remainder(4) == 2)


def op2_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, labels(spark, sf_dir), remainder(3) != 1)
    return toxicity.score(docs, model).withColumn("held_out", remainder(3) == 1)


def op3_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(documents(spark, sf_dir))


def op4_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.payload_features(documents(spark, sf_dir))


def op5_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.limits(lengths.histogram(lengths.token_lengths(documents(spark, sf_dir))))


def op6_super_kmer_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(documents(spark, sf_dir), ["doc_id"])


def op8_adaptive_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classes(documents(spark, sf_dir))


def op9_mixing_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In the order of training: by the time of each document's first copy, those not taken last."""
    out = mixing.mix(documents(spark, sf_dir))
    first = F.col("time_1").isNull()
    out = out.repartitionByRange(first, "time_1", "doc_id").sortWithinPartitions(first, "time_1", "doc_id")
    return out.withColumns({c: F.round(c, 6) for c in ("time_1", "time_2")})


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = surrogates.surrogates(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.size("_types").cast("long").alias("n_entities"), F.array_join(F.array_sort("_types"), ",").alias("types"), "text")


def op11_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces_ = packing.pack(documents(spark, sf_dir))
    return pieces_.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op12_delta_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = codes.compressed(embeddings(spark, sf_dir))
    code = F.array_join(F.transform("indexes", lambda i: F.lower(F.lpad(F.hex(i), 2, "0"))), "")
    return codes.with_label_errors(out).select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))


def op13_drake_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, model = clusters.clustered(embeddings(spark, sf_dir))
    return clusters.with_inertia(out, model).withColumnRenamed("id", "vec_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_machine,
        op2_counterfactual_toxicity,
        op3_piece_transducer,
        op4_telephony_audio,
        op5_length_histogram,
        op6_super_kmer_repeats,
        op7_quality_rules,
        op8_adaptive_prefix_join,
        op9_mixing_curriculum,
        op10_pii_surrogates,
        op11_tier_packing,
        op12_delta_codes,
        op13_drake_clusters,
    )
}
ORACLES: dict[str, str] = {
    "op6_super_kmer_repeats": repeats.ORACLE,
    "op7_quality_rules": rules.oracle(),
    "op8_adaptive_prefix_join": near.ORACLE,
    "op9_mixing_curriculum": mixing.oracle(),
    "op12_delta_codes": codes.oracle(),
    "op13_drake_clusters": clusters.oracle(),
}
