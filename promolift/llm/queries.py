"""One registered query per operator, over its whole table, with the parameters meant for production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promolift.llm import (
    bpe,
    chat,
    decontaminate,
    divergence,
    exact_dedup,
    langid,
    ngram_join,
    pieces,
    pii,
    repair,
    toxicity,
    url_rules,
    warc,
)
from promolift.llm.common import held_out, table

Query = Callable[[SparkSession, str], DataFrame]

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.personal_data(table(spark, folder, "documents"))
    plain = F.filter("spans", lambda span: span["plain"])
    joined = lambda spans: F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    )

    def count(kind: str) -> Column:
        return F.size(F.filter(plain, lambda span: span["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.KINDS]
    added = (F.size("spans") - F.size(plain)).cast("long").alias("n_added")
    base = F.sha2(joined(plain), 256).alias("base_sha256")
    return found.select(F.col("id").alias("doc_id"), *counts, base, joined(F.col("spans")).alias("spans"), added)


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.record_summary(warc.round_trip(table(spark, folder, "pages")))


def op3_chat(spark: SparkSession, folder: str) -> DataFrame:
    said = "'</s>[INST] ok [/INST]'"
    extra = spark.range(2).selectExpr(
        "-7L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", f"{said} AS text"
    )
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    back = chat.read_back(chat.formatted_windows(rows, within_budget=True))
    return back.select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.length("targets").cast("long").alias("loss_chars"),
        F.sha2("targets", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def toxicity_model(spark: SparkSession, folder: str) -> toxicity.Model:
    return toxicity.train(table(spark, folder, "documents"), table(spark, folder, "labels"), ~held_out("doc_id"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.score(toxicity_model(spark, folder), table(spark, folder, "documents"))
    return scored.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", "predicted")


def op5_langid(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    found = langid.identify(langid.train(documents, ~held_out("doc_id")), documents)
    return found.select(
        F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score", "ambiguous"
    )


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_copies(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


def op8_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = url_rules.judge(table(spark, folder, "pages"))
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op9_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_copies(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def vocabulary() -> bpe.Vocabulary:
    import public_tokenizers  # only this query needs the vocabulary files to be installed

    return bpe.Vocabulary(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, cut_at_space=True)


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), vocabulary()).withColumnRenamed("id", "doc_id")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut off, repeated or given to the user, as a digest of their id and turn says."""
    spoken = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(spoken("conv_id"), F.lit(":"), spoken("turn")).cast("binary")) % 20
    text = F.when(harm == 1, "").when(harm == 2, F.translate(spoken("text"), ".!?", "")).otherwise(spoken("text"))
    role = F.when(harm == 4, "user").otherwise(spoken("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(harm == 3, 2).otherwise(1)))
    kept = conversations.where(harm != 0)
    return kept.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("col")


def op11_repair(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    found = repair.repair(damaged(conversations))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    nothing = F.sha2(F.lit(""), 256)
    summary = found.summary.withColumnRenamed("conv_id", "counted")
    written_out = repair.transcripts(found.steps).withColumnRenamed("conv_id", "read")
    return (
        conversations.select("conv_id").distinct()
        .join(summary, F.col("conv_id").eqNullSafe(F.col("counted")), "left")
        .join(written_out, F.col("conv_id").eqNullSafe(F.col("read")), "left")
        .select(
            "conv_id", *[F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in counts],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"),
        )
    )


def op12_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


def op13_pieces(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    model = pieces.Model(public_tokenizers.path(PIECES))
    return pieces.round_trip(table(spark, folder, "documents"), model).withColumnRenamed("id", "doc_id")


def all_queries() -> dict[str, Query]:
    queries = (
        op1_pii, op2_warc, op3_chat, op4_toxicity, op5_langid, op6_exact_dedup, op7_decontaminate, op8_url_rules,
        op9_ngram_jaccard, op10_bpe, op11_repair, op12_divergence,
        op13_pieces,
    )
    return {query.__name__: query for query in queries}
