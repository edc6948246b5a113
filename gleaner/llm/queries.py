"""The training-data operators as registered queries, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.suffix_dedup import remove_repeats

    found = remove_repeats(_table(spark, sf_dir, "documents"), depth=200)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, radius=2).select("doc_id", "fingerprint", "component_id")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), length=2048)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.quality import COUNTS, assess

    found = assess(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return found.select("doc_id", *COUNTS, "base_failed", "kept")


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.pii import KINDS, pseudonymise, session_key

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, session_key(spark)).select("doc_id", "text", *(f"n_{k}" for k in KINDS))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.toxicity import classify

    return classify(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.embedding_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op9_hidden_markov_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.language_model import score

    return score(_table(spark, sf_dir, "documents"))


def op10_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.warc import archive

    found = archive(_table(spark, sf_dir, "pages"), least=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.exact_dedup import dedup

    return dedup(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.fill_in_middle import fill_in_middle, restored_sha256

    found = fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"), seed=42, rate=50, spm=80)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", restored_sha256(found.output, found.form).alias("restored_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm.token_alignment import agreement

    return agreement(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {
        "op1_suffix_array_dedup": op1_suffix_array_dedup,
        "op2_source_mixing": op2_source_mixing,
        "op3_toxicity": op3_toxicity,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_quality_rules": op5_quality_rules,
        "op6_pii_pseudonyms": op6_pii_pseudonyms,
        "op7_simhash_near_dedup": op7_simhash_near_dedup,
        "op8_embedding_near_dedup": op8_embedding_near_dedup,
        "op9_hidden_markov_scores": op9_hidden_markov_scores,
        "op10_warc_archives": op10_warc_archives,
        "op11_exact_dedup": op11_exact_dedup,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_token_alignment": op13_token_alignment,
        "pipeline": pipeline,
    }


def oracle_sql():
    from gleaner.llm import oracle

    return oracle.oracle_sql()
