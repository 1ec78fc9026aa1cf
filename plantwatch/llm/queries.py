"""The registered queries of this subpackage, with production parameters on whole tables, and their SQL twins."""

import os

from plantwatch.llm import chat_format, decontaminate, filter_audit, html_main, merkle, mixing, quality, secret_scan, vector_codes, warc
from plantwatch.llm import minhash_dedup as dedup
from plantwatch.llm import token_counts as counts
from plantwatch.llm import token_files as files
from plantwatch.llm.store import ship


def _table(spark, sf_dir, name):
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name="byte_bpe_50k.json"):
    """Where the public vocabulary lies; $TOKENIZERS_DIR overrides it."""
    folder = os.environ.get("TOKENIZERS_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_dedup(spark, sf_dir):
    return dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_quality(spark, sf_dir):
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_decontaminate(spark, sf_dir):
    return decontaminate.contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_warc(spark, sf_dir):
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op3_secret_scan(spark, sf_dir):
    return secret_scan.secrets(_table(spark, sf_dir, "documents"))


def op8_html_main(spark, sf_dir):
    return html_main.extracted(_table(spark, sf_dir, "pages"))


def op5_mixing(spark, sf_dir):
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op10_merkle(spark, sf_dir):
    return merkle.document_fingerprints(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark, sf_dir):
    return counts.token_counts(_table(spark, sf_dir, "documents"), vocabulary())


def op7_token_files(spark, sf_dir):
    return files.token_files(_table(spark, sf_dir, "documents"), vocabulary())


def op11_vector_codes(spark, sf_dir):
    return vector_codes.vector_codes(_table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark, sf_dir):
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_chat_format(spark, sf_dir):
    return chat_format.round_trip(_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_warc, op3_secret_scan, op4_decontaminate, op5_mixing, op6_token_counts, op7_token_files, op8_html_main, op9_quality, op10_merkle,
                                op11_vector_codes, op12_filter_audit, op13_chat_format)}
ORACLE = {"op2_warc": warc.SQL, "op4_decontaminate": decontaminate.SQL, "op5_mixing": mixing.SQL, "op11_vector_codes": vector_codes.SQL, "op12_filter_audit": filter_audit.SQL,
          "op13_chat_format": chat_format.SQL}
