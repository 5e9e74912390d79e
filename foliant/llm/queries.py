"""The queries of this folder's operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe_transducer, chat_format, content_sort, dual_tree, fst_repair, hpylm, html_tree, langid_ppm, merkle_warc, minhash_fss, packing, spotsigs, token_counts
from .common import table


def op1_bpe_roundtrip(spark, sf_dir):
    out = bpe_transducer.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op8_token_counts(spark, sf_dir):
    budget = 2048
    out = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), budget)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > budget).alias("over_limit"), "fit_chars")


def queries():
    return {
        "op1_bpe_roundtrip": op1_bpe_roundtrip,
        "op2_warc_fixity": merkle_warc.query,
        "op3_hpylm": hpylm.query,
        "op4_spotsigs": spotsigs.query,
        "op5_chat_format": chat_format.query,
        "op6_best_fit_packing": packing.query,
        "op7_content_sort": content_sort.query,
        "op8_token_counts": op8_token_counts,
        "op9_minhash_near_dedup": minhash_fss.query,
        "op10_language_ppm": langid_ppm.query,
        "op11_dual_tree_negatives": dual_tree.query,
        "op12_fst_repair": fst_repair.query,
        "op13_html_tree": html_tree.query,
    }


def oracle_sql():
    return {"op5_chat_format": chat_format.ORACLE, "op7_content_sort": content_sort.ORACLE, "op9_minhash_near_dedup": minhash_fss.ORACLE, "op11_dual_tree_negatives": dual_tree.ORACLE}
