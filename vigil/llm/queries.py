"""Registered queries of the training-data operators: each applies one to its whole table and returns the contract's columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import oracles
from .alignment import align_documents
from .common import Workspace, table
from .binary_records import token_records
from .embedding_dedup import cosine_classes
from .fill_in_middle import fill_in_middle, restored
from .html_text import extract_text
from .mixing import mix
from .nearest import nearest
from .ngram_join import jaccard_classes
from .packing import pack_documents
from .piece_bpe import decode_pieces, encode_pieces
from .quality import fit, score_quality
from .secrets import scan_secrets
from .token_counts import token_counts


def tokenizer(name: str) -> str:
    """Place of a public tokenizer file, which every executor has."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))


def op2_best_fit_packing(spark, sf_dir):
    return pack_documents(Workspace(spark), table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), size=1024)


def op3_embedding_near_dedup(spark, sf_dir):
    return cosine_classes(Workspace(spark), table(spark, sf_dir, "embeddings"), threshold=0.9)


def op4_ngram_jaccard_join(spark, sf_dir):
    return jaccard_classes(Workspace(spark), table(spark, sf_dir, "documents"), n_words=5, num=80, den=100)


def op5_token_binary_records(spark, sf_dir):
    return token_records(Workspace(spark), table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_source_mix(spark, sf_dir):
    return mix(Workspace(spark), table(spark, sf_dir, "documents"), share=1.5, most=2.0)


def op7_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), limit=4096)


def op8_secret_scan(spark, sf_dir):
    return scan_secrets(Workspace(spark), table(spark, sf_dir, "documents")).drop("all_spans")


def op9_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit(docs, table(spark, sf_dir, "labels")), good=0.7)


def op10_approximate_nearest(spark, sf_dir):
    return nearest(Workspace(spark), table(spark, sf_dir, "embeddings"), queries="vec_id % 100 = 0", k=10)


def op11_piece_codec(spark, sf_dir):
    model = tokenizer("piece_bpe_32k.model")
    back = decode_pieces(encode_pieces(table(spark, sf_dir, "documents"), model), model)
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


def op12_fill_in_middle(spark, sf_dir):
    made = fill_in_middle(table(spark, sf_dir, "documents"), seed=1, plain=10, spm=20)
    text = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op13_tokenizer_alignment(spark, sf_dir):
    return align_documents(Workspace(spark), table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op3_embedding_near_dedup": oracles.NEAR_VECTORS, "op4_ngram_jaccard_join": oracles.NGRAM_JOIN, "op8_secret_scan": oracles.SECRETS, "op12_fill_in_middle": oracles.FILL_IN_MIDDLE}
