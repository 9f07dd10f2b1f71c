"""The registered queries of this package and their SQL."""

from __future__ import annotations

from . import bpe, bytebpe, decontaminate, langid, licenses, media, merkle, ngram_join, quotes, repeats, secrets, spelling, toxicity
from .store import table


def op6_benchmark_decontamination(spark, sf_dir):
    return decontaminate.digest(decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op3_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.link_documents(table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe_encode_decode(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary_path())


def op11_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark, sf_dir):
    return merkle.verify(table(spark, sf_dir, "documents"))


def op13_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return bytebpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_media_tiff(spark, sf_dir):
    return media.store_and_read(table(spark, sf_dir, "documents"))


def op2_quotation_linking(spark, sf_dir):
    return quotes.digest(table(spark, sf_dir, "conversations"))


def quoting_replies(spark, sf_dir):
    """Quotation linking where replies quote: the given conversations as mail clients would send them."""
    return quotes.digest(quotes.quoting(table(spark, sf_dir, "conversations")))


def op8_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op1_toxicity(spark, sf_dir):
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language_id(spark, sf_dir):
    return langid.judge(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark, sf_dir):
    return secrets.digest(table(spark, sf_dir, "documents"))


QUERIES = {"op11_spelling_variants": op11_spelling_variants, "op12_merkle_manifest": op12_merkle_manifest, "op13_byte_bpe": op13_byte_bpe, "quoting_replies": quoting_replies, "op9_language_id": op9_language_id, "op10_secret_scan": op10_secret_scan, "op1_toxicity": op1_toxicity, "op2_quotation_linking": op2_quotation_linking, "op8_license_scan": op8_license_scan, "op5_bpe_encode_decode": op5_bpe_encode_decode, "op7_media_tiff": op7_media_tiff, "op4_suffix_array_dedup": op4_suffix_array_dedup, "op3_ngram_jaccard_join": op3_ngram_jaccard_join, "op6_benchmark_decontamination": op6_benchmark_decontamination}
SQL: dict[str, str] = {"op11_spelling_variants": spelling.variants_sql(), "op12_merkle_manifest": merkle.verify_sql(), "op2_quotation_linking": quotes.digest_sql(), "quoting_replies": quotes.digest_sql(quotes.QUOTING_SQL), "op8_license_scan": licenses.scan_sql()}
