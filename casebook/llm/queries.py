"""The queries of this folder: each applies an operator to its whole table."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import functions as F

from casebook.llm import bpe, decontam, language, lengths, neardup, periods, pieces, quality, repeats, secrets, trie, urls, warc
from casebook.llm.common import new_folder, read


def op3_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = language.fit(docs.where(~language.held_out()))
    return language.predict(docs, model).withColumn("held_out", language.held_out()).select("doc_id", "held_out", "lang_pred", "score")


#: The rules of the query.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op4_url_filter(spark, sf_dir):
    return urls.judge(read(spark, sf_dir, "pages"), URL_RULES)


def op5_warc(spark, sf_dir):
    folder = new_folder(spark, "warc")
    warc.write(read(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_decontamination(spark, sf_dir):
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_repeats(spark, sf_dir):
    return repeats.digests(read(spark, sf_dir, "documents"))


def repeats_descended(spark, sf_dir):
    """The same with a descent of every core that occurs more than three times."""
    return repeats.digests(read(spark, sf_dir, "documents"), group=3)


def op8_near_duplicates(spark, sf_dir):
    return neardup.groups(read(spark, sf_dir, "documents"), k=2, percent=80)


def op9_quality_rules(spark, sf_dir):
    rows = quality.apply_policy(quality.ledger(read(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_upper", "n_lower", "fail_bits")


def quality_ablations(spark, sf_dir):
    return quality.ablations(quality.ledger(read(spark, sf_dir, "documents")))


def op1_secret_scan(spark, sf_dir):
    return secrets.scan(read(spark, sf_dir, "documents"))


def op2_bpe(spark, sf_dir):
    return bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_token_counts(spark, sf_dir):
    return lengths.suffix_sums(lengths.histogram(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op11_pieces(spark, sf_dir):
    return pieces.checked(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_periods(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return periods.digests(periods.runs(docs, text=periods.seeded(F.col("doc_id"), F.col("text"))))


def op13_prefix_trie(spark, sf_dir):
    nodes = trie.trie(trie.paths(read(spark, sf_dir, "conversations"), borrow=True))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


QUERIES = {"op1_secret_scan": op1_secret_scan, "op2_bpe": op2_bpe, "op3_language_id": op3_language_id, "op4_url_filter": op4_url_filter, "op5_warc": op5_warc, "op6_decontamination": op6_decontamination, "op7_repeats": op7_repeats, "repeats_descended": repeats_descended, "op8_near_duplicates": op8_near_duplicates, "op9_quality_rules": op9_quality_rules, "quality_ablations": quality_ablations, "op10_token_counts": op10_token_counts, "op11_pieces": op11_pieces, "op12_periods": op12_periods, "op13_prefix_trie": op13_prefix_trie}
