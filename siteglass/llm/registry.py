"""The queries of this subpackage, and their SQL."""

from . import additive_ann, attention_lm, bitsliced_topk, curriculum, importance, line_dedup, mincut_extract, ngram_join, sentencepiece_bpe, suffix_dedup, toxicity, warc_zip, whitening

MODULES = (warc_zip, bitsliced_topk, toxicity, curriculum, mincut_extract, ngram_join, suffix_dedup, attention_lm, sentencepiece_bpe, additive_ann, line_dedup, whitening, importance)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
