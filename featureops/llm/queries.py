"""The operators of this package as queries over whole tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from featureops.llm.alignment import op12_asof_alignment
from featureops.llm.bpe import op7_bpe_forced_boundaries
from featureops.llm.decontaminate import op6_lsa_decontamination
from featureops.llm.fingerprint import op8_cws_fingerprints
from featureops.llm.lm import op9_lm_backoff_automaton
from featureops.llm.ngram_join import op1_ngram_bayes_join
from featureops.llm.pii import op5_pii_lstm_crf
from featureops.llm.prefix_trie import op13_z_fast_trie
from featureops.llm.quality import op4_quality_rule_ensemble
from featureops.llm.repeats import op10_sparse_suffix_repeats
from featureops.llm.toxicity import op3_toxicity_grammar
from featureops.llm.warc import op11_warc_sharded_writer
from featureops.llm.wrappers import op2_html_wrappers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_bayes_join, op2_html_wrappers, op3_toxicity_grammar, op4_quality_rule_ensemble, op5_pii_lstm_crf,
        op6_lsa_decontamination, op7_bpe_forced_boundaries, op8_cws_fingerprints, op9_lm_backoff_automaton, op10_sparse_suffix_repeats,
        op11_warc_sharded_writer, op12_asof_alignment, op13_z_fast_trie,
    )
}
