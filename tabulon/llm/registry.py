"""Queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, fingerprint, jaccard, lm, mixing, pii, quality, runs, substrings, tokenfiles, urlfilter, vectorcodes, warc
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    f.__name__: f
    for f in (
        warc.op1_chunked_records,
        quality.op2_distribution_divergence,
        jaccard.op3_count_vector_tree,
        pii.op4_weak_supervision,
        bpe.op5_pair_index,
        lm.op6_causal_attention,
        tokenfiles.op7_separator_scan,
        fingerprint.op8_scaled_sketch,
        mixing.op9_temperature_mixing,
        urlfilter.op10_character_ratio,
        runs.op11_periodic_runs,
        substrings.op12_count_min_windows,
        vectorcodes.op13_exponion_codes,
    )
}
