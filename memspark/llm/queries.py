"""The queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from memspark.llm import chat, negatives, quality, resample
from memspark.llm.chat import op2_perspective_rotation
from memspark.llm.decontam import op6_decontaminate
from memspark.llm.html_text import op4_tree_model_text
from memspark.llm.language import op11_hyperdimensional_language
from memspark.llm.lengths import op9_length_histogram
from memspark.llm.negatives import op13_distance_key_negatives
from memspark.llm.packing import op1_harmonic_packing
from memspark.llm.pii import op8_boosted_pii
from memspark.llm.quality import op3_adaptive_quality
from memspark.llm.resample import op12_overlap_resampling
from memspark.llm.secret_scan import op7_guess_cost_secrets
from memspark.llm.simhash import op5_simhash_trie
from memspark.llm.wavelet import op10_wavelet_tokens

QUERIES = {
    "op1_harmonic_packing": op1_harmonic_packing,
    "op2_perspective_rotation": op2_perspective_rotation,
    "op3_adaptive_quality": op3_adaptive_quality,
    "op4_tree_model_text": op4_tree_model_text,
    "op5_simhash_trie": op5_simhash_trie,
    "op6_decontaminate": op6_decontaminate,
    "op7_guess_cost_secrets": op7_guess_cost_secrets,
    "op8_boosted_pii": op8_boosted_pii,
    "op9_length_histogram": op9_length_histogram,
    "op10_wavelet_tokens": op10_wavelet_tokens,
    "op11_hyperdimensional_language": op11_hyperdimensional_language,
    "op12_overlap_resampling": op12_overlap_resampling,
    "op13_distance_key_negatives": op13_distance_key_negatives,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op2_perspective_rotation": chat.SQL,
    "op3_adaptive_quality": quality.SQL,
    "op12_overlap_resampling": resample.SQL,
    "op13_distance_key_negatives": negatives.SQL,
}
