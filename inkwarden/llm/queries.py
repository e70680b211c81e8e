"""The registered queries of this folder and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from .byte_pairs import op10_byte_pairs
from .filter_audit import OP12_SQL, op12_filter_audit
from .fingerprints import op2_fingerprints
from .hidden_markov import op11_hidden_markov
from .jaccard import OP3_SQL, op3_jaccard
from .language import op9_language
from .neighbours import OP4_SQL, op4_neighbours
from .packing import op1_packing
from .quality import op7_quality
from .surrogates import op8_surrogates
from .token_counts import op5_token_counts
from .toxicity import op6_toxicity
from .whitening import op13_whitening

QUERIES: dict[str, Callable] = {
    "op9_language": op9_language,
    "op1_packing": op1_packing,
    "op2_fingerprints": op2_fingerprints,
    "op4_neighbours": op4_neighbours,
    "op5_token_counts": op5_token_counts,
    "op6_toxicity": op6_toxicity,
    "op7_quality": op7_quality,
    "op3_jaccard": op3_jaccard,
    "op8_surrogates": op8_surrogates,
    "op10_byte_pairs": op10_byte_pairs,
    "op11_hidden_markov": op11_hidden_markov,
    "op12_filter_audit": op12_filter_audit,
    "op13_whitening": op13_whitening,
}

ORACLES: dict[str, str] = {
    "op3_jaccard": OP3_SQL,
    "op4_neighbours": OP4_SQL,
    "op12_filter_audit": OP12_SQL,
}
