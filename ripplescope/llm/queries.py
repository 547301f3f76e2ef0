"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .centroids import op11_centroids
from .leaks import op5_benchmark_leaks
from .licenses import op6_license_scan
from .lm import op1_lm_scores
from .middles import op12_fill_in_middle
from .multiindex import op13_nearest_vectors
from .pieces import op8_pieces
from .secrets import op7_secret_scan
from .shingles import op2_jaccard_join
from .sql import ORACLE as ORACLE
from .suffixes import op9_suffix_dedup
from .toxicity import op4_toxicity
from .urls import op3_url_filter
from .vectors import op10_near_vectors

QUERIES = {
    "op1_lm_scores": op1_lm_scores,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_url_filter": op3_url_filter,
    "op4_toxicity": op4_toxicity,
    "op5_benchmark_leaks": op5_benchmark_leaks,
    "op6_license_scan": op6_license_scan,
    "op7_secret_scan": op7_secret_scan,
    "op8_pieces": op8_pieces,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_near_vectors": op10_near_vectors,
    "op11_centroids": op11_centroids,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_nearest_vectors": op13_nearest_vectors,
}
