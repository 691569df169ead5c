"""Parameters that are part of the results."""

# Sizes in code points, limits and weights.
CHUNK_TARGET, CHUNK_HARD, CHUNK_MIN = 500, 750, 15
TOP_K, RRF_K = 6, 60
PAGE_BREAK = "\f"
TITLE_MAX = 60
GARBAGE_ALPHA, GARBAGE_DENSITY, GARBAGE_MOJIBAKE, GARBAGE_DOC_MAX = 0.35, 3.0, 0.02, 0.30
BM25_K1, BM25_B = 1.5, 0.75
HIT_COVERAGE, MIN_TERM, MAX_TERMS = 0.45, 4, 25
UNKNOWN_IDF, MAX_IDF = 6.0, 8.0
WINDOW_CHARS, WINDOW_OVERLAP = 1400, 200
PROMPT_BUDGET, CONTEXTS, LEAST_CONTEXT = 3000, 6, 200
# End of fixed values.
