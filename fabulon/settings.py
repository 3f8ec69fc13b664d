"""Settings of the arc pipeline (all can be passed as parameters)."""

# Scoring, windows, smoothing and selection defaults.
CHUNK_WORDS, CHUNK_OVERLAP = 400, 50
WINDOW_WORDS, WINDOW_POINTS = 10_000, 100
NEUTRAL_BAND = 1.0
SMOOTH_WINDOW, SMOOTH_ORDER = 11, 3
PEAK_TOP = 3
RESAMPLE_POINTS = 100
DIVERGENCE_TOP = 3
EXCERPT_WORDS, EXCERPT_CHARS = 200, 500
TEMPERATURES = (0.1, 0.3, 0.5, 0.7, 1.0)
BEST_OF = (1, 5, 10)
WINDOW_METHODS = ("xlm_roberta", "labmt")
PARALLEL_CALLS = 20
TOC_GAP = 500
TITLE_CHARS = 100
EXPLICIT_LABEL = "EXPLICIT_TITLES"
METHOD_LANGUAGES = {
    "vader": ("en",), "labmt": ("fr",), "xlm_roberta": ("fr", "en"), "llm_judge": ("fr", "en"),
    "sw_xlm_roberta": ("fr", "en"), "sw_labmt": ("fr",),
}
METHOD_SUFFIXES = ("sw_xlm_roberta", "sw_labmt", "xlm_roberta", "llm_judge", "labmt", "vader")
PAIRS = (("original_vs_human", "original", "human"), ("original_vs_llm", "original", "llm"), ("human_vs_llm", "human", "llm"))
PAIR_TITLES = {
    "original_vs_human": "Original vs. Human Translation",
    "original_vs_llm": "Original vs. LLM Translation",
    "human_vs_llm": "Human Translation vs. LLM Translation",
}
METRICS = (
    "pearson_r", "pearson_p", "spearman_rho", "spearman_p", "dtw_distance", "rmse", "mean_abs_diff", "cosine_similarity",
    "peak_alignment", "trough_alignment",
)
# Heading patterns by language in order of priority (label, what a whole line holds).
_NUMERAL = "[IVXLCDM]+"
HEADINGS = {
    "en": (
        ("CHAPTER_UPPER", rf"CHAPTER\s+(?:{_NUMERAL}|\d+|[A-Z][A-Z ]+)\s*\.?"),
        ("Chapter_Title", rf"Chapter\s+(?:{_NUMERAL}|\d+|[A-Za-z][A-Za-z ]+)\s*\.?"),
        ("Roman_Bare", _NUMERAL),
        ("BOOK", rf"BOOK\s+(?:{_NUMERAL}|\d+)\s*\.?"),
    ),
    "fr": (
        ("CHAPITRE_UPPER", rf"CHAPITRE\s+(?:{_NUMERAL}|\d+|PREMIER|PREMI[ÈE]RE|[A-ZÉÈ][A-ZÉÈ ]+)\s*\.?"),
        ("Chapitre_Title", rf"Chapitre\s+(?:{_NUMERAL}|\d+|[A-Za-zéèê][A-Za-zéèê ]+)\s*\.?"),
        ("Roman_Bare_FR", _NUMERAL),
        ("PARTIE", rf"PARTIE\s+(?:{_NUMERAL}|\d+|PREMI[ÈE]RE)\s*\.?"),
        ("LIVRE", rf"LIVRE\s+(?:{_NUMERAL}|\d+|PREMIER)\s*\.?"),
    ),
}
