"""Fixed values that results depend on."""

from __future__ import annotations

# Order of the effort tiers, of the judge labels and of the pair strata.
EFFORTS = ("none", "low", "medium", "high")
LABELS = ("A", "B", "C", "D")
STRATA = ("top", "middle", "bottom")
FACETS = ("purpose", "mechanism", "evaluation")
AXES = ("originality", "feasibility", "clarity")

# Points of a label, edges of the calibration bins, smoothing of sentence scores.
LABEL_POINTS = {"A": 10, "B": 7, "C": 4, "D": 1}
BIN_EDGES = (0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.7)
BLEU_EPSILON = 0.1
CALIBRATION_MEAN, CALIBRATION_LEAST, TREND_TOLERANCE, CALIBRATION_ROWS = 0.30, 0.21, 0.5, 30

# Fixed value: white space, as a class that Java's and RE2's patterns share.
WHITE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Patterns of the three tokenizers.
LEXICAL_TOKEN = "[a-z0-9]+(?:[-'][a-z0-9]+)*"
VOCABULARY_TOKEN = "[A-Za-z][A-Za-z-]*[A-Za-z]|[A-Za-z]"
SHARED_TOKEN = "[A-Za-z][A-Za-z-]*[A-Za-z]"

# Words that the vocabulary tokenizer leaves out.
VOCABULARY_STOPWORDS = """
a an the and or of to for in on at by with as is are was were be been being this that these those
it its from our we propose proposes proposed proposing approach approaches method methods
using used use uses via through will can could would should may might
has have had having which whose who whom when where how why what
not no nor so such also while whether than then there here
paper framework work study research
""".split()

# Words that the shared-vocabulary tokenizer leaves out.
SHARED_STOPWORDS = """
a an the and or of to for in on at by with as is are was were be been being
it its from this that these those such which who whom where when how why what
not no nor so also while whether than then there here both either neither
will can could would should may might must does did do has have had having
it's don't couldn't should've would've wouldn't doesn't hasn't isn't aren't
""".split()

# Cell contrasts (kind and effort on either side).
CELL_CONTRASTS = (
    ("default", "low", "default", "high"),
    ("default", "low", "vs", "low"),
    ("default", "high", "vs", "low"),
    ("default", "high", "vs", "high"),
    ("vs", "low", "vs", "high"),
    ("default", "low", "ssot", "low"),
    ("default", "high", "ssot", "high"),
    ("ssot", "low", "ssot", "high"),
    ("default", "high", "ssot", "low"),
    ("vs", "low", "ssot", "low"),
    ("vs", "high", "ssot", "high"),
    ("vs", "high", "ssot", "low"),
)

# Contrasts of distances (8) and of quality (7), and the comparisons of tiers, each as (kind, tier; kind, tier).
GAIN_CONTRASTS = (
    ("default", "high", "default", "low"),
    ("vs", "low", "default", "low"),
    ("vs", "low", "default", "high"),
    ("vs", "high", "default", "high"),
    ("vs", "high", "default", "low"),
    ("ssot", "low", "default", "low"),
    ("ssot", "high", "default", "high"),
    ("ssot", "high", "default", "low"),
)
QUALITY_CONTRASTS = tuple(c for c in GAIN_CONTRASTS if c != ("vs", "low", "default", "high"))
EFFECT_COMPARISONS = (("none", "low"), ("none", "medium"), ("none", "high"), ("low", "high"), ("medium", "high"))
