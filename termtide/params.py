"""Parameters of the engine with their default values.

Fixed values: these must equal the published behaviour the engine reproduces.
"""

# Snapshot size when the deployment configures one, and when it does not.
TOP_K = 100
TOP_K_UNSET = 25

# Count-min sketch: error as a share of the total, probability of exceeding
# it, hash seed; and the share of the total that makes a word a heavy hitter.
EPS = 0.01
DELTA = 0.01
SEED = 314
HEAVY_HITTERS_PCT = 0.0001

# Micro-batch interval.
TRIGGER_INTERVAL = "5 seconds"

# Element that holds a page's description.
CONTAINER = "#productDescription"

# Tokens must be longer than this, in UTF-16 units.
MIN_LEN = 1

# Stop words, compared with the lower-cased token before stemming.
STOP_WORDS = (
    "a", "all", "am", "an", "and", "any", "are", "aren't", "as", "at", "be",
    "because", "been", "to", "from", "by", "can", "can't", "do", "don't",
    "didn't", "did", "the", "is", "'", "or", "+", ".", "it", ",", '"', "!",
    "in", "for",
)

# Display sizes of the smallest and the largest word.
SIZE_RANGE = (10, 100)

# Words with at most one apostrophe suffix, or runs of punctuation. Combining marks
# belong to words; space separators such as U+00A0 divide tokens like any white space.
TOKEN_RE = r"[\p{L}\p{M}\p{N}]+(?:'[\p{L}\p{M}]+)?|[^\s\p{Z}\p{L}\p{M}\p{N}]+"

# URLs accepted for submission: four schemes, and a numeric port if any.
URL_RE = (
    r"(?i)^(https?|ftp|file)://([^/?#]*@)?(\[[^/?#\]]*\]|[^/?#:\[\]]*)"
    r"(:[0-9]{0,9})?([/?#]|$)"
)
