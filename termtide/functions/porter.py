"""Porter stemming as chained projections.

The algorithm is M. F. Porter, "An algorithm for suffix stripping", Program 14(3),
1980, with the two changes of its author's published implementation: ``bli -> ble``
and ``logi -> log`` in step 2. Only lower-case letters count as vowels, so a token keeps its
case, and tokens of one or two characters pass unchanged.

Every step is one or two projections over built-in functions. They are meant for a
vocabulary, not for a token stream: count first, stem the distinct words, sum again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termtide.functions.text import longer_than

# The suffix rules of the published algorithm.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al",
    "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic",
    "ful": "", "ness": "",
}
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)

# A consonant run starts with anything but a, e, i, o, u and goes on to the next vowel or y;
# a vowel run may start with y, except at the start of the word.
_C = "[^aeiou][^aeiouy]*"
_V = "[aeiouy][aeiou]*"
_VC = f"(?:{_C}{_V}|[aeiou]+){_C}"

HAS_VOWEL = f"(?:{_C}[aeiouy]|[aeiou])"
MEASURE_GT0 = f"^{_VC}"
MEASURE_GT1 = f"^{_VC}{_V}{_C}"
MEASURE_EQ1 = rf"^{_VC}(?:{_V})?\z"

# A run of y's alternates: consonant first after a vowel or at the start, vowel first otherwise.
_CONSONANT_Y = "(?:(?:^|[aeiou])y(?:yy)*|[^aeiouy](?:yy)+)"
ENDS_CVC = rf"(?:[^aeiouy]|{_CONSONANT_Y})[aeiouy][^aeiouwxy]\z"
ENDS_DOUBLE = r"([^aeiouy])\1\z|[^aeiouy](?:yy)+\z|(?:^|[aeiou])y(?:yy)+\z"


# In the SQL below, ``_w`` is the word as far as it is stemmed.
_REST = "left(_w, length(_w) - length(_cut))"
_LAST = "left(_w, length(_w) - 1)"


def _suffixes(suffixes) -> str:
    """SQL for the longest of ``suffixes`` that ends the word: the leftmost match."""
    return rf"regexp_extract(_w, r'(?:{'|'.join(suffixes)})\z', 0)"


def _replace(rules: dict[str, str]) -> str:
    """SQL that replaces the suffix in ``_cut``, if the rest has a measure above 0."""
    pairs = ", ".join(f"'{a}', '{b}'" for a, b in rules.items())
    return f"""CASE WHEN _cut <> '' AND {_REST} RLIKE r'{MEASURE_GT0}'
                    THEN {_REST} || map({pairs})[_cut] ELSE _w END"""


# One projection each: a column and the SQL of its new value.
_STEPS = [
    # 1a: plurals
    ("_w", r"regexp_replace({word}, r'(ss|i)es\z|([^s])s\z', '$1$2')"),
    # 1b: -eed, -ed, -ing; ``_cut`` is the word without -ed or -ing
    ("_cut", rf"""CASE WHEN _w RLIKE r'(?:ing|[^e]ed)\z'
                  THEN regexp_extract(_w, r'^({HAS_VOWEL}.*)(?:ed|ing)\z', 1) ELSE '' END"""),
    ("_w", rf"""CASE
        WHEN _cut = '' THEN
            CASE WHEN endswith(_w, 'eed') AND left(_w, length(_w) - 3) RLIKE r'{MEASURE_GT0}'
                 THEN {_LAST} ELSE _w END
        WHEN _cut RLIKE r'(?:at|bl|iz)\z' THEN _cut || 'e'
        WHEN _cut RLIKE r'{ENDS_DOUBLE}' THEN
            CASE WHEN _cut RLIKE r'[lsz]\z' THEN _cut ELSE left(_cut, length(_cut) - 1) END
        WHEN _cut RLIKE r'{MEASURE_EQ1}' AND _cut RLIKE r'{ENDS_CVC}' THEN _cut || 'e'
        ELSE _cut END"""),
    # 1c: -y
    ("_w", rf"""CASE WHEN endswith(_w, 'y')
                THEN regexp_replace(_w, r'^({HAS_VOWEL}.*)y\z', '$1i') ELSE _w END"""),
    # 2 and 3: double suffixes
    ("_cut", _suffixes(STEP2)), ("_w", _replace(STEP2)),
    ("_cut", _suffixes(STEP3)), ("_w", _replace(STEP3)),
    # 4: single suffixes
    ("_cut", _suffixes("(?<=[st])ion" if s == "ion" else s for s in STEP4)),
    ("_w", f"CASE WHEN _cut <> '' AND {_REST} RLIKE r'{MEASURE_GT1}' THEN {_REST} ELSE _w END"),
    # 5: -e, -ll
    ("_w", f"""CASE WHEN endswith(_w, 'e') AND ({_LAST} RLIKE r'{MEASURE_GT1}'
                OR ({_LAST} RLIKE r'{MEASURE_EQ1}' AND NOT {_LAST} RLIKE r'{ENDS_CVC}'))
                THEN {_LAST} ELSE _w END"""),
    ("_w", f"""CASE WHEN endswith(_w, 'll') AND _w RLIKE r'{MEASURE_GT1}'
                THEN {_LAST} ELSE _w END"""),
]


def with_stem(df: DataFrame, word: str = "word", out: str = "stem") -> DataFrame:
    """Add ``out``, the stem of column ``word``."""
    original = F.col(word)
    for column, sql in _STEPS:
        df = df.withColumn(column, F.expr(sql.replace("{word}", f"`{word}`")))
    stem = F.when(longer_than(original, 2), F.col("_w")).otherwise(original)
    return df.withColumn(out, stem).drop("_w", "_cut")
