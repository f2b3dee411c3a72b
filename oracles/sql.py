"""DuckDB SQL that states the result of every registered query."""

from __future__ import annotations

from termtide import params
from termtide.functions import porter
from termtide.operators.sketch import depth_of, width_of

CONTAINER = "article"
FINE_EPS = 0.0001


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def with_(ctes: list[tuple[str, str]], query: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in ctes) + "\n" + query


SUBMISSIONS = [("sub", """
    SELECT e.event_id, e.ts,
           CASE WHEN e.event_type = 'error'
                THEN concat('bad url ', CAST(e.event_id % 7 AS VARCHAR))
                ELSE p.url END AS url
    FROM events e
    JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages)""")]

OUTCOMES = SUBMISSIONS + [("outcomes", f"""
    SELECT event_id, ts, url,
           CASE WHEN NOT regexp_matches(url, {quote(params.URL_RE)}) THEN 'malformed'
                WHEN row_number() OVER (PARTITION BY url ORDER BY ts, event_id) = 1 THEN 'accepted'
                ELSE 'duplicate' END AS outcome
    FROM sub""")]

PARAGRAPH = (rf"(?is)<{CONTAINER}[^>]*>.*?<p(?:\s[^>]*)?>(.*?)"
             rf"(?:</p\s*>|<p[\s>]|</{CONTAINER})")

DESCRIPTIONS = [("paragraphs", f"""
    SELECT page_id, url,
           regexp_replace(regexp_replace(
               regexp_extract(html, {quote(PARAGRAPH)}, 1),
               '(?i)<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') AS html
    FROM pages
    WHERE regexp_matches(html, {quote(PARAGRAPH)})"""), ("descriptions", r"""
    SELECT page_id, url,
           trim(regexp_replace(
               replace(replace(replace(replace(html, '&quot;', '"'), '&copy;', '©'),
                               '&middot;', '·'), '&amp;', '&'),
               '[ \t\n\f\r]+', ' ', 'g')) AS description
    FROM paragraphs""")]

SUBMITTED = OUTCOMES + DESCRIPTIONS + [("submitted", """
    SELECT d.url, d.description
    FROM descriptions d JOIN outcomes o ON o.url = d.url AND o.outcome = 'accepted'""")]


def words(table: str, text: str, keep: str = "") -> list[tuple[str, str]]:
    stop = ", ".join(quote(w) for w in params.STOP_WORDS)
    return [
        ("tokens", f"""
    SELECT * FROM (
        SELECT {keep} unnest(regexp_extract_all({text}, {quote(params.TOKEN_RE)})) AS word
        FROM {table})
    WHERE length(word) > {params.MIN_LEN} OR strlen(word) = 4"""),
        ("words", f"SELECT * FROM tokens WHERE lower(word) NOT IN ({stop})"),
        ("counts", "SELECT word, count(*) AS n FROM words GROUP BY word"),
    ]


def _suffix_step(rules: dict[str, str], measure: str) -> str:
    """Replace the longest suffix that matches, if the measure of the rest allows."""
    branches = []
    for suffix in sorted(rules, key=len, reverse=True):
        rest = f"w[:length(w) - {len(suffix)}]"
        ends = f"suffix(w, {quote(suffix)})"
        allowed = f"regexp_matches({rest}, {quote(measure)})"
        if suffix == "ion":
            allowed += f" AND {rest}[-1:] IN ('s', 't')"
        branches.append(f"WHEN {ends} THEN CASE WHEN {allowed} "
                        f"THEN {rest} || {quote(rules[suffix])} ELSE w END")
    return "CASE " + "\n".join(branches) + " ELSE w END"


def porter_steps(table: str) -> list[tuple[str, str]]:
    """Tables ending in ``stems(word, stem)`` for the distinct words of ``table``."""
    vowel = quote("^" + porter.HAS_VOWEL)
    gt0, gt1, eq1 = map(quote, (porter.MEASURE_GT0, porter.MEASURE_GT1, porter.MEASURE_EQ1))
    cvc = quote(porter.ENDS_CVC)
    consonant_yy = quote(r"[^aeiouy](?:yy)+\z|(?:^|[aeiou])y(?:yy)+\z")
    double = (f"(cut[-1:] = cut[-2:-2] AND (cut[-1:] NOT IN ('a','e','i','o','u','y') "
              f"OR regexp_matches(cut, {consonant_yy})))")
    steps = [
        ("""CASE WHEN suffix(w, 'sses') OR suffix(w, 'ies') THEN w[:length(w) - 2]
                 WHEN suffix(w, 's') AND NOT suffix(w, 'ss') THEN w[:length(w) - 1]
                 ELSE w END""", "NULL"),
        ("w", f"""CASE WHEN suffix(w, 'eed') THEN NULL
                  WHEN suffix(w, 'ed') AND regexp_matches(w[:length(w) - 2], {vowel})
                  THEN w[:length(w) - 2]
                  WHEN suffix(w, 'ing') AND regexp_matches(w[:length(w) - 3], {vowel})
                  THEN w[:length(w) - 3] END"""),
        (f"""CASE WHEN suffix(w, 'eed') AND regexp_matches(w[:length(w) - 3], {gt0})
                  THEN w[:length(w) - 1]
                  WHEN cut IS NULL THEN w
                  WHEN suffix(cut, 'at') OR suffix(cut, 'bl') OR suffix(cut, 'iz')
                  THEN cut || 'e'
                  WHEN {double} THEN CASE WHEN cut[-1:] IN ('l', 's', 'z') THEN cut
                                          ELSE cut[:length(cut) - 1] END
                  WHEN regexp_matches(cut, {eq1}) AND regexp_matches(cut, {cvc}) THEN cut || 'e'
                  ELSE cut END""", "NULL"),
        (f"""CASE WHEN suffix(w, 'y') AND regexp_matches(w[:length(w) - 1], {vowel})
                  THEN w[:length(w) - 1] || 'i' ELSE w END""", "NULL"),
        (_suffix_step(porter.STEP2, porter.MEASURE_GT0), "NULL"),
        (_suffix_step(porter.STEP3, porter.MEASURE_GT0), "NULL"),
        (_suffix_step(dict.fromkeys(porter.STEP4, ""), porter.MEASURE_GT1), "NULL"),
        ("w", "CASE WHEN suffix(w, 'e') THEN w[:length(w) - 1] END"),
        (f"""CASE WHEN cut IS NOT NULL AND (regexp_matches(cut, {gt1})
                      OR (regexp_matches(cut, {eq1}) AND NOT regexp_matches(cut, {cvc})))
                  THEN cut ELSE w END""", "NULL"),
        (f"""CASE WHEN suffix(w, 'll') AND regexp_matches(w, {gt1})
                  THEN w[:length(w) - 1] ELSE w END""", "NULL"),
    ]
    ctes = [("step0", f"SELECT DISTINCT word, word AS w, CAST(NULL AS VARCHAR) AS cut FROM {table}")]
    for i, (w, cut) in enumerate(steps, start=1):
        ctes.append((f"step{i}", f"SELECT word, {w} AS w, {cut} AS cut FROM step{i - 1}"))
    # Two characters beyond the basic plane take four bytes each and count twice.
    longer = "length(word) > 2 OR regexp_matches(word, '.[\\x{10000}-\\x{10FFFF}]|[\\x{10000}-\\x{10FFFF}].')"
    ctes.append(("stems", f"SELECT word, CASE WHEN {longer} THEN w ELSE word END AS stem "
                          f"FROM step{len(steps)}"))
    return ctes


STEM_COUNTS = ("stem_counts", """
    SELECT s.stem AS word, CAST(sum(c.n) AS BIGINT) AS n
    FROM counts c JOIN stems s ON s.word = c.word GROUP BY s.stem""")


def sketch(eps: float, table: str = "counts") -> list[tuple[str, str]]:
    bucket = (f"('0x' || substr(md5('{params.SEED}:' || r || ':' || word), 1, 8))::BIGINT "
              f"% {width_of(eps)}")
    return [
        ("hashed", f"""
    SELECT word, n, r, {bucket} AS b
    FROM {table}, (SELECT CAST(unnest(range({depth_of(params.DELTA)})) AS INTEGER) AS r)"""),
        ("cells", "SELECT r, b, CAST(sum(n) AS BIGINT) AS c FROM hashed GROUP BY r, b"),
        ("estimates", """
    SELECT h.word, h.n, min(c.c) AS est
    FROM hashed h JOIN cells c ON c.r = h.r AND c.b = h.b GROUP BY h.word, h.n"""),
    ]


def threshold(table: str) -> str:
    return (f"CAST({params.HEAVY_HITTERS_PCT:.10f} AS DOUBLE) "
            f"* (SELECT CAST(sum(n) AS DOUBLE) FROM {table})")


def top(table: str, by: str = "n", where: str = "true") -> tuple[str, str]:
    return ("top", f"""
    SELECT word, CAST({by} AS DOUBLE) AS score FROM {table}
    WHERE {where} ORDER BY {by} DESC, word LIMIT {params.TOP_K}""")


ITEMS = ("items", "SELECT word AS text, CAST(least(score, 2147483647) AS INTEGER) AS size FROM top")


# The end of the first hundredth of the events' time.
EARLY = ("span", """
    SELECT min(ts) + to_microseconds((epoch_us(max(ts)) - epoch_us(min(ts))) // 100) AS middle
    FROM events""")


def oracle_sql() -> dict[str, str]:
    documents = words("documents", "text", "doc_id,")
    submitted = SUBMITTED + words("submitted", "description")
    stems = documents + porter_steps("counts") + [STEM_COUNTS]
    chain = submitted + porter_steps("counts") + [STEM_COUNTS]
    per_document = "SELECT doc_id, word, count(*) AS n FROM {} GROUP BY doc_id, word"
    items = documents + [top("counts"), ITEMS]
    low, high = params.SIZE_RANGE
    return {
        "q01_submission_outcomes": with_(OUTCOMES, "SELECT event_id, url, outcome FROM outcomes"),
        "q02_accepted_urls": with_(
            OUTCOMES, "SELECT url, ts FROM outcomes WHERE outcome = 'accepted'"),
        "q03_page_descriptions": with_(
            DESCRIPTIONS, "SELECT page_id, description FROM descriptions"),
        "q04_submitted_descriptions": with_(SUBMITTED, "SELECT url, description FROM submitted"),
        "q05_tokens": with_(documents, per_document.format("tokens")),
        "q06_filtered_words": with_(documents, per_document.format("words")),
        "q07_stems": with_(stems, "SELECT word AS stem, n FROM stem_counts"),
        "q08_word_counts": with_(documents, "SELECT word, n FROM counts"),
        "q09_merged_counts": with_(documents, "SELECT word, n FROM counts"),
        "q10_total_words": with_(documents, "SELECT CAST(sum(n) AS BIGINT) AS total FROM counts"),
        "q11_cms_cells": with_(documents + sketch(params.EPS), "SELECT r, b, c FROM cells"),
        "q12_cms_estimates": with_(
            documents + sketch(params.EPS), "SELECT word, n, est FROM estimates"),
        "q13_heavy_hitters": with_(
            documents, f"SELECT word, n FROM counts WHERE n >= {threshold('counts')}"),
        "q14_heavy_hitters_cms": with_(
            documents + sketch(FINE_EPS),
            f"SELECT word, est FROM estimates WHERE est >= {threshold('counts')}"),
        "q15_top_words": with_(documents + [top("counts")], "SELECT word, score FROM top"),
        "q16_cloud_items": with_(items, "SELECT text, size FROM items"),
        "q17_cloud_json": with_(items, """
            SELECT CAST(to_json(list({'text': text, 'size': size} ORDER BY size DESC, text))
                        AS VARCHAR) AS json FROM items"""),
        "q18_display_sizes": with_(items + [("ends", """
            SELECT CASE WHEN min(size) = 0 THEN 1 ELSE min(size) END AS lo, max(size) AS hi
            FROM items"""), ("scaled", """
            SELECT text, coalesce((sqrt(size) - sqrt(lo)) / nullif(sqrt(hi) - sqrt(lo), 0), 0) AS t
            FROM items, ends""")],
            f"SELECT text, CAST(trunc({low} * (1 - t) + {high} * t) AS INTEGER) AS font_px FROM scaled"),
        "q19_case_folded": with_(items + [("spellings", """
            SELECT text, size,
                   row_number() OVER (PARTITION BY lower(text) ORDER BY size DESC, text) AS i
            FROM items""")], "SELECT text, size FROM spellings WHERE i = 1"),
        "q20_stream_counts": with_(chain, "SELECT word, n FROM stem_counts"),
        "q21_flagship": with_(
            chain + [top("stem_counts", where=f"n >= {threshold('stem_counts')}")],
            "SELECT word, score FROM top"),
        "q22_stream_snapshot": with_(
            chain + [top("stem_counts", where=f"n >= {threshold('stem_counts')}"), ITEMS],
            "SELECT text, size FROM items"),
        "q23_merged_cells": with_(documents + sketch(params.EPS), "SELECT r, b, c FROM cells"),
        "q24_document_terms": with_(
            stems + [top("stem_counts", where=f"n >= {threshold('stem_counts')}")],
            "SELECT word, score FROM top"),
        "q26_accepted_with_history": with_(OUTCOMES + [EARLY],
            """SELECT url, ts FROM outcomes, span
               WHERE outcome = 'accepted' AND ts >= middle"""),
        "q27_outcomes_unchecked": with_(OUTCOMES, """
            SELECT event_id, url,
                   CASE WHEN outcome = 'malformed' THEN outcome ELSE 'accepted' END AS outcome
            FROM outcomes"""),
        "q28_stream_restarted": with_(
            chain + [top("stem_counts", where=f"n >= {threshold('stem_counts')}"), ITEMS],
            "SELECT text, size FROM items"),
        "q29_snapshot_after_empty_batch": with_(items, "SELECT text, size FROM items"),
        "q30_late_pages": with_(chain, "SELECT word, n FROM stem_counts"),
        "q32_sketch_candidates": with_(
            documents + sketch(FINE_EPS),
            f"SELECT word, n, est FROM estimates WHERE n >= {threshold('counts')}"),
        "q33_stream_sketch": with_(
            chain + sketch(params.EPS, "stem_counts"), "SELECT r, b, c FROM cells"),
        "q31_stream_with_history": with_(OUTCOMES + [EARLY], """
            SELECT url, ts FROM outcomes, span WHERE outcome = 'accepted' AND ts >= middle"""),
        "q25_document_terms_cms": with_(
            stems + sketch(FINE_EPS, "stem_counts")
            + [top("estimates", "est", f"est >= {threshold('stem_counts')}")],
            "SELECT word, score FROM top"),
    }
