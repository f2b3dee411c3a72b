"""Text of the first paragraph of an HTML element, as built-in Columns."""

from __future__ import annotations

import re
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tags whose start or end closes an open paragraph (HTML Living Standard,
# "in body" insertion mode).
BLOCK_TAGS = (
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog",
    "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h[1-6]", "header", "hgroup", "hr", "html", "li", "listing", "main", "menu", "nav", "ol",
    "p", "plaintext", "pre", "search", "section", "summary", "table", "td", "th", "tr", "ul",
    "xmp",
)

# The rest of a tag: quoted values may hold ">". Possessive, so that Java neither recurses nor
# backtracks; a quote without its partner is a character like others. An unclosed tag, comment or
# script hides what is left of the page.
_REST = r"""(?:[^>"']|"[^"]*"|'[^']*'|["'])*+(?:>|\z)"""
_ATTRIBUTE = r"""[^\s=>/"'<]++(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s>"']++))?"""

_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)"
_PARAGRAPH = (rf"(?is)<p(?:(?=>)|(?=[\s/])){_REST}"
              r".*?(?=</?(?:" + "|".join(BLOCK_TAGS) + r")[\s>/]|\z)")


def _open_tag(container: str) -> str:
    """Pattern of the container's start tag; group 1 is the tag name.

    ``container`` is ``#id`` or a tag name.
    """
    if container.startswith("#"):
        value = re.escape(container[1:])
        return (rf"<((?i:[a-z][a-z0-9]*+))(?:[\s/]++(?!(?i:id)\s*+=){_ATTRIBUTE})*+"
                r"[\s/]++(?i:id)\s*+=\s*+"
                rf"(?:\"{value}\"|'{value}'|{value}(?=[\s>/])){_REST}")
    return rf"(?i)<({re.escape(container)})(?=[\s/>]){_REST}"


def _named_characters() -> list[tuple[str, str]]:
    """Names and characters of the standard library's table, the most used first."""
    common = ["amp", "lt", "gt", "quot", "apos", "nbsp"]
    names = common + [n[:-1] for n in html5 if n.endswith(";") and n[:-1] not in common]
    return [(name, html5[name + ";"]) for name in names]


def _sql_string(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _character(code: str) -> str:
    """SQL for the character with the number ``code``, U+FFFD if there is none."""
    return rf"""CASE WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111
                THEN decode(unhex(lpad(hex({code}), 8, '0')), 'UTF-32') ELSE '\uFFFD' END"""


def _decode_piece() -> str:
    """SQL for a piece ``s`` of the text between two ``&``, the ``i``-th one."""
    named = r"str_to_map({}, '\u0001', '\u0002')".format(_sql_string(
        "\x01".join(f"{name}\x02{value}" for name, value in _named_characters())))
    name = "substring_index(s, ';', 1)"
    rest = "substr(s, instr(s, ';') + 1)"
    decimal = f"try_cast(substr({name}, 2) AS BIGINT)"
    hexadecimal = f"try_cast(conv(substr({name}, 3), 16, 10) AS BIGINT)"
    return rf"""CASE
        WHEN i = 0 THEN s
        WHEN s RLIKE '^#[0-9]+;' THEN {_character(decimal)} || {rest}
        WHEN s RLIKE '^#[xX][0-9a-fA-F]+;' THEN {_character(hexadecimal)} || {rest}
        WHEN s RLIKE '^[A-Za-z][A-Za-z0-9]*;'
        THEN coalesce({named}[{name}] || {rest}, '&' || s)
        ELSE '&' || s END"""


def decode_entities(text: str) -> Column:
    """Decode ``&name;``, ``&#10;`` and ``&#x0A;`` in column ``text`` in one pass, so ``&amp;lt;``
    gives ``&lt;``."""
    return F.expr(f"""CASE WHEN contains({text}, '&')
        THEN array_join(transform(split({text}, '&', -1), (s, i) -> {_decode_piece()}), '')
        ELSE {text} END""")


def without_tags(html: Column) -> Column:
    """Text of inline HTML, not decoded: a line break is a space, other tags vanish."""
    broken = F.regexp_replace(html, rf"(?i)<br(?=[\s/>]){_REST}", " ")
    return F.regexp_replace(broken, rf"<[/!]?[a-zA-Z]{_REST}", "")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\f\r]+", " "))


def first_paragraph(df: DataFrame, container: str, html: str = "html",
                    out: str = "description") -> DataFrame:
    """Replace ``html`` by ``out``: text of the first ``<p>`` inside the first ``container``.

    A row without one is dropped; a paragraph without text gives ``''``. An open paragraph
    ends at its end tag, at the next block tag or at the container's end, which is found by
    counting nested elements of the same name.
    """
    start = _open_tag(container)
    keep = [c for c in df.columns if c != html]
    df = df.withColumn("_body", F.regexp_replace(html, _HIDDEN, ""))
    df = df.withColumn("_tag", F.lower(F.regexp_extract("_body", start, 1)))
    df = df.withColumn("_tail", F.when(
        F.col("_tag") != "", F.regexp_extract("_body", rf"{start}((?s:.*))", 2)))
    # The pieces between tags of the same name, up to the end tag that closes the container. The
    # pattern is constant where the name is.
    tag = "_tag" if container.startswith("#") else _sql_string(container.lower())
    same = f"'(?i)<(/?)' || {tag} || {_sql_string(rf'(?=[\s>/]){_REST}')}"
    df = df.withColumn("_inner", F.expr(rf"""array_join(
        slice(split(_tail, {same}, -1), 1,
              aggregate(
                  regexp_extract_all(_tail, {same}, 1),
                  struct(1 AS depth, 1 AS pieces),
                  (a, m) -> CASE
                      WHEN a.depth = 0 THEN a
                      WHEN m = '' THEN struct(a.depth + 1 AS depth, a.pieces + 1 AS pieces)
                      WHEN a.depth = 1 THEN struct(0 AS depth, a.pieces AS pieces)
                      ELSE struct(a.depth - 1 AS depth, a.pieces + 1 AS pieces) END,
                  a -> a.pieces)),
        '<' || _tag || '>')"""))
    df = df.withColumn("_paragraph", F.regexp_extract("_inner", _PARAGRAPH, 0))
    df = df.withColumn("_text", without_tags(F.col("_paragraph")))

    # Zero or one row per page by a generator, not by a filter: a filter would be pushed below
    # the projections and repeat all of their work.
    return df.select(*keep, F.explode(
        F.when(F.col("_paragraph") != "", F.array(collapsed(decode_entities("_text"))))).alias(out))
