"""Personal data in texts, plain and disguised.

Plain identifiers are found by fixed patterns. Disguised ones (look-alike letters, full-width and
other digits, spelled digits, "at" and "dot" written out) are first normalised by transducers that
record which source characters every normalised piece stands for; identifiers found in the
normalised text are mapped back to spans of the source.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from termtide.llm.common import freeing, parts, replaced

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Cyrillic and Greek letters that look like Latin ones, each pair in a row.
LOOK_ALIKES = (
    "аa вb еe кk мm нh оo рp сc тt уy хx іi јj ѕs һh ԁd ԛq ԝw "
    "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЈJ ЅS "
    "αa οo νv ρp υu ιi κk "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX")
# The digits from zero in English, German, French and Spanish.
DIGIT_WORDS = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve")
_DIGITS = {word: str(i) for words in DIGIT_WORDS for i, word in enumerate(words.split())}
# Runs of fewer digits, spelled or written, are ordinary prose.
MIN_SPELLED = 4

_WORDS = "|".join(sorted(_DIGITS, key=len, reverse=True))
_ITEM = rf"(?:{_WORDS}|[0-9]++)"
_SPELLED = re.compile(
    rf"(?<!\w)(?:plus[ -])?{_ITEM}(?:(?:[ ,-]{{1,2}}|[ ]?(?:dot|point|punkt|punto|\.)[ ]?){_ITEM})"
    rf"+(?!\w)", re.I)
_SPELLED_PART = re.compile(rf"plus(?=[ -])|dot|point|punkt|punto|\.|{_ITEM}", re.I)
_AT = r"(?:\s?[(\[{<]\s?(?:at|@)\s?[)\]}>]\s?|\s(?:at|@)\s|@)"
_DOT = r"(?:\s?[(\[{<]\s?(?:dot|\.)\s?[)\]}>]\s?|\sdot\s|\.)"
_ADDRESS = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]++(?:{_DOT}[A-Za-z0-9_%+-]++){{0,4}}{_AT}"
    rf"[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++", re.I)
_ADDRESS_PART = re.compile(rf"(?P<at>{_AT})|(?P<dot>{_DOT})", re.I)
# Words before a "dot" that is one in prose, as in "at the dot on the map".
_PROSE = frozenset("the a an this that these those each every one its his her our your my their".split())
# Ends of addresses in which only the "at" is disguised, by a bare word.
_ENDS = frozenset("com org net edu gov info biz io co us uk de fr es eu ch nl be".split())
# A written-out or bracketed "at"; texts without it skip the pattern for addresses.
_HAS_AT = re.compile(r"[(\[{<]\s?(?:at|@)\s?[)\]}>]|\s@\s|\sat\s", re.I)
_HAS_DOT = re.compile(r"[(\[{<]\s?(?:dot|\.)\s?[)\]}>]|\sdot\s", re.I)


class _Folds(dict):
    """Code point to what it looks like in ASCII: one character, or nothing if it is invisible."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        if code < 0x80:
            folded = char
        elif unicodedata.category(char) == "Cf":
            folded = ""
        elif unicodedata.decimal(char, None) is not None:
            folded = str(unicodedata.decimal(char))
        else:
            folded = unicodedata.normalize("NFKC", char)
            folded = folded if len(folded) == 1 and folded.isascii() else char
        self[code] = folded
        return folded


_FOLDS = _Folds({ord(pair[0]): pair[1] for pair in LOOK_ALIKES.split()})
# What may fold: of the Latin letters and signs, which are frequent, only those that do.
_UNUSUAL = re.compile("[{}\u0250-\U0010FFFF]".format("".join(
    re.escape(c) for c in map(chr, range(0x80, 0x250)) if _FOLDS[ord(c)] != c)))


class Normalised:
    """A text with the source span of every piece that a transducer rewrote."""

    def __init__(self, text: str):
        self.text = text
        self.starts, self.sources, self.ends, self.same = [0], [0], [len(text)], [True]

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans of the current text; ``edits`` are in order and apart."""
        if not edits:
            return
        out, starts, sources, ends, same, length, at = [], [], [], [], [], 0, 0

        def keep(lo: int, hi: int) -> None:
            nonlocal length
            while lo < hi:
                i = bisect.bisect_right(self.starts, lo) - 1
                stop = min(hi, self.starts[i + 1] if i + 1 < len(self.starts) else len(self.text))
                shift = lo - self.starts[i] if self.same[i] else 0
                starts.append(length)
                sources.append(self.sources[i] + shift)
                ends.append(sources[-1] + stop - lo if self.same[i] else self.ends[i])
                same.append(self.same[i])
                length += stop - lo
                out.append(self.text[lo:stop])
                lo = stop

        for lo, hi, new in edits:
            keep(at, lo)
            if new:
                first, last = self.source(lo, hi)
                starts.append(length)
                sources.append(first)
                ends.append(last)
                same.append(False)
                out.append(new)
                length += len(new)
            at = hi
        keep(at, len(self.text))
        self.text = "".join(out)
        self.starts, self.sources, self.ends, self.same = starts, sources, ends, same

    def source(self, lo: int, hi: int) -> tuple[int, int]:
        """The span of the source that the span of the current text stands for."""
        i = bisect.bisect_right(self.starts, lo) - 1
        j = bisect.bisect_right(self.starts, hi - 1) - 1
        first = self.sources[i] + (lo - self.starts[i] if self.same[i] else 0)
        last = self.sources[j] + hi - self.starts[j] if self.same[j] else self.ends[j]
        return first, last

    def rewritten(self, lo: int, hi: int) -> bool:
        """Whether the span holds anything that a transducer changed."""
        first, last = self.source(lo, hi)
        i = bisect.bisect_right(self.starts, lo) - 1
        j = bisect.bisect_right(self.starts, hi - 1) - 1
        return last - first != hi - lo or not all(self.same[i:j + 1])


def fold_edits(text: str) -> list[tuple[int, int, str]]:
    """Look-alikes, full-width forms, digits of other scripts and invisible characters."""
    return [(m.start(), m.end(), new) for m in _UNUSUAL.finditer(text)
            if (new := _FOLDS[ord(m[0])]) != m[0]]


def spelled_edits(text: str) -> list[tuple[int, int, str]]:
    """Runs of spelled digits, written ones among them, with their separators, as digits."""
    edits = []
    for m in _SPELLED.finditer(text):
        parts = [(p.start(), p.end(), p[0].lower())
                 for p in _SPELLED_PART.finditer(text, m.start(), m.end())]
        digits = sum(1 if w in _DIGITS else len(w) * w.isdigit() for _, _, w in parts)
        if digits < MIN_SPELLED or not any(w.isalpha() for _, _, w in parts):
            continue
        for k, (lo, hi, word) in enumerate(parts):
            end = parts[k + 1][0] if k + 1 < len(parts) else hi
            new = word if word.isdigit() else _DIGITS.get(word) or (
                "+" if word == "plus" else ".")
            if new != word:
                edits.append((lo, hi, new))
            if end > hi:
                edits.append((hi, end, ""))
    return edits


def _is_address(text: str, m: re.Match, parts: list[re.Match], at: int) -> bool:
    """Whether a match with a bare "at" is an address rather than prose."""
    end = text[parts[-1].end():m.end()].lower()
    if any(len(p[0]) > 1 for p in parts[at + 1:]):
        first = text[parts[at].end():parts[at + 1].start()].lower()
        return len(end) > 1 and end.isalpha() and first not in _PROSE
    return not text[m.start():parts[at].start()].isalpha() and end in _ENDS


def address_edits(text: str) -> list[tuple[int, int, str]]:
    """"at" and "dot" in what is an address once they are signs. A bare "at" needs beside it a
    disguised dot and an end of letters, or else a name that is no plain word and a common end."""
    if not (_HAS_AT.search(text) or "@" in text and _HAS_DOT.search(text)):
        return []
    edits = []
    for m in _ADDRESS.finditer(text):
        parts = list(_ADDRESS_PART.finditer(text, m.start(), m.end()))
        at = next(i for i, p in enumerate(parts) if p.lastgroup == "at")
        if parts[at][0].strip().lower() == "at" and not _is_address(text, m, parts, at):
            continue
        edits += [(p.start(), p.end(), "@" if p.lastgroup == "at" else ".")
                  for p in parts if len(p[0]) > 1]
    return edits


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    at, pos = text.find("@"), 0
    while at >= 0:
        start = at
        while start > pos and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            pos = m.end()
            yield "email", start, pos
        at = text.find("@", max(pos, at + 1))


def plain_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns: leftmost, apart within a kind; by kind, then start."""
    spans = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
            spans.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            spans.append(("phone", m.start(), m.end()))
    return spans


def find(text: str) -> tuple[list[Span], list[Span]]:
    """(plain spans, all spans) of a text; offsets in code points, ends exclusive."""
    plain = plain_spans(text)
    normal = Normalised(text)
    for transducer in (fold_edits, spelled_edits, address_edits):
        normal.rewrite(transducer(normal.text))
    if normal.text == text:
        return plain, plain
    spans = list(plain)
    for kind, lo, hi in plain_spans(normal.text):
        if normal.rewritten(lo, hi):
            first, last = normal.source(lo, hi)
            # A plain piece of a disguised identifier does not stand for the whole of it.
            if not any(k == kind and s <= first and last <= e for k, s, e in plain):
                spans.append((kind, first, last))
    return plain, sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def redact(text: str) -> str:
    """The text with every span replaced by its kind in angle brackets; spans that overlap
    become one, named by the first."""
    out, at = [], 0
    for kind, lo, hi in sorted(find(text)[1], key=lambda s: (s[1], -s[2])):
        if lo >= at:
            out.append(text[at:lo])
            out.append(f"<{kind.upper()}>")
        at = max(at, hi)
    return "".join(out) + text[at:]


_SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType())]))


def spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Every row of ``df`` with ``plain_spans`` and ``all_spans``: arrays of kind, start, end.

    Null and empty texts have empty arrays. The two columns must not exist yet.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    names = ["plain_spans", "all_spans"]
    if set(names) & set(df.columns):
        raise ValueError("the input already has plain_spans or all_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = [find(t) if t else ([], []) for t in batch.column(text).to_pylist()]
            arrays = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in row[i]]
                                for row in found], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays],
                                             names=[*batch.schema.names, *names])

    return df.mapInArrow(freeing(run), T.StructType(
        [*df.schema.fields, *(T.StructField(name, _SPANS) for name in names)]))


def redacted(df: DataFrame, text: str = "text", n_chars: str | None = None) -> DataFrame:
    """``df`` with personal data in ``text`` replaced by <EMAIL>, <IP>, <CARD> or <PHONE>; nulls
    stay. ``n_chars`` names a column that gets the new length (null for a null text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = [redact(t) if t else t for t in batch.column(text).to_pylist()]
            batch = replaced(batch, text, pa.array(texts, pa.string()))
            if n_chars:
                lengths = [None if t is None else len(t) for t in texts]
                batch = replaced(batch, n_chars, pa.array(lengths, pa.int64()))
            yield batch

    return df.mapInArrow(freeing(run), df.schema)
