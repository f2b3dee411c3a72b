"""I-Match fingerprints: hashes of a document's informative terms in random parts of a lexicon.

The lexicon holds the terms whose inverse document frequency lies in a band: neither so frequent
that all documents have them nor so rare that they identify noise. A document's distinct terms in
the lexicon are sorted, and those in each of several random subsets of the lexicon are hashed. The
subsets come in several rates, so that long and short documents both have subsets with few of their
terms, which an edit elsewhere leaves alone.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termtide.llm.common import ascii_lower, written

# The band, as shares of the documents that have the term: IDF from ln 100 to ln 1000. At most
# (distinct terms per document) / BAND[0] terms can be in it, whatever the corpus.
BAND = (0.001, 0.01)
# (cells, subsets): the lexicon is cut into so many random cells, the first of which are subsets. All
# cells of the first level are, so that every term is in a subset and only a text without
# known terms is without any.
LEVELS = ((8, 8), (32, 16), (128, 16), (1024, 16))
SUBSETS = sum(subsets for _, subsets in LEVELS)
WIDTH = 8
NONE = "-" * WIDTH
# Subsets that a level must have terms in for its share to count in full.
LEAST = 4
# A larger lexicon is joined by shuffle; a smaller one is a hash table of so many places.
BROADCAST_TERMS = 2_000_000
PLACES = 1 << 16
# Documents per run of ascending ids, which one task orders; and the most runs there are.
RUN, MOST_RUNS = 500, 4096


def terms(text: Column) -> Column:
    """Distinct words, A to Z in lower case; the empty string stands for a text without words."""
    every = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.array_distinct(F.transform(every, ascii_lower))


def lexicon(df: DataFrame, text: str = "text") -> tuple[DataFrame, bool]:
    """(term_hash of the terms in the band over all rows of ``df``, whether it is small enough for every task).

    Counts are by 64-bit hash of the term, summed in the tasks before the shuffle. The empty string
    belongs to it, so that every document has a row in the join with it.
    """
    total = df.count()
    counted = df.select(F.explode(terms(F.col(text))).alias("term")).where("term <> ''").groupBy(
        F.xxhash64("term").alias("term_hash")).agg(F.count("*").alias("df"))
    low, high = BAND[0] * total, max(1.0, BAND[1] * total)
    band = counted.where(F.col("df").between(low, high)).select("term_hash")
    empty = df.sparkSession.range(1).select(F.xxhash64(F.lit("")).alias("term_hash"))
    found = written(band.where(F.col("term_hash") != F.xxhash64(F.lit(""))).union(empty), "lexicon")
    return found, found.count() <= BROADCAST_TERMS


def cells(term: Column) -> list[Column]:
    """The cell that the term falls in, for every level."""
    digest = F.md5(term.cast("binary"))
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") % n
            for i, (n, _) in enumerate(LEVELS)]


def subset_texts(own: list[Column]) -> Column:
    """For every subset its terms, joined. ``own`` has for every level the sorted (cell, term) of
    the terms in a subset."""
    def joined(level: Column, i: Column) -> Column:
        return F.array_join(F.transform(
            F.filter(level, lambda t: t["cell"] == i), lambda t: t["term"]), " ")

    def texts(level: Column, subsets: int) -> Column:
        # Two uses of the column keep Spark from making it anew for every subset.
        every = F.transform(F.sequence(F.lit(0), F.lit(subsets - 1)), lambda i: joined(level, i))
        return F.when(F.size(level) == 0, F.array_repeat(F.lit(""), subsets)).otherwise(every)

    return F.concat(*(texts(level, n) for level, (_, n) in zip(own, LEVELS, strict=True)))


def fingerprint_of(texts: Column, known: Column, text_hash: Column) -> Column:
    """Fingerprint from the texts of the subsets. Without ``known`` terms in the lexicon, a
    text's own hash takes its place."""
    parts = F.transform(texts, lambda t: F.when(t == "", NONE).otherwise(
        F.left(F.md5(t.cast("binary")), F.lit(WIDTH))))
    return F.when(known == 0, F.concat(F.lit("="), text_hash)).otherwise(F.array_join(parts, ""))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints; else the best level's share of equal hashes among the subsets in
    which either text has terms, counting at least ``LEAST`` of them; 0 beside a text's own hash."""
    shares, first = [], 0
    for _, subsets in LEVELS:
        at = F.sequence(F.lit(first), F.lit(first + subsets - 1))

        def part(text: Column, i: Column) -> Column:
            return F.substring(text, i * WIDTH + 1, F.lit(WIDTH))

        used = F.filter(at, lambda i: (part(a, i) != NONE) | (part(b, i) != NONE))
        equal = F.filter(used, lambda i: part(a, i) == part(b, i))
        shares.append(F.size(equal) / F.greatest(F.size(used), F.lit(LEAST)))
        first += subsets
    whole = a.startswith("=") | b.startswith("=")
    return F.when(a == b, 1.0).when(whole, 0.0).otherwise(F.greatest(*shares)).cast("double")


def _membership(lexicon_terms: DataFrame):
    """A function from a term to whether it is in the lexicon: a constant hash table, whose size
    is that of the lexicon, at most ``BROADCAST_TERMS``."""
    places: list[list[int]] = [[] for _ in range(PLACES)]
    for value in lexicon_terms.toArrow().column(0).to_pylist():
        places[value % PLACES].append(value)
    # Made a constant by the optimizer, once.
    table = F.from_json(F.lit(json.dumps(places, separators=(",", ":"))), "array<array<bigint>>")

    def contains(term: Column) -> Column:
        value = F.xxhash64(term)
        return F.array_contains(F.get(table, F.pmod(value, F.lit(PLACES)).cast("int")), value)

    return contains


def _in_place(rows: DataFrame, keys: list[str], texts: list[str],
              lexicon_terms: DataFrame) -> DataFrame:
    """``fingerprints`` without moving rows, for a lexicon that fits in every task."""
    contains = _membership(lexicon_terms)
    hashes = [F.md5(F.col(name).cast("binary")).alias(f"hash_{i}") for i, name in enumerate(texts)]
    kept = rows.select(*keys, *hashes, *(
        F.filter(terms(F.col(name)), lambda t: (t != "") & contains(t)).alias(f"kept_{i}")
        for i, name in enumerate(texts)))

    def marked(i: int) -> Column:
        return F.transform(f"kept_{i}", lambda t: F.struct(
            t.alias("term"), *(c.alias(f"cell_{k}") for k, c in enumerate(cells(t)))))

    every = kept.select("*", *(marked(i).alias(f"marked_{i}") for i in range(len(texts))))

    def level(i: int, k: int) -> Column:
        chosen = F.filter(f"marked_{i}", lambda t: t[f"cell_{k}"] < LEVELS[k][1])
        return F.sort_array(F.transform(chosen, lambda t: F.struct(
            t[f"cell_{k}"].alias("cell"), t["term"].alias("term"))))

    levels = range(len(LEVELS))
    split = every.select("*", *(
        level(i, k).alias(f"own_{i}_{k}") for i in range(len(texts)) for k in levels))
    return split.select(*keys, *(
        fingerprint_of(subset_texts([F.col(f"own_{i}_{k}") for k in levels]),
                       F.size(f"kept_{i}"), F.col(f"hash_{i}")).alias(name)
        for i, name in enumerate(texts)))


def fingerprints(rows: DataFrame, keys: list[str], texts: list[str], found: tuple[DataFrame, bool],
                 ) -> DataFrame:
    """keys, and for every column of ``texts`` its fingerprint under the same name.

    ``keys`` identify a row. Null texts count as empty. With a small lexicon rows stay where they
    are; otherwise their terms are joined with it and gathered again.
    """
    rows = rows.withColumns({name: F.coalesce(name, F.lit("")) for name in texts})
    lexicon_terms, small = found
    if small:
        return _in_place(rows, keys, texts, lexicon_terms)

    def numbered(i: int, name: str) -> Column:
        return F.transform(terms(F.col(name)), lambda t: F.struct(
            F.lit(i).alias("v"), t.alias("term")))

    # The empty string is in the lexicon, so a row without terms from it survives the join.
    each = F.concat(*(numbered(i, name) for i, name in enumerate(texts)),
                    F.array(F.struct(F.lit(0).alias("v"), F.lit("").alias("term"))))
    hashes = [F.md5(F.coalesce(F.col(name), F.lit("")).cast("binary")).alias(f"hash_{i}")
              for i, name in enumerate(texts)]
    exploded = rows.select(*keys, *hashes, F.explode(each).alias("t")).select(
        *keys, *(f"hash_{i}" for i in range(len(texts))), "t.v", "t.term",
        F.xxhash64("t.term").alias("term_hash"))
    kept = exploded.join(lexicon_terms, "term_hash")
    placed = kept.select(
        *keys, *(f"hash_{i}" for i in range(len(texts))), "v", "term",
        *(c.alias(f"cell_{level}") for level, c in enumerate(cells(F.col("term")))))

    def gather(i: int) -> list[Column]:
        is_own = (F.col("v") == i) & (F.col("term") != "")
        lists = [
            F.sort_array(F.collect_list(F.when(
                is_own & (F.col(f"cell_{level}") < subsets),
                F.struct(F.col(f"cell_{level}").alias("cell"), "term")))).alias(f"own_{i}_{level}")
            for level, (_, subsets) in enumerate(LEVELS)]
        return [*lists, F.count_if(is_own).alias(f"known_{i}")]

    gathered = placed.groupBy(*keys, *(f"hash_{i}" for i in range(len(texts)))).agg(
        *(c for i in range(len(texts)) for c in gather(i)))
    return gathered.select(*keys, *(
        fingerprint_of(subset_texts([F.col(f"own_{i}_{level}") for level in range(len(LEVELS))]),
                       F.col(f"known_{i}"), F.col(f"hash_{i}")).alias(name)
        for i, name in enumerate(texts)))


def _run_of(doc_id: Column, splits: list[int]) -> Column:
    """Number of ``splits`` below the id, found in two steps; 0 for null."""
    width = max(1, int(len(splits) ** 0.5))
    parts = [splits[i:i + width] for i in range(0, len(splits), width)]
    if not parts:
        return F.lit(0)

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda s: s < doc_id))

    heads = F.array(*(F.lit(p[0]).cast("long") for p in parts))
    table = F.array(*(F.array(*(F.lit(s).cast("long") for s in p)) for p in parts))
    part = F.greatest(below(heads) - 1, F.lit(0))
    return part * width + below(F.get(table, part))


def in_runs(df: DataFrame) -> DataFrame:
    """run, guest and the columns of ``df`` (doc_id, others): rows dealt to runs of ascending ids.

    Ids are cut at quantiles into runs, and the rows of the first id of every run are also, as
    guests, in the run before (of the first run: in the last). Nulls come first.
    """
    rows = df.count()
    runs = max(1, min(MOST_RUNS, rows // RUN))
    splits: list[int] = []
    if runs > 1:
        found = df.agg(F.percentile_approx(
            "doc_id", [i / runs for i in range(1, runs)], 20 * runs)).first()[0]
        splits = sorted(set(found or []))
    run = _run_of(F.col("doc_id"), splits)
    first = df.groupBy(run.alias("run")).agg(
        # A null id comes first, and min() passes over it.
        F.min("doc_id").alias("id"), F.max(F.col("doc_id").isNull()).alias("null")).collect()
    starts = sorted((r["run"], None if r["null"] else r["id"]) for r in first) if first else []
    first_id = F.lit(None).cast("long")
    before = F.lit(None).cast("int")
    if starts:
        number = {r: i for i, (r, _) in enumerate(starts)}
        size = max(number) + 1
        ids, previous = [None] * size, [None] * size
        for i, (r, start) in enumerate(starts):
            ids[r], previous[r] = start, starts[i - 1][0]
        first_id = F.get(F.array(*(F.lit(x).cast("long") for x in ids)), run)
        before = F.get(F.array(*(F.lit(x).cast("int") for x in previous)), run)
    own = F.struct(run.alias("run"), F.lit(False).alias("guest"))
    guest = F.struct(before.alias("run"), F.lit(True).alias("guest"))
    return df.select("*", F.explode(
        F.when(F.col("doc_id").eqNullSafe(first_id), F.array(own, guest))
        .otherwise(F.array(own))).alias("r")).select("r.run", "r.guest", *df.columns)


def with_next(df: DataFrame) -> DataFrame:
    """run, at, guest, doc_id, text, next_text: every document with the one after it by doc_id
    (after the last: the first). Nulls come first, repeated ids are ordered by text.

    A task orders the documents of a run, and the first of every run is also the last, as a
    guest, of the run before. Text is shuffled once.
    """
    dealt = in_runs(df.select("doc_id", "text"))
    order = Window.partitionBy("run").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.select(
        "*", F.row_number().over(order).alias("at"), F.lead("text").over(order).alias("next_text"))


def compare_edited(df: DataFrame) -> DataFrame:
    """Fingerprints of every row of ``df`` (doc_id, text) and of its edited text, and how alike
    they are; columns as in the query. Null texts count as empty, repeated rows each have a row,
    other columns of ``df`` do not matter."""
    docs = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = lexicon(docs)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), F.length("text") - half),
                      F.left(F.coalesce("next_text", F.lit("")), half))
    rows = with_next(docs).select(
        "run", "at", "guest", "doc_id", F.length("text").cast("long").alias("n_chars"),
        "text", edited.alias("edited")).withColumn("edited_sha256", F.sha2("edited", 256))
    keys = ["run", "at", "guest", "doc_id", "n_chars", "edited_sha256"]
    prints = fingerprints(rows, keys, ["text", "edited"], found).select(
        *keys, F.col("text").alias("fingerprint"), F.col("edited").alias("edited_fingerprint"))
    after = F.lead("fingerprint").over(Window.partitionBy("run").orderBy("at"))
    return prints.withColumn("next_fingerprint", after).where("NOT guest").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
