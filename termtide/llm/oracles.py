"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from termtide.llm import mixing

# A regular expression for words, as DuckDB's engine reads it.
WORD = r"[^\x20\x09-\x0D]+"


def source_mix(documents: str = "documents") -> str:
    """Common table expressions up to ``mixed``: doc_id, source, text, lang, n_chars, size,
    source_size, target, repeats."""
    weights = ", ".join(map(str, mixing.WEIGHTS))
    return rf"""
    sized AS (
        SELECT *, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
               CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':'
                                       || coalesce(text, '')), 1, 6) AS BIGINT) AS position
        FROM {documents}),
    sums AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
    weighted AS (
        SELECT *, list_value({weights})[
            1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(mixing.WEIGHTS)}]
            AS weight
        FROM sums),
    stepped AS (
        SELECT *, source_size / weight AS ratio, {mixing.MAX_REPEATS} * source_size AS cap,
               sum(source_size) OVER () - coalesce(sum({mixing.MAX_REPEATS} * source_size)
                   OVER w, 0) AS unspent,
               sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS left_weight
        FROM weighted
        WINDOW w AS (ORDER BY source_size / weight, source ASC NULLS LAST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    level AS (
        SELECT unspent AS level_unspent, left_weight AS level_weight FROM stepped
        WHERE NOT unspent * weight > cap * left_weight
        ORDER BY ratio, unspent, left_weight LIMIT 1),
    goals AS (
        SELECT source, source_size,
               CASE WHEN unspent * weight > cap * left_weight OR level_weight IS NULL
                    THEN CAST(cap AS DOUBLE)
                    ELSE weight * (CAST(level_unspent AS DOUBLE) / CAST(level_weight AS DOUBLE))
               END AS target
        FROM stepped LEFT JOIN level ON true),
    budgets AS (
        SELECT *, CAST(floor(target / greatest(source_size, 1)) AS BIGINT) AS whole,
               target - CAST(floor(target / greatest(source_size, 1)) AS BIGINT) * source_size
                   AS budget
        FROM goals),
    ranked AS (
        SELECT s.position, b.source, b.budget,
               sum(sum(s.size)) OVER (PARTITION BY b.source ORDER BY s.position) AS upto,
               sum(s.size) AS words
        FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
        GROUP BY b.source, b.budget, s.position),
    cuts AS (
        SELECT source, min(position) AS cut,
               arg_min(CASE WHEN upto - budget <= budget - (upto - words) THEN 1 ELSE 0 END,
                       position) AS with_cut
        FROM ranked WHERE upto >= budget GROUP BY source),
    mixed AS (
        SELECT s.*, b.source_size, b.target,
               CASE WHEN s.size = 0 THEN 0 ELSE least({mixing.MAX_REPEATS}, b.whole
                    + CASE WHEN s.position < c.cut + c.with_cut THEN 1 ELSE 0 END) END AS repeats
        FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
        LEFT JOIN cuts c ON s.source IS NOT DISTINCT FROM c.source)"""


SOURCE_MIX = f"""WITH {source_mix()}
SELECT doc_id, size, source_size, target, CAST(size * repeats AS BIGINT) AS taken FROM mixed"""


def edited_fingerprints(documents: str = "documents") -> str:
    """The I-Match fingerprints of texts and edited texts."""
    from termtide.llm import imatch

    def words(text: str) -> str:
        lower = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return f"list_distinct(regexp_extract_all({lower}, '{WORD}'))"

    bits, first = [], 0
    for i, (cells, subsets) in enumerate(imatch.LEVELS):
        cell = f"(CAST('0x' || substr(md5(term), {1 + 8 * i}, 8) AS BIGINT) % {cells})"
        bits.append(f"SELECT v, k, term, {first} + {cell} AS subset FROM banded "
                    f"WHERE {cell} < {subsets}")
        first += subsets

    def part(name: str) -> str:
        return f"substr({name}, i * {imatch.WIDTH} + 1, {imatch.WIDTH})"

    def likeness(a: str, b: str) -> str:
        shares, first = [], 0
        for _, subsets in imatch.LEVELS:
            used = (f"list_filter(range({first}, {first + subsets}), lambda i: "
                    f"{part(a)} <> '{imatch.NONE}' OR {part(b)} <> '{imatch.NONE}')")
            shares.append(f"len(list_filter({used}, lambda i: {part(a)} = {part(b)})) "
                          f"/ greatest(len({used}), {imatch.LEAST})")
            first += subsets
        return (f"CASE WHEN {a} = {b} THEN 1.0 WHEN {a} LIKE '=%' OR {b} LIKE '=%' THEN 0.0 "
                f"ELSE CAST(greatest({', '.join(shares)}) AS DOUBLE) END")

    low, high = imatch.BAND
    return f"""
    WITH docs AS (
        SELECT doc_id, coalesce(text, '') AS text,
               row_number() OVER (ORDER BY doc_id NULLS FIRST, coalesce(text, '')) AS k
        FROM {documents}),
    nexts AS (
        SELECT *, coalesce(lead(text) OVER (ORDER BY k), first_value(text) OVER (ORDER BY k))
               AS next_text
        FROM docs),
    texts AS (
        SELECT k, 0 AS v, text FROM nexts UNION ALL
        SELECT k, 1, left(text, length(text) - length(text) // 2)
                     || left(next_text, length(text) // 2) FROM nexts),
    each AS (SELECT v, k, unnest({words('text')}) AS term FROM texts),
    band AS (
        SELECT term FROM each WHERE v = 0 GROUP BY term
        HAVING count(*) BETWEEN {low} * (SELECT count(*) FROM docs)
                            AND greatest(1.0, {high} * (SELECT count(*) FROM docs))),
    banded AS (SELECT v, k, term FROM each SEMI JOIN band USING (term)),
    cells AS ({' UNION ALL '.join(bits)}),
    hashes AS (
        SELECT v, k, subset, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, {imatch.WIDTH})
               AS part
        FROM cells GROUP BY v, k, subset),
    by_text AS (
        SELECT v, k, map(list(subset), list(part)) AS parts FROM hashes GROUP BY v, k),
    prints AS (
        SELECT t.k, t.v, t.text,
               CASE WHEN EXISTS (SELECT 1 FROM banded b WHERE b.k = t.k AND b.v = t.v)
                    THEN list_aggregate(list_transform(range(0, {imatch.SUBSETS}), lambda i:
                         coalesce(parts[i], '{imatch.NONE}')), 'string_agg', '')
                    ELSE '=' || md5(t.text) END AS fp
        FROM texts t LEFT JOIN by_text p ON p.k = t.k AND p.v = t.v),
    compared AS (
        SELECT d.doc_id, d.k, CAST(length(d.text) AS BIGINT) AS n_chars,
               sha256(e.text) AS edited_sha256, f.fp AS fingerprint, e.fp AS edited_fingerprint,
               coalesce(lead(f.fp) OVER (ORDER BY d.k), first_value(f.fp) OVER (ORDER BY d.k))
               AS next_fingerprint
        FROM docs d JOIN prints f ON f.k = d.k AND f.v = 0 JOIN prints e ON e.k = d.k AND e.v = 1)
    SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
           {likeness('fingerprint', 'edited_fingerprint')} AS near_edited,
           {likeness('fingerprint', 'next_fingerprint')} AS near_next
    FROM compared"""


TOP_K = """
WITH scaled AS MATERIALIZED (
    SELECT row_number() OVER () AS place, vec_id,
           list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
    SELECT q.place, q.vec_id AS query_id, c.vec_id,
           CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM scaled q JOIN scaled c ON q.vec_id % 100 = 0 AND c.place <> q.place),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS rank
    FROM scores)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10"""
