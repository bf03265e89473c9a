"""DuckDB SQL for the numbered queries that SQL can express."""


def _vector_codes() -> str:
    """Product codes by plain comparison with every entry: assignment and update are the same text for each round."""

    def assigned(round_: int) -> str:
        return f"""
        d{round_} AS MATERIALIZED (SELECT p.vec_id, p.part, min({{'d': list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': c.entry}}) AS m
            FROM p JOIN c{round_} c ON p.part = c.part GROUP BY ALL)"""

    def updated(round_: int) -> str:
        return f"""
        s{round_} AS (SELECT d.part, d.m.e AS entry, unnest(range(1, len(p.v) + 1)) AS place, unnest(p.v) AS x FROM d{round_} d JOIN p ON d.vec_id = p.vec_id AND d.part = p.part),
        m{round_} AS (SELECT part, entry, place, sum(x) AS s, count(*) AS n FROM s{round_} GROUP BY ALL),
        f{round_} AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS v FROM m{round_} GROUP BY ALL),
        c{round_ + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(f.v, c.v) AS v FROM c{round_} c LEFT JOIN f{round_} f ON c.part = f.part AND c.entry = f.entry)"""

    return f"""
        WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS MATERIALIZED (SELECT vec_id, r.part, v[r.part * (len(v) // 16) + 1 : (r.part + 1) * (len(v) // 16)] AS v FROM k, range(16) r(part)),
        first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT 64),
        c0 AS MATERIALIZED (SELECT p.part, first.entry, p.v FROM p JOIN first ON p.vec_id = first.vec_id),
        {assigned(0)}, {updated(0)}, {assigned(1)}, {updated(1)}, {assigned(2)},
        coded AS (SELECT vec_id, string_agg(lpad(lower(to_hex(m.e)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM d2 GROUP BY vec_id),
        books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2)
        SELECT coded.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN k ON coded.vec_id = k.vec_id, books"""



def _spelling() -> str:
    """Spelling variants: CRC-32 bit by bit, pairs over words with one letter taken out, edit distance with one byte for each letter."""
    wide, upper = "".join(map(chr, range(0xC0, 0x100))), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    bytes_ = "".join(map(chr, range(33, 97))).replace("'", "''")
    narrow = lambda w: f"translate({w}, '{wide}', '{bytes_}')"
    return f"""
        WITH RECURSIVE runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z{wide[0]}-{wide[-1]}]+')), '{upper}', '{upper.lower()}') AS run FROM documents),
        counted AS MATERIALIZED (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS marked, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
        bits AS (SELECT run, n, flatten(list_transform(string_split(marked, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c), -1, -1, -1, -1, -1, -1, -1, -1]
            ELSE [195, -1, -1, -1, -1, -1, -1, -1, -1, ord(c) - 64, -1, -1, -1, -1, -1, -1, -1, -1] END)) AS b FROM counted),
        hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, CAST(b AS BIGINT[])), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) AS h FROM bits),
        w AS MATERIALIZED (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
            FROM hashed GROUP BY 1 HAVING sum(n) >= 5 AND length(word) >= 6),
        less AS MATERIALIZED (SELECT word, n, unnest(list_distinct(list_append(list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1)), word))) AS piece FROM w),
        pairs AS MATERIALIZED (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.piece = b.piece AND a.word <> b.word WHERE levenshtein({narrow("a.word")}, {narrow("b.word")}) = 1),
        near AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM pairs GROUP BY word),
        f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n FROM w LEFT JOIN near ON w.word = near.word),
        up(word, root, depth) AS (SELECT word, word, 0 FROM f UNION ALL SELECT up.word, f.form, depth + 1 FROM up JOIN f ON up.root = f.word WHERE f.form IS NOT NULL),
        ends AS (SELECT word, arg_max(root, depth) AS root FROM up GROUP BY word)
        SELECT f.word, form, root, n, n_near, form_n FROM f JOIN ends ON f.word = ends.word"""


ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(coalesce(text, '')) AS h FROM documents),
        g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256
        FROM d JOIN g ON d.h = g.h""",
    # 20 bits, five hexadecimal digits, are four letters of base 32
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
        SELECT p.page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes,
            list_aggregate(list_transform(range(8), lambda j: list_aggregate(list_transform(range(4), lambda k:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (CAST('0x' || substr(p.h, CAST(5 * j + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * k AS INTEGER)) % 32 + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
            CASE WHEN p.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN p.page_id <> f.first THEN f.first END AS refers_to
        FROM p JOIN f ON p.h = f.h""",
    "op11_vector_codes": _vector_codes(),
    "op12_spelling_variants": _spelling(),
}
