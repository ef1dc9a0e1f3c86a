"""SQL twins of the queries that SQL can express, over the same tables."""

_WORDS = """list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"""

def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an expression's UTF-8, a bit at a time from the lowest."""
    code = f"hex(encode({text}))"
    bits = f"""list_transform(range(0, 4 * length({code})), lambda k:
        (('0x' || substr({code}, (2 * (k // 8) + 1)::INT, 2))::INT >> (k % 8)::INT) & 1)"""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, b:
        xor(c >> 1, (xor(c, b) & 1) * 3988292384)))"""


_VARIANTS = f"""
        WITH RECURSIVE runs AS (
            SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
        each AS (SELECT doc_id, w, count(*) AS k FROM runs WHERE length(w) >= 5 GROUP BY ALL),
        coded AS (SELECT w, k, {_crc32("doc_id::VARCHAR || ':' || w")} AS h FROM each),
        edited AS (
            SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2)
                ELSE w END AS word, k FROM coded),
        words AS (SELECT word, sum(k)::BIGINT AS n FROM edited WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
        cut AS (
            SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest
            FROM (SELECT word, unnest(range(0, length(word)))::INT AS i FROM words)),
        pairs AS (
            SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b USING (i, rest) WHERE a.word <> b.word
            UNION SELECT c.word, c.rest FROM cut c JOIN words w ON c.rest = w.word
            UNION SELECT c.rest, c.word FROM cut c JOIN words w ON c.rest = w.word),
        near AS (
            SELECT a AS word, count(*) AS n_near, arg_max(b, (n, -r)) AS best, max(n) AS best_n
            FROM pairs JOIN (SELECT *, row_number() OVER (ORDER BY encode(word)) AS r FROM words) w ON w.word = b
            GROUP BY a),
        formed AS (
            SELECT words.word, n, coalesce(n_near, 0) AS n_near,
                CASE WHEN best_n >= 2 * n THEN best END AS form, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n
            FROM words LEFT JOIN near USING (word)),
        way AS (
            SELECT word, word AS root, form AS next FROM formed
            UNION ALL
            SELECT way.word, f.word, f.form FROM way JOIN formed f ON f.word = way.next)
        SELECT word, form, root, n, n_near, form_n FROM formed
        JOIN (SELECT word, root FROM way WHERE next IS NULL) USING (word)"""

_PERIODS = f"""
        WITH given AS (
            SELECT doc_id, {_crc32("doc_id::VARCHAR")} AS h,
                list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        sized AS (SELECT *, h // 10 AS g, len(w) AS n, len(w) > 0 AND h % 10 = 0 AS hit FROM given),
        placed AS (SELECT *, CASE WHEN hit THEN g % n END AS a FROM sized),
        d AS (
            SELECT doc_id, n, CASE WHEN hit THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i
                ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM placed),
        words AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM d),
        equal AS (
            SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word
                AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
        islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM equal),
        stretches AS (SELECT doc_id, min(i) AS s, count(*) + q AS len, q FROM islands GROUP BY doc_id, q, k),
        runs AS (
            SELECT doc_id, s, len, min(q) AS q FROM stretches WHERE len >= greatest(24, 3 * q) GROUP BY doc_id, s, len),
        per AS (
            SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS listed
            FROM runs GROUP BY doc_id),
        best AS (
            SELECT * FROM runs QUALIFY row_number() OVER (
                PARTITION BY doc_id ORDER BY (len::DOUBLE / q) DESC, s, q) = 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM runs),
        kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text
            FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s AS start, len AS length, q AS period,
            (1000 * len) // q AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
            sha256(coalesce(kept.text, '')) AS collapsed_sha256
        FROM d LEFT JOIN per USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)"""

_REPEATS = """
        WITH d AS (
            SELECT doc_id, hash(text) AS k, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
        rows AS (SELECT DISTINCT doc_id, k, x, length(x) // 2 AS n FROM d),
        starts AS (SELECT doc_id, k, x, unnest(range(0, n - 199)) AS i FROM rows WHERE n >= 200),
        windows AS (SELECT doc_id, k, i, md5(substr(x, 2 * i + 1, 400)) AS w FROM starts),
        twice AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
        hits AS (SELECT doc_id, k, i FROM windows SEMI JOIN twice USING (w)),
        marked AS (
            SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id, k ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM hits),
        numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, k ORDER BY i) AS s FROM marked),
        spans AS (SELECT doc_id, k, s, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY doc_id, k, s),
        gaps AS (
            SELECT r.doc_id, r.k, x, coalesce(lag(b) OVER (PARTITION BY r.doc_id, r.k ORDER BY a), 0) AS low, a AS high, a, b
            FROM rows r JOIN spans USING (doc_id, k)),
        kept AS (
            SELECT doc_id, k, count(*) AS n_spans, sum(b - a) AS n_removed,
                string_agg(substr(x, 2 * low + 1, 2 * (high - low)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS left_over
            FROM gaps GROUP BY doc_id, k)
        SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
            coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(left_over, x))) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id, k)"""

ORACLES = {
    "op12_suffix_dedup": _REPEATS,
    "op11_periodic_runs": _PERIODS,
    "op13_spelling_variants": _VARIANTS,
    "op6_decontaminate": f"""
        WITH d AS (SELECT doc_id, hash(text) AS k, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        bw AS (
            SELECT DISTINCT item_id, least(10, len(w)) AS n,
                array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
            FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
                  FROM b WHERE len(w) > 0)),
        spans AS (SELECT DISTINCT n FROM bw),
        dw AS (
            SELECT doc_id, k, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
            FROM (SELECT d.*, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, spans)),
        hits AS (SELECT dw.doc_id, k, i, n, item_id FROM dw JOIN bw USING (n, g)),
        covered AS (
            SELECT doc_id, k, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, k, unnest(range(i, i + n)) AS p FROM hits) GROUP BY ALL),
        named AS (
            SELECT doc_id, k, count(DISTINCT item_id) AS n_items,
                string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
            FROM hits GROUP BY ALL)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
            coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
            n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN covered USING (doc_id, k) LEFT JOIN named USING (doc_id, k)""",
}
