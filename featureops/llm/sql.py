"""SQL for the queries of this package that SQL can express.

The others rest on fitted models, on hashes that SQL lacks, or on procedures; ``tests/llm`` holds them against
brute force, exact round trips and held-out labels.
"""

# Fixed value: ASCII white space as a class of the pattern syntax.
BLANK = r" \t\n\x0b\x0c\r"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# crc32 of a text, bit by bit; the list forms keep one state that each byte is mixed into
CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

SQL: dict[str, str] = {
    "op1_ngram_bayes_join": rf"""
        WITH RECURSIVE worded AS (
            SELECT doc_id, list_filter(string_split_regex({LOWER}, '[{BLANK}]+'), lambda x: x <> '') AS w FROM documents),
        sets AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                              ELSE [array_to_string(w, ' ')] END) AS s FROM worded),
        shingles AS (SELECT doc_id, unnest(s) AS g FROM sets),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (
            SELECT shared.a, shared.b, n = len(x.s) AND n = len(y.s) AS same
            FROM shared JOIN sets x ON x.doc_id = shared.a JOIN sets y ON y.doc_id = shared.b
            WHERE 9 * n >= 4 * (len(x.s) + len(y.s))),
        reach AS (SELECT a AS node, b AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other)
        SELECT doc_id,
               least(doc_id, coalesce((SELECT min(other) FROM reach WHERE node = doc_id), doc_id)) AS class_id,
               (SELECT count(*) FROM links WHERE a = doc_id) AS n_links,
               (SELECT count(*) FROM links WHERE a = doc_id AND same) AS n_copies
        FROM documents
    """,
    "op10_sparse_suffix_repeats": rf"""
        WITH pieces AS (
            SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[^{BLANK}]+|[{BLANK}]+')) AS p, generate_subscripts(regexp_extract_all({LOWER}, '[^{BLANK}]+|[{BLANK}]+'), 1) AS k
            FROM documents),
        placed AS (SELECT doc_id, p, k, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM pieces),
        words AS (
            SELECT doc_id, p, e - length(p) AS s, e, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i
            FROM placed WHERE NOT regexp_matches(p, '^[{BLANK}]+$')),
        listed AS (SELECT doc_id, list(p ORDER BY i) AS w FROM words GROUP BY doc_id),
        runs AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' ')))) AS r FROM listed WHERE len(w) >= 50),
        twice AS (SELECT r FROM runs GROUP BY r HAVING count(DISTINCT doc_id) > 1),
        hits AS (SELECT doc_id, i FROM runs SEMI JOIN twice USING (r)),
        marked AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) < 50 THEN 0 ELSE 1 END AS new FROM hits),
        islands AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM marked),
        spans AS (SELECT doc_id, min(i) AS low, max(i) + 49 AS high FROM islands GROUP BY doc_id, island)
        SELECT spans.doc_id, CAST(a.s AS BIGINT) AS start, CAST(b.e AS BIGINT) AS "end", high - low + 1 AS n_words
        FROM spans JOIN words a ON a.doc_id = spans.doc_id AND a.i = low JOIN words b ON b.doc_id = spans.doc_id AND b.i = high
    """,
    "op13_z_fast_trie": rf"""
        WITH t AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
                   coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
        known AS (SELECT conv_id AS c, conv_id - conv_id % 20 AS head, {CRC} % 4 AS h FROM t WHERE i = 1),
        turns AS (
            SELECT c, i, r, x FROM known JOIN t ON conv_id = c WHERE i > h
            UNION ALL SELECT c, i, r, x FROM known JOIN t ON conv_id = head WHERE i <= h),
        seqs AS (SELECT c, list({{'r': r, 'x': x}} ORDER BY i) AS p FROM turns GROUP BY c),
        whole AS (SELECT c, p, coalesce(len(p), 0) AS k FROM known LEFT JOIN seqs USING (c)),
        members AS (SELECT c, d, coalesce(p[1:d], []) AS node, d = k AS ended FROM whole, LATERAL (SELECT unnest(range(k + 1)) AS d)),
        nodes AS (
            SELECT node, d, min(c) AS least, count(*) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ended), '')) AS ends_sha256,
                   CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(node[d].x, '[^{BLANK}]+')) END AS words
            FROM members GROUP BY node, d),
        born AS (SELECT node[1:d - 1] AS node, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
        above AS (
            SELECT m.node, m.d, sum((n - 1) * words) AS saved, count(*) FILTER (born.node IS NULL) AS leaves
            FROM nodes v JOIN members m ON m.c = v.least AND m.d <= v.d LEFT JOIN born ON born.node = v.node AND born.d = v.d GROUP BY ALL)
        SELECT nodes.least AS conv_id, nodes.d AS depth, parent.least AS parent_conv_id, nodes.n AS n_convs, coalesce(n_children, 0) AS n_children,
               leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, nodes.ends_sha256
        FROM nodes JOIN above USING (node, d) LEFT JOIN born USING (node, d)
             LEFT JOIN nodes parent ON parent.node = nodes.node[1:nodes.d - 1] AND parent.d = nodes.d - 1
    """,
    "op11_warc_sharded_writer": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        d AS (SELECT *, octet_length(encode(payload)) AS n, min(page_id) OVER (PARTITION BY payload) AS first,
                     row_number() OVER (PARTITION BY payload ORDER BY page_id) AS k, sha1(payload) AS hex FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
               -- five hexadecimal digits are four of base 32
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
                   (('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), '') AS payload_digest,
               CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first END AS refers_to
        FROM d
    """,
}
