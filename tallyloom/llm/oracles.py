"""DuckDB SQL for the operators that SQL can express over whole tables.

The others have none: learned models (op1, op5), sums of logarithms whose last digits depend on the order (op8), byte
windows and tokenizers that SQL cannot reach (op2, op6, op10), candidates by hashing with linked classes (op4).
"""

ORACLES: dict[str, str] = {
    # keys of at least one code point in ten documents or more lose all their lines
    "op3_line_dedup": r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT r, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM docs),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
frequent AS (SELECT k AS f FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(f) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent ON k = f GROUP BY r""",
    # measures, base verdict and the conjunction of all rules, which no order of the cascade changes
    "op7_quality": r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
           len(string_split(coalesce(text, ''), chr(10))) AS all_lines FROM documents),
words AS (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS pos FROM docs),
windows AS (SELECT r, pos, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM words WINDOW o AS (PARTITION BY r ORDER BY pos)),
twice AS (SELECT r, pos, z IS NOT NULL AND count(*) OVER (PARTITION BY r, x, y, z) > 1 AS again FROM windows),
marked AS (SELECT r, again OR coalesce(lag(again) OVER o, false) OR coalesce(lag(again, 2) OVER o, false) AS hit FROM twice WINDOW o AS (PARTITION BY r ORDER BY pos)),
repeats AS (SELECT r, count_if(hit) AS n FROM marked GROUP BY r),
top AS (SELECT r, max(n) AS n FROM (SELECT r, x, count(*) AS n FROM words GROUP BY r, x) GROUP BY r),
measured AS (
    SELECT r, doc_id, t, w, lines, all_lines, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
           length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
           coalesce(repeats.n, 0) AS n_repeat_words, coalesce(top.n, 0) AS most FROM docs LEFT JOIN repeats USING (r) LEFT JOIN top USING (r)),
judged AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           10 * len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{L}'))) > 5 * n_words
           OR NOT word_chars BETWEEN 2 * n_words AND 15 * n_words
           OR 2 * n_symbols > n_words
           OR n_dup_lines > 4 AND 2 * n_dup_lines > all_lines
           OR len(lines) >= 4 AND 10 * len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•|]'))) > 9 * len(lines)
           OR len(lines) >= 4 AND 10 * len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) > 3 * len(lines)
           OR n_words >= 50 AND 10 * most > 3 * n_words
           OR n_words >= 50 AND 400 * len(list_distinct(w)) * len(list_distinct(w)) < n_words * least(n_words, 2000)
           OR 20 * (length(t) - length(regexp_replace(t, '[{}]', '', 'g'))) > n_words
           OR 50 * (length(t) - length(replace(t, chr(65533), ''))) > length(t) AS rejected FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM judged""",
    # products in 128-bit integers, so that large components are exact too
    "op9_topk": r"""
WITH usable AS (
    SELECT row_number() OVER () AS r, vec_id, len(embedding) AS dim, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::HUGEINT) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM usable q JOIN usable c ON q.r <> c.r AND q.dim = c.dim WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20""",
    # every prefix of every rebuilt conversation as a list of turns; subtrees by joining nodes with their own prefixes
    "op11_trie": r"""
WITH own AS (
    SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (
    SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda b, i: xor(b >> 1, CASE WHEN b % 2 = 1 THEN 3988292384 ELSE 0 END)))) % 6 AS h FROM own),
rebuilt AS (SELECT o.c, list_concat(coalesce(s.turns, [])[1:o.h], o.turns[o.h + 1:]) AS turns FROM heads o LEFT JOIN own s ON s.c = o.c - o.c % 100),
depths AS (SELECT c, unnest(range(len(turns) + 1)) AS depth, turns FROM rebuilt),
prefixes AS (SELECT c, depth, turns[1:depth] AS path, len(turns) = depth AS ended, CASE WHEN depth = 0 THEN 0 ELSE length(turns[depth].text) END AS size FROM depths),
nodes AS (
    SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ended), '') AS ends, (count(*) - 1) * any_value(size) AS saved
    FROM prefixes GROUP BY path, depth),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
known AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)),
above AS (SELECT path[1:up] AS path, sum(saved) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves FROM (SELECT *, unnest(range(depth + 1)) AS up FROM known) GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, a.leaves AS n_leaves, a.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM known n JOIN above a USING (path) LEFT JOIN known p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]""",
    # every order of five letters against every document's failures, step by step
    "op12_interactions": r"""
WITH docs AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
failed AS (
    SELECT part, doc_id, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t))::INT
           + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask FROM docs),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM failed LEFT JOIN marks USING (doc_id) GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
    SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order, unnest([a.bit, b.bit, c.bit, d.bit, e.bit]) AS bit, unnest([0, a.bit, a.bit + b.bit, a.bit + b.bit + c.bit, 31 - e.bit]) AS before, unnest([1, 2, 3, 4, 5]) AS step
    FROM f a JOIN f b ON b.bit <> a.bit JOIN f c ON c.bit NOT IN (a.bit, b.bit) JOIN f d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN f e ON e.bit = 31 - a.bit - b.bit - c.bit - d.bit),
steps AS (
    SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM cells CROSS JOIN orders GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM steps""",
}
