"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from quire.llm.quality_rules import DELTA, GRID, MIN_WORDS, RISK

_cases = ", ".join(f"('{rule}', {k}, {float(c)!r}::double)" for k, (rule, cutoffs) in enumerate(GRID.items()) for c in cutoffs)

OP3 = rf"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), counts AS (
  SELECT words.doc_id, stratum, len(w) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words,
         len(lines) AS n_lines,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals
  FROM words LEFT JOIN covered ON words.doc_id = covered.doc_id
), judged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN n_symbols::double / n_words::double ELSE 0 END AS symbols,
    CASE WHEN n_lines > 0 THEN n_dup_lines::double / n_lines::double ELSE 0 END AS dup_lines,
    CASE WHEN n_words > 0 THEN n_repeat_words::double / n_words::double ELSE 0 END AS repeats,
    CASE WHEN word_chars > 0 THEN n_capitals::double / word_chars::double ELSE 0 END AS capitals,
    CASE WHEN n_words > 0 THEN word_chars::double / n_words::double ELSE 0 END AS word_length
  FROM counts
), long AS (
  SELECT doc_id, stratum, base_failed, unnest(['symbols', 'dup_lines', 'repeats', 'capitals', 'word_length']) AS rule,
         unnest([symbols, dup_lines, repeats, capitals, word_length]) AS v FROM judged
), good AS (
  SELECT doc_id, avg(quality::double) >= 0.5 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
), grid(rule, number, cutoff) AS (VALUES {_cases}),
labelled AS (
  SELECT doc_id, stratum, rule, v, good, md5(doc_id::varchar) < '8' AS choosing FROM long JOIN good USING (doc_id) WHERE NOT base_failed
), tried AS (
  SELECT stratum, rule, number, cutoff, count(*) FILTER (good AND v > cutoff) AS k, count(*) FILTER (NOT good AND v > cutoff) AS caught
  FROM labelled JOIN grid USING (rule) WHERE choosing GROUP BY ALL
), best AS (
  SELECT * FROM tried WHERE caught > k QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY caught - k DESC, cutoff DESC) = 1
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY k, caught - k DESC, number) AS place FROM best
), firsts AS (
  SELECT stratum, doc_id, min(place) FILTER (v > cutoff) AS first FROM labelled JOIN ordered USING (stratum, rule) WHERE NOT choosing AND good GROUP BY ALL
), unions AS (
  SELECT stratum, place, count(*) AS n, count(*) FILTER (first <= place) AS wrong FROM firsts JOIN ordered USING (stratum) GROUP BY ALL
), tails AS (
  SELECT stratum, place, CASE WHEN wrong > n * {RISK} THEN 1.0 ELSE list_sum(list_transform(range(0, wrong::bigint + 1), lambda i:
      exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({RISK}) + (n - i) * ln(1 - {RISK})))) END AS tail
  FROM unions
), passing AS (
  SELECT stratum, place, max(tail) OVER (PARTITION BY stratum ORDER BY place) <= {DELTA} / (SELECT count(DISTINCT stratum) FROM labelled) AS ok FROM tails
), chosen AS (
  SELECT stratum, rule, cutoff FROM ordered JOIN passing USING (stratum, place) WHERE ok
), hits AS (
  SELECT doc_id, bool_or(v > cutoff) AS over FROM long JOIN chosen USING (stratum, rule) GROUP BY doc_id
)
SELECT doc_id, n_words::bigint AS n_words, word_chars::bigint AS word_chars, n_symbols::bigint AS n_symbols, n_dup_lines::bigint AS n_dup_lines,
       n_repeat_words::bigint AS n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(over, false) AS kept
FROM judged LEFT JOIN hits USING (doc_id)
"""

OP5 = """
WITH RECURSIVE steps AS (
  SELECT i::bigint AS i, 0 AS n, i::bigint AS c FROM range(256) t(i)
  UNION ALL
  SELECT i, n + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE n < 8
), crc AS (
  SELECT list(c ORDER BY i) AS tab FROM steps WHERE n = 8
), rows AS (
  SELECT doc_id, source, strlen(coalesce(text, '')) + 8 AS size, coalesce(text, '') AS text,
         md5('42:' || coalesce(doc_id::varchar, '-' || md5(coalesce(text, '')))) AS digest,
         CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS stratum
  FROM documents
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY digest, doc_id) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM rows
), placed AS (
  SELECT *, row_number() OVER (ORDER BY (2 * r - 1)::double / (2 * n)::double, stratum, digest, doc_id) - 1 AS p, count(*) OVER () AS total FROM ranked
)
SELECT doc_id, size::bigint AS size,
       xor(4294967295, list_reduce(list_transform(range(0, strlen(text)), lambda k: ('0x' || hx[2 * k + 1:2 * k + 2])::bigint),
           lambda a, byte: xor(a >> 8, tab[(xor(a, byte) & 255) + 1]), 4294967295))::bigint AS text_crc32, 'rows' AS law, (p * 24 // total)::int AS shard,
       (p - ((p * 24 // total) * total + 23) // 24)::bigint AS slot, NULL::int AS grown_shard
FROM (SELECT *, hex(encode(text)) AS hx FROM placed), crc
"""

OP6 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::bigint AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, rank::int AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

OP8 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), b AS (
  SELECT *, array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * g + 1, 5))::int >> s) & 31) + 1, 1)), '')), '') AS digest,
         min(page_id) OVER (PARTITION BY html) AS least
  FROM p
)
SELECT page_id, strlen(html)::bigint AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> least THEN least END AS refers_to
FROM b
"""

OP10 = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS cut FROM conversations
), s AS (
  SELECT conv_id, turn, role, text AS a, CASE WHEN turn = cut AND role = 'assistant' THEN substr(text, 1, length(text) // 2) ELSE text END AS b FROM t
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, a) AS i FROM s
), f AS (
  SELECT *, coalesce(min(CASE WHEN a <> b THEN i END) OVER (PARTITION BY conv_id) - 1, count(*) OVER (PARTITION BY conv_id)) AS n FROM o
), r AS (
  SELECT *, '<|' || role || '|>' || chr(10) AS head, a || '<|end|>' || chr(10) AS ta, b || '<|end|>' || chr(10) AS tb FROM f
), m AS (
  SELECT *, coalesce(sum(length(head || ta)) OVER w, 0) AS at_a, coalesce(sum(length(head || tb)) OVER w, 0) AS at_b
  FROM r WINDOW w AS (PARTITION BY conv_id, i > n ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT conv_id, CASE WHEN count(*) FILTER (i > n) = 0 THEN 'identical' ELSE 'paired' END AS status,
       count(*) FILTER (i <= n) AS n_prompt_turns, count(*) FILTER (i > n) AS n_chosen_turns, count(*) FILTER (i > n) AS n_rejected_turns,
       coalesce(string_agg(head || ta, '' ORDER BY i) FILTER (i <= n), '') AS prompt,
       coalesce(string_agg(head || ta, '' ORDER BY i) FILTER (i > n), '') AS chosen,
       coalesce(string_agg(head || tb, '' ORDER BY i) FILTER (i > n), '') AS rejected,
       coalesce(string_agg((at_a + length(head))::bigint || ':' || (at_a + length(head) + length(ta) - 1)::bigint, ',' ORDER BY i) FILTER (i > n AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg((at_b + length(head))::bigint || ':' || (at_b + length(head) + length(tb) - 1)::bigint, ',' ORDER BY i) FILTER (i > n AND role = 'assistant'), '') AS rejected_mask
FROM m GROUP BY conv_id
"""

OP11 = """
WITH RECURSIVE steps AS (
  SELECT i::bigint AS i, 0 AS n, i::bigint AS c FROM range(256) t(i)
  UNION ALL
  SELECT i, n + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE n < 8
), crc AS (
  SELECT list(c ORDER BY i) AS tab FROM steps WHERE n = 8
), fields AS (
  SELECT doc_id, text, coalesce('+' || source, '') AS tree,
         list_transform([doc_id::varchar, source, lang, n_chars::varchar], lambda x: coalesce(strlen(x)::varchar || ':' || x, '-')) AS head,
         xor(4294967295, list_reduce(list_transform(range(1, length(doc_id::varchar) + 1), lambda k: ascii(substr(doc_id::varchar, k, 1))::bigint),
             lambda a, byte: xor(a >> 8, tab[(xor(a, byte) & 255) + 1]), 4294967295)) % 2 = 0 AS tamper
  FROM documents, crc
), cut AS (
  SELECT *, CASE WHEN tamper THEN replace(text, chr(10), '') ELSE text END AS later FROM fields
), leaves AS (
  SELECT doc_id, tree, sha256(array_to_string(head, '') || coalesce(strlen(text)::varchar || ':' || text, '-')) AS leaf,
         sha256(array_to_string(head, '') || coalesce(strlen(later)::varchar || ':' || later, '-')) AS tampered
  FROM cut
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM leaves
), up(tree, lvl, i, n, h) AS (
  SELECT tree, 0, i, n, leaf FROM placed
  UNION ALL
  SELECT tree, lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY tree, lvl, i // 3, n
), subroots AS (
  SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1
), top(lvl, i, n, h) AS (
  SELECT 0, i, n, subroot FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY lvl, i // 3, n
), paths AS (
  SELECT tree, i, step, (i // power(3, step)::bigint)::bigint AS pos FROM placed, range(0, 40) t(step) WHERE power(3, step) < n
), runs AS (
  SELECT p.tree, p.i, p.step, coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i < pos), '') AS before, coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i > pos), '') AS after
  FROM paths p JOIN up u ON u.tree = p.tree AND u.lvl = p.step AND u.i // 3 = p.pos // 3 GROUP BY ALL
), toppaths AS (
  SELECT tree, i, step, (i // power(3, step)::bigint)::bigint AS pos FROM subroots, range(0, 40) t(step) WHERE power(3, step) < n
), topruns AS (
  SELECT p.tree, p.step, coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i < pos), '') AS before, coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i > pos), '') AS after
  FROM toppaths p JOIN top u ON u.lvl = p.step AND u.i // 3 = p.pos // 3 GROUP BY ALL
), lower AS (
  SELECT tree, i, string_agg(before || after, '' ORDER BY step) AS proof FROM runs GROUP BY ALL
), upper AS (
  SELECT tree, string_agg(before || after, '' ORDER BY step) AS proof FROM topruns GROUP BY ALL
), fold(tree, i, step, h) AS (
  SELECT tree, i, 0, tampered FROM placed
  UNION ALL
  SELECT f.tree, f.i, f.step + 1, sha256(before || h || after) FROM fold f JOIN runs r ON r.tree = f.tree AND r.i = f.i AND r.step = f.step
), low AS (
  SELECT tree, i, arg_max(h, step) AS h FROM fold GROUP BY ALL
), fold2(tree, i, step, h) AS (
  SELECT tree, i, 0, h FROM low
  UNION ALL
  SELECT f.tree, f.i, f.step + 1, sha256(before || h || after) FROM fold2 f JOIN topruns r ON r.tree = f.tree AND r.step = f.step
), ends AS (
  SELECT tree, i, arg_max(h, step) AS folded_root FROM fold2 GROUP BY ALL
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(lower.proof, '') || coalesce(upper.proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN ends USING (tree, i) JOIN (SELECT tree, subroot FROM subroots) s USING (tree)
     LEFT JOIN lower USING (tree, i) LEFT JOIN upper USING (tree), (SELECT h AS root FROM top WHERE n = 1) r
"""

OP12 = """
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), flags AS (
  SELECT part, len(w) < 100 AS A, 100 * len(list_distinct(w)) < 80 * len(w) AS B,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS C, regexp_matches(text, '[#$%&*|]') AS D,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS E, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM words LEFT JOIN marks USING (doc_id)
), groups AS (
  SELECT part, good, toxic, [A, B, C, D, E] AS fails, count(*) AS n FROM flags GROUP BY ALL
), letters AS (
  SELECT unnest([1, 2, 3, 4, 5]) AS k
), orders AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), steps AS (
  SELECT list_aggregate(list_transform(o, lambda k: substr('ABCDE', k, 1)), 'string_agg', '') AS filter_order, s.k AS step, o, o[s.k] AS f FROM orders, letters s
), met AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails[f] AS failing,
         list_bool_or(list_transform(range(1, step), lambda j: fails[o[j]])) AS earlier,
         list_sum(list_transform(fails, lambda x: x::int)) AS failed
  FROM steps, groups
), sums AS (
  SELECT part, filter_order, step, f, sum(n) FILTER (NOT failing AND NOT coalesce(earlier, false)) AS kept, sum(n) FILTER (failing AND NOT coalesce(earlier, false)) AS removed,
         sum(n) FILTER (failing AND coalesce(earlier, false)) AS redundant, sum(n) FILTER (failing AND failed = 1) AS unique_fails,
         sum(n) FILTER (failing AND NOT coalesce(earlier, false) AND good) AS good_lost, sum(n) FILTER (failing AND NOT coalesce(earlier, false) AND toxic) AS toxic_lost
  FROM met GROUP BY ALL
)
SELECT part, filter_order, step::int AS step, coalesce(kept, 0)::bigint AS kept, coalesce(removed, 0)::bigint AS removed, coalesce(redundant, 0)::bigint AS redundant,
       coalesce(unique_fails, 0)::bigint AS unique_fails, coalesce(good_lost, 0)::bigint AS good_lost, coalesce(toxic_lost, 0)::bigint AS toxic_lost,
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, f))::bigint AS shapley
FROM sums
"""

OP13 = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, strlen(h) // 2 - 99)) AS i FROM d)
), f AS (
  SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1
), s AS (
  SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, -1) AS starts FROM f
), r AS (
  SELECT doc_id, n, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(starts::int) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM s) GROUP BY ALL
), k AS (
  SELECT doc_id, n, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY n) AS p, a FROM r
  UNION ALL
  SELECT doc_id, max(n) + 1, max(b), NULL FROM r GROUP BY doc_id
), t AS (
  SELECT k.doc_id, string_agg(substr(h, 2 * p + 1, CASE WHEN a IS NULL THEN strlen(h) ELSE 2 * (a - p) END), '' ORDER BY n) AS kept FROM k JOIN d ON k.doc_id = d.doc_id GROUP BY k.doc_id
), e AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed FROM r GROUP BY doc_id
)
SELECT d.doc_id, strlen(h) // 2 AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0)::bigint AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN e ON d.doc_id = e.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""

SQL: dict[str, str] = {"op3_quality_rules": OP3, "op5_interleave": OP5, "op6_pivot_search": OP6, "op8_warc": OP8, "op10_preferences": OP10, "op11_merkle": OP11, "op12_filter_audit": OP12, "op13_suffix_dedup": OP13}
