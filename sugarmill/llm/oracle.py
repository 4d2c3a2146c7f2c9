"""DuckDB SQL with the rows of those training-data queries that SQL can express."""

from __future__ import annotations

import string

#: Components by reach: the smallest id that links lead to. ``link`` holds each link in both directions.
REACH = "reach(id, other) AS (SELECT a, b FROM link UNION SELECT r.id, l.b FROM reach r JOIN link l ON l.a = r.other), least AS (SELECT id, min(other) AS low FROM reach GROUP BY 1)"

# RE2 has no lookahead, so a control string is matched whole; none begins within the rest of another
ESCAPED = r"regexp_replace(replace({0}, '\', '\\'), '([<\[])(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2', 'g')"

OP1 = f"""WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, n, who, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(n, who)),
chat AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum(length('<|turn|><|body|></s>') + length({ESCAPED.format("role")}) + length({ESCAPED.format("text")}))::BIGINT AS formatted_chars FROM said GROUP BY 1)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, 0::BIGINT AS attachment_tokens FROM chat"""

OP5 = f"""WITH RECURSIVE given AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
good AS MATERIALIZED (SELECT vec_id, v FROM given WHERE v IS NOT NULL AND len([x FOR x IN v IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN v IF x <> 0]) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY 1), {REACH}
SELECT g.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, least(g.vec_id, coalesce(l.low, g.vec_id)) AS component_id, g.vec_id <= coalesce(l.low, g.vec_id) AS kept
FROM given g LEFT JOIN degree d ON d.a = g.vec_id LEFT JOIN least l ON l.id = g.vec_id"""

OP9 = f"""WITH RECURSIVE given AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
parts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM given WHERE len(w) > 0),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS gram FROM parts),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT c.a, c.b FROM common c JOIN sizes s ON s.doc_id = c.a JOIN sizes t ON t.doc_id = c.b WHERE 100 * c.n >= 85 * (s.n + t.n - c.n)), {REACH}
SELECT g.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(g.doc_id, coalesce(l.low, g.doc_id)) AS component_id
FROM given g LEFT JOIN sizes s ON s.doc_id = g.doc_id LEFT JOIN least l ON l.id = g.doc_id"""

OP13_SCORE = "1000000::HUGEINT * a * a // (l::HUGEINT * r)"
OP13 = f"""WITH given AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM given),
said AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
one AS (SELECT lang, word, count(*) AS f FROM (SELECT lang, unnest(w) AS word FROM said) GROUP BY ALL),
size AS (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY 1),
two AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, count(*) AS a FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM said) GROUP BY ALL HAVING count(*) >= 10),
three AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3, count(*) AS a FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM said) GROUP BY ALL HAVING count(*) >= 10),
inside AS (SELECT lang, w1, w2, max(a) AS longer FROM (SELECT lang, w1, w2, a FROM three UNION ALL SELECT lang, w2, w3, a FROM three) GROUP BY ALL),
cuts AS (SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, 1 AS k, a, x.f AS l, y.f AS r FROM two t JOIN one x ON x.lang = t.lang AND x.word = t.w1 JOIN one y ON y.lang = t.lang AND y.word = t.w2
    LEFT JOIN inside i ON i.lang = t.lang AND i.w1 = t.w1 AND i.w2 = t.w2 WHERE longer IS NULL OR 100 * longer < 50 * a
  UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 1, t.a, x.f, y.a FROM three t JOIN one x ON x.lang = t.lang AND x.word = t.w1 JOIN two y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 2, t.a, x.a, y.f FROM three t JOIN two x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN one y ON y.lang = t.lang AND y.word = t.w3),
lowest AS (SELECT lang, phrase, a, l, r, ({OP13_SCORE})::BIGINT AS score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY {OP13_SCORE}, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM lowest JOIN size USING (lang) QUALIFY rank <= 2000"""

ORACLE = {"op1_chat_formatting": OP1, "op5_embedding_near_dedup": OP5, "op9_ngram_jaccard_join": OP9, "op13_phrase_collocations": OP13}
