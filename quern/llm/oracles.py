"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from quern.llm.quality_rules import RULES

_WORD = r"[^\x20\x09-\x0D]+"


def _escaped(c: str) -> str:
    from quern.llm.chat_format import CONTROL

    c = rf"replace({c}, '\', '\\')"
    for x in CONTROL:
        c = rf"replace({c}, '{x}', '{x[0]}\{x[1:]}')"
    return c


_MARKS = len("<|role|>") + len("<|text|>") + len("<|end|>")

OP1 = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_escaped('role')}) + length({_escaped('text')}) + {_MARKS})::BIGINT AS formatted_chars,
  count(*) FILTER (role = 'assistant') AS n_examples
FROM rows GROUP BY conv_id
"""

#: mix(docs) as SQL over a table `docs`; the pipeline uses it too.
MIX = r"""
mix_base AS (SELECT doc_id, coalesce('a' || source, 'z') AS sk, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '') || '/mix') AS key FROM docs),
mix_sizes AS (SELECT sk, sum(size)::BIGINT AS source_size FROM mix_base GROUP BY sk),
mix_w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY sk) - 1) % 3 + 1)::INT] AS w, source_size * 2.0::DOUBLE AS cap,
    sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM mix_sizes),
mix_fill AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(w) OVER (ORDER BY cap / w, sk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining FROM mix_w),
mix_level AS (SELECT arg_min((budget - before) / remaining, (cap / w, sk)) AS level FROM mix_fill WHERE (budget - before) / remaining * w <= cap),
mix_goal AS (SELECT sk, source_size, budget, least(cap, coalesce(level * w, cap)) AS target FROM mix_fill, mix_level),
mix_queue AS (SELECT b.*, source_size, target, budget, sum(size) OVER (PARTITION BY b.sk ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto
    FROM mix_base b JOIN mix_goal USING (sk)),
mix_entry AS (SELECT *, CASE WHEN target > 0 THEN (upto + p * source_size)::DOUBLE / target ELSE 0 END AS finish FROM mix_queue, range(2) r(p)),
mix_taken AS (SELECT *, sum(size) OVER (ORDER BY finish, sk, p, key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) <= budget AS fits FROM mix_entry)
"""

OP2 = f"""
WITH docs AS (SELECT * FROM documents), {MIX}
SELECT doc_id, size, any_value(source_size) AS source_size, any_value(target) AS target, (size * count(*) FILTER (fits))::BIGINT AS taken
FROM mix_taken GROUP BY doc_id, size, sk
"""

#: measurements of a table `docs` (doc_id, text).
LEDGER = rf"""
led_words AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM docs),
led_lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM led_words) WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id),
led_at AS (SELECT doc_id, ws, unnest(range(len(ws) - 4)) AS i FROM led_words WHERE len(ws) >= 5),
led_win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i+1:i+5]) AS c FROM led_at),
led_rep AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM led_win WHERE c > 1) GROUP BY doc_id),
led AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, len(regexp_extract_all(text, '!')) AS n_exclaim,
    len(list_filter(ws, lambda w: regexp_matches(w, '[\x00-\x7F]') AND regexp_matches(w, '[\x00-\x08\x0E-\x1F\x7F!#$%&*+/0-9<=>@\[\]\\^_`{{|}}~]'))) AS n_odd_words
    FROM led_words LEFT JOIN led_lines USING (doc_id) LEFT JOIN led_rep USING (doc_id)),
led_bits AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (100 * n_symbols > 10 * word_chars)::BIGINT
    + 8 * (n_dup_lines >= 2 AND 100 * n_dup_lines > 30 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 25 * n_words)::BIGINT
    + 64 * (100 * n_exclaim > 50 * n_words)::BIGINT + 128 * (n_words >= 20 AND 100 * n_odd_words > 40 * n_words)::BIGINT AS failed FROM led)
"""

OP7 = f"""
WITH docs AS (SELECT doc_id, text FROM documents), {LEDGER}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM led_bits
"""

_RULE_NAMES = list(RULES)
OP7_ABLATION = f"""
WITH docs AS (SELECT doc_id, text FROM documents), {LEDGER}, rules AS (SELECT unnest({_RULE_NAMES}) AS rule, unnest(range({len(_RULE_NAMES)})) AS i)
SELECT rule, count(*) FILTER (failed & (1::BIGINT << i) <> 0) AS n_failed, count(*) FILTER (failed = (1::BIGINT << i)) AS n_only,
  count(*) FILTER (failed & ~(1::BIGINT << i) = 0) AS n_kept_without FROM led_bits, rules GROUP BY rule
"""

#: Windows of 200 bytes as hex digits; those that stand elsewhere too are merged to runs, and what is left is put together.
OP9 = """
WITH t AS (SELECT doc_id, row_number() OVER () AS r, coalesce(hex(encode(text)), '') AS h FROM documents),
w AS (SELECT r, i, md5(h[2 * i + 1 : 2 * i + 400]) AS k FROM (SELECT r, h, unnest(range(len(h) // 2 - 199)) AS i FROM t WHERE len(h) >= 400)),
hits AS (SELECT r, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
marks AS (SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > 200, true) AS new FROM hits),
runs AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM (SELECT r, i, sum(new::INT) OVER (PARTITION BY r ORDER BY i) AS g FROM marks) GROUP BY r, g),
gaps AS (SELECT r, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS a, a AS b FROM runs UNION ALL SELECT r, max(b), NULL FROM runs GROUP BY r),
kept AS (SELECT r, string_agg(h[2 * g.a + 1 : 2 * coalesce(g.b, len(h) // 2)], '' ORDER BY g.a) AS h FROM gaps g JOIN t USING (r) GROUP BY r),
sums AS (SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY r)
SELECT doc_id, len(t.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.h, t.h))) AS kept_sha256
FROM t LEFT JOIN sums USING (r) LEFT JOIN kept k USING (r)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP10 = f"""
WITH t AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256, {_LOWER} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, text_sha256 FROM t
"""

#: Rules as rows; of those that fit a URL the longest counts.
OP11 = r"""
WITH rules(rule, verdict) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
p AS (SELECT row_number() OVER () AS r, page_id, regexp_replace(url, '(?s)^.*?://', '') AS rest, coalesce(contains(url, '://'), false) AS ok FROM pages),
q AS (SELECT r, page_id, CASE WHEN ok THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN ok THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM p),
fits AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM q, rules
  WHERE ends_with('.' || host, '.' || split_part(rule, '/', 1)) AND starts_with(path, rule[length(split_part(rule, '/', 1)) + 1:]) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM q LEFT JOIN fits USING (r)
"""

OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
held AS (SELECT r, doc_id, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0),
every AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM held),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, every GROUP BY term),
i AS (SELECT row_number() OVER () AS i, item_id, text FROM benchmark),
asked AS (SELECT DISTINCT i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM i),
m AS (SELECT r, doc_id, 50 + (50 * n * n_docs) // n_terms AS m FROM held, every),
s AS (SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY i, item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST, r) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""


def _vector_codes(rounds: int = 4) -> str:
    """Codebooks round by round, each as a table; all in whole numbers."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
far{k} AS MATERIALIZED (SELECT r, p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts JOIN book{k} USING (p)),
near{k} AS MATERIALIZED (SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM far{k} GROUP BY r, p)""")
        if k < rounds:
            steps.append(f"""
mean{k} AS (SELECT p, e, i, floor(sum(x[i + 1])::DOUBLE / count(*))::BIGINT AS c FROM near{k} JOIN parts USING (r, p), range(len(x)) t(i) GROUP BY p, e, i),
book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(new, c) AS c FROM book{k} LEFT JOIN (SELECT p, e, list(c ORDER BY i) AS new FROM mean{k} GROUP BY p, e) USING (p, e))""")
    return f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda y: floor(1024 * y::DOUBLE)::BIGINT) AS y FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
parts AS MATERIALIZED (SELECT r, p, y[len(y) // 4 * p + 1 : len(y) // 4 * (p + 1)] AS x FROM v, range(4) t(p)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= 256), {",".join(steps)},
sums AS (SELECT r, sum(d)::BIGINT AS error, string_agg(lower(printf('%02x', e::INT)), '' ORDER BY p) AS code FROM near{rounds} GROUP BY r),
hash AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM v JOIN sums USING (r), hash
"""


OP13 = _vector_codes()

ORACLES: dict[str, str] = {
    "op1_chat_formatting": OP1,
    "op2_source_mixing": OP2,
    "op7_quality_rules": OP7,
    "quality_ablation": OP7_ABLATION,
    "op9_suffix_dedup": OP9,
    "op10_exact_dedup": OP10,
    "op11_url_filter": OP11,
    "op12_lexical_search": OP12,
    "op13_vector_codes": OP13,
}
