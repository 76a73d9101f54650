"""SQL (DuckDB) that says the same as the queries of the native operators."""

from __future__ import annotations

from skymap.llm import divergence as dv
from skymap.llm import licenses as lc
from skymap.llm import line_dedup as ld
from skymap.llm import merkle as mk

_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def common_lines() -> str:
    return f"""
WITH l AS (
  SELECT row_id, doc_id, u.i AS line_no, u.line,
         translate(trim(u.line, {_STRIP}), '{ld.UPPER}', '{ld.LOWER}') AS key
  FROM (SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
       LATERAL (SELECT unnest(lines) AS line, generate_subscripts(lines, 1) AS i) u
),
common AS (SELECT key FROM l WHERE length(key) >= {ld.MIN_POINTS} GROUP BY key HAVING count(DISTINCT row_id) >= {ld.MIN_DOCS})
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines,
       (count(*) FILTER (WHERE c.key IS NOT NULL))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN common c ON l.key = c.key GROUP BY row_id"""


def licenses() -> str:
    known = ", ".join(f"('{t}', '{n}')" for n, t in lc.SENTENCES.items())
    rules = []
    for name in sorted(lc.RULES):
        tests = " OR ".join(f"regexp_matches('|' || sentence_ids || '|', '{lc.rule_pattern(r)}')" for r in lc.RULES[name])
        rules.append(f"CASE WHEN {tests} THEN '{name}' END")
    return f"""
WITH known(s, id) AS (VALUES {known}),
d AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         string_split(regexp_replace(coalesce(text, ''), '{lc.ENDS}', '\\1' || chr(10), 'g'), chr(10)) AS p FROM documents
),
s AS (
  SELECT row_id, u.i, trim(lower(regexp_replace(u.x, '{lc.NOT_PLAIN}', ' ', 'g'))) AS s
  FROM d, LATERAL (SELECT unnest(p) AS x, generate_subscripts(p, 1) AS i) u
),
g AS (
  SELECT row_id, count(*) AS n_sentences, coalesce(string_agg(id, '|' ORDER BY i), '') AS sentence_ids
  FROM s LEFT JOIN known USING (s) WHERE s <> '' GROUP BY row_id
)
SELECT doc_id, n_sentences, sentence_ids, concat_ws(',', {", ".join(rules)}) AS licenses
FROM (SELECT d.doc_id, coalesce(n_sentences, 0)::BIGINT AS n_sentences, coalesce(sentence_ids, '') AS sentence_ids
      FROM d LEFT JOIN g USING (row_id))"""


def _jsd(p: list[str], q: list[float]) -> str:
    terms = []
    for a, b in zip(p, q):
        m = f"(({a}) + {b!r}) / 2"
        terms.append(f"CASE WHEN {a} > 0 THEN ({a}) * log2(({a}) / ({m})) ELSE 0 END")
        if b > 0:
            terms.append(f"{b!r} * log2({b!r} / ({m}))")
    return f"sqrt(greatest(({' + '.join(terms)}) / 2, 0))"


def divergence() -> str:
    languages = sorted(dv.COMMON_WORDS)
    tallies = ", ".join(f"count(*) FILTER (WHERE w = '{w}') AS c{i}" for i, w in enumerate(dv._ALL_COMMON))
    at = {w: f"coalesce(c{i}, 0)" for i, w in enumerate(dv._ALL_COMMON)}
    found = {x: " + ".join(at[w] for w in dv.COMMON_WORDS[x]) for x in languages}
    most = f"greatest({', '.join(found.values())})"
    common = []
    for x in languages:
        words = dv.COMMON_WORDS[x]
        p = [f"({at[w]})::DOUBLE / n_words" for w in words] + [f"(n_words - ({found[x]}))::DOUBLE / n_words"]
        common.append(f"WHEN {found[x]} = {most} THEN {_jsd(p, [*words.values(), 1 - sum(words.values())])}")
    shares = ["letters / chars", "digits / chars", "(chars - word_chars) / chars", "n_symbols / chars", "(word_chars - letters - digits - n_symbols) / chars"]
    classes = ", ".join(_jsd(shares, list(dv.CHARACTER_CLASSES[x])) for x in languages)
    win = dv.WINDOW
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
),
w AS (SELECT row_id, u.i, u.w FROM d, LATERAL (SELECT unnest(words) AS w, generate_subscripts(words, 1) AS i) u),
t AS (SELECT row_id, sum(length(w)) AS word_chars, {tallies} FROM w GROUP BY row_id),
g AS (
  SELECT row_id, i, list(w) OVER (PARTITION BY row_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {win - 1} FOLLOWING) AS g FROM w
),
r AS (SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, g) AS n FROM g WHERE len(g) = {win}) WHERE n > 1),
c AS (
  SELECT row_id, sum(least({win}, coalesce(nxt - i, {win}))) AS n_repeat
  FROM (SELECT row_id, i, lead(i) OVER (PARTITION BY row_id ORDER BY i) AS nxt FROM r) GROUP BY row_id
),
l AS (
  SELECT row_id, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY row_id
),
b AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '{dv.SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
         length(text)::DOUBLE AS chars, length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) AS letters,
         length(regexp_replace(text, '[^0-9]+', '', 'g')) AS digits, t.* EXCLUDE (row_id, word_chars)
  FROM d LEFT JOIN t USING (row_id) LEFT JOIN c USING (row_id) LEFT JOIN l USING (row_id)
),
v AS (
  SELECT *, (n_words < {dv.MIN_WORDS} OR 100 * n_repeat_words > {dv.MAX_REPEAT_PERCENT} * n_words) AS base_failed,
         CASE WHEN chars >= {dv.MIN_CHARS_FOR_CLASSES} THEN least({classes}) > {dv.MAX_CLASS_DISTANCE} ELSE false END AS odd_classes,
         CASE WHEN n_words >= {dv.MIN_WORDS_FOR_COMMON} THEN (CASE {' '.join(common)} END) > {dv.MAX_COMMON_DISTANCE} ELSE false END AS odd_words
  FROM b
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND NOT odd_classes AND NOT odd_words) AS kept FROM v"""


def merkle(levels: int = 5) -> str:
    """Trees of up to 16^levels leaves a source, and of up to 16^levels sources."""
    fold = mk.FAN_OUT
    upper = "".join(map(chr, range(65, 91)))

    def leaf(text: str) -> str:
        fields = ("doc_id", "source", "lang", "n_chars", text)
        return "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR)::VARCHAR || ':' || {f}::VARCHAR, '-')" for f in fields) + ")"

    def tree(prefix: str) -> str:
        """Tables prefix0 (t, i, h, f) to prefix{levels}: f is the folded hash of leaf ``id`` at that level."""
        parts = []
        for k in range(levels):
            parts.append(
                f"{prefix}{k + 1} AS MATERIALIZED (SELECT t, i // {fold} AS i, "
                f"CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, "
                f"list(h ORDER BY i) AS hs, (any_value(n) + {fold - 1}) // {fold} AS n, any_value(n) AS below "
                f"FROM {prefix}{k} GROUP BY t, i // {fold})"
            )
        return ",\n".join(parts)

    def climb(prefix: str, start: str, tree_id: str, place: str) -> str:
        """Tables {prefix}c1 ... of the leaves' folded hashes and proofs, level by level."""
        parts, before = [], start
        for k in range(levels):
            at = f"({place} // {fold ** k}) % {fold} + 1"
            parts.append(
                f"{prefix}c{k + 1} AS (SELECT b.* REPLACE (CASE WHEN p.below = 1 THEN b.f ELSE "
                f"sha256(array_to_string(p.hs[:{at} - 1] || [b.f] || p.hs[{at} + 1:], '')) END AS f, "
                f"b.proof || CASE WHEN p.below = 1 THEN '' ELSE array_to_string(p.hs[:{at} - 1] || p.hs[{at} + 1:], '') END AS proof) "
                f"FROM {before} b JOIN {prefix}{k + 1} p ON p.t = {tree_id} AND p.i = {place} // {fold ** (k + 1)})"
            )
            before = f"{prefix}c{k + 1}"
        return ",\n".join(parts)

    bit = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""
WITH RECURSIVE bits(b, c, k) AS (
  SELECT range, range::BIGINT, 0 FROM range(256) UNION ALL SELECT b, {bit}, k + 1 FROM bits WHERE k < 8
),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
steps(id, c, k) AS (
  SELECT DISTINCT doc_id, 4294967295::BIGINT, 1 FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT id, xor(c >> 8, t[xor(c & 255, ascii(substr(id::VARCHAR, k, 1))::BIGINT) + 1]), k + 1
  FROM steps, crc WHERE k <= length(id::VARCHAR)
),
hit AS (SELECT id FROM steps WHERE k = length(id::VARCHAR) + 1 AND xor(c, 4294967295) % 5 = 0),
leaves AS (
  SELECT doc_id, source, {leaf('text')} AS h,
         CASE WHEN doc_id IN (SELECT id FROM hit) THEN {leaf(f"translate(text, '{upper}', '{upper.lower()}')")} ELSE {leaf('text')} END AS f
  FROM documents
),
placed AS MATERIALIZED (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i,
         count(*) OVER (PARTITION BY source) AS n
  FROM leaves
),
s0 AS (SELECT t, i, h, n FROM placed),
{tree('s')},
r0 AS (SELECT 0 AS t, t AS i, h, (SELECT count(*) FROM s{levels}) AS n FROM s{levels}),
{tree('r')},
s_start AS (SELECT *, '' AS proof FROM placed),
{climb('s', 's_start', 'b.t', 'b.i')},
{climb('r', f'sc{levels}', '0', 'b.t')}
SELECT b.doc_id, b.h AS leaf, s.h AS subroot, r.h AS root, sha256(b.proof) AS proof_sha256,
       b.f AS folded_root, b.f = r.h AS verified, b.source
FROM rc{levels} b JOIN s{levels} s ON s.t = b.t CROSS JOIN r{levels} r"""
