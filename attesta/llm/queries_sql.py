"""DuckDB SQL of the longer queries, written apart from their operators."""

from __future__ import annotations

from attesta.llm.personal_data import BASE, KINDS, PATTERNS

_BASE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_HOLDS = {
    "email": "true",
    "ip": "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 "
          "OR coalesce(TRY_CAST(ltrim(p, '0') AS INT), 0) > 255)) = 0",
    "card": f"length({_DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda d, i: "
            "CASE WHEN i % 2 = 1 THEN d::INT ELSE (2 * d::INT) // 10 + (2 * d::INT) % 10 END)) % 10 = 0",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
    "iban": "list_reduce(list_prepend(0, list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''), "
            "lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c) - 55 END)), "
            "lambda r, v: (r * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1",
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _found(nth: int, kind: str, pattern: str) -> str:
    """Matches of one pattern with their places: the lengths of what lies between, and of the matches before."""
    return f"""SELECT doc_id, {nth} AS nth, '{kind}' AS kind, m, i, list_sum(list_transform(gaps[:i], lambda g: length(g)))::BIGINT
           + coalesce(list_sum(list_transform(hits[:i - 1], lambda h: length(h))), 0)::BIGINT AS a, t
    FROM (SELECT doc_id, t, gaps, hits, unnest(hits) AS m, generate_subscripts(hits, 1) AS i
          FROM (SELECT doc_id, t, regexp_extract_all(t, {_quoted(pattern)}) AS hits,
                       regexp_split_to_array(t, {_quoted(pattern)}) AS gaps FROM d))"""


def _score(kind: str) -> str:
    own, up, down = KINDS[kind]
    some = lambda words: f"list_has_any(near, {list(words)!r})" if words else "false"
    return f"WHEN '{kind}' THEN {own} + CASE WHEN {some(up)} THEN 30 ELSE 0 END - CASE WHEN {some(down)} THEN 30 ELSE 0 END"


_ALL = {**_BASE_PATTERNS, **PATTERNS}
PERSONAL_DATA = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({' UNION ALL '.join(_found(n, k, p) for n, (k, p) in enumerate(_ALL.items()))}),
held AS (SELECT doc_id, nth, kind, a, a + length(m) AS b,
                regexp_extract_all(translate(substr(t, greatest(a - 39, 1), a - greatest(a - 39, 1) + 1) || '|' || substr(t, a + length(m) + 1, 40),
                                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+') AS near,
                (a > 0 AND regexp_matches(substr(t, a, 1), '[A-Za-z0-9]')) OR regexp_matches(substr(t, a + length(m) + 1, 1), '[A-Za-z0-9]') AS inside
         FROM found WHERE CASE kind {' '.join(f"WHEN '{k}' THEN {c}" for k, c in _HOLDS.items())} ELSE true END),
judged AS (SELECT *, CASE kind {' '.join(_score(k) for k in _ALL)} END AS score FROM held),
base AS (SELECT * FROM judged WHERE nth < {len(BASE)}),
kept AS (SELECT doc_id, nth, kind, a, b FROM base
         UNION ALL SELECT doc_id, nth, kind, a, b FROM judged j WHERE nth >= {len(BASE)} AND NOT inside AND score >= 50
           AND NOT EXISTS (SELECT 1 FROM base x WHERE x.doc_id = j.doc_id AND x.a < j.b AND j.a < x.b)),
per AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
               coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY nth, a) FILTER (nth < {len(BASE)}), '') AS base,
               string_agg(kind || ':' || a || ':' || b, ',' ORDER BY nth, a) AS spans FROM kept GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans FROM d LEFT JOIN per USING (doc_id)"""

_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_HEAD = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
# the checksum's polynomial, bit by bit over the digits of the id
_CRC = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), "
        "lambda r, b: list_reduce(list_prepend(xor(r, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), "
        "lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)")

WITNESSES = f"""
WITH RECURSIVE doc AS (
    SELECT doc_id, source, sha256({_HEAD} || {_FIELD.format('text')}) AS leaf,
           CASE WHEN {_CRC} % 2 = 0 THEN sha256({_HEAD} || {_FIELD.format("replace(text, chr(10), '')")})
                ELSE sha256({_HEAD} || {_FIELD.format('text')}) END AS given FROM documents),
tree AS (
    SELECT 0 AS lvl, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, leaf AS digest,
           count(*) OVER (PARTITION BY source) AS n FROM doc
    UNION ALL
    SELECT lvl + 1, source, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM tree WHERE n > 1
    GROUP BY lvl, source, pos // 3, n),
sub AS (SELECT source, digest FROM tree WHERE n = 1),
top AS (
    SELECT 0 AS lvl, row_number() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS pos, digest, count(*) OVER () AS n FROM sub
    UNION ALL
    SELECT lvl + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY lvl, pos // 3, n),
runs AS (SELECT lvl, source, pos // 3 AS run, list(digest ORDER BY pos) AS ds FROM tree WHERE n > 1 GROUP BY ALL),
top_runs AS (SELECT lvl, pos // 3 AS run, list(digest ORDER BY pos) AS ds FROM top WHERE n > 1 GROUP BY ALL),
walk AS (
    SELECT 0 AS lvl, doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, given AS node, '' AS sibs FROM doc
    UNION ALL
    SELECT w.lvl + 1, doc_id, w.source, pos // 3,
           sha256(array_to_string(ds[:pos % 3], '') || node || array_to_string(ds[pos % 3 + 2:], '')),
           sibs || array_to_string(ds[:pos % 3], '') || array_to_string(ds[pos % 3 + 2:], '')
    FROM walk w JOIN runs r ON r.lvl = w.lvl AND r.source IS NOT DISTINCT FROM w.source AND r.run = w.pos // 3),
up AS (SELECT doc_id, source, node, sibs FROM walk QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY lvl DESC) = 1),
placed AS (SELECT source, row_number() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS spot FROM sub),
climb AS (
    SELECT 0 AS lvl, doc_id, spot AS pos, node, sibs FROM up JOIN placed ON up.source IS NOT DISTINCT FROM placed.source
    UNION ALL
    SELECT c.lvl + 1, doc_id, pos // 3, sha256(array_to_string(ds[:pos % 3], '') || node || array_to_string(ds[pos % 3 + 2:], '')),
           sibs || array_to_string(ds[:pos % 3], '') || array_to_string(ds[pos % 3 + 2:], '')
    FROM climb c JOIN top_runs r ON r.lvl = c.lvl AND r.run = c.pos // 3),
ends AS (SELECT doc_id, node, sibs FROM climb QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY lvl DESC) = 1)
SELECT doc.doc_id, leaf, sub.digest AS subroot, whole.digest AS root, sha256(sibs) AS proof_sha256, node AS folded_root,
       node = whole.digest AS verified
FROM doc JOIN sub ON doc.source IS NOT DISTINCT FROM sub.source JOIN ends USING (doc_id)
JOIN (SELECT digest FROM top WHERE n = 1) whole ON true"""

_TERMS = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

RANKED = f"""
WITH said AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM said GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY 1),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM n),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
      FROM tf, whole WHERE term IN (SELECT term FROM asked) GROUP BY term),
m AS (SELECT doc_id, 50 + (50 * n * docs) // len AS m FROM n, whole),
scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
           FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50"""
