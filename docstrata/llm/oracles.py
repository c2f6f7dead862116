"""DuckDB SQL for the queries that SQL expresses."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
r AS (SELECT doc_id, i FROM g WHERE k IN (SELECT k FROM g GROUP BY k HAVING count(*) > 1)),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
c AS (
  SELECT x.doc_id, word, p,
         coalesce(p - max(r.i) OVER (PARTITION BY x.doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) < 35, false) AS gone
  FROM x LEFT JOIN r ON r.doc_id = x.doc_id AND r.i = x.p)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(s.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(s.kept, '')) AS kept_sha256
FROM w LEFT JOIN (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept
  FROM c GROUP BY doc_id) s USING (doc_id)
"""


def op5() -> str:
    """Base figures from words and lines, cutoffs from the labels as the operator chooses them."""
    from docstrata.llm.quality import DELTA, RISK, RULES, STEPS

    figures = ", ".join(f"{sign} * {sql.split(' / ')[0]} / nullif(CAST({sql.split(' / ')[1]} AS DOUBLE), 0) AS f_{r}" for r, (sql, sign, _) in RULES.items())
    steps = "least(" + ", ".join("CASE " + " ".join(f"WHEN f_{r} > {sign * cut} THEN {STEPS.index((r, k))}" for k, cut in enumerate(cuts)) + " END" for r, (_, sign, cuts) in RULES.items()) + ")"
    cut = {r: "CASE " + " ".join(f"WHEN step >= {STEPS.index((r, k))} THEN {c}" for k, c in reversed(list(enumerate(cuts)))) + " END" for r, (_, _, cuts) in RULES.items()}
    strict = " OR ".join(f"coalesce(f_{r} > {sign} * ({cut[r]}), false)" for r, (_, sign, _) in RULES.items())
    return rf"""
WITH w AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, {WORDS} AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1),
rep AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
b AS (
  SELECT w.doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)),
m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {figures} FROM b),
marks AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT lang AS stratum, {steps} AS step, good FROM m JOIN marks USING (doc_id) WHERE NOT base_failed),
sizes AS (SELECT stratum, count(*) FILTER (WHERE good = 1) AS n, count(*) OVER () AS strata FROM held GROUP BY stratum),
tests AS (
  SELECT h.stratum, step, n, strata, sum(lost) OVER s AS lost, sum(caught) OVER s AS caught
  FROM (SELECT stratum, step, count(*) FILTER (WHERE good = 1) AS lost, count(*) FILTER (WHERE good = 0) AS caught FROM held WHERE step IS NOT NULL GROUP BY ALL) h
  JOIN sizes z ON h.stratum IS NOT DISTINCT FROM z.stratum
  WINDOW s AS (PARTITION BY h.stratum ORDER BY step)),
safe AS (
  SELECT *, min(CAST(lost <= {RISK} * n AND p <= {DELTA} / strata AS INT)) OVER (PARTITION BY stratum ORDER BY step) AS ok
  FROM (SELECT *, (SELECT sum(exp(lgamma(t.n + 1) - lgamma(i + 1) - lgamma(t.n - i + 1) + i * ln({RISK}) + (t.n - i) * ln(1 - {RISK})))
                   FROM (SELECT unnest(range(0, CAST(t.lost AS BIGINT) + 1)) AS i)) AS p FROM tests t)),
best AS (SELECT stratum, arg_max(step, caught * 100 - step) AS step FROM safe WHERE ok = 1 AND caught > 0 GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({strict}) AS kept, n_lines
FROM m LEFT JOIN best b ON b.stratum IS NOT DISTINCT FROM m.lang
"""

#: crc32 as DuckDB macros: of a list of bytes, and of an ASCII string
CRC = "xor(list_reduce({bytes}, lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1))), 4294967295::BIGINT), 4294967295)"


def crc_of_ascii(text: str) -> str:
    return CRC.format(bytes=f"list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))")


def op11(levels: int = 12) -> str:
    """Trees of up to 3 ** levels leaves, level by level, by source and then over the sources."""
    field = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
    cut = "replace(text, chr(10), '')"
    before = " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    ctes, sides = [], []
    for tree, top in (("s", "k"), ("t", "k")):
        for n in range(levels):
            ctes.append(f"{tree}{n + 1} AS (SELECT k, i // 3 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h, (any_value(n) + 2) // 3 AS n FROM {tree}{n} GROUP BY k, i // 3)")
        if tree == "s":
            ctes.append(f"t0 AS (SELECT 0 AS k, row_number() OVER (ORDER BY k) - 1 AS i, h, count(*) OVER () AS n, k AS source FROM s{levels})")
    joins = []
    for tree, own, k in (("s", "l.i", "l.k"), ("t", "u.i", "0")):
        for n in range(levels):
            a = f"{tree}{n}"
            at = f"({own} // {3**n})"
            for j in range(3):
                joins.append(f"LEFT JOIN {a} {a}_{j} ON {a}_{j}.k = {k} AND {a}_{j}.i = {at} // 3 * 3 + {j} AND {a}_{j}.n > 1")
            sides.append(([f"CASE WHEN {at} % 3 > {j} THEN coalesce({a}_{j}.h, '') ELSE '' END" for j in range(2)], [f"CASE WHEN {at} % 3 < {j} THEN coalesce({a}_{j}.h, '') ELSE '' END" for j in (1, 2)], f"({a}_0.h IS NOT NULL)"))
    proof = " || ".join(" || ".join(left + right) for left, right, _ in sides)
    folds = [f"f0 AS (SELECT p.*, coalesce(tampered, leaf) AS f FROM p)"]
    for n in range(2 * levels):
        folds.append(f"f{n + 1} AS (SELECT * REPLACE (CASE WHEN sides[{n + 1}].b THEN sha256(sides[{n + 1}].l || f || sides[{n + 1}].r) ELSE f END AS f) FROM f{n})")
    pairs = ", ".join(f"{{'l': {' || '.join(left)}, 'r': {' || '.join(right)}, 'b': {there}}}" for left, right, there in sides)
    return f"""
WITH d AS (
  SELECT doc_id, source, sha256({before} || {field.format("text")}) AS leaf,
         CASE WHEN {crc_of_ascii("doc_id::VARCHAR")} % 2 = 0 THEN sha256({before} || {field.format(cut)}) END AS tampered
  FROM documents),
g AS (SELECT source, CAST(row_number() OVER (ORDER BY source NULLS FIRST) AS BIGINT) AS k FROM (SELECT DISTINCT source FROM documents)),
l AS (SELECT d.*, g.k, row_number() OVER (PARTITION BY g.k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g.k) AS n
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
s0 AS (SELECT k, i, leaf AS h, n FROM l), {", ".join(ctes)},
p AS (SELECT l.doc_id, leaf, tampered, u.h AS subroot, (SELECT h FROM t{levels}) AS root, sha256({proof}) AS proof_sha256, [{pairs}] AS sides
      FROM l JOIN t0 u ON u.source = l.k {" ".join(joins)}),
{", ".join(folds)}
SELECT doc_id, leaf, subroot, root, proof_sha256, f AS folded_root, f = root AS verified FROM f{2 * levels}
"""

_PLAIN = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BYTES = "list_transform(range(0, len(hex(w)) // 2), lambda k: CAST('0x' || substr(hex(w), CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT))"
OP13 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_PLAIN} AS ws FROM documents),
f AS (SELECT r, unnest(ws) AS w FROM d),
e AS (SELECT unnest(ws) AS w FROM (SELECT {_PLAIN} AS ws FROM benchmark)),
b AS (SELECT w, {CRC.format(bytes=_BYTES)} % 10000 AS b FROM (SELECT w FROM f UNION SELECT w FROM e)),
s AS (SELECT b, count(*) AS s FROM f JOIN b USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM e JOIN b USING (w) GROUP BY b),
n AS (SELECT (SELECT count(*) FROM f)::DOUBLE AS s, (SELECT count(*) FROM e)::DOUBLE AS t),
g AS (SELECT s.b, CAST(floor(1000 * ln((coalesce(t.t, 0) + 1.0)::DOUBLE * (n.s + 10000) / ((s.s + 1.0)::DOUBLE * (n.t + 10000)))) AS BIGINT) AS g
      FROM s LEFT JOIN t ON s.b = t.b CROSS JOIN n),
w AS (SELECT d.doc_id, d.r, CAST(len(ws) AS BIGINT) AS n_features, CAST(coalesce(floor(x.g / len(ws)), 0) AS BIGINT) AS weight
      FROM d LEFT JOIN (SELECT r, sum(g) AS g FROM f JOIN b USING (w) JOIN g USING (b) GROUP BY r) x USING (r)),
c AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k, count(*) FILTER (WHERE n_features >= 20) OVER () AS n FROM c)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= 10 * n // 100 THEN k END AS rank, n_features AS n_words FROM k
"""

_BASE32 = "array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(hexed, CAST(5 * g + 1 AS BIGINT), 5) AS BIGINT) >> s) & 31) + 1 AS BIGINT), 1)), '')), '')"
OP7 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hexed FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM m
"""

OP9 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
o AS (SELECT * FROM v WHERE len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM o a JOIN o b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
