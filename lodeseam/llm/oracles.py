"""SQL that must give the rows of a query, for those that SQL can express over whole tables."""

OP4 = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ') ELSE array_to_string(words[i:i + 4], ' ') END AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM o JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT l.v, r.seen FROM r JOIN l ON l.u = r.node)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.low, documents.doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(seen) AS low FROM r GROUP BY node) m USING (doc_id)"""

OP10 = r"""WITH m AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, coalesce(text, '') AS text FROM conversations),
u AS (SELECT conv_id, turn, min(text) AS text, conv_id || ':' || turn AS call_id FROM m WHERE role = 'user' GROUP BY ALL),
c AS (SELECT u.*, p.call_id AS after, row_number() OVER (PARTITION BY u.conv_id ORDER BY u.turn) - 1 AS position FROM u LEFT JOIN u p ON p.conv_id = u.conv_id AND p.turn = u.turn - 2),
a AS (SELECT conv_id, turn, text, CASE WHEN role = 'assistant' THEN conv_id || ':' || (turn - 1) END AS call_id FROM m WHERE role <> 'user'),
f AS (SELECT call_id, count(*) AS n_results, min((turn, text, conv_id)) AS r FROM a WHERE call_id IS NOT NULL GROUP BY call_id),
j AS (SELECT coalesce(c.conv_id, r[3]) AS conv_id, coalesce(c.call_id, f.call_id) AS call_id, c.turn, c.position, CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN n_results IS NULL THEN 'pending' ELSE 'linked' END AS status, coalesce(n_results, 0) AS n_results, r[1] AS result_turn, r[2] AS result, CASE WHEN c.call_id IS NOT NULL THEN 'reply' END AS name, c.text, c.after FROM c FULL JOIN f ON c.call_id = f.call_id
UNION ALL SELECT conv_id, NULL, NULL, NULL, 'orphan', 1, turn, text, NULL, NULL, NULL FROM a WHERE call_id IS NULL)
SELECT conv_id, call_id, turn, position, status, n_results, result_turn, name IS NOT NULL AS valid,
'{"arguments":' || CASE WHEN name IS NULL THEN 'null' ELSE '{' || CASE WHEN after IS NULL THEN '' ELSE '"after":' || to_json(after) || ',' END || '"prompt":' || to_json(text) || ',"turn":' || turn || '}' END || ',"id":' || coalesce(to_json(call_id)::VARCHAR, 'null') || ',"name":' || coalesce(to_json(name)::VARCHAR, 'null') || ',"result":' || coalesce(to_json(result)::VARCHAR, 'null') || '}' AS json FROM j"""

FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LICENSE_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def license_sql() -> str:
    """Phrases by word slices, templates by list intersection with every block."""
    from lodeseam.llm.licenses import CONTAINMENT, PHRASES, TEMPLATES

    words = lambda text: "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(text.split())) + "]"
    phrases = ", ".join(f"({words(p)}, '{label}')" for p, label in PHRASES.items())
    templates = ", ".join(f"({words(t)}, '{label}')" for t, label in TEMPLATES.items())
    return rf"""WITH d AS (SELECT doc_id, {FOLD} AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, {LICENSE_WORD}) AS words FROM d),
ph AS (SELECT * FROM (VALUES {phrases}) AS v(own, label)), tp AS (SELECT * FROM (VALUES {templates}) AS v(own, label)),
spots AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w),
pl AS (SELECT doc_id, label, i - 1 AS place FROM spots JOIN ph ON words[i:i + len(own) - 1] = own),
b AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(t, '([.!?;])[ \t\n\x0B\f\r]+', '\1' || chr(10), 'g'), '\n+')) AS block FROM d),
s AS (SELECT doc_id, list_distinct(regexp_extract_all(block, {LICENSE_WORD})) AS had FROM b),
mt AS (SELECT doc_id, label, len(list_intersect(had, own)) / len(own)::DOUBLE AS c FROM s JOIN tp ON len(had) > 0 AND len(list_intersect(had, own)) >= ceil({CONTAINMENT} * len(own) - 1e-9)),
ps AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM pl GROUP BY doc_id),
ms AS (SELECT doc_id, max(c) AS score FROM mt GROUP BY doc_id),
ls AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM pl UNION ALL SELECT doc_id, label FROM mt) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM w LEFT JOIN ps USING (doc_id) LEFT JOIN ms USING (doc_id) LEFT JOIN ls USING (doc_id)"""


#: Plain patterns of each kind and the condition on a match `x` with digits `n`.
PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_max(list_transform(string_split(x, '.'), lambda p: p::HUGEINT)) <= 255"),
    "card": (r"[0-9](?:[ -]?[0-9])+", "len(n) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, len(n) + 1), lambda k: CASE WHEN k % 2 = 1 THEN n[-k]::INTEGER ELSE n[-k]::INTEGER * 2 // 10 + n[-k]::INTEGER * 2 % 10 END)) % 10 = 0"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "len(n) BETWEEN 10 AND 15"),
    "iban": (
        r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b",
        "len(replace(x, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr(replace(x, ' ', ''), 5) || substr(x, 1, 4), ''), lambda c: CASE WHEN ascii(c) < 58 THEN ascii(c) - 48 ELSE ascii(c) - 55 END::BIGINT)), lambda a, c: (a * (CASE WHEN c > 9 THEN 100 ELSE 10 END) + c) % 97) = 1",
    ),
}


def pii_sql() -> str:
    """Matches and the gaps between them give the offsets; conditions as in the contract."""
    from lodeseam.llm.pii import CONTEXT_CHARS, KINDS

    parts = []
    for order, kind in enumerate(KINDS):
        pattern, ok = PII[kind.name]
        near = rf"regexp_matches(right(g[i], {CONTEXT_CHARS}) || ' ' || left(g[i + 1], {CONTEXT_CHARS}), '(?i){kind.words}')"
        score = f"CASE WHEN {near} THEN {min(1.0, kind.score + 0.1)!r} ELSE {kind.score!r} END"
        cut = f"SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d"
        each = f"SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM ({cut}) WHERE len(m) > 0"
        from_ = "(list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0))::BIGINT"
        named = f"SELECT doc_id, m[i] AS x, regexp_replace(m[i], '[^0-9]', '', 'g') AS n, {from_} AS a, {score} AS score FROM ({each})"
        parts.append(f"SELECT doc_id, {order} AS o, '{kind.name}' AS kind, a, a + length(x) AS b, score::DOUBLE AS score FROM ({named}) WHERE {ok}")
    base = [k.name for k in KINDS if k.base]
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in base)
    listed = lambda which: f"coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o){which}, '')"
    named = ", ".join(f"'{k}'" for k in base)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({" UNION ALL ".join(parts)}),
p AS (SELECT doc_id, {counts}, sha256({listed(f" FILTER (kind IN ({named}))")}) AS base_sha256, {listed("")} AS spans, max(score) AS top_score FROM s GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in base)}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(top_score, 0.0)::DOUBLE AS top_score FROM d LEFT JOIN p USING (doc_id)"""
