"""DuckDB SQL of the numbered queries that SQL can express."""

from __future__ import annotations

from docweave.llm import quality as Q

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _reach(ids: str, links: str) -> str:
    """CTEs after ``links`` (a, b): ``near`` (id, component_id) for the ids of a query."""
    return f"""
    e AS (SELECT a, b FROM {links} UNION ALL SELECT b, a FROM {links}),
    r AS (SELECT id, id AS reach FROM ({ids}) UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach),
    near AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id)"""


VECTOR_DEDUP = f"""
    WITH RECURSIVE v AS (
      SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.e) = len(y.e)
          WHERE list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e)) / sqrt(list_dot_product(y.e, y.e)) >= 0.98),
    {_reach("SELECT vec_id AS id FROM embeddings", "l")},
    k AS (SELECT a, count(*) AS n FROM e GROUP BY a)
    SELECT id AS vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, id = component_id AS kept FROM near LEFT JOIN k ON k.a = near.id"""

SUBSTRING_DEDUP = f"""
    WITH p AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
    win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM p, unnest(range(1, len(ws) - 48)) AS u(i)),
    f AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
    gone AS (SELECT DISTINCT doc_id, i + j AS at FROM win JOIN f USING (h), unnest(range(0, 50)) AS u(j) WHERE m < doc_id),
    w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS at FROM p),
    k AS (SELECT w.doc_id, count(*) AS n, count(gone.at) AS removed, string_agg(word, ' ' ORDER BY w.at) FILTER (WHERE gone.at IS NULL) AS kept
          FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.at = w.at GROUP BY w.doc_id)
    SELECT p.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM p LEFT JOIN k USING (doc_id)"""

JACCARD_JOIN = f"""
    WITH RECURSIVE p AS (SELECT doc_id, {_WORDS.format(text=f"translate(coalesce(text, ''), '{_A}', '{_Z}')")} AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM p, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS u(i) WHERE len(ws) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
    l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
    {_reach("SELECT doc_id AS id FROM documents", "l")}
    SELECT id AS doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM near LEFT JOIN n ON n.doc_id = near.id"""

_ESC = r"replace(replace(replace({x}, '\', '\b'), '###', '\h'), '</turn>', '\t')"

CHAT_FORMAT = rf"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
    g AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS all_turns,
                 coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
                 sum(4 + length(replace({_ESC.format(x="role")}, ':', '\c')) + 2 + length({_ESC.format(x="text")}) + 8) AS size FROM t GROUP BY conv_id)
    SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(all_turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
           sha256(loss) AS loss_sha256, CAST(size AS BIGINT) AS formatted_chars FROM g"""


def _quality() -> str:
    left, steps, counts = "rest0", [], ["length(joined) - length(rest0)"]
    for i, pattern in enumerate(Q.CLASSES.values(), 1):
        steps.append(f"c{i} AS (SELECT *, regexp_replace({left}, '{pattern.replace(chr(39), chr(39) * 2)}+', '', 'g') AS rest{i} FROM c{i - 1})")
        counts.append(f"length({left}) - length(rest{i})")
        left = f"rest{i}"
    counts.append(f"length({left})")
    langs = " ".join(f"WHEN '{lang}' THEN {words!r}" for lang, words in Q.COMMON_WORDS.items())
    js = lambda a, b: (
        f"CASE WHEN list_sum({a}) > 0 AND list_sum({b}) > 0 THEN sqrt(greatest(0.0, list_sum(list_transform(range(1, len({a}) + 1), lambda i: "
        f"({_part(f'({a}[i] / list_sum({a}))', f'({b}[i] / list_sum({b}))')} + {_part(f'({b}[i] / list_sum({b}))', f'({a}[i] / list_sum({a}))')}) / 2)))) END")
    n_class, n_word = len(counts), len(Q.COMMON_WORDS["en"]) + 1
    sums = lambda name, n: "[" + ", ".join(f"sum({name}[{i}])" for i in range(1, n + 1)) + "]"
    symbol = 2 + list(Q.CLASSES).index("symbol")
    return rf"""
    WITH p AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
    c0 AS (SELECT *, array_to_string(ws, '') AS joined, regexp_replace(array_to_string(ws, ''), '[a-z]+', '', 'g') AS rest0,
                  CASE lang {langs} END AS names, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM p),
    {", ".join(steps)},
    h0 AS (SELECT *, list_transform([{", ".join(counts)}], lambda x: CAST(x AS DOUBLE)) AS classes,
                  list_transform(names, lambda x: CAST(len(list_filter(ws, lambda y: y = x)) AS DOUBLE)) AS found FROM c{len(Q.CLASSES)}),
    h AS (SELECT *, list_append(found, len(ws) - list_sum(found)) AS common FROM h0),
    ref AS (SELECT lang, {sums("classes", n_class)} AS rc, {sums("common", n_word)} AS rw FROM h WHERE names IS NOT NULL GROUP BY lang),
    tri AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS g FROM p, unnest(range(1, len(ws) - 1)) AS u(i)),
    twice AS (SELECT doc_id, g FROM tri GROUP BY doc_id, g HAVING count(*) > 1),
    held AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM tri JOIN twice USING (doc_id, g), unnest([0, 1, 2]) AS u(j) GROUP BY doc_id),
    f AS (SELECT h.*, coalesce(held.n, 0) AS repeated, len(ws) < 50 OR 100 * coalesce(held.n, 0) > 50 * len(ws) AS failed,
                 CASE WHEN length(joined) >= {Q.MIN_CHARS_COMPARED} THEN {js("classes", "rc")} END AS cd,
                 CASE WHEN len(ws) >= {Q.MIN_WORDS_COMPARED} THEN {js("common", "rw")} END AS wd
          FROM h LEFT JOIN ref ON ref.lang = h.lang LEFT JOIN held ON held.doc_id = h.doc_id)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(joined) AS BIGINT) AS word_chars, CAST(classes[{symbol}] AS BIGINT) AS n_symbols,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(repeated AS BIGINT) AS n_repeat_words, failed AS base_failed,
           NOT failed AND coalesce(cd, 0) <= {Q.MAX_CLASS_DISTANCE} AND coalesce(wd, 0) <= {Q.MAX_WORD_DISTANCE} AS kept FROM f"""


def _part(p: str, q: str) -> str:
    return f"CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0.0 END"


COLLOCATIONS = rf"""
    WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_A}', '{_Z}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    p AS (SELECT row_number() OVER () AS id, lang, piece FROM t),
    w AS (SELECT id, lang, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM (SELECT id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p)),
    g AS (SELECT lang, w1, lead(w1, 1) OVER (PARTITION BY id ORDER BY i) AS w2, lead(w1, 2) OVER (PARTITION BY id ORDER BY i) AS w3 FROM w),
    f AS MATERIALIZED (
      SELECT lang, 1 AS words, w1 AS phrase, count(*) AS n FROM g GROUP BY lang, w1
      UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM g WHERE w2 IS NOT NULL GROUP BY lang, w1, w2
      UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM g WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3),
    c AS (SELECT lang, words, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE words > 1 AND n >= 10),
    key AS MATERIALIZED (SELECT lang || chr(10) || phrase AS key, n FROM f),
    cut AS MATERIALIZED (SELECT c.*, k, lang || chr(10) || array_to_string(ws[1:k], ' ') AS lk, lang || chr(10) || array_to_string(ws[k + 1:], ' ') AS rk FROM c, unnest(range(1, words)) AS u(k)),
    left_n AS MATERIALIZED (SELECT cut.*, key.n AS l FROM cut JOIN key ON key.key = lk),
    s AS (SELECT lang, words, phrase, a, k, l, key.n AS r, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * key.n) AS BIGINT) AS score FROM left_n JOIN key ON key.key = rk),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inside AS (SELECT lang, a AS longer, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM c WHERE words = 3),
    gone AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN inside USING (lang, phrase) WHERE 100 * longer >= 50 * a),
    total AS (SELECT lang, sum(n) AS n FROM f WHERE words = 1 GROUP BY lang),
    o AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b ANTI JOIN gone USING (lang, phrase))
    SELECT lang, rank, phrase, a, l, r, CAST(total.n AS BIGINT) AS n, score FROM o JOIN total USING (lang) WHERE rank <= 2000"""

_BYTE = "list_reduce([{c}, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
_CRC32 = f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
            lambda crc, d: {_BYTE.format(c="xor(crc, d)")}))"""

PERIODIC_RUNS = f"""
    WITH h AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws, {_CRC32} AS h FROM documents),
    g AS (SELECT doc_id, ws, len(ws) AS n, h, h // 10 AS g, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM h),
    p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
    w AS (SELECT doc_id, i, CASE WHEN h % 10 = 0 AND i >= a THEN ws[1 + a + (i - a) % p] ELSE ws[1 + i] END AS word, n FROM p, unnest(range(0, n)) AS u(i)),
    eq AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
    island AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length
               FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM eq) GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
    run AS (SELECT doc_id, start, length, min(q) AS q FROM island GROUP BY doc_id, start, length),
    best AS (SELECT doc_id, count(*) AS n_runs, min((-length, start, q)) AS b, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM run GROUP BY doc_id),
    gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM run),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT documents.doc_id, coalesce(n_runs, 0) AS n_runs, b[2] AS start, -b[1] AS length, b[3] AS period, 1000 * -b[1] // b[3] AS exponent_milli,
           sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
    FROM documents LEFT JOIN best ON best.doc_id = documents.doc_id LEFT JOIN kept ON kept.doc_id = documents.doc_id"""

ORACLE = {
    "op2_vector_dedup": VECTOR_DEDUP,
    "op3_substring_dedup": SUBSTRING_DEDUP,
    "op4_quality_rules": _quality(),
    "op6_chat_format": CHAT_FORMAT,
    "op9_jaccard_join": JACCARD_JOIN,
    "op12_periodic_runs": PERIODIC_RUNS,
    "op13_collocations": COLLOCATIONS,
}
