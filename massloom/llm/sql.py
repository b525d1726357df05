"""DuckDB SQL of the queries that SQL can express, over whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_FOLD)} AS words FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(words) < 3 THEN array_to_string(words, ' ') ELSE array_to_string(words[k:k + 2], ' ') END AS shingle
FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 2) + 1)) AS k FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, t.b FROM reach r JOIN both_ways t ON r.b = t.a),
c AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c.low, w.doc_id)) AS component_id, coalesce(c.low, w.doc_id) >= w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
v AS (SELECT doc_id, k, array_to_string(words[k:k + 49], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS k FROM w WHERE len(words) >= 50)),
f AS (SELECT win, min(doc_id) AS first FROM v GROUP BY 1),
g AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS p FROM v JOIN f USING (win) WHERE first < doc_id),
x AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
y AS (SELECT x.doc_id, count(*) AS n_words, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY x.p) FILTER (WHERE g.p IS NULL) AS kept FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.p = g.p GROUP BY 1)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN y USING (doc_id)"""

_ALNUM = f"regexp_extract_all({_FOLD}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS words FROM documents), i AS (SELECT item_id, {_ALNUM} AS words FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(words)) AS n, array_to_string(words[k:k + 12], ' ') AS win FROM (SELECT item_id, words, unnest(range(1, greatest(1, len(words) - 12) + 1)) AS k FROM i WHERE len(words) > 0)),
dw AS (SELECT doc_id, k, n, array_to_string(words[k:k + n - 1], ' ') AS win FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(words) >= n)),
m AS (SELECT DISTINCT doc_id, k, n, item_id FROM dw JOIN iw USING (win, n)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS sha FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

TOP_K = f"""
WITH v AS (SELECT vec_id, row_number() OVER () AS place, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS own FROM embeddings WHERE {_FINITE}),
p AS (SELECT q.place, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.own, c.own), lambda z: z[1] * z[2])) AS BIGINT) AS score
FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM p) WHERE rank <= 5"""


def vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS id, vec_id, label,
list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS own FROM embeddings WHERE {_FINITE})""",
        f"x AS MATERIALIZED (SELECT id, (k - 1) // (len(own) // {parts}) AS part, (k - 1) % (len(own) // {parts}) AS place, own[k] AS x FROM (SELECT id, own, unnest(range(1, len(own) + 1)) AS k FROM v))",
        f"b0 AS MATERIALIZED (SELECT part, id - 1 AS entry, place, x AS c FROM x WHERE id <= {entries})",
    ]
    for k in range(rounds + 1):
        steps.append(f"d{k} AS (SELECT id, part, entry, CAST(sum((x - c) * (x - c)) AS BIGINT) AS far FROM x JOIN b{k} USING (part, place) GROUP BY ALL)")
        steps.append(f"a{k} AS MATERIALIZED (SELECT id, part, entry, far FROM d{k} QUALIFY row_number() OVER (PARTITION BY id, part ORDER BY far, entry) = 1)")
        if k < rounds:
            steps.append(f"m{k} AS (SELECT part, entry, place, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{k} USING (id, part) GROUP BY ALL)")
            # // rounds to zero
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT part, entry, place, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM b{k} LEFT JOIN m{k} USING (part, entry, place))")
    steps.append(f"r AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{rounds} GROUP BY 1)")
    steps.append(f"h AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, place)) AS sha FROM b{rounds})")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM v JOIN r USING (id), h"


def _crc32(text: str) -> str:
    """CRC-32 of a text of code points below 2048, bit by bit for the tables of bytes."""
    table = []
    for k in range(256):
        for _ in range(8):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        table.append(k)
    of_bytes = f"flatten(list_transform(string_split({text}, ''), lambda z: CASE WHEN unicode(z) < 128 THEN [unicode(z)] ELSE [192 + (unicode(z) >> 6), 128 + (unicode(z) & 63)] END))"
    step = f"xor(c >> 8, ({table})[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_transform({of_bytes}, lambda z: CAST(z AS BIGINT)), lambda c, b: {step}, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"


def spelling_variants() -> str:
    return f"""
WITH RECURSIVE o AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{_UPPER}', '{_LOWER}') AS run FROM documents),
u AS MATERIALIZED (SELECT doc_id, run, count(*) AS times FROM o WHERE length(run) >= 6 GROUP BY ALL),
c AS (SELECT run, times, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM u),
e AS (SELECT CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, times FROM c),
w AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM e GROUP BY 1 HAVING length(word) >= 6 AND sum(times) >= 5),
k AS MATERIALIZED (SELECT word, n, spot, word[1:spot - 1] || word[spot + 1:] AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS spot FROM w)),
p AS (SELECT a.word AS a, a.n AS na, b.word AS b, b.n AS nb FROM k a JOIN k b ON a.spot = b.spot AND a.less = b.less AND a.word < b.word
UNION SELECT a.word, a.n, b.word, b.n FROM w a JOIN k b ON a.word = b.less),
t AS (SELECT a AS word, na AS own, b AS near, nb AS n FROM p UNION ALL SELECT b, nb, a, na FROM p),
g AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS near, max(n) AS most, any_value(own) AS own FROM t GROUP BY 1),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * own THEN near END AS form, CASE WHEN most >= 5 * own THEN most END AS form_n FROM w LEFT JOIN g USING (word)),
r AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL),
z AS (SELECT r.word, r.root FROM r JOIN f ON f.word = r.root WHERE f.form IS NULL)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN z USING (word)"""
