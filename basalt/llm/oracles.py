"""SQL (DuckDB) for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .collocations import LEAST, MAX_N, TOP, UNKNOWN
from .jaccard import THRESHOLD as SIMILAR
from .lexical import K, LENGTH, SATURATION
from .quality import BUCKETS, MIN_WORDS, PRIOR_NGRAMS, SCALE, SMOOTHING, THRESHOLD

_WORDS = r"""
docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
arrays AS (SELECT rid, doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM docs),
ws AS (SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM arrays)"""

QUALITY = rf"""WITH {_WORDS},
win AS (SELECT rid, pos, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p || ' ' || lead(w, 3) OVER p || ' ' || lead(w, 4) OVER p AS g FROM ws WINDOW p AS (PARTITION BY rid ORDER BY pos)),
twice AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, g) AS n FROM win WHERE g IS NOT NULL) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT pos + k) AS n_repeat_words FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY rid),
base AS (SELECT a.rid, doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM arrays a LEFT JOIN rep r ON a.rid = r.rid),
crc AS (SELECT w, xor(list_reduce(list_transform(range(1, length(hex(encode(w))) // 2 + 1), lambda i: ('0x' || substr(hex(encode(w)), (2 * i - 1)::BIGINT, 2))::BIGINT),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM (SELECT DISTINCT w FROM ws)),
hs AS (SELECT rid, pos, h, lead(h) OVER (PARTITION BY rid ORDER BY pos) AS h2 FROM ws JOIN crc USING (w)),
grams AS (SELECT rid, h % {BUCKETS} AS b FROM hs UNION ALL SELECT rid, (h * 31 + h2 * 1000003 + 7) % {BUCKETS} FROM hs WHERE h2 IS NOT NULL),
trusted AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL),
counts AS (SELECT b, count(*) AS raw, count(t.doc_id) AS target FROM grams JOIN docs USING (rid) LEFT JOIN trusted t ON docs.doc_id = t.doc_id GROUP BY b),
sums AS (SELECT sum(raw)::DOUBLE AS raw_all, sum(target)::DOUBLE AS target_all FROM counts),
ratio AS (SELECT b, CASE WHEN target_all = 0 THEN 0 ELSE round(ln((target + {SMOOTHING}::DOUBLE) / (raw * target_all / raw_all + {SMOOTHING}::DOUBLE)) * {SCALE}) END::BIGINT AS v FROM counts, sums),
judged AS (SELECT rid, sum(v) AS s, count(*) AS n FROM grams JOIN ratio USING (b) GROUP BY rid),
failed AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(s, 0) >= {round(THRESHOLD * SCALE)} * (coalesce(n, 0) + {PRIOR_NGRAMS}) AS kept FROM failed LEFT JOIN judged USING (rid)"""

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to FROM f"""

JACCARD = rf"""WITH RECURSIVE {_WORDS},
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM arrays WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= {SIMILAR} * (x.n + y.n - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, (SELECT min(b) FROM reach WHERE a = doc_id) AS class_id, (SELECT count(*) FROM links WHERE a = doc_id) AS n_links FROM documents"""

COLLOCATIONS = rf"""WITH p AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
a AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM p),
m AS (SELECT unnest(range(1, {MAX_N} + 1)) AS k),
g AS (SELECT lang, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM a, m WHERE len(ws) >= k),
f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE k >= 2 AND f >= {LEAST}),
s AS (SELECT lang, ws, a, j, unnest(range(1, k - j + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS j FROM c)),
inside AS (SELECT lang, array_to_string(ws[i:i + j - 1], ' ') AS phrase, max(a) AS longer FROM s GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM kept),
parts AS (SELECT *, array_to_string(ws[:cut], ' ') AS lp, array_to_string(ws[cut + 1:], ' ') AS rp FROM cuts),
scored AS (SELECT p.lang, p.phrase, p.a, cut, x.f AS l, y.f AS r, (1000000::HUGEINT * p.a * p.a // (x.f::HUGEINT * y.f))::BIGINT AS score FROM parts p JOIN f x ON x.lang = p.lang AND x.phrase = lp JOIN f y ON y.lang = p.lang AND y.phrase = rp),
best AS (SELECT lang, phrase, a, l, r, score FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= {TOP}"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
LEXICAL = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS ts FROM documents),
i AS (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS ts FROM benchmark),
q AS (SELECT item, term, count(*) AS q FROM (SELECT item, unnest(ts) AS term FROM i) GROUP BY ALL),
sums AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
tf AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(ts) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, sums GROUP BY term, n_docs),
m AS (SELECT rid, 100 - {LENGTH} + {LENGTH} * len(ts)::BIGINT * n_docs // n_terms AS m FROM d, sums),
scored AS (SELECT item, rid, sum(q * w * (1000000000 * tf // (1000 * tf + {SATURATION} * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (rid) GROUP BY item, rid),
ranked AS (SELECT item, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, rid) AS rank FROM scored JOIN d USING (rid) WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked JOIN i USING (item) WHERE rank <= {K}"""
