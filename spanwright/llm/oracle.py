"""SQL statements of the registered queries that SQL can express."""

from __future__ import annotations

from spanwright.llm import urls

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_LEDGER = rf"""
d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
      FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS w
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(8)) AS k) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words,
             len(ls)::BIGINT AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
             length(regexp_replace(text, '[^0-9]', '', 'g'))::BIGINT AS n_digits,
             len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1]))::BIGINT AS n_stutter
      FROM d LEFT JOIN cover USING (doc_id)),
led AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
             + CASE WHEN 100 * n_symbols > 3 * word_chars THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END
             + CASE WHEN 100 * n_upper > 40 * word_chars THEN 16 ELSE 0 END + CASE WHEN 100 * n_stutter > 20 * n_words THEN 32 ELSE 0 END
             + CASE WHEN word_chars > 25 * n_words THEN 64 ELSE 0 END + CASE WHEN 100 * n_digits > 60 * word_chars THEN 128 ELSE 0 END)::BIGINT
             AS failed_bits FROM m)
"""

OP3 = f"""WITH {_LEDGER}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed,
       failed_bits = 0 AS kept, failed_bits FROM led"""

OP3_ABLATIONS = f"""WITH {_LEDGER},
rule AS (SELECT * FROM (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('duplicate_lines', 8), ('upper_case', 16),
                               ('stutter', 32), ('long_words', 64), ('digits', 128)) AS r (rule, bit)),
policy AS (SELECT * FROM (VALUES ('base-1', 3), ('full-2', 255)) AS p (policy, mask))
SELECT policy, rule, count(*) FILTER (failed_bits & bit <> 0)::BIGINT AS n_failed,
       count(*) FILTER (failed_bits & mask = bit)::BIGINT AS n_only, count(*) FILTER (failed_bits & mask <> 0)::BIGINT AS n_rejected
FROM led, rule, policy WHERE mask & bit <> 0 GROUP BY policy, rule"""


def near_duplicates(width: int, percent: int = 80, kept: str = ", d.doc_id = c.root AS kept") -> str:
    """Brute force: all pairs that share a shingle, then components by reaching the smallest id."""
    last = width - 1
    return rf"""WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < {width} THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + {last}], ' ') END AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {last}, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
      JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
      WHERE 100 * least(na.n, nb.n) >= {percent} * greatest(na.n, nb.n)
      GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= {percent} * (na.n + nb.n - count(*))),
r AS (SELECT doc_id AS x, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.x WHERE r.root < e.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.root AS component_id{kept}
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(root) AS root FROM r GROUP BY x) c ON c.x = d.doc_id"""


OP4 = near_duplicates(2)
OP13 = near_duplicates(3, 90, "")


_HOST = "translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = f"""SELECT *, {_HOST} AS host, regexp_extract(substr(rest, length({_HOST}) + 1), '^[^?#]*', 0) AS path
FROM (SELECT *, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest"""
_BUCKETS = """list_distinct(list_transform(CASE WHEN host = '' THEN ['bias'] ELSE
    list_transform(range(1, length(host) + 1), lambda i: 'h' || substr('^' || host || '$', i, 3))
    || list_transform(range(1, greatest(length(path) - 1, 1)), lambda i: 'p' || substr(path, i, 3)) || ['bias'] END,
    lambda g: ('0x' || substr(md5(g), 1, 6))::INT % 1024))"""
_LABELLED = ", ".join(f"('{u}', {y})" for u, y in urls.LABELLED)

OP7 = f"""WITH RECURSIVE
lab AS (SELECT row_number() OVER (ORDER BY url, y) AS i, y, {_BUCKETS} AS b FROM ({_SPLIT} FROM (VALUES {_LABELLED}) AS v (url, y)))),
gram AS (SELECT a.i, list(len(list_intersect(a.b, c.b)) / sqrt(len(a.b) * len(c.b)) ORDER BY c.i) AS g FROM lab a, lab c GROUP BY a.i),
one AS (SELECT list(g ORDER BY i) AS gm, list(y::DOUBLE ORDER BY i) AS ys FROM gram JOIN lab USING (i)),
learn AS (SELECT 0 AS t, list_transform(ys, lambda y: 0::DOUBLE) AS al FROM one
          UNION ALL SELECT t + 1, list_transform(range(1, len(al) + 1), lambda i: al[i] * {1 - urls.RATE * urls.DECAY!r}
            + {urls.RATE!r} * (ys[i] - 1 / (1 + exp(-list_inner_product(gm[i], al))))) FROM learn, one WHERE t < {urls.STEPS}),
w AS (SELECT k, sum(al[i] / sqrt(len(b))) AS w FROM (SELECT i, b, unnest(b) AS k FROM lab), (SELECT al FROM learn WHERE t = {urls.STEPS}) GROUP BY k),
p AS (SELECT page_id, host, path, {_BUCKETS} AS b FROM ({_SPLIT} FROM pages))),
s AS (SELECT page_id, sum(coalesce(w, 0)) / sqrt(count(*)) AS m FROM (SELECT page_id, unnest(b) AS k FROM p) LEFT JOIN w USING (k) GROUP BY page_id),
r AS (SELECT page_id, host, path, m, CASE
        WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
        WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
      FROM p JOIN s USING (page_id))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN m >= 0 THEN 'block' ELSE 'allow' END AS verdict FROM r"""

OP11 = r"""WITH
d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
             sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
x AS (SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3,
             ('0x' || h[25:32])::BIGINT AS h4 FROM d),
y AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM x),
z AS (SELECT *, array_to_string(u[:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM y)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END)
       AS output_sha256, sha256(text) AS restored_sha256 FROM z"""

OP12 = r"""WITH
pc AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pc),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM
        (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
size AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cut AS (SELECT lang, phrase, a, c.k, i, array_to_string(ws[:i], ' ') AS left_part, array_to_string(ws[i + 1:], ' ') AS right_part
        FROM c, (SELECT unnest([1, 2, 3]) AS i) WHERE i < c.k),
scored AS (SELECT cut.*, x.a AS l, y.a AS r, ((2000000 * cut.a::HUGEINT) // (x.a + y.a))::BIGINT AS score
           FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = left_part JOIN f y ON y.lang = cut.lang AND y.phrase = right_part),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
part AS (SELECT lang, array_to_string(ws[i:i + j - 1], ' ') AS phrase, max(a) AS most
         FROM c, (SELECT unnest([2, 3]) AS j), (SELECT unnest([1, 2, 3]) AS i) WHERE j < k AND i + j - 1 <= k GROUP BY 1, 2)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score
FROM low LEFT JOIN part USING (lang, phrase) JOIN size USING (lang) WHERE most IS NULL OR 100 * most < 80 * a
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""
