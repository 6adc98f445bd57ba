"""SQL statements of the registered queries, and of the derived tables they read."""

from __future__ import annotations

WORD = r"[\p{L}\p{N}_]"
TYPES = "['TRIỆU_CHỨNG','TÊN_XÉT_NGHIỆM','KẾT_QUẢ_XÉT_NGHIỆM','CHẨN_ĐOÁN','THUỐC']"
HAS_CODE = "('CHẨN_ĐOÁN','THUỐC')"
HAS_ASSERTION = "('CHẨN_ĐOÁN','THUỐC','TRIỆU_CHỨNG')"


def norm(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(lower(nfc_normalize({x})),"
            rf"'[^\p{{L}}\p{{N}}_À-ỹ]',' ','g'),'\s+',' ','g'))")


def key(x: str) -> str:
    return rf"regexp_replace(lower(trim({x}, E' \t\n\r')),'\s+',' ','g')"


def toks(x: str) -> str:
    """Token list of a normalised string."""
    cls = r"[\p{L}\p{Nl}\p{No}_]"
    return (rf"list_filter(string_split(regexp_replace(regexp_replace({x},'(\p{{Nd}})({cls})','\1 \2','g'),"
            rf"'({cls})(\p{{Nd}})','\1 \2','g'),' '), lambda t: t <> '')")


def alias(x: str) -> str:
    """Abbreviations that occur in the derived mentions."""
    return rf"array_to_string(list_transform(string_split({x},' '), lambda t: CASE t WHEN 'asa' THEN 'aspirin' ELSE t END),' ')"


def _words(table: str, source: str) -> str:
    return rf"""
{table}_tiles AS (SELECT doc_id, unnest(l) t, generate_subscripts(l, 1) i FROM (
  SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]') l FROM {source})),
{table}_at AS (SELECT doc_id, t, i, CAST(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i) - length(t) AS INT) s FROM {table}_tiles),
{table} AS (SELECT doc_id, t, s AS cs, CAST(s + length(t) AS INT) ce, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INT) idx
  FROM {table}_at WHERE regexp_matches(t, '^[\p{{L}}\p{{N}}]'))"""


def _word_concepts(name: str, words: str, min_len: int) -> str:
    return rf"""
{name} AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY cs) - 1 AS INT) cid, t AS text, type, cs AS start, ce AS "end",
  list_filter([CASE WHEN contains(lower(t),'th') THEN 'isNegated' END, CASE WHEN contains(lower(t),'oi') THEN 'isFamily' END,
    CASE WHEN contains(lower(t),'on') THEN 'isHistorical' END], lambda x: x IS NOT NULL) assertions,
  CASE WHEN type IN {HAS_CODE} AND contains(lower(t),'en') THEN ['K' || substr(lower(t),1,2)] ELSE CAST([] AS VARCHAR[]) END candidates
  FROM (SELECT *, {TYPES}[length(t) % 5 + 1] AS type FROM {words} WHERE length(t) >= {min_len}))"""


def _pairs(name: str, words: str) -> str:
    return rf"""
{name}_next AS (SELECT *, lead(t) OVER w AS t2, lead(cs) OVER w AS cs2, lead(ce) OVER w AS ce2 FROM {words} WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
{name} AS (SELECT doc_id, CAST(idx / 3 AS INT) cid, substr(d.text, p.cs + 1, p.ce2 - p.cs) AS text,
  {TYPES}[length(substr(d.text, p.cs + 1, p.ce2 - p.cs)) % 5 + 1] AS type, p.cs AS start, p.ce2 AS "end"
  FROM {name}_next p JOIN {{source}} d USING (doc_id) WHERE idx % 3 = 0 AND t2 IS NOT NULL)"""


DOCS = "docs AS (SELECT doc_id, text FROM documents)"
PASSAGES = "passages AS (SELECT item_id AS doc_id, text FROM benchmark)"
TURNS = "turns AS (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)"
LINES = """
lines AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) - 1 AS INT) cid
  FROM lineitem),
olines AS (SELECT * FROM lines JOIN part ON l_partkey = p_partkey)"""
OUTLINES = LINES + r""",
outlines AS (SELECT o_orderkey AS doc_id, '1. ' || o_orderpriority || chr(10) || 'Status ' || o_orderstatus || ':' || chr(10) || l || chr(10) || chr(10)
  || 'Shipping notes' || chr(10) || '    Customer ' || o_custkey || chr(10) || '2) 1.5 mg' || chr(10) || 'Nothing else was reported.' || chr(10)
  || 'Total ' || CAST(floor(o_totalprice) AS BIGINT) AS text
  FROM orders JOIN (SELECT l_orderkey, string_agg('- ' || p_name || ', ' || l_linestatus, chr(10) ORDER BY cid) l FROM olines GROUP BY 1) ON o_orderkey = l_orderkey)"""
GOLD = LINES + f""",
gold AS (SELECT l_orderkey AS doc_id, cid, p_name AS text, type, cid * 40 AS start, CAST(cid * 40 + length(p_name) AS INT) AS "end",
  list_filter([CASE WHEN l_returnflag = 'R' THEN 'isNegated' END, CASE WHEN l_suppkey % 10 = 0 THEN 'isFamily' END,
    CASE WHEN l_linestatus = 'F' THEN 'isHistorical' END], lambda x: x IS NOT NULL) assertions,
  CASE WHEN type IN {HAS_CODE} AND l_partkey % 4 <> 0 THEN list_filter(['C' || l_partkey % 50, CASE WHEN l_partkey % 9 = 0 THEN 'X' || l_partkey % 7 END], lambda x: x IS NOT NULL)
    ELSE CAST([] AS VARCHAR[]) END candidates
  FROM (SELECT *, {TYPES}[l_partkey % 5 + 1] AS type FROM olines)),
pred AS (SELECT l_orderkey AS doc_id, cid, CASE WHEN l_suppkey % 11 = 0 THEN p_name || ' x' ELSE p_name END AS text, type,
  cid * 40 AS start, CAST(cid * 40 + length(p_name) AS INT) AS "end",
  CASE WHEN l_quantity > 40 THEN CAST([] AS VARCHAR[]) ELSE list_filter([CASE WHEN l_returnflag = 'R' THEN 'isNegated' END,
    CASE WHEN l_linestatus = 'F' THEN 'isHistorical' END], lambda x: x IS NOT NULL) END assertions,
  CASE WHEN type IN {HAS_CODE} THEN ['C' || (CASE WHEN l_partkey % 3 = 0 THEN l_partkey + 1 ELSE l_partkey END) % 50] ELSE CAST([] AS VARCHAR[]) END candidates
  FROM (SELECT *, {TYPES}[(l_partkey + CASE WHEN l_suppkey % 7 = 0 THEN 1 ELSE 0 END) % 5 + 1] AS type FROM olines WHERE cid % 6 <> 5)),
probs AS (SELECT g.*, [(l_quantity % 11) / 10, (l_suppkey % 9) / 8, (l_partkey % 13) / 12] p, (l_quantity % 20) / 20 AS gate,
  ['C' || (CASE WHEN l_partkey % 3 = 0 THEN l_partkey + 1 ELSE l_partkey END) % 50] AS picked
  FROM gold g JOIN lines l ON g.doc_id = l.l_orderkey AND g.cid = l.cid)"""
SPANS = """spans AS (SELECT o_orderkey AS doc_id, CAST(o_custkey % 120 AS INT) s, CAST(o_custkey % 120 + 60 + floor(o_totalprice) % 100 AS INT) e FROM orders)"""
KB = LINES + f""",
kb AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'CHẨN_ĐOÁN' ELSE 'THUỐC' END AS type, p_partkey AS ord, 'P' || p_partkey AS code,
  {norm("CASE WHEN p_partkey % 3 = 0 THEN 'Aspirin ' ELSE '' END || p_name || ' ' || p_brand")} AS norm FROM part),
mentions AS (SELECT l_orderkey AS doc_id, cid, CASE WHEN p_partkey % 3 = 0 THEN 'ASA ' ELSE '' END || upper(p_name) || ',  ' || p_brand AS text,
  CASE WHEN cid % 2 = 0 THEN 'CHẨN_ĐOÁN' ELSE 'THUỐC' END AS type FROM olines),
nmentions AS (SELECT *, {norm('text')} AS norm FROM mentions)"""
EXACT = KB + f""",
direct AS (SELECT doc_id, cid, m.type, ord, code FROM nmentions m JOIN kb USING (type, norm)),
second AS (SELECT doc_id, cid, m.type, ord, code FROM (SELECT *, {alias('norm')} AS x FROM nmentions m WHERE type = 'THUỐC'
    AND NOT EXISTS (SELECT 1 FROM kb WHERE kb.type = m.type AND kb.norm = m.norm)) m JOIN kb ON kb.type = m.type AND kb.norm = m.x WHERE m.x <> m.norm),
exact AS (SELECT * FROM direct UNION ALL SELECT * FROM second),
uniq AS (SELECT doc_id, cid, count(*) n, min(code) AS code FROM exact GROUP BY 1, 2)"""
HEADINGS = OUTLINES + r""",
hl0 AS (SELECT doc_id, unnest(l) line, generate_subscripts(l, 1) n FROM (SELECT doc_id, string_split(text, chr(10)) l FROM outlines)),
hl1 AS (SELECT *, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start,
  trim(line) AS body, regexp_matches(line, '^[ \t]*[-–—•]') AS bullet, length(line) - length(ltrim(line)) AS indent,
  regexp_matches(line, '^[ \t]*(\d+)[.)][ \t]*(.+?)[ \t]*$') AS num FROM hl0),
hl2 AS (SELECT *, lead(bullet) OVER w AS nb, lead(indent) OVER w AS ni FROM hl1 WHERE body <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
hl3 AS (SELECT *, trim(rtrim(trim(regexp_replace(CASE WHEN num THEN regexp_extract(line, '^[ \t]*(\d+)[.)][ \t]*(.+?)[ \t]*$', 2) ELSE body END, '^\d+[.)]\s*', '')), ':')) AS title FROM hl2
  WHERE length(body) <= 70 AND NOT bullet AND (num OR NOT regexp_matches(body, '[.?!]$'))
    AND (num OR body LIKE '%:' OR nb OR ni > indent)),
headings AS (SELECT doc_id, start, CAST(start + length(line) AS INT) AS "end", CASE WHEN num THEN 1 ELSE 2 END AS level, title FROM hl3 WHERE title <> '')"""
SECTIONS = HEADINGS + "," + _words("ow", "outlines") + "," + _word_concepts("oc", "ow", 4) + """,
l1 AS (SELECT c.doc_id, c.cid, h.start AS hs, h.title FROM oc c ASOF LEFT JOIN (SELECT * FROM headings WHERE level = 1) h ON c.doc_id = h.doc_id AND c.start > h.start),
l2 AS (SELECT c.doc_id, c.cid, h.start AS hs, h.title FROM oc c ASOF LEFT JOIN (SELECT * FROM headings WHERE level = 2) h ON c.doc_id = h.doc_id AND c.start > h.start),
sect AS (SELECT c.*, concat_ws(' › ', l1.title, CASE WHEN l1.hs IS NULL OR l2.hs > l1.hs THEN l2.title END) AS section
  FROM oc c JOIN l1 USING (doc_id, cid) JOIN l2 USING (doc_id, cid))"""


def left_lines(n: int) -> str:
    return f"array_to_string(list_slice(string_split(substr(d.text, 1, start), chr(10)), -{n}, -1), chr(10))"


def right_lines(n: int) -> str:
    return f"array_to_string(list_slice(string_split(substr(d.text, \"end\" + 1), chr(10)), 1, {n}), chr(10))"


def window(before: int, after: int, lines_before: int, lines_after: int) -> str:
    return (f"trim(right({left_lines(lines_before + 1)}, {before}) || '«' || substr(d.text, start + 1, \"end\" - start) || '»' || "
            f"left({right_lines(lines_after + 1)}, {after}), E' \\t\\n\\r')")


INPUTS = SECTIONS + f""",
inputs AS (SELECT c.*, c.type || ' | ' || c.section || ' | ' || {window(200, 80, 2, 1)} AS input FROM sect c JOIN outlines d USING (doc_id))"""
TURN_CONCEPTS = TURNS + "," + _words("tw", "turns") + "," + _word_concepts("tc", "tw", 8)
DOC_WORDS = DOCS + "," + _words("dw", "docs")
PASSAGE_PAIRS = PASSAGES + "," + _words("pw", "passages") + "," + _pairs("pp", "pw").replace("{source}", "passages")
FIT = PASSAGE_PAIRS + f""",
votes AS (SELECT {key('text')} AS phrase, type, count(*) n, min((doc_id, cid)) AS first FROM pp GROUP BY 1, 2),
phrases AS (SELECT phrase, arg_min(type, (-n, first)) AS type, min(first) AS rank FROM votes WHERE phrase <> '' GROUP BY 1)"""
TAGGED = FIT + "," + DOCS.replace("text FROM", "lower(text) AS low, text FROM") + r""",
heads AS (SELECT regexp_extract(phrase, '^([\p{L}\p{N}]+|.)') AS head, list(DISTINCT length(phrase)) AS lens FROM phrases WHERE length(phrase) >= 2 GROUP BY 1),
dt0 AS (SELECT doc_id, unnest(l) t, generate_subscripts(l, 1) i FROM (SELECT doc_id, regexp_extract_all(low, '[\p{L}\p{N}]+|[^\p{L}\p{N}]') l FROM docs)),
dt1 AS (SELECT doc_id, t, i, CAST(sum(length(t)) OVER w - length(t) AS INT) s, lag(t) OVER w AS prior,
  string_agg(t, '') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 80 FOLLOWING) AS ahead FROM dt0 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
cands AS (SELECT doc_id, s, ahead, unnest(lens) AS n FROM dt1 JOIN heads ON t = head
  WHERE regexp_matches(t, '^[\p{L}\p{N}]') OR prior IS NULL OR NOT regexp_matches(prior, '^[\p{L}\p{N}]')),
hits AS (SELECT c.doc_id, s, s + n AS e, p.type, p.rank FROM cands c JOIN phrases p ON p.phrase = substr(ahead, 1, n)
  WHERE length(p.phrase) = n AND NOT regexp_matches(substr(ahead, n + 1, 1), '[\p{L}\p{N}]')),
packed AS (SELECT doc_id, list({'n': s - e, 'r': rank, 's': s, 'e': e, 't': type} ORDER BY s - e, rank, s) AS l FROM hits GROUP BY 1),
folded AS (SELECT doc_id, unnest(list_reduce(l, lambda acc, x: CASE WHEN length(list_filter(acc, lambda y: y.s < x[1].e AND x[1].s < y.e)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS x
  FROM (SELECT doc_id, list_transform(l, lambda z: [z]) AS l FROM packed)),
tagged AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY x.s) - 1 AS INT) AS cid, substr(d.text, CAST(x.s AS INT) + 1, CAST(x.e - x.s AS INT)) AS text,
  x.t AS type, CAST(x.s AS INT) AS start, CAST(x.e AS INT) AS "end" FROM folded JOIN docs d USING (doc_id))"""


def cue(clause: str, words: str) -> str:
    return rf"regexp_matches({clause}, '(^|[^\p{{L}}\p{{N}}_])({words})($|[^\p{{L}}\p{{N}}_])')"


def rules(source: str, docs: str) -> str:
    """Cue rules with the words used by the registered queries."""
    return rf"""
ruled AS (SELECT *, list_filter([CASE WHEN {cue('clause', 'of|les|und')} OR starts_with(mention, 'th') OR starts_with(mention, 'ou') THEN 'isNegated' END,
    CASE WHEN {cue('clause', 'the|la|der')} THEN 'isHistorical' END, CASE WHEN {cue('clause', 'in the|de la')} THEN 'isFamily' END], lambda x: x IS NOT NULL) AS found
  FROM (SELECT c.*, trim(lower(c.text)) AS mention, lower(list_extract(string_split_regex(list_extract(string_split(substr(d.text, 1, start), chr(10)), -1), '[\n;.]|(?:^|\s)-\s|,\s'), -1)) AS clause
    FROM {source} c JOIN {docs} d USING (doc_id))),
asserted AS (SELECT *, CASE WHEN type IN {HAS_ASSERTION} THEN found ELSE CAST([] AS VARCHAR[]) END AS labels FROM ruled)"""


def jaccards(field: str, types: str, mode: str, out: str) -> str:
    place = "start, \"end\", type" if mode == "concept" else "0 AS start, 0 AS \"end\", '' AS type"
    return f"""
{out}_i AS (SELECT doc_id, start, "end", type, v, sum(g) g, sum(p) p FROM (
   SELECT doc_id, {place}, unnest({field}) v, 1 g, 0 p FROM gold WHERE type IN {types}
   UNION ALL SELECT doc_id, {place}, unnest({field}) v, 0 g, 1 p FROM pred WHERE type IN {types}) GROUP BY ALL),
{out}_s AS (SELECT doc_id, sum(least(g, p)) i, sum(greatest(g, p)) u, sum(g) ng FROM {out}_i GROUP BY 1),
{out} AS (SELECT o_orderkey AS doc_id, CASE WHEN coalesce(u, 0) = 0 THEN 1.0 WHEN ng = 0 THEN 0.0 ELSE i / u END AS {out}
   FROM orders LEFT JOIN {out}_s ON o_orderkey = doc_id)"""


TEXT_SCORE = r"""
refs AS (SELECT doc_id, string_split(string_agg(text, ' ' ORDER BY cid), ' ') w FROM gold GROUP BY 1),
hyps AS (SELECT doc_id, string_split(string_agg(text, ' ' ORDER BY cid), ' ') w FROM pred GROUP BY 1),
both_w AS (SELECT o_orderkey AS doc_id, coalesce(r.w, []) rw, coalesce(h.w, []) hw FROM orders LEFT JOIN refs r ON r.doc_id = o_orderkey LEFT JOIN hyps h ON h.doc_id = o_orderkey),
enc AS (SELECT doc_id, rw, hw, list_distinct(list_concat(rw, hw)) v FROM both_w),
text_score AS (SELECT doc_id, CASE WHEN length(rw) = 0 THEN CASE WHEN length(hw) = 0 THEN 1.0 ELSE 0.0 END ELSE greatest(0.0, 1.0 - levenshtein(
   array_to_string(list_transform(rw, lambda x: chr(CAST(33 + list_position(v, x) AS INT))), ''),
   array_to_string(list_transform(hw, lambda x: chr(CAST(33 + list_position(v, x) AS INT))), '')) / length(rw)) END AS text FROM enc)"""


def scores(mode: str) -> str:
    return (GOLD + "," + TEXT_SCORE + "," + jaccards("assertions", HAS_ASSERTION, mode, "assertions") + ","
            + jaccards("candidates", HAS_CODE, mode, "candidates") + f""",
weights AS (SELECT doc_id, sum(length(candidates) + 1) AS weight FROM gold WHERE type IN {HAS_CODE} GROUP BY 1),
per_doc AS (SELECT doc_id, text, assertions, candidates, CAST(coalesce(weight, 0) AS BIGINT) AS weight FROM text_score JOIN assertions USING (doc_id) JOIN candidates USING (doc_id)
  LEFT JOIN weights USING (doc_id))""")


def q(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip().rstrip(',')}\n{body}"


BM25 = f"""
bd AS (SELECT doc_id AS ord, source || '-' || doc_id % 7 AS code, text AS description, {toks(norm('text'))} AS t FROM documents),
bp AS (SELECT ord, term, count(*) tf, any_value(dl) dl FROM (SELECT ord, length(t) dl, unnest(t) term FROM bd) GROUP BY 1, 2),
bn AS (SELECT count(*) n, avg(length(t)) avgdl FROM bd),
bi0 AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM bp, bn GROUP BY term, n),
bi AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM bi0) ELSE idf END AS idf FROM bi0),
bq AS (SELECT key, term, count(*) qtf FROM (SELECT item_id AS key, unnest({toks(norm('text'))}) term FROM benchmark) GROUP BY 1, 2),
bs AS (SELECT key, ord, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM bq JOIN bp USING (term) JOIN bi USING (term), bn GROUP BY 1, 2)"""


def ranked(scores_cte: str, entries: str, k: int, out: str) -> str:
    return f"""
{out}_top AS (SELECT key, ord, score, row_number() OVER (PARTITION BY key ORDER BY score DESC, ord) pos FROM {scores_cte} QUALIFY pos <= {3 * k}),
{out}_code AS (SELECT key, code, min(pos) pos, arg_min(score, pos) score, arg_min(description, pos) description FROM {out}_top JOIN {entries} USING (ord) GROUP BY 1, 2),
{out} AS (SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS INT) AS rank, code, score, description FROM {out}_code QUALIFY rank < {k})"""
