"""Registered queries: name -> (Spark query over a table folder, SQL statement or None)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright import vocab
from spanwright.functions import context as ctx
from spanwright.functions import text as tx
from spanwright.operators import align as al
from spanwright.operators import assertion, bio, cluster, layout, mapping, metrics, models, postprocess, retrieval, synth, tagging
from spanwright.operators.concepts import eligible_for_codes, inside_spans, validate, with_text
from spanwright.plans import derived as dv
from spanwright.plans import oracle as o
from spanwright.plans.annotate import annotate
from spanwright.session import read_table, spread

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, tuple[Query, str | None]] = {}

# Cue words of the supplied texts; `oracle.rules` states the same ones.
CUES = dict(negation=("of", "les", "und"), historical=("the", "la", "der"),
            family=("in the", "de la"), prefixes=("th", "ou"))
TOP_K = 5


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        REGISTERED[name] = (fn, sql)
        return fn

    return add


def _joined(c: str | Column, sep: str = "|") -> Column:
    return F.array_join(c, sep)


def _flat(concepts: DataFrame) -> DataFrame:
    return concepts.select("doc_id", F.col("cid").cast("int").alias("cid"), "text", "type", "start", "end",
                           _joined("assertions").alias("assertions"), _joined("candidates").alias("candidates"))


FLAT = """doc_id, cid, text, type, start, "end", array_to_string(assertions, '|') AS assertions, array_to_string(candidates, '|') AS candidates"""


# ---- text functions -------------------------------------------------------------------------

@query("normalize_text", f"SELECT doc_id, {o.norm('text')} AS norm FROM documents")
def normalize_text(spark, sf):
    return dv.documents(spark, sf).select("doc_id", tx.normalize(F.col("text")).alias("norm"))


@query("match_keys", o.q(o.TURNS, f"""SELECT doc_id, {o.key('text')} AS key, lower(trim(text, E' \\t\\n\\r')) AS vote,
  lower(trim(trim(regexp_replace(text, '\\s+', ' ', 'g')), E':.-•* \\t')) AS head FROM turns"""))
def match_keys(spark, sf):
    t = F.col("text")
    return dv.turns(spark, sf).select("doc_id", tx.match_key(t).alias("key"), tx.vote_key(t).alias("vote"),
                                      postprocess.heading_key(t).alias("head"))


@query("retrieval_tokens", f"""SELECT doc_id, CAST(length(t) AS INT) AS n_tokens, array_to_string(t, ' ') AS tokens
  FROM (SELECT doc_id, {o.toks(o.norm('text'))} AS t FROM documents)""")
def retrieval_tokens(spark, sf):
    t = tx.tokens(tx.normalize(F.col("text")))
    return dv.documents(spark, sf).select("doc_id", t.alias("t")).select(
        "doc_id", F.size("t").alias("n_tokens"), _joined("t", " ").alias("tokens"))


@query("expand_aliases", o.q(o.KB, f"SELECT doc_id, cid, {o.alias('norm')} AS expanded FROM nmentions"))
def expand_aliases(spark, sf):
    return dv.part_mentions(spark, sf).select(
        "doc_id", "cid", tx.expand_aliases(tx.normalize(F.col("text"))).alias("expanded"))


@query("line_titles", o.q(o.HEADINGS, r"""SELECT doc_id, CAST(n - 1 AS INT) AS line_no, CAST(bullet AS INT) AS bullet,
  trim(rtrim(trim(regexp_replace(trim(line), '^\d+[.)]\s*', '')), ':')) AS title FROM hl1"""))
def line_titles(spark, sf):
    lines = dv.outlines(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", tx.is_bullet(F.col("line")).cast("int").alias("bullet"),
                        tx.clean_title(F.col("line")).alias("title"))


@query("shingle_sets", o.q(o.DOCS, r"""
SELECT doc_id, CAST(length(g) AS INT) AS n_shingles, list_min(g) AS first_shingle FROM (
 SELECT doc_id, CASE WHEN length(w) >= 8 THEN list_distinct(list_transform(range(1, length(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) ELSE [] END AS g
 FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') w FROM docs))"""))
def shingle_sets(spark, sf):
    g = tx.shingles(F.col("text"))
    return dv.documents(spark, sf).select("doc_id", g.alias("g")).select(
        "doc_id", F.size("g").alias("n_shingles"), F.array_min("g").alias("first_shingle"))


@query("context_windows", o.q(o.TURN_CONCEPTS, f"""SELECT doc_id, cid, {o.window(160, 60, 0, 0)} AS narrow, {o.window(40, 30, 1, 1)} AS wide
  FROM tc JOIN turns d USING (doc_id)"""))
def context_windows(spark, sf):
    docs = dv.turns(spark, sf)
    return with_text(docs, dv.word_concepts(docs, 8), narrow=ctx.context_window,
                     wide=lambda t, c: ctx.context_window(t, c, 40, 30, 1, 1)).select("doc_id", "cid", "narrow", "wide")


@query("mention_lines", o.q(o.SECTIONS, f"""SELECT doc_id, cid,
  left(trim({o.left_lines(1)} || substr(d.text, start + 1, "end" - start) || {o.right_lines(1)}, E' \\t'), 200) AS line,
  CAST(regexp_matches({o.left_lines(1)}, '^[ \\t]*[-–—•]') AS INT) AS bullet,
  CAST(start - length({o.left_lines(1)}) AS INT) AS line_start FROM oc JOIN outlines d USING (doc_id)"""))
def mention_lines(spark, sf):
    docs = dv.shared_outlines(spark, sf)
    return with_text(docs, dv.word_concepts(docs, 4).select("doc_id", "cid", "start", "end"), line=ctx.line_of,
                     bullet=lambda t, c: ctx.in_bullet_line(t, c["start"]).cast("int"),
                     line_start=lambda t, c: ctx.line_span(t, c["start"])[0]).select(
        "doc_id", "cid", "line", "bullet", "line_start")


@query("assertion_prompts", o.q(o.TURN_CONCEPTS, f"""SELECT doc_id, cid,
  'Loại khái niệm: ' || type || chr(10) || 'Khái niệm: ' || tc.text || chr(10) || 'Ngữ cảnh: ' || {o.window(160, 60, 0, 0)} || chr(10) || 'Các nhãn áp dụng (mảng JSON):' AS prompt,
  '[' || array_to_string(list_transform(list_filter(['isNegated','isFamily','isHistorical'], lambda a: list_contains(assertions, a)), lambda a: '"' || a || '"'), ', ') || ']' AS target
  FROM tc JOIN turns d USING (doc_id) WHERE type IN {o.HAS_ASSERTION}"""))
def assertion_prompts(spark, sf):
    docs = dv.turns(spark, sf)
    return assertion.tuning_examples(docs, dv.word_concepts(docs, 8)).select("doc_id", "cid", "prompt", "target")


@query("parse_labels", o.q(o.TURNS, """, answers AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'ok ["isFamily", "isNegated", "x"] ' || text WHEN 1 THEN 'isHistorical, ' || text
  WHEN 2 THEN '[] ' || text ELSE text || ' ["isHistorical"' END AS answer FROM turns)
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'isNegated|isFamily' ELSE array_to_string(list_filter(['isNegated','isFamily','isHistorical'], lambda a: contains(answer, a)), '|') END AS labels
FROM answers""".strip()).replace("\n,", ","))
def parse_labels(spark, sf):
    t, m = F.col("text"), F.col("doc_id") % 4
    answer = (F.when(m == 0, F.concat(F.lit('ok ["isFamily", "isNegated", "x"] '), t))
              .when(m == 1, F.concat(F.lit("isHistorical, "), t)).when(m == 2, F.concat(F.lit("[] "), t))
              .otherwise(F.concat(t, F.lit(' ["isHistorical"'))))
    return dv.turns(spark, sf).select("doc_id", _joined(ctx.parse_labels(answer)).alias("labels"))


@query("parse_codes", o.q(o.LINES, """SELECT l_orderkey AS doc_id, cid, CASE cid % 3 WHEN 0 THEN 'P' || l_partkey || '.1' WHEN 1 THEN NULL ELSE 'P' || l_partkey END AS code FROM lines"""))
def parse_codes(spark, sf):
    x = dv.numbered_lines(spark, sf)
    code = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    longer = F.concat(code, F.lit(".1"))
    answer = F.when(F.col("cid") % 3 == 0, F.concat(F.lit("code: "), longer)).when(
        F.col("cid") % 3 == 1, "None applies").otherwise(F.concat(F.lit(" ("), code, F.lit(")")))
    return x.select(F.col("l_orderkey").alias("doc_id"), "cid", ctx.parse_code(answer, F.array(code, longer)).alias("code"))


# ---- layout ---------------------------------------------------------------------------------

@query("find_headings", o.q(o.HEADINGS, 'SELECT doc_id, start, "end", level, title FROM headings'))
def find_headings(spark, sf):
    return layout.find_headings(dv.outlines(spark, sf))


@query("section_paths", o.q(o.SECTIONS, "SELECT doc_id, cid, start, section FROM sect"))
def section_paths(spark, sf):
    docs = dv.shared_outlines(spark, sf)
    return layout.section_path(dv.word_concepts(docs, 4), layout.find_headings(docs)).select(
        "doc_id", "cid", "start", "section")


@query("layout_stats", o.q(o.HEADINGS, """SELECT doc_id, CAST(count(*) AS INT) AS n_lines, CAST(count(*) FILTER (bullet) AS INT) AS n_bullets,
  round(coalesce(sum(length(line)) FILTER (bullet), 0) / (sum(length(line)) + count(*) - 1), 6) AS bullet_char_ratio,
  CAST((SELECT count(*) FROM headings h WHERE h.doc_id = hl1.doc_id) AS INT) AS n_headings FROM hl1 GROUP BY doc_id"""))
def layout_stats(spark, sf):
    return layout.layout_stats(dv.outlines(spark, sf)).withColumn("bullet_char_ratio", F.round("bullet_char_ratio", 6))


@query("model_inputs", o.q(o.INPUTS, "SELECT doc_id, cid, input FROM inputs"))
def model_inputs(spark, sf):
    docs = dv.shared_outlines(spark, sf)
    concepts = dv.word_concepts(docs, 4).select("doc_id", "cid", "type", "start", "end")
    return layout.model_inputs(docs, concepts).select("doc_id", "cid", "input")


# ---- validation and interval filters --------------------------------------------------------

@query("validate_concepts", o.q(o.TURN_CONCEPTS, f"""SELECT doc_id, cid, array_to_string(list_filter([
  CASE WHEN cid % 13 = 0 THEN 'bad_type' END,
  CASE WHEN NOT ("end" + CASE WHEN cid % 5 = 0 THEN 1 ELSE 0 END <= length(d.text)) THEN 'out_of_range' WHEN cid % 5 = 0 THEN 'text_mismatch' END,
  CASE WHEN length(candidates) > 0 AND (cid % 13 = 0 OR type NOT IN {o.HAS_CODE}) THEN 'codes_not_allowed' END], lambda x: x IS NOT NULL), ',') AS errors
  FROM tc JOIN turns d USING (doc_id)"""))
def validate_concepts(spark, sf):
    docs = dv.turns(spark, sf)
    broken = dv.word_concepts(docs, 8).withColumn("type", F.when(F.col("cid") % 13 == 0, "OTHER").otherwise(F.col("type"))).withColumn(
        "end", F.col("end") + F.when(F.col("cid") % 5 == 0, 1).otherwise(0))
    return validate(docs, broken).select("doc_id", "cid", _joined("errors", ",").alias("errors"))


@query("clip_to_spans", o.q(o.GOLD + "," + o.SPANS, f"""SELECT {FLAT} FROM gold g WHERE EXISTS (
  SELECT 1 FROM spans s WHERE s.doc_id = g.doc_id AND s.s <= g.start AND g."end" <= s.e)"""))
def clip_to_spans(spark, sf):
    return _flat(inside_spans(dv.order_gold(spark, sf), dv.order_spans(spark, sf)))


# ---- tagging --------------------------------------------------------------------------------

@query("fit_gazetteer", o.q(o.FIT, "SELECT phrase, type, rank[1] AS doc_id, rank[2] AS cid FROM phrases"))
def fit_gazetteer(spark, sf):
    return _phrases(spark, sf).select("phrase", "type", "rank.doc_id", "rank.cid")


def _phrases(spark, sf):
    return tagging.fit_gazetteer(dv.pair_concepts(dv.passages(spark, sf)))


@query("tag_documents", o.q(o.TAGGED, 'SELECT doc_id, cid, text, type, start, "end" FROM tagged'))
def tag_documents(spark, sf):
    return tagging.tag(dv.documents(spark, sf), _phrases(spark, sf)).select("doc_id", "cid", "text", "type", "start", "end")


_LABELS = str(bio.label_list()).replace('"', "'")
_ENCODED = (o.TURNS + "," + o._words("tw", "turns") + "," + o._pairs("tp", "tw").replace("{source}", "turns") + f""",
bio AS (SELECT w.doc_id, w.idx, w.cs, w.ce, coalesce(list_position({_LABELS}, CASE WHEN w.idx % 3 = 0 AND p.cid IS NOT NULL THEN 'B-' WHEN p.cid IS NOT NULL THEN 'I-' END || p.type) - 1, 0) AS label
  FROM tw w LEFT JOIN tp p ON w.doc_id = p.doc_id AND w.cs < p."end" AND w.ce > p.start)""")


@query("bio_encode", o.q(_ENCODED, "SELECT doc_id, idx, cs, ce, CAST(label AS INT) AS label FROM bio"))
def bio_encode(spark, sf):
    docs = dv.turns(spark, sf)
    return bio.encode(dv.word_tokens(docs), dv.pair_concepts(docs)).select("doc_id", "idx", "cs", "ce", F.col("label").cast("int").alias("label"))


_DECODED = f"""
bt AS (SELECT doc_id, idx, cs, ce, {_LABELS}[label + 1] AS l FROM raw),
br AS (SELECT *, CASE WHEN l[1] <> 'I' OR lag(l) OVER w IS NULL OR lag(l) OVER w = 'O' OR substr(lag(l) OVER w, 3) <> substr(l, 3) THEN 1 ELSE 0 END AS o FROM bt WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
bg AS (SELECT *, sum(o) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM br),
decoded AS (SELECT doc_id, run, substr(any_value(l), 3) AS type, min(cs) AS start, max(ce) AS "end" FROM bg WHERE l <> 'O' GROUP BY doc_id, run)"""


@query("bio_decode", o.q(_ENCODED + ", raw AS (SELECT doc_id, idx, cs, ce, CASE WHEN idx % 7 = 0 THEN idx % 11 ELSE label END AS label FROM bio)," + _DECODED,
                         'SELECT doc_id, type, start, "end", substr(d.text, start + 1, "end" - start) AS text FROM decoded JOIN turns d USING (doc_id)'))
def bio_decode(spark, sf):
    docs = dv.turns(spark, sf)
    coded = bio.encode(dv.word_tokens(docs), dv.pair_concepts(docs)).withColumn(
        "label", F.when(F.col("idx") % 7 == 0, F.col("idx") % 11).otherwise(F.col("label")))
    return bio.decode(docs, coded).select("doc_id", "type", "start", "end", "text")


def _tokenized(docs):
    return docs.select("doc_id", models.tokenize_column(dv.word_tokenizer)(F.col("text")).alias("tokens"))


@query("token_windows", o.q(o.TURNS + "," + o._words("tw", "turns"), """
SELECT doc_id, CAST(w AS INT) AS "window", CAST(count(*) + 2 AS INT) AS n_tokens, min(cs) AS first_cs, max(ce) AS last_ce
FROM (SELECT doc_id, unnest(range(CAST(CASE WHEN n <= 62 THEN 1 ELSE ceil((n - 62) / 46) + 1 END AS BIGINT))) AS w
  FROM (SELECT doc_id, count(*) n FROM tw GROUP BY 1)) g JOIN tw USING (doc_id) WHERE idx >= w * 46 AND idx < w * 46 + 62 GROUP BY doc_id, w"""))
def token_windows(spark, sf):
    real = bio.token_windows(_tokenized(dv.turns(spark, sf)), 64, 16)
    return real.groupBy("doc_id", "window").agg(
        F.count("*").cast("int").alias("n_tokens"), F.min(F.when(F.col("ce") > 0, F.col("cs"))).alias("first_cs"),
        F.max("ce").alias("last_ce")).filter("last_ce > 0")


@query("token_features")
def token_features(spark, sf):
    docs = dv.turns(spark, sf)
    feats = bio.features(bio.token_windows(_tokenized(docs), 64, 16), dv.pair_concepts(docs))
    return feats.select("doc_id", "window", _joined(F.transform("input_ids", lambda x: x.cast("string")), " ").alias("input_ids"),
                        _joined(F.transform("labels", lambda x: x.cast("string")), " ").alias("labels"))


def length_labels():
    """Stand-in token model: the label is the token id modulo the number of labels."""
    n = len(bio.label_list())
    return lambda batch: [[i % n for i in row] for row in batch]


@query("tag_with_model", o.q(o.TURNS + "," + o._words("tw", "turns") + ", raw AS (SELECT doc_id, idx, cs, ce, (ce - cs) % 11 AS label FROM tw)," + _DECODED,
                             'SELECT doc_id, type, start, "end", substr(d.text, start + 1, "end" - start) AS text FROM decoded JOIN turns d USING (doc_id)'))
def tag_with_model(spark, sf):
    tagged = models.tag_documents(dv.turns(spark, sf), dv.word_tokenizer, length_labels, vocab.TYPES, 64, 16)
    return tagged.select("doc_id", "type", "start", "end", "text")


@query("span_types", o.q(o.GOLD, "SELECT DISTINCT type FROM gold"))
def span_types(spark, sf):
    return bio.external_types(dv.order_gold(spark, sf))


# ---- assertions -----------------------------------------------------------------------------

@query("assert_by_rules", o.q(o.TURN_CONCEPTS + "," + o.rules("tc", "turns"), "SELECT doc_id, cid, text, type, start, array_to_string(labels, '|') AS assertions FROM asserted"))
def assert_by_rules(spark, sf):
    docs = dv.turns(spark, sf)
    return assertion.annotate_rules(docs, dv.word_concepts(docs, 8), **CUES).select(
        "doc_id", "cid", "text", "type", "start", _joined("assertions").alias("assertions"))


def length_logits():
    """Stand-in classifier: three logits from the length of the input."""
    return lambda texts: np.array([[len(t) % 7 - 3, len(t) % 5 - 2, len(t) % 3 - 1] for t in texts], dtype="float64")


@query("assert_by_model", o.q(o.INPUTS, f"""SELECT doc_id, cid, CASE WHEN type IN {o.HAS_ASSERTION} THEN array_to_string(list_filter([
   CASE WHEN length(input) % 7 - 3 >= 0 THEN 'isNegated' END, CASE WHEN length(input) % 5 - 2 >= 0 THEN 'isFamily' END,
   CASE WHEN length(input) % 3 - 1 >= 0 THEN 'isHistorical' END], lambda x: x IS NOT NULL), '|') ELSE '' END AS assertions FROM inputs"""))
def assert_by_model(spark, sf):
    docs = dv.shared_outlines(spark, sf)
    concepts = dv.word_concepts(docs, 4).select("doc_id", "cid", "type", "start", "end", "assertions")
    return assertion.annotate_classifier(docs, concepts, length_logits).select(
        "doc_id", "cid", _joined("assertions").alias("assertions"))


def echo_labels():
    """Stand-in generator: answers from the length of the prompt."""
    options = ('["isNegated"]', "isFamily and isHistorical", "[]")
    return lambda system, prompts: [options[len(p) % 3] for p in prompts]


@query("assert_by_generation", o.q(o.TURN_CONCEPTS, f"""SELECT doc_id, cid, CASE WHEN type IN {o.HAS_ASSERTION} THEN CASE length(
  'Loại khái niệm: ' || type || chr(10) || 'Khái niệm: ' || tc.text || chr(10) || 'Ngữ cảnh: ' || {o.window(160, 60, 0, 0)} || chr(10) || 'Các nhãn áp dụng (mảng JSON):') % 3
  WHEN 0 THEN 'isNegated' WHEN 1 THEN 'isFamily|isHistorical' ELSE '' END ELSE '' END AS assertions FROM tc JOIN turns d USING (doc_id)"""))
def assert_by_generation(spark, sf):
    docs = dv.turns(spark, sf)
    return assertion.annotate_generated(docs, dv.word_concepts(docs, 8), echo_labels).select(
        "doc_id", "cid", _joined("assertions").alias("assertions"))


@query("classifier_examples", o.q(o.INPUTS, f"""SELECT doc_id, cid, input AS text, type,
  array_to_string(list_transform(['isNegated','isFamily','isHistorical'], lambda a: CASE WHEN list_contains(assertions, a) THEN '1' ELSE '0' END), '') AS labels
  FROM inputs WHERE type IN {o.HAS_ASSERTION}"""))
def classifier_examples(spark, sf):
    docs = dv.shared_outlines(spark, sf)
    return assertion.classifier_examples(docs, dv.word_concepts(docs, 4)).withColumn(
        "labels", _joined(F.transform("labels", lambda x: x.cast("int").cast("string")), ""))


# ---- code mapping ---------------------------------------------------------------------------

def _mentions(spark, sf):
    return dv.part_mentions(spark, sf).withColumn("norm", tx.normalize(F.col("text")))


@query("exact_codes", o.q(o.EXACT, "SELECT doc_id, cid, type, code FROM exact"))
def exact_codes(spark, sf):
    return mapping.exact_codes(_mentions(spark, sf), dv.part_kb(spark, sf)).select("doc_id", "cid", "type", "code")


_LOOKUP = o.GOLD + f""",
lv AS (SELECT type, {o.key('text')} AS key, candidates[1] AS code, count(*) n, min((doc_id, cid)) AS first FROM gold WHERE type IN {o.HAS_CODE} GROUP BY ALL),
lookup AS (SELECT type, key, arg_min(code, (-n, first)) FILTER (code IS NOT NULL) AS code FROM lv GROUP BY 1, 2
  HAVING coalesce(sum(n) FILTER (code IS NOT NULL), 0) / sum(n) >= 0.5 AND count(code) > 0)"""


@query("fit_lookup", o.q(_LOOKUP, "SELECT type, key, code FROM lookup"))
def fit_lookup(spark, sf):
    return mapping.fit_lookup(dv.order_gold(spark, sf))


@query("map_by_lookup", o.q(_LOOKUP + "," + o.EXACT.replace(o.LINES + ",", ""), f"""SELECT doc_id, cid, m.type,
  coalesce(l.code, CASE WHEN m.type = 'CHẨN_ĐOÁN' AND u.n = 1 THEN u.code END, '') AS code FROM mentions m LEFT JOIN lookup l ON l.type = m.type AND l.key = {o.key('m.text')}
  LEFT JOIN uniq u USING (doc_id, cid)"""))
def map_by_lookup(spark, sf):
    lookup = mapping.fit_lookup(dv.order_gold(spark, sf))
    return mapping.map_lookup(dv.part_mentions(spark, sf), lookup, dv.part_kb(spark, sf)).select(
        "doc_id", "cid", "type", _joined("candidates").alias("code"))


_PRIOR = o.GOLD + f""",
pc AS (SELECT type, {o.norm('text')} AS norm, count(*) n, count(*) FILTER (length(candidates) > 0) m FROM gold WHERE type IN {o.HAS_CODE} GROUP BY 1, 2),
base AS (SELECT type, sum(m) / sum(n) AS base FROM pc GROUP BY 1)"""


@query("fit_prior", o.q(_PRIOR, "SELECT type, norm, round(m / n, 6) AS ratio FROM pc UNION ALL SELECT type, '' , round(base, 6) FROM base"))
def fit_prior(spark, sf):
    ratio, base = mapping.fit_prior(dv.order_gold(spark, sf))
    both = ratio.unionByName(base.select("type", F.lit("").alias("norm"), F.col("base").alias("ratio")))
    return both.withColumn("ratio", F.round("ratio", 6))


@query("prior_gate", o.q(_PRIOR, f"""SELECT doc_id, cid FROM pred p LEFT JOIN pc ON pc.type = p.type AND pc.norm = {o.norm('p.text')} LEFT JOIN base b ON b.type = p.type
  WHERE p.type IN {o.HAS_CODE} AND coalesce(pc.m / pc.n, b.base, 1.0) >= 0.74"""))
def prior_gate(spark, sf):
    ratio, base = mapping.fit_prior(dv.order_gold(spark, sf))
    rows = dv.order_pred(spark, sf).filter(eligible_for_codes()).withColumn("norm", tx.normalize(F.col("text")))
    return mapping.passes_prior(rows, ratio, base, 0.74).select("doc_id", "cid")


def _bm25_entries(spark, sf):
    return spread(read_table(spark, sf, "documents"), "doc_id").select(
        F.col("doc_id").alias("ord"), F.concat("source", F.lit("-"), (F.col("doc_id") % 7).cast("string")).alias("code"),
        F.col("text").alias("description"), tx.normalize(F.col("text")).alias("norm"))


def _passage_queries(spark, sf):
    return dv.passages(spark, sf).select(F.col("doc_id").alias("item_id"), tx.normalize(F.col("text")).alias("norm"))


def _by_item(items: DataFrame, hits: DataFrame) -> DataFrame:
    keyed = items.select("item_id", F.md5(F.encode("norm", "UTF-8")).alias("key"))
    return keyed.join(hits, "key").select("item_id", "rank", "code", F.round("score", 5).alias("score"))


# scores of entries without any query term are 0 and fill up short lists
_BM25 = o.BM25 + """,
ball AS (SELECT b.item_id AS key, d.ord, coalesce(s.score, 0) AS score FROM benchmark b CROSS JOIN bd d LEFT JOIN bs s ON s.key = b.item_id AND s.ord = d.ord),""" + o.ranked("ball", "bd", TOP_K, "bhits")


@query("bm25_search", o.q(_BM25, "SELECT key AS item_id, rank, code, round(score, 5) AS score FROM bhits"))
def bm25_search(spark, sf):
    items = _passage_queries(spark, sf)
    hits = retrieval.bm25_search(retrieval.query_keys(items), _bm25_entries(spark, sf), TOP_K)
    return _by_item(items, hits)


_DENSE = """
de AS (SELECT vec_id AS ord, 'L' || label || '-' || vec_id % 13 AS code, '' AS description, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
dsim AS (SELECT q.vec_id AS key, e.ord, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), e.v), 9) AS score FROM embeddings q CROSS JOIN de e),""" + o.ranked("dsim", "de", TOP_K, "dhits")


def _dense_entries(spark, sf):
    return read_table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("ord"), F.concat(F.lit("L"), F.col("label").cast("string"), F.lit("-"), (F.col("vec_id") % 13).cast("string")).alias("code"),
        F.lit("").alias("description"), F.col("embedding").alias("vector"))


@query("dense_search", o.q(_DENSE, "SELECT key, rank, code, round(score, 5) AS score FROM dhits"))
def dense_search(spark, sf):
    entries = _dense_entries(spark, sf)
    hits = retrieval.dense_search(entries.select(F.col("ord").alias("key"), "vector"), entries, TOP_K)
    return hits.select("key", "rank", "code", F.round("score", 5).alias("score"))


_HYBRID = (_BM25 + """,
he AS (SELECT ord, code, description, CAST(embedding AS DOUBLE[]) AS v FROM bd JOIN embeddings ON vec_id = ord),
hsim AS (SELECT item_id AS key, he.ord, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), he.v), 9) AS score FROM benchmark JOIN embeddings q ON q.vec_id = item_id CROSS JOIN he),"""
           + o.ranked("hsim", "he", TOP_K, "hhits") + f""",
fused AS (SELECT key, code, round(sum(1.0 / (60 + rank + 1)), 12) AS score, min((src, rank)) AS first FROM (SELECT *, 0 AS src FROM bhits UNION ALL SELECT *, 1 FROM hhits) GROUP BY 1, 2)
""")


@query("hybrid_search", o.q(_HYBRID, f"""SELECT key AS item_id, CAST(row_number() OVER (PARTITION BY key ORDER BY score DESC, first) - 1 AS INT) AS rank, code, round(score, 8) AS score
  FROM fused QUALIFY rank < {TOP_K}"""))
def hybrid_search(spark, sf):
    items = _passage_queries(spark, sf)
    entries = _bm25_entries(spark, sf)
    vectors = read_table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    keys = items.select(F.col("item_id").alias("key"), "norm")  # a vector belongs to the item, not to its text
    lexical = retrieval.bm25_search(keys, entries, TOP_K)
    keyed = keys.join(vectors, F.col("key") == F.col("vec_id"))
    dense = retrieval.dense_search(keyed.select("key", "vector"), entries.join(vectors, F.col("ord") == F.col("vec_id")), TOP_K)
    fused = retrieval.fuse([lexical, dense], TOP_K)
    return fused.select(
        F.col("key").alias("item_id"), "rank", "code", F.round("score", 8).alias("score"))


def _part_searchers(kb: DataFrame):
    def make(ctype: str):
        entries = kb.filter(F.col("type") == ctype).select("ord", "code", "description", "norm")
        index = retrieval.bm25_index(entries)
        return lambda queries, k: retrieval.bm25_search(queries, entries, k, index)

    return {t: make(t) for t in vocab.TYPES_WITH_CANDIDATES}


def _one_per_document(mentions: DataFrame) -> DataFrame:
    """Every mention as its own line of text, under the joined ids of its document and concept."""
    return mentions.withColumn("doc_id", F.concat_ws(":", "doc_id", "cid"))


def gate_logits():
    """Stand-in gate: two logits from the length of the input."""
    return lambda texts: np.array([[0.0, len(t) % 4 - 1.5] for t in texts])


@query("map_gated", o.q(o.EXACT.replace("uniq AS (SELECT doc_id, cid, count(*) n, min(code) AS code", "uniq AS (SELECT doc_id, cid, count(*) n, min(code) AS code") + f""",
kt AS (SELECT type, ord, code, {o.toks('norm')} AS t FROM kb),
kp AS (SELECT type, ord, term, count(*) tf, any_value(dl) dl FROM (SELECT type, ord, length(t) dl, unnest(t) term FROM kt) GROUP BY 1, 2, 3),
kn AS (SELECT type, count(*) n, avg(length(t)) avgdl FROM kt GROUP BY 1),
ki0 AS (SELECT type, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM kp JOIN kn USING (type) GROUP BY type, term, n),
ki AS (SELECT type, term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM ki0 z WHERE z.type = y.type) ELSE idf END AS idf FROM ki0 y),
gated AS (SELECT * FROM nmentions WHERE length(type || ' |  | ' || '«' || text || '»') % 4 >= 2),
qn AS (SELECT DISTINCT type, norm FROM gated LEFT JOIN uniq USING (doc_id, cid) WHERE n IS DISTINCT FROM 1),
qt AS (SELECT type, norm, term, count(*) qtf FROM (SELECT type, norm, unnest({o.toks('norm')}) term FROM qn) GROUP BY 1, 2, 3),
qs AS (SELECT type, norm, ord, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM qt JOIN kp USING (type, term) JOIN ki USING (type, term) JOIN kn USING (type) GROUP BY 1, 2, 3),
best AS (SELECT type, norm, arg_min(code, (-score, ord)) AS code FROM qs JOIN kt USING (type, ord) GROUP BY 1, 2)""",
                        """SELECT m.doc_id, m.cid, coalesce(CASE WHEN g.doc_id IS NULL THEN '' WHEN u.n = 1 THEN u.code ELSE b.code END, '') AS code
  FROM nmentions m LEFT JOIN gated g USING (doc_id, cid) LEFT JOIN uniq u USING (doc_id, cid) LEFT JOIN best b ON b.type = m.type AND b.norm = m.norm"""))
def map_gated(spark, sf):
    kb = dv.part_kb(spark, sf)
    mentions = dv.part_mentions(spark, sf)
    own = _one_per_document(mentions)
    docs = own.select("doc_id", "text")
    mapped = mapping.map_gated(docs, own, gate_logits, 0.5, kb=kb, searchers=_part_searchers(kb), topk=TOP_K)
    return mapped.select(F.split("doc_id", ":")[0].cast("long").alias("doc_id"), "cid", _joined("candidates").alias("code"))


def last_code():
    """Stand-in reranker: picks the last listed code, or none for long prompts."""

    def run(system: str, prompts: list[str]) -> list[str]:
        return ["NONE" if len(p) % 5 == 0 else p.split("\n")[-2].split("\t")[0] for p in prompts]

    return run


@query("map_reranked")
def map_reranked(spark, sf):
    kb = dv.part_kb(spark, sf)
    own = _one_per_document(dv.part_mentions(spark, sf))
    prior = mapping.fit_prior(dv.order_gold(spark, sf))
    mapped = mapping.map_reranked(own.select("doc_id", "text"), own, kb, _part_searchers(kb), last_code, prior, topk=TOP_K)
    return mapped.select(F.split("doc_id", ":")[0].cast("long").alias("doc_id"), "cid", _joined("candidates").alias("code"))


@query("gate_examples", o.q(o.INPUTS, f"SELECT doc_id, cid, input AS text, CAST(length(candidates) > 0 AS INT) AS label, type FROM inputs WHERE type IN {o.HAS_CODE}"))
def gate_examples(spark, sf):
    docs = dv.shared_outlines(spark, sf)
    return mapping.gate_examples(docs, dv.word_concepts(docs, 4))


# ---- scoring and tuning ---------------------------------------------------------------------

def _order_sides(spark, sf):
    return dv.order_docs(spark, sf), dv.order_gold(spark, sf), dv.order_pred(spark, sf)


@query("item_counts", o.q(o.GOLD, f"""SELECT doc_id, start, "end", type, v AS value, count(*) AS n FROM (SELECT doc_id, start, "end", type, unnest(candidates) v FROM gold WHERE type IN {o.HAS_CODE}) GROUP BY ALL"""))
def item_counts(spark, sf):
    return metrics.item_counts(dv.order_gold(spark, sf), "candidates", "concept").select("doc_id", "key.*", "value", "n")


for _mode in ("value", "concept"):
    def _documents(spark, sf, mode=_mode):
        scored = metrics.document_scores(*_order_sides(spark, sf), mode)
        return scored.select("doc_id", *[F.round(c, 6).alias(c) for c in ("text", "assertions", "candidates")],
                             F.col("weight").cast("long").alias("weight"))

    def _dataset(spark, sf, mode=_mode):
        row = metrics.score_dataset(*_order_sides(spark, sf), mode)
        return row.select(*[F.round(c, 6).alias(c) for c in ("text", "assertions", "candidates", "final")])

    query(f"document_scores_{_mode}", o.q(o.scores(_mode), "SELECT doc_id, round(text, 6) AS text, round(assertions, 6) AS assertions, round(candidates, 6) AS candidates, weight FROM per_doc"))(_documents)
    query(f"score_dataset_{_mode}", o.q(o.scores(_mode), """SELECT round(t, 6) AS text, round(a, 6) AS assertions, round(c, 6) AS candidates, round(0.3 * t + 0.3 * a + 0.4 * c, 6) AS final
  FROM (SELECT avg(text) t, avg(assertions) a, sum(candidates * weight) / sum(weight) c FROM per_doc)"""))(_dataset)


@query("f1_thresholds", o.q(o.GOLD, """
, long AS (SELECT unnest(['isNegated','isFamily','isHistorical']) AS label, unnest(p) AS p, unnest(list_transform(['isNegated','isFamily','isHistorical'], lambda a: list_contains(assertions, a))) AS g FROM probs),
grid AS (SELECT i / 20 AS t FROM range(2, 19) x(i)),
f AS (SELECT label, t, 2 * count(*) FILTER (p >= t AND g) / nullif(2 * count(*) FILTER (p >= t AND g) + count(*) FILTER ((p >= t) <> g), 0) AS f1 FROM long, grid GROUP BY 1, 2)
SELECT label, round(arg_min(t, (-coalesce(f1, 0), t)), 6) AS threshold, round(max(coalesce(f1, 0)), 6) AS f1 FROM f GROUP BY 1""".strip()).replace("\n,", ","))
def f1_thresholds(spark, sf):
    scored = dv.order_probabilities(spark, sf).select("p", ctx.multi_hot(F.col("assertions")).alias("gold"))
    return metrics.f1_thresholds(scored).select("label", F.round("threshold", 6).alias("threshold"), F.round("f1", 6).alias("f1"))


@query("tune_gate", o.q(o.GOLD + f""",
grid AS (SELECT i / 20 AS t FROM range(0, 20) x(i)),
el AS (SELECT * FROM probs WHERE type IN {o.HAS_CODE}),
items AS (SELECT doc_id, mode, CASE WHEN mode = 'concept' THEN start ELSE 0 END AS start, CASE WHEN mode = 'concept' THEN type ELSE '' END AS type, v, g, prob
  FROM (SELECT doc_id, start, type, unnest(candidates) v, 1 g, 0.0 prob FROM el UNION ALL SELECT doc_id, start, type, unnest(picked), 0, gate FROM el), (SELECT unnest(['concept','value']) AS mode)),
c1 AS (SELECT doc_id, mode, t, sum(g) g, sum(CASE WHEN g = 0 AND prob >= t THEN 1 ELSE 0 END) p FROM items, grid GROUP BY doc_id, mode, t, start, type, v),
c2 AS (SELECT doc_id, mode, t, sum(least(g, p)) i, sum(greatest(g, p)) u, sum(g) ng FROM c1 GROUP BY 1, 2, 3),
wt AS (SELECT doc_id, sum(length(candidates) + 1) w FROM el GROUP BY 1),
ev AS (SELECT t, sum(CASE WHEN mode = 'concept' THEN 2 / 3 ELSE 1 / 3 END * w * CASE WHEN u = 0 THEN 1.0 WHEN ng = 0 THEN 0.0 ELSE i / u END) / (SELECT sum(w) FROM wt) AS s FROM c2 JOIN wt USING (doc_id) GROUP BY 1)""",
                        "SELECT round(arg_min(t, (-round(s, 12), t)), 6) AS threshold, round(max(s), 6) AS score FROM ev"))
def tune_gate(spark, sf):
    t, s = metrics.tune_gate(dv.order_docs(spark, sf), dv.order_probabilities(spark, sf))
    return spark.createDataFrame([(round(t, 6), round(s, 6))], "threshold double, score double")


@query("tune_assertions")
def tune_assertions(spark, sf):
    th, s = metrics.tune_assertions(dv.order_docs(spark, sf), dv.order_probabilities(spark, sf))
    return spark.createDataFrame([(*th, round(s, 9))], "negated double, family double, historical double, score double")


# ---- alignment, clusters, grafting ----------------------------------------------------------

def _projected(spark, sf):
    sources = dv.passages(spark, sf)
    gold = dv.word_concepts(sources, 5)
    targets = dv.documents(spark, sf)
    return targets, sources, gold, al.project_labels(targets, sources, gold)


@query("align_segments")
def align_segments(spark, sf):
    return al.align(dv.documents(spark, sf), dv.passages(spark, sf)).select("dst", "src", "t_start", "t_end", "s_start")


@query("project_labels")
def project_labels(spark, sf):
    return _flat(_projected(spark, sf)[3][0])


@query("build_dev")
def build_dev(spark, sf):
    targets, sources, gold, projected = _projected(spark, sf)
    dev = al.build_dev(targets, sources, gold, projected=projected)
    return dev.select("doc_id", F.round("coverage", 6).alias("coverage"), "n_concepts",
                      _joined(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))


@query("leave_sources_out")
def leave_sources_out(spark, sf):
    targets, sources, gold, projected = _projected(spark, sf)
    return al.leave_sources_out(sources, al.build_dev(targets, sources, gold, projected=projected)).select("doc_id")


@query("graft", o.q(o.GOLD + "," + o.SPANS, f"""SELECT doc_id, text, type, start, "end", array_to_string(assertions, '|') AS assertions, array_to_string(candidates, '|') AS candidates
  FROM (SELECT * FROM pred p WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = p.doc_id AND p.start < s.e AND s.s < p."end")
  UNION ALL SELECT * FROM gold p WHERE EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = p.doc_id AND p.start < s.e AND s.s < p."end"))"""))
def graft(spark, sf):
    _, gold, pred = _order_sides(spark, sf)
    return _flat(postprocess.graft(pred, gold, dv.order_spans(spark, sf))).drop("cid")


@query("near_duplicates", o.q(o.DOCS, r""",
sh AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) AS g
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') w FROM docs) WHERE length(w) >= 8),
sz AS (SELECT doc_id, count(*) n FROM sh GROUP BY 1),
jp AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) i FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
ed AS (SELECT a, b FROM jp JOIN sz x ON x.doc_id = a JOIN sz y ON y.doc_id = b WHERE i >= 0.3 * (x.n + y.n - i)),
both_ways AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
walk AS (SELECT a AS node, a AS root FROM both_ways UNION SELECT e.b, w.root FROM walk w JOIN both_ways e ON e.a = w.node)
SELECT node AS doc_id, min(root) AS cluster FROM walk GROUP BY 1""".strip()).replace("WITH ", "WITH RECURSIVE ").replace("\n,", ","))
def near_duplicates(spark, sf):
    return cluster.near_duplicates(dv.documents(spark, sf))


@query("vote_clusters")
def vote_clusters(spark, sf):
    docs = dv.documents(spark, sf)
    return _flat(cluster.vote_all(docs, dv.word_concepts(docs, 9)))


# ---- post-processing, pools, synthesis, pipeline --------------------------------------------

_BEST_TYPE = """
ut AS (SELECT doc_id, k, arg_min(type, (-n, first)) AS best FROM (SELECT doc_id, lower(trim(text)) AS k, type, count(*) n, min(cid) AS first FROM pred GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query("unify_types", o.q(o.GOLD + "," + _BEST_TYPE, "SELECT p.doc_id, cid, best AS type FROM pred p JOIN ut ON ut.doc_id = p.doc_id AND k = lower(trim(text))"))
def unify_types(spark, sf):
    return postprocess.unify_types(dv.order_pred(spark, sf)).select("doc_id", "cid", "type")


def _unified(source: str) -> str:
    return f"""
ul AS (SELECT doc_id, k, type, arg_min(candidates, (-n, first)) AS best FROM (SELECT doc_id, lower(trim(text)) AS k, type, candidates, count(*) n, min(cid) AS first FROM {source} WHERE length(candidates) > 0 GROUP BY ALL) GROUP BY 1, 2, 3),
unified AS (SELECT p.doc_id, p.cid, p.text, p.type, p.start, p."end", p.assertions, coalesce(best, p.candidates) AS candidates FROM {source} p LEFT JOIN ul ON ul.doc_id = p.doc_id AND k = lower(trim(text)) AND ul.type = p.type)"""


@query("unify_labels", o.q(o.GOLD + "," + _unified("pred"), "SELECT doc_id, cid, array_to_string(candidates, '|') AS candidates FROM unified"))
def unify_labels(spark, sf):
    return postprocess.unify_labels(dv.order_pred(spark, sf)).select("doc_id", "cid", _joined("candidates").alias("candidates"))


_LINES_AS_CONCEPTS = o.DOCS + r""",
dl AS (SELECT doc_id, CAST(i - 1 AS INT) AS cid, t AS text FROM (SELECT doc_id, unnest(l) t, generate_subscripts(l, 1) i FROM (SELECT doc_id, string_split(text, chr(10)) l FROM docs)))"""


def _text_lines(spark, sf):
    return dv.documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("cid", "text"))


@query("drop_redacted", o.q(_LINES_AS_CONCEPTS, "SELECT doc_id, cid, text FROM dl WHERE text NOT LIKE '%***%'"))
def drop_redacted(spark, sf):
    return postprocess.drop_redacted(_text_lines(spark, sf))


@query("drop_headings", o.q(o.HEADINGS, r"""SELECT doc_id, CAST(n - 1 AS INT) AS cid, line AS text FROM hl1 WHERE lower(trim(trim(regexp_replace(line, '\s+', ' ', 'g')), E':.-•* \t')) NOT IN ('shipping notes', 'status o', '')"""))
def drop_headings(spark, sf):
    lines = dv.outlines(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("cid", "text"))
    return postprocess.drop_headings(lines, ("shipping notes", "status o", ""))


@query("postprocess", o.q(o.GOLD + "," + _BEST_TYPE + """,
typed AS (SELECT p.* REPLACE (best AS type) FROM pred p JOIN ut ON ut.doc_id = p.doc_id AND k = lower(trim(text))),""" + _unified("typed"), f"SELECT {FLAT} FROM unified"))
def postprocess_all(spark, sf):
    return _flat(postprocess.apply(dv.order_pred(spark, sf)))


@query("concept_pool", o.q(o.GOLD, "SELECT type, coalesce(assertions[1], '') AS akey, count(*) AS n FROM gold GROUP BY 1, 2"))
def concept_pool(spark, sf):
    return synth.build_pool(dv.order_gold(spark, sf)).groupBy("type", F.coalesce("akey", F.lit("")).alias("akey")).agg(F.count("*").alias("n"))


@query("kb_pool")
def kb_pool(spark, sf):
    return synth.kb_pool(dv.part_kb(spark, sf)).select("type", "akey", "text", _joined("assertions").alias("assertions"), _joined("candidates").alias("candidates"))


@query("synthesize")
def synthesize(spark, sf):
    docs = dv.turns(spark, sf)
    gold = dv.word_concepts(docs, 8)
    pool = synth.merge_pools(synth.build_pool(gold), synth.kb_pool(dv.part_kb(spark, sf)))
    made = synth.synthesize(spark, pool, n=docs.count(), seed=7, labelled=(docs, gold))
    return made.select("doc_id", "text", F.size("concepts").alias("n_concepts"))


@query("annotate_documents", o.q(o.TAGGED + "," + o.rules("tagged", "docs") + f""",
lk AS (SELECT type, {o.key('text')} AS key, 'B' || doc_id AS code, count(*) n, min((doc_id, cid)) AS first FROM pp WHERE type IN {o.HAS_CODE} GROUP BY ALL),
lkb AS (SELECT type, key, arg_min(code, (-n, first)) AS code FROM lk GROUP BY 1, 2)""",
                                 f"""SELECT a.doc_id, a.cid, a.text, a.type, a.start, a."end", array_to_string(labels, '|') AS assertions, coalesce(CASE WHEN a.type IN {o.HAS_CODE} THEN l.code END, '') AS candidates
  FROM asserted a LEFT JOIN lkb l ON l.type = a.type AND l.key = {o.key('a.text')}"""))
def annotate_documents(spark, sf):
    """Tag, assert, map and validate all documents with a dictionary learned from the passages."""
    return annotate_with_passages(spark, sf)


def annotate_with_passages(spark: SparkSession, sf: str) -> DataFrame:
    known = dv.pair_concepts(dv.passages(spark, sf)).withColumn(
        "candidates", F.array(F.concat(F.lit("B"), F.col("doc_id").cast("string"))))
    phrases, lookup = tagging.fit_gazetteer(known), mapping.fit_lookup(known)
    return _flat(annotate(
        dv.documents(spark, sf), tagger=lambda d: tagging.tag(d, phrases),
        asserter=lambda d, c: assertion.annotate_rules(d, c, **CUES),
        mapper=lambda d, c: mapping.map_lookup(c, lookup)))
