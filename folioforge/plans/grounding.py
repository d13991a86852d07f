"""Queries over lexicon match, routing, parsing of answers, and the judge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.text import space_words
from folioforge.operators import grounding, judge
from folioforge.plans import segments
from folioforge.plans.registry import query
from folioforge.plans.text import WORD, WS, docs
from folioforge.session import table

#: Fingerprints of the documents, some of which are in many.
LEXICON = [("e1", 0, "The and attion to thanedble"), ("e2", 1, "THE  and"), ("e3", 2, "nicht aulich für"), ("e4", 3, "la des et."), ("e5", 4, "not in any text")]
TERMS = [("e1", 0, "in our power", "eph' hēmin", "up to us"), ("e2", 1, "in our power", "other", "later"), ("e3", 2, "function", "ergon", "what a thing is for"), ("e4", 3, "desire", "orexis", "reaching")]
SOURCES = [("Stoic", "Epictetus"), ("", "Nobody"), ("Stoic", "Seneca"), ("Platonic", "Plato"), (None, "Plato")]


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") AS v({names})"


def _fold(x: str) -> str:
    return f"array_to_string(list_filter(regexp_split_to_array(lower({x}), '{WS}+'), lambda w: w <> ''), ' ')"


_HIT = f"""WITH p AS (SELECT doc_id AS passage_id, left({_fold('text')}, 300) AS prefix FROM documents), l AS (SELECT entry_id, ord, {_fold('fingerprint')} AS print FROM {_values(LEXICON, 'entry_id, ord, fingerprint')})"""


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = spark.createDataFrame(LEXICON, "entry_id string, ord int, fingerprint string")
    return grounding.lexicon_match(docs(spark, sf_dir).select(F.col("doc_id").alias("passage_id"), "text"), lexicon)


@query(f"{_HIT} SELECT p.passage_id, arg_min(entry_id, ord) AS entry_id FROM p LEFT JOIN l ON contains(prefix, print) GROUP BY p.passage_id")
def lexicon_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select("passage_id", "entry_id")


_WINDOWS = f"""(SELECT item_id || '/' || k AS entry_id, item_id * 100000 + k AS ord, array_to_string(w[k:k + 2], ' ') AS fingerprint
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS k FROM (SELECT item_id, list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '') AS w FROM benchmark)))"""


@query(
    f"""WITH p AS (SELECT doc_id AS passage_id, left({_fold('text')}, 300) AS prefix FROM documents), l AS (SELECT entry_id, ord, {_fold('fingerprint')} AS print FROM {_WINDOWS})
    SELECT p.passage_id, arg_min(entry_id, ord) AS entry_id FROM p LEFT JOIN l ON contains(prefix, print) GROUP BY p.passage_id"""
)
def window_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three-word window of a benchmark text in the first page of each document: a lexicon of many entries."""
    items = table(spark, sf_dir, "benchmark").select("item_id", space_words(F.col("text")).alias("w"))
    placed = items.where(F.size("w") > 2).select("item_id", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 2)).alias("k"))
    lexicon = placed.select(F.concat_ws("/", "item_id", "k").alias("entry_id"), (F.col("item_id") * 100_000 + F.col("k")).alias("ord"), F.array_join(F.slice("w", F.col("k"), 3), " ").alias("fingerprint"))
    passages = docs(spark, sf_dir).select(F.col("doc_id").alias("passage_id"), "text")
    return grounding.lexicon_match(passages, lexicon).select("passage_id", "entry_id")


@query(f"SELECT english, arg_min(substrate, ord) AS substrate, arg_min(gloss, ord) AS gloss FROM {_values(TERMS, 'entry_id, ord, english, substrate, gloss')} GROUP BY english")
def substrate_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.substrate_map(spark.createDataFrame(TERMS, "entry_id string, ord int, english string, substrate string, gloss string"))


@query(f"SELECT list_sort(list(DISTINCT tradition) FILTER (trim(tradition) <> '')) AS traditions, list_sort(list(DISTINCT author)) AS authors, count(*) AS entries FROM {_values(SOURCES, 'tradition, author')}")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.coverage(spark.createDataFrame(SOURCES, "tradition string, author string"))


ANSWERS = [
    (0, "PARAPHRASE:\nSome things are up to us.\n\nGLOSSARY:\n- in our power (`eph' hēmin`): what is up to us\n- `made up`: wrong\n"),
    (1, "paraphrase (simple): Short.\nglossary:\n* `ergon` (function): *what it is for*\n• plain: \"quoted\"\nno colon here\n- empty:\n"),
    (2, "  just text, no headings  "),
    (3, ""),
    (4, "PARAPHRASE: a: b\nand more"),
]
KNOWN = {"eph' hēmin": "in our power", "ergon": "function"}
#: The answers above, and one from each document: its text as paraphrase, its source and language as glossary.
_ANSWERS = f"""(SELECT * FROM {_values(ANSWERS, 'answer_id, raw')} UNION ALL
    SELECT 1000 + doc_id, 'Paraphrase (' || lang || '):  ' || text || chr(10) || 'GLOSSARY:' || chr(10) || '- ' || lang || ' (`' || CASE WHEN lang = 'en' THEN 'ergon' ELSE source END || '`): *' || source || '*' || chr(10) || '* plain: x' || chr(10) || 'no entry'
    FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL)"""


def _bare(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _unquoted(x: str) -> str:
    return f"""regexp_replace({_bare(x)}, '^[*"'']+|[*"'']+$', '', 'g')"""


_KNOWN = "MAP {" + ", ".join("'" + k.replace("'", "''") + f"': '{v}'" for k, v in KNOWN.items()) + "}"
_PARSE = f"""WITH a AS (SELECT answer_id, guarded, raw FROM {_ANSWERS}, (SELECT unnest([false, true]) AS guarded)),
    p AS (SELECT answer_id, guarded, {_bare(f"CASE WHEN regexp_matches(raw, '(?si)PARAPHRASE[^:]*:{WS}*.') THEN regexp_extract(raw, '(?si)PARAPHRASE[^:]*:{WS}*(.+?)(?:GLOSSARY:|$)', 1) ELSE raw END")} AS paraphrase,
          regexp_split_to_array(regexp_extract(raw, '(?si)GLOSSARY:{WS}*(.+)', 1), '\r?\n') AS lines FROM a),
    l AS (SELECT answer_id, guarded, k, {_bare(f"regexp_replace({_bare('line')}, '^[-*•]+', '')")} AS line FROM (SELECT answer_id, guarded, unnest(lines) AS line, unnest(range(len(lines))) AS k FROM p)),
    c AS (SELECT *, left(line, position(':' IN line) - 1) AS before, {_unquoted("substr(line, position(':' IN line) + 1)")} AS gloss FROM l WHERE position(':' IN line) > 0),
    s AS (SELECT *, CASE WHEN regexp_matches(before, '`[^`]+`') THEN {_bare("regexp_extract(before, '`([^`]+)`', 1)")} END AS substrate_term,
          {_unquoted("regexp_replace(regexp_replace(before, '`[^`]+`', '', 'g'), '\\([^)]*\\)', '', 'g')")} AS named FROM c),
    e AS (SELECT *, coalesce(CASE WHEN guarded THEN {_KNOWN}[substrate_term] END, CASE WHEN named <> '' THEN named ELSE coalesce(substrate_term, '') END) AS term FROM s),
    g AS (SELECT *, row_number() OVER (PARTITION BY answer_id, guarded ORDER BY k) - 1 AS pos FROM e
          WHERE gloss <> '' AND (term <> '' OR substrate_term IS NOT NULL) AND (NOT guarded OR substrate_term IS NULL OR {_KNOWN}[substrate_term] IS NOT NULL))
    SELECT p.answer_id, p.guarded, sha256(paraphrase) AS paraphrase_sha256, pos, term, gloss, substrate_term FROM p LEFT JOIN g ON g.answer_id = p.answer_id AND g.guarded = p.guarded"""


@query(_PARSE)
def parse_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = spark.createDataFrame(ANSWERS, "answer_id long, raw string")
    d = docs(spark, sf_dir).dropna(subset=["text", "lang", "source"])
    substrate = F.when(F.col("lang") == "en", "ergon").otherwise(F.col("source"))
    made = F.concat(F.lit("Paraphrase ("), "lang", F.lit("):  "), "text", F.lit("\nGLOSSARY:\n- "), "lang", F.lit(" (`"), substrate, F.lit("`): *"), "source", F.lit("*\n* plain: x\nno entry"))
    answers = fixed.unionByName(d.select((F.col("doc_id") + 1000).alias("answer_id"), made.alias("raw")))
    known = F.create_map(*[F.lit(x) for kv in KNOWN.items() for x in kv])
    free = grounding.parse_response(answers.withColumn("guarded", F.lit(False)))
    held = grounding.parse_response(answers.withColumn("guarded", F.lit(True)).withColumn("known", known), known_col="known").drop("known")
    entries = free.unionByName(held).select("answer_id", "guarded", F.sha2(F.col("paraphrase").cast("binary"), 256).alias("paraphrase_sha256"), F.posexplode_outer("glossary").alias("pos", "e"))
    return entries.select("answer_id", "guarded", "paraphrase_sha256", F.col("pos").cast("long").alias("pos"), "e.term", "e.gloss", "e.substrate_term")


_MODE = "CASE passage_id % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'jit' WHEN 2 THEN 'no-substrate' ELSE 'auto' END"


@query(
    f"""{_HIT}, m AS (SELECT p.passage_id, arg_min(entry_id, ord) AS entry_id FROM p LEFT JOIN l ON contains(prefix, print) GROUP BY p.passage_id)
    SELECT passage_id, CASE WHEN {_MODE} = 'auto' AND entry_id IS NOT NULL THEN 'curated' WHEN {_MODE} IN ('auto', 'jit') AND passage_id % 5 = 0 THEN 'jit' ELSE 'no-substrate' END AS resolution FROM m"""
)
def route_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("passage_id") % 4 == 1, "jit").when(F.col("passage_id") % 4 == 2, "no-substrate").otherwise("auto")
    answer = F.when(F.col("passage_id") % 5 == 0, '{"terms": ["a term"]}').when(F.col("passage_id") % 5 == 1, '{"terms": ["  "]}').otherwise("broken")
    return grounding.routed(_matched(spark, sf_dir).withColumn("mode", mode).withColumn("terms_json", answer)).select("passage_id", "resolution")


def _judged(pairs: str) -> str:
    """Common table expressions up to jd: support, contradiction_max, introductions and faithful of the
    rows of pairs (pair_id, source, paraphrase)."""
    of = lambda side: segments.sentences(f"(SELECT pair_id, {side} AS text FROM pr)", "pair_id")
    words = f"list_distinct(regexp_extract_all(lower(sentence), '{WORD}'))"
    negated = lambda w: f"list_has_any({w}, ['no', 'not', 'never', 'none'])"
    return f"""pr AS (SELECT * FROM {pairs}),
    pm AS (SELECT pair_id, k, {words} AS w FROM {of('source')}), hy AS (SELECT pair_id, k, {words} AS w FROM {of('paraphrase')}),
    sc AS (SELECT hy.pair_id, hy.k AS h, pm.k AS p, len(list_intersect(pm.w, hy.w)) / greatest(len(hy.w), 1)::DOUBLE AS share, {negated('pm.w')} <> {negated('hy.w')} AS flips FROM hy JOIN pm USING (pair_id)),
    en AS (SELECT *, CASE WHEN flips THEN share * 0.1 ELSE share END AS entail, CASE WHEN flips THEN share * 0.8 ELSE 0 END AS contradict FROM sc),
    bs AS (SELECT pair_id, h, coalesce(max(entail) FILTER (entail > 0), 0) AS e, coalesce(arg_min(contradict, {{'a': -entail, 'b': p}}) FILTER (entail > 0), 0) AS c FROM en GROUP BY pair_id, h),
    ag AS (SELECT pair_id, round(avg(e), 6) AS support, max(c) AS contradiction_max, count(*) FILTER (e < 0.5) AS introductions FROM bs GROUP BY pair_id),
    jd AS (SELECT pair_id, coalesce(support, 0)::DOUBLE AS support, coalesce(contradiction_max, 0)::DOUBLE AS contradiction_max, coalesce(introductions, 0) AS introductions,
           coalesce(support > 0.6 AND contradiction_max < 0.1, false) AS faithful FROM pr LEFT JOIN ag USING (pair_id))"""


_TURNS = "(SELECT conv_id || '/' || turn AS passage_id, text FROM conversations)"
_HIT_TURN = f"(SELECT t.passage_id, t.text, arg_min(entry_id, ord) AS entry_id FROM (SELECT *, left({_fold('text')}, 300) AS prefix FROM {_TURNS}) t LEFT JOIN (SELECT entry_id, ord, {_fold('fingerprint')} AS print FROM {_values(LEXICON, 'entry_id, ord, fingerprint')}) ON contains(prefix, print) GROUP BY ALL)"


@query(
    f"""WITH {_judged(f"(SELECT passage_id AS pair_id, text AS source, {_bare('text')} AS paraphrase FROM {_TURNS})")}, ht AS (SELECT * FROM {_HIT_TURN}),
    kn AS (SELECT DISTINCT entry_id FROM {_values(TERMS, 'entry_id, ord, english, substrate, gloss')}), er AS (SELECT DISTINCT entry_id FROM {_values(TERMS, 'entry_id, ord, english, substrate, gloss')} WHERE substrate = 'ergon')
    SELECT passage_id, CASE WHEN entry_id IS NULL THEN 'no-substrate' ELSE 'curated' END AS resolution,
           CASE WHEN entry_id IN (SELECT entry_id FROM kn) AND entry_id NOT IN (SELECT entry_id FROM er) THEN 0 ELSE 1 END AS entries, support, contradiction_max, faithful
    FROM ht JOIN jd ON pair_id = passage_id"""
)
def ground_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole path over the conversations' turns, with a model that repeats its passage."""
    turns = table(spark, sf_dir, "conversations").select(F.format_string("%d/%d", "conv_id", "turn").alias("passage_id"), "text", F.lit(None).cast("string").alias("author"), F.lit("simple").alias("tier"), F.lit("auto").alias("mode"))
    lexicon = spark.createDataFrame(LEXICON, "entry_id string, ord int, fingerprint string")
    echo = lambda prompt: F.concat(F.lit("PARAPHRASE: "), F.regexp_extract(prompt, '(?s)"""\n(.*)\n"""', 1), F.lit("\nGLOSSARY:\n- it (`ergon`): that"))
    terms = spark.createDataFrame(TERMS, "entry_id string, ord int, english string, substrate string, gloss string")
    routed = grounding.routed(grounding.identified(grounding.lexicon_match(turns, lexicon), lambda prompt: F.lit('{"terms": []}')))
    answered = grounding.grounded(routed, terms, echo)
    scored = judge.score_paraphrases(answered.select("passage_id", "text", "paraphrase"), "passage_id", "text", "paraphrase")
    return answered.select("passage_id", "resolution", F.size("glossary").alias("entries")).join(scored.select("passage_id", "support", "contradiction_max", "faithful"), "passage_id")


#: id, hyp_ord, hyp, prem_ord, entail, contradict
MATRIX = [
    (0, 0, "a", 0, 0.9, 0.0), (0, 0, "a", 1, 0.2, 0.9), (1, 0, "a", 0, 0.5, 0.05), (1, 0, "a", 1, 0.5, 0.4), (2, 0, "a", 0, 0.0, 0.9), (2, 1, "b", 0, 0.0, 0.7),
    (3, 0, "a", 0, 0.8, 0.1), (3, 1, "b", 0, 0.3, 0.2), (3, 2, "c", 0, 0.49, 0.3), (4, 0, "a", 0, 0.7, 0.099), (4, 1, "b", 1, 0.65, 0.0), (5, 0, "a", 0, 0.6, 0.0), (6, 0, "a", 3, 0.61, 0.1),
]
_M = _values(MATRIX, "pair_id, hyp_ord, hyp, prem_ord, entail, contradict")
_NLI = f"""WITH b AS (SELECT pair_id, hyp_ord, hyp, coalesce(max(entail) FILTER (entail > 0), 0)::DOUBLE AS e, coalesce(arg_min(contradict, {{'a': -entail, 'b': prem_ord}}) FILTER (entail > 0), 0)::DOUBLE AS c FROM {_M} GROUP BY ALL),
    a AS (SELECT pair_id, round(avg(e), 6) AS support, max(c) AS contradiction_max, coalesce(list(hyp ORDER BY hyp_ord) FILTER (e < 0.5), []) AS introductions FROM b GROUP BY pair_id)"""


def _aggregated(spark: SparkSession) -> DataFrame:
    return judge.aggregate(spark.createDataFrame(MATRIX, "pair_id int, hyp_ord int, hyp string, prem_ord int, entail double, contradict double"), "pair_id")


@query(f"{_NLI} SELECT * FROM a")
def nli_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aggregated(spark)


@query(f"{_NLI} SELECT pair_id, support > 0.6 AND contradiction_max < 0.1 AS faithful, 0.6::DOUBLE AS support_floor, 0.1::DOUBLE AS contradiction_ceiling FROM a")
def nli_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.with_verdict(_aggregated(spark)).select("pair_id", "faithful", "support_floor", "contradiction_ceiling")


@query(f"{_NLI} SELECT pair_id FROM a WHERE support > 0.6 AND contradiction_max < 0.1")
def nli_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aggregated(spark).where(judge.is_faithful()).select("pair_id")


_PAIRS = "(SELECT a.conv_id || '/' || a.turn AS pair_id, u.text AS source, a.text AS paraphrase FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant' AND u.role = 'user')"


@query(f"WITH {_judged(_PAIRS)} SELECT * FROM jd")
def judged_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn against the user turn before it, by word overlap."""
    turns = table(spark, sf_dir, "conversations")
    said = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("source"))
    pairs = turns.where("role = 'assistant'").join(said, ["conv_id", "turn"]).select(F.format_string("%d/%d", "conv_id", "turn").alias("pair_id"), "source", F.col("text").alias("paraphrase"))
    return judge.score_paraphrases(pairs, "pair_id", "source", "paraphrase").select("pair_id", "support", "contradiction_max", F.size("introductions").alias("introductions"), "faithful")
