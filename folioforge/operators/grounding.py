"""Grounded paraphrase: lexicon match, routing, prompts, parsing of model answers.

A model is any function from a prompt column to an answer column, a pandas UDF as a
rule; nothing here depends on one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import folded, render, trim
from folioforge.operators.containment import matches
from folioforge.operators.harvest import parsed_terms
from folioforge.session import broadcast_if_small, cut

PREFIX = 300
ENTRY = "array<struct<term:string,gloss:string,substrate_term:string>>"

#: Whom each tier writes for. Prompts take these and a passage.
AUDIENCE = {
    "simple": "readers of about fifteen who have read no philosophy. Write plainly, in short sentences. Say only what the passage says: no persons, ties or details of your own, nothing made vaguer or more general, and no remarks about the passage.",
    "standard": "students in a first course of philosophy. Write clear academic English and add no facts, persons or examples.",
    "scholarly": "readers at home in technical philosophical prose. Keep its register and the whole of its argument; each claim must be one that the passage makes.",
}
FORM = 'Answer in this form:\n\nPARAPHRASE:\n[the paraphrase]\n\nGLOSSARY:\n- term (`original term`): meaning\n\nPASSAGE:\n"""\n{passage}\n"""\n'
PROMPTS = {
    "curated": "Rewrite a passage by {author} for {audience}\n\nKeep these terms as they are and use no others:\n\n{substrate}\n\n" + FORM,
    "jit": "Rewrite a passage for {audience}\n\nKeep these terms as they are:\n{terms_list}\n\nLeave out an original term that you are not sure of.\n\n" + FORM,
    "no-substrate": "Rewrite a passage for {audience}\n\nKeep its terms of art as they are and add nothing that it does not say.\n\n" + FORM,
}
IDENTIFY = 'List the phrases of the passage that translate a technical term.\nAnswer with JSON only: {"terms": ["phrase 1", "phrase 2"]}\n\nPASSAGE:\n"""\n{passage}\n"""\n'


def audience(tier: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in AUDIENCE.items() for x in kv])[tier]


def lexicon_match(passages: DataFrame, lexicon: DataFrame, text_col: str = "text") -> DataFrame:
    """passages with entry_id, the first entry (by ord) whose fingerprint, case and white space
    aside, is in their first 300 characters; null if none is. lexicon: entry_id, ord,
    fingerprint, of any number."""
    prefix = F.substring(folded(F.col(text_col)), 1, PREFIX)
    prints = cut(lexicon.groupBy(folded(F.col("fingerprint")).alias("pattern")).agg(F.min("ord").alias("number"), F.min_by("entry_id", "ord").alias("entry_id")))
    hits = matches(passages.select(F.col("passage_id").alias("key"), prefix.alias("text")), prints.select("number", "pattern"), first=True)
    named = hits.join(broadcast_if_small(prints.select("pattern", "entry_id"), prints.count()), "pattern")
    first = named.groupBy(F.col("key").alias("passage_id")).agg(F.min_by("entry_id", F.struct("number", "pattern")).alias("entry_id"))
    return passages.join(first, "passage_id", "left")


def substrate_map(terms: DataFrame) -> DataFrame:
    """english, substrate and gloss; of entries with one english term the first (by ord)."""
    return terms.withColumn("n", F.row_number().over(Window.partitionBy("english").orderBy("ord"))).where("n = 1").select("english", "substrate", "gloss")


def coverage(sources: DataFrame) -> DataFrame:
    """Distinct traditions, blank ones aside, and authors, sorted, and the number of entries."""
    named = F.when(trim(F.col("tradition")) != "", F.col("tradition"))
    return sources.agg(F.array_sort(F.collect_set(named)).alias("traditions"), F.array_sort(F.collect_set("author")).alias("authors"), F.count(F.lit(1)).alias("entries"))


def paraphrase_of(answer: Column) -> Column:
    """What follows the paraphrase heading, up to the glossary; the whole answer without one."""
    pattern = r"(?si)PARAPHRASE[^:]*:(?U:\s)*(.+?)(?:GLOSSARY:|$(?![\n\r]))"
    return trim(F.when(answer.rlike(pattern), F.regexp_extract(answer, pattern, 1)).otherwise(answer))


def glossary_of(answer: Column, known: Column | None = None) -> Column:
    """The glossary's entries: lines `- term (`substrate`): gloss`. known, a map of substrate to
    English, names the term, and drops entries whose substrate it lacks."""
    body = F.regexp_extract(answer, r"(?si)GLOSSARY:(?U:\s)*(.+)", 1)
    lines = F.transform(F.split(body, r"\r?\n"), lambda x: trim(F.regexp_replace(trim(x), r"^[-*•]+", "")))

    def entry(line: Column) -> Column:
        colon = F.instr(line, ":")
        before = F.substring(line, F.lit(1), colon - 1)
        unquoted = lambda x: F.regexp_replace(trim(x), "^[*\"']+|[*\"']+$", "")
        gloss = unquoted(F.substring(line, colon + 1, F.length(line)))
        ticked = before.rlike("`[^`]+`")
        substrate = F.when(ticked, trim(F.regexp_extract(before, "`([^`]+)`", 1)))
        bare = unquoted(F.regexp_replace(F.regexp_replace(before, "`[^`]+`", ""), r"\([^)]*\)", ""))
        term = F.when(bare != "", bare).otherwise(F.coalesce(substrate, F.lit("")))
        listed = F.lit(True)
        if known is not None:
            english = F.try_element_at(known, substrate)
            term = F.coalesce(english, term)
            listed = F.coalesce(known.isNull() | substrate.isNull() | F.map_contains_key(known, substrate), F.lit(True))
        good = (colon > 0) & (gloss != "") & listed & ((term != "") | substrate.isNotNull())
        return F.when(good, F.struct(term.alias("term"), gloss.alias("gloss"), substrate.alias("substrate_term")))

    return F.filter(F.transform(F.filter(lines, lambda x: x != ""), entry), lambda e: e.isNotNull()).cast(ENTRY)


def parse_response(answers: DataFrame, answer_col: str = "raw", known_col: str | None = None) -> DataFrame:
    known = F.col(known_col) if known_col else None
    return answers.withColumn("paraphrase", paraphrase_of(F.col(answer_col))).withColumn("glossary", glossary_of(F.col(answer_col), known))


def routed(passages: DataFrame) -> DataFrame:
    """passages (mode, entry_id, terms_json) with terms and resolution: curated where a lexicon
    entry matches and the mode allows it, jit where terms are found, else no-substrate. Mode
    curated without an entry fails the query."""
    terms = parsed_terms(F.col("terms_json"))
    hit = F.col("mode").isin("auto", "curated") & F.col("entry_id").isNotNull()
    missing = F.raise_error(F.lit("no curated substrate for this passage; use auto or jit")).cast("string")
    resolution = (
        F.when(hit, "curated").when(F.col("mode") == "curated", missing).when(F.col("mode").isin("auto", "jit") & (F.size(terms) > 0), "jit").otherwise("no-substrate")
    )
    return passages.withColumn("terms", terms).withColumn("resolution", resolution)


def prompt(resolution: str, **values: Column) -> Column:
    return render(PROMPTS[resolution], **values)


def identified(passages: DataFrame, model: Callable[[Column], Column], text_col: str = "text") -> DataFrame:
    """passages with terms_json, asked for only where the route may need it."""
    needed = F.col("mode").isin("auto", "jit") & (F.col("entry_id").isNull() | (F.col("mode") == "jit"))
    asked = passages.where(needed).withColumn("terms_json", model(render(IDENTIFY, passage=F.col(text_col))))
    return asked.unionByName(passages.where(~needed).withColumn("terms_json", F.lit(None).cast("string")))


def grounded(passages: DataFrame, terms: DataFrame, model: Callable[[Column], Column]) -> DataFrame:
    """Paraphrase and glossary of routed passages (passage_id, text, author, tier, entry_id, terms,
    resolution). terms: entry_id, english, substrate, gloss of the lexicon."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("english", "substrate", "gloss"))), lambda t: F.concat(F.lit("- "), t["english"], F.lit(" (`"), t["substrate"], F.lit("`): "), t["gloss"])), "\n")
    known = terms.groupBy("entry_id").agg(listed.alias("substrate_list"), F.map_from_entries(F.array_sort(F.array_distinct(F.collect_list(F.struct("substrate", "english"))))).alias("known"))
    joined = passages.join(known, "entry_id", "left")
    for_whom = audience(F.col("tier"))
    asked = F.when(
        F.col("resolution") == "curated", prompt("curated", author=F.coalesce("author", F.lit("unknown")), audience=for_whom, substrate=F.col("substrate_list"), passage=F.col("text"))
    ).when(
        F.col("resolution") == "jit", prompt("jit", audience=for_whom, terms_list=F.array_join(F.transform("terms", lambda t: F.concat(F.lit("- "), t)), "\n"), passage=F.col("text"))
    ).otherwise(prompt("no-substrate", audience=for_whom, passage=F.col("text")))
    answered = joined.withColumn("raw", model(asked)).withColumn("guard", F.when(F.col("resolution") == "curated", F.col("known")))
    return parse_response(answered, "raw", "guard").drop("guard", "known", "substrate_list")


def grounded_globally(passages: DataFrame, terms: DataFrame, model: Callable[[Column], Column]) -> DataFrame:
    """Paraphrase and glossary of passages (passage_id, text, tier) with the terms of the whole lexicon, of each
    English term the first entry's, instead of one matched entry's. The lexicon is curated and small: its
    list is one row."""
    line = F.concat(F.lit("- "), "english", F.lit(" (`"), "substrate", F.lit("`): "), "gloss")
    mapped = substrate_map(terms)
    listed = mapped.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("english", line.alias("line")))), lambda x: x["line"]), "\n").alias("listed"))
    known = mapped.groupBy("substrate").agg(F.max("english").alias("english")).agg(F.map_from_entries(F.collect_list(F.struct("substrate", "english"))).alias("known"))
    every = listed.crossJoin(known)
    asked = prompt("curated", author=F.lit("an author of the library"), audience=audience(F.col("tier")), substrate=F.col("listed"), passage=F.col("text"))
    answered = passages.crossJoin(F.broadcast(every)).withColumn("resolution", F.lit("curated")).withColumn("raw", model(asked))  # one row beside each
    return parse_response(answered, "raw", "known").drop("known", "listed")
