"""Spelling variants: words that are one inserted, deleted or replaced letter apart.

Occurrences are counted into a vocabulary of words, and from there on no pair of words is
ever looked for, only groups:

- Replacement: a word belongs to one wildcard group a position, named by what stands before and
  what stands after it (the position is the length of the first). Two words are in a group if and only
  if they differ in that letter alone, so no two words share two groups. Of a group only its
  size and its top two words count: each member has size - 1 near words there, the best of
  which is the top one, or the second for the top one itself. A group has at most one member a
  letter of the alphabet.
- Insertion and deletion: what a word becomes by losing a letter is looked up in the vocabulary.
  Of equal neighbouring letters only the first is taken out, so no match comes twice. A match
  is a near word of both.

Counts and best words of a word's groups and matches are then summed up by word. A form has at
least twice its word's count, so chains of forms end; their last words come by doubling the links.

Null texts have no words, a null id is written as nothing before the colon, rows that repeat count
as often as they stand there, ties go to the smaller word in code-point order, an empty table
gives no rows. Texts are read whole, of any length. A word of L letters makes L groups; beyond
`LONG` letters their names are digests, so that it takes L rows of bounded size (and a time that grows with
the square of L, of words that occur often enough only). Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.session import cut

#: Letters of words, upper and lower case; only A to Z have a lower case here.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SHORTEST, LEAST, EVERY, TIMES, LONG = 5, 3, 97, 2, 64


def ascii_lower(text: Column) -> Column:
    """text with A to Z in lower case and nothing else changed."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST, every: int = EVERY) -> DataFrame:
    """word and n of the words of at least `shortest` letters that occur at least `least` times.
    An occurrence whose checksum `every` divides loses one letter first (0: none does)."""
    runs = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))
    found = docs.select(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":")).alias("lead"), F.explode(runs).alias("run"))
    found = found.select("lead", ascii_lower(F.col("run")).alias("word"))
    if every:
        hashed = found.select("word", F.crc32(F.concat("lead", "word").cast("binary")).alias("h"))
        at = (F.col("h") % F.length("word")).cast("int")
        torn = F.concat(F.substring("word", F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
        found = hashed.select(F.when(F.col("h") % every == 0, torn).otherwise(F.col("word")).alias("word")).where(F.length("word") >= shortest)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _without_each(words: DataFrame) -> DataFrame:
    """word, n, place, before and after of every letter of every word."""
    placed = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("place"))
    return placed.select("*", F.substring(F.col("word"), F.lit(1), F.col("place")).alias("before"), F.substring(F.col("word"), F.col("place") + 2, F.length("word")).alias("after"))


def _replacements(words: DataFrame) -> DataFrame:
    """word, near, best_n and best of every wildcard group with other members."""
    name = lambda c: F.when(F.length("word") > LONG, F.sha2(F.col(c), 256)).otherwise(F.col(c)).alias(c)
    # a digest is longer than a short word's parts, and the place tells apart parts of other lengths
    named = _without_each(words).select("word", "n", F.when(F.length("word") > LONG, F.col("place")).alias("place"), name("before"), name("after"))
    group = Window.partitionBy("place", "before", "after").orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    member = F.struct("n", "word")
    kept = named.select("word", F.count(F.lit(1)).over(group).alias("size"), F.first(member).over(group).alias("top"), F.nth_value(member, 2).over(group).alias("second"))
    other = F.when(F.col("top.word") == F.col("word"), F.col("second")).otherwise(F.col("top"))
    return kept.where("size > 1").select("word", (F.col("size") - 1).alias("near"), other["n"].alias("best_n"), other["word"].alias("best"))


def _indels(words: DataFrame, shortest: int) -> DataFrame:
    """word, near (1), best_n and best of both words of every match."""
    letter = lambda at: F.substring(F.col("word"), at, F.lit(1))
    first = (F.col("place") == 0) | (letter(F.col("place") + 1) != letter(F.col("place")))
    shorter = _without_each(words.where(F.length("word") > shortest)).where(first).select(F.col("word").alias("longer"), F.col("n").alias("longer_n"), F.concat("before", "after").alias("word"))
    both = shorter.join(words, "word")
    sides = F.array(F.struct(F.col("word"), F.col("longer_n").alias("best_n"), F.col("longer").alias("best")), F.struct(F.col("longer").alias("word"), F.col("n").alias("best_n"), F.col("word").alias("best")))
    return both.select(F.explode(sides).alias("side")).select("side.word", F.lit(1).cast("long").alias("near"), "side.best_n", "side.best")


def _roots(forms: DataFrame) -> DataFrame:
    """word and root, the last form, of every word that has a form; forms: word, form."""
    reached = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if reached.join(further.select("root"), "root", "left_semi").isEmpty():
            return reached
        reached = cut(reached.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")))


def variants(words: DataFrame, times: int = TIMES, shortest: int = SHORTEST) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of a vocabulary (word, n)."""
    words = cut(words)
    near = _replacements(words).unionByName(_indels(words, shortest))
    summed = near.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("top"))
    most = -F.col("top.less")
    formed = summed.select("word", "n_near", most.alias("most"), F.col("top.best").alias("best"))
    ranked = words.join(formed, "word", "left")
    holds = F.col("most") >= times * F.col("n")
    known = cut(ranked.select("word", F.when(holds, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(holds, F.col("most")).alias("form_n")))
    roots = _roots(known.where(F.col("form").isNotNull()))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST, every: int = EVERY, times: int = TIMES) -> DataFrame:
    """variants of the vocabulary of docs."""
    return variants(vocabulary(docs, id_col, text_col, shortest, least, every), times, shortest)
