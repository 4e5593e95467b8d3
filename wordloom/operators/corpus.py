"""Corpus statistics: tokens, postings, vocabulary, filters, weights, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, term), pos from 0."""
    return docs.select("doc_id", F.posexplode(T.words(F.col("text"))).alias("pos", "term"))


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf)."""
    return tokens(docs).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def vocabulary(tf: DataFrame, least: int = 0, most: int | None = None, min_length: int = 0, max_non_letters: int | None = None, numbers: bool = True, stop: DataFrame | None = None, start: DataFrame | None = None) -> DataFrame:
    """(term, gf, df) of the terms that pass the filters."""
    return filtered(tf.groupBy("term").agg(F.sum("tf").alias("gf"), F.count("*").alias("df")), least, most, min_length, max_non_letters, numbers, stop, start)


def filtered(counted: DataFrame, least: int = 0, most: int | None = None, min_length: int = 0, max_non_letters: int | None = None, numbers: bool = True, stop: DataFrame | None = None, start: DataFrame | None = None) -> DataFrame:
    """Of (term, gf, df) the terms that pass the filters."""
    found = counted.where(F.col("gf") >= least).where(F.length("term") >= min_length)
    if most is not None:
        found = found.where(F.col("gf") <= most)
    if max_non_letters is not None:
        found = found.where(T.non_letters(F.col("term")) <= max_non_letters)
    if not numbers:
        found = found.where(~T.is_number(F.col("term")))
    if stop is not None:
        found = found.join(stop, "term", "left_anti")
    return found if start is None else found.join(start, "term", "left_semi")


def entropies(tf: DataFrame) -> DataFrame:
    """(term, gf, df, entropy): the sum of p log2 p over a term's documents; from tf log2 tf alone, in one aggregate."""
    t = tf.groupBy("term").agg(F.sum("tf").alias("gf"), F.count("*").alias("df"), F.sum(F.col("tf") * F.log2("tf")).alias("x"))
    return t.select("term", "gf", "df", (F.col("x") / F.col("gf") - F.log2("gf")).alias("entropy"))


def window_pairs(tokens: DataFrame, vocabulary: DataFrame, radius: int, exact: bool = False, random: bool = False) -> DataFrame:
    """(doc_id, term, other, offset): neighbours among the tokens that the vocabulary keeps.

    exact: tokens left out stay as holes, so that offsets are those of the text; random:
    each token's own radius is drawn from 1 to radius, by a hash of its place.
    """
    kept = tokens.join(vocabulary.select("term"), "term", "left_semi")
    w = Window.partitionBy("doc_id").orderBy("pos")
    around = [F.struct(F.lag("term", -o).over(w).alias("other"), ((F.lag("pos", -o).over(w) - F.col("pos")) if exact else F.lit(o)).cast("int").alias("offset")) for o in range(-radius, radius + 1) if o]
    wide = kept.select("doc_id", "pos", "term", F.array(*around).alias("near"))
    near = wide.select("doc_id", "pos", "term", F.explode("near").alias("n")).select("doc_id", "pos", "term", "n.other", "n.offset").where("other is not null")
    own = F.lit(radius)
    if random:
        own = 1 + F.conv(F.substring(F.md5(F.concat_ws("#", F.col("doc_id").cast("string"), F.col("pos").cast("string"))), 1, 8), 16, 10).cast("long") % radius
    return near.where(F.abs("offset") <= own).select("doc_id", "term", "other", "offset")


def contingency(tf: DataFrame, terms: DataFrame, n_docs: int) -> DataFrame:
    """(first, second, both_, first_, second_, neither) of every pair of a few terms, first before second: documents with both, either and none."""
    kept = tf.join(F.broadcast(terms.select("term")), "term", "left_semi").select("term", "doc_id").distinct()
    df = kept.groupBy("term").agg(F.count("*").alias("df"))
    held = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    # a document's pairs, of few terms, are counted where it is
    pair = F.flatten(F.transform("terms", lambda x, i: F.transform(F.slice("terms", i + 2, F.size("terms")), lambda y: F.struct(x.alias("first"), y.alias("second")))))
    both = held.select(F.explode(pair).alias("p")).groupBy("p.first", "p.second").agg(F.count("*").alias("both_"))
    one, two = (df.select(F.col("term").alias(c), F.col("df").alias(f"df_{c}")) for c in ("first", "second"))
    every = one.crossJoin(F.broadcast(two)).where("first < second").join(both, ["first", "second"], "left").withColumn("both_", F.coalesce("both_", F.lit(0)))
    return every.select("first", "second", "both_", (F.col("df_first") - F.col("both_")).alias("first_"), (F.col("df_second") - F.col("both_")).alias("second_"), (F.lit(n_docs) - F.col("df_first") - F.col("df_second") + F.col("both_")).alias("neither"))


def number_filter(tf: DataFrame, **filters) -> DataFrame:
    """The vocabulary without what reads as a number, and through the term filter."""
    return vocabulary(tf, numbers=False, **filters)
