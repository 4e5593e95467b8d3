"""Tokens, n-grams, number tests and the weights of terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Lower-cased runs of letters."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def pieces(text: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def component_ngrams(term: Column, least: int = 3, most: int = 6) -> Column:
    """Substrings of <term>, but the whole."""
    padded = F.concat(F.lit("<"), term, F.lit(">"))
    n = F.length(padded)
    grams = F.transform(F.sequence(F.lit(least), F.lit(most)), lambda k: F.when(n > k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substr(padded, i, k))).otherwise(F.array().cast("array<string>")))
    return F.flatten(grams)


def non_letters(term: Column) -> Column:
    return F.length(term) - F.length(F.regexp_replace(term, r"[^\p{L}]", ""))


def is_number(term: Column) -> Column:
    return term.try_cast("double").isNotNull()


def normal_term(term: Column) -> Column:
    """Letters alone, white space as _, lower case."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(term, r"[^\p{L}\s]", "")), r"\s+", "_"))


GLOBAL = ("none", "idf", "logentropy", "freq", "sqrt", "logfreq")


def global_weight(kind: str, gf: Column, df: Column, n_docs: Column, entropy: Column | None = None) -> Column:
    return {
        "none": lambda: F.lit(1.0),
        "idf": lambda: F.when(df > 0, F.log10(n_docs / df)).otherwise(F.lit(0.0)),
        "logentropy": lambda: 1 + entropy / F.log2(n_docs),
        "freq": lambda: gf.cast("double"),
        "sqrt": lambda: F.sqrt(gf),
        "logfreq": lambda: F.log(gf),
    }[kind]()


def local_weight(kind: str, tf: Column) -> Column:
    return {"idf": lambda: tf.cast("double"), "logentropy": lambda: F.log10(1 + tf), "sqrt": lambda: F.sqrt(tf)}.get(kind, lambda: F.lit(1.0))()


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def proportion_score(a: Column, b: Column) -> Column:
    return F.when(F.greatest(a, b) == 0, F.lit(1.0)).otherwise(F.least(a, b) / F.greatest(a, b))
