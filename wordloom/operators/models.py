"""Model builders: a join or expansion, then a weighted sum by key and dimension, then the norm.

Models are built in long form (object, dim, val). Elemental vectors are never
stored: they are an expression of the key's md5, `seed` positions of which the
first half is +1 and the rest -1; equal positions add up.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import corpus


@dataclass(frozen=True)
class Space:
    dimension: int = 64
    seed: int = 8

    def __post_init__(self):
        if 2 * self.seed > self.dimension or self.seed % 2:
            raise ValueError("an elemental vector must be sparse, with as many +1 as -1")


def digest(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def elemental(df: DataFrame, key: Column, space: Space) -> DataFrame:
    """Each row of df with (dim, sign) of its key's elemental vector."""
    k = F.explode(F.sequence(F.lit(0), F.lit(space.seed - 1)))
    placed = df.withColumn("_key", key.cast("string")).withColumn("_k", k)
    dim = F.pmod(digest(F.concat_ws("#", "_key", F.col("_k").cast("string"))), F.lit(space.dimension))
    return placed.withColumns({"dim": dim.cast("int"), "sign": F.when(F.col("_k") < space.seed // 2, 1).otherwise(-1)}).drop("_key", "_k")


def summed(df: DataFrame, value: Column) -> DataFrame:
    return df.groupBy("object", "dim").agg(F.sum(value).cast("double").alias("val"))


def normalised(coo: DataFrame) -> DataFrame:
    n = F.sqrt(F.sum(F.col("val") * F.col("val")).over(Window.partitionBy("object")))
    return coo.withColumn("val", F.when(n > 0, F.col("val") / n).otherwise(F.lit(0.0)))


def signs(coo: DataFrame) -> DataFrame:
    """Majority vote (object, dim, bit); ties alternate from 0 in the order of dimensions."""
    tie = F.row_number().over(Window.partitionBy("object", F.col("val") == 0).orderBy("dim"))
    return coo.select("object", "dim", F.when(F.col("val") > 0, 1).when(F.col("val") < 0, 0).otherwise(F.pmod(tie + 1, F.lit(2))).alias("bit"))


def dense(coo: DataFrame, space: Space) -> DataFrame:
    """(object, vec)."""
    entries = F.map_from_entries(F.collect_list(F.struct("dim", "val")))
    return coo.groupBy("object").agg(entries.alias("m")).select("object", F.transform(F.sequence(F.lit(0), F.lit(space.dimension - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vec"))


def arrays(coo: DataFrame, space: Space) -> DataFrame:
    """(object, vec) of a model in long form; null where it has no entry."""
    entries = F.map_from_entries(F.collect_list(F.struct("dim", "val")))
    return coo.groupBy("object").agg(entries.alias("m")).select("object", F.transform(F.sequence(F.lit(0), F.lit(space.dimension - 1)), lambda i: F.try_element_at("m", i)).alias("vec"))


def summed_arrays(df: DataFrame, weight: Column, space: Space) -> DataFrame:
    """(object, dim, val): sums of weight times vec by object, one aggregate for each place.

    A row is joined and combined before the shuffle as a whole vector, not as a row for
    each of its entries.
    """
    sums = df.groupBy("object").agg(*(F.sum(F.get("vec", F.lit(i)) * weight).alias(f"d{i}") for i in range(space.dimension)))
    long = sums.select("object", F.posexplode(F.array(*(f"d{i}" for i in range(space.dimension)))).alias("dim", "val"))
    return long.where("val is not null")


def term_vectors(tf: DataFrame, vocabulary: DataFrame, space: Space) -> DataFrame:
    """Random indexing: the sum of tf times the documents' elemental vectors."""
    kept = tf.join(vocabulary.select("term"), "term", "left_semi").withColumnRenamed("term", "object")
    return summed(elemental(kept, F.col("doc_id"), space), F.col("tf") * F.col("sign"))


def document_vectors(tf: DataFrame, weights: DataFrame, terms: DataFrame, local: Column, space: Space) -> DataFrame:
    """The sum of local times global weight times the term vectors (object, dim, val) over a document's terms."""
    weighted = tf.join(weights, "term").select(F.col("doc_id").alias("object"), "term", (local * F.col("weight")).alias("w"))
    return summed_arrays(weighted.join(arrays(terms, space).withColumnRenamed("object", "term"), "term"), F.col("w"), space)


def terms_from_documents(tf: DataFrame, vocabulary: DataFrame, documents: DataFrame, space: Space) -> DataFrame:
    """A further cycle: term vectors from document vectors."""
    kept = tf.join(vocabulary.select("term"), "term", "left_semi")
    return summed_arrays(kept.join(arrays(documents, space).withColumnRenamed("object", "doc_id"), "doc_id").withColumnRenamed("term", "object"), F.col("tf"), space)


def elemental_vector(key: Column, space: Space) -> Column:
    """The elemental vector of a key as an array."""
    places = F.transform(F.sequence(F.lit(0), F.lit(space.seed - 1)), lambda k: F.struct(F.pmod(digest(F.concat_ws("#", key.cast("string"), k.cast("string"))), F.lit(space.dimension)).cast("int").alias("dim"), F.when(k < space.seed // 2, 1.0).otherwise(-1.0).alias("sign")))
    return V.let(places, lambda p: F.transform(F.sequence(F.lit(0), F.lit(space.dimension - 1)), lambda i: F.aggregate(p, F.lit(0.0), lambda s, e: s + F.when(e["dim"] == i, e["sign"]).otherwise(0.0))))


def places(key: Column, space: Space) -> Column:
    """The places of a key's elemental vector, in their order: the first half is +1."""
    return F.array(*(F.pmod(digest(F.concat_ws("#", key.cast("string"), F.lit(str(k)))), F.lit(space.dimension)).cast("int") for k in range(space.seed)))


def bound(df: DataFrame, one: Column, two: Column, space: Space) -> DataFrame:
    """Each row of df with (dim, sign) of the convolution of two keys' elemental vectors: places add, signs multiply."""
    first = elemental(df, one, space).withColumnsRenamed({"dim": "_dim", "sign": "_sign"})
    both = elemental(first, two, space)
    return both.withColumns({"dim": F.pmod(F.col("_dim") + F.col("dim"), F.lit(space.dimension)).cast("int"), "sign": F.col("_sign") * F.col("sign")}).drop("_dim", "_sign")


def turns(spark: SparkSession, places: list[int], space: Space, method: str) -> DataFrame:
    """(turn, dim, to): a random permutation for each turn; in "proximity" that of a further offset comes from the nearer one's by swapping a quarter."""
    def named(t: int) -> Column:
        return V.permutation(F.lit(f"turn{t}"), space.dimension)

    def near(t: int) -> Column:
        p = named(1 if t > 0 else -1)
        for n in range(2, abs(t) + 1):
            p = V.swapped(p, F.lit(f"swap{n if t > 0 else -n}"))
        return p

    rows = [spark.range(1).select(F.lit(t).alias("turn"), F.posexplode(near(t) if method == "proximity" else named(t)).alias("dim", "to")) for t in places]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def moves(spark: SparkSession, radius: int, space: Space, method: str) -> dict[int, list[np.ndarray]]:
    """The permutations of a positional method by offset: place i goes to [i]."""
    offsets, still = [o for o in range(-radius, radius + 1) if o], np.arange(space.dimension)
    if method == "basic":
        return {o: [still] for o in offsets}
    if method == "permutation_plus_basic":
        return {o: [*p, still] for o, p in moves(spark, radius, space, "permutation").items()}
    turn = {o: (1 if o > 0 else -1) if method == "directional" else o for o in offsets}
    to = {t: np.zeros(space.dimension, np.int64) for t in set(turn.values())}
    for r in turns(spark, sorted(to), space, method).collect():
        to[r.turn][r.dim] = r.to
    return {o: [to[t]] for o, t in turn.items()}


def positional(pairs: DataFrame, weights: DataFrame, space: Space, method: str = "basic") -> DataFrame:
    """Sums of the neighbours' elemental vectors.

    basic: as they are; directional: permuted by side; permutation: by offset; proximity:
    by offset, permutations of near offsets being alike; permutation_plus_basic: both.
    """
    if method == "permutation_plus_basic":
        return summed(positional(pairs, weights, space, "permutation").unionByName(positional(pairs, weights, space)), F.col("val"))
    weighted = pairs.join(weights.withColumnRenamed("term", "other"), "other")
    # equal neighbours are counted first: it divides what is expanded
    turn = {"basic": F.lit(0), "directional": F.signum("offset").cast("int")}.get(method, F.col("offset").cast("int"))
    counted = weighted.groupBy(F.col("term").alias("object"), "other", turn.alias("turn")).agg(F.count("*").alias("n"), F.first("weight").alias("weight"))
    placed = elemental(counted, F.col("other"), space)
    if method != "basic":
        radius = 1 if method == "directional" else pairs.select("offset").agg(F.coalesce(F.max(F.abs("offset")), F.lit(1))).first()[0]
        table = turns(pairs.sparkSession, [t for t in range(-radius, radius + 1) if t], space, method)
        placed = placed.join(F.broadcast(table), ["turn", "dim"]).drop("dim").withColumnRenamed("to", "dim")
    return summed(placed, F.col("n") * F.col("weight") * F.col("sign"))


def symmetric(tf: DataFrame, weights: DataFrame, space: Space) -> DataFrame:
    """Each document's other terms: x gets w_x w_y E(y); from the document's whole sum less the term's own part, so no pairs are built."""
    w = tf.join(weights, "term").withColumn("w", F.col("tf") * F.col("weight"))
    unit = w.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id"))))
    whole = elemental(unit, F.col("term"), space).groupBy(F.col("doc_id").alias("object"), "dim").agg(F.sum(F.col("w") * F.col("sign")).alias("val"))
    others = summed_arrays(unit.join(arrays(whole, space).withColumnRenamed("object", "doc_id"), "doc_id").withColumnRenamed("term", "object"), F.col("w"), space)
    own = unit.groupBy("term").agg(F.sum(F.col("w") * F.col("w")).alias("ww"))
    minus = elemental(own, F.col("term"), space).select(F.col("term").alias("object"), "dim", (-F.col("ww") * F.col("sign")).alias("val"))
    return summed(others.unionByName(minus), F.col("val"))


def dyads(pairs: DataFrame, space: Space) -> DataFrame:
    """R(right) sums E(left) over the rows (left, right)."""
    counted = pairs.groupBy("left", "right").agg(F.count("*").alias("n"))
    return summed(elemental(counted, F.col("left"), space).withColumnRenamed("right", "object"), F.col("n") * F.col("sign"))


def table_rows(df: DataFrame, key: str, strings: list[str], numbers: list[str], space: Space) -> DataFrame:
    """Row vectors: string cells by their elemental vectors, numbers between two bookends, each convolved with its column's."""
    bounds = df.agg(*(f(c).alias(f"{f.__name__}_{c}") for c in numbers for f in (F.min, F.max)))
    wide = df.crossJoin(F.broadcast(bounds))
    cells = [F.struct(F.lit(c).alias("column"), F.concat(F.lit(f"{c}="), F.col(c)).alias("cell"), F.lit(1.0).alias("w")) for c in strings]
    for c in numbers:
        span = F.col(f"max_{c}") - F.col(f"min_{c}")
        p = F.when(span > 0, (F.col(c) - F.col(f"min_{c}")) / span).otherwise(F.lit(0.0)).cast("double")
        cells += [F.struct(F.lit(c).alias("column"), F.lit(f"{c}<").alias("cell"), (1 - p).alias("w")), F.struct(F.lit(c).alias("column"), F.lit(f"{c}>").alias("cell"), p.alias("w"))]
    long = wide.select(F.col(key).cast("string").alias("object"), F.explode(F.array(*cells)).alias("c")).select("object", "c.*").where("cell is not null")
    return summed(bound(long, F.col("cell"), F.col("column"), space), F.col("w") * F.col("sign"))


def corpus_space(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Postings and vocabulary of a corpus."""
    tf = corpus.postings(docs)
    return tf, corpus.vocabulary(tf, least, min_length=2)


def letters(vocabulary: DataFrame, space: Space) -> DataFrame:
    """C(c) sums the elemental vectors of the letters beside c, over all occurrences of the vocabulary's terms."""
    n = F.length("term")
    at = vocabulary.where(n > 1).select("term", "gf", F.explode(F.sequence(F.lit(1), n - 1)).alias("i"))
    one, two = F.substr("term", F.col("i"), F.lit(1)), F.substr("term", F.col("i") + 1, F.lit(1))
    both = at.select("gf", F.explode(F.array(F.struct(one.alias("object"), two.alias("other")), F.struct(two.alias("object"), one.alias("other")))).alias("p"))
    counted = both.groupBy("p.object", "p.other").agg(F.sum("gf").alias("n"))
    return summed(elemental(counted, F.col("other"), space), F.col("n") * F.col("sign"))


def number_line(spark: SparkSession, ends: DataFrame, first: int, last: int) -> DataFrame:
    """(object, vec) of the numbers first to last between two end vectors: vs, of one row."""
    low, high = F.get("vs", F.lit(0)), F.get("vs", F.lit(1))
    line = F.zip_with(low, high, lambda x, y: x * (last - F.col("object")) + y * (F.col("object") - first))
    return spark.range(first, last + 1).withColumnRenamed("id", "object").crossJoin(F.broadcast(ends)).select("object", V.normalise(line).alias("vec"))


def incremental_terms(tf: DataFrame, vocabulary: DataFrame, documents: DataFrame, local: Column, space: Space) -> DataFrame:
    """Term vectors from document vectors (object, dim, val), by local weight."""
    kept = tf.join(vocabulary.select("term"), "term", "left_semi").select(F.col("term").alias("object"), "doc_id", local.alias("w"))
    return summed_arrays(kept.join(arrays(documents, space).withColumnRenamed("object", "doc_id"), "doc_id"), F.col("w"), space)


def seeded_documents(tf: DataFrame, weights: DataFrame, space: Space, local: Column) -> DataFrame:
    """Document vectors from the terms' elemental vectors: where a reflective model may start."""
    w = tf.join(weights, "term").select(F.col("doc_id").alias("object"), "term", (local * F.col("weight")).alias("w"))
    return summed(elemental(w, F.col("term"), space), F.col("w") * F.col("sign"))


def trained(tf: DataFrame, vocabulary: DataFrame, weights: DataFrame, space: Space, cycles: int = 1, seed: str = "document") -> tuple[DataFrame, DataFrame]:
    """(terms, documents) after so many cycles, normalised; each cycle is written to the shared folder, so that lineage does not grow."""
    from ..sources.shared import written

    if seed == "document":
        terms = term_vectors(tf, vocabulary, space)
    else:
        terms = terms_from_documents(tf, vocabulary, written(normalised(seeded_documents(tf, weights, space, F.col("tf"))), "documents"), space)
    for cycle in range(cycles):
        terms = written(normalised(terms), "terms")
        documents = written(normalised(document_vectors(tf, weights, terms, F.col("tf"), space)), "documents")
        if cycle < cycles - 1:
            terms = terms_from_documents(tf, vocabulary, documents, space)
    return terms, documents


def whole_store(coo: DataFrame, objects: DataFrame, space: Space) -> DataFrame:
    """(object, vec) of every object; one without entries has the zero vector."""
    return objects.join(dense(coo, space), "object", "left").select("object", F.coalesce("vec", F.array_repeat(F.lit(0.0), space.dimension)).alias("vec"))


def ends(space: Space, first: str = "*START*", last: str = "*END*") -> tuple[Column, Column]:
    """The number line's ends from two seeds, the second made orthogonal to the first."""
    low = V.normalise(elemental_vector(F.lit(first), space))
    return low, V.without(elemental_vector(F.lit(last), space), low)


def on_line(low: Column, high: Column, at: Column, first: Column, last: Column) -> Column:
    """The vector of a number between two ends."""
    return V.normalise(F.zip_with(low, high, lambda x, y: x * (last - at) + y * (at - first)))


def spelled(terms: DataFrame, space: Space) -> DataFrame:
    """(object, vec) from spelling: the sum over places p of E(letter p) * N(p) on a line from 0 to length + 1; * is convolution."""
    low, high = ends(space)
    line = terms.select(F.length("term").alias("n")).where("n > 0").distinct().select("n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("p"))
    line = line.crossJoin(F.broadcast(terms.sparkSession.range(1).select(low.alias("low"), high.alias("high"))))
    line = line.select("n", "p", on_line(F.col("low"), F.col("high"), F.col("p"), F.lit(0), F.col("n") + 1).alias("number"))
    numbers = line.groupBy("n").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "number"))), lambda e: e["number"]).alias("numbers"))
    # a row for each length of a word; words are no longer than some hundred letters
    letters_ = terms.select(F.col("term").alias("object"), F.length("term").alias("n"), F.split("term", "").alias("letters")).where("n > 0")
    long = letters_.select("object", "n", F.posexplode(F.filter("letters", lambda c: c != "")).alias("p", "letter"))
    placed = elemental(long, F.col("letter"), space).groupBy("object", "n", "p").agg(F.collect_list(F.struct("dim", "sign")).alias("e"))
    d = space.dimension
    def turned(number: Column) -> Column:
        return V.let(number, lambda v: F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.aggregate("e", F.lit(0.0), lambda s, x: s + x["sign"] * F.get(v, F.pmod(i - x["dim"], F.lit(d))))))
    bound_ = placed.join(numbers, "n").select("object", turned(F.get("numbers", F.col("p"))).alias("v"))
    sums = bound_.select("object", F.posexplode("v").alias("dim", "x")).groupBy("object", "dim").agg(F.sum("x").alias("val"))
    return dense(normalised(sums), space)


def bucketed(grams: DataFrame, slots: int = 2_000_000) -> DataFrame:
    """Each (term, gram) with its slot of a fixed number; grams of one slot share a vector."""
    return grams.withColumn("slot", F.pmod(digest(F.col("gram")), F.lit(slots)))
