"""Readers and writers: text folders, lines, triples, typed triples, dyads, tables, vector stores."""

from __future__ import annotations

import struct
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V


def text_folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified, text): one row for each file; names that begin with a dot are left out."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    named = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))
    return named.where(~F.element_at(F.split("path", "/"), -1).startswith("."))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_id, text): lines that are not empty, numbered from 1 within their file."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text")).where(F.length("text") > 0)
    return raw.select("path", F.row_number().over(Window.partitionBy("path").orderBy("at")).alias("line_id"), "text")


def bilingual(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name, contents_l1, contents_l2) of two text folders; every name must be in both."""
    name = lambda df, c: df.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("text").alias(c))
    both = name(left, "contents_l1").join(name(right, "contents_l2"), "name", "full")
    if (lost := both.where("contents_l1 is null or contents_l2 is null").select("name").first()) is not None:
        raise ValueError(f"{lost[0]} is in one folder only")
    return both


def clean_triples(raw: DataFrame, *more: str) -> DataFrame:
    """Subject and object in lower case, predicate in upper case, spaces as underlines; further columns as they are."""
    tidy = lambda c: F.replace(F.trim(c), F.lit(" "), F.lit("_"))
    return raw.select(F.lower(tidy("subject")).alias("subject"), F.upper(tidy("predicate")).alias("predicate"), F.lower(tidy("object")).alias("object"), *more)


def predications(triples: DataFrame) -> DataFrame:
    return triples.select("subject", "predicate", "object", F.concat("subject", "predicate", "object").alias("predication"))


def triples(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated triples; lines of fewer than three fields are left out."""
    fields = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 3)
    return predications(clean_triples(fields.select(F.get("f", F.lit(0)).alias("subject"), F.get("f", F.lit(1)).alias("predicate"), F.get("f", F.lit(2)).alias("object"))))


TYPED = ("subject", "subject_cui", "subject_semtype", "predicate", "object", "object_cui", "object_semtype", "pmid", "source")


def typed_triples(spark: SparkSession, path: str) -> DataFrame:
    """Nine fields; what follows ||| in a concept goes; each pair of the values that | divides is a row."""
    fields = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") >= len(TYPED))
    named = fields.select(*(F.get("f", F.lit(i)).alias(c) for i, c in enumerate(TYPED)))
    bare = lambda c: F.split(F.regexp_replace(c, r"\|\|\|.*", ""), r"\|")
    pairs = named.withColumns({c: F.explode(F.arrays_zip(bare(c).alias("a"), F.split(f"{c}_cui", r"\|").alias("b"))) for c in ("subject",)}).withColumn("object", F.explode(F.arrays_zip(bare("object").alias("a"), F.split("object_cui", r"\|").alias("b"))))
    flat = pairs.withColumns({"subject_cui": F.col("subject.b"), "object_cui": F.col("object.b"), "subject": F.col("subject.a"), "object": F.col("object.a")})
    clean = {"subject": F.lower(F.replace(F.trim("subject"), F.lit(" "), F.lit("_"))), "object": F.lower(F.replace(F.trim("object"), F.lit(" "), F.lit("_"))), "predicate": F.upper(F.trim("predicate"))}
    return flat.withColumns(clean)


def dyads(spark: SparkSession, path: str) -> DataFrame:
    fields = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 2)
    return fields.select(T.normal_term(F.get("f", F.lit(0))).alias("left"), T.normal_term(F.get("f", F.lit(1))).alias("right"))


def table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table of strings with a header; ragged rows are an error."""
    return spark.read.option("header", True).option("mode", "FAILFAST").csv(path)


def column_types(df: DataFrame) -> DataFrame:
    """(name, kind, low, high): DOUBLE if every cell that isn't blank is a number, else STRING; in one aggregate."""
    number = lambda c: F.col(c).cast("string").try_cast("double")
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    one = df.agg(*(F.struct(F.lit(c).alias("name"), F.coalesce(F.bool_and(blank(c) | number(c).isNotNull()), F.lit(True)).alias("numeric"), F.min(number(c)).alias("low"), F.max(number(c)).alias("high")).alias(c) for c in df.columns))
    rows = one.select(F.explode(F.array(*df.columns)).alias("x")).select("x.*")
    keep = lambda c: F.when(F.col("numeric"), F.col(c))
    return rows.select("name", F.when(F.col("numeric"), "DOUBLE").otherwise("STRING").alias("kind"), keep("low").alias("low"), keep("high").alias("high"))


def write_store(store: DataFrame, path: str, kind: str = "real") -> None:
    """Parquet, with type and dimension in the column's metadata."""
    n = store.select(F.size("vec")).first()
    store.withMetadata("vec", {"vectortype": kind, "dimension": n[0] if n else 0}).write.parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


#: What a text store's header line begins with; no stored name does, for a name's own "-vectortype" would have a | behind it.
HEADER = "-vectortype "


def store_path(path: str, text: bool = False) -> str:
    """A store's file name: .txt or .bin behind it, unless it is there."""
    ending = ".txt" if text else ".bin"
    return path if path.endswith(ending) else path + ending


def write_text_store(store: DataFrame, path: str, kind: str = "real") -> None:
    """A header, then lines of name|c0|c1...; a | in a name becomes ;."""
    n = store.select(F.size("vec")).first()
    header = store.sparkSession.range(1).select(F.lit(f"{HEADER}{kind} -dimension {n[0] if n else 0}").alias("value"))
    lines_ = store.select(F.concat_ws("|", F.translate(F.col("object").cast("string"), "|", ";"), V.to_text(F.col("vec"))).alias("value"))
    header.unionByName(lines_).write.text(path)


def read_text_store(spark: SparkSession, path: str) -> DataFrame:
    """(object, vec) of a text store; only its header line is no row."""
    rows = spark.read.text(path).where(~(F.col("value").startswith(HEADER) & ~F.contains("value", F.lit("|"))))
    cells = rows.select(F.split("value", r"\|").alias("c"))
    return cells.select(F.get("c", F.lit(0)).alias("object"), F.slice("c", 2, F.size("c")).cast("array<double>").alias("vec"))


def write_binary_store(store: DataFrame, path: str) -> None:
    """The common binary layout of word vectors, row by row to one local file."""
    n, d = store.count(), store.select(F.size("vec")).first()[0]
    with Path(path).open("wb") as out:
        out.write(f"{n} {d}\n".encode())
        for r in store.toLocalIterator():
            out.write(f"{r.object} ".encode() + struct.pack(f"<{d}f", *r.vec) + b"\n")


def subset(store: DataFrame, names: list[str]) -> DataFrame:
    """The stored vectors of the names that are neither zero nor not a number."""
    found = store.where(F.col("object").isin(names))
    return found.where(~V.is_zero(F.col("vec")) & ~F.exists("vec", lambda x: F.isnan(x))).withColumn("object", F.replace(F.col("object").cast("string"), F.lit(" "), F.lit("_")))


def graph_json(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes and links of a small network as JSON."""
    nodes = hits.agg(F.array_sort(F.collect_list(F.struct("object", "score"))).alias("nodes"))
    links = edges.agg(F.array_sort(F.collect_list(F.struct("a", "b", "distance"))).alias("links"))
    return nodes.crossJoin(links).select(F.to_json(F.struct("nodes", "links")).alias("json"))


def translated(spark: SparkSession, source: str, target: str, to: str) -> None:
    """A stored or text store in another form: "store", "text" or "binary"."""
    store = read_text_store(spark, source) if source.endswith(".txt") else read_store(spark, source)
    {"store": write_store, "text": write_text_store, "binary": write_binary_store}[to](store, target)


def proximity_data(store: DataFrame, path: str) -> None:
    """A text folder of one vector a line, coordinates apart by blanks, behind a line of the least and greatest coordinate."""
    low, high = store.agg(F.min(F.array_min("vec")), F.max(F.array_max("vec"))).first()
    header = store.sparkSession.range(1).select(F.lit(0).alias("k"), F.lit("").alias("object"), F.lit(f"{low} {high}").alias("value"))
    rows = store.select(F.lit(1).alias("k"), F.col("object").cast("string").alias("object"), F.concat_ws(" ", F.col("vec").cast("array<string>")).alias("value"))
    header.unionByName(rows).repartition(1).sortWithinPartitions("k", "object").select("value").write.text(path)
