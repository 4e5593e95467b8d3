"""The registered queries of the word-space engine and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import analysis, corpus, matrices, models, rows, search, trainers
from ..sources import readers
from . import sql as S
from .registry import ELEMENTAL, ORACLES, QUERIES, SPACE, coo, entries, indexed, numbered, pairs_of_store, query, rounded, space, store, table, terms, weights

# sources


@query("""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS line_id, line FROM
  (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE length(trim(line, ' ')) > 0""")
def source_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).where(F.length(F.trim("line")) > 0)
    return lines.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("i")).cast("long").alias("line_id"), "line")


@query(f"WITH {S.TRIPLES} SELECT DISTINCT subject, predicate, object, subject || predicate || object AS predication FROM triples")
def source_triples(spark, d):
    return readers.predications(triples(spark, d)).distinct()


def counted_triples(spark: SparkSession, d: str) -> DataFrame:
    """(subject, predicate, object, n): the distinct triples and how often each occurs.

    What suppliers supply is counted by key and part name before suppliers are joined.
    """
    t = lambda n: table(spark, d, n)
    nation, once = t("nation"), F.lit(1).cast("long")
    supplied = t("lineitem").join(t("part").hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "p_name").agg(F.count("*").alias("n"))
    raw = [
        t("customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_name", F.lit("in_nation"), "n_name", once),
        t("supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_name", F.lit("in_nation"), "n_name", once),
        nation.join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.lit("in_region"), "r_name", once),
        t("part").select("p_name", F.lit("has brand"), "p_brand", once),
        supplied.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("s_name", F.lit("supplies"), "p_name", "n"),
    ]
    named = [r.toDF("subject", "predicate", "object", "n") for r in raw]
    every = named[0]
    for r in named[1:]:
        every = every.unionByName(r)
    return readers.clean_triples(every, "n").groupBy("subject", "predicate", "object").agg(F.sum("n").alias("n"))


def triples(spark: SparkSession, d: str) -> DataFrame:
    return counted_triples(spark, d).drop("n")


@query("""SELECT a.doc_id, a.text AS contents_l1, b.text AS contents_l2 FROM documents a JOIN
  (SELECT *, doc_id - 1 AS left_id FROM documents) b ON a.doc_id = b.left_id WHERE a.lang <> b.lang""")
def source_bilingual(spark, d):
    docs = table(spark, d, "documents")
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("contents_l2"), F.col("lang").alias("lang2"))
    return docs.join(other, "doc_id").where("lang <> lang2").select("doc_id", F.col("text").alias("contents_l1"), "contents_l2")


@query("""SELECT 'p_brand' AS name, 'STRING' AS kind, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high UNION ALL SELECT 'p_name', 'STRING', NULL, NULL UNION ALL SELECT 'p_retailprice', 'DOUBLE', min(p_retailprice), max(p_retailprice) FROM part
  UNION ALL SELECT 'p_size', 'DOUBLE', min(p_size), max(p_size) FROM part UNION ALL SELECT 'p_type', 'STRING', NULL, NULL""")
def source_table_types(spark, d):
    return readers.column_types(table(spark, d, "part").select("p_name", "p_brand", "p_type", "p_size", "p_retailprice"))


@query("SELECT DISTINCT replace(lower(regexp_replace(c_mktsegment, '[^\\p{L}\\s]', '', 'g')), ' ', '_') AS \"left\", lower(regexp_replace(n_name, '[^\\p{L}\\s]', '', 'g')) AS \"right\" FROM customer JOIN nation ON c_nationkey = n_nationkey")
def source_dyads(spark, d):
    return dyads(spark, d).distinct()


def dyads(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return both.select(T.normal_term(F.col("c_mktsegment")).alias("left"), T.normal_term(F.col("n_name")).alias("right"))


@query("SELECT vec_id AS object, array_to_string(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT)), '|') AS line FROM embeddings")
def store_text(spark, d):
    return store(spark, d).select("object", V.to_text(F.transform("vec", lambda x: F.round(x * 1000).cast("long"))).alias("line"))


@query("SELECT vec_id AS object, i - 1 AS i, round(embedding[i]::DOUBLE, 6) + 0.0 AS val FROM embeddings, range(1, 17) r(i)")
def store_truncated(spark, d):
    return entries(store(spark, d), V.truncated(F.col("vec"), 16)).withColumn("i", F.col("i").cast("long"))


@query(f"""WITH {S.STORE}, drawn AS (SELECT * FROM s ORDER BY md5(object::VARCHAR) LIMIT 200), x AS (SELECT object, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS i FROM s),
  y AS (SELECT unnest(vec) AS y, generate_subscripts(vec, 1) - 1 AS i FROM drawn), n AS (SELECT count(*) AS n FROM drawn)
  SELECT object, CAST(i AS INTEGER) AS i, round(2.0 * count(*) FILTER (y <= x) / any_value(n) - 1, 6) + 0.0 AS val FROM x JOIN y USING (i), n GROUP BY object, i""")
def store_redistributed(spark, d):
    r = analysis.redistributed(store(spark, d))
    return entries(r, F.col("vec"))


# corpus


@query(f"WITH {S.TOKENS} SELECT doc_id, CAST(pos AS INTEGER) AS pos, term FROM tokens")
def tokens(spark, d):
    return corpus.tokens(table(spark, d, "documents"))


@query(f"WITH {S.TF} SELECT * FROM tf")
def postings(spark, d):
    return corpus.postings(table(spark, d, "documents"))


@query("SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS INTEGER) AS n FROM documents")
def tokens_whitespace(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.pieces(F.col("text"))).alias("n"))


@query(f"WITH {S.TF} SELECT term, CAST(sum(tf) AS BIGINT) AS gf, count(*) AS df FROM tf WHERE length(term) >= 3 AND term NOT IN (SELECT term FROM tf GROUP BY term ORDER BY count(*) DESC, term LIMIT 10) GROUP BY term HAVING sum(tf) BETWEEN 5 AND 5000")
def term_filter(spark, d):
    tf = corpus.postings(table(spark, d, "documents"))
    stop = tf.groupBy("term").count().orderBy(F.desc("count"), "term").limit(10).select("term")
    return corpus.vocabulary(tf, 5, 5000, 3, 0, False, stop)


@query("WITH tok AS (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS term, doc_id FROM documents) SELECT term, count(*) AS gf, count(DISTINCT doc_id) AS df FROM tok WHERE try_cast(term AS DOUBLE) IS NULL AND length(term) >= 2 AND length(term) - length(regexp_replace(term, '[^\\p{L}]', '', 'g')) <= 2 GROUP BY term HAVING count(*) BETWEEN 3 AND 500")
def number_filter(spark, d):
    """Terms between white space, which may be numbers, through the number test and the term filter."""
    pieces = table(spark, d, "documents").select("doc_id", F.explode(T.pieces(F.lower("text"))).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    return corpus.number_filter(pieces, least=3, most=500, min_length=2, max_non_letters=2)


@query(f"""WITH {S.TF}, n AS (SELECT count(DISTINCT doc_id) AS n FROM tf), g AS (SELECT term, sum(tf) AS gf, count(*) AS df, sum(tf * log2(tf)) AS x FROM tf GROUP BY term)
  SELECT term, round(log10(n / df), 6) + 0.0 AS idf, round(1 + (x / gf - log2(gf)) / log2(n), 6) + 0.0 AS logentropy, round(sqrt(gf), 6) AS sqrt, CAST(gf AS DOUBLE) AS freq, round(ln(gf), 6) AS logfreq, 1.0::DOUBLE AS none FROM g, n""")
def global_weights(spark, d):
    tf = corpus.postings(table(spark, d, "documents"))
    x = corpus.entropies(tf).crossJoin(F.broadcast(tf.agg(F.count_distinct("doc_id").alias("n"))))
    of = lambda k: rounded(T.global_weight(k, F.col("gf"), F.col("df"), F.col("n"), F.col("entropy"))).alias(k)
    return x.select("term", *(of(k) for k in T.GLOBAL))


@query(f"WITH {S.TF} SELECT term, doc_id, tf::DOUBLE AS idf, round(log10(1 + tf), 6) AS logentropy, round(sqrt(tf), 6) AS sqrt, round(1 / sqrt(count(*) OVER (PARTITION BY doc_id)), 6) AS field FROM tf")
def local_weights(spark, d):
    tf = corpus.postings(table(spark, d, "documents"))
    field = 1 / F.sqrt(F.count("*").over(Window.partitionBy("doc_id")))
    return tf.select("term", "doc_id", *(rounded(T.local_weight(k, F.col("tf"))).alias(k) for k in ("idf", "logentropy", "sqrt")), rounded(field).alias("field"))


@query(f"WITH {S.TF}, g AS (SELECT '<' || term || '>' AS p FROM (SELECT DISTINCT term FROM tf)) SELECT p AS padded, substr(p, i, k) AS gram, count(*) AS n FROM g, range(3, 7) a(k), range(1, 200) b(i) WHERE k < length(p) AND i <= length(p) - k + 1 GROUP BY ALL")
def component_ngrams(spark, d):
    terms_ = corpus.postings(table(spark, d, "documents")).select("term").distinct()
    return terms_.select(F.concat(F.lit("<"), "term", F.lit(">")).alias("padded"), F.explode(T.component_ngrams(F.col("term"))).alias("gram")).groupBy("padded", "gram").agg(F.count("*").alias("n"))


@query(f"WITH {S.PAIRS} SELECT term, other, \"offset\", count(*) AS n FROM pairs GROUP BY ALL")
def window_pairs(spark, d):
    return building.window_counts(spark, d)


def pairs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return corpus.window_pairs(corpus.tokens(docs), space(spark, d)[1], S.RADIUS)


@query(f"WITH {S.VOCAB} SELECT term, round(sum(sqrt(gf)) OVER (ORDER BY term ROWS UNBOUNDED PRECEDING), 4) AS cumulative FROM vocab")
def negative_sampling_table(spark, d):
    return analysis.negative_table(space(spark, d)[1]).select("term", F.round("cumulative", 4).alias("cumulative"))


@query(f"WITH {S.VOCAB}, a AS (SELECT sum(gf) AS n FROM vocab) SELECT term, round(greatest(0, 1 - sqrt(0.001 / (gf / n))), 6) + 0.0 AS skip, round(greatest(0, 1 - sqrt(0.001 / (gf / n)) - 0.001 / (gf / n)), 6) + 0.0 AS skip_aggressive FROM vocab, a")
def subsampling_table(spark, d):
    v = space(spark, d)[1]
    hard = analysis.subsampling(v, aggressive=True).select("term", rounded(F.col("skip")).alias("skip_aggressive"))
    return analysis.subsampling(v).select("term", rounded(F.col("skip")).alias("skip")).join(hard, "term")


# models


@query(f"WITH {S.TF}, x AS (SELECT DISTINCT term AS object FROM tf) SELECT object, {S.dim('object')} AS dim, CAST(sum({S.SIGN}) AS BIGINT) AS val FROM x, {S.KS} GROUP BY 1, 2")
def elemental_vectors(spark, d):
    t = corpus.postings(table(spark, d, "documents")).select(F.col("term").alias("object")).distinct()
    return models.elemental(t, F.col("object"), SPACE).groupBy("object", "dim").agg(F.sum("sign").alias("val"))


@query(f"WITH {S.TERMS} SELECT * FROM terms")
def ri_term_vectors(spark, d):
    return coo(terms(spark, d))


@query(f"WITH {S.TERMS}, votes AS (SELECT object, dim, val, row_number() OVER (PARTITION BY object, val = 0 ORDER BY dim) AS r FROM raw) SELECT object, dim, CASE WHEN val > 0 THEN 1 WHEN val < 0 THEN 0 ELSE CAST((r + 1) % 2 AS INTEGER) END AS bit FROM votes")
def ri_binary_term_vectors(spark, d):
    ix = indexed(spark, d)
    if ix is not None:
        return matrices.term_signs(ix, ELEMENTAL)
    tf, v = space(spark, d)
    return models.signs(models.term_vectors(tf, v, SPACE))


@query(f"WITH {S.DOCS} SELECT * FROM docs")
def ri_document_vectors(spark, d):
    return coo(document_vectors(spark, d))


def document_vectors(spark: SparkSession, d: str) -> DataFrame:
    ix = indexed(spark, d)
    if ix is not None:
        return matrices.documents(ix, matrices.Documents("terms", SPACE), matrices.term_matrix(ix, ELEMENTAL))
    tf, _ = space(spark, d)
    return models.normalised(models.document_vectors(tf, weights(spark, d), terms(spark, d), F.col("tf"), SPACE))


@query(f"WITH {S.DOCS}, raw2 AS (SELECT term AS object, dim, sum(tf * val) AS val FROM tf JOIN vocab USING (term) JOIN (SELECT object AS doc_id, dim, val FROM docs_) USING (doc_id) GROUP BY 1, 2), {S.normal('raw2', 'second')} SELECT object, dim, round(val, 5) + 0.0 AS val FROM second")
def reflective_second_cycle(spark, d):
    ix = indexed(spark, d)
    if ix is not None:
        return building.to5(building.second_cycle(ix))
    tf, v = space(spark, d)
    return models.normalised(models.terms_from_documents(tf, v, document_vectors(spark, d), SPACE)).select("object", "dim", (F.round("val", 5) + F.lit(0.0)).alias("val"))


@query(f"""WITH {S.VOCAB}, w0 AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN weights USING (term)), u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w0),
  e AS (SELECT term, {S.dim('term')} AS dim, {S.SIGN} AS sign FROM vocab, {S.KS}), whole AS (SELECT doc_id, dim, sum(w * sign) AS v FROM u JOIN e USING (term) GROUP BY 1, 2),
  own AS (SELECT term, dim, sum(sign) AS s FROM e GROUP BY 1, 2), raw2 AS (SELECT u.term AS object, whole.dim AS dim, sum(w * (v - w * coalesce(s, 0))) AS val FROM u JOIN whole USING (doc_id) LEFT JOIN own ON own.term = u.term AND own.dim = whole.dim GROUP BY 1, 2), {S.normal('raw2', 'p')}
  SELECT object, dim, round(val, 5) + 0.0 AS val FROM p""")
def symmetric_ri(spark, d):
    ix = indexed(spark, d)
    if ix is not None:
        return building.to5(matrices.terms(ix, matrices.Documents("symmetric", SPACE)))
    m = models.symmetric(space(spark, d)[0], weights(spark, d), SPACE)
    return models.normalised(m).select("object", "dim", (F.round("val", 5) + F.lit(0.0)).alias("val"))


@query(f"""WITH x AS (SELECT lower(c_mktsegment) AS l, lower(regexp_replace(n_name, '[^\\p{{L}}\\s]', '', 'g')) AS object FROM customer JOIN nation ON c_nationkey = n_nationkey), raw2 AS (SELECT object, {S.dim('l')} AS dim, CAST(sum({S.SIGN}) AS DOUBLE) AS val FROM x, {S.KS} GROUP BY 1, 2), {S.normal('raw2', 'p')} SELECT object, dim, round(val, 6) + 0.0 AS val FROM p""")
def dyadic_vectors(spark, d):
    return coo(models.normalised(models.dyads(dyads(spark, d), SPACE)))


@query(f"""WITH m AS (SELECT min(p_size) AS a, max(p_size) AS b, min(p_retailprice) AS c, max(p_retailprice) AS e FROM part), x AS (SELECT p_partkey::VARCHAR AS object, 'p_brand' AS col, 'p_brand=' || p_brand AS cell, 1.0::DOUBLE AS w FROM part UNION ALL SELECT p_partkey::VARCHAR, 'p_type', 'p_type=' || p_type, 1.0 FROM part
  UNION ALL SELECT p_partkey::VARCHAR, 'p_size', 'p_size<', 1 - (p_size - a)::DOUBLE / (b - a) FROM part, m UNION ALL SELECT p_partkey::VARCHAR, 'p_size', 'p_size>', (p_size - a)::DOUBLE / (b - a) FROM part, m
  UNION ALL SELECT p_partkey::VARCHAR, 'p_retailprice', 'p_retailprice<', 1 - (p_retailprice - c) / (e - c) FROM part, m UNION ALL SELECT p_partkey::VARCHAR, 'p_retailprice', 'p_retailprice>', (p_retailprice - c) / (e - c) FROM part, m),
  raw2 AS (SELECT object, CAST(({S.dim('cell')} + {S.dim('col', 'l')}) % {S.DIM} AS INTEGER) AS dim, CAST(sum(w * {S.SIGN} * {S.sign('l')}) AS DOUBLE) AS val FROM x, {S.KS}, {S.LS} GROUP BY 1, 2), {S.normal('raw2', 'p')} SELECT object, dim, round(val, 5) + 0.0 AS val FROM p""")
def table_row_vectors(spark, d):
    return rows.vectors(table(spark, d, "part"), *PART, SPACE).select("object", "dim", (F.round("val", 5) + F.lit(0.0)).alias("val"))


@query(f"""WITH x AS (SELECT page_id AS object, lower(u) AS tag, i, n FROM (SELECT page_id, unnest(l) AS u, generate_subscripts(l, 1) AS i, len(l) AS n FROM (SELECT page_id, regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1) AS l FROM pages))),
  raw2 AS (SELECT object, CAST(({S.dim('tag')} + floor(i * {S.DIM} / (n + 1))) % {S.DIM} AS INTEGER) AS dim, CAST(sum({S.SIGN}) AS DOUBLE) AS val FROM x, {S.KS} GROUP BY 1, 2), {S.normal('raw2', 'p')} SELECT object, dim, round(val, 6) + 0.0 AS val FROM p""")
def tagged_page_vectors(spark, d):
    tags = table(spark, d, "pages").select(F.col("page_id").alias("object"), F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), 1).alias("l"))
    x = tags.select("object", F.posexplode("l").alias("i", "tag"), F.size("l").alias("n"))
    placed = models.elemental(x, F.lower("tag"), SPACE)
    turned = placed.withColumn("dim", F.pmod(F.col("dim") + F.floor((F.col("i") + 1) * S.DIM / (F.col("n") + 1)), F.lit(S.DIM)).cast("int"))
    return coo(models.normalised(models.summed(turned, F.col("sign"))))


#: The table of parts as row vectors: its key, its strings and its numbers.
PART = ("p_partkey", ["p_brand", "p_type"], ["p_size", "p_retailprice"])


def _coo_search(spark_coo: DataFrame, key: str) -> DataFrame:
    """The objects nearest to one object of a normalised long-form model."""
    q = spark_coo.where(F.col("object").cast("string") == key).select("dim", F.col("val").alias("q"))
    hits = spark_coo.join(F.broadcast(q), "dim").groupBy("object").agg(F.round(F.sum(F.col("val") * F.col("q")), 6).alias("score"))
    return search.best(hits)


@query(f"WITH {S.DOCS}, q AS (SELECT dim, val AS q FROM docs_ WHERE object = 7) SELECT object, round(sum(val * q), 6) AS score FROM docs_ JOIN q USING (dim) GROUP BY object ORDER BY 2 DESC, 1 LIMIT 20")
def ri_document_search(spark, d):
    ix = indexed(spark, d)
    if ix is not None:
        x = matrices.document_products(ix, matrices.Documents("terms", SPACE), matrices.term_matrix(ix, ELEMENTAL), "7")
        return search.best(x.select("object", F.round("x", 6).alias("score")))
    return _coo_search(document_vectors(spark, d), "7")


@query(ORACLES["table_row_vectors"].split(" SELECT object, dim, round(val, 5)")[0] + ", q AS (SELECT dim, val AS q FROM p WHERE object = '7') SELECT object, round(sum(val * q), 6) AS score FROM p JOIN q USING (dim) GROUP BY object ORDER BY 2 DESC, 1 LIMIT 20")
def table_row_search(spark, d):
    part = table(spark, d, "part")
    own = rows.vectors(part, *PART, SPACE).where("object = '7'").select("dim", "val").collect()
    return search.best(rows.scores(part, *PART, SPACE, {r.dim: r.val for r in own if r.val is not None}).select("object", F.round("x", 6).alias("score")))


@query(f"""WITH {S.VOCAB}, c AS (SELECT substr(term, i, 1) AS object, substr(term, i + o, 1) AS other, sum(gf) AS n FROM vocab, range(1, 100) r(i), (VALUES (-1), (1)) s(o) WHERE i <= length(term) AND i + o BETWEEN 1 AND length(term) GROUP BY 1, 2),
  raw2 AS (SELECT object, {S.dim('other')} AS dim, CAST(sum(n * {S.SIGN}) AS DOUBLE) AS val FROM c, {S.KS} GROUP BY 1, 2), {S.normal('raw2', 'p')} SELECT object, dim, round(val, 6) + 0.0 AS val FROM p""")
def letter_vectors(spark, d):
    return coo(models.normalised(models.letters(space(spark, d)[1], SPACE)))


@query(f"WITH {S.STORE}, ends AS (SELECT {{0}} AS l, {{1}} AS r) SELECT CAST(n AS BIGINT) AS object, CAST(i AS INTEGER) AS i, round((l[i + 1] * (10 - n) + r[i + 1] * n) / sqrt(list_sum(list_transform(range({S.WIDTH}), lambda j: pow(l[j + 1] * (10 - n) + r[j + 1] * n, 2)))), 6) + 0.0 AS val FROM ends, range(0, 11) a(n), range({S.WIDTH}) b(i)".replace("{0}", "(SELECT vec FROM s WHERE object = 1)").replace("{1}", "(SELECT vec FROM s WHERE object = 2)"))
def number_vectors(spark, d):
    ends = search.gathered(store(spark, d), [1, 2])
    return entries(models.number_line(spark, ends, 0, 10), F.col("vec"))


# the algebra over pairs of stored vectors

P = f"WITH {S.STORE}, p AS (SELECT x.object, x.vec AS a, y.vec AS b FROM s x JOIN s y ON y.object = x.object + 1)"


@query(f"{P} SELECT object, round(list_inner_product(a, b), 6) + 0.0 AS dot, round(list_cosine_similarity(a, b), 6) + 0.0 AS cosine, round(sqrt(list_inner_product(a, a)), 6) AS norm FROM p")
def vector_measures(spark, d):
    a, b = F.col("a"), F.col("b")
    return pairs_of_store(spark, d).select("object", rounded(V.dot(a, b)).alias("dot"), rounded(V.cosine(a, b)).alias("cosine"), rounded(V.norm(a)).alias("norm"))


def _algebra(name: str, vec: Callable[[Column, Column], Column], value: str) -> None:
    ORACLES[name] = f"{P} SELECT object, CAST(i AS INTEGER) AS i, round(CAST({value} AS DOUBLE), 6) + 0.0 AS val FROM p, range({S.WIDTH}) r(i)"
    QUERIES[name] = lambda spark, d: entries(pairs_of_store(spark, d), vec(F.col("a"), F.col("b")))


_sum = f"list_sum(list_transform(range({S.WIDTH}), lambda j: a[j + 1] * b[((i - j + {S.WIDTH}) % {S.WIDTH}) + 1]))"
_inv = f"list_sum(list_transform(range({S.WIDTH}), lambda j: a[j + 1] * b[((j - i + {S.WIDTH}) % {S.WIDTH}) + 1]))"
_algebra("vector_superpose", lambda a, b: V.superpose(a, b, 0.5), "a[i + 1] + 0.5 * b[i + 1]")
_algebra("vector_normalise", lambda a, b: V.normalise(a), "a[i + 1] / sqrt(list_inner_product(a, a))")
_algebra("vector_shift", lambda a, b: V.shift(a, 3), f"a[((i - 3 + {S.WIDTH}) % {S.WIDTH}) + 1]")
_algebra("vector_involution", lambda a, b: V.involution(a), f"a[(({S.WIDTH} - i) % {S.WIDTH}) + 1]")
_algebra("vector_bind", lambda a, b: V.convolve(a, b), _sum)
_algebra("vector_release", lambda a, b: V.convolve(a, V.involution(b)), _inv)
_algebra("vector_bind_permutation", lambda a, b: V.bind(a, b, "permutation"), f"b[((i - 1 + {S.WIDTH}) % {S.WIDTH}) + 1] + a[((i + 1) % {S.WIDTH}) + 1]")
_algebra("vector_negation", V.without, "(a[i + 1] / sqrt(list_inner_product(a, a)) - list_cosine_similarity(a, b) * b[i + 1] / sqrt(list_inner_product(b, b))) / sqrt(1 - pow(list_cosine_similarity(a, b), 2))")

PH = f"""WITH {S.STORE}, ph AS (SELECT object, list_transform(range({S.WIDTH} // 2), lambda i: CAST(CASE WHEN vec[2 * i + 1] = 0 AND vec[2 * i + 2] = 0 THEN -1 ELSE CAST(floor((CASE WHEN atan2(vec[2 * i + 2], vec[2 * i + 1]) < 0 THEN atan2(vec[2 * i + 2], vec[2 * i + 1]) + 2 * pi() ELSE atan2(vec[2 * i + 2], vec[2 * i + 1]) END) * 16384 / (2 * pi())) AS INTEGER) % 16384 END AS INTEGER)) AS vec FROM s),
  p AS (SELECT x.object, x.vec AS a, y.vec AS b FROM ph x JOIN ph y ON y.object = x.object + 1)"""


def _phases(name: str, vec: Callable[[Column, Column], Column], value: str) -> None:
    ORACLES[name] = f"{PH} SELECT object, CAST(i AS INTEGER) AS i, CAST({value} AS DOUBLE) AS val FROM p, range({S.WIDTH} // 2) r(i)"

    def build(spark, d):
        x = pairs_of_store(spark, d).select("object", V.phases(F.col("a")).alias("a"), V.phases(F.col("b")).alias("b"))
        return entries(x, vec(F.col("a"), F.col("b")))

    QUERIES[name] = build


_phases("phase_vectors", lambda a, b: a, "a[i + 1]")
_phases("phase_bind", V.phase_bind, "(a[i + 1] + b[i + 1]) % 16384")
_phases("phase_release", V.phase_release, "(a[i + 1] - b[i + 1] + 16384) % 16384")
_phases("phase_complement", lambda a, b: V.phase_complement(a), "(a[i + 1] + 8192) % 16384")


@query(f"{PH} SELECT object, round(list_avg(list_transform(range({S.WIDTH} // 2), lambda i: cos(2 * pi() * (a[i + 1] - b[i + 1]) / 16384))), 6) + 0.0 AS score FROM p")
def phase_overlap(spark, d):
    return pairs_of_store(spark, d).select("object", rounded(V.phase_overlap(V.phases(F.col("a")), V.phases(F.col("b")))).alias("score"))


@query(f"{P} SELECT object, round(1 - 2.0 * list_sum(list_transform(range({S.WIDTH}), lambda i: CASE WHEN (a[i + 1] > 0) <> (b[i + 1] > 0) THEN 1 ELSE 0 END)) / {S.WIDTH}, 6) + 0.0 AS score, CAST(list_sum(list_transform(a, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)) AS INTEGER) AS ones FROM p")
def binary_overlap(spark, d):
    a, b = V.bits(F.col("a")), V.bits(F.col("b"))
    return pairs_of_store(spark, d).select("object", rounded(V.binary_overlap(a, b)).alias("score"), V.ones(a).alias("ones"))


# searches


def _search(name: str, hits: Callable[[DataFrame], DataFrame], ctes: str, score: str, where: str = "true") -> None:
    QUERIES[name] = lambda spark, d: hits(store(spark, d))
    ORACLES[name] = f"WITH {S.STORE}, {ctes} SELECT object, round({score}, 6) AS score FROM s, q WHERE {where} ORDER BY round({score}, 6) DESC, object LIMIT 20"


_v = lambda i: f"(SELECT vec FROM s WHERE object = {i})"
_unit = lambda x: f"list_transform({x}, lambda c: c / sqrt(list_inner_product({x}, {x})))"
_three = f"q AS (SELECT {_v(1)} AS a, {_v(2)} AS b, {_v(3)} AS c)"
_each = lambda f: f"list_transform(range({S.WIDTH}), lambda i: {f})"
_cos = lambda x: f"list_cosine_similarity(vec, {x})"
_search("search_sum", lambda s: search.search_sum(s, [1, 2]), f"q AS (SELECT {_each('a[i + 1] + b[i + 1]')} AS q FROM (SELECT {_v(1)} AS a, {_v(2)} AS b))", _cos("q"))
_search("search_not", lambda s: search.search_not(s, [1], [2]), f"q AS (SELECT {_each('a[i + 1] / sqrt(list_inner_product(a, a)) - list_cosine_similarity(a, b) * b[i + 1] / sqrt(list_inner_product(b, b))')} AS q FROM (SELECT {_v(1)} AS a, {_v(2)} AS b))", _cos("q"))
_search("search_subspace", lambda s: search.search_subspace(s, [1, 2]), f"q AS (SELECT a, {_each('b[i + 1] / sqrt(list_inner_product(b, b)) - list_cosine_similarity(a, b) * a[i + 1] / sqrt(list_inner_product(a, a))')} AS u FROM (SELECT {_v(1)} AS a, {_v(2)} AS b))", f"sqrt(pow({_cos('a')}, 2) + pow({_cos('u')}, 2))")
_search("search_maxsim", lambda s: search.search_extreme(s, [1, 2, 3], False), _three, f"greatest({_cos('a')}, {_cos('b')}, {_cos('c')})")
_search("search_minsim", lambda s: search.search_extreme(s, [1, 2, 3], True), _three, f"least({_cos('a')}, {_cos('b')}, {_cos('c')})")
_search("search_bound_minimum", lambda s: search.search_bound_minimum(s, [1, 2, 3]), _three, f"greatest(0.0, least({_cos('a')}, {_cos('b')}), {_cos('c')})")
_search("search_permuted", lambda s: search.search_permuted(s, [1, None, 2]), f"q AS (SELECT {_each(f'a[((i + 1) % {S.WIDTH}) + 1] + b[((i - 1 + {S.WIDTH}) % {S.WIDTH}) + 1]')} AS q FROM (SELECT {_v(1)} AS a, {_v(2)} AS b))", _cos("q"))
_search("search_analogy", lambda s: search.search_analogy(s, 1, 2, 3), f"q AS (SELECT {_each('b[i + 1] / sqrt(list_inner_product(b, b)) - a[i + 1] / sqrt(list_inner_product(a, a)) + c[i + 1] / sqrt(list_inner_product(c, c))')} AS q FROM (SELECT {_v(1)} AS a, {_v(2)} AS b, {_v(3)} AS c))", _cos("q"), "object NOT IN (1, 2, 3)")
_search("search_bound_product", lambda s: search.search_bound(s, 1, 2), f"q AS (SELECT {_each(_inv)} AS q FROM (SELECT {_v(1)} AS a, {_v(2)} AS b))", _cos("q"))
_search("search_balanced_permutation", lambda s: search.search_balanced(s, s, 1), f"q AS (SELECT {_each(f'a[((i - 1 + {S.WIDTH}) % {S.WIDTH}) + 1]')} AS q, {_each(f'a[((i + 1) % {S.WIDTH}) + 1]')} AS r FROM (SELECT {_v(1)} AS a))", f"greatest({_cos('q')}, {_cos('r')})")


_off = lambda t, e: f"list_cosine_similarity({_each(f'vec[((i + 1) % {S.WIDTH}) + 1] - {t}[((i + 2) % {S.WIDTH}) + 1]')}, {e})"
_search("search_proximity", lambda s: search.search_proximity(s, [1, 2, 3], (4, 5)), f"q AS (SELECT {_v(1)} AS a, {_v(2)} AS b, {_v(3)} AS c, {_v(4)} AS e, {_v(5)} AS f)", f"sqrt(pow({_off('a', 'e')} - {_off('b', 'e')}, 2) + pow({_off('a', 'f')} - {_off('b', 'f')}, 2)) + sqrt(pow({_off('b', 'e')} - {_off('c', 'e')}, 2) + pow({_off('b', 'f')} - {_off('c', 'f')}, 2))")


@query(f"WITH {S.STORE}, q AS (SELECT {_v(1)} AS q), h AS (SELECT object, round(list_cosine_similarity(vec, q), 6) AS score FROM s, q) SELECT object, round(round((score - avg(score) OVER ()) / stddev_pop(score) OVER (), 6), 3) + 0.0 AS score FROM h")
def search_standardised(spark, d):
    s = store(spark, d)
    hits = search.scored(s, search.gathered(s, [1]).select(F.get("vs", F.lit(0)).alias("q")), V.cosine(F.col("vec"), F.col("q")))
    return search.standardised(hits).select("object", (F.round("score", 3) + F.lit(0.0)).alias("score"))


@query(f"WITH {S.STORE}, q AS (SELECT {_v(1)} AS q) SELECT object, round(list_cosine_similarity(vec, q), 6) AS score FROM s, q WHERE round(list_cosine_similarity(vec, q), 6) > 0.1")
def search_threshold(spark, d):
    s = store(spark, d)
    return search.scored(s, search.gathered(s, [1]).select(F.get("vs", F.lit(0)).alias("q")), V.cosine(F.col("vec"), F.col("q"))).where("score > 0.1")


@query(f"WITH {S.STORE}, h AS (SELECT x.object AS query, y.object AS object, round(list_cosine_similarity(x.vec, y.vec), 6) AS score FROM s x JOIN s y ON x.object <> y.object) SELECT query, object, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, object) AS INTEGER) AS rank FROM h QUALIFY rank <= 5")
def search_batch(spark, d):
    s = store(spark, d)
    return search.batch(s, s.select(F.col("object").alias("query"), F.col("vec").alias("q")))


@query(f"WITH {S.STORE}, p AS (SELECT object AS a, object * 7 % 601 AS b FROM s) SELECT a, b, coalesce(round(list_cosine_similarity(x.vec, y.vec), 6), 0.0) AS score FROM p LEFT JOIN s x ON x.object = a LEFT JOIN s y ON y.object = b")
def compare_pairs(spark, d):
    s = store(spark, d)
    return search.compare(s, s.select(F.col("object").alias("a"), (F.col("object") * 7 % 601).alias("b")))


@query(f"""WITH {S.TF}, l AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY 1), m AS (SELECT count(*) AS n, avg(len) AS mean FROM l), h AS (SELECT * FROM tf WHERE term IN ('the', 'und', 'les')), g AS (SELECT term, count(*) AS df FROM h GROUP BY 1)
  SELECT doc_id AS object, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM h JOIN g USING (term) JOIN l USING (doc_id), m GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def search_keyword(spark, d):
    return search.keyword_in(table(spark, d, "documents"), ["the", "und", "les"])


@query(f"""WITH {S.TERMS}, q0 AS (SELECT dim, sum(val) AS q FROM terms_ WHERE object IN ('the', 'and') GROUP BY dim), q AS (SELECT dim, q / sqrt((SELECT sum(q * q) FROM q0)) AS q FROM q0)
  SELECT object, round(sum(val * q), 6) AS score FROM terms_ JOIN q USING (dim) GROUP BY object ORDER BY 2 DESC, 1 LIMIT 20""")
def ri_search_sum(spark, d):
    t = terms(spark, d)
    q = t.where(F.col("object").isin("the", "and")).groupBy("dim").agg(F.sum("val").alias("q"))
    length = q.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("n"))
    hits = t.join(F.broadcast(q), "dim").groupBy("object").agg(F.sum(F.col("val") * F.col("q")).alias("x"))
    return search.best(hits.crossJoin(F.broadcast(length)).select("object", F.round(F.col("x") / F.col("n"), 6).alias("score")))


@query("SELECT vec_id AS object FROM embeddings WHERE regexp_matches(vec_id::VARCHAR, '^1.*7$')")
def lookup_regex(spark, d):
    return store(spark, d).where(F.col("object").cast("string").rlike("^1.*7$")).select("object")


@query(f"WITH {S.STORE}, q AS (SELECT {_v(1)} AS q), h AS (SELECT object, round(list_cosine_similarity(vec, q), 6) AS score FROM s, q ORDER BY 2 DESC, 1 LIMIT 20) SELECT 'q1 Q0 ' || object || ' ' || row_number() OVER (ORDER BY score DESC, object) || ' ' || printf('%.4f', score) || ' DEFAULT' AS line FROM h")
def result_lines(spark, d):
    hits = search.search_sum(store(spark, d), [1])
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "object"))
    return hits.select(F.format_string("q1 Q0 %s %s %.4f DEFAULT", F.col("object").cast("string"), rank.cast("string"), "score").alias("line"))


# analysis


@query("""WITH c AS (SELECT vec_id % 7 AS cluster, label AS parent FROM embeddings), g AS (SELECT cluster, parent, count(*) AS n FROM c GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY cluster) AS size FROM g) SELECT parent, round(sum(n * (n - 1)) / sum(n * (size - 1)), 6) AS overlap FROM t GROUP BY parent""")
def cluster_overlap(spark, d):
    return analysis.cluster_overlap(table(spark, d, "embeddings").select((F.col("vec_id") % 7).alias("cluster"), F.col("label").alias("parent")))


@query()
def k_means(spark, d):
    return analysis.k_means(store(spark, d))


@query(f"""WITH {S.STORE}, p AS (SELECT round(list_cosine_similarity(x.vec, y.vec), 6) AS x, (l.label = m.label)::INT::DOUBLE AS y FROM s x JOIN s y ON y.object = x.object + 1 JOIN embeddings l ON l.vec_id = x.object JOIN embeddings m ON m.vec_id = y.object),
  r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM p) SELECT round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r""")
def pair_correlation(spark, d):
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("object"), "label")
    nxt = labels.select((F.col("object") - 1).alias("object"), F.col("label").alias("label2"))
    p = pairs_of_store(spark, d).join(labels, "object").join(nxt, "object")
    return analysis.correlations(p.select(F.round(V.cosine(F.col("a"), F.col("b")), 6).alias("x"), (F.col("label") == F.col("label2")).cast("double").alias("y")))


@query(f"""WITH {S.STORE}, e AS (SELECT object AS a, object + 1 AS b FROM s UNION ALL SELECT object + 1, object FROM s), n AS (SELECT a AS object, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM e JOIN s ON s.object = e.b), g AS (SELECT object, i, sum(x) AS x, count(*) AS n FROM n GROUP BY 1, 2)
  SELECT s.object, CAST(i - 1 AS INTEGER) AS i, round((n * vec[i] + x) / (2 * n), 6) + 0.0 AS val FROM g JOIN s ON s.object = g.object""")
def retrofit_once(spark, d):
    s = store(spark, d)
    lexicon = s.select(F.col("object").alias("a"), (F.col("object") + 1).alias("b")).unionByName(s.select((F.col("object") + 1).alias("a"), F.col("object").alias("b")))
    return entries(analysis.retrofit(s, lexicon, 1), F.col("vec"))


@query("SELECT avg(value) AS mean, var_pop(value) AS variance, round(avg(1 / (1 + exp(-value))), 6) AS sigmoid, round(avg(CASE WHEN greatest(value, 10) = 0 THEN 1 ELSE least(value, 10) / greatest(value, 10) END), 6) AS proportion FROM events".replace("avg(value)", "round(avg(value), 6)").replace("var_pop(value)", "round(var_pop(value), 4)"))
def statistics(spark, d):
    v = F.col("value")
    return table(spark, d, "events").agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.var_pop(v), 4).alias("variance"), F.round(F.avg(T.sigmoid(v)), 6).alias("sigmoid"), F.round(F.avg(T.proportion_score(v, F.lit(10.0))), 6).alias("proportion"))


@query()
def latent_semantic_analysis(spark, d):
    ix = indexed(spark, d)
    if ix is not None:
        return analysis.decomposition_of_documents(ix)
    tf = space(spark, d)[0].join(weights(spark, d), "term")
    m = tf.select(F.col("term").alias("object"), F.col("doc_id").alias("column"), (F.log10(1 + F.col("tf")) * F.col("weight")).alias("val"))
    return analysis.decomposition(m)


@query()
def skip_gram_embeddings(spark, d):
    held = numbered(spark, d)
    if held is None:
        return trainers.skip_gram(pairs(spark, d).select("term", "other"), space(spark, d)[1])
    return trainers.skip_gram_of_documents(table(spark, d, "documents"), held, S.RADIUS)


@query()
def predication_embeddings(spark, d):
    return trainers.predication_embeddings(triples(spark, d))


# the other books fill themselves as they are read
from . import algebra, building, searching  # noqa: E402, F401
