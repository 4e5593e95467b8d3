"""Common table expressions of the DuckDB oracles."""

DIM, SEED, LEAST, RADIUS, WIDTH = 64, 8, 10, 2, 64
KS = f"range({SEED}) ks(k)"
LS = f"range({SEED}) ls(l)"


def sign(k: str = "k") -> str:
    return f"(CASE WHEN {k} < {SEED // 2} THEN 1 ELSE -1 END)"


SIGN = sign()


def hashed(key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT)"


def dim(key: str, k: str = "k") -> str:
    return f"CAST({hashed(f"CAST({key} AS VARCHAR) || '#' || {k}")} % {DIM} AS INTEGER)"


def normal(raw: str, name: str) -> str:
    return f"{name} AS (SELECT object, dim, CASE WHEN sum(val * val) OVER w > 0 THEN val / sqrt(sum(val * val) OVER w) ELSE 0.0 END AS val FROM {raw} WINDOW w AS (PARTITION BY object))"


TOKENS = r"tokens AS (SELECT doc_id, unnest(l) AS term, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda w: w <> '') AS l FROM documents))"
TF = f"{TOKENS}, tf AS (SELECT term, doc_id, count(*) AS tf FROM tokens GROUP BY 1, 2)"
VOCAB = f"{TF}, vocab AS (SELECT term, sum(tf) AS gf, count(*) AS df FROM tf GROUP BY 1 HAVING sum(tf) >= {LEAST} AND length(term) >= 2), weights AS (SELECT term, log10((SELECT count(DISTINCT doc_id) FROM tf) / df) AS idf FROM vocab)"
RAW = f"raw AS (SELECT term AS object, {dim('doc_id')} AS dim, CAST(sum(tf * {SIGN}) AS DOUBLE) AS val FROM tf JOIN vocab USING (term), {KS} GROUP BY 1, 2)"
TERMS = f"{VOCAB}, {RAW}, {normal('raw', 'terms_')}, terms AS (SELECT object, dim, round(val, 6) + 0.0 AS val FROM terms_)"
DOCS = f"{TERMS}, raw_docs AS (SELECT doc_id AS object, dim, sum(tf * idf * val) AS val FROM tf JOIN weights USING (term) JOIN (SELECT object AS term, dim, val FROM terms_) USING (term) GROUP BY 1, 2), {normal('raw_docs', 'docs_')}, docs AS (SELECT object, dim, round(val, 6) + 0.0 AS val FROM docs_)"
PAIRS = f"{VOCAB}, kept AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM tokens JOIN vocab USING (term)), pairs AS (SELECT x.doc_id, x.term, y.term AS other, CAST(y.n - x.n AS INTEGER) AS \"offset\" FROM kept x JOIN range(-{RADIUS}, {RADIUS + 1}) o(o) ON o <> 0 JOIN kept y ON y.doc_id = x.doc_id AND y.n = x.n + o)"
STORE = "s AS (SELECT vec_id AS object, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"
_clean = lambda c: f"replace(trim(lower({c})), ' ', '_')"
RAW_TRIPLES = f"""raw_triples AS (SELECT {_clean('s')} AS subject, upper(replace(trim(p), ' ', '_')) AS predicate, {_clean('o')} AS object FROM (
  SELECT c_name AS s, 'in_nation' AS p, n_name AS o FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT s_name, 'in_nation', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT n_name, 'in_region', r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT p_name, 'has brand', p_brand FROM part
  UNION ALL SELECT s_name, 'supplies', p_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey))"""
TRIPLES = f"{RAW_TRIPLES}, triples AS (SELECT DISTINCT * FROM raw_triples)"
