"""Host-level quality rules.

Every document is held against seven rules. Failures are counted by host (here the
source column), each rule's host rates are shrunk with a beta prior whose two
parameters come from the mean and variance of the host rates (method of
moments), and the shrunk rates are joined back to the documents. What the rules
need of a text is counted over the bytes of whole blocks of texts at once.

A document is rejected if it breaks at least `HARD` rules, or one of the decisive
rules (symbols, capitals, repeated words or lines: each alone marks junk), or if
it breaks any rule and its host's shrunk rate of some broken rule is above
`HOST_RATE`. A clean document is never rejected for its host.

Defined cases: null and empty texts have no words and break only `empty`, which is
decisive. Texts of any length count whole. A null host is a host of its own. Repeated
rows count each. With a single host, or equal rates, the prior has its weakest defined
form: strength `MOST_STRENGTH`. An empty table gives an empty result. Only doc_id,
source and text are read, whatever the names of other columns; `accepted` hands all
columns on as they were.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, U64, blocks, lean, mix64, release, small_side, word_hashes, word_spans, written

SYMBOLS = 0.05
CAPITALS = 0.3
REPEATED_WORDS = 0.25
REPEATED_LINES = 0.5
LONG_WORDS = 20.0
PIPES = 0.15
HARD = 2
HOST_RATE = 0.5
#: Bounds of the prior's strength a + b.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0

RULES = ("empty", "symbols", "capitals", "word_repeats", "line_repeats", "long_words", "pipes")
DECISIVE = ("empty", "symbols", "capitals", "word_repeats", "line_repeats", "pipes")


def _table(signs: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[[ord(c) for c in signs]] = True
    return found


_SYMBOL, _OTHER = _table("#*%&$!~^<>{}"), _table(" \t\n\r0123456789.,;:!?#*%&$|")
_CAPITAL, _WORD, _LINE = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ~_table(" \t\n\r"), ~_table("\n")
#: Second bytes of the capitals from U+00C0 to U+00DE, whose first byte is 0xC3.
_SECOND = np.zeros(256, bool)
_SECOND[[*range(0x80, 0x97), *range(0x98, 0x9F)]] = True
COUNTS = ("chars", "words", "same", "pipes", "lines", "equal_lines", "symbols", "capitals", "other")


def count_block(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """What the rules need of each text."""
    n = len(offsets) - 1

    def total(marks: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(marks, out=sums[1:])
        return np.diff(sums[offsets])

    capital = _CAPITAL[data]
    capital[1:] |= (data[:-1] == 0xC3) & _SECOND[data[1:]]
    first, last, rows = word_spans(data, offsets, _WORD)
    h = word_hashes(data, first, last)
    per_row = lambda which: np.bincount(which, minlength=n)
    # a line holds something but blanks
    a, b, of = word_spans(data, offsets, _LINE)
    ink = np.zeros(len(data) + 1, np.int32)
    np.cumsum(data != 32, out=ink[1:])
    full = ink[b] > ink[a]
    a, b, of = a[full], b[full], of[full]
    line = mix64(word_hashes(data, a, b) ^ mix64(of.astype(U64)))
    distinct = of[np.unique(line, return_index=True)[1]]
    return {
        "chars": total((data & 0xC0) != 0x80), "words": per_row(rows), "same": per_row(rows[1:][(h[1:] == h[:-1]) & (rows[1:] == rows[:-1])]),
        "pipes": per_row(rows[(last - first == 1) & (data[first] == 124)]) if len(first) else np.zeros(n, int),
        "lines": per_row(of), "equal_lines": per_row(of) - per_row(distinct), "symbols": total(_SYMBOL[data]), "capitals": total(capital), "other": total(_OTHER[data]),
    }


def _counts(text: Column) -> Column:
    @F.arrow_udf(f"struct<{','.join(f'{c}:int' for c in COUNTS)}>")
    def count(column: pa.Array) -> pa.Array:
        parts = [count_block(data, offsets) for _, _, data, offsets in blocks(column)]
        release()
        return pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int32), *(x[c] for x in parts)]).astype(np.int32)) for c in COUNTS], names=list(COUNTS))

    return count(text)


def failures(docs: DataFrame) -> DataFrame:
    """docs with one integer column 0/1 for each rule (fail_<rule>)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = lean(docs).select(F.col("doc_id"), F.col("source").alias("host"), _counts(text).alias("c"))
    c, n = F.col("c"), F.col("c.words")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    rules = {
        "empty": n == 0,
        "symbols": share(c["symbols"], c["chars"]) > SYMBOLS,
        "capitals": (share(c["capitals"], c["chars"] - c["other"]) > CAPITALS) & (n >= 10),
        "word_repeats": (share(c["same"], n) > REPEATED_WORDS) & (n >= 10),
        "line_repeats": (c["lines"] >= 4) & (share(c["equal_lines"], c["lines"]) > REPEATED_LINES),
        "long_words": share(c["chars"], n) > LONG_WORDS,
        "pipes": (n >= 4) & (share(c["pipes"], n) > PIPES),
    }
    return base.select("doc_id", "host", *(F.coalesce(v, F.lit(False)).cast("int").alias(f"fail_{k}") for k, v in rules.items()))


def host_rates(failed: DataFrame) -> DataFrame:
    """(host, docs, rate_<rule> ...): shrunk failure rates."""
    hosts = failed.groupBy("host").agg(F.count("*").alias("docs"), *(F.sum(f"fail_{r}").alias(f"f_{r}") for r in RULES))
    prior = hosts.agg(*(x for r in RULES for x in (F.avg(F.col(f"f_{r}") / F.col("docs")).alias(f"m_{r}"), F.var_pop(F.col(f"f_{r}") / F.col("docs")).alias(f"v_{r}"))))

    def shrunk(r: str) -> Column:
        m, v = F.col(f"m_{r}"), F.col(f"v_{r}")
        strength = F.when(v > 0, F.least(F.greatest(m * (1 - m) / v - 1, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH))).otherwise(F.lit(MOST_STRENGTH))
        return ((F.col(f"f_{r}") + strength * m) / (F.col("docs") + strength)).alias(f"rate_{r}")

    # the prior is one row
    return hosts.crossJoin(F.broadcast(prior)).select("host", "docs", *(shrunk(r) for r in RULES))


def verdicts(docs: DataFrame) -> DataFrame:
    """(doc_id, host, n_failed, host_rate, keep) of every row of docs; host_rate is the highest shrunk rate of a broken rule."""
    failed = written(failures(docs), "failures")
    rates = host_rates(failed).withColumnRenamed("host", "rated").drop("docs")
    if rates.count() <= BROADCAST_ROWS:
        rates = F.broadcast(rates)
    n = sum((F.col(f"fail_{r}") for r in RULES), F.lit(0))
    decisive = sum((F.col(f"fail_{r}") for r in DECISIVE), F.lit(0))
    worst = F.greatest(*(F.col(f"fail_{r}") * F.col(f"rate_{r}") for r in RULES))
    return failed.join(rates, F.col("host").eqNullSafe(F.col("rated")), "left").select(
        "doc_id",
        "host",
        n.cast("bigint").alias("n_failed"),
        F.round(worst, 6).alias("host_rate"),
        (~((n >= HARD) | (decisive > 0) | ((n > 0) & (F.round(worst, 6) > HOST_RATE)))).alias("keep"),
    )


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected; columns as they were. Rows that share a doc_id are judged each."""
    key = F.xxhash64(docs["source"], docs["text"])
    judged = verdicts(docs.select(F.struct(F.col("doc_id").alias("gone_id"), key.alias("gone_key")).alias("doc_id"), "source", "text"))
    gone = written(judged.where("not keep").select("doc_id.gone_id", "doc_id.gone_key").distinct(), "rejected")
    gone = small_side(gone, gone.count())
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (key == gone["gone_key"]), "left_anti")


def oracle() -> str:
    """verdicts() over the documents table in DuckDB's SQL."""
    share = lambda a, b: f"(CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0.0 END)"
    rules = {
        "empty": "n = 0",
        "symbols": f"{share('symbols', 'chars')} > {SYMBOLS}",
        "capitals": f"{share('capitals', '(chars - other)')} > {CAPITALS} AND n >= 10",
        "word_repeats": f"{share('same', 'n')} > {REPEATED_WORDS} AND n >= 10",
        "line_repeats": f"len(lines) >= 4 AND {share('(len(lines) - len(list_distinct(lines)))', 'len(lines)')} > {REPEATED_LINES}",
        "long_words": f"{share('chars', 'n')} > {LONG_WORDS}",
        "pipes": f"n >= 4 AND {share("len(list_filter(words, lambda w: w = '|'))", 'n')} > {PIPES}",
    }
    strength = "CASE WHEN v_{r} > 0 THEN least(greatest(m_{r} * (1 - m_{r}) / v_{r} - 1, %s), %s) ELSE %s END" % (LEAST_STRENGTH, MOST_STRENGTH, MOST_STRENGTH)
    each = lambda text, sep=", ": sep.join(text.format(r=r) for r in RULES)
    return f"""
WITH base AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t,
         list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(13), '   '), ' '), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(trim(x, ' ')) > 0) AS lines
  FROM documents),
counted AS (
  SELECT doc_id, host, words, lines, len(words) AS n, length(t) AS chars,
         length(t) - length(translate(t, '#*%&$!~^<>{{}}', '')) AS symbols,
         length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) AS capitals,
         length(t) - length(translate(t, ' ' || chr(9) || chr(10) || chr(13) || '0123456789.,;:!?#*%&$|', '')) AS other,
         len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS same
  FROM base),
failed AS (SELECT doc_id, host, {', '.join(f'CAST(coalesce({v}, false) AS INTEGER) AS fail_{k}' for k, v in rules.items())} FROM counted),
hosts AS (SELECT host, count(*) AS docs, {each('sum(fail_{r}) AS f_{r}')} FROM failed GROUP BY host),
prior AS (SELECT {each('avg(CAST(f_{r} AS DOUBLE) / docs) AS m_{r}, var_pop(CAST(f_{r} AS DOUBLE) / docs) AS v_{r}')} FROM hosts),
rates AS (SELECT host AS rated, {each('(f_{r} + (' + strength + ') * m_{r}) / (docs + (' + strength + ')) AS rate_{r}')} FROM hosts, prior),
judged AS (
  SELECT doc_id, host, CAST({each('fail_{r}', ' + ')} AS BIGINT) AS n_failed,
         {' + '.join(f'fail_{r}' for r in DECISIVE)} AS decisive,
         round(greatest({each('fail_{r} * rate_{r}')}), 6) AS host_rate
  FROM failed LEFT JOIN rates ON host IS NOT DISTINCT FROM rated)
SELECT doc_id, host, n_failed, host_rate,
       NOT (n_failed >= {HARD} OR decisive > 0 OR (n_failed > 0 AND host_rate > {HOST_RATE})) AS keep
FROM judged"""
