"""Quality rules of documents and of their hosts.

Each text is measured and checked by base rules. Failures are aggregated by host; every host's
failure rate is shrunk towards the corpus by a beta prior fitted to all hosts (empirical Bayes),
so that a small host isn't judged by a few documents. Documents of a host whose shrunk rate is
above the limit go, and so do those that fail a base rule.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALTS, add_columns, grouped_back, numbered, renamed, settled

SYMBOLS = "#*$%&|<>"
#: A host goes if its shrunk failure rate is above this.
MAX_HOST_RATE = 0.6

MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", "kept"]


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text.

    Words are runs without ASCII white space. A line counts as a copy if it has a word and equals
    an earlier line. Repeated words are those in a window of three found twice or more.
    """
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split on exactly \x20 and \x09-\x0D
    chars = len(text) - sum(map(text.count, " \t\n\r\x0b\x0c"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 3 - max(end, i)
                end = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def _measure_batch(batch: pa.RecordBatch) -> list[pa.Array]:
    rows = [measure(t) for t in batch.column(0).to_pylist()]
    return [pa.array(list(c), pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5


def text_measures(df: DataFrame, text_col: str = "text", carry_text: bool = True) -> DataFrame:
    """df with the five measures and base_failed (few words, or mostly repeated ones). Columns named like a result are replaced."""
    few = F.col("n_words") < 50
    mostly_repeated = 100 * F.col("n_repeat_words") > 50 * F.col("n_words")
    return add_columns(df, _measure_batch, MEASURES, [text_col], carry=carry_text).withColumn("base_failed", few | mostly_repeated)


def beta_prior(hosts: DataFrame) -> DataFrame:
    """One row with alpha and beta, fitted to the hosts' n and failed by moments.

    The mean is that of all documents. The spread between hosts is what their weighted variance
    has beyond the binomial's; where there is none (or one host), the prior is as strong as all data.
    """
    n, f = F.col("n").cast("double"), F.col("failed").cast("double")
    sums = hosts.agg(F.sum(n).alias("N"), F.sum(f).alias("K"), F.count("*").alias("H"), F.sum(n * n).alias("N2"), F.sum(f * f / n).alias("Q"))
    mean = F.col("K") / F.col("N")
    # sum n (p - mean)^2, its binomial part and the factor of the variance between hosts
    spread = F.col("Q") - F.col("N") * mean * mean
    within = mean * (1 - mean)
    factor = F.col("N") - F.col("N2") / F.col("N")
    between = F.when(factor > 0, (spread - (F.col("H") - 1) * within) / factor)
    strength = F.when(between > 0, within / between - 1).otherwise(F.col("N"))
    strength = F.greatest(F.least(strength, F.col("N")), F.lit(1.0))
    # half a failure each way keeps the prior proper where nothing or everything failed
    share = (F.col("K") + 0.5) / (F.col("N") + 1)
    return sums.select((share * strength).alias("alpha"), ((1 - share) * strength).alias("beta"))


def host_rules(df: DataFrame, host_col: str = "source", text_col: str = "text", max_rate: float = MAX_HOST_RATE, carry_text: bool = True) -> DataFrame:
    """df with the measures, base_failed, host_rate (shrunk failure rate of the host) and kept.

    A NULL host is a host of its own. NULL text has no words, so it fails. An empty table gives no
    rows. Columns named like a result are replaced, others may have any name. Each row is judged,
    repeated rows too, and each whole text, however long. A rate equal to the limit keeps.
    """
    plain, (host, text) = numbered(df, host_col, text_col)
    key = F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit(""))  # no real host is empty then
    # by row and not by content, so that copies of one text are dealt out too; settled() fixes the numbers
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    rows = settled(text_measures(plain, text, carry_text).withColumn("host", key).withColumn("salt", salt))
    failed = F.sum(F.col("base_failed").cast("bigint"))
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"), failed.alias("failed"))
    prior = F.broadcast(beta_prior(hosts))  # one row
    per_salt = [F.count("*").alias("n"), failed.alias("failed")]
    judged = grouped_back(rows, ["host"], "salt", per_salt, [F.sum("n").alias("n"), F.sum("failed").alias("failed")]).crossJoin(prior)
    rate = (F.col("failed") + F.col("alpha")) / (F.col("n") + F.col("alpha") + F.col("beta"))
    out = judged.withColumn("host_rate", rate).withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= max_rate))
    return renamed(out, df.columns, RESULTS, [] if carry_text else [df.columns[int(text)]])


_WORDS = r"[^\x20\x09-\x0D]+"
ORACLE = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '{_WORDS}') AS w FROM d),
k AS (SELECT doc_id, i, w[i:i+2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM k) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM hit, range(3) r(o) GROUP BY 1),
lin AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{_WORDS}') GROUP BY 1),
m AS (SELECT doc_id, coalesce(source, chr(0)) AS h, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(lin.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lin USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
hosts AS (SELECT h, CAST(count(*) AS DOUBLE) AS n, CAST(sum(base_failed::INT) AS DOUBLE) AS f FROM b GROUP BY h),
s AS (SELECT sum(n) AS n, sum(f) AS k, count(*) AS hs, sum(n * n) AS n2, sum(f * f / n) AS q FROM hosts),
v AS (SELECT *, k / n AS mean, n - n2 / n AS factor FROM s),
x AS (SELECT *, CASE WHEN factor > 0 THEN (q - n * mean * mean - (hs - 1) * mean * (1 - mean)) / factor END AS between FROM v),
y AS (SELECT *, greatest(least(CASE WHEN between > 0 THEN mean * (1 - mean) / between - 1 ELSE n END, n), 1.0) AS strength FROM x),
p AS (SELECT (k + 0.5) / (n + 1) * strength AS a, (1 - (k + 0.5) / (n + 1)) * strength AS b FROM y),
r AS (SELECT h, (f + p.a) / (n + p.a + p.b) AS host_rate FROM hosts, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_rate <= {MAX_HOST_RATE} AS kept
FROM b JOIN r USING (h)
"""
