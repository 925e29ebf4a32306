"""Mixing sources to target weights by Poisson replication.

Each document's number of copies is a Poisson variate with its source's mean repetition
rate, got by inverting the distribution at a hash of seed and id. Copies are dealt out and
sorted by another hash: a shuffle of the whole mix. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import stored

#: Rates above this are split into equal parts, each inverted at a hash of its own: the sum
#: of independent Poisson variates is a Poisson variate, and exp(-rate) never underflows.
MOST_AT_ONCE = 64
#: Entries of an inverted distribution: beyond them its tail is under 1e-16.
ENTRIES = 200
#: With so many sources at most, their rates are broadcast (under 2 KB each); else each
#: source's are joined in so many parts, so that a large source isn't one task's.
BROADCAST_SOURCES, SALTS = 5_000, 64


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 hash."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def _inverted(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... of a Poisson variate."""
    none = F.exp(-rate)
    first = F.struct(F.array(none).alias("all"), none.alias("p"), none.alias("c"))

    def more(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k
        return F.struct(F.concat(s["all"], F.array(s["c"] + p)).alias("all"), p.alias("p"), (s["c"] + p).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ENTRIES)), first, more, lambda s: s["all"])


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """(source, chars, rate) for each source: its target share of the mix, over its own share.

    ``weights`` name the shares of sources; a source that it leaves out gets none. Without
    weights the share of a source is in proportion to its characters to the power
    ``temperature``. The mix has ``epochs`` times the characters of all documents.
    A null source is a source of its own; sources without characters have rate ``epochs``.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).alias("chars"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.when(F.col("chars") > 0, F.pow(F.col("chars").cast("double"), F.lit(float(temperature)))).otherwise(0.0))
    else:
        named = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.create_map().cast("map<string,double>")
        sizes = sizes.withColumn("weight", F.coalesce(F.element_at(named, F.col("source")), F.lit(0.0)).cast("double"))
    sizes = stored(sizes, "mix-sizes")
    total = sizes.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))
    share = F.col("weight") / F.when(F.col("all_weight") > 0, F.col("all_weight"))
    rate = F.when(F.col("chars") > 0, F.coalesce(share * float(epochs) * F.col("all_chars") / F.col("chars"), F.lit(0.0))).otherwise(F.lit(float(epochs)))
    return sizes.join(F.broadcast(total)).select("source", "chars", rate.alias("rate"))  # total is one row


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: str = "mix", doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` replicated to the target weights and shuffled, with ``copy`` (from 1), ``n_copies``, ``rate`` and ``order_key``.

    Rows come sorted by ``order_key`` within partitions that the key deals out. Rows with
    one id (repeated rows, or null ids, which hash as one) get as many copies each.
    Columns of ``docs`` that are named like an added one are replaced.
    """
    found = stored(rates(docs, weights, temperature, epochs, source, text), "mix-rates")
    few = found.count() <= BROADCAST_SOURCES
    parts = F.greatest(F.ceil(F.col("rate") / MOST_AT_ONCE), F.lit(1)).cast("int")
    found = found.select(F.col("source").alias("__source"), "rate", parts.alias("__parts")).withColumn("__cdf", _inverted(F.col("rate") / F.col("__parts")))
    added = {"copy", "n_copies", "rate", "order_key"}
    own = docs.select(*[docs[c] for c in docs.columns if c.lower() not in added])
    if few:
        joined = own.join(F.broadcast(found), own[source].eqNullSafe(F.col("__source")))
    else:
        dealt = own.withColumn("__salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
        salted = found.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = dealt.join(salted.hint("merge"), own[source].eqNullSafe(F.col("__source")) & (F.col("__salt") == F.col("__part")))
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    draws = F.transform(F.sequence(F.lit(1), F.col("__parts")), lambda j: _unit(F.lit(seed), key, j.cast("string")))
    copies = F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter("__cdf", lambda c: c <= u)))
    counted = joined.withColumn("n_copies", copies).where("n_copies > 0")
    dealt = counted.select(*own.columns, F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy"), "n_copies", F.round("rate", 6).alias("rate"))
    order = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), key, F.col("copy").cast("string")).cast("binary")), 1, 15), 16, 10).cast("bigint")
    return dealt.withColumn("order_key", order).repartition("order_key").sortWithinPartitions("order_key", doc_id, "copy")


#: What ``mixed(documents)`` returns, for DuckDB.
SQL = """
WITH sizes AS (
  SELECT source, sum(length(coalesce(text, '')))::BIGINT AS chars FROM documents GROUP BY source
), weighed AS (
  SELECT *, CASE WHEN chars > 0 THEN pow(chars::DOUBLE, 0.5) ELSE 0 END AS weight FROM sizes
), rated AS (
  SELECT source, CASE WHEN chars > 0 THEN weight / (SELECT sum(weight) FROM weighed) * (SELECT sum(chars) FROM weighed)::DOUBLE / chars ELSE 1.0 END AS rate FROM weighed
), split AS (
  SELECT *, greatest(ceil(rate / 64), 1)::INT AS parts FROM rated
), pmf AS (
  SELECT source, k, CASE WHEN rate > 0 THEN exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1)) WHEN k = 0 THEN 1.0 ELSE 0.0 END AS p
  FROM split, generate_series(0, 200) AS g(k)
), cdf AS (
  SELECT source, list(c ORDER BY k) AS cs FROM (
    SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf
  ) GROUP BY source
), drawn AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, s.rate, cdf.cs,
         unnest(range(1, s.parts + 1)) AS part, row_number() OVER () AS row_id
  FROM documents d JOIN split s ON d.source IS NOT DISTINCT FROM s.source JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source
), counted AS (
  SELECT row_id, any_value(doc_id) AS doc_id, any_value(text) AS text, any_value(lang) AS lang, any_value(source) AS source, any_value(n_chars) AS n_chars, any_value(rate) AS rate,
         sum(len(list_filter(cs, lambda c: c <= ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || part), 1, 13))::BIGINT / 4503599627370496.0)))::INT AS n_copies
  FROM drawn GROUP BY row_id
), dealt AS (
  SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n_copies + 1))::INT AS copy, n_copies, round(rate, 6) AS rate FROM counted
)
SELECT *, ('0x' || substr(md5('mix-order|' || coalesce(doc_id::VARCHAR, '') || '|' || copy), 1, 15))::BIGINT AS order_key FROM dealt
"""
