"""Mixing sources to target weights by systematic sampling.

Each source gets a target share of the characters of the mixture (equal shares unless given).
All documents of a source then have the same expected number of copies, target characters over
its own characters, held as a whole number of 1/2**20 so that sums are exact. In each source
expected copies are prefix-summed in order of doc_id, one random offset in [0, 1) is added, and
a copy is emitted for each integer boundary that the sum crosses: the copies of a document differ
from its expectation by less than one, and those of a source from its total by less than one.

The prefix sum doesn't put a source, hot or not, into one task: doc_ids are cut into ranges at
approximate quantiles; sums by source and range are prefix-summed first (a small table), and
within a range by a window. The result doesn't depend on where the ranges are cut.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import packing as P

ONE = 1 << 20
SEED = "mix-1"
EPOCHS = 1.0

ORACLE_SQL = """
WITH s AS (
  SELECT source, count(*) AS n, coalesce(sum(length(text)), 0) AS chars FROM {docs} GROUP BY source
), r AS (
  SELECT source,
         CASE WHEN chars = 0 THEN 0
              ELSE CAST(floor(CAST(sum(chars) OVER () AS DOUBLE) / count(*) OVER () / chars * 1048576.0) AS BIGINT) END AS rate,
         CAST('0x' || substr(md5(coalesce(source, '') || ':mix-1'), 1, 5) AS BIGINT) AS shift
  FROM s
), p AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, r.rate,
         row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id NULLS FIRST, d.text NULLS FIRST) * r.rate + r.shift AS upto
  FROM {docs} d JOIN r ON d.source IS NOT DISTINCT FROM r.source
), c AS (
  SELECT *, (upto // 1048576) - ((upto - rate) // 1048576) AS copies FROM p
)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(generate_series(1, copies)) AS INTEGER) AS copy_no FROM c WHERE copies > 0
"""


def _ranges(docs: DataFrame, column: str, ranges: int) -> list[float]:
    cuts = docs.select(F.percentile_approx(F.col(column).cast("double"), [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0] or []
    return [float("-inf"), *sorted(set(cuts) or {0.0}), float("inf")]


def _fraction(text: Column) -> Column:
    """A number of 0..2**20-1 from a text, the same on every engine."""
    return F.conv(F.substring(F.md5(text), 1, 5), 16, 10).cast("long")


def rates(sizes: DataFrame, key: str, weights: dict[str | None, float] | None, epochs: float, seed: str) -> DataFrame:
    """Expected copies a document and offset, in 1/2**20, of each source of (key, source, chars)."""
    whole = Window.partitionBy(F.lit(1))  # over the sources, of which there are few
    if weights is None:
        share = F.lit(1.0) / F.count("*").over(whole)
    else:
        total = float(sum(weights.values()))
        share = F.lit(0.0)
        for source, weight in weights.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(weight / total)).otherwise(share)
    wanted = F.sum("chars").over(whole).cast("double") * share / F.col("chars") * F.lit(epochs * ONE)
    return sizes.select(key, F.when(F.col("chars") == 0, F.lit(0)).otherwise(F.floor(wanted)).cast("long").alias("rate"), _fraction(F.concat(F.coalesce("source", F.lit("")), F.lit(f":{seed}"))).alias("shift"))


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = EPOCHS, seed: str = SEED, ranges: int | None = None) -> DataFrame:
    """The mixture: all columns of ``docs``, and copy_no = 1.. for the copies of a document.

    ``weights`` maps sources to target weights; a source that it lacks gets none, and with None all
    sources get the same. The mixture has about ``epochs`` times the characters of the corpus. A null
    source is a source of its own. Null and empty texts have no characters but are documents of their
    source and are drawn at its rate; a source without any character gives nothing. Order is by
    doc_id (nulls first), then text; rows that tie in both are alike. An empty table gives no rows.
    A column of ``docs`` named copy_no is replaced.
    """
    ranges = ranges or 4 * P.shuffle_width(docs.sparkSession)
    docs = docs.drop("copy_no")
    row, part, key, rate, shift, upto = (P.fresh_name(docs, f"mix_{x}") for x in ("row", "range", "source", "rate", "shift", "upto"))
    keyed = docs.withColumn(row, F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))))
    cut = _ranges(docs.select("doc_id"), "doc_id", max(2, ranges))
    bucketizer = Bucketizer(splits=cut, inputCol=row, outputCol=part, handleInvalid="keep")
    # a key without nulls, so that the join and the window share one exchange of the texts
    named = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-"))
    keyed = bucketizer.transform(keyed).withColumn(part, F.col(part).cast("int")).withColumn(key, named).drop(row)
    sums = keyed.groupBy(key, part).agg(F.first("source").alias("source"), F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    sums = P.checkpointed(sums)
    rate_of = rates(sums.groupBy(key).agg(F.first("source").alias("source"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars")), key, weights, epochs, seed)
    before = F.sum("n").over(Window.partitionBy(key).orderBy(part)) - F.col("n")
    starts = sums.withColumn("before", before).join(rate_of, key)
    starts = starts.select(key, part, F.col("rate").alias(rate), (F.col("before") * F.col("rate") + F.col("shift")).alias(shift))
    within = Window.partitionBy(key, part).orderBy(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    placed = keyed.withColumn(upto, F.row_number().over(within).cast("long"))
    joined = placed.join(starts, [key, part]).withColumn(upto, F.col(upto) * F.col(rate) + F.col(shift))
    copies = F.shiftright(upto, 20) - F.shiftright(F.col(upto) - F.col(rate), 20)
    emitted = joined.withColumn(upto, copies).filter(F.col(upto) > 0)
    return emitted.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(upto).cast("int"))).alias("copy_no"))
