"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, col, discard, materialize, packed, read, resting, unpacked

#: By the rank of a source in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = "mix-1"
OUTPUTS = ["size", "source_size", "target", "copies", "taken"]


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(quality: Column) -> Column:
    """Sampling weight of a document from its mean quality label (0 to 1): 0.5 to 2, and 1 where there is no label."""
    return F.coalesce(F.lit(0.5) + F.lit(1.5) * quality.cast("double"), F.lit(1.0))


def sampling_key(row_key: Column, weight: Column, seed: str = SEED) -> Column:
    """-ln(u) / weight: exponential with the document's weight as its rate, so the smallest keys are a weighted sample
    without replacement. u in (0, 1] comes from the MD5 of seed and row key: reruns agree."""
    digest = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(row_key.cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + 1) / F.lit(float(2**48))
    w = F.when(weight.isNull() | F.isnan(weight) | (weight <= 0), F.lit(1.0)).otherwise(weight)
    return -F.log(u) / w


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to their targets: min(max_epochs * source_size, level * weight), at the one level at which
    targets add up to all sizes; that is what resharing the excess again and again ends in.

    One row per source goes through single-partition windows; sources are few beside documents.
    """
    rank = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int"))
    s = sizes.withColumn("__w", pick).withColumn("__cap", F.col("source_size") * max_epochs).withColumn("__ratio", F.col("__cap") / F.col("__w"))
    order = [F.col("__ratio"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("__total", F.sum("source_size").over(everything))
    s = s.withColumn("__level", (F.col("__total") - F.coalesce(F.sum("__cap").over(before), F.lit(0))) / F.sum("__w").over(after))
    # Once a source stays under its cap, so do all after it, and their level is the same but for rounding: take the first.
    s = s.withColumn("__open", F.col("__level") <= F.col("__ratio"))
    level = F.min_by(F.when(F.col("__open"), F.col("__level")), F.when(F.col("__open"), F.col("__ratio"))).over(everything)
    s = s.withColumn("__final", level)
    target = F.when(F.col("__final") * F.col("__w") < F.col("__cap"), F.col("__final") * F.col("__w")).otherwise(F.col("__cap").cast("double"))
    return s.select("source", "source_size", target.alias("target"))


def mix_sources(df: DataFrame, *, source: str = "source", size: Column | None = None, row_key: str = "doc_id", weight: Column | None = None, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, tie: Column | None = None) -> DataFrame:
    """How often the mix takes each row, as `copies`, with `size`, `source_size`, `target` and `taken` = size * copies.

    Every row comes back once. A source is taken in complete epochs first; the rest of its target goes to the rows of the
    smallest sampling keys, up to the row whose middle still lies before it, so a source misses its target by at most half
    of one row. Prefix sums run over ranges of the key first (about sqrt(n) of them) and then over the rows of the single
    range in which the target falls: no task sees all rows of a hot source, and no text is shuffled.

    `tie` (a long, equal for rows alike in all columns) and `size` may be given where `df` is a join of wide rows: with both
    made before that join, the tables of keys need no texts of it.

    Null sources are one source, last in order. Size 0 (null or blank text): taken 0, in no way counted. Repeated rows, alike
    in key and in all columns, are rows of their own, of which as many are taken as come nearest the target: which ones cannot
    be told. Null row keys share one sampling key's draw and are told apart by their other columns. An empty table gives an
    empty result. Input columns named as one of the outputs are replaced; other names clash with nothing.
    """
    size = word_count(col("text")) if size is None else size
    weight = F.lit(1.0) if weight is None else weight
    tie = row_hash(df) if tie is None else tie
    own = {"source": col(source), "size": F.coalesce(size.cast("long"), F.lit(0)), "key": sampling_key(col(row_key), weight, seed), "tie": tie}
    slim = materialize(df.select(*[c.alias(n) for n, c in own.items()]))
    ranges = max(16, 2 ** round(math.log2(max(1, slim.count())) / 2))
    bucket = F.least(F.floor(F.lit(float(ranges)) * (1 - F.exp(-F.col("key")))), F.lit(ranges - 1)).cast("int")
    by_range = materialize(slim.groupBy("source", bucket.alias("b")).agg(F.sum("size").alias("words")))
    targets = source_targets(by_range.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0).cast("long")
    rest = F.when(F.col("epochs") < max_epochs, F.col("target") - F.col("epochs") * F.col("source_size")).otherwise(0.0)
    targets = materialize(targets.withColumn("epochs", whole).withColumn("rest", F.greatest(rest, F.lit(0.0))))
    same = F.col("source").eqNullSafe(F.col("s"))
    # The first range of each source whose end lies beyond the rest of the target, and the words before it.
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("b"))
    crossing = by_range.withColumn("end", upto).join(targets.select(F.col("source").alias("s"), "rest"), same).filter(F.col("end") > F.col("rest"))
    crossing = crossing.groupBy(F.col("source").alias("s")).agg(F.min("b").alias("cut_b"), F.min_by(F.col("end") - F.col("words"), "b").alias("before"))
    started = materialize(targets.join(crossing, same, "left").drop("s"))
    discard(by_range, targets)
    # Within that range, group by group of rows alike: the last group of which a row is taken, and how many of it.
    edge = slim.filter("size > 0").join(started.select(F.col("source").alias("s"), "cut_b", "before", "rest"), same & (bucket == F.col("cut_b")))
    edge = edge.groupBy("source", "before", "rest", "key", "tie", F.col("size").alias("each")).agg(F.count(F.lit(1)).alias("rows"))
    ahead = F.col("before") + F.sum(F.col("each") * F.col("rows")).over(Window.partitionBy("source").orderBy("key", "tie", "each")) - F.col("each") * F.col("rows")
    room = F.least(F.floor((F.col("rest") - F.col("ahead")) / F.col("each") + 0.5), F.col("rows"))
    last = edge.withColumn("ahead", ahead).withColumn("room", room).filter((F.col("room") > 0) & (F.col("rest") > 0))
    last = last.groupBy(F.col("source").alias("s")).agg(F.max(F.struct("key", "tie", "each", "room", "rows")).alias("cut"))
    plan = materialize(started.join(last, same, "left").drop("s"))
    discard(slim, started)
    plan = resting(plan.select(F.col("source").alias("s"), F.struct(*[c for c in plan.columns if c != "source"]).alias("plan")), plan)
    rows = packed(df, own).join(plan, same)
    place, cut = F.struct("key", "tie", F.col("size").alias("each")), F.struct("plan.cut.key", "plan.cut.tie", "plan.cut.each")
    inside = F.when(bucket == F.col("plan.cut_b"), F.coalesce(place <= cut, F.lit(False))).otherwise(bucket < F.coalesce(F.col("plan.cut_b"), F.lit(ranges)))
    taking = (F.col("plan.rest") > 0) & (F.col("size") > 0)
    rows = rows.withColumn("extra", F.when(taking, inside.cast("long")).otherwise(0))
    if not plan.filter("plan.cut.room < plan.cut.rows").isEmpty():  # a target falls among repeats of a row
        split = F.coalesce(taking & (bucket == F.col("plan.cut_b")) & (place == cut) & (F.col("plan.cut.room") < F.col("plan.cut.rows")), F.lit(False))
        rows = rows.filter(~split).unionByName(_first_repeats(materialize(rows.filter(split).withColumn("part", F.spark_partition_id()))))
    copies = F.when(F.col("size") > 0, F.col("plan.epochs") + F.col("extra")).otherwise(0).cast("long")
    out = {"size": F.col("size"), "source_size": F.col("plan.source_size"), "target": F.col("plan.target"), "copies": copies, "taken": F.col("size") * copies}
    return resting(rows.select(*unpacked(df.columns, OUTPUTS), *[c.alias(n) for n, c in out.items()]), plan)


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns but maps, which Spark does not hash."""
    return F.xxhash64(*[col(c) for c, kind in df.dtypes if not kind.startswith("map")])


def _first_repeats(rows: DataFrame) -> DataFrame:
    """Repeats of a row, written with the part they came from: `extra` is 1 for as many as there is room for. They are numbered
    by part first, so that a row repeated very often meets in no one task."""
    upto = F.sum("n").over(Window.partitionBy("s").orderBy("part"))
    sizes = rows.groupBy("s", "part").agg(F.count(F.lit(1)).alias("n")).select(F.col("s").alias("of"), F.col("part").alias("p"), (upto - F.col("n")).alias("before"))
    number = F.row_number().over(Window.partitionBy("s", "part").orderBy("tie"))
    numbered = rows.withColumn("number", number).join(sizes, F.col("s").eqNullSafe(F.col("of")) & (F.col("part") == F.col("p")))
    return numbered.withColumn("extra", (F.col("before") + F.col("number") <= F.col("plan.cut.room")).cast("long")).drop("part", "number", "of", "p", "before")


def with_quality(docs: DataFrame, labels: DataFrame, *, row_key: str = "doc_id", output: str = "quality") -> DataFrame:
    """`docs` with the mean quality label of their key, if any. Null keys have none, and are dealt by their text's hash so
    that they do not meet in one task."""
    mean = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg(F.avg(F.col("quality").cast("double")).alias("quality"), F.lit(0).cast("long").alias("zero"))
    spread = F.when(col(row_key).isNull(), row_hash(docs)).otherwise(F.lit(0))
    rows = packed(docs, {"key": col(row_key), "spread": spread}).join(mean, (F.col("key") == F.col("label_id")) & (F.col("spread") == F.col("zero")), "left")
    return rows.select(*unpacked(docs.columns, [output]), F.col("quality").alias(output))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, weighted by their quality labels. Null and blank texts have size 0 and are not taken; null
    sources are one source; rows alike are taken one by one; an empty table gives no rows."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    docs = materialize(with_quality(docs, read(spark, sf_dir, "labels")))
    mixed = mix_sources(docs, size=F.col("words"), weight=quality_weight(F.col("quality")))
    return mixed.select("doc_id", "size", "source", "source_size", "target", "copies", "taken")


def repeat_rows(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of each row as often as `copies` says."""
    again = mixed.filter("copies > 0").select(F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(columns)]).alias("row"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return again.select(*unpacked(columns, []))


def number_copies(rows: DataFrame, *, row_key: str = "doc_id", text: str = "text", output: str = "copy") -> DataFrame:
    """`rows` with a number from 1 on for rows of the same key and text."""
    number = F.row_number().over(Window.partitionBy("key", "hash").orderBy("hash"))
    return packed(rows, {"key": col(row_key), "hash": F.xxhash64(col(text))}).select(*unpacked(rows.columns, [output]), number.cast("long").alias(output))


#: For DuckDB: the same keys and targets, with plain row-by-row prefix sums.
OP1_SQL = """
WITH quality AS (
  SELECT doc_id, avg(CAST(quality AS DOUBLE)) AS q FROM labels GROUP BY doc_id
), base AS (
  SELECT d.doc_id, d.source, CAST(coalesce(len(regexp_extract_all(d.text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 1) / 281474976710656.0::DOUBLE)
      / coalesce(0.5 + 1.5 * q.q, 1.0) AS k
  FROM documents d LEFT JOIN quality q ON d.doc_id = q.doc_id
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source
), weighed AS (
  SELECT source, source_size, source_size * 3 AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM sizes
), levels AS (
  SELECT *, cap / w AS ratio,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
  FROM weighed
), final AS (SELECT min_by(lv, ratio) AS lv FROM levels WHERE lv <= ratio
), targets AS (
  SELECT source, source_size, CASE WHEN f.lv * w < cap THEN f.lv * w ELSE CAST(cap AS DOUBLE) END AS target FROM levels, final f
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS epochs FROM targets
), placed AS (
  SELECT b.*, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
    sum(b.size) OVER (PARTITION BY b.source ORDER BY b.k, b.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - b.size / 2.0 AS middle
  FROM base b JOIN plan p ON b.source IS NOT DISTINCT FROM p.source
), counted AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE CAST(epochs AS BIGINT) + CASE WHEN epochs < 3 AND rest > 0 AND middle <= rest THEN 1 ELSE 0 END END AS copies FROM placed
)
SELECT doc_id, size, source, source_size, target, CAST(copies AS BIGINT) AS copies, CAST(size * copies AS BIGINT) AS taken FROM counted
"""
