"""Mixing sources to target weights by hash-threshold histograms; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, bounded, save

#: Bits of a row's hash, and bits that a histogram refines at a time.
HASH_BITS, LEVEL_BITS = 60, 12
#: The most often that a mix takes a document.
MOST = 3
#: Rounds that fill a source's budget; each after the first takes only documents that fit what is left.
ROUNDS = 3


def with_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with _size (words), _hash (60 bits of the id's md5) and _source."""
    return docs.withColumns({
        "_size": F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long"),
        "_hash": F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long"),
        "_source": F.col(source_col),
    })


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """For each source (a row of sizes: source, source_size): sid, weight and target.

    Sources in code point order, null last, get the weights in turn. All of the words are shared by
    weight; no source gets more than MOST times its size, and what is over goes to the others. With the
    sources sorted by cap per weight, those that are capped come first.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("sid", F.row_number().over(every) - 1)
    s = s.withColumn("weight", F.array(*map(F.lit, weights))[F.col("sid") % len(weights)].cast("long"))
    s = s.withColumn("cap", F.col("source_size") * MOST)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    everything = Window.partitionBy()
    s = s.withColumns({
        "total": F.sum("source_size").over(everything),
        "before": F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"),
        "from_here": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    s = s.withColumn("capped", F.col("cap") / F.col("weight") <= (F.col("total") - F.col("before")) / F.col("from_here"))
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    share = F.col("weight") * left / F.coalesce(open_weight, F.lit(1))
    return s.select("source", "sid", "weight", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _threshold(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """For each sid of budgets (sid, budget): thr, base, edge.

    Rows (sid, _size, _hash) with _hash < thr hold base words, which the budget covers; edge is the words
    of those whose hash is thr (null if all rows fit). A histogram over the hash's leading bits finds the
    bucket in which the budget ends; only the rows of that bucket are looked at again, with more bits.
    No task sorts rows: a window spans a source's buckets, at most 2 ** LEVEL_BITS.
    """
    at = budgets.select("sid", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("base"))
    done = 0
    found = None
    while done < HASH_BITS:
        shift = HASH_BITS - done - LEVEL_BITS
        inside = rows.join(bounded(at), "sid").where(F.shiftright("_hash", HASH_BITS - done) == F.col("prefix"))
        hist = inside.groupBy("sid", "budget", "base", F.shiftright("_hash", shift).alias("bucket")).agg(F.sum("_size").alias("words"), F.min("_hash").alias("low"), F.max("_hash").alias("high"))
        up_to = F.col("base") + F.sum("words").over(Window.partitionBy("sid").orderBy("bucket"))
        over = hist.withColumn("up_to", up_to).where("up_to > budget")
        edge = save(over.groupBy("sid").agg(F.min_by(F.struct("budget", "bucket", (F.col("up_to") - F.col("words")).alias("base"), "words", "low", "high"), "bucket").alias("e")).select("sid", "e.*"))
        done += LEVEL_BITS
        ended = edge.where("low = high").select("sid", F.col("low").alias("thr"), "base", F.col("words").alias("edge"))
        found = ended if found is None else found.unionByName(ended)
        at = edge.where("low < high").select("sid", "budget", F.col("bucket").alias("prefix"), "base")
        if at.isEmpty():
            break
    # Sources whose rows all fit: no threshold.
    fit = rows.join(bounded(budgets), "sid").join(bounded(found), "sid", "left_anti").groupBy("sid").agg(F.sum("_size").alias("base"))
    fit = fit.select("sid", F.lit(1 << HASH_BITS).alias("thr"), "base", F.lit(None).cast("long").alias("edge"))
    return save(found.unionByName(fit))


def _chosen(rounds: int) -> F.Column:
    """Whether a row joined to its source's plan gets a copy besides the whole repeats."""
    out = F.lit(False)
    for k in range(rounds):
        out = out | ((F.col("_size") <= F.col(f"most_{k}")) & (F.col("_hash") < F.col(f"thr_{k}")))
    return F.coalesce(out, F.lit(False))


def mixing_plan(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), rounds: int = ROUNDS) -> DataFrame:
    """A row per source: source, source_size, target, repeats and, for each round, thr_k and most_k.

    sized has _source, _size, _hash. A source's documents are taken `repeats` times each, and those that
    a round chooses once more: in round k those of at most most_k words whose hash is below thr_k.
    Budgets nest: a larger target keeps what a smaller one takes in the first round.
    """
    sizes = save(sized.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size")))
    plan = targets(sizes, weights)
    plan = plan.withColumn("repeats", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
    plan = save(plan.withColumn("budget", F.col("target") - F.col("repeats") * F.col("source_size")))
    rows = sized.join(bounded(plan), F.col("_source").eqNullSafe(F.col("source"))).select("sid", "_size", "_hash")
    rows = save(rows.where("_size > 0"))
    for k in range(rounds):
        most = F.lit((1 << 62)) if k == 0 else F.floor(F.greatest("budget", F.lit(0.0))).cast("long")
        plan = save(plan.withColumn(f"most_{k}", most.cast("long")))
        left = rows if k == 0 else rows.join(bounded(plan), "sid").where(~_chosen(k) & (F.col("_size") <= F.col(f"most_{k}"))).select(rows["sid"], "_size", "_hash")
        cut = _threshold(left, plan.select("sid", "budget"))
        plan = plan.join(bounded(cut), "sid", "left")
        left_after = F.col("budget") - F.coalesce("base", F.lit(0))
        plan = save(plan.withColumns({f"thr_{k}": F.coalesce("thr", F.lit(0)).cast("long"), f"over_{k}": F.col("edge") - left_after, "budget": left_after}).drop("thr", "base", "edge"))
    # Stop with the document at a round's edge where that brings the words nearer than all rounds without.
    overs = [f"over_{k}" for k in range(rounds)]
    best = F.least(*[F.coalesce(F.col(c), F.lit(float("inf"))) for c in overs], F.lit(float("inf")))
    stop = F.when(best < F.col("budget"), F.coalesce(*[F.when(F.col(c) == best, F.lit(k)) for k, c in enumerate(overs)]))
    plan = plan.withColumn("stop", stop)
    for k in range(rounds):
        plan = plan.withColumn(f"thr_{k}", F.when(F.col("stop") == k, F.col(f"thr_{k}") + 1).when(F.col("stop") < k, 0).otherwise(F.col(f"thr_{k}")))
    return save(plan.drop("stop", *overs))


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken (words taken, repeats counted).

    Null text has size 0, and so is never taken; a null source is a source of its own, and comes last.
    Rows that repeat an id share its hash, so a threshold takes all or none. The same rows in any order
    give the same mix. A very long text is a document like any other, counted as a whole. An empty table gives an empty result.
    Other columns of docs, whatever their names, are not looked at.
    """
    sized = save(with_sizes(docs, id_col, text_col, source_col).select(F.col(id_col).alias("doc_id"), "_source", "_size", "_hash"))
    plan = mixing_plan(sized, weights)
    out = sized.join(bounded(plan), F.col("_source").eqNullSafe(F.col("source")))
    taken = F.col("_size") * (F.col("repeats") + _chosen(ROUNDS).cast("long"))
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The rows of docs that the mix takes, as often as it takes them; columns as in docs.

    Other cases as in mix_counts. docs may have columns of any names, those used inside included.
    """
    names = docs.columns
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("_row"))
    sized = with_sizes(packed, f"_row.{id_col}", f"_row.{text_col}", f"_row.{source_col}")
    plan = mixing_plan(save(sized.select("_source", "_size", "_hash")), weights)
    out = sized.join(bounded(plan), F.col("_source").eqNullSafe(F.col("source")))
    copies = (F.col("repeats") + _chosen(ROUNDS).cast("long")) * (F.col("_size") > 0).cast("long")
    out = out.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), copies.cast("int"))))
    return out.select(*[F.col("_row").getField(c).alias(c) for c in names])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _round_sql(k: int) -> str:
    """One filling round: c{k} has the cumulated words of the candidates, g{k} what is left after it and how far the edge is over."""
    fits = "" if k == 0 else f" JOIN g{k - 1} USING (sid) WHERE NOT d.chosen AND d.size <= floor(greatest(g{k - 1}.budget, 0))"
    rows = "SELECT d.* EXCLUDE (chosen) FROM d0 d" if k == 0 else f"SELECT d.* EXCLUDE (chosen) FROM d{k} d{fits}"
    budget = "(SELECT sid, budget FROM plan)" if k == 0 else f"g{k - 1}"
    base = "coalesce(max(c.cum) FILTER (c.cum <= c.budget), 0)"
    return f"""c{k} AS (SELECT r.rid, r.sid, r.size, r.h, b.budget,
      sum(r.size) OVER (PARTITION BY r.sid ORDER BY r.h)::BIGINT AS cum FROM ({rows}) r JOIN {budget} b USING (sid) WHERE r.size > 0),
g{k} AS (SELECT b.sid, b.budget - {base} AS budget, min(c.cum) FILTER (c.cum > c.budget) AS edge,
      min(c.cum) FILTER (c.cum > c.budget) - {base} - (b.budget - {base}) AS over_by FROM {budget} b LEFT JOIN c{k} c USING (sid) GROUP BY b.sid, b.budget),
d{k + 1} AS (SELECT d.* REPLACE (d.chosen OR t.rid IS NOT NULL AS chosen) FROM d{k} d LEFT JOIN (SELECT rid FROM c{k} WHERE cum <= budget) t USING (rid)),
"""


_LAST = ROUNDS - 1
_OVERS = ", ".join(f"coalesce(g{k}.over_by, 'inf'::DOUBLE)" for k in range(ROUNDS))
_STOP_SQL = f"""m AS (SELECT g0.sid, least({_OVERS}) AS best, g{_LAST}.budget AS short, {", ".join(f"g{k}.over_by AS over_{k}" for k in range(ROUNDS))}
      FROM g0 {" ".join(f"JOIN g{k} ON g{k}.sid = g0.sid" for k in range(1, ROUNDS))}),
st AS (SELECT sid, CASE WHEN best < short THEN CASE {" ".join(f"WHEN over_{k} = best THEN {k}" for k in range(ROUNDS))} END ELSE {ROUNDS} END AS stop FROM m),
x AS ({" UNION ALL ".join(f"SELECT c.rid FROM c{k} c JOIN g{k} g USING (sid) JOIN st USING (sid) WHERE {k} <= st.stop AND (c.cum <= c.budget OR {k} = st.stop AND c.cum = g.edge)" for k in range(ROUNDS))})
SELECT s.doc_id, s.size, p.source_size, p.target, s.size * (p.repeats + (x.rid IS NOT NULL)::INT)::BIGINT AS taken
FROM s JOIN d0 USING (rid) JOIN plan p USING (sid) LEFT JOIN x USING (rid)
"""

OP1_SQL = (
    r"""
WITH s AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
      ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM s GROUP BY source),
w AS (SELECT *, (sid % 3 + 1)::BIGINT AS weight, source_size * 3 AS cap FROM src),
o AS (SELECT *, (sum(source_size) OVER ())::BIGINT AS total,
      (sum(cap) OVER (ORDER BY cap / weight, sid ROWS UNBOUNDED PRECEDING))::BIGINT - cap AS before,
      (sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS from_here FROM w),
k AS (SELECT *, cap / weight <= (total - before) / from_here AS capped FROM o),
t AS (SELECT *, CASE WHEN capped THEN cap::DOUBLE ELSE weight * (total - coalesce((sum(cap) FILTER (capped) OVER ())::BIGINT, 0))
      / coalesce((sum(weight) FILTER (NOT capped) OVER ())::BIGINT, 1) END AS target FROM k),
plan AS (SELECT source, sid, source_size, target, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS repeats,
      target - coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT * source_size AS budget FROM t),
d0 AS (SELECT s.rid, p.sid, s.size, s.h, false AS chosen FROM s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
"""
    + "".join(_round_sql(k) for k in range(ROUNDS))
    + _STOP_SQL
)
