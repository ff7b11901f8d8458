"""Profile fields for columns with as many values as rows: quantiles and top values without counting every value.

* Quantiles: a KLL sketch for each column, built in one pass and merged across partitions, groups or stored tables. Only
  sketches are shuffled. ``K`` keeps the rank error of a quantile below 0.01.
* Top values: frequent-items sketches name candidates and bound the count of any value they do not name; the candidates
  are then counted exactly. Where the n-th of them is above the bound the answer is proven, else the values are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.ranking import top_n_per_group
from basketry.operators.profile import TOP_VALUES, top_values
from basketry.session import require_checkpoint_dir

# Items kept by a quantile sketch (normalised rank error about 0.005), the quartiles, and candidates of a
# frequent-items sketch. A value that such a sketch does not name occurs at most ERROR * rows / TRACKED times: its table
# has the next power of two of slots over TRACKED / 0.75, and loses at most 3.5 * rows / slots.
K = 512
QUARTILES = (0.25, 0.5, 0.75)
TRACKED = 4096
ERROR = 3.5 * 0.75


def quantile_sketches(df: DataFrame, columns: list[str], by: list[str] | None = None, k: int = K) -> DataFrame:
    """``[by ...,] col_name, n, sketch``: a mergeable sketch of the non-null, non-NaN values of each column."""
    def of(c: str) -> Column:
        v = F.col(c).cast("double")
        v = F.when(~F.isnan(v), v)
        return F.struct(F.lit(c).alias("col_name"), F.count(v).alias("n"), F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"))

    rows = df.groupBy(*(by or [])).agg(F.array(*(of(c) for c in columns)).alias("_s"))
    return rows.select(*(by or []), F.inline("_s"))


def merged_quantiles(sketches: DataFrame, probabilities: tuple[float, ...] = QUARTILES, k: int = K) -> DataFrame:
    """``col_name, n, q, value``: quantiles of each column over all its sketches; a column without values has none."""
    merged = sketches.where("n > 0").groupBy("col_name").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("_m"))
    values = F.kll_sketch_get_quantile_double("_m", F.array(*(F.lit(float(q)) for q in probabilities)))
    pairs = F.arrays_zip(F.array(*(F.lit(float(q)) for q in probabilities)).alias("q"), values.alias("value"))
    return merged.select("col_name", "n", F.explode(pairs).alias("_p")).select("col_name", "n", F.col("_p.q").alias("q"), F.col("_p.value").alias("value"))


def rank_errors(df: DataFrame, quantiles: DataFrame) -> DataFrame:
    """``quantiles`` with ``rank_error``: how far ``q`` is from the ranks that the value takes among the rows, as a share of
    them (0 where it is one of its ranks). One pass over ``df`` against a few rows per column."""
    columns = [r.col_name for r in quantiles.select("col_name").distinct().collect()]
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("col_name"), F.col(c).cast("double").alias("_x")) for c in columns))))
    counts = long.where(F.col("_x").isNotNull() & ~F.isnan("_x")).join(F.broadcast(quantiles), "col_name").groupBy("col_name", "q").agg(
        F.count_if(F.col("_x") < F.col("value")).alias("_below"), F.count_if(F.col("_x") <= F.col("value")).alias("_upto"))
    error = F.greatest(F.col("_below") / F.col("n") - F.col("q"), F.col("q") - F.col("_upto") / F.col("n"), F.lit(0.0))
    return quantiles.join(counts, ["col_name", "q"]).withColumn("rank_error", error).drop("_below", "_upto")


def heavy_hitters(df: DataFrame, columns: list[str], n: int = TOP_VALUES, tracked: int = TRACKED) -> DataFrame:
    """``col_name, most_freq_values_top_10``: exactly ``profile.top_values``, null counted as a value, ties by text.

    Two passes: sketches of all columns (only they are shuffled), then an exact count of the candidates' rows. The
    candidates, at most ``tracked`` a column, are broadcast. A column is counted in full only where its n-th candidate
    is not above what a value outside the candidates can have.
    """
    require_checkpoint_dir(df.sparkSession)
    text = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    sketch = [F.call_function("approx_top_k", t, F.lit(tracked), F.lit(tracked)) for t in text]
    named = df.agg(F.array(*(F.struct(F.lit(c).alias("col_name"), F.transform(s, lambda x: x["item"]).alias("items")) for c, s in zip(columns, sketch))).alias("_c"))
    candidates = named.select(F.inline("_c")).select("col_name", F.explode("items").alias("_t"))
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("col_name"), t.alias("_t")) for c, t in zip(columns, text)))))
    counts = long.join(F.broadcast(candidates), ["col_name", "_t"]).groupBy("col_name", "_t").agg(F.count(F.lit(1)).alias("n"))
    value = F.when(F.col("_t") != "n", F.expr("substr(_t, 2)"))
    counts = counts.select("col_name", value.alias("value_str"), "n").checkpoint()
    top = top_n_per_group(counts, ["col_name"], [F.desc("n"), F.asc_nulls_first("value_str")], n)
    rows = df.count()
    seen = {r.col_name: r.n for r in counts.groupBy("col_name").agg(F.sum("n").alias("n")).collect()}
    last = {r.col_name: r.n for r in top.where(F.col("rank") == n).collect()}
    open_ = [c for c in columns if seen.get(c, 0) < rows and last.get(c, 0) <= ERROR * rows / tracked]
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("rank", "value_str", "n"))), lambda s: F.struct(s["value_str"].alias("value"), s["n"].alias("count")))
    out = top.where(~F.col("col_name").isin(open_)).groupBy("col_name").agg(pairs.alias("most_freq_values_top_10"))
    return out.unionByName(top_values(df, open_, n)) if open_ else out
