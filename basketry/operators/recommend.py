"""Recommenders: category context, title similarity and optional filters, one request or all products.

Request forms take one product and return a top-n DataFrame; they read the whole catalogue but every
membership test is a join (semi-join against the catalogue, broadcast of the request's own small rows when
AQE measures them small), never a list collected to the driver. The batch form ranks for every product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.ranking import partitions_for, top_n_per_group
from basketry.functions.scores import product_score
from basketry.operators.catalog import category_bucket, product_categories
from basketry.operators.explore import helpfulness, in_folded
from basketry.operators.similarity import similar_titles

# The recommenders' default list length and title-similarity threshold.
DEFAULT_TOP_N = 5
TITLE_THRESHOLD = 0.3

CONTEXT_COLUMNS = ["id", "asin", "title", "salesrank", "total_reviews", "avg_rating", "group", "category"]


def _require_id(product_id) -> int:
    if product_id is None:
        raise ValueError("a product id is required")
    return int(product_id)


def _best_first() -> list[Column]:
    return [F.desc_nulls_last("score"), F.asc_nulls_last("asin")]


def top_scored(candidates: DataFrame, top_n: int | None = DEFAULT_TOP_N, ascending: bool = False) -> DataFrame:
    """``asin, title, score``: one row per product (its best score), best first, ties by asin.

    Grouping before ordering keeps the score that is sorted on (a distinct on (asin, title) followed by a
    sort on score would sort on an arbitrary surviving score).
    """
    n = DEFAULT_TOP_N if top_n is None else top_n
    per_product = candidates.groupBy("asin", "title").agg(F.max("score").alias("score"))
    order = [F.asc_nulls_last("score"), F.asc_nulls_last("asin")] if ascending else _best_first()
    return per_product.orderBy(*order).limit(int(n))


def relevant_categories(
    products: DataFrame, product_id, group: str | None = None, from_similars: bool = False
) -> DataFrame:
    """Category context of a product (``CONTEXT_COLUMNS``).

    * ``group`` None: the product's own rows, one per category.
    * ``group`` given, ``from_similars`` False (the running reference code): the product's own categories,
      kept when at least one of its similars exists in the catalogue and its group equals ``group``.
    * ``group`` given, ``from_similars`` True (the written intent): the catalogue rows of the product's
      similars, one per category, in ``group``.
    """
    pid = _require_id(product_id)
    one = products.where(F.col("id") == F.lit(pid))
    if group is None:
        return one.select(*CONTEXT_COLUMNS[:-1], F.explode("categories").alias("category"))
    sims = one.select(F.explode("similars").alias("similar_asin"))
    catalogue_asins = products.select(F.col("asin").alias("similar_asin"))
    present = sims.join(catalogue_asins, "similar_asin", "left_semi")
    if not from_similars:
        # existence as a scalar count subquery: a semi-join on the literal id would plan as a nested loop
        ctx = one.where(present.agg(F.count(F.lit(1))).scalar() > 0)
        ctx = ctx.select(*CONTEXT_COLUMNS[:-1], F.explode("categories").alias("category"))
    else:
        similar_rows = products.join(present.select(F.col("similar_asin").alias("asin")), "asin", "left_semi")
        ctx = similar_rows.select(*CONTEXT_COLUMNS[:-1], F.explode("categories").alias("category"))
    return ctx.where(F.col("group") == F.lit(group)).distinct()


def restrict_categories(context: DataFrame, categories: list[str] | str | None) -> DataFrame:
    """Keep context rows whose category is among ``categories`` (trimmed, case-folded); None keeps all."""
    if categories is None:
        return context
    wanted = [categories] if isinstance(categories, str) else list(categories)
    return context.where(in_folded(F.trim(F.col("category")), [c.strip() for c in wanted]))


def _in_categories(products: DataFrame, categories: DataFrame, stored=None) -> DataFrame:
    """Catalogue × category rows whose category is in ``categories`` (a semi-join, no collected list).

    With ``stored`` (a stored ``Catalog`` whose catalogue × category table is partitioned by ``cat_bucket``),
    the join also matches the bucket, so dynamic partition pruning reads only the requested categories'
    buckets instead of the whole catalogue.
    """
    wanted = categories.select("category").distinct()
    if stored is None or stored.categories is None:
        return product_categories(products).join(wanted, "category", "left_semi")
    wanted = wanted.withColumn("cat_bucket", category_bucket("category", stored.category_buckets))
    return stored.categories.join(wanted, ["category", "cat_bucket"], "left_semi").drop("cat_bucket")


def _scored(df: DataFrame) -> DataFrame:
    return df.withColumn("score", product_score())


def _best_of_categories(
    products: DataFrame, categories: DataFrame, pid: int, top_n: int | None, stored=None, group: str | None = None
) -> DataFrame:
    """``asin, title, score`` of the products in ``categories`` (of one group, if given) that can be among the ``top_n``
    best, product ``pid`` aside: from the stored score-sorted runs, as deep as ``top_n`` asks, or all of them."""
    n = DEFAULT_TOP_N if top_n is None else int(top_n)
    runs = getattr(stored, "category_runs", None)
    if runs is not None and runs.serves(n):
        return runs.candidates(categories, n, pid, group)
    rows = _in_categories(products, categories, stored)
    if group is not None:
        rows = rows.where(F.col("group") == F.lit(group))
    return _scored(rows.where(F.col("id") != F.lit(pid))).select("asin", "title", "score")


def recommend_by_category(
    products: DataFrame, product_id, group: str | None = None, categories: list[str] | str | None = None,
    top_n: int = DEFAULT_TOP_N, from_similars: bool = False, stored=None,
) -> DataFrame:
    """Products that share a relevant category with the request, best score first (input excluded)."""
    pid = _require_id(product_id)
    context = restrict_categories(relevant_categories(products, pid, group, from_similars), categories)
    return top_scored(_best_of_categories(products, context, pid, top_n, stored), top_n)


def recommend_with_chosen_categories(
    products: DataFrame, product_id, group: str, categories: list[str] | str, top_n: int = DEFAULT_TOP_N,
    from_similars: bool = False, stored=None,
) -> DataFrame:
    """Relevant-category products of ``group`` plus every catalogue product of the chosen categories (equal to one of
    them, blanks around it aside)."""
    pid = _require_id(product_id)
    context = relevant_categories(products, pid, group, from_similars)
    in_context = _best_of_categories(products, context, pid, top_n, stored, group)
    chosen = [categories] if isinstance(categories, str) else list(categories)
    wanted = products.sparkSession.createDataFrame([(c.strip(),) for c in chosen], "category string")
    return top_scored(in_context.unionByName(_best_of_categories(products, wanted, pid, top_n, stored)), top_n)


def recommend_by_category_and_title(
    products: DataFrame, product_id, group: str | None = None, categories: list[str] | str | None = None,
    top_n: int = DEFAULT_TOP_N, threshold: float = TITLE_THRESHOLD, from_similars: bool = False,
    stored=None,
) -> DataFrame:
    """Relevant-category products plus products whose title is at least ``threshold`` similar to the
    request's title (token Jaccard), best score first."""
    pid = _require_id(product_id)
    context = restrict_categories(relevant_categories(products, pid, group, from_similars), categories)
    by_category = _best_of_categories(products, context, pid, top_n, stored)
    by_title = similar_titles(products, pid, threshold, include_self=False, index=getattr(stored, "title_index", None))
    return top_scored(by_category.unionByName(_scored(by_title).select("asin", "title", "score")), top_n)


def recommend_with_requested_category(
    products: DataFrame, product_id, group: str | None, category: str, top_n: int = DEFAULT_TOP_N,
    stored=None,
) -> DataFrame:
    """Relevant categories plus one requested category appended as a row, then as
    ``recommend_by_category``."""
    pid = _require_id(product_id)
    context = relevant_categories(products, pid, group).select("category")
    requested = products.sparkSession.createDataFrame([(category.strip(),)], "category string")
    return top_scored(_best_of_categories(products, context.unionByName(requested), pid, top_n, stored), top_n)


def similar_products(products: DataFrame, product_id) -> DataFrame:
    """The catalogue rows of a product's similars, one per category: ``id, asin, title, group, category``."""
    pid = _require_id(product_id)
    sims = products.where(F.col("id") == F.lit(pid)).select(F.explode("similars").alias("asin"))
    rows = products.alias("m").join(sims.alias("s"), F.col("m.asin") == F.col("s.asin"), "inner")
    return rows.select(
        F.col("m.id").alias("id"), F.col("m.asin").alias("asin"), F.col("m.title").alias("title"),
        F.col("m.group").alias("group"), F.explode(F.col("m.categories")).alias("category"),
    )


def recommend(
    products: DataFrame, asin: str | None = None, group: str | None = None, category: str | None = None,
    top_n: int | None = None, ascending: bool = False, stored=None,
) -> DataFrame:
    """Optional-filter recommender: every given argument adds its predicate, a missing one adds none.

    ``category`` matches as a substring of a category path (blanks around the argument aside), ``group`` by equality,
    and ``asin`` excludes that product. With an asin and no group, the candidates are the asin's own group (every
    product of that group is two hops from it in the property graph, through the group vertex). ``top_n`` defaults
    to 5. Catalogue rows are one per product, so this is a scan, a filter and a top-n: nothing is exploded or
    shuffled, and products without categories take part when no category is asked for. With ``stored`` tables a category
    is found among the paths by their trigrams, and only the buckets of those paths are read.
    """
    rows = products
    grams = getattr(stored, "category_grams", None)
    if category is not None and grams is not None:
        found = stored.categories.join(grams.containing(category.strip()), ["category", "cat_bucket"], "left_semi")
        rows = found.drop("category", "cat_bucket").distinct()  # a product may have several of the paths
    elif category is not None:
        wanted = F.lit(category.strip())
        rows = rows.where(F.exists("categories", lambda c: c.contains(wanted)))
    if group is not None:
        rows = rows.where(F.col("group") == F.lit(group))
    elif asin is not None and category is None:
        rows = rows.where(F.col("group") == products.where(F.col("asin") == F.lit(asin)).agg(F.max("group")).scalar())
    if asin is not None:
        rows = rows.where(F.col("asin") != F.lit(asin))
    first = F.asc_nulls_last("score") if ascending else F.desc_nulls_last("score")
    ranked = _scored(rows).orderBy(first, F.asc_nulls_last("asin"), F.asc("id"))
    return ranked.select("asin", "title", "score").limit(int(DEFAULT_TOP_N if top_n is None else top_n))


# --- the forms of the running reference code: the request's own context rows, not other products ------------------


def context_in_catalogue(
    products: DataFrame, product_id, group: str | None = None, from_similars: bool = False, requested: str | None = None,
    stored=None,
) -> DataFrame:
    """The relevant-category rows of a request whose category the catalogue has, with ``score``. ``requested`` adds one
    row that holds that category only (all else null, so it scores null)."""
    context = relevant_categories(products, product_id, group, from_similars)
    if requested is not None:
        asked = products.sparkSession.createDataFrame([(requested.strip(),)], "category string")
        context = context.unionByName(asked, allowMissingColumns=True)
    # the catalogue's rows of the context's own categories tell which of them it has
    have = _in_categories(products, context, stored).select("category").distinct()
    return _scored(context.join(have, "category", "left_semi"))


def context_recommendation(
    products: DataFrame, product_id, group: str | None = None, top_n: int = DEFAULT_TOP_N, from_similars: bool = False,
    requested: str | None = None, stored=None,
) -> DataFrame:
    """Top-n of the scored context rows (``requested``: with the requested category appended as a row)."""
    return top_scored(context_in_catalogue(products, product_id, group, from_similars, requested, stored), top_n)


def context_and_titles(
    products: DataFrame, product_id, group: str | None = None, top_n: int = DEFAULT_TOP_N, threshold: float = TITLE_THRESHOLD,
    from_similars: bool = False, stored=None,
) -> DataFrame:
    """Top-n of the context rows and the products with a similar title, the request's own row included."""
    cols = ["asin", "title", "score"]
    context = context_in_catalogue(products, product_id, group, from_similars, stored=stored).select(*cols)
    by_title = similar_titles(products, product_id, threshold, index=getattr(stored, "title_index", None))
    return top_scored(context.unionByName(_scored(by_title).select(*cols)), top_n)


def context_and_chosen(
    products: DataFrame, product_id, group: str, categories: list[str] | str, top_n: int = DEFAULT_TOP_N,
    from_similars: bool = False, stored=None,
) -> DataFrame:
    """Top-n of the context rows of ``group`` and the catalogue rows of each chosen category."""
    cols = ["asin", "title", "score"]
    chosen = [categories] if isinstance(categories, str) else list(categories)
    wanted = products.sparkSession.createDataFrame([(c.strip(),) for c in chosen], "category string")
    context = context_in_catalogue(products, product_id, group, from_similars, stored=stored).where(F.col("group") == F.lit(group))
    return top_scored(context.select(*cols).unionByName(_scored(_in_categories(products, wanted, stored)).select(*cols)), top_n)


def context_by_asin(products: DataFrame, product_id, group: str | None = None, categories: list[str] | str | None = None) -> DataFrame:
    """The product's and its similars' rows joined on asin to the relevant categories of the request (restricted to
    ``categories`` when given): ``asin, title, group, category``."""
    pid = _require_id(product_id)
    one = products.where(F.col("id") == F.lit(pid))
    asins = one.select("asin").unionByName(one.select(F.explode("similars").alias("asin"))).distinct()
    relevant = relevant_categories(products, pid, group).unionByName(
        relevant_categories(products, pid, group, from_similars=True) if group is not None else
        _similar_rows(products, one).select(*CONTEXT_COLUMNS)
    )
    return restrict_categories(relevant, categories).join(asins, "asin").select("asin", "title", "group", "category").distinct()


def _similar_rows(products: DataFrame, one: DataFrame) -> DataFrame:
    sims = one.select(F.explode("similars").alias("asin"))
    rows = products.join(sims, "asin", "left_semi")
    return rows.select(*CONTEXT_COLUMNS[:-1], F.explode("categories").alias("category"))


def recommend_all(products: DataFrame, top_n: int = DEFAULT_TOP_N) -> DataFrame:
    """For every product, the ``top_n`` other products sharing a category with it, best score first.

    ``id, rank, rec_id, rec_asin, rec_title, score``. Exact without pairing all products of a category: a
    product's i-th recommendation from category C ranks at most ``top_n + 1`` in C (only the product itself
    can rank above it without being recommended), so each category contributes its ``top_n + 1`` best rows
    (a per-category window limit, pre-limited in every map task), and each product ranks the few rows its
    categories contribute.
    """
    pc = _scored(product_categories(products)).select("id", "asin", "title", "category", "score")
    order = [F.desc_nulls_last("score"), F.asc_nulls_last("asin"), F.asc("id")]
    best = top_n_per_group(pc, ["category"], order, top_n + 1).select(
        "category", F.col("id").alias("rec_id"), F.col("asin").alias("rec_asin"),
        F.col("title").alias("rec_title"), F.col("score"),
    )
    # a category gives at most top_n + 1 candidates to each of its products; equal ones, of several categories, are
    # neighbours in the order, so they share a rank and only the ranked few are made distinct
    held = pc.select("id", "category")
    n = partitions_for(products.sparkSession, held.count() * (top_n + 1))
    # the few best are the side that is hashed; no join broadcasts ``held`` and makes its candidates in one task
    cands = held.join(best.hint("shuffle_hash"), "category").where(F.col("id") != F.col("rec_id"))
    cands = cands.select("id", "rec_id", "rec_asin", "rec_title", "score").repartition(n, "id")
    order = [F.desc_nulls_last("score"), F.asc_nulls_last("rec_asin"), F.asc("rec_id"), F.asc("rec_title")]
    few = cands.withColumn("rank", F.dense_rank().over(Window.partitionBy("id").orderBy(*order))).where(F.col("rank") <= top_n)
    ranked = few.distinct()
    return ranked.select("id", "rank", "rec_id", "rec_asin", "rec_title", "score")


def popularity_scores(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """``id, helpful_percentage, popularity_percentage, popularity_score`` per product:
    average review helpfulness × average rating × ``salesrank * 100 / max(salesrank)``.

    Helpfulness is aggregated per product (map-side combined) before the join; the maximum sales rank is a
    scalar subquery.
    """
    helpful = helpfulness(reviews).groupBy("id").agg(F.avg("helpful_percentage").alias("helpful_percentage"))
    top = products.agg(F.max("salesrank")).scalar()
    p = products.select("id", "salesrank", "avg_rating")
    p = p.withColumn("popularity_percentage", F.try_divide(F.col("salesrank") * F.lit(100.0), top))
    out = p.join(helpful, "id", "left")
    return out.select(
        "id", "helpful_percentage", "popularity_percentage",
        (F.col("helpful_percentage") * F.col("avg_rating") * F.col("popularity_percentage")).alias("popularity_score"),
    )
