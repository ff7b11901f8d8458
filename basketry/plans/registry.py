"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator of the inventory.

Each builds the catalogue from the order tables of ``sf_dir`` (so its work grows with them) and returns
flat columns: arrays are joined into strings and doubles rounded, so results compare by value with the
DuckDB SQL in ``plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions import fields
from basketry.functions.scores import product_score, with_normalised_score
from basketry.operators import catalog as C
from basketry.operators import explore as X
from basketry.operators import graph as G
from basketry.operators import recommend as R
from basketry.operators import similarity as S
from basketry.operators import sketches as K
from basketry.operators.profile import DEFAULT_COLUMNS, profile
from basketry.plans import params as P
from basketry.plans.store import StoredCatalog, stored_catalog
from basketry.session import ensure_checkpoint_dir
from basketry.sources import dump, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def rnd(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, P.DIGITS).alias(name or (c if isinstance(c, str) else "value"))


def joined(c: str, name: str | None = None) -> Column:
    return F.array_join(F.col(c), ",").alias(name or c)


def cat(spark: SparkSession, sf_dir: str) -> StoredCatalog:
    """The stored catalogue of ``sf_dir`` (each table built from the order tables on first use)."""
    return stored_catalog(spark, sf_dir)


def flat_products(p: DataFrame) -> DataFrame:
    return p.select(
        "id", "asin", "title", "group", "salesrank", "total_reviews", rnd("avg_rating"),
        joined("similars"), joined("categories"),
        *[f"category_{i}" for i in range(1, fields.N_CATEGORY_COLUMNS + 1)],
    )


SCALAR_PRODUCT_COLUMNS = ["id", "asin", "title", "group", "salesrank", "total_reviews", "avg_rating"]


def top_out(df: DataFrame) -> DataFrame:
    return df.select("asin", "title", rnd("score"))


# --- catalogue and readers -------------------------------------------------------------------------


@query("products")
def q_products(spark, d):
    return flat_products(cat(spark, d).products)


@query("catalog_build")
def q_catalog_build(spark, d):
    """The catalogue built straight from the order tables (what the store writes once)."""
    return flat_products(C.from_tables(spark, d).products)


@query("reviews")
def q_reviews(spark, d):
    return cat(spark, d).reviews


@query("copurchase_edges")
def q_edges(spark, d):
    return cat(spark, d).edges


@query("product_categories")
def q_product_categories(spark, d):
    pc = C.product_categories(cat(spark, d).products)
    return pc.select("id", "asin", "title", "group", "salesrank", "total_reviews", rnd("avg_rating"), "category")


def header_lines(products: DataFrame) -> Column:
    """The header lines of each product's dump record; a missing field has no line (a missing rank is -1)."""
    def line(label: str, c: Column) -> Column:
        return F.concat(F.lit(label), c)

    total = F.col("total_reviews").cast("string")
    rating = F.coalesce(F.concat(F.lit("  avg rating: "), F.col("avg_rating").cast("string")), F.lit(""))
    lines = F.array(
        line("Id:   ", F.col("id").cast("string")),
        line("ASIN: ", F.col("asin")),
        line("  title: ", F.col("title")),
        line("  group: ", F.col("group")),
        line("  salesrank: ", F.coalesce(F.col("salesrank").cast("bigint").cast("string"), F.lit("-1"))),
        F.concat(F.lit("  similar: "), F.size("similars").cast("string"),
                 F.concat_ws("", F.transform("similars", lambda s: F.concat(F.lit("  "), s)))),
        line("  categories: ", F.size("categories").cast("string")),
    )
    paths = F.transform("categories", lambda c: F.concat(F.lit("   "), c))
    reviews = F.concat(F.lit("  reviews: total: "), total, F.lit("  downloaded: "), total, rating)
    return F.filter(F.concat(lines, paths, F.array(reviews)), lambda x: x.isNotNull())


def product_records(products: DataFrame) -> DataFrame:
    """Product rows written back as dump records (header lines, no review lines)."""
    return products.select(F.array_join(header_lines(products), "\r\n").alias("value"))


def review_line() -> Column:
    return F.concat(
        F.lit("    "), F.date_format("date", "yyyy-M-d"), F.lit("  cutomer: "), F.col("customer"),
        F.lit("  rating: "), F.col("rating").cast("string"), F.lit("  votes: "), F.lpad(F.col("votes").cast("string"), 3, " "),
        F.lit("  helpful: "), F.lpad(F.col("helpful").cast("string"), 3, " "),
    )


def review_records(reviews: DataFrame) -> DataFrame:
    """One dump record per review (a record may hold any number of review lines)."""
    return reviews.select(
        F.concat_ws("\n", F.concat(F.lit("Id:   "), F.col("id").cast("string")), F.lit("ASIN: x"),
                    F.lit("  reviews: total: 1  downloaded: 1  avg rating: 1"), review_line()).alias("value")
    )


def write_dump(products: DataFrame, reviews: DataFrame, path: str) -> None:
    """A dump text with header and review lines, written line by line: a record's lines lie together in one file
    (ranges of ids), in order, and no record is ever one row before it is read."""
    header = products.select("id", F.posexplode(header_lines(products)).alias("at", "value"))
    known = reviews.join(products.select("id"), "id", "left_semi")
    rows = header.unionByName(known.withColumn("at", F.lit(1 << 30)), allowMissingColumns=True)
    # the reviews are moved as their fields and become lines where they are written
    lines = rows.repartitionByRange("id").sortWithinPartitions("id", "at")
    lines.select(F.coalesce("value", review_line()).alias("value")).write.text(path)


@query("parse_products")
def q_parse_products(spark, d):
    records = dump.clean_records(product_records(cat(spark, d).products))
    return flat_products(dump.parse_products(records))


@query("parse_reviews")
def q_parse_reviews(spark, d):
    return dump.parse_reviews(dump.clean_records(review_records(cat(spark, d).reviews)))


def scratch_path(spark: SparkSession, d: str, name: str) -> str:
    """A fresh folder beside the stored catalogue (shared on a cluster, deleted with it)."""
    import uuid

    return f"{cat(spark, d).path}/{name}-{uuid.uuid4().hex}"


@query("parse_products_file")
def q_parse_products_file(spark, d):
    """Products written as a dump text file (one record per product) and read back by the record scan."""
    path = scratch_path(spark, d, "dump")
    product_records(cat(spark, d).products).write.text(path)
    return flat_products(dump.read_products(spark, path))


@query("full_dump_products")
def q_full_dump_products(spark, d):
    """Products of a dump text whose records hold header lines and all their reviews."""
    path = scratch_path(spark, d, "full-dump")
    write_dump(cat(spark, d).products, cat(spark, d).reviews, path)
    return flat_products(dump.read_products(spark, path))


@query("full_dump_reviews")
def q_full_dump_reviews(spark, d):
    """Reviews of the same dump, by the review reader."""
    path = scratch_path(spark, d, "full-dump")
    write_dump(cat(spark, d).products, cat(spark, d).reviews, path)
    return dump.read_reviews(spark, path)


@query("text_lines")
def q_text_lines(spark, d):
    """The line scan: lines of a dump text by their label (category and review lines have none)."""
    path = scratch_path(spark, d, "full-dump")
    write_dump(cat(spark, d).products, cat(spark, d).reviews, path)
    label = F.regexp_extract("value", r"^\s*(\w+):", 1)
    return dump.read_text(spark, path).groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("lines"))


@query("edge_list_file")
def q_edge_list_file(spark, d):
    """Every order's part pairs written as a tab-separated edge list (a pair once per order, even orders turned
    round, so pairs repeat and both directions occur), read back and folded into weighted undirected edges."""
    path = scratch_path(spark, d, "edges")
    pairs = C.order_pairs(cat(spark, d).inputs["lineitem"])
    src, dst = (F.when(F.col("order") % 2 == 0, F.col(x)).otherwise(F.col(y)) for x, y in (("a", "b"), ("b", "a")))
    pairs.select(F.concat_ws("\t", src.cast("string"), dst.cast("string"))).write.text(path)
    return dump.undirected_edges(dump.read_edge_list(spark, path))


@query("adjacency")
def q_adjacency(spark, d):
    return C.adjacency(cat(spark, d).edges, directed=False)


@query("reviews_nested")
def q_reviews_nested(spark, d):
    return C.reviews_nested(cat(spark, d).reviews)


@query("graph_rows")
def q_graph_rows(spark, d):
    c = cat(spark, d)
    edges = c.edges  # first, so that the products' similars come from them
    # rounded once a product, not once for each of its rows
    rows = C.graph_rows(c.products.withColumn("avg_rating", rnd("avg_rating")), edges)
    return rows.select("id", "asin", "title", "group", "salesrank", "total_reviews", "avg_rating", "to", "similar", "category")


# --- exploration ------------------------------------------------------------------------------------


@query("group_count")
def q_group_count(spark, d):
    return X.group_by_count(cat(spark, d).products, "group", "id")


@query("group_rows")
def q_group_rows(spark, d):
    return X.row_count_by(cat(spark, d).products, "group")


@query("category_counts")
def q_category_counts(spark, d):
    return X.category_counts(cat(spark, d).products)


@query("correlation")
def q_correlation(spark, d):
    c = X.correlation(cat(spark, d).products)
    return c.select(rnd("salesrank_avg_rating_corr"), rnd("total_reviews_avg_rating_corr"))


@query("null_rates")
def q_null_rates(spark, d):
    return X.null_rates(cat(spark, d).reviews).select("column", "null_count", "total", rnd("null_rate"))


@query("null_rates_products")
def q_null_rates_products(spark, d):
    p = cat(spark, d).products.select(*SCALAR_PRODUCT_COLUMNS)
    return X.null_rates(p).select("column", "null_count", "total", rnd("null_rate"))


@query("untitled_products")
def q_untitled(spark, d):
    return X.is_null(cat(spark, d).products, "title").select("id", "asin", "group")


@query("rated_products")
def q_rated(spark, d):
    return X.not_null(cat(spark, d).products, "avg_rating").select("id", rnd("avg_rating"))


@query("helpfulness")
def q_helpfulness(spark, d):
    return X.helpfulness(cat(spark, d).reviews)


@query("misleading_share")
def q_misleading(spark, d):
    m = X.misleading_share(cat(spark, d).reviews)
    return m.select(rnd("avg_helpful_percentage"), rnd("misleading_percentage"))


@query("most_frequent_group_month")
def q_mfg_month(spark, d):
    c = cat(spark, d)
    return X.most_frequent_group(c.products, c.reviews, month=P.MONTH)


@query("most_frequent_group_year")
def q_mfg_year(spark, d):
    c = cat(spark, d)
    return X.most_frequent_group(c.products, c.reviews, year=P.YEAR)


@query("most_frequent_group_all")
def q_mfg_all(spark, d):
    return X.most_frequent_group(cat(spark, d).products)


@query("most_frequent_group_per_month")
def q_mfg_per_month(spark, d):
    c = cat(spark, d)
    return X.most_frequent_group_per_period(c.products, c.reviews, "month")


@query("most_frequent_group_per_year")
def q_mfg_per_year(spark, d):
    c = cat(spark, d)
    return X.most_frequent_group_per_period(c.products, c.reviews, "year")


@query("most_frequent_groups")
def q_most_frequent_groups(spark, d):
    c = cat(spark, d)
    return X.most_frequent_groups(c.products, c.reviews)


@query("sort_by_salesrank")
def q_sort_by_salesrank(spark, d):
    s = X.sort_by_salesrank(cat(spark, d).products, P.GROUP)
    return s.select("id", "asin", "title", "group", "salesrank", "total_reviews", rnd("avg_rating"))


@query("histogram_salesrank")
def q_hist_salesrank(spark, d):
    h = X.histogram(cat(spark, d).products, "salesrank", 30)
    return h.select("bucket", rnd("lower"), rnd("upper"), "count")


@query("histogram_group")
def q_hist_group(spark, d):
    return X.histogram(cat(spark, d).products, "group", 30)


@query("title_set")
def q_title_set(spark, d):
    return X.title_set(cat(spark, d).products, P.PRODUCT_ID).select(joined("titles"))


@query("distinct_titles")
def q_distinct_titles(spark, d):
    return X.distinct_titles(cat(spark, d).products)


@query("sample_size")
def q_sample_size(spark, d):
    p = cat(spark, d).products.select(*SCALAR_PRODUCT_COLUMNS)
    return X.sample_size(p, 0.1, seed=7)


@query("sample_rows")
def q_sample_rows(spark, d):
    return X.sample(cat(spark, d).reviews, 0.1, seed=7)


@query("drop_null_rows")
def q_drop_null_rows(spark, d):
    p = cat(spark, d).products.select("id", "salesrank", "avg_rating")
    return X.drop_null_rows(p).select("id", "salesrank", rnd("avg_rating"))


# --- profile ---------------------------------------------------------------------------------------


def _profile_flat(spark, d, sample_fraction):
    prof = profile(cat(spark, d).products, sample_fraction=sample_fraction)
    top = F.array_join(
        F.transform("most_freq_values_top_10", lambda s: F.concat(F.coalesce(s["value"], F.lit("null")), F.lit(":"),
                                                                   s["count"].cast("string"))), ",")
    cols = [
        "col_name", "data_type", "count", "col_sparsity", "distinct_count", "fill_rate", "distinct_count_",
        top.alias("most_freq_values_top_10"), "dataset_size", rnd("mean"), rnd("stddev"), "min", "q1", "q2", "q3",
        "max",
    ]
    if sample_fraction is not None:
        cols.insert(9, "sample_size")
    return prof.select(*cols)


@query("profile_stats")
def q_profile_stats(spark, d):
    return _profile_flat(spark, d, None)


@query("profile")
def q_profile(spark, d):
    return _profile_flat(spark, d, 0.1)


@query("profile_sink")
def q_profile_sink(spark, d):
    """The profile written by its sink and read back."""
    path = scratch_path(spark, d, "profile")
    sinks.write_profile(_profile_flat(spark, d, None), path)
    return spark.read.parquet(path)


@query("heavy_hitters")
def q_heavy_hitters(spark, d):
    ensure_checkpoint_dir(spark)
    top = K.heavy_hitters(cat(spark, d).products, DEFAULT_COLUMNS)
    pairs = F.transform("most_freq_values_top_10", lambda s: F.concat(F.coalesce(s["value"], F.lit("null")), F.lit(":"), s["count"].cast("string")))
    return top.select("col_name", F.array_join(pairs, ",").alias("most_freq_values_top_10"))


@query("quantile_sketch")
def q_quantile_sketch(spark, d):
    """Sketches of each year's orders and each return flag's line items, merged; how far the quartiles are off, exactly."""
    tables = C.load_tables(spark, d, "orders", "lineitem")
    parts = [(tables["orders"].withColumn("part", F.year("o_orderdate")), "o_totalprice"), (tables["lineitem"].withColumn("part", F.col("l_returnflag")), "l_extendedprice")]
    out = None
    for rows, column in parts:
        found = K.merged_quantiles(K.quantile_sketches(rows, [column], by=["part"]))
        one = K.rank_errors(rows, found).select("col_name", "q", "n", (F.col("rank_error") <= 0.01).alias("within_bound"))
        out = one if out is None else out.unionByName(one)
    return out


# --- scores and recommenders -----------------------------------------------------------------------


@query("product_score")
def q_product_score(spark, d):
    p = cat(spark, d).products
    return p.select("id", "asin", rnd(product_score(), "score"))


@query("normalised_score")
def q_normalised_score(spark, d):
    p = with_normalised_score(cat(spark, d).products.select("id", "salesrank", "total_reviews", "avg_rating"))
    return p.select("id", rnd("score"))


@query("popularity_score")
def q_popularity(spark, d):
    c = cat(spark, d)
    return R.popularity_scores(c.products, c.reviews).select("id", rnd("helpful_percentage"),
                                                             rnd("popularity_percentage"), rnd("popularity_score"))


@query("product_context_row")
def q_context_row(spark, d):
    row = C.product_context(cat(spark, d).products, P.PRODUCT_ID)[0]
    return row.select("id", "asin", "title", "group", joined("similars"), joined("categories"))


@query("product_context_similars")
def q_context_similars(spark, d):
    return C.product_context(cat(spark, d).products, P.PRODUCT_ID)[1]


@query("product_context_categories")
def q_context_categories(spark, d):
    return C.product_context(cat(spark, d).products, P.PRODUCT_ID)[2]


@query("relevant_categories")
def q_relevant(spark, d):
    r = R.relevant_categories(cat(spark, d).products, P.PRODUCT_ID)
    return r.select("id", "asin", "title", "salesrank", "total_reviews", rnd("avg_rating"), "group", "category")


@query("relevant_categories_group")
def q_relevant_group(spark, d):
    r = R.relevant_categories(cat(spark, d).products, P.PRODUCT_ID, P.GROUP)
    return r.select("id", "asin", "title", "salesrank", "total_reviews", rnd("avg_rating"), "group", "category")


@query("relevant_categories_similars")
def q_relevant_similars(spark, d):
    c = cat(spark, d)
    r = R.relevant_categories(c.products, P.PRODUCT_ID, P.SIMILARS_GROUP, from_similars=True)
    return r.select("id", "asin", "title", "salesrank", "total_reviews", rnd("avg_rating"), "group", "category")


@query("recommend_by_category")
def q_rec_category(spark, d):
    c = cat(spark, d)
    return top_out(R.recommend_by_category(c.products, P.PRODUCT_ID, None, None, P.TOP_N, stored=c))


@query("recommend_restricted")
def q_rec_restricted(spark, d):
    c = cat(spark, d)
    return top_out(R.recommend_by_category(c.products, P.PRODUCT_ID, None, [P.CATEGORY.lower()], P.TOP_N,
                                           stored=c))


@query("recommend_with_chosen_categories")
def q_rec_chosen(spark, d):
    c = cat(spark, d)
    return top_out(R.recommend_with_chosen_categories(c.products, P.PRODUCT_ID, P.GROUP, P.CHOSEN_CATEGORIES,
                                                      P.TOP_N, stored=c))


@query("recommend_by_category_and_title")
def q_rec_title(spark, d):
    c = cat(spark, d)
    return top_out(R.recommend_by_category_and_title(c.products, P.PRODUCT_ID, None, None, P.TOP_N, P.THRESHOLD,
                                                     stored=c))


@query("recommend_with_requested_category")
def q_rec_requested(spark, d):
    c = cat(spark, d)
    return top_out(R.recommend_with_requested_category(c.products, P.PRODUCT_ID, None, P.REQUESTED_CATEGORY,
                                                       P.TOP_N, stored=c))


@query("similar_products")
def q_similar_products(spark, d):
    return R.similar_products(cat(spark, d).products, P.PRODUCT_ID)


@query("recommend_filters_all")
def q_rec_filters_all(spark, d):
    c = cat(spark, d)
    return top_out(R.recommend(c.products, P.ASIN, P.GROUP, P.CATEGORY_SUBSTRING, P.TOP_N, stored=c))


@query("recommend_filters_category")
def q_rec_filters_category(spark, d):
    c = cat(spark, d)
    return top_out(R.recommend(c.products, None, None, f"   {P.CATEGORY_SUBSTRING} ", 10, stored=c))


@query("recommend_filters_group")
def q_rec_filters_group(spark, d):
    return top_out(R.recommend(cat(spark, d).products, P.ASIN, P.GROUP, None, None))


@query("recommend_filters_asin")
def q_rec_filters_asin(spark, d):
    return top_out(R.recommend(cat(spark, d).products, P.ASIN, None, None, 7))


@query("recommend_filters_none")
def q_rec_filters_none(spark, d):
    return top_out(R.recommend(cat(spark, d).products, None, None, None, None))


@query("recommend_ascending")
def q_rec_ascending(spark, d):
    return top_out(R.recommend(cat(spark, d).products, None, P.GROUP, None, 6, ascending=True))


@query("context_recommendation")
def q_context_rec(spark, d):
    c = cat(spark, d)
    return top_out(R.context_recommendation(c.products, P.PRODUCT_ID, P.SIMILARS_GROUP, P.TOP_N, from_similars=True, stored=c))


@query("context_requested")
def q_context_requested(spark, d):
    c = cat(spark, d)
    return top_out(R.context_recommendation(c.products, P.PRODUCT_ID, None, P.TOP_N, requested=f"   {P.REQUESTED_CATEGORY}", stored=c))


@query("context_and_titles")
def q_context_titles(spark, d):
    c = cat(spark, d)
    return top_out(R.context_and_titles(c.products, P.PRODUCT_ID, None, P.TOP_N, P.THRESHOLD, stored=c))


@query("context_and_chosen")
def q_context_chosen(spark, d):
    c = cat(spark, d)
    return top_out(R.context_and_chosen(c.products, P.PRODUCT_ID, P.GROUP, [f"   {x}" for x in P.CHOSEN_CATEGORIES], P.TOP_N, stored=c))


@query("context_by_asin")
def q_context_by_asin(spark, d):
    return R.context_by_asin(cat(spark, d).products, P.PRODUCT_ID)


@query("recommend_all")
def q_rec_all(spark, d):
    r = R.recommend_all(cat(spark, d).products, P.TOP_N)
    return r.select("id", "rank", "rec_id", "rec_asin", "rec_title", rnd("score"))


@query("recommendations_json")
def q_json(spark, d):
    r = R.recommend(cat(spark, d).products, P.ASIN, P.GROUP, None, P.TOP_N)
    return sinks.to_json_rows(top_out(r))


@query("recommendations_response")
def q_response(spark, d):
    r = R.recommend(cat(spark, d).products, P.ASIN, P.GROUP, None, P.TOP_N)
    return sinks.response_rows(top_out(r))


@query("recommendations_json_file")
def q_json_file(spark, d):
    """Recommendations written as JSON lines by the sink and read back."""
    rows, path = top_out(R.recommend(cat(spark, d).products, P.ASIN, P.GROUP, None, P.TOP_N)), scratch_path(spark, d, "json")
    sinks.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


# --- similarity -------------------------------------------------------------------------------------


@query("title_matches")
def q_title_matches(spark, d):
    c = cat(spark, d)
    m = S.title_matches(c.products, P.PRODUCT_ID, P.THRESHOLD, index=c.title_index)
    return m.select("id", "asin", "title", "group", rnd("similarity"), "category")


@query("title_matches_ngram")
def q_title_matches_ngram(spark, d):
    c = cat(spark, d)
    m = S.title_matches(c.products, P.PRODUCT_ID, 0.5, ngram=P.NGRAM, index=c.title_grams)
    return m.select("id", "asin", "title", "group", rnd("similarity"), "category")


@query("pooled_similarity")
def q_pooled(spark, d):
    return S.pooled_similarity(cat(spark, d).products).select("id", "asin", "n_sets", rnd("pooled_jaccard"))


@query("similar_title_pairs")
def q_title_pairs(spark, d):
    return S.similar_title_pairs(cat(spark, d).products, P.THRESHOLD).select("title_a", "title_b", rnd("similarity"))


@query("similar_title_pairs_banded")
def q_title_pairs_banded(spark, d):
    pairs = S.similar_title_pairs_banded(cat(spark, d).products, P.THRESHOLD)
    return pairs.select("title_a", "title_b", rnd("similarity"))


# --- graph ------------------------------------------------------------------------------------------


def graph(spark, d):
    """The stored property graph (built once with the catalogue)."""
    c = cat(spark, d)
    return c, c.graph_vertices, c.graph_edges


@query("graph_vertices")
def q_vertices(spark, d):
    v = G.vertices(cat(spark, d).products)  # the builder itself (the stored graph is its output)
    return v.select("id", "kind", "asin", "title", "group", "salesrank", rnd("avg_rating"))


@query("graph_edges")
def q_graph_edges(spark, d):
    c = cat(spark, d)
    return G.edges(c.products, c.edges)


@query("graph_sink_vertices")
def q_sink_vertices(spark, d):
    """What the graph sink wrote, read back."""
    v = cat(spark, d).graph_vertices
    return v.select("id", "kind", "asin", "title", "group", "salesrank", rnd("avg_rating"))


@query("graph_sink_edges")
def q_sink_edges(spark, d):
    return cat(spark, d).graph_edges.select("src", "dst", "label")


@query("graph_undirected")
def q_undirected(spark, d):
    return G.distinct_undirected(cat(spark, d).graph_edges.select("src", "dst", "label"))


@query("reach_within_recursive")
def q_reach_within(spark, d):
    return G.reach_within(cat(spark, d).edges, P.PRODUCT_ID, P.REACH_DEPTH)


@query("bfs_copurchase")
def q_bfs(spark, d):
    ensure_checkpoint_dir(spark)
    return G.product_bfs(cat(spark, d).neighbours, P.PRODUCT_ID)


@query("bfs_to_group")
def q_bfs_to_group(spark, d):
    ensure_checkpoint_dir(spark)
    c = cat(spark, d)
    r = G.bfs_to_group(c.graph_vertices, c.graph_neighbours, P.ASIN, "LARGE")
    return r.select("id", "depth", "asin", "title", "salesrank", rnd("avg_rating"))


@query("reachable_all_labels")
def q_reachable(spark, d):
    ensure_checkpoint_dir(spark)
    c = cat(spark, d)
    r = G.reachable_products(c.graph_vertices, c.graph_neighbours, P.ASIN)
    return r.select("asin", "title", "group", "depth", "salesrank", rnd("avg_rating"))


@query("path_top_n")
def q_path(spark, d):
    _, v, e = graph(spark, d)
    r = G.path_top_n(v, e, P.ASIN, P.PATH_GROUP, f"   {P.PATH_CATEGORY}", P.TOP_N)
    return r.select("asin", "title", "group", "salesrank", rnd("avg_rating"))
