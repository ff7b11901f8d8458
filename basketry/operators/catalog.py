"""Typed product, review and co-purchase edge tables, and the long views derived from them.

Two ways in: parse a product dump (``basketry.sources.dump``) or map the order tables (``from_tables``).
Both give the same schemas:

* products: ``id bigint, asin string, title string, group string, salesrank double, total_reviews bigint,
  avg_rating double, similars array<string>, categories array<string>, category_1..category_6 string``
* reviews: ``id bigint, date date, customer string, rating int, votes int, helpful int``
* edges: ``src bigint, dst bigint, weight bigint`` with ``src < dst`` (undirected, one row per pair)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.functions import fields
from basketry.functions.ranking import dense_rank_values, partitions_for, running_totals, top_n_per_group
from basketry.session import require_checkpoint_dir

PRODUCT_COLUMNS = [
    "id", "asin", "title", "group", "salesrank", "total_reviews", "avg_rating", "similars", "categories",
] + [f"category_{i}" for i in range(1, fields.N_CATEGORY_COLUMNS + 1)]
REVIEW_COLUMNS = ["id", "date", "customer", "rating", "votes", "helpful"]

# Fixed values of the order-table mapping: asin width, review rating and vote rules, similars per product.
ASIN_WIDTH = 10
RATING_LEVELS = 5
VOTE_LEVELS = 7
SIMILARS_PER_PRODUCT = 5
SIZE_BAND = 10

# The parts (key modulo the first number = the second) that the mapping gives a missing or odd value,
# so that nulls, empty lists, long category lists, absent products and rating words in titles occur in every table.
ODD_PARTS = {
    "title": (97, 13), "salesrank": (89, 7), "avg_rating": (83, 5), "categories": (79, 11), "similars": (73, 3),
    "many_categories": (71, 9), "asin": (103, 19), "product": (101, 17), "rating_title": (107, 23),
    "zero_rank": (109, 29),
}
MANY_EXTRA = 5


def _odd(case: str) -> F.Column:
    modulus, rest = ODD_PARTS[case]
    return F.pmod(F.col("p_partkey"), F.lit(modulus)) == F.lit(rest)


@dataclass
class Catalog:
    products: DataFrame
    reviews: DataFrame
    edges: DataFrame
    # catalogue x category, partitioned by ``cat_bucket`` (stored catalogues only; see ``category_bucket``)
    categories: DataFrame | None = None
    category_buckets: int = 1
    # the property graph (stored catalogues only): vertices, and edges partitioned by label
    graph_vertices: DataFrame | None = None
    graph_edges: DataFrame | None = None


def asin_of(key) -> F.Column:
    return F.lpad(key.cast("string"), ASIN_WIDTH, "0")


def reviews_from_tables(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """One review per line item: dated by its order, written by the order's customer."""
    li = lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    o = orders.select("o_orderkey", "o_custkey", "o_orderdate")
    votes = (F.col("l_quantity").cast("bigint") % VOTE_LEVELS).cast("int")
    return li.join(o, li.l_orderkey == o.o_orderkey, "left").select(
        F.col("l_partkey").alias("id"),
        F.to_date("o_orderdate").alias("date"),
        F.col("o_custkey").cast("string").alias("customer"),
        (F.lit(1) + (F.col("l_orderkey") + F.col("l_linenumber")) % RATING_LEVELS).cast("int").alias("rating"),
        votes.alias("votes"),
        F.least(votes, F.col("l_linenumber")).cast("int").alias("helpful"),
    )


#: Parts of one order paired as one block; a larger order is a grid of blocks.
ORDER_BLOCK = 1000


@dataclass(frozen=True)
class OrderSizes:
    """How much there is to pair: the lines, the pairs they make at most, the orders of more than a block (None: none)."""

    lines: int
    pairs: int
    large: DataFrame | None


def _lines(lineitem: DataFrame) -> DataFrame:
    lines = lineitem.where(F.col("l_orderkey").isNotNull() & F.col("l_partkey").isNotNull())
    return lines.select(F.col("l_orderkey").alias("_o"), F.col("l_partkey").alias("_p"))


def order_sizes(lineitem: DataFrame, block: int = ORDER_BLOCK) -> OrderSizes:
    n = F.col("_n")
    counts = _lines(lineitem).groupBy("_o").agg(F.count(F.lit(1)).alias("_n"))
    pairs = F.sum((n * (n - 1) / 2).cast("bigint"))
    lines, pairs, large = counts.agg(F.sum(n), pairs, F.count_if(n > block)).first()
    return OrderSizes(lines or 0, pairs or 0, counts.where(n > block) if large else None)


def order_pairs(lineitem: DataFrame, block: int = ORDER_BLOCK, sizes: OrderSizes | None = None) -> DataFrame:
    """``order, a, b``: every two different parts of each order (``a < b``), once.

    Lines are shuffled once, by order, into as many tasks as their count asks: an order's distinct parts become one sorted
    array, and its pairs are made inside the row, without a join. That holds for orders of at most ``block`` lines; larger
    ones, found by a count, are cut into blocks of parts by a hash, and their pairs are made per cell of the grid (block,
    block), so no row holds and no task pairs more than a block with a block. Nothing is dropped.
    """
    sizes = sizes or order_sizes(lineitem, block)
    lines, large = _lines(lineitem), sizes.large
    n = partitions_for(lineitem.sparkSession, sizes.lines)
    if large is None:
        return _pairs_in_rows(lines, n)
    ids = large.select("_o")
    return _pairs_in_rows(lines.join(ids, "_o", "left_anti"), n).unionByName(_pairs_in_grid(lines.join(large, "_o").distinct(), block))


def _pairs_in_rows(lines: DataFrame, n: int) -> DataFrame:
    orders = lines.repartition(n, "_o").groupBy("_o").agg(F.array_sort(F.collect_set("_p")).alias("_ps"))
    firsts = orders.where(F.size("_ps") > 1).select(F.col("_o").alias("order"), "_ps", F.posexplode("_ps").alias("_i", "a"))
    return firsts.select("order", "a", F.explode(F.slice("_ps", F.col("_i") + 2, F.size("_ps"))).alias("b"))


def _pairs_in_grid(items: DataFrame, block: int) -> DataFrame:
    """Pairs of the distinct parts ``_p`` of orders ``_o`` with ``_n`` lines."""
    items = items.withColumn("_k", F.ceil(F.col("_n") / F.lit(block)).cast("int"))
    items = items.withColumn("_b", F.pmod(F.xxhash64("_p"), F.col("_k")).cast("int"))
    one = items.select("_o", F.col("_p").alias("_a"), F.col("_b").alias("_x"), F.explode(F.sequence(F.col("_b"), F.col("_k") - 1)).alias("_y"))
    two = items.select("_o", F.col("_p").alias("_c"), F.col("_b").alias("_y"), F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_x"))
    pairs = one.join(two, ["_o", "_x", "_y"]).where((F.col("_x") < F.col("_y")) | (F.col("_a") < F.col("_c")))
    return pairs.select(F.col("_o").alias("order"), F.least("_a", "_c").alias("a"), F.greatest("_a", "_c").alias("b"))


def copurchase_edges(lineitem: DataFrame, block: int = ORDER_BLOCK) -> DataFrame:
    """Undirected weighted co-purchase edges: two parts of one order; the weight counts orders (``order_pairs``).

    Most pairs occur once, so they are dealt by their parts before they are counted, into as many tasks as there are pairs
    to hold: combining them per map task first would hold a task's pairs in memory and merge few.
    """
    sizes = order_sizes(lineitem, block)
    pairs = order_pairs(lineitem, block, sizes).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    dealt = pairs.repartition(partitions_for(lineitem.sparkSession, sizes.pairs), "src", "dst")
    return dealt.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def neighbours(edges: DataFrame) -> DataFrame:
    """Both directions of every undirected edge: ``node, nbr, weight`` (one pass over ``edges``: a union
    of the two directions would compute the edge table twice)."""
    both = F.array(
        F.struct(F.col("src").alias("node"), F.col("dst").alias("nbr")),
        F.struct(F.col("dst").alias("node"), F.col("src").alias("nbr")),
    )
    return edges.select(F.explode(both).alias("_d"), "weight").select("_d.node", "_d.nbr", "weight")


#: Line items of one part whose partners are counted and ranked in one task; a part with more is dealt to several.
HUB_LINES = 200_000


def similars_from_lines(lineitem: DataFrame, stats: DataFrame, n: int = SIMILARS_PER_PRODUCT, hub_lines: int = HUB_LINES) -> DataFrame:
    """``id, similars``: the n most co-purchased partners of each product (by the edges' weight desc, then id).

    Both directions of every pair (``order_pairs``) are dealt by their product, into as many tasks as there are pairs to
    hold; there they are counted, ranked and gathered, without a stored edge and without another shuffle. ``stats``
    (``part_stats``) tells the hubs: their partners are dealt to several tasks by a hash, and only the n best of each meet.
    """
    sizes = order_sizes(lineitem)
    pairs = neighbours(order_pairs(lineitem, sizes=sizes).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1).alias("weight")))
    pairs, keys = _dealt_by_node(pairs.select("node", "nbr"), stats, 2 * sizes.pairs, hub_lines)
    return _best_partners(pairs.groupBy(*keys, "nbr").agg(F.count(F.lit(1)).alias("weight")), n)


def similars_from_edges(edges: DataFrame, stats: DataFrame, n: int = SIMILARS_PER_PRODUCT, hub_lines: int = HUB_LINES) -> DataFrame:
    """``similars_from_lines`` of edges that are stored already: their pairs are made and counted, so they are only dealt."""
    return _best_partners(_dealt_by_node(neighbours(edges), stats, 2 * edges.count(), hub_lines)[0], n)


def _dealt_by_node(pairs: DataFrame, stats: DataFrame, rows: int, hub_lines: int) -> tuple[DataFrame, list[str]]:
    """``pairs`` (``node, nbr`` ...) dealt by node, a hub's by a hash of the partner too; and the columns they are dealt by."""
    columns, keys = pairs.columns, ["node"]
    hubs = stats.where(F.col("total_reviews") > hub_lines)
    if not hubs.isEmpty():
        # at most one row per ``hub_lines`` line items
        salts = hubs.select(F.col("id").alias("node"), F.ceil(F.col("total_reviews") / F.lit(hub_lines)).cast("int").alias("_salts"))
        pairs = pairs.join(F.broadcast(salts), "node", "left")
        pairs = pairs.select(*columns, F.pmod(F.xxhash64("nbr"), F.coalesce("_salts", F.lit(1))).cast("int").alias("_salt"))
        keys = ["node", "_salt"]
    return pairs.repartition(partitions_for(pairs.sparkSession, rows), *keys), keys


def _best_partners(counted: DataFrame, n: int) -> DataFrame:
    top = top_n_per_group(counted, ["node"], [F.desc("weight"), F.asc("nbr")], n)
    return top.groupBy(F.col("node").alias("id")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "nbr"))), lambda s: asin_of(s["nbr"])
        ).alias("similars")
    )


def part_stats(lineitem: DataFrame) -> DataFrame:
    """Per part: quantity sold (``_qty``), review count and average rating (one map-side combined aggregate)."""
    return lineitem.groupBy(F.col("l_partkey").alias("id")).agg(
        F.sum("l_quantity").alias("_qty"),
        F.count(F.lit(1)).alias("total_reviews"),
        F.avg(F.lit(1) + (F.col("l_orderkey") + F.col("l_linenumber")) % RATING_LEVELS).alias("avg_rating"),
    )


def products_from_tables(
    part: DataFrame, lineitem: DataFrame, stats: DataFrame | None = None, similars: DataFrame | None = None
) -> DataFrame:
    """Product rows from parts: group = part type, two category paths, sales rank by quantity sold.

    ``stats`` (``part_stats``) may be given already stored: the rank and the similars read it too, and a stored copy
    keeps the line items from being aggregated more than once. So may ``similars`` (``similars_from_lines``): a sort by
    ranges reads its rows twice.
    """
    sold = part_stats(lineitem) if stats is None else stats
    ranks = dense_rank_values(sold, "_qty", "_rank")
    stats = sold.join(ranks, "_qty", "left")
    key = F.col("p_partkey")
    cats = F.array(
        F.concat(F.lit("|"), F.col("p_type"), F.lit("|"), F.col("p_brand")),
        F.concat(F.lit("|"), F.col("p_brand"), F.lit("|size_"), (F.col("p_size") / SIZE_BAND).cast("int").cast("string")),
    )
    many = F.concat(cats, F.transform(F.sequence(F.lit(1), F.lit(MANY_EXTRA)), lambda i: F.concat(F.lit("|extra|"), i.cast("string"))))
    none = F.array().cast("array<string>")
    title = F.when(_odd("rating_title"), F.concat(F.col("p_name"), F.lit(" avg rating: 1.5"))).when(~_odd("title"), F.col("p_name"))
    base = part.where(~_odd("product")).select(
        key.alias("id"),
        F.when(~_odd("asin"), asin_of(key)).alias("asin"),
        title.alias("title"),
        F.col("p_type").alias("group"),
        F.when(_odd("categories"), none).when(_odd("many_categories"), many).otherwise(cats).alias("categories"),
        _odd("salesrank").alias("_no_rank"), _odd("zero_rank").alias("_zero_rank"), _odd("avg_rating").alias("_no_rating"), _odd("similars").alias("_no_similars"),
    )
    out = (
        base.join(stats, "id", "left")
        .join(similars_from_lines(lineitem, sold) if similars is None else similars, "id", "left")
        .select(
            "id", "asin", "title", "group",
            F.when(F.col("_zero_rank"), F.lit(0.0)).when(~F.col("_no_rank"), F.col("_rank").cast("double")).alias("salesrank"),
            F.coalesce("total_reviews", F.lit(0)).alias("total_reviews"),
            F.when(~F.col("_no_rating"), F.col("avg_rating")).alias("avg_rating"),
            F.when(F.col("_no_similars"), none).otherwise(F.coalesce("similars", none)).alias("similars"),
            "categories",
        )
    )
    return out.select("*", *fields.category_columns(F.col("categories")))


def load_tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def from_tables(spark: SparkSession, sf_dir: str) -> Catalog:
    t = load_tables(spark, sf_dir, "part", "orders", "lineitem")
    edges = copurchase_edges(t["lineitem"])
    require_checkpoint_dir(spark)
    stats = part_stats(t["lineitem"]).checkpoint()  # the rank and the join read it; one row per part
    return Catalog(
        products=products_from_tables(t["part"], t["lineitem"], stats),
        reviews=reviews_from_tables(t["lineitem"], t["orders"]),
        edges=edges,
    )


# --- long views ---------------------------------------------------------------------------------


def product_categories(products: DataFrame) -> DataFrame:
    """Catalogue × category: one row per (product, category path).

    Product rows are unique by id, so deduplicating the categories inside each row gives distinct rows with
    no shuffle (a ``distinct()`` over the exploded catalogue would reshuffle it for every request).
    """
    return products.select(
        "id", "asin", "title", "group", "salesrank", "total_reviews", "avg_rating",
        F.explode(F.array_distinct("categories")).alias("category"),
    )


# Fixed value: rows per category bucket of the stored catalogue x category table.
ROWS_PER_BUCKET = 2_000_000


def buckets_for(n_rows: int) -> int:
    """Bucket count that grows with the table: one bucket per ``ROWS_PER_BUCKET`` rows."""
    return max(1, -(-int(n_rows) // ROWS_PER_BUCKET))


def category_bucket(category, buckets: int) -> F.Column:
    """Hash bucket of a category path: the partition column of the stored catalogue x category table, so a
    request that names a few categories reads only their buckets (dynamic partition pruning)."""
    c = F.col(category) if isinstance(category, str) else category
    return F.pmod(F.xxhash64(c), F.lit(int(buckets))).cast("int")


def bucketed_product_categories(products: DataFrame, buckets: int) -> DataFrame:
    """``product_categories`` plus its ``cat_bucket``."""
    pc = product_categories(products)
    return pc.withColumn("cat_bucket", category_bucket("category", buckets))


def product_similars(products: DataFrame) -> DataFrame:
    """One row per (product, similar asin)."""
    return products.select("id", "asin", "title", "group", F.explode("similars").alias("similar_asin"))


def product_context(products: DataFrame, product_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The row of one product, its similars exploded and its categories exploded."""
    one = products.where(F.col("id") == F.lit(int(product_id)))
    row = one.select("id", "asin", "title", "group", "similars", "categories")
    sims = one.select("id", "asin", "title", "group", F.explode("similars").alias("similar_asin"))
    cats = one.select("id", "asin", "title", "group", F.explode("categories").alias("category"))
    return row, sims, cats


def adjacency(edges: DataFrame, directed: bool = True, hub_edges: int | None = None) -> DataFrame:
    """``src, pos, dst``: each node's neighbours in order, one row each (``pos`` from 1). Rows, not arrays.

    The pairs are shuffled once, by node, into as many tasks as there are pairs to hold, and numbered there. Nodes of more
    than ``hub_edges`` pairs (by default a task's even share), found by a count, are numbered by the running count over
    ranges, so a hub's rows are spread over tasks.
    """
    pairs = edges.select("src", "dst") if directed else neighbours(edges).select(
        F.col("node").alias("src"), F.col("nbr").alias("dst")
    )
    degrees = pairs.groupBy("src").agg(F.count(F.lit(1)).alias("_n"))
    most, rows = degrees.agg(F.coalesce(F.max("_n"), F.lit(0)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    n = partitions_for(edges.sparkSession, rows)
    hub_edges = hub_edges or max(1, -(-rows // n))
    # at most one row per ``hub_edges`` pairs: by default no more than there are tasks
    hubs = F.broadcast(degrees.where(F.col("_n") > hub_edges).select("src")) if most > hub_edges else None
    rest = pairs if hubs is None else pairs.join(hubs, "src", "left_anti")
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.col("dst").asc())).cast("bigint")
    out = rest.repartition(n, "src").distinct().select("src", place.alias("pos"), "dst")
    if hubs is None:
        return out
    ones = pairs.join(hubs, "src", "left_semi").distinct().withColumn("_one", F.lit(1))
    placed = running_totals(ones, ["src"], [F.col("dst").asc()], "_one", "pos")
    return out.unionByName(placed.select("src", F.col("pos").cast("bigint").alias("pos"), "dst"))


def reviews_nested(reviews: DataFrame) -> DataFrame:
    """``id, pos, date, customer, rating, votes, helpful``: each product's reviews in order (by all fields), one row
    each; equal reviews are counted in ``times`` and stand at the first place they take."""
    same = reviews.groupBy(*REVIEW_COLUMNS).agg(F.count(F.lit(1)).alias("times"))
    order = [F.col(c).asc_nulls_first() for c in REVIEW_COLUMNS[1:]]
    placed = running_totals(same, ["id"], order, "times", "_upto")
    return placed.select("id", (F.col("_upto") - F.col("times") + 1).cast("bigint").alias("pos"), *REVIEW_COLUMNS[1:], "times")


#: Partners of one product whose rows are laid out in one task; a product with more has them joined where they lie.
HUB_PARTNERS = 750_000


def graph_rows(products: DataFrame, edges: DataFrame, hub_partners: int = HUB_PARTNERS) -> DataFrame:
    """Products right-joined to their co-purchase partners (nodes without a product row stay, with nulls), then one
    row per (product, partner, similar, category); an empty list keeps its row with a null. A verification view: it
    multiplies rows; the graph operators use the long tables instead.

    Products and pairs meet by node in as many tasks as there are pairs to hold, sorted, so that a product's rows lie together
    and pack well where they are written. Nodes of more than ``hub_partners`` pairs are not dealt: the few products they are
    of go to all tasks. They are found by a count of the pairs by a hash of their node, and of the nodes only where that many
    have one hash.
    """
    pairs = neighbours(edges).select(F.col("node").alias("_node"), F.col("nbr").alias("to"))
    flat = ["asin", "title", "group", "salesrank", "total_reviews", "avg_rating"]

    def held(c: str) -> F.Column:
        return F.when(F.size(c) > 0, F.col(c)).otherwise(F.array(F.lit(None).cast("string")))

    # each product's (similar, category) rows are laid out once, before the join repeats them for every partner
    both = F.flatten(F.transform(held("similars"), lambda s: F.transform(held("categories"), lambda c: F.struct(s.alias("similar"), c.alias("category")))))
    laid = products.select("id", *flat, both.alias("_both"))
    n, match = partitions_for(edges.sparkSession, 2 * edges.count()), F.col("id") == F.col("_node")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("_node"))
    ends = ends.withColumn("_hash", F.pmod(F.xxhash64("_node"), F.lit(4 * n)))
    crowded = ends.groupBy("_hash").count().where(F.col("count") > hub_partners).select("_hash")
    hubs = None
    if not crowded.isEmpty():
        # both at most one row per ``hub_partners`` pairs
        ends = ends.join(F.broadcast(crowded), "_hash").groupBy("_node").count()
        hubs = F.broadcast(ends.where(F.col("count") > hub_partners).select("_node"))
    rest = pairs if hubs is None else pairs.join(hubs, "_node", "left_anti")
    rows = laid.repartition(n, "id").hint("merge").join(rest.repartition(n, "_node"), match, "right")
    if hubs is not None:
        rows = rows.unionByName(F.broadcast(laid.join(hubs, match, "left_semi")).join(pairs.join(hubs, "_node", "left_semi"), match, "right"))
    rows = rows.select(F.col("_node").alias("id"), *flat, "to", F.explode_outer("_both").alias("_row"))
    return rows.select("id", *flat, "to", "_row.similar", "_row.category")
