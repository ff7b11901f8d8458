"""Property graph of products, groups and categories; labelled breadth-first search; path pattern query.

Vertices and edges are DataFrames (``vertices: id, kind, asin, title, group, salesrank, avg_rating``;
``edges: src, dst, label``). Vertex ids carry their kind as a prefix, so a group and a product can never
collide. BFS is a frontier loop of joins, one small job per hop, with lineage cut by reliable checkpoints; on a stored
``Adjacency`` a hop moves the frontier only, never the edges.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.ranking import partitions_for
from basketry.session import require_checkpoint_dir

# Vertex kinds and edge labels of the property graph.
PRODUCT, GROUP, CATEGORY = "product", "group", "category"
HAS_GROUP, BELONGS_TO, FALLS_UNDER, IS_SIMILAR_TO, CO_PURCHASE = (
    "has_group", "belongs_to", "falls_under", "is_similar_to", "co_purchase",
)
ALL_LABELS = [HAS_GROUP, BELONGS_TO, FALLS_UNDER, IS_SIMILAR_TO, CO_PURCHASE]


def vid(kind: str, key: Column | str) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit(kind + ":"), k.cast("string"))


def vertex_id(kind: str, key) -> str:
    return f"{kind}:{key}"


def vertices(products: DataFrame) -> DataFrame:
    """Product, group and category vertices, one row each."""
    p = products.where(F.col("asin").isNotNull())
    prod = p.select(
        vid(PRODUCT, "asin").alias("id"), F.lit(PRODUCT).alias("kind"), "asin", "title", "group", "salesrank",
        "avg_rating",
    )
    grp = p.select("group").where(F.col("group").isNotNull()).distinct().select(
        vid(GROUP, "group").alias("id"), F.lit(GROUP).alias("kind"), F.lit(None).cast("string").alias("asin"),
        F.lit(None).cast("string").alias("title"), "group", F.lit(None).cast("double").alias("salesrank"),
        F.lit(None).cast("double").alias("avg_rating"),
    )
    cat = p.select(F.explode("categories").alias("c")).distinct().select(
        vid(CATEGORY, "c").alias("id"), F.lit(CATEGORY).alias("kind"), F.lit(None).cast("string").alias("asin"),
        F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("group"),
        F.lit(None).cast("double").alias("salesrank"), F.lit(None).cast("double").alias("avg_rating"),
    )
    return prod.unionByName(grp).unionByName(cat)


def edges(products: DataFrame, copurchase: DataFrame | None = None) -> DataFrame:
    """Labelled edges ``src, dst, label``, one row per distinct (src, dst, label).

    has_group: product → group; belongs_to: product → category; falls_under: group → category; is_similar_to: product →
    similar product; co_purchase: product → product from the undirected ``copurchase`` edges (``src, dst`` product ids).
    Records that share an asin give an edge once. The co-purchase edges, by far the most, are made distinct in as many
    tasks as there are of them, dealt by their ends; the others together, combined per map task first.
    """
    p = products.where(F.col("asin").isNotNull())
    has_group = p.where(F.col("group").isNotNull()).select(
        vid(PRODUCT, "asin").alias("src"), vid(GROUP, "group").alias("dst"), F.lit(HAS_GROUP).alias("label")
    )
    pc = p.select("asin", "group", F.explode(F.array_distinct("categories")).alias("c"))
    belongs = pc.select(vid(PRODUCT, "asin").alias("src"), vid(CATEGORY, "c").alias("dst"),
                        F.lit(BELONGS_TO).alias("label"))
    falls = pc.where(F.col("group").isNotNull()).select(vid(GROUP, "group").alias("src"), vid(CATEGORY, "c").alias("dst"),
                                                        F.lit(FALLS_UNDER).alias("label"))
    similar = p.select("asin", F.explode(F.array_distinct("similars")).alias("s")).where(F.col("s") != F.col("asin"))
    similar = similar.select(vid(PRODUCT, "asin").alias("src"), vid(PRODUCT, "s").alias("dst"),
                             F.lit(IS_SIMILAR_TO).alias("label"))
    out = reduce(DataFrame.unionByName, [has_group, belongs, falls, similar]).distinct()
    if copurchase is not None:
        ids = p.select("id", "asin")
        co = (
            copurchase.select("src", "dst")
            .join(ids.select(F.col("id").alias("src"), F.col("asin").alias("_sa")), "src")
            .join(ids.select(F.col("id").alias("dst"), F.col("asin").alias("_da")), "dst")
            .select(vid(PRODUCT, "_sa").alias("src"), vid(PRODUCT, "_da").alias("dst"), F.lit(CO_PURCHASE).alias("label"))
        )
        n = partitions_for(copurchase.sparkSession, copurchase.count())
        out = out.unionByName(co.repartition(n, "src", "dst").distinct())
    return out


def undirected(e: DataFrame) -> DataFrame:
    """Both directions of every edge (``src, dst`` plus any other columns), in one pass over ``e``."""
    rest = [c for c in e.columns if c not in ("src", "dst")]
    both = F.array(
        F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")),
    )
    return e.select(F.explode(both).alias("_d"), *rest).select("_d.src", "_d.dst", *rest)


def distinct_undirected(e: DataFrame) -> DataFrame:
    """Both directions of every edge, as ``undirected``, without repeats. An edge and its reverse are the same two rows, so the edges are turned one way and
    made distinct, in as many tasks as there are of them, before both directions are made; a loop is one row."""
    rest = [c for c in e.columns if c not in ("src", "dst")]
    turned = F.coalesce(F.col("src") > F.col("dst"), F.col("src").isNull())
    one_way = e.select(F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("dst"), *rest)
    one_way = one_way.repartition(partitions_for(e.sparkSession, e.count()), "src", "dst").distinct()
    loop = F.col("src").eqNullSafe(F.col("dst"))
    sides = F.when(loop, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    back = F.col("_back")
    out = one_way.select("*", F.explode(sides).alias("_back"))
    return out.select(F.when(back, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(back, F.col("src")).otherwise(F.col("dst")).alias("dst"), *rest)


# Rows of one bucket of an adjacency, and edges of one vertex kept under one salt.
BUCKET_ROWS = 1_000_000
HUB_EDGES = 1_000_000


@dataclass(frozen=True)
class Adjacency:
    """Both directions of every edge, stored in buckets of the vertex they leave.

    ``rows``: ``src, salt, dst, forward`` and ``label`` (where edges have one, a partition folder each); ``hubs``: ``id,
    salts`` of the vertices with more than ``HUB_EDGES`` edges, whose edges are dealt to several salts by a hash of the
    other end, so no bucket holds a whole hub. None if there is no such vertex.
    """

    rows: DataFrame
    hubs: DataFrame | None
    table: str

    def step(self, frontier: DataFrame, labels: list[str] | None = None, directed: bool = False) -> DataFrame:
        """``id``: the other ends of the frontier's edges, repeats included. The edges are read in their buckets; only
        the frontier is shuffled, and it is the side that is hashed."""
        e = self.rows if labels is None or "label" not in self.rows.columns else self.rows.where(F.col("label").isin(list(labels)))
        if directed:
            e = e.where("forward")
        f = frontier.select(F.col("id").alias("_id"))
        if self.hubs is None:
            return e.join(f.hint("shuffle_hash"), F.col("src") == F.col("_id")).select(F.col("dst").alias("id"))
        salts = self.hubs.select(F.col("id").alias("_id"), "salts")
        last = F.coalesce("salts", F.lit(1)) - 1
        f = f.join(salts, "_id", "left").select("_id", F.explode(F.sequence(F.lit(0), last)).alias("_salt"))
        return e.join(f.hint("shuffle_hash"), (F.col("src") == F.col("_id")) & (F.col("salt") == F.col("_salt"))).select(F.col("dst").alias("id"))


def store_adjacency(edge_df: DataFrame, path: str, bucket_rows: int = BUCKET_ROWS, hub_edges: int = HUB_EDGES) -> Adjacency:
    """The adjacency of ``edge_df`` (``src, dst`` and, if it has one, ``label``) under the shared folder ``path``. Loops
    are left out. The number of buckets follows the number of edges, and is at least the session's shuffle partitions, so
    that a frontier is dealt as widely as any other shuffle."""
    spark = edge_df.sparkSession
    label = [c for c in ("label",) if c in edge_df.columns]
    ends = F.array(*(F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(a == "src").alias("forward")) for a, b in (("src", "dst"), ("dst", "src"))))
    both = edge_df.where(F.col("src") != F.col("dst")).select(F.explode(ends).alias("_e"), *label).select("_e.*", *label)
    degrees = both.groupBy("src").agg(F.count(F.lit(1)).alias("_n"))
    most, rows = degrees.agg(F.coalesce(F.max("_n"), F.lit(0)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    hubs = None
    if most > hub_edges:
        salted = F.ceil(F.col("_n") / F.lit(hub_edges)).cast("int")
        hubs = degrees.where(F.col("_n") > hub_edges).select(F.col("src").alias("id"), salted.alias("salts"))
        hubs.write.parquet(f"{path}/hubs")
        hubs = spark.read.schema(hubs.schema).parquet(f"{path}/hubs")
    salt = F.lit(0)
    if hubs is not None:
        both = both.join(hubs.withColumnRenamed("id", "src"), "src", "left")
        salt = F.pmod(F.xxhash64("dst"), F.coalesce("salts", F.lit(1))).cast("int")
    both = both.select("src", salt.alias("salt"), "dst", "forward", *label)
    n = max(-(-rows // bucket_rows), int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = ["src"] if hubs is None else ["src", "salt"]
    table = f"adjacency_{uuid.uuid4().hex}"
    writer = both.repartition(n, *keys).write.format("parquet").option("path", f"{path}/rows")
    (writer.partitionBy(*label) if label else writer).bucketBy(n, *keys).saveAsTable(table)
    return Adjacency(spark.table(table), hubs, table)


def _step(edge_df: DataFrame | Adjacency, frontier: DataFrame, labels: list[str] | None, directed: bool) -> DataFrame:
    """``id``: the other ends of the frontier's edges."""
    if isinstance(edge_df, Adjacency):
        return edge_df.step(frontier, labels, directed)
    e = edge_df.where(F.col("src") != F.col("dst"))
    if labels is not None and "label" in e.columns:
        e = e.where(F.col("label").isin(list(labels)))
    e, f = e.select("src", "dst"), frontier.select("id")
    out = e.join(f, F.col("src") == F.col("id")).select(F.col("dst").alias("id"))
    if directed:
        return out
    return out.unionByName(e.join(f, F.col("dst") == F.col("id")).select(F.col("src").alias("id")))


def _level(found: DataFrame, seen: list[DataFrame], depth: int) -> DataFrame:
    """The vertices of ``found`` that no level of ``seen`` has, once each, checkpointed."""
    known = reduce(DataFrame.unionByName, [level.select("id") for level in seen])
    return found.distinct().join(known, "id", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()


def bfs(
    edge_df: DataFrame | Adjacency,
    sources: DataFrame,
    labels: list[str] | None = None,
    targets: DataFrame | None = None,
    max_depth: int | None = None,
    directed: bool = False,
) -> DataFrame:
    """Breadth-first search: ``id, depth`` for every vertex reached from ``sources`` (column ``id``).

    ``labels`` restricts the edges followed (by their ``label`` column when present). With ``targets``
    (column ``id``) the search stops at the first depth that reaches a target and returns the reached
    targets only. ``max_depth`` is an optional bound; by default the search runs until no new vertex is found.

    On an ``Adjacency`` a hop reads the edges in their buckets and shuffles the frontier. On a plain edge table (``src,
    dst``) each hop joins it with the frontier from its ``src`` side and, undirected, from its ``dst`` side. New vertices
    are deduplicated, and undirected, a neighbour of depth d is at depth d-1, d or d+1, so only the last two frontiers
    are anti-joined: no growing visited set is reshuffled. Frontiers are checkpointed to the session's checkpoint folder
    (lineage stays one hop deep and a lost executor recomputes at most one hop).
    """
    spark = sources.sparkSession
    require_checkpoint_dir(spark)
    frontier = sources.select("id").distinct().withColumn("depth", F.lit(0)).checkpoint()
    levels = [frontier]
    depth = 0
    while True:
        if targets is not None:
            hit = frontier.join(targets.select("id").distinct(), "id", "left_semi")
            if not hit.isEmpty():
                return hit
        if max_depth is not None and depth >= max_depth:
            break
        depth += 1
        nxt = _level(_step(edge_df, frontier, labels, directed), levels if directed else levels[-2:], depth)
        if nxt.isEmpty():
            break
        levels.append(nxt)
        frontier = nxt
    if targets is not None:
        return spark.createDataFrame([], sources.select("id").schema.add("depth", "integer"))
    return reduce(DataFrame.unionByName, levels)


def nearest_targets(edge_df: DataFrame | Adjacency, sources: DataFrame, targets: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """``id, depth`` of the targets nearest to the sources, as ``bfs`` with targets over undirected edges, searched from
    both ends.

    Each hop goes on from the smaller of the two last levels. The levels first meet when their depths add up to the
    least distance D: before that hop no vertex was in both searches, so no path is shorter, and a vertex in both is on
    a path of length D. Every target at distance D lies as many hops behind a meeting vertex as the targets' search is
    deep, so it is found by going back from the meeting vertices through the levels of that search, one by one.
    """
    require_checkpoint_dir(sources.sparkSession)
    ways = [[df.select("id").distinct().withColumn("depth", F.lit(0)).checkpoint()] for df in (sources, targets)]
    sizes = [way[0].count() for way in ways]
    while all(sizes):
        met = ways[0][-1].join(ways[1][-1].select("id"), "id", "left_semi").select("id")
        if not met.isEmpty():
            at = met
            for level in reversed(ways[1][:-1]):
                at = _step(edge_df, at, labels, False).join(level.select("id"), "id", "left_semi").distinct().checkpoint()
            return at.withColumn("depth", F.lit(len(ways[0]) + len(ways[1]) - 2))
        k = 0 if sizes[0] <= sizes[1] else 1
        ways[k].append(_level(_step(edge_df, ways[k][-1], labels, False), ways[k][-2:], len(ways[k])))
        sizes[k] = ways[k][-1].count()
    return sources.sparkSession.createDataFrame([], sources.select("id").schema.add("depth", "integer"))


def bfs_to_group(vertex_df: DataFrame, edge_df: DataFrame | Adjacency, source_asin: str, group: str,
                 labels: list[str] | None = None) -> DataFrame:
    """The nearest products of ``group`` from a product along ``labels`` (default co_purchase):
    ``id, depth, asin, title, salesrank, avg_rating`` (searched from the product and from the group)."""
    labels = labels or [CO_PURCHASE]
    src = vertex_df.where(F.col("id") == F.lit(vertex_id(PRODUCT, source_asin))).select("id")
    targets = vertex_df.where((F.col("kind") == PRODUCT) & (F.col("group") == F.lit(group))
                              & (F.col("asin") != F.lit(source_asin))).select("id")
    hit = nearest_targets(edge_df, src, targets, labels)
    return hit.join(vertex_df, "id").select("id", "depth", "asin", "title", "salesrank", "avg_rating")


def path_top_n(
    vertex_df: DataFrame, edge_df: DataFrame, asin: str, group: str, category: str, top_n: int = 5
) -> DataFrame:
    """Pattern ``a -has_group- g -falls_under- c -belongs_to- t`` with ``a.asin = asin``, ``g = group``,
    ``c = category``, ``t != a``, ``t.salesrank > 0``, ``t.avg_rating > 3.0``; distinct ``t`` by ascending
    sales rank (ties by asin), first ``top_n``. ``t``'s own group is not constrained.

    The bound half (a, g, c) is two existence tests, as scalar subqueries; what is left is a filter on the belongs_to
    edges of ``c``, so no join has a single literal for a key. Blanks around ``category`` don't count.
    """
    a_id, g_id, c_id = vertex_id(PRODUCT, asin), vertex_id(GROUP, group), vertex_id(CATEGORY, category.strip())
    ab = edge_df.where((F.col("label") == HAS_GROUP) & (F.col("src") == a_id) & (F.col("dst") == g_id))
    gc = edge_df.where((F.col("label") == FALLS_UNDER) & (F.col("src") == g_id) & (F.col("dst") == c_id))
    ct = edge_df.where((F.col("label") == BELONGS_TO) & (F.col("dst") == c_id) & (F.col("src") != a_id))
    path = ct.where((ab.agg(F.count(F.lit(1))).scalar() > 0) & (gc.agg(F.count(F.lit(1))).scalar() > 0))
    path = path.select(F.col("src").alias("id")).distinct()
    t = vertex_df.where(F.col("kind") == PRODUCT).join(path, "id").where(
        (F.col("salesrank") > 0) & (F.col("avg_rating") > 3.0)
    )
    return t.select("asin", "title", "group", "salesrank", "avg_rating").orderBy(
        F.asc("salesrank"), F.asc("asin")
    ).limit(int(top_n))


def reachable_products(
    vertex_df: DataFrame, edge_df: DataFrame | Adjacency, source_asin: str, labels: list[str] | None = None
) -> DataFrame:
    """Products reachable from a product along ``labels`` (default all), with depth and sales data."""
    src = vertex_df.where(F.col("id") == F.lit(vertex_id(PRODUCT, source_asin))).select("id")
    reached = bfs(edge_df, src, labels or ALL_LABELS)
    prods = vertex_df.where(F.col("kind") == PRODUCT)
    return reached.join(prods, "id").select("asin", "title", "group", "depth", "salesrank", "avg_rating")


def product_bfs(copurchase: DataFrame | Adjacency, source_id: int, max_depth: int | None = None) -> DataFrame:
    """Hop distance from one product over the undirected co-purchase edges (product ids): ``id, depth``."""
    spark = (copurchase.rows if isinstance(copurchase, Adjacency) else copurchase).sparkSession
    src = spark.range(1).select(F.lit(int(source_id)).cast("bigint").alias("id"))
    return bfs(copurchase, src, max_depth=max_depth)


def reach_within(copurchase: DataFrame, source_id: int, max_depth: int) -> DataFrame:
    """``id, depth`` of the products at most ``max_depth`` hops away, as one recursive query without intermediate tables.

    The recursion adds a row for each walk, so it is for a depth of a few hops from one product, where it saves the jobs
    and checkpoints of ``product_bfs``; the session's limits on recursion levels and rows bound it. Walks do not turn
    straight back."""
    spark = copurchase.sparkSession
    view = f"hops_{uuid.uuid4().hex}"
    undirected(copurchase.select("src", "dst").where(F.col("src") != F.col("dst"))).createOrReplaceTempView(view)
    out = spark.sql(f"""
        WITH RECURSIVE walk (id, last, depth) AS (
          SELECT {int(source_id)}L, CAST(NULL AS BIGINT), 0
          UNION ALL
          SELECT e.dst, e.src, w.depth + 1 FROM walk w JOIN {view} e ON e.src = w.id
          WHERE w.depth < {int(max_depth)} AND (w.last IS NULL OR e.dst <> w.last)
        )
        SELECT id, min(depth) AS depth FROM walk GROUP BY id""")
    spark.catalog.dropTempView(view)
    return out
