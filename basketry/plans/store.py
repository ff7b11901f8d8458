"""The catalogue as stored tables, each built on first use in a session and then read back.

Queries run against parquet copies in the session's checkpoint folder (a shared folder on a cluster), so a build
cost is paid once and only for what is used, lineage is cut, a lost executor recomputes from files, and scans get
pushdown. A changed input table (size or time of change) is built anew. Stored tables:

* ``edges``, ``part_stats`` and ``similars``: the line items' pairs, their totals and the best partners by part;
* ``products``: range-partitioned and sorted by id, so a request for one product reads the one file and row
  group whose min/max statistics hold it;
* ``categories``: catalogue x category partitioned by a hash bucket of the category (one bucket per
  ~2 million rows), so a request naming a few categories reads only their buckets (dynamic pruning);
* ``category_grams``: the distinct category paths by trigram, and the bucket of each;
* ``category_runs``: the best products of each category by score, as deep as a request can ask;
* ``title_index`` and ``title_grams``: postings of the titles' words and trigrams by token bucket;
* ``graph_vertices`` and ``graph_edges``: the property graph, edges partitioned by label, so a label filter prunes;
* ``neighbours`` and ``graph_neighbours``: both directions of the co-purchase and of the graph's edges, bucketed by
  vertex, so a search moves its frontier and never the edges;
* ``reviews``: line-item sized and only scanned whole, partitioned by year, so a year's filter reads that year.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators.catalog import (
    REVIEW_COLUMNS, bucketed_product_categories, buckets_for, copurchase_edges, load_tables, part_stats,
    products_from_tables, reviews_from_tables, similars_from_edges, similars_from_lines,
)
from basketry.operators.category_grams import CategoryGrams, store_category_grams
from basketry.operators.category_runs import CategoryRuns, store_category_runs
from basketry.operators.graph import Adjacency, store_adjacency, vertices
from basketry.operators.graph import edges as graph_edges
from basketry.operators.title_index import TitleIndex, store_title_index
from basketry.session import ensure_checkpoint_dir
from basketry.sources.sinks import write_graph

INPUTS = ("part", "orders", "lineitem")
# Fixed value: reviews of one part of a year.
REVIEWS_PER_PART = 5_000_000


class StoredCatalog:
    """The tables of ``operators.catalog.Catalog``, stored; each attribute builds its table on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/catalog-{uuid.uuid4().hex}"
        self.inputs = load_tables(spark, sf_dir, *INPUTS)

    def _kept(self, name: str, df: DataFrame, *partition_by: str) -> DataFrame:
        df.write.partitionBy(*partition_by).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    @cached_property
    def edges(self) -> DataFrame:
        return self._kept("edges", copurchase_edges(self.inputs["lineitem"]))

    @cached_property
    def products(self) -> DataFrame:
        stats = self._kept("part_stats", part_stats(self.inputs["lineitem"]))
        # stored edges hold the pairs already; without them the line items' pairs are not stored
        similars = similars_from_edges(self.edges, stats) if "edges" in self.__dict__ else similars_from_lines(self.inputs["lineitem"], stats)
        similars = self._kept("similars", similars)
        rows = products_from_tables(self.inputs["part"], self.inputs["lineitem"], stats, similars)
        return self._kept("products", rows.repartitionByRange("id").sortWithinPartitions("id"))

    @cached_property
    def category_buckets(self) -> int:
        rows = self.products.agg(F.sum(F.size(F.array_distinct("categories")))).first()[0]
        return buckets_for(rows or 0)

    @cached_property
    def categories(self) -> DataFrame:
        rows = bucketed_product_categories(self.products, self.category_buckets)
        return self._kept("categories", rows.repartitionByRange("cat_bucket", "id"), "cat_bucket")

    @cached_property
    def category_grams(self) -> CategoryGrams:
        return store_category_grams(self.categories, f"{self.path}/category_grams")

    @cached_property
    def category_runs(self) -> CategoryRuns:
        return store_category_runs(self.categories, self.category_buckets, f"{self.path}/category_runs")

    @cached_property
    def title_index(self) -> TitleIndex:
        return store_title_index(self.products, f"{self.path}/title_index")

    @cached_property
    def title_grams(self) -> TitleIndex:
        return store_title_index(self.products, f"{self.path}/title_grams", ngram=3)

    @cached_property
    def _graph(self) -> str:
        path = f"{self.path}/graph"
        write_graph(vertices(self.products), graph_edges(self.products, self.edges), path)
        return path

    @cached_property
    def graph_vertices(self) -> DataFrame:
        return self.spark.read.parquet(f"{self._graph}/vertices")

    @cached_property
    def graph_edges(self) -> DataFrame:
        return self.spark.read.parquet(f"{self._graph}/edges")

    @cached_property
    def neighbours(self) -> Adjacency:
        return store_adjacency(self.edges.select("src", "dst"), f"{self.path}/neighbours")

    @cached_property
    def graph_neighbours(self) -> Adjacency:
        return store_adjacency(self.graph_edges, f"{self.path}/graph_neighbours")

    @cached_property
    def reviews(self) -> DataFrame:
        lines = self.inputs["lineitem"]
        rows = reviews_from_tables(lines, self.inputs["orders"]).withColumn("year", F.year("date"))
        # a year is dealt to as many parts as the rows need; whole rows are hashed, so a product with very many reviews is dealt too
        parts = max(-(-lines.count() // REVIEWS_PER_PART), int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = rows.repartition(parts, "year", F.pmod(F.xxhash64(*REVIEW_COLUMNS), F.lit(parts)))
        return self._kept("reviews", dealt, "year").select(*REVIEW_COLUMNS)

    def release(self) -> None:
        """Delete the stored tables; the object is of no use afterwards."""
        for name in ("neighbours", "graph_neighbours"):
            if name in self.__dict__:
                self.spark.sql(f"DROP TABLE {self.__dict__[name].table}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


_STORED: dict[tuple, StoredCatalog] = {}


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """Size and time of change of each input table's file or folder."""
    out = []
    for name in INPUTS:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        out.append((fs.getFileStatus(path).getModificationTime(), fs.getContentSummary(path).getLength()))
    return tuple(out)


def stored_catalog(spark: SparkSession, sf_dir: str) -> StoredCatalog:
    """The stored catalogue of ``sf_dir`` as its tables are now."""
    key = (spark.sparkContext.applicationId, sf_dir, _state(spark, sf_dir))
    if key not in _STORED:
        _STORED[key] = StoredCatalog(spark, sf_dir)
    return _STORED[key]


def release_catalogs(spark: SparkSession) -> None:
    """Delete everything stored in this session."""
    for key in [k for k in _STORED if k[0] == spark.sparkContext.applicationId]:
        _STORED.pop(key).release()
