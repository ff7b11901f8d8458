"""DuckDB SQL for every deterministic registered query, written independently of the Spark code (the signatures' fixed values
aside, which both need).

``BASE`` re-derives the catalogue from the order tables in plain SQL (window ``dense_rank``, ``row_number``,
a self-join for co-purchase pairs); each query then reads those CTEs. The strings run on DuckDB views named
after the driver tables.
"""

from __future__ import annotations

from basketry.operators.similarity import BAND_ROWS, BANDS, PRIME, multipliers
from basketry.plans import params as P

BASE = """
WITH RECURSIVE
stats AS (
  SELECT l_partkey AS id, sum(l_quantity) AS qty, count(*) AS total_reviews,
         avg(1 + (l_orderkey + l_linenumber) % 5) AS avg_rating
  FROM lineitem GROUP BY l_partkey
),
ranked AS (SELECT *, dense_rank() OVER (ORDER BY qty DESC) AS rnk FROM stats),
co_items AS (
  SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL
),
co_edges AS (
  SELECT a.p AS src, b.p AS dst, count(*) AS weight
  FROM co_items a JOIN co_items b ON a.o = b.o AND a.p < b.p GROUP BY 1, 2
),
nbrs AS (
  SELECT src AS node, dst AS nbr, weight FROM co_edges
  UNION ALL SELECT dst AS node, src AS nbr, weight FROM co_edges
),
top_nbrs AS (
  SELECT node, nbr, row_number() OVER (PARTITION BY node ORDER BY weight DESC, nbr) AS rk FROM nbrs
  QUALIFY rk <= 5
),
sims AS (
  SELECT node AS id, list(lpad(CAST(nbr AS VARCHAR), 10, '0') ORDER BY rk) AS similars
  FROM top_nbrs GROUP BY node
),
products AS (
  SELECT p.p_partkey AS id,
         CASE WHEN p.p_partkey % 103 = 19 THEN NULL ELSE lpad(CAST(p.p_partkey AS VARCHAR), 10, '0') END AS asin,
         CASE WHEN p.p_partkey % 107 = 23 THEN p.p_name || ' avg rating: 1.5'
              WHEN p.p_partkey % 97 = 13 THEN NULL ELSE p.p_name END AS title,
         p.p_type AS "group",
         CASE WHEN p.p_partkey % 109 = 29 THEN 0e0 WHEN p.p_partkey % 89 = 7 THEN NULL ELSE CAST(r.rnk AS DOUBLE) END AS salesrank,
         coalesce(r.total_reviews, 0) AS total_reviews,
         CASE WHEN p.p_partkey % 83 = 5 THEN NULL ELSE r.avg_rating END AS avg_rating,
         CASE WHEN p.p_partkey % 73 = 3 THEN CAST([] AS VARCHAR[]) ELSE coalesce(s.similars, CAST([] AS VARCHAR[])) END AS similars,
         CASE WHEN p.p_partkey % 79 = 11 THEN CAST([] AS VARCHAR[])
              ELSE list_concat(
                ['|' || p.p_type || '|' || p.p_brand,
                 '|' || p.p_brand || '|size_' || CAST(p.p_size // 10 AS VARCHAR)],
                CASE WHEN p.p_partkey % 71 = 9
                     THEN ['|extra|1', '|extra|2', '|extra|3', '|extra|4', '|extra|5'] ELSE CAST([] AS VARCHAR[]) END)
         END AS categories
  FROM part p LEFT JOIN ranked r ON r.id = p.p_partkey LEFT JOIN sims s ON s.id = p.p_partkey
  WHERE p.p_partkey % 101 <> 17
),
scored AS (
  SELECT *, ((1e7 - salesrank) / 1e7 + CAST(total_reviews AS DOUBLE) / 1e2 + avg_rating) / 3e0 AS score
  FROM products
),
reviews AS (
  SELECT l.l_partkey AS id, CAST(o.o_orderdate AS DATE) AS date, CAST(o.o_custkey AS VARCHAR) AS customer,
         CAST(1 + (l.l_orderkey + l.l_linenumber) % 5 AS INTEGER) AS rating,
         CAST(CAST(l.l_quantity AS BIGINT) % 7 AS INTEGER) AS votes,
         CAST(least(CAST(l.l_quantity AS BIGINT) % 7, l.l_linenumber) AS INTEGER) AS helpful
  FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey
),
pc AS (
  SELECT DISTINCT id, asin, title, "group", salesrank, total_reviews, avg_rating, score,
         unnest(categories) AS category
  FROM scored
)
"""


D = P.DIGITS


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(xs: list[str]) -> str:
    return ", ".join(_lit(x) for x in xs)


TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))"


def tokens(col: str) -> str:
    return TOKENS.format(col)


def ngrams(col: str, n: int) -> str:
    t = f"lower(coalesce({col}, ''))"
    return (f"(CASE WHEN length({t}) = 0 THEN CAST([] AS VARCHAR[]) WHEN length({t}) < {n} THEN [{t}] "
            f"ELSE list_distinct(list_transform(range(1, length({t}) - {n - 1} + 1), lambda i: substring({t}, i, {n}))) END)")


def jaccard(a: str, b: str) -> str:
    return (f"(CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN CAST(len(list_intersect({a}, {b})) AS DOUBLE)"
            f" / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0 END)")


SAMPLE_CUTOFF = int(0.1 * (1 << 32))


def draw(seed: int, cols: list[str], lists: tuple[str, ...] = ()) -> str:
    """The sample draw: first 32 bits of md5(seed, marked values as text, '-' for null) below the cutoff."""
    plain = {c: f"CAST({c} AS VARCHAR)" for c in cols}
    plain |= {c: f"array_to_string(list_transform({c}, lambda v: coalesce('=' || v, '-')), ',')" for c in lists}
    text = ", ".join(f"coalesce('=' || {plain[c]}, '-')" for c in cols)
    return f"CAST(('0x' || substr(md5(concat_ws(chr(1), '{seed}', {text})), 1, 8)) AS BIGINT) < {SAMPLE_CUTOFF}"


def top(where: str, n: int) -> str:
    return f"""
SELECT asin, title, round(max(score), {D}) AS score FROM pc WHERE {where}
GROUP BY asin, title ORDER BY max(score) DESC NULLS LAST, asin LIMIT {n}"""


def ranked(where: str, n: int, best: str = "DESC") -> str:
    """Catalogue rows, one per product, by score."""
    return f"""
SELECT asin, title, round(score, {D}) AS score FROM scored WHERE {where}
ORDER BY scored.score {best} NULLS LAST, asin NULLS LAST, id LIMIT {n}"""


def has_category(text: str) -> str:
    return f"len(list_filter(categories, lambda c: contains(c, {_lit(text)}))) > 0"


#: Rows of a list column; an empty list is one row with a null.
def outer(col: str) -> str:
    return f"unnest(CASE WHEN len(coalesce({col}, CAST([] AS VARCHAR[]))) = 0 THEN CAST([NULL] AS VARCHAR[]) ELSE {col} END)"


OWN_CATS = f"(SELECT unnest(categories) FROM products WHERE id = {P.PRODUCT_ID})"
PRODUCT_FLAT = f"""
SELECT id, asin, title, "group", salesrank, total_reviews, round(avg_rating, {D}) AS avg_rating,
       array_to_string(similars, ',') AS similars, array_to_string(categories, ',') AS categories,
       categories[1] AS category_1, categories[2] AS category_2, categories[3] AS category_3,
       categories[4] AS category_4, categories[5] AS category_5, categories[6] AS category_6
FROM products"""
CONTEXT_COLS = f'id, asin, title, salesrank, total_reviews, round(avg_rating, {D}) AS avg_rating, "group", category'
HAS_SIMILAR_IN_CATALOGUE = f"""EXISTS (SELECT 1 FROM (SELECT unnest(similars) AS s FROM products
  WHERE id = {P.PRODUCT_ID}) x JOIN products q ON q.asin = x.s)"""
GRAPH_EDGES = """
ge AS (
  SELECT 'product:' || asin AS src, 'group:' || "group" AS dst, 'has_group' AS label
  FROM products WHERE asin IS NOT NULL AND "group" IS NOT NULL
  UNION ALL
  SELECT 'product:' || asin, 'category:' || c, 'belongs_to'
  FROM (SELECT asin, unnest(list_distinct(categories)) AS c FROM products WHERE asin IS NOT NULL)
  UNION ALL
  SELECT DISTINCT 'group:' || "group", 'category:' || c, 'falls_under'
  FROM (SELECT "group", unnest(categories) AS c FROM products WHERE asin IS NOT NULL AND "group" IS NOT NULL)
  UNION ALL
  SELECT 'product:' || asin, 'product:' || s, 'is_similar_to'
  FROM (SELECT asin, unnest(list_distinct(similars)) AS s FROM products WHERE asin IS NOT NULL) WHERE s <> asin
  UNION ALL
  SELECT 'product:' || a.asin, 'product:' || b.asin, 'co_purchase'
  FROM co_edges e JOIN products a ON a.id = e.src JOIN products b ON b.id = e.dst
  WHERE a.asin IS NOT NULL AND b.asin IS NOT NULL
)"""


def bfs_cte(name: str, edges: str, source: str, id_type: str) -> str:
    """Hop distances by a keyed recursive CTE: each step adds only vertices not yet in the table."""
    return f"""
{name}(id, depth) USING KEY (id) AS (
  SELECT CAST({source} AS {id_type}), 0
  UNION
  SELECT e.dst, min(b.depth) + 1 FROM {name} b JOIN {edges} e ON e.src = b.id
  WHERE NOT EXISTS (SELECT 1 FROM recurring.{name} r WHERE r.id = e.dst)
  GROUP BY e.dst
)"""


FLAT_COLUMNS = [
    "id", "asin", "title", '"group"', "salesrank", "total_reviews", "avg_rating", "similars", "categories",
    *[f"category_{i}" for i in range(1, 7)],
]

PROFILE_LONG = """
plong AS (
  SELECT 'salesrank' AS col_name, CAST(salesrank AS DOUBLE) AS value, CAST(salesrank AS VARCHAR) AS value_str
  FROM products
  UNION ALL SELECT 'total_reviews', CAST(total_reviews AS DOUBLE), CAST(total_reviews AS VARCHAR) FROM products
  UNION ALL SELECT 'avg_rating', CAST(avg_rating AS DOUBLE), CAST(avg_rating AS VARCHAR) FROM products
),
ptop AS (
  SELECT col_name, string_agg(coalesce(value_str, 'null') || ':' || CAST(cnt AS VARCHAR), ',' ORDER BY rk) AS tops
  FROM (
    SELECT col_name, value_str, cnt,
           row_number() OVER (PARTITION BY col_name ORDER BY cnt DESC, value_str ASC NULLS FIRST) AS rk
    FROM (SELECT col_name, value_str, count(*) AS cnt FROM plong GROUP BY col_name, value_str)
  ) WHERE rk <= 10 GROUP BY col_name
),
pstat AS (
  SELECT col_name, count(value) AS cnt, count(*) FILTER (WHERE value IS NULL) AS nulls,
         count(DISTINCT value) AS dcnt, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS mn,
         quantile_disc(value, 0.25) AS q1, quantile_disc(value, 0.5) AS q2, quantile_disc(value, 0.75) AS q3,
         max(value) AS mx
  FROM plong GROUP BY col_name
)"""

ORACLE: dict[str, str] = {
    "products": PRODUCT_FLAT,
    "catalog_build": PRODUCT_FLAT,
    "reviews": "SELECT * FROM reviews",
    "copurchase_edges": "SELECT src, dst, weight FROM co_edges",
    "product_categories": f"""
SELECT id, asin, title, "group", salesrank, total_reviews, round(avg_rating, {D}) AS avg_rating, category
FROM pc""",
    "parse_products": PRODUCT_FLAT,
    "parse_reviews": "SELECT * FROM reviews",
    "parse_products_file": PRODUCT_FLAT,
    "edge_list_file": "SELECT src, dst, weight FROM co_edges",
    "full_dump_products": PRODUCT_FLAT,
    "full_dump_reviews": "SELECT * FROM reviews WHERE id IN (SELECT id FROM products)",
    "text_lines": """
SELECT label, CAST(sum(n) AS BIGINT) AS lines FROM (
  SELECT unnest(['Id', 'ASIN', 'title', 'group', 'salesrank', 'similar', 'categories', 'reviews', '']) AS label,
         unnest([count(*), count(asin), count(title), count("group"), count(*), count(*), count(*), count(*),
                 CAST(sum(len(categories)) AS BIGINT)
                 + (SELECT count(*) FROM reviews WHERE id IN (SELECT id FROM products))]) AS n
  FROM products
) GROUP BY label HAVING sum(n) > 0""",
    "adjacency": """
SELECT node AS src, row_number() OVER (PARTITION BY node ORDER BY nbr) AS pos, nbr AS dst FROM nbrs""",
    "reviews_nested": """
SELECT id, CAST(sum(times) OVER (PARTITION BY id ORDER BY date NULLS FIRST, customer NULLS FIRST, rating NULLS FIRST,
                                 votes NULLS FIRST, helpful NULLS FIRST) - times + 1 AS BIGINT) AS pos,
       date, customer, rating, votes, helpful, times
FROM (SELECT id, date, customer, rating, votes, helpful, count(*) AS times FROM reviews GROUP BY ALL)""",
    "graph_rows": f""",
g1 AS (SELECT n.node AS id, n.nbr AS "to", p.asin, p.title, p."group", p.salesrank, p.total_reviews,
              p.avg_rating, p.similars, p.categories
       FROM nbrs n LEFT JOIN products p ON p.id = n.node),
g2 AS (SELECT *, {outer('similars')} AS "similar" FROM g1),
g3 AS (SELECT *, {outer('categories')} AS category FROM g2)
SELECT id, asin, title, "group", salesrank, total_reviews, round(avg_rating, {D}) AS avg_rating, "to", "similar",
       category
FROM g3""",
    "group_count": 'SELECT "group", count(id) AS count FROM products GROUP BY 1',
    "group_rows": 'SELECT "group", count(*) AS count FROM products GROUP BY 1',
    "category_counts": """
SELECT category, count(*) AS count FROM (SELECT unnest(categories) AS category FROM products) GROUP BY 1""",
    "correlation": f"""
SELECT round(corr(salesrank, avg_rating), {D}) AS salesrank_avg_rating_corr,
       round(corr(total_reviews, avg_rating), {D}) AS total_reviews_avg_rating_corr
FROM products""",
    "null_rates": "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS null_count, count(*) AS total, "
        f"round(CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) / count(*), {D}) AS null_rate FROM reviews"
        for c in ["id", "date", "customer", "rating", "votes", "helpful"]
    ),
    "null_rates_products": "\nUNION ALL ".join(
        f"SELECT '{c.strip(chr(34))}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS null_count, count(*) AS total, "
        f"round(CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) / count(*), {D}) AS null_rate FROM products"
        for c in ["id", "asin", "title", '"group"', "salesrank", "total_reviews", "avg_rating"]
    ),
    "untitled_products": 'SELECT id, asin, "group" FROM products WHERE title IS NULL',
    "rated_products": f"SELECT id, round(avg_rating, {D}) AS avg_rating FROM products WHERE avg_rating IS NOT NULL",
    "helpfulness": """
SELECT id, date, customer, rating,
       round(CASE WHEN votes = 0 THEN NULL ELSE CAST(helpful * 100 AS DOUBLE) / votes END, 2) AS helpful_percentage
FROM reviews""",
    "misleading_share": f""",
h AS (SELECT round(CASE WHEN votes = 0 THEN NULL ELSE CAST(helpful * 100 AS DOUBLE) / votes END, 2) AS hp
      FROM reviews)
SELECT round(avg(hp), {D}) AS avg_helpful_percentage, round(100.0 - avg(hp), {D}) AS misleading_percentage FROM h""",
    "most_frequent_group_month": f"""
SELECT p."group", count(*) AS count FROM products p JOIN reviews r ON r.id = p.id
WHERE month(r.date) = {P.MONTH} GROUP BY 1 ORDER BY count DESC, "group" ASC NULLS LAST LIMIT 1""",
    "most_frequent_group_year": f"""
SELECT p."group", count(*) AS count FROM products p JOIN reviews r ON r.id = p.id
WHERE year(r.date) = {P.YEAR} GROUP BY 1 ORDER BY count DESC, "group" ASC NULLS LAST LIMIT 1""",
    "most_frequent_group_all": """
SELECT "group", count(*) AS count FROM products GROUP BY 1 ORDER BY count DESC, "group" ASC NULLS LAST LIMIT 1""",
    "most_frequent_group_per_month": """
SELECT month, "group", count FROM (
  SELECT CAST(month(r.date) AS INTEGER) AS month, p."group", count(*) AS count,
         row_number() OVER (PARTITION BY month(r.date) ORDER BY count(*) DESC, p."group" ASC NULLS LAST) AS rk
  FROM products p JOIN reviews r ON r.id = p.id WHERE r.date IS NOT NULL GROUP BY month(r.date), p."group"
) WHERE rk = 1""",
    "most_frequent_group_per_year": """
SELECT year, "group", count FROM (
  SELECT CAST(year(r.date) AS INTEGER) AS year, p."group", count(*) AS count,
         row_number() OVER (PARTITION BY year(r.date) ORDER BY count(*) DESC, p."group" ASC NULLS LAST) AS rk
  FROM products p JOIN reviews r ON r.id = p.id WHERE r.date IS NOT NULL GROUP BY year(r.date), p."group"
) WHERE rk = 1""",
    "sort_by_salesrank": f"""
SELECT id, asin, title, "group", salesrank, total_reviews, round(avg_rating, {D}) AS avg_rating
FROM products WHERE "group" = {_lit(P.GROUP)}""",
    "histogram_salesrank": f""",
hb AS (SELECT min(salesrank) AS lo, max(salesrank) AS hi FROM products),
hv AS (SELECT salesrank AS x FROM products WHERE salesrank IS NOT NULL),
hc AS (
  SELECT CAST(CASE WHEN hi = lo THEN 1 ELSE least(floor((x - lo) / ((hi - lo) / 30)) + 1, 30) END AS INTEGER)
           AS bucket, lo, hi, count(*) AS count
  FROM hv CROSS JOIN hb GROUP BY 1, 2, 3
)
SELECT CAST(g.bucket AS INTEGER) AS bucket, round(hb.lo + (g.bucket - 1) * (hb.hi - hb.lo) / 30, {D}) AS lower,
       round(hb.lo + g.bucket * (hb.hi - hb.lo) / 30, {D}) AS upper, coalesce(hc.count, 0) AS count
FROM hb, (SELECT unnest(range(1, 31)) AS bucket) g LEFT JOIN hc ON hc.bucket = g.bucket""",
    "histogram_group": 'SELECT "group", count(*) AS count FROM products GROUP BY 1',
    "title_set": f"""
SELECT array_to_string(list_sort(list(DISTINCT title)), ',') AS titles FROM products WHERE id = {P.PRODUCT_ID}""",
    "distinct_titles": "SELECT DISTINCT id, title FROM products",
    "drop_null_rows": f"""
SELECT id, salesrank, round(avg_rating, {D}) AS avg_rating FROM products
WHERE id IS NOT NULL AND salesrank IS NOT NULL AND avg_rating IS NOT NULL""",
    "profile_stats": f"""
, {PROFILE_LONG.strip()}
SELECT s.col_name,
       CASE s.col_name WHEN 'total_reviews' THEN 'bigint' ELSE 'double' END AS data_type,
       s.cnt AS count,
       round(s.nulls * 100.0 / (s.cnt + s.nulls), 2) AS col_sparsity,
       s.dcnt + CASE WHEN s.nulls > 0 THEN 1 ELSE 0 END AS distinct_count,
       CASE WHEN s.nulls = 0 THEN 100.0 ELSE round(s.cnt * 100.0 / (s.cnt + s.nulls), 2) END AS fill_rate,
       s.dcnt AS distinct_count_, t.tops AS most_freq_values_top_10, s.cnt + s.nulls AS dataset_size,
       round(s.mean, {D}) AS mean, round(s.sd, {D}) AS stddev, s.mn AS min, s.q1, s.q2, s.q3, s.mx AS max
FROM pstat s LEFT JOIN ptop t ON t.col_name = s.col_name""",
    "profile": f"""
, {PROFILE_LONG.strip()}
SELECT s.col_name,
       CASE s.col_name WHEN 'total_reviews' THEN 'bigint' ELSE 'double' END AS data_type,
       s.cnt AS count,
       round(s.nulls * 100.0 / (s.cnt + s.nulls), 2) AS col_sparsity,
       s.dcnt + CASE WHEN s.nulls > 0 THEN 1 ELSE 0 END AS distinct_count,
       CASE WHEN s.nulls = 0 THEN 100.0 ELSE round(s.cnt * 100.0 / (s.cnt + s.nulls), 2) END AS fill_rate,
       s.dcnt AS distinct_count_, t.tops AS most_freq_values_top_10, s.cnt + s.nulls AS dataset_size,
       (SELECT count(*) FILTER (WHERE {draw(42, FLAT_COLUMNS, ('similars', 'categories'))})
          FROM (SELECT *, {', '.join(f'categories[{i}] AS category_{i}' for i in range(1, 7))} FROM products))
         AS sample_size,
       round(s.mean, {D}) AS mean, round(s.sd, {D}) AS stddev, s.mn AS min, s.q1, s.q2, s.q3, s.mx AS max
FROM pstat s LEFT JOIN ptop t ON t.col_name = s.col_name""",
    "sample_rows": f"""
SELECT * FROM reviews WHERE {draw(7, ['id', 'date', 'customer', 'rating', 'votes', 'helpful'])}""",
    "sample_size": f"""
SELECT count(*) AS dataset_size,
       count(*) FILTER (WHERE {draw(7, ['id', 'asin', 'title', '"group"', 'salesrank', 'total_reviews', 'avg_rating'])})
         AS sample_size
FROM products""",
    "product_score": f"SELECT id, asin, round(score, {D}) AS score FROM scored",
    "normalised_score": f""",
mx AS (SELECT max(salesrank) AS ms, max(total_reviews) AS mt FROM products)
SELECT id, round((salesrank / ms + CAST(total_reviews AS DOUBLE) / mt + avg_rating) / 3.0, {D}) AS score
FROM products CROSS JOIN mx""",
    "popularity_score": f""",
hp AS (SELECT id, avg(round(CASE WHEN votes = 0 THEN NULL ELSE CAST(helpful * 100 AS DOUBLE) / votes END, 2)) AS h
       FROM reviews GROUP BY id),
mx AS (SELECT max(salesrank) AS ms FROM products),
pp AS (SELECT p.id, p.avg_rating, h.h, p.salesrank * 100.0 / mx.ms AS pop
       FROM products p CROSS JOIN mx LEFT JOIN hp h ON h.id = p.id)
SELECT id, round(h, {D}) AS helpful_percentage, round(pop, {D}) AS popularity_percentage,
       round(h * avg_rating * pop, {D}) AS popularity_score
FROM pp""",
    "product_context_row": f"""
SELECT id, asin, title, "group", array_to_string(similars, ',') AS similars,
       array_to_string(categories, ',') AS categories
FROM products WHERE id = {P.PRODUCT_ID}""",
    "product_context_similars": f"""
SELECT id, asin, title, "group", unnest(similars) AS similar_asin FROM products WHERE id = {P.PRODUCT_ID}""",
    "product_context_categories": f"""
SELECT id, asin, title, "group", unnest(categories) AS category FROM products WHERE id = {P.PRODUCT_ID}""",
    "relevant_categories": f"""
SELECT {CONTEXT_COLS} FROM (SELECT *, unnest(categories) AS category FROM products WHERE id = {P.PRODUCT_ID})""",
    "relevant_categories_group": f"""
SELECT DISTINCT {CONTEXT_COLS} FROM (SELECT *, unnest(categories) AS category FROM products
  WHERE id = {P.PRODUCT_ID} AND "group" = {_lit(P.GROUP)} AND {HAS_SIMILAR_IN_CATALOGUE})""",
    "relevant_categories_similars": f"""
SELECT DISTINCT {CONTEXT_COLS} FROM (SELECT *, unnest(categories) AS category FROM products
  WHERE "group" = {_lit(P.SIMILARS_GROUP)}
    AND asin IN (SELECT unnest(similars) FROM products WHERE id = {P.PRODUCT_ID}))""",
    "recommend_by_category": top(f"category IN {OWN_CATS} AND id <> {P.PRODUCT_ID}", P.TOP_N),
    "recommend_restricted": top(
        f"category IN (SELECT c FROM (SELECT unnest(categories) AS c FROM products WHERE id = {P.PRODUCT_ID}) "
        f"WHERE lower(trim(c)) IN ({_list([P.CATEGORY.lower()])})) AND id <> {P.PRODUCT_ID}", P.TOP_N),
    "recommend_with_chosen_categories": top(
        f"""id <> {P.PRODUCT_ID} AND (
  ("group" = {_lit(P.GROUP)} AND category IN (SELECT unnest(categories) FROM products
     WHERE id = {P.PRODUCT_ID} AND "group" = {_lit(P.GROUP)} AND {HAS_SIMILAR_IN_CATALOGUE}))
  OR category IN ({_list(P.CHOSEN_CATEGORIES)}))""", P.TOP_N),
    "recommend_by_category_and_title": f"""
SELECT asin, title, round(max(score), {D}) AS score FROM (
  SELECT asin, title, score FROM pc WHERE id <> {P.PRODUCT_ID} AND category IN {OWN_CATS}
  UNION ALL
  SELECT t.asin, t.title, t.score FROM scored t, (SELECT title AS qt FROM products WHERE id = {P.PRODUCT_ID}) q
  WHERE t.id <> {P.PRODUCT_ID} AND {jaccard(tokens('t.title'), tokens('q.qt'))} >= {P.THRESHOLD}
) GROUP BY asin, title ORDER BY max(score) DESC NULLS LAST, asin LIMIT {P.TOP_N}""",
    "recommend_with_requested_category": top(
        f"id <> {P.PRODUCT_ID} AND (category IN {OWN_CATS} OR category = {_lit(P.REQUESTED_CATEGORY)})", P.TOP_N),
    "similar_products": f"""
SELECT id, asin, title, "group", unnest(categories) AS category FROM products
WHERE asin IN (SELECT unnest(similars) FROM products WHERE id = {P.PRODUCT_ID})""",
    "recommend_filters_all": ranked(
        f"{has_category(P.CATEGORY_SUBSTRING)} AND \"group\" = {_lit(P.GROUP)} AND asin <> {_lit(P.ASIN)}", P.TOP_N),
    "recommend_filters_category": ranked(has_category(P.CATEGORY_SUBSTRING), 10),
    "recommend_filters_group": ranked(f"\"group\" = {_lit(P.GROUP)} AND asin <> {_lit(P.ASIN)}", 5),
    "recommend_filters_asin": ranked(
        f"\"group\" IN (SELECT \"group\" FROM products WHERE asin = {_lit(P.ASIN)}) AND asin <> {_lit(P.ASIN)}", 7),
    "recommend_filters_none": ranked("TRUE", 5),
    "recommend_ascending": ranked(f"\"group\" = {_lit(P.GROUP)}", 6, "ASC"),
    "context_recommendation": f"""
SELECT asin, title, round(max(score), {D}) AS score FROM pc
WHERE "group" = {_lit(P.SIMILARS_GROUP)} AND asin IN (SELECT unnest(similars) FROM products WHERE id = {P.PRODUCT_ID})
GROUP BY asin, title ORDER BY max(score) DESC NULLS LAST, asin LIMIT {P.TOP_N}""",
    "context_requested": f"""
SELECT asin, title, round(max(score), {D}) AS score FROM (
  SELECT asin, title, score FROM pc WHERE id = {P.PRODUCT_ID}
  UNION ALL SELECT NULL, NULL, NULL WHERE EXISTS (SELECT 1 FROM pc WHERE category = {_lit(P.REQUESTED_CATEGORY)})
) GROUP BY asin, title ORDER BY max(score) DESC NULLS LAST, asin LIMIT {P.TOP_N}""",
    "context_and_titles": f"""
SELECT asin, title, round(max(score), {D}) AS score FROM (
  SELECT asin, title, score FROM pc WHERE id = {P.PRODUCT_ID}
  UNION ALL
  SELECT t.asin, t.title, t.score FROM scored t, (SELECT title AS qt FROM products WHERE id = {P.PRODUCT_ID}) q
  WHERE {jaccard(tokens('t.title'), tokens('q.qt'))} >= {P.THRESHOLD}
) GROUP BY asin, title ORDER BY max(score) DESC NULLS LAST, asin LIMIT {P.TOP_N}""",
    "context_and_chosen": f"""
SELECT asin, title, round(max(score), {D}) AS score FROM (
  SELECT asin, title, score FROM pc
  WHERE id = {P.PRODUCT_ID} AND "group" = {_lit(P.GROUP)} AND {HAS_SIMILAR_IN_CATALOGUE}
  UNION ALL SELECT asin, title, score FROM pc WHERE category IN ({_list(P.CHOSEN_CATEGORIES)})
) GROUP BY asin, title ORDER BY max(score) DESC NULLS LAST, asin LIMIT {P.TOP_N}""",
    "context_by_asin": f"""
SELECT DISTINCT asin, title, "group", category FROM pc
WHERE asin IS NOT NULL AND (id = {P.PRODUCT_ID}
   OR asin IN (SELECT unnest(similars) FROM products WHERE id = {P.PRODUCT_ID}))""",
    "recommend_all": f""",
pcs AS (SELECT DISTINCT id, asin, title, category, score FROM pc),
cand AS (SELECT DISTINCT a.id, b.id AS rec_id, b.asin AS rec_asin, b.title AS rec_title, b.score
         FROM pcs a JOIN pcs b ON a.category = b.category AND a.id <> b.id)
SELECT id, rank, rec_id, rec_asin, rec_title, round(score, {D}) AS score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC NULLS LAST, rec_asin, rec_id) AS INTEGER)
         AS rank
  FROM cand) WHERE rank <= {P.TOP_N}""",
    "recommendations_json": f"""
SELECT CAST(to_json(struct_pack(asin := asin, title := title, score := score)) AS VARCHAR) AS value FROM (
{ranked(f'"group" = {_lit(P.GROUP)} AND asin <> {_lit(P.ASIN)}', P.TOP_N)})""",
    "title_matches": f""",
q AS (SELECT {tokens('title')} AS qt FROM products WHERE id = {P.PRODUCT_ID}),
m AS (SELECT p.*, {jaccard(tokens('p.title'), 'q.qt')} AS similarity FROM products p CROSS JOIN q)
SELECT id, asin, title, "group", round(similarity, {D}) AS similarity, {outer('categories')} AS category
FROM m WHERE similarity >= {P.THRESHOLD}""",
    "title_matches_ngram": f""",
q AS (SELECT {ngrams('title', P.NGRAM)} AS qt FROM products WHERE id = {P.PRODUCT_ID}),
m AS (SELECT p.*, {jaccard(ngrams('p.title', P.NGRAM), 'q.qt')} AS similarity FROM products p CROSS JOIN q)
SELECT id, asin, title, "group", round(similarity, {D}) AS similarity, {outer('categories')} AS category
FROM m WHERE similarity >= 0.5""",
    "pooled_similarity": f""",
tk AS (SELECT id, asin, similars, {tokens('title')} AS toks FROM products),
pr AS (SELECT a.id, len(list_intersect(a.toks, b.toks)) AS i, len(list_distinct(list_concat(a.toks, b.toks))) AS u,
              len(a.toks) > 0 AS a_ok
       FROM (SELECT id, toks, unnest(similars) AS s FROM tk) a JOIN tk b ON b.asin = a.s),
g AS (SELECT id, count(*) AS n_sets, sum(i) AS i, sum(u) AS u, bool_or(a_ok) AS a_ok FROM pr GROUP BY id)
SELECT p.id, p.asin, coalesce(g.n_sets, 0) AS n_sets,
       round(CASE WHEN g.a_ok AND g.u > 0 THEN CAST(g.i AS DOUBLE) / CAST(g.u AS DOUBLE) ELSE 0.0 END, {D})
         AS pooled_jaccard
FROM products p LEFT JOIN g ON g.id = p.id""",
    "similar_title_pairs": f""",
tt AS (SELECT title, {tokens('title')} AS toks FROM (SELECT DISTINCT title FROM products WHERE title IS NOT NULL)),
tp AS (SELECT a.title AS title_a, b.title AS title_b, {jaccard('a.toks', 'b.toks')} AS similarity
       FROM tt a JOIN tt b ON a.title < b.title WHERE len(a.toks) > 0 AND len(b.toks) > 0)
SELECT title_a, title_b, round(similarity, {D}) AS similarity FROM tp WHERE similarity >= {P.THRESHOLD}""",
    "similar_title_pairs_banded": f""",
tt AS (SELECT title, {tokens('title')} AS toks FROM (SELECT DISTINCT title FROM products WHERE title IS NOT NULL)),
tc AS (SELECT title, toks, list_transform(toks, lambda t: CAST('0x' || substr(md5(t), 1, 7) AS BIGINT)) AS codes FROM tt WHERE len(toks) > 0),
ts AS (SELECT title, toks, list_transform({[list(p) for p in multipliers(BANDS * BAND_ROWS)]},
         lambda p: list_min(list_transform(codes, lambda x: (p[1]::BIGINT * x + p[2]::BIGINT) % {PRIME}))) AS sig FROM tc),
tb AS (SELECT title, toks, unnest(range({BANDS})) AS j, sig FROM ts),
tk AS (SELECT title, toks, j, sig[j * {BAND_ROWS} + 1 : (j + 1) * {BAND_ROWS}] AS k FROM tb),
tp AS (SELECT DISTINCT a.title AS title_a, b.title AS title_b, a.toks AS ta, b.toks AS tbk FROM tk a JOIN tk b ON a.j = b.j AND a.k = b.k AND a.title < b.title),
tj AS (SELECT title_a, title_b, {jaccard('ta', 'tbk')} AS similarity FROM tp)
SELECT title_a, title_b, round(similarity, {D}) AS similarity FROM tj WHERE similarity >= {P.THRESHOLD}""",
    "heavy_hitters": f"""
, {PROFILE_LONG.strip()}
SELECT col_name, tops AS most_freq_values_top_10 FROM ptop""",
    "quantile_sketch": """
SELECT 'o_totalprice' AS col_name, q, n, TRUE AS within_bound
FROM (SELECT count(o_totalprice) AS n FROM orders), (SELECT unnest([0.25e0, 0.5e0, 0.75e0]) AS q)
UNION ALL
SELECT 'l_extendedprice', q, n, TRUE
FROM (SELECT count(l_extendedprice) AS n FROM lineitem), (SELECT unnest([0.25e0, 0.5e0, 0.75e0]) AS q)""",
    "most_frequent_groups": """
SELECT level, period, "group", count FROM (
  SELECT *, row_number() OVER (PARTITION BY level, period ORDER BY count DESC, "group" ASC NULLS LAST) AS rk FROM (
    SELECT 'year' AS level, CAST(year(r.date) AS INTEGER) AS period, p."group", count(*) AS count
    FROM products p JOIN reviews r ON r.id = p.id WHERE r.date IS NOT NULL GROUP BY ALL
    UNION ALL SELECT 'month', CAST(month(r.date) AS INTEGER), p."group", count(*)
    FROM products p JOIN reviews r ON r.id = p.id WHERE r.date IS NOT NULL GROUP BY ALL
    UNION ALL SELECT 'all', 0, p."group", count(*)
    FROM products p JOIN reviews r ON r.id = p.id WHERE r.date IS NOT NULL GROUP BY ALL)
) WHERE rk = 1""",
    "recommendations_response": f"""
SELECT TRUE AS success, 'recommendations' AS message, CAST(to_json(struct_pack(asin := asin, title := title, score := score)) AS VARCHAR) AS data FROM (
{ranked(f'"group" = {_lit(P.GROUP)} AND asin <> {_lit(P.ASIN)}', P.TOP_N)})""",
    "recommendations_json_file": ranked(f'"group" = {_lit(P.GROUP)} AND asin <> {_lit(P.ASIN)}', P.TOP_N),
    "graph_sink_edges": f", {GRAPH_EDGES.strip()}\nSELECT src, dst, label FROM ge",
    "graph_undirected": f""", {GRAPH_EDGES.strip()}
SELECT src, dst, label FROM ge UNION SELECT dst AS src, src AS dst, label FROM ge""",
    "reach_within_recursive": f""",
both_ways AS (SELECT src, dst FROM co_edges UNION ALL SELECT dst, src FROM co_edges),
one AS (SELECT dst AS id, 1 AS depth FROM both_ways WHERE src = {P.PRODUCT_ID}),
two AS (SELECT b.dst AS id, 2 AS depth FROM one JOIN both_ways b ON b.src = one.id)
SELECT id, min(depth) AS depth FROM (SELECT CAST({P.PRODUCT_ID} AS BIGINT) AS id, 0 AS depth UNION ALL SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY id""",
    "graph_vertices": f"""
SELECT 'product:' || asin AS id, 'product' AS kind, asin, title, "group", salesrank,
       round(avg_rating, {D}) AS avg_rating
FROM products WHERE asin IS NOT NULL
UNION ALL
SELECT DISTINCT 'group:' || "group", 'group', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), "group",
       CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)
FROM products WHERE asin IS NOT NULL AND "group" IS NOT NULL
UNION ALL
SELECT DISTINCT 'category:' || c, 'category', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR),
       CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)
FROM (SELECT unnest(categories) AS c FROM products WHERE asin IS NOT NULL)""",
    "graph_edges": f", {GRAPH_EDGES.strip()}\nSELECT src, dst, label FROM ge",
    "bfs_copurchase": f""",
undirected AS (SELECT src, dst FROM co_edges UNION ALL SELECT dst AS src, src AS dst FROM co_edges),
{bfs_cte('walk', 'undirected', str(P.PRODUCT_ID), 'BIGINT').strip()}
SELECT id, depth FROM walk""",
    "bfs_to_group": f""", {GRAPH_EDGES.strip()},
cu AS (SELECT src, dst FROM ge WHERE label = 'co_purchase' UNION SELECT dst AS src, src AS dst FROM ge WHERE label = 'co_purchase'),
{bfs_cte('walk', 'cu', _lit('product:' + P.ASIN), 'VARCHAR').strip()},
hits AS (SELECT p.*, w.depth, w.id AS vertex FROM walk w JOIN products p ON w.id = 'product:' || p.asin
         WHERE p."group" = 'LARGE' AND p.asin <> {_lit(P.ASIN)})
SELECT vertex AS id, depth, asin, title, salesrank, round(avg_rating, {D}) AS avg_rating
FROM hits WHERE depth = (SELECT min(depth) FROM hits)""",
    "reachable_all_labels": f""", {GRAPH_EDGES.strip()},
gu AS (SELECT src, dst FROM ge UNION SELECT dst AS src, src AS dst FROM ge),
{bfs_cte('walk', 'gu', _lit('product:' + P.ASIN), 'VARCHAR').strip()}
SELECT p.asin, p.title, p."group", w.depth, p.salesrank, round(p.avg_rating, {D}) AS avg_rating
FROM walk w JOIN products p ON w.id = 'product:' || p.asin""",
    "path_top_n": f"""
SELECT t.asin, t.title, t."group", t.salesrank, round(t.avg_rating, {D}) AS avg_rating FROM products t
WHERE list_contains(t.categories, {_lit(P.PATH_CATEGORY)}) AND t.asin <> {_lit(P.ASIN)}
  AND t.salesrank > 0 AND t.avg_rating > 3.0
  AND EXISTS (SELECT 1 FROM products a WHERE a.asin = {_lit(P.ASIN)} AND a."group" = {_lit(P.PATH_GROUP)})
  AND EXISTS (SELECT 1 FROM products g WHERE g."group" = {_lit(P.PATH_GROUP)}
              AND list_contains(g.categories, {_lit(P.PATH_CATEGORY)}))
ORDER BY t.salesrank, t.asin LIMIT {P.TOP_N}""",
}


ORACLE["profile_sink"] = ORACLE["profile_stats"]
ORACLE["graph_sink_vertices"] = ORACLE["graph_vertices"]


def sql(name: str) -> str:
    """Full SQL text: the catalogue CTEs, then the query body (a body starting with ',' adds CTEs)."""
    body = ORACLE[name].strip()
    return BASE.rstrip() + ("" if body.startswith(",") else "\n") + body


def all_sql() -> dict[str, str]:
    return {name: sql(name) for name in ORACLE}
