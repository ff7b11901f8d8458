"""Title similarity: one title against the catalogue, pooled Jaccard, and an exact all-pairs join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.sets import jaccard, jaccard_from_sizes, tokens

# Fixed value: the recommenders' title-similarity threshold.
DEFAULT_THRESHOLD = 0.3
EPS = 1e-9


def char_ngrams(text: str | Column, n: int = 3) -> Column:
    """Distinct lower-cased character n-grams; a text shorter than n is its own single gram.

    A zero-width lookahead match at every position captures the n characters that follow it, so one
    linear regex pass yields all overlapping grams (a lambda over positions would recompute the text for
    every gram).
    """
    t = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    grams = F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{int(n)}}}))"), 1)
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).when(
        F.length(t) < n, F.array(t)
    ).otherwise(F.array_distinct(grams))


def set_of(title: str | Column, ngram: int | None) -> Column:
    """The title's set: word tokens, or character n-grams."""
    return tokens(title) if ngram is None else char_ngrams(title, ngram)


def similar_titles(
    products: DataFrame, product_id, threshold: float = DEFAULT_THRESHOLD, ngram: int | None = None,
    include_self: bool = True, index=None,
) -> DataFrame:
    """Catalogue rows whose title set is at least ``threshold`` Jaccard-similar to one product's title, with
    ``similarity``; products without categories stay.

    The query's set is a scalar subquery (one product's title set, computed once), so the scan of the catalogue is a
    single projection and filter with no join or shuffle. Word tokens by default; character n-grams with ``ngram=n``.
    With a ``title_index.TitleIndex`` of the same sets only the postings of the title's rarest tokens are read.
    """
    if index is not None:
        if index.ngram != ngram:
            raise ValueError("the index holds other sets")
        return index.similar_titles(products, product_id, threshold, include_self)
    query = products.where(F.col("id") == F.lit(int(product_id))).select(
        F.array_distinct(F.flatten(F.collect_list(set_of(F.col("title"), ngram))))
    ).scalar()
    # the query set and each title's set are projected once, then compared (one subquery reference)
    sets = products.withColumn("_q", query).withColumn("_t", set_of(F.col("title"), ngram))
    out = sets.withColumn("similarity", jaccard("_t", "_q")).where(F.col("similarity") >= F.lit(threshold))
    if not include_self:
        out = out.where(F.col("id") != F.lit(int(product_id)))
    return out.drop("_q", "_t")


def title_matches(
    products: DataFrame, product_id, threshold: float = DEFAULT_THRESHOLD, ngram: int | None = None,
    include_self: bool = True, index=None,
) -> DataFrame:
    """``similar_titles`` with their categories: ``id, asin, title, group, salesrank, total_reviews, avg_rating,
    similarity, category``, one row per category, and one with a null category for a product that has none. With a
    ``title_index.TitleIndex`` of the same sets, read from its postings instead of the catalogue."""
    found = similar_titles(products, product_id, threshold, ngram, include_self, index)
    return found.select(
        "id", "asin", "title", "group", "salesrank", "total_reviews", "avg_rating", "similarity",
        F.explode_outer("categories").alias("category"),
    )


def pooled_similarity(products: DataFrame) -> DataFrame:
    """For every product, the pooled Jaccard of its title against its similars' titles:
    ``Σ|A ∩ Sᵢ| / Σ|A ∪ Sᵢ|`` over the similars found in the catalogue.

    ``id, asin, n_sets, pooled_jaccard``; 0.0 for a product whose title or similar list is empty. Computed from
    per-pair intersection and union sizes summed by a grouped aggregate, so no list is built per product.
    """
    base = products.select("id", "asin", tokens("title").alias("_a"), "similars")
    pairs = base.select("id", "asin", "_a", F.explode("similars").alias("_s_asin"))
    other = products.select(F.col("asin").alias("_s_asin"), tokens("title").alias("_b"))
    sized = pairs.join(other, "_s_asin").select(
        "id", "asin",
        F.size(F.array_intersect("_a", "_b")).alias("_i"),
        F.size(F.array_union("_a", "_b")).alias("_u"),
        (F.size("_a") > 0).alias("_a_ok"),
    )
    agg = sized.groupBy("id", "asin").agg(
        F.count(F.lit(1)).alias("n_sets"), F.sum("_i").alias("_i"), F.sum("_u").alias("_u"),
        F.max("_a_ok").alias("_a_ok"),
    )
    scored = agg.select(
        "id", "asin", "n_sets",
        F.when(F.col("_a_ok") & (F.col("_u") > 0), F.col("_i").cast("double") / F.col("_u")).otherwise(0.0)
        .alias("pooled_jaccard"),
    )
    missing = products.select("id", "asin").join(scored.select("id"), "id", "left_anti").select(
        "id", "asin", F.lit(0).cast("bigint").alias("n_sets"), F.lit(0.0).alias("pooled_jaccard")
    )
    return scored.unionByName(missing)


# Fixed value: titles of one prefix token that are joined as one block.
POSTINGS_BLOCK = 2000


def similar_title_pairs(
    products: DataFrame, threshold: float = DEFAULT_THRESHOLD, ngram: int | None = None,
    block: int = POSTINGS_BLOCK,
) -> DataFrame:
    """All pairs of distinct titles with set Jaccard >= ``threshold``: ``title_a < title_b, similarity``.

    Exact set-similarity self-join: titles are deduplicated first (products sharing a title share all its
    matches); each set is ordered by global token frequency (rarest first) and only its prefix of
    ``|s| - ceil(t·|s|) + 1`` tokens is joined — two sets with Jaccard >= t must share a prefix token; a
    length filter ``t·|a| <= |b| <= |a|/t`` prunes more; every candidate is verified exactly.

    A prefix token shared by many titles is a grid: its titles are dealt to ``ceil(postings / block)`` blocks by a
    hash, and each cell (block, block) is joined on its own, so each pair is made exactly once, a title is copied
    once per block and no task pairs more than ``block`` by ``block`` titles of a token.
    """
    t = _checked(threshold)
    titles = _title_sets(products, ngram)
    exploded = titles.select("title", F.size("toks").alias("n"), F.explode("toks").alias("tok"))
    freq = exploded.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    # per title: tokens sorted by (frequency, token); the struct sort is inside one row, no shuffle
    ordered = exploded.join(freq, "tok").groupBy("title", "n").agg(
        F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("_ord")
    )
    # EPS keeps 0.3 * 10 = 3.0000000000000004 from rounding a bound up past an exact match
    plen = F.col("n") - F.ceil(F.lit(t) * F.col("n") - F.lit(EPS)) + F.lit(1)
    prefix = ordered.select("title", "n", F.explode(F.slice("_ord", 1, plen)).alias("_e")).select(
        "title", "n", F.col("_e.tok").alias("tok")
    )
    return _verified(_candidates(prefix, t, block), titles, t)


def _checked(threshold: float) -> float:
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    return float(threshold)


def _title_sets(products: DataFrame, ngram: int | None) -> DataFrame:
    """``title, toks``: every distinct title with a set that is not empty."""
    titles = products.select("title").where(F.col("title").isNotNull()).distinct()
    return titles.select("title", set_of("title", ngram).alias("toks")).where(F.size("toks") > 0)


def _candidates(keyed: DataFrame, t: float, block: int) -> DataFrame:
    """``title_a < title_b``: titles of ``keyed`` (``title, n, tok``) that share a key and whose set sizes allow the
    threshold, each pair once; a key with many titles is a grid of blocks."""
    postings = keyed.groupBy("tok").agg(F.ceil(F.count(F.lit(1)) / F.lit(int(block))).cast("int").alias("_k"))
    dealt = keyed.join(postings, "tok").withColumn("_b", F.pmod(F.xxhash64("title"), F.col("_k")).cast("int"))
    # a pair (x, y) of titles in blocks (i, j) is made in cell (min, max) only: the row with the smaller block on the left
    a = dealt.select("title", "n", "tok", F.col("_b").alias("x"), F.explode(F.sequence(F.col("_b"), F.col("_k") - 1)).alias("y")).alias("a")
    b = dealt.select("title", "n", "tok", F.col("_b").alias("y"), F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("x")).alias("b")
    cell = (F.col("a.tok") == F.col("b.tok")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y"))
    once = (F.col("a.x") < F.col("a.y")) | (F.col("a.title") < F.col("b.title"))
    return a.join(b, cell).where(
        once
        & (F.col("b.n") >= F.lit(t) * F.col("a.n") - F.lit(EPS))
        & (F.col("b.n") <= F.col("a.n") / F.lit(t) + F.lit(EPS))
    ).select(F.least("a.title", "b.title").alias("title_a"), F.greatest("a.title", "b.title").alias("title_b")).distinct()


def _verified(cands: DataFrame, titles: DataFrame, t: float) -> DataFrame:
    """The candidate pairs whose exact similarity is at least ``t``, with it."""
    ta = titles.select(F.col("title").alias("title_a"), F.col("toks").alias("_ta"))
    tb = titles.select(F.col("title").alias("title_b"), F.col("toks").alias("_tb"))
    verified = cands.join(ta, "title_a").join(tb, "title_b").select(
        "title_a", "title_b",
        jaccard_from_sizes(F.size(F.array_intersect("_ta", "_tb")), F.size("_ta"), F.size("_tb")).alias("similarity"),
    )
    return verified.where(F.col("similarity") >= F.lit(t))


# Fixed values of the signatures: a prime above all token codes (28 bits of md5), and the shape of the bands: a pair at
# the threshold 0.3 shares one of 30 bands of 2 with probability 1 - (1 - 0.09) ** 30 = 0.94, any above it more likely.
PRIME = 2_147_483_647
BANDS, BAND_ROWS = 30, 2


def multipliers(n: int) -> list[tuple[int, int]]:
    """``n`` pairs (factor, addend) below ``PRIME``, by a rule."""
    return [((i + 1) * 1_103_515_245 % (PRIME - 1) + 1, (i + 1) * 12_820_163 % PRIME) for i in range(n)]


def minhash(toks: Column, n: int) -> Column:
    """``n`` minima of ``(factor * code + addend) mod PRIME`` over the token codes (md5's first 28 bits)."""
    codes = F.transform(toks, lambda t: F.conv(F.substring(F.md5(t), 1, 7), 16, 10).cast("long"))
    pairs = F.array(*(F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in multipliers(n)))
    return F.transform(pairs, lambda p: F.array_min(F.transform(codes, lambda x: (p["a"] * x + p["b"]) % F.lit(PRIME))))


def similar_title_pairs_banded(
    products: DataFrame, threshold: float = DEFAULT_THRESHOLD, ngram: int | None = None, bands: int = BANDS, band_rows: int = BAND_ROWS,
    block: int = POSTINGS_BLOCK,
) -> DataFrame:
    """``similar_title_pairs`` by MinHash banding: most of the pairs (a pair of similarity s with probability ``1 - (1 - s **
    band_rows) ** bands``), every one verified exactly, none below the threshold. No token counts and no sort of each
    title's tokens; a title is joined under ``bands`` keys whatever its length."""
    t = _checked(threshold)
    titles = _title_sets(products, ngram)
    signed = titles.select("title", F.size("toks").alias("n"), minhash(F.col("toks"), bands * band_rows).alias("_sig"))
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda j: F.concat_ws(":", j.cast("string"), F.slice(F.col("_sig"), j * band_rows + 1, band_rows).cast("array<string>")))
    return _verified(_candidates(signed.select("title", "n", F.explode(keys).alias("tok")), t, block), titles, t)
