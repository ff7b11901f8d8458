"""Product dump reader: record framing, field extraction, reviews, edge list."""

from __future__ import annotations

import datetime as dt
import os

from basketry.sources import dump

PREAMBLE = "# Full information about products\nTotal items: 3\n\n"

RECORD_1 = """Id:   1
ASIN: 082722953X
  title: Identity of Rivers: Id and Ego
  group: Baby Product
  salesrank: 396585
  similar: 2  0804215715  156101074X
  categories: 2
   |Books[1]|Subjects[2]|Rivers[3]
   |Books[1]|Travel[4]
  reviews: total: 2  downloaded: 2  avg rating: 4.5
    2000-7-28  cutomer: A2JW67  rating: 5  votes:  10  helpful:   9
    2003-12-14  cutomer: A2VE83  rating: 4  votes:   0  helpful:   0
"""

RECORD_2 = """Id:   2
ASIN: 0771044445
  discontinued product
"""

TWELVE = "\n".join(f"   |Music[{i}]|Style[{i}]" for i in range(12))
RECORD_3 = f"""Id:   3
ASIN: 0000000003
  title: Plain
  group: Music
  salesrank: -1
  similar: 0
  categories: 12
{TWELVE}
  reviews: total: 0  downloaded: 0  avg rating: 0
"""

RECORD_4 = """Id:   4
ASIN: B00000000X
  title: No Categories
  group: DVD
  salesrank: 7
  similar: 1  0000000003
  categories: 0
  reviews: total: 1  downloaded: 1  avg rating: 3
    1999-1-2  cutomer: C1  rating: 3  votes:   0  helpful:   0
"""


def write(path: str, text: str, crlf: bool = False) -> None:
    with open(path, "w", newline="") as f:
        f.write(text.replace("\n", "\r\n") if crlf else text)


def by_id(df):
    return {r["id"]: r for r in df.collect()}


def check_products(rows):
    assert sorted(rows) == [1, 2, 3, 4]
    r1 = rows[1]
    assert r1["asin"] == "082722953X"
    assert r1["title"] == "Identity of Rivers: Id and Ego"  # "Id" inside a title starts no record
    assert r1["group"] == "Baby Product"
    assert r1["salesrank"] == 396585.0
    assert r1["similars"] == ["0804215715", "156101074X"]
    assert r1["categories"] == ["|Books[1]|Subjects[2]|Rivers[3]", "|Books[1]|Travel[4]"]
    assert r1["category_1"] == "|Books[1]|Subjects[2]|Rivers[3]" and r1["category_3"] is None
    assert r1["total_reviews"] == 2 and r1["avg_rating"] == 4.5
    r2 = rows[2]
    assert r2["asin"] == "0771044445" and r2["title"] is None and r2["group"] is None
    assert r2["similars"] == [] and r2["categories"] == [] and r2["total_reviews"] is None
    r3 = rows[3]
    assert r3["salesrank"] is None  # negative rank is no rank
    assert r3["similars"] == [] and len(r3["categories"]) == 12
    assert r3["category_6"] == "|Music[5]|Style[5]"
    r4 = rows[4]
    assert r4["asin"] == "B00000000X" and r4["categories"] == [] and r4["similars"] == ["0000000003"]


def test_records_with_preamble(spark, scratch):
    path = os.path.join(scratch, "dump.txt")
    write(path, PREAMBLE + RECORD_1 + "\n" + RECORD_2 + "\n" + RECORD_3 + "\n" + RECORD_4)
    check_products(by_id(dump.read_products(spark, path)))


def test_records_without_preamble_crlf(spark, scratch):
    path = os.path.join(scratch, "dump.txt")
    write(path, RECORD_1 + "\n" + RECORD_2 + "\n" + RECORD_3 + "\n" + RECORD_4, crlf=True)
    check_products(by_id(dump.read_products(spark, path)))


def test_last_record_without_trailing_newline(spark, scratch):
    path = os.path.join(scratch, "dump.txt")
    write(path, RECORD_1 + "\n" + RECORD_4.rstrip("\n"))
    rows = by_id(dump.read_products(spark, path))
    assert sorted(rows) == [1, 4]
    assert rows[4]["total_reviews"] == 1


def test_reviews(spark, scratch):
    path = os.path.join(scratch, "dump.txt")
    write(path, PREAMBLE + RECORD_1 + "\n" + RECORD_2 + "\n" + RECORD_4, crlf=True)
    rows = sorted(tuple(r) for r in dump.read_reviews(spark, path).collect())
    assert rows == [
        (1, dt.date(2000, 7, 28), "A2JW67", 5, 10, 9),
        (1, dt.date(2003, 12, 14), "A2VE83", 4, 0, 0),
        (4, dt.date(1999, 1, 2), "C1", 3, 0, 0),
    ]


def test_many_small_splits_read_every_record_once(spark, scratch):
    path = os.path.join(scratch, "big.txt")
    body = "".join(RECORD_4.replace("Id:   4", f"Id:   {i}") + "\n" for i in range(1, 2001))
    write(path, PREAMBLE + body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        recs = dump.read_records(spark, path)
        assert recs.rdd.getNumPartitions() > 20
        ids = [r["id"] for r in dump.parse_products(recs).select("id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(ids) == list(range(1, 2001))


def test_rating_words_in_a_title_are_no_rating(spark, scratch):
    path = os.path.join(scratch, "dump.txt")
    write(path, "Id:   1\nASIN: A\n  title: Best avg rating: 1.5 ever\n  reviews: total: 2  downloaded: 2  avg rating: 4.5\n"
                "\nId:   2\nASIN: B\n  title: reviews avg rating: 2\n")
    got = {r.id: r.avg_rating for r in dump.read_products(spark, path).collect()}
    assert got == {1: 4.5, 2: None}


def test_edge_list(spark, scratch):
    path = os.path.join(scratch, "edges.txt")
    write(path, "# Directed graph\n# FromNodeId\tToNodeId\n1\t2\n2\t1\n1\t2\n3\t4\n5\t5\n")
    el = dump.read_edge_list(spark, path)
    assert el.count() == 5
    und = sorted(tuple(r) for r in dump.undirected_edges(el).collect())
    assert und == [(1, 2, 3), (3, 4, 1)]


def test_text_scan(spark, scratch):
    path = os.path.join(scratch, "dump.txt")
    write(path, RECORD_2)
    assert dump.read_text(spark, path).count() == 3


def test_record_with_many_reviews(spark, scratch):
    lines = "".join(f"    2001-{1 + i % 12}-{1 + i % 28}  cutomer: C{i}  rating: {1 + i % 5}  votes: {i % 9}  helpful: {i % 4}\n"
                    for i in range(3000))
    path = os.path.join(scratch, "dump.txt")
    write(path, RECORD_2 + "\n" + RECORD_1.split("  reviews:")[0] + "  reviews: total: 3000  downloaded: 3000  avg rating: 3\n" + lines)
    reviews = dump.read_reviews(spark, path)
    assert reviews.count() == 3000
    assert reviews.where("customer = 'C2999' AND rating = 5 AND votes = 2 AND helpful = 3").count() == 1
    from pyspark.sql import functions as F
    from basketry.functions import fields
    nested = dump.read_records(spark, path).select(F.size(fields.reviews(F.col("value"))).alias("n")).collect()
    assert sorted(r.n for r in nested) == [0, 3000]
