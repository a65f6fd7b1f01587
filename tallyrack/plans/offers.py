"""Offers derived from part: constructed records, the same text in both dialects, as pages hold no listings."""

from __future__ import annotations

from .tables import query

#: Raw records from part: noisy titles, several spellings of each field, some invalid.
OFFERS = """
SELECT p_partkey AS idx,
  CASE p_partkey % 7 WHEN 0 THEN 'Add to Compare ' WHEN 3 THEN 'Trending: ' ELSE '' END
    || CASE p_partkey % 5 WHEN 0 THEN 'Lenovo IdeaPad ' WHEN 1 THEN 'HP Pavilion ' WHEN 2 THEN 'Samsung Galaxy S' WHEN 3 THEN 'APPLE MacBook Air ' ELSE 'Nova Phone ' END
    || cast(p_size % 9 + 1 AS varchar(10))
    || CASE p_partkey % 4 WHEN 0 THEN ' (8 GB/512 GB SSD) Intel Core i5' WHEN 1 THEN ' 16 GB RAM 1 TB HDD Ryzen 7' WHEN 2 THEN ' - (128 GB) 6 GB RAM Snapdragon 888' ELSE ' M2 Pro 8gb 256gb' END
    || CASE p_partkey % 3 WHEN 0 THEN ' 15.6 inch 4.3 1,204 Ratings & 120 Reviews' WHEN 1 THEN ' 39.6 cm laptop' ELSE '' END AS title,
  'Bank Offer 5% off. Was ' || cast(p_size * 1000 AS varchar(20)) || CASE p_partkey % 2 WHEN 0 THEN ' Windows 11 laptop' ELSE ' Android mobile' END AS description,
  CASE p_partkey % 6 WHEN 0 THEN 'hp' WHEN 1 THEN 'unknown' END AS brand,
  CASE p_partkey % 8 WHEN 0 THEN 'Laptops' WHEN 1 THEN 'Mobiles' END AS category,
  CASE WHEN p_partkey % 10 = 0 THEN 'Rs. ' || cast(p_size AS varchar(10)) ELSE 'Rs. ' || cast(p_size * 1000 + 9000 AS varchar(20)) || '/-' END AS price,
  CASE p_partkey % 4 WHEN 0 THEN '4,2 out of 5' WHEN 1 THEN '9.9' END AS rating,
  CASE p_partkey % 5 WHEN 0 THEN '2.5k' WHEN 1 THEN '1,024' END AS review_count,
  CASE p_partkey % 6 WHEN 0 THEN 'In Stock' WHEN 1 THEN 'Sold out' WHEN 2 THEN 'Coming soon' END AS availability,
  CASE WHEN p_partkey % 11 = 0 THEN 'https://Shop.example.com/search?q=' || cast(p_partkey AS varchar(20))
    WHEN p_partkey % 2 = 0 THEN 'HTTP://www.Example.com//item-' || cast(p_size AS varchar(10)) || '/p/' || cast(p_partkey AS varchar(20)) || '/?pid=' || cast(p_partkey AS varchar(20)) || '#top'
    ELSE '//m.example.org/laptop-8gb-256gb-ssd/' || cast(p_partkey AS varchar(20)) END AS product_url
FROM part"""
MISSING = ("specs", "details", "subtitle", "breadcrumbs", "model", "variant", "ram", "storage", "processor", "display", "os", "rating_text", "review_text", "url", "link", "price_inr")


def duck_source() -> str:
    return f"SELECT *, {', '.join(f'cast(NULL AS varchar) AS {c}' for c in MISSING)} FROM ({OFFERS})"


def offers(spark, sf_dir: str):
    """A row costs much more than it weighs: the few files of `part` are dealt out to all cores."""
    return query(spark, sf_dir, OFFERS, ("part",)).repartition(spark.sparkContext.defaultParallelism)
