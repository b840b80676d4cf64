"""The reference's entities as stand-ins on the driver's tables, for Spark and
for SQL: parts are tracks, brands albums, suppliers artists, orders likes and
queue rows, line items analyses, events play facts, documents titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def tracks(self) -> DataFrame:
        return self.part.select(
            F.col("p_partkey").alias("id"), F.col("p_brand").alias("album_id"), F.nullif(F.col("p_size").cast("bigint"), F.lit(7).cast("bigint")).alias("artist_id"),
            F.col("p_name").alias("title"), (F.col("p_size") * 10).cast("bigint").alias("duration"), F.lit(None).cast("string").alias("isrc"), (F.col("p_partkey") % 5).alias("seed_distance"),
        )

    def artists(self) -> DataFrame:
        return self.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))

    def albums(self) -> DataFrame:
        return self.part.groupBy(F.col("p_brand").alias("id")).agg(F.upper(F.min("p_brand")).alias("title"), F.min("p_type").alias("genre"), F.concat(F.lit("2024-01-"), F.lpad((F.min("p_size") % 28 + 1).cast("string"), 2, "0")).alias("release_date"), F.nullif(F.min("p_size").cast("bigint"), F.lit(2).cast("bigint")).alias("artist_id"))

    def blocked(self) -> DataFrame:
        return self.supplier.filter("s_acctbal < 2000").select(F.col("s_suppkey").alias("artist_id"), F.col("s_name").alias("name"))

    def features(self) -> DataFrame:
        return self.lineitem.filter("l_returnflag = 'A'").groupBy(F.col("l_partkey").alias("track_id")).agg(F.max("l_linestatus").alias("extractor_version"))

    def failures(self) -> DataFrame:
        return self.lineitem.filter("l_linenumber = 7 AND l_returnflag = 'R'").select(F.col("l_partkey").alias("track_id")).distinct()

    def likes(self) -> DataFrame:
        return self.orders.select(
            F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderpriority").startswith("1"), "track").otherwise("artist").alias("kind"),
            (F.col("o_orderkey") % 50).alias("ref_id"), F.unix_timestamp("o_orderdate").alias("liked_at"), F.nullif("o_orderstatus", F.lit("P")).alias("item_json"),
        )

    def queue(self) -> DataFrame:
        return self.orders.select(F.col("o_orderkey").alias("track_id"), F.substring("o_orderpriority", 1, 1).cast("bigint").alias("priority"), F.col("o_orderpriority").alias("reason"), F.col("o_orderkey").alias("seq"))

    def rows(self) -> DataFrame:
        """The catalogue in order, with names."""
        t = self.tracks().join(self.artists().select(F.col("id").alias("artist_id"), F.col("name").alias("artist")), "artist_id", "left")
        t = t.join(self.albums().select(F.col("id").alias("album_id"), F.col("title").alias("album"), "genre"), "album_id")
        return t.select(F.col("id").alias("row_no"), "id", F.coalesce("artist_id", F.lit(-1).cast("bigint")).alias("artist_id"), "album_id", "title", F.coalesce("artist", F.lit("")).alias("artist"), "album", "genre", "duration")

    def space(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").alias("row_no"), F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("artist_id"), (F.col("vec_id") % 40).cast("string").alias("album_id"), F.floor(F.col("vec_id") / 2).alias("recording"), F.lit(None).cast("double").alias("bpm"), F.col("embedding").alias("unit"), F.col("embedding").alias("clap"))

    def places(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").alias("row_no"), F.col("vec_id").alias("id"), F.col("label").cast("string").alias("genre"), (F.floor(F.col("embedding")[0].cast("double") * 4096) / 64).alias("x"), (F.floor(F.col("embedding")[1].cast("double") * 4096) / 64).alias("y"))


#: The same as common table expressions.
SQL = r"""
tracks AS (SELECT p_partkey AS id, p_brand AS album_id, nullif(p_size, 7)::BIGINT AS artist_id, p_name AS title, (p_size * 10)::BIGINT AS duration, p_partkey % 5 AS seed_distance FROM part),
artists AS (SELECT s_suppkey AS id, s_name AS name FROM supplier),
albums AS (SELECT p_brand AS id, upper(min(p_brand)) AS title, min(p_type) AS genre, '2024-01-' || lpad((min(p_size) % 28 + 1)::VARCHAR, 2, '0') AS release_date, nullif(min(p_size), 2)::BIGINT AS artist_id FROM part GROUP BY p_brand),
blocked AS (SELECT s_suppkey AS artist_id, s_name AS name FROM supplier WHERE s_acctbal < 2000),
features AS (SELECT l_partkey AS track_id, max(l_linestatus) AS extractor_version FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_partkey),
failures AS (SELECT DISTINCT l_partkey AS track_id FROM lineitem WHERE l_linenumber = 7 AND l_returnflag = 'R'),
likes AS (SELECT o_custkey AS user_id, CASE WHEN o_orderpriority LIKE '1%' THEN 'track' ELSE 'artist' END AS kind, o_orderkey % 50 AS ref_id, epoch(o_orderdate)::BIGINT AS liked_at, nullif(o_orderstatus, 'P') AS item_json FROM orders),
queue AS (SELECT o_orderkey AS track_id, o_orderpriority[1:1]::BIGINT AS priority, o_orderpriority AS reason, o_orderkey AS seq FROM orders),
cat AS (SELECT t.id AS row_no, t.id, coalesce(t.artist_id, -1) AS artist_id, t.album_id, t.title, coalesce(a.name, '') AS artist, b.title AS album, b.genre, t.duration
        FROM tracks t LEFT JOIN artists a ON a.id = t.artist_id JOIN albums b ON b.id = t.album_id),
space AS (SELECT vec_id AS row_no, vec_id AS id, label::BIGINT AS artist_id, vec_id % 40 AS album_id, vec_id // 2 AS recording, embedding::DOUBLE[] AS unit FROM embeddings),
places AS (SELECT vec_id AS row_no, vec_id AS id, label::VARCHAR AS genre, floor(embedding[1]::DOUBLE * 4096) / 64 AS x, floor(embedding[2]::DOUBLE * 4096) / 64 AS y FROM embeddings)
"""
