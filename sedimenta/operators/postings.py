"""A stored inverted index for BM25: a query reads the postings of its terms, not the corpus.

Postings (term, key, tf, dl) lie in folders by a bucket of the term, sorted by term, so that a search
prunes folders and row groups. A frequent term's list is written by several tasks (salted by key).
Corpus statistics and document frequencies are stored beside them and cover all rows with text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions import text as T
from sedimenta.operators.retrieval import K1, B
from sedimenta.sources.tables import spread

BUCKETS, SALTS = 32, 4


class PostingsIndex:
    """An index below ``root``; ``build`` writes a new version and names it last, ``open`` reads that one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._about = spark, path, None

    @classmethod
    def build(cls, df: DataFrame, key: str, text: str, root: str, buckets: int = BUCKETS, fixed: bool = False) -> PostingsIndex:
        """Index every row with text below ``root`` (at ``root`` if ``fixed``). Rows without tokens count in the statistics; null texts do not."""
        spark = df.sparkSession
        path = root.rstrip("/") if fixed else f"{root.rstrip('/')}/{uuid.uuid4().hex}"
        tok = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text"))).where("text IS NOT NULL")
        tok = tok.select("key", T.tokens(F.col("text")).alias("t")).select("key", F.size("t").alias("dl"), "t")
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")
        # the tokens of a row are in one partition: the partial counts are whole before they are shuffled
        postings = tok.select("key", "dl", F.explode("t").alias("term")).groupBy("term", "key", "dl").agg(F.count("*").cast("int").alias("tf"))
        postings = postings.withColumn("bucket", bucket).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
        postings = postings.repartition(buckets * SALTS, "bucket", "salt").drop("salt").sortWithinPartitions("bucket", "term", "key")
        postings.write.partitionBy("bucket").parquet(f"{path}/postings")
        stored = spark.read.schema("term string, bucket int").parquet(f"{path}/postings")
        stored.groupBy("bucket", "term").agg(F.count("*").alias("n_docs")).repartition(buckets, "bucket").sortWithinPartitions("term").write.partitionBy("bucket").parquet(f"{path}/terms")
        tok.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_len"), F.lit(buckets).alias("buckets"), F.lit(df.schema[key].dataType.simpleString()).alias("key_type")).coalesce(1).write.parquet(f"{path}/stats")
        return cls(spark, path)

    def _stats(self):
        if self._about is None:
            self._about = self.spark.read.parquet(f"{self.path}/stats").first()
        return self._about

    def search(self, query: str, limit: int = 10) -> DataFrame:
        """key and score of the best rows, best first; the scores are those of ``retrieval.bm25``."""
        return self.scores(query).orderBy(F.desc("score"), "key").limit(limit)

    def scores(self, query: str) -> DataFrame:
        """key and score of the rows that hold a term of the query."""
        terms, stats = T.query_terms(query), self._stats()
        # an empty index has no files to take the types from
        postings = self.spark.read.schema(f"key {stats['key_type']}, dl int, term string, tf int, bucket int").parquet(f"{self.path}/postings")
        if not terms or not stats["n_docs"]:
            return postings.select("key", F.lit(0.0).alias("score")).limit(0)
        where = self.spark.range(1).select(F.array(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(stats["buckets"])).cast("int") for t in terms]).alias("b")).first()["b"]
        mine = F.col("bucket").isin(*sorted(set(where))) & F.col("term").isin(*terms)
        known = {r.term: r.n_docs for r in self.spark.read.schema("term string, n_docs long, bucket int").parquet(f"{self.path}/terms").where(mine).collect()}  # one row for each query term
        n, avg = float(stats["n_docs"]), float(stats["avg_len"])
        idf = F.element_at(F.create_map(*[x for t in terms for x in (F.lit(t), F.log(F.lit(1.0 + (n - known.get(t, 0) + 0.5) / (known.get(t, 0) + 0.5))))]), F.col("term"))
        tf = F.col("tf").cast("double")
        part = idf * tf * F.lit(K1 + 1.0) / (tf + F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * F.col("dl").cast("double") / F.lit(avg)))
        return postings.where(mine).groupBy("key").agg(F.round(F.sum(part), 6).alias("score"))
