"""A posting index: terms to documents in blocks, built once and appended, and top-k searches that skip blocks.

A folder holds two tables in batches: `documents` (part, key, dl, words), and `postings`, dealt to files by term and shard and sorted
by term, so that a search for a term reads the row groups that may hold it. A posting block has the documents of one (term,
part) whose frequencies, and whose lengths, lie within a factor of two, dealt by key where they are many; beside them
stand how many they are and the least and largest frequency and length. A score grows with the frequency and falls
with the length, so these figures bound it from both sides without the documents being read.

A batch counts once it is listed in `done`, which is written last: a build that fails leaves nothing that a search sees.
Documents whose (part, key) is there already are not added again; those without a key are kept, but have no postings and count for no statistics.

Score: BM25 with IDF = ln(1 + (N - df + 0.5) / (df + 0.5)), k1 = 1.2, b = 0.75; N, df and the mean length are of the part
(the entity that is searched in), over all batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators.retrieval import B, K1, frequent_new_terms, tokens
from ledgerline.shipping import ship
from ledgerline.storage import exists, shared_dir, written

#: Documents of a part that share one block at most, on average.
BLOCK_DOCS = 50_000
#: Words of a shuffle partition when postings are made, on average, so that a task sorts them within its memory.
TASK_WORDS = 4_000_000
#: Terms of a table of terms that are listed as a filter on the postings; of more, all blocks are met by the join.
LISTED_TERMS = 1000
BLOCK = ("batch", "term", "part", "tf_class", "dl_class", "shard")
#: What rounding may take from a bound.
SLACK = 1e-9


def impact(tf: Column, dl: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


def counted(docs: DataFrame) -> DataFrame:
    """(part, key, dl, term, tf) of documents (part, key, dl, words), counted where they lie: a document is one row, so nothing
    is shuffled. Rows that share part, key and dl are put together first."""
    ship(docs.sparkSession)
    again = docs.groupBy("part", "key", "dl").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*[F.col(c).alias(f"__{c}") for c in ("part", "key", "dl")])
    if not again.isEmpty():
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("part", "key", "dl")]
        joined = docs.join(again, same, "left_semi").groupBy("part", "key", "dl").agg(F.flatten(F.collect_list("words")).alias("words"))
        docs = docs.join(again, same, "left_anti").select("part", "key", "dl", "words").unionByName(joined)
    schema = T.StructType([*(docs.schema[c] for c in ("part", "key", "dl")), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            words = batch.column(3)
            flat = words.flatten().dictionary_encode()
            if not len(flat):
                continue
            row = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
            met, tf = np.unique(row * len(flat.dictionary) + flat.indices.to_numpy(), return_counts=True)
            at, term = np.divmod(met, len(flat.dictionary))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(at)) for i in range(3)), flat.dictionary.take(pa.array(term)), pa.array(tf, pa.int64())], ["part", "key", "dl", "term", "tf"])

    return docs.select("part", "key", "dl", "words").mapInArrow(run, schema)


class PostingIndex:
    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or shared_dir(spark, "postings")

    def batches(self) -> list[str]:
        """One row a batch."""
        if not exists(self.spark, f"{self.path}/done"):
            return []
        return [r.batch for r in self.spark.read.schema("batch string").json(f"{self.path}/done").collect()]

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}").where(F.col("batch").isin(self.batches()))

    def documents(self) -> DataFrame:
        return self._read("documents")

    def postings(self) -> DataFrame:
        return self._read("postings")

    def append(self, docs: DataFrame, key: str, part: str, text: str, block_docs: int = BLOCK_DOCS) -> None:
        batch = f"b{uuid.uuid4().hex}"
        rows = docs.select(F.col(part).alias("part"), F.col(key).alias("key"), tokens(F.col(text)).alias("words")).withColumn("dl", F.size("words").cast("bigint"))
        if self.batches():
            rows = rows.join(self.documents().select("part", "key"), ["part", "key"], "left_anti")
        rows.write.parquet(f"{self.path}/documents/batch={batch}")
        own = self.spark.read.parquet(f"{self.path}/documents/batch={batch}")
        size = own.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).first()
        shards, tasks = -(-max(1, size.docs) // block_docs), max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-size.words // TASK_WORDS))
        met = counted(own.where("key IS NOT NULL")).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
        doubling = lambda c: F.floor(F.log2(F.col(c))).cast("int")
        # One shuffle: what is dealt by term and shard is grouped where it comes to lie.
        blocks = met.repartition(tasks, "term", "shard").groupBy("term", "part", doubling("tf").alias("tf_class"), doubling("dl").alias("dl_class"), "shard").agg(
            F.count(F.lit(1)).alias("n"), F.min("tf").alias("min_tf"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.max("dl").alias("max_dl"), F.collect_list(F.struct("key", "dl", "tf")).alias("posts")
        )
        blocks.sortWithinPartitions("term", "part").write.parquet(f"{self.path}/postings/batch={batch}")
        self.spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").json(f"{self.path}/done")

    def bounds(self, terms: Sequence[str] | DataFrame, k: int, each: bool = False) -> DataFrame:
        """The blocks of the terms (a list, or a table of part and the array `terms`), with idf, mean, low and high (what a
        document's score for the term lies between) and kept: whether a document of the block can be among the k best of
        its part, or, with each, of its part and term. Only figures of blocks are read and shuffled."""
        blocks = self.postings().drop("posts")
        if isinstance(terms, DataFrame):
            blocks = blocks.join(terms.select("part", F.explode(F.array_distinct("terms")).alias("term")), ["part", "term"])
        else:
            blocks = blocks.where(F.col("term").isin(list(terms)))
        stats = self.documents().where("key IS NOT NULL").groupBy("part").agg(F.count(F.lit(1)).alias("docs"), F.avg("dl").alias("mean"))
        df = blocks.groupBy("part", "term").agg(F.sum("n").alias("df"))
        known = blocks.join(df, ["part", "term"]).join(stats, "part").withColumn("idf", F.ln(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        score = lambda tf, dl: F.col("idf") * impact(F.col(tf), F.col(dl), F.col("mean"))
        known = known.withColumns({"low": score("min_tf", "max_dl"), "high": score("max_tf", "min_dl")})
        # The low of the block that holds the k-th document from above: at least k score no less, for this term alone.
        upto = F.sum("n").over(Window.partitionBy("part", "term").orderBy(F.desc("low")).rowsBetween(Window.unboundedPreceding, 0))
        per_term = known.withColumn("upto", upto).groupBy("part", "term").agg(F.max(F.when(F.col("upto") >= k, F.col("low"))).alias("least"), F.max("high").alias("most"))
        if each:
            reach = F.col("high")
            known = known.join(per_term, ["part", "term"])
        else:
            per_part = per_term.groupBy("part").agg(F.max("least").alias("least"), F.sum("most").alias("all"))
            known = known.join(per_term.drop("least"), ["part", "term"]).join(per_part, "part")
            reach = F.col("high") + F.col("all") - F.col("most")
        return known.withColumn("kept", F.col("least").isNull() | (reach >= F.col("least") * (1 - SLACK) - SLACK)).select(*BLOCK, "n", "idf", "mean", "low", "high", "kept")

    def scored(self, terms: Sequence[str] | DataFrame, k: int, each: bool = False) -> DataFrame:
        """(part, key, term, score) of the documents of the kept blocks. What a skipped block adds to a document is missing:
        such a document is not among the k best with it, nor without."""
        kept = self.bounds(terms, k, each).where("kept").select(*BLOCK, "idf", "mean")
        posts = self.postings()
        listed = terms
        if isinstance(terms, DataFrame):
            # Written, so that Spark knows how few blocks these are before it deals all postings to meet them.
            kept = written(kept, "kept-blocks")
            listed = [r.term for r in kept.select("term").distinct().limit(LISTED_TERMS + 1).collect()]
        if len(listed) <= LISTED_TERMS or listed is terms:
            posts = posts.where(F.col("term").isin(list(listed)))
        read = posts.select(*BLOCK, "posts").join(kept, list(BLOCK)).select("part", "term", "idf", "mean", F.inline("posts"))
        return read.select("part", "key", "term", (F.col("idf") * impact(F.col("tf"), F.col("dl"), F.col("mean"))).alias("score"))

    def _best(self, scored: DataFrame, groups: Sequence[str], k: int) -> DataFrame:
        w = Window.partitionBy(*groups).orderBy(F.desc(F.round("score", 9)), "key")
        return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)

    def search(self, terms: Sequence[str] | DataFrame, k: int) -> DataFrame:
        """(part, key, score, rank): the k best documents of each part, ties to the smaller key."""
        return self._best(self.scored(terms, k).groupBy("part", "key").agg(F.sum("score").alias("score")), ["part"], k)

    def search_each(self, terms: Sequence[str], k: int) -> DataFrame:
        """(part, key, terms): the k best of every term by itself, one row a document with the terms that found it; documents
        without a key, which cannot be told apart, are all kept, one row each."""
        hits = self._best(self.scored(terms, k, each=True), ["part", "term"], k)
        named = hits.groupBy("part", "key").agg(F.sort_array(F.collect_set("term")).alias("terms"))
        loose = self.documents().where("key IS NULL").select("part", "key", F.sort_array(F.array_intersect("words", F.array(*map(F.lit, terms)))).alias("terms"))
        return named.unionByName(loose.where(F.size("terms") > 0))

    def iterative_search(self, first: Sequence[str], rounds: int, k: int, n_terms: int, propose=frequent_new_terms) -> DataFrame:
        """(part, key, iteration): each hit with the first round that found it. A round is one search over all parts; its
        hits are written, so that no round works out an earlier one again."""
        own = self.documents().select("part", "key", F.col("words").alias("__t"))

        def hits(terms: Sequence[str] | DataFrame, i: int) -> DataFrame:
            return written(self.search(terms, k).select("part", "key", F.lit(i).cast("bigint").alias("iteration")), "hits")

        found = last = hits(first, 0)
        for i in range(1, rounds):
            last = hits(written(propose(last, own, "key", "part", first, n_terms), "terms"), i)
            found = found.unionByName(last)
        return found.groupBy("part", "key").agg(F.min("iteration").alias("iteration"))


_open: dict[tuple[str, str], PostingIndex] = {}


def index_of(docs: DataFrame, name: str, key: str, part: str, text: str) -> PostingIndex:
    """The index of a table under this name, built when an application first asks for it."""
    spark = docs.sparkSession
    at = (spark.sparkContext.applicationId, name)
    if at not in _open or not _open[at].batches():
        _open[at] = PostingIndex(spark)
        _open[at].append(docs, key, part, text)
    return _open[at]
