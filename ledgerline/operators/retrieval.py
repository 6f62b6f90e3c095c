"""Keyword retrieval: BM25 over an inverted index, and rounds of it.

Score: IDF = ln(1 + (N - df + 0.5) / (df + 0.5)), k1 = 1.2, b = 0.75. Postings are restricted to the
query's terms before anything is shuffled, so the index is never built for words nobody asks for.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import bound
from ledgerline.storage import written

K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def tokenised(docs: DataFrame, key: str, partition: str, text: str) -> DataFrame:
    """(partition, key, __t): the tokens of each document, written once for all rounds that search it."""
    return written(docs.select(F.col(partition), F.col(key), tokens(F.col(text)).alias("__t")), "tokens")


def bm25(own: DataFrame, key: str, partition: str, terms: Column) -> DataFrame:
    """(partition, key, term, score) of documents (tokenised) that hold a term of the array column `terms`; statistics are
    per partition (the entity searched in)."""
    stats = own.groupBy(partition).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("__t")).alias("avg_dl"))
    met = own.select(partition, key, F.size("__t").cast("bigint").alias("dl"), F.explode(bound(terms, lambda q: F.filter("__t", lambda x: F.array_contains(q, x)))).alias("term"))
    post = met.groupBy(partition, key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df_ = post.groupBy(partition, "term").agg(F.count(F.lit(1)).alias("df"))
    scored = post.join(df_, [partition, "term"]).join(stats, partition)
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    return scored.select(partition, key, "term", (idf * tf).alias("score"))


def _best(scored: DataFrame, key: str, groups: Sequence[str], k: int) -> DataFrame:
    w = Window.partitionBy(*groups).orderBy(F.desc(F.round("score", 9)), key)
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def _dated(docs: DataFrame, time: str | None, start: str | None, end: str | None) -> DataFrame:
    """A one-sided date range is open on the other side."""
    if time and start:
        docs = docs.where(F.col(time) >= F.lit(start))
    if time and end:
        docs = docs.where(F.col(time) <= F.lit(end))
    return docs


def search(docs: DataFrame, key: str, partition: str, text: str, terms: Column, k: int, time: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Top k per partition by score, then key."""
    own = tokenised(_dated(docs, time, start, end), key, partition, text)
    total = bm25(own, key, partition, terms).groupBy(partition, key).agg(F.sum("score").alias("score"))
    return _best(total, key, [partition], k)


def search_each(docs: DataFrame, key: str, partition: str, text: str, terms: Sequence[str], k: int) -> DataFrame:
    """(partition, key, terms): the top k of every term by itself, one row a document with the terms that found it; hits
    without an id, which cannot be told apart, are all kept, one row each."""
    own = tokenised(docs, key, partition, text)
    hits = _best(bm25(own.where(F.col(key).isNotNull()), key, partition, F.array(*map(F.lit, terms))), key, [partition, "term"], k)
    named = hits.groupBy(partition, key).agg(F.sort_array(F.collect_set("term")).alias("terms"))
    loose = own.where(F.col(key).isNull()).select(partition, key, F.sort_array(F.array_intersect("__t", F.array(*map(F.lit, terms)))).alias("terms"))
    return named.unionByName(loose.where(F.size("terms") > 0))


def frequent_new_terms(hits: DataFrame, own: DataFrame, key: str, partition: str, searched: Sequence[str], n: int, least: int = 4) -> DataFrame:
    """Per partition the n most frequent words of the hits that were not searched yet: the default proposer."""
    words = hits.select(partition, key).join(own, [partition, key]).select(partition, F.explode("__t").alias("term"))
    counts = words.where((F.length("term") >= least) & ~F.col("term").isin(*searched)).groupBy(partition, "term").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(partition).orderBy(F.desc("c"), "term")
    return counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).groupBy(partition).agg(F.sort_array(F.collect_list("term")).alias("terms"))


def iterative_search(docs: DataFrame, key: str, partition: str, text: str, first: Sequence[str], rounds: int, k: int, n_terms: int, propose: Callable[..., DataFrame] = frequent_new_terms) -> DataFrame:
    """(partition, key, iteration): each hit with the first round that found it. A round is one plan over all partitions;
    tokens and each round's hits are written, so that no round works out an earlier one again."""
    own = tokenised(docs, key, partition, text)

    def hits(table: DataFrame, terms: Column, i: int) -> DataFrame:
        total = bm25(table, key, partition, terms).groupBy(partition, key).agg(F.sum("score").alias("score"))
        return written(_best(total, key, [partition], k).select(partition, key, F.lit(i).cast("bigint").alias("iteration")), "hits")

    found = last = hits(own, F.array(*map(F.lit, first)), 0)
    for i in range(1, rounds):
        terms = propose(last, own, key, partition, first, n_terms)
        last = hits(own.join(terms, partition), F.col("terms"), i)
        found = found.unionByName(last)
    return found.groupBy(partition, key).agg(F.min("iteration").alias("iteration"))


def per_iteration(rows: DataFrame, steps: str, order: Sequence[Column]) -> DataFrame:
    """One row per element of the array `steps`, with its iteration; index is by key and iteration, not by arrival."""
    out = rows.select("*", F.posexplode(steps).alias("iteration", "step")).drop(steps)
    return out.withColumn("index", F.concat_ws("-", *[o.cast("string") for o in order], F.col("iteration").cast("string")))


def with_cached(rows: DataFrame, cache: DataFrame, on: Sequence[str], timeline: str, summary: str | None = None) -> DataFrame:
    """Timelines from an earlier run where there are any; a stored summary takes their place."""
    c = cache.select(*on, *[F.col(x).alias(f"__{x}") for x in filter(None, [timeline, summary])])
    stored = F.coalesce(*([F.col(f"__{summary}")] if summary else []), F.col(f"__{timeline}"), F.col(timeline))
    return rows.join(c, list(on), "left").withColumn(timeline, stored).drop(*[f"__{x}" for x in filter(None, [timeline, summary])])


def summarised(df: DataFrame, column: str, model: Callable[[list[str]], list[str | None]], most: int, name: str = "summary") -> DataFrame:
    """A batch model over a text column: blanks are skipped, a failed or empty answer falls back to the text, both cut at 2 x most."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def run(s):
        ask = [i for i, t in enumerate(s) if isinstance(t, str) and t.strip()]
        try:
            answers = dict(zip(ask, model([s.iloc[i] for i in ask])))
        except Exception:  # a model that fails leaves the texts as they are
            answers = {}
        return s.__class__([(answers.get(i) or t)[: 2 * most] if isinstance(t, str) else None for i, t in enumerate(s)], index=s.index, dtype=object)

    return df.withColumn(name, run(F.col(column)))
