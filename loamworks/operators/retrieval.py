"""Ranked retrieval: exact cosine search, BM25 and their fusion."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamworks.functions.text import tokens
from loamworks.operators.lineage import cut, small_or_shuffled, spread

#: Query vectors multiplied at a time, which bounds the broadcast.
QUERY_BLOCK = 2_000
#: Terms of all queries that are broadcast, at most.
MAX_TERMS = 200_000


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` most similar rows of each query vector, itself excluded.

    Queries are taken in blocks; each task keeps its own best ``k`` per query, so that only those are shuffled.
    Null, empty and zero vectors, and vectors of another length than the query's, match nothing.
    """
    spark = vectors.sparkSession
    asked = queries.where(F.size(vector_col) > 0).select(F.col(id_col).cast("bigint").alias("q"), vector_col)
    n = max(1, -(-asked.count() // block))
    out = None
    for part in range(n):
        rows = asked.where(F.pmod(F.xxhash64("q"), F.lit(n)) == part).collect()  # about one block
        rows = [r for r in rows if r[1] and any(r[1])]
        shared = spark.sparkContext.broadcast(([r[0] for r in rows], [list(map(float, r[1])) for r in rows]))

        def best(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, raw = shared.value
            by_length: dict[int, list[int]] = {}
            for i, v in enumerate(raw):
                by_length.setdefault(len(v), []).append(i)
            kept = []
            for b in batches:
                vectors_of: dict[int, tuple[list, list]] = {}
                for i, v in zip(b["id"], b["v"], strict=True):
                    if v is not None and len(v) in by_length:
                        slot = vectors_of.setdefault(len(v), ([], []))
                        slot[0].append(i)
                        slot[1].append(v)
                for size, (own, vs) in vectors_of.items():
                    m = np.array(vs, float)
                    norm = np.linalg.norm(m, axis=1)
                    m, own = m[norm > 0] / norm[norm > 0, None], np.array(own)[norm > 0]
                    asked_m = np.array([raw[i] for i in by_length[size]])
                    s = (asked_m / np.linalg.norm(asked_m, axis=1)[:, None]) @ m.T
                    for row, i in enumerate(by_length[size]):
                        top = np.lexsort((own, -np.round(s[row], 12)))[: k + 1]
                        kept += [(ids[i], int(own[j]), float(s[row, j])) for j in top if own[j] != ids[i]]
                if len(kept) > 50_000:
                    kept = _cut(kept, k)
            yield pd.DataFrame(_cut(kept, k), columns=["query_id", "id", "score"])

        found = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v")).mapInPandas(best, "query_id bigint, id bigint, score double")
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _cut(rows: list, k: int) -> list:
    if not rows:
        return rows
    df = pd.DataFrame(rows, columns=["q", "i", "s"]).drop_duplicates(["q", "i"])
    df = df.assign(r=df["s"].round(12)).sort_values(["q", "r", "i"], ascending=[True, False, True]).groupby("q").head(k)
    return list(df[["q", "i", "s"]].itertuples(index=False, name=None))


def bm25_top(documents: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """(query_id, doc_id, score, rank): Okapi BM25 of documents (doc_id, text) for queries (query_id, text).

    A negative idf is replaced by ``floor`` times the mean idf of the query terms in the corpus. Of a text only its number
    of tokens and the counts of query terms leave the task that read it. The query terms are broadcast while there are at
    most MAX_TERMS of them and joined by shuffle beyond. Documents without one of them do not come out; null and empty
    texts and queries match nothing.
    """
    terms = cut(queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")))
    few = small_or_shuffled(terms, MAX_TERMS)
    wanted = small_or_shuffled(terms.select("term").distinct(), MAX_TERMS)
    lengths = spread(documents.where("text is not null").select("doc_id", "text")).select("doc_id", tokens(F.col("text")).alias("w")).withColumn("len", F.size("w"))
    stats = cut(lengths.agg(F.count("*").alias("n_docs"), F.avg("len").alias("mean_len")))
    counted = cut(lengths.select("doc_id", "len", F.explode("w").alias("term")).join(wanted, "term").groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf")))
    df = counted.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(stats))
    idf = cut(df.withColumn("idf", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)))
    mean = idf.agg(F.avg("idf").alias("mean_idf"))
    weights = idf.join(F.broadcast(mean)).select("term", "mean_len", F.when(F.col("idf") < 0, floor * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))
    asked = small_or_shuffled(weights.join(few, "term"), MAX_TERMS)
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean_len")))
    scored = counted.join(asked, "term").groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
