"""Lines repeated across one site's documents.

``repeated_lines`` goes by equal letters: a text is read once for the hashes of its lines' letters, and the documents of
each hash are counted exactly within the site.

Clusters go by likeness: lines are masked (numbers, dates, names) and clustered within their site by locality-sensitive
hashing over MinHash bands; clusters that stand in many documents come out. Bucket counts are pre-aggregated before they
are shuffled, so a line in a third of all chunks costs one row per task; only lines in crowded buckets go further.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamworks.functions.keys import text_key, upper_key
from loamworks.llm.hashing import minima
from loamworks.llm.lexicon import COURTESY_TITLES, GIVEN_NAMES
from loamworks.operators.lineage import cut, small_or_shuffled, spread

# Words of dates.
DATE_WORDS = frozenset(
    "january february march april may june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec "
    "monday tuesday wednesday thursday friday saturday sunday mon tue wed thu fri sat sun am pm est edt pst pdt utc gmt".split()
)
_BY_NAME = COURTESY_TITLES | GIVEN_NAMES
_MASK = DATE_WORDS | _BY_NAME
_LETTERS = {i: (chr(i).lower() if chr(i).isalpha() else " ") for i in range(128)}
_LOWER = bytes(range(256)).lower()
_NO_LETTER = bytes(i for i in range(128) if not chr(i).isalpha() and chr(i) != "\n")

#: Shingles of so many letters; three bands of two hashes find 0.95 of the pairs at a similarity of 0.8, 0.99 at 0.9.
WIDTH, BANDS, ROWS, SIMILARITY = 12, 3, 2, 0.8
_BUCKETS = [f"b{j}" for j in range(BANDS)]
_SEEDS = np.random.default_rng(7).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)
#: At most so many hot buckets or lines are broadcast; beyond that the joins shuffle.
MAX_BROADCAST_ROWS = 500_000
#: Forms of a bucket that one round of clustering may settle as representatives; more of them take more rounds.
HEADS = 32


def words_of(line: str) -> list[str]:
    """The lower-cased runs of letters of a line."""
    if line.isascii():
        return line.translate(_LETTERS).split()
    return "".join(ch if ch.isalpha() else " " for ch in line.lower()).split()


def letters_of(text: str) -> list[bytes]:
    """Of each line of a text, its lower-cased letters: the words of the line without what stands between them."""
    if text.isascii():
        return text.encode().translate(_LOWER, _NO_LETTER).split(b"\n")
    return ["".join(words_of(line)).encode() for line in text.split("\n")]


def masked(words: list[str]) -> str:
    """The letters of a line without dates and names: the form that is clustered. Digits and symbols are gone before."""
    if _MASK.isdisjoint(words):
        return "".join(words)
    out, after = [], False
    for w in words:
        if w in _BY_NAME:
            after = True
        elif w in DATE_WORDS or len(w) == 1 and after:
            continue
        else:
            if not after:
                out.append(w)
            after = False
    return "".join(out) or "".join(words)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _band(m: np.ndarray, sites: np.ndarray, j: int) -> np.ndarray:
    """The bucket of each row's minima within its site, in band ``j``."""
    h = m[:, 0].copy()
    for r in range(1, ROWS):
        h = h * np.uint64(0x9E3779B97F4A7C15) + m[:, r]
    return (h ^ sites) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(j)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per chunk: chunk_id, site, doc and the keys of its lines in turn, null for a line without a letter."""
    for b in batches:
        for k in range(0, b.num_rows, 2000):
            part = b.slice(k, 2000)
            ends, keys = [0], []
            for text in part["content"].to_pylist():
                keys += [xxhash.xxh3_64_intdigest(x) if x else None for x in letters_of(text)]
                ends.append(len(keys))
            hashes = pa.array(keys, pa.uint64()).view(pa.int64())
            yield pa.RecordBatch.from_pydict({"chunk_id": part["chunk_id"], "site": part["site"], "doc": part["doc"], "keys": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), hashes)})


def _lines(batches: Iterator[pa.RecordBatch], forms: bool) -> Iterator[pa.RecordBatch]:
    """One row per line with a letter: chunk_id, line_no, site, doc, key, the bands and where asked for the form."""
    for b in batches:
        for k in range(0, b.num_rows, 2000):
            part = b.slice(k, 2000)
            sites, docs = part["site"].to_numpy(zero_copy_only=False), part["doc"].to_numpy(zero_copy_only=False)
            row, number, keys, shapes = [], [], [], []
            for i, text in enumerate(part["content"].to_pylist()):
                for n, line in enumerate(text.split("\n"), 1):
                    if w := words_of(line):
                        row.append(i)
                        number.append(n)
                        keys.append("".join(w).encode())
                        shapes.append(masked(w))
            if not row:
                continue
            index = np.array(row)
            data = {
                "chunk_id": part["chunk_id"].take(pa.array(index)),
                "line_no": pa.array(number, pa.int64()),
                "site": pa.array(sites[index]),
                "doc": pa.array(docs[index]),
                "key": _signed(np.fromiter((xxhash.xxh3_64_intdigest(x) for x in keys), np.uint64, len(keys))),
            }
            own = sites[index].view(np.uint64)
            m = minima([x.encode() for x in shapes], WIDTH, _SEEDS)
            for j, band in enumerate(_BUCKETS):
                data[band] = _signed(_band(m[:, j * ROWS : (j + 1) * ROWS], own, j))
            if forms:
                data["form"] = pa.array(shapes)
            yield pa.RecordBatch.from_pydict(data)


def site_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(chunk_id, site, doc, content) of the chunks whose document exists and has a ticker; site and doc are hashes.

    Keys are compared without regard to letter case and padding. Null contents have no line.
    """
    known = documents.select(F.xxhash64(text_key("id")).alias("doc"), F.xxhash64(upper_key("ticker")).alias("site"), F.col("id"), F.col("ticker")).where("id is not null and trim(ticker) <> ''").select("doc", "site").dropDuplicates(["doc"])
    rows = spread(chunks.where("content is not null").select("id", "document_id", "content")).select(F.col("id").cast("string").alias("chunk_id"), F.xxhash64(text_key("document_id")).alias("doc"), "content", text_key("document_id").alias("ref")).where("ref is not null").drop("ref")
    return rows.join(small_or_shuffled(known, MAX_BROADCAST_ROWS), "doc").select("chunk_id", "site", "doc", "content")


def site_keys(rows: DataFrame) -> DataFrame:
    """The chunks of ``site_chunks`` with the keys of their lines in place of their contents."""
    return rows.mapInArrow(_keys, "chunk_id string, site bigint, doc bigint, keys array<bigint>")


def site_lines(rows: DataFrame, forms: bool = False) -> DataFrame:
    """The lines of ``site_chunks`` with their keys and LSH bands, and their masked forms where asked for."""
    schema = "chunk_id string, line_no bigint, site bigint, doc bigint, key bigint" + "".join(f", {b} bigint" for b in _BUCKETS) + ", form string" * forms
    return rows.mapInArrow(lambda it: _lines(it, forms), schema)


def crowded(rows: DataFrame, min_docs: int) -> DataFrame:
    """The lines that share an LSH bucket of their site with enough other lines, with all such buckets of their masked form."""
    bucket = F.explode(F.array_distinct(F.array(*_BUCKETS))).alias("bucket")
    full = site_lines(rows).select(bucket).groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    hot = small_or_shuffled(cut(full), MAX_BROADCAST_ROWS)
    near = site_lines(rows, forms=True).select("chunk_id", "line_no", "site", "doc", "key", "form", bucket).join(hot, "bucket")
    return near.groupBy("chunk_id", "line_no", "site", "doc", "key", "form").agg(F.collect_set("bucket").alias("buckets"))


def repeated_lines(chunks: DataFrame, documents: DataFrame, min_docs: int = 4) -> DataFrame:
    """(chunk_id, line_no): lines that stand, but for case, spacing, punctuation, symbols and digits, in at least ``min_docs`` documents of their site.

    Every line with a letter is counted, in each document once; none is left out beforehand. Lines without a letter, null
    contents, chunks without a known document and empty tables give no row; a chunk that stands twice counts and comes out once.
    """
    lines = cut(site_keys(site_chunks(chunks, documents)))
    docs = lines.select("site", "doc", F.explode("keys").alias("key")).where("key is not null").distinct()
    hot = docs.groupBy("site", "key").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs).select("site", "key")
    placed = lines.select("chunk_id", "site", F.posexplode("keys").alias("pos", "key")).where("key is not null")
    found = placed.join(small_or_shuffled(cut(hot), MAX_BROADCAST_ROWS), ["site", "key"])
    return found.select("chunk_id", (F.col("pos") + 1).cast("bigint").alias("line_no")).distinct()


def without_lines(chunks: DataFrame, lines: DataFrame) -> DataFrame:
    """(chunk_id, content, n_removed): each chunk, once, without the given lines; chunks without such lines stay as they are."""
    gone = lines.groupBy("chunk_id").agg(F.collect_list("line_no").alias("gone"))
    text = chunks.select(F.col("id").cast("string").alias("chunk_id"), "content").dropDuplicates(["chunk_id"])
    joined = text.join(gone, "chunk_id", "left")
    kept = F.array_join(F.filter(F.split("content", "\n"), lambda x, i: ~F.array_contains("gone", (i + 1).cast("bigint"))), "\n")
    return joined.select("chunk_id", F.when(F.col("gone").isNull(), F.col("content")).otherwise(kept).alias("content"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"))


def _shingles(s: str) -> set[str]:
    return {s[i : i + WIDTH] for i in range(max(1, len(s) - WIDTH + 1))}


def _alike(a: set[str], b: set[str], similarity: float) -> bool:
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    same = len(a & b)
    return same >= similarity * (len(a) + len(b) - same)


def _represented(forms: DataFrame, similarity: float) -> DataFrame:
    """(site, form, representative) of every form of ``forms`` (site, form, n, buckets).

    A form represents itself if no more frequent representative that it shares a bucket with is similar enough, and
    otherwise belongs to such a one. Each round settles those of the HEADS most frequent open forms of the buckets that
    no open form before them resembles, in any of their buckets, and the forms that resemble these; rounds go on until
    no form is open, and each settles at least the most frequent one.
    """

    def free(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for site, heads in zip(b["site"], b["heads"], strict=True):
                before: list[set[str]] = []
                for h in sorted(heads, key=lambda h: h["place"]):
                    own = _shingles(h["form"])
                    if not any(_alike(own, x, similarity) for x in before):
                        rows.append((site, h["form"]))
                    before.append(own)
            yield pd.DataFrame(rows, columns=["site", "form"])

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known = {f: _shingles(f) for f in b["head"].unique()}
            yield b[[_alike(_shingles(f), known[h], similarity) for f, h in zip(b["form"], b["head"], strict=True)]]

    place = F.row_number().over(Window.partitionBy("site", "bucket").orderBy(F.desc("n"), F.desc("form")))
    still, settled = forms, None
    while not still.isEmpty():
        rows = still.select("site", "form", "n", F.explode("buckets").alias("bucket"))
        first = rows.withColumn("place", place).where(F.col("place") <= HEADS).groupBy("site", "bucket").agg(F.collect_list(F.struct("place", "form")).alias("heads"))
        times = first.select("site", "heads").mapInPandas(free, "site bigint, form string").groupBy("site", "form").agg(F.count("*").alias("times"))
        heads = cut(still.join(times, ["site", "form"]).where(F.size("buckets") == F.col("times")).select("site", "form", "n", "buckets"))
        sides = heads.select("site", F.col("form").alias("head"), F.col("n").alias("head_n"), F.explode("buckets").alias("bucket"))
        pairs = rows.select("site", "bucket", "form").join(sides, ["site", "bucket"]).select("site", "form", "head", "head_n")
        found = pairs.mapInPandas(joined, "site bigint, form string, head string, head_n bigint")
        new = cut(found.groupBy("site", "form").agg(F.max_by("head", F.struct("head_n", "head")).alias("representative")))
        settled = new if settled is None else settled.union(new)
        still = cut(still.join(new, ["site", "form"], "left_anti"))
    return forms.select("site", "form", F.col("form").alias("representative")) if settled is None else settled


def _clustered(chunks: DataFrame, documents: DataFrame, min_docs: int, similarity: float) -> DataFrame:
    """(chunk_id, line_no, site, doc, form, representative) of the lines of crowded buckets."""
    near = cut(crowded(site_chunks(chunks, documents), min_docs))
    forms = cut(near.groupBy("site", "form").agg(F.count("*").alias("n"), F.first("buckets").alias("buckets")))
    return near.select("chunk_id", "line_no", "site", "doc", "form").join(_represented(forms, similarity), ["site", "form"])


def near_duplicate_lines(chunks: DataFrame, documents: DataFrame, min_docs: int = 4, similarity: float = SIMILARITY) -> DataFrame:
    """(chunk_id, line_no): the lines of near-duplicate clusters that stand in at least ``min_docs`` documents of a site.

    Other than ``repeated_lines`` this finds lines that differ in names, dates or a few letters, as bylines do. Null
    contents, chunks without a known document and empty tables give no row; a chunk that stands twice comes out once.
    """
    lines = cut(_clustered(chunks, documents, min_docs, similarity))
    docs = lines.select("site", "representative", "doc").distinct().groupBy("site", "representative").agg(F.count("*").alias("n_docs"))
    hot = docs.where(F.col("n_docs") >= min_docs).select("site", "representative")
    return lines.join(small_or_shuffled(cut(hot), MAX_BROADCAST_ROWS), ["site", "representative"]).select("chunk_id", "line_no").distinct()


def line_clusters(chunks: DataFrame, documents: DataFrame, min_docs: int = 4, similarity: float = SIMILARITY) -> DataFrame:
    """(ticker, representative, n_docs, n_lines, n_forms): near-duplicate clusters of masked lines in at least ``min_docs`` documents of a site.

    Every form of a crowded bucket belongs to one cluster. Frequent forms represent the clusters: a form belongs to one
    that it shares any bucket with and to which the Jaccard similarity of their letter shingles is at least
    ``similarity``, and represents its own if there is none.
    """
    placed = _clustered(chunks, documents, min_docs, similarity).groupBy("site", "representative", "doc").agg(F.count("*").alias("n"), F.collect_set("form").alias("f"))
    out = placed.groupBy("site", "representative").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_lines"), F.size(F.array_distinct(F.flatten(F.collect_set("f")))).cast("bigint").alias("n_forms"))
    sites = documents.select(F.xxhash64(upper_key("ticker")).alias("site"), upper_key("ticker").alias("ticker")).where("ticker is not null").distinct()
    return out.where(F.col("n_docs") >= min_docs).join(sites, "site").select("ticker", "representative", "n_docs", "n_lines", "n_forms")
