"""Mixing sources to target weights.

Texts are grouped by the set of target sources that hold them. A small min-cost flow routes the tokens of these groups
to the quotas of the sources, at a cost that grows with every repetition; whole documents are then selected in the
order of a seeded hash.
"""

import base64
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loamworks.operators.lineage import cut, small_or_shuffled, spread

# Fixed value: how the public tokenizer splits a text before merging bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ways of groups of sources that are broadcast, beyond that their join shuffles; hash buckets of a group.
MAX_GROUPS, BUCKETS = 1_000, 1024


def token_counts(documents: DataFrame, tokenizer: str, sources: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, text_key, n_tokens) of each document with a text, once, where asked for only those of ``sources`` (source).

    ``tokenizer`` is a file of ranks that the driver can read; its tables, which no data makes longer, are broadcast.
    """
    with open(tokenizer, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            sizes = {t: len(coder.encode_ordinary(t)) for t in b["text"].unique()}
            yield b.drop(columns="text").assign(n_tokens=[sizes[t] for t in b["text"]])

    rows = documents.where("text is not null and text <> ''").select("doc_id", "source", "text")
    rows = rows if sources is None else rows.join(F.broadcast(sources), "source", "left_semi")  # one row a target source
    rows = spread(rows).select("doc_id", "source", F.substring(F.sha2("text", 256), 1, 32).alias("text_key"), "text")
    return rows.mapInPandas(count, "doc_id bigint, source string, text_key string, n_tokens bigint").dropDuplicates(["doc_id"])


class _Flow:
    """Maximum flow by blocking flows; arcs may be added between runs, what flows already stays on its way."""

    def __init__(self, n: int):
        self.arcs: list[list[list]] = [[] for _ in range(n)]

    def add(self, a: int, b: int, room: float) -> list:
        there, back = [b, room, None], [a, 0.0, None]
        there[2], back[2] = back, there
        self.arcs[a].append(there)
        self.arcs[b].append(back)
        return back

    def run(self, s: int, t: int, least: float = 1e-6) -> float:
        total = 0.0
        while True:
            level = {s: 0}
            queue = deque([s])
            while queue:
                a = queue.popleft()
                for b, room, _ in self.arcs[a]:
                    if room > least and b not in level:
                        level[b] = level[a] + 1
                        queue.append(b)
            if t not in level:
                return total
            at = [0] * len(self.arcs)

            def push(a: int, most: float, level=level, at=at) -> float:
                if a == t:
                    return most
                while at[a] < len(self.arcs[a]):
                    arc = self.arcs[a][at[a]]
                    if arc[1] > least and level.get(arc[0]) == level[a] + 1 and (got := push(arc[0], min(most, arc[1]))) > least:
                        arc[1] -= got
                        arc[2][1] += got
                        return got
                    at[a] += 1
                return 0.0

            while (got := push(s, float("inf"))) > least:
                total += got


def routes(groups: dict[tuple[str, ...], float], quotas: dict[str, float], repeats: dict[str, int]) -> tuple[dict[tuple[tuple[str, ...], str], float], float]:
    """Tokens that flow from each group of sources to each source, and what of the quotas is met.

    The k-th use of a group's tokens costs more than the one before. As only these arcs have a cost, opening them in
    the order of their cost and augmenting each time gives a flow of least cost.
    """
    keys, names = list(groups), list(quotas)
    node = {s: 1 + len(keys) + k for k, s in enumerate(names)}
    end = 1 + len(keys) + len(names)
    net = _Flow(end + 1)
    ways = {}
    for k, g in enumerate(keys):
        for s in g:
            if s in node:
                ways[g, s] = net.add(1 + k, node[s], groups[g] * repeats[s])
    for s in names:
        net.add(node[s], end, quotas[s])
    uses = [sum(repeats.get(s, 0) for s in g) for g in keys]
    supply = [net.add(0, 1 + k, 0.0)[2] for k in range(len(keys))]
    met, asked = 0.0, sum(quotas.values())
    for use in range(max(uses, default=0)):
        if asked - met <= 1e-6:
            break
        for k, g in enumerate(keys):
            if uses[k] > use:
                supply[k][1] += groups[g]
        met += net.run(0, end)
    return {w: back[1] for w, back in ways.items() if back[1] > 1e-6}, met


def largest_total(groups: dict[tuple[str, ...], float], shares: dict[str, float], repeats: dict[str, int]) -> float:
    """The largest total at which every source of ``shares`` can meet its share.

    A group can be used as often as all its sources together may, so what one source takes is not missing to another
    and each source has its own limit: its tokens times its repeats.
    """
    room = dict.fromkeys(shares, 0.0)
    for g, n in groups.items():
        for s in g:
            if s in room:
                room[s] += n * repeats[s]
    return min((room[s] / x for s, x in shares.items() if x > 0), default=0.0)


def mixture(documents: DataFrame, targets: DataFrame, tokenizer: str, total_tokens: float | None = None, seed: int = 0, max_groups: int = MAX_GROUPS) -> DataFrame:
    """(doc_id, source, n_tokens, repeats) of the chosen documents.

    ``total_tokens`` is the size of the mixture; by default the largest at which every target source that has documents
    meets its share among those that have. A text that stands under several ids of a source is used under the least of
    them, at most ``max_repeats`` times (1 where null); one that several sources hold counts for the one it is chosen for.
    Every set of sources that holds a text is routed, on the driver; ``max_groups`` only bounds what is broadcast of them.
    Null and empty texts, documents without a source and sources without a target are not used; a target source
    without documents gets nothing; empty tables give no row.
    """
    spark = documents.sparkSession
    wanted = {r["source"]: (float(r["target_share"]), int(r["max_repeats"] or 1)) for r in targets.where("source is not null and target_share > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).collect()}  # one row a source
    names = spark.createDataFrame([(s,) for s in wanted], "source string")
    sized = token_counts(documents, tokenizer, names)
    held = cut(sized.groupBy("text_key", "source").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens")))
    texts = held.groupBy("text_key").agg(F.array_join(F.sort_array(F.collect_set("source")), "\x1f").alias("sources"), F.max("n_tokens").alias("n_tokens"))
    sizes = cut(texts.groupBy("sources").agg(F.sum("n_tokens").alias("n")))
    groups = {(s,): 0.0 for s in wanted} | {tuple(r["sources"].split("\x1f")): float(r["n"]) for r in sizes.orderBy(F.desc("n"), "sources").toLocalIterator()}  # one row a set of sources that holds a text
    have = {s for g, n in groups.items() if n > 0 for s in g}
    whole = sum(wanted[s][0] for s in have) or 1.0
    shares = {s: wanted[s][0] / whole for s in sorted(have)}
    repeats = {s: wanted[s][1] for s in shares}
    size = total_tokens if total_tokens is not None else largest_total(groups, shares, repeats)
    flows, _ = routes(groups, {s: x * size for s, x in shares.items()}, repeats)
    schema = T.StructType([T.StructField("group", T.StringType()), T.StructField("source", T.StringType()), T.StructField("uses", T.DoubleType()), T.StructField("room", T.IntegerType())])
    plan = spark.createDataFrame([("\x1f".join(g), s, min(f / groups[g], repeats[s]), repeats[s]) for (g, s), f in flows.items() if groups[g] > 0], schema)
    placed = texts.select("text_key", F.col("sources").alias("group"))
    units = held.join(placed, "text_key").join(small_or_shuffled(plan, max_groups), ["group", "source"])
    order = F.xxhash64(F.lit(seed), "text_key", "source")
    units = cut(units.select("doc_id", "group", "source", "n_tokens", "uses", "room", order.alias("h"), F.pmod(F.shiftright(order, 20), F.lit(BUCKETS)).alias("bucket")))
    part = ["group", "source"]
    heaps = units.groupBy(*part, "bucket").agg(F.sum("n_tokens").alias("n"), F.max("uses").alias("uses"))
    before = F.sum("n").over(Window.partitionBy(*part).orderBy("bucket")) - F.col("n")
    goal = (F.col("uses") - F.floor("uses")) * F.sum("n").over(Window.partitionBy(*part))
    heaps = heaps.select(*part, "bucket", (goal - before).alias("left"), "n")
    marked = units.join(heaps, [*part, "bucket"])
    inside = F.sum("n_tokens").over(Window.partitionBy(*part, "bucket").orderBy("h", "doc_id")) - F.col("n_tokens") / 2
    cols = ["doc_id", "source", "n_tokens", "uses", "room"]
    clear = marked.where("left <= 0 or left >= n").select(*cols, (F.col("left") > 0).alias("more"))
    edge = marked.where("left > 0 and left < n").withColumn("inside", inside).select(*cols, (F.col("inside") <= F.col("left")).alias("more"))
    times = F.least(F.floor("uses").cast("int") + F.col("more").cast("int"), F.col("room")).cast("bigint")
    return clear.unionByName(edge).select("doc_id", "source", "n_tokens", times.alias("repeats")).where("repeats > 0")


def mixture_shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target_share, tokens and share of the mixture, documents and the most repetitions; 0 where nothing was chosen."""
    got = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("n_docs"), F.max("repeats").alias("most_repeats"))
    whole = got.agg(F.sum("tokens").alias("whole"))
    rows = targets.where("source is not null").select("source", F.col("target_share").cast("double").alias("target_share")).join(got, "source", "left").join(F.broadcast(whole))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return rows.select("source", "target_share", zero("tokens").alias("tokens"), F.coalesce(F.try_divide("tokens", "whole"), F.lit(0.0)).alias("actual_share"), zero("n_docs").alias("n_docs"), zero("most_repeats").alias("most_repeats"))
