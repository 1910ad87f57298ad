"""From ranked hits to a context: neighbours, budget, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import token_count

NEIGHBOUR_SCORE, NEIGHBOUR_RERANK = 0.5, 0.01


def expand_neighbours(hits: DataFrame, chunks: DataFrame, window: int = 1, query: str = "query_id") -> DataFrame:
    """Hits (query, id, book_id, ordinal, score, relevance_rank) with the chunks whose ordinal in
    the same book is within ``window``; a gap in the ordinals is no neighbour. A neighbour of
    several hits takes half the score of the most relevant, and none is a hit already kept."""
    own = hits.select(query, "id", "book_id", "ordinal", "score", F.lit(False).alias("is_neighbor"), "relevance_rank")
    if window <= 0:
        return own
    steps = F.array(*[F.lit(d) for d in range(-window, window + 1) if d])
    near = hits.withColumn("step", F.explode(steps)).select(query, "book_id", (F.col("ordinal") + F.col("step")).alias("ordinal"), (F.col("score") * NEIGHBOUR_SCORE).alias("score"), "relevance_rank")
    found = near.join(chunks.select("id", "book_id", "ordinal"), ["book_id", "ordinal"]).join(hits.select(query, "id"), [query, "id"], "left_anti")
    first = W.partitionBy(query, "id").orderBy("relevance_rank")
    found = found.withColumn("n", F.row_number().over(first)).where("n = 1")
    return own.unionByName(found.select(query, "id", "book_id", "ordinal", "score", F.lit(True).alias("is_neighbor"), "relevance_rank"))


def reading_order(rows: DataFrame, query: str = "query_id") -> DataFrame:
    w = W.partitionBy(query).orderBy("book_id", "ordinal")
    return rows.withColumn("position", F.row_number().over(w).cast("long"))


def budgeted(items: Column, budget: int, least_room: int = 20) -> Column:
    """Greedy selection under a token budget. ``items`` is an array of structs (position,
    is_neighbor, score, cost, header); hits go before neighbours, then by score, then position.
    One that does not fit is skipped, and later ones may still fit; the first hit is cut down to the
    room left, if that is at least ``least_room`` tokens, rather than dropped. The result
    is an array of (position, tokens) in reading order, tokens being what the body may take."""
    order = F.array_sort(F.transform(items, lambda x: F.struct(x["is_neighbor"].alias("late"), (-x["score"]).alias("s"), x["position"].alias("position"), x["cost"].alias("cost"), x["header"].alias("header"))))
    taken = F.lit(None).cast("array<struct<position:bigint,tokens:int>>")
    start = F.struct(F.lit(0).alias("used"), F.coalesce(taken, F.array().cast("array<struct<position:bigint,tokens:int>>")).alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        whole = x["cost"] + x["header"]
        room = F.lit(budget) - acc["used"] - x["header"]
        add = lambda tokens: F.struct((acc["used"] + x["header"] + tokens).cast("int").alias("used"), F.array_append(acc["taken"], F.struct(x["position"].cast("long").alias("position"), tokens.cast("int").alias("tokens"))).alias("taken"))
        cut = (F.size(acc["taken"]) == 0) & ~x["late"] & (room >= least_room)
        return F.when(acc["used"] + whole <= budget, add(x["cost"])).when(cut, add(room)).otherwise(acc)

    return F.aggregate(order, start, step, lambda acc: F.array_sort(acc["taken"]))


def select_within(rows: DataFrame, budget: int = 4500, query: str = "query_id", cost: Column | None = None) -> DataFrame:
    """Rows (query, position, is_neighbor, score, text, citation) kept under the budget, with
    their place in the context and the tokens their text may take. ``cost`` is what a text takes, a
    quarter of its characters if nothing else is said."""
    own = token_count(F.col("text")) if cost is None else cost.cast("int")
    cost = rows.withColumns({"cost": own, "header": token_count(F.concat(F.lit("["), F.count("*").over(W.partitionBy(query)).cast("string"), F.lit("] "), F.col("citation"))) + 4})
    item = F.struct("position", "is_neighbor", "score", "cost", "header")
    kept = cost.groupBy(query).agg(budgeted(F.collect_list(item), budget).alias("kept")).select(query, F.posexplode("kept").alias("at", "k"))
    kept = kept.select(query, F.col("k.position").alias("position"), F.col("k.tokens").alias("tokens"), (F.col("at") + 1).alias("number"))
    return rows.join(kept, [query, "position"])


def shown(text: Column, tokens: Column) -> Column:
    """What a context shows of a text that may take so many tokens."""
    return F.substring(text, F.lit(1), tokens * 4 + 3)


def render(rows: DataFrame, query: str = "query_id") -> DataFrame:
    """One context per query: numbered blocks, and beside it the list of citations, and the passages as (n,
    citation, text)."""
    body = shown(F.col("text"), F.col("tokens"))
    block = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), F.col("citation"), F.lit("\n"), body)
    listed = F.array_sort(F.collect_list(F.struct("number", block.alias("block"), "citation", body.alias("body"))))
    passages = F.transform("x", lambda r: F.struct(r["number"].alias("n"), r["citation"].alias("citation"), r["body"].alias("text")))
    return rows.groupBy(query).agg(listed.alias("x")).select(query, F.array_join(F.transform("x", lambda r: r["block"]), "\n\n").alias("context"), F.transform("x", lambda r: r["citation"]).alias("citations"), passages.alias("passages"))
