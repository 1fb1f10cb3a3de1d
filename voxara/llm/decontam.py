"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A mask ignores fixed token positions of a window, so that a substituted word there does not hide a match. The hashes
of all masked windows of the benchmark are joined with those of every document position. Hits of one document and item
that lie on one diagonal (the same distance between the two positions) are one; only then are the tokens fetched and
compared along the diagonal, +1 for an equal token and -MISMATCH for another: where the sum falls below 0 a part ends,
at its best sum. A short item is also compared as a whole. A document and an item overlap when enough tokens agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxara.llm.common import absent, few, read_table, stash

#: 1: the token counts; 0: it is ignored.
MASKS = ["11111", "11011011", "1110111", "111101", "1010111"]
MISMATCH = 2
#: Least number of agreeing tokens (or MIN_SHARE of a shorter item), and their least share of the overlap.
MIN_TOKENS, MIN_SHARE = 13, 0.75
#: Windows of the benchmark that are broadcast at a time (24 bytes each); a larger benchmark is taken in blocks.
BROADCAST_WINDOWS = 2_000_000
#: Tokens of a benchmark whose items are broadcast to be compared (8 bytes each); a larger one is shuffled.
BROADCAST_TOKENS = 4_000_000
BLANKS = r"[\x20\x09-\x0D]+"


def token_hashes(text: Column) -> Column:
    """array<bigint>: a hash for each blank-separated word, lower-cased; empty for null."""
    return F.transform(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BLANKS), ""), lambda w: F.xxhash64(w))


def _seeds(tokens: Column, at: Column) -> Column:
    """The hash of each mask at a position; null where the window passes the end."""
    out = []
    for n, mask in enumerate(MASKS):
        kept = [F.get(tokens, at + i) for i, c in enumerate(mask) if c == "1"]
        out.append(F.when(at + len(mask) <= F.size(tokens), F.xxhash64(F.lit(n), *kept)))
    return F.array(*out)


def windows(rows: DataFrame) -> DataFrame:
    """rows (which have tokens) with at and seed: a row for each position and mask."""
    least = min(map(len, MASKS))
    places = F.when(F.size("tokens") >= least, F.sequence(F.lit(0), F.size("tokens") - least))
    placed = rows.select("*", F.explode(places).alias("at"))
    return placed.select("*", F.explode(_seeds(F.col("tokens"), F.col("at"))).alias("seed")).filter("seed is not null")


def _best_part(same: Column, agrees: Callable[[Column], Column]) -> Column:
    """The part of most equal tokens that agrees (struct n_equal, n_compared, start), of a diagonal's array of which tokens are equal; null where none does."""
    part = lambda eq, n, start: F.struct(eq.cast("int").alias("n_equal"), n.cast("int").alias("n_compared"), start.cast("int").alias("start"))
    names = ("at", "start", "eq", "sum", "top", "best", "found")
    state = lambda *values: F.struct(*[v.alias(n) for n, v in zip(names, values, strict=True)])
    zero = F.lit(0)
    none = part(zero, zero, zero)

    def step(acc: Column, e: Column) -> Column:
        at, eq, total = acc["at"] + 1, acc["eq"] + e.cast("int"), acc["sum"] + F.when(e, 1).otherwise(-MISMATCH)
        over = total < 0
        best = F.when(total > acc["top"], part(eq, at - acc["start"], acc["start"])).otherwise(acc["best"])
        found = F.when(agrees(best) & (best["n_equal"] > acc["found"]["n_equal"]), best).otherwise(acc["found"])
        from_here = lambda c: F.when(over, 0).otherwise(c)
        return state(at, F.when(over, at).otherwise(acc["start"]), from_here(eq), from_here(total), from_here(F.greatest(total, acc["top"])), F.when(over, none).otherwise(best), found)

    return F.aggregate(same, state(zero, zero, zero, zero, zero, none, none), step, lambda acc: F.when(acc["found"]["n_equal"] > 0, acc["found"]))


def _searched(docs: DataFrame, benchmark: DataFrame, id_col: str, item_col: str) -> DataFrame:
    """_doc, _hash (of the text), _item and b, the best overlap, of each row and item that overlap; null ids are rows too."""
    items, _ = stash(benchmark.select(benchmark[item_col].alias("_item"), token_hashes(benchmark["text"]).alias("tokens")).filter(F.col("_item").isNotNull()), "benchmark")
    total = items.select(F.sum(F.size("tokens"))).first()[0] or 0
    blocks = -(-total * len(MASKS) // BROADCAST_WINDOWS) or 1
    own = docs.select(docs[id_col].alias("_doc"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("_hash"), token_hashes(docs["text"]).alias("tokens"))
    theirs = windows(items).select("_item", F.col("at").alias("j"), "seed").distinct()
    hits = None
    for k in range(blocks):
        block = theirs if blocks == 1 else theirs.filter(F.pmod(F.xxhash64("_item", "j"), F.lit(blocks)) == k)
        part = windows(own).select("_doc", "_hash", "at", "seed").join(F.broadcast(block), "seed").select("_doc", "_hash", "_item", (F.col("at") - F.col("j")).alias("d"))
        hits = part if hits is None else hits.union(part)
    diagonals, _ = stash(hits.distinct(), "diagonals")
    right = diagonals.groupBy("_doc", "_hash").agg(F.collect_list(F.struct("_item", "d")).alias("_at")).withColumnsRenamed({"_doc": "_d", "_hash": "_h"})
    met = own.join(few(diagonals)(right), F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_h")))
    placed = met.select("_doc", "_hash", "tokens", F.explode("_at").alias("_at")).select("_doc", "_hash", "tokens", "_at.*")
    whole_items = items.select("_item", F.col("tokens").alias("_theirs"))
    both = placed.join(F.broadcast(whole_items) if total <= BROADCAST_TOKENS else whole_items, "_item")
    a, b, d = F.col("tokens"), F.col("_theirs"), F.col("d")
    i, j = F.greatest(d, F.lit(0)), F.greatest(-d, F.lit(0))
    length = F.least(F.size(a) - i, F.size(b) - j)
    same = F.zip_with(F.slice(a, i + 1, length), F.slice(b, j + 1, length), lambda x, y: x == y)
    compared = both.select("_doc", "_hash", "_item", i.alias("i"), j.alias("j"), F.size(b).alias("size"), F.least(F.lit(MIN_TOKENS), F.ceil(F.size(b) * MIN_SHARE)).alias("least"), same.alias("same"))
    agrees = lambda o: (o["n_equal"] >= F.col("least")) & (o["n_equal"] >= MIN_SHARE * o["n_compared"])
    # The best sum of a short item can end before worn words near its ends although the whole item agrees enough.
    fits = (F.col("size") * MIN_SHARE <= MIN_TOKENS) & (F.col("j") == 0) & (F.size("same") == F.col("size"))
    whole = F.struct(F.size(F.filter("same", lambda e: e)).alias("n_equal"), F.col("size").alias("n_compared"), F.lit(0).alias("start"))
    best = compared.select("_doc", "_hash", "_item", "i", "j", F.coalesce(_best_part(F.col("same"), agrees), F.when(fits & agrees(whole), whole)).alias("o")).filter("o is not null")
    place = F.struct(F.col("o.n_equal").alias("n_equal"), (-F.col("o.n_compared")).alias("less"), (-(F.col("i") + F.col("o.start"))).alias("s"), (-(F.col("j") + F.col("o.start"))).alias("t"))
    return best.groupBy("_doc", "_hash", "_item").agg(F.max(place).alias("b"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """id_col, item_col, n_equal, n_compared, doc_start, item_start: the best overlap of each pair that has one.

    Tokens are counted from 0. Null texts and null items match nothing; texts shorter than the shortest mask have no
    window. Rows with a null id are searched and have a null in the result; rows that repeat an id have one row for each
    of their texts that overlaps. Other columns are ignored. Seeds of the benchmark are broadcast in blocks of about
    BROADCAST_WINDOWS windows, a long item in several, so neither its size nor an item's has a limit.
    """
    found = _searched(docs, benchmark, id_col, item_col)
    return found.select(F.col("_doc").alias(id_col), F.col("_item").alias(item_col), F.col("b.n_equal").cast("bigint").alias("n_equal"), (-F.col("b.less")).cast("bigint").alias("n_compared"), (-F.col("b.s")).cast("bigint").alias("doc_start"), (-F.col("b.t")).cast("bigint").alias("item_start"))


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that overlap; clean documents have none."""
    return overlaps(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose texts overlap with an item, those with a null id too. Columns of any name are kept."""
    gone = _searched(docs, benchmark, "doc_id", "item_id").select("_doc", "_hash").distinct()
    return absent(docs, gone, [docs["doc_id"], F.xxhash64(F.coalesce(docs["text"], F.lit("")))])
