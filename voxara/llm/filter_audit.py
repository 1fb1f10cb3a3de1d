"""Filter interaction audit: what five filters remove in every order, from Walsh-Hadamard sums of their failures.

Each document's failures are a mask of five bits. Per part and pair of labels the documents are summed 32 times with the
sign of the parity of mask & k; the transform is its own inverse but for a factor of 32, so the number of documents of
every mask comes back exactly, as integers. What a filter removes after any others, and its Shapley value, are sums of those cells.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxara.llm.common import join_hot, read_table, stash

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Least words, percent of distinct words, most percent of capitals, and characters of markup.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, MARKUP = 200, 50, 2, "[#$%&*|]"
_WORD = r"[^\x20\x09-\x0D]+"


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask, digest of every row of docs: a bit for each of the filters A to D that its text fails; digest: SHA-256 of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("_text"))
    found = rows.select("*", F.regexp_extract_all("_text", F.lit(_WORD), F.lit(0)).alias("_words"))
    sized = found.select("doc_id", "part", "_text", F.size("_words").alias("_n"), F.size(F.array_distinct("_words")).alias("_distinct"))
    bad = [
        F.col("_n") < MIN_WORDS,
        F.col("_distinct") * F.lit(100) < F.col("_n") * F.lit(MIN_DISTINCT),
        F.length(F.regexp_replace("_text", "[^A-Z]+", "")) * F.lit(100) > F.length("_text") * F.lit(MAX_CAPITALS),
        F.col("_text").rlike(MARKUP),
    ]
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(bad)), F.lit(0))
    return sized.select("doc_id", "part", mask.cast("int").alias("mask"), F.unhex(F.sha2("_text", 256)).alias("digest"))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (all five bits), good, toxic (0 or 1) of every row of docs.

    E fails where a smaller doc_id has an equal text; a null id is neither smaller nor larger, and rows that repeat an id
    are not copies of each other. A document is good or toxic if any row of labels with its id says so. Texts of many
    copies are looked up without a shuffle of their rows, see join_hot, and rows without an id take no part in the join with labels.
    """
    rows, _ = stash(failures(docs), "failures")
    copies = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).filter("copies > 1 and least is not null")
    copied = join_hot(rows, stash(copies, "copies", packed=True)[0], "digest", "copies", "left")
    all_bits = (F.col("mask") + F.when(F.col("doc_id") > F.col("least"), CELLS // 2).otherwise(0)).alias("mask")
    full = copied.select("doc_id", "part", all_bits)
    flags = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(*[F.max((F.col(c) == 1).cast("int")).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    columns = ["part", "mask", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("good", "toxic")]]
    known = full.filter("doc_id is not null").join(flags, "doc_id", "left").select(columns)
    return known.union(full.filter("doc_id is null").select("part", "mask", F.lit(0), F.lit(0)))


def _sign(mask: Column, k: Column) -> Column:
    """-1 where mask and k have an odd number of bits in common, else 1."""
    return F.lit(1) - F.lit(2) * (F.bit_count(mask.bitwiseAND(k)) % 2)


def parity_sums(rows: DataFrame) -> DataFrame:
    """part, good, toxic, sums: the 32 signed sums of rows (part, mask, good, toxic), summed within tasks before the shuffle."""
    sums = [F.sum(_sign(F.col("mask"), F.lit(k)).cast("bigint")).alias(f"s{k}") for k in range(CELLS)]
    return rows.groupBy("part", "good", "toxic").agg(*sums).select("part", "good", "toxic", F.array(*[f"s{k}" for k in range(CELLS)]).alias("sums"))


def cells(sums: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of every part and mask (zeros included), from the inverse transform of the sums."""
    each = sums.select("part", "good", "toxic", "sums", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))).alias("mask"))
    back = F.aggregate(F.transform("sums", lambda s, k: s * _sign(F.col("mask"), k)), F.lit(0).cast("bigint"), lambda a, b: a + b)
    counts = each.select("part", "mask", "good", "toxic", (back / CELLS).cast("bigint").alias("n"))
    return counts.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(c)).alias(c) for c in ("good", "toxic")])


def orders(table: DataFrame) -> DataFrame:
    """For each part every order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley, see op11_filter_audit."""
    packed = table.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("_m"))
    masks_ = F.sequence(F.lit(0), F.lit(CELLS - 1))
    of_masks = lambda c: F.transform(masks_, lambda k: F.element_at("_m", k)[c]).alias(f"_{c}")
    lists = packed.select("part", *map(of_masks, ("n", "good", "toxic")))
    steps = lists.select("*", F.explode(F.array(*[F.lit(o) for o in ORDERS])).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = lambda i: F.pow(F.lit(2), F.ascii(F.col("filter_order").substr(i, F.lit(1))) - ord(FILTERS[0])).cast("int")
    earlier = F.filter(F.sequence(F.lit(1), F.lit(len(FILTERS))), lambda i: i < F.col("step"))
    at = steps.select("*", F.aggregate(earlier, F.lit(0), lambda a, i: a + bit(i)).alias("_p"), bit(F.col("step")).alias("_b"))

    def total(column: str, which, weigh=lambda v, k: v) -> Column:
        chosen = F.transform(column, lambda v, k: F.when(which(k), weigh(v, k)).otherwise(0))
        return F.aggregate(chosen, F.lit(0).cast("bigint"), lambda a, b: a + b)

    fails = lambda k: k.bitwiseAND(F.col("_b")) != 0
    gone = lambda k: k.bitwiseAND(F.col("_p")) != 0
    share = lambda v, k: v * F.lit(len(ORDERS)) / F.bit_count(k)
    return at.select(
        "part",
        "filter_order",
        "step",
        total("_n", lambda k: ~fails(k) & ~gone(k)).alias("kept"),
        total("_n", lambda k: fails(k) & ~gone(k)).alias("removed"),
        total("_n", lambda k: fails(k) & gone(k)).alias("redundant"),
        F.get("_n", F.col("_b")).alias("unique_fails"),
        *[total(f"_{c}", lambda k: fails(k) & ~gone(k)).alias(f"{c}_lost") for c in ("good", "toxic")],
        total("_n", fails, lambda v, k: share(v, k).cast("bigint")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of orders, for every source of docs.

    Null sources and texts count as empty, null ids have no label and no earlier copy, repeated rows count each, repeated
    or null label rows are read as any of them, and other columns are ignored. Without documents there are no parts.
    """
    return orders(cells(parity_sums(masks(docs, labels))))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents; see audit for nulls and repeated rows."""
    return audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


SQL = r"""
WITH t AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
first_ AS (SELECT text, min(doc_id) AS least FROM t GROUP BY text),
flags AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS MATERIALIZED (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > least, false)] AS fails
  FROM w JOIN first_ USING (text) LEFT JOIN flags ON flags.doc_id = w.doc_id),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS MATERIALIZED (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
g AS MATERIALIZED (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
r AS MATERIALIZED (SELECT g.*, filter_order, list_transform(range(1, 6), lambda i: fails[ascii(filter_order[i]) - 64]) AS seq FROM g, o),
s AS MATERIALIZED (SELECT part, filter_order, step, good, toxic, n, seq[step] AS fail, list_count(list_filter(seq[1:step - 1], lambda x: x)) > 0 AS gone, len(list_filter(seq, lambda x: x)) AS k FROM r, (SELECT unnest(range(1, 6)) AS step)),
a AS (SELECT part, filter_order, step::INT AS step, filter_order[step] AS letter, sum(CASE WHEN NOT fail AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fail AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN fail AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fail AND k = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN fail AND NOT gone THEN n * good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN fail AND NOT gone THEN n * toxic ELSE 0 END)::BIGINT AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM a ORDER BY ALL
"""
