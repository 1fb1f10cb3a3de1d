"""Jaccard self-join of word-shingle sets with several global token orders; classes of linked documents.

Two sets link when 100 * intersection >= 75 * union. A set of n shingles then shares at least ceil(0.75 n) of them,
and under any fixed order of all shingles a linked pair meets in the first n - ceil(0.75 n) + 1 of each set. Order A is
rarity (document frequency, then hash), order B the hash, order C another hash. Exact steps, none of which drops a link:

1. Equal sets are one node, named by 64 bits of their signature.
2. Of the first SENT shares of each set under order B, a linked pair shares as many as the rest leaves room for. Sets
   that share fewer with all other sets together leave. Shingles go packed to buckets; those that meet in a task
   already are combined there, so that a common line costs an entry for each slice of rows, not for each set.
3. Among the rest, candidates meet in prefixes under A. Before whole sets are compared a pair must also meet under B and
   under C, and parity bits must not tell the sets apart.
4. For each prefix shingle, two leaders (the set whose shingles are the most frequent, and the smallest set) are
   compared with all sets that have it: as many candidates as rows. Then only sets of different classes so far are
   paired, at shingles that come early enough in both sets, and only such as the parity bits let pass. Sets of one
   class never give their pairs; sets that nearly link but don't are tested in the join and yield no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxara.llm.common import absent, drop_path, few, read_table, stash, tidy, words

SHINGLE, NUM, DEN, BITS = 5, 75, 100, 1024
#: Share of a set, first under order B, that step 2 compares; more lets fewer sets pass and sends more.
SENT = 0.4
#: Shingles that meet in one bucket of step 2, about, and rows of a slice that are combined before.
BUCKET_SHINGLES, SLICE = 1_000_000, 4_000
#: Odd multipliers that combine the word hashes of a shingle, and the one of order C.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_OTHER = np.uint64(0xD6E8FEB86659FD93)


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; of fewer than SHINGLE words the whole sequence is one."""
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    if len(w) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), len(w))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = len(w) - SHINGLE + 1
    out = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        x = h[i : i + n] * _MIX[i]
        out += x ^ (x >> np.uint64(29))
    out ^= out >> np.uint64(32)
    out *= _MIX[0]
    out ^= out >> np.uint64(29)
    return np.unique(out)


def _signature(s: np.ndarray) -> bytes:
    return hashlib.md5(s.tobytes()).digest()


def _key(signature: bytes) -> int:
    return int.from_bytes(signature[:8], "little", signed=True)


def _need(n: int) -> int:
    """Shingles that a set of n must share with a linked one, at least."""
    return -(-n * NUM // DEN)


def sent_size(n: int) -> int:
    return max(n - _need(n) + 1, -(-n * round(SENT * 100) // 100))


def _own_share(n: Column) -> Column:
    return F.ceil(n * NUM / DEN)


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def _rows(docs: DataFrame, id_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("bigint").alias("id"), F.xxhash64(_text(docs)).alias("text_hash"), _text(docs).cast("binary").alias("b"))


def signatures(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, text_hash, n, sig, key, first: of each row the size of its set, its 128-bit signature, the half that names the node, and its first hashes under order B, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["n", "sig", "key", "first"], [pa.int64(), pa.binary(), pa.int64(), pa.binary()]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part, out = batch.slice(at, 1000), []
                for cell in part.column(2):
                    s = shingles(cell.as_py())
                    sig = _signature(s)
                    out.append((len(s), sig, _key(sig), s[: sent_size(len(s))].tobytes()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=["id", "text_hash", *names])

    return _rows(docs, id_col).mapInArrow(tidy(run), "id bigint, text_hash bigint, n bigint, sig binary, key bigint, first binary")


def shared_counts(signed: DataFrame, buckets: int) -> DataFrame:
    """key, shared: of each node, the shingles sent that some other node sent too, at least.

    A shingle that two nodes of a slice have is known to be shared there: the slice counts it for them and sends it once,
    as common. Others go with their node. A bucket yields a row for each shingle of a node that it finds shared.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["bucket", "keys", "counts", "low", "common", "known", "times"], [pa.int64(), *[pa.binary()] * 6]
        low = lambda h: h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                key, one = np.unique(part.column(0).to_numpy(zero_copy_only=False), return_index=True)
                sets = [np.frombuffer(part.column(1)[i].as_py(), np.uint64) for i in one.tolist()]
                h, node = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                order = np.argsort(h, kind="stable")
                h, node = h[order], node[order]
                begins = np.r_[True, h[1:] != h[:-1]]
                alone = begins & np.r_[begins[1:], True]
                times = np.bincount(node[~alone], minlength=len(sets))
                common = h[begins & ~alone]
                h, node = h[alone], node[alone]
                b, cb = ((x >> np.uint64(40)) % np.uint64(buckets) for x in (h, common))
                order, corder = np.lexsort((node, b)), np.argsort(cb, kind="stable")
                h, node, b, common, cb = h[order], node[order], b[order], common[corder], cb[corder]
                out, seen = [], times > 0
                known = key[seen].astype("<i8").tobytes(), times[seen].astype("<u4").tobytes()
                for k in np.union1d(b, cb).tolist():
                    x, y = np.searchsorted(b, [k, k + 1]).tolist()
                    cx, cy = np.searchsorted(cb, [k, k + 1]).tolist()
                    own = node[x:y]
                    head = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if y > x else np.empty(0, np.int64)
                    out.append((k, key[own[head]].astype("<i8").tobytes(), np.diff(np.r_[head, y - x]).astype("<u4").tobytes(), low(h[x:y]), low(common[cx:cy]), *known))
                    known = b"", b""
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def meet(table: pa.Table) -> pa.Table:
        joined = lambda c, t: np.frombuffer(b"".join(table[c].to_pylist()), t)

        def wide(c: str) -> np.ndarray:
            out = np.zeros((len(low := joined(c, np.uint8).reshape(-1, 5)), 8), np.uint8)
            out[:, :5] = low
            return out.view("<u8").ravel()

        node, h, common = np.repeat(joined("keys", "<i8"), joined("counts", "<u4")), wide("low"), np.unique(wide("common"))
        order = np.lexsort((node, h))
        node, h = node[order], h[order]
        if len(h):
            new = np.r_[True, (h[1:] != h[:-1]) | (node[1:] != node[:-1])]  # equal sets of several slices are one node
            node, h = node[new], h[new]
            same = h[1:] == h[:-1]
            node = node[np.r_[False, same] | np.r_[same, False] | np.isin(h, common)]
        known, times = joined("known", "<i8"), joined("times", "<u4")
        return pa.table({"key": pa.array(np.r_[node, known], pa.int64()), "shared": pa.array(np.r_[np.ones(len(node), np.int64), times.astype(np.int64)], pa.int64())})

    packed = signed.select("key", "first").mapInArrow(tidy(pack), "bucket bigint, keys binary, counts binary, low binary, common binary, known binary, times binary")
    return packed.groupBy("bucket").applyInArrow(meet, "key bigint, shared bigint").groupBy("key").agg(F.sum("shared").alias("shared"))


def members(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, key, n, tokens in order B, the prefix under order C, and BITS bits: the parity of the number of tokens in each of as many groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, out = batch.slice(at, 500), []
                for cell in part.column(2):
                    s = shingles(cell.as_py())
                    mixed = s * _OTHER
                    other = s[np.argsort(mixed)[: len(s) - _need(len(s)) + 1]]
                    odd = np.bincount((mixed >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS) & 1
                    out.append((_key(_signature(s)), len(s), s.view(np.int64), other.view(np.int64), np.packbits(odd.astype(np.uint8)).view("<i8")))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=["id", "key", "n", "tokens", "other", "bits"])

    return _rows(docs, id_col).mapInArrow(tidy(run), "id bigint, key bigint, n bigint, tokens array<bigint>, other array<bigint>, bits array<bigint>")


def _early(x: str, y: str) -> Column:
    """Where the first shingle that sets x and y share under A is the r-th of the m that any set shares, m - r + 1 bounds the intersection."""
    c = lambda name, of: F.col(f"{name}{of}")
    most = F.least(c("m", x) - c("r", x), c("m", y) - c("r", y)) + 1
    return most * (DEN + NUM) >= (c("n", x) + c("n", y)) * NUM


def _few_differ(x: str, y: str) -> Column:
    """A shingle that one set alone has flips one parity bit, so differing bits bound the symmetric difference from below."""
    differ = sum((F.bit_count(F.get(f"bits{x}", F.lit(i)).bitwiseXOR(F.get(f"bits{y}", F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
    return differ * (DEN + NUM) <= (F.col(f"n{x}") + F.col(f"n{y}")) * (DEN - NUM)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that meet under orders B and C too and whose sets are similar enough; whole sets come in last."""
    first = F.slice("tokens", 1, (F.col("n") - _own_share(F.col("n")) + 1).cast("int"))

    def with_columns(to: DataFrame, **columns: Column) -> DataFrame:
        for x in ("a", "b"):
            to = to.join(sets.select(F.col("key").alias(x), *[c.alias(f"{name}{x}") for name, c in columns.items()]), x)
        return to

    met = with_columns(pairs, n=F.col("n"), bits=F.col("bits"), first=first, other=F.col("other")).filter(_few_differ("a", "b") & F.arrays_overlap("othera", "otherb") & F.arrays_overlap("firsta", "firstb"))
    both = with_columns(met.select("a", "b"), n=F.col("n"), tokens=F.col("tokens"))
    common = F.size(F.array_intersect("tokensa", "tokensb"))
    return both.filter(common * DEN >= (F.col("na") + F.col("nb") - common) * NUM).select("a", "b")


def components(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, str]:
    """key, label of nodes: the least key that edges (a, b) reach; also the path of the table.

    Labels move to neighbours and then to their labels' labels until none changes; each round is a table. A label that
    many nodes have is looked up in a table of nodes, which is broadcast where its size allows that.
    """
    both, both_path = stash(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges", packed=True)
    labels, path = stash(nodes.select("key", F.col("key").alias("label")), "labels", packed=True)
    look_up = few(labels)
    while True:
        near = both.join(look_up(labels.withColumnRenamed("key", "b")), "b").groupBy("a").agg(F.min("label").alias("near"))
        moved = labels.join(near, labels["key"] == near["a"], "left").select("key", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = look_up(moved.select(F.col("key").alias("label"), F.col("label").alias("far")))
        new, new_path = stash(moved.join(jump, "label", "left").select("key", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels", packed=True)
        changed = not new.filter("old <> label").isEmpty()
        drop_path(nodes.sparkSession, path)
        labels, path = new.select("key", "label"), new_path
        if not changed:
            drop_path(nodes.sparkSession, both_path)
            return labels, path


def prefixes(sets: DataFrame) -> DataFrame:
    """token, key, n, m, r, weight: the prefix of each set under order A. m: how many of its shingles other sets have; r: the token's rank among them."""
    each = sets.select("key", "n", F.explode("tokens").alias("token"))
    common = each.join(each.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "token")
    by_set = Window.partitionBy("key")
    ranked = common.select("*", F.row_number().over(by_set.orderBy("df", "token")).alias("r"), F.count("*").over(by_set).alias("m"), F.sum("df").over(by_set).alias("weight"))
    # Shingles that no other set has come first in order A, so a set's first common one is its (n - m + 1)-th.
    near = F.col("n") - F.col("m") + F.col("r") <= F.col("n") - _own_share(F.col("n")) + 1
    return ranked.filter(near).select("token", "key", "n", "m", "r", (F.col("weight") / F.col("n")).alias("weight"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(sets: DataFrame) -> tuple[DataFrame, str]:
    """key, label of the sets: equal labels where links reach; also the path of the table."""
    spark = sets.sparkSession
    prefix, prefix_path = stash(prefixes(sets), "prefixes", packed=True)
    one = lambda *c: F.struct(*c, "key", "n", "m", "r")
    leaders = prefix.groupBy("token").agg(F.array(F.max(one("weight")).dropFields("weight"), F.min(one(F.col("n").alias("weight"))).dropFields("weight")).alias("l"))
    lead = leaders.select("token", F.explode(F.array_distinct("l")).alias("l")).select("token", *[F.col(f"l.{c}").alias(f"{c}b" if c != "key" else "b") for c in ("key", "n", "m", "r")])
    sides = prefix.select("token", F.col("key").alias("a"), *[F.col(c).alias(f"{c}a") for c in ("n", "m", "r")])
    star, star_path = stash(_ordered(sides.join(lead, "token").filter(F.col("a") != F.col("b")).filter(_early("a", "b"))), "star", packed=True)
    edges, edges_path = stash(verified(star, sets), "links", packed=True)
    labels, path = components(sets, edges)
    placed = prefix.join(labels, "key")
    mixed = placed.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("token")
    rest = placed.join(mixed, "token").join(sets.select("key", "bits"), "key")
    side = lambda x: rest.select("token", F.col("key").alias(x), *[F.col(c).alias(f"{c}{x}") for c in ("n", "m", "r", "label", "bits")])
    cross = side("a").join(side("b"), "token").filter((F.col("a") < F.col("b")) & (F.col("labela") != F.col("labelb")) & _early("a", "b") & _few_differ("a", "b"))
    more, more_path = stash(verified(_ordered(cross), sets), "links", packed=True)
    if not more.isEmpty():
        drop_path(spark, path)
        labels, path = components(sets, edges.union(more))
    for p in (prefix_path, star_path, edges_path, more_path):
        drop_path(spark, p)
    return labels, path


def row_classes(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, text_hash, n, component of every row; see classes."""
    spark = docs.sparkSession
    signed, _ = stash(signatures(docs, id_col), "signatures")
    real = signed.filter("n > 0 and id is not null")
    total = real.select(F.sum(F.length("first") / 8)).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(-(-total // BUCKET_SHINGLES)))
    alike = real.groupBy("sig", "key", "n").agg(F.min("id").alias("id"))
    n = F.col("n")
    room = F.greatest(n - _own_share(n) + 1, F.ceil(n * round(SENT * 100) / 100)) - n + _own_share(n)
    left, left_path = stash(alike.join(shared_counts(real, buckets), "key").filter(F.col("shared") >= room).select("id", "key"), "similar", packed=True)
    named = alike.select("sig", F.col("id").alias("component"))
    if not left.isEmpty():
        mine = docs.select(F.col(id_col).cast("bigint").alias("id"), "text").join(few(left)(left.select("id").distinct()), "id", "left_semi")
        sets, sets_path = stash(members(mine, "id").join(few(left)(left), ["id", "key"]).drop("id").dropDuplicates(["key"]), "sets")
        labels, _ = links(sets)
        drop_path(spark, sets_path)
        of_label = labels.join(alike.select("key", "id"), "key").groupBy("label").agg(F.min("id").alias("component"))
        found = labels.join(of_label, "label").select("key", "component")
        named = alike.join(found, "key", "left").select("sig", F.coalesce("component", "id").alias("component"))
    drop_path(spark, left_path)
    return signed.select("id", "text_hash", "n", "sig").join(named, "sig", "left").select("id", "text_hash", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id")).alias("component"))


def classes(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, n_shingles, component_id of every row.

    A null or empty text has an empty set and is a class of its own; so is a row with a null id, with a null class.
    Rows that repeat an id have a result each: equal texts the same, different texts each that of its own set. Other
    columns are ignored, whatever their names. An empty table gives no rows.
    """
    return row_classes(docs, id_col).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of the documents; see classes for nulls, empty texts and repeated rows."""
    return classes(read_table(spark, sf_dir, "documents"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with the document of least id of each class alone.

    Documents without words and rows without an id all stay; of rows that repeat an id, those whose text is the class's
    stay. Columns of any other name are kept as they are.
    """
    extra = row_classes(docs).filter("component <> id").select("id", "text_hash").distinct()
    return absent(docs, extra, [docs["doc_id"].cast("bigint"), F.xxhash64(_text(docs))])
