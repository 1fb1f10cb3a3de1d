"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of each text. A chunk begins at each word whose hash is the least (the last such) of
some reach words in a row, so a chunk's ends depend on the text within reach words alone, periodic text included.

1. Chunks that occur more than once in the corpus are anchors. Any min_words words in a row hold the ends of two
   windows of reach words, so a whole chunk at least, and their copies hold the same one.
2. Every run of min_words whole words (a window) whose inner chunks are all anchors is hashed, separators included. The
   windows whose first inner chunk is one and the same are a range; it travels as one row to its chunk's bucket, where
   windows are counted over the whole corpus; the first occurrence (least doc_id, then place) stays, others are repeats.
3. Repeated windows of a document that overlap or touch join to passages, which thereby reach to their true ends in words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxara.llm.common import few, join_hot, read_table, stash, tidy

#: A passage has over 50 words.
MIN_WORDS = 51
#: Bytes before a word that its hash takes in, and the words that these can reach back over.
WINDOW = 8
LEAD = WINDOW // 2
#: Bytes of a chunk at most; a longer one is cut at multiples from its own beginning.
MOST = 512
#: Windows that meet in one bucket, about.
BUCKET_WINDOWS = 1_000_000
#: A fixed table made by rule: one 32-bit number for each byte value.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], np.uint32)


def reach_of(min_words: int) -> int:
    """Words of a window: two in a row fit into min_words without the first LEAD."""
    if min_words < LEAD + 2:
        raise ValueError(f"min_words must be {LEAD + 2} at least")
    return (min_words - LEAD) // 2


def word_ends(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where blank-separated words start and stop."""
    edge = np.flatnonzero(np.diff(np.r_[True, (b == 32) | (b - np.uint8(9) < 5), True].view(np.int8)))
    return edge[::2], edge[1::2]


def least_words(b: np.ndarray, starts: np.ndarray, reach: int) -> np.ndarray:
    """For each reach words in a row, the number of the last one with the least hash."""
    n = len(starts) - reach + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.r_[np.uint32(0), GEAR[b]]  # at i: bytes before i
    step = 1
    while step < WINDOW:  # h(i) = gear(i) + 2 h(i-1), over WINDOW bytes, by doubling
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    key = h[starts].astype(np.uint64) << np.uint64(32) | (np.uint64(0xFFFFFFFF) - np.arange(len(starts), dtype=np.uint64))
    size = 1
    while 2 * size <= reach:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    key = np.minimum(key[:n], key[reach - size : reach - size + n])
    return (np.uint64(0xFFFFFFFF) - (key & np.uint64(0xFFFFFFFF))).astype(np.int64)


def _cuts(n: int, starts: np.ndarray, least: np.ndarray) -> list[int]:
    cuts = starts[least[np.r_[True, least[1:] != least[:-1]]]].tolist() if len(least) else []
    out, at = [], 0
    for m in [*cuts, n]:
        while m - at > MOST:
            at += MOST
            out.append(at)
        if m > at:
            at = m
            out.append(at)
    return out


def boundaries(data: bytes, min_words: int = MIN_WORDS) -> list[int]:
    """Ends of the chunks; the last is the length. Empty data has none."""
    b = np.frombuffer(data, np.uint8)
    starts, _ = word_ends(b)
    return _cuts(len(data), starts, least_words(b, starts, reach_of(min_words)))


def _digests(data: bytes, ends: list[int]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)], np.uint64).view(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.filter(docs["doc_id"].isNotNull()).select(docs["doc_id"].cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("b"))


def chunks(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, digest, n: the distinct chunks of each text of at least min_words words, with their occurrences in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                take, digests, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for i, cell in enumerate(part.column(1)):
                    data = cell.as_py() or b""
                    b = np.frombuffer(data, np.uint8)
                    starts, _ = word_ends(b)
                    if len(starts) < min_words:
                        continue
                    own, n = np.unique(_digests(data, _cuts(len(data), starts, least_words(b, starts, reach_of(min_words)))), return_counts=True)
                    take.append(np.full(len(own), i))
                    digests.append(own)
                    counts.append(n)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.concatenate(take))), pa.array(np.concatenate(digests)), pa.array(np.concatenate(counts), pa.int64())], names=["doc_id", "digest", "n"])

    return _texts(docs).select("doc_id", "b").mapInArrow(tidy(run), "doc_id bigint, digest bigint, n bigint")


def anchors(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, digests: each document's chunks that occur more than once in the corpus.

    Counts are combined before the shuffle, so a digest that a third of all rows hold costs a row per task; joined back,
    hot digests are kept apart.
    """
    all_, _ = stash(chunks(docs, min_words), "chunks")
    many, _ = stash(all_.groupBy("digest").agg(F.sum("n").alias("n")).filter("n > 1"), "anchors")
    return join_hot(all_.select("doc_id", "digest"), many, "digest", "n").groupBy("doc_id").agg(F.collect_set("digest").alias("digests"))


def ranges(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each run of windows that have the same first inner chunk and may occur elsewhere.

    d: the chunk's digest; k: a hash of the windows' digests; doc_id, text_hash, word, start: the first window's place;
    m: how many windows; digests: 5 bytes each; places: their starts and stops from start on, packed. Of the chunks
    within a window, those between the first and the last of its own windows of reach words are the same in any copy, so
    all must be anchors.
    """
    reach = reach_of(min_words)
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    names = ["i", "d", "k", "word", "start", "m", "digests", "places"]

    def of_text(i: int, data: bytes, found: np.ndarray) -> list[tuple]:
        b = np.frombuffer(data, np.uint8)
        starts, stops = word_ends(b)
        n = len(starts) - min_words + 1
        if n <= 0:
            return []
        least = least_words(b, starts, reach)
        ends = _cuts(len(data), starts, least)
        own = _digests(data, ends)
        other = np.r_[0, np.cumsum(~np.isin(own, found))]
        inner = np.searchsorted(np.array([0, *ends[:-1]]), starts[least])
        first, last = inner[LEAD : LEAD + n], inner[min_words - reach : min_words - reach + n]
        j = np.flatnonzero(other[first] == other[last])
        if not len(j):
            return []
        x, y, chunk = starts[j], stops[j + min_words - 1], first[j]
        hashes = np.array([xxhash.xxh3_64_intdigest(data[p:q]) for p, q in zip(x.tolist(), y.tolist(), strict=True)], "<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        cut = np.flatnonzero(np.r_[True, (j[1:] != j[:-1] + 1) | (chunk[1:] != chunk[:-1])])
        out = []
        for p, q in zip(cut.tolist(), [*cut[1:].tolist(), len(j)], strict=True):
            windows = hashes[p:q].tobytes()
            places = zlib.compress(np.r_[np.diff(x[p:q], prepend=x[p]), y[p:q] - x[p:q]].astype("<u4").tobytes(), 1)
            out.append((i, int(own[chunk[p]]), xxhash.xxh3_64_intdigest(windows, q - p) - (1 << 63), int(j[p]), int(x[p]), q - p, windows, places))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = [r for i, (cell, found) in enumerate(zip(part.column(2), part.column(3), strict=True)) for r in of_text(i, cell.as_py(), found.values.to_numpy())]
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(columns[0]), part.column(1).take(columns[0]), *columns[1:]], names=["doc_id", "text_hash", *names[1:]])

    return _texts(docs).join(anchors(docs, min_words), "doc_id").select("doc_id", "text_hash", "b", "digests").mapInArrow(tidy(run), "doc_id bigint, text_hash bigint, d bigint, k bigint, word int, start int, m int, digests binary, places binary")


def _placed(places: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where a range's windows start, from its first on, and their sizes."""
    a = np.frombuffer(zlib.decompress(places), "<u4").astype(np.int64)
    return np.cumsum(a[: len(a) // 2]), a[len(a) // 2 :]


def _first_of(*columns: np.ndarray) -> np.ndarray:
    """Where rows of sorted columns differ from those before."""
    return np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)] if len(columns[0]) else np.empty(0, bool)


def repeated(found: DataFrame, buckets: int) -> DataFrame:
    """d, k, lo, hi, n, f_doc, f_hash, f_start, begin, end, least, most: the runs of windows lo to hi of the ranges (d, k) that occur elsewhere too.

    n: occurrences; the first occurrence of window lo is at f_start of document f_doc with text f_hash, and those of the
    others follow it as in the range. begin, end: bytes from the range's start; least, most: sizes of the windows. Equal ranges of a slice of rows are combined before they go to their bucket, so
    what many documents hold reaches it once for each slice.
    """
    place = ["doc_id", "text_hash", "start"]
    schema = "bucket bigint, d bigint, k bigint, n bigint, f0 bigint, f1 bigint, f2 bigint, l0 bigint, l1 bigint, l2 bigint, digests binary, places binary"
    fields = [f.split(" ")[0] for f in schema.split(", ")]

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, k, *p = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("d", "k", *place))
            order = np.lexsort((p[2], p[1], p[0], k, d))
            head = np.flatnonzero(_first_of(d[order], k[order]))
            tail = np.r_[head[1:], len(order)] - 1
            one = order[head]
            rest = [batch.column(batch.schema.get_field_index(c)).take(pa.array(one)) for c in ("digests", "places")]
            own = [d[one].view(np.uint64) % np.uint64(buckets), d[one], k[one], tail - head + 1, *(c[one] for c in p), *(c[order[tail]] for c in p)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in own), *rest], names=fields)

    def meet(table: pa.Table) -> pa.Table:
        col = lambda c: table[c].to_numpy().astype(np.int64)
        d, k, n, first, last = col("d"), col("k"), col("n"), [col(f"f{i}") for i in range(3)], [col(f"l{i}") for i in range(3)]
        digests, spans = table["digests"].to_pylist(), [_placed(x) for x in table["places"].to_pylist()]
        size = np.array([len(x) // 5 for x in digests])
        wide = np.zeros((size.sum(), 8), np.uint8)
        wide[:, :5] = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 5)
        w, row = wide.view("<u8").ravel(), np.repeat(np.arange(len(d)), size)
        rel, length = np.concatenate([s for s, _ in spans]), np.concatenate([s for _, s in spans])
        # Each window stands at its range's first place, which counts, and at its last.
        twice = lambda x: np.r_[x, x]
        at = [np.r_[f[row], t[row]] for f, t in zip(first, last, strict=True)]
        at[2] = at[2] + twice(rel)
        order = np.lexsort((at[2], at[1], at[0], twice(w), twice(d[row])))
        begin = _first_of(twice(d[row])[order], twice(w)[order])
        head = np.flatnonzero(begin)
        tail = np.r_[head[1:], len(order)] - 1
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(begin) - 1
        group = group[: len(row)]
        count = np.add.reduceat(np.r_[n[row], np.zeros(len(row), np.int64)][order], head)
        f, t = [c[order[head]] for c in at], [c[order[tail]] for c in at]
        again = (count > 1) & ((f[0] != t[0]) | (f[1] != t[1]) | (t[2] >= f[2] + twice(length)[order[head]]))
        # One row of each range gives its runs.
        pick = np.lexsort((k, d))
        chosen = np.zeros(len(d), bool)
        chosen[pick[_first_of(d[pick], k[pick])]] = True
        pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        use = np.flatnonzero(chosen[row] & again[group])
        g, r, i = group[use], row[use], pos[use]
        f0, f1, f2, c = f[0][g], f[1][g], f[2][g], count[g]
        new = np.flatnonzero(_first_of(r, i - np.arange(len(i)), f0, f1, f2 - rel[use], c)) if len(use) else np.empty(0, np.int64)
        end = np.r_[new[1:], len(use)] - 1 if len(use) else new
        out = {"d": d[r[new]], "k": k[r[new]], "lo": i[new].astype(np.int32), "hi": i[end].astype(np.int32), "n": c[new], "f_doc": f0[new], "f_hash": f1[new], "f_start": f2[new]}
        at_use, size_use = rel[use], length[use]
        fewest = [f.reduceat(size_use, new) if len(new) else size_use for f in (np.minimum, np.maximum)]
        out |= dict(zip(("begin", "end", "least", "most"), (c.astype(np.int32) for c in (at_use[new], at_use[end] + size_use[end], *fewest)), strict=True))
        return pa.table({name: pa.array(x) for name, x in out.items()})

    packed = found.select("d", "k", *place, "digests", "places").mapInArrow(tidy(combine), schema)
    return packed.groupBy("bucket").applyInArrow(meet, "d bigint, k bigint, lo int, hi int, n bigint, f_doc bigint, f_hash bigint, f_start bigint, begin int, end int, least int, most int")


def _passages(docs: DataFrame, min_words: int) -> DataFrame:
    """passages with the text_hash of each."""
    spark = docs.sparkSession
    found, _ = stash(ranges(docs, min_words), "ranges")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(found.select(F.sum("m")).first()[0] or 0) // BUCKET_WINDOWS))
    runs, _ = stash(repeated(found, buckets), "repeated")
    each = found.select("d", "k", "doc_id", "text_hash", "word", "start", "places").join(runs, ["d", "k"])
    gap = F.col("start") + F.col("begin") - F.col("f_start")
    own = (F.col("doc_id") == F.col("f_doc")) & (F.col("text_hash") == F.col("f_hash"))
    # Windows that overlap their own first occurrence stay; only where some of a run do, their sizes are looked up.
    torn = F.when(own & (gap >= F.col("least")) & (gap < F.col("most")), F.struct("places", "lo", "hi", F.col("word").alias("w"), F.col("start").alias("s"), gap.alias("gap")))
    fields = {"low": F.col("word") + F.col("lo"), "high": F.col("word") + F.col("hi"), "start": F.col("start") + F.col("begin"), "stop": F.col("start") + F.col("end"), "n": F.col("n"), "f_doc": F.col("f_doc"), "f_start": F.col("f_start"), "again": ~own | (gap >= F.col("most")), "torn": torn}
    by_doc = each.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct(*[c.alias(name) for name, c in fields.items()])).alias("c"))
    names = ["doc_id", "text_hash", "start", "stop", "n_words", "n_copies", "first_doc_id", "first_start", "repeats"]

    def whole_parts(c: dict, n: int, f_doc: int) -> list[tuple]:
        """low, high, start, stop, n, f_doc, f_start, again of the parts of a torn run."""
        starts, sizes = _placed(c["places"])
        again = c["gap"] >= sizes[c["lo"] : c["hi"] + 1]
        edge = np.flatnonzero(np.r_[True, again[1:] != again[:-1]]).tolist()
        out = []
        for p, q in zip(edge, [*edge[1:], len(again)], strict=True):
            x, y = c["lo"] + p, c["lo"] + q - 1
            start = c["s"] + int(starts[x])
            out.append((c["w"] + x, c["w"] + y, start, c["s"] + int(starts[y] + sizes[y]), n, f_doc, start - c["gap"], int(again[p])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                cells = part.column(2).flatten()
                doc = np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(part.column(2)).to_numpy())
                columns = [cells.field(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("low", "high", "start", "stop", "n", "f_doc", "f_start", "again")]
                torn_ = cells.field("torn")
                split = np.flatnonzero(torn_.is_valid().to_numpy(zero_copy_only=False))
                if len(split):
                    parts = [(int(doc[i]), *p) for i in split.tolist() for p in whole_parts(torn_[i].as_py(), int(columns[4][i]), int(columns[5][i]))]
                    keep = np.setdiff1d(np.arange(len(doc)), split)
                    added = np.array(parts, np.int64)
                    doc = np.r_[doc[keep], added[:, 0]]
                    columns = [np.r_[c[keep], added[:, k]] for k, c in enumerate(columns, 1)]
                low, high, start, stop, n, f_doc, f_start, again = columns
                order = np.lexsort((high, low, again, doc))
                low, high, start, stop, n, f_doc, f_start, again, doc = (c[order] for c in (*columns, doc))
                group = np.cumsum(_first_of(doc, again)) - 1
                top = np.maximum.accumulate(high + (group << 32)) - (group << 32)
                new = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (low[1:] > top[:-1] + min_words)])
                last = np.maximum.reduceat(high, new)
                out = [start[new], np.maximum.reduceat(stop, new), last - low[new] + min_words, np.minimum.reduceat(n, new), f_doc[new], f_start[new]]
                ids = pa.array(doc[new])
                yield pa.RecordBatch.from_arrays([part.column(0).take(ids), part.column(1).take(ids), *map(pa.array, out), pa.array(again[new] == 1)], names=names)

    return by_doc.mapInArrow(tidy(run), ", ".join(f"{n} bigint" for n in names[:-1]) + ", repeats boolean")


def passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start, stop (bytes), n_words, n_copies, first_doc_id, first_start, repeats: the repeated passages.

    A passage is whole words. Those with repeats hold what is found at an earlier place, those without what stays: first
    occurrences, and what overlaps its own first occurrence. The two kinds may overlap, as where a passage that is
    copied from one document goes on into one that is first here. n_copies is the least number of occurrences of the
    words min_words in a row, first_doc_id and first_start are of the first such. Equal rows are one place, and of rows
    that repeat an id each different text is one. doc_ids are integers; rows without one, null texts and texts under
    min_words words have no passages. Other columns are ignored.
    """
    return _passages(docs, min_words).drop("text_hash")


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs whose texts lack the repeats; first occurrences stay. Documents without repeats, or without an id, are unchanged, and so are columns of any other name."""
    cut = _passages(docs, min_words).filter("repeats").groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("_passage_cuts")).withColumnsRenamed({"doc_id": "_passage_doc", "text_hash": "_passage_hash"})
    cut, _ = stash(cut, "cuts")
    text, spans = docs["text"].cast("binary"), cut["_passage_cuts"]
    size = F.length(text)
    step = lambda acc, c: F.struct(c["stop"].alias("at"), F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(c["start"] - acc["at"], F.lit(0)).cast("int"))).alias("out"))
    rest = F.aggregate(spans, F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(b"").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), size)))
    joined = docs.join(few(cut)(cut), (docs["doc_id"].cast("bigint") == cut["_passage_doc"]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == cut["_passage_hash"]), "left")
    return joined.select(*[F.when(spans.isNull(), docs["text"]).otherwise(rest.cast("string")).alias(c) if c == "text" else docs[c] for c in docs.columns])


def op3_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each repeated passage; documents without one have none."""
    return passages(read_table(spark, sf_dir, "documents"))
