"""Near-duplicate vectors by iterative quantisation: balanced binary codes from learned rotations, multi-index Hamming tables, and a rerank with the original vectors.

Equal vectors are one class, told by a 64-bit hash, with a number of copies. Rotations are fitted on SAMPLE classes at most
and every class gets BITS bits from each. Codes are cut into substrings, each an index of its own: their length grows with
the table, so that buckets don't, and there are as many as find a pair of cosine THRESHOLD in RECALL of all cases.
Candidates share a substring and differ in few bits.

Vectors close to one leader form a ball, within which any two are linked by the triangle inequality; a large group of near
copies is thus counted without its pairs. Candidates are pairs of balls, and a vector is linked with all of another
ball, with none of it or, where angles leave that open, with the members that cosines say. Counts are exact over all pairs
of balls that are found, and nothing is linked below THRESHOLD.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxara.llm.common import Batches, few, join_hot, read_table, stash, tidy
from voxara.llm.ngram_join import components

THRESHOLD, RECALL = 0.9, 0.92
ANGLE = math.acos(THRESHOLD)
#: Classes that rotations are fitted on at most, rounds of a fit, and bits of a code.
SAMPLE, ROUNDS, BITS = 10_000, 30, 64
#: Unrelated vectors that a bucket holds on average, about.
BUCKET = 64
#: Tables that leaders are looked for in, and leaders tried within a bucket. What finds none is a ball of its own.
LEADER_TABLES, LEADER_ROUNDS = 5, 16
#: Standard deviations of the number of differing bits, beyond the mean, up to which pairs are candidates.
DEVIATIONS = 3.5
#: Rows compared at once; buckets of which the sample shows MANY rows and, altogether, more than a tile are dealt over tiles (LEADER_TILE while leaders are sought).
TILE, LEADER_TILE, MANY = 1_000, 250, 5
#: Vectors that are broadcast at most.
BROADCAST_VECTORS = 20_000
#: Radians that angles may be off by.
SLACK = 1e-6
#: A bucket's name: table, substring, two tiles and whether the row is of the second.
_TILES = 1 << 12


def substring_bits(n: int) -> int:
    return min(32, max(8, round(math.log2(max(n, 2) / BUCKET))))


def table_count(bits: int) -> int:
    """Substrings of which a pair at THRESHOLD shares one at least, with probability RECALL."""
    return min(31, math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - ANGLE / math.pi) ** bits)))


def fit(vectors: np.ndarray, rotations: int) -> np.ndarray:
    """Rotations: matrices of dimensions x BITS, fitted to unit vectors.

    Principal axes, then alternately the binary codes nearest to the rotated data and the rotation nearest to the codes, from
    several random starts. Axes go through the origin and not the mean, so that bits tell angles and near copies
    stay together where they are most of the data. With fewer dimensions than BITS, bits beyond the first fit's come from its starts.
    """
    width = min(BITS, vectors.shape[1])
    axes = np.linalg.eigh(vectors.T @ vectors)[1][:, ::-1][:, :width]
    data, rng = vectors @ axes, np.random.default_rng(7)

    def one(rounds: int) -> np.ndarray:
        turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(data.T @ np.where(data @ turn >= 0, 1.0, -1.0))
            turn = left @ right
        return axes @ turn

    return np.stack([np.hstack([one(0 if i else ROUNDS) for i in range(-(-BITS // width))])[:, :BITS] for _ in range(rotations)])


def encode(vectors: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Codes (vectors x rotations) as signed 64-bit integers."""
    weights = np.left_shift(np.uint64(1), np.arange(BITS, dtype=np.uint64))
    return np.stack([((vectors @ t >= 0) * weights).sum(1, dtype=np.uint64).view(np.int64) for t in turns], axis=1)


def _units(column: pa.Array, width: int) -> np.ndarray:
    """Lists as unit vectors of float64, shorter ones filled with zeros and longer ones cut; for codes alone."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False).astype(float), np.diff(lists.offsets.to_numpy())
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row, inside = np.repeat(np.arange(len(sizes)), sizes), place < width
    out = np.zeros((len(sizes), width))
    out[row[inside], place[inside]] = flat[inside]
    out /= np.maximum(np.abs(out).max(1, keepdims=True, initial=0), 1e-300)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def vectors_of(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, key, v of every row; key is the vector's hash, and both are null for those that link with nothing."""
    v = F.col(vector_col)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.col(id_col).isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0)
    safe = F.when(good, F.transform(v, lambda x: x + 0))  # -0 becomes 0
    return table.select(F.col(id_col).cast("bigint").alias("id"), safe.alias("v")).select("id", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("key"), "v")


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def unit(v: Column) -> Column:
    """A vector of doubles of length 1, by its largest component first, so that squares neither overflow nor vanish."""
    doubles = F.transform(v, lambda x: x.cast("double"))
    large = _with(F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))), lambda most: F.transform(doubles, lambda x: x / most))
    return _with(large, lambda u: _with(F.sqrt(F.aggregate(u, F.lit(0.0), lambda a, x: a + x * x)), lambda norm: F.transform(u, lambda x: x / norm)))


def cosine(a: str, b: str) -> Column:
    """Of two columns of unit vectors; null where their lengths differ."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def coded(rows: DataFrame, turns: np.ndarray) -> DataFrame:
    """key, id (the least), copies, code of each class; copies are merged within tasks before the shuffle."""
    width = turns.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                found = encode(_units(batch.column("v"), width), turns)
                code = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, found.shape[1]), pa.int32()), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), code], ["key", "id", "code"])

    each = rows.filter("key is not null").select("key", "id", "v").mapInArrow(tidy(run), "key bigint, id bigint, code array<bigint>")
    return each.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("code").alias("code"))


def hot_buckets(codes: np.ndarray, bits: int, tables: int, whole: int, tile: int) -> dict[int, int]:
    """Tiles of the buckets that hold MANY of the sampled codes and, by their share of whole, more than tile rows."""
    per, out = BITS // bits, {}
    for t in range(tables):
        parts = (codes[:, t // per].view(np.uint64) >> np.uint64(t % per * bits)) & np.uint64((1 << bits) - 1)
        for part, n in Counter(parts.tolist()).items():
            tiles = -(-n * whole // (len(codes) * tile))
            if n >= MANY and tiles > 1:
                out[t << 32 | part] = min(tiles, _TILES - 1)
    return out


def buckets(points: DataFrame, bits: int, tables: int, hot: dict[int, int], pairs: bool) -> DataFrame:
    """bucket besides points' columns: a row for each substring of code.

    Rows of a hot bucket go to one of its tiles or, for pairs, to every pair of tiles that has theirs.
    """
    per = BITS // bits
    each = points.select("*", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))).alias("_t")).select("*", F.get("code", (F.col("_t") / per).cast("int")).alias("_c"))
    part = F.expr(f"shiftrightunsigned(_c, _t % {per} * {bits})").bitwiseAND(F.lit((1 << bits) - 1))
    named = each.select("*", (F.col("_t").cast("bigint") * (1 << 32) + part).alias("_part"))
    tiles = F.lit(1)
    if hot:
        known = points.sparkSession.createDataFrame(list(hot.items()), "_part bigint, _tiles int")
        named, tiles = named.join(F.broadcast(known), "_part", "left"), F.coalesce("_tiles", F.lit(1))
    own = F.pmod(F.xxhash64("key"), tiles)
    side = lambda i, j, second: (i * _TILES + j) * 2 + second.cast("bigint")
    if pairs:
        every = F.transform(F.sequence(F.lit(0).cast("bigint"), tiles.cast("bigint") - 1), lambda o: side(F.least(o, own), F.greatest(o, own), own > o))
        named = named.select("*", F.explode(every).alias("_s"))
    else:
        named = named.select("*", side(own, own, F.lit(False)).alias("_s"))
    return named.select((F.col("_part") * F.lit(2 * _TILES * _TILES) + F.col("_s")).alias("bucket"), *points.columns)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict[str, np.ndarray]]]:
    """Each run of one bucket's rows (both sides of a pair of tiles), whether it is a tile with itself, and its columns; code as a matrix."""
    rest: pa.Table | None = None

    def columns(table: pa.Table) -> tuple[bool, dict[str, np.ndarray]]:
        out = {n: table.column(n).to_numpy() for n in table.column_names if n != "code"}
        code = table.column("code").combine_chunks().flatten().to_numpy().reshape(len(table), -1)
        tiles = int(out["bucket"][0]) // 2 % (_TILES * _TILES)
        return tiles // _TILES == tiles % _TILES, out | {"code": code}

    for batch in batches:
        now = pa.Table.from_batches([batch])
        table = now if rest is None else pa.concat_tables([rest, now])
        names = table.column("bucket").to_numpy() // 2
        cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield columns(table.slice(a, b - a))
        rest = table.slice(cuts[-1])
    if rest is not None and len(rest):
        yield columns(rest)


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of every code of a and every code of b."""
    return sum((np.bitwise_count(a[:, i, None] ^ b[None, :, i]).astype(np.int32) for i in range(a.shape[1])), np.int32(0))


def bits_within(angle: np.ndarray | float, bits: int) -> np.ndarray:
    """Bits that two codes differ in at most where vectors are at angle, but for chance beyond DEVIATIONS."""
    p = np.minimum(angle / math.pi, 0.5)
    return np.floor(bits * p + DEVIATIONS * np.sqrt(bits * p * (1 - p)))


def _by_bucket(rows: DataFrame, run: Batches, schema: str) -> DataFrame:
    """run over rows in the order of buckets, of which each lies within one task."""
    dealt = rows.select(F.shiftright("bucket", 1).alias("_place"), "*").repartition("_place").sortWithinPartitions("bucket", "key").drop("_place")
    return dealt.mapInArrow(tidy(run), schema)


def leaders(points: DataFrame, bits: int, tables: int, hot: dict[int, int]) -> DataFrame:
    """key, leader of the points that are near a lesser key in a bucket: the least such key, which may have a leader itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, g in _runs(batches):
            key, code, left = g["key"], g["code"], np.arange(len(g["key"]))
            limit = bits_within(ANGLE / 2, code.shape[1] * BITS)
            for _ in range(LEADER_ROUNDS):
                if len(left) < 2:
                    break
                first, others = left[0], left[1:]
                close = _differing(code[first : first + 1], code[others])[0] <= limit
                if close.any():
                    yield pa.RecordBatch.from_arrays([pa.array(key[others[close]]), pa.array(np.full(close.sum(), key[first]))], ["key", "leader"])
                left = others[~close]

    at = buckets(points.select("key", "code"), bits, min(LEADER_TABLES, tables), hot, False)
    return _by_bucket(at, run, "key bigint, leader bigint").groupBy("key").agg(F.min("leader").alias("leader"))


def fetched(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """key, v (a unit vector) of the classes of keys (a stored table of distinct keys), from the rows themselves."""
    mine = rows.filter("key is not null").select("key", "v").join(few(keys)(keys), "key", "left_semi")
    return mine.groupBy("key").agg(F.first("v").alias("v")).select("key", unit(F.col("v")).alias("v"))


def with_vectors(df: DataFrame, vectors: DataFrame, key: str, name: str) -> DataFrame:
    """df with the vector of its column key as name; vectors (stored) are broadcast where they are few, and shuffled else."""
    table = vectors.select(F.col("key").alias(key), F.col("v").alias(name))
    return df.join(F.broadcast(table) if vectors.count() <= BROADCAST_VECTORS else table, key)


def balls(rows: DataFrame, points: DataFrame, found: DataFrame) -> DataFrame:
    """key, ball, angle of the points that lie within half of ANGLE of the leader that found names, or the leader's own; leaders excluded."""
    lead, _ = stash(found, "leaders", packed=True)
    next_ = lead.select(F.col("key").alias("leader"), F.col("leader").alias("_next"))
    for _ in range(2):  # a leader with a leader hands its points on
        lead = lead.join(few(next_)(next_), "leader", "left").select("key", F.coalesce("_next", "leader").alias("leader"))
    roots, _ = stash(lead.join(few(next_)(next_.select("leader")), "leader", "left_anti"), "roots", packed=True)
    vectors, _ = stash(fetched(rows, stash(roots.select("key").union(roots.select("leader")).distinct(), "keys", packed=True)[0]), "near", packed=True)
    mine = with_vectors(roots, vectors, "key", "a")
    counted, _ = stash(roots.groupBy("leader").agg(F.count("*").alias("members")).join(vectors.select(F.col("key").alias("leader"), F.col("v").alias("b")), "leader"), "centres", packed=True)
    both = mine.join(F.broadcast(counted), "leader") if counted.count() <= BROADCAST_VECTORS else join_hot(mine, counted, "leader", "members")
    near = both.select("key", F.col("leader").alias("ball"), cosine("a", "b").alias("cos")).filter("cos is not null")
    return near.select("key", "ball", F.acos(F.least("cos", F.lit(1.0))).alias("angle")).filter(F.col("angle") <= ANGLE / 2 - SLACK)


def candidates(points: DataFrame, bits: int, tables: int, hot: dict[int, int]) -> DataFrame:
    """a, b: pairs of balls with members in one bucket whose leaders' codes are as near as linked members allow.

    points: ball, code, lead (the leader's code), radius of every class; members of one ball in one bucket are one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for same, g in _runs(batches):
            second = g["bucket"] % 2 == 1
            sides = [np.arange(len(second))] * 2 if same else [np.flatnonzero(~second), np.flatnonzero(second)]
            for i in range(0, len(sides[0]), TILE):
                for j in range(i if same else 0, len(sides[1]), TILE):
                    a, b = sides[0][i : i + TILE], sides[1][j : j + TILE]
                    limit = bits_within(ANGLE + g["radius"][a][:, None] + g["radius"][b][None, :], g["code"].shape[1] * BITS)
                    near = (_differing(g["code"][a], g["code"][b]) <= limit) & (g["key"][a][:, None] != g["key"][b][None, :])
                    x, y = np.nonzero(near)
                    if len(x):
                        x, y = g["key"][a[x]], g["key"][b[y]]
                        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
                        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    one = points.filter("members = 1").select(F.col("ball").alias("key"), "code", "radius")
    many = points.filter("members > 1").select(F.col("ball").alias("key"), "code", "lead", "radius")
    dealt = buckets(many, bits, tables, hot, True).groupBy("bucket", "key").agg(F.first("lead").alias("code"), F.first("radius").alias("radius"))
    return _by_bucket(buckets(one, bits, tables, hot, True).union(dealt), run, "a bigint, b bigint").distinct()


def reranked(rows: DataFrame, points: DataFrame, found: DataFrame) -> DataFrame:
    """key, a, b, n: n (more than 0) vectors of ball b are linked with class key of ball a; found has each pair of balls once."""
    pairs, _ = stash(found, "pairs", packed=True)
    both = pairs.union(pairs.select("b", "a"))
    ball = points.groupBy("ball").agg(F.sum("copies").alias("weight"), F.first("radius").alias("radius"), F.first("members").alias("members"))
    touched, _ = stash(both.select(F.col("a").alias("ball")).distinct(), "touched", packed=True)
    mine, _ = stash(points.join(few(touched)(touched), "ball", "left_semi").select("key", "ball", "copies", "members"), "members", packed=True)
    vectors, _ = stash(fetched(rows, mine.select("key")), "near", packed=True)
    ball, _ = stash(ball.join(few(touched)(touched), "ball", "left_semi"), "balls", packed=True)
    to = few(ball)(ball.select(F.col("ball").alias("b"), "weight", "radius", F.col("members").alias("others")))
    full, _ = stash(both.join(to, "b"), "both", packed=True)
    side = mine.select("key", F.col("ball").alias("a")).join(few(full)(full), "a")
    angled = with_vectors(with_vectors(side, vectors, "key", "u"), vectors, "b", "w").select("key", "a", "b", "weight", "radius", "others", cosine("u", "w").alias("cos")).filter("cos is not null")
    angle = F.acos(F.greatest(F.least("cos", F.lit(1.0)), F.lit(-1.0)))
    state = F.when(F.col("others") == 1, F.when(F.col("cos") >= THRESHOLD, "all").otherwise("none")).when(angle + F.col("radius") <= ANGLE - SLACK, "all").when(angle - F.col("radius") > ANGLE + SLACK, "none").otherwise("open")
    judged, _ = stash(angled.select("key", "a", "b", "weight", state.alias("state")).filter("state <> 'none'"), "judged", packed=True)
    whole = judged.filter("state = 'all'").select("key", "a", "b", F.col("weight").alias("n"))
    unsure = judged.filter("state = 'open'").select("key", "a", "b").join(mine.select(F.col("ball").alias("b"), F.col("key").alias("other"), "copies"), "b")
    linked = with_vectors(with_vectors(unsure, vectors, "key", "u"), vectors, "other", "w").filter(cosine("u", "w") >= THRESHOLD)
    return whole.union(linked.groupBy("key", "a", "b").agg(F.sum("copies").alias("n")))


def links(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id_col, n_links, component_id, kept of every row.

    Rows without an id and vectors that are null, empty or zero or hold null or infinite components or NaN link with
    nothing and are classes of their own; so are vectors of different lengths to each other. Rows that repeat an id are vectors
    like others. Other columns are ignored, and an empty table gives no rows.
    """
    rows = vectors_of(table, id_col, vector_col)
    result = lambda df, n, component: df.select(F.col("id").alias(id_col), n.alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
    whole = rows.count()
    if not whole:
        return result(rows, F.lit(0).cast("bigint"), F.col("id"))
    chosen = rows.filter("key is not null").filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < max(1, min(1 << 30, math.ceil((1 << 30) * 1.2 * SAMPLE / whole))))
    drawn = chosen.groupBy("key").agg(F.first("v").alias("v")).orderBy(F.xxhash64("key")).limit(SAMPLE).toArrow()
    bits = substring_bits(whole)
    tables = table_count(bits)
    width = max((len(v) for v in drawn.column("v").to_pylist()), default=1)
    sample = _units(drawn.column("v"), width)
    turns = fit(sample if len(sample) else np.zeros((1, width)), -(-tables // (BITS // bits)))
    points, _ = stash(coded(rows, turns), "codes")
    sampled = encode(sample, turns)
    hot, warm = (hot_buckets(sampled, bits, tables, whole, tile) if len(sampled) else {} for tile in (TILE, LEADER_TILE))
    in_balls, _ = stash(balls(rows, points, leaders(points, bits, tables, warm)), "balls", packed=True)
    led = in_balls.join(points.select("key", "id", "copies"), "key")
    sizes, _ = stash(led.groupBy("ball").agg(F.max("angle").alias("radius"), (F.count("*") + 1).alias("members")), "sizes", packed=True)
    of = in_balls.select("key", "ball")
    leads = points.join(few(sizes)(sizes), points["key"] == sizes["ball"]).select("ball", F.col("code").alias("lead"), "radius", "members")
    placed = points.join(few(of)(of), "key", "left").select("key", "id", "copies", "code", F.coalesce("ball", "key").alias("ball"))
    balled, _ = stash(placed.join(few(sizes)(leads), "ball", "left").select("key", "id", "copies", "code", "lead", "ball", F.coalesce("radius", F.lit(0.0)).alias("radius"), F.coalesce("members", F.lit(1)).alias("members")), "points")
    counts, _ = stash(reranked(rows, balled, candidates(balled, bits, tables, hot)), "links", packed=True)
    edges = counts.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    nodes, _ = stash(edges.select(F.col("a").alias("key")).union(edges.select("b")).distinct(), "nodes", packed=True)
    labels, _ = components(nodes, edges)
    named = balled.groupBy("ball").agg(F.min("id").alias("id"), F.sum("copies").alias("weight")).join(labels.select(F.col("key").alias("ball"), "label"), "ball", "left").select("ball", "id", "weight", F.coalesce("label", "ball").alias("label"))
    groups, _ = stash(named, "groups")
    grouped = groups.join(groups.groupBy("label").agg(F.min("id").alias("component")), "label").select("ball", "weight", "component")
    more = counts.groupBy("key").agg(F.sum("n").alias("n"))
    found = balled.select("key", "copies", "ball").join(grouped, "ball").join(more, "key", "left")
    classes, _ = stash(found.select("key", "copies", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n"), "component"), "classes")
    joined = join_hot(rows.select("id", "key"), classes, "key", "copies", "left")
    return result(joined, F.coalesce("n", F.lit(0)).cast("bigint"), F.coalesce("component", "id"))


def op13_itq_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings; see links for nulls, repeated ids and vectors that link with nothing."""
    return links(read_table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS e FROM embeddings),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
t(id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT t.id, l.b FROM t JOIN l ON t.other = l.a),
c AS (SELECT id, min(other) AS component_id FROM t GROUP BY id), n AS (SELECT a AS id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.id = vec_id LEFT JOIN n ON n.id = vec_id ORDER BY ALL
"""
