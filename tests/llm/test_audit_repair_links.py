"""Filter audit, conversation repair and binary codes against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from voxara.llm import conversation_repair as repair
from voxara.llm import entry, filter_audit, itq_links

SF = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"
CONVERSATION = "conv_id bigint, turn bigint, role string, text string"


def brute_audit(docs, labels):
    """{(part, order, step): counts} by removing documents one filter after the other."""
    texts = [(i, "" if t is None else t, "" if p is None else p) for i, t, p in docs]
    good, toxic = ({i for i, *flags in labels if flags[k] == 1 and i is not None} for k in (0, 1))
    least = {}
    for i, t, _ in texts:
        if i is not None:
            least[t] = min(least.get(t, i), i)
    fails = []
    for i, t, part in texts:
        words = [w for w in re.split("[ \t-\r]+", t) if w]
        found = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > least.get(t, i),
        }
        fails.append((i, part, {f for f, bad in found.items() if bad}))
    out, shapley = {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {p for _, p, _ in fails}:
            left = [(i, f) for i, p, f in fails if p == part]
            mine = left
            for step, name in enumerate(order, 1):
                cut = [(i, f) for i, f in left if name in f]
                left = [(i, f) for i, f in left if name not in f]
                shapley[part, name] += len(cut)
                failing = [f for _, f in mine if name in f]
                out[part, order, step] = (len(left), len(cut), len(failing) - len(cut), sum(f == {name} for f in failing), sum(i in good for i, _ in cut), sum(i in toxic for i, _ in cut))
    return {(part, order, step): (*v, shapley[part, order[step - 1]]) for (part, order, step), v in out.items()}


def test_audit_equals_brute_force(spark):
    rng = random.Random(9)
    words = ["alpha", "Beta", "GAMMA", "x|y", "100%", "\u00e9t\u00e9", "\x85", "a\nb"]
    texts = [None, "", " \n", "one", *[" ".join(rng.choices(words[: rng.choice((2, 8))], k=rng.choice((3, 199, 200, 260)))) for _ in range(25)], " ".join(f"w{k}" for k in range(220))]
    docs = [(rng.choice([None, *range(40)]) if rng.random() < 0.2 else k, rng.choice(texts), rng.choice(["a", "b", None, ""])) for k in range(300)]
    labels = [(rng.choice([None, *range(320)]), rng.choice((0, 1, None)), rng.choice((0, 1, None))) for _ in range(200)]
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id bigint, text string, source string, mask int")
    rows = filter_audit.audit(df, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}
    assert got == brute_audit(docs, labels)


def test_sums_of_parities_invert_exactly(spark):
    rows = [("p", m, m % 2, 0) for m in range(32) for _ in range(m)] + [("q", 31, 0, 1)] * 3
    sums = filter_audit.parity_sums(spark.createDataFrame(rows, "part string, mask int, good int, toxic int"))
    got = {(r.part, r["mask"]): (r.n, r.good, r.toxic) for r in filter_audit.cells(sums).collect()}
    assert got == {("p", m): (m, m * (m % 2), 0) for m in range(32)} | {("q", m): (3 * (m == 31), 0, 3 * (m == 31)) for m in range(32)}


def test_audit_query_equals_its_sql(spark):
    con = duckdb.connect()
    for table in ("documents", "labels", "embeddings"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    for name in ("op11_filter_audit", "op13_itq_links"):
        rel = con.sql(entry.oracle_sql()[name])
        columns = sorted(rel.columns)
        want = sorted(tuple(row[rel.columns.index(c)] for c in columns) for row in rel.fetchall())
        assert sorted(tuple(r[c] for c in columns) for r in entry.queries()[name](spark, SF).collect()) == want


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        harm = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if harm == 0:
            continue
        if harm == 1:
            text = ""
        if harm == 2:
            text = "".join(c for c in text if c not in ".!?")
        if harm == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if harm == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit) of rows (initial, must go, truncated) by dynamic programming over suffixes with the texts of edits."""
    steps = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    none = (10**9, "")

    def insertions(best):
        for _ in range(4):
            for q in ("", "s", "u", "a"):
                for role in "ua":
                    if (q, role) in steps:
                        c, e = best[steps[q, role]]
                        best[q] = min(best[q], (c + 3, "I" + e))
        return best

    best = insertions({"": (0, ""), "a": (0, ""), "s": none, "u": none})
    for initial, gone, truncated in reversed(rows):
        now = {}
        for q in ("", "s", "u", "a"):
            options = [(best[q][0] + 4, "D" + best[q][1])]
            if not gone:
                extra = 3 if truncated else 0
                if (q, initial) in steps:
                    c, e = best[steps[q, initial]]
                    options.append((c + extra, "K" + e))
                for role in "ua":
                    if (q, role) in steps:
                        c, e = best[steps[q, role]]
                        options.append((c + 3 + extra, "R" + e))
            now[q] = min(options)
        best = insertions(now)
    return best[""]


def brute_repairs(rows):
    out = {}
    after = damage(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in after if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults, kinds = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in mine:
            stripped = text.strip(SPACES)
            kind = "blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else ""
            seen.add((role, text))
            if kind:
                kinds[kind] += 1
            faults.append((role[:1], kind in ("blank", "duplicate"), kind == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit = cheapest(faults)
        form = "".join(e for e in audit if e != "D")
        roles = ["s"] * (len(form) % 2) + ["ua"[i % 2] for i in range(len(form) - len(form) % 2)]
        lines, left = [], iter(mine)
        at = 0
        for e in audit:
            row = next(left) if e != "I" else None
            if e == "D":
                continue
            text = row[2] if row else ""
            role = row[1] if e == "K" else {"u": "user", "a": "assistant"}[roles[at]]
            assert e != "K" or role[:1] == roles[at]
            lines.append(f"{role}:{text}")
            at += 1
        out[conv] = (gaps, *kinds.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found_repairs(df, **more):
    return {r[0]: tuple(r)[1:] for r in repair.repairs(df, **more).collect()}


def test_repair_equals_brute_force_on_the_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert found_repairs(df) == brute_repairs([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def random_conversations(seed, count, most):
    rng = random.Random(seed)
    texts = ["Hi.", "No end", " \n", "", "Why?", "Ok!\t", "End. more"]
    roles = ["user", "assistant", "system", "tool", "User", "admin", None]
    weights = [6, 6, 2, 1, 1, 1, 1]
    return [(c, rng.choice([None, *range(most)]) if rng.random() < 0.2 else t, rng.choices(roles, weights)[0], rng.choice([*texts, None, f"Text {rng.random()}."])) for c in range(count) for t in range(rng.randrange(most))]


@pytest.mark.parametrize("block_rows", [2, 3, 2000])
def test_repair_equals_brute_force_on_random_rows(spark, block_rows):
    rows = random_conversations(block_rows, 80, 12)
    rows += [(None, None, "user", "Hi."), (None, 3, None, None), (7, 1, "user", "Hi."), (7, 1, "user", "Hi.")]
    df = spark.createDataFrame(rows, CONVERSATION).repartition(5)
    assert found_repairs(df, block_rows=block_rows) == brute_repairs(rows)


def test_repair_of_one_long_conversation_in_parts(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant"]), f"Line {t % 90}{rng.choice('.! ')}") for t in range(3000)] + [(2, 0, "user", "Hello.")]
    df = spark.createDataFrame(rows, CONVERSATION).repartition(7)
    assert found_repairs(df, block_rows=50) == brute_repairs(rows)


def test_repair_of_empty_tables_and_clashing_columns(spark):
    assert repair.repairs(spark.createDataFrame([], CONVERSATION)).collect() == []
    rows = [(1, t, "user", "x " * 30_000 + ".") for t in range(3)]
    df = spark.createDataFrame([(*r, 0, "k") for r in rows], CONVERSATION + ", done int, k string")
    assert found_repairs(df) == brute_repairs(rows)
    dropped = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    assert found_repairs(spark.createDataFrame([(5, dropped, "user", "a")], CONVERSATION)) == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def brute_links(rows):
    """{row number: (links, component)} of (id, vector) by all cosines."""
    unit = {}
    for n, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            unit[n] = x / np.linalg.norm(x)
    near = {n: [m for m in unit if m != n and len(unit[m]) == len(unit[n]) and unit[n] @ unit[m] >= 0.9] for n in unit}
    out = {}
    for n, (i, _) in enumerate(rows):
        seen, left = {n}, [n]
        while left:
            for m in near.get(left.pop(), []):
                if m not in seen:
                    seen.add(m)
                    left.append(m)
        out[n] = (len(near.get(n, [])), min((rows[m][0] for m in seen), default=i) if i is not None else None)
    return out


def clustered(seed, singles, sizes, spread, width=24):
    rng = np.random.default_rng(seed)
    out = [rng.normal(size=width) for _ in range(singles)]
    for size in sizes:
        centre = rng.normal(size=width)
        out += [centre + rng.normal(size=width) * spread for _ in range(size)]
    rng.shuffle(out)
    return [(k, [float(x) for x in np.float32(v)]) for k, v in enumerate(out)]


EMBEDDING = "vec_id bigint, embedding array<float>"


@pytest.mark.parametrize(("seed", "sizes", "spread"), [(1, [150, 20, 3, 2], 0.1), (2, [60, 40, 5], 0.2), (3, [120, 30], 0.3)])
def test_links_are_those_of_brute_force(spark, seed, sizes, spread):
    rows = clustered(seed, 200, sizes, spread)
    want = brute_links(rows)
    got = {r.vec_id: r for r in itq_links.links(spark.createDataFrame(rows, EMBEDDING)).collect()}
    assert len(got) == len(rows)
    assert all(got[k].n_links <= want[k][0] for k in got)
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(n for n, _ in want.values())
    assert sum(got[k].component_id == want[k][1] for k in got) >= 0.9 * len(got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_links_of_odd_vectors(spark):
    v = [0.5, -0.25, 1.0, 2.0]
    rows = [(5, v), (3, v), (3, v), (9, [2 * x for x in v]), (4, [-x for x in v]), (6, None), (7, []), (8, [0.0] * 4), (10, [1.0, None, 0.0, 0.0]), (11, [math.nan] * 4), (12, [math.inf, 0.0, 0.0, 0.0]), (None, v), (13, v[:3]), (3, v[:3]), (14, [1e-30, 0.0, 0.0, 0.0]), (15, [1e30, 0.0, 0.0, 0.0])]
    want = sorted(zip((i for i, _ in rows), brute_links(rows).values(), strict=True), key=repr)
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], EMBEDDING + ", copies int, ball string")
    got = sorted(((r.vec_id, (r.n_links, r.component_id)) for r in itq_links.links(df).collect()), key=repr)
    assert got == want
    assert itq_links.links(spark.createDataFrame([], EMBEDDING)).collect() == []
    assert [tuple(r) for r in itq_links.links(spark.createDataFrame([(1, None)], EMBEDDING)).collect()] == [(1, 0, 1, True)]


def test_copies_count_without_their_pairs(spark):
    rows = clustered(4, 20, [3], 0.05) + [(100 + k, [1.0] * 24) for k in range(500)] + [(1000, [1.0] * 23 + [1.2])]
    want = brute_links(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in itq_links.links(spark.createDataFrame(rows, EMBEDDING)).collect()}
    assert {i: want[n] for n, (i, _) in enumerate(rows) if i >= 100} == {i: r for i, r in got.items() if i >= 100}


@pytest.mark.parametrize("width", [2, 5, 90])
def test_a_table_of_near_copies_alone(spark, width):
    rows = clustered(8, 0, [120], 0.1, width)
    got = {r.vec_id: (r.n_links, r.component_id) for r in itq_links.links(spark.createDataFrame(rows, EMBEDDING)).collect()}
    want = brute_links(rows)
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values())
    assert sum(got[k][1] == want[k][1] for k in got) >= 0.95 * len(got)


def test_tiles_of_hot_buckets_lose_no_pair(spark, monkeypatch):
    rows = clustered(6, 100, [150], 0.1)
    df = spark.createDataFrame(rows, EMBEDDING)
    whole = {r.vec_id: (r.n_links, r.component_id) for r in itq_links.links(df).collect()}
    monkeypatch.setattr(itq_links, "TILE", 20)
    assert {r.vec_id: (r.n_links, r.component_id) for r in itq_links.links(df).collect()} == whole
