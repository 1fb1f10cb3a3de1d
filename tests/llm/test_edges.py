"""Every query on empty tables and on nulls, empty and very long texts, ties and repeated rows; ownership verdicts against brute force."""

import random
import re
from collections import defaultdict

import pytest

from voxara.llm import entry, secrets

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TABLES = {
    "documents": DOCS, "pages": "page_id bigint, url string, html string", "benchmark": "item_id bigint, text string", "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string", "embeddings": "vec_id bigint, embedding array<float>, label int",
}
#: Queries with a row for each row of documents; the others have rows for findings alone or read another table.
PER_DOCUMENT = ("op1_lattice", "op4_mpegts", "op5_ngram_join", "op6_toxicity", "op9_bpe", "op10_secrets")


def long_text(words):
    r = random.Random(words)
    return " ".join(r.choice("alpha beta gamma delta of the in tion er ing".split()) + str(r.randrange(5000)) for _ in range(words))


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """(empty tables, odd rows): paths of the two, and the number of odd documents."""
    long = long_text(30_000) + " password=qv8T2mmX91z token: " + "ab" * 20_000
    texts = [None, "", " \n", "one", "one", "x" * 50_000, long, long, "\U0001f600 é \x00 \x85 end", "</s>[INST]"]
    docs = [(k if k % 4 else None, t, None if k == 2 else "en", None if k == 1 else f"s{k % 3}", None) for k, t in enumerate(texts)] + [(7, long, "en", "s1", 3), (7, "one", "en", "s1", 3)]
    rows = {
        "documents": docs, "pages": [(None, None, None), (1, "", ""), (2, "u", long), (3, "u", long), (3, "u", long), (4, None, "x")], "benchmark": [(1, " ".join(long.split()[500:1500])), (None, "a"), (2, None)],
        "labels": [(1, None, None), (None, 1, 1), (2, 1, 0), (3, 1, 1), (3, 1, 0)], "conversations": [(None, None, None, None), (1, 0, "user", long), (1, 0, "user", long), (1, 0, "assistant", ""), (2, None, "assistant", "a\\b")],
        "embeddings": [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 1), (None, [1.0, 2.0], None), (2, None, 0), (3, [2.0, 4.1], 0)],
    }
    paths = []
    for name, content in (("empty", {}), ("odd", rows)):
        at = tmp_path_factory.mktemp(name)
        for table, schema in TABLES.items():
            spark.createDataFrame(content.get(table, []), schema).write.parquet(f"{at}/{table}.parquet")
        paths.append(str(at))
    return *paths, len(docs)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_empty_tables(spark, folders, name):
    rows = entry.queries()[name](spark, folders[0]).collect()
    assert [r.conv_id for r in rows] == [-7] if name == "op8_chat" else rows == []


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_odd_rows(spark, folders, name):
    rows = entry.queries()[name](spark, folders[1]).collect()
    if name in PER_DOCUMENT:
        assert len(rows) == folders[2]
    elif name == "op2_warc":
        assert len(rows) == 6 and all(r.complete for r in rows)
    elif name == "op8_chat":
        assert sorted((r.conv_id or 0, r.n_turns) for r in rows) == [(-7, 2), (0, 1), (1, 3), (2, 1)]
    elif name == "op7_decontam":
        assert {(r.doc_id, r.item_id) for r in rows} == {(6, 1), (7, 1)} and all(r.n_equal == r.n_compared == 1000 for r in rows)
    elif name == "op11_filter_audit":
        assert len(rows) == 600 * 4 and {r.part for r in rows} == {"", "s0", "s1", "s2"}
        first = {r.part: r.kept + r.removed for r in rows if r.filter_order == "ABCDE" and r.step == 1}
        assert sum(first.values()) == folders[2]
    elif name == "op12_conversation_repair":
        assert {(r.conv_id, r.gaps) for r in rows} == {(None, 0), (1, 0), (2, 0)}
    elif name == "op13_itq_links":
        assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in rows) == [(0, 0, 0), (1, 2, 1), (1, 2, 1), (2, 0, 2), (3, 2, 1)]
    else:
        assert {r.doc_id for r in rows if r.repeats} == {7} and {r.n_words for r in rows} >= {30_003}


def test_ownership_equals_brute_force(spark):
    r = random.Random(5)
    values = [f"v{k}Zq8{k * 7919}" for k in range(12)] + ["changeme123", "xxxxxxxxxx"]
    docs = [(k, " and ".join(f"password={r.choice(values[: r.choice((3, 14))])} ok" for _ in range(r.randrange(4))), r.choice(("en", "de")), f"s{r.randrange(9)}", 0) for k in range(120)]
    owners, places, total = defaultdict(set), defaultdict(set), defaultdict(int)
    for _, text, lang, source, _ in docs:
        for m in re.finditer(r"password=(\S+)", text):
            owners[m[1]].add(source)
            places[m[1]].add((source, lang))
            total[m[1]] += 1
    verdict = {v: "copied" if len(o) > secrets.MAX_OWNERS else "placeholder" if v in ("changeme123", "xxxxxxxxxx") else "live" for v, o in owners.items()}
    from pyspark.sql import functions as F

    df = spark.createDataFrame(docs, DOCS)
    found, judged = secrets.scan(df, F.col("source"), F.concat_ws("/", "source", "lang"))
    got = {(j["start"], q.doc_id): (j["verdict"], j["owners"], j["repositories"]) for q in judged.collect() for j in q.judged}
    want = {(m.start(), i): (verdict[m[1]], len(owners[m[1]]), len(places[m[1]])) for i, text, *_ in docs for m in re.finditer(r"password=(\S+)", text)}
    assert got == want and {"copied", "live"} <= set(verdict.values())
    counted = {q.occurrences for q in secrets.ownership(found).collect()}
    assert counted == set(total.values())
