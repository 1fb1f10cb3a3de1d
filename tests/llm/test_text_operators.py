"""Training-data operators against brute force and exact round trips, with nulls, empty texts, repeats and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxara.llm import bpe, cdc, chat, common, decontam, lattice, mpegts, ngram_join, secrets, toxicity, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, b string, key string"


def docs_of(spark, texts):
    """Rows with columns whose names the operators use inside too."""
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t), 5, "b", "k") for i, t in texts], DOCS)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta of the in tion er ing".split()) + r.choice("abcdefgh") * r.randint(1, 3) for _ in range(n))


EDGE = [(1, None), (2, ""), (3, "x"), (4, "x"), (None, "a b c d e f")]


def test_bpe_equals_library(spark):
    path = bpe.tokenizer_path()
    lib, own = Tokenizer.from_file(path), bpe.Bpe(path)
    for x in ["", "Don't!!! 12٣", "a\x1cb ΑΣ İ", "x<|endoftext|>y", "日本語 😀́e", "\x85q​\x00", prose(1, 500), "ab" * 3000]:
        ids = lib.encode(x, add_special_tokens=False).ids
        assert own.encode(x) == ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    rows = {r.doc_id: r for r in bpe.encode_documents(docs_of(spark, EDGE), path, with_ids=True).collect()}
    assert rows[1].n_tokens == rows[2].n_tokens == 0 and rows[1].ids_sha256 == hashlib.sha256(b"").hexdigest() and rows[3].ids == rows[4].ids
    assert bpe.encode_documents(docs_of(spark, []), path).count() == 0


@pytest.mark.parametrize("n", [0, 1, 160, 170, 575, 576, 577, 23040, 23041, 100_000])
def test_transport_stream_round_trip(n):
    data = random.Random(n).randbytes(n)
    s = mpegts.demux(mpegts.mux(mpegts.pad(data)))
    assert s.payload == mpegts.pad(data) and s.continuity_errors == s.table_errors == 0 and s.stream_type == 6
    assert s.index[0] == (0, 0, True) and [x[2] for x in s.index] == [i % mpegts.RAP_EVERY == 0 for i in range(len(s.index))]


def test_transport_stream_repeats_and_lost_sync():
    data = mpegts.pad(prose(4, 3000).encode())
    media = mpegts.mux(data)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    twice = mpegts.demux(b"".join(p * 2 for p in packets))
    assert twice.payload == data and twice.continuity_errors == 0
    assert mpegts.demux(b"".join(p * (3 if i == 5 else 1) for i, p in enumerate(packets))).continuity_errors == 1
    shifted = mpegts.demux(b"noise" + media)
    assert shifted.payload == data and shifted.continuity_errors == 1
    torn = mpegts.demux(b"".join(packets[:20]) + packets[20][:100] + b"".join(packets[20:]))
    assert torn.payload == data[: len(torn.payload)] or torn.continuity_errors >= 1
    assert mpegts.demux(b"").payload == mpegts.demux(b"x" * 1000).payload == b""


def test_chat_layouts_of_odd_records(spark):
    """Other types in a text's place, lone surrogates, deep and broken JSON, unknown layouts, null records and ids."""
    records = ['{"prompt": 5}', '{"prompt": false}', '{"prompt": null}', '{"prompt": []}', '{"prompt": "\\ud800x"}', '{"messages": [{"role": 3, "content": 1.5}]}', "[" * 100_000, '{"a":' * 3000 + "1" + "}" * 3000, "{", None, '{"other": 1}', "7"]
    rows = spark.createDataFrame([(None if i == 1 else i, r, "u", "v") for i, r in enumerate(records)], "conv_id bigint, record string, role string, text string")
    got = {r.conv_id: (r.role, r.text) for r in chat.canonical_turns(rows).collect()}
    assert [got[i][1] for i in (0, None, 2, 3, 4)] == ["5", "false", "", "[]", "?x"] and got[5] == ("3", "1.5")
    assert all(got[i] == (None, None) for i in (6, 7, 8, 9, 10, 11))
    assert chat.canonical_turns(rows.limit(0)).count() == 0


def test_transport_stream_counts_errors(spark):
    media = mpegts.mux(mpegts.pad(b"a" * 5000))
    assert mpegts.demux(media[: 188 * 5] + media[188 * 6 :]).continuity_errors == 1
    broken = bytearray(media)
    broken[10] ^= 1
    assert mpegts.demux(bytes(broken)).table_errors == 1
    rows = {r.doc_id: r for r in mpegts.read_media(mpegts.store_media(docs_of(spark, EDGE))).collect()}
    assert rows[1].payload_bytes == 576 and rows[1].payload_sha256 == rows[2].payload_sha256 and rows[3].media_sha256 == rows[4].media_sha256
    assert rows[3].tail_crc32 == zlib.crc32(b"\xff" * 32)


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 40_000 + "\r\n\r\nWARC/1.1\r\n" + prose(3, 3000)
    pages = spark.createDataFrame([(1, "u", big), (5, "u", big), (2, None, None), (3, "a b", ""), (4, "u", "x"), (4, "u", "x")], "page_id bigint, url string, html string")
    warc.write_warc(pages, f"file://{tmp_path}/w")
    segments = warc.read_segments(spark, f"file://{tmp_path}/w")
    assert segments.filter("type = 'continuation'").count() > 3
    rows = warc.reassemble(segments).collect()
    assert len(rows) == 6 and all(r.complete for r in rows) and len({r.record_id for r in rows}) == 6
    by = {re.match(r"<urn:voxara:(-?\d+)", r.record_id)[1]: r for r in rows}
    assert bytes(by["5"].payload).decode() == big and by["1"].record_type == "revisit" and by["1"].refers_to == by["5"].record_id and by["1"].payload_bytes == len(big.encode())
    assert by["2"].record_type == "revisit" and by["3"].payload_bytes == 0
    lost = warc.reassemble(segments.filter("not (type = 'continuation' and number = 2)")).collect()
    assert sum(not r.complete for r in lost) == 1
    assert warc.unchunked(b"5\r\nabc") is None and warc.unchunked(warc.chunked(b"x" * 9000)) == b"x" * 9000


def test_chat_round_trip(spark):
    texts = ["", "\\", "</s>[INST] ok [/INST]", "<\\s>", "<<SYS>>\\<</SYS>> <s><s>", "a\nb"]
    for t in texts:
        assert chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROL)
    rows = [(7, i, r, t) for i, (r, t) in enumerate((r, t) for t in texts for r in ("user", "assistant", "tool"))] + [(8, 0, None, None), (9, 0, "assistant", "x"), (9, 0, "assistant", "x")]
    df = chat.as_layouts(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(chat.canonical_turns(df))).collect()}
    assert got[7].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for t in texts for r in ("user", "assistant", "tool")).encode()).hexdigest()
    assert got[7].loss_sha256 == hashlib.sha256("".join(texts).encode()).hexdigest() and got[8].n_turns == 1 and got[9].n_turns == 2
    assert chat.canonical('{"unknown": 1}')[1] is None and chat.canonical("{")[1] is None
    assert chat.canonical('{"prompt": "a", "completion": null}')[1] == [("user", "a"), ("assistant", "")]


def test_secrets_equal_regex(spark):
    texts = [(i, t) for i, t in enumerate(["token=token: abcdef", "API_KEY: 'aaaaaaa' password=abc", "AKIA" + "A" * 16 + " é" + "0" * 24, "secret=secret=abcdefg", "0" * 23, "😀 passwd\"=\"q1w2e3r4t5", "AKIAAKIA" + "B" * 20])] + [(90, None), (91, "")]
    found = secrets.candidates(docs_of(spark, texts), secrets.F.col("source"), secrets.F.col("lang")).select("doc_id", secrets.span_text(secrets.F.col("spans"), 3).alias("s")).collect()
    assign = re.compile(secrets.BASE[0][1], re.A)
    for r in found:
        t = dict(texts)[r.doc_id] or ""
        want = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert r.s == ",".join(f"{secrets.BASE[k][0]}:{a}:{b}" for a, k, b in sorted(want))


def test_widely_copied_is_not_live(spark):
    shared, own = "token=zq9x8w7v6u5t", "token=p0o9i8u7y6t5"
    docs = docs_of(spark, [(i, f"é {shared} end") for i in range(3)] + [(10, f"é {own} end"), (11, None)]).drop("key", "id", "b")
    out = {r.doc_id: r for r in secrets.redact(spark, docs).collect()}
    assert out[0].text == f"é {shared} end" and out[10].text == "é token=<secret> end" or out[10].text == "é <secret> end"
    assert out[10].n_chars == len(out[10].text) and out[11].text is None


def test_null_ids_get_verdicts(spark, tmp_path):
    texts = [(None, "é token=p0o9i8u7y6t5 end"), (None, "password: 'a1b2c3d4e5f6g7'"), (None, "no such thing"), (1, "secret=m1n2b3v4c5x6")]
    docs = docs_of(spark, texts)
    out = [(r.doc_id, r.text, r.n_chars) for r in secrets.redact(spark, docs).collect()]
    assert len(out) == 4 and sum("<secret>" in t for _, t, _ in out) == 3 and all(n == len(t) for _, t, n in out)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = secrets.op10_secrets(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.n_live) for r in rows) == [(False, 1), (True, 0), (True, 1), (True, 1)]


def test_secrets_of_keys_and_clashing_columns(spark):
    """A key file is its body; distinct keys of five owners are live; a text of many matches; columns with the operators' names."""
    body = lambda k: f"-----BEGIN RSA PRIVATE KEY-----\n{hashlib.sha512(b'%d' % k).hexdigest()}\n-----END RSA PRIVATE KEY-----"
    rows = [(k, f"key {body(k)} end", "en", f"s{k}", 0, "o", "h", "l") for k in range(5)]
    rows += [(9, " ".join(f"token={k:06d}abcxyz" for k in range(700)), "en", "s9", 0, "o", "h", "l"), (None, "password=" + "k9x2mmq81z", None, None, 0, "o", "h", "l"), (10, None, "en", "s", 0, "o", "h", "l")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, owner string, text_hash string, _live string")
    got = {r.doc_id: r for r in secrets.redact(spark, docs).collect()}
    assert all(got[k].text == "key <secret> end" for k in range(5)) and got[None].text == "<secret>" and got[10].text is None
    assert got[9].text.count("<secret>") == 700 and got[9].n_chars == len(got[9].text) and (got[9].owner, got[9].text_hash, got[9]._live) == ("o", "h", "l")
    found = secrets.candidates(docs, F.col("source"), F.col("lang")).filter("doc_id = 9").select("owner", "spans").first()
    assert found.owner == "s9" and [(s.start, s.stop) for s in found.spans] == [(m.start(), m.end()) for m in re.finditer(r"token=\w+", rows[5][1])]
    assert secrets.redact(spark, docs.limit(0)).count() == 0


def test_decontamination_tolerates_substitutions(spark):
    item = prose(5, 40).split()
    worn = [w if i % 5 else "zz" for i, w in enumerate(item)]
    docs = docs_of(spark, [(1, prose(6, 200)), (2, prose(7, 50) + " " + " ".join(item) + " " + prose(8, 20)), (3, " ".join(worn)), (4, None), (5, ""), (6, prose(9, 3)), (2, "x")])
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "short one")], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.overlaps(docs, bench).collect()} == {(2, 1), (3, 1)}
    assert decontam.overlaps(docs, bench.limit(0)).count() == 0
    kept = [(r.doc_id, r.text == "x") for r in decontam.decontaminated(docs, bench).collect()]
    assert sorted(kept) == [(1, False), (2, True), (4, False), (5, False), (6, False)]


def test_decontamination_finds_worn_short_items(spark):
    items, docs = [], []
    for size in (15, 16, 17):
        lack = size - math.ceil(0.75 * size)
        for n, worn in enumerate(itertools.combinations(range(size), lack)):
            if n % 23 and worn not in {(0, 5, 10), (2, 3, 4), (1, 5, 6), (0, 5, 10, 15), (5, 6, 12, 13), (1, 2, 13, 14)}:
                continue
            k = len(items)
            item = [f"w{k}x{t}" for t in range(size)]
            items.append((k, " ".join(item)))
            docs.append((k, f"{prose(k, 9)} {' '.join('zz' if t in worn else w for t, w in enumerate(item))} {prose(k + 500, 7)}"))
            docs.append((10_000 + k, f"{prose(k, 9)} {' '.join('zz' if t in worn or t == size // 2 + 1 or t == size // 2 else w for t, w in enumerate(item))}"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.overlaps(docs_of(spark, docs), bench).collect()}
    share = lambda d, i: sum(w in dict(docs)[d].split() for w in dict(items)[i].split()) / len(dict(items)[i].split())
    assert got == {(d, d % 10_000) for d, _ in docs if share(d, d % 10_000) >= 0.75}


def test_decontamination_equals_brute_force(spark):
    """Whole passages, null and repeated ids, long texts and clashing columns, in one block and in several."""
    r = random.Random(3)
    items = [(k, prose(k, r.choice((14, 20, 60, 900)))) for k in range(12)]
    rows = []
    for n in range(60):
        k = r.randrange(12)
        w, at = items[k][1].split(), 0
        cut = w[(at := r.randrange(max(1, len(w) - 10))) : at + r.choice((5, 12, 13, 30, 900))]
        rows.append((r.choice((None, n, n, 7)), f"{prose(n + 99, 30)} | {' '.join(cut)} | {prose(n + 300, 10)}"))

    def longest(a, b):
        best = 0
        for d in range(-len(b), len(a)):
            run = 0
            for i in range(max(0, d), min(len(a), len(b) + d)):
                run = run + 1 if a[i] == b[i - d] else 0
                best = max(best, run)
        return best

    def may(a, b):
        """Some part of a diagonal holds enough equal tokens with the least share."""
        least = min(13, math.ceil(0.75 * len(b)))
        for d in range(-len(b), len(a)):
            same = np.array([a[i] == b[i - d] for i in range(max(0, d), min(len(a), len(b) + d))], int)
            eq, gain = np.r_[0, np.cumsum(same)], np.r_[0, np.cumsum(4 * same - 3)]
            if eq[-1] >= least and ((gain[None] >= gain[:, None]) & (eq[None] - eq[:, None] >= least)).any():
                return True
        return False

    sure = {(i, t, k) for i, t in rows for k, x in items if longest(t.split(), x.split()) >= 13}
    bench = spark.createDataFrame([*items, (None, "x"), (99, None)], "item_id bigint, text string")
    docs = docs_of(spark, rows)
    found = [(q.doc_id, q.item_id) for q in decontam.overlaps(docs, bench).collect()]
    assert Counter((i, k) for i, _, k in sure) - Counter(found) == Counter()
    assert Counter(found) - Counter((i, k) for i, t in set(rows) for k, x in items if may(t.split(), x.split())) == Counter()
    kept = Counter((q.doc_id, q.text) for q in decontam.decontaminated(docs, bench).collect())
    assert not any((i, t) in kept for i, t, _ in sure)
    whole, decontam.BROADCAST_WINDOWS, decontam.BROADCAST_TOKENS = (decontam.BROADCAST_WINDOWS, decontam.BROADCAST_TOKENS), 3000, 0
    try:
        assert Counter((q.doc_id, q.item_id) for q in decontam.overlaps(docs, bench).collect()) == Counter(found)
    finally:
        decontam.BROADCAST_WINDOWS, decontam.BROADCAST_TOKENS = whole
    assert decontam.overlaps(docs_of(spark, []), bench).count() == 0


def test_decontamination_measures_long_overlaps(spark):
    item = " ".join(f"w{k}" for k in range(1000))
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    (r,) = decontam.overlaps(docs_of(spark, [(1, f"a b c {item} d e")]), bench).collect()
    assert (r.n_equal, r.n_compared, r.doc_start, r.item_start) == (1000, 1000, 3, 0)


def test_shingle_classes_equal_brute_force(spark, monkeypatch):
    r = random.Random(1)
    base = [prose(i, 60) for i in range(6)]
    texts = list(EDGE[:4])
    for i in range(10, 110):
        w = r.choice(base).split()
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"new{r.randint(0, 30)}"
        texts.append((i, " ".join(w)))
    sets = {}
    for i, t in texts:
        w = (t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {q.doc_id: (q.n_shingles, q.component_id) for q in ngram_join.classes(docs_of(spark, texts)).collect()}
    assert got == {i: (len(sets[i]), root(i)) for i in sets}
    assert ngram_join.classes(docs_of(spark, [])).count() == 0
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(ngram_join, "SLICE", 3)
    assert {q.doc_id: q.component_id for q in ngram_join.classes(docs_of(spark, texts)).collect()} == {i: root(i) for i in sets}


def test_one_of_each_group_stays(spark):
    """Repeated ids with different texts are told apart; null ids, empty texts and clashing columns stay."""
    a, b = prose(50, 40), prose(51, 40)
    rows = [(1, a), (2, a + " more"), (2, b), (3, b), (None, a), (4, None), (5, ""), (6, a), (6, a)]
    got = sorted(((r.doc_id, r.text) for r in ngram_join.one_of_each(docs_of(spark, rows)).collect()), key=repr)
    assert got == sorted([(1, a), (2, b), (None, a), (4, None), (5, "")], key=repr)
    found = [(r.doc_id, r.n_shingles > 0, r.component_id) for r in ngram_join.classes(docs_of(spark, rows)).collect()]
    assert sorted(found, key=repr) == sorted([(1, True, 1), (2, True, 1), (2, True, 2), (3, True, 2), (None, True, None), (4, False, 4), (5, False, 5), (6, True, 1), (6, True, 1)], key=repr)


def test_near_links_of_a_large_family(spark):
    """Worn copies of one text, most of which don't link with each other, against brute force."""
    r, base = random.Random(9), prose(60, 120).split()
    texts = []
    for i in range(120):
        w = list(base)
        for _ in range(r.choice((1, 4, 6, 9))):
            w[r.randrange(len(w))] = f"new{r.randrange(400)}"
        texts.append((i, " ".join(w)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(116)} for _, t in texts]
    root = list(range(120))
    for a, b in itertools.combinations(range(120), 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root[a], root[b]))
            root = [x if v == y else v for v in root]
    assert {q.doc_id: q.component_id for q in ngram_join.classes(docs_of(spark, texts)).collect()} == dict(enumerate(root))


def test_small_tables_are_few_files(spark, monkeypatch):
    """Tables between the rounds of components have the files that their size asks for, not one for each task; rows stay the same."""
    files, drop = [], ngram_join.drop_path

    def counted(session, path):
        files.append(len(list(Path(path.removeprefix("file://")).glob("part-*"))))
        drop(session, path)

    monkeypatch.setattr(ngram_join, "drop_path", counted)
    nodes = spark.range(0, 40, 1, 8).withColumnRenamed("id", "key")
    labels, path = ngram_join.components(nodes, nodes.filter("key % 10 > 0").select((F.col("key") - 1).alias("a"), F.col("key").alias("b")))
    assert {q.key: q.label for q in labels.collect()} == {k: k - k % 10 for k in range(40)}
    counted(spark, path)
    assert len(files) >= 4 and set(files) == {1}


def test_lattice_equals_enumeration():
    model = lattice.Lattice({"a": -1.0, "ab": -2.0, "b": -1.5}, {"a": -1.0, "b": -2.0, "ba": -3.0, "bb": -1.2}, 0.3)
    for w in ("a", "ab", "abba", "bbabab", "acb", "é"):
        total = 0.0
        for cuts in itertools.product([0, 1], repeat=len(w) - 1):
            ends = [i for i, c in enumerate(cuts, 1) if c] + [len(w)]
            parts = [w[a:b] for a, b in zip([0, *ends], ends)]
            lp = math.log(0.3)
            for k, p in enumerate(parts):
                x = (model.inner if k else model.first).get(p, model.byte * len(p.encode()) if len(p) == 1 else -math.inf)
                lp += x + (math.log(0.7) if k else 0)
            total += math.exp(lp)
        assert abs(model.log_q(w) - math.log(total)) < 1e-9


def test_document_scores(spark, monkeypatch):
    texts = [(i, prose(i, 30 + i)) for i in range(40)] + [(90, None), (91, ""), (3, prose(3, 33)), (92, "unseen Ünseen")]
    pieces = [("▁" + c, -float(i)) for i, c in enumerate("abcdefgh")] + [(c, -float(i)) for i, c in enumerate("abcdefghinorst")]
    held = lattice.F.pmod(lattice.F.coalesce("doc_id", lattice.F.lit(0)), lattice.F.lit(7)) == 2
    counts = Counter()
    for i, t in texts:
        if i % 7 != 2:
            counts.update((t or "").encode().lower().split() + [b" "])
    n, v = sum(counts.values()), len(counts)
    results = []
    for heavy in (lattice.HEAVY, 1):  # every word sent along; hardly any
        monkeypatch.setattr(lattice, "HEAVY", heavy)
        rows = lattice.score_documents(docs_of(spark, texts), ~held, pieces).collect()
        assert len(rows) == len(texts)
        results.append({r.doc_id: round(r.score, 6) for r in rows})
        for r in rows:
            w = (dict(texts)[r.doc_id] or "").encode().lower().split() + [b" "]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
            assert abs(r.base_score - sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) < 1e-6
    assert results[0] == results[1]


def test_class_mixture_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lattice, "FITS", 0)
    texts = [(i, prose(i, 20 + i) + (", Alphaa." if i % 3 else " (beta)")) for i in range(30)] + [(93, "x" * 3000 + " " + "x" * 3000), (37, None), (51, "ALPHAA! (alphaa) Betà. of of of"), (58, "of, of;")]
    pieces = [("▁" + c, -float(i)) for i, c in enumerate("abcdefgh")] + [(c, -float(i)) for i, c in enumerate("abcdefghinorst")]
    held = lattice.F.pmod("doc_id", lattice.F.lit(7)) == 2
    docs = docs_of(spark, texts)
    name = {r.doc_id: r.source for r in docs.collect()}
    tokens = {i: (t or "").encode().lower().split() + [lattice.END] for i, t in texts}
    own = {k: Counter() for k in set(name.values())}
    for i, w in tokens.items():
        if i % 7 != 2:
            own[name[i]].update(w)
    c = sum(own.values(), Counter())
    n, v = sum(c.values()), len(c)
    ones, twos = (sum(x == k for x in c.values()) for k in (1, 2))
    d = min(0.95, max(0.1, ones / (ones + 2 * twos)))
    cores = Counter(lattice.core_of(w)[0] for w in c if w != lattice.END)
    shapes = Counter(lattice.core_of(w)[1] for w in c if w != lattice.END)
    q = lattice.start_lattice(pieces)

    def p(w, k):
        g = 0.0
        if w != lattice.END:
            core, shape = lattice.core_of(w)
            g = (1 - lattice.CORE) * math.exp(q.log_q(w.decode())) + (lattice.CORE * cores[core] * shapes[shape] / v**2 if core else 0)
        total = max(c[w] - d, 0) / n + d * v / n * g
        return max(own[k][w] - d, 0) / own[k].total() + d * len(own[k]) / own[k].total() * total

    for heavy in (lattice.HEAVY, 1):
        monkeypatch.setattr(lattice, "HEAVY", heavy)
        for r in lattice.score_documents(docs, ~held, pieces, lattice.F.col("source")).collect():
            assert math.isfinite(r.score) and r.score < 0
            if r.doc_id == 93:  # its word is less likely than a double can tell
                continue
            found = 0.0
            for k in own:
                x, seen = (own[k][lattice.END] + 1) / (c[lattice.END] + len(own)), Counter()
                for t, w in enumerate(tokens[r.doc_id]):
                    x *= 1e3 * (lattice.ALPHA * p(w, k) + seen[w]) / (lattice.ALPHA + t)
                    seen[w] += 1
                found += x
            assert abs(r.score - math.log10(found) + 3 * len(tokens[r.doc_id])) < 1e-4
    alone = lattice.score_documents(docs, lattice.F.lit(False), pieces, lattice.F.col("source")).collect()
    assert len(alone) == len(texts) and all(math.isfinite(r.score) and r.n_known == 0 for r in alone)
    assert lattice.score_documents(docs.limit(0), ~held, pieces, lattice.F.col("source")).collect() == []


def test_chunks_resist_insertions(spark):
    passage = prose(11, 70)
    docs = docs_of(spark, [(1, prose(12, 40) + passage + prose(13, 40)), (2, prose(14, 25) + " inserted " + passage), (3, prose(15, 200)), (4, None), (5, "")])
    rows = cdc.passages(docs).collect()
    assert {r.doc_id for r in rows} == {1, 2} and {r.doc_id: r.repeats for r in rows} == {1: False, 2: True}
    kept = {r.doc_id: r.text for r in cdc.deduplicated(docs).collect()}
    assert kept[1] == dict((r.doc_id, r.text) for r in docs.collect())[1] and len(kept[2]) < 400 and kept[4] is None
    for n in (1, 15, 16, 17, 5000):
        data = random.Random(n).randbytes(n)
        ends = cdc.boundaries(data)
        assert ends[-1] == n and all(b - a <= cdc.MOST for a, b in zip([0, *ends], ends))


def brute_passages(texts, size):
    """(doc, start, stop, n_words, n_copies, first doc, first start, repeats) from all runs of size words, by their bytes."""
    runs = []
    for i, t in texts:
        b = (t or "").encode()
        w = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", b)]
        runs += [(i, k, w[k][0], w[k + size - 1][1], b[w[k][0] : w[k + size - 1][1]]) for k in range(len(w) - size + 1)]
    places = {}
    for i, _, a, z, x in runs:
        places.setdefault(x, []).append((i, a))
    out = {}
    for i, k, a, z, x in sorted(runs):
        (f, fs), (g, gs) = min(places[x]), max(places[x])
        if f == g and gs < fs + len(x):
            continue
        again = f != i or a >= fs + len(x)
        mine = out.setdefault((i, again), [])
        if mine and k <= mine[-1][1]:
            mine[-1][1:5] = [k + size, mine[-1][2], z, min(mine[-1][4], len(places[x]))]
        else:
            mine.append([k, k + size, a, z, len(places[x]), f, fs])
    return {(i, a, z, m - k, n, f, fs, again) for (i, again), rows in out.items() for k, m, a, z, n, f, fs in rows}


def found_passages(docs, **more):
    return {(r.doc_id, r.start, r.stop, r.n_words, r.n_copies, r.first_doc_id, r.first_start, r.repeats) for r in cdc.passages(docs, **more).collect()}


def test_passages_equal_brute_force(spark):
    texts = [(1, None), (2, ""), (3, prose(30, 51)), (4, prose(31, 50))]
    for k in range(150):  # passages of 51 to 60 words in two unrelated documents each
        p = prose(1000 + k, 51 + k % 10)
        texts += [(10 + 2 * k, f"{prose(2000 + k, 37)} {p} {prose(3000 + k, 21)}"), (11 + 2 * k, f"{prose(4000 + k, 12)}\n{p}\t{prose(5000 + k, 44)}")]
    # each chunk of a passage is first in a document that lacks the passage; separators differ; 50 words alone; a goes on into b
    long, a, b, fifty = prose(40, 90), prose(41, 60), prose(42, 30), prose(43, 50)
    w = long.split()
    texts += [(5, " ".join(w[:48]) + " cut " + " ".join(w[42:])), (400, long), (401, "é " + long), (402, long.replace(" ", "  ")), (403, a), (404, f"{a} {b} z"), (405, f"y {a} {b}")]
    texts += [(406, f"q {fifty} r"), (407, f"s {fifty} t"), (408, f"{long} u {long}"), (409, prose(30, 51))]
    # few distinct short words
    r = random.Random(9)
    few = [" ".join(r.choice("ab") for _ in range(60)) for _ in range(3)]
    texts += [(500 + i, " ".join(r.choice("ab") for _ in range(r.randint(0, 40))) + " " + few[i % 3] + " " + prose(600 + i, i)) for i in range(12)]
    want = brute_passages(texts, 51)
    assert found_passages(docs_of(spark, texts)) == want and len(want) > 300
    assert found_passages(docs_of(spark, texts), min_words=20) == brute_passages(texts, 20)


def test_periodic_passages_share_chunks(spark):
    lines = ["x", "ab cd", "the same line again and", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"]
    texts = []
    for k, line in enumerate(lines):
        passage = " ".join((line.split() * 90)[: 60 + 7 * k])
        for n in range(6):
            texts.append((10 * k + n, f"{prose(700 + 10 * k + n, 9 + 5 * n)[3 * n :]} {passage} {prose(800 + 10 * k + n, 30)}"))
        parts = [{t.encode()[a:z] for e in [cdc.boundaries(t.encode())] for a, z in zip([0, *e], e)} for i, t in texts[-6:]]
        assert any(len(x.split()) and x in passage.encode() + b" " for x in set.intersection(*parts))
    got = found_passages(docs_of(spark, texts))
    assert got == brute_passages(texts, 51) and {r[0] for r in got} == {i for i, _ in texts}


def test_toxicity_finds_held_out(spark):
    bad = ["vilex", "grobor", "snarkle"]
    texts = [(i, prose(i, 40) + (" " + random.Random(i).choice(bad) + "." if i % 4 == 0 else "")) for i in range(400)] + [(900, None), (901, ""), (902, "Snarkle!")]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(1, None)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(docs, model).collect()}
    assert sum(got[i] == (i % 4 == 0) for i in range(300, 400)) >= 95 and not got[900] and got[902]
    assert {r.doc_id for r in toxicity.accepted(docs, labels).collect()} >= {1, 2, 3, 900, 901}
    none = toxicity.train(docs, labels.limit(0))
    assert all(r.score < 0.5 for r in toxicity.score(docs, none).collect())


def test_bpe_words_of_different_chunks_are_merged_once(monkeypatch):
    """Chunks that differ in their punctuation alone share their words, and short words have the tokens that a heap gives."""
    texts = [f"{a}underestimated{b} ça{b} don't {'ab' * 60}{a}" for a in ("", "(", '"', "[[") for b in ("", ".", "!?", ",")]
    model, merged = bpe.Bpe(bpe.tokenizer_path()), []
    word = model.word
    monkeypatch.setattr(model, "word", lambda w: merged.append(w) or word(w))
    got = [model.encode(t) for t in texts]
    assert len(merged) == len(set(merged))
    monkeypatch.setattr(bpe, "SHORT", 0)
    assert [bpe.Bpe(bpe.tokenizer_path()).encode(t) for t in texts] == got
    monkeypatch.setattr(bpe, "SHORT", 40)
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 3)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 2)
    small = bpe.Bpe(bpe.tokenizer_path())
    assert [small.encode(t) for t in texts] == got
    assert len(small.young_words) <= 2 and len(small.old_words) <= 2 and len(small.young) <= 3
