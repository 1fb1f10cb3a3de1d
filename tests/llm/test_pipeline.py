"""The corpus pipeline against a brute-force version of its stages, with null and repeated ids, extra columns and empty tables."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from voxara.llm import bpe

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, text_hash string, component bigint, _gone string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta of the in tion er ing".split()) + r.choice("abcdefgh") * r.randint(1, 3) for _ in range(n))


def rows_of(texts):
    return [(i, t, "en", f"s{k % 5}", None if t is None else len(t), "h", 7, "g") for k, (i, t) in enumerate(texts)]


def fixture():
    """(documents, labels, benchmark, ids and texts that the stages must keep, by hand)."""
    leak, bad = prose(900, 40), ["vilex", "grobor", "snarkle"]
    texts, labels, kept = [], [], []
    for i in range(300):
        toxic = i % 4 == 0
        texts.append((i, prose(i, 40) + (f" {random.Random(i).choice(bad)} {random.Random(i + 1).choice(bad)}." if toxic else "")))
        labels.append((i, 1, int(toxic)))
        if not toxic:
            kept.append(texts[-1])
    base = prose(700, 60).split()
    near = " ".join([*base[:30], "changed", *base[31:]])
    texts += [(400, " ".join(base)), (401, " ".join(base)), (402, near), (403, near + " "), (None, " ".join(base))]
    kept += [(400, " ".join(base)), (None, " ".join(base))]
    texts += [(410, f"{prose(710, 20)} {leak} {prose(711, 9)}"), (None, f"{leak} {prose(712, 9)}"), (411, prose(713, 30)), (411, f"{prose(714, 5)} {leak}")]
    kept.append((411, prose(713, 30)))
    texts += [(420, "the key is password=q8ZrT2mmXw91 here"), (None, "token: zz81QmnRt55p ok"), (421, None), (422, ""), (422, "")]
    kept += [(420, "the key is <secret> here"), (None, "<secret> ok"), (421, None), (422, ""), (422, "")]
    return rows_of(texts), labels, [(1, leak), (2, None), (3, "short")], kept


def write(spark, folder, docs, labels, bench):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs, labels, bench, kept = fixture()
    at = write(spark, tmp_path, docs, labels, bench)
    library = Tokenizer.from_file(bpe.tokenizer_path())
    want = []
    for i, text in kept:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest(), tuple(ids)))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in corpus_pipeline.run(spark, at).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_stages_keep_the_columns(spark, tmp_path):
    at = write(spark, tmp_path, *fixture()[:3])
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert all((r.text_hash, r.component, r._gone) == ("h", 7, "g") for r in out.limit(3).collect())


@pytest.mark.parametrize("none", ["documents", "labels", "benchmark"])
def test_empty_tables(spark, tmp_path, none):
    docs, labels, bench, _ = fixture()
    at = write(spark, tmp_path, *([] if name == none else rows for name, rows in (("documents", docs), ("labels", labels), ("benchmark", bench))))
    n = corpus_pipeline.run(spark, at).count()
    assert n == 0 if none == "documents" else n > 200
