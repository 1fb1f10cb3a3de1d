"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Each kind of pattern is found with its place in the text: splitting at the pattern gives what lies between matches,
so a running sum of lengths gives every match's span in code points. Candidate values are hashed and aggregated by
distinct repositories and owners over the whole corpus. A value that more than MAX_OWNERS owners hold is a widely
copied example; one that looks like a placeholder is none either; what is left is live-looking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxara.llm.common import few, join_hot, read_table, stash

#: Kinds in the order of the span list: name, pattern, group that is the secret, its least length in code points.
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: What the method adds.
MORE = [
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 32),
    # To the end line, or as far as lines of base64 go where it is missing: the header alone is the same for every key.
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*(?:-[^-]+){0,8}?-----END [A-Z ]*PRIVATE KEY-----|(?:\s+[A-Za-z0-9+/=]{16,})*)", 0, 20),
]
ANY = r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA|[0-9a-f]{24}|gh[pousr]_|eyJ|-----BEGIN "
#: A candidate held by more owners than this is a copied example.
MAX_OWNERS = 2
PLACEHOLDER = r"(?i)example|changeme|change_me|placeholder|dummy|sample|your[_-]|x{6,}|0{8,}|1234567"
#: Matches of a text that are appended one by one.
BLOCK = 128
SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"


def _found(text: Column, n: int, pattern: str, group: int, least: int) -> Column:
    """The spans of one kind that are long enough, as SPAN."""
    between = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    each = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), values.alias("v"), F.transform(between, F.length).alias("gap"))
    none = F.from_json(F.lit("[]"), SPAN)
    size = lambda x: x["gap"] + F.coalesce(F.length(x["m"]), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        start, stop = acc["at"] + x["gap"], acc["at"] + size(x)
        span = F.struct(start.alias("start"), F.lit(n).alias("kind"), stop.alias("stop"), x["v"].alias("value"))
        return F.struct(stop.alias("at"), F.when(x["m"].isNotNull() & (F.length(x["v"]) >= least), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    # Appending copies an array, so matches are summed up in blocks, and appended within a block alone.
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(each) - 1) / BLOCK)), lambda k: F.slice(each, (k * BLOCK + 1).cast("int"), F.lit(BLOCK)))
    begin = lambda acc, b: F.struct((acc["at"] + F.aggregate(b, F.lit(0), lambda t, x: t + size(x))).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), b.alias("b")))).alias("out"))
    kind = "array<struct<at:int,b:array<struct<m:string,v:string,gap:int>>>>"
    placed = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), kind).alias("out")), begin, lambda acc: acc["out"])
    return F.flatten(F.transform(placed, lambda p: F.aggregate(p["b"], F.struct(p["at"].alias("at"), none.alias("out")), step, lambda acc: acc["out"])))


def candidates(docs: DataFrame, owner: Column, repository: Column, text_col: str = "text") -> DataFrame:
    """docs' columns with owner, repository, and spans: every candidate of BASE and MORE by start, then kind.

    Null and empty texts have none. The three replace columns of docs that have their names. Repeated rows have a result each.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kinds = [_found(text, n, p, g, k) for n, (_, p, g, k) in enumerate(BASE + MORE)]
    spans = F.when(text.rlike(ANY), F.array_sort(F.concat(*kinds))).otherwise(F.from_json(F.lit("[]"), SPAN))
    new = {"owner": F.coalesce(owner, F.lit("")), "repository": F.coalesce(repository, F.lit("")), "spans": spans}
    return docs.select(*[docs[c] for c in docs.columns if c.lower() not in new], *[c.alias(name) for name, c in new.items()])


def ownership(found: DataFrame) -> DataFrame:
    """value_hash, owners, repositories, occurrences, verdict of each candidate value in the corpus.

    Rows are first reduced to one for each value, owner and repository, so a value that a third of all rows hold
    reaches its last aggregation as few rows. Rows without an owner or repository share the one that has no name.
    """
    each = found.select("owner", "repository", F.explode("spans").alias("s")).select("owner", "repository", F.sha2("s.value", 256).alias("value_hash"), F.col("s.value").alias("value"))
    once = each.groupBy("value_hash", "owner", "repository").agg(F.count("*").alias("n"), F.min("value").alias("value"))
    by_owner = once.groupBy("value_hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("r"), F.min("value").alias("value"))
    total = by_owner.groupBy("value_hash").agg(F.count("*").alias("owners"), F.sum("r").alias("repositories"), F.sum("n").alias("occurrences"), F.min("value").alias("value"))
    placeholder = F.col("value").rlike(PLACEHOLDER) | (F.size(F.array_distinct(F.split("value", ""))) < 6)
    verdict = F.when(F.col("owners") > MAX_OWNERS, "copied").when(placeholder, "placeholder").otherwise("live")
    return total.select("value_hash", "owners", "repositories", "occurrences", verdict.alias("verdict"))


def judged(found: DataFrame, key: list[str]) -> DataFrame:
    """key and judged: the spans of each keyed row with their verdicts, for rows that have any. key must tell rows apart, or hold for equal rows."""
    each = found.select(*key, F.explode("spans").alias("s")).select(*key, "s", F.sha2("s.value", 256).alias("value_hash"))
    values, _ = stash(ownership(found), "ownership")
    item = F.struct(F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.stop").alias("stop"), "verdict", "owners", "repositories")
    return join_hot(each, values, "value_hash", "occurrences").groupBy(*key).agg(F.array_sort(F.collect_set(item)).alias("judged"))


def span_text(spans: Column, keep: int | None = None) -> Column:
    """kind:start:end of each span, comma-joined; keep: only the first kinds."""
    names = F.array(*[F.lit(k[0]) for k in BASE + MORE])
    kept = spans if keep is None else F.filter(spans, lambda s: s["kind"] < keep)
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan(docs: DataFrame, owner: Column, repository: Column) -> tuple[DataFrame, DataFrame]:
    """(candidates of every row without its text, as a table in the shared folder; the verdicts of rows that have any), both keyed by doc_id and text_hash."""
    found, _ = stash(candidates(docs.select("doc_id", "text", owner.alias("_o"), repository.alias("_r")), F.col("_o"), F.col("_r")).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "owner", "repository", "spans"), "secrets")
    return found, judged(found.filter(F.size("spans") > 0), ["doc_id", "text_hash"])


def with_verdicts(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """rows (which have doc_id and text_hash) with the other columns of verdicts, or nulls. Null ids are equal."""
    right = verdicts.withColumnsRenamed({"doc_id": "_doc", "text_hash": "_hash"})
    return rows.join(right, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left").drop("_doc", "_hash")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source is its owner, and its source with its language the repository.

    Every row has a result; null and empty texts have no spans, and null ids and repeated ids are told apart by their texts.
    """
    docs = read_table(spark, sf_dir, "documents")
    found, verdicts = scan(docs, F.col("source"), F.concat_ws("/", "source", "lang"))
    count = lambda n: F.size(F.filter("spans", lambda s: s["kind"] == n)).cast("bigint")
    of = lambda v: F.coalesce(F.size(F.filter("judged", lambda s: s["verdict"] == v)), F.lit(0)).cast("bigint")
    rows = with_verdicts(found, verdicts)
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(span_text(F.col("spans"), len(BASE)), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"),
        of("live").alias("n_live"), of("copied").alias("n_copied"), of("placeholder").alias("n_placeholder"),
    )


def redact(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with live-looking spans of their texts replaced by <secret>, and n_chars counted anew where that changes a text.

    Rows are told apart by id and text, so null ids and repeated ids have their own spans. Null texts stay null. Other
    columns are kept, whatever their names.
    """
    _, verdicts = scan(docs, F.col("source"), F.concat_ws("/", "source", "lang"))
    live, _ = stash(verdicts.select(F.col("doc_id").alias("_live_id"), F.col("text_hash").alias("_live_hash"), F.filter("judged", lambda s: s["verdict"] == "live").alias("_live_spans")).filter(F.size("_live_spans") > 0), "live")
    own, spans = docs["text"], live["_live_spans"]

    def step(acc: Column, s: Column) -> Column:
        inside = s["stop"] <= acc["at"]
        start = F.greatest(s["start"], acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["stop"]).alias("at"),
            F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.substring(own, acc["at"] + 1, start - acc["at"]), F.lit("<secret>"))).alias("out"),
        )

    text = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(own, acc["at"] + 1, F.length(own))))
    joined = docs.join(few(live)(live), docs["doc_id"].eqNullSafe(live["_live_id"]) & (F.xxhash64(F.coalesce(own, F.lit(""))) == live["_live_hash"]), "left")
    changed = spans.isNotNull()
    new = {"text": F.when(changed, text).otherwise(own), "n_chars": F.when(changed, F.char_length(text).cast("bigint")).otherwise(docs["n_chars"]) if "n_chars" in docs.columns else None}
    return joined.select(*[new.get(c, docs[c]).alias(c) for c in docs.columns])
