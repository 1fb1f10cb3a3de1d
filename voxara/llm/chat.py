"""Chat formatting from heterogeneous layouts.

A record is JSON in one of several layouts. Its schema fingerprint - the hash of its sorted nested field paths, list
elements written as [] - selects a declarative mapping, which yields canonical (role, text) turns; records of an
unknown fingerprint give no turns and are reported. Turns are then set into a template that marks each turn and its
role and escapes control strings inside texts, so that reading back is exact.

Rows of a conversation stand together and in order after one shuffle and a sort; they are streamed, never collected,
so that a conversation of any length needs little memory.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxara.llm.common import read_table, tidy

#: Control strings of the template. The backslash is its escape character.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\] (.*?)</s>", re.S)


def escape(text: str) -> str:
    """Doubles backslashes and puts one after the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def field_paths(value: Any) -> set[str]:
    """Nested field paths of a JSON value; an empty object or list counts as a leaf. Any depth will do."""
    out, todo = set(), [(value, "")]
    while todo:
        v, at = todo.pop()
        if isinstance(v, dict) and v:
            todo += [(x, f"{at}.{k}") for k, x in v.items()]
        elif isinstance(v, list) and v:
            todo += [(x, f"{at}[]") for x in v]
        else:
            out.add(at)
    return out


def _as_text(value: Any) -> str:
    """A leaf as text: null is empty, what is no string is its JSON; a lone surrogate becomes a question mark."""
    text = "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return text.encode("utf-8", "replace").decode()


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha1("\n".join(sorted(paths)).encode()).hexdigest()


#: Each layout: its field paths, and its mapping: ("fields", [(role, path), ...]) or ("list", path, role field, text field, role names).
LAYOUTS: dict[str, tuple[set[str], tuple]] = {
    "prompt": ({".prompt"}, ("fields", [("user", ["prompt"])])),
    "completion": ({".completion"}, ("fields", [("assistant", ["completion"])])),
    "pair": ({".prompt", ".completion"}, ("fields", [("user", ["prompt"]), ("assistant", ["completion"])])),
    "instruction": ({".instruction.text"}, ("fields", [("user", ["instruction", "text"])])),
    "output": ({".output.text"}, ("fields", [("assistant", ["output", "text"])])),
    "instruction_pair": ({".instruction.text", ".output.text"}, ("fields", [("user", ["instruction", "text"]), ("assistant", ["output", "text"])])),
    "messages": ({".messages[].role", ".messages[].content"}, ("list", ["messages"], "role", "content", {})),
    "shares": ({".conversations[].from", ".conversations[].value"}, ("list", ["conversations"], "from", "value", {"human": "user", "gpt": "assistant"})),
}
MAPPINGS = {fingerprint(paths): (name, rule) for name, (paths, rule) in LAYOUTS.items()}


def canonical(record: str | None, mappings: dict[str, tuple[str, tuple]] = MAPPINGS) -> tuple[str, list[tuple[str, str]] | None]:
    """(fingerprint, turns) of a JSON record; turns is None where JSON is broken or nested too deep to parse, or no mapping has its fingerprint.

    Null texts are empty, and numbers, true, false and empty lists or objects in a text's place are their JSON.
    """
    try:
        value = json.loads(record or "")
    except (ValueError, RecursionError):
        return "", None
    print_ = fingerprint(field_paths(value))
    if (rule := mappings.get(print_, ("", None))[1]) is None:
        return print_, None

    def reach(v: Any, path: list[str]) -> Any:
        for k in path:
            v = v[k]
        return v

    if rule[0] == "fields":
        return print_, [(role, _as_text(reach(value, path))) for role, path in rule[1]]
    _, path, role, text, names = rule
    turns = [(_as_text(x.get(role)), _as_text(x.get(text))) for x in reach(value, path)]
    return print_, [(names.get(r, r), t) for r, t in turns]


def canonical_turns(records: DataFrame, key: str = "conv_id", json_col: str = "record") -> DataFrame:
    """key, fingerprint, role, text: a row for each turn, in the records' order; an unmapped or null record gives one row with null role and text.

    Null and repeated keys pass through; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, prints, roles, texts = [], [], [], []
            for i, record in enumerate(batch.column(1)):
                print_, turns = canonical(record.as_py())
                for role, text in [(None, None)] if turns is None else turns:
                    at.append(i)
                    prints.append(print_)
                    roles.append(role)
                    texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(prints, pa.string()), pa.array(roles, pa.string()), pa.array(texts, pa.string())], names=[key, "fingerprint", "role", "text"])

    kind = dict(records.dtypes)[key]
    return records.select(key, json_col).mapInArrow(tidy(run), f"`{key}` {kind}, fingerprint string, role string, text string")


def format_turns(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, formatted, loss_start, loss_end: the template text of each turn and, for assistant turns, the loss mask within it (code points).

    A conversation's formatted text is that of its rows, in order. Rows without a role are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out, starts, ends = [], [], [], []
            for i, (role, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if role is None:
                    continue
                head, body = f"<s>[INST] {escape(role)} [/INST] ", escape(text or "")
                at.append(i)
                out.append(f"{head}{body}</s>")
                starts.append(len(head) if role == "assistant" else None)
                ends.append(len(head) + len(body) if role == "assistant" else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(out, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=[key, "formatted", "loss_start", "loss_end"])

    kind = dict(turns.dtypes)[key]
    return turns.select(key, "role", "text").mapInArrow(tidy(run), f"`{key}` {kind}, formatted string, loss_start bigint, loss_end bigint")


def read_back(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """A row per run of equal keys: counts and hashes of the turns and of the text under the loss mask, parsed from the formatted text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None  # key, turns, hash, loss characters, hash, formatted characters
        kind = None

        def rows(done: list[list]) -> pa.RecordBatch:
            c = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c[0], kind), pa.array(c[1], pa.int64()), pa.array([h.hexdigest() for h in c[2]], pa.string()), pa.array(c[3], pa.int64()), pa.array([h.hexdigest() for h in c[4]], pa.string()), pa.array(c[5], pa.int64())], names=[key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for k, text, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or state[0] != k:
                    if state is not None:
                        done.append(state)
                    state = [k, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in _TURN.findall(text):
                    state[1] += 1
                    state[2].update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                if start is not None:
                    loss = unescape(text[start:end])
                    state[3] += len(loss)
                    state[4].update(loss.encode())
                state[5] += len(text)
            if done:
                yield rows(done)
        if state is not None:
            yield rows([state])

    kind = dict(formatted.dtypes)[key]
    return formatted.select(key, "formatted", "loss_start", "loss_end").mapInArrow(tidy(run), f"`{key}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def as_layouts(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and a JSON record of each row in a layout that depends on conversation and role."""
    text, pick = F.coalesce("text", F.lit("")), F.pmod(F.xxhash64("conv_id"), F.lit(4))
    json_of = lambda **c: F.to_json(F.struct(*[v.alias(k) for k, v in c.items()]))
    role = F.coalesce("role", F.lit(""))
    user, assistant = role == "user", role == "assistant"
    one = lambda a, b, name: F.array(F.struct(name.alias(a), text.alias(b)))
    record = (
        F.when((pick == 0) & user, json_of(prompt=text))
        .when((pick == 0) & assistant, json_of(completion=text))
        .when((pick == 1) & user, json_of(instruction=F.struct(text.alias("text"))))
        .when((pick == 1) & assistant, json_of(output=F.struct(text.alias("text"))))
        .when((pick == 2) & user, json_of(conversations=one("from", "value", F.lit("human"))))
        .when((pick == 2) & assistant, json_of(conversations=one("from", "value", F.lit("gpt"))))
        .otherwise(json_of(messages=one("role", "content", role)))
    )
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), record.alias("record"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ties in turn are ordered by role and text; rows without a conversation id form one conversation."""
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    planted = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", planted), (-7, 1, "assistant", planted)], "conv_id bigint, turn bigint, role string, text string")
    ordered = as_layouts(rows.unionByName(own)).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return read_back(format_turns(canonical_turns(ordered)))


SQL = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, replace(text, '\', '\\') AS b FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(23 + length(role) + length(b) + len(regexp_extract_all(b, '<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>')))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""
