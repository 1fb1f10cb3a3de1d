"""BPE encoding and decoding with a given merge table (word-end BPE over byte characters).

A long word is a doubly linked list of symbols. A heap holds the possible merges by (rank, position); a popped entry is
skipped when one of its symbols is gone or has grown since (a stale entry). A short one has a list of its pairs' ranks. Decoding concatenates vocabulary strings,
with a space between tokens where the file names no decoder.

Whitespace never lies inside a token, so a text is the sequence of its blank-separated chunks and each worker keeps
the results of recent chunks in a cache of bounded size.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxara.llm.common import read_table, tidy

#: Chunks, and words, in each of the two generations of a worker's caches.
CACHE_CHUNKS, CACHE_WORDS = 60_000, 60_000
#: Hashes that tell whether a chunk was met before.
MET = 1 << 21
#: Pairs of a word that does without a heap, and the rank of a pair that doesn't merge.
SHORT, NONE = 40, 1 << 32
_SPACE = regex.compile(r"\s+")
#: Python's split() takes these for blanks, the tokenizer's \s doesn't.
_NOT_BLANK = re.compile("[\x1c-\x1f]")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Bpe:
    """A tokenizer read from a tokenizers-library JSON file with NFC, blanks folded, lower case, split pattern, byte level, word-end suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        ids = self.vocab
        #: Rank of each pair (the first id shifted by 20 bits, plus the second), and what each rank makes.
        self.merges: dict[int, int] = {}
        self.made: list[int] = []
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.merges.setdefault(ids[a] << 20 | ids[b], rank)
            self.made.append(ids[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {v: k for k, v in ids.items()} | {v: k for k, v in self.special.items()}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern)
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.start = [ids[c] for c in byte_alphabet()]
        self.end = [ids[c + self.suffix] for c in byte_alphabet()]
        self.young: dict[str, tuple[str, int, str]] = {}
        self.old: dict[str, tuple[str, int, str]] = {}
        self.young_words: dict[str, tuple[str, int, str]] = {}
        self.old_words: dict[str, tuple[str, int, str]] = {}
        #: Marks of the hashes of chunks met: one is cached when it is met again.
        self.met = bytearray(MET)

    def word(self, word: str) -> list[int]:
        """Token ids of one pre-split word."""
        data = word.encode("utf-8", "surrogatepass")
        symbol = [self.start[b] for b in data[:-1]]
        symbol.append(self.end[data[-1]])
        last = len(symbol) - 1
        if last == 0:
            return symbol
        rank_of, made = self.merges.get, self.made
        if last <= SHORT:  # the pairs of a short word are searched faster than kept in a heap
            ranks = [rank_of(a << 20 | b, NONE) for a, b in pairwise(symbol)]
            while (rank := min(ranks)) != NONE:
                i = ranks.index(rank)
                symbol[i] = new = made[rank]
                del symbol[i + 1], ranks[i]
                if not ranks:
                    break
                if i:
                    ranks[i - 1] = rank_of(symbol[i - 1] << 20 | new, NONE)
                if i < len(ranks):
                    ranks[i] = rank_of(new << 20 | symbol[i + 1], NONE)
            return symbol
        heap = []
        for i in range(last):
            if (r := rank_of(symbol[i] << 20 | symbol[i + 1])) is not None:
                heap.append(r << 32 | i)
        if not heap:
            return symbol
        heapq.heapify(heap)
        before, after = list(range(-1, last)), list(range(1, last + 2))
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            top = pop(heap)
            i, rank = top & 0xFFFFFFFF, top >> 32
            if (s := symbol[i]) < 0 or (j := after[i]) > last or rank_of(s << 20 | symbol[j]) != rank:
                continue  # stale
            symbol[i], symbol[j] = (new := made[rank]), -1
            after[i] = k = after[j]
            if k <= last:
                before[k] = i
                if (r := rank_of(new << 20 | symbol[k])) is not None:
                    push(heap, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank_of(symbol[h] << 20 | new)) is not None:
                push(heap, r << 32 | h)
        return [s for s in symbol if s >= 0]

    def _word(self, word: str) -> tuple[str, int, str]:
        """What pieces has of a word; most chunks that are met once are made of words that are met again."""
        found = self.old_words.get(word)
        if found is None:
            ids = self.word(word)
            found = (" ".join(map(str, ids)), len(ids), " ".join([self.names[i] for i in ids]))
        if len(self.young_words) >= CACHE_WORDS:
            self.old_words, self.young_words = self.young_words, {}
        self.young_words[word] = found
        return found

    def _chunk(self, chunk: str) -> tuple[str, int, str]:
        found = self.old.get(chunk)
        if found is None:
            known = self.young_words.get
            parts = [known(w) or self._word(w) for w in self.split.findall(chunk)]
            found = parts[0] if len(parts) == 1 else (" ".join([p[0] for p in parts]), sum([p[1] for p in parts]), " ".join([p[2] for p in parts]))
        if not self.met[at := hash(chunk) & MET - 1]:  # most chunks never come again
            self.met[at] = 1
            return found
        if len(self.young) >= CACHE_CHUNKS:
            self.old, self.young, self.met = self.young, {}, bytearray(MET)
        self.young[chunk] = found
        return found

    def pieces(self, text: str) -> list[tuple[str, int, str]]:
        """(decimal ids joined by a space, their number, vocabulary strings joined by a space) of the parts of a text."""
        out: list[tuple[str, int, str]] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append((str(self.special[part]), 1, part))
                continue
            part = unicodedata.normalize("NFC", part)
            part = "".join([c.lower() for c in part]) if "Σ" in part else part.lower()
            chunks = part.split() if not _NOT_BLANK.search(part) else [c for c in _SPACE.split(part) if c]
            found = list(map(self.young.get, chunks))
            if None in found:
                found = [f or self._chunk(c) for f, c in zip(found, chunks, strict=True)]
            out += found
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _, _ in self.pieces(text) for i in ids.split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.names[i] for i in ids if i in self.names])


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, and with_ids the ids as array<int>.

    path: the tokenizer's JSON file, which every executor must have at that place.
    A null or empty text has no tokens (hashes of the empty string); repeated rows and null ids pass through; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(path)  # of this task alone: a worker keeps nothing for the next
        for whole in batches:
            for at in range(0, whole.num_rows, 250):  # few lists of ids in memory at a time
                batch, rows, all_ids, ends = whole.slice(at, 250), [], [], [0]
                for text in batch.column(1):
                    parts = [p for p in bpe.pieces(text.as_py() or "") if p[1]]
                    ids = " ".join([p[0] for p in parts])
                    decoded = " ".join([p[2] for p in parts])
                    rows.append((sum([p[1] for p in parts]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
                    if with_ids:
                        all_ids.append(np.fromstring(ids, np.int32, sep=" "))
                        ends.append(ends[-1] + len(all_ids[-1]))
                columns = [batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.string(), pa.string())))]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(all_ids))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens; see encode_documents for nulls, empty texts and repeated rows."""
    return encode_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())
