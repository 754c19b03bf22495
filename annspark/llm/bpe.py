"""Byte-level BPE encoding and decoding with a lexicon of the corpus's frequent words.

1. The pre-tokens of the whole corpus are counted; the ``lexicon_words`` most frequent
   ones (a documented bound) are merged once and compiled into a minimal acyclic
   transducer (``lexicon.py``).
2. The file goes to the executors as a Spark file (``addFile``: fetched anew by any
   executor that joins later) and is memory-mapped by their workers.
3. A second pass splits the texts, looks words up in the transducer and merges the words
   it does not hold exactly, so ids never depend on what the lexicon holds.

A tokenizer JSON is read on the driver; its path is a parameter. Supported is what
byte-level BPE files use: added tokens matched in the text, the byte-level split, merges,
and the byte-level decoder. Anything else is refused.

Nulls and ties. A null text counts as empty: no ids. Every row gets its row, also repeated
ones, and further columns are carried along (columns named like a result are replaced).
An empty table gives an empty result and an empty lexicon. Very long texts are encoded
whole; a long word is merged with a heap.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annspark.llm.common import quoted, written
from annspark.llm.lexicon import Lexicon, compile_lexicon

# The pre-token pattern of byte-level BPE files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEXICON_WORDS = 262_144
LEXICON_WORD_BYTES = 48
MEMO_WORDS = 300_000
COUNTER_WORDS = 400_000
SHORT_WORD = 48
CHUNK_CHARS = 500_000
SLICE_ROWS = 256
_NONE = 1 << 40


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is
    a printable Latin-1 character, else the next free one from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b], extra = chr(extra), extra + 1
    return letters


class Vocabulary:
    """Merges, token bytes and added tokens of a byte-level BPE tokenizer JSON."""

    def __init__(self, spec: dict):
        model, pre, dec = spec["model"], spec["pre_tokenizer"], spec.get("decoder") or {}
        odd = [k for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "dropout")
               if model.get(k)] + [k for k in ("byte_fallback", "ignore_merges") if model.get(k)]
        if (model.get("type") != "BPE" or odd or spec.get("normalizer")
                or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space")
                or not pre.get("use_regex", True) or dec.get("type") != "ByteLevel"):
            raise ValueError(f"not a plain byte-level BPE tokenizer: {odd}")
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        ids = model["vocab"]
        self.first = [ids[c] for c in byte_letters()]
        self.rank, self.made = {}, []  # pair of ids -> rank; rank -> id of the merged token
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault((ids[a], ids[b]), rank)
            self.made.append(ids[a + b])
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens with stripping or word rules are not supported")
        self.bytes = [b""] * (max([*ids.values(), *self.added.values()]) + 1)
        for token, i in [*ids.items(), *self.added.items()]:
            known = all(c in byte_of for c in token)
            self.bytes[i] = bytes(byte_of[c] for c in token) if known else token.encode()

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one pre-token: the lowest-ranked pair first, leftmost of equals."""
        ids = [self.first[b] for b in word]
        return self._merge_short(ids) if len(ids) <= SHORT_WORD else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        get, made = self.rank.get, self.made
        ranks = [get(pair, _NONE) for pair in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == _NONE:
                break
            k = ranks.index(low)
            ids[k:k + 2] = (made[low],)
            del ranks[k]
            if k < len(ranks):
                ranks[k] = get((ids[k], ids[k + 1]), _NONE)
            if k:
                ranks[k - 1] = get((ids[k - 1], ids[k]), _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        get, heap = self.rank.get, []

        def push(k):
            j = nxt[k]
            if j < n:
                rank = get((ids[k], ids[j]))
                if rank is not None:
                    heapq.heappush(heap, (rank, k, ids[k], ids[j]))

        for k in range(n - 1):
            push(k)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            j = nxt[k] if ids[k] == a else n
            if j >= n or ids[j] != b:
                continue  # one of the two has been merged meanwhile
            ids[k], ids[j] = self.made[rank], -1
            nxt[k] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = k
            push(k)
            if prv[k] >= 0:
                push(prv[k])
        return [x for x in ids if x >= 0]


def load_spec(path: str) -> dict:
    """A tokenizer JSON, read on the driver; broadcast as plain data (a few MB)."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


class Encoder:
    """Encodes and decodes texts; keeps a bounded memo of the pre-tokens met so far."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None,
                 match_added: bool = True):
        import regex

        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.words = regex.compile(SPLIT).findall
        self.memo: dict = {}
        longest_first = sorted(vocabulary.added, key=len, reverse=True) if match_added else []
        self.added = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") \
            if longest_first else None

    def _learn(self, new: list) -> None:
        words = [w for w in new if isinstance(w, str)]
        raw = [w.encode("utf-8", "replace") for w in words]
        ranks = self.lexicon.ranks(raw).tolist() if self.lexicon else [-1] * len(raw)
        for word, data, rank in zip(words, raw, ranks):
            self.memo[word] = (self.lexicon.tokens(rank).tobytes() if rank >= 0
                               else array("I", self.vocabulary.merge(data)).tobytes())
        for i in new:
            if not isinstance(i, str):  # the id of an added token stands for itself
                self.memo[i] = array("I", [i]).tobytes()

    def _split(self, text: str | None) -> list:
        """Pre-tokens, with the ids of added tokens in their places."""
        if not text:
            return []
        if self.added is None or not self.added.search(text):
            return self.words(text)
        out: list = []
        for k, part in enumerate(self.added.split(text)):
            out.extend([self.vocabulary.added[part]] if k % 2 else self.words(part))
        return out

    def encode_all(self, texts, chunk: int = CHUNK_CHARS):
        """Token ids of each text, as little-endian unsigned 32-bit integers. Texts are
        taken about ``chunk`` characters at a time, so unknown words are looked up together."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text or "")
            if size >= chunk:
                yield from self._encode(held)
                held, size = [], 0
        yield from self._encode(held)

    def _encode(self, texts) -> list[bytes]:
        split = [self._split(t) for t in texts]
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        new = {w for words in split for w in words if w not in memo}
        if new:
            self._learn(list(new))
        # Made before any is handed out: the next texts, also those of another call that is
        # read in turn with this one, may clear the memo.
        return [b"".join(map(memo.__getitem__, words)) for words in split]

    def encode(self, text: str | None) -> bytes:
        return self._encode([text])[0]

    def decode(self, ids: bytes) -> str:
        found = np.frombuffer(ids, dtype="<u4").tolist()
        return b"".join(map(self.vocabulary.bytes.__getitem__, found)).decode("utf-8", "replace")


def slices(batches, rows: int = SLICE_ROWS):
    """The batches in parts of few rows, so that only a few texts are Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def frequent_words(docs: DataFrame, text_col: str = "text", limit: int = LEXICON_WORDS,
                   max_bytes: int = LEXICON_WORD_BYTES) -> DataFrame:
    """``word, n``: the most frequent pre-tokens over all rows, at most ``limit`` of them.

    What stands between spaces is counted first, in DataFrame functions; then each distinct
    piece, a space put before it, is split into pre-tokens once. Words are graded by the
    logarithm of their count; the grades from the top that hold ``limit`` words at most are
    taken whole, so nothing is sorted and only a table of a few hundred grades comes to the
    driver."""

    def split(batches):
        import regex

        find, seen = regex.compile(SPLIT).findall, Counter()

        def flush():
            rows = [(w, n) for w, n in seen.items() if len(w.encode("utf-8", "replace")) <= max_bytes]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()),
                                               pa.array([n for _, n in rows], pa.int64())],
                                              names=["word", "n"])

        for batch in batches:
            for piece, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word in find(" " + piece):
                    seen[word] += n
            if len(seen) > COUNTER_WORDS:
                yield flush()
        yield flush()

    pieces = (docs.select(F.explode(F.split(F.col(text_col), " ")).alias("piece"))
              .where(F.length("piece").between(1, max_bytes))
              .groupBy("piece").agg(F.count(F.lit(1)).alias("n")))
    counted = written(pieces.mapInArrow(split, "word string, n long")
                      .groupBy("word").agg(F.sum("n").alias("n"))
                      .withColumn("grade", F.floor(F.log("n") * 16)), "word-counts")
    taken, least = 0, None
    for row in sorted(counted.groupBy("grade").count().collect(), reverse=True):
        taken += row["count"]
        if taken > limit:
            break
        least = row["grade"]
    return counted.where(F.col("grade") >= least if least is not None else F.lit(False)).select("word", "n")


def build_lexicon(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text",
                  limit: int = LEXICON_WORDS) -> str:
    """Compiles the corpus's frequent words and ships the file; returns its Spark name.

    At most ``limit`` words of ``LEXICON_WORD_BYTES`` bytes come to the driver. The file
    lies in the driver's own Spark files folder, which Spark removes with the session."""
    rows = frequent_words(docs, text_col, limit).select("word").collect()
    words = [r[0].encode("utf-8") for r in rows]
    data = compile_lexicon([(w, vocabulary.merge(w)) for w in words])
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    path = os.path.join(SparkFiles.getRootDirectory(), "lexicons", name)
    if not os.path.exists(path):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)
    docs.sparkSession.sparkContext.addFile(path)
    return name


def _numbered(kept) -> list:
    """Columns under plain names of their own, since theirs may hold any marks."""
    return [F.col(quoted(f.name)).alias(f"c{k}") for k, f in enumerate(kept)]


def encode_table(docs: DataFrame, tokenizer: str, text_col: str = "text",
                 lexicon_words: int = LEXICON_WORDS, with_ids: bool = True) -> DataFrame:
    """``docs`` without its text, plus ``n_tokens``, ``ids`` (array, unless ``with_ids`` is
    off), ``ids_sha256`` and ``decoded_sha256`` of the text decoded from the ids."""
    spec = load_spec(tokenizer)
    name = build_lexicon(docs, Vocabulary(spec), text_col, lexicon_words)
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    made = ["n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    kept = [f for f in docs.schema.fields if f.name != text_col and f.name not in made]
    new = [T.StructField("n_tokens", T.LongType())]
    if with_ids:
        new.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    new += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def run(batches):
        encoder = Encoder(Vocabulary(shared.value), Lexicon(SparkFiles.get(name)))
        for batch in slices(batches):
            n, digest, back, blobs = [], [], [], []
            for ids in encoder.encode_all(batch.column("text").to_pylist()):
                n.append(len(ids) // 4)
                digest.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(encoder.decode(ids).encode("utf-8")).hexdigest())
                blobs.append(ids if with_ids else b"")
            cols = [batch.column(k) for k in range(len(kept))] + [pa.array(n, pa.int64())]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                flat = np.frombuffer(b"".join(blobs), dtype="<i4")
                cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
            cols += [pa.array(digest, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in kept + new])

    source = docs.select(*_numbered(kept), F.col(quoted(text_col)).alias("text"))
    return source.mapInArrow(run, T.StructType(kept + new))


def count_tokens(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, plus ``n_tokens`` (a null text: 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(load_spec(tokenizer))
    kept = [f for f in docs.schema.fields if f.name not in (text_col, "n_tokens")]

    def run(batches):
        encoder = Encoder(Vocabulary(shared.value))
        for batch in slices(batches):
            n = [len(ids) // 4 for ids in encoder.encode_all(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(kept))] + [pa.array(n, pa.int64())],
                                             names=[f.name for f in kept] + ["n_tokens"])

    source = docs.select(*_numbered(kept), F.col(quoted(text_col)).alias("text"))
    return source.mapInArrow(run, T.StructType([*kept, T.StructField("n_tokens", T.LongType())]))
