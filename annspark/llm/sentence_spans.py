"""Substring dedup by sliding sentence spans.

Every run of consecutive sentence pieces is hashed, runs are grouped over all documents,
and the pieces covered by a repeated run are removed wherever the run is not the first.

* A sentence ends after ``.``, ``!`` or ``?`` (closing quotes or brackets included) before
  white space, or at a line break. It is cut into pieces after each word whose hash is the
  least of some ``piece_words`` words in a row, so no piece is longer, and whether a word
  ends a piece depends only on the ``piece_words - 1`` words on either side: a passage is
  cut alike wherever it stands, also in the middle of a sentence. Any 50 words in a row
  hold a run that does not depend on the words beside them.
* The run that starts at a piece takes ``min_sentences`` pieces and goes on until it has
  ``min_words`` words, so short stock phrases alone are no run; the run that ends at a
  sentence's end is made alike backwards, so a short last piece is covered too. Words are
  compared lower-cased, white space apart.
* Repeated runs that overlap or touch make one span. A span goes if it has
  ``min_span_words`` words: a stock sentence that many documents share stays, a repeated
  passage goes, whatever the lengths of its sentences.
* First is the run in the smallest ``id``; inside a document the earlier one.

One Arrow pass makes the runs (96 hash bits, id, number) and tells, among the documents it
holds at a time, which ones cannot be the first; of a run that many documents share, it
leaves one or so open. The runs are shuffled once, by their hash, and ranked by id, so the
others that are not the first come out too; they are listed per document, and a second
Arrow pass cuts the texts. Nothing but these lists is written. Runs that stand in many
different texts without an id stay open, one row each.

Nulls and ties. A null text stays null and has no sentences; an empty text, or one of a
single sentence, has no runs and stays. Rows that share an id are one document: nothing
is removed between them, only inside each. A null id comes after all others. Repeated
rows are all returned. Further columns are carried along, whatever their names.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annspark.llm.bpe import slices
from annspark.llm.common import fresh, quoted, text_key, written

MIN_SENTENCES = 2
MIN_WORDS = 12
MIN_SPAN_WORDS = 16
PIECE_WORDS = 10
HELD_RUNS = 1 << 18  # compared within a task at a time
_NO_ID = (1 << 63) - 1

_BREAK = re.compile(r"(?<=[.!?])[\"'”’»)\]]*\s+|\s*\n\s*")
# Code points that separate words; the last entry stands for all above.
_SPACE = np.array([chr(c).isspace() for c in range(0x3001)] + [False])


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    """Lower case by code point: lengths, and so positions, stay."""
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x1E944):  # no cased letter above
        low = chr(c).lower()
        if len(low) == 1:
            table[c] = ord(low)
    table[ord("ς")] = ord("σ")
    return table


class Pieces(NamedTuple):
    """The pieces of a text; all arrays but ``at`` have one value per piece."""

    start: np.ndarray  # in code points
    end: np.ndarray
    first: np.ndarray  # its first and last word
    last: np.ndarray
    closing: np.ndarray  # ends a sentence
    at: np.ndarray  # per word: where it starts in ``norm``; one value more than words
    norm: bytes  # the lower-cased words, single spaces, 4 bytes a character


def _word_order(letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A mixed 64-bit value above 0 per word, of its letters alone."""
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(letters)) - np.repeat(starts, sizes)
    h = np.add.reduceat((letters.astype(np.uint64) + np.uint64(1)) * _ODD[place & 63], starts)
    for shift in (32, 29):
        h = (h ^ (h >> np.uint64(shift))) * _ODD[1]
    return (h ^ (h >> np.uint64(32))) | np.uint64(1)


_ODD = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(64)], np.uint64)


def _least(order: np.ndarray, sentence: np.ndarray, window: int) -> np.ndarray:
    """Per word, whether it is the least (the leftmost of equals) of any ``window`` words
    in a row of its sentence. Only the ``window - 1`` words on either side matter."""
    own = np.arange(len(order)) + sentence + window  # zeros between sentences stop the count
    padded = np.zeros(own[-1] + window + 1, np.uint64)
    padded[own] = order
    core = padded[window:-window]
    left, right = np.ones(len(core), bool), np.ones(len(core), bool)
    held = np.ones(len(core), np.int32)
    for d in range(1, window):
        left &= padded[window - d:-window - d] > core
        right &= padded[window + d:len(padded) - window + d] >= core
        held += left
        held += right
    return (held >= window)[own - window]


def pieces(text: str | None, window: int = PIECE_WORDS) -> Pieces | None:
    """The pieces of ``text``; None if it has no words."""
    if not text:
        return None
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    space = _SPACE[np.minimum(points, len(_SPACE) - 1)]
    breaks = [m.span() for m in _BREAK.finditer(text)]
    for start, stop in breaks:  # closing quotes too
        space[start:stop] = True
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(begin):
        return None
    low = _lower()[points]
    closing = np.zeros(len(begin), bool)
    closing[-1] = True
    after = np.searchsorted(begin, [stop for _, stop in breaks])
    closing[after[after > 0] - 1] = True
    sentence = np.cumsum(closing) - closing
    cut_here = _least(_word_order(low[~space], end - begin), sentence, window)
    last = np.flatnonzero(cut_here | closing)
    first = np.concatenate([[0], last[:-1] + 1])
    keep = ~space
    keep[1:] |= ~space[:-1]
    norm = np.where(space, np.uint32(32), low)[keep]
    at = np.concatenate([[0], np.cumsum(end - begin + 1)])
    return Pieces(begin[first], end[last], first, last, closing[last], at, norm.astype("<u4").tobytes())


def runs(found: Pieces | None, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS):
    """First and last piece of each run, two arrays: the shortest run from every piece on,
    and the shortest one up to every sentence end, each once."""
    if found is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(found.first)
    k = np.arange(n)
    to = np.maximum(np.searchsorted(found.last, found.first + min_words - 1), k + min_sentences - 1)
    of = np.minimum(np.searchsorted(found.first, found.last - min_words + 1, "right") - 1,
                    k - min_sentences + 1)
    ahead, back = to < n, found.closing & (of >= 0)
    both = np.unique(np.concatenate([k[ahead] * n + to[ahead], of[back] * n + k[back]]))
    return both // n, both % n


def digests(found: Pieces | None, firsts, lasts) -> list[bytes]:
    """128 hash bits of the words of each run."""
    import xxhash

    if found is None:
        return []
    begin = (4 * found.at[found.first[firsts]]).tolist()
    end = (4 * (found.at[found.last[lasts] + 1] - 1)).tolist()
    return [xxhash.xxh3_128_digest(found.norm[b:e]) for b, e in zip(begin, end)]


def cut(text: str, wanted, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS,
        piece_words: int = PIECE_WORDS, min_span_words: int = MIN_SPAN_WORDS):
    """``(kept text, removed spans)``: the text without the pieces that the runs numbered
    ``wanted`` cover, where these make spans of ``min_span_words`` words. Spans are (start, end) in code points; neighbouring removed pieces
    make one span, which takes the white space after it along."""
    found = pieces(text, piece_words)
    firsts, lasts = runs(found, min_sentences, min_words)
    if found is None:
        return text, []
    gone = np.zeros(len(found.first) + 1, dtype=bool)
    for run in wanted:
        gone[firsts[run]:lasts[run] + 1] = True
    spans, kept, at, k = [], [], 0, 0
    while k < len(found.first):
        if not gone[k]:
            k += 1
            continue
        first = k
        while gone[k]:
            k += 1
        if found.last[k - 1] - found.first[first] + 1 < min_span_words:
            continue
        start = int(found.start[first])
        end = int(found.start[k]) if k < len(found.first) else len(text)
        spans.append((start, end))
        kept.append(text[at:start])
        at = end
    kept.append(text[at:])
    out = "".join(kept)
    return (out.rstrip() if spans and spans[-1][1] == len(text) else out), spans


def _open_and_later(h, c, ids, keys, numbers):
    """Which runs may be the first of their hash, and which cannot be: another one of these
    has a smaller id, or stands further up in the same document. Two lists of positions;
    of rows that are equal in all, one is listed."""
    order = np.lexsort((numbers, keys, ids, c, h))
    h, c, ids, keys, numbers = (x[order] for x in (h, c, ids, keys, numbers))
    same_run = np.zeros(len(order), bool)
    same_run[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
    begin = np.flatnonzero(~same_run)
    least = np.repeat(ids[begin], np.diff(np.append(begin, len(order))))
    same_doc = same_run.copy()
    same_doc[1:] &= (ids[1:] == ids[:-1]) & (keys[1:] == keys[:-1])
    begin = np.flatnonzero(~same_doc)
    upmost = np.repeat(numbers[begin], np.diff(np.append(begin, len(order))))
    twice = same_doc.copy()
    twice[1:] &= numbers[1:] == numbers[:-1]
    later = (ids > least) | (numbers > upmost)
    return np.sort(order[~later & ~twice]), np.sort(order[later & ~twice])


def span_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS,
              piece_words: int = PIECE_WORDS, held_runs: int = HELD_RUNS) -> DataFrame:
    """``h, c, id, text_hash, run``: the runs of every document, numbered, one row each. A
    run that is known not to be the first has no ``c``, and an ``h`` that its document's
    runs share. Runs are compared within a task, some ``held_runs`` at a time."""

    def sorted_out(held):
        h, c, ids, keys, numbers = (np.concatenate(x) for x in zip(*held))
        opened, later = _open_and_later(h, c, ids, keys, numbers)
        spread = keys[later] ^ (ids[later] * _ODD[0].astype(np.int64))
        for take, first, second in ((opened, h[opened], pa.array(c[opened], pa.int32())),
                                    (later, spread, pa.nulls(len(later), pa.int32()))):
            yield pa.RecordBatch.from_arrays([
                pa.array(first, pa.int64()), second, pa.array(ids[take], pa.int64()),
                pa.array(keys[take], pa.int64()), pa.array(numbers[take], pa.int32())],
                names=["h", "c", "id", "text_hash", "run"])

    def hashed(batches):
        held, n = [], 0
        for batch in slices(batches):
            ids, keys, texts = (batch.column(k) for k in range(3))
            made, counts = [], []
            for text in texts.to_pylist():
                found = pieces(text, piece_words)
                of_text = digests(found, *runs(found, min_sentences, min_words))
                made += of_text
                counts.append(len(of_text))
            words = np.frombuffer(b"".join(made), dtype="<i4").reshape(-1, 4)
            numbers = np.arange(len(made)) - np.repeat(np.cumsum(counts) - counts, counts)
            held.append((np.ascontiguousarray(words[:, :2]).view("<i8").ravel(), words[:, 2],
                         np.repeat(ids.to_numpy(), counts), np.repeat(keys.to_numpy(), counts),
                         numbers.astype(np.int32)))
            n += len(made)
            if n >= held_runs:
                yield from sorted_out(held)
                held, n = [], 0
        if n:
            yield from sorted_out(held)

    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"),
                       text_key(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return slim.mapInArrow(hashed, "h long, c int, id long, text_hash long, run int")


def sentence_span_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS,
                        piece_words: int = PIECE_WORDS, out_col: str = "span_dedup",
                        min_span_words: int = MIN_SPAN_WORDS) -> DataFrame:
    """All columns of ``docs`` with the cleaned text, and one struct column
    ``out_col`` of ``n_removed`` (sentence spans) and ``spans`` (start, end), which takes
    the place of a column of that name."""
    made = span_runs(docs, id_col, text_col, min_sentences, min_words, piece_words)
    by_id = Window.partitionBy("h", "c").orderBy("id")
    # Rows of one text that stand twice in the table give the same run twice: a set.
    cuts = (made.withColumn("rank", F.rank().over(by_id)).where("c is null or rank > 1")
            .groupBy("id", "text_hash").agg(F.collect_set("run").alias("runs")))
    *key, found, done = fresh(docs, "_id", "_th", "_runs", "_cut")
    cuts = written(cuts, "cuts").select(F.col("id").alias(key[0]), F.col("text_hash").alias(key[1]),
                                        F.col("runs").alias(found))

    @F.arrow_udf("struct<text:string,spans:array<struct<start:int,end:int>>>")
    def _cut(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for text, wanted in zip(texts.to_pylist(), lists.to_pylist()):
            if not wanted or text is None:
                out.append({"text": None, "spans": []})
                continue
            kept, spans = cut(text, wanted, min_sentences, min_words, piece_words, min_span_words)
            out.append({"text": kept, "spans": [{"start": s, "end": e} for s, e in spans]})
        return pa.array(out, pa.struct([("text", pa.string()), ("spans", pa.list_(
            pa.struct([("start", pa.int32()), ("end", pa.int32())])))]))

    keyed = docs.withColumns({key[0]: F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)),
                              key[1]: text_key(text_col)})
    # Only texts with something to cut go through Python.
    todo = F.when(F.col(found).isNotNull(), F.col(text_col))
    whole = keyed.join(cuts, key, "left").withColumn(done, _cut(todo, F.col(found)))
    text = F.when(F.col(found).isNotNull(), F.col(done)["text"]).otherwise(F.col(text_col)).alias(text_col)
    names = [text if c == text_col else F.col(quoted(c)) for c in docs.columns if c.lower() != out_col.lower()]
    spans = F.col(done)["spans"]
    return whole.select(*names, F.struct(F.size(spans).alias("n_removed"), spans.alias("spans")).alias(out_col))
