"""Repeated passages from sparse suffix arrays.

Only suffixes at content-selected places are kept: a word position is a
minimiser if its gram of `gram` words has the smallest hash among the grams
that start in some stretch of `passage - gram + 1` words. Equal passages of
`passage` words contain the same minimiser at the same place, so:

1. A minimiser gram that only one text has starts no common suffix; it goes.
2. At the others, one suffix is kept for each place: the words to its right and
   left that passages with this minimiser reach. Equal ones of one text, as in a
   line that it repeats thousands of times, are one row from the start; equal ones
   of several texts become one row.
3. The rows are sorted by the words of the suffix, and each is compared with its
   two neighbours. No other row shares more words to the right than these do, so
   the common prefix tells which passages no row but this one can have: they are
   matched if several texts have the row, and dropped if not.
4. The other passages reach as far to the left as the minimiser lies behind their
   start. They are extended to the left and compared as whole passages, since the
   neighbour with the longest common prefix needn't be the one that also matches
   to the left.
5. Matching passages that overlap are joined, which extends a match to its full
   length on both sides.

Rows at the ends of a sorted chunk have a neighbour in another task; their
passages all go through step 4. Copies of a whole text are one text from the
start. Texts are told apart by 128-bit hashes, contexts and passages likewise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blocktrace.llm.common import WORD, bounded, fresh, hashed_words, join_uneven, mix64, settle, slices

WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")
#: A longer word stands in a suffix by its hash, in a form that is too long for a word that stands by itself.
LONGEST_WORD = 32
SUFFIX = ("text_no long, doc_id long, firsts array<long>, lasts array<long>, near int, far int, left binary, right binary, "
          "context binary")
JUDGED = "context binary, near int, far int, passage binary, first_id long, low long, high long"


def gram_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of each run of `width` words."""
    count = len(hashes) - width + 1
    with np.errstate(over="ignore"):
        out = np.full(max(count, 0), width, dtype=np.uint64)
        if count > 0:
            for j in range(width):
                out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j:j + count]
    return mix64(out)


def anchors(hashes: np.ndarray, passage: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a passage, the place of its minimiser and that gram's hash."""
    if len(hashes) < passage:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    grams = gram_hashes(hashes, gram)
    width = passage - gram + 1
    starts = len(hashes) - passage + 1
    places = np.empty(starts, dtype=np.int64)
    for low in range(0, starts, 16384):
        high = min(low + 16384, starts)
        view = sliding_window_view(grams[low:high + width - 1], width)
        places[low:high] = np.arange(low, high) + view.argmin(axis=1)
    return places, grams[places].view(np.int64)


def _text_id(text: str = "text") -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def _minimisers(docs: DataFrame, passage: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            counts, keys = [], []
            for text in part.column("text").to_pylist():
                hashes = hashed_words((text or "").encode())
                counts.append(len(hashes))
                keys.append(np.unique(anchors(hashes, passage, gram)[1]))
            yield pa.record_batch([part.column("doc_id"), part.column("text_id"), pa.array(counts, pa.int64()),
                                   pa.array(keys, pa.list_(pa.int64()))],
                                  names=["doc_id", "text_id", "words", "grams"])

    return bounded(docs).select(docs["doc_id"].cast("long"), _text_id().alias("text_id"), "text").mapInArrow(
        run, "doc_id long, text_id binary, words long, grams array<long>")


def _record(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows of a schema of longs, lists of them, ints and binaries."""
    names, kinds = zip(*(field.split() for field in schema.split(", ")))
    types = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "int": pa.int32(), "binary": pa.binary()}
    return pa.record_batch([pa.array(c, types[k]) for c, k in zip(zip(*rows), kinds)], names=list(names))


def _written(word: bytes) -> bytes:
    """A word as it stands in a suffix, closed by a space."""
    return word + b" " if len(word) <= LONGEST_WORD else b"#" + xxhash.xxh3_128_hexdigest(word).encode() + b" "


def _suffixes(docs: DataFrame, wanted: DataFrame, passage: int, gram: int) -> DataFrame:
    """One suffix for each text and each context of a minimiser at a shared gram, with the words that its passages reach.

    Passages with the minimiser at a place start `near` to `far` words before it. The places of a context in its
    text are given as runs, from `firsts` to `lasts`, in which each place is at most `passage` words after the one
    before it: passages that start as far before each cover the words between without a gap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows: list[tuple] = []
            for text_no, doc_id, text, keys in zip(*(part.column(c).to_pylist()
                                                     for c in ("text_no", "doc_id", "text", "grams"))):
                raw = (text or "").encode()
                places, found = anchors(hashed_words(raw), passage, gram)
                words = list(map(_written, raw.split()))
                firsts = np.flatnonzero(np.diff(places, prepend=-1))
                lasts = np.append(firsts[1:], len(places)) - 1
                held = np.isin(found[firsts], np.array(keys, dtype=np.int64))
                runs: dict[bytes, tuple] = {}
                for first, last in zip(firsts[held].tolist(), lasts[held].tolist()):
                    place = int(places[first])
                    left, right = b"".join(words[first:place]), b"".join(words[place:last + passage])
                    near, far = place - last, place - first
                    context = xxhash.xxh3_128_digest(b"%d %d " % (near, far) + left + right)
                    if context not in runs:
                        runs[context] = (text_no, doc_id, [place], [place], near, far, left, right, context)
                        rows.append(runs[context])
                        continue
                    starts, ends = runs[context][2:4]
                    if place - ends[-1] <= passage:
                        ends[-1] = place
                    else:
                        starts.append(place)
                        ends.append(place)
            if rows:
                yield _record(rows, SUFFIX)

    read = bounded(docs).select(docs["doc_id"].cast("long"), _text_id().alias("text_id"), "text").join(
        wanted, ["doc_id", "text_id"])
    return read.select("text_no", "doc_id", "text", "grams").mapInArrow(run, SUFFIX)


def common_words(one: bytes, other: bytes) -> int:
    """Number of words that two suffixes begin with alike."""
    count = 0
    for a, b in zip(one.split(b" ")[:-1], other.split(b" ")[:-1]):
        if a != b:
            break
        count += 1
    return count


def _compared(contexts: DataFrame, passage: int) -> DataFrame:
    """Contexts in suffix order, each held against its neighbours.

    Gives a row without `passage` for offsets `near` to `far` that this context
    alone has and several texts share, and a row for each offset at which another
    context may have the passage, with the hash of that passage.
    """

    def judge(row: tuple, reach: int) -> Iterator[tuple]:
        context, left, right, near, far, first_id, low, high = row
        shared = max(near, passage - reach)
        if low < high and near < shared:
            yield context, near, min(shared - 1, far), None, first_id, low, high
        if shared <= far:
            words = (left + right).split(b" ")
            for offset in range(shared, far + 1):
                start = far - offset
                digest = xxhash.xxh3_128_digest(b" ".join(words[start:start + passage]))
                yield context, offset, offset, digest, first_id, low, high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The neighbours of the first and the last row may be in other tasks.
        waiting, before, rows = None, passage, []
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if waiting is not None:
                    after = common_words(waiting[2], row[2])
                    rows += judge(waiting, max(before, after))
                    before = after
                waiting = row
                if len(rows) >= 20_000:
                    yield _record(rows, JUDGED)
                    rows = []
        if waiting is not None:
            rows += judge(waiting, passage)
        if rows:
            yield _record(rows, JUDGED)

    ordered = contexts.repartitionByRange("right", "left").sortWithinPartitions("right", "left")
    return ordered.select("context", "left", "right", "near", "far", "first_id", "low", "high").mapInArrow(run, JUDGED)


def matched_starts(docs: DataFrame, passage: int, gram: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Passages that another text has too, the distinct texts, and the rows.

    The first table has `text_no`, `doc_id`, `first_start`, `last_start` and
    `first_id`, the smallest id of a document with the passages that start there:
    those passages cover all words from the first to the end of the last, though
    in a text that repeats itself not each start between them need be one;
    the second has one row per distinct text, `text_no`, `text_id`, `words`,
    `speaker` (smallest id with the text) and `copies`; the third has `doc_id`
    and `text_id` of every row. Passages are those of speakers.
    """
    held = settle(_minimisers(docs, passage, gram), "minimisers")
    same = held.groupBy("text_id").agg(F.min("doc_id").alias("speaker"), F.count(F.lit(1)).alias("copies"),
                                       F.max("words").alias("words")).filter("speaker IS NOT NULL")
    same = settle(same.withColumn("text_no", F.monotonically_increasing_id()), "copies")
    spoken = same.select("text_id", F.col("speaker").alias("doc_id"), "text_no")
    posted = settle(held.join(spoken, ["doc_id", "text_id"]).select(
        "doc_id", "text_id", "text_no", F.explode("grams").alias("gram")), "posted")
    shared = posted.groupBy("gram").agg(
        F.min("text_no").alias("_low"), F.max("text_no").alias("_high"), F.count(F.lit(1)).alias("_rows"))
    shared = shared.filter("_low < _high").select("gram", "_rows")
    wanted = join_uneven(posted, shared, ["gram"], "_rows").groupBy("doc_id", "text_id", "text_no").agg(
        F.collect_set("gram").alias("grams"))
    suffixes = settle(_suffixes(docs, wanted, passage, gram), "suffixes")
    contexts = settle(suffixes.groupBy("context", "left", "right", "near", "far").agg(
        F.min("doc_id").alias("first_id"), F.min("text_no").alias("low"), F.max("text_no").alias("high")), "contexts")
    judged = settle(_compared(contexts, passage), "compared")
    extended = judged.filter("passage IS NOT NULL").select("context", "near", "far", "passage")
    matched = judged.filter("passage IS NOT NULL").groupBy("passage").agg(
        F.min("first_id").alias("first_id"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.count(F.lit(1)).alias("_contexts")).filter("low < high").drop("low", "high")
    spans = judged.filter("passage IS NULL").select("context", "near", "far", "first_id").union(
        join_uneven(extended, matched, ["passage"], "_contexts").select("context", "near", "far", "first_id"))
    # One row per context, so that a context of many texts can be told and split.
    spans = spans.groupBy("context").agg(F.collect_list(F.struct("near", "far", "first_id")).alias("spans"))
    weights = suffixes.groupBy("context").agg(F.count(F.lit(1)).alias("_members"))
    members = join_uneven(suffixes.select("text_no", "doc_id", "firsts", "lasts", "context"), spans.join(weights, "context"),
                          ["context"], "_members")
    found = members.select("text_no", "doc_id", F.arrays_zip("firsts", "lasts").alias("_runs"), F.inline("spans")).select(
        "text_no", "doc_id", "near", "far", "first_id", F.inline("_runs")).select(
        "text_no", "doc_id", (F.col("firsts") - F.col("far")).alias("first_start"),
        (F.col("lasts") - F.col("near")).alias("last_start"), "first_id")
    return settle(found, "matches"), same, held.select("doc_id", "text_id")


def repeated_passages(docs: DataFrame, *, passage: int = 50, gram: int = 20) -> DataFrame:
    """Passages of at least `passage` words that other documents have too.

    Returns one row per maximal run of words that such passages cover:
    `doc_id`, `start_word` (from 0), `end_word` (exclusive), `n_words` and
    `first_id`, the smallest id of a document that has a passage of the run.
    A text that another document repeats whole is one run. Null and shorter
    texts have none, nor have rows with a null id; words that a document
    repeats only in itself are no match. Rows that repeat an id with one text
    count as copies; with different texts each is a document of its own. An
    empty table gives no rows.
    """
    found, same, rows = matched_starts(docs, passage, gram)
    order = Window.partitionBy("text_no").orderBy("first_start", "last_start")
    # Spans of a text that repeats itself may overlap.
    reached = F.max("last_start").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (F.col("first_start") > F.coalesce(reached + passage, F.lit(-1))).cast("int")
    runs = found.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order)).groupBy("text_no", "_run").agg(
        F.min("first_start").alias("start_word"), (F.max("last_start") + passage).alias("end_word"),
        F.min("first_id").alias("first_id"))
    single = same.filter("copies = 1").join(runs, "text_no").select(
        F.col("speaker").alias("doc_id"), "start_word", "end_word", "first_id")
    # A copied text is one run, whatever else its passages match.
    earliest = runs.groupBy("text_no").agg(F.min("first_id").alias("_first"))
    copied = same.filter((F.col("copies") > 1) & (F.col("words") >= passage)).join(earliest, "text_no", "left").select(
        "text_id", "copies", F.lit(0).cast("long").alias("start_word"), F.col("words").alias("end_word"),
        F.least("speaker", F.coalesce("_first", "speaker")).alias("first_id"))
    whole = join_uneven(rows.filter("doc_id IS NOT NULL"), copied, ["text_id"], "copies").select(
        "doc_id", "start_word", "end_word", "first_id")
    return single.union(whole).select(
        "doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first_id")


@F.pandas_udf(T.StringType())
def _without(texts: pd.Series, firsts: pd.Series, lasts: pd.Series, lengths: pd.Series) -> pd.Series:
    """Texts without the words of passages that start in the spans, and without the white space after each."""
    out = []
    for text, first, last, length in zip(texts, firsts, lasts, lengths):
        if first is None or text is None:
            out.append(text)
            continue
        raw = text.encode()
        words = [m.start() for m in WORD_BYTES.finditer(raw)]
        covered = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(covered, np.asarray(first, dtype=np.int64), 1)
        np.add.at(covered, np.minimum(np.asarray(last, dtype=np.int64) + length, len(words)), -1)
        cut = np.cumsum(covered)[:-1] > 0
        edges = [*words, len(raw)]
        kept = [raw[:words[0]]] + [raw[edges[i]:edges[i + 1]] for i in np.flatnonzero(~cut)]
        out.append(b"".join(kept).decode())
    return pd.Series(out, dtype=object)


def without_repeats(docs: DataFrame, *, passage: int = 50, gram: int = 20) -> DataFrame:
    """Keep each repeated passage in the document with the smallest id alone.

    Returns the columns of `docs`. Words that a passage covers which a document
    with a smaller id has too are cut out, `n_chars` is counted anew, and a
    document that loses all its words goes, like a later copy of a whole text.
    Rows with one id lose nothing on account of each other. Other rows stay as
    they are, and their texts aren't shuffled as long as the ids of those that
    change are few enough to be broadcast.
    """
    found, same, rows = matched_starts(docs, passage, gram)
    starts, ends, own = fresh(docs, "_starts"), fresh(docs, "_ends"), fresh(docs, "_own_text")
    later = found.filter("first_id < doc_id").groupBy("text_no", "doc_id").agg(
        F.collect_list(F.struct("first_start", "last_start")).alias("_spans"))
    later = settle(later.join(same.select("text_no", "text_id"), "text_no").select(
        F.col("doc_id").alias("_changed_id"), F.col("text_id").alias("_changed_text"),
        F.col("_spans.first_start").alias(starts), F.col("_spans.last_start").alias(ends)), "later")
    copied = same.filter((F.col("copies") > 1) & (F.col("words") >= passage)).select("text_id", "speaker", "copies")
    gone = join_uneven(rows.filter("doc_id IS NOT NULL"), copied, ["text_id"], "copies").filter("doc_id > speaker")
    gone = settle(gone.select(F.col("doc_id").alias("_gone_id"), F.col("text_id").alias("_gone_text")).distinct(), "gone")
    tagged = docs.withColumn(own, _text_id())

    def keyed(side: DataFrame, name: str) -> Column:
        return (tagged["doc_id"].cast("long") == side[f"_{name}_id"]) & (tagged[own] == side[f"_{name}_text"])

    rest = tagged.join(gone, keyed(gone, "gone"), "left_anti")
    unchanged = rest.join(later.select("_changed_id", "_changed_text"), keyed(later, "changed"), "left_anti")
    cut = bounded(rest.join(later, keyed(later, "changed"))).select(
        *[tagged[c] for c in docs.columns], later[starts], later[ends]).withColumn(
            "text", _without("text", starts, ends, F.lit(passage))).filter(F.col("text").rlike(WORD))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return unchanged.select(*docs.columns).union(cut.select(*docs.columns))
