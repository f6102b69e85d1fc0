"""Quality rules from the fertility of a public vocabulary.

A text's words are encoded with a vocabulary that falls back to bytes. Three
figures describe how well it fits: characters of words per token, the share of
byte tokens, and the entropy of the tokens as a share of the largest possible
one. Each is held against a band of its language (or script, where the language
is unknown) and length class, taken from the quartiles over all distinct texts.
Short texts scatter more, so they have bands of their own. A text with too few
others in its band is held against two, then four neighbouring length classes of
its language, then all its lengths, its script in all languages, and the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocktrace.llm.common import hashed_words, settle, slices, texts
from blocktrace.llm.passages import gram_hashes
from blocktrace.llm.vocabularies import default_path, piece_vocabulary

#: First code points of script blocks and their names; a block ends where the next begins.
SCRIPTS = ((0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"),
           (0x0600, "arabic"), (0x0700, "other"), (0x0900, "indic"), (0x0E00, "other"), (0x3040, "japanese"),
           (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"))
FIGURES = ("chars_per_token", "fallback_share", "token_entropy")
#: A band reaches this many quartile distances beyond the quartiles, and at least so far.
REACH = 3.0
LEAST = {"chars_per_token": 0.25, "fallback_share": 0.1, "token_entropy": 0.15}
#: Other distinct texts that a band must hold to judge a text; the band of the whole corpus judges with any number.
LEAST_OTHERS = 20
MEASURES = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            "n_tokens long, chars_per_token double, fallback_share double, token_entropy double, script string, words_hash binary")


def script(text: str) -> str:
    """Script of most of the letters; `none` without letters."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else "none"
    points = np.frombuffer("".join(filter(str.isalpha, text)).encode("utf-32-le"), dtype="<u4")
    if not len(points):
        return "none"
    block = np.searchsorted([first for first, _ in SCRIPTS], points, side="right") - 1
    counts: dict[str, int] = {}
    for i, n in zip(*np.unique(block, return_counts=True)):
        name = SCRIPTS[max(i, 0)][1]
        counts[name] = counts.get(name, 0) + int(n)
    return max(counts, key=lambda name: (counts[name], name))


def repeated_words(hashes: np.ndarray, width: int = 5) -> int:
    """Words in windows of `width` words that the text has at least twice."""
    grams = gram_hashes(hashes, width)
    if len(grams) < 2:
        return 0
    _, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
    edges = np.zeros(len(hashes) + 1, dtype=np.int64)
    twice = np.flatnonzero(counts[inverse] > 1)
    edges[twice] += 1
    edges[twice + width] -= 1
    return int((np.cumsum(edges) > 0).sum())


def measures(text: str, vocabulary, is_byte: np.ndarray) -> tuple:
    """All figures of a text, in the order of ``MEASURES`` after the id."""
    import xxhash

    raw = text.encode()
    words = raw.split()
    joined = b" ".join(words).decode()
    chars = len(joined) - max(len(words) - 1, 0)
    seen, again = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            again += line in seen
            seen.add(line)
    ids = np.array(vocabulary.encode(joined, num_threads=1), dtype=np.int64)
    tokens = len(ids)
    counts = np.bincount(ids)
    counts = counts[counts > 0]
    most = np.log2(min(tokens, len(is_byte))) if tokens > 1 else 1.0
    # The largest minus the sum keeps equal texts at equal values, whatever the order of tokens.
    entropy = (np.log2(tokens) - (counts * np.log2(counts)).sum() / tokens) / most if tokens > 1 else 0.0
    return (len(words), chars, sum(map(text.count, "#*$%&|<>")), again, repeated_words(hashed_words(raw)), tokens,
            chars / tokens if tokens else 0.0, float(is_byte[ids].mean()) if tokens else 0.0, float(entropy), script(text),
            xxhash.xxh3_128_digest(joined.encode()))


def _by_length(own: Column) -> list[Column]:
    """Names of the bands of a language or script for one, two and four length classes."""
    first = F.col("length_class")
    return [F.concat(own, F.lit("/"), first.cast("string")), *[
        F.concat(own, F.lit("/"), (first - first % n).cast("string"), F.lit("-"), (first - first % n + n - 1).cast("string"))
        for n in (2, 4)]]


def fertility_rules(docs: DataFrame, *, path: str | None = None, least_others: int = LEAST_OTHERS) -> DataFrame:
    """Base rules and fertility bands for every document.

    Returns one row per row of `docs`: `doc_id`, `n_words`, `word_chars`,
    `n_symbols`, `n_dup_lines`, `n_repeat_words`, `base_failed`, `kept`, the
    three figures and the `band` they were held against. Null text has no
    words, so it fails the base rules. Texts without tokens are in no band.
    Quartiles are taken over distinct texts, apart from white space. The band
    is the first with `least_others` other texts of: language (or script) and
    length class, two classes, four classes; language; script; corpus. The
    corpus judges with any number.
    Extra columns don't matter; equal rows get equal values; an empty table
    gives no rows.
    """
    path = path or default_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = piece_vocabulary(path)
        is_byte = np.array([vocabulary.is_byte(i) for i in range(vocabulary.get_piece_size())])
        for part in slices(batches):
            rows = [measures(text, vocabulary, is_byte) for text in texts(part)]
            names = [field.split()[0] for field in MEASURES.split(", ")]
            yield pa.record_batch([part.column("doc_id"), *map(pa.array, zip(*rows)), part.column("lang")],
                                  names=[*names, "lang"])

    measured = docs.select(docs["doc_id"].cast("long"), "text", docs["lang"].cast("string")).mapInArrow(
        run, f"{MEASURES}, lang string")
    own = F.coalesce(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("script:"), "script"))
    length_class = F.floor(F.log2("n_tokens")).cast("int")
    measured = settle(measured.withColumn("own", F.when(F.col("n_tokens") > 0, own)).withColumn(
        "length_class", F.when(F.col("n_tokens") > 0, length_class)), "fertility")
    # Copies count once, in each language that they are given.
    distinct = measured.filter("own IS NOT NULL").groupBy("words_hash").agg(
        F.collect_set("own").alias("owns"), *[F.max(name).alias(name) for name in ("script", "length_class", *FIGURES)])
    of_script, corpus = F.concat(F.lit("script:"), "script"), F.lit("all")
    quartiles = distinct.select(*FIGURES, F.explode(F.array_distinct(F.concat(
        F.flatten(F.transform("owns", lambda own: F.array(*_by_length(own), own))),
        F.array(of_script, corpus)))).alias("band")).groupBy("band").agg(F.count("*").alias("_texts"), *[
            F.percentile_approx(name, [0.25, 0.5, 0.75], 10000).alias(f"_{name}") for name in FIGURES])
    keys = ["own", "script", "length_class"]
    ladder = measured.filter("own IS NOT NULL").select(*keys).distinct().select(*keys, F.posexplode(F.array(
        *_by_length(F.col("own")), F.col("own"), of_script, corpus)).alias("_step", "band"))
    held = F.struct("band", *[f"_{name}" for name in FIGURES])
    chosen = ladder.join(quartiles, "band").filter((F.col("_texts") > least_others) | (F.col("band") == corpus)).groupBy(
        *keys).agg(F.min_by(held, "_step").alias("_held")).select(*keys, "_held.*")
    inside = F.lit(True)
    for name in FIGURES:
        low, middle, high = (F.col(f"_{name}")[i] for i in range(3))
        least = F.lit(LEAST[name]) * (middle if name == "chars_per_token" else 1)
        reach = F.greatest(REACH * (high - low), least)
        inside = inside & F.col(name).between(low - reach, high + reach)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measured.join(chosen, keys, "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~base & F.coalesce(inside, F.lit(False))).alias("kept"), *FIGURES, "band")
