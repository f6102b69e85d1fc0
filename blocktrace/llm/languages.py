"""Language of a text from a bidirectional gated recurrent network over its bytes.

The network (see ``recurrent.py``) reads a whole text in windows of `WINDOW`
bytes. Neighbouring windows overlap by `CONTEXT` bytes on both sides, whose
labels come from the window in which they are further from the edge; so each
byte is labelled once, with context around it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blocktrace.llm.common import bounded, remainder, slices, texts
from blocktrace.llm.recurrent import ByteNetwork, train

#: Labelled documents that the network is fitted on, in turn from each language by a hash of their id, and windows of each.
TRAINING_DOCUMENTS, TRAINING_WINDOWS = 3000, 8
WINDOW, CONTEXT = 160, 16
HIDDEN, STEPS, BATCH = 8, 160, 96
UNKNOWN = "und"


def windows(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Windows over a text, filled with spaces, and a mask of the bytes that each of them labels."""
    step = WINDOW - 2 * CONTEXT
    count = max(1, -(-len(raw) // step))
    data = np.full(CONTEXT + count * step + CONTEXT, 32, dtype=np.uint8)
    data[CONTEXT:CONTEXT + len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    at = np.arange(count)[:, None] * step + np.arange(WINDOW)[None, :]
    inner = (np.arange(WINDOW) >= CONTEXT) & (np.arange(WINDOW) < WINDOW - CONTEXT)
    return data[at], inner[None, :] & (at - CONTEXT < len(raw))


def fit(samples: list[tuple[str | bytes, str]], labels: list[str], seed: int = 7) -> ByteNetwork:
    """Train on windows of (text or its bytes, language) pairs, all languages in equal parts."""
    draw = np.random.default_rng(seed)
    network = ByteNetwork.new(HIDDEN, len(labels), seed)
    found = {label: [raw for text, lang in samples if lang == label
                     and (raw := text if isinstance(text, bytes) else text.encode())] for label in labels}
    usable = [label for label in labels if found[label]]

    def gradients(_: int) -> list[np.ndarray]:
        data, mask, target = [], [], []
        for i in range(BATCH):
            label = usable[i % len(usable)]
            raw = found[label][draw.integers(len(found[label]))]
            start = draw.integers(max(1, len(raw) - WINDOW + 1))
            part = raw[start:start + WINDOW]
            data.append(np.frombuffer(part.ljust(WINDOW), dtype=np.uint8))
            mask.append(np.arange(WINDOW) < len(part))
            target.append(labels.index(label))
        return network.gradients(np.array(data), np.array(mask), np.array(target))

    if len(usable) > 1:
        train(network.parts, gradients, STEPS, 0.03)
    return network


def probabilities(found: list[str], network: ByteNetwork) -> np.ndarray:
    """Pooled label probabilities of each text: the mean log probability over all its bytes, normalised."""
    cut = [windows(text.encode()) for text in found]
    owner = np.repeat(np.arange(len(cut)), [len(data) for data, _ in cut])
    data, mask = (np.concatenate([c[i] for c in cut]) for i in (0, 1))
    labels = len(network.bias)
    sums, counts = np.zeros((len(found), labels)), np.zeros(len(found))
    for low in range(0, len(data), 2048):
        part = slice(low, low + 2048)
        logs = network.log_probabilities(data[part])
        weight = mask[part].T.astype(np.float32)
        np.add.at(sums, owner[part], (logs * weight).sum(axis=1).T)
        np.add.at(counts, owner[part], weight.sum(axis=0))
    # A text of a few bytes is less certain than its bytes: the pooled evidence grows with its length up to 100 bytes.
    pooled = sums / np.maximum(counts, 1)[:, None] * np.minimum(np.maximum(counts, 1), 100)[:, None] / 10
    p = np.exp(pooled - pooled.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def training_windows(docs: DataFrame, documents: int, per_document: int) -> list[tuple[bytes, str]]:
    """Seeded windows of labelled documents outside the held-out third, with their languages.

    Ids are chosen first, from narrow rows: the languages take turns, so that
    each of them is learned, however rare, while there are fewer than
    `documents`. The tasks then cut windows out of the chosen texts, and only
    those reach the driver: at most `documents * per_document * WINDOW` bytes.
    """
    lang = docs["lang"].cast("string").alias("lang")
    known = docs.filter("length(text) > 0 AND lang IS NOT NULL").filter(F.coalesce(remainder("doc_id", 3) != 1, F.lit(False)))
    place = Window.partitionBy("lang").orderBy("_order", "doc_id")
    ids = (known.select(docs["doc_id"], lang, F.xxhash64(docs["doc_id"].cast("string")).alias("_order"))
           .withColumn("_turn", F.dense_rank().over(place)).filter(F.col("_turn") <= documents).distinct()
           .orderBy("_turn", "_order", "doc_id", "lang").limit(documents).select("doc_id", "lang"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts(part)):
                raw = text.encode()
                draw = np.random.default_rng(zlib.crc32(str(doc_id).encode()))
                starts = draw.integers(max(1, len(raw) - WINDOW + 1), size=per_document if len(raw) > WINDOW else 1)
                found.append([raw[start:start + WINDOW] for start in starts])
            yield pa.record_batch([part.column("doc_id"), part.column("lang"), pa.array(found, pa.list_(pa.binary()))],
                                  names=["doc_id", "lang", "windows"])

    # Bounded by `documents`, so it may be sent to every executor.
    chosen = bounded(known.select("doc_id", lang, "text").join(F.broadcast(ids), ["doc_id", "lang"]))
    kind = docs.schema["doc_id"].dataType.simpleString()
    # Rows that repeat an id count once.
    cuts = chosen.mapInArrow(cut, f"doc_id {kind}, lang string, windows array<binary>") \
        .groupBy("doc_id", "lang").agg(F.max("windows").alias("windows"))
    rows = cuts.select("doc_id", "lang", "windows").toArrow().sort_by([("lang", "ascending"), ("doc_id", "ascending")]).to_pydict()
    return [(raw, lang) for lang, found in zip(rows["lang"], rows["windows"]) for raw in found]


def detect_languages(docs: DataFrame, *, documents: int = TRAINING_DOCUMENTS,
                     per_document: int = TRAINING_WINDOWS) -> DataFrame:
    """Language of every document.

    Returns one row per row of `docs`: `doc_id`, `held_out` (crc32 of the id
    modulo 3 is 1; null ids are not), `lang_pred` (`und` for null texts and
    texts without a letter) and `score` (0 for `und`). Learns from
    `per_document` windows of at most `documents` rows with text and language
    outside the held-out third; without any, all texts are `und`. Equal texts
    get equal languages. An empty table gives no rows.
    """
    samples = training_windows(docs, documents, per_document)
    labels = sorted({lang for _, lang in samples})
    network = fit(samples, labels) if labels else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = texts(part)
            lettered = np.array([any(map(str.isalpha, text)) for text in found])
            if network is None:
                best, score = [UNKNOWN] * len(found), np.zeros(len(found))
            else:
                p = probabilities(found, network)
                best = [labels[i] if known else UNKNOWN for i, known in zip(p.argmax(axis=1), lettered)]
                score = np.where(lettered, p.max(axis=1), 0.0)
            yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(best), pa.array(score)],
                                  names=["doc_id", "held_out", "lang_pred", "score"])

    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held_out, "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
