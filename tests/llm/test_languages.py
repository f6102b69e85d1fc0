"""What the language network learns from, and its gradients against differences."""

from __future__ import annotations

import random
import zlib

import numpy as np

from blocktrace.llm import languages
from blocktrace.llm.recurrent import ByteNetwork

SCHEMA = "doc_id long, text string, lang string, _order string, _turn string, held_out string"


def frame(spark, rows):
    return spark.createDataFrame([(*row, "x", "x", "x") for row in rows], SCHEMA)


def texts(draw, letters, count):
    return [" ".join("".join(draw.choices(letters, k=5)) for _ in range(30)) for _ in range(count)]


def test_rare_languages_are_learned_and_texts_stay_in_the_tasks(spark):
    draw = random.Random(3)
    kinds = {"aa": ("abcde", 400), "bb": ("klmno", 30), "cc": ("uvwxy", 4)}
    rows = [(text, lang) for lang, (letters, count) in kinds.items() for text in texts(draw, letters, count)]
    rows = [(i, text, lang) for i, (text, lang) in enumerate(rows)]
    rows += [(0, rows[0][1], "aa")] * 50 + [(900, "", "dd"), (901, None, "ee"), (902, "word " * 40_000, None), (None, "abc", "ff")]
    df = frame(spark, rows)
    found = languages.training_windows(df, 12, 3)
    assert {lang for _, lang in found} == {"aa", "bb", "cc"} and max(len(raw) for raw, _ in found) <= languages.WINDOW
    assert len(found) <= 12 * 3 and found == languages.training_windows(df.repartition(7), 12, 3)
    assert all(any(raw in text.encode() for _, text, _ in rows if text) for raw, _ in found)
    held = {i for i, _, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 3 == 1}
    assert not any(raw in text.encode() for raw, _ in found for i, text, lang in rows if i in held and text)
    result = languages.detect_languages(df, documents=60).collect()
    assert len(result) == len(rows) and all(0 <= r.score <= 1 for r in result)
    by_id = {r.doc_id: r for r in result}
    assert [by_id[i].lang_pred for i, _, lang in rows[:434] if i in held] == [lang for i, _, lang in rows[:434] if i in held]
    assert by_id[900].lang_pred == by_id[901].lang_pred == "und" and by_id[902].lang_pred in kinds
    assert {r.doc_id for r in result if r.held_out} == held


def test_gradients_equal_differences():
    """The loss of two short windows, one of them cut, moved by one weight at a time."""
    draw = np.random.default_rng(1)
    network = ByteNetwork.new(3, 2, 4)
    data = draw.integers(97, 101, size=(2, 6)).astype(np.uint8)
    mask, target = np.ones((2, 6), dtype=bool), np.array([0, 1])
    mask[1, 4:] = False

    def loss():
        logs = network.log_probabilities(data).astype(np.float64)
        weight = mask.T / mask.sum()
        return -sum(weight[t, i] * logs[target[i], t, i] for t in range(6) for i in range(2))

    slopes = [np.array(g, dtype=np.float64) for g in network.gradients(data, mask, target)]
    shown = 0
    for part, slope in zip(network.parts, slopes):
        for place in sorted(zip(*np.nonzero(np.abs(slope) > 1e-3)))[:4]:
            old, step = part[place], 1e-2
            part[place] = old + step
            up = loss()
            part[place] = old - step
            down = loss()
            part[place] = old
            assert abs((up - down) / (2 * step) - slope[place]) < 0.1 * abs(slope[place]) + 1e-3
            shown += 1
    assert shown > 4
