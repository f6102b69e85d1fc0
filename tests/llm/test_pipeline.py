"""The pipeline, stage by stage, against plain Python on planted copies, passages and bad documents."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np

from blocktrace.llm.vocabularies import default_path


def planted():
    """Rows of id, text, whether it is good."""
    draw = random.Random(6)
    words = ["".join(draw.choices("abcdefghiklmnoprstu", k=draw.randint(2, 8))) for _ in range(600)]

    def prose(n):
        picked = draw.choices(words, k=n)
        return " ".join(w + (".\n" if k % 12 == 11 else "") for k, w in enumerate(picked))

    def changed(text, at):
        parts = text.split(" ")
        parts[at] = "changed"
        return " ".join(parts)

    good = [prose(draw.randint(70, 160)) for _ in range(60)]
    passage = " ".join(draw.choices(words, k=60))
    good += [f"{prose(80)} {passage}", f"{passage} {prose(90)}", good[0], good[1] + " end."]
    # One word in the middle: 40 of 50 shingles of five words (0.8) for 49 words, 39 of 49 for 48.
    for n in (49, 48):
        good.append(prose(n))
        good.append(changed(good[-1], n // 2))
    good.append("<|endoftext|> " + prose(70))
    bad = ["\n".join(" ".join(draw.choices(["WORD!!", "###", "$$$", "again", "again", "|||"], k=5)) for _ in range(12))
           for _ in range(30)]
    rows = [(text, True) for text in good] + [(text, False) for text in bad]
    draw.shuffle(rows)
    return [(i, *row) for i, row in enumerate(rows)]


def test_run_matches_plain_python(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    rows = planted()
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t, _ in rows],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(ok), 0) for i, _, ok in rows if i % 5], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    stages, settle = {}, corpus_pipeline.settle

    def kept(df, label):
        stages[label.removeprefix("pipeline-")] = settle(df, label)
        return stages[label.removeprefix("pipeline-")]

    monkeypatch.setattr(corpus_pipeline, "settle", kept)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert list(stages) == [name for name, _ in corpus_pipeline.STAGES]

    found = {r.doc_id: r.text for r in stages["quality"].collect()}
    assert found == {i: t for i, t, ok in rows if ok}

    sets = {i: set(zip(*(t.lower().split()[k:] for k in range(5)))) for i, t in found.items()}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    found = {i: t for i, t in found.items() if root[i] == i}
    assert len(found) == len(sets) - 3  # the copy, the longer copy, and the one at 0.8
    assert {r.doc_id: r.text for r in stages["near-duplicates"].collect()} == found

    split = {i: t.split() for i, t in found.items()}
    first = {}
    for i in sorted(split):
        for s in range(len(split[i]) - 49):
            first.setdefault(tuple(split[i][s:s + 50]), i)
    cut = {i: {s + k for s in range(len(w) - 49) if first[tuple(w[s:s + 50])] < i for k in range(50)}
           for i, w in split.items()}
    assert sum(map(len, cut.values())) == 60
    texts = {r.doc_id: r.text for r in stages["passages"].collect()}
    assert {i: t.split() for i, t in texts.items()} == {
        i: [x for k, x in enumerate(w) if k not in cut[i]] for i, w in split.items()}

    size = Counter()
    for i, t in texts.items():
        size[i % 3] += len(t.split())
    # Weights 3, 1, 2 share one and a half times all words; a source over twice its words gives the rest to the others.
    budget, target, free = 1.5 * sum(size.values()), {}, {0: 3, 1: 1, 2: 2}
    while over := [s for s in free if budget * free[s] / sum(free.values()) > 2 * size[s]]:
        for s in over:
            target[s] = 2 * size[s]
            budget -= target[s]
            del free[s]
    target |= {s: budget * weight / sum(free.values()) for s, weight in free.items()}
    mixed, by_source, by_id = [(r.doc_id, r.text) for r in stages["mixing"].collect()], Counter(), defaultdict(list)
    for i, t in mixed:
        assert texts[i].startswith(t)
        by_source[i % 3] += len(t.split())
        by_id[i].append(t)
    assert all(abs(by_source[s] - target[s]) <= 1 for s in target)
    assert all(sum(len(t.split()) for t in held) <= 2 * len(texts[i].split()) for i, held in by_id.items())

    assert any("<|endoftext|>" in t for _, t in mixed)
    tokenizer = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    ids = {i: [np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], dtype="<u4") for t in held]
           for i, held in by_id.items()}
    want, got, lengths = Counter(), Counter(), defaultdict(int)
    for r in packed:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start:r.start + r.length].tobytes()) == r.ids_crc32
                   for x in ids[r.doc_id])
        got[r.doc_id] += r.length
        lengths[r.sequence_id] += r.length
    for i, held in ids.items():
        want[i] += sum(map(len, held))
    assert got == want and all(n == 1024 or n & (n - 1) == 0 and n < 1024 for n in lengths.values())


def odd_table(spark, rows):
    """Documents with nulls, repeated ids, and columns named like the stages' own."""
    schema = ("doc_id long, text string, lang string, source string, n_chars long, _id string, _starts string, _words int, "
              "_gone_id long, _plan string, _size int")
    return spark.createDataFrame([(*r, "a", "b", 1, 2, "c", 3) for r in rows], schema)


def test_stages_take_odd_rows(spark, tmp_path):
    draw = random.Random(9)
    words = ["".join(draw.choices("abcdefgh", k=4)) for _ in range(300)]
    texts = [" ".join(draw.choices(words, k=90)) for _ in range(12)]
    shared = " ".join(draw.choices(words, k=70))
    rows = [(i, t, "en", "s" if i % 2 else None, len(t)) for i, t in enumerate(texts)]
    rows += [(20, f"{texts[10]} {shared}", "en", "s", 9), (21, f"{shared} {' '.join(draw.choices(words, k=90))}", None, None, None),
             (22, texts[3], "en", "s", 5), (None, "no id at all", None, None, None), (None, None, None, None, None),
             (23, None, "en", "s", 0), (24, "", None, "", 0), (25, " \n", "en", "s", 2),
             # One id with two texts, and one row twice.
             (30, texts[5] + " more words", "en", "s", 1), (30, " ".join(draw.choices(words, k=80)), "en", "s", 1),
             (31, " ".join(draw.choices(words, k=60)), "en", "s", 1), (32, "z " * 40_000, "en", "s", 1)]
    rows.append(rows[-2])
    docs = odd_table(spark, rows)
    spark.createDataFrame([(i, 1, 0) for i in range(10)] + [(None, 0, 0), (40, None, 0)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = kept.columns
        kept = corpus_pipeline.settle(stage(spark, kept, str(tmp_path)), f"odd-{name}")
        assert kept.columns == before
        ids = [r.doc_id for r in kept.collect()]
        if name == "quality":
            assert len(ids) == len(rows)  # all labels say good
        if name == "near-duplicates":
            assert ids.count(None) == 2 and ids.count(30) in (0, 2) and ids.count(31) == 2 and 22 not in ids and 3 in ids
        if name == "passages":
            found = {r.doc_id: r.text for r in kept.collect()}
            assert shared in found[20] and shared not in found[21] and ids.count(31) in (1, 2) and 23 in found
    packed = corpus_pipeline.STAGES[4][1](spark, kept, str(tmp_path)).collect()
    assert sum(r.length for r in packed) > 0


def test_stages_take_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd_table(spark, []), str(tmp_path))
        assert out.collect() == [], name
    # Documents, but no labels: nothing can be rejected.
    assert corpus_pipeline.good(spark, odd_table(spark, [(1, "some words", None, None, 1)]), str(tmp_path)).count() == 1
