"""Text operators against brute force, exact round trips and odd rows."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from blocktrace.llm import (addresses, audio, fertility, languages, mixing, near_dups, packing, pages, passages,
                            quality)
from blocktrace.llm.vocabularies import byte_vocabulary, default_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string"


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, shared passages, junk, and rows with nulls; two columns clash with results."""
    draw = random.Random(4)
    words = ["".join(draw.choices("abcdefgh", k=5)) for _ in range(400)]
    text = [" ".join(draw.choices(words, k=draw.randint(30, 160))) for _ in range(40)]
    shared = " ".join(draw.choices(words, k=60))
    text += [text[0], text[0], text[1] + " end", text[2].replace(" ", "  ", 3), f"{text[3]}\n{shared}", f"{shared} {text[4]}"]
    for i in range(6):
        changed = text[5].split()
        changed[7 * i] = "other"
        text.append(" ".join(changed))
    text += [None, "", "  \n", "one", "one two", "x " * 3000, "<|endoftext|> é\n\n\n  three   spaces"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 3}", None, "s", "c")
            for i, t in enumerate(text)]
    rows.append((None, "no id here at all", None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA).cache()


def texts_of(corpus):
    return {r.doc_id: r.text or "" for r in corpus.collect() if r.doc_id is not None}


def test_near_duplicates_match_brute_force(corpus):
    found = texts_of(corpus)
    sets = {}
    for i, t in found.items():
        w = t.lower().encode().split()
        sets[i] = set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if j < i and both and 100 * both >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    rows = {r.doc_id: r for r in near_dups.near_duplicates(corpus, words=2).collect()}
    assert {i: rows[i].component_id for i in sets} == {i: root(i) for i in sets}
    assert all(rows[i].n_shingles == len(sets[i]) and rows[i].kept == (root(i) == i) for i in sets)
    assert rows[None].component_id is None and rows[None].kept


def test_passages_match_brute_force(corpus):
    found = {i: t.encode().split() for i, t in texts_of(corpus).items()}
    holders = defaultdict(set)
    for i, w in found.items():
        for s in range(len(w) - 49):
            holders[tuple(w[s:s + 50])].add(i)
    want = {(i, s + k) for i, w in found.items() for s in range(len(w) - 49)
            if len(holders[tuple(w[s:s + 50])]) > 1 for k in range(50)}
    rows = passages.repeated_passages(corpus).collect()
    assert {(r.doc_id, k) for r in rows for k in range(r.start_word, r.end_word)} == want
    left = {r.doc_id: (r.text or "").encode().split() for r in passages.without_repeats(corpus).collect()}
    for i, w in found.items():
        cut = {s + k for s in range(len(w) - 49) if min(holders[tuple(w[s:s + 50])]) < i for k in range(50)}
        kept = [x for k, x in enumerate(w) if k not in cut]
        assert left.get(i, []) == kept


def test_packing_is_exact(corpus):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rows = packing.pack(corpus).collect()
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append(r)
    for i, t in texts_of(corpus).items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for held in places.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 1024 or at & (at - 1) == 0 and at < 1024


def test_packer_balances_levels():
    packer = packing.Packer(16, 0)
    for i in range(200):
        packer.document(i, bytes(4 * (1 + i % 11)))
    assert (packer.counts == [len(packer.open.get(h, [])) for h in range(17)]).all()
    packer.close()
    assert sum(r[2] for r in packer.rows) == sum(1 + i % 11 for i in range(200))


def test_mix_reaches_targets(corpus):
    rows = mixing.mix_sources(corpus).collect()
    total = sum(r["size"] for r in rows)
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
        assert 0 <= r.taken <= 2 * r["size"]
    for held in by_source.values():
        assert abs(sum(r.taken for r in held) - held[0].target) <= 1
        assert held[0].target <= 2 * sum(r["size"] for r in held) == 2 * held[0].source_size
    assert abs(sum(held[0].target for held in by_source.values()) - 1.5 * total) < 1e-6
    taken = {r.doc_id: r.taken for r in rows if r.doc_id is not None}
    words = Counter()
    for r in mixing.mixed_documents(corpus).collect():
        words[r.doc_id] += len((r.text or "").encode().split())
    assert {i: n for i, n in taken.items() if n} == {i: n for i, n in words.items() if i is not None}


def test_audio_round_trip(corpus):
    for r in audio.audio_features(corpus).collect():
        assert r.frames_failed == 0 and r.payload_bytes % 576 == 0 and r.payload_bytes > 0
    data = audio.payload("é" * 3000)
    stored = audio.encode(data)
    assert audio.decode(stored).data == data
    # Junk between frames costs no frame; a broken frame only itself.
    whole = audio.decode(stored)
    cut = whole.offsets[2]
    noisy = audio.decode(stored[:cut] + b"\xff\xfa\x00junk" + stored[cut:])
    assert len(noisy.offsets) == len(whole.offsets) and noisy.skipped == 7
    assert audio.decode(b"").samples == 0 and audio.crc16(b"123456789") == 0xAEE7


def test_fertility_counts_match_brute_force(corpus):
    for r in fertility.fertility_rules(corpus).collect():
        if r.doc_id is None:
            continue
        text = texts_of(corpus)[r.doc_id]
        w = text.encode().split()
        windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        again = {i + k for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        assert (r.n_words, r.n_repeat_words) == (len(w), len(again))
        assert r.word_chars == sum(len(x.decode()) for x in w) and r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w)) and not (r.base_failed and r.kept)


def test_rules_and_templates(spark):
    urls = [None, "no scheme", "HTTP://A.Example.ORG/es/1?x", "http://b.com/fr/2#a", "http://b.com", "http://xorg/fr/"]
    urls += [f"http://h.com/{lang}/{i}" for lang in ("de", "fr", "it") for i in range(30)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {r.page_id: r for r in addresses.judge_urls(df).collect()}
    assert (rows[0].host, rows[0].path, rows[1].host) == ("", "", "")
    assert (rows[2].host, rows[2].rule, rows[2].verdict) == ("a.example.org", "example.org/es/", "block")
    assert rows[3].rule == "com/fr/" and rows[3].path == "/fr/2" and rows[4].path == "" and rows[5].rule is None
    assert rows[6].verdict == "block" and rows[40].verdict == "allow" and len(rows) == len(urls)
    assert rows[6].template != rows[40].template


def test_quality_separates_lines():
    good = "Plain words stand here in a row, and they end well.\nAnother line of words follows here."
    bad = "WORD!! WORD!! WORD!! WORD!!\nword### word$$$ word*** word&&&\nagain again again again again again"
    chains = quality.Chains.of([quality.line_features(t) for t in [good, bad, "", good, bad] * 20])
    labels = np.array([1, 0, 1, 1, 0] * 20)
    scores = quality.fit(chains, labels).score(chains)
    assert scores[0] > 0.5 > scores[1] and ((0 <= scores) & (scores <= 1)).all()


def test_chain_marginals_match_enumeration():
    from itertools import product

    scores, step = np.array([0.3, -1.0, 2.0]), np.array([[0.5, -0.2], [-0.4, 0.9]])
    weights = {y: np.exp(sum(s * v for s, v in zip(scores, y)) + sum(step[a, b] for a, b in zip(y, y[1:])))
               for y in product((0, 1), repeat=3)}
    total = sum(weights.values())
    got, _ = quality.marginals(scores, np.array([3]), step)
    assert np.allclose(got, [sum(w for y, w in weights.items() if y[i]) / total for i in range(3)])


def test_languages_and_blocks():
    samples = [("the cat and the dog went out " * 4, "en"), ("der hund und die katze gingen aus " * 4, "de")] * 5
    network = languages.fit(samples, ["de", "en"])
    assert list(languages.probabilities([t for t, _ in samples[:2]], network).argmax(axis=1)) == [1, 0]
    page = "<p>a &amp; b<br>c<p>d<script>x</p></script><!-- no --><ul><li><a href=x>e"
    assert [text for _, text, _ in pages.blocks(page)] == ["a & b c", "d", "e"]
    assert pages.blocks("") == []


def test_block_network_gradient():
    network = pages.BlockNetwork()
    network.parts = [a.astype(np.float64) for a in network.parts]
    draw = np.random.default_rng(1)
    rows, sizes, target = draw.random((5, pages.INPUTS)), np.array([2, 3]), np.array([0, 1, 1, 0, 1.0])
    slope = network.gradients(rows, sizes, target)[1][0, 0, 0]
    u, losses = network.parts[1], []
    for move in (1e-3, -1e-3):
        u[0, 0, 0] += move
        p, _ = network.run(rows, sizes)
        losses.append(-np.mean(target * np.log(p) + (1 - target) * np.log(1 - p)))
        u[0, 0, 0] -= move
    assert abs(slope - (losses[0] - losses[1]) / 2e-3) < 1e-3


def test_empty_tables(spark, corpus):
    empty = corpus.limit(0)
    assert near_dups.near_duplicates(empty).count() == 0 and passages.repeated_passages(empty).count() == 0
    assert packing.pack(empty).count() == 0 and mixing.mix_sources(empty).count() == 0
    assert fertility.fertility_rules(empty).count() == 0 and languages.detect_languages(empty).count() == 0
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert addresses.judge_urls(none).count() == 0 and pages.extract_text(none).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score_quality(empty, labels).count() == 0
    assert quality.score_quality(corpus, labels).count() == corpus.count()


def test_unclosed_tags_take_no_long_search():
    assert pages.blocks("<p>a</p>" + "<div " * 400 + "x" * 50_000)[0][1] == "a"
    assert pages.blocks("<p title='>' id=\"b>\">a<br/>b</p>")[0][1] == "a b"
