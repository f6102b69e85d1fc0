"""Cases in which operators once did less than the whole job."""

from __future__ import annotations

import random
import zlib

import numpy as np

from blocktrace.llm import audio, catalog, fertility, packing, pages
from blocktrace.llm.vocabularies import default_path, json_vocabulary


def test_packed_ids_are_those_of_tokenizers_by_default(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  \n\n <|endoftext|", " <|endoftext|>\té ",
             "a" + " " * 1_000_000 + "b <|endoftext|> c", "\n 　" * 400_000]
    assert json_vocabulary(default_path("byte_bpe_50k.json"), True).encode(texts[0]) == [64, 220, 50256, 275]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalog.op10_pack(spark, str(tmp_path)).collect()
    for i, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        held = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert sum(r.length for r in held) == len(ids) == held[0].doc_tokens
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in held)
    assert packing.pack(spark.createDataFrame([(0, texts[0])], "doc_id long, text string")).first().doc_tokens == 10


def test_fertility_judges_lone_and_copied_junk(spark):
    draw = random.Random(1)
    words = "the cat and a dog went out in rain while old people were reading long letters near every house".split()
    texts = [(" ".join(draw.choices(words, k=40)), "en") for _ in range(120)]
    junk = " ".join("".join(chr(draw.randrange(0x2800, 0x28FF)) for _ in range(6)) for _ in range(40))
    texts += [(junk.replace(" ", " " * (1 + i % 2)), "en") for i in range(60)]
    texts += [(" ".join("".join(chr(draw.randrange(0x2800, 0x28FF)) for _ in range(6)) for _ in range(20_000)), "en"),
              (junk[::-1], "xx"), (" ".join(draw.choices(words, k=40)), "yy")]
    table = spark.createDataFrame([(i, *row) for i, row in enumerate(texts)], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in fertility.fertility_rules(table).collect()}
    assert len(rows) == len(texts) and all(rows[i].kept for i in range(120))
    # A third of the rows are one junk text; one junk text is alone in its length, one in its language.
    assert not any(rows[i].kept or rows[i].base_failed for i in range(120, 182))
    assert rows[180].band == "lang:en" and rows[181].band.startswith(("script:", "all"))
    assert rows[182].kept and rows[182].band == "script:latin"


def test_fertility_copies_count_once_and_neighbours_come_first(spark):
    draw = random.Random(2)
    words = "rain wind sun snow cloud storm river field stone bridge garden window".split()
    short = [" ".join(draw.choices(words, k=12)) for _ in range(20)]
    table = spark.createDataFrame([(i, t, "en") for i, t in enumerate(short + [short[0]] * 100)],
                                  "doc_id long, text string, lang string")
    bands = {r.band for r in fertility.fertility_rules(table).collect()}
    assert not any(band.startswith("lang:") for band in bands)  # 20 texts, whatever the number of copies
    bands = {r.band for r in fertility.fertility_rules(table, least_others=1).collect()}
    assert all(band.startswith("lang:en/") for band in bands)


def test_unclosed_silent_elements_cost_no_article():
    def found(page):
        return [text for _, text, _ in pages.blocks(page)]

    page = "<html><head><title>T</title><meta x><style>s</style><body><article><p>one<p>two</article>"
    assert found(page) == ["one", "two"] and pages.blocks(page)[0][0] == ("html", "body", "article", "p")
    for tag in ("title", "button", "textarea", "select", "noscript", "svg", "object", "iframe", "script", "style"):
        assert found(f"<p>a</p><div><{tag}>x <b>y</b><p>one</p></div><p>two") == ["a", "one", "two"], tag
        closed = f"<{tag}>z</{tag}>"
        assert found(f"{closed}<p>one{closed}</p>{closed}two<{tag}/>") == ["one", "two"], tag
    # A later element of the name with an end tag doesn't close an earlier one.
    for tag in ("title", "button", "textarea", "svg"):
        assert found(f"<{tag}>x<p>one</p><{tag}>y</{tag}><p>two") == ["one", "two"]
    assert found("<svg>a<svg>b</svg>c</svg><p>one") == ["one"] and found("<p>a<button>b") == ["a", "b"]
    assert found("<script><!-- x</script><p>one") == ["one"] and found("<p>one<script>x") == ["one"]
    assert found("<button>" * 20_000 + "<title>" * 20_000 + "<p>one" + "<script>" * 20_000) == ["one"]
    assert found("<p>one" + "<button>" * 50_000 + "two") == ["one", "two"]


def test_audio_table_is_read_by_its_flags():
    whole = audio.encode(audio.payload("word " * 20_000))
    at = whole.index(b"Xing")
    stream = audio.decode(whole)
    size = len(whole) - (at - audio.DATA)
    assert stream.table == (len(stream.offsets), size) and len(stream.points) == 100 and stream.points_off == 0

    def changed(flags, fields):
        return audio.decode((whole[:at + 4] + flags.to_bytes(4, "big") + fields + bytes(120))[:at + 128] + whole[at + 128:])

    count, points = stream.table[0].to_bytes(4, "big"), stream.points
    assert changed(1, count).table == (stream.table[0], None) and changed(1, count).points == b""
    assert changed(2, size.to_bytes(4, "big")).table == (None, size) and changed(0, b"").table == (None, None)
    only = changed(4, points)
    assert only.table == (None, None) and only.points == points and only.points_off == 0
    assert changed(5, count + bytes(100)).points_off > 50
    assert only.data == stream.data and only.offsets == stream.offsets
