"""Page text, licence rules and token files."""

import random
import textwrap
import zlib
from collections import Counter

import numpy as np
import plain
import public_tokenizers
import pytest
import tables
from tokenizers import Tokenizer

from tickloom.llm import html_text, license_scan, token_store

PATH = public_tokenizers.path("byte_bpe_50k.json")


# --- page text

LONG = "long paragraph " * 8


@pytest.mark.parametrize("html, want", [
    (None, ""), ("", ""), ("   ", ""), ("a &amp; b&nbsp;&nbsp; c", "a & b c"), ("<p>one<br>two</p>", "one two"),
    (f"<nav><ul><li>Home</li></ul></nav><div class='ad'>Buy</div><article><h1>T</h1><p>{LONG}</p><p>x</p></article><footer>f</footer>", f"T\n{LONG.strip()}\nx"),
    (f"<div>Top line</div><nav>menu</nav><p>{LONG}</p><p>short</p><p>{LONG}</p><aside>side</aside><div>tail</div>", f"{LONG.strip()}\nshort\n{LONG.strip()}"),
    (f"<ul><li><a href=a>A</a></li><li><a href=b>B</a></li><li><a href=c>C</a></li><li><a href=d>D</a></li></ul><p>{LONG}</p>", None),
    ("<script>if (a < b) { '</p>' }</script><style>p{}</style><p>body</p><form><input>name<button>go</button></form>", "body"),
    ("<article><header><h1>Head</h1></header><p>Body &lt;b&gt;</p><div id='comments'><article class='comment'>no</article></div></article>", "Head\nBody <b>"),
    ("<div class='page-header'>Site</div><div class='cookie-notice'>We use</div><p>Text of the page</p><section class='comments'>me too</section>", "Text of the page"),
    ("<div class='with sidebar'><p>only text</p></div>", "only text"),
    ("<nav><ul><li>never closed<article><p>Main</p></article>", "Main"),
    ("<p>un<b>closed <i>inline<p>next</p>", "unclosed inline\nnext"),
])
def test_page(html, want):
    got = html_text.main_text(html)
    assert got == want if want is not None else got.endswith(LONG.strip())


def test_long_page():
    body = "".join(f"<p>paragraph {i} of many</p>" for i in range(20_000))
    assert html_text.main_text(f"<article>{body}</article>").count("\n") == 19_999


def test_pages_query(spark, tmp_path):
    rows = [(1, "u", "<p>a b</p>"), (1, "u", "<p>a b</p>"), (None, None, None), (3, "u", "")]
    folder = tables.write(spark, tmp_path, docs=[], pages=("page_id long, url string, html string, text string, n_chars string", [(*r, "x", "y") for r in rows]))
    got = html_text.op5_line_blocks(spark, folder).collect()
    assert Counter(map(tuple, got)) == Counter([(1, "u", "a b", 3), (1, "u", "a b", 3), (None, None, "", 0), (3, "u", "", 0)])
    empty = tables.write(spark, tmp_path / "e", docs=[], pages=("page_id long, url string, html string", []))
    assert html_text.op5_line_blocks(spark, empty).count() == 0


def test_given_pages_keep_article_only(spark):
    for r in html_text.op5_line_blocks(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html"), "page_id").collect():
        assert r.text and "&copy;" not in r.text and "<" not in r.text and r.n_chars == len(r.text)
        assert r.text.count("\n") + 1 <= r.html.count("<p>") + 1


# --- licences

def test_licences(spark, tmp_path):
    s = license_scan.SENTENCES
    mit = "/*\n * The MIT License (MIT)\n *\n * Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files (the \"Software\"), to deal\n" \
          " * in the Software without restriction, including without limitation the rights\n * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n * copies of the Software, and to permit persons to whom the Software is\n" \
          " * furnished to do so, subject to the following conditions:\n *\n * The above copyright notice and this permission notice shall be included in all\n * copies or substantial portions of the Software.\n */\nint main() {}"
    cases = [
        (1, "Released under the MIT License.\nMore text.", "MitReleased", "MIT"), (2, "text\nAll rights reserved.\nLicensed under CC BY-NC 4.0.", "AllRights,CcByNc4", "CC-BY-NC-4.0,All-Rights-Reserved"),
        (3, "LICENSED under the apache license,   Version 2.0", "ApacheLicensedUnder", "Apache-2.0"), (4, mit, "MitTitle,MitGrant,MitCondition", "MIT"), (5, None, "", ""), (6, "", "", ""),
        (7, f"{s['MitCondition']}. {s['MitGrant']}.", "MitCondition,MitGrant", ""), (8, "Not licensed under the MIT license. ok", "", ""),
        (9, "word " * 50_000 + ". Released under the MIT License.", "MitReleased", "MIT"), (9, "Released under the MIT License", "MitReleased", "MIT"),
    ]
    folder = tables.write(spark, tmp_path, docs=[(d, t, "en", "s", 1) for d, t, *_ in cases])
    got = Counter((r.doc_id, r.sentence_ids, r.licences) for r in license_scan.op6_sentence_rules(spark, folder).collect())
    assert got == Counter((d, i, l) for d, _, i, l in cases)
    assert license_scan.op6_sentence_rules(spark, tables.write(spark, tmp_path / "e", docs=[])).count() == 0


def found(spark, path, *texts):
    folder = tables.write(spark, path, docs=[(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    return [(r.sentence_ids, r.licences) for r in license_scan.op6_sentence_rules(spark, folder).orderBy("doc_id").collect()]


def wrap(text):
    return "".join(f" * {x}\n" for x in textwrap.wrap(text, 60))


def test_both_readings_count(spark, tmp_path):
    s = license_scan.SENTENCES
    cc = "Licensed under CC BY-NC 4.0\nordinary text goes on\n\n"
    mit = wrap(f"{s['MitGrant']}: {s['MitCondition']}. {s['MitAsIs']}.")
    assert found(spark, tmp_path, cc + mit, cc + wrap(s["GplFree"] + "."), mit + "\n" + cc) == [
        ("CcByNc4,MitGrant,MitCondition,MitAsIs", "MIT,CC-BY-NC-4.0"), ("CcByNc4,GplFree", "GPL-3.0-or-later,CC-BY-NC-4.0"), ("MitGrant,MitCondition,MitAsIs,CcByNc4", "MIT,CC-BY-NC-4.0")]


def test_rules_use_identifiers_up(spark, tmp_path):
    s = license_scan.SENTENCES

    def text(*ids):
        return "\n".join(s[i] + "." for i in ids)

    two = ["BsdRedistribution", "BsdSource", "BsdBinary"]
    three = [*two, "BsdEndorse"]
    doubled = [i for i in three for _ in range(2)]
    got = found(spark, tmp_path, text(*three), text(*two), text(*three, *two), text(*two, *three), text(*three, *three), text(*doubled), text("GplFree", *three, "MitReleased"),
                text("MitGrant", "BsdSource", "MitCondition"), text(*["MitReleased"] * 3, "AllRights"))
    assert [x[1] for x in got] == ["BSD-3-Clause", "BSD-2-Clause", "BSD-3-Clause,BSD-2-Clause", "BSD-3-Clause,BSD-2-Clause", "BSD-3-Clause", "BSD-3-Clause", "BSD-3-Clause,GPL-3.0-or-later,MIT",
                                  "MIT", "MIT,All-Rights-Reserved"]


def test_text_on_both_sides_of_an_advert():
    page = '<body><div class="post"><p>' + "Long text here, " * 30 + '</p><div class="ad">Buy now</div><p>A last paragraph of some words here.</p></div></body>'
    assert html_text.main_text(page).split("\n")[1:] == ["A last paragraph of some words here."]


def test_names_are_whole():
    page = '<article><h1>Title</h1><section id="related-work"><p>Prior work.</p></section><div class="long-form"><p>' + "Body " * 60 + '</p></div><div class="share-buttons">Share</div><ul class="post-comments"><li>Nice</li></ul></article>'
    assert html_text.main_text(page).split("\n") == ["Title", "Prior work.", ("Body " * 60).strip()]
    assert all(map(html_text.names_aside, ("ad", "site-nav", "x comment-list", "sidebar_left", "ad-300-250", "ADVERT"))) and not any(map(html_text.names_aside, ("related-work", "long-form", "add", "cookie-recipes", "", "main")))


def test_pages_with_clashing_columns(spark, tmp_path):
    rows = [(1, "u", "<p>" + "Some words. " * 20 + "</p>", "x", "y", 3), (1, "u", "<p>" + "Some words. " * 20 + "</p>", "x", "y", 3), (None, None, None, None, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string, found string, n_chars long").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(html_text.op5_line_blocks(spark, str(tmp_path)).collect(), key=str)
    assert [(r.page_id, r.n_chars) for r in got] == [(1, 239), (1, 239), (None, 0)]


# --- token files

@pytest.mark.parametrize("n, symbols", [(0, 1), (1, 1), (511, 2), (512, 3), (5000, 1), (4097, 300), (20_000, 70_000)])
def test_wavelet(n, symbols):
    r = np.random.default_rng(n)
    ids = (r.integers(0, symbols, n) ** 2 % 100_000).astype("<u4")
    file = token_store.Wavelet(token_store.pack(3, 4, [(7, n)], ids))
    assert (file.part, file.seq) == (3, 4) and (file.ids() == ids).all() and file.ids().dtype == np.dtype("<u4")
    for i in r.integers(0, max(n, 1), 30)[:n]:
        assert file.access(int(i)) == ids[i]
    for token in [*ids[:5].tolist(), 99_999_999]:
        where = np.flatnonzero(ids == token)
        assert file.count(token) == len(where)
        for i in (0, n // 3, n):
            assert file.rank(token, i) == (ids[:i] == token).sum()
        for k in {0, len(where) // 2, len(where) - 1} if len(where) else ():
            assert file.select(token, k) == where[k]
        if len(where) < 200:
            assert file.occurrences(token) == where.tolist()
        with pytest.raises(IndexError):
            file.select(token, len(where))
    with pytest.raises(IndexError):
        file.access(n)


def test_encoder_equals_the_library():
    encoder, library = token_store.Encoder(PATH), Tokenizer.from_file(PATH)
    r = random.Random(4)
    alphabet = "aab  cZéßñ'stlvermd'  0129.,!?*#\n\t\r\x0b\x0c-_&<>|\"(){}" + "²漢🙂\x85\xa0\x1c "
    texts = ["".join(r.choice(alphabet if i % 3 == 0 else alphabet[:-8]) for _ in range(r.randrange(60))) for i in range(3000)]
    texts += [t for _, t, *_ in tables.documents() if t] + ["<|endoftext|>", "", " ", "  a", "a  ", "'S 's 'll don't"]
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_added_tokens_as_the_library():
    encoder, library = token_store.Encoder(PATH), Tokenizer.from_file(PATH)
    texts = ["end of text <|endoftext|> next", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n漢", "<|endoftext|", "plain"]
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
    assert np.frombuffer(encoder.encode(texts[0]), "<u4").tolist() == [437, 286, 2420, 220, 50256, 1306]


@pytest.mark.parametrize("file_tokens", [1, 50, 1 << 22])
def test_round_trip(spark, tmp_path, monkeypatch, file_tokens):
    monkeypatch.setattr(token_store.write_tokens, "__defaults__", (file_tokens,))
    docs = tables.documents()
    got = token_store.op10_wavelet_matrix(spark, tables.write(spark, tmp_path, docs=docs)).orderBy("start").collect()
    library = Tokenizer.from_file(PATH)
    ids = {(d[0], d[1]): [*library.encode(d[1] or "", add_special_tokens=False).ids, 0] for d in docs}
    want = Counter((d[0], len(ids[d[:2]]), zlib.crc32(np.array(ids[d[:2]], "<u4").tobytes())) for d in docs)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens


def test_no_documents_no_files(spark, tmp_path):
    assert token_store.op10_wavelet_matrix(spark, tables.write(spark, tmp_path, docs=[])).count() == 0


def test_plain_crc():
    assert plain.crc(None) == 0
