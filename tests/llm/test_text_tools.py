"""BPE, token counts, page text and licence scans against libraries and brute force."""
import hashlib
import random
import struct
import textwrap

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cargolens.llm import bpe, licences, pagetext, wordpiece
from helpers import LONG, awkward, documents

WORD_BPE, RANKS = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def library():
    t = Tokenizer.from_file(WORD_BPE)
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_the_library(spark):
    t = library()
    odd = ["<|endoftext|>x<|startoftext|>", "<|endof", "it's I'LL we're '", "ΑΣ ΟΔΟΣ Σ", "İstanbul ﬁ Ǻ e\u0301", "a\x1cb\x1dc", "a\u00a0b\u2003c\x85d", "1234 ½ ²", "😀👍🏽 日本語", "!!!???...,,,", "\x00\x01", "x" * 3000]
    rows = awkward() + [(300 + i, s, "o") for i, s in enumerate(odd)]
    docs = documents(spark, rows)
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(docs, WORD_BPE, digests=True).collect()), key=str)
    want = []
    for i, text, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    whole = bpe.encode(docs, WORD_BPE)
    assert all(list(r.ids) == t.encode(dict((i, x) for i, x, _ in rows)[r.doc_id] or "", add_special_tokens=False).ids for r in whole.where("doc_id is not null").collect())
    back = bpe.decode(whole.drop("decoded"), WORD_BPE).withColumnRenamed("decoded", "again")
    assert sorted(r.again for r in back.collect()) == sorted(r.decoded for r in whole.collect())


def test_bpe_random_texts():
    t, v, rng = library(), bpe.Vocabulary(open(WORD_BPE, encoding="utf-8").read()), random.Random(1)
    pool = [chr(c) for c in range(0x20, 0x7F)] + list("éèßüñÉİıΣσς \u00a0\x85\t\n\r\x1f가日²½😀’") + ["<|endoftext|>", "'s", "the", "tion"]
    for _ in range(3000):
        s = "".join(rng.choice(pool) for _ in range(rng.randint(0, 20)))
        ids = t.encode(s, add_special_tokens=False).ids
        assert v.encode(s) == ids and v.decode(ids) == t.decode(ids, skip_special_tokens=False), s


def greedy(initial, inner, word):
    at = n = 0
    while at < len(word):
        end = next((j for j in range(len(word), at, -1) if word[at:j] in (inner if at else initial)), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def test_automaton_equals_greedy_cutting():
    rng = random.Random(3)
    for _ in range(800):
        make = lambda m: {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(m)}
        initial, inner = make(rng.randint(0, 6)), make(rng.randint(1, 6))
        counter = wordpiece.PieceCounter(initial, inner)
        for _ in range(20):
            w = "".join(rng.choice("aaabbbcccd") for _ in range(rng.randint(0, 12)))
            assert counter.count(w) == greedy(initial, inner, w), (initial, inner, w)


def test_token_counts(spark):
    import base64
    pieces = [base64.b64decode(x.split()[0]) for x in open(RANKS, "rb") if x.strip()]
    every = {bytes([b]) for b in range(256)}
    initial, inner = every | {p[1:] for p in pieces if p.startswith(b" ")}, every | {p for p in pieces if not p.startswith(b" ")}
    rows = awkward()
    got = sorted(((r.doc_id, r.n_words, r.n_tokens) for r in wordpiece.token_counts(documents(spark, rows), RANKS).collect()), key=str)
    words = lambda t: (t or "").encode().split()
    assert got == sorted(((i, len(words(t)), sum(greedy(initial, inner, w) for w in words(t))) for i, t, _ in rows), key=str)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=/a>A</a></ul></nav>
<div id="cookie-notice">We use cookies on this site, please accept them now.</div><!-- <p>comment</p> --><article><h1>Title &amp; more</h1><p>First   paragraph with <b>bold<br>text and a
<a href=y>link</a> in it, long enough.<p>Second &lt;one&gt; &#233;&nbsp;end.</p><script>var x = "<p>no</p>";</script><div class="ad">Buy now</div><ul><li>item one<li>item two</ul>
<form><input value="x"><button>Send</button></form></article><section id="comments"><p>A reader says that this is a really great article, thanks for it.</p></section>
<aside>Related things</aside><footer>&copy; Site</footer></body></html>"""


def test_page_text(spark):
    want = "Title & more\n\nFirst paragraph with bold text and a link in it, long enough.\n\nSecond <one> é end.\n\nitem one\n\nitem two"
    bare = PAGE.replace("<article>", '<div class="x1">').replace("</article>", "</div>")
    rows = [(1, "u", PAGE), (2, "u", bare), (3, None, None), (4, "u", ""), (5, "u", "just text"), (6, "u", "<p>open <b>tags"), (7, "u", "<div>" * 2000 + "deep"), (None, "u", "<p>" + LONG),
            (8, "u", '<a href="x>broken</a><p>z'), (1, "u", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(1))
    out = [(r.page_id, r.text, r.n_chars) for r in pagetext.page_texts(df).collect()]
    text = {i: t for i, t, _ in out}
    assert len(out) == len(rows) and all(n == len(t) for _, t, n in out)
    assert text[1] == want and text[2] == want and text[3] == text[4] == "" and text[5] == "just text" and text[6] == "open tags" and text[7] == "deep" and text[None] == LONG
    assert pagetext.page_texts(df.limit(0)).count() == 0


def sentences(n, word="stone"):
    return " ".join(f"The {word} number {i} lies in the quiet river." for i in range(n))


def test_page_text_in_wrappers():
    head = "<html><body><nav><ul><li><a href=/a>Alpha</a><li><a href=/b>Bravo</a></ul></nav>"
    body = f"<h1>Title</h1><p>{sentences(12)}</p><p>{sentences(9, 'tree')}</p><div class='ad'>Buy now</div><div class='sidebar'><p>Read this too, it is new.</p></div>"
    want = f"Title\n\n{sentences(12)}\n\n{sentences(9, 'tree')}"
    for open_, close in (("<form id=f method=post>", "</form>"), ("<div class='page sidebar-right'>", "</div>"), ("<div class='overflow-hidden'>", "</div>"), ("<div class='elementor-widget'>", "</div>"),
                         ("<form><div class=overflow-hidden>", "</div></form>"), ("<article><div class='overflow-hidden'>", "</div></article>"), ("<span class=widget>", "</span>")):
        control = "<input name=q><select><option>One</select><button>Send</button>" if "form" in open_ else ""
        assert pagetext.main_text(head + open_ + body + control + close + "<footer>Site</footer></body></html>") == want, open_
    widgets = "".join(f"<div class='elementor-widget'><p>{sentences(5, w)}</p></div>" for w in ("stone", "tree", "cloud", "light"))
    assert pagetext.main_text(f"{head}<div>{widgets}</div></body></html>") == "\n\n".join(sentences(5, w) for w in ("stone", "tree", "cloud", "light"))
    comments = "".join(f"<div class=comment><p>{sentences(4, 'word')}</p></div>" for _ in range(20))
    assert pagetext.main_text(f"{head}<div>{body}</div><section id=comments>{comments}</section></body></html>") == want


def test_page_text_of_several_sections():
    blocks = ["<section>" + f"<p>{sentences(6)}</p>" * 10 + "</section>", f"<section><p>{sentences(18, 'tree')}</p></section>", f"<blockquote>{sentences(16, 'light')}</blockquote>",
              f"<section><ul>{''.join(f'<li>{sentences(3, w)}</li>' for w in ('iron', 'gold', 'lead', 'zinc'))}</ul></section>", f"<pre>{sentences(14, 'code')}</pre>",
              f"<div><table><tr><td>{sentences(6, 'left')}</td><td>{sentences(6, 'right')}</td></tr></table></div>"]
    page = "<html><body><div id=a><h1>Title</h1>" + "".join(blocks) + "<ul><li><a href=/a>Other page of links</a><li><a href=/b>One more page</a></ul></div><footer>Site</footer></body></html>"
    want = ["Title", *[sentences(6)] * 10, sentences(18, "tree"), sentences(16, "light"), *[sentences(3, w) for w in ("iron", "gold", "lead", "zinc")], sentences(14, "code"), sentences(6, "left"), sentences(6, "right")]
    assert pagetext.main_text(page) == "\n\n".join(want)


def test_licences(spark):
    mit = licences.TEMPLATES["MIT"][3]
    rows = awkward() + [(1, mit, "a"), (2, "Intro words here.\n\n" + mit + "\n\nMore words.", "a"), (3, "Text before. Released under the MIT License.\nNothing else", "a"), (4, mit.replace("software", "program"), "a"),
                        (5, "LICENSED under the apache license   version 2.0", "a"), (6, "The license of the house is not under the tree", "a"), (7, mit[:200], "a")]
    out = [(r.doc_id, r.licence, r.n_matches) for r in licences.licence_scan(documents(spark, rows)).collect()][len(awkward()):]
    assert out == [(1, "MIT", 1), (2, "MIT", 1), (3, "MIT", 1), (4, "MIT", 1), (5, "Apache-2.0", 1), (6, None, 0), (7, None, 0)]
    assert licences.licence_scan(documents(spark, [])).count() == 0


def test_licences_over_several_paragraphs_and_lines():
    t = licences.Templates(licences.TEMPLATES, licences.THRESHOLD)
    names = lambda text: [n for n, _ in licences.scan(text, t)]
    intro = " ".join(f"word{i}" for i in range(300)) + ".\n\n"
    whole = {k: v[-1] for k, v in licences.TEMPLATES.items() if k in ("MIT", "Apache-2.0", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "AGPL-3.0", "BSD-3-Clause", "BSD-2-Clause", "ISC")}
    for name, text in whole.items():
        text = " ".join(text.split())
        cut = text.replace(". ", ".\n\n").replace(": ", ":\n\n")
        wrapped = textwrap.fill(text, 60)
        for form in (text, cut, wrapped, "\n".join("# " + x for x in wrapped.split("\n"))):
            assert names(form) == names(intro + form + "\n\nThe end.") == [name], (name, form[:80])
    assert "THIS SOFTWARE IS PROVIDED BY" in whole["BSD-3-Clause"] and "DISCLAIMS ALL WARRANTIES" in whole["ISC"]
    assert names("A line of other words here. This project is licensed under\nthe terms of the MIT license. And more words follow.") == ["MIT"]
    assert names(intro + "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.") == ["MIT", "Apache-2.0"]
    assert names(intro + whole["BSD-3-Clause"] + "\n\nLicensed under the Apache License, Version 2.0.") == ["BSD-3-Clause", "Apache-2.0"]


def test_size_bounds_prune_no_template():
    rng, t = random.Random(4), licences.Templates(licences.TEMPLATES, licences.THRESHOLD)
    for grams, _ in t.rows:
        for _ in range(10):
            part = {g for g in grams if rng.random() < 0.93} | {("x", str(i)) for i in range(rng.randint(0, 2))}
            every = [(2 * len(part & b) / max(1, len(part) + len(b)), n) for b, n in t.rows]
            top = max(e[0] for e in every)
            got = t.best(part)
            assert (got[1] if got else None) == (top if top >= licences.THRESHOLD and part else None)


def test_licence_choice_equals_plain_rescans():
    """The choice among runs by taking the best and striking what it covers, again and again."""
    t = licences.Templates(licences.TEMPLATES, licences.THRESHOLD)

    def plain(runs, parts):
        out, rest, whole = [], sorted(runs, key=lambda r: r[3]), {p for b in parts for p in zip(b, b[1:])}
        while rest:
            tops = {}
            for r in rest:
                if r[2] not in tops or (r[1], r[4] - r[3]) > (tops[r[2]][1], tops[r[2]][4] - tops[r[2]][3]):
                    tops[r[2]] = r
            _, dice, at, start, end = max(tops.values(), key=lambda r: (r[0], r[1], -r[2], -r[3]))
            out.append((start, t.rows[at][1], dice))
            around = [r for r in rest if r[2] == at and r[3] <= start and end <= r[4] and (r[3], r[4]) in whole]
            low, high = min([start, *(r[3] for r in around)]), max([end, *(r[4] for r in around)])
            rest = [r for r in rest if r[4] <= low or r[3] >= high]
        return [m[1:] for m in sorted(out)]

    rng = random.Random(9)
    for _ in range(200):
        borders = [sorted({0, 60, *(rng.randrange(60) for _ in range(n))}) for n in (3, 9)]
        runs = []
        for _ in range(rng.randrange(40)):
            a, b = sorted(rng.sample(range(61), 2))
            if rng.random() < 0.3:
                i = rng.randrange(len(borders[1]) - 1)
                a, b = borders[1][i:i + 2]
            runs.append((rng.randrange(5), rng.randrange(4) / 4, rng.randrange(3), a, b))
        assert licences._chosen(runs, borders, t) == plain(runs, borders)


def test_licences_of_a_long_text_of_notices():
    """A wrapped notice thousands of times: every run overlaps its neighbours."""
    t, notice = licences.Templates(licences.TEMPLATES, licences.THRESHOLD), licences.TEMPLATES["MIT"][0].replace(" ", "\n", 3)
    import time
    start = time.time()
    assert licences.scan("Foreword of the file.\n" + f"{notice}\n\n" * (400_000 // len(notice)), t) and time.time() - start < 60


PROSE = "The river runs to the sea, and the light of the moon is on the water of the bay. "


def test_anchors_and_styles_of_articles_stay():
    """Ids and classes that journals and generated pages give to parts of an article."""
    parts = ['<section id="discussion"><h2>Discussion</h2><p>{}A1</p></section>', '<h2 id="related-work">Related work A2</h2><p>{}A3</p>', '<h2 id="search">Search A4</h2>',
             '<blockquote class="social-quote">{}A5</blockquote>', '<div class="form-group-text"><p>{}A6</p></div>', '<pre id="notice">{}A7</pre>',
             '<div class="section" id="related"><p>{}A8</p></div>', '<div class="related-work"><p>{}A9</p></div>', '<p id="alert">{}A10</p>']
    furniture = ['<div class="comment-thread"><p>{}B1</p></div>', '<section id="comments"><p>{}B2</p></section>', '<div class="related-posts"><p>{}B3</p></div>',
                 '<div id="cookie-policy-banner"><p>{}B4</p></div>', '<ul class="social-links"><li>{}B5</li></ul>', '<div class="ad-slot-3"><p>{}B6</p></div>', '<div id="sidebar"><p>{}B7</p></div>']
    for outer in ("<article>{}</article>", "<main>{}</main>", "<div>{}</div>"):
        inner = "".join(f"<p>{PROSE * 3}</p>" + p.format(PROSE * 2) for p in parts) + "".join(p.format(PROSE) for p in furniture)
        text = pagetext.main_text("<html><body><nav><a href='/'>Home</a></nav>" + outer.format(inner) + "<footer>Foot</footer></body></html>")
        missing = [k for k in ("A1", "A2", "A3", "A4", "A5", "A6", "A7", "A8", "A9") if k not in text]
        assert not missing and not [k for k in ("B1", "B2", "B3", "B4", "B5", "B6", "B7", "Home", "Foot") if k in text], (outer, missing)
