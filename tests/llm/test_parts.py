"""Parts of the operators against simple versions of themselves."""

import collections
import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import byte_bpe, decontaminate, gray_index, language, media, pages, secrets, simhash, substring_dedup, token_store, toxicity


@pytest.fixture(scope="module")
def encoding():
    return byte_bpe.Encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(encoding):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoding.replay.ranks, special_tokens={})


def test_merge_replay_as_tiktoken(encoding, reference):
    draw = random.Random(1)
    parts = [*"abc the THE's 't \n\t\x1c\x85\xa0   .,!é漢字😀1²Ⅷ", "  ", " the", " I'm", "aaaaaaa", "<|endoftext|>"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 40))) for _ in range(5_000)]
    texts += ["".join(chr(draw.randint(1, 0x24F)) for _ in range(draw.randint(0, 30))) for _ in range(2_000)] + ["a" * 5_000, " ".join(["ab"] * 5_000), "\n".join([" "] * 99)]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoding.encode(texts)]
    assert got == [reference.encode_ordinary(t) for t in texts]
    assert [encoding.decode(g) for g in got] == [t.encode() for t in texts]


def test_replay_and_queue_agree(encoding):
    draw = random.Random(2)
    words = [bytes(draw.choice(b"the anditon '1.") for _ in range(draw.randint(1, 40))) for _ in range(3_000)]
    assert encoding.replay.encode_words(words) == [encoding.replay.ranks[w].to_bytes(4, "little") if w in encoding.replay.ranks else encoding.replay.one_word(w) for w in words]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 255), st.integers(0, 70_000), st.integers(0, 2**32 - 1)), max_size=2_000))
def test_codes_round_trip(ids):
    ids = np.array(ids, np.uint32)
    codes = token_store.Codes(token_store.encode_codes(ids))
    assert codes.size == len(ids) and (codes.slice(0, len(ids)) == ids).all()
    if len(ids):
        at = np.random.default_rng(0).integers(0, len(ids), 50)
        assert (codes.get(at) == ids[at]).all()
        a, b = sorted(np.random.default_rng(1).integers(0, len(ids) + 1, 2).tolist())
        assert (codes.slice(a, b) == ids[a:b]).all()


def test_files_start_where_the_ones_before_end(spark):
    docs = spark.createDataFrame([(i, f"word {i} " * (i % 7)) for i in range(300)], "doc_id long, text string")
    path = token_store.fresh_path(spark, "test")
    token_store.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), path, file_tokens=64)
    assert spark.read.parquet(path).count() > 20
    rows = sorted(token_store.read_tokens(spark, path).collect(), key=lambda r: r.doc_id)
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    every = [i for r in rows for i in r.ids]
    at = random.Random(0).sample(range(len(every)), 40)
    assert {r.place: r.id for r in token_store.read_places(spark, path, at).collect()} == {p: every[p] for p in at}
    assert not token_store.read_places(spark, path, [len(every)]).collect()


def test_a_slice_reads_the_directory():
    """A document's ids come from its own codes: what stands before in the file may be garbage."""
    ids = np.random.default_rng(0).integers(0, 60_000, 5_000).astype(np.uint32)
    codes = token_store.Codes(token_store.encode_codes(ids))
    chunk = codes.levels[0][0].copy()
    chunk[:3_000] = 7
    codes.levels[0] = (chunk, *codes.levels[0][1:])
    assert (codes.slice(3_000, 3_500) == ids[3_000:3_500]).all()
    for at in (0, 1, 511, 512, 513, 4_999):
        assert codes.rank_one(0, at) == (ids[:at] > 255).sum()


def test_decoders():
    draw = np.random.default_rng(0)
    for shape in ((1, 1), (5, 3), (37, 64), (4, 7, 3)):
        image = draw.integers(0, 256, shape).astype(np.uint8)
        assert (media.decode(media.encode_bmp(image)) == image).all()
        if image.ndim == 2:
            assert (media.decode(media.encode_pgm(image)) == image).all()
    assert media.decode(b"P1\n# note\n3 2\n1 0 1\n0 1 0\n").tolist() == [[0, 1, 0], [1, 0, 1]]
    assert media.decode(b"P2 2 1 255\n7 9\n").tolist() == [[7, 9]]
    assert media.decode(b"P3\n1 1\n255\n1 2 3\n").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P4\n10 1\n\xa5\x40").tolist() == [[0, 1, 0, 1, 1, 0, 1, 0, 1, 0]]
    assert media.decode(b"P5\n2 1\n65535\n\x01\x00\x00\x02").tolist() == [[256, 2]]
    assert media.decode(b"P6\n1 1\n255\nabc").tolist() == [[[97, 98, 99]]]
    for bad in (b"P5\n2 2\n255\nabc", b"P5\n0 2\n255\n", b"GIF89a", b"BM"):
        with pytest.raises(ValueError):
            media.decode(bad)


@pytest.mark.parametrize("shape", [(1, 64), (8, 9), (13, 64), (200, 64), (3, 5)])
def test_area_resize(shape):
    image = np.random.default_rng(0).integers(0, 256, shape).astype(float)
    fine = np.kron(image, np.ones((8, 9)))  # each pixel as 8 x 9, so that areas are whole
    want = fine.reshape(8, shape[0], 9, shape[1]).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(image, 8, 9), want)


def test_gray_index_loses_no_link():
    draw = np.random.default_rng(0)
    base, values = draw.integers(0, 2**63, 200, dtype=np.uint64), []
    for b in base.tolist():
        values.append(b)
        for _ in range(draw.integers(0, 40)):
            x = b
            for k in draw.integers(0, 64, draw.integers(1, 6)):
                x ^= 1 << int(k)
            values.append(x)
            b = x if draw.random() < 0.3 else b
    values = np.unique(np.array(values, np.uint64))
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    brute = gray_index.Forest(len(values))
    brute.join(*np.nonzero(near))
    order = np.argsort(gray_index.gray_rank(values))
    got = gray_index.GrayIndex(np.zeros(len(values), int), values[order]).joined(4).roots(np.arange(len(values)))
    groups = lambda labels: {frozenset(np.flatnonzero(labels == x).tolist()) for x in set(labels.tolist())}
    assert {frozenset(order[list(g)].tolist()) for g in groups(got)} == groups(brute.roots(np.arange(len(values))))


def test_gray_index_prunes_groups():
    """Most pairs of a bucket as large as production allows are never looked at one by one."""
    draw = np.random.default_rng(0)
    mask = np.uint64(simhash.tables_of(5, 4)[0])
    values = np.unique(draw.integers(0, 2**63, simhash.BUCKET, dtype=np.uint64) & ~mask)
    values = values[np.argsort(gray_index.gray_rank(values))]
    index = gray_index.GrayIndex(np.zeros(len(values), int), values)
    index.joined(4)
    assert len(index.levels) >= 6 and index.compared < 0.12 * len(values) * (len(values) - 1) / 2


def test_few_tables_until_buckets_are_full():
    assert [simhash.blocks_for(n, 4) for n in (0, 10**6, 10**7, 10**9, 10**10)] == [5, 5, 5, 6, 7]


def test_gray_rank_is_the_inverse_of_the_code():
    rank = np.arange(1000, dtype=np.uint64)
    assert (gray_index.gray_rank(rank ^ (rank >> np.uint64(1))) == rank).all()


@pytest.mark.parametrize("blocks", [5, 6, 7, 8])
def test_tables_cover_all_pairs(blocks):
    draw = random.Random(0)
    masks = simhash.tables_of(blocks, 4)
    for _ in range(300):
        differ = sum(1 << b for b in draw.sample(range(64), draw.randint(0, 4)))
        assert any(not differ & m for m in masks)


def test_components_of_a_long_path(spark):
    n = 200
    edges = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(1000, 1001), (5, 5)], "src long, dst long")
    got = {r.node: r.label for r in simhash.components(edges).collect()}
    assert {i: got.get(i, i) for i in range(n + 1)} == dict.fromkeys(range(n + 1), 0) and got[1001] == 1000


def test_least_of():
    values = np.random.default_rng(0).integers(0, 99, 50).astype(np.uint64)
    for width in (1, 2, 3, 7, 15, 50):
        assert substring_dedup.least_of(values, width).tolist() == [values[i : i + width].min() for i in range(51 - width)]


def test_regions_cover_each_window_once():
    words = [b"w%d" % random.Random(i).randint(0, 20) for i in range(400)]
    _, _, first, count = substring_dedup.regions(substring_dedup.Words(words))
    assert [x for f, c in zip(first.tolist(), count.tolist()) for x in range(f, f + c)] == list(range(381))


def brute_parse(snippets, window):
    """Snippets (words; in the order of the text): the greedy parse of each against all that starts before, by comparing words."""
    out = []
    for i, own in enumerate(snippets):
        p = 0
        while p <= len(own) - window:
            best = 0
            for j in range(i + 1):
                for q in range(len(snippets[j]) - window + 1 if j < i else p):
                    n = 0
                    while p + n < len(own) and q + n < len(snippets[j]) and own[p + n] == snippets[j][q + n]:
                        n += 1
                    best = max(best, n)
            if best >= window:
                out.append((i, p, best))
            p += best - window + 1 if best >= window else 1
    return out


@pytest.mark.parametrize("window", [4, 20])
def test_factors_of_a_block_against_a_brute_parse(window):
    draw = random.Random(window)
    pool = [[draw.randint(0, 9) for _ in range(window + 14)] for _ in range(4)]
    snippets = []
    for _ in range(60):
        x = list(draw.choice(pool))[draw.randint(0, 6) :]
        for _ in range(draw.randint(0, 2)):
            x[draw.randint(0, len(x) - 1)] = draw.randint(0, 99)
        snippets.append(x[: draw.randint(window, len(x))] if len(x) > window else x + [1] * window)
    n = np.arange(len(snippets))
    hashes = [substring_dedup.Words([b"%d" % w for w in x]).h.tobytes() for x in snippets]
    who, at, size, source = substring_dedup.parsed(hashes, n // 3, (n % 3) * 1000 << 32, window)
    assert sorted(zip(who.tolist(), at.tolist(), size.tolist())) == brute_parse(snippets, window)
    count = np.array([len(x) - window + 1 for x in snippets])
    base = np.cumsum(count) - count
    for i, p, k, s in zip(who.tolist(), at.tolist(), size.tolist(), source.tolist()):
        j = int(np.searchsorted(base, s, side="right")) - 1
        q = s - int(base[j])
        assert (j, q) < (i, p) and snippets[j][q : q + k] == snippets[i][p : p + k]


def test_crowded_blocks(spark):
    """The same result whether blocks are parsed by longest match or window by window."""
    from tests.llm.test_queries import brute_removed, sha

    draw = random.Random(9)
    phrase = [f"p{i}" for i in range(25)]
    texts = [" ".join([f"x{draw.randint(0, 30)}" for _ in range(30)] + phrase[draw.randint(0, 4) :] + [f"x{draw.randint(0, 30)}" for _ in range(30)]) for _ in range(80)]
    docs = dict(enumerate(texts))
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    for most in (1, 8, 4096):
        got = {r.doc_id: (r.n_words, sum(b - a for a, b in r.spans), sha(r.kept)) for r in substring_dedup.dedup(frame, most_snippets=most).collect()}
        assert got == brute_removed(docs)


def test_phrases_in_many_surroundings(spark):
    """One short phrase in ever other words, in tasks that spread it and in tasks that don't."""
    from tests.llm.test_queries import brute_removed, sha

    draw = random.Random(3)
    phrase = [f"p{i}" for i in range(8)]
    texts = [" ".join(w for _ in range(draw.randint(1, 40)) for w in phrase + [f"x{draw.randint(0, 60)}" for _ in range(draw.randint(4, 9))]) for _ in range(60)]
    texts += [texts[3], texts[5] + " end", "start " + texts[7]]
    docs = dict(enumerate(texts))
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for parts in (1, 7, 63):
        got = {r.doc_id: (r.n_words, sum(b - a for a, b in r.spans), sha(r.kept)) for r in substring_dedup.dedup(frame.repartition(parts)).collect()}
        assert got == brute_removed(docs)


def test_automaton_offsets():
    text = "Ä, The quick-brown FOX! jumps; over the lazy dog's back now".encode()
    words = decontaminate.words_of(text)
    one = decontaminate.Automaton([("i", b"quick brown fox")])
    hits = one.scan(words)
    assert [(a, b) for a, b, _ in hits] == [(2, 5)]
    ((a, b),) = decontaminate.byte_spans(text, [[2, 5]])
    assert text[a:b] == b"quick-brown FOX"


def test_ownership_separates_examples(spark):
    live, example = "Zx9Qw7Lk2Mn4Vb8Rt5", "Ab1Cd2Ef3Gh4Ij5Kl6"
    docs = [(i, f"see {example} here", f"org{i}/r") for i in range(8)] + [(20, f"use {live} now", "me/a"), (21, f"and {live}", "me/b"), (22, "bare Hq7Zp2Lx9Wm4Tk8Rb3 here", "x/y"), *[(30 + i, "password=Hq7Zp2Lx9Wm4Tk8Rb3", f"o{i}/r") for i in range(6)]]
    rows = {r.doc_id: [secrets.KINDS[f.kind] for f in r.found] for r in secrets.secrets(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert all(not rows[i] for i in range(8)) and rows[20] == rows[21] == ["owned"] and rows[22] == ["owned"] and rows[30] == ["assign"]


def test_replaced():
    text = "a bcd efg h"
    assert secrets.replaced(text, [(2, 5, False), (4, 9, True), (10, 11, False)], "[S]", "[E]") == "a [S] [E]"
    assert secrets.replaced(text, [], "[S]", "[E]") == text


def test_base_rules_consume_dropped_matches():
    assert secrets.candidates("password = token: abcdefgh") == []
    kinds = [c[:3] for c in secrets.candidates("API_KEY='abcdef' x" + "ab" * 12)]
    assert kinds == [(0, 0, 15), (2, 18, 42)]


def test_templates_are_told_by_their_host(spark):
    frame = lambda i, host: f"<body><div><div><span>Best of {host}</span> <b>Daily</b></div><div>Story number {i} about {i * 7}</div></div></body>"
    rows = [(i, f"http://{h}/{i}", frame(i, h)) for h in ("a.example", "b.example") for i in range(6)] + [(99, "http://c.example/1", frame(1, "c.example"))]
    got = {r.url: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got["http://a.example/3"] == "Story number 3 about 21"
    assert got["http://c.example/1"] == "Best of c.example Daily\nStory number 1 about 7"


def test_copies_of_an_article_stay(spark):
    page = "<body><nav>Menu</nav><article><h1>T</h1><div><p>Same everywhere.</p></div><div class='notice'>We use cookies</div></article><footer>f</footer></body>"
    got = {r.text for r in pages.extract(spark.createDataFrame([(i, f"http://a/{i}", page) for i in range(9)], "page_id long, url string, html string")).collect()}
    assert got == {"T\nSame everywhere."}


def page_texts(spark, htmls):
    frame = spark.createDataFrame([(i, f"http://a/{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in pages.extract(frame).collect()}


def test_copies_of_a_page_without_an_article_stay(spark):
    frame = lambda body: f"<body><div class='top'><b>Daily</b> news</div><h1>{body}</h1><div>Text of {body}</div></body>"
    got = page_texts(spark, [frame("One")] * 5 + [frame(f"Other {i}") for i in range(6)])
    assert got[0] == got[4] == "One\nText of One" and got[7] == "Other 2\nText of Other 2"


def test_copied_lists_and_tables_stay(spark):
    frame = lambda title, body: f"<body><article><h1>{title}</h1>{body}</article></body>"
    copied = frame("Copy", "<ul><li>a</li><li>b</li></ul><table><tr><td>1</td><td>2</td></tr></table>")
    got = page_texts(spark, [copied] * 5 + [frame(f"T{i}", f"<ul><li>Yes</li><li>n{i}</li></ul><table><tr><td>1</td><td>{i}</td></tr></table><div>No</div><div class='box'>Read on</div>") for i in range(6)])
    assert got[0] == got[4] == "Copy\na\nb\n1\n2"
    assert got[8] == "T3\nYes\nn3\n1\n3\nNo"


def test_cells_of_pages_without_an_article_stay(spark):
    got = page_texts(spark, [f"<body><ul><li><a href='/'>Home</a></li><li><a href='/x'>X</a></li></ul><table><tr><td>1</td><td>Yes</td></tr><tr><td>n{i}</td></tr></table></body>" for i in range(6)])
    assert got[3] == "1\nYes\nn3"


MARKUP = [
    ("<p>a&nbsp;&amp; b&#228;<p>c", "a & bä\nc"),
    ("<article><p>x<script>var a='</p>';</script>y</article>", "x y"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>1<td>2</table>", "a\nb\n1\n2"),
    ("<main><p>in</p></main><p>out", "in"),
    ("<article><header><h1>T</h1></header><p>b</p><section id=comments><article class=comment><p>no</p></article></section></article>", "T\nb"),
    ("<article><p>a</p><form><p>f</p></form><aside>s</aside><div class='ad-slot'>x</div><div class='address'>y</div></article>", "a\ny"),
    ('<article><h1>T</h1><div class="popular-science"><p>Body.</p></div><p>Two.</p></article>', "T\nBody.\nTwo."),
    ('<article><section class="ad-hoc"><p>a</p></section><section id="search-methods"><h2>b</h2></section><div class="tags-intro"><p>c</p></div></article>', "a\nb\nc"),
    ('<article><div class="popular"><p>a</p></div><div class="tags">x y</div><p class="notice">b</p><div class="popular-science">c</div></article>', "a\nb\nc"),
    ('<article><p>a</p><div class="comment-section"><p>no</p></div><div id="related_posts"><h3>no</h3></div><p class="advert">no</p><p class="commentary">b</p></article>', "a\nb"),
    ('<div class="ad-hoc"><p>a</p></div><div class="site-footer"><p>no</p></div><div class="main-menu">no</div><div id="comment-12"><p>no</p></div>', "a"),
    ("<!-- <p>no --><p>yes<!-- open", "yes"),
    ("<p>1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ("<TITLE>t</TITLE><BODY><P>Up</P></BODY>", "Up"),
    ("</p></div><p>x</b>y", "xy"),
    ("<article><p>a <a href='/?class=ad&hidden=1'>b</a> <span data-hidden=1 data-class='ad'>c</span><i hidden>d</i></p></article>", "a b c"),
]


@pytest.mark.parametrize(("html", "text"), MARKUP)
def test_markup(html, text):
    assert pages.main_text(html) == text


def plain_site(n, host="http://s.example"):
    """Pages without telling tags or names: bars of links, a box and a closing line around paragraphs that differ."""
    draw = random.Random(n)
    words = lambda k: " ".join(draw.choice("lor em ips um dol or sit am et con sec tet ur".split()) + str(draw.randint(0, 99)) for _ in range(k))
    out = []
    for i in range(n):
        body = "\n".join(words(draw.randint(20, 40)) for _ in range(draw.randint(2, 5)))
        paragraphs = "".join(f"<p>{x}</p>" for x in body.split("\n"))
        links = "".join(f"<a href='/{words(1)}'>{words(1)}</a> " for _ in range(draw.randint(3, 6)))
        out.append((i, f"{host}/{i}", f"<body><div class=x1>{links}</div><div class=x2>Fine words since 1990</div><div class=x3>{paragraphs}</div><div class=x4>Imprint and contact</div></body>", body))
    return out


def test_the_template_decides_what_is_text(spark):
    """Link bars that differ and boxes that don't go by their host's counts alone; without them most pages keep them."""
    site = plain_site(12)
    frame = spark.createDataFrame([x[:3] for x in site], "page_id long, url string, html string")
    with_template = {r.page_id: r for r in pages.extract(frame).collect()}
    assert {i: r.text for i, r in with_template.items()} == {i: body for i, _, _, body in site}
    assert all(r.n_template == 3 and r.n_ruled == 0 for r in with_template.values())
    without = {r.page_id: r.text for r in pages.extract(frame, min_pages=1 << 30).collect()}
    assert all(without[i] != body and body in without[i] for i, _, _, body in site)


def test_template_without_rules_on_the_sample(spark):
    """On hosts of many pages the template alone, without tags, roles and names, finds the text of most pages."""
    sample = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("page_id < 600")
    wanted = {r.page_id: r for r in pages.extract(sample).collect()}
    alone = {r.page_id: r for r in pages.extract(sample, rules=False).collect()}
    nothing = {r.page_id: r for r in pages.extract(sample, rules=False, min_pages=1 << 30).collect()}
    assert all(nothing[i].text != wanted[i].text for i in wanted)
    host = lambda u: u.split("/")[2]
    size = collections.Counter(host(r.url) for r in wanted.values())
    many = [i for i, r in wanted.items() if size[host(r.url)] >= 12]
    assert len(many) > 100 and sum(alone[i].text == wanted[i].text for i in many) > 0.9 * len(many)
    assert sum(wanted[i].n_template > 0 for i in many) > 0.95 * len(many)


def test_five_equal_pages_keep_their_text(spark):
    html = "<body><div>One box</div><p>Some text</p><div><p>More text</p></div></body>"
    for urls in (["http://a/1"] * 5, [f"http://a/{i}" for i in range(5)]):
        frame = spark.createDataFrame([(1 if len(set(urls)) == 1 else i, u, html) for i, u in enumerate(urls)], "page_id long, url string, html string")
        assert {(r.text, r.n_template) for r in pages.extract(frame).collect()} == {("One box\nSome text\nMore text", 0)}


def test_mirrors_that_differ_a_little_keep_their_text(spark):
    """Near copies of one page on a host of other pages."""
    body = "".join(f"<p>Paragraph {i} of the mirrored page, long enough to matter.</p>" for i in range(4))
    got = page_texts(spark, [f"<body><div class=t>Top</div>{body}<p>seen {i}</p></body>" for i in range(5)] + [f"<body><div class=t>Top</div><p>Own words {i}</p></body>" for i in range(12)])
    assert all(got[i].count("mirrored") == 4 for i in range(5)) and got[9] == "Own words 4"


@pytest.mark.parametrize("html", ["<a " * 8_000, "<div>" * 8_000 + "</b>" * 8_000, "<div>" * 8_000 + "<li>x" * 8_000, '<a ">"' * 8_000, "<p><button>" + "<div>" * 8_000, "<!-" * 8_000, "<a b='" * 8_001, "<td>" * 8_000 + "<tr>" * 8_000, "<ul>" * 4_000 + "</ul>" * 9_000])
def test_broken_markup_takes_linear_time(html):
    def took(text):
        start = time.perf_counter()
        pages.main_text(text)
        return time.perf_counter() - start

    pages.main_text(html)
    short, long = min(took(html) for _ in range(3)), min(took(html * 4) for _ in range(2))
    assert long < 12 * short + 0.05 and short < 0.5


def test_factorization_machine_learns_pairs():
    """Each term alone says nothing, two together decide."""
    draw = random.Random(0)
    rows, labels = [], []
    for _ in range(3_000):
        a, b = draw.random() < 0.5, draw.random() < 0.5
        rows.append(np.array(sorted([1] * a + [2] * b + [100 + draw.randint(0, 9)])))
        labels.append(int(a == b))
    machine = toxicity.fit(rows, np.array(labels), weight=1.0, epochs=30)
    said = [machine.score(r) > 0.5 for r in rows]
    assert sum(x == y for x, y in zip(said, labels)) / len(rows) > 0.95


def test_ranked_counts():
    assert language.ranked("aab").tolist()[0] == ord("a") and not len(language.ranked("12 !"))
    assert len(language.ranked("abcdefghij " * 90, 10)) == 10


def test_bpe_holds_few_texts_at_once():
    class Own:
        sizes = []

        def encode(self, texts):
            self.sizes.append(len(texts))
            return [t.encode() for t in texts]

    own, texts = Own(), [f"t{i}" for i in range(2 * byte_bpe.ROWS_OUT + 5)]
    out = list(byte_bpe.encoded(own, pa.array(texts)))
    assert own.sizes == [byte_bpe.ROWS_OUT, byte_bpe.ROWS_OUT, 5]
    assert [(a + i, t) for a, part in out for i, t in enumerate(part)] == [(i, t.encode()) for i, t in enumerate(texts)]
