import math
import random

import numpy as np

from sojourn.llm import html_main
from sojourn.llm.html_blocks import blocks, choose

FOOT = "Copyright notice of this wonderful site that everyone sees on each and every page here"


def text(page):
    return "\n\n".join(choose(blocks(page))[0])


def test_article_without_the_rest():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="post">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- <p>no</p> --><div class="cookie-notice">We use</div>
<article><header><h1>Head &amp; tail</h1></header><p><b>One&nbsp; two
 three<br>four.<p>caf&eacute; &#x41;&lt;b&gt;<ul><li>x<li>y</ul><div class="ad">Buy</div><form><p>mail</form>
<aside>see also</aside><p hidden>secret</p><p>last</article><section id="comments"><p>first!</section><footer>f</footer></body></html>"""
    assert text(page) == "Head & tail\n\nOne two three four.\n\ncafé A<b>\n\nx\n\ny\n\nlast"


def test_broken_markup():
    assert text("") == text("<") .replace("<", "") == ""
    assert text("a < b <p>c<a href='x>y'>d</a> <a href=\"tru") == "a < b\n\ncd"
    assert text("<article><p>one</p></footer></nav><p>two") == "one\n\ntwo"
    assert text("<script>never closed <p>x</p>") == ""
    assert text("<main><p>m</p><nav>n</nav></main><p>o") == "m"
    assert text("<div id=content><p>m</div><div>o</div>") == "m"
    assert choose(blocks("<p>plain</p>")) == (["plain"], False)


def test_names_of_a_container_never_discard_it():
    for opening in ('<article class="post category-social">', '<article class="post has-comments">', '<article class="comment">',
                    '<div class="content no-sidebar">', '<div class="content has-header">', '<main class="sidebar-left">'):
        tag = opening[1:].split()[0]
        page = f'<body><div>menu</div>{opening}<p>all of the text<div class="post-comments">first!</div></{tag}><div class="site-footer">f</div></body>'
        assert text(page) == "all of the text", opening
    assert text('<div class="nav-open"><article><p>the story<div class="ad-box">buy</div></article></div><p>c') == "the story"


def test_replies_and_tags_are_no_article():
    page = """<article class="tag-news"><p>the story<ul class="tags"><li>news</ul></article>
<section id="responses"><article class="reply">a very long reply of a reader to it</article></section>"""
    assert text(page) == "the story"


def brute_unique(pages, run, share):
    """Blocks not covered by runs of ``run`` tokens that stand on two distinct pages of the host."""
    distinct = sorted(set(map(tuple, pages)))
    streams = [[(w, k) for k, block in enumerate(p) for w in block.split(" ")] for p in distinct]
    windows = [{tuple(w for w, _ in s[i:i + run]) for i in range(len(s) - run + 1)} for s in streams]
    out = {}
    for p, s, own in zip(distinct, streams, windows):
        others = set().union(*(w for w in windows if w is not own))
        covered = [False] * len(s)
        for i in range(len(s) - run + 1):
            if tuple(w for w, _ in s[i:i + run]) in others:
                covered[i:i + run] = [True] * run
        kept = []
        for k, block in enumerate(p):
            marks = [c for (_, b), c in zip(s, covered) if b == k]
            if sum(marks) / len(marks) < share:
                kept.append(block)
        out[p] = kept or list(p)
    return out


def test_host_windows_equal_brute_force(spark):
    rng = random.Random(4)
    shared = [" ".join(rng.choices("abcdefgh", k=rng.randint(5, 40))) for _ in range(6)]
    pages = []
    for _ in range(60):
        own = [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 30))) for _ in range(rng.randint(1, 4))]
        blocks_of = own + rng.sample(shared, rng.randint(0, 3))
        rng.shuffle(blocks_of)
        pages.append(blocks_of)
    pages += pages[:3]
    hosts = [k % 3 for k in range(len(pages))]
    rows = [(k, f"https://h{h}.example/{k}", "".join(f"<p>{b}</p>" for b in p)) for k, (p, h) in enumerate(zip(pages, hosts))]
    want = {}
    for h in range(3):
        told = brute_unique([p for p, x in zip(pages, hosts) if x == h], html_main.RUN, html_main.COVERED)
        want.update({k: "\n\n".join(told[tuple(p)]) for k, (p, x) in enumerate(zip(pages, hosts)) if x == h})
    got = html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert any(want[k] != "\n\n".join(p) for k, p in enumerate(pages))


NOTICE = "Sign up for the daily letter of this paper and read all that our editors wrote this week"


def story(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))


def test_template_inside_articles_goes_and_shared_prose_stays(spark):
    rng = random.Random(7)
    shared = story(rng, 30)

    def page(*parts):
        return "<nav>n</nav><article>" + "".join(f"<p>{t}</p>" for t in parts) + "</article>"

    rows, want = [], {}
    for k in range(9):  # every article bears the notice; three share a passage
        own = [story(rng, 60)] + [shared] * (k < 3)
        rows.append((k, f"https://news.example/{k}", page(*own, NOTICE)))
        want[k] = "\n\n".join(own)
    rows.append((20, "https://news.example/20", page(NOTICE)))  # nothing else, so it stays
    want[20] = NOTICE
    for k in range(30, 34):  # too few pages to tell a template
        own = story(rng, 60)
        rows.append((k, f"https://small.example/{k}", page(own, NOTICE)))
        want[k] = f"{own}\n\n{NOTICE}"
    copied = [story(rng, 40) for _ in range(4)]
    for k in range(40, 46):  # most of the text is on all pages: copies of one article
        own = story(rng, 10)
        rows.append((k, f"https://copies.example/{k}", page(*copied, own)))
        want[k] = "\n\n".join([*copied, own])
    for k in range(60, 66):  # pages without a container whose articles others hold in one
        own = story(rng, 60)
        rows += [(k, f"https://print.example/{k}", f"<p>{own}<p>printed {k}"), (k + 10, f"https://print.example/{k}", page(own))]
        want |= {k: f"{own}\n\nprinted {k}", k + 10: own}
    rows.append(rows[0])
    got = html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and {r["page_id"]: r["text"] for r in got} == want


def test_windows_of_all_pages_equal_brute_force(spark):
    rng = random.Random(11)
    shared = [" ".join(rng.choices("abcdefgh", k=rng.randint(5, 30))) for _ in range(5)]
    rows, hosts = [], {}
    for k in range(90):
        parts = [" ".join(rng.choices("abcdefgh", k=rng.randint(20, 60))) for _ in range(rng.randint(1, 4))]
        parts += [b for j, b in enumerate(shared) if rng.random() < (0.1, 0.4, 0.6, 0.8, 0.95)[j]]
        rng.shuffle(parts)
        told = k % 4 > 0
        html = "".join(f"<p>{b}" for b in parts)
        rows.append((k, f"https://h{k % 3}.example/{k}", f"<article>{html}</article>" if told else html))
        hosts.setdefault(k % 3, []).append((k, parts, told))
    want, removed = {}, {True: 0, False: 0}
    for pages in hosts.values():
        run = lambda p: [w for b in p for w in b.split(" ")]
        on, free = {}, {}
        for _, p, told in pages:
            s = run(p)
            for i in range(len(s) - html_main.RUN + 1):
                for on_, counts in ((on, True), (free, not told)):
                    if counts:
                        on_.setdefault(tuple(s[i:i + html_main.RUN]), set()).add(tuple(p))
        need = max(html_main.PAGES, math.ceil(html_main.SHARE * len({tuple(p) for _, p, _ in pages})))
        for k, p, told in pages:
            s = run(p)
            at = [i for i in range(len(s) - html_main.RUN + 1) if len((on if told else free)[tuple(s[i:i + html_main.RUN])]) >= (need if told else 2)]
            covered = {j for i in at for j in range(i, i + html_main.RUN)}
            kept, begin = [], 0
            for b in p:
                n = len(b.split(" "))
                if sum(j in covered for j in range(begin, begin + n)) / n < html_main.COVERED:
                    kept.append(b)
                begin += n
            if not kept or told and len(s) - len(run(kept)) > html_main.MOST * len(s):
                kept = p
            removed[told] += kept != p
            want[k] = "\n\n".join(kept)
    got = html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert min(removed.values()) > 5


def test_equal_windows_have_equal_seeds():
    rng = random.Random(3)
    words = rng.choices("abcdef", k=400)
    shared = words[100:100 + html_main.RUN]
    one, two = html_main.hashed([" ".join(words)])[0], html_main.hashed([" ".join(["x", *shared, "y"])])[0]
    assert html_main.seeds(one, "h")[100] == html_main.seeds(two, "h")[1] != html_main.seeds(two, "i")[1]
    assert len(html_main.seeds(one, "h")) == len(words) - html_main.RUN + 1 and len(html_main.seeds(one[:11], "h")) == 0


def test_container_with_most_text():
    card = "<article><p>card</article>"
    assert text(f"<main><p>a long story of main<p>and more of it{card}</main>") == "a long story of main\n\nand more of it\n\ncard"
    assert text(f"{card}<main><p>a long story of main</main>") == "a long story of main"
    assert text("<main><p>m</main><article><p>longer text of the article</article>") == "longer text of the article"
    assert text("<article><p>one</article><article><p>two</article>") == "one\n\ntwo"


def test_empty_text_falls_back_to_all_blocks():
    assert choose(blocks('<body><form id="f"><p>all of the page</form></body>')) == (["all of the page"], False)
    assert choose(blocks('<div class="widget"><p>w</div><footer>f</footer>')) == (["w", "f"], False)


def test_windows_mark_repeated_runs():
    page = ["a b c d e f", "g h i j k l m n", "u"]
    code, block = html_main.stream(page)
    assert len(code) == 15 - html_main.RUN + 1 and block.tolist() == [0] * 6 + [1] * 8 + [2]
    again, _ = html_main.stream(["a b c d e f g h i j k l", "zz"])
    assert again[0] == code[0] and len(np.unique(code)) == len(code)
    assert html_main.keep_unique(page, [0]) == ["g h i j k l m n", "u"]
    assert html_main.keep_unique(page, [0, 3]) == page  # nothing would stay
    assert html_main.keep_unique(page, []) == page


def test_host_repeats_go_where_markup_is_silent(spark):
    def page(k):
        return f"<body><div>{FOOT}</div><p>{' '.join(f'w{k}x{j}' for j in range(30))}<p>tail {k}</body>"

    rows = [(k, f"http://H.example/{k}", page(k)) for k in range(5)]
    rows += [(0, "http://h.example/0", page(0)), (20, "http://other.example/", f"<p>{FOOT}"), (21, "http://other.example/2", f"<p>{FOOT}"),
             (22, None, None), (None, "x", ""), (23, "http://h.example/a", f"<article><p>{FOOT}</article>")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, place int")
    got = html_main.extract(pages).collect()
    own = lambda k: " ".join(f"w{k}x{j}" for j in range(30)) + f"\n\ntail {k}"
    want = [(str(k), own(k)) for k in (0, 0, 1, 2, 3, 4)] + [("20", FOOT), ("21", FOOT), ("22", ""), ("None", ""), ("23", FOOT)]
    assert sorted((str(r["page_id"]), r["text"]) for r in got) == sorted(want)
    assert all(r["n_chars"] == len(r["text"]) for r in got) and {r["url"] for r in got} == {u for _, u, _ in rows}


def test_empty_table(spark):
    assert html_main.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
