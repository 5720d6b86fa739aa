"""Wrappers of hosts: alignment against brute force, and what they decide on each page."""

import random
import re
from itertools import combinations

from rarebird.llm import html_wrappers
from rarebird.llm.html_wrappers import align, alone, main_text, stream, template

SCHEMA = "page_id long, url string, html string"


def items(names):
    return [[n, 1, False, False, []] for n in names]


def pattern(some):
    return "".join(x[0] + ("*" if x[2] else "+") * x[3] + "?" * (x[2] and not x[3]) for x in some)


def longest(a, b):
    """The longest common subsequence, by trying all."""
    for n in range(min(len(a), len(b)), 0, -1):
        if {x for x in combinations(a, n)} & {x for x in combinations(b, n)}:
            return n
    return 0


def test_alignment_against_brute_force():
    r = random.Random(11)
    plain = 0
    for _ in range(3000):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randint(0, 7))) for _ in "ab")
        merged = align(items(a), items(b))
        if any(x[3] for x in merged):
            # A repeated group of several names is shown item by item.
            assert set(a + b) == {x[0] for x in merged}
            continue
        plain += 1
        shown = pattern(merged)
        assert re.fullmatch(shown, a) and re.fullmatch(shown, b), (a, b, shown)
        assert sum(not x[2] for x in merged) == sum(x[1] - 1 for x in merged) == longest(a, b)
        assert sum(x[1] for x in merged) == len(a) + len(b)
    assert plain > 500


def test_streams_of_one_page_make_their_own_wrapper():
    page = stream("<body><div>a<p>x</p><p>y</p></div></body>")
    assert align(page, page)[0][4][0][4][1][3] and align([], page)[0][2] and align(page, [])[0][2]
    assert align([], []) == [] and template([]) == {"constants": {}, "linked": []}


def words(n, seed):
    r = random.Random(f"{n} {seed}")
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(12))


def corpus():
    """(host, html, article text) of hosts whose markup does not say it all."""
    for n in range(12):
        one, two, three = (words(n, k) for k in "123")
        # No article tag; template and a list of related pages bear no telling names.
        links = "".join(f"<li><a href=/{k}>{words(n * 9 + k, 'l')}</a></li>" for k in range(3))
        yield (
            "plain.org",
            f"<body><div class=a>The site of all sites</div><div class=b><h1>{one}</h1><p>{two}</p></div>"
            f"<ul class=c>{links}</ul><div class=d>All rights reserved</div></body>",
            f"{one} {two}",
        )
        # The whole page in a form, as some servers make it.
        yield (
            "forms.org",
            f"<body><form id=aspnet action=/><div class=t>Our shop</div><div class=u><p>{one}</p><p>{two}</p></div>"
            "<button>Send</button><select><option>en<option>fr</select></form></body>",
            f"{one} {two}",
        )
        # A word of the article that also names other things, and real ones beside it.
        yield (
            "words.org",
            f"<body><article><p>{one}</p><div class='social-history'><p>{two}</p></div><p>{three}</p>"
            "<div class='share-tools'><b>Tell a friend</b></div><form><p>Your name</p><input><p>Your mail</p></form>"
            f"<div class='comments'><p>{words(n, 'c')}</p></div></article></body>",
            f"{one} {two} {three}",
        )
        # A paragraph that all pages share in the midst of their own.
        own = "".join(f"<p>{words(n, k)}</p>" for k in range(4))
        yield (
            "shared.org",
            f"<body><article><p>{one}</p><p>Names in this report are changed.</p>{own}</article><p>Printed by us</p></body>",
            " ".join([one, "Names in this report are changed.", *(words(n, k) for k in range(4))]),
        )


def test_wrappers_decide(spark):
    made = list(corpus())
    rows = [(i, f"https://{host}/{i}", html) for i, (host, html, _) in enumerate(made)]
    got = {r.page_id: r.text for r in html_wrappers.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, (host, html, article) in enumerate(made):
        assert got[i] == article, host
    # Without their hosts' wrappers all pages of two hosts and the words of a third read worse.
    off = {i: main_text(html) for i, (_, html, _) in enumerate(made)}
    for host, worse in [("plain.org", True), ("forms.org", True), ("words.org", True), ("shared.org", False)]:
        assert all((off[i] != made[i][2]) is worse for i in off if made[i][0] == host), host
    assert all(set(made[i][2].split()) <= set(off[i].split()) for i in off)


def test_copies_of_a_page_say_nothing_of_a_host(spark):
    page = "<body><form><p>One longer text</p><div class='notice-period'>two weeks</div></form></body>"
    rows = [(i, "https://copies.org/", page) for i in range(5)] + [(5, "none", page), (6, "https://b.org", page)]
    got = html_wrappers.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.text for r in got} == {main_text(page)} == {"One longer text"}


def test_doubtful_regions_of_a_page_alone():
    assert alone("<body><form><p>text</p></form></body>") == {"", "/body", "/body/form", "/body/form/p"}
    assert main_text("<body><form><p>text</p></form></body>") == "text"
    assert main_text("<body><p>a long text of its own</p><form><p>name</p></form></body>") == "a long text of its own"
    assert main_text("<article><p>long text</p><div class=social-history>x</div><div class=ad-box>buy</div></article>") == "long text x"
    assert main_text("<article><p>a</p><div id=share-price>b</div><div id=share-bar>c</div></article>") == "a b"
    assert main_text("<p>a text</p><div class=share-tools><a href=/>x</a></div>") == "a text"
    deep = "<div>" * 500 + "<div class=social-history>x</div>y" + "</div>" * 500
    assert main_text(deep) and main_text("") == main_text(None) == main_text("<form></form>") == ""
