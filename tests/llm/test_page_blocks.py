"""Pages built around known articles, without an article element, and single rules."""

import random
import time

import pytest

from docloom.llm.html_text import blocks_of, main_text

P = "The fox was in the house and it was on the mat for the rest of the day."
LEADS = ["A short lead.", "Call the author.", "One egg", "Two cups of milk", "Mix it well.", "Done!"]


def built(seed):
    """(page, text) of a random article in random furniture."""
    rng = random.Random(seed)
    blocks = [("h1", f"Title {seed}")]
    for _ in range(rng.randint(2, 7)):
        kind = rng.choice(["p", "p", "short", "list", "h2", "quote"])
        if kind == "p":
            blocks.append(("p", f"{P} It was {rng.randint(0, 99)} of them."))
        elif kind == "short":
            blocks += [("p", rng.choice(LEADS)) for _ in range(rng.randint(1, 3))]
        elif kind == "list":
            blocks += [("li", rng.choice(LEADS)) for _ in range(rng.randint(1, 4))]
        else:
            blocks += [("h2" if kind == "h2" else "blockquote", f"Part {rng.randint(0, 9)}"), ("p", P)]
    if rng.random() < 0.8:
        blocks.append(("p", P))
    body = "".join(f"<{t}>{x}</{t}>" for t, x in blocks)
    before = ["<nav><a href=/>Home</a> <a href=/b>About</a></nav>", f"<header><p>{P} of the site</p></header>", f"<div class='cookie-notice'>{P} cookies</div>", "<ul class=menu><li><a>One</a><li><a>Two</a></ul>", "<form action=/s><input name=q><button>Go</button></form>"]
    after = [f"<footer>{P} of the footer</footer>", f"<aside><p>{P} aside</p></aside>", f"<div class='user-comment'>{P} I think</div>", f"<div class='ad-slot-300x250'>{P} Buy</div>", "<form><p>Your name</p><input><p>Your mail</p></form>", f"<section id=related-posts><p>{P} related</p></section>", "<script>var a = '<p>no</p>';</script>"]
    rng.shuffle(before)
    rng.shuffle(after)
    page = "".join(before[: rng.randint(0, 5)]) + rng.choice(["<div id=content>{}</div>", "<div class='page single'>{}</div>", "<form id=aspnetForm>{}</form>", "{}"]).format(body) + "".join(after[: rng.randint(0, 7)])
    return f"<html><head><title>t</title></head><body class='has-sidebar'>{page}</body></html>", "\n".join(x for _, x in blocks)


@pytest.mark.parametrize("seed", range(200))
def test_known_articles(seed):
    page, text = built(seed)
    assert main_text(page) == text


def test_furniture_does_not_vote():
    assert main_text(f"<p>{P}</p><p>Call the author.</p><footer>x</footer>") == f"{P}\nCall the author."
    assert main_text(f"<nav>menu</nav><p>A short lead.</p><p>{P}</p>") == f"A short lead.\n{P}"
    assert main_text(f"<p>{P}</p><p>One.</p><p>Two.</p><p>Three.</p><footer>x</footer>") == f"{P}\nOne.\nTwo.\nThree."
    assert main_text(f"<p>{P}</p><ul><li>One egg<li>Two cups of milk</ul><footer>x</footer>") == f"{P}\nOne egg\nTwo cups of milk"


def test_pages_without_prose():
    assert main_text("<nav>menu</nav><h1>Cake</h1><ul><li>Two eggs</ul><ol><li>Mix it</ol><footer>f</footer>") == "Cake\nTwo eggs\nMix it"
    assert main_text("<form id=f><h1>Cake</h1><p>Two eggs</p></form>") == "Cake\nTwo eggs"


def test_forms():
    assert main_text(f"<form id=aspnetForm><nav>m</nav><p>{P}</p><p>Short.</p></form>") == f"{P}\nShort."
    assert main_text(f"<div><p>{P}</p><p>{P}</p></div><form><p>By signing up you agree to the terms and to the rules of the house.</p></form>") == f"{P}\n{P}"
    assert main_text("<form><p>Your name</p><p>Your mail</p></form>") == ""


def test_other_languages_beside():
    russian = "Быстрая лисица прыгает через ленивую собаку каждое утро перед тем как солнце встанет над рекой"
    places = "Aachen Augsburg Berlin Bochum Bonn Bremen Chemnitz Dortmund Dresden Duisburg Essen Frankfurt Freiburg"
    assert main_text(f"<p>{P}</p><p>{russian}</p>") == f"{P}\n{russian}"
    assert main_text(f"<p>{P}</p><p>{places}</p><footer>f</footer>") == f"{P}\n{places}"


def test_words_are_not_broken():
    assert main_text(f"<p>{P} super<wbr>cali<img src=x>fragilistic a<br>b</p>") == f"{P} supercalifragilistic a b"


def test_reader_comments():
    assert main_text(f"<article><p>{P}</p><article class='user-comment'><p>{P} I think</p></article></article>") == P
    assert main_text(f"<main><p>{P}</p><p>{P}</p><div class='reader-comments'><p>{P} no</p></div></main>") == f"{P}\n{P}"


def test_no_caps_on_nesting_or_distance():
    for depth in (1, 5, 40):
        page = "<article>" * depth + f"<p>{P}</p>" + "</article>" * depth + f"<article><p>{P[:30]}</p></article>"
        assert main_text(page) == P
    outer = f"<main><p>{P} a</p><article><article><article><article><article><p>{P} b</p></article></article></article></article></article><p>{P} c</p></main>"
    assert main_text(outer).startswith(f"{P} a") and main_text(outer).endswith(f"{P} c")
    between = "".join(f"<p>by line {i}</p>" for i in range(9))
    assert main_text(f"<h1>Head</h1>{between}<article><p>{P}</p></article>") == f"Head\n{P}"


def test_linear_in_nesting():
    began = time.time()
    main_text("<article><p>x</p>" * 30_000)
    assert time.time() - began < 10
    assert len(blocks_of("<article><p>x</p>" * 50).parents) == 50
