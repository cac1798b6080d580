"""Main text of made-up pages with known content, minimum cuts against brute force, and pages built to be slow."""

import html
import random
import time

import pytest

from plexgraph.llm import html_text

WORDS = "river stone letter market window garden winter answer teacher journey village silver morning shadow engine".split()


def page(seed):
    """A page and its article's blocks."""
    rng = random.Random(seed)
    sentence = lambda n: " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."
    blocks = [sentence(4).rstrip("."), *(sentence(rng.randrange(14, 60)) for _ in range(rng.randrange(3, 9)))]
    body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{html.escape(b[: len(b) // 2])}<em>{html.escape(b[len(b) // 2 :])}</em></p>\n" for b in blocks[1:])
    wrap = rng.choice(["<article>{}</article>", "<main><div class='entry-content'>{}</div></main>", "<div id='content'><article class=\"post\">{}</article></div>"])
    links = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in rng.sample(WORDS, 6))
    around = [
        f"<header><nav><ul>{links}</ul></nav></header>", f"<div class='sidebar'><h3>Popular</h3><ul>{links}</ul></div>", f"<aside><p>{sentence(9)}</p></aside>", f"<div class='advert'><p>{sentence(12)}</p></div>",
        f"<div class='cookie-notice'><p>{sentence(8)}</p><button>OK</button></div>", f"<form><label>Mail</label><input name='m'><p>{sentence(5)}</p></form>", "<script>var x = '<p>no</p>';</script><style>p{}</style>", f"<section class='comments'><div class='comment'><p>{sentence(15)}</p></div></section>",
    ]
    rng.shuffle(around)
    cut = rng.randrange(len(around))
    return f"<html><head><title>T</title></head><body>{''.join(around[:cut])}{wrap.format(body)}{''.join(around[cut:])}<footer><p>&copy; all rights reserved</p></footer></body></html>", "\n".join(blocks)


@pytest.mark.parametrize("seed", range(40))
def test_articles_come_out_whole_and_alone(seed):
    source, text = page(seed)
    assert html_text.main_text(source) == text


@pytest.mark.parametrize(
    "source",
    ["<b>x" * 60_000 + "</i>" * 60_000, "<b>" * 50_000 + "<hr>text " * 50_000, "<h1>x" * 60_000, "<div>x" * 60_000 + "</section>" * 40_000, "<li><b>x" * 40_000, "<p>" + "<b>" * 30_000 + "<li>x" * 30_000, "<a 'x" * 60_000, "<!-- " * 60_000],
)
def test_misnested_pages_take_seconds(source):
    began = time.monotonic()
    html_text.main_text(source)
    assert time.monotonic() - began < 20


def test_a_large_undecided_page():
    rng = random.Random(4)
    n = 6000
    gain = [rng.uniform(-1.2, 1.2) for _ in range(n)]
    ties = [(i, i + 1, 1.2) for i in range(n - 1)] + [(i, i + 3, 0.6) for i in range(0, n - 3, 3)]
    began = time.monotonic()
    label = html_text.min_cut(gain, ties)
    assert time.monotonic() - began < 20
    cost = lambda lab: sum(max(0, -g) if x else max(0, g) for g, x in zip(gain, lab)) + sum(w for a, b, w in ties if lab[a] != lab[b])
    best = cost(label)
    for _ in range(300):  # no run of blocks can be turned over with profit
        a = rng.randrange(n)
        b = min(n, a + rng.randrange(1, 40))
        assert cost(label[:a] + [not x for x in label[a:b]] + label[b:]) >= best - 1e-9


def test_chains_against_exact_labels():
    """Along a chain the best labels follow from left to right."""
    rng = random.Random(2)
    for _ in range(20):
        n = rng.randrange(2, 60)
        gain, tie = [rng.uniform(-2, 2) for _ in range(n)], [rng.uniform(0, 2) for _ in range(n - 1)]
        own = lambda i, x: max(0, -gain[i]) if x else max(0, gain[i])
        best = [own(0, False), own(0, True)]
        for i in range(1, n):
            best = [own(i, x) + min(best[x], best[not x] + tie[i - 1]) for x in (False, True)]
        label = html_text.min_cut(gain, [(i, i + 1, w) for i, w in enumerate(tie)])
        assert sum(own(i, x) for i, x in enumerate(label)) + sum(w for i, w in enumerate(tie) if label[i] != label[i + 1]) == pytest.approx(min(best))
