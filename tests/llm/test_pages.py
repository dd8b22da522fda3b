"""Extraction on pages written by hand, whose layouts and names the page maker does not draw as a whole, and on awkward tables."""

import pytest
from pyspark.sql import functions as F

from coverwell.llm import html_extract, perspectives

#: (name, html, blocks of the main text)
PAGES = [
    (
        'bare divs',
        '<html><head><title>Town Gazette</title></head><body>\n<div><a href="/">Home</a> <a href="/news">News</a> <a href="/sport">Sport</a> <a href="/contact">Contact</a></div>\n<h1>Council votes to reopen the old ferry line</h1>\n<div>The city council agreed on Tuesday to bring back the ferry that crossed the river until 1998, after months of debate over its cost and the state of the two piers.</div>\n<div>Work on the northern pier starts in March. Boats are expected to run every half hour, and a single ticket will cost about as much as the bus.</div>\n<div>Copyright 2024 Town Gazette. All rights reserved.</div></body></html>',
        ['Council votes to reopen the old ferry line', 'The city council agreed on Tuesday to bring back the ferry that crossed the river until 1998, after months of debate over its cost and the state of the two piers.', 'Work on the northern pier starts in March. Boats are expected to run every half hour, and a single ticket will cost about as much as the bus.'],
    ),
    (
        'comments in an unknown thread',
        '<body><header><a href="/">The Baker</a></header><article><h1>How to keep a sourdough starter alive</h1>\n<p>A starter wants flour, water and a little patience. Feed it once a day while it sits on the counter, and once a week when it lives in the fridge.</p>\n<p>If it smells of nail polish it is hungry: pour most of it away and feed the rest twice in one day.</p></article>\n<div class="thread"><h3>12 replies</h3><div>Marta wrote:</div><div>Mine died last summer, I think it was the heat. Thanks for this.</div><div><a href="#">Reply</a></div>\n<div>Jon 3 hours ago</div><div>I agree, rye flour works best.</div><div><a href="#">Reply</a></div></div><footer>Privacy &amp; terms</footer></body>',
        ['How to keep a sourdough starter alive', 'A starter wants flour, water and a little patience. Feed it once a day while it sits on the counter, and once a week when it lives in the fridge.', 'If it smells of nail polish it is hungry: pour most of it away and feed the rest twice in one day.'],
    ),
    (
        'sidebar and newsletter',
        '<body><nav><ul><li><a href="/a">World</a></li><li><a href="/b">Business</a></li></ul></nav><div class="wrap"><main><h1>Glacier loses a tenth of its ice</h1>\n<p>Measurements made this autumn show that the glacier lost a tenth of its volume in two years, more than in the whole decade before.</p><form class="newsletter"><label>Your email</label><input name=e><button>Sign up</button></form>\n<h2>What comes next</h2><p>Researchers will return in spring with radar. &quot;We want to know how thick it still is,&quot; said the leader of the team.</p></main>\n<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Ten recipes for autumn</a></li><li><a href="/2">Why trains run late</a></li></ul></aside></div><div class="cookie-banner"><p>We use cookies to improve your visit. Accept or manage your consent.</p></div></body>',
        ['Glacier loses a tenth of its ice', 'Measurements made this autumn show that the glacier lost a tenth of its volume in two years, more than in the whole decade before.', 'What comes next', 'Researchers will return in spring with radar. "We want to know how thick it still is," said the leader of the team.'],
    ),
    (
        'divs with made-up names',
        '<body><div class="css-1x9"><div class="css-77"><a href="/">Start</a><a href="/shop">Shop</a><a href="/login">Login</a></div></div>\n<div class="css-ab2"><div class="css-t1"><h1>A library opens in the old station</h1></div><div class="css-p">For eleven years the station hall stood empty. On Saturday its doors open again, with forty thousand books on the platforms.</div>\n<div class="css-p">The reading room keeps the ticket windows, where visitors now return what they have borrowed.</div></div>\n<div class="css-zz"><a href="/privacy">Privacy</a> <a href="/terms">Terms</a></div></body>',
        ['A library opens in the old station', 'For eleven years the station hall stood empty. On Saturday its doors open again, with forty thousand books on the platforms.', 'The reading room keeps the ticket windows, where visitors now return what they have borrowed.'],
    ),
    (
        'list and quote',
        '<body><div id="header">My Garden</div><div id="content"><h1>Three plants for dry balconies</h1><p>Not every balcony gets watered on time. These three do not mind.</p><ul><li>Houseleek, which grows on bare stone.</li><li>Lavender, if the pot is deep.</li><li>Thyme, which also feeds the cook.</li></ul>\n<blockquote><p>Plant in spring, then leave it alone.</p></blockquote></div><div class="ads">Advertisement</div><div id="footer">Copyright My Garden</div></body>',
        ['Three plants for dry balconies', 'Not every balcony gets watered on time. These three do not mind.', 'Houseleek, which grows on bare stone.', 'Lavender, if the pot is deep.', 'Thyme, which also feeds the cook.', 'Plant in spring, then leave it alone.'],
    ),
    (
        'german in sections',
        '<body><header class="site-header"><a href="/">Zeitblatt</a></header><section class="story"><h1>Der Zug fährt wieder nachts</h1><p>Ab Dezember fährt der Nachtzug wieder zwischen den beiden Städten, zunächst dreimal in der Woche.</p><p>Die Fahrt dauert elf Stunden. Schlafwagen gibt es erst im nächsten Jahr.</p><aside class="related"><a href="/x">Mehr zum Thema</a></aside></section><footer><p>Impressum</p></footer></body>',
        ['Der Zug fährt wieder nachts', 'Ab Dezember fährt der Nachtzug wieder zwischen den beiden Städten, zunächst dreimal in der Woche.', 'Die Fahrt dauert elf Stunden. Schlafwagen gibt es erst im nächsten Jahr.'],
    ),
    (
        'french with advert and tags',
        '<body><div class="topbar"><a href="/">Accueil</a><a href="/culture">Culture</a></div><div class="page"><article class="post"><header><h1>Le marché revient sur la place</h1></header>\n<p>Après deux ans de travaux, le marché du samedi revient sur la grande place, avec quarante marchands et une halle couverte.</p><div class="ad">Publicité</div><p>Les forains demandent encore plus de places de parking.</p><div class="tags"><a href="/t/1">marché</a> <a href="/t/2">ville</a></div></article></div><footer>Mentions légales</footer></body>',
        ['Le marché revient sur la place', 'Après deux ans de travaux, le marché du samedi revient sur la grande place, avec quarante marchands et une halle couverte.', 'Les forains demandent encore plus de places de parking.'],
    ),
    (
        'responses after a plain article',
        '<body><ul class="menu"><li><a href="/">Blog</a></li><li><a href="/about">About</a></li></ul><h1>Why I repair my own bicycle</h1><p>I started with a flat tyre and a borrowed spoon. Ten years later I own more tools than bicycles.</p><p>The point is not to save money. It is to know what each sound means before it becomes a walk home.</p>\n<section><h3>3 comments</h3><article><div>Ana says:</div><p>Same here, and the spoon works.</p><a href="#">Reply</a></article><article><div>Tom says:</div><p>What about the brakes? Thanks!</p><a href="#">Reply</a></article></section><small>© 2023 The Blog</small></body>',
        ['Why I repair my own bicycle', 'I started with a flat tyre and a borrowed spoon. Ten years later I own more tools than bicycles.', 'The point is not to save money. It is to know what each sound means before it becomes a walk home.'],
    ),
]


@pytest.mark.parametrize("name, html, want", PAGES, ids=[p[0] for p in PAGES])
def test_main_text_is_exact(name, html, want):
    labeller = html_extract.Labeller(html_extract.trained())
    assert labeller.texts([html]) == ["\n\n".join(want)]


def test_awkward_tables(spark):
    rows = [(1, "u", PAGES[0][1]), (1, "u", PAGES[0][1]), (None, None, None), (2, "", ""), (3, "v", "text without a tag")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("text", "n_chars", "TEXTS")})
    got = html_extract.extract(pages).collect()
    assert sorted((x.page_id or 0, x.n_chars) for x in got)[:2] == [(0, 0), (1, len("\n\n".join(PAGES[0][2])))] and len(got) == 5
    assert all(x.n_chars == len(x.text) for x in got)
    assert html_extract.extract(pages.where("false")).collect() == []
    turns = spark.createDataFrame([(1, 0, "a", "x"), (1, 0, "a", "x"), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    turns = turns.withColumns({c: F.lit("clash") for c in ("speaker", "part", "masks", "offset", "rank")})
    assert {(x.conv_id, x.speaker, x.n_turns) for x in perspectives.perspectives(turns).collect()} == {(1, "a", 2), (None, "unknown", 1)}
    assert perspectives.perspectives(turns.where("false")).collect() == []
