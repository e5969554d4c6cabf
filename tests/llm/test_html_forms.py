"""Forms: those of a few fields go, those that sites wrap pages in stay."""

import pytest

from folioworks.llm import html_extract

STORY = "<div>A story of some length that the page is about, told in a few words more.</div>"
TOLD = STORY[5:-6]


@pytest.mark.parametrize("template", [None, ""])
@pytest.mark.parametrize("html, text", [
    ("<form id=aspnetForm><div>Story text here</div></form><div>foot</div>", "Story text here foot"),
    (f"<h1>Site</h1><form>{STORY}</form>", f"Site {TOLD}"),
    (f"<form action=x><input type=hidden name=v><input name=q><div class=menu>no</div><nav>no</nav>{STORY}<p>{TOLD}</p><footer>no</footer></form>", f"{TOLD} {TOLD}"),
    (f"<form><input><button>no</button>Name<h1>Head</h1>x</form><div class=ad>{TOLD}</div>", "Name Head x"),
    (f"<article><h1>T</h1>{STORY}<form>Say something <input name=a><input type=submit></form></article>", f"T {TOLD}"),
    (f"<article><h1>T</h1><p>Short</p><form>Leave a reply to this <input name=a> your mail <input> or not<input type=submit></form></article>", "T Short"),
    (f"{STORY}<form>no</form><p>More</p><form>no <form>no</form>", f"{TOLD} More"),
    ("<form>only this</form>", "only this"),
    (f"<article><form><p>{TOLD}</p></form></article><form>Search <input></form>", TOLD),
])
def test_forms(template, html, text):
    assert html_extract.main_text(f"<body>{html}</body>", template) == text


def test_wrapped_pages_of_a_host(spark):
    page = lambda k: f"<body><form method=post><input type=hidden><div>Start Shop Help</div><div>Story {'x' * k} of day {k}</div><div>All rights kept</div></form><form><input>Find</form></body>"
    rows = [(k, f"http://w.example/{k}", page(k)) for k in range(5)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: " ".join(r.text.split()) for r in got.collect()} == {k: " ".join(f"Story {'x' * k} of day {k}".split()) for k in range(5)}
