"""Pages whose head or silent elements are not ended, and names of the root elements."""

import pytest

from tessella.llm import html_labels as hl

HEAD = "<html><head><meta charset=utf-8><title>Name</title><style>p{}</style>"
TEXT = "<p>First paragraph with several words in it, enough to be prose.</p>"
WANT = ["First paragraph with several words in it, enough to be prose."]


def read(page):
    return [t for _, t, _ in hl.blocks(page)]


@pytest.mark.parametrize("start", ["<body>", "<article>", "", "<noscript><img src=x></noscript><body>", "<title>open</title><svg><text>x</text></svg>", "<script>'<p>'</script></head><body>"])
def test_a_head_without_its_end(start):
    assert read(HEAD + start + TEXT) == WANT


def test_text_and_inline_elements_end_a_head():
    assert read(HEAD + "plain words") == ["plain words"]
    assert read(HEAD + "<b>bold</b> words") == ["bold words"]
    assert read(HEAD + "<template><p>held</p></template><body>" + TEXT) == WANT


@pytest.mark.parametrize("tag", ["button", "noscript", "object", "iframe"])
def test_silent_elements_without_their_end(tag):
    assert read(f"<body><{tag}>x</{tag}><{tag}>" + TEXT)[-1:] == WANT
    assert read(f"<body><{tag}>hidden</{tag}>" + TEXT) == WANT
    assert read(f"<body><{tag}/>" + TEXT) == WANT


def test_names_of_the_root_are_no_signs():
    page = "<html class='no-comments'><body class='has-sidebar' id=search>" + TEXT
    (block,) = hl.blocks(page)
    assert block[0] == ("html", "body", "p") and hl.teacher(*block) == 1
