"""Furniture inside of a block does not cut its text; only real attributes make furniture."""

import pytest

from ledgerlens.llm.extract import extract

LONG = "A long paragraph of the article with many words in it. " * 12


@pytest.mark.parametrize("cut", ['<div class="advert">Buy</div>', "<aside>See also</aside>", '<p class="notice">Note</p>\n' * 4])
def test_short_ends_beside_furniture_stay(cut):
    page = f"<html><body><div id='text'><p>Opening.</p>\n{cut}\n<p>{LONG}</p><p>{LONG}</p>\n{cut}\n<p>Closing.</p></div></body></html>"
    assert extract(page) == " ".join(f"Opening. {LONG} {LONG} Closing.".split())


def test_other_blocks_stay_apart():
    page = f"<body><div><p>Menu.</p></div><nav>x</nav><div><p>{LONG}</p><p>{LONG}</p></div><footer>f</footer><div><p>Legal.</p></div></body>"
    assert extract(page) == " ".join(f"{LONG} {LONG}".split())


@pytest.mark.parametrize("tag", ['div style="overflow:hidden"', "article style='overflow: hidden'", 'div title="the class=advert id=nav"', 'div data-x=" hidden "'])
def test_words_in_values_are_no_attributes(tag):
    assert extract(f"<body><{tag}><p>{LONG}</p></{tag.split()[0]}></body>") == LONG.strip()


@pytest.mark.parametrize("tag", ["div hidden", "div HIDDEN=''", 'div aria-hidden="true"', "div class='x advert'", "div id=sidebar", 'div role="navigation"', 'div title="a" hidden'])
def test_real_attributes_still_drop(tag):
    assert extract(f"<body><{tag}><p>Gone.</p></div><div><p>{LONG}</p></div></body>") == LONG.strip()
