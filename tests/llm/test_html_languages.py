"""Pages without an article in languages that have no stop words in the list."""

import pytest
from test_html_text import STORY, page

from millrace.llm.html_text import main_text

TEXTS = {
    "ru": "Старая гавань города долгое время была местом, куда приходили все корабли с севера, и она до сих пор полна жизни.",
    "zh": "这座城市的旧港口在很长一段时间里是所有来自北方的船只停靠的地方,直到今天这里仍然充满生机,每天都有许多人来散步。",
    "it": "Il vecchio porto della città fu per molto tempo il luogo dove arrivavano tutte le navi provenienti dal nord, ed oggi resta pieno di vita.",
    "pt": "O velho porto da cidade foi durante muito tempo o lugar onde chegavam todos os navios vindos do norte, e ainda hoje está cheio de vida.",
}
LINKS = "".join(f"<li><a href='/{i}'>Link number {i} of the long list of links that stands beside the text of all pages</a></li>" for i in range(9))


@pytest.mark.parametrize("text", TEXTS.values(), ids=TEXTS)
def test_text_in_plain_blocks(text):
    got = main_text(page(f"<div><ul>{LINKS}</ul></div><div><h2>H</h2><p>{text}</p><p>{text}</p></div><div class=footer>{text}</div>"))
    assert got == f"H\n{text}\n{text}"


def test_one_known_paragraph_does_not_hide_the_rest():
    text = TEXTS["ru"]
    assert main_text(page(f"<p>{text}</p><p>{STORY}</p><p>{text}</p>")) == f"{text}\n{STORY}\n{text}"
    assert main_text(page(f"<p>{text}</p><article><p>{STORY}</p></article>")) == STORY


def test_known_language_still_drops_lists_of_names():
    names = " ".join(f"Name{i}" for i in range(20))
    assert main_text(page(f"<p>{STORY}</p><p>{STORY}</p><div>{names}</div>")) == f"{STORY}\n{STORY}"
