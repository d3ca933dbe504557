"""The text queries use whole texts of all rows; against plain Python on a small table."""

import re

import pytest

from pairlens.functions import text as tx
from pairlens.plans import texts

TEXTS = [
    "one two three four five six seven eight nine ten eleven twelve thirteen",
    "a first line of words that is longer than thirty characters\nThe solution is late\n### end",
    "see `code` and a todo here",
    "x = 1\n```\nprint(2)\n```\nend of it",
    "twenty nine characters in alls yes",
    "line\n\nprint(3)\n\nif __name__ == 1",
    " leading and\nlines\n ",
    "<think>hm</think> so\n```py\nreturn 7\nreturn 8\n```",
    "élan 漢字 𝄞 and so on, with a stop\nExplanation: none",
    "",
]


def stripped(text):
    """The reference's rule: best fenced segment of code by score, then length; stubs only without others."""
    text = re.sub(r"<think>.*?</think>\s*", "", text, flags=re.S)

    def score(x):
        return sum(y.startswith(tuple(tx.CODE_STARTS)) or bool(re.match(tx.ASSIGNMENT, y)) for y in map(str.strip, x.splitlines()))

    parts = text.split("```")
    parts = [parts[0].strip(), *(re.sub(r"^\s*(?i:python|py)(?=\s|$)", "", x).strip() for x in parts[1:])]
    code = [x for x in parts if x and score(x)]
    real = [x for x in code if not ("todo" in x.lower() or "your implementation here" in x.lower() or x.lower() == "pass")]
    return max(real or code, key=lambda x: (score(x), len(x))) + "\n"


def cut(text):
    return text[: min([text.find(s) for s in tx.STOPS if s in text], default=len(text))]


@pytest.fixture
def given(spark, monkeypatch):
    rows = spark.createDataFrame([(i, 1, "user" if i == 1 else "assistant", t) for i, t in enumerate(TEXTS)], "id long, turn int, role string, text string")
    monkeypatch.setattr(texts, "load", lambda *_: rows.selectExpr("id AS conv_id", "id AS doc_id", "id AS item_id", "turn", "role", "text"))
    return spark


def test_fences_after_whole_texts(given):
    got = {r.conv_id: r.kept for r in texts.fence_extract(given, "").collect()}
    assert got == {i: stripped(f"Here:\n```python\n# todo\nreturn 1\n```\nor\n```python\nreturn {t}\n```\nThanks.") for i, t in enumerate(TEXTS)}
    assert got[0] == f"return {TEXTS[0]}\n"


def test_stops_in_whole_texts(given):
    got = {r.doc_id: (r.kept, r.half) for r in texts.truncate_completion(given, "").collect()}
    assert got == {i: (cut(t + "\n### " + t), cut(t[: len(t) // 2] + "\nThe solution" + t[len(t) // 2 :])) for i, t in enumerate(TEXTS)}
    assert got[0][0] == TEXTS[0]


def test_prompts_of_whole_texts(given):
    got = {r.item_id: (r.prompt, r.back) for r in texts.prompt_round_trip(given, "").collect()}
    want = {i: (f"P\n\n### Visible Test Cases\nTest 1\n{t}\n\nTest 2\nx\n\n### Answer\ngo", "|".join(x for x in (t.strip(), "x") if x)) for i, t in enumerate(TEXTS)}
    assert got == want
