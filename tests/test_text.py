import re

import pytest
from hypothesis import HealthCheck, Phase, given, settings, strategies as st

from condensa.functions import text as T


def test_word_tokens_keep_accents_and_inner_apostrophes(column):
    found = column(T.word_tokens("t"), t="Žluťoučký kůň, o'Neil! x²\n- a_b (c)")
    assert found == ["žluťoučký", "kůň", ",", "o'neil", "!", "x²", "a_b", "c"]


def test_plain_tokens_split_at_apostrophes_and_keep_case(column):
    assert column(T.plain_tokens("t"), t="o'Neil;Ok") == ["o", "Neil", ";", "Ok"]


def test_clean_chars_glues_lines(column):
    assert column(T.clean_chars("t"), t='A\nb\tc-d "x"!') == 'abcd "x"!'


def test_normalize(column):
    assert column(T.normalize_text("t"), t="Ahoj,  světe!") == "ahoj , světe !"
    assert column(T.normalize_text("t"), t="") == ""


def test_first_word_token(column):
    assert column(T.first_word_token("t"), t=" - Ahoj, ty") == "ahoj"
    assert column(T.first_word_token("t"), t=" - ") is None


TEXT = "Hi. Ok? Čau! Now.  A b. c. D"


def test_split_sees_ascii_capitals_only(column):
    assert column(T.split_sentences("t"), t=TEXT) == ["Hi.", "Ok? Čau!", "Now.  A b. c.", "D"]


def test_split_with_unicode_capitals(column):
    expected = ["Hi.", "Ok?", "Čau!", "Now.  A b. c.", "D"]
    assert column(T.split_sentences("t", upper="unicode"), t=TEXT) == expected


@pytest.mark.parametrize("text", ["", ". A", "A. ", "a. B", ". A. B"])
def test_split_edges(column, text):
    cuts = [m.start() + 1 for m in re.finditer(r"[.?!] (?=[A-Z])", text)]
    bounds = [0, *[c + 1 for c in cuts]], [*cuts, len(text)]
    expected = [text[a:b] for a, b in zip(*bounds)]
    assert column(T.split_sentences("t"), t=text) == expected


def test_flatten(column):
    assert column(T.flatten_newlines("t"), t="a\nb\n") == "a b "


def plain_detokenize(tokens):
    """The rule of detokenizing, stated as a loop."""
    out, capital, quoted, opened = "", False, False, False
    for position, token in enumerate(tokens):
        if position == 0:
            out = token.capitalize()
        elif token in (".", "!", "?"):
            out, capital = out + token, True
        elif token in (",", ";"):
            out += token
        elif token in ('"', "'"):
            out += token if quoted else " " + token
            opened = opened or not quoted
            quoted = not quoted
        else:
            out += ("" if opened else " ") + (token.capitalize() if capital else token)
            capital = opened = False
    return out


def test_detokenize_example(column):
    tokens = 'ahoj " jak se máš ? " řekl . dobře , díky !'
    expected = 'Ahoj "jak se máš?" Řekl. Dobře, díky!'
    assert column(T.detokenize("t"), t=tokens.split()) == expected
    assert column(T.detokenize_text("t"), t=f" {tokens} \n") == expected
    assert column(T.detokenize_text("t"), t="") == ""


CAPITALS = ["(ABC", '"Ahoj', "9aBC", "-X", "ß", "ßA", "ﬁX", "ΑΣ", "İx", "é", "O'NEIL", "jak-SE"]


@pytest.mark.parametrize("word", CAPITALS)
def test_first_token_is_capitalised_as_python_does(column, word):
    assert column(T.detokenize_text("t"), t=word) == word.capitalize()


def test_white_space_as_python_sees_it(column):
    text = "a\u00a0b\u2028c\x1cd\x85e\u3000f\x0bg\u200bh"
    assert column(T.detokenize_text("t"), t=text) == " ".join(["A", *text.split()[1:]])


TOKENS = st.lists(
    st.sampled_from([".", "!", "?", ",", ";", '"', "'", "a", "Bc", "o'neil", "ß", "éa", "9x"]),
    max_size=200,
)


@settings(
    max_examples=3,
    deadline=None,
    phases=[Phase.generate],
    suppress_health_check=list(HealthCheck),
)
@given(st.lists(TOKENS, min_size=40, max_size=60))
def test_detokenize_equals_loop(spark, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t array<string>")
    found = {r["i"]: r["v"] for r in df.select("i", T.detokenize("t").alias("v")).collect()}
    assert found == {i: plain_detokenize(r) for i, r in enumerate(rows)}


def test_the_head_of_the_words_is_that_of_all_words(column):
    texts = ["", "  ", "a", "It's, no?! ÉTÉ_9 … — x'y;z\n\"q\"", "---", "word " * 500, "x" * 30_000 + " y.", "Σ ΑΣ. ΣΑΣ b"]
    for text in texts:
        whole = column(T.word_tokens("text"), text=text)
        for n in (1, 2, 3, 100):
            assert column(T.head_word_tokens("text", n), text=text) == whole[:n]
