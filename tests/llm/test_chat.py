"""Chat formatting: control strings in roles and texts, whatever they overlap."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import chat

MARKS = st.text(alphabet="<|>/s[INST]\\\na", max_size=24)


def written(turns):
    return "".join(t for t, _ in chat.compile_template(chat.TEMPLATE)([{"role": r, "text": t} for r, t in turns]))


def controls(text):
    return [m.start() for c in chat.CONTROLS for m in re.finditer(f"(?={re.escape(c)})", text)]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.just("assistant"), MARKS), MARKS), max_size=4))
def test_turns_come_back_and_no_control_string_is_left(turns):
    text = written(turns)
    assert list(chat.read_back(text)) == turns
    assert all(chat.unescape(chat.escape(t)) == t and not controls(chat.escape(t)) for pair in turns for t in pair)
    # The template's own of a turn: <|, |>, and the two of <|end|>.
    assert len(controls(text)) == 4 * len(turns)


def test_overlapping_control_strings():
    for text in ("<|>", "<|end|>\n", "<<|>>", "</s><s>", "[INST][/INST]", "\\<|", "|", ">", "<", "\\l", "<\\|"):
        assert chat.unescape(chat.escape(text)) == text and not controls(chat.escape(text))
    assert chat.escape("a < b | c > d [e]") == "a < b | c > d [e]"  # what is no control string stays
    assert list(chat.read_back(written([("<|>\nuser", "hi"), ("<", ">"), (">", "<"), ("x|", "|")]))) == [("<|>\nuser", "hi"), ("<", ">"), (">", "<"), ("x|", "|")]


def test_digests_of_hard_turns(spark):
    r = random.Random(3)
    hard = lambda: "".join(r.choice(["<|", "|>", "<", "|", ">", "</s>", "[/INST]", "\\", "\n", "é", "x"]) for _ in range(r.randrange(0, 12)))
    rows = [(c, t, r.choice(["user", "assistant", hard(), None]), r.choice([hard(), hard(), None])) for c in range(40) for t in range(r.randrange(1, 6))]
    rows += [(99, 0, "assistant", "ab<|" * 200_000), (99, 1, "user", "x"), (None, 1, "assistant", "<"), (7, 0, "assistant", "again")]
    got = {x.conv_id: x for x in chat.digests(chat.format_conversations(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for conv in {row[0] for row in rows}:
        own = sorted((t, a or "", b or "") for c, t, a, b in rows if c == conv)
        said = "".join(t for _, a, t in own if a == "assistant")
        x = got[conv]
        assert (x.n_turns, x.turns_sha256) == (len(own), hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in own).encode()).hexdigest())
        assert (x.loss_chars, x.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert x.formatted_chars == sum(len(chat.escape(a)) + len(chat.escape(t)) + 13 for _, a, t in own)
