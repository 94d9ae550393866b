import pytest
from hypothesis import given
from hypothesis import strategies as st

from cairn.functions import querytext as Q


@pytest.mark.parametrize(
    ("query", "want"),
    [("foo bar", '"foo" "bar"'), ("check*", '"check"*'), ('"check mc"*', '"check mc"*'), ("*", '"*"'), ("*foo", '"*foo"'), ('foo"bar', '"foo" "bar"'), ('"', ""), ("a\0b", '"ab"'), ("", "")],
)
def test_terms(query, want):
    assert Q.sanitised(query) == want


@given(st.text())
def test_terms_never_fail(query):
    text = Q.sanitised(query)
    assert text.count('"') % 2 == 0 and "\0" not in text
    Q.phrases(query)


def test_inline_filters_and_prefix():
    assert Q.inline_filters("lang:py owner: x tag:a tag:b y") == ("x y", {"language": "py", "tag": "b"})
    assert Q.live_prefix("deploy no") == "deploy no*"
    assert Q.live_prefix('"deploy no') == '"deploy no"*'
    assert Q.bookmark("@a", {"a": "b c"}) == "b c" and Q.bookmark("@z", {}) == "z"


@pytest.mark.parametrize("limit", [0, -1, 1 << 63])
def test_limits(limit):
    with pytest.raises(Q.ValidationError):
        Q.check_limit(limit)


def test_regex_translation():
    assert Q.java_regex("a$") == r"(?U)a\z"
    assert Q.java_regex("[$]a\\$") == "(?U)[$]a\\$"
    for bad in ("(?=a)", r"(a)\1", "("):
        with pytest.raises(Q.ValidationError):
            Q.java_regex(bad)


def test_roles():
    Q.check_role("inputfile", declares=True)
    with pytest.raises(Q.ValidationError):
        Q.check_role("inputfile", declares=False)
    with pytest.raises(Q.ValidationError):
        Q.check_role("other", declares=True)
