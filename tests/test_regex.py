"""Dialects: translation for both engines, class algebra, smart case, sure literals."""

import random
import re

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seekwell.functions.find import Finder, column_of, display_width
from seekwell.functions.regex import PatternError, bre_to_ere, compile_patterns, has_upper, required_literal, split_alternatives
from seekwell.model import SearchOptions as O
from seekwell.plans.predicates import predicate

CASES = [
    (O(patterns=("[a-z--[aeiou]]+",)), "aeiou", False), (O(patterns=("[a-z--[aeiou]]+",)), "xyz", True), (O(patterns=("[a-z&&[x-z]]",)), "abc", False), (O(patterns=("[a-z&&[x-z]]",)), "y", True), (O(patterns=("[a||[0-9]]",)), "7", True),
    (O(patterns=("[[:digit:]]",)), "d", False), (O(patterns=("[[:digit:]]",)), "5", True), (O(patterns=("[^[:alpha:]]",)), "ab", False), (O(patterns=("[[:^alpha:]]",)), "a1", True),
    (O(patterns=(r"\p{Greek}",)), "α", True), (O(patterns=(r"\p{IsGreek}",)), "α", True), (O(patterns=(r"\p{Lu}",)), "a", False), (O(patterns=(r"\l+\u",)), "abC", True), (O(patterns=(r"\u{3B1}",)), "α", True), (O(patterns=(r"\o{141}",)), "a", True),
    (O(patterns=(r"\<foo\>",)), "a foo b", True), (O(patterns=(r"\<foo\>",)), "afoo", False), (O(patterns=(r"\w",)), "é", True), (O(patterns=(r"\w",), ascii=True), "é", False), (O(patterns=("a.b",)), "a\rb", True), (O(patterns=("a.b",)), "a b", True),
    (O(patterns=(r"\(a\|b\)\{2\}",), dialect="bre"), "xab", True), (O(patterns=("a+",), dialect="bre"), "aa", False), (O(patterns=("a+",), dialect="bre"), "a+", True), (O(patterns=("*a",), dialect="bre"), "*a", True),
    (O(patterns=("a.b\nc*",), dialect="fixed"), "c*d", True), (O(patterns=("a.b",), dialect="fixed"), "axb", False), (O(patterns=("ab",), whole_line=True), "ab", True), (O(patterns=("ab",), whole_line=True), "abc", False), (O(patterns=("ab|abc",), whole_line=True), "abc", True),
    (O(patterns=("ab",), word=True), "x ab-", True), (O(patterns=("ab",), word=True), "abc", False), (O(patterns=("HELLO",), ignore_case=True), "hello", True), (O(patterns=("hello",), smart_case=True), "HELLO", True), (O(patterns=("Hello",), smart_case=True), "HELLO", False),
    (O(patterns=(r"(?=.*b)a",), dialect="perl"), "acb", True), (O(patterns=(r"(a)\1",), dialect="perl"), "aa", True), (O(patterns=("",)), "anything", True), (O(patterns=(r"\Qa.b\E+",)), "a.bb", True), (O(patterns=("a  b",), free_space=True), "ab", True),
    (O(patterns=(r"\s",)), "a b", True), (O(patterns=(r"[^x]",)), "x", False), (O(patterns=(r"\x41\x{42}",)), "AB", True), (O(patterns=(r"\h",)), "a\tb", True), (O(patterns=("[]a]",)), "]", True), (O(patterns=("[a-]",)), "-", True), (O(patterns=(r"[\]x]",)), "]", True),
    (O(patterns=("é",), ignore_case=True, dialect="perl"), "É", True), (O(patterns=("abc",), invert=True), "abc", False),
]


def test_predicates_agree_with_cases_and_finder(spark):
    df = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(CASES)], "i int, t string")
    for i, (o, t, want) in enumerate(CASES):
        got = df.filter(F.col("i") == i).select(predicate("t", o).alias("x")).first()["x"]
        assert got is want, (o, t)
        if not o.invert:
            assert bool(list(Finder(compile_patterns(o), o).spans(t))) is want, (o, t)


def test_longest_alternative_wins():
    o = O(patterns=("foo|foobar",))
    assert [(s, e) for s, e, *_ in Finder(compile_patterns(o), o).spans("foobar foo")] == [(0, 6), (7, 10)]
    o = O(patterns=("foo", "foobar"))
    assert [(e, a) for _, e, a, _ in Finder(compile_patterns(o), o).spans("foobar foo")] == [(6, 2), (10, 1)]
    o = O(patterns=("foo|foobar",), dialect="perl")
    assert [(s, e) for s, e, *_ in Finder(compile_patterns(o), o).spans("foobar")] == [(0, 3)]


def test_negative_patterns_discard_matches_as_long():
    o = O(patterns=("Hello", '(?^"Hello World!")'))
    assert [s for s, *_ in Finder(compile_patterns(o), o).spans('"Hello World!" Hello')] == [15]


def test_empty_matches_only_if_asked():
    o = O(patterns=("a*",))
    assert not list(Finder(compile_patterns(o), o).spans("xyz"))
    o = O(patterns=("a*",), empty=True)
    assert len(list(Finder(compile_patterns(o), o).spans("xyz"))) == 4


def test_smart_case_and_literals():
    assert has_upper("aB") and not has_upper(r"\W\p{Lu}[[:upper:]]")
    assert required_literal("abc[0-9]+xyzw") == "xyzw" and required_literal("ab|cd") == "" and required_literal("abc?") == "ab" and required_literal("(?i)abc") == "" and required_literal(r"foo\.bar") == "foo.bar"
    assert split_alternatives("a|(b|c)|[|]") == ["a", "(b|c)", "[|]"]
    assert bre_to_ere(r"\(a\)+") == r"(a)\+"
    with pytest.raises(PatternError):
        compile_patterns(O(patterns=("(a",)))


@settings(max_examples=200, deadline=None)
@given(st.text("ab.c", min_size=1, max_size=6), st.text("abc\n", max_size=12))
def test_sure_literal_is_in_every_match(p, t):
    try:
        lit = required_literal(p)
        found = regex.search(p, t)
    except regex.error:
        return
    if found:
        assert lit in found[0]


def test_column_and_width():
    assert column_of("\t", 8) == 9 and column_of("ab\t", 8) == 9 and column_of("é", 8) == 2
    assert display_width("日本") == 4 and display_width("abc") == 3


def test_finder_places_match_python(spark):
    rng = random.Random(3)
    for _ in range(200):
        t = "".join(rng.choice("abé\n\t ") for _ in range(rng.randrange(30)))
        o = O(patterns=("[ab]+",))
        got = [(r["line_no"], r["byte_off"], r["match"]) for r in Finder(compile_patterns(o), o).records(t)]
        want = [(t.count("\n", 0, m.start()) + 1, len(t[: m.start()].encode()), m[0]) for m in re.finditer("[ab]+", t)]
        assert got == want


def test_first_is_longest_only_where_it_is():
    import itertools
    import random

    import regex

    from seekwell.functions.regex import first_is_longest

    assert all(first_is_longest(p) for p in [("thing",), ("th[aeio]ng",), ("[0-9]+@[a-z0-9]+",), ("idiot", "clown"), ("PRO(M|T)O",)])
    assert not any(first_is_longest(p) for p in [("a|ab",), ("a", "ab"), ("a?(ab)?",), ("a*ab*",), ("a+?",), ("[[:digit:]]+",)])
    rng = random.Random(5)
    texts = ["".join(t) for t in itertools.product("abc", repeat=5)]
    proven = 0
    for _ in range(400):
        atoms = [rng.choice(["a", "b", "c", "[ab]", "[^a]", "(a|b)", "(a|bc)", "(ab|a)", "."]) + rng.choice(["", "", "?", "*", "+", "{1,2}", "{2}"]) for _ in range(rng.randrange(1, 4))]
        p = tuple("".join(atoms).split("#")) if rng.random() < 0.7 else (atoms[0], "".join(atoms))
        if first_is_longest(p):
            proven += 1
            one = "|".join(f"(?:{x})" for x in p)
            first, longest = regex.compile(one, regex.VERSION1), regex.compile(one, regex.VERSION1 | regex.POSIX)
            assert all([m.span() for m in first.finditer(t)] == [m.span() for m in longest.finditer(t)] for t in texts), p
    assert proven > 50


def test_alternatives_of_fixed_width_go_widest_first():
    import itertools
    import random

    import regex

    from seekwell.functions.regex import compile_patterns

    rng = random.Random(7)
    texts = ["".join(t) for t in itertools.product("abc", repeat=6)]
    for _ in range(150):
        made = ["|".join("".join(rng.choice(["a", "b", "c", "[ab]", "(a|b)", "a{2}", r"\Qb\E"]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 3))) for _ in range(rng.randrange(1, 4))]
        c = compile_patterns(O(patterns=tuple(made)))
        first, longest = regex.compile(c.jvm_longest.removeprefix("(?dUm)")), regex.compile("|".join(f"(?:{x})" for x in c.finder), regex.VERSION1 | regex.POSIX)
        assert all([m.span() for m in first.finditer(t)] == [m.span() for m in longest.finditer(t)] for t in texts), made
    assert not any(compile_patterns(o).jvm_longest for o in (O(patterns=("a|ab+",)), O(patterns=("a", "ab"), ignore_case=True), O(patterns=("a|ab  # c|d",), free_space=True)))
    assert not any(compile_patterns(O(patterns=p)).ordered for p in (("a?", "ab"), (r"\w", "ab"), ("th(e|ere)",)))
