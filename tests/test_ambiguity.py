"""What the guard says of user patterns, and the texts that every match must hold."""

import itertools
import re
import time

import pytest

from keysift import catalog
from keysift.functions.ambiguity import judge
from keysift.functions.regex_tree import required_literals
from keysift.operators.match import find_matches
from keysift.sources import patterns

EXPONENTIAL = ["(a+)+b", "((a+))+b", "(a|a)*b", "(a|aa)*b", "(a*)*b", "(a?b?)*c", "(a{0,3})*b",
               r"([a-z]+\.?)+@", "(x+x+)+y", r"^(([a-z])+.)+[A-Z]([a-z])+$", "(?:a|b|ab)*c", "(.*)*x",
               r"(\w+\d*)+;", "(?i)(a|A)+b", "((ab)*(ab)*)*c", "(?:ñ|ñ)+x", "(a*|b*)*c", "(a+){2,}b"]
POLYNOMIAL = [("a*a*a*b", 2), ("a*a*a*a*a*b", 4), (".*a.*b.*c.*d", 3), (r"\s*,?\s*,?\s*x", 2),
              ("ñ+ñ+ñ+x", 2), ("(a*){4}b", 3), ("(.*)(.*)(.*)[^a]", 2), ("a{2,}a{2,}a{2,}b", 2)]
HARMLESS = ["a*a*b", ".*foo.*bar", "([a-z]?)+9", "(a?){24}a{24}", "(ab+c)+d", r"([a-z]+\.)*[a-z]+@",
            "[0-9]{3}-[0-9]{4}", r"[\w.]+@[\w.]+", "(a|b)*c", "(?:x*y){2,}", "(ab)+c", r"(\(a\+)+",
            "([+*|]x)+", "[(a+]+", "((ab)c)*", "a{0,400}b", "(?=a+)b", r"\Qa+(\E+b", "[^\\]x]+]", "",
            "[a-f&&[^c]]+c", "x++y", r"\x41+B", "(?<name>a|b)+", "a|b|", "[[a][b]]+c"]


@pytest.mark.parametrize("regex", EXPONENTIAL)
def test_exponential(regex):
    found = judge(regex)
    assert (found.accepted, found.kind, found.power) == (False, "exponential", None)
    # The given text keeps an engine busy for longer with every further turn.
    pump = found.bad_input
    assert len(pump) > 30


@pytest.mark.parametrize("regex,power", POLYNOMIAL)
def test_polynomial(regex, power):
    found = judge(regex)
    assert (found.accepted, found.kind, found.power) == (False, "polynomial", power)
    assert found.bad_input and judge(regex, most_power=power).accepted


@pytest.mark.parametrize("regex", HARMLESS)
def test_harmless(regex):
    assert judge(regex).accepted, judge(regex)


def test_built_in_patterns_are_accepted():
    for pattern in catalog.PATTERNS:
        assert judge(pattern.regex).accepted, pattern.name
        assert judge(pattern.redaction_regex).accepted, pattern.name


@pytest.mark.parametrize("regex", [r"(a)\1", "[a-", "(a", "a)", "a{2,1}", "*a", r"\p{Nonsense}", r"(?x)a b",
                                   r"\x{zz}"])
def test_what_cannot_be_read_is_refused(regex):
    found = judge(regex)
    assert (found.accepted, found.kind) == (False, "unreadable")


def test_size_is_bounded():
    began = time.time()
    assert judge("(" * 240 + "a" + ")" * 240).kind in ("linear", "too large")
    assert judge("(a{0,90}b{0,90}c{0,90}){0,90}d").kind == "too large"
    assert judge("([a-z]{0,300}x)*[a-z]{0,100}y").kind in ("exponential", "too large")
    assert time.time() - began < 30


@pytest.mark.parametrize("regex", [r for r in EXPONENTIAL if "(?i)" not in r][:10])
def test_the_bad_input_is_bad(regex):
    """Steps of an engine, as time: it more than doubles with four more turns."""
    found = judge(regex)
    pump = found.bad_input
    # The part that is repeated thirty times.
    unit = next(pump[i:i + n] for n in range(1, 4) for i in range(3) if pump[i:i + 30 * n] ==
                pump[i:i + n] * 30)
    end = pump[-1]

    def seconds(turns):
        best = 9.0
        for _ in range(2):
            began = time.perf_counter()
            re.match(regex, unit * turns + end)
            best = min(best, time.perf_counter() - began)
        return best

    turns = 6
    while seconds(turns) < 0.002 and turns < 60:
        turns += 1
    assert seconds(turns + 3) > 2 * seconds(turns)


def test_verdicts_of_the_engine_and_the_automaton(spark):
    for regex, reason in [("(a+)+b", "nested quantifiers"), ("([", "does not compile"), ("x" * 501, "too long"),
                          ("a*a*a*a*a*b", "5 repetitions can read the same text"),
                          ("(a?b?)*c", "repeats in exponentially many ways"),
                          (r"(a)\1", "not understood: a back reference"), ("ok[a-z]+", None)]:
        assert patterns.verdict(spark, regex).reason == reason


@pytest.mark.parametrize("regex,literals", [
    ("[a-z]+_key_[0-9]+", ("_key_",)), ("(?:alpha|beta)[0-9]", ("alpha", "beta")), ("[0-9]+", ()),
    ("x(?:secret)?y+", ("y",)), ("(abc){2}d", ("abcabcd",)), ("(abc)+d", ("abc",)), ("(abc)*d", ("d",)),
    ("a[bc]d", ("abd", "acd")), ("(foo|[0-9])bar", ("bar",)), (r"\Qa.b\E+[0-9]", ("a.b",)), ("", ()),
    ("(?=long_text)ab", ("ab",)), ("[^a]bc", ("bc",)), (r"(a)\1", ()), ("ab|[0-9]", ()),
    ("[0-9]{3}-[a-z]{2}::x", ("::x",)), ("ab?cde", ("abcde", "acde"))])
def test_required_literals(regex, literals):
    assert required_literals(regex) == literals


def test_every_match_holds_a_required_literal():
    letters = ["a", "b", "[ab]", "(a|bb)", "a?", "(ab)*", "(ba){2}", "."]
    texts = ["".join(x) for n in range(7) for x in itertools.product("ab", repeat=n)]
    for parts in itertools.product(letters, repeat=3):
        regex = "".join(parts)
        literals = required_literals(regex)
        for text in texts:
            found = re.search(regex, text)
            assert not found or not literals or any(x in found[0] for x in literals), (regex, text)


def test_inner_literals_find_the_same(spark, files):
    rows = [("r", f"p{i}", f"line {i}\nuser{i % 7}_key_{i}\nnothing\nx{i % 5}-mark-{'z' * (i % 4)}")
            for i in range(60)]
    regexes = [f"[a-z]+{i}_key_[0-9]+" for i in range(7)] + [
        f"x{i}(-mark-|-none-)z+" for i in range(5)] + ["[0-9]+$"]
    custom = [catalog.custom_pattern(f"K{i}", r, hints=catalog.literal_hints(r))
              for i, r in enumerate(regexes)]
    assert custom[0].hints == ("0_key_",) and not custom[-1].hints
    found = [sorted(map(tuple, find_matches(files(*rows), custom, (), use_prefilter=x).collect()))
             for x in (True, False)]
    assert found[0] == found[1] and found[0]
