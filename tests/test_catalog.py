import re

import duckdb
import pytest

import samples
from keysift.catalog import PATTERNS, SEVERITIES, Pattern, custom_pattern, leading_text
from keysift.operators.match import find_matches
from keysift.remediation import template_for, templates

BY_NAME = {p.name: p for p in PATTERNS}


def test_names_are_unique_and_severities_known():
    assert len(BY_NAME) == len(PATTERNS) == 35
    assert {p.severity for p in PATTERNS} <= set(SEVERITIES)


@pytest.mark.parametrize("name", sorted(BY_NAME))
def test_sample_and_near_miss_in_python_and_duckdb(name):
    pattern = BY_NAME[name]
    secret = samples.POSITIVE[name][1]

    def python(text):
        return [m.group(pattern.group) for m in re.finditer(pattern.regex, text)]

    def duck(text):
        return duckdb.execute(
            f"SELECT regexp_extract_all(?, ?, {pattern.group})", [text, pattern.regex]
        ).fetchall()[0][0]

    assert python(samples.line(name)) == duck(samples.line(name)) == [secret]
    assert python(samples.near_miss(name)) == duck(samples.near_miss(name)) == []


def test_spark_finds_every_sample_and_no_near_miss(files):
    rows = [("r", f"hit/{n}", "first\n" + samples.line(n) + "\nlast") for n in BY_NAME]
    rows += [("r", f"miss/{n}", samples.near_miss(n)) for n in BY_NAME]
    found = find_matches(files(*rows)).collect()
    own = {(m["path"], m["secret"], m["line"]) for m in found
           if m["path"].endswith("/" + m["pattern"])}
    assert own == {(f"hit/{n}", samples.POSITIVE[n][1], 2) for n in BY_NAME}


def test_prefilter_never_drops_a_match(files):
    noise = ["", "plain words", "token: short", "SK_ SG. sk- key- xox eyJ", "a_b-c/d\"e"]
    rows = [("r", n, "\n".join([*noise, samples.line(n).upper(), samples.line(n), *noise,
                                samples.line(n) + " " + samples.line(n)])) for n in BY_NAME]
    custom = [custom_pattern("ANCHORED", "^plain"), custom_pattern("AT", "[a-z]@[a-z]", hints=("@",))]
    with_it = find_matches(files(*rows), custom).collect()
    without = find_matches(files(*rows), custom, use_prefilter=False).collect()
    assert sorted(map(tuple, with_it)) == sorted(map(tuple, without))
    assert len(with_it) > 2 * len(BY_NAME)


def test_every_match_holds_a_hint():
    for pattern in PATTERNS:
        assert pattern.hints or pattern.shape
        text = samples.line(pattern.name)
        if pattern.shape:
            assert re.search(pattern.shape, text)
        elif pattern.ignore_case:
            assert any(h in text.lower() for h in pattern.hints) and re.search("[:=]", text)
            assert all(re.fullmatch("[a-z_-]+", h) for h in pattern.hints)
        else:
            assert any(h in text for h in pattern.hints)


@pytest.mark.parametrize("regex,beginning", [
    ("hq-deploy_[a-f0-9]{12}", "hq-deploy_"), ("abc?d", "ab"), ("abc*", "ab"),
    ("abcd{0,2}x", "abc"), ("abc+", "abc"), ("abc|xyz", ""), ("(?i)abc", ""), ("[ab]cde", ""),
    ("^abc", ""), ("abc\\.def", "abc"), ("abc(d|e)", ""), ("it's", "it"), ("abc.d", "abc"),
])
def test_beginning_of_a_user_regex(regex, beginning):
    assert leading_text(regex) == beginning
    assert custom_pattern("X", regex).hints == ((beginning,) if len(beginning) > 2 else ())


def test_user_regex_with_a_beginning_loses_nothing(files):
    custom = [custom_pattern(None, r) for r in ("abcd?e", "key-[0-9]{3}", "xyz+", "ab|cd")]
    df = files(("r", "a", "abce abcde\nkey-123\nxy xyzz\nab cd"), ("r", "b", "plain\nKEY-123"))
    found = find_matches(df, custom, builtin=()).collect()
    assert sorted((r["line"], r["secret"]) for r in found) == [
        (1, "ab"), (1, "ab"), (1, "abcde"), (1, "abce"), (1, "cd"), (2, "key-123"), (3, "xyzz"),
        (4, "ab"), (4, "cd")]


def test_hint_with_quote_is_refused():
    with pytest.raises(ValueError):
        Pattern("X", "LOW", "c", "a", hints=("it's",))
    with pytest.raises(ValueError):
        Pattern("X", "LOW", "c", "a", hints=("a\\",))


def test_one_template_per_pattern():
    rows = templates()
    assert len({r[0] for r in rows}) == len(rows) == len(PATTERNS)
    aws = template_for("AWS_ACCESS_KEY_ID")
    assert aws.rotation_command == "aws iam create-access-key --user-name USERNAME"
    assert len(aws.immediate_actions) == 5 and len(aws.prevention) == 3


@pytest.mark.parametrize("name", [
    "SLACK_WEBHOOK", "FIREBASE_GOOGLE_API_KEY", "NEW_RELIC_KEY", "PAYPAL_BRAINTREE_TOKEN",
    "SENDGRID_API_KEY", "SENTRY_DSN"])
def test_values_longer_than_usual_are_whole(name):
    pattern, usual = BY_NAME[name], samples.POSITIVE[name][1]
    long = usual + "7" * 30
    assert [m.group(pattern.group) for m in re.finditer(pattern.regex, long)] == [long]
