import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import samples
from keysift.functions import scoring
from keysift.operators.findings import assess
from keysift.operators.match import find_matches
from keysift.options import BASE_SCORES, ScanOptions
from keysift.plans.scan import detect

OPTIONS = ScanOptions()


def entropy(text):
    n = len(text)
    return round(abs(sum(c / n * math.log2(c / n) for c in Counter(text).values())), 4)


def test_entropy_equals_the_formula(spark):
    rng = random.Random(7)
    texts = ["a", "aaaa", "ab", samples.ALNUM, samples.HEX[:40], "naïve-ключ", "a b\tc\n"]
    texts += ["".join(rng.choices(samples.ALNUM, k=rng.randint(1, 90))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    for row in df.select("t", scoring.shannon_entropy(F.col("t")).alias("e")).collect():
        assert row["e"] == pytest.approx(entropy(row["t"]), abs=1.01e-4)
        assert row["e"] <= math.log2(len(row["t"])) + 1e-4
        assert math.copysign(1, row["e"]) == 1


def test_entropy_of_nothing_is_zero(spark):
    row = spark.range(1).select(scoring.shannon_entropy(F.lit("")).alias("e")).first()
    assert row["e"] == 0.0


def test_score_over_all_combinations(spark):
    rows = [(s, e, t, d) for s in BASE_SCORES for e in (2.9, 3.0, 4.5, 4.6)
            for t in (True, False) for d in (True, False)]
    df = spark.createDataFrame(rows, "s STRING, e DOUBLE, t BOOLEAN, d BOOLEAN")
    base = F.create_map(*[F.lit(x) for kv in BASE_SCORES.items() for x in kv])[F.col("s")]
    score = scoring.risk_score(base, F.col("e"), F.col("t"), F.col("d"), OPTIONS)
    got = df.select("*", score.alias("score"), scoring.risk_level(score, OPTIONS).alias("level"),
                    scoring.classification(score, OPTIONS).alias("label"))
    for r in got.collect():
        want = BASE_SCORES[r["s"]] + (10 if r["e"] > 4.5 else 0) - (30 if r["e"] < 3 else 0) \
            - 30 * r["t"] - 60 * r["d"]
        want = max(0, min(100, want))
        assert r["score"] == want
        assert r["level"] == ("high" if want >= 80 else "medium" if want >= 50 else "low")
        assert r["label"] == ("likely_secret" if want >= 80 else
                              "possible_secret" if want >= 50 else "likely_false_positive")


@pytest.mark.parametrize("path,expected", [
    ("tests/a.py", True), ("src/test/a.py", True), ("docs", True), ("a/Docs/x", True),
    ("src/latest/a.py", False), ("contest.py", False), ("a/examples/b", True), ("src/a", False),
])
def test_context_path(spark, path, expected):
    assert spark.range(1).select(
        scoring.is_context_path(F.lit(path), OPTIONS).alias("x")).first()["x"] is expected


def test_critical_key_scores_ninety(files):
    row = detect(files(("org/one", "src/config.py", "\n" * 41 + samples.line("AWS_ACCESS_KEY_ID")))
                 ).first()
    secret = samples.POSITIVE["AWS_ACCESS_KEY_ID"][1]
    assert (row["line"], row["score"], row["classification"]) == (42, 90, "likely_secret")
    assert row["match_preview"] == "AKIA..."
    assert row["secret_hash"] == hashlib.sha256(secret.encode()).hexdigest()


def test_context_and_denylist_are_clamped_at_zero(files):
    fake = "password = your_" + samples.HEX[:20]
    rows = detect(files(("r", "src/a", fake), ("r", "tests/a", fake))).collect()
    assert {(r["path"], r["score"], r["is_denylisted"]) for r in rows} == {
        ("src/a", 0, True), ("tests/a", 0, True)}
    strict = detect(files(("r", "tests/a", fake)), OPTIONS.with_(denylist=())).first()
    assert strict["score"] == 30 and not strict["is_denylisted"]


def test_short_secrets_are_hidden_whole(spark):
    df = spark.createDataFrame([("1234567",), ("12345678",)], "s STRING")
    assert [r[0] for r in df.select(scoring.match_preview(F.col("s"))).collect()] == [
        "***", "1234..."]


@pytest.mark.parametrize("rows", [0, 1000])
def test_known_fakes_join(spark, files, monkeypatch, rows):
    monkeypatch.setattr("keysift.session.BROADCAST_ROWS", rows)
    key, other = samples.line("NPM_TOKEN"), samples.line("GITLAB_PAT")
    found = find_matches(files(("r", "a", key), ("r", "b", other)))
    fakes = spark.createDataFrame([(key.lower(),), (key.lower(),)], "secret STRING")
    rows = assess(found, OPTIONS, fakes).collect()
    assert {(r["path"], r["is_denylisted"]) for r in rows} == {("a", True), ("b", False)}


def test_no_column_holds_the_secret(files):
    rows = [("r", n, samples.line(n)) for n in samples.POSITIVE]
    for r in detect(files(*rows)).collect():
        secret = samples.POSITIVE[r["path"]][1]
        assert not any(secret in str(v) for v in r)
