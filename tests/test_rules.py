import fnmatch
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from govlens import contract, providers
from govlens.functions.rules import RuleBook, classify, glob_match, glob_to_regex
from govlens.plans import quality
from govlens.providers import Provider, register_provider
from govlens.sources.bridge import EVENT_TYPES

NAMES = [
    *EVENT_TYPES,
    "access_denied",
    "x_rejected",
    "ip_blocked",
    "USER_SIGNED_OUT",
    "claude_code_a.b_updated",
    "claude_code_x_updated_late",
    "data_exported",
    "org_data_export_requested",
    "conversation_deleted",
    "profile_viewed",
    "file",
    "projects",
]


def first_match(name, rules, default):
    return next((v for p, v in rules if fnmatch.fnmatchcase(name, p)), default) if name else default


@pytest.mark.parametrize("kind", ["category", "action", "resource", "outcome"])
def test_classify_takes_the_first_matching_rule(spark, kind):
    rules = providers.DEFAULT_RULES
    df = spark.createDataFrame([(n,) for n in [*NAMES, ""]], "name string")
    got = dict(df.select("name", classify("name", rules, kind)).collect())
    for name in [*NAMES, ""]:
        assert got[name] == first_match(name, getattr(rules, kind), rules.default(kind)), name


def test_order_decides_between_rules():
    rules = providers.DEFAULT_RULES
    assert first_match("org_data_export_started", rules.action, "") == "export"
    assert first_match("compliance_api_accessed", rules.category, "") == "data_export"


GLOBS = st.text(alphabet="ab.*?[!]^-\\$'", min_size=0, max_size=6)
TEXTS = st.text(alphabet="ab.*[]!^-\\$'\n", min_size=0, max_size=5)


@settings(max_examples=400, deadline=None)
@given(GLOBS, TEXTS)
def test_glob_regex_agrees_with_shell_globs(pattern, text):
    import re

    regex = glob_to_regex(pattern).replace(r"\A", "").replace(r"\z", "")
    try:
        ours = re.fullmatch(regex, text) is not None
    except re.error:  # a reversed range, which a shell glob takes as empty
        return
    assert ours == fnmatch.fnmatchcase(text, pattern)


def test_glob_tests_on_spark(spark):
    patterns = ["*", "a*", "*a", "*a*", "a", "a?c", "[ab]*", "[!a]*", "a'b*", "a.b", "a*c", "**a"]
    texts = ["a", "abc", "ba", "xay", "a'bz", "a.b", "axb", "b", "ac"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", *[glob_match("t", p).alias(f"p{i}") for i, p in enumerate(patterns)])
    for row in rows.collect():
        for i, pattern in enumerate(patterns):
            assert row[f"p{i}"] == fnmatch.fnmatchcase(row.t, pattern), (row.t, pattern)


def test_rule_file_outside_the_vocabulary_is_refused(tmp_path, spark):
    path = tmp_path / "rules.json"
    path.write_text(
        json.dumps(
            {
                "version": 1,
                "vendor": "google",
                "category_rules": [["a*", "nonsense"]],
                "default_category": "usage",
            }
        )
    )
    rules = RuleBook.load(str(path))
    assert rules.problems() == ["category 'nonsense'"]
    with pytest.raises(ValueError, match="nonsense"):
        register_provider(Provider("google", "suite", rules))
    assert quality.rule_problems(spark, rules, "google").count() == 1
    assert quality.rule_problems(spark, providers.DEFAULT_RULES, "google").count() == 1
    assert quality.rule_problems(spark, providers.DEFAULT_RULES, providers.VENDOR).count() == 0


def test_provider_needs_its_own_rules():
    with pytest.raises(ValueError, match="another|rules are for"):
        register_provider(Provider("google", "suite", providers.DEFAULT_RULES))


def test_every_record_but_activity_has_a_category(spark):
    assert set(contract.RECORDS) - {contract.ACTIVITY} == set(contract.RECORD_CATEGORY)
    assert quality.category_map_gaps(spark).count() == 0


def test_shared_reports_name_no_vendor():
    import pathlib

    import govlens

    root = pathlib.Path(govlens.__file__).parent
    for module in ("overview", "security", "tokenomics", "health"):
        text = (root / "plans" / "reports" / f"{module}.py").read_text().lower()
        assert providers.VENDOR not in text, module
        assert providers.PRODUCT.split("_")[0] not in text, module


def test_no_nulls_for_missing_names(spark):
    df = spark.createDataFrame([(None,)], "name string")
    row = df.select(classify("coalesce(name, '')", providers.DEFAULT_RULES, "action")).first()
    assert row[0] == "unknown"
    assert df.where(F.col("name").isNull()).count() == 1


@pytest.mark.parametrize(
    "value, pattern, matches",
    [("xa", "[!x]a", False), ("ya", "[!x]a", True), ("xa", "[xy]a", True), ("za", "[x-y]a", False),
     ("a?b", "a[?]b", True), ("axb", "a[?]b", False), ("a*b", "a[*]b", True), ("abc", "a*", True),
     ("a\nb", "a?b", True), ("a.b", "a.b", True), ("axb", "a.b", False), ("[a", "[a", True),
     ("^a", "[^]a", True), ("xa", "[^]a", False), ("]a", "[]]a", True), ("ba", "[!]]a", True),
     ("a", "", False), ("", "", True), ("x{2}", "x{2}", True), ("é_1", "?_[0-9]", True),
     ("x_a_y", "*_a_*", True)],
)
def test_sql_glob_is_the_rules_glob(spark, value, pattern, matches):
    import fnmatch
    import re

    from govlens.functions import sql

    assert bool(re.match(fnmatch.translate(pattern), value)) == matches
    sql.register(spark)
    df = spark.createDataFrame([(value, pattern)], "v string, p string")
    assert df.selectExpr("glob_match(v, p)").first()[0] == matches


def test_a_provider_may_name_its_own_fields(spark, tmp_path):
    import dataclasses
    import json

    from govlens.plans.normalize import normalize
    from govlens.sources import feeds

    vendor = dataclasses.replace(providers.provider(providers.VENDOR), chat_field="thread", file_field="blob")
    path = tmp_path / "own.jsonl"
    path.write_text(json.dumps({"id": "1", "type": "claude_chat_created", "thread": "t7", "created_at": "2026-01-01"}))
    for schema in (None, "id string, type string, thread string, created_at string"):
        feed = feeds.read_feed(spark, str(path), "activity", schema)
        row = normalize(feed, "activity", vendor, "2026-01-02").select("ai.resource.id").first()
        assert row[0] == "t7"
