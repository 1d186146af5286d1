"""Data-driven classification: ordered glob rules compiled to one CASE expression."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govlens import contract
from govlens.functions.values import quote

# The result where no rule matches.
DEFAULTS = {
    "category": "usage",
    "action": "unknown",
    "resource": "other",
    "outcome": "success",
}
VOCABULARY = {
    "category": contract.CATEGORIES,
    "action": contract.ACTIONS,
    "resource": contract.RESOURCE_TYPES,
    "outcome": contract.OUTCOMES,
}

Rules = tuple[tuple[str, str], ...]


def glob_to_regex(pattern: str) -> str:
    """A regex for a whole-string, case-sensitive glob with * ? [seq] [!seq]."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        i += 1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[" and (end := pattern.find("]", i + 1 + (pattern[i : i + 1] == "!"))) > 0:
            body, i = pattern[i:end], end + 1
            negate, body = body.startswith("!"), body.removeprefix("!")
            body = re.sub(r"([\\\[\]^&~])", r"\\\1", body)
            out.append(f"[{'^' if negate else ''}{body}]")
        else:
            out.append(re.sub(r"([^A-Za-z0-9_])", r"\\\1", ch))
    return "(?s)\\A" + "".join(out) + "\\z"


def glob_test(column: str, pattern: str) -> str:
    """SQL that matches a glob with the cheapest string test that decides it."""
    core = pattern.strip("*")
    if not core:
        return f"{column} IS NOT NULL" if pattern else f"{column} = ''"
    if re.search(r"[*?\[]", core):
        return f"rlike({column}, {quote(glob_to_regex(pattern))})"
    head, tail = not pattern.startswith("*"), not pattern.endswith("*")
    if head and tail:
        return f"{column} = {quote(core)}"
    test = "startswith" if head else "endswith" if tail else "contains"
    return f"{test}({column}, {quote(core)})"


def glob_match(column: str, pattern: str) -> Column:
    return F.expr(glob_test(column, pattern))


@dataclass(frozen=True)
class RuleBook:
    """One vendor's four ordered rule lists with their defaults."""

    vendor: str
    category: Rules
    action: Rules = ()
    resource: Rules = ()
    outcome: Rules = ()
    default_category: str = DEFAULTS["category"]
    default_action: str = DEFAULTS["action"]
    default_resource: str = DEFAULTS["resource"]
    default_outcome: str = DEFAULTS["outcome"]

    @classmethod
    def load(cls, path: str) -> RuleBook:
        """Read a JSON rule file: ``{kind}_rules`` lists and ``default_{kind}``."""
        with open(path, encoding="utf-8") as handle:
            data = json.load(handle)
        fields: dict = {"vendor": data["vendor"]}
        for kind in VOCABULARY:
            fields[kind] = tuple((p, v) for p, v in data.get(f"{kind}_rules", ()))
            if f"default_{kind}" in data:
                fields[f"default_{kind}"] = data[f"default_{kind}"]
        return cls(**fields)

    def default(self, kind: str) -> str:
        return getattr(self, f"default_{kind}")

    def problems(self) -> list[str]:
        """Values that lie outside the contract's vocabularies."""
        return [
            f"{kind} {value!r}"
            for kind, allowed in VOCABULARY.items()
            for value in [v for _, v in getattr(self, kind)] + [self.default(kind)]
            if value not in allowed
        ]

    def table(self, spark: SparkSession) -> DataFrame:
        """The rules as rows (kind, idx, pattern, value); idx -1 is the default."""
        rows = [
            (kind, idx, pattern, value)
            for kind in VOCABULARY
            for idx, (pattern, value) in enumerate(getattr(self, kind))
        ]
        rows += [(kind, -1, "", self.default(kind)) for kind in VOCABULARY]
        return spark.createDataFrame(rows, "kind string, idx int, pattern string, value string")


def choose(column: str, rules: Rules, results: dict[str, str], default: str) -> str:
    """SQL for the result that belongs to the value of the first matching rule.

    One CASE inside code generation: no join, no shuffle, no Python. Neighbouring
    rules with the same result share a branch; values without an entry in
    ``results`` give the default. The column is repeated in each test, so give a
    plain column, not an expression.
    """
    branches = [
        (" OR ".join(glob_test(column, pattern) for pattern, _ in run), results.get(value, default))
        for value, run in groupby(rules, key=lambda rule: rule[1])
    ]
    if not branches:
        return default
    return f"CASE {' '.join(f'WHEN {t} THEN {r}' for t, r in branches)} ELSE {default} END"


def classify_sql(column: str, rules: RuleBook, kind: str) -> str:
    listed = getattr(rules, kind)
    results = {value: quote(value) for _, value in listed}
    return choose(column, listed, results, quote(rules.default(kind)))


def classify(column: str, rules: RuleBook, kind: str) -> Column:
    """Value of the first rule whose glob matches, else the default."""
    return F.expr(classify_sql(column, rules, kind))


def matched_rule_sql(column: str, rules: RuleBook, kind: str) -> str:
    """Index of the rule that decides, -1 where the default does."""
    tests = [
        f"WHEN {glob_test(column, pattern)} THEN {idx}"
        for idx, (pattern, _) in enumerate(getattr(rules, kind))
    ]
    return f"CASE {' '.join(tests)} ELSE -1 END" if tests else "-1"


def rule_hits(events: DataFrame, rules: RuleBook) -> DataFrame:
    """Events per deciding rule, with rules that never fire at zero.

    Events are counted per name first, so that rules are tried once per distinct
    name and only counts reach the join. The rule table is the small, fixed side.
    """
    counts = events.groupBy(F.col("ai.event_type").alias("event_type")).agg(
        F.count("*").alias("n")
    )
    decided = ", ".join(
        f"named_struct('kind', '{kind}', 'idx', {matched_rule_sql('event_type', rules, kind)})"
        for kind in VOCABULARY
    )
    hits = (
        counts.select("n", F.expr(f"explode(array({decided}))").alias("d"))
        .groupBy("d.kind", "d.idx")
        .agg(F.sum("n").alias("events"))
    )
    table = rules.table(events.sparkSession)
    return table.join(hits, ["kind", "idx"], "left").fillna(0, ["events"])
