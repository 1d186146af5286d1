r"""Secret scan with corpus-wide ownership of what was found, in DataFrame functions only.

``scan`` finds candidate secrets in whole texts. A kind's matches are the pieces between
which ``split`` cuts the text, so their places follow from the lengths of the pieces:
no text is walked twice for a place and no Python is involved.

``ownership`` counts, for every candidate's hash, the distinct repositories and owners it
occurs in. A value that ``example_owners`` owners have is a widely copied example, and so is
one that two owners have in ``example_repos`` repositories or more; what a single owner has,
in however many repositories, or two owners in few, is live-looking. Counts are taken over distinct (hash, owner, repository)
first, so a value copied a billion times is one row per owner before anything meets.

``redact`` replaces the live-looking spans and leaves the examples.

Defined results: null text has no candidates. Rows with null owner or repository count as
one owner or repository of their own. Repeated rows keep their own results. Offsets are in
code points, end exclusive; a span is the whole match, its secret the value in it. Kinds
are matched apart, so spans of two kinds may overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlens.llm.common import staged

# Fixed patterns, in the order in which equal starts are listed. The first three are the
# base kinds; a value shorter than the given number of characters is dropped after matching.
KINDS = (
    (
        "assign",
        r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("vendor", r"(?:gh[pousr]_|xox[abprs]-|sk_live_|AIza)[A-Za-z0-9_-]{16,}", 0, 20),
    ("signed", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28),
    ("private", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]+", 0, 40),
)
BASE = 3
EXAMPLE_OWNERS = 3
EXAMPLE_REPOS = 8  # with two owners
BLOCK = 256

SPAN = "struct<start:int,kind_no:int,kind:string,end:int,hash:string>"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _blocks(items: Column) -> Column:
    """``items`` in runs of ``BLOCK``; none for an empty array."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(BLOCK))
    runs = F.transform(starts, lambda k: F.slice(items, k, BLOCK))
    return F.filter(runs, lambda run: F.size(run) > 0)


def _running(values: Column, step) -> Column:
    """Running totals of an array of int under ``step``: associative, with 0 for nothing.

    An array that grows by one is copied each time, so totals are taken within blocks, then
    over blocks: work grows with the length, not with its square.
    """

    def totals(run: Column) -> Column:
        return F.aggregate(
            run,
            F.lit([]).cast("array<int>"),
            lambda done, v: F.concat(done, F.array(step(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)), v))),
        )

    def whole(inner: Column) -> Column:
        ends = totals(F.transform(inner, lambda run: F.element_at(run, -1)))
        before = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))))
        return F.flatten(
            F.transform(
                F.arrays_zip(inner.alias("run"), F.slice(before, 1, F.size(inner)).alias("at")),
                lambda z: F.transform(z["run"], lambda v: step(z["at"], v)),
            )
        )

    return _bound(F.transform(_blocks(values), totals), whole)


def _found(text: Column, number: int) -> Column:
    """Spans of one kind, in order."""
    kind, pattern, group, least = KINDS[number]
    pieces = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    # gap, match, gap, match ...; the last gap has no match behind it
    matches = F.filter(
        F.arrays_zip(
            F.transform(pieces, F.char_length).alias("gap"),
            F.transform(whole, F.char_length).alias("size"),
            value.alias("value"),
        ),
        lambda m: m["size"].isNotNull(),
    )

    def placed(found: Column) -> Column:
        ends = _running(F.transform(found, lambda m: m["gap"] + m["size"]), lambda a, b: a + b)
        spans = F.transform(
            F.filter(
                F.arrays_zip(found.alias("match"), ends.alias("end")),
                lambda z: F.char_length(z["match"]["value"]) >= least,
            ),
            lambda z: F.struct(
                (z["end"] - z["match"]["size"]).alias("start"),
                F.lit(number).alias("kind_no"),
                F.lit(kind).alias("kind"),
                z["end"].alias("end"),
                F.sha2(z["match"]["value"].cast("binary"), 256).alias("hash"),
            ),
        )
        return spans.cast(f"array<{SPAN}>")

    # most texts have no match: one look, no pieces
    return F.when(F.coalesce(text, F.lit("")).rlike(pattern), _bound(matches, placed)).otherwise(
        F.lit([]).cast(f"array<{SPAN}>")
    )


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: spans of all kinds by start, then kind as listed."""
    spans = F.concat(*[_found(F.col(text_col), k) for k in range(len(KINDS))])
    return docs.withColumn("secrets", F.array_sort(spans))


def ownership(
    found: DataFrame,
    owner_col: str = "source",
    repo_col: str = "doc_id",
    example_owners: int = EXAMPLE_OWNERS,
    example_repos: int = EXAMPLE_REPOS,
) -> DataFrame:
    """hash, n_owners, n_repos, example for every distinct candidate of ``found``."""
    none = F.lit("\0null")
    # distinct pairs first: what shuffles by hash alone is at most one row per owner or repository
    seen = (
        found.where(F.size("secrets") > 0)
        .select(
            F.explode(F.col("secrets")["hash"]).alias("hash"),
            F.coalesce(F.col(owner_col).cast("string"), none).alias("owner"),
            F.coalesce(F.col(repo_col).cast("string"), none).alias("repo"),
        )
        .groupBy("hash", "owner", "repo")
        .agg(F.count("*").alias("n"))
    )
    # hot values combine before they meet: one row per value and repository, or owner
    by_repo = seen.select("hash", "repo").distinct()
    by_owner = seen.select("hash", "owner").distinct()
    owners = by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"))
    repos = by_repo.groupBy("hash").agg(F.count("*").alias("n_repos"))
    example = (F.col("n_owners") >= example_owners) | (
        (F.col("n_owners") >= 2) & (F.col("n_repos") >= example_repos)
    )
    return owners.join(repos, "hash").withColumn("example", example)


def verdicts(
    found: DataFrame,
    key: str,
    owner_col: str = "source",
    repo_col: str = "doc_id",
    example_owners: int = EXAMPLE_OWNERS,
    example_repos: int = EXAMPLE_REPOS,
) -> DataFrame:
    """Per row of ``found`` with candidates, by its unique ``key``: live, a list of the spans
    that look live, n_live, n_example, and the most owners and repositories of a candidate."""
    owned = ownership(found, owner_col, repo_col, example_owners, example_repos)
    spans = found.where(F.size("secrets") > 0).select(
        F.col(key), F.explode("secrets").alias("span")
    )
    return (
        spans.withColumn("hash", F.col("span")["hash"])
        .join(owned, "hash")
        .groupBy(key)
        .agg(
            F.sort_array(F.collect_list(F.when(~F.col("example"), F.col("span")))).alias("live"),
            F.count(F.when(~F.col("example"), 1)).alias("n_live"),
            F.count(F.when(F.col("example"), 1)).alias("n_example"),
            F.max("n_owners").alias("max_owners"),
            F.max("n_repos").alias("max_repos"),
        )
    )


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each run of overlapping spans (by start) replaced by a mark of its first kind.

    Text between marks is cut out of a block's part of the text, not of the whole, because
    the way to a place is counted from the beginning.
    """
    size = F.size(spans)

    def cut(reached: Column) -> Column:
        # where the text has been copied or replaced before each span
        before = F.slice(F.concat(F.array(F.lit(0)), reached), 1, size)
        firsts = F.filter(
            F.arrays_zip(spans.alias("span"), before.alias("from")),
            lambda z: z["span"]["start"] >= z["from"],
        )

        def block(run: Column) -> Column:
            at = F.element_at(run, 1)["from"]
            part = F.substring(text, at + 1, F.element_at(run, -1)["span"]["start"] - at)
            return _bound(
                part,
                lambda p: F.array_join(
                    F.transform(
                        run,
                        lambda z: F.concat(
                            F.substring(p, z["from"] - at + 1, z["span"]["start"] - z["from"]),
                            F.lit("[secret:"),
                            z["span"]["kind"],
                            F.lit("]"),
                        ),
                    ),
                    "",
                ),
            )

        marked = F.array_join(F.transform(_blocks(firsts), block), "")
        return F.concat(
            marked, F.substring(text, F.element_at(reached, -1) + 1, F.char_length(text))
        )

    ends = _running(F.transform(spans, lambda s: s["end"]), F.greatest)
    return F.when(size > 0, _bound(ends, cut)).otherwise(text)


def redact(docs: DataFrame, owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """``docs`` with live-looking secrets replaced in ``text`` and ``n_chars`` to match.

    Texts without candidates, and all other columns, are left as they are.
    """
    names = docs.columns
    found = staged(
        scan(docs).withColumn("__row", F.monotonically_increasing_id()), "secrets"
    )
    live = verdicts(found, "__row", owner_col, repo_col).where(F.col("n_live") > 0)
    changed = (
        found.where(F.size("secrets") > 0)
        .join(live, "__row", "left")
        .withColumn(
            "text",
            F.when(F.col("live").isNotNull(), redacted(F.col("text"), F.col("live"))).otherwise(
                F.col("text")
            ),
        )
        .withColumn(
            "n_chars",
            F.when(F.col("live").isNotNull(), F.char_length("text").cast("long")).otherwise(
                F.col("n_chars")
            ),
        )
    )
    return found.where(F.size("secrets") == 0).select(names).unionByName(changed.select(names))


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def report(docs: DataFrame) -> DataFrame:
    """Every document's candidates and how many of them look live."""
    found = staged(
        scan(docs.select("doc_id", "source", "text"))
        .drop("text")
        .withColumn("row", F.monotonically_increasing_id()),
        "secrets",
    )
    judged = verdicts(found, "row").drop("live")
    base = F.filter("secrets", lambda s: s["kind_no"] < BASE)

    def number(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")

    return found.join(judged, "row", "left").select(
        "doc_id",
        number("assign").alias("n_assign"),
        number("access").alias("n_access"),
        number("hex").alias("n_hex"),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("secrets")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"),
        F.coalesce("max_owners", F.lit(0)).cast("long").alias("max_owners"),
        F.coalesce("max_repos", F.lit(0)).cast("long").alias("max_repos"),
    )
