"""Secret scans by a trigram inverted index: Boolean trigram queries from the rules, postings, verified candidates.

Everything runs as DataFrame functions; only the rules themselves, a fixed short list, are looked at on the driver.
"""

from __future__ import annotations

import re
import re._parser as regex
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, stored


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of `pattern`, leftmost and not overlapping, whose `group` has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The three base kinds, in the order in which spans at one start are listed.
BASE = (
    Rule("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
# Public token formats that the method adds to the base kinds.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abp]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE
MASK = "[SECRET]"
#: Literal strings followed at once while a query is derived; beyond that the run of literals ends.
FAN = 64


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """The trigrams that every match must have: an AND of ORs of ANDs, in lower case; [] if there are none.

    Runs of literals, small character sets, options and alternatives of the parsed pattern become sets of strings;
    each set that has three characters or more in all its strings gives one OR over the strings' trigrams.
    """
    clauses: list[list[frozenset[str]]] = []

    def end(run: set[str]) -> set[str]:
        if all(len(s) >= 3 for s in run):
            grams = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
            clauses.append(sorted((g for g in grams if not any(h < g for h in grams)), key=sorted))
        return {""}

    def strings(tree) -> set[str] | None:
        """All strings that the tree matches, or None if there are too many to list."""
        run = {""}
        for op, arg in tree:
            more = part(op, arg)
            if more is None or len(run) * len(more) > FAN:
                return None
            run = {a + b for a in run for b in more}
        return run

    def part(op, arg) -> set[str] | None:
        name = str(op)
        if name == "LITERAL":
            return {chr(arg).lower()}
        if name == "IN" and len(arg) <= 6 and all(str(o) == "LITERAL" for o, _ in arg):
            return {chr(a).lower() for _, a in arg}
        if name == "SUBPATTERN":
            return strings(arg[3])
        if name == "BRANCH":
            found = [strings(x) for x in arg[1]]
            return None if any(x is None for x in found) else set().union(*found)
        if name == "MAX_REPEAT" and arg[1] <= 5 and (one := strings(arg[2])) is not None:
            out, power = ({""} if arg[0] == 0 else set()), {""}
            for k in range(1, int(arg[1]) + 1):
                power = {a + b for a in power for b in one}
                out |= power if k >= arg[0] else set()
            return out if len(out) <= FAN else None
        return None

    run = {""}
    for op, arg in regex.parse(pattern):
        more = part(op, arg)
        if more is None:
            run = end(run)
        elif len(run) * len(more) > FAN:
            end(run)
            run = more
        else:
            run = {a + b for a in run for b in more}
    end(run)
    return clauses


def _key() -> Column:
    """Names a row: doc_id, or a hash of the text where that is null, so that rows without an id do not meet."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted index (trigram, key): every trigram of some rule's query and the documents that hold it.

    Trigrams that no rule asks for are never looked up, so they get no postings.
    """
    grams = sorted({g for r in rules for clause in trigram_query(r.pattern) for option in clause for g in option})
    text = docs.select(_key().alias("key"), ascii_lower(F.col("text")).alias("low"))
    held = F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(F.col("low"), g))
    return text.select(F.explode(held).alias("trigram"), "key")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, kinds): the rules that a document can match, from the postings of its trigrams.

    The rules' queries, a fixed table of (trigram, rule, clause, option), meet the postings by trigram. An
    option holds for the keys that all its trigrams' postings have in common, a clause for the keys of any of its
    options, and a rule for those of all its clauses. Several documents of one key share their postings; that can only
    add candidates.
    """
    asked = [(g, r.kind, c, o, len(option), len(query)) for r in rules for query in [trigram_query(r.pattern)] for c, clause in enumerate(query) for o, option in enumerate(clause) for g in sorted(option)]
    names = ("trigram", "kind", "clause", "option", "grams", "clauses")
    rows = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(names, row))) for row in asked))
    table = index.sparkSession.range(1).select(F.inline(rows))
    met = index.join(F.broadcast(table), "trigram").groupBy("key", "kind", "clauses", "clause", "option", "grams").agg(F.count_distinct("trigram").alias("n"))
    held = met.where("n = grams").groupBy("key", "kind", "clauses").agg(F.count_distinct("clause").alias("n")).where("n = clauses")
    return held.groupBy("key").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def _spans(rule: Rule, order: int) -> Column:
    """Spans (start, order, kind, end) in code points, from the matches `found`, what stands between, and `sized`."""
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("at"),
        F.when(
            F.length(x["size"]) >= rule.least,
            F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["gap"])).alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end")))),
        )
        .otherwise(acc["out"])
        .alias("out"),
    )
    none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")
    rows = F.arrays_zip(F.slice(f"gaps_{rule.kind}", 1, F.size(f"found_{rule.kind}")).alias("gap"), F.col(f"found_{rule.kind}").alias("hit"), F.col(f"sized_{rule.kind}").alias("size"))
    folded = F.aggregate(rows, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.size(f"found_{rule.kind}") > 0, folded).otherwise(none)


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the column secret_spans: array of (start, order, kind, end), by start, then as the rules are listed.

    start and end are code points, end exclusive. A rule with a trigram query is tried on its candidates only, one
    without (hex) on every text. A null text counts as empty. Every row stays, repeated and null doc_ids included;
    other columns stay, whatever their names (one called secret_spans is replaced). An empty table gives an empty result.
    """
    names = [c for c in docs.columns if c != "secret_spans"]
    return _spans_of(docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), "doc_id", "text"), rules).select("row.*", "secret_spans")


def _spans_of(wrapped: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row, text, secret_spans) of rows (row, doc_id, text).

    The candidates are written before they meet the texts: Spark then knows their size, and moves no text where they
    are few.
    """
    found = stored(candidates(postings(wrapped, rules), rules))
    rows = wrapped.select("row", F.coalesce("text", F.lit("")).alias("text"), _key().alias("key")).join(found, "key", "left")
    tried = {r.kind: F.array_contains("kinds", r.kind) if trigram_query(r.pattern) else F.lit(True) for r in rules}
    rows = rows.select("row", "text", *(F.when(tried[r.kind], F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).alias(f"found_{r.kind}") for r in rules))
    some = {r.kind: F.size(f"found_{r.kind}") > 0 for r in rules}
    rows = rows.select(
        "*",
        *(F.when(some[r.kind], F.split("text", r.pattern, -1)).alias(f"gaps_{r.kind}") for r in rules),
        *((F.when(some[r.kind], F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group))) if r.group else F.col(f"found_{r.kind}")).alias(f"sized_{r.kind}") for r in rules),
    )
    spans = F.array_sort(F.concat(*(_spans(r, i) for i, r in enumerate(rules))))
    return rows.select("row", "text", spans.alias("secret_spans"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_digests(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, matches of each base kind, base_sha256, and all spans as text.

    A null text counts as empty: no spans and the digest of the empty string. Null and repeated doc_ids stay as rows;
    other columns are ignored. An empty table gives an empty result.
    """
    rows = secret_spans(docs.select("doc_id", "text"))
    kinds = [r.kind for r in BASE]
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("secret_spans", lambda s: s["order"] < len(BASE))
    return rows.select("doc_id", *(count(k).alias(f"n_{k}") for k in kinds), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("secret_spans")).alias("spans"))


def mask_secrets(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """docs with every secret in text replaced by `mask` (spans that overlap are replaced together) and n_chars brought up to date.

    Every row stays, repeated ones too, with all its columns, whatever their names; rows without a secret stay as they
    are, a null text null. An empty table gives an empty result.
    """
    rows = _spans_of(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise(acc["out"]).alias("out"),
    )
    ended = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    text = F.aggregate("secret_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, ended)
    rows = rows.select("row", F.when(F.size("secret_spans") > 0, text).alias("masked"))
    new = {"text": F.coalesce("masked", "row.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length("masked").cast("long"), F.col("row.n_chars"))
    return rows.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def digests_sql() -> str:
    """DuckDB SQL for secret_digests over the view documents."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    found = ", ".join(f"regexp_extract_all(t, {quoted(r.pattern)}, 0) AS f{i}, string_split_regex(t, {quoted(r.pattern)}) AS g{i}, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS s{i}" for i, r in enumerate(RULES))
    spans = " UNION ALL ".join(
        f"SELECT n, {i} AS o, '{r.kind}' AS kind, length(s{i}[k]) AS size, {r.least} AS least,"
        f" (list_sum(list_transform(g{i}[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(f{i}[1:k-1], lambda x: length(x))), 0))::BIGINT AS a, length(f{i}[k]) AS l"
        f" FROM (SELECT n, f{i}, g{i}, s{i}, unnest(range(1, len(f{i}) + 1)) AS k FROM m)"
        for i, r in enumerate(RULES)
    )
    joined = lambda where: f"coalesce(string_agg(kind || ':' || a || ':' || (a + l), ',' ORDER BY a, o) FILTER (WHERE {where}), '')"
    counts = ", ".join(f"count(*) FILTER (WHERE o = {i}) AS n_{r.kind}" for i, r in enumerate(BASE))
    return (
        "WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),"
        f" m AS (SELECT n, {found} FROM d), spans AS ({spans}),"
        f" x AS (SELECT n, {counts}, sha256({joined(f'o < {len(BASE)}')}) AS base_sha256, {joined('true')} AS spans FROM spans WHERE size >= least GROUP BY n)"
        " SELECT doc_id, " + ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE) + ", coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN x USING (n)"
    )


assert all(re.compile(r.pattern) for r in RULES)
