"""Rules over a table of logged SQL texts.

One regular pass turns a text into tokens: comments, literals, quoted names,
words, numbers, operators. Comments go, literals keep nothing but a leading
wildcard, names in quotes become one word. Then parentheses are folded from the
innermost outwards, each to one mark, so that the text of a statement at depth
0 and that of every block in parentheses stand by themselves, and rules look at
one of them at a time: a `where` in a subquery is none of its outer query's.
There is no grammar: unknown syntax is just more words.

All of it is expressions over one row; the log is not shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Comments, literals and quoted names may be cut off by the end of the text.
TOKEN = (
    r"""(?s)--[^\n]*|/\*.*?(?:\*/|\z)|'(?:[^']|'')*+(?:'|\z)|"(?:[^"]|"")*+(?:"|\z)|`[^`]*+(?:`|\z)"""
    r"|[\p{L}_][\p{L}\p{N}_$]*|\p{N}+(?:\.\p{N}+)?|<>|!=|<=|>=|\S"
)
FOLDED = "\ue000"  # stands for a block in parentheses
NAME = "quoted_name"
INNERMOST = r"\(([^()]*)\)"
SET_OPERATION = r"\b(?:union(?: all| distinct)?|intersect(?: all)?|except(?: all)?|minus)\b"
MAIN_VERB = r"\b(?:select|insert|update|delete|merge)\b.*"
FROM_CLAUSE = r"\bfrom\b(.*?)(?:\b(?:where|group|having|order|limit|window|qualify|fetch|for)\b|$)"
WHERE_CLAUSE = r"\bwhere\b(.*?)(?:\b(?:group|having|order|limit|window|qualify|fetch)\b|$)"
CALL_BEFORE_COMPARISON = rf"(\w+) {FOLDED} (?:=|<|>|!)"
# Words before a parenthesis that call nothing.
NO_CALLS = (
    "all", "and", "any", "between", "case", "else", "exists", "in", "is", "like", "not", "on", "or", "row", "some", "then",
    "values", "when", "where",
)

_HIDDEN = "\u2063"  # begins the names of columns that rules look at
Test = Callable[[Column], Column]


def _has(pattern: str) -> Test:
    return lambda text: text.rlike(pattern)


def _lacks(pattern: str) -> Test:
    return lambda text: ~text.rlike(pattern)


def _all(*tests: Test) -> Test:
    def test(text: Column) -> Column:
        result = tests[0](text)
        for t in tests[1:]:
            result = result & t(text)
        return result

    return test


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _cartesian(select: Column) -> Column:
    source = F.regexp_extract(select, FROM_CLAUSE, 1)
    joins = _count(source, r"\bjoin\b") - _count(source, r"\bnatural\b")
    return source.contains(",") | source.rlike(r"\bcross join\b") | (joins > _count(source, r"\b(?:on|using)\b"))


def _calls_in_where(unit: Column) -> Column:
    found = F.regexp_extract_all(F.regexp_extract(unit, WHERE_CLAUSE, 1), F.lit(CALL_BEFORE_COMPARISON), F.lit(1))
    return F.exists(found, lambda word: ~word.isin(*NO_CALLS))


def _compares_null(unit: Column) -> Column:
    """An assignment in an update is no comparison."""
    judged = F.when(unit.rlike(r"^update\b"), F.regexp_extract(unit, WHERE_CLAUSE, 1)).otherwise(unit)
    return judged.rlike(r"(?:=|<>|!=) null\b")


# What a rule looks at: every select at its own depth, every unit (statement or block), statements only, or the tokens.
SELECT, UNIT, STATEMENT, TEXT = "selects", "units", "statements", "text"

# rule, severity, what it looks at, test.
RULES = (
    ("select_star", "Medium", SELECT, _has(r"^select (?:distinct |all )?\*")),
    ("select_without_where", "Low", SELECT, _lacks(r"\bwhere\b")),
    ("delete_without_where", "High", UNIT, _all(_has(r"^delete\b"), _lacks(r"\bwhere\b"))),
    ("update_without_where", "High", UNIT, _all(_has(r"^update\b"), _lacks(r"\bwhere\b"))),
    ("truncate", "High", STATEMENT, _has(r"^truncate\b")),
    ("drop", "High", STATEMENT, _has(r"^drop\b")),
    ("eq_null", "Medium", UNIT, _compares_null),
    ("leading_wildcard_like", "Medium", UNIT, _has(r"\bi?like '%")),
    ("order_without_limit", "Low", SELECT, _all(_has(r"\border by\b"), _lacks(r"\b(?:limit|fetch)\b"))),
    ("function_on_column", "Medium", UNIT, _calls_in_where),
    ("cartesian_join", "High", SELECT, _cartesian),
    ("having_without_group", "Medium", SELECT, _all(_has(r"\bhaving\b"), _lacks(r"\bgroup by\b"))),
    ("unbalanced_parens", "High", TEXT, None),
    ("injection_pattern", "High", TEXT, None),
    ("select_without_from", "Medium", SELECT, _lacks(r"\bfrom\b")),
    ("distinct_used", "Low", SELECT, _has(r"^select distinct\b")),
)


def _is_comment(token: Column) -> Column:
    return token.startswith("--") | token.startswith("/*")


def _word(token: Column) -> Column:
    literal = F.concat(F.lit("'"), F.when(token.startswith("'%"), "%").otherwise(""), F.lit("'"))
    return (
        F.when(token.startswith("'"), literal).when(token.startswith('"') | token.startswith("`"), NAME)
        .when(token == FOLDED, "?").otherwise(F.lower(token))
    )


def _fold(state: Column) -> Column:
    """Replace the innermost parentheses of a text by marks and keep what was in them."""
    inside = F.regexp_extract_all(state["text"], F.lit(INNERMOST), F.lit(1))
    folded = F.struct(F.regexp_replace(state["text"], INNERMOST, FOLDED).alias("text"),
                      F.concat(state["blocks"], inside).alias("blocks"))
    return F.when(state["text"].rlike(INNERMOST), folded).otherwise(state)


def _main(unit: Column) -> Column:
    """A unit without the named queries before it."""
    bare = F.btrim(unit)
    return F.when(bare.rlike(r"^with\b"), F.regexp_extract(bare, MAIN_VERB, 0)).otherwise(bare)


def _selects(unit: Column) -> Column:
    grants = unit.rlike(r"^(?:grant|revoke|deny)\b")
    parts = F.transform(F.split(unit, SET_OPERATION), lambda part: F.regexp_extract(part, r"\bselect\b.*", 0))
    return F.when(grants, F.array().cast("array<string>")).otherwise(F.filter(parts, lambda part: part != ""))


def taken_apart(sql: Column) -> list[tuple[str, Callable[[], Column]]]:
    """Named steps, each over the columns before it; the last ones are what rules look at."""

    def col(name: str) -> Column:
        return F.col(_HIDDEN + name)

    opened = _count(col("flat"), r"\(")
    rounds = F.when(opened > 0, F.sequence(F.lit(1), opened)).otherwise(F.array().cast("array<int>"))
    start = F.struct(col("flat").alias("text"), F.array().cast("array<string>").alias("blocks"))
    units = F.concat(F.split(col("folded")["text"], ";"), col("folded")["blocks"])
    steps = (
        ("tokens", F.regexp_extract_all(sql, F.lit(TOKEN), F.lit(0))),
        ("flat", F.array_join(F.transform(F.filter(col("tokens"), lambda t: ~_is_comment(t)), _word), " ")),
        ("folded", F.aggregate(rounds, start, lambda state, _: _fold(state))),
        ("statements", F.filter(F.transform(F.split(col("folded")["text"], ";"), _main), lambda u: u != "")),
        ("units", F.filter(F.transform(units, _main), lambda u: u != "")),
        ("selects", F.flatten(F.transform(col("units"), _selects))),
    )
    return [(_HIDDEN + name, expression) for name, expression in steps]


def _text_rules() -> dict[str, Column]:
    flat, tokens = F.col(_HIDDEN + "flat"), F.col(_HIDDEN + "tokens")
    left = F.col(_HIDDEN + "folded")["text"]
    ends_bare = F.coalesce(F.get(tokens, F.size(tokens) - 1).rlike(r"^--\s*$"), F.lit(False))
    return {
        "unbalanced_parens": (_count(flat, r"\(") != _count(flat, r"\)")) | left.rlike("[()]"),
        "injection_pattern": (
            flat.rlike(r"\bor 1 = 1\b") | (F.size(_HIDDEN + "statements") > 1) | ends_bare),
    }


def audit_rules(queries: DataFrame, text: str = "input_text") -> DataFrame:
    """One row per query and rule it breaks. A map-only pass over the log."""
    kept = [c for c in queries.columns if c != text]
    whole = _text_rules()

    def broken(rule: str, looks_at: str, test: Test | None) -> Column:
        return whole[rule] if looks_at == TEXT else F.exists(_HIDDEN + looks_at, test)

    hits = F.filter(
        F.array(*[
            F.when(broken(rule, looks_at, test), F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity")))
            for rule, severity, looks_at, test in RULES
        ]),
        lambda hit: hit.isNotNull(),
    )
    rows = queries.where(F.col(text).isNotNull())
    for name, expression in taken_apart(F.col(text)):
        rows = rows.withColumn(name, expression)
    return rows.select(*kept, F.inline(hits))


def audit_by_rule(hits: DataFrame) -> DataFrame:
    return hits.groupBy("rule", "severity", "user_id").agg(F.count(F.lit(1)).alias("n"))
