"""Line scanning: numbered lines, detectors, and one finding per matching rule and line.

All rules of a set become one array expression evaluated while the line is in hand: a scan is a
narrow projection with no join, no shuffle and no Python.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import spread
from ..sources.rules import Rule, RuleSet

# How a call is told from other uses of a name.
NOT_WORD = "[^A-Za-z0-9_$]"
NOT_WORD_OR_DOT = "[^A-Za-z0-9_$.]"
EXEMPT_FROM_SUPPRESSION = ("call", "websocket_call")
SCANNED_TYPES = ("javascript", "typescript", "typescript_declaration")
# End of fixed values.


def call_pattern(name: str) -> str:
    return rf"(^|{NOT_WORD}){text.quote_pattern(name)}\("


def process_pattern(name: str, owners: tuple[str, ...]) -> str:
    owner = "|".join(text.quote_pattern(o) for o in owners)
    return rf"(^|{NOT_WORD_OR_DOT}){text.quote_pattern(name)}\(|(^|{NOT_WORD})(?i:{owner})\.{text.quote_pattern(name)}\("


def nonliteral_pattern(name: str) -> str:
    return rf"(^|{NOT_WORD}){text.quote_pattern(name)}\s*\(\s*[^\s'\"]"


Detector = Callable[[Column, Rule, RuleSet], Column]


def _contains(line: Column, needle: str) -> Column:
    return F.contains(line, F.lit(needle))


def _guarded(line: Column, literal: str, pattern: str) -> Column:
    """A regular expression tried only on lines that hold its literal part."""
    return F.when(_contains(line, literal), line.rlike(pattern)).otherwise(F.lit(False))


def quoted(line: Column, rule: Rule, rules: RuleSet) -> Column:
    forms = [_contains(line, q + p + q) for p in rule.patterns for q in ("'", '"')]
    return reduce(lambda a, b: a | b, forms)


def substring(line: Column, rule: Rule, rules: RuleSet) -> Column:
    return _contains(line, rule.patterns[0])


def call(line: Column, rule: Rule, rules: RuleSet) -> Column:
    name = rule.patterns[0]
    return _guarded(line, name + "(", call_pattern(name))


def process_call(line: Column, rule: Rule, rules: RuleSet) -> Column:
    name = rule.patterns[0]
    return _guarded(line, name + "(", process_pattern(name, rules.owners))


def nonliteral_require(line: Column, rule: Rule, rules: RuleSet) -> Column:
    name = rule.patterns[0]
    return _guarded(line, name, nonliteral_pattern(name))


def websocket_call(line: Column, rule: Rule, rules: RuleSet) -> Column:
    return _contains(line, "new " + rule.patterns[0]) | call(line, rule, rules)


# A new kind of detector is a function of (line, rule, rule set) under a new name.
DETECTORS: dict[str, Detector] = {
    "quoted": quoted,
    "substring": substring,
    "call": call,
    "process_call": process_call,
    "nonliteral_require": nonliteral_require,
    "websocket_call": websocket_call,
}


def documentation_context(line: Column, rules: RuleSet) -> Column:
    """True when any marker occurs, letters A-Z compared without case, in one pass."""
    markers = "|".join(text.quote_pattern(m) for m in rules.documentation_markers)
    return line.rlike(f"(?i)(?:{markers})")


def rule_condition(line: Column, rule: Rule, rules: RuleSet) -> Column:
    hit = DETECTORS[rule.detector](line, rule, rules)
    if rule.suppress_documentation and rule.detector not in EXEMPT_FROM_SUPPRESSION:
        hit = hit & ~documentation_context(line, rules)
    return hit


def matching_rules(line: Column, rules: RuleSet) -> Column:
    """Array of the distinct matching rules of a line, as positions in the rule set."""
    hits = [F.when(rule_condition(line, r, rules), F.lit(i)) for i, r in enumerate(rules.line_rules)]
    return F.array_compact(F.array(*hits))


def numbered_lines(files: DataFrame, content: str, keep: list[str]) -> DataFrame:
    """Lines with 1-based numbers. Only a newline ends a line; a trailing empty line counts."""
    return spread(files.select(*keep, content)).select(*keep, F.posexplode(F.split(F.col(content), "\n", -1)).alias("_pos", "line")).select(
        *keep, (F.col("_pos") + 1).alias("line_number"), "line"
    )


def line_findings(lines: DataFrame, rules: RuleSet, keep: list[str]) -> DataFrame:
    """One finding per (file, line, rule). Rule ids are unique in a checked rule set, so a line
    names each rule at most once and nothing has to be grouped."""
    fields = ("rule_id", "category", "severity", "confidence", "symbol", "title", "explanation")
    lookup = F.array(
        *[F.struct(*[F.lit(getattr(r, f)).alias(f) for f in fields]) for r in rules.line_rules]
    )
    return (
        lines.withColumn("_hits", matching_rules(F.col("line"), rules))
        .filter(F.size("_hits") > 0)
        .select(*keep, "line_number", "line", F.explode("_hits").alias("_hit"))
        .withColumn("_rule", F.get(lookup, F.col("_hit")))
        .select(
            *keep,
            "line_number",
            *[F.col(f"_rule.{f}").alias(f) for f in fields],
            text.bound_snippet("line").alias("evidence"),
        )
    )
