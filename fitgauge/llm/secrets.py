"""Secrets in texts, found by rules that a trigram index narrows down. DataFrame functions only.

Each rule is a regular expression. From it follow the trigrams that every match must hold: alternatives, each a set of trigrams. The
texts are indexed by the trigrams that rules ask for, postings are intersected for each alternative, and the expression is tried on the texts
that are left. A rule with an alternative without three fixed letters in a row has no such query and is tried on all texts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from re import _parser as parser

from pyspark.sql import Column, DataFrame, Window, functions as F

from fitgauge.llm.shared import stored

#: Longer lists of alternatives are cut to what surrounds them, which asks for fewer trigrams.
MOST_ALTERNATIVES = 64
#: Classes of up to so many letters are alternatives, larger ones stand for anything.
LARGEST_CLASS = 8
#: Up to so many rows with candidates (a row number and a mask each) are sent to every executor.
BROADCAST_ROWS = 500_000
GAP = "￿"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and without overlap, whose ``group`` has ``least`` characters. Matches that fail this are
    dropped, but their text stays taken."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    ignore_case: bool = False

    @property
    def expression(self) -> str:
        return f"(?i){self.pattern}" if self.ignore_case else self.pattern


#: The base rules. Runs of a class are written with their least length, which gives the same matches.
BASE = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
]
#: Formats of keys that are in public use.
MORE = [
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("url", r"://[^\x00-\x20/:@]+:[^\x00-\x20/:@]{3,}@"),
]
RULES = [*BASE, *MORE]


# --- trigram queries


def _crossed(left: list[str], right: list[str]) -> list[str]:
    return [a + b for a in left for b in right] if len(left) * len(right) <= MOST_ALTERNATIVES else [a + GAP for a in left]


def _class(members: list) -> list[str]:
    letters: set[str] = set()
    for op, value in members:
        if op is parser.LITERAL:
            letters.add(chr(value).lower())
        elif op is parser.RANGE and value[1] - value[0] < 2 * LARGEST_CLASS:
            letters |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return [GAP]
    return sorted(letters) if len(letters) <= LARGEST_CLASS and all(c.isascii() for c in letters) else [GAP]


def _texts(nodes) -> list[str]:
    """What a match looks like, in lower case: every alternative, with GAP for what is not fixed."""
    out = [""]
    for op, value in nodes:
        if op is parser.LITERAL:
            found = [chr(value).lower()] if value < 128 else [GAP]
        elif op is parser.IN:
            found = _class(value)
        elif op is parser.SUBPATTERN:
            found = _texts(value[-1])
        elif op is parser.BRANCH:
            found = list(dict.fromkeys(x for branch in value[1] for x in _texts(branch)))
        elif op is parser.AT:
            found = [""]
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT):
            least, most, inner = value
            once = _texts(inner)
            if most == 1:
                found = ["", *once]
            else:
                found = [GAP] if least == 0 else [""]
                for _ in range(min(least, 3)):
                    found = _crossed(found, once)
                found = found if least == most <= 3 else [x + GAP for x in found]
        else:
            found = [GAP]
        out = _crossed(out, found)
        if len(out) > MOST_ALTERNATIVES:
            out = [GAP]
    return out


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Sets of trigrams in lower case: the text of every match holds all of one of them. None if nothing can be said."""
    sets = []
    for text in _texts(parser.parse(pattern)):
        sets.append(frozenset(run[i : i + 3] for run in text.split(GAP) for i in range(len(run) - 2)))
    least = [s for s in dict.fromkeys(sets) if not any(t < s for t in sets)]
    return None if frozenset() in least else least


# --- index and search


def index(texts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Postings ``gram``, ``row`` of the trigrams that the rules ask for, over ``row``, ``text``. Texts are compared in lower case, which finds
    more than upper and lower case do apart, never less."""
    grams = sorted({g for r in rules for s in trigram_query(r.pattern) or [] for g in s})
    held = [F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]
    low = texts.select("row", F.lower("text").alias("low"))
    return low.select(F.explode(F.array_compact(F.array(F.lit(None).cast("string"), *held))).alias("gram"), "row")


def candidates(postings: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``row``, ``mask`` (a bit for each rule): the postings of an alternative's trigrams, intersected; any alternative will do."""
    asked = [
        (gram, n, alternative, 1 << bit, (1 << len(grams)) - 1)
        for n, r in enumerate(rules) for alternative, grams in enumerate(trigram_query(r.pattern) or []) for bit, gram in enumerate(sorted(grams))
    ]
    asked = postings.sparkSession.createDataFrame(asked, "asked string, rule int, alternative int, bit bigint, all_bits bigint")
    met = postings.join(F.broadcast(asked), F.col("gram") == F.col("asked"))
    met = met.groupBy("row", "rule", "alternative", "all_bits").agg(F.bit_or("bit").alias("bits")).where("bits = all_bits")
    return met.groupBy("row").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("mask"))


def _matches(rule: Rule) -> Column:
    """Lengths of each match, of the text between it and the one before, and of its group."""
    text, pattern = F.col("text"), F.lit(rule.expression)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.slice(F.split(text, rule.expression, -1), 1, F.size(whole))
    group = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    return F.arrays_zip(*(F.transform(x, F.length).alias(n) for x, n in ((between, "between"), (whole, "whole"), (group, "part"))))


def spans(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Every row of ``docs`` (``doc_id``, ``text``) with ``spans``: kind, start, end (code points, end exclusive) by start, then by the order of rules.

    A null text is empty and has no spans, nor has an empty one; repeated rows and ids count each; an empty table gives an empty result. Other
    columns are not read. Rows are numbered once and stored with their texts, and everything is joined by that number, so that no
    key is hot. No text is cut and no match dropped.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    numbered = stored(numbered, "texts")
    postings = stored(index(numbered.select("row", "text"), rules), "postings")
    found = stored(candidates(postings, rules), "candidates")
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    checked = numbered.select("row", "text").join(found.select(F.col("row").alias("found_row"), "mask"), F.col("row") == F.col("found_row"), "left")
    tried = []
    for n, rule in enumerate(rules):
        possible = F.col("text").rlike(rule.expression)
        if trigram_query(rule.pattern):
            possible = (F.coalesce("mask", F.lit(0)).bitwiseAND(1 << n) != 0) & possible
        tried.append(F.when(possible, F.struct(F.lit(n).alias("rule"), _matches(rule).alias("matches"))))
    hits = checked.select("row", F.explode(F.array_compact(F.array(*tried))).alias("hit"))
    hits = hits.select("row", "hit.rule", F.posexplode("hit.matches").alias("i", "m")).select("row", "rule", "i", "m.between", "m.whole", "m.part")
    until = F.sum(F.col("between") + F.col("whole")).over(Window.partitionBy("row", "rule").orderBy("i"))
    least = F.element_at(F.array(*(F.lit(r.least) for r in rules)), F.col("rule") + 1)
    hits = hits.withColumn("end", until).where(F.col("part") >= least)
    span = F.struct((F.col("end") - F.col("whole")).alias("start"), "rule", F.col("end").alias("end"))
    grouped = hits.groupBy(F.col("row").alias("hit_row")).agg(F.array_sort(F.collect_list(span)).alias("hits"))
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    named = F.transform("hits", lambda x: F.struct(F.element_at(kinds, x["rule"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    joined = numbered.select("row", "doc_id").join(grouped, F.col("row") == F.col("hit_row"), "left")
    nothing = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return joined.select("doc_id", F.coalesce(named, nothing).alias("spans"))


def joined_spans(found: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
