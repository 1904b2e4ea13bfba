"""Question text expressions (ops H1, H2) on Spark's Java regex engine.

The patterns of ``constants`` are written for an engine where ``.`` stops
only at ``\\n`` and ``\\b`` is Unicode-aware. ``java_regex`` states those
two rules explicitly for Java: the ``(?d)`` flag (only ``\\n`` ends a line)
and look-arounds on Unicode letters, digits and ``_`` in place of ``\\b``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardflow import constants as K

WORD_CHAR = r"[\p{L}\p{N}_]"


def java_regex(pattern: str) -> str:
    r"""Java form of a pattern: ``.`` excludes only ``\n``; each ``\b``
    becomes a Unicode word boundary."""
    boundary = rf"(?:(?<!{WORD_CHAR})(?={WORD_CHAR})|(?<={WORD_CHAR})(?!{WORD_CHAR}))"
    return "(?d)" + pattern.replace(r"\b", boundary)


def whole_word(word: str) -> str:
    return java_regex(r"\b" + re.escape(word) + r"\b")


_META = set(".^$*+?{}[]\\|()")


def _split_top(s: str, sep: str = "|") -> list[str]:
    """Split ``s`` at ``sep`` outside parentheses."""
    parts, depth, cur = [], 0, ""
    for ch in s:
        depth += ch == "("
        depth -= ch == ")"
        if ch == sep and depth == 0:
            parts.append(cur)
            cur = ""
        else:
            cur += ch
    return parts + [cur]


def _series(branch: str) -> list[str]:
    """The parts of a branch between its top-level ``.*``."""
    parts, depth, cur, i = [], 0, "", 0
    while i < len(branch):
        if depth == 0 and branch.startswith(".*", i):
            parts.append(cur)
            cur, i = "", i + 2
            continue
        depth += (branch[i] == "(") - (branch[i] == ")")
        cur += branch[i]
        i += 1
    return parts + [cur]


def linear_regex(pattern: str) -> str:
    r"""A Java regex that finds a match where ``pattern`` does, in time linear
    in the text.

    A line matches a series ``A.*B.*C`` if, after its first A, there is a B,
    and after the first such B a C. The search is tied to line starts, and
    each step (``(?>.*?A)``) is atomic, so what was passed is not tried again.
    Taking the first A is right because no word of a group holds another one
    that would leave the beginning of a later group's word behind it (the
    tests hold this against the plain pattern).
    """
    branches = ["".join(f"(?>.*?(?:{part}))" for part in _series(b)) for b in _split_top(pattern)]
    return "(?dm)^(?:" + "|".join(branches) + ")"


def _prefix(alternative: str) -> str:
    """The literal text every match of the alternative begins with."""
    lit = ""
    for ch in alternative:
        if ch in "?*{":      # the character before may be missing
            return lit[:-1]
        if ch in _META:
            return lit
        lit += ch
    return lit


def _required_groups(branch: str) -> list[str]:
    """Contents of the top-level groups that a match must hold: not those
    behind which a quantifier allows none."""
    groups, depth, start = [], 0, 0
    for i, ch in enumerate(branch):
        if ch == "(":
            if depth == 0:
                start = i + 1
            depth += 1
        elif ch == ")":
            depth -= 1
            if depth == 0 and branch[i + 1: i + 2] not in ("?", "*", "{"):
                groups.append(branch[start:i])
    return groups


def necessary_literals(pattern: str) -> list[list[list[str]]] | None:
    """A condition every match of ``pattern`` meets, as branches of groups
    of literal prefixes: some branch has, for each of its groups, some
    prefix contained in the text. ``None`` when no such literals exist.

    Only top-level groups of literal alternatives count (e.g. the groups of
    ``(average|avg|mean).*(wait|waiting)``); a group whose alternative starts
    with a metacharacter constrains nothing and is left out.
    """
    branches = []
    for branch in _split_top(pattern):
        groups = [[_prefix(alt) for alt in _split_top(g)] for g in _required_groups(branch)]
        groups = [sorted(set(g)) for g in groups if all(g)]
        if not groups:
            return None
        branches.append(groups)
    return branches


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often ``use``
    refers to it."""
    return F.transform(F.array(value), use)[0]


def _tested(group: Sequence[str]) -> list[str]:
    """The literals of a group without those that hold another one: a text
    that contains the longer contains the shorter."""
    return [lit for lit in group if not any(o != lit and o in lit for o in group)]


def _guard(text: Column, pattern: str) -> Column | None:
    lits = necessary_literals(pattern)
    if lits is None:
        return None
    ors = []
    for groups in lits:
        ands = None
        for prefixes in groups:
            any_of = None
            for lit in _tested(prefixes):
                c = text.contains(lit)
                any_of = c if any_of is None else any_of | c
            ands = any_of if ands is None else ands & any_of
        ors.append(ands)
    out = ors[0]
    for c in ors[1:]:
        out = out | c
    return out


def _rx(text: Column, pattern: str) -> Column:
    """``rlike`` behind its literal guard: substring tests are cheap and
    rule out most texts before the regex runs over the whole text."""
    test = text.rlike(linear_regex(pattern))
    guard = _guard(text, pattern)
    return test if guard is None else (guard & test)


def number_after(pattern: str) -> str:
    r"""Linear form of ``word.*?(number)``: the walk from a word to the next
    digit of its line ends at the next such word, from which it would go on to
    the same digit."""
    word, number = pattern.split(".*?")
    return java_regex(rf"{word}(?:(?!{word})[^\n0-9])*+{number}")


def percent_regex(pattern: str) -> str:
    """``PERCENT_PATTERN`` tied to the first digit of a run of digits."""
    return java_regex(r"(?<![0-9])" + pattern.replace("+", "++"))


def classify(text: Column) -> Column:
    """H1: the first intent whose pattern occurs in the lower-cased text."""
    low = F.lower(text)
    expr = None
    for name, pattern in K.QUESTION_PATTERNS:
        expr = (F.when(_rx(low, pattern), F.lit(name)) if expr is None
                else expr.when(_rx(low, pattern), F.lit(name)))
    return expr.otherwise(F.lit(K.DEFAULT_INTENT))


def _first(text: Column, p: str, literal: str, group: int = 1) -> Column:
    """Group of the first match of the Java regex ``p``, or null when there is
    none (or it is empty). ``literal`` is a substring every match contains;
    testing it first spares the regex on most rows."""
    return F.when(text.contains(literal), once(F.regexp_extract(text, p, group), lambda s: F.when(s != "", s)))


def _canonical(word: str) -> str:
    for name in K.SPECIALTIES:
        if name.lower() == word:
            return name
    return word.title()


def _whole(first: str, body: str) -> str:
    """Java regex of ``body``, whole words that begin with a character of
    ``first`` and end with a word character. The first character is looked at
    before anything else, which passes over most places of a text cheaply."""
    return f"(?d)(?=[{first}])(?<!{WORD_CHAR}){body}(?!{WORD_CHAR})"


def _any_word(words: Sequence[str]) -> str:
    """Any of the words, as group 1; longer words before those they begin with."""
    ordered = sorted(words, key=lambda w: (-len(w), w))
    return _whole("".join(sorted({w[0] for w in words})), "(" + "|".join(
        # "adult" inside "young adult" is not a second, later group.
        ("(?<!young )" if w == "adult" else "") + re.escape(w) for w in ordered) + ")")


def extract_params(question: Column) -> Column:
    """H2: the typed parameters of a question as one struct column.

    Each parameter is one scan of the text, behind the test of a literal: all
    specialties are found by one pattern and all age groups by another, and
    what they found is looked up in the resulting short arrays."""
    return once(F.lower(question), lambda low: _params(question, low))


def _params(question: Column, low: Column) -> Column:
    pct = _first(question, percent_regex(K.PERCENT_PATTERN), "%").cast("double")
    nums = F.transform(F.regexp_extract_all(question, F.lit(_whole("0-9", K.NUMBER_PATTERN.replace(r"\b", ""))), 1),
                       lambda s: s.cast("double"))
    # A number in the text is never replaced by the default; one beyond the
    # range of a bigint gives null.
    cap = once(_first(low, number_after(K.BASELINE_CAPACITY_PATTERN), "baseline"), lambda number: F.when(
        number.isNotNull(), number.try_cast("bigint")).when(
        low.contains("capacity") | low.contains("increase"),
        F.lit(K.BASELINE_CAPACITY_DEFAULT).cast("bigint")))
    found = F.regexp_extract_all(low, F.lit(_any_word(K.QUESTION_SPECIALTIES)), 1)
    named = once(found, lambda words: F.filter(
        F.array(*[F.when(F.array_contains(words, s), F.lit(_canonical(s))) for s in K.QUESTION_SPECIALTIES]),
        lambda s: s.isNotNull()))

    # Later groups overwrite earlier ones.
    def last_group(words: Column) -> Column:
        expr = None
        for g in reversed(list(K.AGE_GROUPS)):
            cond = F.array_contains(words, g)
            expr = F.when(cond, F.lit(g)) if expr is None else expr.when(cond, F.lit(g))
        return expr

    group = once(F.regexp_extract_all(low, F.lit(_any_word(list(K.AGE_GROUPS))), 1), last_group)
    ends = F.create_map(*[x for g, (a, b) in K.AGE_GROUPS.items()
                          for x in (F.lit(g), F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")))])
    between = once(_first(low, java_regex(K.AGE_RANGE_PATTERN), "between", 0), lambda span: F.when(
        span.isNotNull(), F.struct(
            F.regexp_extract(span, java_regex(K.AGE_RANGE_PATTERN), 1).cast("int").alias("lo"),
            F.regexp_extract(span, java_regex(K.AGE_RANGE_PATTERN), 2).cast("int").alias("hi"))))
    ages = once(group, lambda g: F.struct(
        g.alias("name"), F.coalesce(F.try_element_at(ends, g), between).alias("range")))
    weight = _first(low, number_after(K.RISK_WEIGHT_PATTERN), "risk").cast("double")
    limit = _first(low, number_after(K.THRESHOLD_PATTERN), "threshold").cast("double")
    age = _first(low, java_regex(K.AGE_PATTERN), "age").cast("int")
    return once(F.struct(nums.alias("n"), named.alias("s"), ages.alias("a"), cap.alias("c")), lambda x: F.struct(
        pct.alias("percentage"),
        F.when(F.size(x["n"]) > 0, x["n"]).alias("numbers"),
        x["c"].alias("baseline_capacity"),
        x["c"].alias("weekly_capacity"),
        weight.alias("risk_weight"),
        limit.alias("threshold"),
        F.when(F.size(x["s"]) > 0, x["s"]).alias("specialties"),
        age.alias("age"),
        x["a"]["range"]["lo"].alias("age_min"),
        x["a"]["range"]["hi"].alias("age_max"),
        x["a"]["name"].alias("age_group"),
    ))


def route(intent: Column, question: Column) -> Column:
    """H3: the operation that answers a question.

    Only the cancellation and capacity intents go to a function: text with
    "cancel" to the cancellation what-if, else text with "capacity" or
    "increase" to the capacity figures. The eight grouped intents go to
    their grouped answer; everything else gets the preview rows.

    One map lookup keyed by (intent, text tag) references ``intent`` once,
    so a filter on ``route`` pushed below the classification does not repeat
    the classification per branch.
    """
    low = F.lower(question)
    tag = (F.when(low.contains("cancel"), F.lit("cancel"))
            .when(low.contains("capacity") | low.contains("increase"), F.lit("capacity"))
            .otherwise(F.lit("none")))
    grouped = {
        "average_wait_time": "average_wait_time",
        "specialty_analysis": "specialty_analysis",
        "high_risk_patients": "high_risk_by_specialty",
        "cost_impact": "cost_impact",
        "seasonal_analysis": "seasonal_analysis",
        "age_based_risk": "age_based_risk",
        "age_based_cancellation": "age_based_cancellation",
        "age_based_cost": "age_based_cost",
    }
    by_tag = {"cancel": "cancellation_reduction", "capacity": "capacity_kpis", "none": "preview_rows"}
    entries = []
    for t in by_tag:
        for i, r in grouped.items():
            entries += [F.lit(f"{i}:{t}"), F.lit(r)]
        for i in K.FUNCTION_INTENTS:
            entries += [F.lit(f"{i}:{t}"), F.lit(by_tag[t])]
    table = F.create_map(*entries)
    return F.coalesce(F.element_at(table, F.concat(intent, F.lit(":"), tag)), F.lit("preview_rows"))
