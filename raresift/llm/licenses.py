"""License scan: ordered signature rules over whole texts, in column expressions only.

Two filters come before any rule. A text without any of the gate's words is done at once. Of a text that passes, the words
are numbered (`` mit#7 license#8``) and only rules one of whose keywords is among its words are tried. A match tells
its own place by the numbers in it, so no position has to be counted.

Overlapping detections are resolved by tier (notices before names before hints) and by containment of intervals:

1. a detection goes if its interval lies in that of one of the same or a higher tier (of equal intervals the earlier
   rule stays);
2. of the rest, one goes if its interval encloses one of a higher tier.

Both are one running maximum (or minimum) over the sorted detections of a text. A text's result depends on that text
alone: a scan, without shuffle, that a hot source or copies cannot skew.

Defined cases: null and empty texts have no words and no labels; repeated rows give equal rows; ids are not
read; an empty table gives an empty result; further columns are passed through by ``detect`` unread, whatever their
names (new names are those of ``FOUND``; a column that has one is replaced).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from raresift.llm.license_rules import BASE, GATE, HINT, NAME, NOTICE, RULES, Rule

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII characters that are no letter or digit stand between words.
SEPARATORS = "".join(chr(code) for code in range(128) if not chr(code).isalnum())
#: Words of a text in lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Detections per block of a running maximum; keeps its cost in proportion to their number.
BLOCK = 256
FOUND = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")


def numbered(pattern: str) -> str:
    """A rule's pattern over words as one over numbered words."""
    return " " + pattern.replace("[^ #]", "_").replace(" ?", "(?: )?").replace(" ", r"#\d+ ").replace("_", "[^ #]+") + r"#\d+"


def word_count(text: Column) -> Column:
    """Number of words, without making any: each run of separators becomes one mark, and marks are counted.

    A run of spaces is a run of pairs of marks; taking out every inner border leaves one pair.
    """
    spaced = F.rtrim(F.concat(F.lit(" "), F.translate(text, SEPARATORS, " " * len(SEPARATORS))))
    marked = F.replace(F.replace(spaced, F.lit(" "), F.lit("\x01\x02")), F.lit("\x02\x01"), F.lit(""))
    return (F.length(marked) - F.length(F.replace(marked, F.lit("\x01"), F.lit("")))).cast("bigint")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _rule(place: int, rule: Rule) -> Column:
    return F.struct(
        F.lit(place).alias("rule"),
        F.lit(rule.tier).alias("tier"),
        F.lit(rule.label).alias("label"),
        F.lit(rule.confidence).alias("confidence"),
        F.array(*[F.lit(word) for word in rule.keywords]).alias("keywords"),
        F.lit(numbered(rule.pattern)).alias("pattern"),
    )


def _number(match: Column, pattern: str) -> Column:
    return F.regexp_extract(match, pattern, 1).cast("int")


def _matches(text: Column, rule: Column) -> Column:
    """All places of one rule, as structs that sort by start, then the longer, the higher tier, the earlier rule."""

    def detection(match: Column) -> Column:
        last = _number(match, r"#(\d+)$")
        return F.struct(
            _number(match, r"#(\d+)").alias("first"),
            (-last).alias("minus_last"),
            rule["tier"].alias("tier"),
            rule["rule"].alias("rule"),
            rule["label"].alias("label"),
            rule["confidence"].alias("confidence"),
        )

    return F.transform(F.regexp_extract_all(text, rule["pattern"], F.lit(0)), detection)


def _sift(items: Column, zero: Column, keep: Callable[[Column, Column], Column], step: Callable[[Column, Column], Column]) -> Column:
    """Items that pass ``keep(state, item)``; the state starts as ``zero`` and is carried on by ``step``.

    Kept items are gathered per block and the blocks joined at the end, since adding to one array would copy it
    each time.
    """

    def through(whole: Column) -> Column:
        nothing = F.slice(whole, 1, 0)
        starts = F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / BLOCK).cast("int"))

        def block(carried: Column, start: Column) -> Column:
            inner = F.aggregate(
                F.slice(whole, start * BLOCK + 1, F.lit(BLOCK)),
                F.struct(carried["state"].alias("state"), nothing.alias("kept")),
                lambda acc, item: F.struct(
                    step(acc["state"], item).alias("state"),
                    F.when(keep(acc["state"], item), F.concat(acc["kept"], F.array(item))).otherwise(acc["kept"]).alias("kept"),
                ),
            )
            return _let(
                inner,
                lambda done: F.struct(done["state"].alias("state"), F.concat(carried["blocks"], F.array(done["kept"])).alias("blocks")),
            )

        empty = F.struct(zero.alias("state"), F.slice(F.array(nothing), 1, 0).alias("blocks"))
        return F.flatten(F.aggregate(starts, empty, block)["blocks"])

    return F.when(F.size(items) > 1, _let(items, through)).otherwise(items)


def _per_tier(make: Callable[[int], Column]) -> Column:
    return F.struct(*[make(tier).alias(f"t{tier}") for tier in (NOTICE, NAME, HINT)])


def _of_tier(state: Column, tier: Column) -> Column:
    return F.when(tier == NOTICE, state["t1"]).when(tier == NAME, state["t2"]).otherwise(state["t3"])


def resolve(detections: Column) -> Column:
    """Detections left after containment, in order of their places."""
    outside = _sift(
        F.sort_array(detections),
        _per_tier(lambda tier: F.lit(-1)),
        lambda furthest, item: _of_tier(furthest, item["tier"]) < -item["minus_last"],
        lambda furthest, item: _per_tier(
            lambda tier: F.when(item["tier"] <= tier, F.greatest(furthest[f"t{tier}"], -item["minus_last"])).otherwise(furthest[f"t{tier}"])
        ),
    )
    far = 2**31 - 1
    without = _sift(
        F.sort_array(outside, asc=False),
        _per_tier(lambda tier: F.lit(far)),
        lambda nearest, item: _of_tier(nearest, item["tier"]) > -item["minus_last"],
        lambda nearest, item: _per_tier(
            lambda tier: F.when(item["tier"] < tier, F.least(nearest[f"t{tier}"], -item["minus_last"])).otherwise(nearest[f"t{tier}"])
        ),
    )
    return F.reverse(without)


def _scan(text: Column, rules: Sequence[Rule]) -> Column:
    """What a text that passed the gate holds: starts of base phrases by label, and resolved detections."""
    table = F.array(*[_rule(place, rule) for place, rule in enumerate(rules)])
    every = F.array(*[F.lit(word) for word in sorted({word for rule in rules for word in rule.keywords})])

    def of_words(words: Column) -> Column:
        line = F.concat(F.lit(" "), F.array_join(F.transform(words, lambda word, at: F.concat(word, F.lit("#"), at.cast("string"))), " "))
        tried = _let(F.array_intersect(every, words), lambda held: F.filter(table, lambda rule: F.arrays_overlap(rule["keywords"], held)))

        def of_line(text: Column) -> Column:
            return F.struct(
                *[
                    F.regexp_extract_all(text, F.lit(numbered(phrase).replace(r"#\d+", r"#(\d+)", 1)), F.lit(1)).alias(f"base_{place}")
                    for place, (phrase, _) in enumerate(BASE)
                ],
                resolve(F.flatten(F.transform(tried, lambda rule: _matches(text, rule)))).alias("detections"),
            )

        return _let(line, of_line)

    return _let(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), of_words)


def detect(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] | None = None) -> DataFrame:
    """All columns of ``docs`` with those of ``FOUND``.

    ``detections`` holds ``first_word, last_word, label, confidence, rule`` of each detection kept; ``score`` is
    the greatest confidence among them, or 0.
    """
    rules = RULES if rules is None else list(rules)
    text = F.coalesce(F.col(text_col), F.lit(""))
    scanned = docs.withColumn("license_scan", F.when(text.rlike(GATE), _scan(text, rules)))
    scan = F.col("license_scan")
    none = F.array().cast("array<bigint>")
    starts = {label: F.coalesce(scan[f"base_{place}"].cast("array<bigint>"), none) for place, (_, label) in enumerate(BASE)}
    every = F.concat(*starts.values())
    base = F.array_compact(F.array(*[F.when(F.size(places) > 0, F.lit(label)) for label, places in starts.items()]))
    kept = F.coalesce(scan["detections"], F.filter(scan["detections"], lambda _: F.lit(False)))
    kept_labels = F.coalesce(F.transform(scan["detections"], lambda item: item["label"]), F.array().cast("array<string>"))
    shown = F.transform(
        kept,
        lambda item: F.struct(
            item["first"].alias("first_word"),
            (-item["minus_last"]).alias("last_word"),
            item["label"].alias("label"),
            item["confidence"].alias("confidence"),
            item["rule"].alias("rule"),
        ),
    )
    made = {
        "n_words": word_count(text),
        "n_base": F.size(every).cast("bigint"),
        "first_word": F.array_min(every),
        "last_word": F.array_max(every),
        "base_labels": F.array_join(F.sort_array(base), ","),
        "labels": F.array_join(F.sort_array(F.array_distinct(F.concat(base, kept_labels))), ","),
        "score": F.coalesce(F.array_max(F.transform(scan["detections"], lambda item: item["confidence"])), F.lit(0.0)),
        "detections": F.coalesce(shown, F.array().cast("array<struct<first_word:int,last_word:int,label:string,confidence:double,rule:int>>")),
    }
    kept_columns = [F.col(f"`{name}`") for name in docs.columns if name.lower() not in FOUND]
    return scanned.select(*kept_columns, *[column.alias(name) for name, column in made.items()])
