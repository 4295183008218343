"""Personal data: candidate spans, boosted trees, calibrated thresholds.

Base spans follow fixed rules.  Beside them, generators of high recall propose
overlapping candidates per kind; boosted trees score each by its format and
context; candidates above their kind's calibrated threshold become spans too.
Base spans always stay, and no added span overlaps one.

The trees learn from the verdicts of the base rules.  A candidate is positive if it is
a base span of its kind; negative if it overlaps one otherwise (wrong bounds or kind) or
if a base pattern matched exactly it and the rule dropped it; and unlabelled if no rule
looked at it by itself: written another way, or swallowed by a longer match that was
dropped, as where two card numbers stand next to each other.  The trees decide on those.
Features are small codes, so all candidates of a corpus, of any size, fold into a table
of at most ``FOLDS * CELLS`` rows of counts; that table is what training looks at.
Thresholds rest on scores that come from trees fitted to other texts (``FOLDS``).

Only DataFrame functions touch the texts: one pass, no shuffle of text.  Positions
are code points, ends exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastseen.llm.common import stored, text_of

KINDS = ("email", "ip", "card", "phone")

# The patterns of the contract.  Possessive repeats and the look-behind
# give the same leftmost matches in linear time: a match never starts inside a run of
# its first class, unless the match before ended there (\G).
_MAIL = r"[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_MAIL})){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

# What the generators propose: obfuscated, bracketed, dotted and unprefixed forms, and
# the parts of longer runs.  Those of a kind may overlap.
_AT = r"(?:@|\x20?(?:\[at\]|\(at\)|\{at\})\x20?|\x20at\x20)"
_DOT = r"(?:\.|\x20?(?:\[dot\]|\(dot\)|\{dot\})\x20?|\x20dot\x20)"
GENERATORS = {
    "email": (
        rf"(?<!{_MAIL}){_MAIL}{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,8}}+",
    ),
    "ip": (r"(?<![0-9.])[0-9]{1,4}+(?:(?:\.|\[\.\]|\(\.\)|\[dot\])[0-9]{1,4}+){3}",),
    "card": (
        r"(?<![0-9])[0-9](?:[\x20._/-]{0,2}+[0-9]){12,22}+",
        r"(?<![0-9])[0-9]{13,19}+(?![0-9])",
        r"(?<![0-9])[0-9]{4}(?:[\x20._/-][0-9]{4}){3}(?![0-9])",
    ),
    "phone": (
        r"(?<![0-9A-Za-z.])(?:\+|00)?\(?[0-9](?:[\x20().-]{0,3}+[0-9]){7,16}+",
        r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{1,4}\)?(?:[\x20.-][0-9]{2,4}){2}(?![0-9])",
        r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{1,4}\)?(?:[\x20.-][0-9]{2,4}){3}(?![0-9])",
    ),
}
# A text without these is not searched.
GUARDS = {"email": r"@|[\[({\x20]at[\])}\x20]", "ip": r"[0-9](?:\.|\[|\()", "card": r"[0-9]", "phone": r"[0-9]"}
CUES = {
    "email": "mail|contact|write",
    "ip": "ip|host|server|address|ping",
    "card": "card|visa|credit|pay|konto|carte",
    "phone": "phone|call|tel|fax|mobile",
}
CUE_REACH = 24

FEATURES = {
    "kind": 4,
    "digits": 5,
    "groups": 5,
    "separators": 3,
    "before": 3,
    "after": 3,
    "cue": 3,
    "check": 2,
}
#: Most rows of the table that training collects.
CELLS = math.prod(FEATURES.values())
ROUNDS, RATE, LEAST_WEIGHT = 40, 0.3, 1.0
#: Parts of the texts; each is scored by trees fitted to the others, for the thresholds.
FOLDS = 2
#: Share of true spans wanted above a threshold, and labelled spans it must rest on.
PRECISION, SUPPORT = 0.99, 20


def located(text: Column, pattern: str, guard: Column) -> Column:
    """Leftmost non-overlapping matches as an array of (start, end, match)."""
    matches = F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    between = F.split(text, pattern, -1)
    starts = F.aggregate(
        F.arrays_zip(matches.alias("m"), F.slice(between, 1, F.size(matches)).alias("b")),
        F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("starts")),
        lambda seen, x: F.struct(
            (seen["end"] + F.char_length(x["b"]) + F.char_length(x["m"])).alias("end"),
            F.array_append(seen["starts"], seen["end"] + F.char_length(x["b"])).alias("starts"),
        ),
        lambda seen: seen["starts"],
    )
    spans = F.zip_with(
        matches,
        starts,
        lambda m, s: F.struct(s.alias("start"), (s + F.char_length(m)).alias("end"), m.alias("match")),
    )
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    return F.when(F.size(matches) > 0, spans).otherwise(none)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    backwards = F.reverse(digits)
    total = F.aggregate(
        F.transform(
            F.sequence(F.lit(1), F.char_length(digits)),
            lambda i: F.when(i % 2 == 1, backwards.substr(i, F.lit(1)).cast("int")).otherwise(
                F.element_at(
                    F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))),
                    backwards.substr(i, F.lit(1)).cast("int") + 1,
                )
            ),
        ),
        F.lit(0),
        lambda a, b: a + b,
    )
    return (F.char_length(digits) > 0) & (total % 10 == 0)


def _parts_fit(match: Column) -> Column:
    """Every number is at most 255."""
    return F.forall(
        F.regexp_extract_all(match, F.lit("[0-9]+"), F.lit(0)),
        lambda part: F.coalesce(
            F.ltrim(part, F.lit("0")).rlike("^[0-9]{0,3}$")
            & (F.concat(F.lit("0"), F.right(part, F.lit(3))).cast("int") <= 255),
            F.lit(False),
        ),
    )


def base_valid(kind: str, match: Column) -> Column:
    digits = _digits(match)
    length = F.char_length(digits)
    return {
        "email": F.lit(True),
        "ip": _parts_fit(match),
        "card": length.between(16, 19) & passes_luhn(digits),
        "phone": length.between(8, 15),
    }[kind]


def _side(character: Column) -> Column:
    return (
        F.when((character == "") | character.rlike(r"\s"), 0)
        .when(character.rlike(r"[\p{L}\p{N}]"), 1)
        .otherwise(2)
    )


def _place(span: Column) -> Column:
    return span["start"].cast("long") * 2**32 + span["end"]


def _candidate(kind: str, text: Column, base: dict[str, Column], span: Column) -> Column:
    """Feature codes of a candidate, and its label (null: unlabelled).

    ``__matched`` holds the places of all base matches, dropped ones included.
    """
    match, start, end = span["match"], span["start"], span["end"]
    digits = _digits(match)
    n = F.char_length(digits)
    separators = F.size(F.array_distinct(F.split(F.regexp_replace(match, "[0-9A-Za-z]", ""), "")))
    context = F.lower(
        text.substr(F.greatest(start - CUE_REACH, F.lit(0)) + 1, F.least(start, F.lit(CUE_REACH)))
    )
    others = "|".join(cues for other, cues in CUES.items() if other != kind)
    check = {
        "email": match.rlike(r"[A-Za-z]{2,}$"),
        "ip": _parts_fit(match),
        "card": passes_luhn(digits),
        "phone": n.between(8, 15),
    }[kind]
    overlaps = lambda spans: F.exists(spans, lambda b: (b["start"] < end) & (b["end"] > start))
    same = F.exists(base[kind], lambda b: (b["start"] == start) & (b["end"] == end))
    covered = reduce(lambda a, b: a | b, map(overlaps, base.values()))
    return F.struct(
        start.alias("start"),
        end.alias("end"),
        F.lit(KINDS.index(kind)).alias("kind"),
        F.when(n < 8, 0).when(n <= 12, 1).when(n <= 15, 2).when(n <= 19, 3).otherwise(4).alias("digits"),
        F.least(F.size(F.regexp_extract_all(match, F.lit("[0-9]+"), F.lit(0))), F.lit(4)).alias("groups"),
        F.when(match.rlike("^[0-9A-Za-z]*$"), 0).when(separators <= 1, 1).otherwise(2).alias("separators"),
        _side(F.when(start > 0, text.substr(start, F.lit(1))).otherwise(F.lit(""))).alias("before"),
        _side(text.substr(end + 1, F.lit(1))).alias("after"),
        F.when(context.rlike(CUES[kind]), 1).when(context.rlike(others), 2).otherwise(0).alias("cue"),
        check.cast("int").alias("check"),
        F.when(same, 1)
        .when(covered | F.array_contains("__matched", _place(span)), 0)
        .alias("label"),
        covered.alias("covered"),
    )


# Functions of one argument for each kind: Spark reads a lambda's parameters.
def _valid_of(kind: str) -> Callable[[Column], Column]:
    return lambda span: base_valid(kind, span["match"])


def _candidate_of(kind: str, text: Column, base: dict[str, Column]) -> Callable[[Column], Column]:
    return lambda span: _candidate(kind, text, base, span)


def _of_kind(number: int) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == number


def found_spans(docs: DataFrame, *carried: str) -> DataFrame:
    """Base spans (one array for each kind) and scored-later candidates of each text."""
    text = F.col("__text")
    rows = docs.select(*carried, text_of().alias("__text"))
    rows = rows.withColumns({f"__has_{k}": text.rlike(GUARDS[k]) for k in KINDS})
    rows = rows.withColumns({f"__m_{k}": located(text, BASE[k], F.col(f"__has_{k}")) for k in KINDS})
    rows = rows.withColumns({k: F.filter(f"__m_{k}", _valid_of(k)) for k in KINDS})
    rows = rows.withColumn("__matched", F.concat(*(F.transform(f"__m_{k}", _place) for k in KINDS)))
    generated = {
        k: F.array_distinct(F.concat(*(located(text, g, F.col(f"__has_{k}")) for g in GENERATORS[k])))
        for k in KINDS
    }
    rows = rows.withColumns({f"__g_{k}": spans for k, spans in generated.items()})
    base = {k: F.col(k) for k in KINDS}
    proposed = [F.transform(f"__g_{k}", _candidate_of(k, text, base)) for k in KINDS]
    fold = F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int").alias("__fold")
    plain = {k: F.transform(k, lambda s: F.struct(s["start"], s["end"])).alias(k) for k in KINDS}
    return rows.select(*carried, *plain.values(), F.concat(*proposed).alias("candidates"), fold)


def _length_code(candidate):
    return candidate["kind"] * FEATURES["digits"] + candidate["digits"]


class Trees:
    """Boosted trees of depth two over feature codes, for the logistic loss.

    ``lengths`` are the lengths that true spans of a kind had; of others the trees saw
    nothing true, and their score would be a guess.
    """

    def __init__(self, cells: list[dict]):
        """``cells``: feature codes with counts ``yes`` and ``no``."""
        self.lengths = sorted({_length_code(c) for c in cells if c["yes"]})
        total = sum(c["yes"] + c["no"] for c in cells)
        yes = sum(c["yes"] for c in cells)
        share = min(max((yes + 0.5) / (total + 1.0), 1e-6), 1 - 1e-6)
        self.start = math.log(share / (1 - share))
        self.trees: list[tuple] = []
        scores = [self.start] * len(cells)
        for _ in range(ROUNDS):
            sums = []
            for cell, score in zip(cells, scores):
                p = 1 / (1 + math.exp(-score))
                n = cell["yes"] + cell["no"]
                sums.append((cell["yes"] - n * p, n * p * (1 - p)))
            tree = self._grow(cells, sums, range(len(cells)), 2)
            if tree[0] == "leaf":
                break
            self.trees.append(tree)
            scores = [s + self._value(tree, cell) for s, cell in zip(scores, cells)]

    @staticmethod
    def _leaf(sums, rows) -> tuple:
        g, h = sum(sums[i][0] for i in rows), sum(sums[i][1] for i in rows)
        return ("leaf", RATE * max(-4.0, min(4.0, g / (h + LEAST_WEIGHT))))

    def _grow(self, cells, sums, rows, depth: int) -> tuple:
        g, h = sum(sums[i][0] for i in rows), sum(sums[i][1] for i in rows)
        best = (1e-6, None)
        for feature, levels in FEATURES.items() if depth else ():
            by_level = [[0.0, 0.0] for _ in range(levels)]
            for i in rows:
                slot = by_level[cells[i][feature]]
                slot[0] += sums[i][0]
                slot[1] += sums[i][1]
            for level, (a, b) in enumerate(by_level):
                if b > 0 and h - b > 0:
                    gain = (
                        a * a / (b + LEAST_WEIGHT)
                        + (g - a) ** 2 / (h - b + LEAST_WEIGHT)
                        - g * g / (h + LEAST_WEIGHT)
                    )
                    if gain > best[0]:
                        best = (gain, (feature, level))
        if best[1] is None:
            return self._leaf(sums, rows)
        feature, level = best[1]
        inside = [i for i in rows if cells[i][feature] == level]
        outside = [i for i in rows if cells[i][feature] != level]
        return (
            feature,
            level,
            self._grow(cells, sums, inside, depth - 1),
            self._grow(cells, sums, outside, depth - 1),
        )

    def _value(self, tree: tuple, cell) -> float:
        while tree[0] != "leaf":
            tree = tree[2] if cell[tree[0]] == tree[1] else tree[3]
        return tree[1]

    def score(self, cell) -> float:
        return self.start + sum(self._value(tree, cell) for tree in self.trees)

    def column(self, candidate: Column) -> Column:
        """The score as an expression over a candidate's feature codes."""

        def nested(tree: tuple) -> Column:
            if tree[0] == "leaf":
                return F.lit(float(tree[1]))
            feature, level, inside, outside = tree
            return F.when(candidate[feature] == level, nested(inside)).otherwise(nested(outside))

        return reduce(lambda a, b: a + b, map(nested, self.trees), F.lit(float(self.start)))


def _limits(scored: list[tuple[int, float, int, int]]) -> list[float]:
    """Per kind, the lowest score above which spans are true often enough.

    ``scored``: kind, score, and numbers of true and false spans.
    """
    limits = []
    for kind in range(len(KINDS)):
        own = sorted(((score, y, n) for k, score, y, n in scored if k == kind), reverse=True)
        limit, yes, no = math.inf, 0, 0
        for i, (score, y, n) in enumerate(own):
            yes, no = yes + y, no + n
            last_of_score = i + 1 == len(own) or own[i + 1][0] != score
            if last_of_score and yes >= SUPPORT and yes >= PRECISION * (yes + no):
                limit = score
        limits.append(limit)
    return limits


def _scored(trees: Trees, cells: list[dict]) -> list[tuple[int, float, int, int]]:
    return [(c["kind"], trees.score(c), c["yes"], c["no"]) for c in cells]


def calibrated(trees: Trees, cells: list[dict]) -> list[float]:
    """Per kind, the threshold over the scores that these trees give these cells."""
    return _limits(_scored(trees, cells))


def trained(found: DataFrame) -> tuple[Trees, list[float]]:
    """Trees fitted to all texts, and thresholds from scores of texts kept out of a fit."""
    cells = (
        found.select("__fold", F.explode("candidates").alias("c"))
        .filter("c.label IS NOT NULL")
        .groupBy("__fold", *(F.col(f"c.{name}").alias(name) for name in FEATURES))
        .agg(F.sum("c.label").alias("yes"), F.sum(1 - F.col("c.label")).alias("no"))
        .orderBy("__fold", *FEATURES)
    )
    rows = [row.asDict() for row in cells.collect()]  # at most FOLDS * CELLS rows
    scored = []
    for fold in range(FOLDS):
        kept_out = [c for c in rows if c["__fold"] == fold]
        scored += _scored(Trees([c for c in rows if c["__fold"] != fold]), kept_out)
    return Trees(rows), _limits(scored)


def _listed(kind: str, spans: Column) -> Column:
    return F.transform(
        F.array_sort(spans),
        lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")),
    )


def personal_spans(docs: DataFrame, *carried: str) -> DataFrame:
    """The carried columns and, per text, base and added spans.

    ``email``, ``ip``, ``card`` and ``phone`` are the base spans, ``added`` the
    spans of the method with their kind.  Null texts are empty; texts of any length are
    read whole; every row counts, repeated ones too.  Of overlapping candidates the one
    of the higher score stays, of equal ones the earlier, then the longer, then the
    first kind.  A table without labelled candidates adds nothing.  No carried column
    may have the name of a kind or ``added``.
    """
    clashing = {c.lower() for c in carried} & {*KINDS, "added", "candidates"}
    if clashing:
        raise ValueError(f"rename these columns first: {sorted(clashing)}")
    found = stored(found_spans(docs, *carried), "personal-spans")
    trees, limits = trained(found)
    limit = lambda c: F.element_at(F.array(*map(F.lit, limits)), c["kind"] + 1)
    scored = F.transform(
        F.filter("candidates", lambda c: ~c["covered"] & _length_code(c).isin(trees.lengths)),
        lambda c: F.struct(
            (-trees.column(c)).alias("rank"),
            c["start"].alias("start"),
            (-c["end"]).alias("minus_end"),
            c["kind"].alias("kind"),
            limit(c).alias("limit"),
        ),
    )
    chosen = F.aggregate(
        F.array_sort(F.filter(scored, lambda c: -c["rank"] >= c["limit"])),
        F.array().cast("array<struct<start:int,end:int,kind:int>>"),
        lambda kept, c: F.when(
            F.exists(kept, lambda k: (k["start"] < -c["minus_end"]) & (k["end"] > c["start"])), kept
        ).otherwise(
            F.array_append(
                kept,
                F.struct(
                    c["start"].alias("start"), (-c["minus_end"]).alias("end"), c["kind"].alias("kind")
                ),
            )
        ),
    )
    return found.select(*carried, *KINDS, chosen.alias("added"))


def op1_personal_data(spark, sf_dir: str) -> DataFrame:
    """Counts and places of personal data in every document.

    Null and empty texts have none.  Each row is answered by itself, so ids may be null
    or repeat; an empty table gives no rows.  Columns beside doc_id and text are not read.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = personal_spans(docs, "doc_id")
    base = F.concat(*(_listed(k, F.col(k)) for k in KINDS))
    every = F.concat(
        *(
            _listed(
                k,
                F.concat(
                    F.col(k),
                    F.transform(
                        F.filter("added", _of_kind(i)),
                        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")),
                    ),
                ),
            )
            for i, k in enumerate(KINDS)
        )
    )
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"),
        F.concat_ws(",", every).alias("spans"),
    )
