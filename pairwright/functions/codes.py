"""Codes of decisions, confidence, quality and viewpoints, and columns made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POSTV, NEGTV, INCMP, UNKWN, UNREV = "POSTV", "NEGTV", "INCMP", "UNKWN", "UNREV"

# The integer and the text of each code.
EVIDENCE = {POSTV: (1, "Positive"), NEGTV: (0, "Negative"), INCMP: (2, "Incomparable"), UNKWN: (3, "Unknown"), UNREV: (None, "Unreviewed")}
META = {"null": (None, "NULL"), "diff": (0, "Different"), "same": (1, "Same")}
CONFIDENCE = {"guessing": (1, "Just Guessing"), "not_sure": (2, "Unsure"), "pretty_sure": (3, "Sure"), "absolutely_sure": (4, "Doubtless"), "unspecified": (None, "Unspecified")}
QUALITY = {"junk": (1, "Junk"), "poor": (2, "Poor"), "ok": (3, "OK"), "good": (4, "Good"), "excellent": (5, "Excellent"), "unspecified": (None, "Unspecified")}
UNINFERABLE = (INCMP, UNREV, UNKWN)
#: What each confidence adds to the weight of an edge in a cut.
CUT_WEIGHT = {"absolutely_sure": 4.0, "pretty_sure": 0.6, "not_sure": 0.2, "guessing": 0.0, "unspecified": 0.0}

# Viewpoints by number from 1, the faces of a rhombicuboctahedron; unknown has none.
VIEWS = (
    "right", "frontright", "front", "frontleft", "left", "backleft", "back", "backright",
    "up", "upfront", "upback", "upleft", "upright", "upfrontleft", "upfrontright", "upbackleft", "upbackright",
    "down", "downfront", "downback", "downleft", "downright", "downfrontleft", "downfrontright", "downbackleft", "downbackright",
)
_AXES = (("up", "down"), ("front", "back"), ("left", "right"))


def _vector(view: str) -> tuple[int, ...]:
    parts = view.replace("up", "+u").replace("down", "+d").replace("front", "+f").replace("back", "+b").replace("left", "+l").replace("right", "+r")
    return tuple((f"+{a[0]}" in parts) - (f"+{b[0]}" in parts) for a, b in _AXES)


def _touch(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether one face has all directions of the other and more."""
    pairs = list(zip(a, b, strict=True))
    return a != b and (all(x == y or x == 0 for x, y in pairs) or all(x == y or y == 0 for x, y in pairs))


def view_distance(a: str | None, b: str | None) -> int | None:
    """Steps from face to touching face; None if either is unknown."""
    if a not in VIEWS or b not in VIEWS:
        return None
    faces = [_vector(v) for v in VIEWS]
    goal, seen, steps = _vector(b), {_vector(a)}, 0
    while goal not in seen:
        seen |= {f for f in faces if any(_touch(f, s) for s in seen)}
        steps += 1
    return steps


def coded(column: Column, table: dict, default=None) -> Column:
    """The integer of a code; codes not listed give ``default``."""
    pairs = [F.lit(x) for code, (number, _) in table.items() if number is not None for x in (code, number)]
    return F.coalesce(F.create_map(*pairs)[column], F.lit(default).cast("int"))


def decoded(column: Column, table: dict, default: str) -> Column:
    """The code of an integer; null and unlisted integers give ``default``."""
    pairs = [F.lit(x) for code, (number, _) in table.items() if number is not None for x in (number, code)]
    return F.coalesce(F.create_map(*pairs)[column.cast("int")], F.lit(default))


def nice(column: Column, table: dict) -> Column:
    return F.create_map(*[F.lit(x) for code, (_, text) in table.items() for x in (code, text)])[column]


def view_table(spark: SparkSession) -> DataFrame:
    """(v1, v2, dist) of all pairs of viewpoints."""
    return spark.createDataFrame([(a, b, view_distance(a, b)) for a in VIEWS for b in VIEWS], "v1 string, v2 string, dist int")


def rectified(evidence: Column, meta: Column) -> Column:
    """The decision of an edge: ``same`` and ``diff`` decide where the evidence cannot; a contradiction is an error."""
    evidence = F.coalesce(evidence, F.lit(UNREV))
    open_ = evidence.isin(*UNINFERABLE)
    clash = F.raise_error(F.concat(F.lit("evidence "), evidence, F.lit(" contradicts meta decision "), meta))
    return (
        F.when((meta == "same") & open_, POSTV).when((meta == "diff") & open_, NEGTV)
        .when(((meta == "same") & (evidence == NEGTV)) | ((meta == "diff") & (evidence == POSTV)), clash).otherwise(evidence)
    )


def cut_weight(num_reviews: Column, prob_match: Column, confidence: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CUT_WEIGHT.items() for x in pair])
    return sum((F.coalesce(x, F.lit(0.0)) for x in (prob_match, table[F.coalesce(confidence, F.lit("unspecified"))])), F.coalesce(num_reviews.cast("double"), F.lit(0.0)))
