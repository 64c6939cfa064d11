"""Cleaning of raw model output."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions.ngrams import let
from pairloom.functions.text import WHITESPACE, WHITESPACE_CLASS, strip

FENCE_PATTERN = rf"```(?:python)?{WHITESPACE_CLASS}*\n?"
# One pattern per quote, outermost first; quotes that overlap leave nothing.
QUOTE_PATTERNS = (
    r'(?s)\A"""(?:(.*)"""|"{0,2})\z',
    r"(?s)\A'''(?:(.*)'''|'{0,2})\z",
    r'(?s)\A"(?:(.*)"|)\z',
    r"(?s)\A'(?:(.*)'|)\z",
)
FUNCTION_NAME_PATTERN = r"def ([\p{L}\p{N}_]+)"
SCORE_PATTERN = r"[1-5]"


def drop_fences(col: Column) -> Column:
    return F.replace(F.regexp_replace(col, FENCE_PATTERN, ""), F.lit("```"), F.lit(""))


def extract_function(col: str) -> Column:
    """The first function of a text: its def line and the lines that are blank or indented deeper.

    Without a def line the whole stripped text is returned. Both ends are always stripped. ``col``
    is a SQL expression, see ``ngrams`` for the reason.
    """

    def bare(line: str) -> str:
        return f"trim(LEADING '{WHITESPACE}' FROM {line})"

    def indent(line: str) -> str:
        return f"(length({line}) - length({bare(line)}))"

    def first(flags: str) -> str:
        return f"cast(array_position({flags}, true) as int)"

    stripped = f"trim(BOTH '{WHITESPACE}' FROM body)"
    head = "get(lines, start - 1)"
    leaves = f"transform(rest, x -> {bare('x')} <> '' and {indent('x')} <= base)"
    kept = let("stop", first(leaves), "if(stop = 0, rest, slice(rest, 1, greatest(stop - 1, 0)))")
    cut = let(
        "rest", "slice(lines, start + 1, size(lines))", let("base", indent(head), f"concat(array({head}), {kept})")
    )
    function = let("body", f"array_join({cut}, char(10))", stripped)
    starts = first(f"transform(lines, x -> startswith({bare('x')}, 'def '))")
    found = let(
        "lines",
        "split(body, char(10), -1)",
        let("start", starts, f"if(start = 0, {stripped}, {function})"),
    )
    text = f"replace(regexp_replace({col}, r'{FENCE_PATTERN}', ''), '```', '')"
    whole = f"if(contains(body, 'def '), {found}, {stripped})"
    return F.expr(let("body", text, whole))


def clean_docstring(col: Column) -> Column:
    """Strip, drop fences, then unwrap each kind of quote once, then strip."""
    text = drop_fences(strip(col))
    for pattern in QUOTE_PATTERNS:
        text = F.regexp_replace(text, pattern, "$1")
    return strip(text)


def function_name(code: Column, sample_id: Column) -> Column:
    """Name after the first ``def``, else ``sample_<id>``."""
    name = F.regexp_extract(F.coalesce(code, F.lit("")), FUNCTION_NAME_PATTERN, 1)
    return F.coalesce(
        F.nullif(name, F.lit("")), F.concat(F.lit("sample_"), sample_id.cast("string"))
    )


def parse_judge_score(col: Column) -> Column:
    """First digit 1-5 anywhere in the reply, else 0."""
    digit = F.regexp_extract(F.coalesce(col, F.lit("")), SCORE_PATTERN, 0)
    return F.coalesce(digit.try_cast("int"), F.lit(0))


def truncate_response(col: Column, limit: int) -> Column:
    """Cut after ``limit`` characters and mark the cut; a missing text becomes empty."""
    cut = F.concat(F.substring(col, 1, limit), F.lit("..."))
    return F.coalesce(F.when(F.length(col) > limit, cut).otherwise(col), F.lit(""))
