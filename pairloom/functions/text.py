"""String, token and array expressions. Everything here stays in the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that Python's str.strip removes.
WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
WHITESPACE_CLASS = r"[\s\x1c-\x1f\x85\p{Z}]"
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]"
# Strings without escapes and whole numbers have one spelling each.
PLAIN_JSON_PATTERN = r'\A(?:"[^"\\]*"|0|-?[1-9][0-9]*)\z'
# These and lists or objects are never equal; a fraction of zeros is dropped unparsed while doubles are exact.
NESTED_JSON_PATTERN = r"\A[\[{]"
WHOLE_JSON_PATTERN = r"\A(?:0|-?[1-9][0-9]{0,14})\.0+\z"
JSON_TOKEN_PATTERN = r'"(?:[^"\\]|\\.)*+"|[^\s,:\[\]{}"]+|[,:\[\]{}]'


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def space_pieces(col: Column) -> Column:
    """Number of pieces between single spaces; the empty string has one."""
    return F.octet_length(col) - F.octet_length(F.replace(col, F.lit(" "), F.lit(""))) + 1


def tokens(col: Column) -> Column:
    """Lower-cased words and single other characters, Unicode-aware."""
    return F.regexp_extract_all(F.lower(col), F.lit(TOKEN_PATTERN), F.lit(0))


def tokens_sql(col: str) -> str:
    """The same tokens as SQL text; a null text has none."""
    return f"regexp_extract_all(lower(coalesce({col}, '')), r'{TOKEN_PATTERN}', 0)"


def canonical_json(col: Column) -> Column:
    """JSON text in one spelling: keys sorted, booleans as 1/0, whole numbers without a fraction.

    Text that is no JSON stays as it is.
    """

    def spell(tok: Column) -> Column:
        number = tok.try_cast("double")
        whole = (number == F.floor(number)) & (F.abs(number) < F.lit(2.0**53))
        return (
            F.when(tok.startswith('"'), tok)
            .when(tok == "true", F.lit("1"))
            .when(tok == "false", F.lit("0"))
            # A failing cast raises an exception inside, which costs far more than a pattern.
            .when(~tok.rlike(r"^-?[0-9]"), tok)
            .when(tok.rlike(r"^-?[0-9]+$") & (tok != "-0"), tok)
            .when(whole, number.cast("bigint").cast("string"))
            .when(number.isNotNull(), number.cast("string"))
            .otherwise(tok)
        )

    ordered = F.to_json(F.try_parse_json(col))
    toks = F.regexp_extract_all(ordered, F.lit(JSON_TOKEN_PATTERN), F.lit(0))
    return F.coalesce(F.array_join(F.transform(toks, spell), ""), col)


def json_equal(left: Column, right: Column) -> Column:
    """Equality of JSON values. Only what plain spellings cannot decide is parsed."""
    plain = {side: col.rlike(PLAIN_JSON_PATTERN) for side, col in (("left", left), ("right", right))}
    apart = (plain["left"] & right.rlike(NESTED_JSON_PATTERN)) | (plain["right"] & left.rlike(NESTED_JSON_PATTERN))

    def spelled(col: Column, known: Column) -> Column:
        whole = F.when(col.rlike(WHOLE_JSON_PATTERN), F.substring_index(col, ".", 1))
        # Longer numbers are read as doubles.
        return F.when(known & (col.startswith('"') | (F.length(col) <= 30)), col).otherwise(
            F.coalesce(whole, canonical_json(col))
        )

    return (
        F.when(left == right, True)
        .when((plain["left"] & plain["right"]) | apart, False)
        .otherwise(spelled(left, plain["left"]) == spelled(right, plain["right"]))
    )
