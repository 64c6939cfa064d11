"""n-grams and multisets inside a row, as SQL expression text.

Text instead of nested Column calls: these expressions have hundreds of nodes, and building each
node from Python costs far more than parsing the whole. Arguments are SQL expressions. Tokens hold
no white space, so a space joins them without ambiguity.
"""


from collections.abc import Callable


def let(name: str, value: str, body: str) -> str:
    """Bind a value once; a plain reference inside a lambda is evaluated per element."""
    return f"transform(array({value}), {name} -> {body})[0]"


def extend(grams: str, toks: str, n: int) -> str:
    """n-grams out of (n-1)-grams and the tokens; null parts make null n-grams."""
    return (
        f"zip_with(slice({grams}, 1, greatest(size({grams}) - 1, 0)),"
        f" slice({toks}, {n}, greatest(size({toks}) - {n - 1}, 0)), (a, b) -> concat(a, ' ', b))"
    )


def run_starts(ordered: str) -> str:
    """Places from 0 where a sorted array has another value than before."""
    starts = f"filter(sequence(0, size({ordered}) - 1), i -> i = 0 or get({ordered}, i) <> get({ordered}, i - 1))"
    return f"if(size({ordered}) = 0, cast(array() as array<int>), {starts})"


def run_lengths(values: str) -> str:
    """Distinct values with their counts, by sorting: n log n for any text length."""
    runs = (
        "zip_with(st, concat(slice(st, 2, size(st)), array(size(s))),"
        " (a, b) -> named_struct('value', get(s, a), 'cnt', b - a))"
    )
    empty = "cast(array() as array<struct<value: string, cnt: int>>)"
    return let("s", f"sort_array({values})", f"if(size(s) = 0, {empty}, {let('st', run_starts('s'), runs)})")


def repeat_tags(runs: str) -> str:
    """One tag per occurrence beyond the first, so that multisets intersect like sets."""
    tags = "transform(sequence(2, r.cnt), k -> concat(r.value, ' ', cast(k as string)))"
    return f"flatten(transform(filter({runs}, r -> r.cnt > 1), r -> {tags}))"


def per_order(toks: str, max_n: int, entry: Callable[[str, int], str]) -> str:
    """Array of ``entry(grams, n)`` for n = 1..max_n, each order's n-grams built once from the last."""

    def level(grams: str, n: int) -> str:
        own = f"array({entry(grams, n)})"
        if n == max_n:
            return own
        longer = f"g{n + 1}"
        return let(longer, extend(grams, toks, n + 1), f"concat({own}, {level(longer, n + 1)})")

    return level(toks, 1)
