"""Sentence BLEU as one expression per row: no shuffle of n-grams, no Python.

The clipped count of an order is a multiset intersection. It is computed as the common distinct
n-grams plus the common tags of repeated ones, both by hash set inside ``array_intersect``.
Arguments are SQL expressions, see ``ngrams``.
"""

from pairloom.functions.ngrams import extend, let, per_order, repeat_tags, run_lengths
from pairloom.schemas import BLEU_FLOOR, BLEU_ORDER

# Up to this many common words, looking each token up costs less than joining its n-grams.
MASK_LIMIT = 64


def reference_profile(toks: str, max_n: int = BLEU_ORDER) -> str:
    """Token count, and per order the distinct n-grams and repeat tags of a reference."""

    def entry(grams: str, n: int) -> str:
        return (
            f"named_struct('grams', array_distinct({grams}), 'tags', {repeat_tags(run_lengths(grams))})"
        )

    return f"named_struct('length', size({toks}), 'orders', {per_order(toks, max_n, entry)})"


def clipped_counts(toks: str, profile: str, max_n: int = BLEU_ORDER) -> str:
    """Clipped n-gram matches of a hypothesis against a reference profile, one entry per order.

    Where no n-gram matches, no longer one can, and longer ones are not built.
    """

    def hits(grams: str, n: int) -> str:
        ref = f"{profile}.orders[{n - 1}]"
        tags = repeat_tags(run_lengths("present"))
        repeats = f"if(size({ref}.tags) = 0, 0, size(array_intersect({tags}, {ref}.tags)))"
        found = f"size(array_intersect(present, {ref}.grams)) + {repeats}"
        return let("present", f"array_compact({grams})", f"if(size(present) = 0, 0, {found})")

    def level(grams: str, n: int) -> str:
        if n == max_n:
            return f"array({hits(grams, n)})"
        longer = f"g{n + 1}"
        rest = let(longer, extend(grams, "g1", n + 1), level(longer, n + 1))
        return let(f"h{n}", hits(grams, n), f"if(h{n} = 0, array_repeat(0, {max_n - n + 1}), concat(array(h{n}), {rest}))")

    # A token the reference lacks turns every n-gram over it into null; one null stands for a run of them.
    masked = let(
        "m",
        f"transform({toks}, t -> if(array_contains(common, t), t, null))",
        "filter(m, (t, i) -> t is not null or (i > 0 and get(m, i - 1) is not null))",
    )
    return let(
        "common",
        f"array_intersect({toks}, {profile}.orders[0].grams)",
        let("g1", f"if(size(common) <= {MASK_LIMIT}, {masked}, {toks})", level("g1", 1)),
    )


def bleu_score(toks: str, profile: str, max_n: int = BLEU_ORDER) -> str:
    """BLEU with smoothing of zero counts; 0 if either text has no token."""

    def log_precision(n: int) -> str:
        total, hits = f"(h - {n - 1})", f"hits[{n - 1}]"
        return (
            f"case when {total} <= 0 then ln({BLEU_FLOOR}D)"
            f" when {hits} = 0 then ln(1D / (2 * {total})) else ln({hits} / {total}) end"
        )

    mean = f"({' + '.join(log_precision(n) for n in range(1, max_n + 1))}) / {max_n}"
    value = f"least(1D, exp(1D - {profile}.length / h)) * exp({mean})"
    scored = let("hits", clipped_counts("toks", profile, max_n), value)
    guarded = f"if(h = 0 or {profile}.length = 0, 0D, {scored})"
    return let("toks", toks, let("h", "size(toks)", guarded))
