"""Quality rules: a ledger of failure bits and measurements, judged by policies.

Method.  ``ledger`` measures every text once and evaluates every rule of
``RULES`` once; it stores the measurements and one integer whose bit ``b`` says
that rule ``b`` failed.  ``apply_policy`` compares that integer with a versioned
policy, a mask of the rules that reject.  ``ablation`` finds, for every rule of a
policy, how many rows it rejects, rejects alone, and how many come back without
it: sums over bitwise tests of the ledger, without a look at the texts.

Everything is a built-in expression over one row, so a ledger is a map without a
shuffle, and an ablation is one aggregate with map-side sums over a fixed number
of columns.  Repeated five-word windows are found by sorting 64-bit hashes of a
text's windows with their places.

Words are ``[^\\x20\\x09-\\x0D]+``.  Defined cases: a null text has no words, like
an empty one; ratios over nothing are 0.  Very long texts are measured whole.
Repeated rows are judged each; an empty table gives an empty ledger.  Extra
columns are kept; those with the name of a ledger column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.llm.naming import unused

WINDOW = 5
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\f\r"

#: Bit, name, and the condition under which a text fails.
RULES: tuple[tuple[int, str, str], ...] = (
    (0, "few_words", "n_words < 10"),
    (1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    (2, "many_symbols", "10 * n_symbols > n_words"),
    (3, "repeated_lines", "2 * n_dup_lines > n_lines"),
    (4, "shouting", "n_exclaims > 4 and 3 * n_exclaims > n_words"),
    (5, "long_words", "word_chars > 25 * n_words"),
    (6, "short_words", "2 * word_chars < 3 * n_words"),
    (7, "no_sentence", "n_words >= 50 and n_stops = 0"),
)
BIT = {name: bit for bit, name, _ in RULES}
BASE = ("few_words", "repeated_windows")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims", "n_stops")


@dataclass(frozen=True)
class Policy:
    version: str
    rejecting: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << BIT[name] for name in self.rejecting)


POLICIES = {
    "v1": Policy("v1", BASE),
    "v2": Policy("v2", (*BASE, "many_symbols", "repeated_lines", "shouting", "long_words", "short_words", "no_sentence")),
}


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(_without(text, chars))


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns that no later filter or projection can take apart and evaluate again.

    Catalyst moves filters below projections by repeating their expressions; it
    does not do so below a generator, here one that makes a single row.
    """
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def ledger(docs: DataFrame) -> DataFrame:
    """``docs`` with the measurements and the failure bits ``failed`` of every rule."""
    out = docs.drop(*MEASURES, "failed")
    t, w, l, s, d = own = unused(out, "_t", "_w", "_l", "_s", "_d")  # noqa: E741
    hashes = ", ".join(f"get({w}, i + {k})" for k in range(WINDOW))
    out = _once(out, **{t: F.coalesce(F.col("text"), F.lit(""))})
    words = F.expr(f"filter(split({t}, '[ \\\\t-\\\\r]+'), w -> w <> '')")
    lines = F.expr(f"filter(split({t}, '\\n'), l -> translate(l, ' \\t\\n\\u000b\\f\\r', '') <> '')")
    out = _once(out, **{w: words, l: lines})
    # Sorted (hash, place) pairs of all windows; neighbours with one hash are repeats.
    out = _once(out, **{s: F.expr(f"if(size({w}) < {WINDOW}, array(), sort_array(transform(sequence(0, size({w}) - {WINDOW}), i -> struct(xxhash64({hashes}) as h, i as i))))")})
    out = _once(out, **{d: F.expr(f"sort_array(transform(filter({s}, (x, j) -> x.h = get({s}, j - 1).h or x.h = get({s}, j + 1).h), x -> x.i))")})
    measures = {
        "n_words": F.size(w),
        "word_chars": F.length(_without(F.col(t), _SPACE)),
        "n_symbols": _count(F.col(t), SYMBOLS),
        "n_lines": F.size(l),
        "n_dup_lines": F.size(l) - F.size(F.array_distinct(l)),
        "n_repeat_words": F.expr(f"aggregate({d}, struct(0L as n, -{WINDOW} as at), (a, i) -> struct(a.n + least({WINDOW}, i - a.at) as n, i as at), a -> a.n)"),
        "n_exclaims": _count(F.col(t), "!"),
        "n_stops": _count(F.col(t), ".!?"),
    }
    out = _once(out, **{name: c.cast("long") for name, c in measures.items()})
    bits = " + ".join(f"if({rule}, {1 << bit}L, 0L)" for bit, _, rule in RULES)
    return out.withColumn("failed", F.expr(bits)).drop(*own)


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """A ledger with ``kept``: none of the policy's rules failed."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0)


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: rows it fails, rows only it rejects, rows kept with and without it."""
    hit = F.col("failed").bitwiseAND(F.lit(policy.mask))
    one = {name: 1 << BIT[name] for name in policy.rejecting}
    sums = [F.count("*").alias("n"), F.count_if(hit == 0).alias("kept")]
    for name, bit in one.items():
        sums += [F.count_if(hit.bitwiseAND(F.lit(bit)) != 0).alias(f"fail_{name}"), F.count_if(hit == bit).alias(f"alone_{name}")]
    total = rows.agg(*sums)
    each = F.array(*[F.struct(F.lit(policy.version).alias("policy"), F.lit(name).alias("rule"), F.col("n"), F.col(f"fail_{name}").alias("failed"), F.col(f"alone_{name}").alias("failed_alone"), F.col("kept"), (F.col("kept") + F.col(f"alone_{name}")).alias("kept_without")) for name in one])
    return total.select(F.inline(each))
