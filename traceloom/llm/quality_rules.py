"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements and one failure
bit per rule.  A policy is a named, versioned mask over those bits, so a change of policy, or
the question what a single rule costs, needs no second look at the texts.

All on the JVM, row by row, without a shuffle: repeated windows are found inside the row by
sorting the window hashes of one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.llm.shared import ANY_WORD_CHAR, fresh, words

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


@dataclass(frozen=True)
class Rule:
    """A rule fails where `fails` (SQL over the measurements) is true.  `bit` never changes its meaning."""

    bit: int
    name: str
    fails: str


#: Integer arithmetic only, so that every engine agrees.
RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 15 * n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 60 * n_lines"),
    Rule(4, "shouting", "100 * n_upper > 50 * word_chars"),
    Rule(5, "word_length", "word_chars > 20 * n_words or word_chars < 2 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules: a document is kept if none of them fails."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {r.name: r.bit for r in RULES}
        return sum(1 << bits[name] for name in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
STANDARD = Policy("standard", 1, tuple(r.name for r in RULES))


def ledger(docs: DataFrame, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, the kept columns, measurements (long) and `failures` (long bitmask).

    Null and empty texts measure zero everywhere and fail `few_words`.  Repeated rows and null ids
    stay as they are; other columns of docs are ignored, whatever their names.
    """
    base = docs.select(
        *[F.col(f"`{c}`") for c in (id, *keep)],
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"),
    )
    carried = [F.col(f"`{c}`") for c in (id, *keep)]
    split = base.select(
        *carried,
        words(F.col("_text")).alias("_words"),
        F.filter(F.split("_text", "\n", -1), lambda l: l.rlike(ANY_WORD_CHAR)).alias("_lines"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("_text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
    )
    hashed = split.select(
        *carried,
        "n_symbols",
        "n_upper",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _window_hashes(F.col("_words")).alias("_hashes"),
    )
    measured = hashed.withColumn(
        # only texts with a repeated window sort their windows
        "_starts",
        F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), _sorted(F.col("_hashes"))),
    ).withColumn("_starts", F.when(F.col("_starts").isNotNull(), _repeated(F.col("_starts"))))
    measured = measured.withColumn("n_repeat_words", _covered(F.col("_starts")))
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in RULES]
    failures = bits[0]
    for bit in bits[1:]:
        failures = failures.bitwiseOR(bit)
    # always zero, but not deterministic: a filter on the ledger must not move below the arrays, where
    # it would compute them anew for every word
    failures = failures.bitwiseOR(F.shiftright(F.monotonically_increasing_id(), 63))
    return measured.select(*carried, *MEASURES, failures.alias("failures"))


def _window_hashes(w: Column) -> Column:
    # 64 bits, compared only inside one text
    at = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)])
    return F.when(F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), at)).otherwise(
        F.array().cast("array<bigint>")
    )


def _sorted(hashes: Column) -> Column:
    return F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def _repeated(windows: Column) -> Column:
    """Starts, in order, of the windows whose neighbour in hash order has the same hash."""
    same = lambda x, i: F.coalesce(F.get(windows, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(
        F.get(windows, i + 1)["h"] == x["h"], F.lit(False)
    )
    return F.array_sort(F.transform(F.filter(windows, same), lambda x: x["i"]))


def _covered(starts: Column) -> Column:
    """Words covered by windows at these starts: each adds what the next one doesn't reach."""
    step = F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW))))
    return F.coalesce(F.aggregate(step, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0).cast("long"))


def kept(policy: Policy) -> Column:
    """Condition over a ledger: no rule of the policy fails."""
    return F.col("failures").bitwiseAND(F.lit(policy.mask)) == 0


def judge(book: DataFrame, policies: tuple[Policy, ...]) -> DataFrame:
    """The ledger with one boolean per policy, named `<name>_v<version>`."""
    return book.withColumns({f"{p.name}_v{p.version}": kept(p) for p in policies})


def ablation(book: DataFrame, policy: Policy) -> DataFrame:
    """What each rule of a policy does: documents it fails, and those that only it removes.

    The ledger shrinks to counts per failure pattern (at most 2^rules rows, combined before the
    shuffle); the rest is bit arithmetic on the patterns.  `removed_without` is what the policy
    would still remove if the rule were left out.
    """
    active = F.col("failures").bitwiseAND(F.lit(policy.mask))
    patterns = book.select(active.alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    wanted = F.array(
        *[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if r.name in policy.rules]
    )
    each = patterns.select("pattern", "n", F.explode(wanted).alias("r")).select("pattern", "n", "r.rule", "r.bit")
    hit = F.col("pattern").bitwiseAND(F.col("bit")) != 0
    zero = F.lit(0).cast("long")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), zero)
    return each.groupBy("rule").agg(
        total(hit).alias("failed"),
        total(F.col("pattern") == F.col("bit")).alias("failed_only_here"),
        total((F.col("pattern") != 0) & (F.col("pattern") != F.col("bit"))).alias("removed_without"),
    )


def keep_good(docs: DataFrame, policy: Policy = STANDARD, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with all their columns, that pass the policy."""
    row = fresh(docs, "row")
    packed = docs.select(F.struct("*").alias(row), F.col(f"`{id}`").alias("_id"), F.col(f"`{text}`").alias("_body"))
    return ledger(packed, "_id", "_body", keep=(row,)).where(kept(policy)).select(f"{row}.*")
