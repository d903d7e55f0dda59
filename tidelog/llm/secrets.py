"""Secret scans: rule spans, and spans of high sliding-window entropy (DataFrame functions only).

Spark's functions give the texts of all matches but not where they are; splitting the text by the same pattern gives what lies between
them, and running sums over the lengths of both give every span. Each span is looked at once; only references to spans are copied as their array grows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import let

# The rules' patterns, in the order in which kinds at the same start are listed.
ASSIGN = (
    r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

#: Candidate strings of the entropy method: 20 characters or more; those with digits and letters are looked at.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Strings that look random but are no secrets: UUIDs, and documentation's examples.
ALLOWED = (r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"EXAMPLE|example")
WINDOW = 20
#: Bits per character that a window needs, by the class of the candidate: hex digits only, or letters and digits of all sorts.
THRESHOLDS = {"hex": 3.0003, "mixed": 3.7003}


SPANS = "array<struct<start:int,kind:int,end:int,text:string>>"  # in this order spans sort by start, then kind


def _spans(kind: str, between: Column, found: Column, keep: Column | None = None) -> Column:
    """The spans (see SPANS) of matches, from the pieces between them and the matches themselves; of those that `keep` (an array beside them) holds for."""
    if keep is None:
        keep = F.transform(found, lambda _: F.lit(True))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))
    steps = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("b"), found.alias("m"), keep.alias("k"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["b"])
        end = start + F.char_length(x["m"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), x["m"].alias("text"))
        return F.struct(end.alias("at"), F.when(x["k"], F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(steps, zero, step, lambda acc: acc["out"])


def rule_spans(text: Column, kind: str, pattern: str, group: int = 0, least: int = 1) -> Column:
    """Leftmost non-overlapping matches of pattern whose group has `least` characters."""
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    keep = F.transform(F.regexp_extract_all(text, p, F.lit(group)), lambda g: F.char_length(g) >= least) if group else None
    spans = _spans(kind, F.split(text, pattern, -1), found, keep)
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPANS))


def _plogp(n: Column) -> Column:
    return F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def peak_entropy(s: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits per character, of any window of s.

    Counts are kept per distinct character and change by one for the character that enters and the one that leaves, and with
    them the sum of n*log2(n); no window is counted anew.
    """
    def best(codes: Column, size: Column) -> Column:
        """codes: each character's place in the alphabet of `size`."""
        zero = F.struct(F.array_repeat(F.lit(0), size).alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

        def step(acc: Column, i: Column) -> Column:
            into, out = F.get(codes, i), F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(-1))
            counts = F.transform(acc["n"], lambda n, j: n + F.when(j == into, 1).otherwise(0) - F.when(j == out, 1).otherwise(0))
            a, b = F.get(acc["n"], into), F.when(out >= 0, F.get(acc["n"], out)).otherwise(F.lit(0))
            change = F.when(into == out, F.lit(0.0)).otherwise(
                _plogp(a + 1) - _plogp(a) + F.when(out >= 0, _plogp(b - 1) - _plogp(b)).otherwise(F.lit(0.0)))
            total = acc["sum"] + change
            entropy = F.when(i >= window - 1, F.log2(F.lit(float(window))) - total / window).otherwise(F.lit(0.0))
            return F.struct(counts.alias("n"), total.alias("sum"), F.greatest(acc["best"], entropy).alias("best"))

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero, step, lambda acc: acc["best"])

    of = lambda chars, alphabet: let(F.transform(chars, lambda c: F.array_position(alphabet, c).cast("int") - 1), lambda codes: best(codes, F.size(alphabet)))
    return let(F.split(s, ""), lambda chars: let(F.array_distinct(chars), lambda alphabet: of(chars, alphabet)))


def entropy_spans(text: Column, window: int = WINDOW, thresholds: dict = THRESHOLDS, allowed: tuple = ALLOWED) -> Column:
    """Candidates with a window of high entropy for their character class, without allow-listed ones."""
    all_of = rule_spans(text, "entropy", CANDIDATE)

    def secret(x: Column) -> Column:
        both = x["text"].rlike("[0-9]") & x["text"].rlike("[A-Za-z]")
        limit = F.when(x["text"].rlike("^[0-9a-fA-F]+$"), F.lit(thresholds["hex"])).otherwise(F.lit(thresholds["mixed"]))
        suppressed = F.lit(False)
        for pattern in allowed:
            suppressed = suppressed | x["text"].rlike(pattern)
        return both & ~suppressed & (peak_entropy(x["text"], window) >= limit)

    return F.filter(all_of, secret)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of start, kind, end, text) in code points, sorted by start, then by the order of KINDS.

    An entropy span that lies within a rule's span adds nothing and is left out. A null text counts as empty; rows stay as they
    are, repeated ones too; other columns are ignored.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    rules = docs.select(
        "doc_id",
        F.concat(rule_spans(t, "assign", ASSIGN, 1, 6), rule_spans(t, "access", ACCESS), rule_spans(t, "hex", HEX)).alias("rules"),
        entropy_spans(t).alias("entropy"),
    )
    both = rules.select("doc_id", F.sort_array(F.concat("rules", "entropy")).alias("spans"))
    zero = F.struct(F.lit(-1).alias("upto"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        # an entropy span lies within a rule's if one that begins no later ends no earlier
        rule = x["kind"] < KINDS.index("entropy")
        return F.struct(
            F.when(rule, F.greatest(acc["upto"], x["end"])).otherwise(acc["upto"]).alias("upto"),
            F.when(rule | (acc["upto"] < x["end"]), F.array_append(acc["out"], x)).otherwise(acc["out"]).alias("out"))

    return both.select("doc_id", F.aggregate("spans", zero, step, lambda acc: acc["out"]).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
