"""Scalar functions over residues, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: symbols of the RNA alphabet in the order of their codes.
SYMBOLS = "ACGU-RYMKSWHBVDN*~"
#: Fixed value: base pairs that are canonical.
CANONICAL_PAIRS = ("AU", "UA", "GC", "CG", "GU", "UG")
ILLEGAL = 254


def digitize(seq: Column) -> Column:
    """Codes of a sequence; T counts as U, X as N, I as A, dots and underscores as gaps, others are illegal."""
    plain = F.translate(F.upper(seq), "TXI_.", "UNA--")
    return F.transform(F.split(plain, ""), lambda c: F.when(F.instr(F.lit(SYMBOLS), c) > 0, F.instr(F.lit(SYMBOLS), c) - 1).otherwise(ILLEGAL))


def textize(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.when(c < len(SYMBOLS), F.substring(F.lit(SYMBOLS), c + 1, F.lit(1))).otherwise("?")), "")


def reverse_complement(seq: Column) -> Column:
    """Only the four canonical residues are complemented; degenerate ones stay."""
    return F.reverse(F.translate(seq, "ACGU", "UGCA"))


def count_of(seq: Column, residues: str) -> Column:
    """How many residues of these a sequence has."""
    return F.length(seq) - F.length(F.translate(seq, residues, ""))


def gc_canonical(seq: Column) -> Column:
    """Share of G and C among canonical residues; 0.5 if there are none."""
    n = count_of(seq, "ACGU")
    return F.when(n > 0, count_of(seq, "GC") / n).otherwise(0.5)


def gc_span(seq: Column) -> Column:
    """Share of G and C in a span, degenerate residues included."""
    return F.when(F.length(seq) > 0, count_of(seq, "GC") / F.length(seq)).otherwise(0.0)


def frequency(seq: Column, residue: str) -> Column:
    n = count_of(seq, "ACGU")
    return F.when(n > 0, count_of(seq, residue) / n).otherwise(0.25)


#: Fixed value: what each degenerate symbol stands for.
DEGENERATE = {"R": "AG", "Y": "CU", "M": "AC", "K": "GU", "S": "CG", "W": "AU", "H": "ACU", "B": "CGU", "V": "ACG", "D": "AGU", "N": "ACGU"}
#: The mean posterior probability that each posterior code stands for.
CODE_MEANS = {"*": 0.975, "0": 0.025} | {str(d): d / 10 for d in range(1, 10)}


def is_residue(symbol: Column) -> Column:
    return symbol.isin(*"ACGU", *DEGENERATE)


def is_gap(symbol: Column) -> Column:
    return symbol.isin("-", ".", "_")


def is_missing(symbol: Column) -> Column:
    return symbol.isin("*", "~")


def expected_count(seq: Column, residue: str) -> Column:
    """How often a sequence is expected to hold a residue, where a degenerate symbol counts as an equal share of each of its own."""
    shares = [count_of(seq, x) / len(members) for x, members in DEGENERATE.items() if residue in members]
    return sum(shares, count_of(seq, residue).cast("double"))


def members(symbol: Column) -> Column:
    """The canonical residues of a symbol as an array; empty for gaps and missing data."""
    known = {x: [x] for x in "ACGU"} | {x: list(m) for x, m in DEGENERATE.items()}
    table = F.create_map(*(y for x, m in known.items() for y in (F.lit(x), F.array(*map(F.lit, m)))))
    return F.coalesce(F.element_at(table, symbol), F.array().cast("array<string>"))


def _of(scores: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(y) for x, v in scores.items() for y in (x, float(v))))


def average_score(symbol: Column, scores: dict[str, float]) -> Column:
    """Mean score of what a symbol stands for; 0 where it is no residue."""
    total = F.aggregate(members(symbol), F.lit(0.0), lambda t, x: t + F.element_at(_of(scores), x))
    return F.when(is_residue(symbol), total / F.size(members(symbol))).otherwise(0.0)


def average_integer_score(symbol: Column, scores: dict[str, float]) -> Column:
    """The mean rounded half away from zero."""
    mean = average_score(symbol, scores)
    return F.when(mean < 0, F.ceil(mean - 0.5)).otherwise(F.floor(mean + 0.5)).cast("int")


def expected_score(symbol: Column, scores: dict[str, float], null: dict[str, float]) -> Column:
    """Mean score of what a symbol stands for, weighted by the null model; 0 where it is no residue."""
    weighted = F.aggregate(members(symbol), F.lit(0.0), lambda t, x: t + F.element_at(_of(scores), x) * F.element_at(_of(null), x))
    weight = F.aggregate(members(symbol), F.lit(0.0), lambda t, x: t + F.element_at(_of(null), x))
    return F.when(is_residue(symbol), weighted / weight).otherwise(0.0)


def pair_score(left: Column, right: Column, scores: dict[str, float]) -> Column:
    """Mean score over all pairs that two symbols stand for; scores has pairs such as "AU". -1e7 with a gap or missing data, 0 with a nonresidue."""
    each = F.flatten(F.transform(members(left), lambda x: F.transform(members(right), lambda y: F.element_at(_of(scores), F.concat(x, y)))))
    mean = F.aggregate(each, F.lit(0.0), lambda t, v: t + v) / F.size(each)
    return F.when(left.isin("-", "~") | right.isin("-", "~"), -1e7).otherwise(F.coalesce(mean, F.lit(0.0)))


def is_canonical_pair(left: Column, right: Column) -> Column:
    return F.concat(left, right).isin(*CANONICAL_PAIRS)


def without_gaps(seq: Column) -> Column:
    return F.regexp_replace(seq, "[-_.~]", "")


def embedded(background: Column, seq: Column, start: Column) -> Column:
    """A background sequence with another one in the place of its residues from start (1-based)."""
    return F.overlay(background, seq, start)


def without_pseudoknots(structure: Column) -> Column:
    return F.regexp_replace(structure, "[A-Za-z]", ".")


def checksum(codes: Column) -> Column:
    """Jenkins' one-at-a-time hash of an array of codes, as an unsigned 32-bit number in a long."""
    low = lambda x: x.bitwiseAND(F.lit(4294967295))
    shifted = lambda h, n: low(h + F.shiftleft(h, n))
    mixed = lambda h, n: h.bitwiseXOR(F.shiftright(h, n))
    step = lambda h, c: mixed(shifted(low(h + c), 10), 6)
    return F.aggregate(codes, F.lit(0).cast("long"), step, lambda h: shifted(mixed(shifted(h, 3), 11), 15))


def justified(block: Column, left: bool = True) -> Column:
    """An insert block with its residues moved to one side and its gaps to the other."""
    residues, pad = F.regexp_replace(block, "[-.]", ""), F.rpad if left else F.lpad
    return pad(residues, F.length(block), F.lit("."))


def text_width(n: Column) -> Column:
    """Places that an integer takes, its sign included; 0 takes none."""
    return F.when(n == 0, 0).otherwise(F.length(n.cast("string")))


def probability_text(p: Column, null: float = 0.25) -> Column:
    return F.when(p == 0, "*").otherwise(F.format_string("%.3f", F.log(p / null) * 1.44269504))


def probability_of_text(text: Column, null: float = 0.25) -> Column:
    return F.when(text == "*", 0.0).otherwise(F.exp(text.cast("double") / 1.44269504) * null)


def posterior_code(p: Column) -> Column:
    return F.when(p + 0.05 >= 1, "*").otherwise(F.floor((p + 0.05) * 10).cast("string"))


def mean_of_code(code: Column) -> Column:
    return F.coalesce(F.element_at(_of(CODE_MEANS), code), F.lit(0.0))


def truncation_label(from_span: Column, to_span: Column, from_emit: Column, to_emit: Column) -> Column:
    five, three = from_emit != from_span, to_emit != to_span
    return F.when(five & three, "5'&3'").when(five, "5'").when(three, "3'").otherwise("no")
