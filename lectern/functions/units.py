"""Quantities in text: ambiguity, scientific notation, units, and the comparison of two quantities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.binding import let

#: What a unit is in nM, and how each field is read.
NANOMOLAR = {"pM": 0.001, "nM": 1.0, "uM": 1000.0, "μM": 1000.0, "µM": 1000.0, "mM": 1e6, "M": 1e9}
NUMERIC_FIELDS = {
    "Binding_Kinetics_KD": "concentration", "Binding_EC50": "concentration", "Binding_Kinetics_kon": "scientific",
    "Binding_Kinetics_koff": "scientific", "Thermal_Stability_Tm": "temperature",
}
SEVERAL = r"(?i)\b(and|or|to|~|–|—|respectively)\b|,\s*\d|[;；]|>\s*\d|<\s*\d|±|\brange\b"
POWER = r"(-?\d+\.?\d*)\s*[×xX\*]\s*10\s*\^?\s*[\(\[]?\s*(-?\d+)\s*[\)\]]?"
EXPONENT = r"^[=≈~:]*\s*(-?\d+\.?\d*)\s*[eE]\s*([+-]?\d+)"
UNIT = r"(pM|nM|[μµu]M|mM|M)\b"
MEASURED = r"(\d+\.?\d*)\s*(pM|nM|[μµu]M|mM|M)\b"
BARE = r"^[=≈~:KDkdECec50]*\s*(\d+\.?\d*)\s*$"
RAISED = ("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+")


def _number(text: Column) -> Column:
    return text.try_cast("double")


def several(text: Column) -> Column:
    """Whether text holds a range, a list or more than one number; then it is left undecided."""
    t = F.translate(text, RAISED[0], "^" * len(RAISED[0]))  # raised digits are letters to no word boundary
    t = F.regexp_replace(t, r"[×xX\*]\s*10\s*\^?\s*[\(\[]?\s*-?\d+\s*[\)\]]?", "")
    t = F.regexp_replace(t, r"\d+\.?\d*[eE][+-]?\d+", "NUM")
    t = F.regexp_replace(t, r"\b1/[A-Za-z]+", "")
    raised = text.rlike(f"[{RAISED[0]}]")
    count = F.size(F.regexp_extract_all(t, F.lit(r"(\b\d+\.?\d*\b)"), F.lit(1)))
    # with raised exponents the 10 stays joined to its power and is no number of its own
    count = F.when(raised, F.size(F.regexp_extract_all(F.regexp_replace(t, r"10\^+", "P"), F.lit(r"(\b\d+\.?\d*\b)"), F.lit(1)))).otherwise(count)
    return text.rlike(SEVERAL) | (count > 1)


def scientific(text: Column) -> Column:
    """a e b at the start, a x 10^b anywhere, or with a raised exponent; null otherwise."""

    def of(t: Column) -> Column:
        flat = F.regexp_replace(F.translate(F.regexp_replace(t, r"(10)([⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺]+)", "$1^$2"), *RAISED), r"\^\+", "^")
        # the mantissa and the exponent, apart, from the first of the patterns that holds
        found = F.array(*[F.when(s.rlike(p), F.array(F.regexp_extract(s, p, 1), F.regexp_extract(s, p, 2))) for s, p in ((t, EXPONENT), (flat, POWER))])
        pair = F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))
        return let(pair, lambda x: _number(F.get(x, F.lit(0))) * F.pow(F.lit(10.0), _number(F.get(x, F.lit(1)))))

    return let(F.trim(text), of)


def _factor(unit: Column) -> Column:
    out = F.lit(1.0)
    for name, nm in NANOMOLAR.items():
        out = F.when(unit == name, F.lit(nm)).otherwise(out)
    return out


def concentration(text: Column) -> Column:
    """Value in nM; a bare number is nM, scientific notation with no known unit stays as it is."""

    def of(x: Column) -> Column:
        t, sci, unit = x["t"], x["sci"], x["unit"]
        value = F.regexp_extract(t, MEASURED, 1)
        return (
            F.when(sci.isNotNull(), sci * _factor(unit))
            .when(value != "", _number(value) * _factor(F.regexp_extract(t, MEASURED, 2)))
            .otherwise(_number(F.nullif(F.regexp_extract(t, BARE, 1), F.lit(""))))
        )

    t = F.trim(text)
    return let(F.struct(t.alias("t"), scientific(t).alias("sci"), F.regexp_extract(t, UNIT, 1).alias("unit")), of)


def temperature(text: Column) -> Column:
    """The first number if it lies between 20 and 120 degrees."""
    first = _number(F.nullif(F.regexp_extract(F.trim(text), r"(\d+\.?\d*)", 1), F.lit("")))
    return let(first, lambda n: F.when(n.between(20, 120), n))


def quantity(field: Column, text: Column) -> Column:
    """Value of text as the field is read; null where it is blank, ambiguous or not understood."""
    kinds = {k: [f for f, x in NUMERIC_FIELDS.items() if x == k] for k in ("concentration", "scientific", "temperature")}

    def of(x: Column) -> Column:
        t, f = x["t"], x["f"]
        first = _number(F.nullif(F.regexp_extract(t, r"(-?\d+\.?\d*)", 1), F.lit("")))
        value = (
            F.when(f.isin(kinds["concentration"]), concentration(t))
            .when(f.isin(kinds["scientific"]), scientific(t))
            .when(f.isin(kinds["temperature"]), temperature(t))
            .otherwise(first)
        )
        return F.when((t != "") & ~several(t), value)

    return let(F.struct(F.trim(F.coalesce(text, F.lit(""))).alias("t"), field.alias("f")), of)


def numeric_label(gt: Column, pred: Column) -> Column:
    """exact within a tenth, partial within threefold, else wrong; null where either is null."""
    ratio = F.try_divide(pred, gt)
    fold = F.when(ratio > 0, F.greatest(ratio, F.try_divide(gt, pred))).otherwise(F.lit(float("inf")))
    near = F.try_divide(F.abs(pred - gt), F.abs(gt)) <= 0.10
    zero = F.when(gt == 0, F.when(pred == 0, "exact").otherwise("wrong"))
    return F.when(gt.isNotNull() & pred.isNotNull(), F.coalesce(zero, F.when(near, "exact").when(fold <= 3.0, "partial").otherwise("wrong")))


def sort_key(text: Column) -> Column:
    """KD in nM for sorting: `<` halves, no unit is nM, no value comes last."""
    value = concentration(F.regexp_replace(F.coalesce(text, F.lit("")), "[<>]", " "))
    return F.coalesce(F.when(F.contains(text, F.lit("<")), value / 2).otherwise(value), F.lit(float("inf")))


def metric_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", "")
