"""Column expressions: coercion, labels, probabilities and evidence. No UDFs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S


def quoted(name: str) -> Column:
    """Column by its exact name; flow features contain dots, slashes and blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def finite(value: Column) -> Column:
    """NaN and both infinities become null."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


# Decimal numbers with optional exponent, and the words for infinity and NaN.
NUMBER = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|(?i:inf(inity)?|nan))\s*$"


def parsed_cell(text: Column) -> Column:
    """A text cell as a number, infinities included, else null.

    The pattern keeps out ``1d``, ``1f`` and hex forms, which Java parses too, and spares
    the parser the failure on every word: a failed parse costs more than the match.
    """
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def numeric_cell(text: Column, to: str = "double") -> Column:
    """A text cell as a finite number, else null."""
    return finite(parsed_cell(text).cast(to))


def printable_label(label: Column) -> Column:
    """Label text with every run of non-printable or non-ASCII characters as one dash."""
    return F.trim(F.regexp_replace(F.coalesce(label.cast("string"), F.lit("nan")), r"[^\x20-\x7E]+", "-"))


def capture_day(file: Column) -> Column:
    """``Monday`` from ``monday-WorkingHours.csv``."""
    head = F.split_part(file, F.lit("-"), F.lit(1))
    return F.concat(F.upper(F.left(head, F.lit(1))), F.lower(F.substr(head, F.lit(2))))


def day_rank(day: Column) -> Column:
    """Position of a capture day in the week, null for any other token."""
    pairs = [F.lit(x) for i, d in enumerate(S.DAY_ORDER, start=1) for x in (d, i)]
    return F.try_element_at(F.create_map(*pairs), day)


def known_day(day: Column) -> Column:
    """The day when it is one of the ordered capture days, else null."""
    return F.when(day.isin(*S.DAY_ORDER), day)


def attack_flag(label: Column) -> Column:
    return (label != S.BENIGN).cast("tinyint")


def valid_label(label: Column) -> Column:
    text = F.trim(label.cast("string"))
    return label.isNotNull() & (text != "") & (F.lower(text) != "nan")


def is_benign(label: Column, label_column: str = "Label") -> Column:
    text = F.upper(F.trim(label.cast("string")))
    benign = text == S.BENIGN
    return benign | (text == "0") if label_column.lower() == "is_attack" else benign


def arg_max(classes: Sequence[str], probabilities: Column, largest: Column) -> Column:
    """Class whose probability is the ``largest``; the first class wins ties."""
    names = F.array(*[F.lit(c) for c in classes])
    return F.element_at(names, F.array_position(probabilities, largest).cast("int"))


def probability_map(classes: Sequence[str], probabilities: Column) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(c) for c in classes]), probabilities)


def normalised_entropy(probabilities: Column, n_classes: int) -> Column:
    """Entropy over its maximum; zero probabilities add nothing."""
    total = F.aggregate(
        F.filter(probabilities, lambda p: p > 0),
        F.lit(0.0),
        lambda acc, p: acc + p * F.ln(p),
    )
    return -total / F.ln(F.lit(float(n_classes)))


def missing_count(features: Sequence[str]) -> Column:
    cells = [F.when(quoted(f).isNull() | F.isnan(quoted(f).cast("double")), 1).otherwise(0) for f in features]
    return F.aggregate(F.array(*cells), F.lit(0), lambda acc, x: acc + x)


def largest_feature(features: Sequence[str]) -> Column:
    """Name of the observed value with the largest magnitude; the first column wins ties."""
    cells = [
        F.struct(
            F.abs(finite(quoted(f).cast("double"))).alias("size"),
            F.lit(-i).alias("place"),
            F.lit(f).alias("name"),
        )
        for i, f in enumerate(features)
    ]
    seen = F.filter(F.array(*cells), lambda c: c["size"].isNotNull())
    return F.array_max(seen)["name"]


def evidence(features: Sequence[str], confidence: Column) -> Column:
    """Evidence sentences for one scored row."""
    missing, largest = missing_count(features), largest_feature(features)
    return F.array_compact(F.array(
        F.when(missing > 0, F.concat(missing.cast("string"), F.lit(S.EVIDENCE_MISSING))),
        F.when(largest.isNotNull(), F.concat(F.lit(S.EVIDENCE_LARGEST), largest, F.lit("."))),
        F.when(confidence >= S.HIGH_CONFIDENCE, F.lit(S.EVIDENCE_SURE))
        .otherwise(F.lit(S.EVIDENCE_UNSURE)),
    ))


def feature_map(features: Sequence[str]) -> Column:
    return F.map_from_arrays(
        F.array(*[F.lit(f) for f in features]),
        F.array(*[quoted(f).cast("double") for f in features]),
    )


def iso_utc(micros: Column) -> Column:
    """ISO-8601 UTC text; the fraction is left out when it is zero."""
    at = F.timestamp_micros(micros)
    whole = F.pmod(micros, F.lit(1_000_000)) == 0
    return F.when(whole, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise(
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    )


def safe_ratio(top: Column, bottom: Column) -> Column:
    """0 when the denominator is empty."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))
