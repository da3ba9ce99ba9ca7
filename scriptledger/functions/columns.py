"""Column -> Column helpers. All are built-in expressions, so they stay inside
whole-stage code generation."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptledger.functions import rules


def first_match(
    test: Callable[[str], Column],
    ordered_rules: Iterable[tuple[str, Sequence[str]]],
    default: Column,
) -> Column:
    """Label of the first rule with a pattern for which ``test`` holds."""
    branches = [
        (reduce(or_, map(test, patterns)), label) for label, patterns in ordered_rules
    ]
    (condition, label), *rest = branches
    chain = F.when(condition, F.lit(label))
    for condition, label in rest:
        chain = chain.when(condition, F.lit(label))
    return chain.otherwise(default)


def banded(value: Column, bands: Iterable[tuple[float, str]], lowest: str) -> Column:
    """Label of the first band whose inclusive lower bound the value reaches."""
    ordered = [(label, [bound]) for bound, label in bands]
    return first_match(lambda bound: value >= F.lit(bound), ordered, F.lit(lowest))


def matches(text: Column) -> Callable[[str], Column]:
    """A ``LIKE`` test for ``first_match``. A pattern with an inner wildcard
    needs a regular expression, so plain searches for its pieces go first."""

    def test(pattern: str) -> Column:
        pieces = [text.contains(piece) for piece in pattern.split("%") if piece]
        whole = text.like(pattern)
        return reduce(and_, [*pieces, whole]) if len(pieces) > 1 else whole

    return test


# --- text -----------------------------------------------------------------


def npi(value: Column) -> Column:
    """Ten-character identifier; exports drop leading zeros."""
    return F.lpad(F.trim(value.cast("string")), 10, "0")


def key_text(value: Column) -> Column:
    return F.upper(F.trim(value))


def canonical_company(cleaned: Column) -> Column:
    """Parent company of a name that ``key_text`` has already cleaned."""
    return first_match(matches(cleaned), rules.COMPANY_RULES, cleaned)


def payment_category(nature: Column) -> Column:
    other = F.lit(rules.OTHER_CATEGORY)
    return first_match(matches(F.lower(nature)), rules.CATEGORY_RULES, other)


def canonical_specialty(specialty: Column) -> Column:
    fallback = F.coalesce(F.trim(specialty), F.lit(rules.UNKNOWN_SPECIALTY))
    return first_match(matches(F.lower(specialty)), rules.SPECIALTY_RULES, fallback)


def initcap_words(value: Column) -> Column:
    """Capitalise after every character that is not a letter or digit.

    The built-in ``initcap`` only starts a word after white space.
    """
    pieces = F.split(F.lower(value), r"(?<=[^\p{L}\p{N}])")
    return F.array_join(F.transform(pieces, F.initcap), "")


def company_display_name(company: Column) -> Column:
    named = [(shown, [name]) for name, shown in rules.COMPANY_DISPLAY_NAMES.items()]
    return first_match(lambda name: company == F.lit(name), named, initcap_words(company))


def display_id(physician: Column) -> Column:
    """Public label from the first 16 bits of a hash; always four characters."""
    leading_bits = F.conv(F.substring(F.md5(physician), 1, 4), 16, 10)
    return F.concat(F.lit(rules.DISPLAY_ID_PREFIX), F.lpad(leading_bits, 4, "0"))


def hashed_key(*parts: Column) -> Column:
    texts = [F.coalesce(part.cast("string"), F.lit(rules.KEY_NULL_TOKEN)) for part in parts]
    return F.md5(F.concat_ws("-", *texts))


def starts_with_any(value: Column, prefixes: Iterable[str]) -> Column:
    return reduce(or_, [value.startswith(prefix) for prefix in prefixes], F.lit(False))


def contains_any(value: Column, fragments: Iterable[str]) -> Column:
    return reduce(or_, [value.contains(fragment) for fragment in fragments], F.lit(False))


# --- numbers that may be redacted or badly written ------------------------


def whole_number(value: Column) -> Column:
    """Digits only, else NULL: a suppressed cell count is not zero."""
    text = F.trim(value.cast("string"))
    return F.when(text.rlike(r"^[0-9]+\z"), text.try_cast("int"))


def money(value: Column) -> Column:
    """Digits and points only, else NULL; a sign counts as redacted."""
    text = F.trim(value.cast("string"))
    return F.when(text.rlike(r"^[0-9.]+\z"), text.try_cast("decimal(14,2)"))


def lenient_number(text: Column) -> Column:
    """Number written as text, NULL if it is not one. Wide enough to compare
    before rounding to cents."""
    return text.try_cast("decimal(38,12)")


def lenient_count(text: Column) -> Column:
    """Whole number that may be written as ``155.0``."""
    number = lenient_number(text)
    return F.when(number == F.floor(number), number.try_cast("int"))


# Ways in which extracts write dates, with or without a time of day.
DATE_FORMATS = ["M/d/yyyy", "yyyy-M-d", "yyyy/M/d"]
TIMES = ["H:mm", "H:mm:ss", "h:mm:ss a"]


def lenient_date(text: Column) -> Column:
    """Date written as text, NULL if it is none; a time of day is cut off."""
    text = F.trim(text)
    days = [F.try_to_date(text, day) for day in DATE_FORMATS]
    moments = [F.try_to_timestamp(text, F.lit(f"{day} {time}")).cast("date") for day in DATE_FORMATS for time in TIMES]
    return F.coalesce(*days, *moments, text.try_cast("date"))


# --- labels ---------------------------------------------------------------


def size_bucket(amount: Column) -> Column:
    buckets = [(label, [bound]) for bound, label in rules.SIZE_BUCKETS]
    return first_match(
        lambda bound: amount < F.lit(bound), buckets, F.lit(rules.LARGEST_SIZE_BUCKET)
    )


def relationship_type(payment: Column, claims: Column) -> Column:
    """Which sides of a physician-company pair exist, before NULLs become 0."""
    return (
        F.when(payment.isNotNull() & claims.isNotNull(), rules.PAID_AND_PRESCRIBED)
        .when(payment.isNotNull(), rules.PAID_NO_RX)
        .when(claims.isNotNull(), rules.RX_NO_PAYMENT)
        .otherwise(rules.NEITHER)
    )


def kol_tier(percentile: Column) -> Column:
    return banded(percentile, rules.KOL_TIERS, rules.LOWEST_KOL_TIER)


def loyalty_segment(score: Column) -> Column:
    return banded(score, rules.LOYALTY_SEGMENTS, rules.LOWEST_LOYALTY_SEGMENT)


def market_class(
    investment_ratio: Column,
    null_label: str,
    over: float = rules.OVER_INVESTED_ABOVE,
    under: float = rules.UNDER_INVESTED_BELOW,
) -> Column:
    """Both bounds are open; a ratio on a bound is balanced."""
    return (
        F.when(investment_ratio.isNull(), null_label)
        .when(investment_ratio > F.lit(over), rules.OVER_INVESTED)
        .when(investment_ratio < F.lit(under), rules.UNDER_INVESTED)
        .otherwise(rules.BALANCED)
    )


def paid_group(is_paid: Column) -> Column:
    return F.when(is_paid, rules.PAID_GROUP).otherwise(rules.UNPAID_GROUP)


def paid_mark(is_paid: Column) -> Column:
    return F.when(is_paid, rules.PAID_MARK).otherwise(rules.UNPAID_MARK)


def valid_state(state: Column) -> Column:
    return state.isNotNull() & (F.length(state) == 2)


def known_specialty(specialty: Column) -> Column:
    return specialty.isNotNull() & (specialty != F.lit(rules.UNKNOWN_SPECIALTY))


def specialist(specialty: Column) -> Column:
    """A NULL specialty is not a specialist either."""
    return ~specialty.isin(rules.NOT_SPECIALISTS)
