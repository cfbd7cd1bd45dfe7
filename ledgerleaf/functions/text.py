"""Text expressions: case, masks, phones, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerleaf.functions.folding import ascii_fold
from ledgerleaf.functions.parsing import parse_date
from ledgerleaf.schemas import (
    GENDERS,
    MARITAL_STATUSES,
    SETTLEMENT_PREFIX,
    SETTLEMENT_SUFFIX,
    UNKNOWN,
)

# Letters that have case, and the space: ``initcap`` is right within a run of these.
_WORDS = r"\p{LC} "

# The masks.
CARD_MASK = "**** **** **** "
IBAN_MASK = "AZ**********************"


def same_ignoring_case(c: Column, text: str) -> Column:
    """Equality without regard to case; spaces count, null never matches."""
    return F.lower(c) == text.lower()


def title_case(c: Column) -> Column:
    """Capital after every character that is not a letter: ``e2e test`` gives ``E2E Test``.

    ``initcap`` alone starts words at spaces only; it answers directly where nothing
    but letters and spaces occurs, and run by run elsewhere.
    """
    runs = F.regexp_extract_all(c, F.lit(f"[{_WORDS}]+|[^{_WORDS}]+"), F.lit(0))
    by_run = F.array_join(F.transform(runs, lambda run: F.initcap(run)), "")
    return F.when(c.rlike(f"[^{_WORDS}]"), by_run).otherwise(F.initcap(c))


def mask_tail(c: Column, prefix: str, keep: int = 4) -> Column:
    """``prefix`` and the last ``keep`` characters; null stays null."""
    return F.concat(F.lit(prefix), F.right(c, F.lit(keep)))


def mask_card(c: Column) -> Column:
    return mask_tail(c, CARD_MASK)


def mask_iban(c: Column) -> Column:
    return mask_tail(c, IBAN_MASK)


def card_key(c: Column, salt: str) -> Column:
    """A salted digest that tells two cards with the same last four digits apart."""
    return F.sha2(F.concat(F.lit(salt), c), 256)


def name_part(c: Column, index: int) -> Column:
    """Item ``index`` of the text split at single spaces, or null where it is missing."""
    return F.get(F.split(c, " "), F.lit(index))


def normalize_city(c: Column) -> Column:
    return ascii_fold(title_case(c))


def az_phone(c: Column) -> Column:
    """Digits only, with the country code: a leading ``994`` or one ``0`` is replaced by it."""
    digits = F.regexp_replace(c, r"[^\p{Nd}]", "")
    return F.when(c != "", F.regexp_replace(digits, "^(994|0)?", "+994"))


def phone_valid(c: Column) -> Column:
    """Whether a cleaned phone is the country code and nine digits."""
    return F.coalesce(c.rlike(r"^\+994\d{9}$"), F.lit(False))


def _label(key: Column, labels: dict[str, str]) -> Column:
    pairs = [F.lit(text) for pair in labels.items() for text in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(UNKNOWN))


def gender_label(c: Column) -> Column:
    """By the first letter, in any case."""
    return _label(F.lower(F.left(c, F.lit(1))), GENDERS)


def marital_label(c: Column) -> Column:
    """The known statuses as they are, spelled exactly."""
    return _label(c, MARITAL_STATUSES)


def is_settlement_name(c: Column) -> Column:
    """Prefix in any case, suffix in lower case only."""
    return F.upper(c).startswith(SETTLEMENT_PREFIX) & c.endswith(SETTLEMENT_SUFFIX)


def file_date(c: Column) -> Column:
    """The date after the eight-letter prefix of a settlement file name, or null."""
    return parse_date(F.substring(c, 9, 10))


def clip_error(c: Column, length: int = 2000) -> Column:
    """Head and tail of an error text, without repeating a short one."""
    return F.when(F.length(c) <= 2 * length, c).otherwise(
        F.concat(F.left(c, F.lit(length)), F.right(c, F.lit(length)))
    )
