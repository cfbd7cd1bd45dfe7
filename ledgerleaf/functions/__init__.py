"""Column to column functions; all of them built-in expressions, no Python workers."""

from ledgerleaf.functions.parsing import (
    local_time,
    parse_compact_date,
    parse_compact_datetime,
    parse_date,
    parse_datetime,
    to_bool,
    to_decimal,
)
from ledgerleaf.functions.text import (
    ascii_fold,
    az_phone,
    card_key,
    clip_error,
    file_date,
    gender_label,
    is_settlement_name,
    marital_label,
    mask_card,
    mask_iban,
    mask_tail,
    name_part,
    normalize_city,
    phone_valid,
    same_ignoring_case,
    title_case,
)

__all__ = [
    "ascii_fold",
    "az_phone",
    "card_key",
    "clip_error",
    "file_date",
    "gender_label",
    "is_settlement_name",
    "local_time",
    "marital_label",
    "mask_card",
    "mask_iban",
    "mask_tail",
    "name_part",
    "normalize_city",
    "parse_compact_date",
    "parse_compact_datetime",
    "parse_date",
    "parse_datetime",
    "phone_valid",
    "same_ignoring_case",
    "title_case",
    "to_bool",
    "to_decimal",
]
