"""Bronze to silver. Every step is narrow: no shuffle, no Python worker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf import functions as fn
from ledgerleaf.schemas import TITLE_CASED


def customers(bronze: DataFrame) -> DataFrame:
    """The twelve columns in place, then first_name and last_name."""
    return bronze.withColumns(
        {
            "first_name": fn.ascii_fold(fn.name_part(F.col("full_name"), 0)),
            "last_name": fn.ascii_fold(fn.name_part(F.col("full_name"), 1)),
            "birth_date": fn.parse_date(F.col("birth_date")),
            "registration_date": fn.parse_date(F.col("registration_date")),
            "gender": fn.gender_label(F.col("gender")),
            "marital_status": fn.marital_label(F.col("marital_status")),
            "email": F.lower("email"),
            "phone": fn.az_phone(F.col("phone")),
        }
    )


def card_transactions(bronze: DataFrame) -> DataFrame:
    """Completed transactions, typed and masked; columns keep their places."""
    completed = bronze.filter(fn.same_ignoring_case(F.col("transaction_status"), "completed"))
    return completed.withColumns(
        {
            "transaction_datetime": fn.parse_datetime(F.col("transaction_datetime")),
            "card_number": fn.mask_card(F.col("card_number")),
            "iban": fn.mask_iban(F.col("iban")),
            "currency": F.upper("currency"),
            **{name: fn.title_case(F.col(name)) for name in TITLE_CASED},
            "is_international": fn.to_bool(F.col("is_international")),
        }
    )
