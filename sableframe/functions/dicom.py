"""Stable pseudonyms, shifted dates and mapped identifiers for medical-image tags."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .masking import hmac_sha256

VERSION = "v1"


def token_digest(purpose: str, value: Column, namespace: str, secret: str) -> Column:
    """Hex digest over version, namespace, purpose and value, each ended by a zero byte."""
    head = "\0".join((VERSION, namespace, purpose, ""))
    return hmac_sha256(F.concat(F.lit(head), value), secret)


def token(prefix: str, purpose: str, value: Column, namespace: str, secret: str, size: int = 20) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.upper(F.substring(token_digest(purpose, value, namespace, secret), 1, size)))


def pseudonym(patient: Column, namespace: str, secret: str) -> Column:
    return token("P", "patient", patient, namespace, secret)


def shift_days(patient: Column, namespace: str, secret: str, reach: int = 3650) -> Column:
    """Days by which a patient's dates move, from -reach to reach."""
    number = F.conv(F.substring(token_digest("date", patient, namespace, secret), 1, 16), 16, 10).cast("decimal(20,0)")
    return (number % (2 * reach + 1)).cast("int") - reach


def shifted_date(value: Column, days: Column) -> Column:
    """YYYYMMDD moved by days; YYYY and YYYYMM move with their first day; else null."""
    full = F.to_date(F.when(value.rlike("^[0-9]{8}$"), value), "yyyyMMdd")
    month = F.to_date(F.when(value.rlike("^[0-9]{6}$"), F.concat(value, F.lit("01"))), "yyyyMMdd")
    year = F.to_date(F.when(value.rlike("^[0-9]{4}$"), F.concat(value, F.lit("0101"))), "yyyyMMdd")
    return F.coalesce(
        F.date_format(F.date_add(full, days), "yyyyMMdd"), F.date_format(F.date_add(month, days), "yyyyMM"), F.date_format(F.date_add(year, days), "yyyy")
    )


@F.pandas_udf(StringType())
def uid_of_hex(digest: pd.Series) -> pd.Series:
    """2.25 and the first 128 bits as a number; 39 digits are beyond any column type."""
    return digest.map(lambda x: None if x is None else f"2.25.{int(x[:32], 16)}")


def uid(source: Column, namespace: str, secret: str) -> Column:
    return uid_of_hex(token_digest("uid", source, namespace, secret))


def patient_key(patient_id: Column, name: Column, birth: Column, sex: Column, study: Column) -> Column:
    """The id, else name, birth and sex together, else the study."""
    several = F.concat_ws("|", F.coalesce(name, F.lit("")), F.coalesce(birth, F.lit("")), F.coalesce(sex, F.lit("")))
    return F.coalesce(F.nullif(F.btrim(patient_id), F.lit("")), F.nullif(several, F.lit("||")), study)


def hashed_reference(key: Column) -> Column:
    return F.sha2(key.cast("binary"), 256)
