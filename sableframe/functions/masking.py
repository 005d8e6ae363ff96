"""Redaction of single values, all as column expressions inside code generation."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compact, trimmed

ACTIONS = ("keep", "mask", "hash", "tokenize", "generalize", "bucket", "suppress", "custom")


def hmac_sha256(message: Column, secret: str) -> Column:
    """Hex HMAC-SHA256 from two nested digests over the padded key."""
    if not secret:
        raise ValueError("a secret is needed")
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in key).hex() for pad in (0x36, 0x5C))
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), message.cast("binary")), 256)
    return F.lower(F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256))


def digest(text: Column, salt: str, secret: str) -> Column:
    """24 hex digits that depend on the value and its salt (owner, dataset, column)."""
    return F.substring(hmac_sha256(F.concat(F.lit(f"{salt}:"), text), secret), 1, 24)


def stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), F.greatest(n, F.lit(0)).cast("int"))


def keep_edges(text: Column, left: int, right: int) -> Column:
    n = F.char_length(text)
    tail = F.substring(text, -right, right) if right else F.lit("")
    return F.when(n <= left + right, stars(n)).otherwise(F.concat(F.substring(text, 1, left), stars(n - left - right), tail))


def mask(text: Column, entity_type: str) -> Column:
    if entity_type == "EMAIL":
        at = F.instr(text, "@")
        name = F.substring(text, F.lit(1), at - 1)
        return F.when(at > 0, F.concat(keep_edges(name, 1, 0), F.substring(text, at, F.char_length(text)))).otherwise(_plain_mask(text))
    if entity_type in {"PHONE", "BANK_CARD", "ID_CARD"}:
        return keep_edges(compact(text), 3, 4)
    return _plain_mask(text)


def _plain_mask(text: Column) -> Column:
    return F.when(F.char_length(text) <= 2, stars(F.char_length(text))).otherwise(keep_edges(text, 1, 1))


def generalize(text: Column, entity_type: str) -> Column:
    if entity_type == "DATE":
        pattern = "^([0-9]{4})[-/年]([0-9]{1,2})"
        year, month = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
        return F.when(year != "", F.concat_ws("-", year, F.lpad(month, 2, "0"))).otherwise("***")
    if entity_type == "ADDRESS":
        return F.when(F.char_length(text) > 6, F.concat(F.substring(text, 1, 6), F.lit("***"))).otherwise("***")
    return F.lit("***")


def bucket(text: Column) -> Column:
    """Size class of an amount; what isn't a finite number is hidden."""
    bare = F.regexp_replace(text, "[,¥￥]", "")
    x = F.when(bare.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"), F.btrim(bare).try_cast("double"))
    return (
        F.when(x.isNull(), "***").when(x < 1_000, "<1k").when(x < 10_000, "1k-10k").when(x < 100_000, "10k-100k").when(x < 1_000_000, "100k-1m").otherwise(">=1m")
    )


def redacted(value: Column, action: str, entity_type: str, salt: str, secret: str, params: dict[str, str] | None = None) -> Column:
    """A value under an action. Nulls and blank texts stay as they are, also when suppressed."""
    if action == "keep":
        return value
    text = trimmed(value)
    if action == "suppress":
        changed = F.lit(None).cast("string")
    elif action == "hash":
        changed = digest(text, salt, secret)
    elif action == "tokenize":
        changed = F.concat(F.lit(f"{entity_type}_"), F.substring(digest(text, salt, secret), 1, 12))
    elif action == "generalize":
        changed = generalize(text, entity_type)
    elif action == "bucket":
        changed = bucket(text)
    elif action == "custom":
        changed = F.lit((params or {}).get("replacement") or "***")
    else:
        changed = mask(text, entity_type)
    return F.when(value.isNull() | (text == ""), value.cast("string")).otherwise(changed)


def document_mask(text: Column, entity_type: Column) -> Column:
    """Masks inside running text, by type: a name keeps its first letter, numbers keep known parts."""
    n = F.char_length(text)
    return (
        F.when(entity_type == "PERSON", F.concat(F.substring(text, 1, 1), stars(n - 1)))
        .when((entity_type == "PHONE") & (n >= 11), F.concat(F.substring(text, 1, 3), F.lit("****"), F.substring(text, -4, 4)))
        .when((entity_type == "ID_CARD") & (n >= 18), F.concat(F.substring(text, 1, 6), F.lit("********"), F.substring(text, -4, 4)))
        .when((entity_type == "BANK_CARD") & (n >= 16), F.concat(stars(n - 4), F.substring(text, -4, 4)))
        .otherwise(stars(n))
    )


# -- made-up identifiers ----------------------------------------------------

#: Fixed values of the national identity number: weights and check letters.
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CHECKS = "10X98765432"


def fictional_id(seq: Column) -> Column:
    """18 characters with a valid check letter, in an area code that isn't given out."""
    body = F.concat(F.lit("99000019900101"), F.lpad((seq % 1000).cast("string"), 3, "0"))
    total = sum((F.substring(body, i + 1, 1).cast("int") * w for i, w in enumerate(ID_WEIGHTS)), F.lit(0))
    return F.concat(body, F.substring(F.lit(ID_CHECKS), total % 11 + 1, F.lit(1)))


def fictional_phone(seq: Column) -> Column:
    return F.concat(F.lit("199"), F.lpad((seq % 100_000_000).cast("string"), 8, "0"))


def fictional_card(seq: Column) -> Column:
    """19 digits that pass the Luhn test."""
    body = F.concat(F.lit("999900"), F.lpad((seq % 10**12).cast("string"), 12, "0"))
    total = F.lit(0)
    for i in range(18):
        d = F.substring(body, i + 1, 1).cast("int") * (2 if i % 2 else 1)
        total = total + F.when(d > 9, d - 9).otherwise(d)
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


def fictional_email(seq: Column) -> Column:
    return F.concat(F.lit("user"), F.lpad(seq.cast("string"), 4, "0"), F.lit("@example.com"))
