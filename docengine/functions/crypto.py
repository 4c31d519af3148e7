"""Field encryption with AES-256-GCM: base64 of nonce, text and tag; the key is the password's SHA-256."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _key(password: str) -> Column:
    return F.lit(hashlib.sha256(password.encode()).digest())


def encrypt(c: Column, password: str) -> Column:
    return F.base64(F.aes_encrypt(c, _key(password), F.lit("GCM")))


def decrypt(c: Column, password: str) -> Column:
    """What cannot be decrypted is returned as it is."""
    plain = F.try_aes_decrypt(F.try_to_binary(c, F.lit("base64")), _key(password), F.lit("GCM"))
    return F.coalesce(plain.cast("string"), c)


def _on_fields(df: DataFrame, fields: list[str], f) -> DataFrame:
    for name in fields:
        head, _, rest = name.partition(".")
        if head not in df.columns:
            continue
        if rest:
            df = df.withColumn(head, F.when(F.col(head).isNotNull(), F.col(head).withField(rest, f(F.col(name)))))
        elif isinstance(df.schema[name].dataType, T.StringType):
            df = df.withColumn(name, f(F.col(name)))
    return df


def encrypt_fields(df: DataFrame, fields: list[str], password: str) -> DataFrame:
    """String fields, also of objects by a dotted path."""
    return _on_fields(df, fields, lambda c: encrypt(c, password))


def decrypt_fields(df: DataFrame, fields: list[str], password: str) -> DataFrame:
    return _on_fields(df, fields, lambda c: decrypt(c, password))
