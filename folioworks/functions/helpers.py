"""The few steps that need Python: Arrow batches in, Arrow batches out."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tables

#: Python names of encodings whose web names differ from them.
_CODECS = {"gbk": "gb18030", "windows-874": "cp874", "shift_jis": "cp932", "euc-kr": "cp949", "big5": "big5hkscs"}


def decode_text(raw: bytes, encoding: str | None) -> str:
    """Bytes as text: bad bytes become U+FFFD, an unknown encoding counts as utf-8, a mark of byte order goes."""
    name = (encoding or "utf-8").lower()
    if name == "windows-1252":  # browsers give the five free places to control characters
        return "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in raw) if any(b in raw for b in b"\x81\x8d\x8f\x90\x9d") else raw.decode("cp1252")
    try:
        text = raw.decode(_CODECS.get(name, name), "replace")
    except LookupError:
        text = raw.decode("utf-8", "replace")
    return text.removeprefix("﻿")


@F.pandas_udf(T.StringType())
def decode_bytes(raw: pd.Series, encoding: pd.Series) -> pd.Series:
    return pd.Series([None if r is None else decode_text(bytes(r), e) for r, e in zip(raw, encoding, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def nfkc(x: pd.Series) -> pd.Series:
    return pd.Series([v if v is None or v.isascii() else unicodedata.normalize("NFKC", v) for v in x], dtype=object)


_ENTITY = re.compile(r"&(#x?[0-9a-f]+|[a-z][a-z0-9]*);", re.I)


def entity(m: re.Match) -> str:
    body = m[1]
    if body[0] != "#":
        return tables.ENTITIES.get(body.lower(), m[0])
    digits, base = (body[2:], 16) if body[1] in "xX" else (body[1:], 10)
    try:
        return chr(int(digits, base))
    except (ValueError, OverflowError):
        return m[0]


def decode_once(text: str) -> str:
    return _ENTITY.sub(entity, text)


@F.pandas_udf(T.StringType())
def decode_entities_once(x: pd.Series) -> pd.Series:
    return pd.Series([v if v is None or "&" not in v else decode_once(v) for v in x], dtype=object)
