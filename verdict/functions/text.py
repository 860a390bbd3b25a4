"""Text functions: normal forms, tokens, trigrams, page quality, redaction."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no function for it."""
    return texts.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def folded(texts: pd.Series) -> pd.Series:
    """Compatibility composition, then case folding."""
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


@F.pandas_udf(T.ArrayType(T.StringType()))
def folded_each(texts: pd.Series) -> pd.Series:
    """Each text of an array, folded; the texts of a row cross to Python together."""
    fold = lambda x: None if x is None else x.lower() if x.isascii() else unicodedata.normalize("NFKC", x).casefold()
    return texts.map(lambda row: None if row is None else [fold(x) for x in row])


def spaced(text: Column) -> Column:
    """Punctuation (Unicode P) becomes a space, white space collapses, ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\p{P}", " "), r"\s+", " "))


def excerpt(text: Column, limit: int = 320) -> Column:
    return F.substring(text, 1, limit)


def words(text: Column) -> Column:
    """The runs of letters and digits, in lower case, in their order."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def tokens(text: Column, most: int | None = None) -> Column:
    """The distinct tokens of 2 to 64 letters and digits, in lower case and in order; the first `most` of them."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " ")
    distinct = F.sort_array(F.array_distinct(F.filter(words, lambda w: F.length(w).between(2, 64))))
    return F.slice(distinct, 1, most) if most else distinct


def trigrams(text: Column) -> Column:
    """The distinct trigrams of each word, padded with two spaces before and one after."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, 3)))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of two trigram arrays; 0 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared.cast("double"), F.size(a) + F.size(b) - shared), F.lit(0.0))


#: Fixed values of rule version quality-v1.
QUALITY_V1 = {"characters": 20, "alphanumeric": 0.25, "replacement": 0.05, "run": 20}


def quality_measures(text: Column) -> dict[str, Column]:
    solid = F.length(F.regexp_replace(text, r"\s", ""))
    alphanumeric = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    replaced = F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))
    return {
        "solid": solid,
        "alphanumeric_ratio": alphanumeric / F.greatest(solid, F.lit(1)),
        "replacement_ratio": replaced / F.greatest(F.length(text), F.lit(1)),
        "long_run": text.rlike(rf"(?s)(.)\1{{{QUALITY_V1['run']}}}"),
    }


def quality(text: Column) -> Column:
    """OCR_REQUIRED for pages with too little, too odd or too repetitive text, else TEXT_SUFFICIENT."""
    m, v = quality_measures(text), QUALITY_V1
    poor = (m["solid"] < v["characters"]) | (m["alphanumeric_ratio"] < v["alphanumeric"]) | (m["replacement_ratio"] > v["replacement"]) | m["long_run"]
    return F.when(poor, "OCR_REQUIRED").otherwise("TEXT_SUFFICIENT")


REDACTED = "[REDACTED]"

# What counts as a mail address, a number of a resident, a telephone and a labelled document number, and the
# labels before and after a labelled identity. Digits, spaces and word boundaries are those of Unicode.
MAIL = r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,63}\b"
RESIDENT = r"(?<![\d*])\d{6}\s*-\s*[\d*]{7}(?![\d*])"
PHONE = r"(?<!\d)(?:\+82[- .]?)?0?(?:1[016789]|2|[3-6][1-5])[- .]?\d{3,4}[- .]?\d{4}(?!\d)"
NUMBER_LABELS = (r"(?:(?:보\s*험\s*)?증\s*권|계\s*약)\s*번\s*호", r"(?:policy|contract|certificate)\s*(?:number|no\.?|id)")
NUMBER = r"[A-Z0-9][A-Z0-9._/-]{4,}"
IDENTITY_LABELS = (
    r"계약자(?:명)?", r"피\s*보\s*험\s*자(?:\s*성\s*명|\s*명)?", r"보험\s*수익자", r"수익자(?:명)?", "성명", "이름", "주소", "거주지", "소재지", "생년월일", "주민등록번호",
    "policyholder", r"insured(?!\s+amount\b)(?:\s+(?:person|name))?", r"beneficiary(?:\s+name)?", r"full\s+name", r"customer\s+name", "address", r"date\s+of\s+birth",
)
NEXT_LABELS = (
    "보험사", "상품명", "계약일", "보험기간", "보장기간", "보장개시일", "보장종료일", "계약상태", "담보명", "가입금액", "통화", "갱신여부", r"증\s*권\s*번\s*호", r"계\s*약\s*번\s*호",
    "insurer", r"product(?:\s+name)?", r"contract\s+(?:date|status)", r"coverage\s+(?:start|end)", r"rider(?:\s+name)?", r"insured\s+amount", "currency", "renewable", r"policy\s+(?:number|no\.?|id)",
)
VALUE_CHARS = 800


def _redactions() -> list[tuple[str, str]]:
    """Patterns and what stands for a match. Neighbours are looked at but not consumed, so adjacent numbers all go."""
    any_of = lambda labels: "(?:" + "|".join(labels) + ")"
    whole = lambda labels: f"{any_of(labels)}(?![가-힣A-Z])"
    ends = rf"(?=[;|\r\n]|\s+{whole(IDENTITY_LABELS + NEXT_LABELS)}\s*[:#]?|\z)"
    labelled = f"$1: {REDACTED}"
    return [
        (MAIL, REDACTED), (RESIDENT, REDACTED), (PHONE, REDACTED),
        (rf"({any_of(NUMBER_LABELS)})\s*[:#]?\s*{NUMBER}", labelled),
        (rf"((?<![가-힣A-Z]){whole(IDENTITY_LABELS)})\s*[:#]?\s*.{{2,{VALUE_CHARS}}}?{ends}", labelled),
    ]


PATTERNS = _redactions()


def redacted(text: Column, terms: tuple[str, ...] = (), limit: int | None = 240) -> Column:
    """text without identifiers and the given terms; redaction comes before the cut to `limit` characters."""
    for pattern, to in PATTERNS:
        text = F.regexp_replace(text, f"(?iU){pattern}", to)
    for term in terms:
        text = F.regexp_replace(text, "(?iU)" + re.escape(term), REDACTED)
    return F.substring(text, 1, limit) if limit else text
