"""Column functions for cleaning and naming text: Column in, Column out, no Python workers
but for NFKC, which Spark doesn't have."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values of the publisher's page furniture.
PUBLISHER, MINISTRY = "국가법령정보센터", "법제처"
LAW_TYPES = "법률|대통령령|총리령|부령|헌법|법규명령"
PHONE = r"\b\d{2,4}-\d{3,4}-\d{4}\b"
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
_EDGE = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]+"


@F.pandas_udf(StringType())
def _nfkc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def normalize_unicode(x: Column) -> Column:
    """NFKC; zero-width characters go; no-break and ideographic spaces become spaces."""
    return F.translate(F.translate(_nfkc(x), " 　", "  "), "​‌‍﻿", "")


def strip(x: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(x, f"^{_EDGE}|{_EDGE}$", "")


def clean_line(x: Column, nfkc: bool = True) -> Column:
    return strip(F.regexp_replace(normalize_unicode(x) if nfkc else x, r"[ \t]+", " "))


def clean_text(x: Column, nfkc: bool = True) -> Column:
    """Runs of blanks are one space, none at line ends; at most one empty line in a row."""
    x = F.regexp_replace(normalize_unicode(x) if nfkc else x, r"[ \t]+", " ")
    return strip(F.regexp_replace(F.regexp_replace(x, r"[ \t]*\n[ \t]*", "\n"), r"\n{3,}", "\n\n"))


def clean_text_flat(x: Column, nfkc: bool = True) -> Column:
    """The older rule: empty lines go altogether."""
    x = F.regexp_replace(normalize_unicode(x) if nfkc else x, r"[ \t]+", " ")
    return strip(F.regexp_replace(x, r"(?U)\s*\n\s*", "\n"))


def is_noise_line(x: Column) -> Column:
    """Blank, or page furniture of the publisher."""
    return (strip(x) == "") | F.contains(x, F.lit(PUBLISHER)) | x.rlike(rf"(?U)^{MINISTRY}\s*\d*$") | x.rlike(PHONE)


def drop_noise_words(x: Column) -> Column:
    """The older rule: the publisher's names go, the rest of the line stays."""
    x = F.replace(strip(x), F.lit(PUBLISHER), F.lit(""))
    return strip(F.regexp_replace(F.regexp_replace(x, rf"(?U){MINISTRY}\s*\d+", ""), MINISTRY, ""))


def safe_id(x: Column) -> Column:
    x = F.regexp_replace(x, r"[^\p{L}\p{N}_\-]+", "_")
    return F.regexp_replace(F.regexp_replace(x, "_+", "_"), "^_+|_+$", "")


def fingerprint(x: Column) -> Column:
    """SHA-1 of the text without white space."""
    return F.sha1(F.regexp_replace(x, r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]+", "").cast("binary"))


def _none_if_empty(x: Column) -> Column:
    return F.when(x != "", x)


def short_law_name(x: Column) -> Column:
    """What stands before the first parenthesis; the whole name if nothing does; '' for null."""
    return F.coalesce(_none_if_empty(strip(F.regexp_extract(x, r"^([^(]+)", 1))), strip(x), F.lit(""))


def law_metadata(document: Column) -> dict[str, Column]:
    """law_name, law_type, law_number, effective_date (ISO text) from a document's name."""
    day = F.regexp_extract(document, r"(20\d{6})", 1)
    iso = F.concat_ws("-", F.substr(day, F.lit(1), F.lit(4)), F.substr(day, F.lit(5), F.lit(2)), F.substr(day, F.lit(7), F.lit(2)))
    return {
        "law_name": F.coalesce(_none_if_empty(strip(F.regexp_extract(document, r"^([^_]+)", 1))), document),
        "law_type": _none_if_empty(F.regexp_extract(document, f"(?:^|_)({LAW_TYPES})(?:_|$)", 1)),
        "law_number": _none_if_empty(F.regexp_extract(document, r"(제\d+호)", 1)),
        "effective_date": F.when(day != "", iso),
    }


def chunk_id(*parts: Column, part_index: Column | None = None) -> Column:
    """Parts that aren't null, joined and made safe; ``_partN`` where there is a part index."""
    tail = [] if part_index is None else [F.concat(F.lit("part"), part_index.cast("string"))]
    return safe_id(F.concat_ws("_", *parts, *tail))


def chunk_id_old(document: Column, section: Column, article: Column, part: Column) -> Column:
    return safe_id(F.concat_ws("_", document, section, article, F.when(part > 1, F.concat(F.lit("part"), part.cast("string")))))


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """RFC 4122 version 5 identifier of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(h.substr(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), F.concat(F.lit("5"), h.substr(14, 3)), F.concat(variant, h.substr(18, 3)), h.substr(21, 12))


def preview(x: Column, n: int) -> Column:
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit("..."))).otherwise(x)


def after_main_section(x: Column) -> Column:
    return F.element_at(F.split(x, "_본문_"), -1)


def article_number(article: Column) -> Column:
    """The number for sorting; 999999 where there is none."""
    return F.coalesce(F.regexp_extract(article, r"제\s*(\d+)\s*조", 1).try_cast("int"), F.lit(999_999))


def evaluation_title(text: Column, fixed: bool = True) -> Column:
    """The title in parentheses after an article's number; ``fixed`` false keeps the older pattern,
    which doesn't match a parenthesis that follows the character for article."""
    if fixed:
        return strip(F.regexp_extract(text, r"제\s*\d+\s*조(?:의\s*\d+)?\s*\(([^)]+)\)", 1))
    return strip(F.regexp_extract(text, r"제\s*\d+(?:조의\d+)?\s*\(([^)]+)\)", 1))
