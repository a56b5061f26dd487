"""Heading patterns of statutes as Column predicates and extracts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: The headings of a statute.
CHAPTER, SUBSECTION = r"^(제\d+장)(?:\s+(.+))?$", r"^(제\d+절)(?:\s+(.+))?$"
CHAPTER_UI, SUBSECTION_UI = r"^(제\d+장(?:의\d+)?)(?:\s+(.+))?$", r"^(제\d+절(?:의\d+)?)(?:\s+(.+))?$"
ARTICLE = r"^(제\d+조(?:의\d+)?)(?:\(([^)]*)\))?(?:\s+(.*))?$"
TITLED = r"^제\d+조(?:의\d+)?\([^)]*\)(?:\s|$)"
#: What may stand after a heading without title.
MARKERS = ("삭제", "신설", "생략")


@dataclass
class Heading:
    is_one: Column
    number: Column
    title: Column
    content: Column | None = None


def _group(line: Column, pattern: str, k: int) -> Column:
    got = strip(F.regexp_extract(line, pattern, k))
    return F.when(got != "", got)


def chapter(line: Column, allow_ui: bool = False) -> Heading:
    p = CHAPTER_UI if allow_ui else CHAPTER
    return Heading(line.rlike(p), _group(line, p, 1), _group(line, p, 2))


def subsection(line: Column, allow_ui: bool = False) -> Heading:
    p = SUBSECTION_UI if allow_ui else SUBSECTION
    return Heading(line.rlike(p), _group(line, p, 1), _group(line, p, 2))


#: How supplements begin, in the present and the older form, and the note after the older one.
SUPPLEMENT = r"^부칙(?:\s+.*)?$"
OLD_SUPPLEMENT, OLD_NOTE = r"^부칙\s*(?:<.*>)?$|^부칙\s+", r"^<.*(?:법률|대통령령|총리령|부령|시행령|시행규칙).*?>$"


def supplementary(line: Column) -> Column:
    return line.rlike(SUPPLEMENT)


def article(line: Column) -> Heading:
    """A heading without title counts only if nothing or one of MARKERS follows."""
    content = strip(F.regexp_extract(line, ARTICLE, 3))
    titled = line.rlike(TITLED)
    is_one = line.rlike(ARTICLE) & (titled | (content == "") | content.isin(*MARKERS))
    return Heading(is_one, _group(line, ARTICLE, 1), F.when(titled, strip(F.regexp_extract(line, ARTICLE, 2))), content)


#: The headings that the older parser accepts.
OLD_DUPLICATED = r"^(제\d+조)(\1)(?:\s*\(([^)]*)\))?(?:\s+|$)(.*)$"
OLD_ARTICLE = r"^(제\d+조)(?:\s*\(([^)]*)\))?(?:\s+|$)(.*)$"
OLD_RANGE = r"^(제\d+조부터\s+제\d+조까지)(?:\s+(.+))?$"


def article_old(line: Column) -> tuple[Heading, Column]:
    """The older parser: a doubled number, an ordinary heading with any content, a range. Also whether doubled."""
    doubled, plain, span = line.rlike(OLD_DUPLICATED), line.rlike(OLD_ARTICLE), line.rlike(OLD_RANGE)

    def pick(a, b, c):
        return F.when(doubled, _group(line, OLD_DUPLICATED, a)).when(plain, _group(line, OLD_ARTICLE, b)).when(span, _group(line, OLD_RANGE, c) if c else F.lit(None))

    return Heading(doubled | plain | span, pick(1, 1, 1), pick(3, 2, 0), F.when(doubled | plain | span, F.coalesce(pick(4, 3, 2), F.lit("")))), doubled


def supplementary_old(line: Column) -> Column:
    return line.rlike(OLD_SUPPLEMENT)


def supplementary_note(line: Column) -> Column:
    """The line after a supplementary heading that names the amending law."""
    return line.rlike(OLD_NOTE)
