"""Lines of statutes -> articles: the heading state machine as windows over each document.

A document's lines are its window partition, so the work spreads over documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import headings as H
from ..functions import text as T

MAIN, SUPPLEMENT = "본문", "부칙"


def document_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines_a_page: int = 40) -> DataFrame:
    """(document string, page int, line_no int, line string) of every line of every text."""
    lines = docs.select(F.col(id_col).cast("string").alias("document"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("n", "line"))
    return lines.select("document", (F.floor(F.col("n") / lines_a_page) + 1).cast("int").alias("page"), (F.col("n") % lines_a_page).cast("int").alias("line_no"), "line")


def clean_lines(lines: DataFrame, nfkc: bool = True) -> DataFrame:
    """Lines cleaned, without blank and noise lines."""
    return once(lines, line=T.clean_line(F.col("line"), nfkc)).where(~T.is_noise_line(F.col("line")))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once, whatever filters and columns come after.

    The optimizer copies the expression of a plain column into every use of it, but not through a generator.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _number_and_title(h: H.Heading) -> Column:
    return F.struct(h.number.alias("number"), h.title.alias("title"))


def _latches(lines: DataFrame, allow_ui: bool) -> DataFrame:
    """The state in which each line is read: section, chapter, subsection and its kind of heading."""
    order = Window.partitionBy("document").orderBy("page", "line_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    line = F.col("line")
    chap, sub, art = H.chapter(line, allow_ui), H.subsection(line, allow_ui), H.article(line)
    lines = lines.withColumn("is_supp", H.supplementary(line))
    lines = lines.withColumn("n_supp", F.sum(F.col("is_supp").cast("int")).over(so_far))
    main = F.col("n_supp") == 0
    lines = lines.withColumn("is_chap", chap.is_one & main & ~F.col("is_supp")).withColumn("is_sub", sub.is_one & main & ~F.col("is_supp"))
    lines = lines.withColumn("is_art", art.is_one & ~(F.col("is_supp") | F.col("is_chap") | F.col("is_sub")))
    lines = lines.withColumn("n_chap", F.sum(F.col("is_chap").cast("int")).over(so_far))
    by_section = Window.partitionBy("document", "n_supp").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    by_chapter = Window.partitionBy("document", "n_supp", "n_chap").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.select(
        "*",
        F.when(main, MAIN).otherwise(SUPPLEMENT).alias("section"),
        F.last(F.when(F.col("is_chap"), _number_and_title(chap)), ignorenulls=True).over(by_section).alias("chapter"),
        F.last(F.when(F.col("is_sub"), _number_and_title(sub)), ignorenulls=True).over(by_chapter).alias("subsection"),
        F.row_number().over(order).alias("pos"),
    )


def articles(lines: DataFrame, allow_ui: bool = False, flush_at_chapters: bool = True) -> DataFrame:
    """Articles in order: document, seg, pos, section, chapter, subsection, article, title, lines, pages.

    A heading opens a segment; lines up to the next heading are its body. Lines before any
    article are dropped; articles without lines too. Chapter and subsection headings within the
    supplement are body text. With ``flush_at_chapters`` false a chapter heading doesn't end the
    open article and empty articles stay, as the older parser has it.
    """
    so_far = Window.partitionBy("document").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    state = _latches(lines, allow_ui)
    ends = F.col("is_supp") | F.col("is_art") | (F.col("is_chap") | F.col("is_sub") if flush_at_chapters else F.lit(False))
    return gather_articles(state.withColumn("seg", F.sum(ends.cast("int")).over(so_far)), flush_at_chapters)


def gather_articles(state: DataFrame, flush_at_chapters: bool = True) -> DataFrame:
    """Articles of lines that know their state: section, chapter, subsection, pos, seg and kind of heading."""
    art = H.article(F.col("line"))
    heading = F.col("is_chap") | F.col("is_sub") | F.col("is_supp")
    body = F.when(F.col("is_art"), F.when(art.content != "", art.content)).when(~heading, F.col("line"))
    state = state.withColumns({"body": body, "number": F.when(F.col("is_art"), art.number), "art_title": F.when(F.col("is_art"), art.title)})
    opening = F.when(F.col("is_art"), F.struct("pos", "section", "chapter", "subsection", F.col("number").alias("article"), F.col("art_title").alias("title")))
    kept = F.when(F.col("body").isNotNull(), F.struct("pos", "body"))
    out = state.groupBy("document", "seg").agg(
        F.min_by(opening, F.when(F.col("is_art"), F.col("pos"))).alias("o"), F.array_sort(F.collect_list(kept)).alias("body"), F.array_sort(F.collect_set("page")).alias("pages")
    )
    out = out.where(F.col("o").isNotNull() & ((F.size("body") > 0) | F.lit(not flush_at_chapters)))
    return out.select("document", "seg", "o.pos", "o.section", "o.chapter", "o.subsection", "o.article", "o.title", F.transform("body", lambda b: b["body"]).alias("lines"), "pages")


def merge_articles(arts: DataFrame) -> DataFrame:
    """One article for each (document, section, article), in order of first appearance.

    First chapter, subsection and title that aren't null; each line once, where it first
    stands; all pages, those of dropped lines too.
    """
    key = ["document", "section", "article"]
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("pos")))
    heads = arts.groupBy(*key).agg(F.min("pos").alias("pos"), first("chapter").alias("chapter"), first("subsection").alias("subsection"), first("title").alias("title"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"), F.array_sort(F.collect_list(F.struct("pos", "lines"))).alias("parts"))
    return heads.select("document", "section", "article", "pos", "chapter", "subsection", "title", F.array_distinct(F.flatten(F.transform("parts", lambda p: p["lines"]))).alias("lines"), "pages")


def article_text(arts: DataFrame, nfkc: bool = True) -> DataFrame:
    """Adds ``text``: heading and lines in one, cleaned; and the page range."""
    header = F.concat(F.col("article"), F.when(F.col("title").isNotNull(), F.concat(F.lit("("), F.col("title"), F.lit(")"))).otherwise(F.lit("")))
    body = F.filter(F.transform("lines", T.strip), lambda x: x != "")
    return once(arts, text=T.clean_text(F.concat_ws(" ", header, F.array_join(body, " ")), nfkc)).withColumns({"page_start": F.array_min("pages"), "page_end": F.array_max("pages")})


CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"


def structural_units(text: Column, fold_circled: bool = False) -> Column:
    """array<struct<paragraph, item, text>>: pieces that start at a circled number, then at ``1.``.

    Empty without a circled number. ``fold_circled`` is for texts that NFKC has folded: there
    are no circled numbers then and the array is empty.
    """
    kind = "array<struct<paragraph:string,item:string,text:string>>"
    if fold_circled:
        return F.array().cast(kind)
    pieces = F.filter(F.split(text, f"(?=[{CIRCLED}])"), lambda p: T.strip(p) != "")

    def units(p):
        number = F.instr(F.lit(CIRCLED), F.left(p, F.lit(1)))
        paragraph = F.when(number > 0, F.concat(F.lit("제"), number.cast("string"), F.lit("항")))
        items = F.filter(F.split(p, r"(?m)(?<!\S)(?=\d+\.\s)"), lambda x: T.strip(x) != "")

        def item(x):
            n = F.regexp_extract(x, r"^(\d+)\.\s", 1)
            return F.struct(paragraph.alias("paragraph"), F.when((number > 0) & (n != ""), F.concat(F.lit("제"), n, F.lit("호"))).alias("item"), T.strip(x).alias("text"))

        whole = F.array(F.struct(paragraph.alias("paragraph"), F.lit(None).cast("string").alias("item"), T.strip(p).alias("text")))
        return F.when(number > 0, F.transform(items, item)).otherwise(whole)

    return F.when(text.rlike(f"[{CIRCLED}]"), F.flatten(F.transform(pieces, units))).otherwise(F.array().cast(kind))
