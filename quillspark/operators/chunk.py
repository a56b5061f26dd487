"""Articles -> size-bounded, de-duplicated chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .parse import structural_units

MAX_CHARS, MIN_CHARS, LEAST_CUT = 7000, 20, 1000
#: Where a sentence may end; the cut is after the marker's first character.
MARKERS = ("다.", "한다.", "한다", ".")


def _last_marker(window: Column, size: int) -> Column:
    """0-based place of the last marker in a full window of ``size`` characters; -1 if none."""
    turned = F.reverse(window)

    def place(m):
        at = F.instr(turned, m[::-1])
        return F.when(at > 0, size - len(m) - (at - 1)).otherwise(-1)

    return F.greatest(*(place(m) for m in MARKERS))


def split_sentences(text: Column, size: int = MAX_CHARS, least: int = LEAST_CUT, min_chars: int = MIN_CHARS, after: int = 1) -> Column:
    """array<string> of pieces of at most ``size`` characters, cut after the last sentence marker.

    Where the last marker lies at ``least`` or before, the cut is hard. Pieces below
    ``min_chars`` are dropped. ``after`` characters from the marker's start stay before the cut.
    """
    kind = "struct<at:int,out:array<string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def pieces(b):
        def step(acc, _):
            rest, off = b["n"] - acc["at"], acc["at"] % size
            # what begins at ``off`` in one block and has ``size`` characters ends in the next
            near = F.concat(*(F.coalesce(F.get(b["blocks"], (acc["at"] / size).cast("int") + k), F.lit("")) for k in (0, 1)))

            def cut(w):
                def at_marker(marker):
                    taken = F.when(rest <= size, rest).when(marker <= least, size).otherwise(marker + after)
                    return F.struct((acc["at"] + taken).alias("at"), F.array_append(acc["out"], T.strip(w.substr(off + 1, taken))).alias("out")).cast(kind)

                # one-element arrays give values names, so that they are computed once
                return F.element_at(F.transform(F.array(_last_marker(w.substr(off + 1, F.lit(size)), size)), at_marker), 1)

            return F.when(rest <= 0, acc).otherwise(F.element_at(F.transform(F.array(near), cut), 1))

        steps = F.sequence(F.lit(0), (b["n"] / least).cast("int") + 1)
        return F.filter(F.aggregate(steps, start.cast(kind), step, lambda acc: acc["out"]), lambda x: F.length(x) >= min_chars)

    # blocks of the text are cut once, in order: a step reads two of them, wherever it stands
    blocks = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), 0).alias("blocks"), F.length(text).alias("n"))
    return F.element_at(F.transform(F.array(blocks), pieces), 1)


PART = "array<struct<text:string,paragraph:string,item:string,chunk_type:string,part_index:int>>"


def _part(text, paragraph=None, item=None, kind="article", index=None) -> Column:
    none = F.lit(None)
    return F.struct(text.alias("text"), (none if paragraph is None else paragraph).cast("string").alias("paragraph"), (none if item is None else item).cast("string").alias("item"), (F.lit(kind) if isinstance(kind, str) else kind).alias("chunk_type"), (none if index is None else index).cast("int").alias("part_index"))


def split_article(text: Column, fold_circled: bool = False, size: int = MAX_CHARS) -> Column:
    """Parts of an article: itself if short, else its paragraphs and items, else cut at sentences."""
    def pieces(t, paragraph=None, item=None, kind="article"):
        return F.transform(split_sentences(t, size, min(LEAST_CUT, size // 7)), lambda x, i: _part(x, paragraph, item, kind, i + 1)).cast(PART)

    def unit(u):
        kind = F.when(u["item"].isNotNull(), "item").when(u["paragraph"].isNotNull(), "paragraph").otherwise("article")
        short = F.array(_part(u["text"], u["paragraph"], u["item"], kind)).cast(PART)
        return F.when(F.length(u["text"]) <= size, short).otherwise(pieces(u["text"], u["paragraph"], u["item"], kind))

    units = structural_units(text, fold_circled)
    parts = F.when(F.size(units) > 0, F.flatten(F.transform(units, unit))).otherwise(pieces(text))
    return F.when(F.length(text) <= size, F.array(_part(text)).cast(PART)).otherwise(parts)


def split_article_old(text: Column, size: int = MAX_CHARS) -> Column:
    """The older split: paragraphs packed together up to ``size``; without any, cut two characters after a marker's start."""
    parts = F.filter(F.transform(F.split(text, "(?=[①-⑳])"), T.strip), lambda p: p != "")
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("out"))

    def pack(acc, p):
        fits = F.length(acc["now"]) + F.length(p) <= size
        return F.when(acc["now"] == "", F.struct(p.alias("now"), acc["out"].alias("out"))).when(fits, F.struct(F.concat_ws(" ", acc["now"], p).alias("now"), acc["out"].alias("out"))).otherwise(F.struct(p.alias("now"), F.array_append(acc["out"], acc["now"]).alias("out")))

    packed = F.aggregate(parts, start, pack, lambda acc: F.when(acc["now"] != "", F.array_append(acc["out"], acc["now"])).otherwise(acc["out"]))
    return F.when(F.length(text) <= size, F.array(text)).when(text.rlike("[①-⑳]"), packed).otherwise(split_sentences(text, size, min(LEAST_CUT, size // 7), 0, 2))


def _emitted(parts: Column, text: Column) -> Column:
    """The parts that become chunks, numbered; the whole article first where it has typed parts."""

    def numbered(ps):
        nested = F.exists(ps, lambda p: p["chunk_type"] != "article")
        all_parts = F.transform(ps, lambda p, i: F.struct(p["text"].alias("text"), p["paragraph"].alias("paragraph"), p["item"].alias("item"), p["chunk_type"].alias("chunk_type"), p["part_index"].alias("part_index"), (i + 1).alias("emit"), F.size(ps).alias("parts")))
        none = F.lit(None)
        parent = F.struct(text.alias("text"), none.cast("string").alias("paragraph"), none.cast("string").alias("item"), F.lit("article").alias("chunk_type"), none.cast("int").alias("part_index"), F.lit(0).alias("emit"), F.lit(1).alias("parts"))
        return F.when(nested, F.concat(F.array(parent), F.filter(all_parts, lambda p: p["chunk_type"] != "article"))).otherwise(all_parts)

    # a one-element array names the parts, so that the split runs once
    return F.element_at(F.transform(F.array(parts), numbered), 1)


def articles_to_chunks(arts: DataFrame, size: int = MAX_CHARS, fold_circled: bool = False, shared_part_ids: bool = False) -> DataFrame:
    """Chunks of articles with ``text``: id, text and the flat metadata columns.

    Texts below MIN_CHARS are dropped. An article with paragraph or item parts also gives a
    parent chunk, and its untyped lead is skipped. Of equal texts (white space aside) in one
    document the first stays. ``shared_part_ids`` leaves the part number out of an article's id.
    """
    meta = T.law_metadata(F.col("document"))
    rows = arts.where(F.length("text") >= MIN_CHARS).select("*", F.explode(_emitted(split_article(F.col("text"), fold_circled, size), F.col("text"))).alias("p"))
    rows = rows.withColumns(meta)
    law, section, article = F.col("law_name"), F.col("section"), F.col("article")
    plain, index = F.col("p.chunk_type") == "article", F.col("p.part_index")
    own_index = F.when(plain, F.lit(None)).otherwise(index) if shared_part_ids else index
    both = rows.select(
        "document", "pos", "law_name", "law_type", "law_number", "effective_date", "section", F.col("chapter.number").alias("chapter"), F.col("chapter.title").alias("chapter_title"),
        F.col("subsection.number").alias("subsection"), F.col("subsection.title").alias("subsection_title"), "article", F.col("title").alias("article_title"), "page_start", "page_end",
        T.chunk_id(law, section, article, F.col("p.paragraph"), F.col("p.item"), part_index=own_index.cast("int")).alias("id"), "p.text", "p.paragraph", "p.item", "p.chunk_type", F.when(~plain, T.chunk_id(law, section, article)).alias("parent_id"),
        F.when(F.col("p.emit") == 0, 1).when(plain, F.col("p.emit")).otherwise(F.coalesce(index, F.col("p.emit"))).alias("chunk_index"), F.when(F.col("p.emit") == 0, 1).otherwise(F.col("p.parts")).alias("chunk_count"), F.col("p.emit").alias("emit"),
    ).where(F.length("text") >= MIN_CHARS)
    first = Window.partitionBy("document", T.fingerprint(F.col("text"))).orderBy("pos", "emit")
    return both.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def articles_to_chunks_old(arts: DataFrame, size: int = MAX_CHARS) -> DataFrame:
    """The older chunks: no parents, every part of an article numbered."""
    rows = arts.where(F.length("text") >= MIN_CHARS).select("document", "pos", "section", "article", "page_start", "page_end", F.posexplode(split_article_old(F.col("text"), size)).alias("k", "text"))
    rows = rows.where(F.length("text") >= MIN_CHARS).withColumn("id", T.chunk_id_old(F.col("document"), F.col("section"), F.col("article"), F.col("k") + 1))
    first = Window.partitionBy("document", T.fingerprint(F.col("text"))).orderBy("pos", "k")
    return rows.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def first_of_each(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def nested_chunks(chunks: DataFrame) -> DataFrame:
    """The chunk file's form: id, text, metadata with its nested source."""
    source = F.struct(F.concat("document", F.lit(".pdf")).alias("file"), "page_start", "page_end", "section", "article")
    names = ["law_name", "law_type", "law_number", "effective_date", "section", "chapter", "chapter_title", "subsection", "subsection_title", "article", "article_title", "paragraph", "item", "chunk_type", "parent_id", "page_start", "page_end", "chunk_index", "chunk_count"]
    return chunks.select("document", "id", "text", F.struct(*names, source.alias("source")).alias("metadata"))
