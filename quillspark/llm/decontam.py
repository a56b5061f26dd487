"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Words become templates of three kinds. In kind 0 capitalised words, numbers and units are typed
placeholders; in kind 1 numbers and units are; other words are in lower case. A run of one
placeholder is one template word, so 12 and 1,200 or Paris and New York agree. Kind 2 is the words
as written, in lower case: it serves the stretches of the benchmark that are mostly numbers and
units, which say little as templates.

Windows of template words are hashed and joined with those of the benchmark. They only propose:
around the diagonal of a shared window the template words that really agree are counted, and
the slots are compared. Each benchmark value must stand for one document value throughout, or
nearly all slots must be unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import quoted, staged, text_or_empty

WINDOW = 8
#: A window is matched as a template if at least so many of its words are no placeholders, else as written.
LITERALS = 4
#: Words that must agree: half of the item and 13 words, or the whole item.
SHARE, WORDS = 0.5, 13
#: Windows of the benchmark that are broadcast at most (about 40 bytes each); beyond, Spark shuffles.
BROADCAST_WINDOWS = 500_000
#: Diagonals on either side of a shared window on which further words are looked for.
BAND = 16
#: Placeholders are characters that no text holds after ``plain_text``.
NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"
#: Kinds of templates: with names, without, as written.
KINDS = (0, 1, 2)
#: Words that are a unit after a number.
UNITS = ("km", "cm", "mm", "kg", "mg", "lb", "lbs", "oz", "ml", "mph", "kmh", "hz", "kw", "kwh", "meters", "metres", "miles", "feet", "inches", "grams", "kilograms", "pounds", "ounces", "litres", "liters", "gallons", "seconds", "minutes", "hours", "days", "weeks", "months", "years", "percent", "dollars", "euros", "cents", "usd", "eur", "degrees")


_WORD, _GAP = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}\x01-\x03]"


def _runs(head: str) -> str:
    """Runs of words that begin with ``head``; the head comes first, as it is rarer than what stands before it."""
    return rf"{head}(?<!{_WORD}{head}){_WORD}*+(?:{_GAP}++{head}{_WORD}*+)*+"


_CAPITAL, _DIGIT = r"[\p{Lu}\p{Lt}]", "[0-9]"
_NAMES, _NUMBERS = _runs(_CAPITAL), _runs(_DIGIT)
_UNITS = rf"{NUMBER}({_GAP}++)(?i:{'|'.join(UNITS)})(?!{_WORD})"


def plain_text(text: Column) -> Column:
    """The placeholders' characters as blanks; a capital I with a dot would fall apart in lower case."""
    text, odd = F.coalesce(text, F.lit("")), "\u0130\x01\x02\x03"
    found = F.contains(text, F.lit(odd[0]))
    for c in odd[1:]:
        found = found | F.contains(text, F.lit(c))
    return F.when(found, F.translate(text, odd, "I   ")).otherwise(text)


def words(text: Column) -> Column:
    """Runs of letters and digits, as written."""
    return F.array_remove(F.split(plain_text(text), r"[^\p{L}\p{N}]+"), "")


def template(text: Column, kind: int) -> Column:
    """array<string>: a text's template. Patterns work on whole texts, so no function runs word by word."""
    text = plain_text(text)
    if kind < 2:
        text = F.regexp_replace(text, _NUMBERS, NUMBER)
        text = F.when(F.contains(text, F.lit(NUMBER)), F.regexp_replace(text, _UNITS, f"{NUMBER}$1{UNIT}")).otherwise(text)
    if kind == 0:
        text = F.regexp_replace(text, _NAMES, NAME)
    return F.array_remove(F.split(F.lower(text), f"{_GAP}+"), "")


def _is_slot(word: Column) -> Column:
    return word.isin(NAME, NUMBER, UNIT)


def _full(raw: str, kind: int) -> Column:
    """array<struct<w, v, width>>: the same template, what its words stand for and how many words that is."""

    def placeholder(w, before):
        number = F.when(w.rlike(f"^{_DIGIT}"), NUMBER).when(before.rlike(f"^{_DIGIT}") & F.lower(w).isin(*UNITS), UNIT)
        return F.lit("") if kind == 2 else (number.when(w.rlike(f"^{_CAPITAL}"), NAME) if kind == 0 else number).otherwise("")

    def of(marks):
        starts = F.filter(F.transform(marks, lambda m, i: F.when((m == "") | ~m.eqNullSafe(F.get(marks, i - 1)) | (m == UNIT), i)), lambda i: i.isNotNull())
        return F.transform(F.array(starts), lambda s: F.transform(s, lambda at, k: word(marks, s, at, k)))[0]

    def word(marks, starts, at, k):
        width = F.coalesce(F.get(starts, k + 1), F.size(marks)) - at
        mark = F.get(marks, at)
        return F.struct(F.when(mark != "", mark).otherwise(F.lower(F.get(raw, at))).alias("w"), F.array_join(F.slice(raw, at + 1, width), " ").alias("v"), width.alias("width"))

    marks = F.transform(raw, lambda w, i: placeholder(w, F.coalesce(F.get(raw, i - 1), F.lit(""))))
    return F.transform(F.array(marks), of)[0]


def _identified(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, part, text) of distinct rows. ``part`` tells texts apart that share an id; a null text is empty."""
    part = f"{id_col[:-3]}_part"
    return rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias(id_col), F.xxhash64(text_or_empty()).alias(part), text_or_empty().alias("text"))


def _templates_of(rows: DataFrame) -> DataFrame:
    """One row a text and kind: ``text`` gives way to ``n_raw``, ``kind`` and ``full``."""
    kept = [c for c in rows.columns if c != "text"]
    rows = rows.select(*kept, words(F.col("text")).alias("raw"))
    return rows.select(*kept, F.size("raw").alias("n_raw"), F.posexplode(F.array(*(_full("raw", k) for k in KINDS))).alias("kind", "full"))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, item_part, n_item, kind, it): the templates of every distinct item text that has a word."""
    items = _identified(benchmark, "item_id").dropDuplicates(["item_id", "item_part"])
    return _templates_of(items).where("n_raw > 0").select("item_id", "item_part", F.col("n_raw").alias("n_item"), "kind", F.col("full").alias("it"))


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, kind, size, item_id, item_part, item_pos): the windows that documents are searched for.

    Each window of kind 1 with LITERALS plain words, of kind 0 with as many and a name, and of
    kind 2 with fewer than LITERALS plain words. An item shorter than a window is one
    window. So every stretch of an item is in some window, as a template or as written.
    """
    n = F.size("it")
    rows = items.select("item_id", "item_part", "kind", "it", F.least(n, F.lit(window)).alias("size"), F.explode(F.sequence(F.lit(0), n - F.least(n, F.lit(window)))).alias("item_pos"))
    rows = rows.withColumn("win", F.slice("it", F.col("item_pos") + 1, F.col("size")))
    plain = F.size(F.filter("win", lambda x: ~_is_slot(x["w"])))
    # kind 2 has no placeholders; its plain words are those that kind 1 keeps
    numeric = F.size(F.filter("win", lambda x: x["w"].rlike("^[0-9]") | x["w"].isin(*UNITS)))
    named = F.exists("win", lambda x: x["w"] == NAME)
    template_like = ((F.col("kind") == 1) | ((F.col("kind") == 0) & named)) & (plain >= LITERALS)
    rows = rows.where(template_like | ((F.col("kind") == 2) & (F.col("size") - numeric < LITERALS)))
    key = F.lit(None).cast("long")
    for size in range(1, window + 1):
        key = F.when(F.col("size") == size, _key(F.col("kind"), size, lambda j: F.get("win", F.lit(j))["w"])).otherwise(key)
    return rows.select(key.alias("key"), "kind", "size", "item_id", "item_part", "item_pos")


def _key(kind: Column, size: int, word_at) -> Column:
    """Hash of a window: its kind, its size and its template words."""
    return F.xxhash64(kind.cast("int"), F.lit(size), *(word_at(j) for j in range(size)))


def document_windows(docs: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """(doc_id, doc_part, doc_pos, key): every window of the given kinds and sizes."""
    kinds = sorted({k for k, _ in shapes})
    rows = _identified(docs, "doc_id")
    rows = rows.select("doc_id", "doc_part", *(template(F.col("text"), k).alias(f"t{k}") for k in kinds))
    longest = F.greatest(*(F.size(f"t{k}") for k in kinds), F.lit(0))
    rows = rows.select("*", F.explode(F.when(longest > 0, F.sequence(F.lit(0), longest - 1))).alias("doc_pos"))

    def key(kind, size):
        t = F.col(f"t{kind}")
        return F.when(F.col("doc_pos") + size <= F.size(t), _key(F.lit(kind), size, lambda j: F.get(t, F.col("doc_pos") + j)))

    return rows.select("doc_id", "doc_part", "doc_pos", F.explode(F.array(*(key(*s) for s in shapes))).alias("key")).where("key is not null")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Leaks: (doc_id, item_id, matched_words, item_words, n_slots, n_changed, consistent).

    One row per document and item, its best match; n_slots and n_changed count words of the
    item. Null texts are empty; rows with a null doc_id or item_id give nothing; equal rows
    count as one, rows that share an id but not the text are compared one by one and the best
    counts; an empty table or benchmark gives no rows; other columns aren't used. Items without
    a word match nothing, those shorter than a window match as wholes.
    """
    items = staged(benchmark_items(benchmark), "bench-items")
    bench = staged(benchmark_windows(items, window), "bench-windows")
    shapes = sorted(map(tuple, bench.select("kind", "size").distinct().collect()))  # three kinds, at most ``window`` sizes
    few = bench.count() <= broadcast_windows
    small = F.broadcast if few else lambda df: df
    if not shapes:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, matched_words long, item_words long, n_slots long, n_changed long, consistent boolean")
    hits = document_windows(docs, shapes).join(small(bench), "key")
    shift = F.col("doc_pos") - F.col("item_pos")
    runs = hits.groupBy("kind", "doc_id", "doc_part", "item_id", "item_part", shift.alias("shift")).agg(F.count_distinct("item_pos").alias("n"), F.min("item_pos").alias("lo"))
    band = F.floor(F.col("shift") / BAND).alias("band")
    anchors = runs.groupBy("kind", "doc_id", "doc_part", "item_id", "item_part", band).agg(F.max(F.struct("n", "lo", "shift")).alias("a"))
    anchors = staged(anchors.select("kind", "doc_id", "doc_part", "item_id", "item_part", "a.shift"), "bench-anchors")
    return _best(_aligned(anchors, docs, items, small))


def _needed(size: Column) -> Column:
    """Words that must agree of ``size``."""
    return F.least(size, F.greatest(F.lit(WORDS), F.ceil(size * SHARE)))


def _let(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once: the optimizer doesn't copy expressions through a generator."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _aligned(anchors: DataFrame, docs: DataFrame, items: DataFrame, small) -> DataFrame:
    """Anchors with ``matched`` and ``slots``, of pairs whose template words agree in number.

    A word agrees if it stands on one of the diagonals around the anchor and a neighbour agrees
    there too; the nearest diagonal counts. An unchanged slot counts all its words, a changed one
    1; of the item's words enough must agree, or of its template's. The first and last
    slot may run on into the words around, so their values aren't compared.
    """
    near = _identified(docs, "doc_id").join(anchors.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "doc_part"])
    near = _templates_of(near).withColumnRenamed("full", "dt").drop("n_raw")
    met = anchors.join(small(items), ["kind", "item_id", "item_part"]).join(near, ["kind", "doc_id", "doc_part"])
    cut = F.greatest(F.lit(0), F.col("shift") - BAND - 1)
    met = met.select("kind", "doc_id", "item_id", "n_item", "it", "shift", (F.col("shift") - cut).alias("base"), F.slice("dt", cut + 1, F.size("it") + 2 * BAND + 3).alias("dt"))
    met = _let(met, iw=F.col("it.w"), dw=F.col("dt.w"), n=F.size("it"))

    def bigrams(c):
        return F.when(F.size(c) > 1, F.transform(F.slice(c, 1, F.size(c) - 1), lambda x, i: F.xxhash64(x, F.get(c, i + 1)))).otherwise(F.array().cast("array<long>"))

    # a cheap bound first: words whose bigram is anywhere near
    met = _let(met, ib=bigrams(F.col("iw")), db=bigrams(F.col("dw")))
    met = _let(met, common=F.array_intersect("ib", "db"))
    held = F.filter("it", lambda x, p: (F.col("n") == 1) | F.coalesce(F.array_contains("common", F.get("ib", p)), F.lit(False)) | F.coalesce(F.array_contains("common", F.get("ib", p - 1)), F.lit(False)))
    met = _let(met, held=held)
    width = F.aggregate("held", F.lit(0), lambda s, x: s + x["width"])
    met = _let(met, hopeful=(width >= _needed(F.col("n_item"))) | (F.size("held") >= _needed(F.col("n")))).where("hopeful")

    def agrees(p, q):
        return F.coalesce(F.get("iw", p) == F.get("dw", q), F.lit(False))

    def partner(p):
        def at(b):
            q = p + F.col("base") + b
            return F.when(agrees(p, q) & ((F.col("n") == 1) | agrees(p - 1, q - 1) | agrees(p + 1, q + 1)), F.struct(F.abs(b).alias("far"), q.alias("q")))

        return F.array_min(F.filter(F.transform(F.sequence(F.lit(-BAND), F.lit(BAND)), at), lambda x: x.isNotNull()))["q"]

    both = F.transform("it", lambda x, p: F.struct(_is_slot(x["w"]).alias("slot"), x["v"].alias("i"), x["width"].alias("width"), F.get("dt", partner(p))["v"].alias("d"), ((p > 0) & (p < F.col("n") - 1)).alias("inner")))
    met = _let(met, pairs=F.filter(both, lambda x: x["d"].isNotNull()))
    same = F.aggregate("pairs", F.lit(0), lambda s, x: s + F.when(x["slot"] & (x["i"] == x["d"]), x["width"]).otherwise(1))
    met = _let(met, matched=same, slots=F.filter("pairs", lambda x: x["slot"] & x["inner"]))
    return met.where((F.col("matched") >= _needed(F.col("n_item"))) | (F.size("pairs") >= _needed(F.col("n"))))


def _best(met: DataFrame) -> DataFrame:
    """The rows whose ``slots`` are consistent or hardly changed, the best of each document and item."""
    wide = lambda keep: F.aggregate(F.filter("slots", keep), F.lit(0), lambda s, x: s + x["width"])
    changed, every = wide(lambda x: x["i"] != x["d"]), wide(lambda x: F.lit(True))
    one_to_one = F.size(F.array_distinct(F.transform("slots", lambda s: s["i"]))) == F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["i"], s["d"]))))
    met = met.select("doc_id", "item_id", F.col("matched").cast("long").alias("matched_words"), F.col("n_item").cast("long").alias("item_words"), every.cast("long").alias("n_slots"), changed.cast("long").alias("n_changed"), one_to_one.alias("consistent"), "shift", "kind")
    good = met.where(F.col("consistent") | (F.col("n_changed") * 10 <= F.col("n_slots")))
    best = good.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("matched_words"), F.col("kind"), -F.col("n_changed"), -F.col("shift"), F.struct("item_words", "n_slots", "n_changed", "consistent").alias("rest"))).alias("b"))
    return best.select("doc_id", "item_id", "b.matched_words", "b.rest.item_words", "b.rest.n_slots", "b.rest.n_changed", "b.rest.consistent")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item or half of one; null doc_ids stay.

    Rows that share a doc_id go together; null texts hold nothing; an empty benchmark drops nothing.
    """
    # staged, its size is known, and where it is small the documents aren't shuffled
    leaks = staged(contamination(docs, benchmark).select("doc_id").distinct(), "bench-leaks")
    return docs.join(leaks, "doc_id", "left_anti").select(*quoted(docs.columns))
