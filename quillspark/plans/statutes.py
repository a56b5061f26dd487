"""Ingest: derived statute lines -> articles -> chunks, and their validators.

The driver's documents have no headings, so every line's number in its document decides
whether it becomes a chapter, subsection, article, supplement or noise line. All documents
and all lines take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import headings as H
from ..functions import text as T
from ..operators import chunk as C
from ..operators import parse as P
from ..operators import ranges as R
from ..operators import validate as V
from ..sources import files
from ..storage import shared_folder, staged
from .registry import query, table

SIZE = 600  # chunk size here: the derived articles are short


def statute_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "l"))
    word = F.regexp_extract("l", r"(\p{L}+)", 1)
    rows = rows.withColumn("w", F.when(word != "", word).otherwise("x"))
    n = F.col("n")
    text = lambda c: c.cast("int").cast("string")
    line = (
        F.when(n % 40 == 33, "부칙").when(n % 17 == 0, F.concat(F.lit("제"), text(F.floor(n / 17) + 1), F.lit("장 "), "w")).when(n % 17 == 5, F.concat(F.lit("제"), text(F.floor(n / 17) + 1), F.lit("절 "), "w"))
        .when(n % 3 == 1, F.concat(F.lit("제"), text(F.floor(n / 3) % 7 + 1), F.lit("조("), "w", F.lit(") "), "l")).when(n % 29 == 8, F.concat(F.lit("02-123-4567 "), "l")).otherwise(F.col("l"))
    )
    name = F.concat(F.lit("법"), F.col("doc_id").cast("string"), F.lit("_법률_제"), F.col("doc_id").cast("string"), F.lit("호_2024"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0"), F.lit("15"))
    return rows.select(name.alias("document"), (F.floor(n / 10) + 1).cast("int").alias("page"), (n % 10).cast("int").alias("line_no"), line.alias("line"))


def statute_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.articles(P.clean_lines(statute_lines(spark, sf_dir), nfkc=False))


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.article_text(P.merge_articles(statute_articles(spark, sf_dir)), nfkc=False)


def statute_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.articles_to_chunks(merged(spark, sf_dir), SIZE)


STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def strip_sql(x: str) -> str:
    return STRIP.format(x)


LINES = rf"""
raw AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS n FROM documents),
worded AS (SELECT *, coalesce(nullif(regexp_extract(l, '(\p{{L}}+)', 1), ''), 'x') AS w FROM raw),
lines AS (SELECT '법' || doc_id || '_법률_제' || doc_id || '호_2024' || lpad(((doc_id % 12) + 1)::VARCHAR, 2, '0') || '15' AS document, (n // 10 + 1)::INT AS page, (n % 10)::INT AS line_no,
  CASE WHEN n % 40 = 33 THEN '부칙' WHEN n % 17 = 0 THEN '제' || (n // 17 + 1) || '장 ' || w WHEN n % 17 = 5 THEN '제' || (n // 17 + 1) || '절 ' || w
       WHEN n % 3 = 1 THEN '제' || ((n // 3) % 7 + 1) || '조(' || w || ') ' || l WHEN n % 29 = 8 THEN '02-123-4567 ' || l ELSE l END AS line FROM worded),
clean AS (SELECT document, page, line_no, {strip_sql(r"regexp_replace(line, '[ \t]+', ' ', 'g')")} AS line FROM lines),
kept AS (SELECT * FROM clean WHERE NOT (line = '' OR contains(line, '국가법령정보센터') OR regexp_full_match(line, '법제처\s*\d*') OR regexp_matches(line, '\b\d{{2,4}}-\d{{3,4}}-\d{{4}}\b')))"""

_ART = r"'^(제\d+조(?:의\d+)?)(?:\(([^)]*)\))?(?:\s+(.*))?$'"
STATE = LINES + rf""",
flags AS (SELECT *, regexp_matches(line, '^부칙(?:\s+.*)?$') AS is_supp, {strip_sql(f"regexp_extract(line, {_ART}, 3)")} AS content, regexp_matches(line, '^제\d+조(?:의\d+)?\([^)]*\)(?:\s|$)') AS titled FROM kept),
s1 AS (SELECT *, sum(is_supp::INT) OVER so_far AS n_supp FROM flags WINDOW so_far AS (PARTITION BY document ORDER BY page, line_no ROWS UNBOUNDED PRECEDING)),
s2 AS (SELECT *, n_supp = 0 AND NOT is_supp AND regexp_matches(line, '^(제\d+장)(?:\s+(.+))?$') AS is_chap, n_supp = 0 AND NOT is_supp AND regexp_matches(line, '^(제\d+절)(?:\s+(.+))?$') AS is_sub FROM s1),
s3 AS (SELECT *, NOT (is_supp OR is_chap OR is_sub) AND regexp_matches(line, {_ART}) AND (titled OR content = '' OR content IN ('삭제', '신설', '생략')) AS is_art, sum(is_chap::INT) OVER (PARTITION BY document ORDER BY page, line_no ROWS UNBOUNDED PRECEDING) AS n_chap,
  row_number() OVER (PARTITION BY document ORDER BY page, line_no) AS pos FROM s2),
state AS (SELECT *, CASE WHEN n_supp = 0 THEN '본문' ELSE '부칙' END AS section,
  last_value(CASE WHEN is_chap THEN regexp_extract(line, '^(제\d+장)', 1) END IGNORE NULLS) OVER (PARTITION BY document, n_supp ORDER BY pos ROWS UNBOUNDED PRECEDING) AS chapter,
  last_value(CASE WHEN is_chap THEN {strip_sql("regexp_extract(line, '^제[0-9]+장(.*)$', 1)")} END IGNORE NULLS) OVER (PARTITION BY document, n_supp ORDER BY pos ROWS UNBOUNDED PRECEDING) AS chapter_title,
  last_value(CASE WHEN is_sub THEN regexp_extract(line, '^(제\d+절)', 1) END IGNORE NULLS) OVER (PARTITION BY document, n_supp, n_chap ORDER BY pos ROWS UNBOUNDED PRECEDING) AS subsection,
  sum((is_supp OR is_chap OR is_sub OR is_art)::INT) OVER (PARTITION BY document ORDER BY pos ROWS UNBOUNDED PRECEDING) AS seg FROM s3)"""

ARTICLES = STATE + rf""",
bodies AS (SELECT *, CASE WHEN is_art THEN nullif(content, '') WHEN NOT (is_chap OR is_sub OR is_supp) THEN line END AS body FROM state),
arts AS (SELECT document, seg, min(pos) AS pos, first(section ORDER BY pos) AS section, first(chapter ORDER BY pos) AS chapter, first(chapter_title ORDER BY pos) AS chapter_title, first(subsection ORDER BY pos) AS subsection,
  first(regexp_extract(line, {_ART}, 1) ORDER BY pos) AS article, first(CASE WHEN titled THEN {strip_sql(f"regexp_extract(line, {_ART}, 2)")} END ORDER BY pos) AS title,
  list(body ORDER BY pos) FILTER (body IS NOT NULL) AS lines, list_sort(list_distinct(list(page))) AS pages
  FROM bodies GROUP BY document, seg HAVING bool_or(is_art) AND count(body) > 0)"""

MERGED = ARTICLES + rf""",
each_line AS (SELECT document, section, article, pos, unnest(lines) AS x, generate_subscripts(lines, 1) AS k FROM arts),
once AS (SELECT document, section, article, x, min(pos * 1000000 + k) AS place FROM each_line GROUP BY ALL),
whole AS (SELECT document, section, article, list(x ORDER BY place) AS lines FROM once GROUP BY ALL),
heads AS (SELECT document, section, article, min(pos) AS pos, first(chapter ORDER BY pos) FILTER (chapter IS NOT NULL) AS chapter, first(chapter_title ORDER BY pos) FILTER (chapter IS NOT NULL) AS chapter_title,
  first(subsection ORDER BY pos) FILTER (subsection IS NOT NULL) AS subsection, first(title ORDER BY pos) FILTER (title IS NOT NULL) AS title, list_sort(list_distinct(flatten(list(pages)))) AS pages FROM arts GROUP BY document, section, article),
merged AS (SELECT h.*, w.lines FROM heads h JOIN whole w USING (document, section, article)),
texts AS (SELECT *, {strip_sql("regexp_replace(article || CASE WHEN title IS NULL THEN '' ELSE '(' || title || ')' END || ' ' || array_to_string(lines, ' '), '[ \\t]+', ' ', 'g')")} AS text, pages[1] AS page_start, pages[len(pages)] AS page_end FROM merged)"""


def greedy_sql(source: str, key: str, size: int, least: int, min_chars: int = 20, after: int = 1) -> str:
    """Recursive CTE ``pieces``: the greedy sentence split of ``source``'s text."""
    return f"""
cuts AS (SELECT {key}, text, 0 AS st, 0 AS en, 0 AS k FROM {source} UNION ALL
  SELECT {key}, text, en, CASE WHEN length(text) - en <= {size} THEN length(text) ELSE en + CASE WHEN best <= {least} THEN {size} ELSE best + {after} END END, k + 1 FROM (
    SELECT *, greatest({", ".join(f"CASE WHEN contains(w, '{m}') THEN {size} - {len(m)} - (instr(reverse(w), '{m[::-1]}') - 1) ELSE -1 END" for m in ("다.", "한다.", "한다", "."))}) AS best
    FROM (SELECT *, substr(text, en + 1, {size}) AS w FROM cuts WHERE en < length(text)))),
pieces AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY k) AS part FROM (SELECT {key}, k, {strip_sql("substr(text, st + 1, en - st)")} AS piece FROM cuts WHERE k > 0) WHERE length(piece) >= {min_chars})"""


CHUNKS = MERGED + ",\nlongs AS (SELECT document || '|' || section || '|' || article AS kk, * FROM texts WHERE length(text) >= 20),\n" + greedy_sql("longs", "kk", SIZE, SIZE // 7) + rf""",
parts AS (SELECT l.*, p.piece, p.part, count(*) OVER (PARTITION BY l.kk) AS n_parts, length(l.text) > {SIZE} AS cut FROM longs l JOIN pieces p USING (kk)),
named AS (SELECT *, regexp_extract(document, '^([^_]+)', 1) AS law_name FROM parts),
chunked AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(law_name || '_' || section || '_' || article || CASE WHEN cut THEN '_part' || part ELSE '' END, '[^\p{{L}}\p{{N}}_\-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS id,
  sha1(regexp_replace(piece, '[\s\p{{Z}}]+', '', 'g')) AS fp FROM named),
chunks AS (SELECT document, pos, id, piece AS text, section, chapter, chapter_title, subsection, article, title AS article_title, page_start, page_end, part::INT AS chunk_index, n_parts::INT AS chunk_count, law_name, 'article' AS chunk_type,
  NULL::VARCHAR AS paragraph, NULL::VARCHAR AS item, NULL::VARCHAR AS parent_id FROM (SELECT *, row_number() OVER (PARTITION BY document, fp ORDER BY pos, part) AS nth FROM chunked) WHERE nth = 1)"""


def with_sql(ctes: str, select: str) -> str:
    """``select`` after the CTEs; one that starts with a comma adds CTEs of its own."""
    return f"WITH RECURSIVE {ctes.strip()}\n{select}"


@query("S03_page_lines", with_sql(LINES, "SELECT document, page, line_no, line FROM kept"))
def page_lines(spark, sf_dir):
    return P.clean_lines(statute_lines(spark, sf_dir), nfkc=False)


@query("S04_page_preview", with_sql(LINES, "SELECT document, left(string_agg(line, chr(10) ORDER BY page, line_no), 2000) AS preview FROM lines WHERE page <= 3 GROUP BY document"))
def page_preview(spark, sf_dir):
    return files.page_preview(statute_lines(spark, sf_dir))


@query("T04_noise_lines", with_sql(LINES, "SELECT document, count(*) AS lines, count(*) - count(k.page) AS noise FROM clean LEFT JOIN kept k USING (document, page, line_no) GROUP BY document"))
def noise_lines(spark, sf_dir):
    lines = statute_lines(spark, sf_dir).withColumn("line", T.clean_line(F.col("line"), nfkc=False))
    return lines.groupBy("document").agg(F.count("*").alias("lines"), F.count_if(T.is_noise_line(F.col("line"))).alias("noise"))


@query("P01_P02_headings", with_sql(LINES, r"SELECT document, page, line_no, regexp_extract(line, '^(제\d+[장절])', 1) AS number, nullif(regexp_replace(regexp_extract(line, '^제\d+[장절](.*)$', 1), '^\s+', ''), '') AS title FROM kept WHERE regexp_matches(line, '^(제\d+[장절])(?:\s+(.+))?$')"))
def chapter_headings(spark, sf_dir):
    lines = page_lines(spark, sf_dir)
    chap, sub = H.chapter(F.col("line")), H.subsection(F.col("line"))
    return lines.where(chap.is_one | sub.is_one).select("document", "page", "line_no", F.coalesce(chap.number, sub.number).alias("number"), F.coalesce(chap.title, sub.title).alias("title"))


@query("P03_supplement_lines", with_sql(LINES, r"SELECT document, page, line_no FROM kept WHERE regexp_matches(line, '^부칙(?:\s+.*)?$')"))
def supplement_lines(spark, sf_dir):
    return page_lines(spark, sf_dir).where(H.supplementary(F.col("line"))).select("document", "page", "line_no")


@query("P04_article_headings", with_sql(STATE, f"SELECT document, page, line_no, regexp_extract(line, {_ART}, 1) AS article, CASE WHEN titled THEN {strip_sql(f'regexp_extract(line, {_ART}, 2)')} END AS title, content FROM flags WHERE regexp_matches(line, {_ART}) AND (titled OR content = '' OR content IN ('삭제', '신설', '생략'))"))
def article_headings(spark, sf_dir):
    h = H.article(F.col("line"))
    return page_lines(spark, sf_dir).where(h.is_one).select("document", "page", "line_no", h.number.alias("article"), h.title.alias("title"), h.content.alias("content"))


def old_lines(spark, sf_dir):
    """Lines in the older form too: doubled article numbers, ranges, supplements with a note after them."""
    lines = page_lines(spark, sf_dir)
    n, line = F.length("line") % 9, F.col("line")
    art = F.regexp_extract(line, r"^(제\d+조)", 1)
    form = F.when((art != "") & (n == 1), F.concat(art, line)).when((art != "") & (n == 2), F.concat(art, F.lit("부터 "), art, F.lit("까지 "), F.length("line").cast("string")))
    form = form.when(n == 3, F.concat(F.lit("<법률 제"), F.length("line").cast("string"), F.lit("호>"))).when(n == 4, F.concat(F.lit("부칙 <"), line, F.lit(">")))
    return lines.withColumn("line", form.otherwise(line))


OLD_LINES = LINES + r""",
olds AS (SELECT document, page, line_no, CASE WHEN regexp_matches(line, '^제\d+조') AND length(line) % 9 = 1 THEN regexp_extract(line, '^(제\d+조)', 1) || line
  WHEN regexp_matches(line, '^제\d+조') AND length(line) % 9 = 2 THEN regexp_extract(line, '^(제\d+조)', 1) || '부터 ' || regexp_extract(line, '^(제\d+조)', 1) || '까지 ' || length(line)
  WHEN length(line) % 9 = 3 THEN '<법률 제' || length(line) || '호>' WHEN length(line) % 9 = 4 THEN '부칙 <' || line || '>' ELSE line END AS line FROM kept)"""


_OLD_DOUBLED, _OLD_PLAIN, _OLD_SPAN = (f"'{p}'" for p in (r"^(제\d+조)(제\d+조)(?:\s*\(([^)]*)\))?(?:\s+|$)(.*)$", r"^(제\d+조)(?:\s*\(([^)]*)\))?(?:\s+|$)(.*)$", r"^(제\d+조부터\s+제\d+조까지)(?:\s+(.+))?$"))


def _old_sql(doubled: int, plain: int, span: int) -> str:
    group = lambda p, k: strip_sql(f"regexp_extract(line, {p}, {k})") if k else "''"
    return f"CASE WHEN doubled THEN {group(_OLD_DOUBLED, doubled)} WHEN plain THEN {group(_OLD_PLAIN, plain)} ELSE {group(_OLD_SPAN, span)} END"


@query("P05_article_headings_old", with_sql(OLD_LINES, f""", kinds AS (SELECT *, regexp_matches(line, {_OLD_DOUBLED}) AND regexp_extract(line, {_OLD_DOUBLED}, 1) = regexp_extract(line, {_OLD_DOUBLED}, 2) AS doubled, regexp_matches(line, {_OLD_PLAIN}) AS plain, regexp_matches(line, {_OLD_SPAN}) AS span FROM olds)
SELECT document, page, line_no, nullif({_old_sql(1, 1, 1)}, '') AS article, nullif({_old_sql(3, 2, 0)}, '') AS title, {_old_sql(4, 3, 2)} AS content, doubled FROM kinds WHERE doubled OR plain OR span"""))
def article_headings_old(spark, sf_dir):
    h, doubled = H.article_old(F.col("line"))
    return old_lines(spark, sf_dir).where(h.is_one).select("document", "page", "line_no", h.number.alias("article"), h.title.alias("title"), h.content.alias("content"), doubled.alias("doubled"))


@query("P06_supplement_lines_old", with_sql(OLD_LINES, r"SELECT document, page, line_no, regexp_matches(line, '^<.*(법률|대통령령|총리령|부령|시행령|시행규칙).*?>$') AS is_note FROM olds WHERE regexp_matches(line, '^부칙\s*(?:<.*>)?$') OR regexp_matches(line, '^부칙\s+') OR regexp_matches(line, '^<.*(법률|대통령령|총리령|부령|시행령|시행규칙).*?>$')"))
def supplement_lines_old(spark, sf_dir):
    line = F.col("line")
    return old_lines(spark, sf_dir).where(H.supplementary_old(line) | H.supplementary_note(line)).select("document", "page", "line_no", H.supplementary_note(line).alias("is_note"))


@query("P07_P09_W05_articles", with_sql(ARTICLES, "SELECT document, pos, section, chapter, chapter_title, subsection, article, title, array_to_string(lines, chr(10)) AS body, array_to_string(pages, ',') AS pages FROM arts"))
def articles(spark, sf_dir):
    return statute_articles(spark, sf_dir).select("document", F.col("pos").cast("long").alias("pos"), "section", F.col("chapter.number").alias("chapter"), F.col("chapter.title").alias("chapter_title"), F.col("subsection.number").alias("subsection"), "article", "title", F.array_join("lines", "\n").alias("body"), F.array_join("pages", ",").alias("pages"))


def long_lines(spark, sf_dir):
    """Every third document's lines one after another in a single document: a third of all lines. Its supplement starts late."""
    lines = statute_lines(spark, sf_dir).withColumn("no", F.regexp_extract("document", r"^법(\d+)_", 1).cast("long"))
    long = F.col("no") % 3 == 0
    return lines.select(F.when(long, F.lit("법0_법률_제0호_20240115")).otherwise(F.col("document")).alias("document"), F.when(long, F.col("no") * 10_000 + F.col("page")).otherwise(F.col("page")).alias("page"), "line_no", F.when(long & (F.col("no") < 300) & (F.col("line") == "부칙"), "").otherwise(F.col("line")).alias("line"))


LONG_LINES = LINES.replace("\nclean AS", r"""
longer AS (SELECT CASE WHEN n % 3 = 0 THEN '법0_법률_제0호_20240115' ELSE document END AS document, CASE WHEN n % 3 = 0 THEN n * 10000 + page ELSE page END AS page, line_no, CASE WHEN n % 3 = 0 AND n < 300 AND line = '부칙' THEN '' ELSE line END AS line FROM (SELECT *, regexp_extract(document, '^법(\d+)_', 1)::INT AS n FROM lines)),
clean AS""").replace("line FROM lines)", "line FROM longer)")


@query("P07_W05_long_document", with_sql(ARTICLES.replace(LINES, LONG_LINES), "SELECT document, pos, section, chapter, chapter_title, subsection, article, title, array_to_string(lines, chr(10)) AS body, array_to_string(pages, ',') AS pages FROM arts"))
def long_document(spark, sf_dir):
    """The heading machine in parts of a thousand lines, over a document that holds a third of all lines."""
    lines = staged(P.clean_lines(long_lines(spark, sf_dir), nfkc=False), "long-lines")  # read three times: counted, sampled, dealt
    arts = R.articles_of_ranges(lines, part_lines=1000)
    return arts.select("document", F.col("pos").cast("long").alias("pos"), "section", F.col("chapter.number").alias("chapter"), F.col("chapter.title").alias("chapter_title"), F.col("subsection.number").alias("subsection"), "article", "title", F.array_join("lines", "\n").alias("body"), F.array_join("pages", ",").alias("pages"))


@query("P08_articles_old", with_sql(STATE, """, old AS (SELECT *, sum((is_supp OR is_art)::INT) OVER (PARTITION BY document ORDER BY pos ROWS UNBOUNDED PRECEDING) AS oseg, CASE WHEN is_art THEN nullif(content, '') WHEN NOT (is_chap OR is_sub OR is_supp) THEN line END AS body FROM state)
SELECT document, min(pos) AS pos, count(body) AS n_lines FROM old GROUP BY document, oseg HAVING bool_or(is_art)"""))
def articles_old(spark, sf_dir):
    arts = P.articles(page_lines(spark, sf_dir), flush_at_chapters=False)
    return arts.select("document", F.col("pos").cast("long").alias("pos"), F.size("lines").cast("long").alias("n_lines"))


@query("G01_merged_articles", with_sql(MERGED, "SELECT document, section, article, pos, chapter, chapter_title, subsection, title, array_to_string(lines, chr(10)) AS body, array_to_string(pages, ',') AS pages FROM merged"))
def merged_articles(spark, sf_dir):
    return P.merge_articles(statute_articles(spark, sf_dir)).select("document", "section", "article", F.col("pos").cast("long").alias("pos"), F.col("chapter.number").alias("chapter"), F.col("chapter.title").alias("chapter_title"), F.col("subsection.number").alias("subsection"), "title", F.array_join("lines", "\n").alias("body"), F.array_join("pages", ",").alias("pages"))


@query("P10_P11_W06_article_text", with_sql(MERGED, "SELECT document, section, article, text, page_start, page_end FROM texts"))
def article_text(spark, sf_dir):
    return merged(spark, sf_dir).select("document", "section", "article", "text", "page_start", "page_end")


_FLAT = rf"""flat AS (SELECT doc_id, {strip_sql(r"regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')")} AS text FROM documents)"""


def flat_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.strip(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")).alias("text"))


@query("G02_sentence_split", with_sql(_FLAT + ",\n" + greedy_sql("flat", "doc_id", 7000, 1000), "SELECT doc_id, part::INT AS part, piece FROM pieces"))
def sentence_split(spark, sf_dir):
    return flat_texts(spark, sf_dir).select("doc_id", F.posexplode(C.split_sentences(F.col("text"))).alias("k", "piece")).select("doc_id", (F.col("k") + 1).alias("part"), "piece")


@query("G03_split_articles", with_sql(_FLAT + ",\n" + greedy_sql("(SELECT * FROM flat WHERE length(text) > 7000)", "doc_id", 7000, 1000), "SELECT doc_id, part::INT AS part_index, 'article' AS chunk_type, piece AS text FROM pieces UNION ALL SELECT doc_id, NULL, 'article', text FROM flat WHERE length(text) <= 7000"))
def split_articles(spark, sf_dir):
    return flat_texts(spark, sf_dir).select("doc_id", F.explode(C.split_article(F.col("text"))).alias("p")).select("doc_id", "p.part_index", "p.chunk_type", "p.text")


@query("G04_split_articles_old", with_sql(_FLAT + ",\n" + greedy_sql("(SELECT * FROM flat WHERE length(text) > 7000)", "doc_id", 7000, 1000, 0, 2), "SELECT doc_id, part::INT AS part, piece AS text FROM pieces UNION ALL SELECT doc_id, 1, text FROM flat WHERE length(text) <= 7000"))
def split_articles_old(spark, sf_dir):
    return flat_texts(spark, sf_dir).select("doc_id", F.posexplode(C.split_article_old(F.col("text"))).alias("k", "text")).select("doc_id", (F.col("k") + 1).alias("part"), "text")


CIRCLED = P.CIRCLED


def marked_texts(spark, sf_dir):
    """Each text with a circled number before every sentence after the first, an item number before its second."""
    docs = flat_texts(spark, sf_dir)
    sentences = F.transform(F.split("text", r"\. "), lambda s, i: F.when(i == 0, s).when(i % 2 == 1, F.concat(F.lit(CIRCLED).substr((i % 20) + 1, F.lit(1)), F.lit(" "), s)).otherwise(F.concat((i % 9 + 1).cast("string"), F.lit(". "), s)))
    return docs.select("doc_id", F.array_join(sentences, ". ").alias("text"))


UNITS = _FLAT + rf""",
marked AS (SELECT doc_id, array_to_string(list_transform(string_split(text, '. '), lambda x, i: CASE WHEN i = 1 THEN x WHEN i % 2 = 0 THEN substr('{CIRCLED}', (i - 1) % 20 + 1, 1) || ' ' || x ELSE ((i - 1) % 9 + 1) || '. ' || x END), '. ') AS text FROM flat),
pars AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([{CIRCLED}])', chr(2) || '\1', 'g'), chr(2))) AS p, generate_subscripts(string_split(regexp_replace(text, '([{CIRCLED}])', chr(2) || '\1', 'g'), chr(2)), 1) AS pi FROM marked WHERE regexp_matches(text, '[{CIRCLED}]')),
cut AS (SELECT *, instr('{CIRCLED}', left(p, 1)) AS no, string_split(CASE WHEN instr('{CIRCLED}', left(p, 1)) > 0 THEN regexp_replace(regexp_replace(p, '(^|\s)(\d+\.\s)', '\1' || chr(1) || '\2', 'g'), '(^|\s)(\d+\.\s)', '\1' || chr(1) || '\2', 'g') ELSE p END, chr(1)) AS xs FROM pars WHERE {strip_sql("p")} <> ''),
items AS (SELECT doc_id, pi, no, unnest(xs) AS x, generate_subscripts(xs, 1) AS ii FROM cut),
units AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pi, ii) - 1)::INT AS k, CASE WHEN no > 0 THEN '제' || no || '항' END AS paragraph,
  CASE WHEN no > 0 AND regexp_matches(x, '^\d+\.\s') THEN '제' || regexp_extract(x, '^(\d+)\.\s', 1) || '호' END AS item, {strip_sql("x")} AS text FROM items WHERE {strip_sql("x")} <> '')"""


@query("P12_structural_units", with_sql(UNITS, "SELECT doc_id, k, paragraph, item, text FROM units"))
def structural_units(spark, sf_dir):
    units = marked_texts(spark, sf_dir).select("doc_id", F.posexplode(P.structural_units(F.col("text"))).alias("k", "u"))
    return units.select("doc_id", "k", "u.paragraph", "u.item", "u.text")


@query("G05_T12_chunks", with_sql(CHUNKS, "SELECT document, pos, id, text, section, chapter, chapter_title, subsection, article, article_title, page_start, page_end, chunk_index, chunk_count, law_name FROM chunks"))
def chunks(spark, sf_dir):
    return statute_chunks(spark, sf_dir).select("document", F.col("pos").cast("long").alias("pos"), "id", "text", "section", "chapter", "chapter_title", "subsection", "article", "article_title", "page_start", "page_end", "chunk_index", "chunk_count", "law_name")


OLD_CHUNKS = MERGED + ",\nlongs AS (SELECT document || '|' || section || '|' || article AS kk, * FROM texts WHERE length(text) >= 20),\n" + greedy_sql(f"(SELECT * FROM longs WHERE length(text) > {SIZE})", "kk", SIZE, SIZE // 7, 0, 2) + rf""",
olds AS (SELECT document, pos, section, article, page_start, page_end, piece AS text, part FROM longs JOIN pieces USING (kk) UNION ALL SELECT document, pos, section, article, page_start, page_end, text, 1 FROM longs WHERE length(text) <= {SIZE}),
once_old AS (SELECT *, row_number() OVER (PARTITION BY document, sha1(regexp_replace(text, '[\s\p{{Z}}]+', '', 'g')) ORDER BY pos, part) AS nth FROM olds WHERE length(text) >= 20)"""


@query("G06_T13_chunks_old", with_sql(OLD_CHUNKS, r"SELECT document, regexp_replace(regexp_replace(regexp_replace(document || '_' || section || '_' || article || CASE WHEN part > 1 THEN '_part' || part ELSE '' END, '[^\p{L}\p{N}_\-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS id, section, article, page_start, page_end, text FROM once_old WHERE nth = 1"))
def chunks_old(spark, sf_dir):
    return C.articles_to_chunks_old(merged(spark, sf_dir), SIZE).select("document", "id", "section", "article", "page_start", "page_end", "text")


@query("G07_first_of_each", "SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY ALL")
def first_of_each(spark, sf_dir):
    return C.first_of_each(table(spark, sf_dir, "documents").select("source", "lang", "doc_id"), ["source", "lang"], ["doc_id"])


@query("G08_duplicate_keys", "SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return C.duplicate_keys(table(spark, sf_dir, "documents"), "text")


@query("M13_chunk_statistics", with_sql(CHUNKS, "SELECT law_name, count(*) AS chunks, count(*) FILTER (section = '본문') AS main, count(*) FILTER (section = '부칙') AS supplement, count(*) AS article, 0::BIGINT AS paragraph, 0::BIGINT AS item, count(DISTINCT section || article) AS articles FROM chunks GROUP BY law_name"))
def chunk_statistics(spark, sf_dir):
    from ..operators.evaluate import chunk_statistics as stats

    return stats(statute_chunks(spark, sf_dir), "law_name")


def faulty_chunks(spark, sf_dir):
    """The chunks with planted faults, by page and chunk number: each check has rows that offend it."""
    n = F.col("page_start") * 7 + F.col("chunk_index") * 3 + F.length("text")
    rows = statute_chunks(spark, sf_dir).select("document", "id", "text", "section", "chapter", "chunk_type", "paragraph", "item", "parent_id", "page_start", "page_end", "article", n.alias("n"))
    kind = F.when(F.col("n") % 11 == 3, "paragraph").when(F.col("n") % 11 == 4, "item").when(F.col("n") % 11 == 5, "clause").otherwise(F.col("chunk_type"))
    rows = rows.withColumns({
        "id": F.when(F.col("n") % 7 == 0, F.concat("document", "section")).otherwise(F.col("id")), "text": F.when(F.col("n") % 13 == 1, F.left("text", F.lit(12))).otherwise(F.col("text")),
        "section": F.when(F.col("n") % 17 == 2, "별표").otherwise(F.col("section")), "chapter": F.when(F.col("n") % 23 != 3, F.col("chapter")), "chunk_type": kind, "paragraph": F.when(F.col("n") % 5 == 0, "제1항"), "item": F.when(F.col("n") % 9 == 0, "제1호"),
        "parent_id": F.when(F.col("n") % 4 == 1, F.col("id")).when(F.col("n") % 4 == 2, F.concat("id", F.lit("_lost"))), "page_end": F.when(F.col("n") % 19 == 6, F.lit(0)).otherwise(F.col("page_end")),
    })
    return rows.drop("n")


FAULTY = CHUNKS + """,
numbered AS (SELECT *, page_start * 7 + chunk_index * 3 + length(text) AS n FROM chunks),
faulty AS (SELECT document, CASE WHEN n % 7 = 0 THEN document || section ELSE id END AS id, CASE WHEN n % 13 = 1 THEN left(text, 12) ELSE text END AS text, CASE WHEN n % 17 = 2 THEN '별표' ELSE section END AS section, CASE WHEN n % 23 <> 3 THEN chapter END AS chapter,
  CASE n % 11 WHEN 3 THEN 'paragraph' WHEN 4 THEN 'item' WHEN 5 THEN 'clause' ELSE chunk_type END AS chunk_type, CASE WHEN n % 5 = 0 THEN '제1항' END AS paragraph, CASE WHEN n % 9 = 0 THEN '제1호' END AS item,
  CASE n % 4 WHEN 1 THEN id WHEN 2 THEN id || '_lost' END AS parent_id, page_start, CASE WHEN n % 19 = 6 THEN 0 ELSE page_end END AS page_end, article FROM numbered)"""
OFFENCES = "SELECT document, '{}' AS \"check\", id AS offending_id FROM faulty WHERE {}"


def offences(name: str, bad: str) -> str:
    return with_sql(FAULTY, OFFENCES.format(name, bad))


def _only(name: str):
    def plan(spark, sf_dir):
        return V.row_checks(faulty_chunks(spark, sf_dir), F.lit(2)).where(F.col("check") == name)

    return plan


_ROW_CHECKS = {
    "V02": "section = '본문' AND chapter IS NULL",
    "V04": "page_start < 1 OR page_end < page_start OR page_end > 2",
    "V05": "length(text) < 20",
    "V06": "section NOT IN ('본문', '부칙')",
    "V07": "chunk_type NOT IN ('article', 'paragraph', 'item')",
    "V08a": "(chunk_type = 'article') <> (parent_id IS NULL)",
    "V09": "CASE chunk_type WHEN 'article' THEN paragraph IS NOT NULL OR item IS NOT NULL WHEN 'paragraph' THEN paragraph IS NULL OR item IS NOT NULL ELSE item IS NULL END",
}
for _name, _bad in _ROW_CHECKS.items():
    query(f"{_name}_row_check", offences(_name, _bad))(_only(_name))


@query("V01_duplicate_ids", with_sql(FAULTY, "SELECT document, 'V01' AS \"check\", id AS offending_id FROM faulty GROUP BY document, id HAVING count(*) > 1"))
def duplicate_ids(spark, sf_dir):
    return V.duplicates(faulty_chunks(spark, sf_dir), ["document", "id"], "V01")


@query("V12_duplicate_articles", with_sql(FAULTY, "SELECT document, 'V12' AS \"check\", section || '|' || article AS offending_id FROM faulty GROUP BY document, section, article HAVING count(*) > 1"))
def duplicate_articles(spark, sf_dir):
    return V.duplicates(faulty_chunks(spark, sf_dir), ["document", "section", "article"], "V12")


@query("V03_missing_keys", with_sql(CHUNKS, "SELECT DISTINCT document, 'V03' AS \"check\", k AS offending_id FROM chunks, (VALUES ('chunk_count'), ('law_name')) v(k)"))
def missing_keys(spark, sf_dir):
    """Two of the required columns are left out of the chunks."""
    return V.missing_keys(statute_chunks(spark, sf_dir).drop("law_name", "chunk_count"))


@query("V08_J08_orphans", with_sql(FAULTY, "SELECT document, 'V08' AS \"check\", id AS offending_id FROM faulty c WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM faulty p WHERE p.document = c.document AND p.id = c.parent_id)"))
def orphans(spark, sf_dir):
    return V.orphans(faulty_chunks(spark, sf_dir))


@query("V10_parents_of_kind", "SELECT conv_id::VARCHAR AS document, 'V10' AS \"check\", turn::VARCHAR AS offending_id FROM conversations c WHERE turn > 0 AND NOT EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1 AND p.role = 'user')")
def parents_of_kind(spark, sf_dir):
    return V.orphans(turn_tree(spark, sf_dir), of_article=True)


def turn_tree(spark, sf_dir):
    """Conversations as a tree: a turn's parent is the turn before it; user turns stand for articles."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(F.col("conv_id").cast("string").alias("document"), F.col("turn").cast("string").alias("id"), F.when(F.col("turn") > 0, (F.col("turn") - 1).cast("string")).alias("parent_id"), F.when(F.col("role") == "user", "article").otherwise("paragraph").alias("chunk_type"))


@query("V11_verdicts", with_sql(CHUNKS, """, bad AS (SELECT DISTINCT document FROM chunks WHERE (section = '본문' AND chapter IS NULL) UNION SELECT document FROM chunks GROUP BY document, id HAVING count(*) > 1)
SELECT a.document, b.document IS NULL AS passed, NOT a.found OR coalesce(h.have, false) AS supplement_ok FROM (SELECT document, bool_or(section = '부칙') AS found FROM merged GROUP BY document) a LEFT JOIN (SELECT document, bool_or(section = '부칙') AS have FROM chunks GROUP BY document) h USING (document) LEFT JOIN bad b USING (document)"""))
def verdicts(spark, sf_dir):
    from ..storage import staged

    own = staged(statute_chunks(spark, sf_dir), "chunks")
    return V.verdicts(own, merged(spark, sf_dir), V.validate_chunks(own))


@query("V12_oversize", with_sql(MERGED, f"SELECT document, 'V12' AS \"check\", section || article AS offending_id FROM texts WHERE length(text) > {SIZE}"))
def oversize(spark, sf_dir):
    return V.oversize(merged(spark, sf_dir).withColumn("id", F.concat("section", "article")), SIZE)


@query("S05_S06_K01_chunk_files", with_sql(CHUNKS, "SELECT document, id, text, article, law_name AS law FROM chunks"))
def chunk_files(spark, sf_dir):
    folder = shared_folder(spark, "chunk-files")
    nested = C.nested_chunks(statute_chunks(spark, sf_dir))
    # a folder per document suits some thousands of documents; more share folders by hash
    nested.withColumn("file", F.pmod(F.xxhash64("document"), F.lit(16))).write.partitionBy("file").json(folder)
    back = files.read_chunks(spark, folder)
    return back.select(F.regexp_replace("metadata.source.file", r"\.pdf$", "").alias("document"), "id", "text", "metadata.article", "law")
