"""Language-aware tokens for lexical search, as array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Particles taken off a word's end, and verb endings whose stem is a token too.
PARTICLES = "은 는 이 가 을 를 의 에 에서 에게 으로 로 와 과 도 만 이나 나 란 이란 까지 부터 보다 처럼 에서는 에는 에도 에서도 으로는 으로도 에서의 에의 와의 과의 이고 이며 이라 으로서 로서 으로써 로써 이어서 여서 에서부터 로부터 은요 는요 나요 인가요 인지 이야 이에요 인데 이라면 라면 라도 이라도".split()
VERB_ENDINGS = "되나요 됩니까 됩니다 되어야 되어서 되어있 되었 되어 되는 됩 되고 되며 되면 되지 되다 해야 합니까 합니다 하나요 하여야 하여 하는 하고 하며 하면 하지 하다 합 이다 이며 있나요 있어야 있습니까 있습니다 있는 있어 되".split()


def raw_words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, longer than one character."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " ")
    return F.filter(F.split(plain, r"(?U)\s+"), lambda w: F.length(w) > 1)


def tokenize(text: Column, dedup: bool = True) -> Column:
    """Words without their particle, and the stems of verbs; each once, in order of appearance."""
    particle, verb = f"({'|'.join(PARTICLES)})$", f"({'|'.join(VERB_ENDINGS)})$"
    # only words that end in Hangul have particles or endings; a comparison is cheaper than a pattern
    korean = lambda w: F.right(w, F.lit(1)).between("가", "힣")

    def bare(w):
        cut = F.regexp_replace(w, particle, "")
        return F.when(korean(w) & (F.length(cut) > 1), cut).otherwise(w)

    def with_stem(w):
        stem = F.left(w, F.length(w) - F.length(F.regexp_extract(w, verb, 1)))
        return F.when(korean(w) & w.rlike(f"^..+?{verb}") & (F.length(stem) >= 2), F.array(w, stem)).otherwise(F.array(w))

    plain = raw_words(text)
    # a text without Hangul is its words: no function runs word by word
    out = F.when(text.rlike("[가-힣]"), F.flatten(F.transform(F.transform(plain, bare), with_stem))).otherwise(plain)
    return F.array_distinct(out) if dedup else out
