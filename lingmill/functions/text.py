"""Text functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The literal separator of prompt sections: backslash n backslash n, four characters.
SEP = "\\n\\n"
TERMINATORS = ".?!।。？！؟"
BUCKET_MARKS = "।॥.!?？！。"
#: Script name to code point range, in the order that breaks ties.
RANGES = {
    "devanagari": "ऀ-ॿ", "bengali": "ঀ-৿", "arabic": "؀-ۿݐ-ݿ", "cyrillic": "Ѐ-ӿ",
    "kana": "぀-ヿ", "hangul": "가-힯", "han": "一-鿿㐀-䶿", "latin": "A-Za-zÀ-ɏ",
}
# Arabic, Devanagari, Bengali, Thai, Telugu, kana, Chinese characters, Hangul.
NON_LATIN = r"\x{0600}-\x{06FF}\x{0900}-\x{097F}\x{0980}-\x{09FF}\x{0E00}-\x{0E7F}\x{0C00}-\x{0C7F}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7A3}"
QUOTES = [('"', '"'), ("«", "»"), ("“", "”"), ("„", "“"), ("„", "”"), ("‘", "’")]
RUNAWAY = "(?:\nuser\n|\nassistant\n|<think>)"


def strip(c: Column) -> Column:
    """All Unicode white space off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def is_blank(c: Column) -> Column:
    """White space alone, or nothing; ends at the first other character."""
    return ~c.rlike(r"(?U)\S")


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def bare(code: Column) -> Column:
    """hin_Deva: hin."""
    return F.split_part(code, F.lit("_"), F.lit(1))


def digest16(c: Column) -> Column:
    return F.substring(F.md5(c.cast("binary")), 1, 16)


def talk_key(c: Column) -> Column:
    """Digest of 300 characters after the first blank line; of the whole text's if there is none."""
    return digest16(F.substring(F.regexp_replace(c, r"(?s)\A.*?\n\n", ""), 1, 300))


def last_segment(ident: Column) -> Column:
    return F.element_at(F.split(ident, "_"), -1)


def sections(c: Column) -> Column:
    return F.split(c, r"\\n\\n")


def unescape(c: Column) -> Column:
    return F.replace(c, F.lit("\\n"), F.lit("\n"))


def wrap_context(lead: Column, passage: Column, intro: Column, question: Column, tail: Column) -> Column:
    return F.concat_ws(SEP, lead, strip(passage), F.concat(intro, strip(question)), tail)


def append_clause(c: Column, clause: Column) -> Column:
    return F.concat(rstrip(c), F.lit("\n\n"), clause)


def truncate_runaway(c: Column) -> Column:
    """Cut at the first sign of a new turn; a text without one keeps its trailing white space."""
    return F.when(c.rlike(RUNAWAY), rstrip(F.regexp_extract(c, rf"(?s)\A(.*?){RUNAWAY}", 1))).otherwise(c)


def sentences(c: Column, marks: str = TERMINATORS) -> Column:
    """Sentences with their terminators, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(f"(?s)[^{marks}]*[{marks}]|[^{marks}]+$"), F.lit(0)), strip), lambda s: s != "")


def danda_sentences(c: Column) -> Column:
    """Split at white space behind a danda, double danda or full stop."""
    return F.filter(F.transform(F.split(c, "(?U)(?<=[।॥.])\\s+"), strip), lambda s: s != "")


def one_sentence(c: Column) -> Column:
    """Not blank, and no terminator or a single one at the very end."""
    s = strip(c)
    n = F.length(s) - F.length(F.translate(s, TERMINATORS, ""))
    return (s != "") & ((n == 0) | ((n == 1) & s.rlike(f"[{TERMINATORS}]$")))


def sentence_bucket(c: Column) -> Column:
    s = strip(c)
    n = F.length(s) - F.length(F.translate(s, BUCKET_MARKS, "")) - s.rlike(f"[{BUCKET_MARKS}]$").cast("int")
    return F.when(n <= 0, "one").when(n == 1, "two").otherwise("many")


def count_in(c: Column, ranges: str) -> Column:
    """Characters in the ranges: those that are gone when runs of them are cut out.

    A match of each other character takes many times longer, and so do runs of the negated Latin set.
    """
    return F.length(c) - F.length(F.regexp_replace(c, f"[{ranges}]+", ""))


def script_fraction(c: Column, script: str) -> Column:
    """Share of letters of a Unicode script (Latin, Devanagari, Han ...; Japanese: Han, Hiragana or Katakana); no letters: 1."""
    names = ["Han", "Hiragana", "Katakana"] if script == "Japanese" else [script]
    letters = F.length(F.regexp_replace(c, r"\P{L}+", ""))
    own = count_in(F.regexp_replace(c, r"\P{L}+", ""), "".join(f"\\p{{Is{n}}}" for n in names))
    return F.when(letters == 0, 1.0).otherwise(own / letters)


def script_of(c: Column) -> Column:
    """The range with most characters, the first of equal ones; none: 'none'.

    Latin letters that are over half of a text can't be outnumbered, so most texts are counted once. Else each range is
    counted once: the counts are read in a lambda.
    """
    names = F.array(*map(F.lit, RANGES))
    counts = F.array(*(count_in(c, r) for r in RANGES.values()))
    most = F.transform(F.array(counts), lambda n: F.when(F.array_max(n) > 0, F.get(names, (F.array_position(n, F.array_max(n)) - 1).cast("int"))).otherwise("none"))
    return F.when(2 * count_in(c, RANGES["latin"]) > F.length(c), "latin").otherwise(F.get(most, F.lit(0)))


def non_latin_fraction(c: Column) -> Column:
    """Share of letters in NON_LATIN; no letters: 0."""
    letters = F.length(F.regexp_replace(c, r"\P{L}+", ""))
    other = count_in(F.regexp_replace(c, r"\P{L}+", ""), NON_LATIN)
    return F.when(letters == 0, 0.0).otherwise(other / letters)


def script_mismatch(gold: Column, pred: Column) -> Column:
    return (non_latin_fraction(gold) > 0.5) & (non_latin_fraction(pred) < 0.2)


def length_mismatch(gold: Column, pred: Column) -> Column:
    return F.length(pred) > 3 * F.length(gold) + 20


def has_token(c: Column, pattern: str) -> Column:
    """A whole token: between starts, ends, commas, white space or dandas."""
    return F.concat(F.lit(" "), c, F.lit(" ")).rlike(f"(?U)(?:^|[,\\s।])(?:{pattern})(?=[\\s,।]|$)")


# Pairs of words with one function in Bhojpuri and Hindi.
CONTRASTS = [
    ("'and'", "आ", "और"),
    ("'for'", "खातिर", "के लिए"),
    ("copula", "बा|बाड़|होखल|होला", "है|हैं"),
    ("oblique", "के", "की|को"),
    ("infinitive", "करे|करल", "करना|करता"),
]


def lean(c: Column, pairs: list[tuple[str, str, str]], a: str = "a", b: str = "b") -> Column:
    """Which of two varieties more of the contrasting pairs (name, pattern of a, pattern of b) speak for; null if neither."""
    n = {k: reduce(add, (has_token(c, p[i]).cast("int") for p in pairs)) for k, i in ((a, 1), (b, 2))}
    return F.when(n[a] > n[b], a).when(n[b] > n[a], b)


def quoted(c: Column) -> Column:
    """The first quotation of 2 to 40 characters, pairs of marks in order; apostrophes are no marks."""
    return strip(F.coalesce(*(F.nullif(F.regexp_extract(c, f"{o}([^{o}{z}]{{2,40}}){z}", 1), F.lit("")) for o, z in QUOTES)))


def strip_framing(c: Column, frame: str = "The previous text is in") -> Column:
    return F.split(c, rf"\s*\|?\s*{frame}\b")[0]


def preview(c: Column, n: int = 160) -> Column:
    return F.substring(c, 1, n)


def tail_of(c: Column, n: int = 120) -> Column:
    return F.right(c, F.lit(n))
