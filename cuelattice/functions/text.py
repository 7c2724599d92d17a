"""Column functions on words, cue texts and timecodes."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Abbreviations whose period does not end a sentence.
ABBREVIATIONS = [
    "mr", "mrs", "ms", "messrs", "dr", "prof", "st", "mt", "sr", "jr", "rev", "fr", "hon", "gen", "lt", "col", "sgt", "capt", "cmdr", "sen", "rep",
    "gov", "supt", "det", "adm", "maj", "vs", "vol", "fig", "pp", "al", "u.s", "u.k", "a.m", "p.m", "e.g", "i.e",
]
# Contractions (applied in this order), spelled numbers and fillers of the metric normalizer.
CONTRACTIONS = {"won't": "will not", "can't": "can not", "n't": " not", "'re": " are", "'ll": " will", "'ve": " have", "'m": " am", "'d": " would"}
NUMBERS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10", "eleven": "11", "twelve": "12", "twenty": "20", "thirty": "30", "forty": "40", "fifty": "50", "hundred": "100"}
FILLERS = ["uh", "um", "uhm", "hmm", "mm", "mhm", "er", "erm", "ah"]
# English stopwords of the word-language test.
STOPWORDS = [
    "the", "and", "that", "this", "with", "from", "have", "has", "was", "were", "been", "will", "would", "could", "should", "can", "not", "for", "but",
    "are", "you", "your", "they", "them", "their", "what", "when", "where", "which", "who", "whom", "how", "why", "all", "any", "more", "most", "some",
    "such", "only", "own", "same", "so", "than", "too", "very", "just", "because", "about", "into", "over", "after", "before", "between", "under",
    "again", "further", "then", "once", "here", "there", "each", "few", "both", "also", "one", "two", "three",
]
# Scripts by character range, in order of the test.
SCRIPTS = (("ar", r"[؀-ۿݐ-ݿ]"), ("zh", r"[一-鿿]"), ("ja", r"[぀-ゟ゠-ヿ]"), ("ko", r"[가-힯]"), ("ru", r"[Ѐ-ӿ]"), ("el", r"[Ͱ-Ͽ]"), ("he", r"[֐-׿]"))
# Patterns of tags, of marks that name no sound, of closing marks and sentence ends, and of bracketed text in metrics.
TAG = r"\[[^\]]*\]"
TIMECODE = r"^[0-9]{2}:[0-9]{2}:[0-9]{2}"
END_MARK = "END OF AUDIO"
NO_SOUND = r"\?|inaudible|unintelligible|[0-9]{2}:[0-9]{2}"
CLOSERS = "[\"'”’»）】]*$"
TERMINAL = "[.!?…。！？‥]+[\"'”’»）】]?$"
BRACKETED = r"\[.*?\]|\(.*?\)"


#: Letters whose capital is several letters by Java (ß: SS), with the one that stands for it, themselves where there is none.
_ONE_CAPITAL = {c: c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x10000)) if len(c.upper()) > 1} | {"ß": "ẞ"}


def upper(text: Column) -> Column:
    """Capitals letter by letter, so that a text keeps its length; for short texts."""
    one = F.create_map(*[F.lit(x) for kv in _ONE_CAPITAL.items() for x in kv])
    return F.when(text == "", text).otherwise(F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.element_at(one, c), F.upper(c))), ""))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[^ \n\t\r]+"), F.lit(0))


def normalize_word(word: Column) -> Column:
    """Letters, digits and underscores, lower-cased. Java's \\w is ASCII only, hence the classes."""
    return F.lower(F.regexp_replace(word, r"[^\p{L}\p{N}_\s]", ""))


def strip_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, TAG, " "), r" +", " "))


def extract_tags(text: Column) -> Column:
    """Distinct labels in [tags], but timecodes and end marks."""
    labels = F.transform(F.regexp_extract_all(text, F.lit(r"\[([^\]]*)\]"), F.lit(1)), lambda t: F.trim(t))
    return F.array_distinct(F.filter(labels, lambda t: ~t.rlike(TIMECODE) & ~t.contains(END_MARK)))


def sentence_end(text: Column) -> Column:
    t = F.trim(text)
    bare = F.regexp_replace(t, CLOSERS, "")
    last = F.regexp_replace(F.lower(F.regexp_extract(bare, r"([^ ]*)$", 1)), r"\.+$", "")
    short = bare.endswith(".") & last.isin(ABBREVIATIONS)
    return bare.endswith("--") | (t.rlike(TERMINAL) & ~short)


def visible_chars(text: Column) -> Column:
    return F.length(F.replace(text, F.lit("\n"), F.lit("")))


def longest_line(text: Column) -> Column:
    return F.array_max(F.transform(F.split(text, "\n"), lambda x: F.length(x)))


def caption_tokens(text: Column) -> Column:
    """Tokens; a [tag of several words] stays whole."""
    return F.regexp_extract_all(text, F.lit(r"[^ \n\t\r\[]*\[[^\]]*\][^ \n\t\r]*|[^ \n\t\r]+"), F.lit(0))


def isolated_tag(text: Column) -> Column:
    return F.trim(text).rlike(r"^\[[^\]]*\]$")


def tags_only(text: Column) -> Column:
    return F.trim(text).rlike(r"^(\[[^\]]*\][ \n]*)+$")


def sound_tag(tag: Column) -> Column:
    """A tag that names a sound, not a mark such as [?] or [inaudible 00:01:02]."""
    return tag.rlike(r"^\[[^\]]+\]$") & ~F.lower(tag).rlike(NO_SOUND)


def keepable_tags(line: Column) -> Column:
    """A line with tags all of which belong in subtitles: no timecode, no end mark, none empty."""
    labels = F.transform(F.regexp_extract_all(line, F.lit(r"\[([^\]]*)\]"), F.lit(1)), lambda t: F.trim(t))
    return (F.size(labels) > 0) & F.forall(labels, lambda t: (t != "") & ~t.rlike(TIMECODE) & ~F.upper(t).contains(END_MARK))


def plausible(start: Column, end: Column) -> Column:
    return (start >= 0) & (end - start >= 20) & (end - start <= 3000)


def spoken_ms(word: Column) -> Column:
    return F.least(F.lit(800), F.greatest(F.lit(150), 70 * F.length(word) + 50))


def metric_words(text: Column) -> Column:
    t = F.regexp_replace(F.lower(F.replace(text, F.lit("’"), F.lit("'"))), BRACKETED, " ")
    for old, new in CONTRACTIONS.items():
        t = F.replace(t, F.lit(old), F.lit(new))
    t = F.replace(F.regexp_replace(t, r"[^\p{L}\p{N}_\s']", " "), F.lit("'"), F.lit(""))
    numbers = F.create_map(*[F.lit(x) for kv in NUMBERS.items() for x in kv])
    return F.filter(F.transform(tokens(t), lambda w: F.coalesce(F.element_at(numbers, w), w)), lambda w: ~w.isin(FILLERS))


def script_of(text: Column) -> Column:
    return F.coalesce(*[F.when(text.rlike(pattern), lang) for lang, pattern in SCRIPTS], F.lit(None).cast("string"))


def word_language(word: Column, fallback: Column) -> Column:
    clean = F.btrim(F.lower(word), F.lit(".,;:!?\"'()[]{}"))
    return F.when(~word.rlike(r"\p{L}"), fallback).otherwise(F.coalesce(script_of(word), F.when(clean.isin(STOPWORDS), "en"), fallback))


def to_ms(timecode: Column) -> Column:
    """HH:MM:SS,mmm (or a point) as milliseconds; anything else is 0."""
    part = lambda i: F.nullif(F.regexp_extract(timecode, r"^([0-9]+):([0-9]{1,2}):([0-9]{1,2})[,.]([0-9]{3})$", i), F.lit("")).cast("long")
    return F.coalesce(((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4), F.lit(0))


def timecode(ms: Column, mark: str = ",") -> Column:
    ms = F.greatest(ms.cast("long"), F.lit(0))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    h = F.floor(ms / 3600000)
    hours = F.when(h < 100, two(h)).otherwise(h.cast("string"))
    return F.concat(hours, F.lit(":"), two(F.floor(ms / 60000) % 60), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit(mark), F.lpad((ms % 1000).cast("string"), 3, "0"))


def same_words(a: Column, b: Column) -> Column:
    """A rewrite may change punctuation and case only."""
    words = lambda x: F.filter(F.transform(tokens(x), normalize_word), lambda w: w != "")
    return (words(a) == words(b)) & (F.size(words(a)) > 0)


def polished(text: Column) -> Column:
    """i -> I, capital at the start and after . ! ?, a period at the end."""
    t = F.regexp_replace(F.trim(text), r"\bi\b", "I")
    parts = F.regexp_extract_all(t, F.lit(r"[^.!?]*[.!?]+ *|[^.!?]+"), F.lit(0))
    t = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")
    return F.when(t.rlike("[.!?]$") | (t == ""), t).otherwise(F.concat(t, F.lit(".")))


def register_sql(spark: SparkSession) -> None:
    """cl_normalize_word, cl_spoken_ms, cl_timecode_ms, cl_timecode, cl_strip_tags for SQL users."""
    for name, args, body in (
        ("cl_normalize_word", "w STRING) RETURNS STRING", r"lower(regexp_replace(w, '[^\\p{L}\\p{N}_\\s]', ''))"),
        ("cl_spoken_ms", "w STRING) RETURNS INT", "least(800, greatest(150, 70 * length(w) + 50))"),
        ("cl_timecode_ms", "t STRING) RETURNS BIGINT", "CASE WHEN t RLIKE '^[0-9]+:[0-9]{1,2}:[0-9]{1,2}[,.][0-9]{3}$' THEN ((bigint(split_part(t, ':', 1)) * 60 + int(split_part(t, ':', 2))) * 60 + int(split_part(replace(split_part(t, ':', 3), '.', ','), ',', 1))) * 1000 + int(split_part(replace(t, '.', ','), ',', 2)) ELSE 0 END"),
        ("cl_timecode", "ms BIGINT) RETURNS STRING", "concat(lpad(string(ms div 3600000), greatest(2, length(string(ms div 3600000))), '0'), ':', lpad(string(ms div 60000 % 60), 2, '0'), ':', lpad(string(ms div 1000 % 60), 2, '0'), ',', lpad(string(ms % 1000), 3, '0'))"),
        ("cl_strip_tags", "t STRING) RETURNS STRING", r"trim(regexp_replace(regexp_replace(t, '\\[[^\\]]*\\]', ' '), ' +', ' '))"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args} RETURN {body}")
