"""Column functions on text: tokens, edit distance, word lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that retrieval leaves out.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "being", "but", "by",
    "can", "did", "do", "does", "doing", "for", "from", "had", "has", "have",
    "having", "he", "her", "him", "his", "how", "i", "if", "in", "into", "is",
    "it", "its", "itself", "just", "me", "more", "most", "my", "no", "not",
    "now", "of", "on", "once", "only", "or", "other", "our", "out", "own",
    "she", "so", "some", "such", "than", "that", "the", "their", "them",
    "then", "there", "these", "they", "this", "those", "to", "too", "up",
    "us", "very", "was", "we", "were", "what", "when", "where", "which",
    "who", "will", "with", "you", "your",
)
# Words that chapter titles leave out.
TITLE_STOP_WORDS = (
    "the", "a", "an", "is", "it", "in", "on", "at", "to", "of", "and", "or",
    "but", "for", "with", "this", "that", "was", "are", "be", "been", "have",
    "has", "had", "not", "we", "i", "you", "he", "she", "they", "do", "does",
    "so", "if", "as", "by", "from", "also", "just", "then", "than", "about",
    "up", "out", "what", "when", "which", "who", "will", "can", "its", "into",
    "more", "very", "like", "all", "now", "how", "no", "get", "one", "some",
    "there", "their", "them", "our", "your", "his", "her", "my", "me", "re",
    "go", "come", "know", "want", "look", "right", "okay", "yeah", "ve",
    "ll", "don", "didn", "isn", "wasn", "aren", "won", "let", "got",
)
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0]+"
#: Vocabulary ids that every vocabulary begins with.
PAD, UNK, CLS, SEP = 0, 1, 2, 3


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda t: t != "")


def tokenize(text: Column, stop: bool = True) -> Column:
    """Lower case, punctuation deleted, words of two characters and more, without stop words."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    words = F.filter(split_words(bare), lambda t: F.length(t) > 1)
    return F.filter(words, lambda t: ~t.isin(*STOP_WORDS)) if stop else words


def vocabulary_tokens(text: Column) -> Column:
    """Lower case, only a-z, 0-9 and white space kept; null gives no tokens."""
    bare = F.regexp_replace(F.trim(F.lower(F.coalesce(text, F.lit("")))), r"[^a-z0-9\s]", "")
    return F.filter(F.split(bare, r"\s+"), lambda t: t != "")


def confusable(word: Column) -> Column:
    """Characters that readers of pixels take for one another become one."""
    return F.translate(word, "iIlLJ", "11111")


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(confusable(F.lower(a)), confusable(F.lower(b)))


def edit_confidence(a: Column, b: Column) -> Column:
    """1 - distance / longer length; null where both are empty."""
    return 1 - F.try_divide(edit_distance(a, b).cast("double"), F.greatest(F.length(a), F.length(b)).cast("double"))


def whitelisted(text: Column) -> Column:
    """Letters, digits, blanks and the marks that transcripts keep."""
    return F.regexp_replace(text, r"""[^A-Za-z0-9 .,!?;:'"\-()\[\]{}]""", "")


def padded(ids: Column, size: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(PAD), F.greatest(F.lit(0), F.lit(size) - F.size(ids))))


def minutes(seconds: Column) -> Column:
    """m:ss"""
    whole = F.floor(seconds)
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def mpeg7_seconds(time: Column) -> Column:
    """T<h>:<m>:<s>:<fraction>F<denominator> as seconds; 0 where it has another form."""
    form = r"T(\d+):(\d+):(\d+):(\d+)F(\d+)"
    part = lambda k: F.regexp_extract(time, form, k).try_cast("double")
    return F.coalesce(part(1) * 3600 + part(2) * 60 + part(3) + F.try_divide(part(4), part(5)), F.lit(0.0))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)
