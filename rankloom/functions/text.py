"""Text functions as columns."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import unicode

#: Words that full-text queries leave out.
STOPWORDS = (
    "a an and are as at be been by for from had has have he her his in is it its of on or she that the their there they this to was were "
    "which who will with"
).split()
#: What makes a text negative.
NEGATION = r"(?i)\b(?:no|not|never|none|neither|without|cannot|can't|won't|doesn't|does\s+not|do\s+not|did\s+not|is\s+not|are\s+not|must\s+not)\b"
#: Fixed value: the answer of an abstention.
SENTINEL = "__UNANSWERABLE__"


@cache
def _folds() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """What case folding changes beyond lower case: letters for letters, and letters for several; the sharp s is apart."""
    lower = [c for c in map(chr, range(0x20000)) if not 0xD800 <= ord(c) < 0xE000 and c.lower() == c != c.casefold() and c != "ß"]
    one = [c for c in lower if len(c.casefold()) == 1]
    return "".join(one), "".join(c.casefold() for c in one), tuple((c, c.casefold()) for c in lower if len(c.casefold()) > 1)


def _ranges(letters: str) -> str:
    """A class of letters by ranges: a regular expression tries the members of a class one after another."""
    points, out = sorted(map(ord, letters)), []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in out) + "]"


def casefold(text: Column) -> Column:
    """Full case folding in the JVM: lower case with the sharp s as two; the other letters that fold further are rare, and only texts that have one pay for them."""
    ones, to, many = _folds()
    low = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in many])
    wide = F.aggregate(pairs, F.translate(low, ones, to), lambda acc, p: F.replace(acc, p["a"], p["b"]))
    rare = ones + "".join(c for c, _ in many)
    beyond = rf"[µ\x{{{min(ord(c) for c in rare if c != 'µ'):x}}}-\x{{10ffff}}]"  # what most texts don't have, by two members
    return F.when(low.rlike(beyond) & low.rlike(_ranges(rare)), wide).otherwise(low)


def tokens(text: Column) -> Column:
    """Unicode words of the folded text, in order."""
    return F.regexp_extract_all(casefold(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def alnum_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(casefold(text), F.lit(r"([a-z0-9]+)"), 1))


def question_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(casefold(text), F.lit(r"([a-z0-9][a-z0-9_.:/-]*)"), 1))


def fts_terms(text: Column) -> Column:
    """Distinct query terms over two letters and no stop words; if none is left the first eight words."""
    words = tokens(text)
    kept = F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS)))
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(words, 1, 8))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def heading_key(doc_id: Column, heading: Column) -> Column:
    return F.concat(doc_id, F.lit("::"), slug(heading))


def decomposed(text: Column) -> Column:
    """NFKD. Texts of ASCII are their own and don't go through Python."""
    return F.coalesce(unicode.nfkd(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def composed(text: Column) -> Column:
    """NFC, in the same way."""
    return F.coalesce(unicode.nfc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "), r"^ | $", "")


def normalize_answer(text: Column) -> Column:
    """Decomposed, folded, without ASCII punctuation and articles, single spaces."""
    t = F.regexp_replace(casefold(decomposed(F.coalesce(text, F.lit("")))), r"[!-/:-@\[-`{-~]", "")
    return squeeze(F.regexp_replace(t, r"(?U)\b(a|an|the)\b", " "))


def normalized_text(text: Column) -> Column:
    """Composed, single spaces, folded."""
    return casefold(squeeze(composed(text)))


def is_abstention(text: Column) -> Column:
    return F.lower(text).contains("enough information")


def sentences(stored: Column) -> Column:
    """A document's sentences: those stored, trimmed and without blanks; a single one is split after sentence marks and at line ends."""
    kept = F.filter(F.transform(stored, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    split = F.filter(F.transform(F.split(F.get(kept, F.lit(0)), r"(?U)(?<=[.!?])\s+|[\r\n]+"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    return F.when((F.size(kept) == 1) & (F.size(split) > 1), split).otherwise(kept)


def word_windows(words: Column, width: int = 180, overlap: int = 40) -> Column:
    """Overlapping windows of an array of words; the last one covers the tail."""
    step = width - overlap
    n = F.size(words)
    count = F.when(n <= width, 1).otherwise(F.ceil((n - width) / step).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("window"), F.slice(words, i * step + 1, F.lit(width)).alias("words")))


def canonical_sha256(row: dict[str, Column]) -> Column:
    """Digest of a row as JSON with sorted keys, no blanks and nulls kept."""
    return F.sha2(F.to_json(F.struct(*[row[k].alias(k) for k in sorted(row)]), {"ignoreNullFields": "false"}), 256)


def one_edit_apart(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b) == 1


def semver_key(version: Column) -> Column:
    """Orders versions; a release comes after its own pre-releases."""
    part = lambda i: F.regexp_extract(version, r"^v?(\d+)\.(\d+)\.(\d+)(?:-(.+))?$", i)
    return F.struct(part(1).cast("int").alias("major"), part(2).cast("int").alias("minor"), part(3).cast("int").alias("patch"), (part(4) == "").cast("int").alias("release"), part(4).alias("pre"))


def prompt_tokens(text: Column) -> Column:
    """An upper estimate of a prompt's tokens."""
    return (F.ceil(F.octet_length(text) / 3) + 64).cast("long")


def judge_integer(text: Column) -> Column:
    """The first integer in a text, held to 0..10; null without one."""
    found = F.regexp_extract(text, r"(-?\d+)", 1)
    return F.when(found != "", F.least(F.greatest(found.cast("long"), F.lit(0)), F.lit(10)))


def percent(value: Column) -> Column:
    """One decimal, halves to the even digit; `n/a` for null."""
    return F.when(value.isNull(), "n/a").otherwise(F.format_string("%.1f%%", F.bround(value * 100, 1)))


def negated(text: Column) -> Column:
    return text.rlike(NEGATION)


def loses_negation(reference: Column, candidate: Column) -> Column:
    return negated(reference) & ~negated(candidate)


def fts_expression(terms: Column, operator: str = "OR") -> Column:
    """A quoted full-text expression of the terms."""
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))), f" {operator} ")


def title_candidates(text: Column, most: int = 6) -> Column:
    """Every run of 1 to `most` words joined by underscores, composed, sorted: the page titles that a text may name. Possessive endings are cut."""
    return unicode.word_runs(text, F.lit(most))


def namespaced_ids(prefix: str, count: Column) -> Column:
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1)).cast("int")), lambda i: F.concat(F.lit(prefix), i.cast("string")))).otherwise(F.array().cast("array<string>"))


def utc_timestamp(text: Column) -> Column:
    """An ISO timestamp in UTC with the suffix Z; without a zone it is in UTC already. Fractions of a second stay if there are any."""
    zoned = text.rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})$")
    at = F.to_utc_timestamp(F.to_timestamp(F.when(zoned, text).otherwise(F.concat(text, F.lit("Z")))), F.current_timezone())
    micros = F.date_format(at, "SSSSSS")
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("Z"))


def stable_custom_id(case_id: Column) -> Column:
    return F.concat(F.lit("rag-"), F.substring(F.sha2(case_id, 256), 1, 24))


def evidence_cluster(answerable: Column, record_id: Column, relevant: Column) -> Column:
    """A name for a set of evidence ids, whatever their order; without an answer the record is a cluster of its own."""
    named = F.concat(F.lit("legacy-v1-evidence::"), F.substring(F.sha2(F.to_json(F.array_sort(relevant)), 256), 1, 16))
    return F.when(answerable, named).otherwise(F.concat(F.lit("legacy-v1-unanswerable::"), record_id))


def matches_checkout(content: Column, sha256: Column) -> Column:
    """Whether a file has this digest with its own line ends, or with LF or CRLF for all of them."""
    lf = F.replace(content, F.lit("\r\n"), F.lit("\n"))
    return sha256.isin(F.sha2(content, 256), F.sha2(lf, 256), F.sha2(F.replace(lf, F.lit("\n"), F.lit("\r\n")), 256))


def find_answer(context: Column, answers: Column) -> Column:
    """(start, answer) of the answer that stands first in the context, the shortest of these; null if none does. Case is folded by lower case, which keeps places."""
    found = F.transform(F.filter(answers, lambda a: a != ""), lambda a: F.struct((F.instr(F.lower(context), F.lower(a)) - 1).alias("start"), F.length(a).alias("n"), a.alias("answer")))
    best = F.array_min(F.filter(found, lambda x: x["start"] >= 0))
    return F.when(best.isNotNull(), F.struct(best["start"].alias("start"), F.substring(context, best["start"] + 1, best["n"]).alias("answer")))


def trimmed_block(text: Column) -> Column:
    """Lines without blanks at their ends, the block without blank lines around it."""
    return F.regexp_replace(F.regexp_replace(text, r"(?m)[ \t\x0b\f\r]+$", ""), r"^\s+|\s+$", "")
