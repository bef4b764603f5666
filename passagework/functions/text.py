"""String expressions with the semantics of Unicode-aware text handling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space with the four separators that Java leaves out.
WHITE = r"[\x1c-\x1f\p{IsWhite_Space}]"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WHITE}+|{WHITE}+\z", "")


def words(c: Column) -> Column:
    """Words between runs of white space; none of an empty text."""
    s = stripped(F.coalesce(c, F.lit("")))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, WHITE + "+"))


def extension(filename: Column) -> Column:
    """Last suffix in lower case; a bare dot-file and a trailing dot have none."""
    name = F.regexp_extract(filename, r"([^/]*)\z", 1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)\z", 1))


def before_first(c: Column, mark: str) -> Column:
    return F.lower(stripped(F.split_part(c, F.lit(mark), F.lit(1))))


def contains_folded(text: Column, needle: Column) -> Column:
    return F.contains(F.lower(text), F.lower(needle))


def all_or_any(text: Column, needles: Column, match: Column) -> Column:
    """Whether all (match = 'all') or any of the needles occur, case folded."""
    return F.when(match == "all", F.forall(needles, lambda n: contains_folded(text, n))).otherwise(F.exists(needles, lambda n: contains_folded(text, n)))


def marked(text: Column, needle: Column, before: str = "<mark>", after: str = "</mark>") -> Column:
    """Every occurrence of a literal needle between marks, case kept."""
    quoted = F.concat(F.lit(r"(?i)(\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    return F.when(needle == "", text).otherwise(F.regexp_replace(text, quoted, F.lit(f"{before}$1{after}")))


def size_label(n: Column) -> Column:
    kb = 1024.0
    return F.when(n.isNull(), F.lit(None).cast("string")).when(n < kb, F.concat(n.cast("string"), F.lit(" B"))).when(n < kb * kb, F.format_string("%.1f KB", n / kb)).otherwise(F.format_string("%.1f MB", n / kb / kb))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit("n/a")).otherwise(F.format_string("%.1f%%", 100.0 * part / whole))


def retry_after(header: Column, cap: float = 30.0) -> Column:
    """Seconds of a numeric header above zero, capped; null otherwise."""
    x = stripped(header).try_cast("double")
    return F.when((x > 0) & ~F.isnan(x), F.least(x, F.lit(cap)))


def backoff(attempt: Column, base: float = 3.0, cap: float = 30.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(cap))


def failure_reason(stage: Column, message: Column) -> Column:
    """Stage label and at most 300 characters of the message."""
    from ..schemas import STAGE_LABELS

    labels = F.create_map(*[F.lit(x) for pair in STAGE_LABELS.items() for x in pair])
    return F.concat(F.element_at(labels, stage), F.lit(": "), F.substring(message, 1, 300))


def filled(template: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value.cast("string"))
    return template


def localized(catalogues: dict[str, dict[str, str]], language: Column, key: Column, values: dict[str, Column] | None = None, default: str = "en") -> Column:
    """A message in a language, filled in; in the default language where the other has none, null where neither has.

    Only the primary part of the first of a list of language tags counts, in any case; a null language is the default.
    """
    entries = {f"{lang}/{k}": text for lang, texts in catalogues.items() for k, text in texts.items()}
    if not entries:
        return F.lit(None).cast("string")
    table = F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])
    primary = F.lower(stripped(F.split_part(F.split_part(F.coalesce(language, F.lit(default)), F.lit(","), F.lit(1)), F.lit("-"), F.lit(1))))
    found = F.coalesce(F.try_element_at(table, F.concat_ws("/", primary, key)), F.try_element_at(table, F.concat_ws("/", F.lit(default), key)))
    return filled(found, values or {})


def expired(since: Column, seconds: float, now: Column) -> Column:
    """Whether a life of ``seconds`` is over at ``now``; the last instant still counts, a null start is over."""
    return F.coalesce(F.unix_micros(now.cast("timestamp")) - F.unix_micros(since.cast("timestamp")) > int(seconds * 1_000_000), F.lit(True))
