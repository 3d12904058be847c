"""Text functions of rows, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowloom.functions import lexicon as lx


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for all of ``body``: a lambda in it would otherwise evaluate it for every element."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def normalized(c: Column) -> Column:
    """Null becomes empty; runs of any white space become a space; none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"[{lx.SPACES}]+", " "))


def _clean(c: Column, clean: bool) -> Column:
    """Predicates take ``clean`` columns, which are normalized already, as they are: a query that asks several things
    about a text normalizes it in a projection of its own first."""
    return c if clean else normalized(c)


def target_spacing(c: Column) -> Column:
    """Normalized, and closed up before and after the punctuation of the target script. It also eats the space after a
    closing ASCII quote, since that looks like an opening one."""
    c = F.regexp_replace(normalized(c), lx.NO_SPACE_BEFORE, "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(c, lx.NO_SPACE_AFTER, "$1"), " {2,}", " "))


def polished(c: Column) -> Column:
    """Target spacing, once more around brackets and guillemets."""
    c = target_spacing(c)
    for pattern, to in lx.POLISH:
        c = F.regexp_replace(c, pattern, to)
    return c


def joined(parts: Column) -> Column:
    """The non-empty parts of an array in one line."""
    return target_spacing(F.array_join(F.filter(parts, lambda x: x != ""), " "))


def word_count(c: Column, clean: bool = False) -> Column:
    n = _clean(c, clean)
    return F.when(n == "", 0).otherwise(F.size(F.split(n, " ")))


def char_count(c: Column, clean: bool = False) -> Column:
    return F.length(_clean(c, clean))


def reading_length(c: Column) -> Column:
    """Characters that aren't white space."""
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), f"[{lx.SPACES}]+", ""))


def is_blank(c: Column, clean: bool = False) -> Column:
    return _clean(c, clean) == ""


def has_target_script(c: Column, script: str = lx.TARGET_SCRIPT) -> Column:
    return F.coalesce(c, F.lit("")).rlike(script)


def has_latin(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(lx.LATIN)


def ends_sentence(c: Column, clean: bool = False) -> Column:
    return _clean(c, clean).rlike(lx.SENTENCE_END)


def is_terminal(c: Column, spaced: bool = False) -> Column:
    """``ends_sentence`` of target text."""
    return (c if spaced else target_spacing(c)).rlike(lx.SENTENCE_END)


def is_header(c: Column, clean: bool = False) -> Column:
    n = _clean(c, clean)
    return n.rlike(lx.HEADER) | ((F.length(n) > 40) & (n == F.upper(n)))


def is_cue(c: Column, clean: bool = False) -> Column:
    return _clean(c, clean).endswith(":")


def is_bracketed(c: Column, clean: bool = False) -> Column:
    return _clean(c, clean).rlike(lx.BRACKETED)


def is_url(c: Column, clean: bool = False) -> Column:
    return _clean(c, clean).rlike(lx.URL)


def _capitals(n: Column, least: int) -> Column:
    letters = F.regexp_replace(n, "[^A-Za-z]", "")
    return (F.length(letters) >= least) & (letters == F.upper(letters))


def is_meta(c: Column, clean: bool = False) -> Column:
    n = _clean(c, clean)
    return is_bracketed(n, True) | is_url(n, True) | n.rlike(lx.CREDIT) | (_capitals(n, 4) & (word_count(n, True) <= 4))


def is_date(c: Column, clean: bool = False) -> Column:
    n = _clean(c, clean)
    return n.rlike(f"(?i)({lx.MONTHS})(?![A-Za-z0-9_])") | n.rlike("(?<![A-Za-z0-9_])[0-9]{4}(?![A-Za-z0-9_])")


def is_title(c: Column, clean: bool = False) -> Column:
    n = _clean(c, clean)
    return n.rlike(lx.TITLE) | _capitals(n, 8)


def row_type(c: Column, clean: bool = False) -> Column:
    """source, date, title or normal: the first that fits."""
    n = _clean(c, clean)
    return F.when(is_meta(n, True), "source").when(is_date(n, True), "date").when(is_title(n, True), "title").otherwise("normal")


def ends_with_comma(c: Column, spaced: bool = False) -> Column:
    return (c if spaced else target_spacing(c)).rlike(lx.COMMA_END)


def source_ends_with_comma(c: Column) -> Column:
    return normalized(c).rlike(lx.SOURCE_COMMA_END)


def strong_comma_clause(target: Column, source: Column) -> Column:
    """A clause that ends with a comma on either side and can stand on its own line."""
    t = target_spacing(target)
    return (t != "") & (ends_with_comma(target) | source_ends_with_comma(source)) & (word_count(t) >= 3) & (char_count(t) >= 16)


def comparable(token: Column) -> Column:
    """A token without punctuation and case."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(token, F.lit("")), lx.IGNORED_IN_TOKENS, "")))


def is_adjective(token: Column) -> Column:
    t = comparable(token)
    return (t != "") & (t.isin(lx.ADJECTIVES) | t.rlike(lx.ADJECTIVE_ENDS))


def is_content(token: Column) -> Column:
    t = comparable(token)
    return (t != "") & ~t.isin(lx.CONNECTORS + lx.AUXILIARIES + lx.VERB_PREFIXES) & t.rlike("[؀-ۿA-Za-z]")


def row_range(first: Column, last: Column) -> Column:
    """``7`` or ``7-9``."""
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first, last))


def version_parts(c: Column) -> Column:
    """The numbers of a version, without a leading v and what follows + or -."""
    core = F.regexp_replace(F.regexp_replace(normalized(c), "(?i)^v", ""), r"(?s)[+-].*$", "")
    return F.transform(
        F.split(core, r"\."), lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"^\s*([0-9]+)", 1), F.lit("")).cast("bigint"), F.lit(0).cast("bigint"))
    )


def compare_versions(left: Column, right: Column) -> Column:
    """1, 0 or -1; missing parts are 0."""
    differ = F.filter(
        F.zip_with(version_parts(left), version_parts(right), lambda a, b: F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0))),
        lambda d: d != 0,
    )
    return F.coalesce(F.signum(F.get(differ, F.lit(0))), F.lit(0)).cast("int")


def category(path: Column) -> Column:
    """The profile that a file's name routes to; either kind of slash parts a path."""
    name = F.upper(F.element_at(F.split(F.coalesce(path, F.lit("")), r"[\\/]"), -1))
    return F.when(name.rlike("^(NWN|NEWS SCROLL)(?![A-Za-z0-9_])"), "nwn").otherwise("bmd")


def quota(message: Column) -> Column:
    """What a provider's message says about quotas: struct<is_quota, quota_type, retry_ms>."""
    m = F.coalesce(message, F.lit(""))
    seconds = F.nullif(F.regexp_extract(m, r"(?i)retry in ([0-9.]+)s", 1), F.lit(""))
    return F.struct(
        m.rlike("RESOURCE_EXHAUSTED|429").alias("is_quota"),
        F.when(m.rlike("(?i)PerMinute"), "minute").when(m.rlike("(?i)PerDay"), "day").alias("quota_type"),
        F.ceil(seconds.cast("double") * 1000).cast("int").alias("retry_ms"),
    )


def phrase_hints(target: Column) -> Column:
    """The known phrases in a text, distinct, in the order of the list."""
    return F.filter(F.array(*[F.lit(p) for p in lx.HINT_PHRASES]), lambda p: F.contains(target, p))


def response_text(top: Column, parts: Column) -> Column:
    """The text of a provider's answer: its own, if it isn't blank, else the lines of its parts' texts that aren't.
    ``parts`` is array<array<string>>: the texts of each output's contents."""
    said = F.filter(F.flatten(F.filter(F.coalesce(parts, F.array().cast("array<array<string>>")), lambda p: p.isNotNull())), lambda x: ~is_blank(x))
    return F.when(~is_blank(top), top).otherwise(F.trim(F.array_join(said, "\n")))


def retry_action(message: Column) -> Column:
    """What a client does about a failed request: struct<action, wait_ms>. ``wait`` and ask again after the time that a
    per-minute quota names and half a second more, ``disable`` all further requests of the run after a per-day quota,
    or ``fail`` this one."""
    q = quota(message)
    waits = q["is_quota"] & (q["quota_type"] == "minute") & (F.coalesce(q["retry_ms"], F.lit(0)) > 0)
    action = F.when(waits, "wait").when(q["is_quota"] & (q["quota_type"] == "day"), "disable").otherwise("fail")
    return F.struct(action.alias("action"), F.when(waits, q["retry_ms"] + 500).alias("wait_ms"))


def safe_json(c: Column, schema: str) -> Column:
    """A JSON text as a struct, null where it isn't JSON of an object."""
    return F.when(F.coalesce(c, F.lit("")).rlike(r"^\s*\{"), F.from_json(c, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))


def head(items: Column, most: int) -> Column:
    """The first ``most`` items of an array."""
    return F.slice(items, 1, most)
