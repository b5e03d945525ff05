"""Text normalisation, hashes, locators, identifiers and term sets."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranges that count as one token a character.
WIDE = r"\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}"
CJK = r"\x{4E00}-\x{9FFF}"
#: Fixed value: ideographs that have no blanks between them.
CLOSE = r"\x{3400}-\x{9FFF}"
#: Characters that normalisation removes or turns to a blank.
INVISIBLE = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}\x{FEFF}]"
BLANKS = r" \t\r\f\x{0B}\x{A0}\x{3000}"
#: All other white space than line feeds, which is stripped from lines and between ideographs.
SPACES = " \t\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: What a text holds that normalisation does more to than strip its lines; in UTF-8 how rare blanks,
#: invisible characters and ideographs start, some others too.
RARE = ["  ", "-\n", "\t", "\r", "\f", "\x0b", "\x1c", "\x1d", "\x1e", "\x1f"]
RARE_BYTES = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81", b"\xef\xbb\xbf", *(bytes([first]) for first in range(0xE3, 0xEA))]
#: White space that is left once blanks have collapsed.
ODD_SPACES = r"[\x1C-\x1F\x{85}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}]"
#: What stands for a page without content, and what failed parsers leave.
PLACEHOLDERS = [
    r"^[.\-_=*~#·—–\s]+$",
    r"(?i)^[\[(（【]\s*(空|无|略|图片|image|figure|table|图表|公式|equation|待补充|todo|tbd)\s*[\])）】]$",
    r"(?i)^(无内容|没有内容|此页无文字|no content|empty|n/?a)$",
]
PARSE_MARKERS = [
    r"^\[[^\]\n]{0,40}解析失败[^\]\n]{0,120}\]$",
    r"(?i)^\[[^\]\n]{0,40}parse (failed|error)[^\]\n]{0,120}\]$",
    r"(?i)^error:\s*.{0,120}$",
]
UNPARSED_FILE = r"^\[(docx|pdf|pptx?)\s*解析失败[:：]"


def normalize_text(text: Column) -> Column:
    """Line ends to LF; invisible characters go; a word of Latin letters split by a hyphen and line end is joined; blanks
    collapse; lines are stripped; gaps between ideographs go; three and more line ends become two; the whole is stripped.
    White space is Unicode's and the four separators of ASCII."""
    swap = lambda c, a, b: F.replace(c, F.lit(a), F.lit(b))
    stripped = lambda c: swap(swap(c, " \n", "\n"), "\n ", "\n")

    out = swap(swap(text, "\r\n", "\n"), "\r", "\n")
    out = F.regexp_replace(out, INVISIBLE, "")
    # patterns start with what is rare, so that most places are passed by at their first character
    out = F.regexp_replace(out, r"([A-Za-z])-\n([A-Za-z])", "$1$2")
    out = stripped(F.regexp_replace(out, rf" [{BLANKS}]+|[{BLANKS[1:]}][{BLANKS}]*", " "))  # single blanks stay as they are
    # what is left at line ends is rare; a run of it is looked at from its start only
    out = F.when(text.rlike(ODD_SPACES), F.regexp_replace(F.regexp_replace(out, f"(?<![{SPACES}])[{SPACES}]++(?=\n)", ""), f"(?<=\n)[{SPACES}]++", "")).otherwise(out)
    out = F.regexp_replace(out, rf"([{CLOSE}])[\n{SPACES}]++(?=[{CLOSE}])", "$1")
    # most texts have nothing of this, and searches for a few bytes are much faster than patterns
    holds = lambda c, parts: reduce(or_, [F.contains(c, F.lit(part)) for part in parts])
    rare = holds(text, RARE) | holds(text.cast("binary"), map(bytearray, RARE_BYTES))
    out = F.when(rare, out).otherwise(stripped(text))
    return F.btrim(F.regexp_replace(out, r"\n{3,}", "\n\n"), F.lit("\n" + SPACES))


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def estimate_tokens(text: Column) -> Column:
    """Wide characters, and a quarter of the others, rounded up."""
    other = F.length(F.regexp_replace(text, f"[{WIDE}]", ""))
    return (F.length(text) - other + F.ceil(other / 4)).cast("long")


def infer_kind(kind: Column, name: Column) -> Column:
    """The declared kind, else one by the name's suffix, else unknown."""
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    #: Suffixes of each kind.
    by_suffix = {"pdf": ["pdf"], "ppt": ["ppt", "pptx"], "docx": ["doc", "docx"], "text": ["txt", "md", "markdown"], "transcript": ["srt", "vtt"], "audio": ["mp3", "wav", "m4a"], "image": ["png", "jpg", "jpeg"], "html": ["html", "htm"]}
    out = F.lit("unknown")
    for value, suffixes in by_suffix.items():
        out = F.when(suffix.isin(suffixes), value).otherwise(out)
    return F.coalesce(F.when(F.trim(kind) != "", F.lower(F.trim(kind))), out)


def matches_any(text: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for pattern in patterns:
        out = out | text.rlike(pattern)
    return out


def noise_verdict(text: Column) -> Column:
    """Why a normalised text of at most 200 characters says nothing; null if it does. Longer texts are never noise."""
    short = F.length(text) <= 200
    return (
        F.when(text.rlike(r"^\s*$"), "empty")
        .when(short & matches_any(text, PLACEHOLDERS), "placeholder")
        .when(short & matches_any(text, PARSE_MARKERS), "parse_marker")
    )


def is_parse_marker(text: Column) -> Column:
    """Whether all that a parser left, 300 characters at most, is that it failed."""
    plain = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.coalesce((F.length(plain) <= 300) & matches_any(plain, [*PARSE_MARKERS, UNPARSED_FILE]), F.lit(False))


def page_number(locator: Column) -> Column:
    digits = F.regexp_extract(locator, r"(?i)^(?:page|slide|p|s)[:# ]*([0-9]{1,9})", 1)
    return F.when(digits != "", digits.cast("int"))


def canonical_locator(locator: Column) -> Column:
    """page:N, slide:N, body, seg:N, cue:N or a time range; unknown for all else."""
    low = F.lower(F.trim(locator))
    number = F.regexp_replace(F.regexp_extract(low, r"([0-9]+)", 1), "^0+(?=[0-9])", "")
    return (
        F.when(low.rlike(r"^(page|p)[:# ]*[0-9]+$"), F.concat(F.lit("page:"), number))
        .when(low.rlike(r"^(slide|s)[:# ]*[0-9]+$"), F.concat(F.lit("slide:"), number))
        .when(low == "body", "body")
        .when(low.rlike(r"^(seg|segment)[:# ]*[0-9]+$"), F.concat(F.lit("seg:"), number))
        .when(low.rlike(r"^cue[:# ]*[0-9]+$"), F.concat(F.lit("cue:"), number))
        .when(low.rlike(r"^[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,3})?-[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,3})?(#[0-9]+)?$"), F.concat(F.lit("time:"), low))
        .otherwise("unknown")
    )


def clock_ms(text: Column) -> Column:
    """HH:MM:SS[.mmm] to milliseconds; null for minutes or seconds over 59 and for all else."""
    part = lambda i: F.regexp_extract(text, r"^([0-9]{1,3}):([0-9]{2}):([0-9]{2})(?:[.,]([0-9]{1,3}))?$", i)
    hours, minutes, seconds = (F.when(part(i) != "", part(i).cast("long")) for i in (1, 2, 3))
    millis = F.coalesce(F.when(part(4) != "", F.rpad(part(4), 3, "0").cast("long")), F.lit(0))
    return F.when((minutes < 60) & (seconds < 60), ((hours * 60 + minutes) * 60 + seconds) * 1000 + millis)


def ms_clock(ms: Column) -> Column:
    """Milliseconds to HH:MM:SS, with .mmm where there are some."""
    two = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    whole = F.concat_ws(":", two(F.floor(ms / 3600000)), two(F.floor(ms / 60000) % 60), two(F.floor(ms / 1000) % 60))
    rest = (ms % 1000).cast("long")
    return F.when(rest == 0, whole).otherwise(F.concat(whole, F.lit("."), F.lpad(rest.cast("string"), 3, "0")))


def char_tokens(text: Column) -> Column:
    """All runs of ASCII letters and digits in lower case, then each ideograph."""
    latin = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)
    return F.concat(latin, F.regexp_extract_all(text, F.lit(f"[{CJK}]"), F.lit(0)))


def term_set(text: Column) -> Column:
    """Distinct Latin words of two and more letters or digits, ideograph runs of two and more, and their bigrams."""
    latin = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]{2,}"), F.lit(0)), F.lower)
    wide = F.regexp_extract_all(text, F.lit(f"[{CJK}]{{2,}}"), F.lit(0))
    pairs = F.flatten(F.transform(wide, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(latin, wide, pairs))


def phrase_bonus(tokens: Column, text: Column) -> Column:
    """0.1 for each query token of two and more characters that the text contains, at most 0.5."""
    hits = F.size(F.filter(tokens, lambda t: (F.length(t) >= 2) & F.contains(text, t)))
    return F.least(F.lit(0.5), hits * F.lit(0.1))


def normalize_answer(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[\s\p{P}]+", ""))


def answer_is_right(given: Column, expected: Column) -> Column:
    """Equal once white space and punctuation are gone, or an expected answer of four and more characters is contained."""
    g, e = normalize_answer(given), normalize_answer(expected)
    return F.coalesce((e != "") & ((g == e) | ((F.length(e) >= 4) & F.contains(g, e))), F.lit(False))


def fuzzy_contains(haystack: Column, needle: Column) -> Column:
    """Contained after white space is dropped and letters are lowered, as it is or under one common misreading."""
    plain = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    h, n = plain(haystack), plain(needle)
    #: Pairs that optical recognition confuses.
    confused = [("0", "o"), ("1", "l"), ("5", "s"), ("8", "b"), ("2", "z"), ("6", "g"), ("9", "q")]
    found = F.contains(h, n)
    for a, b in confused:
        found = found | F.contains(F.replace(h, F.lit(a), F.lit(b)), F.replace(n, F.lit(a), F.lit(b)))
    return found


def safe_file_name(name: Column) -> Column:
    """Reserved characters to underscores; dots and blanks off the ends; never empty."""
    out = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1F]', "_"), r"^[ .]+|[ .]+$", "")
    return F.when(out == "", "untitled").otherwise(out)


def yaml_quoted(text: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(text.rlike(r"""[:#\[\]{}",'&*!|>%@`]|^\s|\s$|^$"""), quoted).otherwise(text)


def padded(number: Column, width: int) -> Column:
    """Leading zeros up to a width; longer numbers stay whole."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def sequence_id(prefix: Column, number: Column) -> Column:
    """T000001 and so on."""
    return F.concat(prefix, padded(number, 6))


def paged_id(prefix: Column, page: Column, number: Column) -> Column:
    """P0017.01 and so on."""
    return F.concat(prefix, padded(page, 4), F.lit("."), padded(number, 2))


def is_source_id(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[TPDIS][0-9]{4,6}(\.[0-9]{1,2})?$"), F.lit(False))


def without_thinking(text: Column) -> Column:
    """Thinking blocks go, closed or left open at the end, and then stray tags of them."""
    closed = F.regexp_replace(text, r"(?is)<(think(?:ing)?)>.*?</\1>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(closed, r"(?is)<think>.*$", ""), r"(?i)<\s*/?\s*think(ing)?\s*>", ""))
