"""Text functions: folding, fuzzy ratio, hosts, rule lists, names. Native expressions where Spark has them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from zlib import crc32

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType


@F.pandas_udf(StringType())
def decomposed(text: pd.Series) -> pd.Series:
    """Compatibility decomposition, then case folding: what styled, accented and plain letters have in common."""
    return text.str.normalize("NFKD").str.casefold()


def unicode_fold(text: Column) -> Column:
    """The key under which spellings of a name meet: folded letters and digits without marks, & as the word and, all
    else as single spaces. NULL for NULL."""
    bare = F.regexp_replace(F.replace(decomposed(text), F.lit("&"), F.lit(" and ")), r"\p{Mn}", "")
    return F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "))


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence: a row of its table is the bits of one number, a step is one addition."""
    end, most = 0, min(len(a), len(b))
    while end < most and a[end] == b[end]:
        end += 1
    tail = 0
    while tail < most - end and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    # equal ends belong to a longest one
    a, b = a[end : len(a) - tail], b[end : len(b) - tail]
    at: dict[str, int] = {}
    for i, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << i
    whole = (1 << len(b)) - 1
    row = whole
    for x in a:
        hit = row & at.get(x, 0)
        row = (row + hit | row - hit) & whole
    return end + tail + len(b) - row.bit_count()


def _indel(a: str, b: str) -> float:
    """Similarity 2 LCS / (len a + len b) in per cent."""
    return 200.0 * _common(a, b) / (len(a) + len(b)) if a and b else 0.0


def words_of(text: str) -> set[str]:
    return set(re.sub(r"[\W_]+", " ", text.lower()).split())


def token_set_score(a: str | None, b: str | None) -> float | None:
    """Best similarity of the common words, and of them with either text's own words; 100 if one text has no own."""
    if a is None or b is None:
        return None
    return _word_score(words_of(a), words_of(b))


def _word_score(x: set[str], y: set[str]) -> float:
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if not both:
        return _indel(left, right)
    if not left or not right:
        return 100.0
    # the common words, a space, own words: what both begin with is common, and the common words alone are in either whole
    n, one, two = len(both), len(both) + 1 + len(left), len(both) + 1 + len(right)
    return max(200.0 * (n + 1 + _common(left, right)) / (one + two), 200.0 * n / (n + one), 200.0 * n / (n + two))


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    # a text comes in many pairs
    words = {t: words_of(t) for s in (a, b) for t in s.unique() if t is not None}
    return pd.Series([None if x is None or y is None else _word_score(words[x], words[y]) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(ArrayType(StringType()))
def name_words(text: pd.Series) -> pd.Series:
    """The distinct words that token_set_ratio compares, sorted."""
    return text.map(lambda t: sorted(words_of(t or "")))


@F.pandas_udf(ArrayType(StringType()))
def name_grams(text: pd.Series) -> pd.Series:
    """Pairs of neighbouring characters of the sorted words, with a space before, between and after; numbered from 1 if
    they recur, so that the bag is a set. It does not depend on the order of the words."""

    def grams(t: str | None) -> list[str]:
        plain, seen = f" {' '.join(sorted(words_of(t or '')))} ", Counter()
        for pair in zip(plain, plain[1:], strict=False):
            seen["".join(pair)] += 1
        return [f"{g}{i}" for g, n in seen.items() for i in range(1, n + 1)]

    return text.map(grams)


#: Numbers of keys are whole and not negative as a long.
BITS = (1 << 62) - 1


def _number(word: str) -> int:
    """A number that stands for a word, 0 for none; the sum of some stands for their bag. Squares, as checksums of words that
    differ alike differ alike."""
    code = crc32(word.encode("utf-8", "surrogatepass"))
    return code * (code + 0x9E3779B97F4A7C15)


def cuts_of(words: set[str]) -> set[int]:
    """A number for the bag of words, and one for each that is less any one character: of a word, or of a space between any two
    words. Two texts, whatever words they have in common, that a character less on each side makes equal share one."""
    numbers = {w: _number(w) for w in words}
    total = sum(numbers.values())
    out = {total & BITS}
    for w, own in numbers.items():
        rest = total - own
        out |= {rest + _number(w[:j] + w[j + 1 :]) & BITS for j in range(len(w))}
        out |= {rest - other + _number(w + x) & BITS for x, other in numbers.items() if x != w}
    return out


def typical_of(words: set[str], held: dict[str, int], least: float) -> list[str]:
    """A text's words, those that few hold first, as far as one of them must be common to two texts whose common words make up
    enough of this one to score `least`. held: counts of the words that many hold."""
    t, n, before, out = least / 100, sum(map(len, words)) + len(words) - 1, 0, []
    for w in sorted(words, key=lambda w: (held.get(w, 0), w)):
        # the common words have 2 c >= t (c + n): the others, each with a space, are at most n - c long
        if before > n * (2 * (1 - t) / (2 - t)) + 1e-6:
            break
        out.append(w)
        before += len(w) + 1
    return out


def name_typical(text: Column, held: dict[str, int], least: float) -> Column:
    """typical_of a text's words."""
    return F.pandas_udf(lambda x: x.map(lambda t: typical_of(words_of(t or ""), held, least)), ArrayType(StringType()))(text)


def name_keys(text: Column, own: str, other: str, held: dict[str, int], least: float, *, asked: set[str] | None = None, cuts: bool = True) -> Column:
    """Numbers by which two texts meet: of typical words, marked `own`, with any words, marked `other`; and of cuts. Of the words
    that many hold, any words are those of `asked` only. Different keys may by chance have one number."""

    def keys(t: str | None) -> list[int]:
        words = words_of(t or "")
        out = {_number(f"{own} {w}") & BITS for w in typical_of(words, held, least)}
        out |= {_number(f"{other} {w}") & BITS for w in words if asked is None or w not in held or w in asked}
        return list(out | cuts_of(words) if cuts else out)

    return F.pandas_udf(lambda x: x.map(keys), ArrayType(LongType()))(text)


def host(url: Column) -> Column:
    """Lower-cased host of a URL, of whatever characters; NULL where there is none or its brackets do not pair.

    What stands between // and the next /, ? or #, without user and port. (try_parse_url wants a strict URI.)
    """
    plain = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    place = F.regexp_extract(plain, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)

    def named(place: Column) -> Column:
        own = F.regexp_replace(place, "^.*@", "")
        name = F.when(own.startswith("["), F.regexp_extract(own, r"^\[([^\]]*)", 1)).otherwise(F.regexp_extract(own, "^([^:]*)", 1))
        return F.when(place.contains("[") != place.contains("]"), None).otherwise(F.nullif(F.lower(name), F.lit("")))

    # as an element the place is found once, however often it is named
    return F.get(F.transform(F.array(place), named), F.lit(0))


def host_in(url: Column, suffixes: Sequence[str]) -> Column:
    """Whether the host is one of the suffixes or below one."""
    h = host(url)
    found = [(h == s) | h.endswith(f".{s}") for s in suffixes]
    out = found[0]
    for f in found[1:]:
        out = out | f
    return F.coalesce(out, F.lit(False))


def fired(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in their order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())))


NAMES = re.compile(r'"([^"\n]{2,80})"|“([^”\n]{2,80})”')


@F.pandas_udf(ArrayType(StringType()))
def quoted_names(text: pd.Series) -> pd.Series:
    """Names between quotation marks in order of their place, each once, stripped of signs at the ends."""

    def names(t: str | None) -> list[str]:
        found = [(m[1] or m[2]).strip(" .,;:!?-") for m in NAMES.finditer(t or "")]
        return list(dict.fromkeys(n for n in found if len(n) >= 2))

    return text.map(names)


# How names are written in posts, between marks or beside wording about music; and the signs stripped from
# a name's ends.
DOUBLE = '["“]([^"”]{2,100})["”]'
SINGLE = r"(?<!\w)['\u2018]([^'\u2019\n]{2,100})['\u2019](?!\w)"
CAPITAL = r"(?:[A-Z0-9](?:[\w\u2019'&.-]*[\w\u2019'&])?|of|the|and|&)"
PHRASE = rf"{CAPITAL}(?:\s+{CAPITAL}){{0,5}}"
LISTENING, NEW, DROPPED = rf"(?i:\blistening\s+to\s+)({PHRASE})", rf"(?i:\bnew\s+)({PHRASE})(?i:\s+album\b)", rf"({PHRASE})(?i:\s+just\s+dropped\b)"
STRIPPED = " \t\r\n.,:;!?()[]{}"
SPANS = {"double": re.compile(DOUBLE), "single": re.compile(SINGLE), "listening": re.compile(LISTENING), "new": re.compile(NEW), "dropped": re.compile(DROPPED)}


def spans_of(text: str | None) -> list[tuple[int, str, str]]:
    """(start, kind, name) of all spans in the order of their start, then name: where the pattern begins, and what it names,
    stripped at both ends; names of fewer than two characters are none."""
    found = sorted((m.start(), m[1], kind) for kind, p in SPANS.items() for m in p.finditer(text or ""))
    return [(at, kind, name.strip(STRIPPED)) for at, name, kind in found if len(name.strip(STRIPPED)) >= 2]


@F.pandas_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("kind", StringType()), StructField("name", StringType())])))
def name_spans(text: pd.Series) -> pd.Series:
    """spans_of a text."""
    return text.map(lambda t: [{"start": a, "kind": k, "name": n} for a, k, n in spans_of(t)])


@F.pandas_udf(ArrayType(StringType()))
def candidate_names(text: pd.Series) -> pd.Series:
    """The names of a text's spans, each once, as they first come."""
    return text.map(lambda t: list(dict.fromkeys(n for _, _, n in spans_of(t))))


def pick(options: Sequence[str], key: Column, byte: int = 1) -> Column:
    """One of the options by a byte of the key's sha256."""
    number = F.conv(F.substring(F.sha2(key.cast("string"), 256), 2 * byte - 1, 2), 16, 10).cast("int")
    return F.element_at(F.array(*map(F.lit, options)), number % len(options) + 1)
