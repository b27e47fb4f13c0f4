"""Which posts are about music, by rules over links, tags and wording; and which of them a public feed may show.

Rules are tables: other hosts, tags or wordings are given as arguments. Everything is Column expressions, so that streams
and tables are classified alike.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.texts import host

# What counts as a music host, tag or wording, what such wordings mean elsewhere, and what a feed trusts.
HOSTS = ("bandcamp.com", "soundcloud.com", "open.spotify.com", "music.apple.com", "youtube.com", "youtu.be", "last.fm")
TAGS = ("nowplaying", "np", "newmusic", "newrelease")
WORDINGS = {
    "intent:listening_to": r"\blistening\s+to\b",
    "intent:on_repeat": r"\bon\s+repeat\b",
    "intent:new_album": r"\bnew\s+album\b",
    "intent:new_ep": r"\bnew\s+ep\b",
    "intent:new_single": r"\bnew\s+single\b",
    "intent:just_dropped": r"\bjust\s+dropped\b",
}
VETOES = {
    "hashtag:#np": r"\b(?:no\s+problem|happy\s+to\s+help|you(?:'re|\s+are)\s+welcome|anytime)\b",
    "intent:new_single": r"\b(?:dating|relationship|tinder|bumble|hinge|boyfriend|girlfriend|divorc(?:e|ed)|breakup|romantic|eligible bachelor)\b|\b(?:i(?:'m|\s+am)|he(?:'s|\s+is)|she(?:'s|\s+is)|they(?:'re|\s+are)|newly|currently)\s+(?:a\s+)?new\s+single\b",
    "intent:just_dropped": r"\bjust\s+dropped\s+(?:the\s+)?(?:ball|pass|catch|punt|game|match)\b",
}
TRUSTED = (
    "link:bandcamp.com", "link:soundcloud.com", "link:open.spotify.com", "link:music.apple.com", "link:last.fm",
    "hashtag:#nowplaying", "hashtag:#newmusic", "hashtag:#newrelease",
    "intent:on_repeat", "intent:new_album", "intent:new_ep", "intent:new_single", "intent:just_dropped",
)
# Wording that a post needs beside a weaker rule, in lower case or as written.
VIDEO_WORDS = "(^|[^a-z])(song|music|album|ep|track|band|artist|listen|listening|lyric|lyrics|chorus|record|playlist|earworm|sing|concert)([^a-z]|$)"
TAGGED_MUSIC = "#music([^a-z]|$)"
PAIR = r"^[^\n]{2,80} - [^\n]{2,80}"
LISTENED = "[Ll]istening\\s+to\\s+(the\\s+)?[A-Z0-9][A-Za-z0-9&.'’_-]*"


def _words(text: Column, pattern: str) -> Column:
    """Whether the text has the pattern in letters of either case, with Unicode's white space, letters and word ends; a
    missing text has none."""
    return F.coalesce(text.rlike(f"(?iuU){pattern}"), F.lit(False))


def tags(text: Column, given: Column) -> Column:
    """A post's tags, given ones first, without their sign; each once, as first written."""
    bare = F.filter(F.transform(F.coalesce(given, F.array().cast("array<string>")), lambda t: F.regexp_replace(t, "^#", "")), lambda t: t != "")
    written = F.coalesce(F.regexp_extract_all(text, F.lit(r"(?U)(?<![\w])#([A-Za-z0-9_]+)\b"), F.lit(1)), F.array().cast("array<string>"))
    return F.array_distinct(F.concat(bare, written))


def rules(text: Column, links: Column, hashtags: Column, *, hosts: Sequence[str] = HOSTS, music_tags: Sequence[str] = TAGS, wordings: Mapping[str, str] = WORDINGS, vetoes: Mapping[str, str] = VETOES) -> Column:
    """The rules that hold, each once: links to a music host or below one, in the links' order; music tags, in theirs; then
    wordings. A rule whose veto is found in the text does not hold; a link that is no URL is passed over."""
    none = F.array().cast("array<string>")
    allowed = F.array(*map(F.lit, hosts))

    # names are elements before they are compared: written inside the filter they would be parsed again for every host
    names = F.transform(F.coalesce(links, none), lambda url: F.regexp_replace(host(url), r"\.+$", ""))
    found = F.transform(names, lambda name: F.get(F.filter(allowed, lambda a: (name == a) | name.endswith(F.concat(F.lit("."), a))), F.lit(0)))
    by_link = F.transform(F.filter(found, lambda h: h.isNotNull()), lambda h: F.concat(F.lit("link:"), h))
    lower = F.filter(F.transform(F.coalesce(hashtags, none), F.lower), lambda t: t.isin(*music_tags))
    by_tag = F.transform(lower, lambda t: F.concat(F.lit("hashtag:#"), t))
    by_wording = F.array_compact(F.array(*(F.when(_words(text, p), F.lit(n)) for n, p in wordings.items())))
    # a veto is looked for only where its rule holds
    vetoed = lambda rule: reduce(lambda c, x: c.when(rule == x[0], _words(text, x[1])), vetoes.items(), F.when(F.lit(False), False)).otherwise(False)
    return F.filter(F.array_distinct(F.concat(by_link, by_tag, by_wording)), lambda rule: ~vetoed(rule))


def in_feed(text: Column, found: Column) -> Column:
    """Whether a feed shows a post: for a trusted rule, or for a weaker one beside wording that confirms it."""
    some = lambda *names: F.arrays_overlap(found, F.array(*map(F.lit, names)))
    has = lambda own, pattern: F.coalesce(own.rlike(pattern), F.lit(False))
    video = some("link:youtube.com", "link:youtu.be") & has(F.lower(text), VIDEO_WORDS)
    played = some("hashtag:#np") & (has(F.lower(text), TAGGED_MUSIC) | has(text, PAIR))
    heard = some("intent:listening_to") & has(text, LISTENED)
    return F.coalesce(some(*TRUSTED) | video | played | heard, F.lit(False))
