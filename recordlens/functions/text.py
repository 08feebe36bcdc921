"""Text normalisers and tokenisers as column expressions; pandas UDFs only where Spark has no function."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Word characters and white space that agree with Unicode regular expressions elsewhere.
WORD = r"[\p{L}\p{N}_]"
SYMBOL = r"[^\p{L}\p{N}_\p{IsWhite_Space}\x1c-\x1f]"
#: Words joined by - . : / and single symbols.
JOINED_WORDS = rf"{WORD}+(?:[-.:/]{WORD}+)*|{SYMBOL}"
#: Plain words and single symbols.
PLAIN_WORDS = rf"{WORD}+|{SYMBOL}"
#: ASCII lookup tokens.
LOOKUP_TOKENS = r"[A-Za-z0-9_.:/=-]+"
#: The first two again, for Python.
JOINED, PLAIN = re.compile(r"\w+(?:[-.:/]\w+)*|[^\w\s]"), re.compile(r"\w+|[^\w\s]")
DOI = r"^10\.[0-9]{4,9}/\S+$"


def collapse(text: Column) -> Column:
    """Lower case, outer white space gone, inner runs one space: aliases and answers."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def normal_text(text: str) -> str:
    """Compatibility normal form and full case folding."""
    return text.casefold() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()


def nfkc_casefold(text: Column | str) -> Column:
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda s: None if s is None else normal_text(s))

    return F.pandas_udf(run, "string")(text)


def joined_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(JOINED_WORDS), F.lit(0))


def plain_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PLAIN_WORDS), F.lit(0))


def lookup_tokens(text: Column, longer_than: int = 0) -> Column:
    """Distinct lower-case lookup tokens; for queries only those longer than two characters."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(LOOKUP_TOKENS), F.lit(0)))
    return F.filter(tokens, lambda t: F.length(t) > longer_than) if longer_than else tokens


def portable_tokens(text: str) -> int:
    """Portable tokens of a text in compatibility normal form: a quarter of a word's bytes rounded up, one for a symbol.

    A symbol has four bytes at most, so one formula does for both.
    """
    if text.isascii():
        return sum((len(t) + 3) // 4 for t in PLAIN.findall(text))
    return sum((len(t.encode("utf-8", "surrogatepass")) + 3) // 4 for t in PLAIN.findall(unicodedata.normalize("NFKC", text)))


def token_cost(text: Column | str) -> Column:
    """``portable_tokens`` of a column; null stays null."""
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda s: None if s is None else portable_tokens(s)).astype("Int64")

    return F.pandas_udf(run, "long")(text)


def normal_doi(doi: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(doi), r"(?i)^(https?://(dx\.)?doi\.org/|doi:)", ""))


def is_doi(doi: Column) -> Column:
    return normal_doi(doi).rlike(DOI)


def expected_tag(version: Column) -> Column:
    return F.when(version.startswith("v"), version).otherwise(F.concat(F.lit("v"), version))


def is_commit(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{40}$")


def is_digest(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{64}$")


def zoned_timestamp(text: Column) -> Column:
    """The instant of an ISO 8601 text with a zone; null without one, as for any other text."""
    zoned = text.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)$")
    whole = F.regexp_replace(F.regexp_replace(text, "Z$", "+00:00"), r"^(\S{10}[T ]\d\d:\d\d)([+-])", "$1:00$2")
    return F.when(zoned, F.try_to_timestamp(whole))


def safe_path(path: Column) -> Column:
    """Relative, not empty, without a parent step or a backslash."""
    parts = F.split(path, "/")
    return (
        path.isNotNull()
        & ~path.isin("", ".")
        & ~path.startswith("/")
        & ~path.contains("\\")
        & ~path.rlike("^[A-Za-z]:")
        & ~F.exists(parts, lambda p: p == "..")
    )


def glob_regex(pattern: str) -> str:
    """A shell pattern, in which * also crosses slashes, as an anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = close
        else:
            out += c if c.isalnum() or c in "_/" else "\\" + c
        i += 1
    return f"(?s)^{out}$"


def matches_any_glob(path: Column, patterns: list[str]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | path.rlike(glob_regex(p))
    return found


def semver(version: Column) -> Column:
    """Parts of a semantic version, or null: no leading zeros, in the pre-release neither."""
    core = r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?(?:\+([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?$"
    pre = F.regexp_extract(version, core, 4)
    sound = version.rlike(core) & ~F.exists(F.split(pre, r"\."), lambda p: p.rlike(r"^0\d+$"))
    parts = F.struct(
        *(F.regexp_extract(version, core, i + 1).cast("long").alias(n) for i, n in enumerate(("major", "minor", "patch"))),
        pre.alias("pre"),
        F.regexp_extract(version, core, 5).alias("build"),
    )
    return F.when(sound, parts)


def channel_matches(version: Column, channel: Column) -> Column:
    """A stable release has no pre-release part; every other channel names the first one."""
    pre = semver(version)["pre"]
    return F.when(channel == "stable", pre == "").otherwise(F.split(pre, r"\.")[0] == channel)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)


def _path_parts(url: Column) -> Column:
    return F.transform(F.filter(F.split(url_path(url), "/"), lambda p: p != ""), lambda p: F.url_decode(p))


#: The host that release evidence must come from.
RELEASE_HOST = "github.com"


def release_identity(url: Column, snapshot_url: Column, tag: Column, commit: Column) -> Column:
    """(repository, tag, commit, reason): what a release source says of itself.

    The release page must name the tag, and the snapshot must pin the commit of the same repository;
    otherwise repository is null and reason tells what is amiss.
    """
    page, pinned = _path_parts(url), _path_parts(snapshot_url)
    at = lambda parts, i: F.get(parts, F.lit(i))
    trusted = lambda u: u.startswith("https://") & (url_host(u) == RELEASE_HOST)
    yes = lambda c: F.coalesce(c, F.lit(False))
    same = (at(page, 0) == at(pinned, 0)) & (at(page, 1) == at(pinned, 1))
    reason = (
        F.when(~yes(F.length(tag) > 0), "no tag")
        .when(~yes(is_commit(commit)), "commit is not valid")
        .when(url.isNull() | snapshot_url.isNull(), "a URL is missing")
        .when(~(trusted(url) & trusted(snapshot_url)), "not from the release host")
        .when(~yes((F.size(page) >= 5) & (at(page, 2) == "releases") & (at(page, 3) == "tag")), "not the page of a release")
        .when(F.array_join(F.slice(page, 5, F.greatest(F.size(page), F.lit(1))), "/") != tag, "the page is another tag's")
        .when(~yes((F.size(pinned) == 4) & same & (at(pinned, 2) == "tree") & (at(pinned, 3) == commit)), "the snapshot pins something else")
    )
    repo = F.concat_ws("/", F.slice(page, 1, 2))
    return F.struct(F.when(reason.isNull(), repo).alias("repository"), tag.alias("tag"), commit.alias("commit"), reason.alias("reason"))


def between_markers(text: Column, begin: str, end: str) -> Column:
    """What stands between the first ``begin`` and the next ``end``; null unless both are there."""
    start = F.instr(text, begin)
    after = F.substr(text, start + len(begin))
    stop = F.instr(after, end)
    return F.when((start > 0) & (stop > 0), F.substr(after, F.lit(1), stop - 1))


def drop_lines(text: Column, prefixes: list[str], exact: list[str]) -> Column:
    """The text without lines that have one of the prefixes or equal one of the given lines."""

    def stays(line: Column) -> Column:
        out = F.lit(False)
        for p in prefixes:
            out = out | line.startswith(p)
        return ~(out | line.isin(exact) if exact else out)

    return F.array_join(F.filter(F.split(text, "\n"), stays), "\n")


def visible_refs(text: Column, pattern: str, group: int = 1) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))))


def _walk(value, keys: bool, out: list[str]) -> None:
    if isinstance(value, dict):
        for k in sorted(value):
            if keys:
                out.append(k)
            _walk(value[k], keys, out)
    elif isinstance(value, list):
        for x in value:
            _walk(x, keys, out)
    elif isinstance(value, str):
        out.append(value)
    elif keys and value is not None:
        out.append(str(value))


def _strings(text: str | None, keys: bool) -> list[str]:
    out: list[str] = []
    if text is not None:
        _walk(json.loads(text), keys, out)
    return [x for x in out if x.strip()]


def payload_text(payload: Column | str) -> Column:
    """Keys and values of a JSON text, keys sorted, depth first, a line each."""
    def run(payload: pd.Series) -> pd.Series:
        return payload.map(lambda s: "\n".join(_strings(s, True)))

    return F.pandas_udf(run, "string")(payload)


def payload_strings(payload: Column | str) -> Column:
    """String values, without keys, of a JSON text."""
    def run(payload: pd.Series) -> pd.Series:
        return payload.map(lambda s: _strings(s, False))

    return F.pandas_udf(run, "array<string>")(payload)


def search_text(item_id: Column, kind: Column, path: Column, payload: Column) -> Column:
    return F.concat_ws("\n", item_id, kind, path, payload_text(payload))
