"""Scalar text functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as str.isspace() has it; Java's \s lacks some of it.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{SPACE}]"

# Comment patterns that may open a file, by language.
_SLASHES = (r"//.*", r"/\*[\s\S]*?\*/")
_HASH = (r"#.*",)
LEADING_COMMENTS = {
    "Python": (r"#.*", r'"""[\s\S]*?"""', r"'''[\s\S]*?'''"),
    "Java": _SLASHES,
    "Go": _SLASHES,
    "JavaScript": _SLASHES,
    "C++": _SLASHES,
    "TypeScript": _SLASHES,
    "PHP": (r"//.*", r"#.*", r"/\*[\s\S]*?\*/"),
    "Ruby": (r"#.*", r"=begin[\s\S]*?=end"),
    "C": _SLASHES,
    "C#": _SLASHES,
    "Rust": _SLASHES,
    "Scala": _SLASHES,
    "Kotlin": _SLASHES,
    "Swift": _SLASHES,
    "Perl": _HASH,
    "Haskell": (r"--.*", r"\{-[\s\S]*?-\}"),
    "R": _HASH,
    "Shell": _HASH,
}
#: Fixed value: characters of an English keyboard besides letters, digits and white space.
KEYBOARD = r"""./<>?;:"'`!@#$%^&*()[]{}_+=|\-~,一"""
#: Fixed value: openings of a first line that is set aside.
HEADERS = ("#!", r"<\?php")


_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(text: Column) -> Column:
    """Text without white space, as SPACE has it, at both ends."""
    return F.btrim(text, F.lit(_BLANKS))


def _once(value: Column, use) -> Column:
    """use(value), where value is computed once however often use has it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip_leading_comments(text: Column, language: Column, most: int = 50, line_comments: str = "rest") -> Column:
    """Text without the comments it opens with, up to most of them, after a header line.

    The result is header + newline + rest; a text that is a header line alone comes back stripped, and a text in a
    language without patterns comes back as it is. line_comments: "rest" has a line comment reach to the end of
    the text, "single" to the end of its line.
    """
    flag = "(?s)" if line_comments == "rest" else ""
    by_patterns: dict[tuple[str, ...], list[str]] = {}
    for name, patterns in LEADING_COMMENTS.items():
        by_patterns.setdefault(patterns, []).append(name)

    def opened(rest: Column) -> Column:
        bare = F.lit(None).cast("string")
        for patterns, names in by_patterns.items():
            one = "|".join(patterns)
            bare = F.when(language.isin(names), F.regexp_replace(rest, rf"{flag}^(?:(?:{one}){WS}*){{1,{most}}}", "")).otherwise(bare)
        return bare

    def of(body: Column) -> Column:
        headed = reduce(lambda a, h: a | body.startswith(h), HEADERS, F.lit(False))
        end = F.instr(body, "\n")
        head = F.when(headed, strip(F.substring_index(body, "\n", 1))).otherwise("")
        rest = F.when(headed, strip(F.substring(body, end + 1, F.length(body)))).otherwise(body)
        return F.when(headed & (end == 0), body).otherwise(F.concat(head, F.lit("\n"), _once(rest, opened)))

    return F.when(language.isin(list(LEADING_COMMENTS)), _once(strip(text), of)).otherwise(text)


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, repeats kept; null gives none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")


def on_keyboard(text: Column) -> Column:
    """Whether all characters are white space or on an English keyboard."""
    escaped = "".join("\\" + c if c in r"\[]^-&" else c for c in KEYBOARD)
    return ~text.rlike(f"[^a-zA-Z0-9{SPACE}{escaped}]")


def content_id(text: Column) -> Column:
    return F.md5(text)


def composite_key(code: Column, query: Column, version: Column) -> Column:
    return F.concat_ws("[SEP]", F.md5(code), F.md5(query), version)


def joined_fields(*fields: Column) -> Column:
    """One or two fields on lines of their own; null unless each is there and not blank."""
    if not 1 <= len(fields) <= 2:
        raise ValueError("one or two fields can be joined")
    ok = F.lit(True)
    for f in fields:
        ok = ok & f.isNotNull() & (strip(f) != "")
    return F.when(ok, F.concat_ws("\n", *fields))


def path_tail(path: Column) -> Column:
    """The last two segments of a path: owner/name of a checkout."""
    parts = F.split(path, "/")
    return F.concat_ws("/", F.get(parts, F.size(parts) - 2), F.get(parts, F.size(parts) - 1))


def repo_url(owner: Column, name: Column) -> Column:
    return F.concat(F.lit("https://github.com/"), owner, F.lit("/"), name)


def split_repo_url(url: Column) -> Column:
    """struct(git_url, rev, maintainer, name): the revision follows the last colon, if one lies beyond the scheme."""
    has_rev = F.locate(":", F.substring(url, 7, 1 << 30)) > 0
    rev = F.when(has_rev, F.substring_index(url, ":", -1))
    git = F.when(has_rev, F.substring(url, F.lit(1), F.length(url) - F.length(rev) - 1)).otherwise(url)
    parts = F.split(git, "/")
    return F.struct(git.alias("git_url"), rev.alias("rev"), F.get(parts, F.size(parts) - 2).alias("maintainer"), F.get(parts, F.size(parts) - 1).alias("name"))


def tagged_output(text: Column, tags: tuple[str, ...] = ("candidates", "final_output")) -> Column:
    """What the last tag of a chain holds, stripped; null if any is missing or it is empty.

    Each step takes the text after the last opening tag and needs the closing tag in what follows; the output ends
    at its last closing tag.
    """
    rest, ok = text, F.lit(True)
    for tag in tags:
        opened = F.instr(rest, f"<{tag}>") > 0
        rest = F.substring_index(rest, f"<{tag}>", -1)
        ok = ok & opened & (F.instr(rest, f"</{tag}>") > 0)
    body = strip(F.regexp_extract(rest, rf"(?s)^(.*)</{tags[-1]}>", 1))
    return F.when(ok & (body != ""), body)


def null_to_none(text: Column) -> Column:
    """The word null as None, wherever it stands."""
    return F.regexp_replace(text, r"(?<![a-zA-Z0-9_])null(?![a-zA-Z0-9_])", "None")
