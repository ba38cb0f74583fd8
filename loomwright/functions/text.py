"""Text functions as column expressions. All run in the JVM; those that need Unicode tables Spark lacks are in `unicode`."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.split() and str.strip() treat as white space.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: ASCII punctuation.
PUNCTUATION = r"[!-/:-@\[-`{-~]"
#: Code points that clean_text treats as white space, and as control characters.
CLEAN_SPACE = r"[\t-\r\x1c-\x1f\x{85}\p{Z}&&[^\x{1680}]]"
CLEAN_CONTROL = r"[\p{Cc}\p{Cf}\x{fffc}\x{fffd}&&[^\t-\r\x1c-\x1f\x{85}]]"
#: The CJK ranges that clean_text spaces out.
CJK = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{2a6df}\x{2a700}-\x{2b73f}\x{2b740}-\x{2b81f}\x{2b820}-\x{2ceaf}\x{2f800}-\x{2fa1f}]"
#: LaTeX macros and the characters that get a backslash.
LATEX_NAMED = {"\\": "\\textbackslash", "~": "\\textasciitilde", "^": "\\textasciicircum"}
LATEX_PREFIXED = "%$&#_{}"


def pystrip(text: Column) -> Column:
    """Strips all Unicode white space; Spark's trim takes spaces alone."""
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def words(text: Column) -> Column:
    """White-space tokens; none for blank text."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda x: x != "")


def without_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, PUNCTUATION, " ")


def tokens(text: Column) -> Column:
    """Lower-case tokens between ASCII punctuation and white space, as ROUGE counts them."""
    return words(F.lower(without_punctuation(text)))


def stripped_lines(text: Column) -> Column:
    """Lines stripped, blank ones dropped, and always a line break at the end (also of empty text)."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    return F.concat(F.array_join(F.filter(F.transform(lines, pystrip), lambda x: x != ""), "\n"), F.lit("\n"))


def punctuated(text: Column) -> Column:
    """Whether any character is punctuation: ASCII symbols, or Unicode category P."""
    return F.regexp_like(text, F.lit(rf"[\p{{P}}{PUNCTUATION[1:]}"))


def cleaned(normalized: Column, replace_newline: bool = False, space_cjk: bool = False) -> Column:
    """What clean_text does after NFKC: drops control and replacement characters, turns white space into spaces (line
    breaks stay unless `replace_newline`), and sets spaces around CJK characters on request."""
    out = F.regexp_replace(normalized, CLEAN_CONTROL, "")
    out = F.regexp_replace(out, CLEAN_SPACE if replace_newline else rf"[{CLEAN_SPACE[1:-1]}&&[^\n]]", " ")
    return spaced_cjk(out) if space_cjk else out


def spaced_cjk(text: Column) -> Column:
    """One space after each CJK character, and one before it unless a space stands there already."""
    return F.regexp_replace(F.regexp_replace(text, rf"({CJK})", "$1 "), rf"(?<! )({CJK})", " $1")


def ellipsis_path(path: Column, longest: int = -1, mark: str = "...") -> Column:
    """A path's tail behind a mark, `longest` characters in all; negative: as it is."""
    if longest < 0:
        return path
    keep = max(longest - len(mark), 0)
    tail = F.right(path, F.lit(keep)) if keep else F.lit("")
    return F.when(F.length(path) > longest, F.concat(F.lit(mark), tail)).otherwise(path)


def latex_escaped(text: Column) -> Column:
    """Escapes LaTeX's special characters outside <latex>...</latex>, which passes as it is and loses its tags; an open
    tag runs to the end."""
    raw = r"(?s)<latex>(.*?)(?:</latex>|\z)"
    plain = F.transform(F.split(text, raw), _latex_plain)
    kept = F.regexp_extract_all(text, F.lit(raw), F.lit(1))
    return F.array_join(F.flatten(F.zip_with(plain, kept, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


def _latex_plain(x: Column) -> Column:
    out = F.regexp_replace(x, "\\\\", "\x00")
    out = F.regexp_replace(out, f"([{re.escape(LATEX_PREFIXED)}])", r"\\$1")
    for raw, named in LATEX_NAMED.items():
        out = F.replace(out, F.lit("\x00" if raw == "\\" else raw), F.lit(named))
    return F.replace(F.regexp_replace(out, r"\p{Zs}", " "), F.lit("​"), F.lit(""))


def ranking_reply(reply: Column) -> Column:
    """The items of a reply that begins with 'Ranking: [a, b]', as they stand between commas; null for other replies."""
    pattern = r"^Ranking:\s*\[(.*?)\]"
    return F.when(F.regexp_like(reply, F.lit(pattern)), F.split(F.regexp_extract(reply, pattern, 1), ","))


def preferred_name(reply: Column, names: Column) -> Column:
    """The one of `names` that the reply holds, if names occur once in all; null otherwise. Names are taken literally."""
    pattern = F.array_join(F.transform(names, lambda n: F.concat(F.lit("\\Q"), n, F.lit("\\E"))), "|")
    found = F.regexp_extract_all(reply, pattern, F.lit(0))
    return F.when(F.size(found) == 1, F.element_at(found, 1))


def matches_any(text: Column, patterns: list[str] | None, default: bool) -> Column:
    """Whether any pattern is found; without patterns, `default`."""
    if patterns is None:
        return F.lit(default)
    out = F.lit(False)
    for p in patterns:
        out = out | F.regexp_like(text, F.lit(p))
    return out


def path_ignored(path: Column, ignore: list[str] | None = None, include: list[str] | None = None, include_wins: bool = False) -> Column:
    """Whether a path is left out. With `include_wins`: it matches `ignore` and not `include`. Otherwise: it matches
    `ignore`, or does not match a given `include`. Lists that are not given match nothing."""
    ignored = matches_any(path, ignore, False)
    if include_wins:
        return ignored & ~matches_any(path, include, False)
    return ignored | ~matches_any(path, include, True)


def error_text(body: Column) -> Column:
    """An error reply's text: the JSON document if it is one, the raw text otherwise, 'Unknown error' if empty."""
    parsed = F.to_json(F.try_parse_json(body)) if hasattr(F, "try_parse_json") else F.lit(None)
    return F.coalesce(parsed, F.when(F.trim(body) != "", body), F.lit("Unknown error"))


def falsy_coalesce(*columns: Column) -> Column:
    """The first value that is neither null, empty nor zero; the last one as it is."""
    out = columns[-1]
    for c in reversed(columns[:-1]):
        out = F.when(c.isNotNull() & ~c.cast("string").isin("", "0", "0.0", "false"), c).otherwise(out)
    return out


def filled(template: str, **values: Column) -> Column:
    """A prompt template with {name} places; values are put in as they are, and never searched for places themselves."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)))
