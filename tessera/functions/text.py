"""Column functions over text, lines and paths."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Suffix to language.
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript", ".rb": "ruby", ".go": "go", ".rs": "rust",
    ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".toml": "toml",
    ".md": "markdown", ".txt": "text", ".cfg": "ini", ".ini": "ini",
}
PROSE = ["markdown", "text", "json", "yaml", "toml"]
PROSE_SUFFIX = ".mdc"
NOT_CODE = ["ini", "json", "markdown", "text", "toml", "yaml"]
BREAK = "\r\n|\r|\n"
#: Lines of context on either side, characters around a match, and an excerpt's length.
RADIUS, MARGIN, LIMIT = 20, 24, 200
REDACTED = "[REDACTED]"
#: What Python's strip() takes away.
_STRIP = r"[\t\n\x0b\f\r \x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
_RUN = "[A-Za-z0-9+/=_-]"
#: What counts as a credential, in order of application; (pattern, replacement).
REDACTIONS = [
    (r"(?iu)\b([a-z][a-z0-9+.\-]*://)([^\s:/@]*):([^\s/@]{1,})@", "$1$2:" + REDACTED + "@"),
    (r"(?iu)((?:^|\s)(?:--?(?:password|passwd|pass|pwd|token|secret|api[_-]?key|auth|credential)|-p)\s+)([^\s]{4,})", "$1" + REDACTED),
    (r"""(?iu)([A-Za-z0-9_.-]*(?:token|password|passwd|passphrase|pgpass|pwd|pw|secret|api[_-]?key|private[_-]?key|credential|authorization|bearer)[A-Za-z0-9_.-]*)(["']?\s*[=:]\s*(?:bearer\s+)?)(?:(["'])([^"'\n]{4,})|([^\s"',)]{4,}))""", "$1$2$3" + REDACTED),
    (r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{32,}(?![A-Za-z0-9+/=_-])", REDACTED),
]


def split_lines(text: Column) -> Column:
    """Lines between CRLF, CR or LF only; no empty line after a last break; null stays null, empty has none."""
    return unended(F.split(text, BREAK, -1))


def unended(parts: Column) -> Column:
    """Without the empty line after a last break."""
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def to_lf(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def suffix(path: Column) -> Column:
    """The lower-cased last suffix of the base name with its dot, or empty."""
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]*)$", 1))


def language_of(path: Column) -> Column:
    """A language by suffix, null where it is unknown."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(known, suffix(path))


def is_prose(path: Column) -> Column:
    return F.coalesce((suffix(path) == PROSE_SUFFIX) | language_of(path).isin(PROSE), F.lit(False))


def glob_regex(glob: str) -> str:
    """A glob as a whole-path pattern: **/ is any folders, ** anything, * and ? stay within a folder."""
    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out, k = out + "(?:[^/]+/)*", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        elif glob[k] in "*?":
            out, k = out + ("[^/]*" if glob[k] == "*" else "[^/]"), k + 1
        else:
            out, k = out + (glob[k] if glob[k].isalnum() or glob[k] in "_/" else "\\" + glob[k]), k + 1
    return f"^(?:{out})$"


def window(lines: Column, index: Column, first: Column | None = None, last: Column | None = None) -> Column:
    """Up to RADIUS lines on either side of a zero-based index, clipped to a body's first and last where given."""
    low = F.greatest(F.lit(0), index - RADIUS)
    high = F.least(F.size(lines), index + RADIUS + 1)
    if first is not None:
        inner_low, inner_high = F.greatest(low, first), F.least(high, last + 1)
        fits = inner_high > inner_low
        low, high = F.when(fits, inner_low).otherwise(low), F.when(fits, inner_high).otherwise(high)
    return F.array_join(F.slice(lines, (low + 1).cast("int"), (high - low).cast("int")), "\n")


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def slug(name: pd.Series) -> pd.Series:
    """Letters and digits of a name without marks, lower-cased, dashes between; `target` where none are left."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        bare = "".join(c for c in unicodedata.normalize("NFKD", x).lower() if not unicodedata.combining(c))
        return "-".join(p for p in "".join(c if c.isalnum() and c.isascii() else " " for c in bare).split()) or "target"

    return name.map(one)


def composed(text: Column) -> Column:
    """NFC. Letters below the first combining mark (U+0300) never change; Python gets null for texts of such letters only, as Spark
    evaluates it for all rows, whatever condition stands around it."""
    return F.coalesce(nfc(F.when(text.rlike(r"[^\x{0}-\x{2FF}]"), text)), text)


def normal(text: Column) -> Column:
    """NFC with LF breaks."""
    return composed(to_lf(text))


def window_sha(text: Column) -> Column:
    return F.sha2(normal(text), 256)


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value) with the value worked out once, however often it is named there, and kept as it is: an array that comes out of a row is
    copied whole by each slice of it, one made here is not."""
    return F.element_at(F.transform(F.array(value), of), 1)


def window_shas(content: Column) -> Column:
    """Digests of the windows of all lines, as an array; null where a line has the window of the line before it.

    A line break composes with nothing, so the text is brought to NFC before it is cut; each window is dropped as soon as it is hashed.
    """

    def of(lines: Column) -> Column:
        same = lambda i: (i > 0) & (i <= RADIUS) & (i + RADIUS >= F.size(lines))
        return F.transform(lines, lambda _, i: F.when(~same(i), F.sha2(window(lines, i), 256)))

    return once(once(F.split(composed(content), BREAK, -1), unended), of)


def candidate_id(path: Column, rule: Column, digest: Column, ordinal: Column) -> Column:
    gap = F.char(F.lit(0))
    return F.left(F.sha2(F.concat(path, gap, rule, gap, digest, gap, ordinal.cast("string")), 256), F.lit(16))


def redact(text: Column) -> Column:
    for pattern, replacement in REDACTIONS:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "^" + _STRIP, ""), _STRIP + r"\z", "")


def excerpt(line: Column, start: Column, end: Column) -> Column:
    """A match with a margin, widened over runs of credential characters, stripped, redacted, then cut."""
    left, right = F.greatest(F.lit(0), start - MARGIN), F.least(F.length(line), end + MARGIN)
    before = F.length(F.regexp_extract(F.reverse(F.substring(line, F.lit(1), left)), f"^{_RUN}*", 0))
    after = F.length(F.regexp_extract(F.substring(line, right + 1, F.length(line)), f"^{_RUN}*", 0))
    span = F.substring(line, left - before + 1, right + after - left + before)
    return F.left(redact(strip(span)), F.lit(LIMIT))


def is_binary(content: Column) -> Column:
    """More than 5 % of the first 8192 bytes are control bytes other than the nine of plain text; empty is text."""
    head = F.hex(F.substring(content, 1, 8192))
    # fixed values: TAB LF VT FF CR ESC and the file, group and record separators
    odd = F.length(F.regexp_replace(F.regexp_replace(head, "(..)", "$1 "), "(?:09|0A|0B|0C|0D|1B|1C|1D|1E) |[2-9A-F]. ", "")) / 3
    total = F.length(head) / 2
    return F.coalesce((total > 0) & (odd > 0.05 * total), F.lit(False))


def lexical_join(folder: Column, reference: Column) -> Column:
    """folder/reference with . and .. resolved by text; null where it leaves the root or is rooted elsewhere."""
    parts = F.filter(F.split(F.concat_ws("/", folder, reference), "/", -1), lambda x: (x != "") & (x != "."))
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(False).alias("out"))

    def step(s: Column, x: Column) -> Column:
        up = x == ".."
        gone = s["out"] | (up & (F.size(s["at"]) == 0))
        at = F.when(up, F.slice(s["at"], 1, F.greatest(F.size(s["at"]) - 1, F.lit(0)))).otherwise(F.concat(s["at"], F.array(x)))
        return F.struct(at.alias("at"), gone.alias("out"))

    end = F.aggregate(parts, start, step)
    rooted = reference.rlike(r"^(?:/|~|[A-Za-z]:[\\/])")
    return F.when(~end["out"] & ~rooted & (F.size(end["at"]) > 0), F.array_join(end["at"], "/"))
