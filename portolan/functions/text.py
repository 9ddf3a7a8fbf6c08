"""Text functions: accent folding, normalising, searching, URLs and file names."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Mapping
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accented letters the header matching folds, and their plain forms.
ACCENTED = "áàãâäéêëèíïîìóõôöòúüûùç"
PLAIN = "aaaaaeeeeiiiiooooouuuuc"

# ASCII white space stripped from both ends of a text.
ASCII_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"

# MIME type by extension.
MIME_TYPES = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".csv": "text/csv",
    ".txt": "text/plain",
    ".json": "application/json",
}
DEFAULT_MIME = "application/octet-stream"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@cache
def _folding() -> tuple[str, str, str, tuple[str, ...]]:
    """ASCII forms of all characters that have one under compatibility decomposition.

    Gives characters with a form of one letter and those letters, then characters with a longer form and
    those forms. Each character decomposes by itself, so a text's form is that of its characters in turn.
    """
    one, letters, more, forms = [], [], [], []
    for code in range(0x80, 0x20000):
        if 0xD800 <= code < 0xE000:
            continue
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            one.append(chr(code))
            letters.append(plain)
        elif plain:
            more.append(chr(code))
            forms.append(plain)
    return "".join(one), "".join(letters), "".join(more), tuple(forms)


@cache
def _ranges(characters: str) -> str:
    """The inside of a character class, as ranges: every range is one test for each character that is read."""
    codes = sorted(map(ord, characters))
    starts = [c for c, before in zip(codes, [None, *codes]) if before != c - 1]
    ends = [c for c, after in zip(codes, [*codes[1:], None]) if after != c + 1]
    return "".join(f"{chr(a)}-{chr(z)}" for a, z in zip(starts, ends))


def _unfolded(text: Column) -> Column:
    """Characters that stand for several letters or digits (ligatures, fractions, enclosed and squared forms) written out."""
    _, _, more, forms = _folding()
    parts = F.split(F.lit("\n".join(forms)), "\n")
    long = _ranges(more)

    def spelled(c: Column) -> Column:
        # A run of other characters is no single one of them; only those are looked up.
        return F.when(F.length(c) == 1, F.coalesce(F.try_element_at(parts, F.nullif(F.instr(F.lit(more), c), F.lit(0))), c)).otherwise(c)

    written = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"[{long}]|[^{long}]+"), F.lit(0)), spelled), "")
    return F.when(text.rlike(rf"(?=[^\x00-\x7F])[{long}]"), written).otherwise(text)


def normalize_text(c: Column | str) -> Column:
    """Compatibility forms, no accents, nothing outside ASCII, lower case, trimmed.

    Texts of ASCII alone are taken as they are, and what has one letter is put first, so few texts are looked through for longer forms.
    """
    one, letters, _, _ = _folding()
    text = _col(c)
    folded = F.regexp_replace(_unfolded(F.translate(text, one, letters)), r"[^\x00-\x7F]+", "")
    plain = F.when(text.rlike(r"[^\x00-\x7F]"), folded).otherwise(text)
    return F.trim(F.lower(plain), F.lit(ASCII_SPACE))


def fold_accents(c: Column | str) -> Column:
    """Lower-case and replace the 23 accented letters used in headers."""
    return F.translate(F.lower(_col(c)), ACCENTED, PLAIN)


def fold_name(name: str) -> str:
    """fold_accents for a header name known on the driver."""
    return name.lower().translate(str.maketrans(ACCENTED, PLAIN))


def contains_text(c: Column | str, needle: str | Column) -> Column:
    """Literal, case-insensitive containment; null counts as no."""
    wanted = F.lower(F.lit(needle) if isinstance(needle, str) else needle)
    return F.coalesce(F.contains(F.lower(_col(c)), wanted), F.lit(False))


def matches(c: Column | str, pattern: str, ignore_case: bool = True) -> Column:
    """Regular-expression search; null counts as no."""
    flag = "(?i)" if ignore_case else ""
    return F.coalesce(_col(c).rlike(flag + pattern), F.lit(False))


def any_of(conditions: Iterable[Column]) -> Column:
    """OR over conditions; no conditions means false."""
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result


def occurrences(text: Column, word: Column) -> Column:
    """Non-overlapping occurrences of word in text (0 for an empty word)."""
    removed = F.length(text) - F.length(F.replace(text, word, F.lit("")))
    return F.when(F.length(word) > 0, F.floor(removed / F.length(word))).otherwise(F.lit(0)).cast("bigint")


# The hosts and link parameters below.
def cloud_provider(url: Column | str) -> Column:
    """Class of a share link; the first matching rule wins."""
    u = F.lower(_col(url))
    return (
        F.when(F.contains(u, F.lit("docs.google.com/spreadsheets")), "google_sheets")
        .when(F.contains(u, F.lit("1drv.ms")) | F.contains(u, F.lit("onedrive.live.com")), "onedrive")
        .when(F.contains(u, F.lit("sharepoint.com")) & F.contains(u, F.lit("excel")), "sharepoint")
        .when(F.contains(u, F.lit("dropbox.com")), "dropbox")
        .when(F.contains(u, F.lit("box.com")), "box")
        .when(F.contains(u, F.lit("icloud.com")), "icloud")
        .when(F.endswith(u, F.lit(".xlsx")) | F.endswith(u, F.lit(".xls")) | F.endswith(u, F.lit(".csv")), "direct_file")
        .otherwise("unknown")
    )


def sheet_id(url: Column | str) -> Column:
    found = F.regexp_extract(_col(url), r"/spreadsheets/d/([a-zA-Z0-9_-]+)", 1)
    return F.nullif(found, F.lit(""))


def sheet_gid(url: Column | str) -> Column:
    found = F.regexp_extract(_col(url), r"[#&]gid=([0-9]+)", 1)
    return F.nullif(found, F.lit(""))


def _with_parameter(url: Column, parameter: str) -> Column:
    separator = F.when(F.contains(url, F.lit("?")), "&").otherwise("?")
    return F.concat(url, separator, F.lit(parameter))


def direct_download_url(url: Column | str) -> Column:
    """Rewrite a share link into its direct-download form; null where none is known."""
    u = _col(url)
    provider = cloud_provider(u)
    sheet = F.when(
        sheet_id(u).isNotNull(),
        F.concat(
            F.lit("https://docs.google.com/spreadsheets/d/"), sheet_id(u),
            F.lit("/export?format=csv&gid="), F.coalesce(sheet_gid(u), F.lit("0")),
            F.lit("&usp=sharing"),
        ),
    ).otherwise(u)
    viewed = F.replace(u, F.lit("/view.aspx"), F.lit("/download.aspx"))
    onedrive = (
        F.when(~F.contains(u, F.lit("onedrive.live.com")), u)
        .when(F.contains(viewed, F.lit("?download=1")), viewed)
        .otherwise(_with_parameter(viewed, "download=1"))
    )
    dropbox = (
        F.when(F.contains(u, F.lit("dl=0")), F.replace(u, F.lit("dl=0"), F.lit("dl=1")))
        .when(F.contains(u, F.lit("dl=1")), u)
        .otherwise(_with_parameter(u, "dl=1"))
    )
    sharepoint = F.when(F.contains(u, F.lit("download=1")), u).otherwise(_with_parameter(u, "download=1"))
    return (
        F.when(provider == "google_sheets", sheet)
        .when(provider == "onedrive", onedrive)
        .when(provider == "dropbox", dropbox)
        .when(provider == "sharepoint", sharepoint)
        .when(provider == "direct_file", u)
    )


def extension(path: Column | str) -> Column:
    """Lower-case extension with its dot; empty when there is none."""
    return F.lower(F.regexp_extract(_col(path), r"(\.[^./]+)$", 1))


def mime_type(path: Column | str, types: Mapping[str, str] = MIME_TYPES) -> Column:
    ext = extension(path)
    result = F.lit(None).cast("string")
    for suffix, mime in types.items():
        result = F.when(ext == suffix, mime).otherwise(result)
    return F.coalesce(result, F.lit(DEFAULT_MIME))


def safe_name(c: Column | str) -> Column:
    """Keep letters, digits and '_-. ', then turn spaces into underscores."""
    kept = F.regexp_replace(_col(c), r"[^\p{L}\p{N}_. -]", "")
    return F.replace(F.trim(kept), F.lit(" "), F.lit("_"))


def truncate_text(c: Column | str, limit: int = 50_000, marker: str = "\n\n[Conteúdo truncado...]") -> Column:
    text = _col(c)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))).otherwise(text)
