"""Identity, path, id and text normal forms."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

# Every character that counts as whitespace.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same as a pattern; Java's \s alone is ASCII only. Measured faster than a class of ranges or a translation.
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"

ASCII_SPACE_RUN = r"[\s\x1c-\x1f]+"

# Lower-case letters that full case folding changes, by Unicode's own tables: one to one, and one to several.
_FOLDED = [(c, c.casefold()) for c in map(chr, range(0x110000)) if c == c.lower() != c.casefold()]
FOLDED_ALIKE = [(c, folded) for c, folded in _FOLDED if len(folded) == 1]
FOLDED_LONGER = [(c, folded) for c, folded in _FOLDED if len(folded) > 1]



def _stretches(letters: list[str], gap: int = 48) -> str:
    """A short character class that holds all letters, and others between them."""
    found: list[list[int]] = []
    for code in sorted(map(ord, letters)):
        if found and code - found[-1][1] <= gap:
            found[-1][1] = code
        else:
            found.append([code, code])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in found) + "]"


# Texts without a letter of these stretches need no folding beyond lower case; the sharp s is common and handled by itself.
SELDOM_FOLDED = _stretches([c for c, _ in _FOLDED if c != "ß"])

# File extensions accepted when none are configured.
DEFAULT_EXTENSIONS = (".mp3", ".wav", ".m4a", ".aac", ".flac")


def bind(value: Column, build: Callable[[Column], Column]) -> Column:
    """``build(value)`` with ``value`` evaluated once per row, however often ``build`` uses it."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def non_blank(text: Column) -> Column:
    """Stripped text, or null when nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def forward_slashes(text: Column) -> Column:
    return F.replace(text, F.lit("\\"), F.lit("/"))


def compact(text: Column) -> Column:
    """Runs of whitespace become one blank; leading and trailing whitespace goes."""
    return F.trim(F.regexp_replace(text, SPACE_RUN, " "))


def comparable(text: Column) -> Column:
    """Text without any whitespace, case folded, for equality tests."""
    given = F.coalesce(text, F.lit(""))

    def fully(value: Column) -> Column:
        value = F.translate(value, "".join(c for c, _ in FOLDED_ALIKE), "".join(f for _, f in FOLDED_ALIKE))
        for letter, replacement in FOLDED_LONGER:
            value = F.replace(value, F.lit(letter), F.lit(replacement))
        return value

    def folded(value: Column) -> Column:
        plain = F.replace(value, F.lit("ß"), F.lit("ss"))
        return F.when(value.rlike(SELDOM_FOLDED), bind(value, fully)).otherwise(plain)

    # Most texts are ASCII, which one cheap test tells; few of the others hold a letter that lower case leaves unfolded.
    ascii_only = F.octet_length(given) == F.char_length(given)
    return F.when(ascii_only, F.lower(F.regexp_replace(given, ASCII_SPACE_RUN, ""))).otherwise(
        bind(F.lower(F.regexp_replace(given, SPACE_RUN, "")), folded)
    )


def identity_key(identity: Column) -> Column:
    """Case- and separator-insensitive form of a file identity; null becomes the empty string."""
    slashed = forward_slashes(strip(F.coalesce(identity, F.lit(""))))
    return F.lower(F.regexp_replace(slashed, "/+$", ""))


def lowered(text: Column) -> Column:
    return F.lower(strip(F.coalesce(text, F.lit(""))))


def catalog_key(identity: Column, source_hash: Column, signature: Column) -> Column:
    """Display form of the three key columns; the identity part is left out when blank."""
    return F.concat_ws(
        "::", F.nullif(identity_key(identity), F.lit("")), lowered(source_hash), lowered(signature)
    )


def source_identity(source_id: Column, relative_path: Column) -> Column:
    source = F.coalesce(non_blank(source_id), F.lit("local"))
    relative = F.regexp_replace(forward_slashes(strip(F.coalesce(relative_path, F.lit("")))), "^/+", "")
    return F.concat(source, F.lit("::"), relative)


def relative_to(path: Column, root: Column) -> Column:
    """Path below ``root``; unchanged when it lies elsewhere."""
    base = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    inside = F.startswith(path, base)
    return F.when(inside, F.substr(path, F.length(base) + F.lit(1))).otherwise(path)


def file_name(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, "/+$", ""), r"([^/]*)$", 1)


def directory(path: Column) -> Column:
    """Parent directory; empty at the top level."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Lowercase suffix with its dot; empty when there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def is_windows_path(path: Column) -> Column:
    return path.rlike(r"^[A-Za-z]:[\\/]") | F.contains(path, F.lit("\\"))


def display_path(root: Column, relative_path: Column, fallback: Column) -> Column:
    """Root and relative path joined in the root's own style."""
    root_text = strip(F.coalesce(root, F.lit("")))
    relative = forward_slashes(strip(F.coalesce(relative_path, F.lit(""))))
    parts = F.filter(F.split(relative, "/"), lambda part: part != "")
    windows_root = F.regexp_replace(F.replace(root_text, F.lit("/"), F.lit("\\")), r"\\+$", "")
    posix_root = F.regexp_replace(root_text, "/+$", "")
    return (
        F.when(root_text == "", fallback)
        .when(F.size(parts) == 0, root_text)
        .when(is_windows_path(root_text), F.concat_ws("\\", windows_root, F.array_join(parts, "\\")))
        .otherwise(F.concat_ws("/", posix_root, F.array_join(parts, "/")))
    )


def slug(text: Column) -> Column:
    dashed = F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"[^A-Za-z0-9._-]+", "-")
    cleaned = F.regexp_replace(F.regexp_replace(dashed, "-{2,}", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("item"))


def media_id(display_name: Column, original_path: Column, identity: Column, source_hash: Column) -> Column:
    """Slug of the file stem plus eight hex digits of the identity, or of the content hash without identity."""
    name = F.coalesce(F.nullif(display_name, F.lit("")), stem(original_path))
    suffix = F.coalesce(F.left(F.sha2(non_blank(identity), 256), F.lit(8)), F.left(source_hash, F.lit(8)))
    return F.concat(slug(stem(name)), F.lit("-"), suffix)


def item_id(
    audio_id: Column,
    identity: Column,
    source_hash: Column,
    signature: Column,
    run_id: Column,
    whole_row: Column,
) -> Column:
    """Media id; else a digest of the known parts; else a digest of the row as text."""
    seed = F.concat_ws(
        "::",
        F.nullif(identity_key(identity), F.lit("")),
        F.nullif(lowered(source_hash), F.lit("")),
        F.nullif(lowered(signature), F.lit("")),
        non_blank(run_id),
    )
    digest = F.sha2(F.coalesce(F.nullif(seed, F.lit("")), whole_row), 256)
    return F.coalesce(non_blank(audio_id), F.concat(F.lit("item-"), F.left(digest, F.lit(12))))


def output_root_key(path: Column) -> Column:
    """Sixteen hex digits naming the catalog and run partitions of one output root."""
    return F.left(F.sha2(F.lower(path), 256), F.lit(16))


def id_list(text: Column) -> Column:
    """Distinct non-blank ids of a comma or line separated list, first occurrence first."""
    parts = F.transform(F.split(text, r"[,\r\n]"), strip)
    return F.array_distinct(F.filter(parts, lambda part: part != ""))


def normalize_extensions(extensions: Sequence[str] | None) -> list[str]:
    """Lowercase, dotted, distinct; the defaults when nothing is given."""
    cleaned = [value.strip().lower() for value in extensions or () if value.strip()]
    dotted = [value if value.startswith(".") else f".{value}" for value in cleaned]
    return list(dict.fromkeys(dotted)) or list(DEFAULT_EXTENSIONS)


def extension_list(extensions: Column) -> Column:
    """The same normal form for an array column."""
    cleaned = F.filter(F.transform(extensions, lambda e: F.lower(strip(e))), lambda e: e != "")
    dotted = F.array_distinct(
        F.transform(cleaned, lambda e: F.when(F.startswith(e, F.lit(".")), e).otherwise(F.concat(F.lit("."), e)))
    )
    default = F.array(*[F.lit(value) for value in DEFAULT_EXTENSIONS])
    return F.when(F.size(dotted) > 0, dotted).otherwise(default)
