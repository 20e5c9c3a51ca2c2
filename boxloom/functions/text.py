"""Column functions on text: cleaning, names, languages, numbers, times, progress lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -----------------------------------------------------------------------------
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
NO_SPACE_BEFORE = r"(?U)\s+([,.;:!?%~)\]}»”’…]+)"
SOURCE_ALIASES = {
    "japanese": "jp", "japan": "jp", "ja": "jp", "jp": "jp",
    "korean": "kr", "korea": "kr", "ko": "kr", "kr": "kr",
    "chinese": "cn", "china": "cn", "zh": "cn", "cn": "cn", "ch": "cn",
}
TARGET_ALIASES = {"english": "en", "en": "en"}
RIGHT_TO_LEFT = ("jp", "cn")
SOURCE_SCRIPTS = {
    "jp": r"[\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9D}]",
    "cn": r"[\x{3100}-\x{312F}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]",
    "kr": r"[\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}]",
}
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tif", ".tiff")
ARCHIVE_SUFFIXES = (".cbz", ".zip")
LIVE_PROGRESS = r"^VLM .+: (?:waiting|reasoning|answering) \| "
PROGRESS_PATTERNS = (
    (r"^OCR page (\d+)", "OCR"),
    (r"^VLM structure page (\d+)", "Structure"),
    (r"^(?:VLM|Skip VLM) alt-placement page (\d+)", "Alt placement"),
    (r"^VLM translate page (\d+)", "Translation"),
    (r"^VLM proofread translations", "Proofreading"),
    (r"^VLM write translation notes", "Translation notes"),
    (r"^VLM open placement page (\d+)", "Open placement"),
    (r"^Detect placement containers page (\d+)", "Placement expansion"),
    (r"^VLM style placement page (\d+)", "Placement style"),
    (r"^Clean page (\d+)", "Clean"),
    (r"^Render page (\d+)", "Render"),
)
RESUME_PHASE = {
    "OCR": "ocr_raw", "Structure": "ocr_structured", "Alt placement": "alt_placement",
    "Translation": "translations", "Proofreading": "proofreading", "Translation notes": "translation_notes",
    "Open placement": "placements", "Placement expansion": "placements", "Placement style": "placements",
    "Clean": "render", "Render": "render",
}
BOOK_LEVEL_PHASES = ("proofreading", "translation_notes")


def lookup(values: dict[str, str], key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.try_element_at(table, key)


# cleaning --------------------------------------------------------------------------------

def strip(value: Column) -> Column:
    """Trim every kind of Unicode white space, not only blanks."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def collapse(value: Column) -> Column:
    return strip(F.regexp_replace(value, r"(?U)\s+", " "))


def lines(value: Column) -> Column:
    return F.split(value, LINE_BREAK)


def squeeze(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", "")


def texts_agree(a: Column, b: Column) -> Column:
    """Squeezed texts agree when one is blank or contained in the other."""
    a, b = squeeze(a), squeeze(b)
    return (a == "") | (b == "") | F.contains(a, b) | F.contains(b, a)


def caption(value: Column) -> Column:
    cleaned = F.transform(lines(strip(value)), lambda x: F.regexp_replace(collapse(x), NO_SPACE_BEFORE, "$1"))
    return F.array_join(F.filter(cleaned, lambda x: x != ""), "\n")


def plain_lines(value: Column) -> Column:
    """Trimmed text with every kind of line break written as a newline."""
    return F.regexp_replace(strip(value), LINE_BREAK, "\n")


def without_fences(text: Column) -> Column:
    """Drop a code fence around text that already has plain line breaks."""
    opened = F.regexp_replace(text, r"\A```[^\n]*(?:\n|\z)", "")
    closed = F.regexp_replace(opened, r"(?U)(?:\A|\n)[^\S\n]*```[^\S\n]*\z", "")
    return strip(F.when(text.startswith("```"), closed).otherwise(text))


def strip_fences(value: Column) -> Column:
    return without_fences(plain_lines(value))


def clean_title(value: Column) -> Column:
    """One line without a pair of outer quotes; null when nothing is left."""
    title = collapse(value)
    unquoted = title
    for quote in reversed(('"', "'", "`", "“", "”")):
        inner = strip(F.substr(title, F.lit(2), F.greatest(F.lit(0), F.length(title) - 2)))
        unquoted = F.when(title.startswith(quote) & title.endswith(quote), inner).otherwise(unquoted)
    return F.nullif(unquoted, F.lit(""))


def flat_field(value: Column) -> Column:
    """A field for a tab-separated line."""
    return strip(F.translate(F.coalesce(value, F.lit("")), "\t\r\n", "   "))


def replace_marked_line(notes: Column, marker: str, value: Column) -> Column:
    """Keep the other lines of a note and set the one that starts with `marker`."""
    kept = F.filter(lines(F.coalesce(notes, F.lit(""))), lambda x: ~strip(x).startswith(marker))
    added = F.when(F.coalesce(value, F.lit("")) != "", F.array(F.concat(F.lit(marker + " "), value))) \
             .otherwise(F.array().cast("array<string>"))
    return F.nullif(strip(F.array_join(F.concat(kept, added), "\n")), F.lit(""))


# names -----------------------------------------------------------------------------------

def _strip_chars(value: Column, chars: str) -> Column:
    return F.trim(value, F.lit(chars))


def base_name(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, r"/+$", ""), r"[^/]*$", 0)


def suffix(name: Column) -> Column:
    """Lower-case suffix with its dot; hidden files and trailing dots have none."""
    return F.lower(F.regexp_extract(name, r"[^.].*?(\.[^./]+)$", 1))


def is_ignored_member(name: Column) -> Column:
    return base_name(name).startswith(".") | F.rlike(name, F.lit(r"(^|/)__MACOSX(/|$)"))


def is_image_member(name: Column) -> Column:
    return ~is_ignored_member(name) & suffix(base_name(name)).isin(*IMAGE_SUFFIXES)


def safe_job_name(value: Column, fallback: Column, longest: int = 256) -> Column:
    name = F.regexp_replace(strip(value), r"[\\/\x00-\x1f\x7f]+", " - ")
    name = _strip_chars(F.regexp_replace(name, r"(?U)\s+", " "), " .")
    name = F.rtrim(F.substring(name, 1, longest), F.lit(" ."))
    return F.coalesce(F.nullif(name, F.lit("")), fallback)


def safe_file_name(value: Column, fallback: Column, longest: int = 180) -> Column:
    name = F.regexp_replace(value, r'[\\/:*?"<>|\x00-\x1f]', "_")
    return F.coalesce(F.nullif(F.substring(_strip_chars(name, ". "), 1, longest), F.lit("")), fallback)


def default_job_name(file_name: Column, job_id: Column) -> Column:
    name = base_name(strip(F.coalesce(file_name, F.lit(""))))
    known = suffix(name).isin(*ARCHIVE_SUFFIXES, *IMAGE_SUFFIXES)
    stem = F.when(known, F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)
    return F.coalesce(F.nullif(stem, F.lit("")), job_id)


def natural_key(name: Column) -> Column:
    """Sort key in which runs of digits compare as numbers of any length."""
    pieces = F.regexp_extract_all(F.lower(name), F.lit(r"[^0-9]+[0-9]*|[0-9]+"), F.lit(0))

    def piece(x: Column) -> Column:
        digits = F.regexp_extract(x, r"[0-9]+$", 0)
        number = F.regexp_replace(digits, "^0+", "")
        return F.struct(F.regexp_extract(x, r"^[^0-9]*", 0).alias("text"),
                        F.when(digits == "", F.lit(-1)).otherwise(F.length(number)).alias("size"),
                        number.alias("number"))

    return F.transform(pieces, piece)


# languages -------------------------------------------------------------------------------

def source_language(value: Column) -> Column:
    """Language code, null when the language is not supported."""
    return lookup(SOURCE_ALIASES, F.lower(strip(F.coalesce(value, F.lit("jp")))))


def target_language(value: Column) -> Column:
    return lookup(TARGET_ALIASES, F.lower(strip(F.coalesce(value, F.lit("en")))))


def reads_right_to_left(code: Column) -> Column:
    return code.isin(*RIGHT_TO_LEFT)


def needs_translation(text: Column, source: str, target: str = "en") -> Column:
    """Source-script text always does; text without letters never; Latin text not into English."""
    value = F.coalesce(text, F.lit(""))
    has_source = F.rlike(value, F.lit(SOURCE_SCRIPTS[source]))
    has_letter = F.rlike(value, F.lit(r"\p{L}"))
    foreign = F.rlike(value, F.lit(r"[\p{L}&&[^\p{IsLatin}]]")) if target == "en" else F.lit(True)
    return has_source | (has_letter & foreign)


# lenient values --------------------------------------------------------------------------

def lenient_bool(value: Column) -> Column:
    word = F.lower(strip(value))
    return F.when(word.isin("true", "1", "yes"), True).when(word.isin("false", "0", "no"), False)


def lenient_index(value: Column) -> Column:
    """Whole number without sign or leading zeros, else null."""
    word = strip(value)
    return F.when(F.rlike(word, F.lit(r"^(?:0|[1-9][0-9]*)$")), word.try_cast("bigint"))


def _finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def lenient_ratio(value: Column) -> Column:
    """Number or percentage, null unless finite."""
    word = strip(value)
    percent = word.endswith("%")
    digits = F.when(percent, F.regexp_replace(word, "%$", "")).otherwise(word)
    number = _finite(strip(digits).try_cast("double"))
    return F.when(percent, number / 100).otherwise(number)


def expansion_ratio(value: Column) -> Column:
    number = lenient_ratio(value)
    return F.when(number >= 0, number)


def fraction(value: Column) -> Column:
    number = lenient_ratio(value)
    return F.when(number.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), number)))


def _plain_decimal(number: Column) -> Column:
    text = number.cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def chapter_number(value: Column) -> Column:
    """Canonical decimal text of a chapter or volume number, null when it is not valid."""
    word = strip(value)
    shaped = (F.length(value) <= 20) & F.rlike(word, F.lit(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"))
    wide = word.try_cast("decimal(38,30)")
    exact = wide.try_cast("decimal(38,18)")
    vanished = (wide == 0) & F.rlike(F.regexp_replace(word, "[eE].*$", ""), F.lit("[1-9]"))
    plain = _plain_decimal(exact)
    ok = shaped & (wide >= 0) & (wide <= 1_000_000) & (wide == exact.try_cast("decimal(38,30)")) & ~vanished & (F.length(plain) <= 20)
    return F.when(ok, plain)


def chapter_label(volume: Column, chapter: Column) -> Column:
    return F.concat(F.when(F.coalesce(volume, F.lit("")) != "", F.concat(F.lit("Vol. "), volume, F.lit(" "))).otherwise(""),
                    F.when(F.coalesce(chapter, F.lit("")) != "", F.concat(F.lit("Ch. "), chapter)).otherwise(""))


# times and sizes -------------------------------------------------------------------------

def iso_timestamp(value: Column) -> Column:
    """ISO 8601 text; without an offset it is UTC; anything else is null."""
    word = F.regexp_extract(value, r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]{1,9})?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?$", 0)
    has_offset = F.rlike(word, F.lit(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")) & (F.length(word) > 10)
    full = F.when(F.length(word) == 10, F.concat(word, F.lit("T00:00:00Z"))) \
            .when(has_offset, word).otherwise(F.concat(word, F.lit("Z")))
    return F.when(word != "", F.regexp_replace(F.replace(full, F.lit(","), F.lit(".")),
                                               r"([+-][0-9]{2})([0-9]{2})$", "$1:$2").try_cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1_000_000.0)


def _whole(value: Column) -> Column:
    return F.floor(value).cast("bigint").cast("string")


def duration_text(seconds: Column) -> Column:
    s = F.greatest(seconds.cast("double"), F.lit(0.0))
    minutes = F.floor(s / 60)
    rest = F.bround(s - minutes * 60, 0)
    return (F.when(seconds.isNull(), "")
            .when(s < 60, F.concat(F.format_string("%.1f", F.bround(s, 1)), F.lit("s")))
            .when(minutes < 60, F.concat(_whole(minutes), F.lit("m "), _whole(rest), F.lit("s")))
            .otherwise(F.concat(_whole(minutes / 60), F.lit("h "), _whole(minutes % 60), F.lit("m"))))


def age_text(seconds: Column) -> Column:
    s = F.greatest(seconds.cast("double"), F.lit(0.0))
    minutes = F.floor(s / 60)
    hours = F.floor(minutes / 60)
    return (F.when(seconds.isNull(), "").when(s < 60, "less than 1m")
            .when(minutes < 60, F.concat(_whole(minutes), F.lit("m")))
            .when(hours < 24, F.concat(_whole(hours), F.lit("h "), _whole(minutes % 60), F.lit("m")))
            .otherwise(F.concat(_whole(hours / 24), F.lit("d "), _whole(hours % 24), F.lit("h"))))


def size_text(size: Column) -> Column:
    s = F.greatest(size.cast("double"), F.lit(0.0))
    out = F.when(size.isNull(), "").when(s < 1024, F.concat(_whole(s), F.lit(" B")))
    for step, unit in enumerate(("KB", "MB"), start=1):
        out = out.when(s < 1024.0 ** (step + 1),
                       F.concat(F.format_string("%.1f", F.bround(s / 1024.0 ** step, 1)), F.lit(f" {unit}")))
    return out.otherwise(F.concat(F.format_string("%.1f", F.bround(s / 1024.0 ** 3, 1)), F.lit(" GB")))


# progress lines --------------------------------------------------------------------------

def progress_phase(line: Column) -> Column:
    phase = F.lit(None).cast("string")
    for pattern, name in reversed(PROGRESS_PATTERNS):
        phase = F.when(F.rlike(line, F.lit(pattern)), name).otherwise(phase)
    return phase


def progress_page(line: Column) -> Column:
    """Page of a line that reports progress; the patterns differ only in what comes before it."""
    page = [pattern for pattern, _ in PROGRESS_PATTERNS if "(\\d+)" in pattern]
    heads = "|".join(pattern.replace("^", "").replace(r" (\d+)", "") for pattern in page)
    return F.regexp_extract(line, rf"^(?:{heads}) (\d+)", 1).try_cast("bigint")


def resume_target(resume_from: Column, page: Column) -> Column:
    """struct(phase, page) to resume at, null when there is none."""
    known = resume_from.isin(*sorted(set(RESUME_PHASE.values())))
    book_level = resume_from.isin(*BOOK_LEVEL_PHASES)
    number = F.when(book_level, F.lit(0).cast("bigint")).otherwise(page.try_cast("bigint"))
    return F.when(known & (number >= 0), F.struct(resume_from.alias("phase"), number.alias("page")))


def progress_target(phase: Column, page: Column) -> Column:
    return resume_target(lookup(RESUME_PHASE, phase), page)
