"""Text columns: accents, file names, references and label maps."""

from __future__ import annotations

import unicodedata
from itertools import chain

from pyspark.sql import Column, functions as F

# Labels that the reports print.
UNCATEGORISED = "Sin categoría"
KIND_LABEL = {"expense": "GASTO", "income": "INGRESO", "transfer": "TRANSFERENCIA"}
NATURE_LABEL = {"basico": "Básico", "necesario": "Necesario", "estilo_de_vida": "Estilo de vida"}
FREQUENCY_LABEL = {"fijo": "Fijo", "variable": "Variable"}


# Blocks of Latin letters: supplement and extensions, additional, ligatures, full width.
_LATIN = (range(0xA0, 0x250), range(0x1E00, 0x1F00), range(0xFB00, 0xFB07), range(0xFF01, 0xFF5F))


def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Letters of any script that decompose to one bare letter, and Latin ones that give several."""
    source, target, several = [], [], {}
    for code in (c for c in range(0xA0, 0x10000) if not 0xD800 <= c < 0xE000):
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(bare) > 1:
            if any(code in block for block in _LATIN):
                several[chr(code)] = bare
        elif bare and bare != chr(code):
            source.append(chr(code))
            target.append(bare)
    return "".join(source), "".join(target), several


_FOLD_FROM, _FOLD_TO, _FOLD_SEVERAL = _fold_tables()


def fold_accents(text: Column) -> Column:
    """Compatibility decomposition of letters without combining marks.

    Single letters of every script go by table; signs of other scripts that stand for
    several letters (Hangul syllables, squared abbreviations) stay as they are. Ligatures and the like are rare, so they are only
    replaced in texts that have one.
    """
    folded = F.translate(text, _FOLD_FROM, _FOLD_TO)
    spread = folded
    for letter, bare in _FOLD_SEVERAL.items():
        spread = F.replace(spread, F.lit(letter), F.lit(bare))
    rare = text.rlike("[" + "".join(_FOLD_SEVERAL) + "]")
    return F.regexp_replace(F.when(rare, spread).otherwise(folded), r"\p{M}", "")


def haystack(raw: Column, description: Column) -> Column:
    """Text that the rules search: raw text (or nothing), a space, the description."""
    return F.concat(F.coalesce(raw, F.lit("")), F.lit(" "), F.coalesce(description, F.lit("")))


def matches(text: Column, pattern: str) -> Column:
    """Case-insensitive, Unicode-aware regular-expression search."""
    return text.rlike("(?iU)" + pattern)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_extension(path: Column) -> Column:
    """Lower-cased extension with its dot; empty when there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.](\.[^.]*)$", 1))


def labelled(column: Column, labels: dict[str, str]) -> Column:
    """Replace codes by labels; a code without a label gives NULL."""
    return F.create_map(*[F.lit(x) for x in chain(*labels.items())])[column]


def reference_after(text: Column) -> Column:
    """First six-digit-or-longer number right after the word Referencia."""
    return F.nullif(F.regexp_extract(text, r"(?:^|\s)Referencia\s+(\d{6,})(?=\s|$)", 1), F.lit(""))


def reference_slash(text: Column) -> Column:
    """Code glued to a token that begins with ``/REF``."""
    return F.nullif(F.regexp_extract(text, r"(?:^|\s)/REF(\S+)", 1), F.lit(""))


def unquoted(text: Column) -> Column:
    """Trimmed text without surrounding single quotes; empty becomes NULL."""
    return F.nullif(F.regexp_replace(F.trim(text), r"^'+|'+$", ""), F.lit(""))
