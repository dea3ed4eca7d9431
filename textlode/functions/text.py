"""Column expressions for text rules: decoding, UTF-16 lengths, literal patterns, delta lists."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: One white-space character as the JVM's Character sees it: isWhitespace or isSpaceChar.
WHITESPACE = r"[\t-\r\x1c-\x1f\p{Z}]"
ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def lenient_text(content: Column) -> Column:
    """UTF-8 bytes as text; malformed sequences become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def strict_text(content: Column) -> Column:
    """UTF-8 bytes as text, null if malformed."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units; only texts with characters beyond the BMP are looked at twice."""
    return F.when(text.rlike(ASTRAL), F.length(text) + F.regexp_count(text, F.lit(ASTRAL))).otherwise(F.length(text))


def gap_widths(text: Column, pattern: str) -> Column:
    """UTF-16 lengths of what lies before, between and after the matches of a Java regular expression."""
    gaps = F.split(text, pattern, -1)
    return F.when(text.rlike(ASTRAL), F.transform(gaps, utf16_length)).otherwise(F.transform(gaps, F.length))


def quoted(term: str) -> str:
    """``term`` as a literal in a Java regular expression."""
    return r"\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E"


def deltas(positions: Column) -> Column:
    """Ascending numbers as the first and the differences between neighbours."""
    return F.transform(positions, lambda x, i: x - F.when(i > 0, F.get(positions, i - 1)).otherwise(F.lit(0)))


@F.arrow_udf(ArrayType(IntegerType()))
def _summed(lists: pa.Array) -> pa.Array:
    values, at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0)))
    sums = np.append(0, np.cumsum(values))
    out = sums[1:] - np.repeat(sums[at[:-1]], np.diff(at))
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(out, pa.int32()), mask=pa.array(lists.is_null()))


def undelta(values: Column) -> Column:
    """The numbers that ``deltas`` came from: running sums, of all lists of a batch at once."""
    return _summed(values)


def utf16_width(text: str) -> int:
    """Length of a string in UTF-16 code units."""
    return len(text) + sum(c > "\uffff" for c in text)


def extension_pattern(extensions: list[str]) -> str:
    return r"\.(" + "|".join(map(re.escape, extensions)) + ")$"
