"""Text helpers with the whitespace rules of Python strings, as built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.constants import STOP_WORDS, TOKENS_PER_WORD

# Everything Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0            "
    "    　"
)
_WORD_GAP = r"(?U)[\s\x1c-\x1f]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def blank_to_null(text: Column) -> Column:
    """Regular-expression functions give '' where there is no match."""
    return F.nullif(text, F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(strip(text), _WORD_GAP), "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def tokens_of_words(n: Column) -> Column:
    return (n * F.lit(TOKENS_PER_WORD)).cast("int")


def estimate_tokens(text: Column) -> Column:
    return tokens_of_words(word_count(text))


def squeeze(text: Column) -> Column:
    """Collapse every run of whitespace to one blank."""
    return F.array_join(words(text), " ")


def overlap_tail(text: Column, n: int) -> Column:
    """The last ``n`` words joined by blanks; the text as it is when it has no more than that."""
    return let(
        words(text),
        lambda w: F.when(F.size(w) <= n, text).otherwise(F.array_join(F.slice(w, -n, n), " ")),
    )


def split_sections(text: Column, sep: str = "\n\n") -> Column:
    parts = F.split(text, r"\Q" + sep + r"\E")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def runs_of_letters(text: Column) -> Column:
    """Lower-cased alphanumeric runs, stop words and the empty strings at either end among them."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def terms(text: Column) -> Column:
    """Lower-cased alphanumeric terms without English stop words, repeats kept."""
    return F.filter(runs_of_letters(text), lambda t: ~t.isin(["", *STOP_WORDS]))


def numbered_terms(runs: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The terms among ``runs_of_letters`` of a batch of texts: the row and the number of each, and the distinct runs by number.

    Each distinct run of the batch is looked up once.
    """
    found = runs.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(runs)), pc.fill_null(pc.list_value_length(runs), 0).to_numpy())
    number = found.indices.to_numpy(zero_copy_only=False)
    kept = pc.invert(pc.is_in(found.dictionary, pa.array(["", *STOP_WORDS]))).to_numpy(zero_copy_only=False)
    is_term = kept[number]
    return row[is_term], number[is_term].astype(np.int64), found.dictionary


def content_hash(data: Column) -> Column:
    """SHA-256 of bytes or of UTF-8 text, as lower-case hex."""
    return F.sha2(data, 256)


def last_part(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased suffix of the file name; '' for names such as 'a', '.a' and 'a.'."""
    return F.lower(F.regexp_extract(last_part(path), r"(?s)^.+(\.[^.]+)$", 1))
