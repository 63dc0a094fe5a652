"""Fill-in-middle transformation by a pyarrow.compute pipeline.

Texts of a batch are split into units as list arrays (a word with the white space before it; white space at the
end is a unit of its own). The lists are flattened beside their parent's index, each unit gets its ordinal, the
two cuts of its text give it a role (prefix, middle, suffix), units are filtered by role, lists are rebuilt from
their counts, and ``binary_join`` makes the pieces. No step looks at a single text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches

SPACES, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
MARKS = ("<P>", "<S>", "<M>")


def unit_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All units of a batch flattened, the index of each unit's text, and the number of units of each text."""
    gaps = pc.split_pattern_regex(texts, WORD)  # one more than there are words: before, between, after
    parents = pc.list_parent_indices(gaps).to_numpy()
    n_words = pc.list_value_length(gaps).to_numpy() - 1
    words = pc.list_flatten(pc.split_pattern_regex(texts, SPACES))
    words = words.filter(pc.not_equal(words, ""))
    spaces = pc.list_flatten(gaps)
    ordinal = np.arange(len(spaces)) - np.repeat(np.cumsum(n_words + 1) - (n_words + 1), n_words + 1)
    after = ordinal == n_words[parents]
    at = np.repeat(np.cumsum(n_words) - n_words, n_words + 1) + ordinal
    follows = pc.fill_null(words.take(pa.array(at, mask=after)), "")
    real = ~after | pc.not_equal(spaces, "").to_numpy(zero_copy_only=False)
    units = pc.binary_join_element_wise(spaces, follows, "").filter(pa.array(real))
    parents = parents[real]
    return units, parents, np.bincount(parents, minlength=len(texts))


def joined(units: pa.Array, parents: np.ndarray, chosen: np.ndarray, n: int) -> pa.Array:
    """The chosen units of each of ``n`` texts as one string: lists rebuilt from their counts, then joined."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(parents[chosen], minlength=n))]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), units.filter(pa.array(chosen))), "")


def _transform(percent: int, spm_percent: int, marks: Sequence[str], schema: pa.Schema):
    p, s, m = marks
    marked = "|".join(map(re.escape, marks))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            texts = pc.fill_null(batch.column(1).cast(pa.string()), "")
            h1, h2, h3, h4 = (batch.column(i).to_numpy() for i in range(2, 6))
            units, parents, n = unit_lists(texts)
            ordinal = np.arange(len(units)) - np.repeat(np.cumsum(n) - n, n)
            low, high = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))
            role = (ordinal >= low[parents]).astype(np.int8) + (ordinal >= high[parents])
            prefix, middle, suffix = (joined(units, parents, role == r, len(texts)) for r in range(3))
            plain = (n == 0) | (h3 % 100 >= percent) | pc.match_substring_regex(texts, marked).to_numpy(zero_copy_only=False)
            spm = h4 % 100 < spm_percent
            is_plain, is_spm = pa.array(plain), pa.array(spm)
            in_psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, "")
            in_spm = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, "")
            out = [
                batch.column(0),
                pa.array(n, type=pa.int64()),
                pc.if_else(is_plain, "plain", pc.if_else(is_spm, "spm", "psm")),
                *[pc.if_else(is_plain, pa.scalar(None, pa.int64()), pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)],
                pc.if_else(is_plain, texts, pc.if_else(is_spm, in_spm, in_psm)),
            ]
            yield pa.RecordBatch.from_arrays(out, schema=schema)

    return run


def fill_in_middle(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 42,
    percent: int = 50,
    spm_percent: int = 80,
    marks: Sequence[str] = MARKS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n, form, prefix_chars, middle_chars, output``.

    ``n`` counts units. Cuts and form come from the first four 8-digit groups h1 to h4 of the hex SHA-256 of
    ``seed:doc_id``: the prefix ends after ``min(h1 % (n+1), h2 % (n+1))`` units, the middle after the larger.
    A text is left as it is (``plain``, lengths NULL) if it is empty, holds a mark, or ``h3 % 100 >= percent``;
    else it is ``spm`` (suffix, prefix, middle) if ``h4 % 100 < spm_percent``, else ``psm``.

    NULL texts are empty. Rows without an id draw as ``seed:``. Equal rows give equal rows, as there is no other
    state: each row is made from itself alone, without a shuffle, in slices of about 8 MB; columns other than the
    two named are ignored. An empty table gives an empty one. Marks must not begin with what another ends with.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    drawn = named.select("doc_id", "text", *[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)])
    return drawn.mapInArrow(
        _transform(percent, spm_percent, marks, schema), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restored(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text that ``fill_in_middle`` made ``output`` of: pieces lie between the first places of the marks.

    No text in ``spm`` or ``psm`` form holds a mark, and no mark overlaps another, so the first place is the mark itself.
    """
    p, s, m = marks

    def pieces(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(rest, second, 1)
        rest = F.substr(rest, F.length(one) + len(second) + 1)
        two = F.substring_index(rest, m, 1)
        return one, two, F.substr(rest, F.length(two) + len(m) + 1)

    prefix, suffix, middle = pieces(p, s)
    suffix_first, prefix_second, middle_last = pieces(s, p)
    return (
        F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_second, middle_last, suffix_first)).otherwise(output)
    )


def fill_in_middle_digests(docs: DataFrame, **options) -> DataFrame:
    """The same rows with ``output_sha256`` and, of the text rebuilt from output and form, ``restored_sha256``."""
    out = fill_in_middle(docs, **options)
    back = restored(F.col("output"), F.col("form"), options.get("marks", MARKS))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    )


SPACES_OR_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"

#: the query in DuckDB: units by one regular expression, pieces by list slices
ORACLE = f"""
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
           regexp_extract_all(coalesce(text, ''), '{SPACES_OR_WORD}') AS units FROM documents),
numbers AS (
    SELECT doc_id, text, units, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
           ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM drawn),
cuts AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM numbers),
pieces AS (
    SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM cuts)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM pieces
"""
