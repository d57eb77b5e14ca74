"""Fill-in-the-middle samples: a text cut at two token borders and put in another order.

One ``fullmatch`` of ``(unit)*`` walks the whole text, and the regex library keeps every repetition
of its group: ``match.ends(1)`` holds the end of each unit, so its length is the number of units
and two look-ups in it are the cuts. No loop runs over units.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

UNIT = r"[A-Za-z]++|[^A-Za-z]"
FLUSH_CHARS = 4 << 20


class Rules(NamedTuple):
    """``fim_percent`` of the texts are rearranged, ``spm_percent`` of those with the suffix first."""

    seed: int = 1
    fim_percent: int = 90
    spm_percent: int = 20
    prefix_mark: str = "<P>"
    suffix_mark: str = "<S>"
    middle_mark: str = "<M>"
    unit: str = UNIT

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix_mark, self.suffix_mark, self.middle_mark


def draws(seed: int, row_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 that depend on the seed and the id only; a null id reads as empty."""
    told = hashlib.sha256(f"{seed}:{'' if row_id is None else row_id}".encode()).hexdigest()
    return tuple(int(told[i : i + 8], 16) for i in range(0, 32, 8))


def unit_ends(text: str, whole: regex.Pattern) -> list[int]:
    """The end of each unit, in code points."""
    return whole.fullmatch(text).ends(1)


def rearrange(text: str, row_id: int | None, rules: Rules, whole: regex.Pattern) -> tuple[int, str, int | None, int | None, str]:
    """``(n, form, prefix_chars, middle_chars, output)`` of one text."""
    ends, (h1, h2, h3, h4) = unit_ends(text, whole), draws(rules.seed, row_id)
    n = len(ends)
    if not text or any(mark in text for mark in rules.marks) or h3 % 100 >= rules.fim_percent:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    first, second = (ends[k - 1] if k else 0 for k in (low, high))
    prefix = rules.prefix_mark + text[:first]
    suffix = rules.suffix_mark + text[second:]
    spm = h4 % 100 < rules.spm_percent
    output = (suffix + prefix if spm else prefix + suffix) + rules.middle_mark + text[first:second]
    return n, "spm" if spm else "psm", first, second - first, output


def _batches(rules: Rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = regex.compile(f"({rules.unit})*+")
        for batch in batches:
            ids, texts = batch.columns
            made, chars, first = [], 0, 0
            for i in range(len(texts)):
                text = texts[i].as_py() or ""
                made.append(rearrange(text, ids[i].as_py(), rules, whole))
                chars += len(text)
                if chars > FLUSH_CHARS or i + 1 == len(texts):
                    n, form, prefix, middle, output = zip(*made)
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(first, len(made)), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                         pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                        names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])
                    made, chars, first = [], 0, i + 1

    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """``(id_col, n, form, prefix_chars, middle_chars, output)``, a row per input row; nothing is shuffled.

    ``n`` counts the units of the text. ``form`` is ``plain`` (the text as it is: empty, holding a
    mark, or drawn to stay so), ``psm`` or ``spm``. Null texts count as empty, a null id draws like
    an empty one, rows that repeat an id draw alike, other columns are ignored. One text is held
    at a time, with one integer per unit.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    made = own.mapInArrow(
        _batches(rules), "id long, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("id", id_col)


def restored(rules: Rules = Rules(), output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of. No mark can begin inside a part and end in the next mark."""
    def after(text: Column, mark: str) -> Column:
        return F.substring(text, F.instr(text, F.lit(mark)) + len(mark), F.length(text))

    def before(text: Column, mark: str) -> Column:
        return F.substring_index(text, mark, 1)

    text = F.col(output)
    prefix_first, suffix_first = after(text, rules.prefix_mark), after(text, rules.suffix_mark)
    psm_rest = after(prefix_first, rules.suffix_mark)
    spm_rest = after(suffix_first, rules.prefix_mark)
    return (
        F.when(F.col(form) == "plain", text)
        .when(F.col(form) == "psm", F.concat(
            before(prefix_first, rules.suffix_mark), after(psm_rest, rules.middle_mark), before(psm_rest, rules.middle_mark)))
        .otherwise(F.concat(
            before(spm_rest, rules.middle_mark), after(spm_rest, rules.middle_mark), before(suffix_first, rules.prefix_mark)))
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
    CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS low,
    greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS high,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
      THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (
  SELECT *, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle,
    array_to_string(units[high + 1:n], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
