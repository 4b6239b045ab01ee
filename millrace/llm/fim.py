"""Fill-in-the-middle: documents with their middle moved to the end, and back.

A text is cut into tokens (white space with the word after it, or white space at the end); two cuts
between tokens make it prefix, middle and suffix. Inside a task one ``bytearray`` per text is scanned
for the cuts, gets the sentinels in front of the three segments where they stand, and then two
neighbouring blocks change places by three reversals: each block is reversed, then both together.
Nothing is copied apart from the buffer itself. ``restore`` finds the sentinels, applies the inverse
rotation and takes them out, which gives the exact text.

| form | buffer before | blocks that change places | after |
|---|---|---|---|
| psm | P prefix M middle S suffix | (M middle)(S suffix) | P prefix S suffix M middle |
| spm | P prefix M middle S suffix | (P prefix M middle)(S suffix) | S suffix P prefix M middle |
| plain | the text | none | the text |

Form and cuts come from SHA-256 of ``seed:id``, so they are the same on every attempt and for any
partitioning.

Defined results: a null text counts as empty; an empty text, or one that holds a sentinel, is plain; a
null id counts as no digits. Rows are treated one by one: repeated rows, ties and equal ids with
different texts are no special case. Texts without white space are one token, texts of white space
only too. Texts of any length are handled whole, in memory of a few times one text. All columns are
kept; columns with the names of the results are replaced. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.util import check_columns, col, fresh, require

# The sentinels.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
_ROWS = 256        # rows of a batch at most
_BYTES = 16 << 20  # a batch of results ends beyond


def token_ends(data: np.ndarray) -> np.ndarray:
    """The byte positions behind each token: behind every word, and at the end of the text."""
    blank = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    last = ~blank
    last[:-1] &= blank[1:]
    if len(data):
        last[-1] = True
    return np.flatnonzero(last) + 1


def draws(seed: int, identifier: int | None) -> list[int]:
    """Four numbers of 32 bits."""
    digits = "" if identifier is None else str(identifier)
    hexes = hashlib.sha256(f"{seed}:{digits}".encode()).hexdigest()
    return [int(hexes[8 * i:8 * i + 8], 16) for i in range(4)]


def _reverse(buffer: np.ndarray, a: int, b: int) -> None:
    """Reverse ``buffer[a:b]`` in place."""
    half = (b - a) // 2
    left, right = buffer[a:a + half], buffer[b - half:b]
    for at in range(0, half, 1 << 16):  # a block at a time, so that no segment is copied
        x = left[at:at + (1 << 16)]
        y = right[len(right) - at - len(x):len(right) - at]
        kept = x[::-1].copy()
        x[:] = y[::-1]
        y[:] = kept


def rotate(buffer: np.ndarray, a: int, b: int, c: int) -> None:
    """Let the blocks [a, b) and [b, c) change places by three reversals."""
    _reverse(buffer, a, b)
    _reverse(buffer, b, c)
    _reverse(buffer, a, c)


def _code_points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def transform_text(text: bytes, drawn: list[int], rate: int, spm_share: int) -> dict:
    """The output, its form and what is known of the cuts of one text."""
    data = np.frombuffer(text, dtype=np.uint8)
    ends = token_ends(data)
    n = len(ends)
    if not n or drawn[2] % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return {"n": n, "form": PLAIN, "prefix_chars": None, "middle_chars": None, "output": text}
    low, high = (int(ends[units - 1]) if units else 0
                 for units in sorted((drawn[0] % (n + 1), drawn[1] % (n + 1))))
    form = SPM if drawn[3] % 100 < spm_share else PSM
    out = bytearray(text)
    out[high:high] = SUFFIX
    out[low:low] = MIDDLE
    out[0:0] = PREFIX
    middle, suffix = low + len(PREFIX), high + len(PREFIX) + len(MIDDLE)
    rotate(np.frombuffer(out, dtype=np.uint8), 0 if form == SPM else middle, suffix, len(out))
    return {"n": n, "form": form, "prefix_chars": _code_points(data[:low]),
            "middle_chars": _code_points(data[low:high]), "output": out}


def restore_text(output: bytes, form: str) -> bytes | bytearray:
    """The text that an output was made from: the inverse rotation, without the sentinels."""
    if form == PLAIN:
        return output
    require(form in (PSM, SPM), f"unknown form: {form}")
    start = 0 if form == SPM else output.find(SUFFIX)
    suffix_end = output.find(PREFIX if form == SPM else MIDDLE)
    require(output.startswith(SUFFIX if form == SPM else PREFIX) and 0 <= start < suffix_end,
            "the sentinels are not where the form puts them")
    out = bytearray(output)
    # The suffix comes first now; after the rotation it is the second block again.
    rotate(np.frombuffer(out, dtype=np.uint8), start, suffix_end, len(out))
    suffix = len(out) - (suffix_end - start)
    middle = out.find(MIDDLE)
    require(0 < middle < suffix, "the sentinels are not where the form puts them")
    del out[suffix:suffix + len(SUFFIX)]
    del out[middle:middle + len(MIDDLE)]
    del out[:len(PREFIX)]
    return out


def _add(df: DataFrame, sources: list[str], made: T.StructType, function) -> DataFrame:
    """Add the columns ``made``, computed from the values of ``sources`` of each row."""
    kept = df.drop(*[c for c in made.names if c in df.columns and c not in sources])
    inputs = [f for f in kept.schema.fields if f.name not in made.names]
    schema = T.StructType([*inputs, *made.fields])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(made)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                rows, size = [], 0
                values = [whole.column(c).slice(at, _ROWS) for c in sources]
                for cells in zip(*values):
                    rows.append(function(*[c.as_py() for c in cells]))
                    size += sum(len(v) for v in rows[-1].values() if hasattr(v, "__len__"))
                    if size > _BYTES:
                        break
                batch = whole.slice(at, len(rows))
                at += len(rows)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(f.name) for f in inputs],
                     *[pa.array([r[f.name] for r in rows], f.type) for f in arrow]],
                    names=schema.names)
    return kept.mapInArrow(run, schema)


def transform(df: DataFrame, identifier: str = "doc_id", text: str = "text", seed: int = 42,
              rate: int = 50, spm_share: int = 80) -> DataFrame:
    """Add n (tokens), form, prefix_chars, middle_chars (null if plain) and output.

    ``rate`` percent of the texts are transformed, ``spm_share`` percent of these to suffix, prefix,
    middle, the others to prefix, suffix, middle.
    """
    check_columns(df, [identifier, text])
    require(0 <= rate <= 100 and 0 <= spm_share <= 100, "shares are percentages")
    made = T.StructType.fromDDL(
        "n long, form string, prefix_chars long, middle_chars long, output binary")
    require(not {identifier, text} & set(made.names), "the results need columns of their own")
    raw = fresh(df, "_raw")

    def one(key, data):
        return transform_text(data or b"", draws(seed, key), rate, spm_share)
    carried = df.withColumn(raw, col(text).cast("binary"))
    out = _add(carried, [identifier, raw], made, one).drop(raw)
    return out.withColumn("output", F.col("output").cast("string"))


def restore(df: DataFrame, output: str = "output", form: str = "form",
            into: str = "restored") -> DataFrame:
    """Add the text that each output was made from."""
    check_columns(df, [output, form])
    require(into not in (output, form), "the result needs a column of its own")
    raw = fresh(df, "_raw")
    carried = df.withColumn(raw, col(output).cast("binary"))
    out = _add(carried, [raw, form], T.StructType().add(into, T.BinaryType()),
               lambda data, kind: {into: restore_text(data or b"", kind or PLAIN)}).drop(raw)
    return out.withColumn(into, F.col(f"`{into}`").cast("string"))
