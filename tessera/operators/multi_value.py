"""Several values packed in one field.

The values are found on the bytes of the Arrow string buffers: masks of the
delimiters, the parity of the quotes before each byte, and the places of the
next and previous byte that is no blank.  From these the offsets of the child
values are derived, and list arrays are built.  Only values with escapes, and
fields that mix both kinds of quotes, take a second look.

How a field is read:

* Blanks around the field have no meaning.  A field in square brackets is a
  list: both ``"`` and ``'`` quote, a backslash escapes.  Elsewhere only ``"``
  quotes, and two quotes within quotes stand for one.
* A quote opens only where a value begins and closes only where one ends, at a
  delimiter or the end; any other quote is a character of its value.  A quote
  that is never closed quotes to the end of the field.
* A delimiter outside quotes separates.  Each value loses blanks around it, a
  leading ``u`` before a quoted list element, its quotes and its escapes.
* Empty pieces aren't counted; positions are 1, 2, ...
* A null field, and one that only says that there is nothing (``NOTHING``),
  has no values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole fields, in small letters and without brackets, quotes and blanks, that name nothing.
NOTHING = ("", "-", "--", "n/a", "na", "nan", "nil", "none", "nothing", "null", "unknown")
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _inside_quotes(data: np.ndarray, row: np.ndarray, starts: np.ndarray, ends: np.ndarray, bracket: np.ndarray, is_delimiter: np.ndarray) -> np.ndarray:
    """Whether each byte is within quotes, the quotes themselves counted as within.

    A quote may open only where a value begins and close only where one ends.
    Of most rows all such quotes open and close in turn, and their parity tells;
    the others are read quote by quote.
    """
    size = len(data)
    at = np.arange(size)
    double, single = data == 34, (data == 39) & bracket[row]
    if bracket.any() and (slash := data == 92).any():
        # a quote after an odd number of backslashes is escaped, in lists
        last_other = np.maximum.accumulate(np.where(slash, -1, at))
        run = np.r_[0, (at - last_other)[:-1]]
        escaped = (run % 2 == 1) & bracket[row]
        double, single = double & ~escaped, single & ~escaped
    quote = double | single
    if not quote.any():
        return quote
    # two quotes in a row stand for one, outside lists: of an odd run the first opens or the last closes
    doubled = double & ~bracket[row]
    before = np.r_[False, doubled[:-1] & (row[1:] == row[:-1])]
    first = np.maximum.accumulate(np.where(doubled & ~before, at, -1))
    after = np.r_[doubled[1:] & (row[1:] == row[:-1]), False]
    last = np.minimum.accumulate(np.where(doubled & ~after, at, size)[::-1])[::-1]
    even = doubled & ((last - first) % 2 == 1)
    # the next byte to either side that is no blank, where a delimiter is none
    hard = ~_BLANK[data] | is_delimiter[data]
    left = np.r_[-1, np.maximum.accumulate(np.where(hard, at, -1))[:-1]]
    right = np.r_[np.minimum.accumulate(np.where(hard, at, size)[::-1])[::-1][1:], size]
    inner_start, inner_end = (starts + bracket)[row], (ends - bracket)[row]
    begins = lambda place, prior: (prior < inner_start[place]) | is_delimiter[data[np.maximum(prior, 0)]]
    opens = begins(at, left)
    prefix = bracket[row] & np.r_[False, np.isin(data[:-1], (117, 85))] & (at - 1 >= inner_start)
    opens |= prefix & np.r_[False, opens[:-1]]
    closes = (right >= inner_end) | is_delimiter[data[np.minimum(right, size - 1)]]
    opens &= ~before & ~even
    closes &= ~after & ~even
    place = np.flatnonzero(quote & (opens | closes))
    if not len(place):
        return np.zeros(size, bool)
    of = row[place]
    new = np.r_[True, of[1:] != of[:-1]]
    group = np.cumsum(new) - 1
    turn = np.arange(len(place)) - np.flatnonzero(new)[group]
    fits = np.where(turn % 2 == 0, opens[place], closes[place])
    same = np.r_[True, (data[place[1:]] == data[place[:-1]])] | (turn % 2 == 0)  # a quote closes only its own kind
    regular = np.bincount(group, fits & same) == np.bincount(group)
    real = np.zeros(size, bool)
    real[place[regular[group]]] = True
    odd = ~regular[group]
    if odd.any():
        real |= _opening_or_closing(data, place[odd], row, opens, closes)
    count = np.cumsum(real)
    base = np.r_[0, count][starts]
    return real | ((count - real - base[row]) % 2 == 1)


def _opening_or_closing(data: np.ndarray, at: np.ndarray, row: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
    """Of the quotes ``at`` those that open or close a value, row by row from the left.

    The k-th quotes of all rows are taken together, one step for each k.  A
    quote that opens and is never closed quotes to the end of the field.
    """
    rows, first, counts = np.unique(row[at], return_index=True, return_counts=True)
    real = np.zeros(len(data), bool)
    order = np.argsort(-counts, kind="stable")
    first, counts = first[order], counts[order]
    open_with = np.zeros(len(rows), data.dtype)
    for k in range(int(counts[0])):
        live = int(np.searchsorted(-counts, -k, "left"))  # rows with more than k quotes
        place = at[first[:live] + k]
        kind, now = data[place], open_with[:live]
        acts = np.where(now == 0, opens[place], (now == kind) & closes[place])
        real[place[acts]] = True
        open_with[:live] = np.where(acts, np.where(now == 0, kind, 0), now)
    return real


def _unescape(text: str, in_list: bool) -> str:
    if not in_list:
        return text.replace('""', '"')
    if "\\" not in text:
        return text
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c != "\\" or i + 1 == len(text):
            out.append(c)
            i += 1
            continue
        c, width = text[i + 1], {"u": 4, "x": 2, "U": 8}.get(text[i + 1], 0)
        code = text[i + 2 : i + 2 + width]
        if width and len(code) == width and all(d in "0123456789abcdefABCDEF" for d in code) and int(code, 16) < 0x110000:
            out.append(chr(int(code, 16)))
            i += 2 + width
        else:
            out.append(_ESCAPES.get(c, c))
            i += 2
    joined = "".join(out)
    return joined.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def split_array(texts: pa.Array, delimiters: str) -> pa.ListArray:
    """The values of each text, as a list; null and "nothing" give an empty list."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    texts = pc.utf8_trim_whitespace(texts)
    said = pc.utf8_lower(pc.utf8_trim(texts, " \t\r\n[]{}()\"'"))
    nothing = pc.is_in(said, pa.array(NOTHING))
    texts = pc.if_else(nothing, "", texts)
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32, n + 1, texts.offset * 4).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        return pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.string()))
    row = np.repeat(np.arange(n), np.diff(offsets))
    starts, ends = offsets[:-1], offsets[1:]
    filled = ends > starts
    bracket = np.zeros(n, bool)
    bracket[filled] = (data[starts[filled]] == 91) & (data[ends[filled] - 1] == 93) & (ends[filled] - starts[filled] > 1)
    is_delimiter = np.zeros(256, bool)
    is_delimiter[[ord(c) for c in delimiters]] = True
    inside = _inside_quotes(data, row, starts, ends, bracket, is_delimiter)
    cut = np.flatnonzero(is_delimiter[data] & ~inside)
    # pieces: from the row's start (after its bracket) or a delimiter to the next one
    inner_start, inner_end = starts + bracket, ends - bracket
    first = np.concatenate([inner_start, cut + 1])
    last = np.concatenate([inner_end, cut])
    piece_row = np.concatenate([np.arange(n), row[cut]])
    # a row's k-th piece begins at its k-th start and ends at its k-th end
    first, last = first[np.lexsort((first, piece_row))], last[np.lexsort((last, piece_row))]
    piece_row = np.sort(piece_row)
    # without blanks
    at = np.arange(len(data))
    solid = ~_BLANK[data]
    following = np.r_[np.minimum.accumulate(np.where(solid, at, len(data))[::-1])[::-1], len(data)]
    preceding = np.r_[0, np.maximum.accumulate(np.where(solid, at, -1)) + 1]
    first, last = np.minimum(following[first], last), preceding[last]
    keep = last > first
    first, last, piece_row = first[keep], last[keep], piece_row[keep]
    # without quotes
    in_list = bracket[piece_row]
    prefixed = in_list & (last - first > 2) & np.isin(data[first], (117, 85)) & np.isin(data[np.minimum(first + 1, len(data) - 1)], (34, 39))
    first = first + prefixed
    mark = data[first]
    quoted = (last - first > 1) & (mark == data[last - 1]) & ((mark == 34) | (mark == 39))
    first, last = first + quoted, last - quoted
    first = np.minimum(following[first], last)
    last = np.maximum(preceding[last], first)
    keep = last > first
    first, last, piece_row, in_list, quoted = first[keep], last[keep], piece_row[keep], in_list[keep], quoted[keep]
    length = last - first
    child = np.r_[0, np.cumsum(length)]
    taken = data[np.arange(child[-1]) - np.repeat(child[:-1] - first, length)]
    values = pa.Array.from_buffers(pa.string(), len(length), [None, pa.py_buffer(child.astype(np.int32)), pa.py_buffer(taken)])
    # with escapes
    marks = np.r_[0, np.cumsum((data == 92) | (data == 34))]
    odd = np.flatnonzero((marks[last] > marks[first]) & quoted)
    if len(odd):
        clean = [_unescape(values[i].as_py(), bool(in_list[i])) for i in odd]
        mask = np.zeros(len(values), bool)
        mask[odd] = True
        values = pc.replace_with_mask(values, pa.array(mask), pa.array(clean, pa.string()))
    if data.max(initial=0) > 127:  # blanks beyond ASCII
        values = pc.utf8_trim_whitespace(values)
        full = pc.greater(pc.binary_length(values), 0)
        values, piece_row = values.filter(full), piece_row[full.to_numpy(zero_copy_only=False)]
    lists = np.r_[0, np.cumsum(np.bincount(piece_row, minlength=n))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(lists), values)


def packed_values(df: DataFrame, record_id: Column, field: Column, delimiters: str) -> DataFrame:
    """``record_id, pos, value``: one row per value of the packed ``field``.

    Positions count from 1 within the field.  Rows without values give none;
    repeated rows give repeated results.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = split_array(batch.column(1), delimiters)
            parent = pc.list_parent_indices(lists)
            offsets = lists.offsets.to_numpy()
            pos = np.arange(len(parent)) - np.repeat(offsets[:-1], np.diff(offsets)) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(parent), pa.array(pos, pa.int64()), lists.flatten()], names=["record_id", "pos", "value"])

    source = df.select(record_id.cast("string").alias("record_id"), field.cast("string").alias("field"))
    return source.where(F.col("field").isNotNull()).mapInArrow(split, "record_id string, pos bigint, value string")
