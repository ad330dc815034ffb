"""Counts and weights of character n-grams inside a task, as packed numbers in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
#: Characters whose n-grams are held at a time.
SLICE = 400_000


def _spelled(ids: np.ndarray, codes: np.ndarray) -> pa.Array:
    """Strings of the rows of ``ids``, which are places in the code points ``codes``."""
    spelled = [chr(c).encode("utf-8", "surrogatepass") for c in codes]
    size = np.array([len(b) for b in spelled])
    table = np.frombuffer(b"".join(b.ljust(4, b"\0") for b in spelled), np.uint8).reshape(-1, 4)
    lengths = size[ids]
    ends = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum(lengths.sum(axis=1), out=ends[1:])
    width = int(size.max())
    data = table[ids][..., :width]
    data = data if width == 1 else data[np.arange(width) < lengths[..., None]]
    return pa.StringArray.from_buffers(len(ids), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))


def _counts(codes: np.ndarray, lengths: np.ndarray, sizes: Sequence[int]) -> Iterator[tuple]:
    """Per size (text, place, tf, terms): each distinct n-gram of each text, as a place in the terms, which
    are different for different places; ``codes`` are all texts in a row. Ordered by text, then by code points."""
    used = np.zeros(0x110000, dtype=np.int64)
    used[codes] = 1
    known = np.flatnonzero(used)
    used[known] = np.arange(len(known))
    ids, bits = used[codes], max(len(known) - 1, 1).bit_length()
    doc = np.repeat(np.arange(len(lengths)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # characters up to the end
    for n in sizes:
        at = np.flatnonzero(left >= n)
        if not len(at):
            continue
        gram, have = ids[at], bits
        for k in range(1, n):
            if have + bits >= 63:  # number what has been read so far
                gram, have = np.unique(gram, return_inverse=True)[1], len(at).bit_length()
            gram = (gram << bits) | ids[at + k]
            have += bits
        packed = bits * n < 63
        if have + len(lengths).bit_length() >= 63 or not packed:
            first_at, gram = np.unique(gram, return_index=True, return_inverse=True)[1:]
            have = len(at).bit_length()
        key = np.sort((doc[at] << have) | gram)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        tf, key = np.diff(first, append=len(key)), key[first]
        each = pa.array(key & ((1 << have) - 1)).dictionary_encode()  # each n-gram is spelled once
        found = np.asarray(each.dictionary)
        if have == bits * n and packed:
            spelled = found[:, None] >> bits * np.arange(n)[::-1] & ((1 << bits) - 1)
        else:
            spelled = ids[at[first_at[found]][:, None] + np.arange(n)]
        yield key >> have, np.asarray(each.indices), tf, _spelled(spelled, known)


def counted(texts: pa.Array, sizes: Sequence[int]) -> Iterator[tuple]:
    """(start, text, place, tf, terms) of a slice of the texts and a size at a time; null has no n-gram."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(np.asarray(pc.utf8_length(texts), dtype=np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE, side="right")))
        lengths = np.diff(ends[start:stop], prepend=before)
        joined = "".join(texts.slice(start, stop - start).to_pylist())
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        yield start, list(_counts(codes, lengths, sizes))
        start = stop


def totals(texts: pa.Array, sizes: Sequence[int]) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Per size and text that has n-grams, with the text's number: how many different ones, sum of their
    counts and of the counts' squares, first and last n-gram by code points."""
    for start, parts in counted(texts, sizes):
        for text, place, tf, terms in parts:
            first = np.flatnonzero(np.diff(text, prepend=-1))
            last = np.append(first[1:], len(text)) - 1
            yield start + text[first], pa.table({
                "n_terms": last - first + 1, "n_total": np.add.reduceat(tf, first),
                "n_squares": np.add.reduceat(tf * tf, first),
                "first_term": terms.take(pa.array(place[first])), "last_term": terms.take(pa.array(place[last])),
            })


def frequencies(texts: pa.Array, sizes: Sequence[int]) -> Iterator[pa.Table]:
    """(term, df, cf) of the texts, added up by slice."""
    for _, parts in counted(texts, sizes):
        for _, place, tf, terms in parts:
            yield pa.table({
                "term": terms, "df": np.bincount(place, minlength=len(terms)),
                "cf": np.bincount(place, weights=tf, minlength=len(terms)).astype(np.int64),
            })


def placed(texts: pa.Array, sizes: Sequence[int], terms: pa.Array) -> Iterator[tuple]:
    """(start, text, place, tf): how often each text of a slice has each known term, by its place in ``terms``."""
    for start, parts in counted(texts, sizes):
        rows = []
        for text, place, tf, grams in parts:
            at = np.asarray(pc.fill_null(pc.index_in(grams, value_set=terms), -1))[place]
            here = at >= 0
            rows.append((text[here], at[here], tf[here]))
        if rows:
            yield start, *(np.concatenate(x) for x in zip(*rows))


def weights(texts: pa.Array, sizes: Sequence[int], terms: pa.Array, idf: np.ndarray,
            sublinear: bool) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """(text, term, value) of the known terms, each text of Euclidean length 1, a slice at a time."""
    for start, owner, place, tf in placed(texts, sizes, terms):
        share = tf.astype(float)
        w = (1 + np.log(share) if sublinear else share) * idf[place]
        norm = np.sqrt(np.bincount(owner, weights=w * w))
        yield start + owner, terms.take(pa.array(place)), w / norm[owner]


def packed(texts: pa.Array, sizes: Sequence[int], terms: pa.Array, idf: np.ndarray) -> pa.Table:
    """Per text, in their order: places of its known terms, their counts, and the length of the weighted counts."""
    lens, norm, cells = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts)), []
    for start, owner, place, tf in placed(texts, sizes, terms):
        order = np.lexsort((place, owner))
        cells.append((place[order], tf[order]))
        n = np.bincount(owner)
        lens[start : start + len(n)] = n
        norm[start : start + len(n)] = np.sqrt(np.bincount(owner, weights=(tf * idf[place]) ** 2))
    ends = pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32())
    at, tf = (np.concatenate(x).astype(np.int32) for x in zip(*cells)) if cells else np.zeros((2, 0), np.int32)
    return pa.table({
        "at": pa.ListArray.from_arrays(ends, pa.array(at)), "tf": pa.ListArray.from_arrays(ends, pa.array(tf)), "norm": norm})
