"""Language-model scores from n-gram tries in Elias-Fano code.

Unigrams are smoothed counts of all training tokens. An n-gram's probability is its discounted share
in its context plus what the context leaves, times the shorter probability; so each context's
probabilities sum to one. Every n-gram counts. The contexts are dealt by hash: a bucket holds the
trie of its contexts, and each slice of texts sends it the n-grams that it needs, with how often it
has them in training texts. What comes back is exact; neither the driver nor a task holds more than
a slice, a bucket, and the few contexts that are so frequent that their n-grams go to all buckets.
"""

from __future__ import annotations

import mmap
import pickle
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.llm.common import bounds, held_out, let_go, plain, slices, sums, words_of
from inkprint.llm.eliasfano import EliasFano
from inkprint.session import default_partitions, materialize

FOLDS = 10
ORDER = 3
ADD = 0.1
DISCOUNT = 0.5
#: Share of the training tokens under which n-grams don't count: none.
SHARE = 0.0
#: A trie made by ``build`` holds 2**WORD_BITS entries a level at most.
WORD_BITS = 22
CODES = 4096
SLICE = 8 << 20
#: Words that are sent as numbers, the most frequent first; others are sent as their hashes.
NUMBERED = 1 << 20
#: A slice names a word for that list if it holds it so often.
REPEATED = 4
#: Buckets to a shuffle partition; share of the tokens from which a context goes to all buckets.
SPREAD = 4
HOT = 2.0**-11
NEXT_BITS = 48
END = xxhash.xxh64_intdigest(b"\n")


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct tokens, the token of every place, and the number per text.

    Tokens are lower-cased words and one end per text; a line feed, which no word holds, stands
    for the end."""
    words, per = words_of(plain(texts))
    coded = words.dictionary_encode()
    names = np.array(
        [xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()] + [END], np.uint64
    )
    places = np.full(len(words) + len(per), len(names) - 1, dtype=np.int64)
    places[np.arange(len(words)) + np.repeat(np.arange(len(per)), per)] = np.asarray(coded.indices)
    return names, places, per + 1


def _quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A book of at most CODES values, exact if there are no more, and the code of each value."""
    book = np.unique(values)
    if len(book) > CODES:
        book = np.unique(np.quantile(book, np.linspace(0, 1, CODES)))
    at = np.clip(np.searchsorted(book, values), 1, max(1, len(book) - 1))
    if len(book) > 1:
        at -= values - book[at - 1] < book[np.minimum(at, len(book) - 1)] - values
    else:
        at = np.zeros(len(values), dtype=np.int64)
    return book.astype(np.float64), at.astype(np.uint16)


@dataclass
class Trie:
    """Words by hash, and per level the frequent n-grams as context * 2**WORD_BITS + word.

    The successors of a context lie together, in the order of their words, so a search starts at the
    context's own run. ``total`` and ``kinds`` are N and V of the training tokens.
    """

    total: int
    kinds: int
    words: EliasFano
    count: np.ndarray
    levels: list[EliasFano]
    books: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + ADD) / (self.total + ADD * (self.kinds + 1)))

    def known(self, names: np.ndarray) -> np.ndarray:
        return self.words.find(names)

    def contexts(self, word: np.ndarray, first: np.ndarray, levels: int) -> np.ndarray:
        """Number of the frequent n-gram of ``levels`` words that ends at each place, -1 for none."""
        gram = word
        for level in range(levels - 1):
            gram = self._next(level, self._before(gram, first), word)
        return gram

    @staticmethod
    def _before(gram: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = np.full(len(gram), -1, dtype=np.int64)
        out[1:] = gram[:-1]
        out[first] = -1
        return out

    def _next(self, level: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = np.full(len(word), -1, dtype=np.int64)
        both = np.flatnonzero((context >= 0) & (word >= 0))
        keys = (context[both].astype(np.uint64) << np.uint64(WORD_BITS)) | word[both].astype(np.uint64)
        out[both] = self.levels[level].find(keys)
        return out

    def score(self, word: np.ndarray, first: np.ndarray, own: np.ndarray) -> np.ndarray:
        """log10 probability of every place, without the unigram part of words outside the trie.
        ``own`` is the unigram part of the others, 0 for words outside."""
        out, gram = own.copy(), word
        for level in range(len(self.levels)):
            context = self._before(gram, first)
            gram = self._next(level, context, word)
            prob_book, prob, left_book, left = self.books[level]
            backed = np.flatnonzero(context >= 0)
            out[backed] += left_book[left[context[backed]]]
            hit = np.flatnonzero(gram >= 0)
            out[hit] = prob_book[prob[gram[hit]]]
        return out

    def packed(self) -> bytes:
        arrays = [np.array([self.total, self.kinds, len(self.levels)], dtype=np.int64), self.count]
        for part in [self.words, *self.levels]:
            arrays += part.parts()
        for book in self.books:
            arrays += book
        return pickle.dumps([(a.dtype.str, a.tobytes()) for a in arrays])

    @staticmethod
    def mapped(blob: bytes) -> Trie:
        """The levels as views of a mapped file, which is unlinked at once."""
        raw = pickle.loads(blob)
        with tempfile.TemporaryFile() as file:
            places = []
            for kind, data in raw:
                places.append((file.tell(), len(data), kind))
                file.write(data + b"\0" * (-len(data) % 8))
            file.write(b"\0" * 8)
            file.flush()
            view = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        arrays = [np.frombuffer(view, dtype=k, count=n // np.dtype(k).itemsize, offset=a) for a, n, k in places]
        total, kinds, depth = arrays[0].tolist()
        parts = [EliasFano.from_parts(arrays[2 + 4 * k : 6 + 4 * k]) for k in range(depth + 1)]
        rest = arrays[6 + 4 * depth :]
        books = [tuple(rest[4 * k : 4 * k + 4]) for k in range(depth)]
        return Trie(total, kinds, parts[0], arrays[1], parts[1:], books)


def _frequent(counted: DataFrame, key: str, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys in rising order and counts of what occurs at least ``least`` times: 1 / share rows at most."""
    rows = counted.where(F.col("n") >= least).select(key, "n").toArrow()
    keys = np.asarray(rows.column(key), dtype=np.int64).astype(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.asarray(rows.column("n"), dtype=np.int64)[order]


def _counts(texts: DataFrame, share, column: str) -> DataFrame:
    """Sums over all tasks of the (key, n) that ``share`` makes of a batch of texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            keys, n = share(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=[column, "n"]
            )

    counted = texts.select("text").mapInArrow(work, f"{column} long, n long")
    return counted.groupBy(column).agg(F.sum("n").alias("n"))


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n): how often each token, by its hash, stands in the texts."""

    def share(batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        names, places, _ = tokens(batch)
        return names, np.bincount(places, minlength=len(names))

    return materialize(_counts(texts, share, "word").where("n > 0"))


def build(texts: DataFrame, words: DataFrame, order: int = ORDER, share: float = SHARE) -> Trie:
    """One trie of the n-grams that hold the share at least, for callers that have few enough; scores
    of whole corpora don't use it. A level's n-grams are counted only behind frequent contexts, which
    loses none, since an n-gram isn't more frequent than its context."""
    whole = words.agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).first()
    total, least = whole["total"] or 0, max(1, ceil(share * (whole["total"] or 0)))
    keys, count = _frequent(words, "word", least)
    trie = Trie(total, whole["kinds"], EliasFano.of(keys), count, [], [])
    above = count
    lower = trie.unigram(count)  # log10 probability of each entry's last word in the shorter context
    last, shorter = np.arange(len(keys)), None
    for level in range(order - 1):
        sent = texts.sparkSession.sparkContext.broadcast(trie.packed())

        def grams(batch: pa.Array, sent=sent, level=level) -> tuple[np.ndarray, np.ndarray]:
            now = load(sent)
            names, places, per = tokens(batch)
            word = now.known(names)[places]
            first = bounds(per)[:-1]
            context = now._before(now.contexts(word, first, level + 1), first)
            both = (context >= 0) & (word >= 0)
            made = (context[both].astype(np.uint64) << np.uint64(WORD_BITS)) | word[both].astype(np.uint64)
            return np.unique(made, return_counts=True)

        keys, n = _frequent(_counts(texts, grams, "gram"), "gram", least)
        context = (keys >> np.uint64(WORD_BITS)).astype(np.int64)
        word = (keys & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
        part = (n - DISCOUNT) / above[context]
        left = 1 - np.bincount(context, part, minlength=len(above))
        # probability of the word in the context without its first word
        if level == 0:
            tail = 10 ** lower[word]
        else:
            tail = 10 ** trie_probability(trie, last[context], word, lower)
        prob = np.log10(part + left[context] * tail)
        weight = np.log10(np.maximum(left, 1e-12))
        trie.levels.append(EliasFano.of(keys))
        prob_book, prob_code = _quantised(prob)
        left_book, left_code = _quantised(weight)
        trie.books.append((prob_book, prob_code, left_book, left_code))
        above, last = n, word
        if not len(keys):
            break
    return trie


def trie_probability(trie: Trie, before: np.ndarray, word: np.ndarray, unigram: np.ndarray) -> np.ndarray:
    """log10 probability of words after single words, for the second level of a trie that has one."""
    flat = np.column_stack([before, word]).reshape(-1)
    own = unigram[flat]
    return trie.score(flat, np.arange(0, len(flat), 2), own)[1::2]


_LOADED: list[tuple[bytes, Trie]] = []


def load(sent) -> Trie:
    """The trie of a broadcast, mapped once per worker."""
    blob = sent.value
    if not _LOADED or _LOADED[0][0] is not blob:
        _LOADED[:] = [(blob, Trie.mapped(blob))]
    return _LOADED[0][1]


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _planes(values: np.ndarray) -> bytes:
    """Numbers below 2**24 as their low, middle and high bytes, which compress better apart."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes()


def _squeezed(parts: list[bytes]) -> bytes:
    whole = b"".join(parts)
    return len(whole).to_bytes(8, "little") + pa.compress(whole, codec="zstd", asbytes=True)


def _small(values: np.ndarray) -> bytes:
    """Counts in a byte each, those from 255 on behind them in eight."""
    values = values.astype(np.int64)
    return np.minimum(values, 255).astype(np.uint8).tobytes() + values[values >= 255].tobytes()


class _Reader:
    """Reads what ``_squeezed`` holds."""

    def __init__(self, data: bytes):
        self.data = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
        self.at = 0

    def take(self, kind, n: int) -> np.ndarray:
        out = np.frombuffer(self.data, kind, n, self.at)
        self.at += out.nbytes
        return out

    def planes(self, n: int) -> np.ndarray:
        low, middle, high = self.take(np.uint8, 3 * n).reshape(3, n).astype(np.int64)
        return low | middle << 8 | high << 16

    def small(self, n: int) -> np.ndarray:
        out = self.take(np.uint8, n).astype(np.int64)
        large = out == 255
        out[large] = self.take(np.int64, int(large.sum()))
        return out


class _Slice:
    """The n-grams of some texts, and how they are dealt to buckets.

    ``contexts`` are all words and n-grams below the highest order, in levels; ``at[m]`` numbers the
    n-gram of m + 1 words that ends at each place inside its level, -1 for none. A context stands in the
    bucket of the context before its last word, so that it tells what follows that one; behind a hot
    context each is dealt by itself. Pairs, a context and the word after it, are those of the highest order. An
    entry is a context in a bucket: its own, and for a hot one also every bucket that gets a pair of it.
    """

    def __init__(self, names, places, per, held, order: int, hot: np.ndarray, buckets: int):
        self.places, self.ends, size = places, bounds(per), len(names)
        whole = np.uint64(buckets)
        deal = lambda h: ((h >> np.uint64(32)) * whole >> np.uint64(32)).astype(np.int64)
        first, train = self.ends[:-1], np.repeat(~held, per)
        hashes, self.at, counts = names, [places], [np.bincount(places[train], minlength=size)]
        self.names, self.base, contexts, bucket_of = names, [0], [names], [deal(names)]
        self.spelled = [np.arange(size, dtype=np.int32)[:, None]]  # the words of the contexts of each level
        is_hot, context, word, times = np.isin(names, hot), None, None, None
        for level in range(1, order):
            before = Trie._before(self.at[-1], first)
            where = np.flatnonzero(before >= 0)
            keys, number = np.unique(before[where] * size + places[where], return_inverse=True)
            now = np.full(len(places), -1, dtype=np.int64)
            now[where] = number
            self.at.append(now)
            context, word = np.divmod(keys, size)
            times = np.bincount(number[train[where]], minlength=len(keys))
            self.base.append(self.base[-1] + len(contexts[-1]))
            if level < order - 1:
                hashes = _mixed(hashes[context], names[word])
                contexts.append(hashes)
                counts.append(times)
                bucket_of.append(np.where(is_hot[context], deal(hashes), bucket_of[-1][context]))
                is_hot = np.isin(hashes, hot)
                self.spelled.append(np.column_stack([self.spelled[-1][context], word.astype(np.int32)]))
        self.words, self.contexts, self.counts = size, np.concatenate(contexts), np.concatenate(counts)
        self.hot = np.isin(self.contexts, hot)
        n = len(self.contexts)
        own = np.concatenate(bucket_of) * n + np.arange(n)
        if context is None:
            keys = self.pair_times = self.pair_number = self.pair_word = np.zeros(0, dtype=np.int64)
        else:
            spread, context = np.flatnonzero(is_hot[context]), context + self.base[-2]
            bucket = own[context] // n
            bucket[spread] = deal(_mixed(self.contexts[context[spread]], names[word[spread]]))
            keys = bucket * n + context
            self.pair_number = np.argsort(keys, kind="stable")
            keys, self.pair_word, self.pair_times = (x[self.pair_number] for x in (keys, word, times))
        entries = np.unique(np.concatenate([own, keys]))
        self.bucket, self.context = np.divmod(entries, n)
        self.home = np.searchsorted(entries, own)
        self.pairs = np.bincount(np.searchsorted(entries, keys), minlength=len(entries))

    def asks(self, numbered: np.ndarray, numbers: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """Each bucket and what it is asked: entries of each level, pairs, words that are spelled as hashes; then the words
        of the entries, level by level and place by place, and of the pairs, as numbers; those
        hashes; and the counts of the entries, their pairs and these pairs' counts.
        ``numbered`` are the hashes of the words that have one, in order, ``numbers`` these numbers from 1."""
        at = np.searchsorted(numbered, self.names)
        at[at == len(numbered)] = 0
        number = np.where(numbered[at] == self.names, numbers[at], 0) if len(numbered) else np.zeros(len(self.names), np.int64)
        counts = np.zeros(len(self.context), dtype=np.int64)
        counts[self.home] = self.counts
        cuts = np.append(np.flatnonzero(np.diff(self.bucket, prepend=-1)), len(self.bucket))
        ends, levels = bounds(self.pairs), np.append(self.base[: len(self.spelled)], len(self.contexts))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            p = slice(ends[a], ends[b])
            by_level = np.searchsorted(self.context[a:b], levels) + a
            words = [
                column for spelled, base, x, y in zip(self.spelled, levels, by_level[:-1], by_level[1:])
                for column in spelled[self.context[x:y] - base].T
            ] + [self.pair_word[p]]
            rare = np.concatenate([w[number[w] == 0] for w in words])
            head = [len(self.spelled), *np.diff(by_level), ends[b] - ends[a], len(rare)]
            # only contexts of the last level have pairs
            yield int(self.bucket[a]), _squeezed([
                np.array(head, dtype=np.int64).tobytes(), *(_planes(number[w]) for w in words), self.names[rare].tobytes(),
                _small(counts[a:b]), _small(self.pairs[by_level[-2] : b]), _small(self.pair_times[p]),
            ])

    def told(self, answers: list[bytes], known: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
        """Count, kinds and tokens left out of each context, and counts of the highest n-grams. ``answers``
        are in the order of buckets; ``known`` has the sums of hot contexts."""
        parts = [[], [], [], []]
        for data in answers:
            read = _Reader(data)
            n, pairs = read.take(np.int64, 2).tolist()
            for part, size in zip(parts, (n, n, n, pairs)):
                part.append(read.small(size))
        count, kinds, out, high = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts)
        sums_of = [x[self.home] for x in (count, kinds, out)]
        at = np.searchsorted(known["context"], self.contexts[self.hot])
        for x, name in zip(sums_of, ("n", "kinds", "dropped")):
            x[self.hot] = known[name][at]
        grams = np.zeros(len(high), dtype=np.int64)
        grams[self.pair_number] = high
        return (*sums_of, grams)

    def scores(self, count, kinds, dropped, grams, total: int, words: int, least: int) -> tuple[np.ndarray, ...]:
        """Whether each place's word is known, and log10 of its probability alone and in its context."""
        first = self.ends[:-1]
        seen = count[self.places]
        prob = base = (seen + ADD) / (total + ADD * (words + 1))
        for level in range(1, len(self.at)):
            context, own = Trie._before(self.at[level - 1], first), self.at[level]
            where = np.flatnonzero(context >= 0)
            c = context[where] + self.base[level - 1]
            where, c = where[count[c] >= least], c[count[c] >= least]
            n = (grams if level == len(self.at) - 1 else count[self.base[level] :])[own[where]]
            share = np.where(n >= least, n - DISCOUNT, 0) / count[c]
            left = (dropped[c] + DISCOUNT * kinds[c]) / count[c]
            prob = prob.copy()
            prob[where] = share + left * prob[where]
        return seen > 0, np.log10(base), np.log10(prob)


@dataclass
class _Asked:
    """What a slice asks a bucket, in hashes: ``before`` and ``last`` cut the contexts of more than one word."""

    words: int
    contexts: np.ndarray
    before: np.ndarray
    last: np.ndarray
    counts: np.ndarray
    pairs: np.ndarray
    following: np.ndarray
    times: np.ndarray

    @staticmethod
    def of(data: bytes, by_number: np.ndarray) -> _Asked:
        read = _Reader(data)
        levels = int(read.take(np.int64, 1)[0])
        *sizes, pairs, rare = read.take(np.int64, levels + 2).tolist()
        numbers = [read.planes(n) for level, n in enumerate(sizes) for _ in range(level + 1)] + [read.planes(pairs)]
        left, made = read.take(np.uint64, rare), []
        for number in numbers:
            hashes = by_number[number]
            gone = np.flatnonzero(number == 0)
            hashes[gone], left = left[: len(gone)], left[len(gone) :]
            made.append(hashes)
        contexts, before, last, at = [made[0]], [made[0][:0]], [made[0][:0]], 1
        for level in range(1, levels):
            now = made[at]
            for column in made[at + 1 : at + level]:
                now = _mixed(now, column)
            before.append(now)
            last.append(made[at + level])
            contexts.append(_mixed(now, last[-1]))
            at += level + 1
        counts, n = read.small(sum(sizes)), np.zeros(sum(sizes), dtype=np.int64)
        n[len(n) - sizes[-1] :] = read.small(sizes[-1])
        return _Asked(
            sizes[0], np.concatenate(contexts), np.concatenate(before), np.concatenate(last), counts, n, made[-1],
            read.small(pairs),
        )


def _answers(asked: pa.Table, least: int, hot: np.ndarray, by_number: np.ndarray) -> pa.Table:
    """What a bucket tells each slice: count of each context in training texts, kinds of words behind
    it, tokens of it without a counted word behind them; counts of the n-grams of the highest order.

    The trie of a bucket: contexts are numbered, and a level holds context and next word. Rows
    without a slice have the sums of hot contexts, and for context null the number of words."""
    asks = [_Asked.of(data, by_number) for data in asked.column("ask").to_pylist()]
    joined = lambda name: np.concatenate([getattr(a, name) for a in asks])
    mine = joined("contexts")
    names, number = np.unique(np.concatenate([mine, joined("before")]), return_inverse=True)
    size, number, parent = len(names), number[: len(mine)], number[len(mine) :]
    counts = joined("counts")
    count = np.bincount(number, counts, size).astype(np.int64)
    width = min(NEXT_BITS, 64 - size.bit_length())

    def gram_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
        return context.astype(np.uint64) << np.uint64(width) | word >> np.uint64(64 - width)

    # what follows a context: longer contexts, and the pairs of those of the last level
    keys = gram_keys(np.repeat(number, joined("pairs")), joined("following"))
    longer = np.concatenate([a.counts[a.words :] for a in asks])
    told, times = np.concatenate([gram_keys(parent, joined("last")), keys]), np.concatenate([longer, joined("times")])
    trained = np.flatnonzero(times)
    grams, gram = np.unique(told[trained], return_inverse=True)
    n = np.bincount(gram, times[trained], len(grams)).astype(np.int64)
    grams, n = grams[n >= least], n[n >= least]
    level, above = EliasFano.of(grams), (grams >> np.uint64(width)).astype(np.int64)
    kinds = np.bincount(above, minlength=size)
    dropped = count - np.bincount(above, n, size).astype(np.int64)
    made, a, p = [], 0, 0
    for ask in asks:
        entries, m = len(ask.contexts), len(ask.following)
        at = level.find(keys[p : p + m])
        high = np.where(at >= 0, n[at], 0) if len(n) else np.zeros(m, dtype=np.int64)
        own = number[a : a + entries]
        # a hot context has its sums from all buckets, which may be negative in one
        made.append(_squeezed([np.array([entries, m], dtype=np.int64).tobytes(), *(
            _small(x) for x in (count[own], kinds[own], np.maximum(dropped[own], 0), high)
        )]))
        a, p = a + entries, p + m
    known = np.flatnonzero(np.isin(names, hot))
    words = np.unique(number[np.concatenate([np.arange(len(a.contexts)) < a.words for a in asks])])
    more = len(known) + 1
    def column(kind, own, extra):
        return pa.concat_arrays([pa.nulls(len(made), kind), pa.array([*own.tolist(), extra], kind)])
    return pa.table({
        "slice": pa.concat_arrays([asked.column("slice").combine_chunks().cast(pa.int64()), pa.nulls(more, pa.int64())]),
        "bucket": pa.concat_arrays([asked.column("bucket").combine_chunks().cast(pa.int64()), pa.nulls(more, pa.int64())]),
        "answer": pa.concat_arrays([pa.array(made, pa.binary()), pa.nulls(more, pa.binary())]),
        "context": column(pa.int64(), names[known].astype(np.int64), None),
        "n": column(pa.int64(), count[known], int((count[words] > 0).sum())),
        "kinds": column(pa.int64(), kinds[known], 0),
        "dropped": column(pa.int64(), dropped[known], 0),
    })


def _frequent_contexts(names, places, per, held, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts that hold the share HOT of the places of a slice, and their training tokens."""
    least, out, n = max(2, HOT * len(places)), [], []
    train = np.repeat(~held, per)
    first, at, hashes = bounds(per)[:-1], places, names
    for level in range(order - 1):
        times = np.bincount(at[at >= 0], minlength=len(hashes))
        often = times >= least
        # nothing follows the end, so that a context which ends there has no pairs
        if level == 0:
            often[-1] = False
        out.append(hashes[often])
        n.append(np.bincount(at[(at >= 0) & train], minlength=len(hashes))[often])
        often = np.append(often, False)
        context = Trie._before(at, first)
        where = np.flatnonzero(often[context] & often[places] if level == 0 else often[context])
        keys, number = np.unique(context[where] * len(names) + places[where], return_inverse=True)
        at = np.full(len(places), -1, dtype=np.int64)
        at[where] = number
        hashes = _mixed(hashes[keys // len(names)], names[keys % len(names)])
    return np.concatenate(out or [np.zeros(0, np.uint64)]), np.concatenate(n or [np.zeros(0, np.int64)])


def _packed(part: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(part)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def _tokenised(part: pa.RecordBatch, order: int) -> tuple:
    """A slice as its words' hashes, the words of its places, and its rows without their texts."""
    names, places, per = tokens(part.column("text"))
    held = part.column("held_out").to_numpy(zero_copy_only=False)
    rows = pa.RecordBatch.from_arrays(
        [part.column("id"), part.column("held_out"), pa.array(per)], names=["id", "held_out", "n_tokens"]
    )
    often, n = _frequent_contexts(names, places, per, held, order)
    # the most frequent words first: their places are small numbers
    times = np.bincount(places, minlength=len(names))
    by_times = np.argsort(-times, kind="stable")
    number = np.empty(len(names), dtype=np.int64)
    number[by_times] = np.arange(len(names))
    names, times = names[by_times], times[by_times]
    repeated = times >= REPEATED
    return (
        _packed(rows), names.tobytes(), _squeezed([_planes(number[places])]),
        int(per[~held].sum()), often.astype(np.int64), n, names[repeated].astype(np.int64), times[repeated],
    )


def _numbered(cuts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of at most NUMBERED frequent words in order, their numbers from 1, and hashes by number. How a
    word is sent doesn't change what is counted."""
    words = cuts.select(F.explode(F.arrays_zip("words", "times_of")).alias("z")).groupBy("z.words").agg(
        F.sum("z.times_of").alias("n"))
    words = materialize(words)
    sizes = sorted(((r["n"], r["count"]) for r in words.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).count().collect()), reverse=True)
    least, room = None, NUMBERED
    for n, count in sizes:
        if count > room:
            break
        least, room = n, room - count
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.uint64)
    rows = words.where(F.col("n") >= least).toArrow()
    hashes, n = np.asarray(rows["words"]).astype(np.uint64), np.asarray(rows["n"])
    by_number = hashes[np.lexsort((hashes, -n))]
    order = np.argsort(by_number)
    return by_number[order], order + 1, np.concatenate([np.zeros(1, np.uint64), by_number])


def _slice_of(row: dict, order: int, hot: np.ndarray, buckets: int) -> tuple[pa.RecordBatch, _Slice]:
    rows = _unpacked(row["rows"])
    per, held = np.asarray(rows.column("n_tokens")), rows.column("held_out").to_numpy(zero_copy_only=False)
    names, places = np.frombuffer(row["names"], dtype=np.uint64), _Reader(row["places"]).planes(int(per.sum()))
    return rows, _Slice(names, places, per, held, order, hot, buckets)


def score_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, share: float = SHARE,
    folds: int = FOLDS,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Null texts are empty: their one token is the end. Rows with a null id are learned from. Repeated
    rows are scored each. Without training rows all probabilities are 1. With a ``share``, longer
    n-grams that hold less of the training tokens don't count.
    """
    spark = docs.sparkSession
    buckets = SPREAD * default_partitions(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn(
        "held_out", held_out("id", folds)
    )
    kind = rows.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            made = _tokenised(part, order)
            kinds = [pa.binary()] * 3 + [pa.int64()] + [pa.list_(pa.int64())] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], k) for x, k in zip(made, kinds)],
                names=["rows", "names", "places", "n", "often", "times", "words", "times_of"],
            )

    # written out, so that the numbers given to slices stay the same when a task is run again
    cuts = materialize(rows.mapInArrow(
        cut, "rows binary, names binary, places binary, n long, often array<long>, times array<long>, "
        "words array<long>, times_of array<long>"
    ).withColumn("slice", F.monotonically_increasing_id()))
    total = cuts.agg(F.sum("n").alias("n")).first()["n"] or 0
    least = max(1, ceil(share * total))
    often = cuts.select(F.explode(F.arrays_zip("often", "times")).alias("z")).groupBy("z.often").agg(
        F.sum("z.times").alias("n")
    )
    # each of the order - 1 levels has 1 / HOT of them at most
    often = often.where(F.col("n") >= max(1, HOT * total)).select("often").toArrow()
    hot = np.sort(np.asarray(often.column("often"), dtype=np.int64).astype(np.uint64))

    numbered = spark.sparkContext.broadcast(_numbered(cuts))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own = batch.slice(row, 1).to_pylist()[0]
                asks = list(_slice_of(own, order, hot, buckets)[1].asks(*numbered.value[:2]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([own["slice"]] * len(asks), pa.int64()), pa.array([b for b, _ in asks], pa.int64()),
                     pa.array([x for _, x in asks], pa.binary())], names=["slice", "bucket", "ask"],
                )

    answers = materialize(
        cuts.select("slice", "rows", "names", "places").mapInArrow(ask, "slice long, bucket long, ask binary")
        .groupBy("bucket").applyInArrow(
            lambda table: _answers(table, least, hot, numbered.value[2]),
            "slice long, bucket long, answer binary, context long, n long, kinds long, dropped long",
        )
    )
    let_go(spark)  # of what was asked: the answers are written out
    known = answers.where("slice is null").groupBy("context").agg(
        *(F.sum(c).alias(c) for c in ("n", "kinds", "dropped"))
    ).toArrow().to_pylist()
    words = next((r["n"] for r in known if r["context"] is None), 0)
    known = [r for r in known if r["context"] is not None]
    sums_of = {c: np.array([r[c] for r in known], dtype=np.int64) for c in ("context", "n", "kinds", "dropped")}
    sums_of["context"] = sums_of["context"].astype(np.uint64)
    by_name = np.argsort(sums_of["context"])
    sums_of = {c: x[by_name] for c, x in sums_of.items()}

    def score(cut: pa.Table, told: pa.Table) -> pa.Table:
        batch, own = _slice_of(cut.to_pylist()[0], order, hot, buckets)
        told = told.sort_by("bucket").column("answer").to_pylist()
        seen, base, model = own.scores(*own.told(told, sums_of), total, words, least)
        at = own.ends
        return pa.table({
            "id": batch.column("id"), "held_out": batch.column("held_out"), "n_tokens": batch.column("n_tokens"),
            "n_known": pa.array(sums(seen.astype(np.int64), at)),
            # long sums of a slice would lose digits of short texts: each text is summed by itself
            "base_score": pa.array(np.add.reduceat(base, at[:-1])), "score": pa.array(np.add.reduceat(model, at[:-1])),
        })

    scored = cuts.select("slice", "rows", "names", "places").groupBy("slice").cogroup(
        answers.where("slice is not null").select("slice", "bucket", "answer").groupBy("slice")
    ).applyInArrow(score, f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        "base_score", "score",
    )
