"""SentencePiece BPE encoding and decoding by vectorised merge rounds."""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from inkprint.llm.common import bounds, buffers, plain, ragged, slices

SPACE = "▁"
SIDE = 1 << 21  # symbols are pieces or, behind them, single characters outside the vocabulary
LONG_WORD = 2048
SLICE = 4 << 20
NONE = np.iinfo(np.int32).max
SEGMENT = re.compile(r" +[^ ]*")
FIELDS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _byte_by_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("byte_by_byte", _byte_by_byte)


class PieceModel:
    """Merge tables of a SentencePiece BPE model with byte fallback.

    A merge is allowed if the joined text is a piece; the better score goes first, the leftmost
    place first among equal scores. No piece has a space behind another character, so the
    stretches between such places (words with the spaces before them) are independent.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.size = n = sp.get_piece_size()
        probe = " a  b\tAＡ\n"
        if sp.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("only models that leave texts as they are and put a space before them")
        self.text = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
        self.of = {t: i for i, t in enumerate(self.text) if not special[i]}
        if any(SPACE in t[1:].lstrip(SPACE) for t in self.of):
            raise ValueError("a piece has a space behind another character")
        self.byte = np.full(256, -1)
        for i in range(n):
            if sp.is_byte(i):
                self.byte[int(self.text[i][3:5], 16)] = i
        if (self.byte < 0).any():
            raise ValueError("the model has no byte fallback")
        self.character = np.arange(0x110000, dtype=np.int64) + n
        for t, i in self.of.items():
            if len(t) == 1:
                self.character[ord(t)] = i
        score = np.array([sp.get_score(i) for i in range(n)])
        _, rank = np.unique(-score, return_inverse=True)
        rows = sorted(
            (self._symbol(t[:k]) * SIDE + self._symbol(t[k:]), i)
            for t, i in self.of.items()
            for k in range(1, len(t))
            if self._symbol(t[:k]) >= 0 and self._symbol(t[k:]) >= 0
        )
        self.key = np.array([k for k, _ in rows], dtype=np.int64)
        self.merged = np.array([i for _, i in rows] + [0], dtype=np.int64)
        self.rank = np.append(rank[self.merged[:-1]], NONE).astype(np.int64)
        # Of these pieces only one is made per round: a pair with a piece just made may have to go
        # before the other places of the same pair, or another piece has the same score.
        own = self.rank[:-1]
        first = np.full(n + 0x110000, NONE, dtype=np.int64)
        np.minimum.at(first, self.key // SIDE, own)
        np.minimum.at(first, self.key % SIDE, own)
        alone = first[:n] <= rank
        alone |= np.bincount(rank[list(self.of.values())], minlength=rank.max() + 1)[rank] > 1
        self.alone = np.append(alone[self.merged[:-1]], False)
        self.digits, self.digit_at = self._table([f"{i},".encode() for i in range(n)])
        shown = [
            bytes([int(t[3:5], 16)]) if sp.is_byte(i)
            else b"" if sp.is_control(i)
            else " ⁇ ".encode() if sp.is_unknown(i)
            else t.replace(SPACE, " ").encode()
            for i, t in enumerate(self.text)
        ]
        self.shown, self.shown_at = self._table(shown)
        self.control = np.array([sp.is_control(i) for i in range(n)])
        self.leads = np.array([t.startswith(SPACE) and not special[i] for i, t in enumerate(self.text)])

    def _symbol(self, t: str) -> int:
        return self.of.get(t, self.size + ord(t) if len(t) == 1 else -1)

    @staticmethod
    def _table(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(parts), dtype=np.uint8), bounds(np.array([len(p) for p in parts]))

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Number of the merge of each pair; the last number means none."""
        key = left * SIDE + right
        at = np.searchsorted(self.key, key)
        found = self.key[np.minimum(at, len(self.key) - 1)] == key
        return np.where(found, at, len(self.key))

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words (``SPACE`` for spaces) and their number per word."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        symbols, word = self.character[chars], np.repeat(np.arange(len(words)), lengths)
        ends = bounds(lengths)
        done_symbols, done_words = [], []
        for k in np.flatnonzero(lengths > LONG_WORD):
            done_symbols.append(self._one_long(symbols[ends[k] : ends[k + 1]]))
            done_words.append(np.full(len(done_symbols[-1]), k))
        short = (lengths <= LONG_WORD)[word]
        symbols, word = symbols[short], word[short]
        none = len(self.key)
        pair = np.full(len(symbols), none)
        if len(symbols):
            pair[:-1] = np.where(word[:-1] == word[1:], self._pairs(symbols[:-1], symbols[1:]), none)
        while len(symbols):
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(heads, len(word)))
            rank = self.rank[pair]
            best = np.minimum.reduceat(rank, heads)
            over = np.repeat(best == NONE, sizes)
            if over.any():
                done_symbols.append(symbols[over])
                done_words.append(word[over])
                symbols, word, pair, rank = (x[~over] for x in (symbols, word, pair, rank))
                best, sizes = best[best != NONE], sizes[best != NONE]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            # leftmost places that do not overlap: every other one in a run of neighbours
            run = np.append(True, at[1:] != at[:-1] + 1)
            number = np.arange(len(at))
            take = (number - np.maximum.accumulate(np.where(run, number, 0))) % 2 == 0
            lead = np.append(True, word[at[1:]] != word[at[:-1]])
            at = at[np.where(self.alone[pair[at]] | self._word_alone(pair, at, lead), lead, take)]
            symbols = symbols.copy()
            symbols[at] = self.merged[pair[at]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            symbols, word, pair = symbols[keep], word[keep], pair[keep]
            at = moved[at]
            near = np.zeros(len(symbols), dtype=bool)
            near[at] = True
            near[at[at > 0] - 1] = True
            touched = np.flatnonzero(near)
            pair[touched] = none
            touched = touched[touched < len(symbols) - 1]
            touched = touched[word[touched] == word[touched + 1]]
            pair[touched] = self._pairs(symbols[touched], symbols[touched + 1])
        symbols = np.concatenate(done_symbols) if done_symbols else np.zeros(0, dtype=np.int64)
        word = np.concatenate(done_words) if done_words else np.zeros(0, dtype=np.int64)
        order = np.argsort(word, kind="stable")
        return self._bytes(symbols[order], word[order], len(words))

    def _word_alone(self, pair: np.ndarray, at: np.ndarray, lead: np.ndarray) -> np.ndarray:
        """Whether any place of the same word makes a piece that is made alone."""
        group = np.cumsum(lead) - 1
        return np.bincount(group, self.alone[pair[at]])[group] > 0

    def _one_long(self, symbols: np.ndarray) -> np.ndarray:
        """The same merges for a long word, with a queue: n log n whatever the number of rounds."""
        n, none = len(symbols), len(self.key)
        symbols = symbols.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self._pairs(np.array(symbols[:-1]), np.array(symbols[1:]))
        queue = [
            (int(self.rank[p]), i, symbols[i], symbols[i + 1], int(self.merged[p]))
            for i, p in enumerate(first.tolist()) if p != none
        ]
        heapq.heapify(queue)
        known: dict[tuple[int, int], tuple[int, int] | None] = {}

        def push(i: int, j: int) -> None:
            pair = symbols[i], symbols[j]
            if pair not in known:
                p = int(self._pairs(np.array(pair[:1]), np.array(pair[1:]))[0])
                known[pair] = None if p == none else (int(self.rank[p]), int(self.merged[p]))
            if known[pair]:
                heapq.heappush(queue, (known[pair][0], i, *pair, known[pair][1]))

        while queue:
            _, i, left, right, piece = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = piece, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return np.array([s for s in symbols if s >= 0], dtype=np.int64)

    def _bytes(self, symbols: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters outside the vocabulary become the ids of their bytes."""
        other = np.flatnonzero(symbols >= self.size)
        if len(other):
            made, which = np.unique(symbols[other], return_inverse=True)
            raw = [self.byte[list(chr(c - self.size).encode())] for c in made.tolist()]
            count = np.array([len(r) for r in raw])
            sizes = np.ones(len(symbols), dtype=np.int64)
            sizes[other] = count[which]
            at = ragged(bounds(sizes)[other], count[which])
            symbols, word = np.repeat(symbols, sizes), np.repeat(word, sizes)
            symbols[at] = np.concatenate(raw)[ragged(bounds(count)[:-1][which], count[which])]
        return symbols, np.bincount(word, minlength=n).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and their number per text. Each distinct word is encoded once."""
        texts = pc.replace_substring(plain(texts), SPACE, " ")
        odd = pc.or_(pc.match_substring(texts, "  "), pc.or_(
            pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
        odd = np.asarray(pc.and_(odd, pc.greater(pc.binary_length(texts), 0)), dtype=bool)
        lists = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        words, parents = pc.list_flatten(lists), np.asarray(pc.list_parent_indices(lists))
        full = np.asarray(pc.binary_length(texts)) > 0
        keep = full[parents] & ~odd[parents]
        words, parents = words.filter(pa.array(keep)), parents[keep]
        if odd.any():  # more than one space in a row, or at an end: spaces lead the word behind them
            rows = np.flatnonzero(odd)
            more = [[s[1:] for s in SEGMENT.findall(" " + texts[int(r)].as_py())] for r in rows]
            words = pa.concat_arrays(
                [words, pa.array([s for m in more for s in m], type=pa.large_string())]
            )
            parents = np.concatenate([parents, np.repeat(rows, [len(m) for m in more])])
            order = np.argsort(parents, kind="stable")
            words, parents = words.take(pa.array(order)), parents[order]
        coded = words.dictionary_encode()
        distinct = [SPACE + w.replace(" ", SPACE) for w in coded.dictionary.to_pylist()]
        ids, sizes = self.encode_words(distinct)
        code = np.asarray(coded.indices, dtype=np.int64)
        starts, lengths = bounds(sizes)[:-1][code], sizes[code]
        per_text = np.bincount(parents, lengths, minlength=len(texts)).astype(np.int64)
        return ids[ragged(starts, lengths)], per_text

    def digit_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._spread(self.digits, self.digit_at, ids)

    def shown_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._spread(self.shown, self.shown_at, ids)

    @staticmethod
    def _spread(table: np.ndarray, at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = at[ids + 1] - at[ids]
        return table[ragged(at[ids], sizes)], bounds(sizes)

    def decode(self, ids: np.ndarray, per_text: np.ndarray) -> list[bytes]:
        """UTF-8 bytes of the text of each run of ids. The space that encoding put before a text is
        taken off again; a byte that is no UTF-8 becomes U+FFFD."""
        flat, at = self.shown_bytes(ids)
        ends = bounds(per_text)
        out = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            text = flat[at[a] : at[b]].tobytes()
            stops = [a - 1, *(a + np.flatnonzero(self.control[ids[a:b]])).tolist(), b]
            head = next((i + 1 for i, j in zip(stops, stops[1:]) if j > i + 1), b)
            if head < b and self.leads[ids[head]]:
                text = text[1:]
            try:
                text.decode()
                whole = True
            except UnicodeDecodeError:
                whole = False
            if not whole or len(stops) > 2:  # bytes on both sides of a control piece don't join
                runs = [flat[at[i + 1] : at[j]].tobytes() for i, j in zip(stops, stops[1:])]
                text = "".join(r.decode("utf-8", "byte_by_byte") for r in runs).encode()
                if head < b and self.leads[ids[head]]:
                    text = text[1:]
            out.append(text)
        return out


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def _digest(model: PieceModel, texts: pa.Array) -> list[pa.Array]:
    ids, per_text = model.encode(texts)
    ends = bounds(per_text)
    digits, at = model.digit_bytes(ids)
    raw = [
        hashlib.sha256(digits[at[a] : max(at[a], at[b] - 1)].tobytes()).hexdigest()
        for a, b in zip(ends[:-1], ends[1:])
    ]
    back = [hashlib.sha256(t).hexdigest() for t in model.decode(ids, per_text)]
    return [pa.array(per_text, pa.int64()), pa.array(raw), pa.array(back)]


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every text: (id, ids array<int>, decoded string).

    Null and empty texts have no ids and decode to the empty text. Every row gives one row,
    repeated ids too; other columns are not looked at. Texts of any length are handled; words
    over ``LONG_WORD`` characters are merged by a queue instead of rounds, with the same ids.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for part in slices(batches, text_col, SLICE):
            ids, per_text = model.encode(part.column(text_col))
            lists = pa.LargeListArray.from_arrays(bounds(per_text), pa.array(ids, pa.int32()))
            shown = [t.decode() for t in model.decode(ids, per_text)]
            yield pa.RecordBatch.from_arrays(
                [part.column(id_col), lists.cast(pa.list_(pa.int32())), pa.array(shown, pa.string())],
                names=[id_col, "ids", "decoded"],
            )

    return docs.select(id_col, text_col).mapInArrow(
        work, f"`{id_col}` {kind}, ids array<int>, decoded string"
    )


def digest_texts(
    docs: DataFrame, path: str, keep: list[str], text_col: str = "text", also: bool = False
) -> DataFrame:
    """``keep`` columns of every row with n_tokens, ids_sha256 and decoded_sha256 of its text.

    One pass without a shuffle. Null and empty texts: 0 tokens, digests of the empty text.
    """
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for part in slices(batches, text_col, SLICE):
            made = _digest(model, part.column(text_col))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in keep), *made],
                names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    columns = list(dict.fromkeys([*keep, text_col]))
    return docs.select(*columns).mapInArrow(work, f"{kept}, {FIELDS}")
