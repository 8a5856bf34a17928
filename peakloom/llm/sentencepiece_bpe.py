"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut where the model can never merge (before a space that follows another character, and around a newline
that no longer piece contains), each distinct word of a batch is encoded once, and all new words are merged together
in flat numpy arrays: every round finds each word's best pair by a segmented minimum, merges its leftmost
occurrences in all words at once, and compacts, until no pair remains.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import text_of

SPACE = "▁"
#: Distinct words that a task keeps encoded; beyond it the memory starts afresh.
CACHE_WORDS = 250_000
#: Texts that are encoded together.
STEP_ROWS = 250
#: Symbols that one call of merge() takes at once, so that its arrays stay in cache.
MERGE_SYMBOLS = 100_000
TABLE_BITS = 20
NONE = np.iinfo(np.int64).max


class Model:
    """Tables of a SentencePiece BPE model: piece ids, pair ranks and the bytes each id decodes to."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        special = [sp.is_control(i) or sp.is_unknown(i) for i in range(size)]
        self.byte_ids = np.full(256, sp.unk_id(), np.int64)
        for i in range(size):
            if sp.is_byte(i):
                self.byte_ids[int(pieces[i][3:5], 16)] = i
        plain = {p: i for i, p in enumerate(pieces) if not (special[i] or sp.is_byte(i))}
        # ids beyond the vocabulary stand for characters that only occur inside pieces
        self.chars = {c: plain[c] for c in plain if len(c) == 1}
        extra = sorted({c for p in plain for c in p} - self.chars.keys())
        self.chars |= {c: size + k for k, c in enumerate(extra)}
        self.size, self.other = size, size + len(extra)  # characters of no piece get ids from `other` on
        symbol = plain | {c: i for c, i in self.chars.items()}
        scores = {p: sp.get_score(i) for p, i in plain.items()}
        rank = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = []
        for p, i in plain.items():
            for k in range(1, len(p)):
                if p[:k] in symbol and p[k:] in symbol:
                    pairs.append((symbol[p[:k]] * self.other + symbol[p[k:]], rank[scores[p]], i))
        pairs.sort()
        table = np.array(pairs or [(-1, 0, 0)], np.int64)
        self.pair_key, self.pair_rank, self.pair_piece = table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy()
        # a hash table of the pairs: -1 empty, -2 shared by several (those are searched for in the sorted keys)
        slot = self.slots(self.pair_key)
        self.table = np.full(1 << TABLE_BITS, -1, np.int32)
        self.table[slot] = np.arange(len(slot))
        self.table[np.flatnonzero(np.bincount(slot, minlength=len(self.table)) > 1)] = -2
        self.char_id = np.arange(1 << 16) + self.other  # of the characters below U+10000
        for c, i in self.chars.items():
            if ord(c) < len(self.char_id):
                self.char_id[ord(c)] = i
        longer = [p for p in plain if len(p) > 1]
        self.cut_spaces = not any(a != SPACE and b == SPACE for p in longer for a, b in zip(p, p[1:], strict=False))
        self.cut_lines = self.cut_spaces and not any("\n" in p for p in longer)
        self.is_byte = np.array([sp.is_byte(i) for i in range(size)])
        texts = [bytes([int(p[3:5], 16)]) if b else b"" if s else p.replace(SPACE, " ").encode() for p, b, s in zip(pieces, self.is_byte, special, strict=True)]
        unknown = sp.unk_id()
        texts[unknown] = sp.decode([unknown]).encode() or b" \xe2\x81\x87 "
        self.text = np.frombuffer(b"".join(texts), np.uint8)
        self.text_len = np.array([len(t) for t in texts], np.int64)
        self.text_at = np.cumsum(self.text_len) - self.text_len
        self.space_first = np.array([(not s) and p.startswith(SPACE) for p, s in zip(pieces, special, strict=True)])

    @staticmethod
    def slots(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NONE: no piece) and the piece it makes."""
        key = np.where((left < self.other) & (right < self.other), left * self.other + right, 0)
        at = self.table[self.slots(key)]
        if (shared := at == -2).any():
            at[shared] = np.minimum(np.searchsorted(self.pair_key, key[shared]), len(self.pair_key) - 1)
        at = np.maximum(at, 0)
        hit = self.pair_key[at] == key
        return np.where(hit, self.pair_rank[at], NONE), self.pair_piece[at]

    def codes(self, text: str) -> np.ndarray:
        """A symbol for each character."""
        flat = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.char_id[np.minimum(flat, 0xFFFF)]
        for k in np.flatnonzero(flat > 0xFFFF).tolist():
            out[k] = self.chars.get(chr(flat[k]), self.other + int(flat[k]))
        return out


@functools.lru_cache(maxsize=4)
def load(path: str) -> Model:
    return Model(path)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def merge(model: Model, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge rounds over flat arrays; word has ascending word numbers. Returns the final symbols and their words."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    rank, made = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int64)
    if len(symbols) > 1:
        same = word[1:] == word[:-1]
        r, p = model.ranks(symbols[:-1], symbols[1:])
        rank[:-1], made[:-1] = np.where(same, r, NONE), p
    while len(symbols):
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        lengths = np.diff(np.r_[first, len(word)])
        best = np.minimum.reduceat(rank, first)
        if (over := best == NONE).any():  # finished words leave
            out = np.repeat(over, lengths)
            done.append((symbols[out], word[out]))
            symbols, word, rank, made = symbols[~out], word[~out], rank[~out], made[~out]
            if not len(symbols):
                break
            lengths = lengths[~over]
            best, first = best[~over], np.cumsum(lengths) - lengths
        best_here = np.repeat(best, lengths)
        at = np.flatnonzero(rank == best_here)
        # pairs that overlap the one before are left out; a tie of another piece ends the round for its word
        piece = made[at]
        chain = np.r_[False, (at[1:] == at[:-1] + 1) & (word[at[1:]] == word[at[:-1]])]
        head = np.maximum.accumulate(np.where(chain, -1, np.arange(len(at))))
        at, piece = (keep := (np.arange(len(at)) - head) % 2 == 0, at[keep])[1], piece[keep]
        own = word[at]
        start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        lead = np.repeat(piece[start], np.diff(np.r_[start, len(at)]))
        # a new pair as good as the best goes before the occurrences further right
        left_merged = np.r_[False, (at[1:] == at[:-1] + 2) & (own[1:] == own[:-1])]
        left = np.where(left_merged, piece[np.maximum(np.arange(len(at)) - 1, 0)], symbols[np.maximum(at - 1, 0)])
        has_left = (at > 0) & (word[np.maximum(at - 1, 0)] == own)
        nxt = np.minimum(at + 2, len(symbols) - 1)
        has_right = (at + 2 < len(symbols)) & (word[nxt] == own)
        lr = np.where(has_left, model.ranks(left, piece)[0], NONE)
        rr = np.where(has_right, model.ranks(piece, symbols[nxt])[0], NONE)
        stop = (np.minimum(lr, rr) <= best_here[at]) | (piece != lead)
        before = np.cumsum(stop) - stop  # stops at earlier places, then of the same word only
        go = (before == np.repeat(before[start], np.diff(np.r_[start, len(at)]))) & (piece == lead)
        at, piece = at[go], piece[go]
        symbols[at] = piece
        alive = np.ones(len(symbols), bool)
        alive[at + 1] = False
        place = np.cumsum(alive) - 1
        symbols, word, rank, made = symbols[alive], word[alive], rank[alive], made[alive]
        at = place[at]
        near = np.zeros(len(symbols), bool)
        near[at] = near[np.maximum(at - 1, 0)] = True
        touched = np.flatnonzero(near)
        nxt = np.minimum(touched + 1, len(symbols) - 1)
        r, p = model.ranks(symbols[touched], symbols[nxt])
        rank[touched] = np.where((nxt > touched) & (word[nxt] == word[touched]), r, NONE)
        made[touched] = p
    if not done:
        return symbols, word
    symbols, word = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
    order = np.argsort(word, kind="stable")
    return symbols[order], word[order]


class Encoder:
    """Encodes batches of texts, keeping the ids of words met before."""

    def __init__(self, model: Model, cache_words: int = CACHE_WORDS):
        self.model, self.cache_words = model, cache_words
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.n = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def words(self, text: str) -> list[str]:
        """The text's words. A word stands for its symbols, which begin with a space unless it begins with a newline."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        if not self.model.cut_spaces:
            return [text.replace(" ", SPACE)]
        if self.model.cut_lines:
            text = text.replace("\n", " \n")
        words = text.split(" ")
        if "" not in words:
            return words
        out, spaces = [], 0
        for w in [*words, None]:
            if w == "":
                spaces += 1
            elif w is None or (self.model.cut_lines and w[0] == "\n"):
                out += ([SPACE * (spaces - 1)] if spaces else []) + ([] if w is None else [w])
                spaces = 0
            else:
                out.append(SPACE * spaces + w)
                spaces = 0
        return out

    def symbols(self, word: str) -> str:
        return word if self.model.cut_lines and word[:1] == "\n" else SPACE + word

    def learn(self, words: list[str]) -> None:
        """Encode words that aren't known yet."""
        for k in range(0, len(words), 50_000):
            block, first = words[k : k + 50_000], len(self.n)
            texts = [self.symbols(w) for w in block]
            sizes = np.array([len(t) for t in texts], np.int64)
            word = np.repeat(np.arange(len(block)), sizes)
            symbols = self.model.codes("".join(texts))
            parts, ends = [], np.cumsum(sizes)
            lo = 0
            while lo < len(block):  # whole words, about MERGE_SYMBOLS at a time
                base = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, base + MERGE_SYMBOLS, "right")))
                parts.append(merge(self.model, symbols[base : ends[hi - 1]].copy(), word[base : ends[hi - 1]]))
                lo = hi
            symbols, word = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            ids, n = self.spelled(symbols, word, len(block))
            self.index.update(zip(block, range(first, first + len(block)), strict=True))
            self.ids, self.n = np.concatenate([self.ids, ids.astype(np.int32)]), np.concatenate([self.n, n])
        self.at = np.cumsum(self.n) - self.n

    def spelled(self, symbols: np.ndarray, word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids with unknown characters spelled as their UTF-8 bytes, and the number of ids of each word."""
        m = self.model
        if (odd := symbols >= m.size).any():
            inner = {i: c for c, i in m.chars.items() if i >= m.size}
            spell = [m.byte_ids[np.frombuffer((inner.get(s) or chr(s - m.other)).encode("utf-8", "replace"), np.uint8)] for s in symbols[odd].tolist()]
            sizes = np.ones(len(symbols), np.int64)
            sizes[odd] = [len(x) for x in spell]
            out = np.repeat(symbols, sizes)
            out[np.repeat(odd, sizes)] = np.concatenate(spell)
            symbols, word = out, np.repeat(word, sizes)
        return symbols, np.bincount(word, minlength=words)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text)."""
        if len(self.index) > self.cache_words:
            self.clear()
        words: list[str] = []
        sizes = []
        for text in texts:
            words += (own := self.words(text))
            sizes.append(len(own))
        if new := set(words) - self.index.keys():
            self.learn(list(new))
        index = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if not len(index):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        n = self.n[index]
        ids = self.ids[ranges(self.at[index], n)]
        ends = np.r_[0, np.cumsum(n)][np.r_[0, np.cumsum(sizes)]]
        return ids, ends


def decode(model: Model, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Texts of id lists: pieces are joined, bytes reassembled (ill-formed ones give U+FFFD), a leading space dropped."""
    sizes = model.text_len[ids]
    flat = model.text[ranges(model.text_at[ids], sizes)].tobytes()
    ends = np.r_[0, np.cumsum(sizes)][offsets]
    out = []
    for k in range(len(offsets) - 1):
        a, b = int(ends[k]), int(ends[k + 1])
        if offsets[k] < offsets[k + 1] and model.space_first[ids[offsets[k]]]:
            a += 1
        out.append(flat[a:b].decode("utf-8", "replace"))
    return out


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text, as the library encodes it without begin and end ids.

    A null or empty text has no ids; nulls in the id pass through; each row is on its own, so repeated rows repeat;
    an empty table gives no rows; columns other than the two named are ignored. Bounded memory: a task keeps at most
    CACHE_WORDS words beside one Arrow batch.
    """

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(encoding(model_path, False), f"id {kind}, ids array<int>")


def encoding(model_path: str, decoded: bool):
    """The function for mapInArrow: (id, ids), and the decoded text if wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        encoder = Encoder(model)
        for batch in batches:
            for k in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(k, STEP_ROWS)
                ids, offsets = encoder.encode(part.column(1).to_pylist())
                out = {"id": part.column(0), "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))}
                if decoded:
                    out["text"] = pa.array(decode(model, ids, offsets), pa.string())
                yield pa.RecordBatch.from_pydict(out)

    return run


def decode_ids(encoded: DataFrame, model_path: str) -> DataFrame:
    """(id, ids, text) of rows (id, ids): the text that the ids spell; null or empty ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            lists = batch.column(1).fill_null([])
            texts = decode(model, lists.flatten().to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "ids", "text"])

    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.select("id", "ids").mapInArrow(run, f"id {kind}, ids array<int>, text string")


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, text): every text encoded and decoded again in one pass over the rows."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(encoding(model_path, True), f"id {kind}, ids array<int>, text string")
