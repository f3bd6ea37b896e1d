"""Byte-pair encoding and decoding with a public tokenizer file.

A text is cut at ASCII white space, which no token spans; a chunk's ids are kept, so that each
distinct chunk is encoded once for as long as it is remembered. A new chunk is normalised and cut
into words as the file says. Two neighbouring bytes of a word that stand side by side in no token
of the vocabulary can't be joined by any merge: there the word is cut for certain. All fragments are
encoded independently of each other, many at a time, and their ids concatenated.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import add_columns, resident

WORD_FILE = "word_bpe_49k.json"
#: Chunks remembered by a Python worker: as many met lately, and as many met before.
REMEMBERED = 130_000
#: Longer chunks (bytes) are merged by themselves, and longer fragments with a heap.
LONG = 1000
#: Texts encoded together, new chunks merged together, and characters of a text looked at together.
BATCH_ROWS, LEARNT, STRETCH = 256, 16_000, 1 << 20
NONE = np.iinfo(np.int32).max
EMPTY = np.uint32(0xFFFFFFFF)
MULTIPLIER, SHIFT = np.uint32(2654435769), np.uint32(12)
#: Below this code point all Unicode versions agree on classes and cases.
AGREED = "՘"
END = "</w>"
BLANK = re.compile("[\\x20\\x09-\\x0D]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def stretches(text: str) -> Iterator[str]:
    """A text in parts of about STRETCH characters, cut at ASCII white space; a longer run without any stays whole."""
    at = 0
    while len(text) - at > STRETCH:
        if (blank := BLANK.search(text, at + STRETCH)) is None:
            break
        yield text[at : blank.start()]
        at = blank.start()
    yield text[at:] if at else text


class WordBPE:
    """The tokenizer of a byte-level BPE file whose words end in a suffix."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model["end_of_word_suffix"] != END or model["continuing_subword_prefix"] or spec["decoder"] is not None:
            raise ValueError(f"{path} is not a word-end BPE file without a decoder")
        vocab: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.special_cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        names = {i: s for s, i in [*vocab.items(), *special.items()]}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        # merges by pair of ids, in a table of open slots; what each makes, by rank
        self.slot_keys, self.slot_ranks = np.full(1 << 20, EMPTY, np.uint32), np.zeros(1 << 20, np.int32)
        self.made = np.zeros(len(model["merges"]), np.int32)
        for rank, (a, b) in enumerate(model["merges"]):
            key = vocab[a] << 16 | vocab[b]
            slot = (key * int(MULTIPLIER) & 0xFFFFFFFF) >> int(SHIFT)
            while self.slot_keys[slot] != EMPTY:
                slot = (slot + 1) & (1 << 20) - 1
            self.slot_keys[slot], self.slot_ranks[slot] = key, rank
            self.made[rank] = vocab[a + b]
        letters = byte_letters()
        byte_of = {c: i for i, c in enumerate(letters)}
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + END] for c in letters], np.int32)
        self.joined = np.zeros(1 << 16, bool)  # byte pairs that stand side by side in some token
        for token in vocab:
            body = [byte_of[c] for c in token.removesuffix(END)]
            self.joined[[a << 8 | b for a, b in zip(body, body[1:])]] = True
        self.path = path
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @cached_property
    def library(self) -> Tokenizer:
        """For texts on which Unicode versions may differ."""
        return Tokenizer.from_file(self.path)

    def cuts(self, word: bytes) -> list[bytes]:
        """The fragments of a word between its forced boundaries."""
        letters = np.frombuffer(word, np.uint8)
        at = np.flatnonzero(self.forced(letters)) + 1
        return [word[i:j] for i, j in zip([0, *at], [*at, len(word)])]

    def forced(self, letters: np.ndarray) -> np.ndarray:
        """Whether there is a forced boundary between each byte and the next."""
        return ~self.joined[letters[:-1].astype(np.uint16) << 8 | letters[1:]]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge ranks of pairs of ids; NONE where there is no merge."""
        keys = left.astype(np.uint32) << 16 | right.astype(np.uint32)
        slots = (keys * MULTIPLIER) >> SHIFT
        found = self.slot_keys[slots]
        out = np.where(found == keys, self.slot_ranks[slots], NONE)
        open_ = np.flatnonzero((found != keys) & (found != EMPTY))
        while len(open_):  # the few whose slot another pair has
            slots[open_] = (slots[open_] + 1) & (len(self.slot_keys) - 1)
            found = self.slot_keys[slots[open_]]
            same = found == keys[open_]
            out[open_[same]] = self.slot_ranks[slots[open_[same]]]
            open_ = open_[~same & (found != EMPTY)]
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many words, one after the other, and how many each word has.

        All fragments advance at once: in a round each applies its merge of lowest rank, leftmost
        first, wherever it occurs; fragments without a merge leave.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths) - 1
        token = self.inner[letters]
        token[ends] = self.last[letters[ends]]
        alive = np.ones(len(letters), bool)
        first = np.zeros(len(letters), bool)
        first[1:] = self.forced(letters)
        first[ends[:-1] + 1] = True
        symbol, fragment, place = token.copy(), np.cumsum(first), np.arange(len(letters))
        while len(symbol):
            begins = np.flatnonzero(np.concatenate(([True], fragment[1:] != fragment[:-1])))
            rank = np.full(len(symbol), NONE, np.int32)
            rank[:-1] = self.ranks(symbol[:-1], symbol[1:])
            rank[begins[1:] - 1] = NONE  # the last of a fragment has no right neighbour
            least = np.repeat(np.minimum.reduceat(rank, begins), np.diff(begins, append=len(symbol)))
            done = least == NONE
            hit = (rank == least) & ~done
            if (hit[1:] & hit[:-1]).any():  # a run of one symbol: every other pair
                at = np.arange(len(hit))
                run = at - np.maximum.accumulate(np.where(hit, -1, at)) - 1
                hit &= run % 2 == 0
            symbol[hit] = self.made[rank[hit]]
            gone = np.concatenate(([False], hit[:-1]))
            alive[place[gone]] = False
            token[place[done]] = symbol[done]
            stay = ~(gone | done)
            symbol, fragment, place = symbol[stay], fragment[stay], place[stay]
        counts = np.add.reduceat(alive.astype(np.int64), ends - lengths + 1) if len(words) else lengths
        return token[alive], counts

    def merge_parts(self, words: list[bytes]) -> list[int]:
        """As merge(), for words of any length: fragment by fragment with a heap where they are few or one is long."""
        if sum(map(len, words)) > LONG and all(len(part) <= LONG for w in words if len(w) > LONG for part in self.cuts(w)):
            return self.merge(words)[0].tolist()
        out: list[int] = []
        for w in words:
            *parts, end = self.cuts(w)
            for part in parts:
                out += self.merge_long(part, False)
            out += self.merge_long(end)
        return out

    def rank_of(self, a: int, b: int) -> int | None:
        """The merge rank of one pair of ids."""
        key = a << 16 | b
        slot = (key * int(MULTIPLIER) & 0xFFFFFFFF) >> int(SHIFT)
        while (found := self.slot_keys.item(slot)) != key:
            if found == EMPTY:
                return None
            slot = (slot + 1) & (len(self.slot_keys) - 1)
        return self.slot_ranks.item(slot)

    def merge_long(self, fragment: bytes, ends: bool = True) -> list[int]:
        """The ids of one fragment of any length, merged with a heap; ends: it is the last of its word."""
        ids = self.inner[np.frombuffer(fragment, np.uint8)].tolist()
        if ends:
            ids[-1] = int(self.last[fragment[-1]])
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.rank_of(ids[i], ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.made.item(rank), -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for p, q in ((left[i], i), (i, right[i])):
                if p >= 0 and q >= 0 and (m := self.rank_of(ids[p], ids[q])) is not None:
                    heapq.heappush(heap, (m, p, ids[p], ids[q]))
        return [x for x in ids if x >= 0]

    def split(self, text: str) -> list[bytes]:
        """The words of a stretch without special tokens, normalised, as bytes."""
        if not text.isascii():
            if max(text) >= AGREED:
                letters = {c: i for i, c in enumerate(byte_letters())}
                found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
                return [bytes(letters[c] for c in w) for w, _ in found]
            # lower-casing letter by letter has no final sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if text.isalpha():
            return [text.encode()]
        if text[-1] in ".,!|" and text[:-1].isalpha():
            return [text[:-1].encode(), text[-1].encode()]
        return [w.encode() for w in self.words.findall(text)]

    def learn(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """The ids of new chunks as little-endian unsigned 32-bit integers."""
        out, plain, words, sizes = {}, [], [], []
        for chunk in chunks:
            if len(chunk) <= LONG:
                if chunk.isalpha():  # ASCII letters only
                    plain.append(chunk)
                    words.append(chunk.lower())
                    sizes.append(1)
                    continue
                if chunk[-1] in b".,!|" and chunk[:-1].isalpha():
                    plain.append(chunk)
                    words += (chunk[:-1].lower(), chunk[-1:])
                    sizes.append(2)
                    continue
            text = chunk.decode("utf-8")
            if len(chunk) > LONG or self.special_cut and "<" in text and self.special_cut.search(text):
                ids: list[int] = []
                for part in self.special_cut.split(text) if self.special_cut else [text]:
                    ids += [self.special[part]] if part in self.special else self.merge_parts(self.split(part) if part else [])
                out[chunk] = np.array(ids, "<u4").tobytes()
            else:
                found = self.split(text)
                plain.append(chunk)
                words += found
                sizes.append(len(found))
        if not words:
            return out | dict.fromkeys(plain, b"")
        ids, counts = self.merge(words)
        raw = ids.astype("<u4").tobytes()
        word_ends = np.concatenate(([0], np.cumsum(counts)))
        ends = (4 * word_ends[np.cumsum(sizes)]).tolist()
        begin = 0
        for chunk, end in zip(plain, ends):
            out[chunk] = raw[begin:end]
            begin = end
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of whole texts as little-endian unsigned 32-bit integers; of NULL: none."""
        out, at = [[] for _ in texts], 0
        parts = [(i, part) for i, text in enumerate(texts) for part in stretches(text or "")]
        while at < len(parts):  # as many texts at once as make a stretch
            until, size = at, 0
            while until < len(parts) and (until == at or size < STRETCH):
                size += len(parts[until][1])
                until += 1
            for (i, _), ids in zip(parts[at:until], self._encode([part for _, part in parts[at:until]])):
                out[i].append(ids)
            at = until
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def _encode(self, texts: list[str]) -> list[bytes]:
        known, old = self.known, self.old
        found, new, gaps = [], {}, []
        for text in texts:
            chunks = text.encode("utf-8").split()
            ids = list(map(known.get, chunks))
            found.append(ids)
            if None in ids:
                where = [k for k, x in enumerate(ids) if x is None]
                missing = [chunks[k] for k in where]
                gaps.append((ids, where, missing))
                new.update(dict.fromkeys(missing))
        unmet = []
        for c in new:
            if (got := old.get(c)) is None:
                unmet.append(c)
            else:
                known[c] = got
        for at in range(0, len(unmet), LEARNT):
            known.update(self.learn(unmet[at : at + LEARNT]))
        for ids, where, missing in gaps:
            for k, c in zip(where, missing):
                ids[k] = known[c]
        if len(known) >= REMEMBERED:  # what isn't met again is forgotten
            self.known, self.old = {}, known
        return list(map(b"".join, found))

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included: the file names no decoder, so tokens stand between blanks."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def tokenizer(path: str) -> WordBPE:
    return resident("bpe", path, lambda: WordBPE(path))


def encode_decode(df: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """df with ids (binary: little-endian unsigned 32-bit), n_tokens and decoded, of each whole text.

    NULL and blank texts have no ids and decode to the empty text. Each row is encoded, repeated
    rows too; columns named like a result are replaced. path is that of the tokenizer file, which
    every executor must have.
    """
    path = path or public_tokenizers.path(WORD_FILE)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        bpe = tokenizer(path)
        ids = bpe.encode(batch.column(0).to_pylist())
        return [pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([bpe.decode(i) for i in ids], pa.string())]

    return add_columns(df, run, "ids binary, n_tokens bigint, decoded string", [text_col], BATCH_ROWS)


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    out = encode_decode(df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("__text")), "__text")
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
