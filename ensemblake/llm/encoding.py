"""Whole-text encoding with the tokenizers library, of new words only where the tokenizer allows it: the rest is Arrow and numpy, without a step of Python a word."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import only


#: What a tokenizer's file must say for its texts to fall apart at white space and its words to be told apart by their last id
#: (fixed values of the file format).
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "truncation": None,
    "padding": None,
}


def by_words(path: str) -> bool:
    """Whether a tokenizer is of the kind whose texts can be encoded word by word; any other gets whole texts."""
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    model, added = own["model"], own["added_tokens"]
    return (
        all(own[k] == v for k, v in BY_WORDS.items())
        and (model["type"], model["end_of_word_suffix"], model["dropout"], model["unk_token"], model["continuing_subword_prefix"]) == ("BPE", "</w>", None, None, None)
        and all(t["content"].startswith("<|") and not set(t["content"]) & set(" \t\r\n") and not (t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"]) for t in added)
    )


#: Characters of text, and texts, that are taken apart at a time.
SLICE_CHARS, SLICE_TEXTS = 3_000_000, 10_000
#: New words in one call of the library, which takes many times their size: simple ones, others.
SIMPLES, OTHERS = 4096, 2000
STOPS = (".", ",")
SPACE, END = 32, 10


def table_of(change: dict[int, int]) -> bytes:
    return bytes(change.get(b, b) for b in range(256))


#: Tabs and line ends are spaces, for UTF-8; and Latin-1 in lower case too, whose characters are composed as they are.
GAPS = table_of({9: SPACE, 10: SPACE, 13: SPACE})
FOLDED = table_of({9: SPACE, 10: SPACE, 13: SPACE} | {b: ord(chr(b).lower()) for b in range(256) if chr(b).isupper()})
#: Bytes of UTF-8 words of the letters a-z and ß-ÿ alone; last bytes of a letter A-Z, a-z, or (after 0xC3) À-ÿ.
SIMPLE = np.isin(np.arange(256), [*range(97, 123), 0xC3, *(b for b in range(0x9F, 0xC0) if b != 0xB7)])
ASCII_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
LATIN_END = np.isin(np.arange(256), [b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)])


def byte_letters() -> dict[str, str]:
    """Bytes that the byte-level alphabet writes as another character than Latin-1 does."""
    odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
    return {chr(b): chr(256 + k) for k, b in enumerate(odd)}


BYTE_LETTERS = {k: v for k, v in byte_letters().items() if SIMPLE[ord(k)]}


def folded(text: str) -> bytes:
    """A text as UTF-8 that has the same ids, with no white space below 128 but spaces, vertical tabs and such; Latin-1 texts in lower case."""
    if "<|" in text:  # which may begin an added token, whose case counts
        return text.encode().translate(GAPS)
    if text.isascii():
        return text.encode().translate(FOLDED)
    try:
        return text.encode("latin-1").translate(FOLDED).decode("latin-1").encode()
    except UnicodeEncodeError:
        return text.encode().translate(GAPS)


def words_of(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts as one binary array, each text followed by a word that is a line end, and the places of these.

    The tokenizer's pattern never joins characters across white space, its normaliser works
    within it, and no added token holds any: ids of a text are those of its words in order.
    Other Unicode spaces stay inside a word, where the library itself splits at them. A single stop
    between a letter and white space is a piece of its own, so it is a word of its own.
    """
    raw = bytearray()
    for text in texts:
        raw += folded(text) if text else b""
        raw.append(END)
    a = np.frombuffer(raw, np.uint8)
    gap, end = a == SPACE, a == END
    cut = gap | end
    if b"<|" not in raw:
        at = np.flatnonzero((a == 44) | (a == 46))
        at = at[cut[at + 1]]  # the last byte is a line end
        cut[at[ASCII_LETTER[a[at - 1]] | LATIN_END[a[at - 1]] & (a[at - 2] == 0xC3)]] = True
    at = np.flatnonzero(cut)
    ends, gaps = end[at], gap[at]
    times = 1 + ends  # a line end is a word, so it is cut off on both sides
    offsets = np.zeros(1 + int(times.sum()), np.int32)
    offsets[1:] = np.repeat(at - np.cumsum(gaps) + gaps, times)
    places = np.cumsum(times)[ends]
    offsets[places] += 1
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(a[~gap])]), places - 1


def spans(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary array and their offsets."""
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def binaries(data: bytes | np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.py_buffer(data)])


#: Letters that are normalised as they are, in either case.
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def one_piece(word: str) -> bool:
    """Letters only, and still so once normalised: one match of the tokenizer's pattern."""
    return bool(LATIN.fullmatch(word)) or word.isalpha() and word.lower().isalpha() and is_normalized("NFC", word) and is_normalized("NFC", word.lower())


def stem_of(chunk: str) -> tuple[str, bool]:
    """A chunk with the same ids, and whether it is one piece: ASCII letters in lower case, without one stop after a letter (its ids come after)."""
    if chunk.isascii():
        if "<|" not in chunk:  # which may begin an added token, whose case counts
            chunk = chunk.lower()
        if chunk.isalpha():
            return chunk, True
        if chunk[-1:] in STOPS and chunk[-2:-1].isalpha():
            chunk = chunk[:-1]
        return chunk, chunk.isalpha()
    if chunk[-1] in STOPS and one_piece(chunk[-2:-1]):
        chunk = chunk[:-1]
    return chunk, one_piece(chunk)


class WordEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, with an end id appended.

    Keeps the words it has met with their ids, as Arrow arrays. Beyond `limit_bytes` those go that weren't met for longest, down to half of it,
    so memory is bounded however many distinct words a corpus has, and frequent words stay. (Finding words takes some four times what is counted, for a while.)
    """

    def __init__(self, path: str, end_id: int = 1, limit_bytes: int = 16_000_000, words: bool | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.end, self.limit = Tokenizer.from_file(path), array("I", [end_id]).tobytes(), limit_bytes
        self.by_words = by_words(path) if words is None else words
        if not self.by_words:
            return
        #: The same model, for words that need no normaliser, split at spaces.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        vocabulary = self.tokenizer.get_vocab()
        top = max(end_id, *vocabulary.values())
        self.kind = "<u2" if top < 1 << 16 else "<u4"
        self.ends_word = np.zeros(top + 1, bool)
        self.ends_word[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.words = pa.array([b"", b"\n"], pa.binary())
        self.ids = pa.array([b"", np.array([end_id], self.kind).tobytes()], pa.binary())
        #: The slice of texts in which each word was met last.
        self.met, self.now = np.zeros(2, np.int32), 0

    def _forget(self) -> None:
        """Of the words beyond the first two, which always stay, those met last stay."""
        if 12 * len(self.words) + sum(len(spans(x)[0]) for x in (self.words, self.ids)) <= self.limit:
            return
        sizes = 12 + sum(np.diff(spans(x)[1]) for x in (self.words, self.ids))
        order = 2 + np.argsort(-self.met[2:], kind="stable")
        keep = np.concatenate(([0, 1], np.sort(order[np.cumsum(sizes[order]) <= self.limit // 2])))
        self.words, self.ids, self.met = self.words.take(pa.array(keep)), self.ids.take(pa.array(keep)), self.met[keep]

    def _learn(self, new: pa.Array) -> None:
        """Ids of new words, which go behind those known."""
        data, offsets = spans(new)
        odd = np.concatenate(([0], np.cumsum(~SIMPLE[data])))[offsets]
        simple = odd[1:] == odd[:-1]
        ids, sizes, places = [], [], [np.flatnonzero(simple), np.flatnonzero(~simple)]
        for at in range(0, len(places[0]), SIMPLES):
            own, n = self._encode_simple(new.take(pa.array(places[0][at : at + SIMPLES])))
            ids.append(own)
            sizes.append(n)
        others = [x.decode() for x in new.take(pa.array(places[1])).to_pylist()]
        for at in range(0, len(others), OTHERS):
            own = self._encode_others(others[at : at + OTHERS])
            ids += own
            sizes.append(np.fromiter(map(len, own), np.int64, len(own)) // 4)
        flat = np.frombuffer(b"".join(ids), "<u4").astype(self.kind)
        place = np.empty(len(new), np.int64)
        place[np.concatenate(places)] = np.arange(len(new))
        self.ids = pa.concat_arrays([self.ids, binaries(flat, np.concatenate(sizes) * flat.itemsize).take(pa.array(place))])

    def _encode_simple(self, words: pa.Array) -> tuple[bytes, np.ndarray]:
        """Words of simple letters, many in one call of the model; the id that ends each word tells them apart."""
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), b" ")[0].as_py()
        text = joined.decode("latin-1")
        if not text.isascii():
            for byte, letter in BYTE_LETTERS.items():
                text = text.replace(byte, letter)
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) == len(words) and ends[-1] == len(ids):
            return ids.tobytes(), np.diff(ends, prepend=0)
        own = self._encode(joined.decode().split(" "))
        return b"".join(own), np.fromiter(map(len, own), np.int64, len(own)) // 4

    def _encode_others(self, words: list[str]) -> list[bytes]:
        """Case is folded by the tokenizer and a final stop is a piece of its own, so many words share a stem."""
        stems = list(map(stem_of, words))
        joined, single = list({s for s, one in stems if one}), list({s for s, one in stems if not one}.union(STOPS))
        known = dict(zip([*joined, *single], [*self._encode_joined(joined), *self._encode(single)], strict=True))
        return [known[s] + known[w[-1]] if len(w) > len(s) else known[s] for w, (s, _) in zip(words, stems, strict=True)]

    def _encode(self, words: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _encode_joined(self, words: list[str]) -> list[bytes]:
        """Words that are one pre-token each, many in one call."""
        out = []
        for at in range(0, len(words), 512):
            part = words[at : at + 512]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
            if len(ends) == len(part) and ends[-1] == ids.nbytes:
                raw = ids.tobytes()
                out += [raw[a:z] for a, z in zip([0, *ends], ends, strict=False)]
            else:
                out += self._encode(part)
        return out

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """In the order of the texts; null is encoded as an empty text."""
        for _, ids in self.encode_keyed((None, t) for t in texts):
            yield ids

    def encode_keyed(self, rows: Iterable[tuple]) -> Iterator[tuple]:
        """(key, text) to (key, ids), in order."""
        if not self.by_words:
            for key, text in rows:
                yield key, array("I", self.tokenizer.encode(text or "", add_special_tokens=False).ids).tobytes() + self.end
            return
        keys, texts, chars = [], [], 0
        for key, text in rows:
            keys.append(key)
            texts.append(text)
            chars += len(text or "")
            if chars >= SLICE_CHARS or len(texts) >= SLICE_TEXTS:
                yield from zip(keys, self._encode_slice(texts), strict=True)
                keys, texts, chars = [], [], 0
        if texts:
            yield from zip(keys, self._encode_slice(texts), strict=True)

    def _encode_slice(self, texts: list[str | None]) -> Iterator[bytes]:
        words, ends = words_of(texts)
        # Known words come first, so their numbers are their places and those of new words follow.
        found = pa.chunked_array([self.words, words]).dictionary_encode().chunk(1)
        had, self.words = len(self.words), found.dictionary
        if len(self.words) > had:
            self._learn(self.words.slice(had))
        self.met, self.now = np.concatenate((self.met, np.zeros(len(self.words) - had, np.int32))), self.now + 1
        self.met[found.indices.to_numpy()] = self.now
        data, offsets = spans(self.ids.take(found.indices))
        del words, found
        self._forget()
        ids, a = data.view(self.kind), 0
        for z in (offsets[ends + 1] // ids.itemsize).tolist():
            yield ids[a:z].astype("<u4").tobytes()
            a = z


def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, text) of batches of two columns, with few texts as Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            few = batch.slice(at, 500)
            yield from zip(few.column(0).to_pylist(), few.column(1).to_pylist(), strict=True)


def encoder(path: str, end_id: int, words: bool) -> WordEncoder:
    """One encoder for each worker process and setting. words: by_words(path), which is read once on the driver."""
    return only(("encoder", path, end_id), lambda: WordEncoder(path, end_id, words=words))
