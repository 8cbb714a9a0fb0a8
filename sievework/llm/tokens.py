"""Token ids of whole texts, from the tokenizers library, with a word cache.

The vocabulary's normaliser (NFC, white space, lower case) and its splitter
never look across ASCII white space, so a text is the sequence of its words.
A text or word of ASCII and Latin-1 letters is lower-cased and split here by
the vocabulary's own rule and each part goes to the library's BPE model; any
other word goes through the library's full ``encode``. Parts are kept in a
dictionary of bounded size, since most parts of a corpus repeat.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from sievework.llm.common import one_model

PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
# fixed values: the splitting rule of the vocabulary file, for Latin-1 lower case
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")
TOUCHING = re.compile("[^\\sa-z0-9ß-öø-ÿ]{2}")
MARKS = frozenset(c for c in map(chr, range(33, 127)) if not c.isalpha())
ARROW_PLAIN = "\\A[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*\\z"
ARROW_HARD = "'|[^\t\n\r A-Za-z0-9À-ÖØ-öø-ÿ]{2}|<\\|"
ARROW_MARK = "[!-@\\[-`{-~]"
ASCII_SPACE = re.compile("[\t\n\v\f\r ]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others
    follow from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    rest = (b for b in range(256) if b not in table)
    table.update({b: chr(256 + n) for n, b in enumerate(rest)})
    return table


class _Parts(dict):
    """Part -> packed ids, in two generations: when the young one is full it
    becomes the old one, so that frequent parts stay and memory is bounded."""

    def __init__(self, model, pack: list[bytes], room: int):
        super().__init__()
        self.tokenize, self.pack, self.room = model.tokenize, pack, room
        self.letters = _byte_letters()
        self.old: dict[str, bytes] = {}

    def __missing__(self, p: str) -> bytes:
        got = self.old.get(p)
        if got is None:
            shown = p if p.isascii() else p.encode().decode("latin-1").translate(self.letters)
            got = b"".join([self.pack[t.id] for t in self.tokenize(shown)])
            if len(p) > 64:
                return got
        if len(self) >= self.room:
            self.old = dict(self)
            self.clear()
        self[p] = got
        return got


class Encoder:
    """Ids of a text as packed little-endian uint32 bytes."""

    def __init__(self, path: str, room: int = 200_000):
        self.whole = Tokenizer.from_file(path)
        pack = [n.to_bytes(4, "little") for n in range(self.whole.get_vocab_size(with_added_tokens=True))]
        self.parts = _Parts(self.whole.model, pack, room)

    def full(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def split(self, text: str) -> list[str]:
        """Parts of a lower-cased plain text. Where no two marks touch and no
        apostrophe occurs, spaces round marks and digits do the rule's work."""
        if "'" in text or TOUCHING.search(text):
            return PARTS.findall(text)
        for c in MARKS.intersection(text):
            text = text.replace(c, f" {c} ")
        return text.split()

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, self.split(text.lower())))

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" not in text and PLAIN.fullmatch(text):
            return self.plain(text)
        words = ASCII_SPACE.split(text)
        return b"".join([self.plain(w) if "<|" not in w and PLAIN.fullmatch(w) else self.full(w) for w in words])


    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each text) of an Arrow array of strings; null is empty.

        Texts without an apostrophe or touching marks are split, and their parts
        numbered, by Arrow; only distinct parts are looked up."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        hard = pc.or_(pc.invert(pc.match_substring_regex(texts, ARROW_PLAIN)), pc.match_substring_regex(texts, ARROW_HARD))
        hard = hard.to_numpy(zero_copy_only=False)
        counts = np.zeros(len(texts), np.int64)
        flat, counts[~hard] = self._easy(texts.filter(pa.array(~hard)))
        if not hard.any():
            return flat, counts
        blobs = [np.frombuffer(self.ids(t.as_py()), "<u4") for t in texts.filter(pa.array(hard))]
        counts[hard] = [b.size for b in blobs]
        parts = np.empty(len(texts), object)
        parts[~hard] = _views(flat, counts[~hard])
        parts[hard] = _views(np.concatenate(blobs), counts[hard])
        return np.concatenate(parts), counts

    def _easy(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        low = pc.replace_substring_regex(pc.utf8_lower(texts), ARROW_MARK, r" \0 ")
        lists = pc.ascii_split_whitespace(low)
        coded = lists.flatten().dictionary_encode()
        blobs = [self.parts[p] if p else b"" for p in coded.dictionary.to_pylist()]
        sizes = np.array([len(b) // 4 for b in blobs], np.int64)
        pool = np.frombuffer(b"".join(blobs), "<u4")
        at = np.concatenate([[0], np.cumsum(sizes)])[:-1] if blobs else np.zeros(0, np.int64)
        code = coded.indices.to_numpy()
        n = sizes[code]
        ends = np.cumsum(n)
        total = int(ends[-1]) if n.size else 0
        take = np.arange(total, dtype=np.int64) + np.repeat(at[code] - ends + n, n)
        bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return pool[take], np.diff(bounds)


def _views(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.empty(counts.size, object)
    ends = np.cumsum(counts)
    for i, (a, b) in enumerate(zip(ends - counts, ends)):
        out[i] = flat[a:b]
    return out


def encoder(path: str) -> Encoder:
    """The worker process's encoder."""
    return one_model(("encoder", path), lambda: Encoder(path))
